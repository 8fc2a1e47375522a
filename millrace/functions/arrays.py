"""Token arrays: stripping, layouts, shingles, overlap. Indices count from 0, ends are exclusive."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The special ids of the layouts.
PRE, MID, SUF, BOS, EOS, PAD = 128002, 128003, 128005, 128000, 128001, 128011


def cut(a: Column, begin: Column | int, end: Column | int) -> Column:
    """a[begin:end], empty where nothing is inside."""
    begin, end = (F.lit(x) if isinstance(x, int) else x for x in (begin, end))
    begin = F.greatest(begin, F.lit(0))
    return F.slice(a, begin + 1, F.greatest(F.least(end, F.size(a)) - begin, F.lit(0)))


def one(*ids: int) -> Column:
    return F.array(*(F.lit(x) for x in ids))


def strip_bounds(a: Column, bos: int = BOS, eos: int = EOS) -> tuple[Column, Column]:
    """[begin, end) without all leading bos and all trailing eos ids."""
    # the passes over the array are taken only where an end needs them
    begin = F.when(F.get(a, F.lit(0)) != bos, 0).otherwise(F.coalesce(F.array_min(F.transform(a, lambda x, i: F.when(x != bos, i))), F.size(a)))
    end = F.when(F.get(a, F.size(a) - 1) != eos, F.size(a)).otherwise(F.coalesce(F.array_max(F.transform(a, lambda x, i: F.when(x != eos, i + 1))), F.lit(0)))
    return begin, F.when(a.isNotNull(), F.greatest(begin, end))


def strip(a: Column, bos: int = BOS, eos: int = EOS) -> Column:
    begin, end = strip_bounds(a, bos, eos)
    bare = (F.get(a, F.lit(0)) != bos) & (F.get(a, F.size(a) - 1) != eos)
    return F.when(bare, a).otherwise(cut(a, begin, end))


def cap(a: Column, n: int | None) -> Column:
    return a if n is None else F.when(F.size(a) <= n, a).otherwise(cut(a, 0, max(n, 0)))


def clean_ltr(a: Column) -> Column:
    return F.concat(a, one(EOS))


def even_cuts(a: Column) -> tuple[Column, Column]:
    third = F.floor(F.size(a) / 3).cast("int")
    return third, third * 2


def fim(a: Column, left: Column, middle: Column) -> Column:
    """Prefix, suffix, then middle, each behind its mark."""
    return F.concat(one(PRE), cut(a, 0, left), one(SUF), cut(a, middle, F.size(a)), one(MID), cut(a, left, middle), one(EOS))


def legacy_ltr(a: Column, left: Column, middle: Column) -> Column:
    return F.concat(one(PRE), cut(a, 0, left), one(MID), cut(a, left, middle), one(SUF), cut(a, middle, F.size(a)), one(EOS))


def one_eos(a: Column) -> Column:
    """a, or an error unless it holds exactly one end."""
    return F.when(F.size(F.filter(a, lambda x: x == EOS)) == 1, a).otherwise(F.raise_error(F.lit("a sequence must hold exactly one end")))


def shingles(a: Column, k: int = 5) -> Column:
    """Distinct runs of k; one run of all if there are fewer; none of none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - k + 1, F.lit(1))), lambda i: F.slice(a, i, k))
    return F.when(F.size(a) == 0, F.slice(F.array(a), 1, 0)).when(a.isNotNull(), F.array_distinct(runs))


def word_shingles(a: Column, k: int = 5) -> Column:
    """The same for words without spaces, as texts: distinct arrays are told by comparing each with each, texts by hash."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(a, i, k), " "))
    return F.when(F.size(a) == 0, F.array().cast("array<string>")).when(a.isNotNull(), F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence: one row of the table at a time, folded over a."""
    zero = F.transform(b, lambda _: F.lit(0))
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("diagonal"), F.slice(zero, 1, 0).alias("row"))

    def next_row(row: Column, x: Column) -> Column:
        def cell(state: Column, at: Column) -> Column:
            above = at["above"]
            value = F.when(at["y"] == x, state["diagonal"] + 1).otherwise(F.greatest(above, state["last"]))
            return F.struct(value.alias("last"), above.alias("diagonal"), F.concat(state["row"], F.array(value)).alias("row"))

        return F.aggregate(F.zip_with(b, row, lambda y, above: F.struct(y.alias("y"), above.alias("above"))), start, cell, lambda s: s["row"])

    return F.coalesce(F.element_at(F.when(F.size(b) > 0, F.aggregate(a, zero, next_row)), -1), F.lit(0))


@F.pandas_udf(IntegerType())
def long_lcs_length(x: pd.Series, y: pd.Series) -> pd.Series:
    """The same for arrays of any length: a bit for each place of the second, a few operations for each of the first."""

    def of(a: Sequence, b: Sequence) -> int:
        at: dict = {}
        for i, w in enumerate(b):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(b)) - 1
        open_ = full  # a bit is cleared where the length grows
        for w in a:
            hit = open_ & at.get(w, 0)
            open_ = (open_ + hit | open_ - hit) & full
        return len(b) - open_.bit_count()

    return pd.Series([None if a is None or b is None else of(a, b) for a, b in zip(x, y, strict=True)], dtype="Int32")


def rouge_l(reference: Column, predicted: Column, lcs: Column | None = None) -> Column:
    lcs = lcs_length(reference, predicted) if lcs is None else lcs
    p, r = lcs / F.greatest(F.size(predicted), F.lit(1)), lcs / F.greatest(F.size(reference), F.lit(1))
    return F.when(lcs == 0, 0.0).otherwise(2 * p * r / (p + r))


def type_token_ratio(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1)))


def matches(a: Column, b: Column) -> Column:
    """Positions at which two arrays of one length agree; null if either is."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), same).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("int"))


def packed_boundaries(a: Column, eod: int) -> Column:
    """0, the place after each end of document, and the length if the last one is not final."""
    after = F.filter(F.transform(a, lambda x, i: F.when(x == eod, i + 1)), lambda x: x.isNotNull())
    inside = F.concat(F.array(F.lit(0)), after)
    return F.when(F.element_at(inside, -1) == F.size(a), inside).otherwise(F.concat(inside, F.array(F.size(a))))


def prompt(prefix: Column, suffix: Column, fill: Column) -> Column:
    """What is shown to a model: the prefix alone, or prefix and suffix behind their marks and the middle's mark."""
    return F.when(fill, F.concat(one(PRE), prefix, one(SUF), suffix, one(MID))).otherwise(prefix)
