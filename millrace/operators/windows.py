"""Windows over token arrays: sliding windows, evaluation targets, replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cut


def starts(n: Column, length: int, stride: int, first: int = 0) -> Column:
    """first, first + stride, ... as long as length fits in n; empty if none does."""
    last = n - length
    # sequence() counts down or fails on an empty range, so the guard is inside the expression
    return F.when(last >= first, F.sequence(F.lit(first), F.greatest(last, F.lit(first)), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def sliding(df: DataFrame, tokens: str, length: int, stride: int, most: int | None = None) -> DataFrame:
    """A row for each full window: window_index, window_start and its tokens."""
    at = starts(F.size(tokens), length, stride)
    at = at if not most else F.slice(at, 1, most)
    out = df.select("*", F.posexplode(at).alias("window_index", "window_start"))
    return out.withColumn(tokens, F.slice(tokens, F.col("window_start") + 1, length))


def target_starts(n: Column, prefix: int, middle: int, suffix: int, stride: int, offset: int = 0, layout: str = "matched_context") -> Column:
    """Places of a target: with the same context on both sides (matched), or between prefix and suffix."""
    if layout == "matched_context":
        context = max(prefix, suffix) if prefix + suffix == 0 else prefix + suffix
        return starts(n, middle + context, stride, context + offset)
    return starts(n, middle + suffix, stride, prefix + offset)


def min_gap(at: Column, gap: int) -> Column:
    """Greedy: each place at least gap after the last one taken."""
    empty = F.slice(at, 1, 0)
    return F.aggregate(at, empty, lambda got, x: F.when((F.size(got) == 0) | (x - F.element_at(F.when(F.size(got) > 0, got), -1) >= gap), F.concat(got, F.array(x))).otherwise(got))


def segments(tokens: Column, start: Column, prefix: int, middle: int, suffix: int) -> tuple[Column, Column, Column]:
    return cut(tokens, start - prefix, start), cut(tokens, start, start + middle), cut(tokens, start + middle, start + middle + suffix)


def replicate(df: DataFrame, copies: Column | int, id_column: str, order: str) -> DataFrame:
    """copies rows of each row, with replica_count and replica_index."""
    copies = F.lit(copies) if isinstance(copies, int) else copies
    base = df if "base_excerpt_id" in df.columns else df.withColumn("base_excerpt_id", F.col(id_column))
    return base.withColumn("replica_count", copies).withColumn("replica_index", F.explode(F.sequence(F.lit(0), F.col("replica_count") - 1)))
