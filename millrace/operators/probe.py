"""The probe's windows: candidates, selection, counterfactual contexts, paired examples, shards and summaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.arrays import cut
from ..functions.rng import sample_sorted, seed_column
from . import windows as W

#: Places of samples that a window looks through at once.
BLOCK = 1024


@dataclass(frozen=True)
class Geometry:
    """Lengths in tokens; a target's candidates stand at every stride, selected ones a whole window apart."""

    prefix: int
    middle: int
    suffix: int
    stride: int
    offset: int = 0
    layout: str = "matched_context"

    @property
    def span(self) -> int:
        return self.prefix + self.middle + self.suffix

    def starts(self, n: Column) -> Column:
        return W.target_starts(n, self.prefix, self.middle, self.suffix, self.stride, self.offset, self.layout)


def candidates(samples: DataFrame, g: Geometry, most: int = 0, selection: str = "uniform", seed: int = 0) -> DataFrame:
    """(id, size) -> id, starts (all candidates), chosen (the selected ones).

    Selected: greedily, a whole window apart; of more than most (0: no limit) the first, or a keyed draw.
    """
    if selection not in ("first", "uniform"):
        raise ValueError(f"no selection is called {selection}")
    rows = samples.withColumn("starts", g.starts(F.col("size"))).withColumn("chosen", W.min_gap(F.col("starts"), g.span))
    if most > 0 and selection == "first":
        rows = rows.withColumn("chosen", F.slice("chosen", 1, most))
    elif most > 0:
        drawn = sample_sorted(seed_column(F.lit(str(seed)), F.col("id").cast("string"), F.lit("windows")).cast("string"), F.col("chosen"), F.lit(most))
        rows = rows.withColumn("chosen", F.when(F.size("chosen") > most, drawn).otherwise(F.col("chosen")))
    return rows


def windows(rows: DataFrame) -> DataFrame:
    """candidates() -> id, window_index (among all candidates), target_start, candidate_window_count."""
    at = F.arrays_zip(F.transform("starts", lambda x: x).alias("target_start"), F.sequence(F.lit(0), F.greatest(F.size("starts") - 1, F.lit(0))).alias("window_index"))
    out = rows.select("id", "chosen", F.size("starts").alias("candidate_window_count"), F.explode(at).alias("w")).select("id", "w.window_index", "w.target_start", "candidate_window_count", "chosen")
    return out.filter(F.array_contains("chosen", F.col("target_start"))).drop("chosen")


def counters(rows: DataFrame) -> DataFrame:
    """candidates() -> one row: excerpts, those with windows and without, candidates, selected."""
    some = F.size("chosen") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("num_excerpts"), total(some.cast("int")).alias("num_excerpts_with_windows"), total((~some).cast("int")).alias("num_short_excerpts"), total(F.size("starts")).alias("num_candidate_windows"), total(F.size("chosen")).alias("num_selected_windows")
    )


def cut_out(found: DataFrame, tokens: DataFrame, g: Geometry) -> DataFrame:
    """found (id, target_start, ...), tokens (id, t) -> found with prefix, middle and suffix.

    An excerpt's windows wait for its tokens together, so that no window carries the whole excerpt; an excerpt has no
    more windows than tokens. A window that is found twice is one; of rows of tokens that share an id the longest (then
    the greatest) counts; null ids have none.
    """
    rest = [c for c in found.columns if c != "id"]
    by = found.groupBy("id").agg(F.collect_set(F.struct(*rest)).alias("_w"))
    t, a = F.col("t"), lambda w: w["target_start"]
    parts = F.transform(
        "_w", lambda w: F.struct(*(w[c].alias(c) for c in rest), cut(t, a(w) - g.prefix, a(w)).alias("prefix"), cut(t, a(w), a(w) + g.middle).alias("middle"), cut(t, a(w) + g.middle, a(w) + g.middle + g.suffix).alias("suffix"))
    )
    one = tokens.filter("id is not null").groupBy("id").agg(F.max(F.struct(F.size("t").alias("n"), "t")).alias("_o")).select("id", "_o.t")
    return by.join(one, "id").select("id", F.explode(parts).alias("_p")).select("id", "_p.*")


def ladder(sizes: np.ndarray) -> list[np.ndarray]:
    """Of each place the largest size among it and the following: of 1, 2, 4, ... of them; what reaches past the end has no bound."""
    levels = [np.append(sizes.astype(np.int64), np.iinfo(np.int64).max)]
    while 1 << len(levels) <= len(sizes):
        step, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.append(np.maximum(last[:-step], last[step:]), np.full(step, last[-1])))
    return levels


def climb(levels: list[np.ndarray], at: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The first places from at on whose sizes are need or more; the number of sizes if there is none."""
    for k in reversed(range(len(levels))):
        at = np.where(levels[k][at] < need, at + (1 << k), at)
    return at


def answered(asks: DataFrame, places: DataFrame) -> DataFrame:
    """asks (block, pos, own, need, id, target_start), places (block, pos, size, id) -> asks with other: the first sample of
    the block from pos on, but for the one at own, of size need or more (null if the block has none).

    A task holds one block's samples; its asks pass by in batches.
    """
    kinds = dict(asks.dtypes)
    names = ["block", "pos", "own", "need", "id", "target_start"]
    rows = places.select("block", F.lit(0).alias("side"), "pos", F.lit(0).cast("long").alias("own"), F.col("size").alias("need"), "id", F.lit(0).cast(kinds["target_start"]).alias("target_start"))
    rows = rows.unionByName(asks.select("block", F.lit(1).alias("side"), *names[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, levels = None, [], []
        for b in batches:
            block, side = b.column("block").to_numpy(), b.column("side").to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if key != block[lo]:
                    key, held, levels = block[lo], [], []
                if side[lo] == 0:
                    held.append(part)
                    continue
                if not levels:
                    samples = pa.Table.from_batches(held).combine_chunks()
                    first, ids = samples.column("pos")[0].as_py(), samples.column("id").combine_chunks()
                    levels = ladder(samples.column("need").to_numpy())
                pos, own, need = (part.column(c).to_numpy() for c in ("pos", "own", "need"))
                at = climb(levels, pos - first, need)
                at = np.where(at + first == own, climb(levels, np.minimum(at + 1, len(ids)), need), at)
                other = ids.take(pa.array(at, pa.int64(), mask=at == len(ids)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), other], [*names, "other"])

    kind = f"block long, pos long, own long, need long, id {kinds['id']}, target_start {kinds['target_start']}, other {kinds['id']}"
    return rows.repartition("block").sortWithinPartitions("block", "side", "pos").mapInArrow(run, kind)


def distractors(found: DataFrame, samples: DataFrame, g: Geometry, seed: int = 0) -> DataFrame:
    """found (id, target_start), samples (id, size) -> id, target_start, distractor: the first other sample, from a keyed
    place on and around, whose tokens reach over the window (null if there is none). Null ids take no part; of rows that
    share an id the longest counts.

    Samples stand in blocks of BLOCK places. A window looks in the block of its place; those that find none there go to the
    next block around that has one, told by the two largest sizes of each block, all that passes the driver. So rows are
    as many as samples and windows, whatever the lengths.
    """
    from ..plans.corpus import global_rank
    from ..session import settle

    width = BLOCK
    found = found.filter("id is not null").select("id", "target_start").distinct()
    samples = samples.filter("id is not null").groupBy("id").agg(F.coalesce(F.max("size"), F.lit(-1)).cast("long").alias("size"))
    places = settle(global_rank(samples, [F.col("id").asc()], "id").select("id", "size", (F.col("rank") - 1).cast("long").alias("pos")))
    places = places.withColumn("block", F.floor(F.col("pos") / width))
    n = places.agg(F.count("*").cast("decimal(20,0)").alias("n"))
    key = seed_column(F.lit(str(seed)), F.col("id").cast("string"), F.col("target_start").cast("string"), F.lit("distractor"))
    asks = found.join(places.select("id", F.col("pos").alias("own")), "id", "left").crossJoin(F.broadcast(n))
    asks = asks.select("id", "target_start", F.coalesce("own", F.lit(-1)).alias("own"), (F.col("target_start") + g.middle + g.suffix).cast("long").alias("need"), (key % F.col("n")).cast("long").alias("pos"))
    first = settle(answered(asks.withColumn("block", F.floor(F.col("pos") / width)), places))
    largest = places.groupBy("block").agg(F.slice(F.sort_array(F.collect_list("size"), asc=False), 1, 2).alias("top")).orderBy("block").collect()  # of so many sizes each
    most = np.array([r.top[0] for r in largest], np.int64)
    second = np.array([r.top[1] if len(r.top) > 1 else -1 for r in largest], np.int64)

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, blocks = ladder(np.concatenate((most, most))), len(most)
        for b in batches:
            block, own, need = (b.column(c).to_numpy() for c in ("block", "own", "need"))
            at = climb(levels, block + 1, need)
            # its own block only for another sample
            alone = (own >= 0) & (at % blocks == own // width) & (second[own // width] < need)
            at = np.where(alone, climb(levels, np.minimum(at + 1, 2 * blocks), need), at)
            at = pa.array(np.where(at <= block + blocks, at % blocks, -1))
            yield pa.RecordBatch.from_arrays([at, *(b.column(c) for c in b.schema.names[1:])], b.schema.names)

    names = ["block", "own", "need", "id", "target_start"]
    kinds = dict(first.dtypes)
    left = first.filter("other is null").select(*names).mapInArrow(onward, ", ".join(f"{c} {kinds[c]}" for c in names))
    left = settle(left.withColumn("pos", F.col("block") * width))
    later = answered(left.filter("block >= 0"), places)
    parts = [x.select("id", "target_start", F.col("other").alias("distractor")) for x in (first.filter("other is not null"), later, left.filter("block < 0").withColumn("other", F.lit(None).cast(kinds["id"])))]
    return reduce(DataFrame.unionByName, parts)


def swapped(found: DataFrame, tokens: DataFrame, g: Geometry, interventions: tuple[str, ...], seed: int = 0, samples: DataFrame | None = None) -> DataFrame:
    """found (id, target_start) -> a row for each intervention: prefix and suffix, of the window or of its distractor.

    A side of no length is never replaced. A window that needs a distractor and has none keeps null contexts. samples
    (id, size) are those of tokens, if they are told already. Tokens are moved once, for both.
    """
    from ..session import settle

    samples = tokens.select("id", F.size("t").alias("size")) if samples is None else samples
    pairs = settle(distractors(found, samples, g, seed))
    wants = pairs.select("id", "target_start", F.col("id").alias("of"), F.lit(True).alias("own"))
    others = pairs.filter("distractor is not null").select(F.col("distractor").alias("id"), "target_start", F.col("id").alias("of"), F.lit(False).alias("own"))
    cuts = cut_out(wants.unionByName(others), tokens, g)
    parts = cuts.groupBy(F.col("of").alias("id"), "target_start").agg(F.max(F.when(F.col("own"), F.struct("prefix", "middle", "suffix"))).alias("own"), F.max(F.when(~F.col("own"), F.struct("prefix", "suffix", F.col("id").alias("distractor")))).alias("other"))
    rows = parts.filter("own is not null").select("id", "target_start", "own.*", "other.distractor", F.col("other.prefix").alias("other_prefix"), F.col("other.suffix").alias("other_suffix"))
    rows = rows.withColumn("context_intervention", F.explode(F.array(*(F.lit(x) for x in interventions))))
    sides = {"prefix": g.prefix, "suffix": g.suffix}
    for side, length in sides.items():
        rows = rows.withColumn(f"{side}_is_distractor", F.col("context_intervention").isin(f"{side}_distractor", "both_distractor") & F.lit(length > 0))
        rows = rows.withColumn(side, F.when(F.col(f"{side}_is_distractor"), F.col(f"other_{side}")).otherwise(F.col(side)))
    used = F.col("prefix_is_distractor") | F.col("suffix_is_distractor")
    return rows.withColumn("distractor", F.when(used, F.col("distractor"))).drop("other_prefix", "other_suffix")


def paired_examples(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows (keys, model: no_fim or fim_v2, p, nll, extractable), one a window and model -> the k best windows of each
    scenario (ltr_only, fim_only, both), ranked; an error if a scenario has none.

    Only k rows of a scenario leave each part before they meet.
    """
    side = lambda m, x: rows.filter(F.col("model") == m).select(*keys, F.col("p").alias(f"{x}_p"), F.col("nll").alias(f"{x}_nll"), F.col("extractable").alias(f"{x}_x"))
    both = side("no_fim", "no").join(side("fim_v2", "fim"), keys)
    a, b = F.col("no_x") > 0, F.col("fim_x") > 0
    both = both.withColumn("scenario", F.when(a & b, "both").when(a, "ltr_only").when(b, "fim_only")).filter("scenario is not null")
    no, fim = F.col("no_p"), F.col("fim_p")
    score = lambda x, y, nll: F.struct(x.alias("s1"), (x / F.greatest(y, F.lit(1e-300))).alias("s2"), (-nll).alias("s3"))
    equal = F.struct(F.least(no, fim).alias("s1"), (no + fim).alias("s2"), (-F.greatest("no_nll", "fim_nll")).alias("s3"))
    both = both.withColumn("score", F.when(F.col("scenario") == "ltr_only", score(no, fim, F.col("no_nll"))).when(F.col("scenario") == "fim_only", score(fim, no, F.col("fim_nll"))).otherwise(equal))
    w = Window.partitionBy("scenario").orderBy(F.desc("score"), *keys)
    best = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("score", "no_x", "fim_x")
    missing = F.array_except(F.array(*(F.lit(x) for x in ("ltr_only", "fim_only", "both"))), F.collect_set("scenario"))
    whole = best.agg(missing.alias("missing"))  # of 3 k rows
    checked = F.when(F.size("missing") == 0, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("no pairs for "), F.array_join("missing", ", "))).cast("int"))
    return best.crossJoin(F.broadcast(whole)).withColumn("rank", checked).drop("missing")


def in_shard(window_id: Column, shards: int) -> Column:
    return F.pmod(window_id, F.lit(shards))


def summary(rows: DataFrame, metrics: list[str], rates: list[str]) -> DataFrame:
    """One row: num_windows, metrics (name -> mean and population deviation of its finite values), match_rates."""
    value = lambda m: F.when(S.finite(F.col(m).cast("double")), F.col(m).cast("double"))
    stats = [F.struct(F.coalesce(F.avg(value(m)), F.lit(S.NAN)).alias("mean"), F.coalesce(F.stddev_pop(value(m)), F.lit(S.NAN)).alias("std")) for m in metrics]
    pairs = lambda names, cells: F.create_map(*(x for n, c in zip(names, cells, strict=True) for x in (F.lit(n), c)))
    return rows.agg(F.count("*").alias("num_windows"), pairs(metrics, stats).alias("metrics"), pairs(rates, [F.coalesce(F.avg(value(m)), F.lit(S.NAN)) for m in rates]).alias("match_rates"))


def summary_document(one: DataFrame, **fields) -> DataFrame:  # noqa: ANN003
    """A summary's row as a JSON document, with the run's fields beside."""
    return one.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in fields.items()), *one.columns), {"ignoreNullFields": "false"}).alias("document"))


def row_metrics(truth: Column, made: Column, lcs: Column) -> dict[str, Column]:
    """A window's metrics from its target, what was generated (null: nothing was) and their longest common subsequence."""
    from ..functions.arrays import matches, type_token_ratio

    n = F.size(truth)
    checked = F.when(made.isNull() | (F.size(made) == n), made).otherwise(F.raise_error(F.lit("what is generated must be as long as the target")).cast("array<string>"))
    share = lambda c: F.when(made.isNull(), S.NAN).otherwise(F.when(n > 0, c / F.greatest(n, F.lit(1))).otherwise(0.0))
    same = F.when(made.isNotNull(), matches(truth, F.coalesce(checked, truth)))
    part = share(lcs)
    at_least = lambda x: F.when(made.isNull(), S.NAN).otherwise((part >= x).cast("double"))
    return {
        "true_length": n, "generated_length": F.when(made.isNull(), 0).otherwise(F.size(made)), "positional_match_count": F.coalesce(same, F.lit(0)), "memorization_score": share(same), "token_accuracy": share(same),
        "LCS_length": F.coalesce(lcs, F.lit(0)), "LCS": part, "Rouge-L": part, "TTR_ref": type_token_ratio(truth), "TTR_gen": F.when(made.isNull(), S.NAN).otherwise(type_token_ratio(F.coalesce(made, truth))),
        "exact_match": F.when(made.isNull(), S.NAN).otherwise((made == truth).cast("double")), "match_ge_0_75": at_least(0.75), "match_ge_0_50": at_least(0.5), "match_ge_0_25": at_least(0.25),
    }
