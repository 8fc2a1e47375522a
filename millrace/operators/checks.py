"""Rules that a run's arguments and its buckets must keep; a broken one is an error that names it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suite import INTERVENTIONS


def _require(rules: list[tuple[bool, str]]) -> None:
    broken = [says for holds, says in rules if not holds]
    if broken:
        raise ValueError("; ".join(broken))


def probe_arguments(
    prefix: int, middle: int, suffix: int, stride: int, *, offset: int = 0, layout: str = "matched_context", prompt_format: str = "ltr_prefix", intervention: str = "full", most: int = 0, batch: int = 1,
    shards: int = 1, rank: int = 0, expected_shards: int | None = None, top_k: int = 1, temperature: float = 1.0, threshold: float = 1.0, budget: int | None = None,
) -> int:
    """The context's length, prefix and suffix together; or an error with every rule that the arguments break."""
    ltr, plain = prompt_format == "ltr_prefix", layout.startswith("cooper_")
    _require([
        (min(prefix, middle, suffix, offset) >= 0, "lengths and offset must not be negative"), (middle > 0, "the middle must not be empty"), (stride > 0, "the stride must be positive"),
        (not ltr or suffix == 0, "ltr_prefix takes no suffix"), (not ltr or prefix > 0, "ltr_prefix needs a prefix"), (most >= 0, "windows of an excerpt can't be fewer than none"), (batch > 0, "a batch holds one at least"),
        (shards > 0, "there is one shard at least"), (0 <= rank < max(shards, 1), "a shard's rank lies below their number"), (expected_shards is None or expected_shards > 0, "one shard at least is expected"),
        (top_k > 0, "top_k must be positive"), (temperature > 0, "the temperature must be positive"), (0 < threshold <= 1, "the threshold lies in (0, 1]"), (not plain or (ltr and suffix == 0), f"{layout} is for ltr_prefix without a suffix"),
        (layout != "cooper_nonoverlap" or stride == prefix + middle, f"cooper_nonoverlap steps by prefix and middle, {prefix + middle}"), (budget is None or budget == prefix + suffix, f"a budget of {budget} isn't {prefix} and {suffix}"),
        (intervention == "full" or prompt_format == "fim_native", "interventions are for fim_native"), (intervention in INTERVENTIONS, f"no intervention is called {intervention}"),
    ])
    return prefix + suffix


def dedup_arguments(cosine: float, jaccard: float, *, dim: int = 2, length: int = 8, batch: int = 1, block: int = 1, keep: int | None = None, divisor: int = 1) -> None:
    _require([
        (batch >= 1, "a batch holds one at least"), (length >= 8, "eight tokens at least are encoded"), (dim >= 2, "vectors have two components at least"), (0 < cosine < 1, "the cosine lies in (0, 1)"),
        (0 <= jaccard <= 1, "the Jaccard similarity lies in [0, 1]"), (block >= 1, "a block holds one at least"), (keep is None or keep >= 1, "one row at least is kept"), (divisor >= 1, "the divisor is one at least"),
    ])


def interventions(text: str) -> list[str]:
    """Names between commas or spaces, repeated ones once, in order."""
    names = list(dict.fromkeys(text.replace(",", " ").split()))
    _require([(bool(names), "no intervention is given"), *((n in INTERVENTIONS, f"no intervention is called {n}") for n in names)])
    return names


def bucket_size(asked: str, rows: int, buckets: int) -> int:
    """A number, or "auto": rows shared by the buckets, rounded down."""
    if asked.casefold() == "auto":
        size = rows // buckets
    else:
        try:
            size = int(asked)
        except ValueError as e:
            raise ValueError(f'a bucket\'s size is a number or "auto", not {asked}') from e
    _require([(size >= 1, f"{buckets} buckets of {rows} rows would hold {size}")])
    return size


def bucket_faults(rows: DataFrame, buckets: list[int], size: int, spread: float = 0.01) -> DataFrame:
    """(id, bucket, score) -> rule, bucket, id, found: a row for each bucket of another size, each id in several rows, each
    missing score, and for bucket means that spread over more than so much of their mean (a negative limit: any).

    Counts by bucket and by id alone; nothing is gathered.
    """
    kinds = lambda rule, bucket, key, found: [F.lit(rule).alias("rule"), bucket.cast("long").alias("bucket"), key.cast("string").alias("id"), found.cast("double").alias("found")]
    none = F.lit(None)
    want = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket long")
    per = rows.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    sizes = want.join(per, "bucket", "full").withColumn("n", F.coalesce("n", F.lit(0))).join(want.withColumn("known", F.lit(True)), "bucket", "left")
    out = sizes.filter((F.col("n") != size) | F.col("known").isNull()).select(*kinds("size", F.col("bucket"), none, F.col("n")))
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    out = out.union(twice.select(*kinds("disjoint", none, F.col("id"), F.col("n"))))
    out = out.union(rows.filter(F.col("score").isNull() | F.isnan("score")).select(*kinds("score", F.col("bucket"), F.col("id"), none)))
    if spread >= 0:
        ratio = per.agg(((F.max("m") - F.min("m")) / F.nullif(F.abs(F.avg("m")), F.lit(0.0))).alias("r"))
        out = out.union(ratio.filter(F.col("r") > spread).select(*kinds("spread", none, none, F.col("r"))))
    return out
