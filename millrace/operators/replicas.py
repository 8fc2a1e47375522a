"""Replicas of excerpts: metadata rows out of lists, flags or single rows, and back to one compact row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("repetition_bucket", "replica_count", "replica_index", "bucket_base_index")
ITEM = "struct<excerpt_id:string,base_excerpt_id:string,repetition_bucket:int,replica_count:int,replica_index:int,bucket_base_index:long>"


def items(rows: DataFrame, fallback: int | None = None, expand: bool = True) -> DataFrame:
    """rows (sample_index, excerpt_id, base_excerpt_id, the FIELDS, unique_eval_compact, replica_metadata: array of ITEM)
    -> sample_index, excerpt_id, base_excerpt_id and the FIELDS, a row a replica.

    Where replica_metadata names items, each is one, with what it lacks taken from the row; else a compact row with a
    replica_count gives replicas 0 to that less one (none below one), if expand; else the row is its own single one.
    A null is a field that isn't there: an id is then the sample's number, a base its excerpt, a bucket and a count
    the fallback. Null items, and lists of nothing else, don't count.
    """
    own = {
        "excerpt_id": F.coalesce("excerpt_id", F.col("sample_index").cast("string")), "base_excerpt_id": F.coalesce("base_excerpt_id", "excerpt_id", F.col("sample_index").cast("string")),
        **{c: F.coalesce(c, F.lit(fallback)) if c in ("repetition_bucket", "replica_count") else F.col(c) for c in FIELDS},
    }

    def item(given: dict[str, Column]) -> Column:
        return F.struct(*(given.get(c, x).alias(c) for c, x in own.items())).cast(ITEM)

    named = F.filter(F.coalesce(F.col("replica_metadata"), F.array().cast(f"array<{ITEM}>")), lambda x: x.isNotNull())
    from_list = F.transform(named, lambda x: item({c: F.coalesce(x[c], own[c]) for c in own}))
    compact = F.lit(expand) & F.coalesce(F.col("unique_eval_compact"), F.lit(False)) & own["replica_count"].isNotNull() & F.col("replica_metadata").isNull()
    count = F.greatest(own["replica_count"], F.lit(0))
    numbers = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    expanded = F.transform(numbers, lambda i: item({"replica_index": i}))
    chosen = F.when(F.size(named) > 0, from_list).when(compact, expanded).otherwise(F.array(item({})))
    return rows.select("sample_index", F.explode(chosen).alias("_i")).select("sample_index", "_i.*")


def first_samples(rows: DataFrame, *columns: str) -> DataFrame:
    """Of the rows of an excerpt_id, the one of smallest sample_index, with the columns asked for; by partial minima."""
    key = F.coalesce("excerpt_id", F.col("sample_index").cast("string"))
    found = rows.groupBy(key.alias("excerpt_id")).agg(F.min_by(F.struct("sample_index", *columns), "sample_index").alias("_f"))
    return found.select("excerpt_id", "_f.*")


def compacted(replicas: DataFrame) -> DataFrame:
    """items() -> one compact row for each base that has all its replicas, numbered 0 to replica_count - 1, once; the
    others' rows as they are. items() of the result gives the replicas back. Bases are counted, never gathered."""
    keys = ["base_excerpt_id", "repetition_bucket", "replica_count", "bucket_base_index"]
    complete = (F.count("*") == F.max("replica_count")) & (F.count_distinct("replica_index") == F.count("*")) & (F.min("replica_index") == 0) & (F.max("replica_index") == F.max("replica_count") - 1)
    told = replicas.groupBy(*keys).agg(complete.alias("_all"), (F.min("excerpt_id") == F.max("excerpt_id")).alias("_same"), F.min("excerpt_id").alias("excerpt_id"), F.min("sample_index").alias("sample_index"))
    whole = F.coalesce(F.col("_all") & F.col("_same"), F.lit(False))
    empty = F.lit(None).cast(f"array<{ITEM}>").alias("replica_metadata")
    out = told.filter(whole).select("sample_index", "excerpt_id", *keys, F.lit(0).alias("replica_index"), F.lit(True).alias("unique_eval_compact"), empty)
    same = F.lit(True)
    other = told.filter(~whole).select(*(F.col(k).alias(f"_{k}") for k in keys))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rest = replicas.join(other, same, "left_semi")
    return out.unionByName(rest.select("sample_index", "excerpt_id", *keys, "replica_index", F.lit(False).alias("unique_eval_compact"), empty))


def python_sample(rows: DataFrame, key: str, k: int | None, seed: int) -> DataFrame:
    """k rows without replacement: those that Python's random.Random(seed).sample takes from the rows in order of a
    distinct key; all rows if k is None, not above zero, or no less than their number.

    The driver draws k places and holds nothing else; ranks come from range partitions.
    """
    import random

    from ..plans.corpus import global_rank
    from ..session import settle

    if k is None or k <= 0:
        return rows
    n = rows.count()
    if k >= n:
        return rows
    places = random.Random(seed).sample(range(n), k)
    drawn = rows.sparkSession.createDataFrame([(p + 1,) for p in places], "rank long")
    ranked = settle(global_rank(rows.select(key), [F.col(key).asc()], key))
    return rows.join(ranked.join(drawn, "rank", "left_semi").select(key), key, "left_semi")
