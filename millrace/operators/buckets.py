"""Buckets of equal size and near-equal score, and orders for cutting them."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake(rank: Column, n: Column) -> Column:
    """Place of the row of 1-based rank in the order lowest, highest, second lowest, ..."""
    r = rank - 1
    return F.when(r < F.ceil(n / 2), 2 * r).otherwise(2 * (n - 1 - r) + 1)


def equal_means(rows: DataFrame, buckets: int, size: int) -> DataFrame:
    """(id, score) -> id, bucket: best first, each into the open bucket of least (total, count, number).

    Each step depends on all before it, so ids and scores (nothing else) go through one task.
    """

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True]).head(buckets * size)
        heap, out = [(0.0, 0, b) for b in range(buckets)], []
        for score in frame.score:
            total, count, b = heapq.heappop(heap)
            out.append(b)
            if count + 1 < size:
                heapq.heappush(heap, (total + score, count + 1, b))
        return pd.DataFrame({"id": frame.id, "bucket": out, "score": frame.score})

    return rows.select("id", "score", F.lit(1).alias("all")).groupBy("all").applyInPandas(deal, "id long, bucket int, score double")


def bucket_stats(rows: DataFrame) -> DataFrame:
    """Mean of bucket means, their extremes, spread and its ratio."""
    per = rows.groupBy("bucket").agg(F.avg("score").alias("m"))
    out = per.agg(F.avg("m").alias("mean_global"), F.min("m").alias("mean_min"), F.max("m").alias("mean_max"))
    out = out.withColumn("spread", F.col("mean_max") - F.col("mean_min"))
    return out.withColumn("spread_ratio", F.when(F.col("mean_global") == 0, 0.0).otherwise(F.try_divide(F.col("spread"), F.abs("mean_global"))))
