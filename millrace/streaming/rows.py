"""Row-local transforms under Structured Streaming: stateless, so a stream gives what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.layout import lay_out


def long_texts(df: DataFrame, least: int = 200) -> DataFrame:
    return df.filter(F.length("text") >= least)


def sequences(df: DataFrame, cap: int = 4096) -> DataFrame:
    """Documents as code points, laid out by key."""
    tokens = df.select("doc_id", T.code_points(F.col("text")).alias("tokens"))
    return lay_out(tokens, F.concat(F.lit("doc:"), F.col("doc_id")), cap=cap)


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def words(df: DataFrame) -> DataFrame:
    return df.select("doc_id", T.words(F.col("text")).alias("t"))
