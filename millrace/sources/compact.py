"""The compact cache: each bucket's excerpts once, in a folder a repetition, rebuilt when its sources change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 1
SIGNATURE = "version int, files long, bytes long, digest long, mode string"


def source_signature(spark: SparkSession, paths: list[str], mode: str) -> DataFrame:
    """One row that changes with any source's name, size or time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    files = files.select("path", "length", F.unix_micros("modificationTime").alias("at"))
    return files.agg(
        F.lit(VERSION).alias("version"), F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.bit_xor(F.xxhash64("path", "length", "at")), F.lit(0)).cast("long").alias("digest"), F.lit(mode).alias("mode"),
    )


def preview_faults(assigned: DataFrame, summary: DataFrame) -> DataFrame:
    """Places where a dealing done again differs from the ids that its summary shows first.

    assigned: excerpt_id, repetition, bucket_base_index; summary: repetition, excerpt_ids_preview.
    Repetitions that were not dealt, and empty previews, have nothing to compare.
    """
    shown = summary.select("repetition", F.posexplode("excerpt_ids_preview").alias("bucket_base_index", "expected"))
    shown = shown.join(assigned.select("repetition").distinct(), "repetition", "left_semi")
    found = assigned.select("repetition", "bucket_base_index", "excerpt_id")
    return shown.join(found, ["repetition", "bucket_base_index"], "left").filter(~F.col("excerpt_id").eqNullSafe(F.col("expected")))


def compact_rows(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """rows (excerpt_id, ...) of dealt excerpts, with the columns of their first replica."""
    dealt = assigned.select("excerpt_id", "repetition", "bucket_base_index")
    return rows.join(dealt, "excerpt_id").select(
        *rows.columns, F.col("excerpt_id").alias("base_excerpt_id"), F.col("repetition").alias("repetition_bucket"), F.col("repetition").alias("replica_count"),
        F.lit(0).alias("replica_index"), "bucket_base_index", F.lit(True).alias("unique_eval_compact"), "repetition",
    )


def write_compact(rows: DataFrame, assigned: DataFrame, path: str) -> DataFrame:
    """Write JSON lines below path, a folder a repetition; return repetition, num_assignments, num_written.

    An excerpt in two buckets, or a bucket whose rows are not all found, is an error, and then no signature is
    written: a reader takes the folder for stale.
    """
    twice = assigned.groupBy("excerpt_id").agg(F.count("*").alias("n")).filter("n > 1").orderBy("excerpt_id").limit(5).collect()
    if twice:
        raise ValueError("excerpts in several buckets: " + ", ".join(str(r.excerpt_id) for r in twice))
    spark = rows.sparkSession
    compact_rows(rows, assigned).write.mode("overwrite").partitionBy("repetition").option("ignoreNullFields", "false").json(path)
    want = assigned.groupBy("repetition").agg(F.count("*").alias("num_assignments"))
    try:
        got = spark.read.schema("repetition int").json(path).groupBy("repetition").agg(F.count("*").alias("num_written"))
    except AnalysisException:
        got = want.select("repetition", F.lit(0).cast("long").alias("num_written")).limit(0)
    report = want.join(got, "repetition", "left").select("repetition", "num_assignments", F.coalesce("num_written", F.lit(0)).alias("num_written"))
    short = report.filter("num_written <> num_assignments").orderBy("repetition").limit(5).collect()
    if short:
        raise RuntimeError("buckets without all their rows: " + ", ".join(f"{r.repetition} ({r.num_written} of {r.num_assignments})" for r in short))
    return report


def ensure_compact(rows: DataFrame, assigned: DataFrame, path: str, sources: list[str], mode: str = "replay") -> tuple[DataFrame, bool]:
    """(the cache's rows, whether it was built): reused where the signature beside it is that of the sources now."""
    spark = rows.sparkSession
    now, beside = source_signature(spark, sources, mode).first(), f"{path.rstrip('/')}.signature"
    try:
        known = spark.read.schema(SIGNATURE).json(beside).collect()
    except AnalysisException:
        known = []
    built = known != [now]
    if built:
        spark.createDataFrame([], SIGNATURE).write.mode("overwrite").json(beside)
        write_compact(rows, assigned, path)
        spark.createDataFrame([now], SIGNATURE).coalesce(1).write.mode("overwrite").json(beside)
    return spark.read.schema(compact_rows(rows, assigned).schema).json(path), built
