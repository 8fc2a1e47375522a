"""Scans of window rows, keys and caches: JSON lines, shards, trees of files, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import first_of_key, last_of_key, placed


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """What a glob meets, in any file system that Spark knows, in the order of names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found) if found is not None else []


def window_rows(spark: SparkSession, path: str, keys: dict[str, str], metrics: list[str]) -> DataFrame:
    """Windows' JSON lines: the keys (name -> type) and metrics asked for alone are parsed; of a repeated key the last
    counts, in the order of file names and lines."""
    schema = ", ".join([*(f"`{k}` {t}" for k, t in keys.items()), *(f"`{m}` double" for m in metrics)])
    return last_of_key(placed(spark.read.schema(schema).json(path)), list(keys))


def ltr_rows(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("experiment") == "ltr") & (F.col("prompt_format") == "ltr_prefix"))


def tree_rows(spark: SparkSession, pattern: str, schema: str, models: list[str] | None = None, repetitions: list[int] | None = None, where: Column | None = None) -> DataFrame:
    """Rows of all files that a pattern meets, of the models and repetitions asked for; an error if no file does."""
    if not (paths := _paths(spark, pattern)):
        raise FileNotFoundError(pattern)
    rows = spark.read.schema(schema).json(paths)
    if models:
        rows = rows.filter(F.col("model_label").isin(models))
    if repetitions:
        rows = rows.filter(F.col("repetition").isin(repetitions))
    return rows if where is None else rows.filter(where)


def keyed_rows(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key is asked for; an error, when read, names keys that no row has (five of them)."""
    asked = keys.select(*by).distinct()
    missing = asked.join(rows, by, "left_anti").select(F.to_json(F.struct(*by)).alias("k"))
    few = missing.orderBy("k").limit(5).agg(F.array_join(F.collect_list("k"), ", ").alias("_missing"))
    found = rows.join(asked, by, "left_semi").crossJoin(F.broadcast(few))
    return found.filter(F.when(F.col("_missing") == "", True).otherwise(F.raise_error(F.concat(F.lit("missing keys: "), F.col("_missing"))).cast("boolean"))).drop("_missing")


def manifest_keys(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """Distinct keys of several manifests, as strings; files that aren't there, and empty keys, are skipped."""
    there = [p for x in paths for p in _paths(spark, x)]
    if not there:
        return spark.createDataFrame([], f"`{key}` string")
    return spark.read.schema(f"`{key}` string").json(there).filter(F.col(key).isNotNull() & ~F.col(key).isin("", "0", "false")).distinct()


def bucket_members(spark: SparkSession, path: str, repetition: int) -> DataFrame:
    """base_excerpt_id, repetition_bucket, replica_count, bucket_base_index: the first row of each base among replicas of
    index 0 (or none); an error, when read, if there are none. Only these fields are parsed."""
    schema = "excerpt_id string, base_excerpt_id string, repetition_bucket int, replica_count int, bucket_base_index int, replica_index int"
    rows = placed(spark.read.schema(schema).json(path)).filter("replica_index is null or replica_index = 0")
    rows = rows.select(F.coalesce("base_excerpt_id", "excerpt_id").alias("base_excerpt_id"), "repetition_bucket", "replica_count", "bucket_base_index", "_at")
    first = first_of_key(rows, ["base_excerpt_id"])
    if first.isEmpty():
        raise RuntimeError(f"no assignments in {path}")
    return first.select("base_excerpt_id", *(F.coalesce(c, F.lit(repetition)).alias(c) for c in ("repetition_bucket", "replica_count")), "bucket_base_index")


def newest_snapshot(spark: SparkSession, folder: str, fallback: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The Parquet files of the last folder by name, together; without any, what fallback gives."""
    if found := _paths(spark, f"{folder.rstrip('/')}/*"):
        return spark.read.parquet(found[-1])
    if fallback is None:
        raise FileNotFoundError(folder)
    return fallback()


def fetch_once(spark: SparkSession, source: str, target: str, force: bool = False) -> str:
    """Copy source to target through Spark's file systems, unless it is there."""
    conf = spark._jsc.hadoopConfiguration()
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fa, fb = a.getFileSystem(conf), b.getFileSystem(conf)
    if force or not fb.exists(b):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, True, conf)
    return target


def stale(spark: SparkSession, made: str, sources: list[str], columns: dict[str, list[str]] | None = None) -> list[str]:
    """Why what a stage made must be made again: a source that is missing or newer, or a column that it lacks."""
    conf = spark._jsc.hadoopConfiguration()

    def changed(x: str) -> int | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        fs = path.getFileSystem(conf)
        return fs.getFileStatus(path).getModificationTime() if fs.exists(path) else None

    out, own = [], changed(made)
    if own is None:
        return [f"{made} is missing"]
    for x in sources:
        when = changed(x)
        if when is None:
            out.append(f"{x} is missing")
        elif when > own:
            out.append(f"{x} is newer")
    for x, names in (columns or {}).items():
        lacks = [n for n in names if n not in spark.read.json(x).columns]
        out += [f"{x} lacks {', '.join(lacks)}"] if lacks else []
    return out


def summary_csv(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    rows = spark.read.option("header", "true").csv(path)
    return rows.filter(F.col("model_label").isin(models)) if models else rows


def write_texts(rows: DataFrame, path: str) -> None:
    """The text alone, a JSON line a row, a file a part of the source."""
    rows.select("text").write.mode("overwrite").json(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    rows.select("excerpt_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def write_shards_of(rows: DataFrame, shard: str, shards: int, folder: str) -> str:
    """JSON lines, a folder a shard (0 to shards - 1, empty where it has no rows); the path, which no earlier run has."""
    spark, path = rows.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    rows.filter(F.col(shard).isNotNull()).repartition(shard).write.partitionBy(shard).json(path)
    for k in range(shards):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{shard}={k}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def read_shards_of(spark: SparkSession, path: str, shard: str, expected: int, schema: str) -> DataFrame:
    """The rows of all shards 0 to expected - 1; an error names those that are missing."""
    there = {int(p.rsplit("=", 1)[1]) for p in _paths(spark, f"{path}/{shard}=*")}
    if missing := sorted(set(range(expected)) - there):
        raise FileNotFoundError(f"{path} lacks shards {', '.join(map(str, missing))}")
    return spark.read.schema(f"{schema}, `{shard}` int").json(path)
