"""Text sources and sinks: JSON lines, catalog, summaries, CSV."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hadoop
from .lines import last_of_key, placed

CATALOG = "`Text#` string, Type string, Issued string, Title string, Language string, Authors string, Subjects string, LoCC string, Bookshelves string"


def read_shards(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """Files of a folder by suffix, not below it; a corrupt file is skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", f"*{suffix}").parquet(folder)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Strict: a bad line fails. Tolerant: a bad line gives a row of nulls, which keeps its place in counts."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """Rows with the union of the parts' columns; nothing is written for no parts."""
    if not parts:
        return
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", "true").csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Gzip CSV with a header: values trimmed, empty ones null, rows without a key dropped, the last of a key kept, in
    the order of file names and lines."""
    rows = placed(spark.read.schema(CATALOG).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path))
    rows = rows.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns if c != "_at"), "_at").filter("`Text#` is not null")
    return last_of_key(rows.withColumnRenamed("Text#", "_id"), ["_id"]).withColumnRenamed("_id", "Text#")


def read_summaries(spark: SparkSession, paths: dict[tuple[str, int], str], schema: str, allow_missing: bool = False) -> DataFrame:
    """One JSON document an (arm, repetition); every missing path is named in the error."""
    missing = sorted(p for p in paths.values() if not hadoop.exists(spark, p))
    if missing and not allow_missing:
        raise FileNotFoundError("missing summaries: " + ", ".join(missing))
    there = [(hadoop.qualified(spark, p), a, r) for (a, r), p in paths.items() if p not in missing]
    keys = spark.createDataFrame(there, "path string, arm string, repetition int")
    if not there:
        return spark.createDataFrame([], schema).crossJoin(keys.drop("path"))
    rows = spark.read.schema(schema).option("multiLine", "true").json([p for p in paths.values() if p not in missing])
    return rows.withColumn("path", hadoop.file_name()).join(F.broadcast(keys), "path").drop("path")


def task_metrics(rows: DataFrame, document: str) -> DataFrame:
    """Evaluation results as JSON, {"results": {task: {metric: value}}}, a row each: other columns, task, metric, value.
    What is not a number is left out; a document that is no such JSON gives no rows."""
    read = F.from_json(document, "results map<string, map<string, string>>")["results"]
    flat = rows.withColumn("_r", read).drop(document).select("*", F.explode("_r").alias("task", "_m")).drop("_r")
    return flat.select("*", F.explode("_m").alias("metric", "_v")).withColumn("value", F.col("_v").try_cast("double")).filter("value is not null").drop("_m", "_v")


def parse_env(text: str, known: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines; ${NAME} and ${NAME:-default} are filled in."""
    out = dict(known or {})
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)=(.*?)\s*$", line)
        if m:
            value = m[2].strip("\"'")
            out[m[1]] = re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda v: out.get(v[1]) or v[2] or "", value)
    return out


def unresolved(keys: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return keys.join(found, key, "left_anti").select(key).distinct()
