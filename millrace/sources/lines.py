"""Lines of many files in one total order: by file name, then by their place in the file.

Spark deals files to tasks by size and cuts large ones, so a row's partition says nothing about where its line stands.
A file's split is read by one task from its first line to its last, so (file, where the split begins, the row's number
in its task) orders all lines. Any number of readers may follow from it without sorting rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def place() -> Column:
    """Where a row of a file source stands; taken where the source is read, before anything is filtered or joined."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, name: str = "_at") -> DataFrame:
    """Rows just read, with their place."""
    return rows.withColumn(name, place())


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line (blank ones too), _at."""
    return placed(spark.read.text(path)).withColumnRenamed("value", "line")


def numbered(rows: DataFrame, at: str = "_at") -> DataFrame:
    """Adds number, from 0, in the order of lines over all files. rows: every row of its source, with its place.

    Rows of a split have one number after another, so that a row a split is all that is counted and summed; the
    rows themselves are not shuffled. The source is read twice.
    """
    split = [F.col(f"{at}.file").alias("_file"), F.col(f"{at}.block").alias("_block")]
    heads = rows.groupBy(*split).agg(F.count("*").alias("_n"), F.min(f"{at}.row").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumns({"_file": F.col(f"{at}.file"), "_block": F.col(f"{at}.block")}).join(heads, ["_file", "_block"])
    return rows.withColumn("number", F.col("_before") + F.col(f"{at}.row") - F.col("_first")).drop("_file", "_block", "_first", "_before")


def documents(spark: SparkSession, path: str | list[str], schema: str, most: int | None = None) -> DataFrame:
    """JSON lines that are objects, with number: of the first so many lines if most is given, where blank and broken
    ones count though they give no row. Missing fields, and fields of another type, are null."""
    lines = numbered(text_lines(spark, path)) if most is None or most > 0 else numbered(text_lines(spark, path)).limit(0)
    if most is not None:
        lines = lines.filter(F.col("number") < most)
    text = F.trim("line")
    # a field of another type makes a record corrupt, too: what begins and ends as an object and parses as a map is one
    whole = F.from_json(text, "map<string,string>").isNotNull() & text.startswith("{")
    return lines.filter(whole).select("number", F.from_json(text, schema).alias("_d")).select("number", "_d.*")


def last_of_key(rows: DataFrame, keys: list[str], at: str = "_at") -> DataFrame:
    """The last row of each key in the order of lines, by partial aggregates, whatever share of the rows a key has."""
    return _end_of_key(rows, keys, at, F.max_by)


def first_of_key(rows: DataFrame, keys: list[str], at: str = "_at") -> DataFrame:
    return _end_of_key(rows, keys, at, F.min_by)


def _end_of_key(rows: DataFrame, keys: list[str], at: str, pick) -> DataFrame:  # noqa: ANN001
    rest = [c for c in rows.columns if c not in (*keys, at)]
    found = rows.groupBy(*keys).agg(pick(F.struct(*rest) if rest else F.lit(True), at).alias("_row"))
    return found.select(*keys, *(F.col(f"_row.{c}") for c in rest)).select(*(c for c in rows.columns if c != at))
