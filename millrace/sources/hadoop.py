"""Files of the driver's own, in any file system that Spark knows: small documents, lists, and one CSV put together from parts."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def located(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path), as the cluster's Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = located(spark, path)
    return fs.exists(at)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file_name() gives it."""
    fs, at = located(spark, path)
    return re.sub("^file:/+", "file:/", fs.makeQualified(at).toUri().toString())


def file_name() -> Column:
    """The file that a row was read from; local ones may begin with one slash or three."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = located(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _whole(spark: SparkSession, path: str, fill) -> None:  # noqa: ANN001
    """What fill writes to a stream, under a name of its own until it is whole; then it takes the path's place."""
    fs, at = located(spark, path)
    beside = located(spark, f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.tmp")[1]
    stream = fs.create(beside, True)
    try:
        fill(fs, stream)
    except BaseException:
        stream.close()
        fs.delete(beside, False)
        raise
    stream.close()
    fs.delete(at, True)
    if not fs.rename(beside, at):
        raise OSError(f"{beside} could not be renamed")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _whole(spark, path, lambda fs, stream: stream.write(bytearray(text.encode())))


def write_status(spark: SparkSession, path: str, status: dict) -> None:
    """A JSON document that readers see whole."""
    write_text(spark, path, json.dumps(status, ensure_ascii=False, sort_keys=True))


def write_list(keys: DataFrame, path: str) -> int:
    """The first column's distinct values, a line each, in order; without any, an older list goes. How many there are."""
    spark, column = keys.sparkSession, keys.columns[0]
    lines = keys.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    n = lines.count()
    if n:
        _concatenated(lines.orderBy("value"), path, "")
    else:
        fs, at = located(spark, path)
        fs.delete(at, True)
    return n


def write_one_csv(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence, names: dict[str, Sequence[str]] | None = None, beside: Sequence[str] = ()) -> None:
    """One CSV file with a header: the columns asked for (null where rows have none), rows in order; where names gives a
    column's values, it sorts by their places (values it doesn't name come last). Files beside it that an earlier run
    left go first.

    Rows are sorted by range over all tasks, which write their parts as text; the parts are then copied behind each
    other, in blocks, into one file, which takes its name when it is whole.
    """
    spark = rows.sparkSession
    for x in beside:
        fs, at = located(spark, x)
        fs.delete(at, True)
    keys = []
    for x in order:
        if isinstance(x, str) and names and x in names:
            at = F.array_position(F.array(*(F.lit(v) for v in names[x])), F.col(x).cast("string"))
            keys += [F.when(at > 0, at).otherwise(len(names[x]) + 1), F.col(x)]
        else:
            keys.append(F.col(x) if isinstance(x, str) else x)
    cells = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    options = {"emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = rows.orderBy(*keys).select(F.to_csv(F.struct(*(c.cast(StringType()).alias(n) for c, n in zip(cells, columns, strict=True))), options).alias("value"))
    _concatenated(lines, path, ",".join(f'"{c}"' if set(c) & set(',"') else c for c in columns) + "\n")


def _concatenated(lines: DataFrame, path: str, head: str) -> None:
    """Sorted lines, written by tasks, in one file behind a head."""
    spark = lines.sparkSession
    parts = f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.parts"
    lines.write.text(parts)

    def fill(fs, stream) -> None:  # noqa: ANN001
        stream.write(bytearray(head.encode()))
        for x in sorted((x.getPath() for x in fs.globStatus(located(spark, f"{parts}/part-*")[1])), key=lambda p: p.getName()):
            part = fs.open(x)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, 1 << 20, False)
            finally:
                part.close()

    try:
        _whole(spark, path, fill)
    finally:
        fs, at = located(spark, parts)
        fs.delete(at, True)
