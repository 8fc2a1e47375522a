"""Shards of texts: files that can't be read to their end give no row at all; outputs go by input shard; counts are taken on the way."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scans import _paths
from .tokenindex import located


def checked(spark: SparkSession, folder: str, columns: list[str], suffix: str = ".parquet") -> DataFrame:
    """file, rows, fault: each Parquet file of a folder (not below it), read to its end by a task; fault is null where that succeeds.

    Only the columns asked for are decoded, a batch at a time; pages that carry a checksum are held against it.
    """
    files = [(x,) for x in _paths(spark, f"{folder.rstrip('/')}/*{suffix}") if not x.rsplit("/", 1)[-1].startswith(("_", "."))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file in frame.file:
                rows, fault = 0, None
                try:
                    system, at = located(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                    with system.open_input_file(at) as f:
                        for batch in pq.ParquetFile(f, page_checksum_verification=True).iter_batches(columns=columns):
                            rows += batch.num_rows
                except (OSError, ValueError) as e:  # Arrow's errors are of these kinds
                    fault = str(e)[:200]
                out.append((file, rows, fault))
            yield pd.DataFrame(out, columns=["file", "rows", "fault"])

    names = spark.createDataFrame(files, "file string")
    return names.repartition(max(1, len(files))).mapInPandas(run, "file string, rows long, fault string")


def whole_shards(spark: SparkSession, folder: str, columns: list[str], suffix: str = ".parquet") -> tuple[DataFrame | None, list[str]]:
    """(rows of the files that are whole, with the column shard; names of those that are not). Rows are None if no file is whole.

    The names of a folder's files are all that the driver holds, as it does for any read of the folder.
    """
    found = checked(spark, folder, columns, suffix).collect()
    good, bad = sorted(r.file for r in found if r.fault is None), sorted(r.file.rsplit("/", 1)[-1] for r in found if r.fault is not None)
    if not good:
        return None, bad
    rows = spark.read.parquet(*good).select(*columns, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("shard"))
    return rows, bad


def counted(rows: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:  # noqa: ANN003
    """rows, and counters that fill while any action runs over them: no pass of their own."""
    seen = Observation(name)
    return rows.observe(seen, *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items())), seen


def write_texts_by_shard(spark: SparkSession, folder: str, out: str, least: int = 200) -> dict[str, int]:
    """Texts of least characters as JSON lines below out, a folder a shard that is whole; read, kept, short and lost.

    lost counts files, the others rows. A shard whose file is corrupt leaves nothing, and older output of it goes.
    """
    rows, bad = whole_shards(spark, folder, ["text"])
    if rows is None:
        spark.createDataFrame([], "text string").write.mode("overwrite").json(out)
        return {"read": 0, "kept": 0, "short": 0, "lost": len(bad)}
    enough = F.coalesce(F.length("text") >= least, F.lit(False))
    rows, seen = counted(rows, "texts", read=F.lit(1), kept=enough, short=~enough)
    rows.filter(enough).write.mode("overwrite").partitionBy("shard").json(out)
    return {**seen.get, "lost": len(bad)}
