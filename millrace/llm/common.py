"""Shared plumbing: tables, shared-folder materialisation, Arrow batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session

#: Rows handed to Python at once; whole texts can be long, so it is below Spark's default.
BATCH_ROWS = 1000
#: Bytes of text that one step of a Python function holds in working arrays.
CHUNK_BYTES = 4 << 20
#: Parts that the rows of one key are spread over in spread_join.
SPREAD = 256


# glibc raises the size from which it maps an array of its own, and gives it back when freed, to 32 MB as it goes; held at
# 1 MB, a worker that is used again and again doesn't keep the working arrays of its largest chunks; free memory at the
# heap's end is given back beyond 16 MB only, or smaller arrays would fetch their pages anew each time
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
    ctypes.CDLL(None).mallopt(-1, 16 << 20)


def prepare(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch to BATCH_ROWS; a value that the user chose stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set for the context; else (tests, on a
    local master) a temporary one, on a cluster an error."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            spark.conf.set("spark.checkpoint.dir", jdir.get())
    return session.shared_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice batches so that the strings of column hold about limit bytes; one longer row stays whole."""
    for batch in batches:
        sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Join the rows of many to at most one row a key, however many rows share a key.

    Rows of many fall into SPREAD parts by the hash of the columns in by. The row of a key goes to the parts
    that its key's rows are in, and no others: no task gathers a key's rows, and one grows to no more rows than
    many has. many is read twice.
    """
    many = many.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(SPREAD)))
    places = many.select(*keys, "_part").distinct()
    return many.join(places.join(one, keys), [*keys, "_part"], how).drop("_part")


def salted_join(many: DataFrame, one: DataFrame, keys: dict[str, str], by: str, hot: int = 1000, known: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join small rows of many to at most one large row a key: keys has many's column and one's.

    A key with more than hot rows of many (or one that known, of one column, lists) is spread over SPREAD parts by the
    column by, and its row of one goes to each; the row of any other key is sent once. Null keys meet nothing. Without
    known, many is read twice.
    """
    ((left, right),) = keys.items()
    counted = many.groupBy(left).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(F.col(left).alias("_hot")) if known is None else known.toDF("_hot")
    many = many.join(counted, F.col(left) == F.col("_hot"), "left").withColumn("_part", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SPREAD))).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    one = one.join(counted, F.col(right) == F.col("_hot"), "left").withColumn("_part", F.explode(parts)).drop("_hot").withColumnRenamed(right, "_key")
    one = one.withColumnRenamed("_part", "_of")
    return many.join(one, (F.col(left) == F.col("_key")) & (F.col("_part") == F.col("_of")), how).drop("_part", "_of", "_key")


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v) long -> (node, root): root is the smallest node reachable. Alternating large and small stars.

    Each round only takes minima by node and joins them back, so no neighbour list is ever gathered: a node's
    edges are dealt to SPREAD parts, whose minima meet by node. Rounds are written to the shared folder, and
    settle when the edges stay as they are, told by sums that no order of rows changes. Raises if that takes
    more than limit rounds (a round at least halves the depth, so that is far beyond any real graph).
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = e.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SPREAD)))
        low = e.groupBy("u", "part").agg(F.min("v").alias("m"))
        low = low.withColumn("m", F.least("u", F.min("m").over(Window.partitionBy("u"))))
        joined = e.join(low, ["u", "part"])
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = low.select("u", F.col("m").alias("v"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).filter("u <> v").distinct()

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, last = materialize(e, "edges"), None
    h = F.xxhash64("u", "v")
    for _ in range(limit):
        state = e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        e = materialize(stars(stars(e, True), False), "edges")
    raise RuntimeError("connected components did not settle")
