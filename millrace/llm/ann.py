"""Nearest neighbours by cosine: a block matrix join over int8 tiles with error bounds.

Each unit vector becomes int8 codes with one scale, and the norm of what they leave out. Blocks of these, an
eighth of the doubles' bytes, are all that tiles take: a block of candidates goes to one task, and the blocks of
queries are sent to each. A tile's integer product bounds each cosine from both sides: with x = s*c + e,
|x.y - s_x s_y c_x.c_y| <= |e_x| |y| + |e_y| |x| + |e_x||e_y|. The k-th largest lower bound of a query within a
tile, and then the largest such over its tiles, is a floor; pairs whose upper bound reaches it survive. Their
vectors are fetched by row and the cosine recomputed in double precision, one addition after another, so that
equal vectors tie exactly. Heaps merge survivors within a task, and a rank by query after it.

Exact copies of a vector beyond the k + 1 smallest distinct ids can't be among anyone's k nearest, as ties go
to the smaller id and k ids besides a query's own remain; nor can rows of one id and vector beyond k. They are
set aside before tiles are formed, so that a hot vector makes no hot block. Copies are told by 128 bits of hash.

Defined results: vectors null, empty, zero or with null or non-finite components take no part, as query
or candidate; nor do null ids, nor vectors of another length than the query's; a repeated vec_id is
a candidate once a row, but asks once, with its smallest vector; a query's own rows (same vec_id) are never
its candidates; components of any finite size are scaled by a power of two first, which changes no cosine;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

#: Vectors in a block of candidates, and of queries.
BLOCK, QUERIES = 8192, 1024
CODES = "rid long, vec_id long, h1 long, h2 long, dim int, code binary, scale double, rest double"


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.select(F.col("vec_id").cast("long"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    return df.filter(~bad & F.exists("v", lambda x: x != 0))


def lean(df: DataFrame, k: int) -> DataFrame:
    """Of exact copies, the k + 1 smallest distinct ids, and k rows of each: ranks are limited before the shuffle, too."""
    own = Window.partitionBy("h1", "h2", "vec_id").orderBy("rid")
    df = df.withColumn("copy", F.row_number().over(own)).filter(F.col("copy") <= k).drop("copy")
    ids = Window.partitionBy("h1", "h2").orderBy("vec_id")
    return df.withColumn("copy", F.dense_rank().over(ids)).filter(F.col("copy") <= k + 1).drop("copy")


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that its largest component is near one."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each row of q with the same row of v, component after component in double precision."""
    q, v = scaled(q), scaled(v)
    dot, a, b = (np.zeros(len(q)) for _ in range(3))
    for i in range(q.shape[1]):
        x, y = q[:, i], v[:, i]
        dot, a, b = dot + x * y, a + x * x, b + y * y
    return dot / (np.sqrt(a) * np.sqrt(b))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, scales, and the norms of what the codes leave out."""
    unit = scaled(v)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


def coded(rows: DataFrame) -> DataFrame:
    """(rid, vec_id, v) -> CODES; h1 and h2 are hashes of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            size, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
            start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                codes, scale, rest = quantise(flat[start[at][:, None] + np.arange(dim)])
                own = b.select(["rid", "vec_id", "h1", "h2"]).take(pa.array(at))
                ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim)
                code = pa.Array.from_buffers(pa.binary(), len(at), [None, ends.buffers()[1], pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(at), dim), pa.int32()), code, pa.array(scale), pa.array(rest)], ["rid", "vec_id", "h1", "h2", "dim", "code", "scale", "rest"])

    return rows.select("rid", "vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v").mapInArrow(run, CODES)


class Codes:
    """A block's vectors of one length."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        self.rids, self.ids, self.codes, self.scale, self.rest = rids, ids, codes, scale, rest


BLOCKS = "block int, dim int, rids binary, ids binary, codes binary, scales binary, rests binary"
_TYPES = {"rids": np.int64, "ids": np.int64, "codes": np.int8, "scales": np.float64, "rests": np.float64}


def pack(df: DataFrame, parts: int, rows: int, salt: int) -> DataFrame:
    """Codes in blocks, whose columns are bytes; a block holds one length of vector, and a part's rows make one or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[pa.RecordBatch]] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(key))
            columns = [t.column(x).to_numpy().tobytes() for x in ("rid", "vec_id")] + [b"".join(t.column("code").to_pylist())] + [t.column(x).to_numpy().tobytes() for x in ("scale", "rest")]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], ["block", "dim", *_TYPES])

        for b in batches:
            blocks, dims = b.column("block").to_numpy(), b.column("dim").to_numpy()
            for key in {*zip(blocks.tolist(), dims.tolist(), strict=True)}:
                held.setdefault(key, []).append(b.take(pa.array(np.flatnonzero((blocks == key[0]) & (dims == key[1])))))
                if sum(x.num_rows for x in held[key]) >= 2 * rows:
                    yield out(key)
        for key in list(held):
            yield out(key)

    dealt = df.select("rid", "vec_id", "dim", "code", "scale", "rest", F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(parts)).cast("int").alias("block"))
    return dealt.repartition("block").mapInArrow(run, BLOCKS)


def tile(q: Codes, c: Codes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, upper bound) of all pairs that may be among a query's k nearest here;
    and each query's k-th largest lower bound."""
    at_q, at_c, upper, floors = [], [], [], []
    exact = q.codes.shape[1] <= 1040  # products of int8 codes summed in float32 are whole numbers below 2^24
    kind = np.float32 if exact else np.float64
    codes = c.codes.astype(kind).T
    for i in range(0, len(q.ids), 256):
        part = slice(i, i + 256)
        near = (q.codes[part].astype(kind) @ codes).astype(np.float64)
        near *= q.scale[part, None] * c.scale[None, :]
        slack = q.rest[part, None] + c.rest[None, :] + q.rest[part, None] * c.rest[None, :] + 1e-9
        own = q.ids[part, None] == c.ids[None, :]
        low = np.where(own, -np.inf, near - slack)
        least = np.partition(low, -k, axis=1)[:, -k] if len(c.ids) > k else np.full(len(low), -np.inf)
        near += slack
        a, b = np.nonzero((near >= least[:, None]) & ~own)
        at_q.append(a + i)
        at_c.append(b)
        upper.append(near[a, b])
        floors.append(least)
    return np.concatenate(at_q), np.concatenate(at_c), np.concatenate(upper), np.concatenate(floors)


def survivors(left: DataFrame, right: DataFrame, parts: int, k: int) -> DataFrame:
    """Blocks of queries and of candidates -> query_id, rid, upper, and floor on one row of each query and tile."""
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for b in batches:  # by block: its candidates first, then the queries
            for row in b.to_pylist():
                if row["block"] != number:
                    number, held = row["block"], []
                made = {x: np.frombuffer(row[x], t) for x, t in _TYPES.items()}
                block = Codes(made["rids"], made["ids"], made["codes"].reshape(-1, row["dim"]), made["scales"], made["rests"])
                if not row["asks"]:
                    held.append(block)
                    continue
                for c in held:
                    if c.codes.shape[1] != row["dim"]:
                        continue
                    a, at, upper, floor = tile(block, c, k)
                    first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
                    columns = (block.ids[a], c.rids[at], upper, np.where(first, floor[a], -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["query_id", "rid", "upper", "floor"])

    # the stated query set meets all blocks: its blocks are sent to each, which are whole numbers below parts
    every = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(True))
    both = right.withColumn("asks", F.lit(False)).unionByName(every)
    return both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, "query_id long, rid long, upper double, floor double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(vec_id, v) twice -> query_id, rank, vec_id, score: each query's k nearest, ties to the smaller vec_id."""
    queries = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("rid", F.col("vec_id")), "queries")
    vectors = materialize(vectors.withColumn("rid", F.monotonically_increasing_id()), "vectors")  # written, so rids stay
    codes = materialize(lean(coded(vectors), k), "codes")
    parts = max(1, -(-codes.count() // block))
    left, right = pack(coded(queries), max(1, -(-queries.count() // query_block)), query_block, 1), pack(codes, parts, block, 2)
    found = materialize(survivors(materialize(left, "queries"), right, parts, k), "survivors")
    floors = found.groupBy("query_id").agg(F.max("floor").alias("floor"))
    left_over = found.drop("floor").join(floors, "query_id").filter("upper >= floor").select("query_id", "rid")
    # a vector may be near to very many queries
    pairs = spread_join(left_over, vectors.withColumnRenamed("v", "c"), ["rid"], ["query_id"])
    pairs = pairs.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", "q", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(q, -i, s) for q, h in heaps.items() for s, i in h]
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for b in batches:
            size = b.column("q").value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                part = b.filter(pa.array(size == dim))
                q, c = (part.column(x).flatten().to_numpy().reshape(-1, dim) for x in ("q", "c"))
                for i, j, s in zip(part.column("query_id").to_pylist(), part.column("vec_id").to_pylist(), cosine(q, c).tolist(), strict=True):
                    heap = heaps.setdefault(i, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -j))
                    elif (s, -j) > heap[0]:
                        heapq.heapreplace(heap, (s, -j))
            if len(heaps) > 100_000:
                yield out()
                heaps.clear()
        yield out()

    scored = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows.filter("vec_id % 50 = 0"), rows)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), z AS (
  -- by a power of two, so that no square overflows or vanishes; it changes no cosine
  SELECT vec_id, list_transform(v, lambda x: x * pow(2.0, -floor(log2(list_max(list_transform(v, lambda y: abs(y))))))) AS v FROM e
), n AS (
  SELECT vec_id, v, list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x * x)), lambda a, b: a + b) AS s FROM z
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda a, b: a + b)
      / (sqrt(q.s) * sqrt(c.s)) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
