"""Vector code compression: product codes from Lloyd's rounds that rescan only what may have moved, told by heaps.

Vectors become whole numbers and are cut into equal parts; each part position has its own codebook. A block of
vectors, put together where they are read, keeps for each position and entry a heap of its parts, keyed by slack:
distance to the second nearest entry less distance to the nearest. When entries move, the slack of an entry's parts
shrinks by no more than its own move and the longest move of another one. These drifts add up over rounds; a part
joins a heap with its slack plus the drift so far, so a heap's keys never change. A round pops only the parts whose
key the drift has reached, rescans these exactly, and pushes them where they now belong; the others keep their
nearest entry by the triangle inequality. A heap is an array in order of keys, so what is popped is its front, found
by binary search.

Blocks are written to the shared folder after each round with the sums of their parts by entry, which change by the
parts that moved. Vectors are never shuffled; what meets are sums, of the codebooks' size for each task.

Defined results: rows with null, empty or non-finite vectors take no part, nor those whose length isn't a multiple
of the number of parts or differs from that of the first vector kept (of smallest vec_id, null last, then of smallest
vector); null and repeated vec_ids are rows like others; with fewer rows than entries a codebook has one entry a row;
whole numbers beyond 2^24 either way count as 2^24, so that errors fit a long; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest whole number, either way.
MOST = 1 << 24
#: Vectors of a block at most, and bytes of their whole numbers.
ROWS, BYTES = 8192, 4 << 20
#: Beyond the rounding of distances below 2^30 and of sums of a few of them.
EPS = 1e-4

BLOCK = "ids array<long>, labels array<long>, ints binary, code binary, keys binary, at binary, sizes binary, sums binary, scanned long"
CODED = "vec_id long, label long, code string, error long"


def usable(df: DataFrame, parts: int) -> DataFrame:
    """vec_id, label, v (array<double>) of vectors of finite components that can be cut into parts."""
    df = df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & ~bad)


def whole(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * SCALE), -MOST, MOST).astype(np.int32)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:  # sums of doubles are whole numbers
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        gap = x[:, i, None].astype(np.int64) - book[None, :, i]
        out += gap * gap
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x, ties to the lower one, and its slack."""
    near = distances(x, book)
    code, row = near.argmin(axis=1), np.arange(len(x))
    first = np.sqrt(near[row, code])
    if len(book) == 1:
        return code, np.full(len(x), np.inf)
    near[row, code] = np.iinfo(np.int64).max
    return code, np.sqrt(near.min(axis=1)) - first


class Heaps:
    """The heaps of one part position: of each entry, keys in order and the parts that they stand for."""

    def __init__(self, keys: list[np.ndarray], at: list[np.ndarray]) -> None:
        self.keys, self.at = keys, at

    @classmethod
    def empty(cls, entries: int) -> Heaps:
        return cls([np.zeros(0)] * entries, [np.zeros(0, np.int32)] * entries)

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """The parts whose key their entry's drift has reached; they leave."""
        out = []
        for entry, limit in enumerate(drift):
            n = np.searchsorted(self.keys[entry], limit + EPS, "right")
            if n:
                out.append(self.at[entry][:n])
                self.keys[entry], self.at[entry] = self.keys[entry][n:], self.at[entry][n:]
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def push(self, code: np.ndarray, key: np.ndarray, at: np.ndarray) -> None:
        order = np.lexsort((key, code))
        ends = np.searchsorted(code[order], np.arange(len(self.keys) + 1))
        for entry in np.unique(code):
            new = order[ends[entry] : ends[entry + 1]]
            keys, where = np.concatenate([self.keys[entry], key[new]]), np.concatenate([self.at[entry], at[new].astype(np.int32)])
            merged = np.argsort(keys, kind="stable")
            self.keys[entry], self.at[entry] = keys[merged], where[merged]


def sums_by_entry(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """entries x (sum of the parts, and their count); sums of a block fit a double."""
    chosen = np.zeros((entries, len(x)))
    chosen[code, np.arange(len(x))] = 1
    return np.concatenate([chosen @ x, chosen.sum(axis=1, keepdims=True)], axis=1).astype(np.int64)


def advance(ints: np.ndarray, code: np.ndarray, heaps: list[Heaps], sums: np.ndarray, books: np.ndarray, drift: np.ndarray) -> int:
    """Assign what may have moved, in place; the number of parts scanned. books: position x entry x component."""
    scanned, width = 0, books.shape[2]
    for p, book in enumerate(books):
        popped = heaps[p].pop(drift[p])
        if not len(popped):
            continue
        scanned += len(popped)
        x = ints[popped, p * width : (p + 1) * width]
        new, slack = scan(x, book)
        moved = np.flatnonzero(new != code[popped, p])
        sums[p] += sums_by_entry(x[moved], new[moved], len(book)) - sums_by_entry(x[moved], code[popped[moved], p], len(book))
        code[popped, p] = new
        heaps[p].push(new, slack + drift[p][new], popped)
    return scanned


def begin(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows (vec_id, label, v) -> blocks, every part scanned."""
    parts, entries, width = books.shape
    dim = parts * width
    most = max(1, min(ROWS, BYTES // (4 * dim)))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ints = np.concatenate([whole(b.column("v").flatten().to_numpy()) for b in held]).reshape(-1, dim)
        n = len(ints)
        code, heaps, sums = np.zeros((n, parts), np.uint8), [Heaps.empty(entries) for _ in range(parts)], np.zeros((parts, entries, width + 1), np.int64)
        for p, book in enumerate(books):
            x = ints[:, p * width : (p + 1) * width]
            found, slack = scan(x, book)
            code[:, p] = found
            heaps[p].push(found, slack, np.arange(n))
            sums[p] = sums_by_entry(x, found, entries)
        return written(t.column("vec_id").combine_chunks(), t.column("label").combine_chunks(), ints, code, heaps, sums, n * parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - count)
                held.append(part)
                count += part.num_rows
                b = b.slice(part.num_rows)
                if count == most:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return materialize(rows.mapInArrow(run, BLOCK), "code-blocks")


def written(ids: pa.Array, labels: pa.Array, ints: np.ndarray, code: np.ndarray, heaps: list[Heaps], sums: np.ndarray, scanned: int) -> pa.RecordBatch:
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    keys, at = (np.concatenate([x for h in heaps for x in getattr(h, name)]) for name in ("keys", "at"))
    sizes = np.array([len(x) for h in heaps for x in h.at], np.int32)
    raw = [pa.array([x.tobytes()], pa.binary()) for x in (ints, code, keys, at, sizes, sums)]
    return pa.RecordBatch.from_arrays([one(ids), one(labels), *raw, pa.array([scanned], pa.int64())], ["ids", "labels", "ints", "code", "keys", "at", "sizes", "sums", "scanned"])


def read(row: pa.RecordBatch, parts: int, entries: int, width: int) -> tuple:
    """The first row of a batch of blocks: ids, labels, ints, code, heaps, sums."""
    raw = lambda name, kind: np.frombuffer(row.column(name)[0].as_buffer(), kind)
    ints, code = raw("ints", np.int32).reshape(-1, parts * width), raw("code", np.uint8).reshape(-1, parts).copy()
    ends = np.cumsum(raw("sizes", np.int32))[:-1]
    keys, at = np.split(raw("keys", np.float64), ends), np.split(raw("at", np.int32), ends)
    heaps = [Heaps(keys[p * entries : (p + 1) * entries], at[p * entries : (p + 1) * entries]) for p in range(parts)]
    return row.column("ids").slice(0, 1).flatten(), row.column("labels").slice(0, 1).flatten(), ints, code, heaps, raw("sums", np.int64).reshape(parts, entries, width + 1).copy()


def onward(blocks: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Blocks after their violated parts were assigned anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, ints, code, heaps, sums = read(b.slice(i, 1), *books.shape)
                scanned = advance(ints, code, heaps, sums, books, drift)
                yield written(ids, labels, ints, code, heaps, sums, scanned)

    return materialize(blocks.mapInArrow(run, BLOCK), "code-blocks")


def last(blocks: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """CODED: the codes after the last round, and their exact errors."""
    parts, entries, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, ints, code, heaps, sums = read(b.slice(i, 1), parts, entries, width)
                advance(ints, code, heaps, sums, books, drift)
                error = np.zeros(len(ints), np.int64)
                for p, book in enumerate(books):
                    gap = ints[:, p * width : (p + 1) * width].astype(np.int64) - book[code[:, p]]
                    error += (gap * gap).sum(axis=1)
                text = ["".join(x) for x in digits[code].tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, CODED)


def totals(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Sums over all blocks, position x entry x (components, count): by task first, then by place."""
    size = shape[0] * shape[1] * (shape[2] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("sums"):
                held += np.frombuffer(x.as_buffer(), np.int64)
        place = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(held[place])], ["place", "s"])

    # as many rows as the codebooks have numbers
    found = blocks.select("sums").mapInArrow(run, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("place").to_numpy()] = found.column("s").to_numpy()
    return out.reshape(shape[0], shape[1], shape[2] + 1)


def moved(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries after a round: floors of the means; unused ones stay."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far an entry's slack may shrink, position x entry: its own move, and the longest of the others."""
    step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2))
    ranked = np.sort(step, axis=1)
    others = np.where(step == ranked[:, -1:], ranked[:, -2:-1], ranked[:, -1:]) if step.shape[1] > 1 else 0 * step
    ties = (step == ranked[:, -1:]).sum(axis=1, keepdims=True) > 1
    return step + np.where(ties, ranked[:, -1:], others)


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None, list[DataFrame]]:
    """df (vec_id, embedding, label) -> CODED, the final codebooks, and the blocks after each round."""
    rows = usable(df, parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return df.sparkSession.createDataFrame([], CODED), None, []
    dim = len(first[0].v)
    rows = rows.filter(F.size("v") == dim)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = whole(np.array([r.v for r in start])).astype(np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy()
    drift, blocks = np.zeros(books.shape[:2]), [begin(rows, books)]
    for i in range(rounds):
        new = moved(books, totals(blocks[-1], books.shape))
        drift += drifts(books, new)
        books = new
        if i < rounds - 1:
            blocks.append(onward(blocks[-1], books, drift))
    return last(blocks[-1], books, drift), books, blocks


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books, _ = compress(table(spark, sf_dir, "embeddings"))
    digest = "" if books is None else hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = materialize(rows.withColumns({"none": F.col("label").isNull(), "kind": F.coalesce("label", F.lit(0))}), "coded")
    by_label = rows.groupBy("none", "kind").agg(F.sum("error").alias("label_error"))
    rows = spread_join(rows, by_label, ["none", "kind"], ["vec_id", "code"])
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    width, distance = "(SELECT max(w) FROM dims)", "list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda i: f"""a{i} AS MATERIALIZED (
  SELECT rn, pos, m % 64 AS entry, m // 64 AS d FROM (SELECT p.rn, p.pos, min({distance} * 64 + b.entry) AS m FROM p JOIN b{i} b ON p.pos = b.pos GROUP BY p.rn, p.pos)
)"""  # noqa: E731
    means = lambda i: f"""m{i} AS (
  SELECT pos, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (
    SELECT p.pos, a.entry, generate_subscripts(p.c, 1) AS i, unnest(p.c) AS x FROM p JOIN a{i} a ON p.rn = a.rn AND p.pos = a.pos) GROUP BY ALL
), b{i + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT pos, entry, list(x ORDER BY i) AS c FROM m{i} GROUP BY ALL) n ON b.pos = n.pos AND b.entry = n.entry
)"""  # noqa: E731
    return f"""
WITH u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), first AS (SELECT len(v) AS dim FROM u ORDER BY vec_id NULLS LAST, v LIMIT 1), dims AS (SELECT dim // 16 AS w FROM first), e AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn,
    list_transform(v, lambda x: CAST(greatest(least(floor(256 * x), 16777216), -16777216) AS BIGINT)) AS v FROM u WHERE len(v) = (SELECT dim FROM first)
), p AS MATERIALIZED (
  SELECT rn, pos, v[pos * {width} + 1 : pos * {width} + {width}] AS c FROM e, (SELECT unnest(range(16)) AS pos)
), b0 AS (SELECT pos, rn - 1 AS entry, c FROM p WHERE rn <= 64), {near(0)}, {means(0)}, {near(1)}, {means(1)}, {near(2)}, out AS (
  SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rn
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, entry)) FROM b2) AS codebooks_sha256
FROM e JOIN out USING (rn)
"""


OP12_SQL = _sql()
