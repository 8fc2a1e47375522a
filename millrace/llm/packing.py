"""Packing documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt to blocks of about BLOCK. A block's islands evolve packings of their own, of which the
first comes from best-fit decreasing: crossover injects whole well-filled bins of one parent into a child,
drops the bins of the other parent that hold a piece twice, and best-fits the displaced pieces, largest
first; mutation empties a child's worst bins likewise. After an epoch each island sends its elite to the
next. A block that has as few bins as its lengths allow is settled, and evolves no further.

Well-filled bins of a block's best packing are final. The pieces of the others go on to a next level of
fewer blocks, so that the loss at a block's edge doesn't add up; the last level is one block, or the one
at which bins no longer fill.

Only row keys and lengths are packed; ids and texts stay in the table of pieces. Full pieces make a
sequence of their own at once.

Defined results: null text is empty and has the end id alone; repeated rows and ties are packed as
separate documents; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, table
from .pretokens import encoder

CAPACITY = 4096
#: Pieces in a block, islands of a block, epochs, packings on an island, and children an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 8192, 3, 2, 4, 6
#: Bins at least this full are final before the last level.
FILLED = 0.998


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for b in chunks(batches, "text"):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), code.encode(b.column("text").to_pylist()), strict=True):
                ids += tail
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[i : i + 4 * capacity]
                    rows.append((doc_id, k, i // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """bins: lists of piece numbers; free: room in each."""

    def __init__(self, bins: list[list[int]], free: list[int]) -> None:
        self.bins, self.free = bins, free

    def fitness(self) -> tuple[int, float]:
        """Few bins, then uneven fill: better is smaller."""
        return len(self.bins), -sum(float(CAPACITY - f) ** 2 for f in self.free)


def best_fit(order: list[int], size: list[int], packing: Packing, capacity: int) -> Packing:
    """Put pieces, in order, each into the fullest bin that has room."""
    bins, free = packing.bins, packing.free
    room = sorted((f, i) for i, f in enumerate(free))
    for x in order:
        at = bisect.bisect_left(room, (size[x], -1))
        if at < len(room):
            f, i = room.pop(at)
            bins[i].append(x)
        else:
            f, i = capacity, len(bins)
            bins.append([x])
            free.append(capacity)
        free[i] = f - size[x]
        bisect.insort(room, (free[i], i))
    return packing


def cross(a: Packing, b: Packing, size: list[int], rng: np.random.Generator, capacity: int) -> Packing:
    """Whole well-filled bins of a, what is left whole of b, and the displaced best-fitted."""
    full = sorted(range(len(a.bins)), key=lambda i: a.free[i])[: max(1, len(a.bins) // 2)]
    take = [i for i in full if rng.random() < 0.7] or full[:1]
    bins, free = [list(a.bins[i]) for i in take], [a.free[i] for i in take]
    inside = {x for y in bins for x in y}
    displaced = []
    worst = max(b.free)
    for y, f in zip(b.bins, b.free, strict=True):
        rest = [x for x in y if x not in inside]
        if len(rest) == len(y) and not (f == worst or rng.random() < 0.02):  # the second part is mutation
            bins.append(list(y))
            free.append(f)
        else:
            displaced += rest
    displaced.sort(key=lambda x: -size[x])
    return best_fit(displaced, size, Packing(bins, free), capacity)


def decreasing(size: list[int], rng: np.random.Generator | None, capacity: int) -> Packing:
    key = np.array(size, float) if rng is None else np.array(size) * rng.uniform(0.8, 1.2, len(size))
    return best_fit(np.argsort(-key, kind="stable").tolist(), size, Packing([], []), capacity)


def evolve(size: list[int], population: list[Packing], rng: np.random.Generator, least: int, capacity: int, children: int = CHILDREN) -> list[Packing]:
    population = sorted(population, key=Packing.fitness)
    for _ in range(children):
        if len(population[0].bins) <= least:
            break
        i, j = rng.integers(0, len(population), 2)
        child = cross(population[min(i, j)], population[max(i, j)] if i != j else population[-1], size, rng, capacity)
        if child.fitness() < population[-1].fitness():
            population[-1] = child
            population.sort(key=Packing.fitness)
    return population


def to_bytes(p: Packing) -> bytes:
    out = np.zeros(sum(map(len, p.bins)), np.int32)
    for i, y in enumerate(p.bins):
        out[y] = i
    return out.tobytes()


def from_bytes(raw: bytes, size: list[int], capacity: int) -> Packing:
    at = np.frombuffer(raw, np.int32)
    n = int(at.max(initial=-1)) + 1
    free = (capacity - np.bincount(at, weights=size, minlength=n)).astype(int).tolist()
    order = np.argsort(at, kind="stable")
    return Packing([x.tolist() for x in np.split(order, np.searchsorted(at[order], np.arange(1, n)))], free)


STATE = "block long, island int, keys binary, sizes binary, least int, packings array<binary>"


def _size(raw: bytes) -> list[int]:
    return np.frombuffer(raw, np.int32).tolist()


def islands(items: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    """(key, length) -> settled or evolved packings, a row for each island (STATE)."""

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "key"], ascending=[False, True])
        size, least = frame.length.tolist(), int(-(-frame.length.sum() // capacity))
        first = decreasing(size, None, capacity)
        rows, raw = [], (frame.key.to_numpy(np.int64).tobytes(), frame.length.to_numpy(np.int32).tobytes())
        for island in range(1 if len(first.bins) <= least else ISLANDS):
            rng = np.random.default_rng([level, int(frame.block.iloc[0]), island])
            own = [first] + [decreasing(size, rng, capacity) for _ in range(POPULATION - 1)] if len(first.bins) > least else [first]
            rows.append((int(frame.block.iloc[0]), island, *raw, least, [to_bytes(p) for p in own]))
        return pd.DataFrame(rows, columns=["block", "island", "keys", "sizes", "least", "packings"])

    def epoch(number: int):  # noqa: ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i, r in frame.iterrows():
                    size = _size(r.sizes)
                    own = [from_bytes(x, size, capacity) for x in r.packings]
                    rng = np.random.default_rng([level, r.block, r.island, number + 1])
                    frame.at[i, "packings"] = [to_bytes(p) for p in evolve(size, own, rng, r.least, capacity)]
                yield frame

        return run

    dealt = items.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks)))
    state = materialize(dealt.groupBy("block").applyInPandas(begin, STATE), "islands")
    for number in range(EPOCHS):
        if number:  # each island's worst gives way to the elite of the island before it
            elite = state.select("block", F.expr(f"cast((island + 1) % {ISLANDS} as int)").alias("island"), F.col("packings")[0].alias("elite"))
            state = state.join(elite, ["block", "island"], "left").withColumn(
                "packings", F.when(F.col("elite").isNull(), F.col("packings")).otherwise(F.concat(F.slice("packings", 1, POPULATION - 1), F.array("elite")))
            ).drop("elite")
        state = materialize(state.select("block", "island", "keys", "sizes", "least", "packings").repartition("block", "island").mapInPandas(epoch(number), STATE), "islands")
    return state


def bins_of(state: DataFrame, level: int, capacity: int, last: bool) -> DataFrame:
    """The best island's packing of each block: key, sequence_id, offset, length, final."""

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        choice = min(((from_bytes(r.packings[0], _size(r.sizes), capacity), r) for r in frame.sort_values("island").itertuples()), key=lambda x: x[0].fitness())
        packing, r = choice
        keys, size, rows = np.frombuffer(r.keys, np.int64), _size(r.sizes), []
        for i, (y, f) in enumerate(zip(packing.bins, packing.free, strict=True)):
            final, at = last or capacity - f >= FILLED * capacity, 0
            for x in y:
                rows.append((keys[x], (level << 56) + (int(r.block) << 24) + i, at, size[x], final))
                at += size[x]
        return pd.DataFrame(rows, columns=["key", "sequence_id", "offset", "length", "final"])

    return state.groupBy("block").applyInPandas(best, "key long, sequence_id long, offset long, length long, final boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(key, length) -> key, sequence_id, offset; keys are distinct."""
    done, left, level, n = [], items.filter(F.col("length") < capacity), 0, None
    done.append(items.filter(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    while True:
        now = left.count()
        if not now:
            break
        # blocks at least halve, so the last level comes after a few
        blocks = -(-now // block)
        last = blocks == 1 or (n is not None and now > 0.5 * n) or level == 60
        found = materialize(bins_of(islands(left, blocks, level, capacity), level, capacity, last), "bins")
        done.append(found.filter("final").select("key", "sequence_id", "offset"))
        if last:
            break
        left, level, n = found.filter("not final").select("key", "length"), level + 1, now
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(docs, vocabulary, end_id, capacity).withColumn("key", F.monotonically_increasing_id())
    found = materialize(found, "pieces")  # written, so keys stay
    return found.join(pack(found.select("key", "length"), capacity), "key").drop("key")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
