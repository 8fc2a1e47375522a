"""SimHash near-duplicates, linked exactly through vantage-point trees over Hamming distance.

A vantage-point tree fitted on a bounded sample of distinct fingerprints deals all fingerprints to
leaves. At a node with vantage v and radius r, x is at home inside if d(x, v) <= r, else outside; by
the triangle bound a partner within t of an outer point lies further than r - t from v, so inner
points beyond r - t also visit the outer side as guests. Every pair within t thus meets in a leaf. A
leaf builds its own tree the same way down to small blocks, compared in full (a block that nothing divides, in
strips), and hands on a spanning star for each linked set of a block, never all pairs. Stars join in connected components.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and link
like any other; repeated rows and ties share a fingerprint and hence a component; an empty table gives
an empty result; other columns are ignored. component_id is the smallest non-null doc_id reachable
(null if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, connected_components, materialize, spread_join, table

SEED = 42
#: Distinct fingerprints that the driver's tree is fitted on, at most.
SAMPLE = 65536
#: Fingerprints at home in a leaf of the shared tree, about; and in a block that is compared in full.
LEAF, BLOCK = 8192, 768


def shingle_hashes(text: str | None, words: int) -> list[bytes]:
    """Digests (big-endian) of the word shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    if len(found) < words:
        parts = [b" ".join(found)]
    else:
        parts = map(b" ".join, zip(*(islice(found, i, None) for i in range(words)), strict=False))
    return list(map(partial(xxhash.xxh64_digest, seed=SEED), parts))


def majority_bits(digests: list[list[bytes]]) -> np.ndarray:
    """uint64 of each list of hashes: a bit is set if it is in over half of them."""
    out, sizes = np.zeros(len(digests), np.uint64), np.array([len(x) for x in digests], np.int64)
    first = 0
    while first < len(digests):
        last = first + 1
        total = sizes[first]
        while last < len(digests) and total + sizes[last] <= 200_000:
            total += sizes[last]
            last += 1
        n = sizes[first:last]
        if total:
            raw = np.frombuffer(b"".join(b"".join(x) for x in digests[first:last]), np.uint8).reshape(-1, 8)
            full = n > 0
            starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
            counts = np.zeros((int(full.sum()), 64), np.int64)
            for k in range(8):  # a byte of the hash at a time keeps the unpacked bits small
                counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(raw[:, k : k + 1], axis=1), starts, axis=0, dtype=np.int32)
            bits = counts * 2 > n[full][:, None]
            out[first:last][full] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
        first = last
    return out


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """uint64 fingerprint of each text."""
    return majority_bits([shingle_hashes(x, words) for x in texts])


def document_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            fp = fingerprints(b.column("text").to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v)


def split(sample: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage and a radius near the median with few points in the band below it; None if none divides."""
    rng = np.random.default_rng(seed)
    best = None
    for v in sample[rng.integers(0, len(sample), 6)]:
        count = np.bincount(distance(sample, v), minlength=65)
        below = np.cumsum(count)
        for r in range(64):
            share = below[r] / len(sample)
            if 0.2 <= share <= 0.8:
                band = below[r] - (below[r - 2] if r >= 2 else 0)
                cost = max(below[r], len(sample) - below[r] + band)
                if cost < len(sample) and (best is None or cost < best[0]):
                    best = (cost, v, r)
    return best and (best[1], best[2])


def fit_tree(sample: np.ndarray, leaf: float, seed: int = 1) -> list | None:
    """Nested [vantage, radius, inner, outer]; None is a leaf."""
    if len(sample) <= max(leaf, 8) or (at := split(sample, seed)) is None:
        return None
    d = distance(sample, at[0])
    return [int(at[0]), at[1], fit_tree(sample[d <= at[1]], leaf, 2 * seed % (1 << 40)), fit_tree(sample[d > at[1]], leaf, (2 * seed + 1) % (1 << 40))]


def route(tree: list | None, fp: np.ndarray, reach: int) -> list[tuple[int, np.ndarray]]:
    """(leaf number, positions in fp), guests included."""
    out: list[tuple[int, np.ndarray]] = []

    def walk(node: list | None, at: np.ndarray) -> None:
        if node is None:
            out.append((len(out), at))
            return
        d = distance(fp[at], np.uint64(node[0])).astype(np.int16)
        walk(node[2], at[d <= node[1]])
        walk(node[3], at[d > node[1] - reach])

    walk(tree, np.arange(len(fp)))
    return out


def local_links(fp: np.ndarray, reach: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions a, b) whose components are those of all pairs within reach: stars, not pairs."""
    found_a, found_b = [], []

    def block(at: np.ndarray) -> None:
        x, n = fp[at], len(at)
        step = max(64, 4 * BLOCK * BLOCK // n)  # where nothing divides many, a strip at a time
        strips = [slice(i, i + step) for i in range(0, n, step)]
        masks = [np.bitwise_count(x[strips[0], None] ^ x[None, :]) <= reach] if len(strips) == 1 else None
        label = np.arange(n)
        while True:  # smallest label in reach, until it settles
            near = masks or (np.bitwise_count(x[s, None] ^ x[None, :]) <= reach for s in strips)
            new = np.concatenate([np.where(m, label[None, :], n).min(axis=1) for m in near])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(n)
        found_a.append(at[moved])
        found_b.append(at[label[moved]])

    def walk(at: np.ndarray, seed: int) -> None:
        if len(at) <= BLOCK or (cut := split(fp[at[:: max(1, len(at) // 4096)]], seed)) is None:
            block(at)
            return
        d = distance(fp[at], cut[0]).astype(np.int16)
        inner, outer = at[d <= cut[1]], at[d > cut[1] - reach]
        if max(len(inner), len(outer)) > 0.95 * len(at) or len(inner) + len(outer) > 1.35 * len(at):
            block(at)
            return
        walk(inner, 2 * seed % (1 << 40))
        walk(outer, (2 * seed + 1) % (1 << 40))

    walk(np.arange(len(fp)), seed)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def fingerprint_links(distinct: DataFrame, reach: int = 2, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(fp) distinct -> (u, v): links whose components are those of all pairs within reach."""
    n = distinct.count()
    picked = [r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").collect()]
    tree = fit_tree(np.array(sorted(picked), np.int64).view(np.uint64), leaf * len(picked) / max(n, 1)) if n > leaf else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for number, at in route(tree, fp.view(np.uint64), reach):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(fp[at])], ["leaf", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[np.ndarray]) -> pa.RecordBatch:
            fp = np.unique(np.concatenate(parts))
            a, b = local_links(fp.view(np.uint64), reach)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["u", "v"])

        held, number = [], None
        for b in batches:
            leaves, fp = b.column("leaf").to_numpy(), b.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(leaves)) + 1
            for part, x in zip(np.split(fp, cuts), np.split(leaves, cuts), strict=True):
                if not len(x):
                    continue
                if number is not None and x[0] != number:
                    yield done(held)
                    held = []
                number = x[0]
                held.append(part)
        if held:
            yield done(held)

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long")
    return dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fp (long), component_id, for every row of docs."""
    marked = materialize(document_fingerprints(docs, words), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(fingerprint_links(distinct, reach))
    own = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    own = materialize(own, "classes")
    smallest = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # very many documents may share a fingerprint, and fingerprints a component
    own = spread_join(own, smallest, ["root"], ["fp"]).select("fp", "component_id")
    return spread_join(marked, own, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
