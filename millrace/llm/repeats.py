"""Repeated substrings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of LENGTH bytes that starts at two places of the corpus, same document included, is found
exactly; bytes that such strings cover are removed.

1. Equal texts form a class with one representative; two copies or more weigh 2. A class's result holds
   for all its copies.
2. Of the k-grams in a string of LENGTH bytes, the one of least hash (leftmost in a tie) is its anchor.
   Equal strings have equal anchors, and neighbouring strings mostly share one, so a document has an
   anchor every eighty bytes or so. Strings whose anchor occurs once can't repeat and are left out.
3. The strings of a repeated anchor make a context, the bytes that they cover. Contexts are dealt by
   anchor, so equal strings meet in one task, in batches of about BATCH bytes; equal contexts count once,
   at most twice where they repeat, and those of one part are made one before they are dealt. A batch's
   contexts without a string whose hash is met twice there share none and leave; the rest are joined and sorted by
   their first 256 symbols into a Burrows-Wheeler transform. From the intervals of prefixes of 16 symbols, backward extension
   breadth-first sets each boundary between neighbouring suffixes at its common prefix's length, shortest
   first; an interval whose boundary was set before is not extended again. After LENGTH - 1 the
   boundaries not yet set are those of common prefixes of LENGTH or more: their suffixes repeat.
4. An anchor with more than HOT distinct contexts (the edge of a passage that very many documents share)
   is cut again by longer k-grams, up to LENGTH itself, at which a context is a single string, and only
   keys that still repeat go on; so no task gathers an unbounded group.

Defined results: null and empty texts have 0 bytes; texts shorter than LENGTH lose nothing; repeated rows
are copies of each other; matches never cross documents; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, spread_join, table

LENGTH = 200
#: Lengths of the k-grams that anchors are taken from; later ones for hot anchors.
GRAMS = (40, 120, 180)
HOT = 4096
#: Bytes of a batch that a transform is built over; of texts that a step takes; that anchors are taken from at once.
BATCH, STEP, PIECE = 1 << 18, 1 << 20, 1 << 16
SEPARATOR = 0xFF  # in no UTF-8 text

_rng = np.random.default_rng(23)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on: blocks of doubling length are put together."""
    power, size, done, out = _BYTES[data], 1, 0, None
    for step in range(k.bit_length()):
        if k >> step & 1:
            out = power if out is None else out[: len(data) - done - size + 1] * _FACTORS[step] + power[done : len(data) - size + 1]
            done += size
        if k >> (step + 1):
            n = max(len(data) - 2 * size + 1, 0)
            power = power[:n] * _FACTORS[8 + step] + power[size : size + n]
            size *= 2
    out = out ^ (out >> np.uint64(29))
    out *= _FACTORS[7]
    return out ^ (out >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of documents in one buffer: (document, hash, first and last string start) of each context, in order."""
    none = np.zeros(0, np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(data, k)
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # a place in the buffer needs 24 bits
    least = sliding_min(key, length - k + 1)
    at = np.arange(windows.sum()) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    doc = np.repeat(np.arange(len(sizes)), windows)
    place = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return doc[new], h[place[new]], at[new] - starts[doc[new]], at[last] - starts[doc[new]]


def contexts(texts: list[bytes], length: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, hashes, first and last string starts), texts in order; a long text comes in pieces."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > PIECE:
            for begin in range(0, max(len(texts[i]) - length + 1, 0), PIECE):
                part = np.frombuffer(texts[i][begin : begin + PIECE + length - 1], np.uint8)
                _, h, lo, hi = anchors(part, np.zeros(1, np.int64), np.array([len(part)]), length, k)
                yield i, h, lo + begin, hi + begin
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and len(texts[j]) <= PIECE and (j == i or total + len(texts[j]) <= PIECE):
            total += len(texts[j])
            j += 1
        sizes = np.array([len(x) for x in texts[i:j]])
        doc, h, lo, hi = anchors(np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum(sizes) - sizes, sizes, length, k)
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        for n in range(j - i):
            part = slice(cuts[n], cuts[n + 1])
            yield i + n, h[part], lo[part], hi[part]
        i = j


# --- the transform ---


def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.concatenate(([0], np.cumsum(x[1:] != x[:-1]))).astype(np.uint64)
    return out


def sorted_suffixes(text: np.ndarray, depth: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first depth symbols (doubling from 8), and boundaries of prefixes of mark symbols."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, SEPARATOR, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order, size, marks = np.argsort(key), 8, None
    while size < depth:
        rank = _ranks(order, key)
        if marks is None and size >= mark:
            marks = rank
        later = np.concatenate((rank[size:], np.full(min(size, n), n, np.uint64)))[:n]
        key = rank << np.uint64(32) | later
        order, size = np.argsort(key), 2 * size
    x = marks[order]
    return order, np.concatenate(([True], x[1:] != x[:-1], [True]))


def repeated_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """True at each place whose string of length symbols is found at another place, too."""
    depth = 16
    while depth < length:
        depth *= 2
    first = min(16, depth // 2)
    order, edge = sorted_suffixes(text, depth, first)
    n = len(text)
    before = text[order - 1]  # the transform; the place before the first one is the last
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following, previous = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = edge.copy()  # boundaries set so far: common prefixes below first
    bounds = np.flatnonzero(edge)
    low, high = bounds[:-1], bounds[1:]
    for _ in range(first, length):
        if not len(low):
            break
        width = high - low
        at = np.arange(width.sum()) + np.repeat(low - (np.cumsum(width) - width), width)
        # a symbol's first and last place in its interval give the ends of the extended interval
        begin = np.sort(to[at[previous[at] < np.repeat(low, width)]])
        end = np.sort(to[at[following[at] >= np.repeat(high, width)]]) + 1
        new = ~known[end]
        known[end] = True
        low, high = begin[new], end[new]
    out = np.zeros(n, bool)
    out[order] = ~known[:-1] | ~known[1:]
    return out


def sharing(parts: list[bytes], length: int) -> np.ndarray:
    """True for each context that has a string whose hash is met again among all: no other's is found again."""
    sizes = np.array([len(x) for x in parts])
    windows, starts = sizes - length + 1, np.cumsum(sizes) - sizes
    at = np.arange(windows.sum()) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    h, of = gram_hashes(np.frombuffer(b"".join(parts), np.uint8), length)[at], np.repeat(np.arange(len(parts)), windows)
    order = np.argsort(h)
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    out = np.zeros(len(parts), bool)
    out[of[order[again]]] = out[of[order[again + 1]]] = True
    return out


def repeated_in(parts: list[bytes], twice: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """Runs [a, b) of string starts in each context whose strings are found again among all contexts."""
    # a context that shares nothing repeats as a whole or not at all
    out = [[(0, len(x) - length + 1)] if double else [] for x, double in zip(parts, twice, strict=True)]
    some = np.flatnonzero(sharing(parts, length)).tolist()
    if not some:
        return out
    parts, twice = [parts[i] for i in some], [twice[i] for i in some]
    pieces, places, at = [], [], 0
    for x in parts:
        places.append(at)
        pieces += [x, b"\xff"]
        at += len(x) + 1
    flags = repeated_suffixes(np.frombuffer(b"".join(pieces), np.uint8), length)
    for i, x, place, double in zip(some, parts, places, twice, strict=True):
        # a context's multiplicity counts in the width of its strings' intervals
        own = np.concatenate(([False], flags[place : place + len(x) - length + 1] | double, [False]))
        edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
        out[i] = list(zip(edges[::2], edges[1::2], strict=True))
    return out


# --- the stages ---

CONTEXT = "key long, digest binary, content binary, cid long, start long, weight int"


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    names = ["key", "digest", "content", "cid", "start", "weight"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def cut_documents(candidates: DataFrame, length: int, k: int) -> DataFrame:
    """(cid, weight, text, keys) -> the contexts of the anchors in keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", STEP):
            texts, cids, weights = b.column("text").to_pylist(), b.column("cid").to_pylist(), b.column("weight").to_pylist()
            wanted, rows = b.column("keys").to_pylist(), []
            for i, h, lo, hi in contexts(texts, length, k):
                h = h.view(np.int64)
                for j in np.flatnonzero(np.isin(h, wanted[i])).tolist():
                    part = texts[i][lo[j] : hi[j] + length]
                    rows.append((int(h[j]), _digest(part), part, cids[i], int(lo[j]), weights[i]))
            yield _context_rows(rows)

    return candidates.mapInArrow(run, CONTEXT)


def cut_contexts(found: DataFrame, length: int, k: int) -> DataFrame:
    """Contexts cut again by longer k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "content", STEP):
            texts, rows = b.column("content").to_pylist(), []
            cids, starts, weights = (b.column(x).to_pylist() for x in ("cid", "start", "weight"))
            for i, h, lo, hi in contexts(texts, length, k):
                for key, a, z in zip(h.view(np.int64).tolist(), lo.tolist(), hi.tolist(), strict=True):
                    part = texts[i][a : z + length]
                    rows.append((key, _digest(part), part, cids[i], starts[i] + a, weights[i]))
            yield _context_rows(rows)

    return found.mapInArrow(run, CONTEXT)


def expand(found: DataFrame, length: int) -> DataFrame:
    """Contexts -> (key, digest, runs): runs of string starts that repeat, where there are any."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # in order of key and digest: equal contexts of a batch become one
            if not b.num_rows:
                continue
            key, digest = b.column("key"), b.column("digest")
            new = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(digest[1:], digest[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], new)))
            weights = np.minimum(np.add.reduceat(b.column("weight").to_numpy(), first), 2)
            rows = b.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in ("key", "digest", "content")), pa.array(weights, pa.int32())], ["key", "digest", "content", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests, parts, weights, size = [], [], [], [], 0

        def done() -> pa.RecordBatch:
            rows = [(k, d, r) for k, d, r in zip(keys, digests, repeated_in(parts, [w > 1 for w in weights], length), strict=True) if r] if parts else []
            runs = pa.array([[{"a": a, "b": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), runs], ["key", "digest", "runs"])

        for b in batches:
            for key, digest, part, weight in zip(*(b.column(x).to_pylist() for x in ("key", "digest", "content", "weight")), strict=True):
                if keys and key == keys[-1] and digest == digests[-1]:
                    weights[-1] = 2
                    continue
                if size >= BATCH and key != keys[-1]:
                    yield done()
                    keys, digests, parts, weights, size = [], [], [], [], 0
                keys.append(key)
                digests.append(digest)
                parts.append(part)
                weights.append(weight)
                size += len(part)
        yield done()

    own = found.select("key", "digest", "content", "weight").sortWithinPartitions("key", "digest")
    dealt = own.mapInArrow(combine, "key long, digest binary, content binary, weight int").repartition("key").sortWithinPartitions("key", "digest")
    return dealt.mapInArrow(run, "key long, digest binary, runs array<struct<a: int, b: int>>")


def hot_keys(found: DataFrame) -> DataFrame:
    lean = found.groupBy("key", "digest").agg(F.sum("weight").alias("weight"))
    return lean.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key")


def repeated_runs(candidates: DataFrame, length: int = LENGTH) -> DataFrame:
    """(cid, start, end): byte runs of the candidates' texts that repeated strings cover (they may overlap)."""
    grams = [*[k for k in GRAMS if k < length], length] if length >= GRAMS[0] else [length]
    found, out = materialize(cut_documents(candidates, length, grams[0]), "contexts"), None
    for level, _ in enumerate(grams):
        later = None
        if level + 1 < len(grams):
            hot = materialize(hot_keys(found), "hot")
            if hot.first() is not None:
                later = cut_contexts(found.join(hot, "key", "left_semi"), length, grams[level + 1])
                found = found.join(hot, "key", "left_anti")
        runs = expand(found, length)
        own = spread_join(found.select("key", "digest", "cid", "start"), runs, ["key", "digest"], ["cid", "start"])
        own = own.select("cid", "start", F.explode("runs").alias("r"))
        own = own.select("cid", (F.col("start") + F.col("r.a")).alias("start"), (F.col("start") + F.col("r.b") + length - 1).alias("end"))
        out = own if out is None else out.unionByName(own)
        if later is None:
            break
        later = materialize(later, "contexts")
        again = later.groupBy("key").agg(F.sum("weight").alias("n")).filter("n > 1").select("key")
        found = materialize(later.join(again, "key", "left_semi"), "contexts")
    return out


def _once_or_twice(keys: np.ndarray) -> np.ndarray:
    """Each key once, or twice if there are more of it."""
    found, n = np.unique(keys, return_counts=True)
    return np.repeat(found, np.minimum(n, 2))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    k = GRAMS[0] if length > GRAMS[0] else length
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    docs = docs.select("doc_id", "text", F.sha2("text", 256).alias("sha"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", STEP):
            texts = b.column("text").to_pylist()
            keys: list[list[np.ndarray]] = [[] for _ in texts]
            for i, h, _, _ in contexts(texts, length, k):
                keys[i].append(h.view(np.int64))
            keys = [_once_or_twice(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in keys]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column("sha"), b.column("doc_id"), flat], ["sha", "doc_id", "keys"])

    long = docs.filter(F.octet_length("text") >= length)
    marked = long.select("sha", "doc_id", "text").mapInArrow(mark, "sha string, doc_id long, keys array<long>")
    classes = marked.groupBy("sha").agg(F.first("keys").alias("keys"), F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"), F.min("doc_id").alias("doc_id"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    each = classes.select("cid", "weight", F.explode("keys").alias("key"))
    again = each.groupBy("key").agg(F.sum("weight").alias("n")).filter("n > 1").select("key")
    wanted = each.join(again, "key").groupBy("cid").agg(F.collect_set("key").alias("keys"))
    wanted = classes.select("cid", "weight", F.col("sha").alias("class_sha"), F.col("doc_id").alias("class_doc")).join(wanted, "cid")
    candidates = long.join(wanted, (F.col("sha") == F.col("class_sha")) & F.col("doc_id").eqNullSafe(F.col("class_doc")))
    candidates = materialize(candidates.select("cid", "weight", "sha", "text", "keys"), "candidates")
    runs = repeated_runs(candidates, length).groupBy("cid").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sha, text, found in zip(b.column("sha").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                kept, at, spans, removed = hashlib.sha256(), 0, 0, 0
                end = -1
                for x in sorted((x["start"], x["end"]) for x in found):
                    if x[0] > end:  # a new maximal run
                        if end >= 0:
                            at = end
                        kept.update(text[at : x[0]])
                        spans += 1
                        removed -= x[0]
                        end = x[1]
                        removed += end
                    elif x[1] > end:
                        removed += x[1] - end
                        end = x[1]
                kept.update(text[end:])
                rows.append((sha, removed, spans, kept.hexdigest()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["sha", "n_removed", "n_spans", "kept_sha256"])

    # a candidate row repeated as a row gives the same result twice
    results = candidates.select("cid", "sha", "text").join(runs, "cid").select("sha", "text", "runs").mapInArrow(remove, "sha string, n_removed long, n_spans long, kept_sha256 string")
    results = results.groupBy("sha").agg(*(F.first(x).alias(x) for x in ("n_removed", "n_spans", "kept_sha256")))
    lean = docs.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    zero = F.lit(0).cast("long")
    return lean.join(results, "sha", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
