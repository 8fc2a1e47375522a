"""Benchmark decontamination by spaced seeds.

A mask such as 11011011 keeps some of the positions under it and ignores the others. The words that a mask
keeps are hashed at every place of every test item and every document; equal hashes are hits, so that an
overlap with a substituted word still hits wherever a mask ignores it. Each diagonal (document place minus
item place) with a hit is then verified on the words themselves: any of its segments with at least MATCHES
equal words (or all of a shorter item) and a share of them of SHARE or more will do. The one reported is
that of greatest score, matches counting +1 and substitutions -4, if it is such, else the one of most equal words.

Test hashes go to executors as a sorted array while they are few; beyond PASS_WORDS words of test items
they are taken in groups of items, one pass over the documents each, so that memory stays bounded
whatever the benchmark's size. Documents are never grouped or shuffled before the verified pairs.

Words are runs of letters and digits, lower-cased. Defined results: items of fewer words than the
shortest mask spans are never matched, as so few words can't be told from chance; null, empty and short
texts match nothing; repeated rows and ties are reported as they are, one row a document row and item;
empty tables give an empty result; other columns are ignored by overlaps() and kept by clean().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, table

#: Fixed masks: 1 keeps a word, 0 ignores it. None spans more than the shortest overlap looked for.
MASKS = ("1110111", "11011011", "1101010011")
MATCHES, SHARE = 10, 0.8
#: Words of test items held in executors at once.
PASS_WORDS = 2_000_000
#: Pairs of a document's and the items' places that are held at once.
PAIRS = 1 << 20
#: Bits of the table that screens hashes before they are looked up.
SCREEN = 22
WORD = re.compile(r"[^\W_]+")
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = Words()


def word_hashes(text: str | None) -> np.ndarray:
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the kept words at each place where the mask fits."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), salt, np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1" and n > 0:
            x = words[i : i + n] * _MULTIPLIERS[i]
            out += x ^ (x >> np.uint64(29))
    return out * _MULTIPLIERS[63]


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """Begin and end of the segment of greatest score (+1 equal, -4 not)."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end


def widest_segment(equal: np.ndarray, share: float) -> tuple[int, int]:
    """Begin and end of the segment of most equal words among those whose share is as asked; it begins and ends with one."""
    asked = Fraction(share).limit_denominator(1000)
    total = np.concatenate(([0], np.cumsum(np.where(equal, asked.denominator - asked.numerator, -asked.numerator))))
    count = np.concatenate(([0], np.cumsum(equal)))
    # to each end, the first begin whose sum is not above the end's
    begin = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int((count - count[begin]).argmax())
    inside = np.flatnonzero(equal[begin[end] : end])
    return (int(begin[end] + inside[0]), int(begin[end] + inside[-1]) + 1) if len(inside) else (0, 0)


class Benchmark:
    """Seeds of a group of items, looked up by hash."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS) -> None:
        self.masks = masks
        self.ids, self.words = [i for i, _ in items], [word_hashes(t) for _, t in items]
        self.tables = []
        for salt, mask in enumerate(masks):
            own = [seeds(w, mask, salt) for w in self.words]
            h = np.concatenate(own or [np.zeros(0, np.uint64)])
            item = np.repeat(np.arange(len(own)), [len(x) for x in own])
            place = np.concatenate([np.arange(len(x)) for x in own] or [np.zeros(0, int)])
            order = np.argsort(h, kind="stable")
            screen = np.zeros(1 << SCREEN, bool)
            screen[h >> np.uint64(64 - SCREEN)] = True
            self.tables.append((h[order], item[order], place[order], screen))

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item number, diagonal) of every hit, each once.

        Places of a repeated seed are multiplied out PAIRS at a time, and each lot becomes distinct diagonals, of
        which an item has no more than the document has places.
        """
        codes = np.zeros(0, np.int64)
        for salt, (mask, (h, item, place, screen)) in enumerate(zip(self.masks, self.tables, strict=True)):
            own = seeds(words, mask, salt)
            at = np.flatnonzero(screen[own >> np.uint64(64 - SCREEN)])
            if not len(at):
                continue
            first = np.searchsorted(h, own[at], "left")
            n = np.searchsorted(h, own[at], "right") - first
            at, first, n = at[n > 0], first[n > 0], n[n > 0]
            lots = np.cumsum(n) // PAIRS
            for lot in np.split(np.arange(len(n)), np.flatnonzero(np.diff(lots)) + 1) if len(n) else []:
                m = n[lot]
                row = np.repeat(first[lot], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                codes = np.union1d(codes, (item[row] << 40) + (np.repeat(at[lot], m) - place[row] + (1 << 39)))
        for x in codes.tolist():
            yield x >> 40, (x & ((1 << 40) - 1)) - (1 << 39)

    def overlaps(self, words: np.ndarray, matches: int = MATCHES, share: float = SHARE) -> list[tuple[int, int, int, int]]:
        """(item id, place in the document, length, equal words) of each item's best verified overlap."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, diagonal in self.hits(words):
            other = self.words[item]
            a, b = max(0, diagonal), min(len(words), diagonal + len(other))
            equal = words[a:b] == other[a - diagonal : b - diagonal]
            least = min(matches, len(other))
            if equal.sum() < least:
                continue
            x, y = best_segment(equal)
            n = int(equal[x:y].sum())
            if n < least or n < share * (y - x):
                x, y = widest_segment(equal, share)
                n = int(equal[x:y].sum())
            if n >= least and (item not in best or (n, -a - x) > (best[item][2], -best[item][0])):
                best[item] = (a + x, y - x, n)
        return [(self.ids[i], *best[i]) for i in sorted(best)]


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Groups of items of about PASS_WORDS words, one in the driver's memory at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len(WORD.findall(r.text or ""))
        if held and size + n > PASS_WORDS:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame, matches: int = MATCHES, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, place, length, matched: words of each document's verified overlap with each item."""
    schema = "doc_id long, item_id long, place long, length long, matched long"
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for group in _groups(benchmark):
        if out is not None:  # one pass over the documents a group; what a pass found is written, and its items let go
            out = materialize(out, "overlaps")

        def run(batches: Iterator[pa.RecordBatch], group: list = group) -> Iterator[pa.RecordBatch]:
            known = Benchmark(group)
            for b in chunks(batches, "text"):
                rows = [
                    (doc_id, *x)
                    for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                    for x in known.overlaps(word_hashes(text), matches, share)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["doc_id", "item_id", "place", "length", "matched"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, matches: int = MATCHES, share: float = SHARE) -> DataFrame:
    """docs without those that overlap an item; all columns stay as they are."""
    for number, group in enumerate(_groups(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], group: list = group) -> Iterator[pa.RecordBatch]:
            known = Benchmark(group)
            for b in chunks(batches, "text"):
                yield b.filter(pa.array([not known.overlaps(word_hashes(x), matches, share) for x in b.column("text").to_pylist()], pa.bool_()))

        if number:
            docs = materialize(docs, "clean")
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
