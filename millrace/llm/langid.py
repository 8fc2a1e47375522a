"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone. A letter trigram's vector
is the product (binding) of its letters' vectors, the first rotated by two places and the second by one
(permutation). A text's vector is the sum (bundle) of its trigrams' vectors; a language's prototype is
the sum over its training texts. A text gets the language whose prototype has the largest cosine.

Letters are lower-cased; every run of other characters counts as one space, so trigrams know where words
begin and end. Sums are integers, so results don't depend on partitioning. Prototypes, one short
vector a language, are all that reaches the driver, summed in executors first.

Defined results: null text, or one without letters, gives "und" with score 0; a text of one letter is
padded with spaces; null or empty lang is never learned from; nothing learned gives "und"; ties go to
the language that sorts first; null doc_id counts as '' in the fold; repeated rows and long texts are
counted as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

DIM = 1024
#: Bytes of text whose trigrams are told at once, and counts (texts by trigrams) that are held at once: short texts are many.
TOLD_BYTES, COUNTS = 1 << 18, 1 << 20


def letter(code: int) -> np.ndarray:
    return np.random.default_rng([7, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


_symbol = np.zeros(0x110000, np.int32)  # code point -> 1 + position in _letters' order; filled as letters turn up
_vectors: list[list[np.ndarray]] = []  # of each symbol: rotated by 2, by 1, by 0
_cells: dict[int, np.ndarray] = {}


def _symbols(codes: np.ndarray) -> np.ndarray:
    if not _vectors:
        _add(32)
    out = _symbol[codes]
    for code in np.unique(codes[out == 0]).tolist():
        if chr(code).isalpha():
            _add(code)
        else:
            _symbol[code] = 1  # the space
    return _symbol[codes] - 1


def _add(code: int) -> None:
    v = letter(code)
    _vectors.append([np.roll(v, 2), np.roll(v, 1), v])
    _symbol[code] = len(_vectors)


def trigrams(text: str) -> np.ndarray:
    """Keys of the letter trigrams of a text with a space at either end; empty without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols(codes)
    s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))]  # one space for each run
    if len(s) < 3:
        return np.zeros(0, np.int64)
    s = s.astype(np.int64)
    return (s[:-2] << 40) | (s[1:-1] << 20) | s[2:]


def cells(keys: np.ndarray) -> np.ndarray:
    """Trigram vectors, one a row, as float32."""
    if len(_cells) > 16_000:
        _cells.clear()
    for k in keys.tolist():
        if k not in _cells:
            a, b, c = _vectors[k >> 40][0], _vectors[k >> 20 & 0xFFFFF][1], _vectors[k & 0xFFFFF][2]
            _cells[k] = a * b * c
    return np.stack([_cells[k] for k in keys.tolist()]).astype(np.float32) if len(keys) else np.zeros((0, DIM), np.float32)


def bundles(texts: list[str | None], group: np.ndarray | None = None) -> np.ndarray:
    """Vectors of texts (whole numbers, as doubles), or their sums by group number."""
    found = [trigrams(x) if x else np.zeros(0, np.int64) for x in texts]
    rows = np.arange(len(texts)) if group is None else group
    out = np.zeros((int(rows.max(initial=-1)) + 1, DIM))
    keys, at = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
    row = np.repeat(rows, [len(x) for x in found])
    for i in range(0, len(keys), 4096):  # a few thousand trigrams at a time bound the count matrix
        width = min(4096, len(keys) - i)
        vectors, step = cells(keys[i : i + width]), max(1, COUNTS // width)
        for r in range(0, len(out), step):
            part = out[r : r + step]
            inside = (at >= i) & (at < i + width) & (row >= r) & (row < r + step)
            count = np.bincount((row[inside] - r) * width + at[inside] - i, minlength=len(part) * width).reshape(len(part), width)
            # float32 is exact for whole numbers below 2^24; larger counts go in double
            kind = np.float32 if count.sum(axis=1).max(initial=0) < 1 << 24 else np.float64
            part += count.astype(kind) @ vectors.astype(kind, copy=False)
    return out


def fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.expr("crc32(coalesce(cast(doc_id as string), '')) % 5 = 0"))


def prototypes(train: DataFrame) -> dict[str, np.ndarray]:
    """(text, lang) -> the sum vector of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in chunks(batches, "text", TOLD_BYTES):
            langs = b.column("lang").to_pylist()
            names = sorted({*langs})
            sums = bundles(b.column("text").to_pylist(), np.array([names.index(x) for x in langs]))
            for name, v in zip(names, sums, strict=True):
                total[name] = total.get(name, 0) + v.astype(np.int64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "i", "x"])

    parts = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang <> ''").mapInArrow(run, "lang string, i int, x long")
    out: dict[str, np.ndarray] = {}
    for lang, i, x in parts.groupBy("lang", "i").agg(F.sum("x")).collect():
        out.setdefault(lang, np.zeros(DIM))[i] = x
    return {k: v for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns keep of docs, with lang_pred and score; text must be among the columns of docs."""
    names = list(learned)
    unit = np.stack([learned[x] / np.linalg.norm(learned[x]) for x in names]) if names else np.zeros((0, DIM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text", TOLD_BYTES):
            v = bundles(b.column("_text").to_pylist())
            norm = np.linalg.norm(v, axis=1)
            known = (norm > 0) & bool(names)
            cos = np.round(v @ unit.T / np.where(norm > 0, norm, 1)[:, None], 9) if names else np.zeros((len(v), 1))
            best = cos.argmax(axis=1)
            pred = np.where(known, np.array([*names, "und"], object)[np.where(known, best, -1)], "und")
            score = np.where(known, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(pred.tolist(), pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fold(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return predict(docs, prototypes(docs.filter("not held_out")), ["doc_id", "held_out"])
