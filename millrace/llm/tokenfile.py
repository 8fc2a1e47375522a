"""Token-id shards: each document's ids compressed on their own with one shared zstandard dictionary.

A shard holds documents of a range of doc_id, ascending. Layout, little-endian:
    magic "MRTOKZ01", u64 dictionary hash (XXH64; 0: none), u32 bytes per id, u32 zero,
    frames, one for each document,
    index: i64 doc_id (smallest long: null), u64 offset, u32 frame length, u32 number of ids per document,
    u64 place of the index, u64 number of documents.
The dictionary lies beside the shards as dict-<hash>.zdict; readers refuse another one. A short document
is read with the tail, the index and one frame. Shards are written under a name of their own and renamed,
so a repeated or speculative attempt leaves a whole file with the same bytes.

The dictionary is trained on a bounded sample: at most SAMPLE documents, chosen by a hash of doc_id among
those of at most SAMPLE_CHARS characters. All documents are encoded.

Defined results: null text is empty and has the end id alone; repeated rows and ties in doc_id each get a
record, in the order of their texts; null doc_ids come first; an empty table gives no records; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh_path, table
from .pretokens import encoder

MAGIC = b"MRTOKZ01"
HEAD, TAIL = struct.Struct("<8sQII"), struct.Struct("<QQ")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])
NULL_ID = -(1 << 63)
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 800, 20_000, 64 << 10, 3


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def wide(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; too little material for training gives the arrays themselves."""
    parts = [x[i : i + 8192] for x in samples for i in range(0, len(x), 8192)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def dictionary_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) if raw else 0


class ShardWriter:
    def __init__(self, folder: str, name: str, dictionary: bytes, width: int) -> None:
        self.fs, self.folder = open_fs(folder)
        self.name, self.width = name, width
        self.temporary = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        held = _dictionary(dictionary)
        if held:
            held.precompute_compress(level=LEVEL)  # else each short document pays for digesting it
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True)
        self.out.write(HEAD.pack(MAGIC, dictionary_hash(dictionary), width, 0))
        self.at, self.index = HEAD.size, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.press.compress(narrow(ids, self.width))
        self.out.write(frame)
        self.index.append((NULL_ID if doc_id is None else doc_id, self.at, len(frame), len(ids) // 4))
        self.at += len(frame)

    def close(self) -> tuple[str, int, int]:
        """File name, documents, ids."""
        index = np.array(self.index, INDEX)
        self.out.write(index.tobytes())
        self.out.write(TAIL.pack(self.at, len(index)))
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        return self.name, len(index), int(index["ids"].sum())


class ShardReader:
    """Documents of a shard, all in order or one by doc_id."""

    def __init__(self, folder: str, name: str) -> None:
        store, folder = open_fs(folder)
        self.file = store.open_input_file(f"{folder}/{name}")
        magic, self.hash, self.width, _ = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        size = self.file.size()
        at, n = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if size != at + n * INDEX.itemsize + TAIL.size:
            raise ValueError(f"{name} is cut short")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        raw = b""
        if self.hash:
            with store.open_input_stream(f"{folder}/dict-{self.hash:016x}.zdict") as f:
                raw = f.read()
            if dictionary_hash(raw) != self.hash:
                raise ValueError(f"{name} was written with another dictionary")
        self.unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def at(self, i: int) -> bytes:
        x = self.index[i]
        return wide(self.unpress.decompress(self.file.read_at(int(x["size"]), int(x["offset"]))), self.width)

    def document(self, doc_id: int) -> bytes | None:
        i = int(np.searchsorted(self.index["doc_id"], doc_id))
        return self.at(i) if i < len(self.index) and self.index["doc_id"][i] == doc_id else None

    def all(self) -> Iterator[tuple[int | None, bytes]]:
        for i, doc_id in enumerate(self.index["doc_id"].tolist()):
            yield (None if doc_id == NULL_ID else doc_id), self.at(i)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> list[tuple[str, int, int, int]]:
    """Write docs (doc_id, text); return the manifest, a line a shard: name, documents, ids, ids before it."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tail = struct.pack("<I", end_id)
    known = encoder(vocabulary)
    width = 2 if max(known.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    # a share of the hashes that leaves about four times SAMPLE rows, so that tasks send few to the driver
    share = max(1, docs.count() // (4 * SAMPLE))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(share)) == 0).filter(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).collect()
    dictionary = train_dictionary([narrow(x + tail, width) for x in known.encode([r.text for r in picked])])
    store, place = open_fs(folder)
    store.create_dir(place, recursive=True)
    if dictionary:
        with store.open_output_stream(f"{place}/dict-{dictionary_hash(dictionary):016x}.zdict") as f:
            f.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer, code = TaskContext.get().partitionId(), None, encoder(vocabulary)
        for b in chunks(batches, "text"):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), code.encode(b.column("text").to_pylist()), strict=True):
                writer = writer or ShardWriter(folder, f"shard-{number:08d}.mrtok", dictionary, width)
                writer.add(doc_id, ids + tail)
        if writer:
            name, n, ids = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), pa.array([n]), pa.array([ids])], ["number", "name", "docs", "ids"])

    dealt = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    manifest, before = [], 0
    # a line a shard reaches the driver
    for r in sorted(dealt.mapInArrow(run, "number long, name string, docs long, ids long").collect()):
        manifest.append((r.name, r.docs, r.ids, before))
        before += r.ids
    return manifest


def read_shards(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("before").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in ShardReader(folder, name).all():
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == 20_000:
                        yield _records(rows)
                        rows = []
                yield _records(rows)

    lines = spark.createDataFrame(manifest, "name string, docs long, ids long, before long").select("name", "before")
    return lines.repartition(max(1, len(manifest)), "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-shards")
    return read_shards(spark, folder, write_shards(table(spark, sf_dir, "documents"), folder))
