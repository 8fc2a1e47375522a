"""Texts and ids that go to Python and back as buffers: no object an id, and the same values as text by text."""

import numpy as np
import pyarrow as pa

from millrace.functions.tokenizers import BYTES, decode, encode

TEXTS = ["", None, "aé€😀b", "x" * 300, "\x00\n"]


def test_bytes_of_a_batch():
    texts = pa.array(["cut", *TEXTS, "cut"])[1:-1]
    ids = BYTES.encode_all(texts)
    assert ids.to_pylist() == [None if x is None else BYTES.encode(x) for x in TEXTS]
    assert BYTES.decode_all(ids).to_pylist() == TEXTS
    assert BYTES.decode_all(ids[2:4]).to_pylist() == TEXTS[2:4]
    assert BYTES.encode_all(pa.array([], pa.string())).to_pylist() == []
    assert BYTES.decode_all(pa.array([[97, 256]], pa.list_(pa.int32()))) is None
    assert BYTES.decode_all(pa.array([[200]], pa.list_(pa.int32()))) is None


def test_tokenizers_without_batches(spark):
    class Ords:
        end = -1

        def encode(self, text):
            return [ord(x) for x in text]

        def decode(self, ids):
            assert isinstance(ids, np.ndarray)
            return "".join(map(chr, ids))

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, text string")
    for t in (Ords(), BYTES):
        ids = rows.select("i", "text", encode(t)("text").alias("ids"))
        got = ids.select("i", "ids", decode(t)("ids").alias("back")).orderBy("i").collect()
        assert [r.back for r in got] == TEXTS
        assert [r.ids for r in got] == [None if x is None else t.encode(x) for x in TEXTS]
    special = spark.createDataFrame([([97, 256, 98, 200],), (None,)], "ids array<int>")
    assert [r[0] for r in special.select(decode(BYTES)("ids")).collect()] == ["a<|end|>b�", None]


def test_shards_grow_in_number(spark, tmp_path):
    """texts were dealt to six shards, whatever their size."""
    from pathlib import Path

    from pyspark.sql import functions as F

    from millrace.plans import QUERIES
    from millrace.session import shared_dir

    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("a")).select(F.col("id").alias("doc_id"), F.repeat("a", 5).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    key, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", set(Path(shared_dir(spark)).glob("shards-*"))
    spark.conf.set(key, "100k")
    try:
        got = QUERIES["src1_snk2_agg22_texts"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(key)
    assert [tuple(r) for r in got] == [(4000, 4000, 0, 0, 4000)]
    (folder,) = set(Path(shared_dir(spark)).glob("shards-*")) - before
    sizes = [x.stat().st_size for x in folder.glob("*.parquet")]
    assert len(sizes) > 6


def test_code_points_of_a_batch():
    """F16: ids of a text were an object each."""
    from millrace.functions.text import code_points

    run = code_points.func
    texts = pa.array(["cut", *TEXTS])[1:]
    assert run(texts).to_pylist() == [None if x is None else list(map(ord, x)) for x in TEXTS]
    assert run(pa.array([], pa.string())).to_pylist() == []


def test_index_is_written_from_buffers(tmp_path):
    import pytest

    from millrace.sources import tokenindex

    writer = tokenindex.Writer({"path": f"{tmp_path}/a", "code": "8"})
    kind = pa.list_(pa.int32())
    batch = lambda seq, doc, ids: pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(doc, pa.int64()), pa.array(ids, kind)], ["seq_id", "doc_id", "tokens"])
    part = writer.write(iter([batch([], [], []), batch([4, 5], [None, 7], [[1, 2], []]), batch([6, 7], [7, 8], [[3], [65535]])]))
    assert (part.first, part.sequences, part.documents, part.first_doc, part.last_doc) == (4, 4, 3, None, 8)
    writer.commit([part])
    (one,) = tokenindex.shards(f"{tmp_path}/a")
    tokens = tokenindex.Tokens(one["prefix"])
    assert [x.tolist() for x in tokens.slice(0, 4)] == [[1, 2], [], [3], [65535]]
    assert tokens.index.documents(0, 4).tolist() == [0, 1, 3, 4]
    for wrong, error in (([[65536]], OverflowError), ([[-1]], OverflowError), ([[None]], TypeError), ([None], TypeError)):
        with pytest.raises(error):
            writer.write(iter([batch([0], [0], wrong)]))


def test_bigrams_are_counted_in_tasks(spark, monkeypatch):
    """each pair of neighbours was a row of its own."""
    from pyspark.sql import functions as F

    from millrace.operators.model import bigram_counts

    def explode(*_):
        raise AssertionError("a row a pair")

    monkeypatch.setattr(F, "explode", explode)
    rows = spark.createDataFrame([([0, 1, 1],), ([],), (None,), ([2],), ([1, 1],)], "ids array<int>")
    assert bigram_counts(rows, 3).tolist() == [[0, 1, 0], [0, 2, 0], [0, 0, 0]]
    assert bigram_counts(rows.limit(0), 3).sum() == 0
