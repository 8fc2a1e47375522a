"""Keyed draws, strings, numbers, the token index, the suite, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import rng, stats
from millrace.functions import text as T
from millrace.operators import layout, suite, windows
from millrace.sources import files, tokenindex
from millrace.streaming import rows as stream


def one(spark, column, **values):
    return spark.range(1).select(*(v.alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("key, n, coin, left, middle", [("b1::window_0000", 4096, 0.931669748249, 2393, 3775), ("b1::window_0000:replica:0", 4096, 0.374293621484, 1474, 4001), ("bin:0", 50, 0.490222922923, 10, 35), ("bin:1", 3, 0.616668472245, 1, 2)])
def test_draws(spark, key, n, coin, left, middle):
    d = one(spark, rng.split_draws(F.lit("42"), F.lit(key), F.lit(n)))
    assert (round(d.coin, 12), d.left_end, d.middle_end) == (coin, left, middle)


def test_seeds(spark):
    assert str(one(spark, rng.seed_column(*(F.lit(x) for x in ("0", "b1::window_0000", "windows"))))) == "10475976221203455456"
    got = one(spark, rng.sample_sorted(F.lit("10475976221203455456"), F.sequence(F.lit(100), F.lit(3999), F.lit(132)), F.lit(5)))
    assert got == [100, 1420, 1684, 3532, 3796]


def test_windows(spark):
    starts = lambda n: one(spark, windows.starts(F.lit(n), 4, 3))
    assert starts(10) == [0, 3, 6] and starts(3) == []
    assert one(spark, windows.min_gap(F.array(*map(F.lit, (0, 3, 6, 9, 12))), 5)) == [0, 6, 12]


def test_arrays(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    b, e = A.BOS, A.EOS
    assert one(spark, A.strip(arr(b, b, 5, e, 7, e, e))) == [5, e, 7]
    assert one(spark, A.strip(arr(b, e))) == [] and one(spark, A.strip(arr())) == []
    left, middle = A.even_cuts(arr(1, 2, 3, 4, 5, 6))
    assert one(spark, A.fim(arr(1, 2, 3, 4, 5, 6), left, middle)) == [A.PRE, 1, 2, A.SUF, 5, 6, A.MID, 3, 4, e]
    assert one(spark, F.size(A.shingles(arr(*range(7))))) == 3 and one(spark, F.size(A.shingles(arr(1, 2, 3)))) == 1 and one(spark, F.size(A.shingles(arr()))) == 0
    assert one(spark, A.jaccard(arr(), arr())) == 1.0 and one(spark, A.jaccard(arr(), arr(1))) == 0.0
    assert one(spark, A.lcs_length(arr(1, 2, 3, 4, 5), arr(2, 4, 9, 5))) == 3
    assert round(one(spark, A.rouge_l(arr(1, 2, 3, 4, 5), arr(2, 4, 9, 5))), 4) == 0.6667
    assert one(spark, A.packed_boundaries(arr(7, 0, 7, 7, 0, 7), 0)) == [0, 2, 5, 6]
    with pytest.raises(Exception, match="one end"):
        one(spark, A.one_eos(arr(1, e, e)))


def test_numbers(spark):
    assert [one(spark, stats.t95(F.lit(n))) for n in (2, 22, 31, 200)] == [12.706, 2.086, 2.042, 1.96]
    assert math.isnan(one(spark, stats.t95(F.lit(1)))) and one(spark, stats.ci95(F.lit(1.0), F.lit(1))) == 0.0
    assert one(spark, stats.safe_exp(F.lit(51.0))) == math.inf and one(spark, stats.prob_from_log(F.lit(-math.inf))) == 0.0
    assert math.isnan(one(spark, stats.log10_or_nan(F.lit(0.0)))) and one(spark, stats.log10_floored(F.lit(0.0), 1e-8)) == -8.0
    assert one(spark, stats.number(F.lit("x"))) is None and one(spark, stats.number(F.lit("2.5"))) == 2.5


def test_strings(spark):
    names = {"Brontë, Charlotte, 1816-1855 [Editor]": "bronte charlotte", "Ærøskøbing & Þór, 1901-": "aeroskobing thor 1901", "ﬁne Straße ½": "fine strasse 12", "[x] – 12": "12", "日本": None, "": None, None: None}
    keys = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.normalize_key(F.col("n")).alias("k"))
    assert {r.n: r.k for r in keys.collect()} == names
    assert [one(spark, T.ebook_id(F.lit(x))) for x in ("10-0", "1342_x", "phys-0", "abc")] == ["10", "1342", "10453", None]
    book = "intro\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n body \n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nend"
    assert one(spark, T.between(F.lit(book))) == "body" and one(spark, T.between(F.lit("plain"))) == "plain"
    people = T.contributors(F.lit("Doe, Jane, 1820-1890 [Translator, Editor]; Roe, R., 1900-1950"))
    assert one(spark, T.primary_author(people)) == "Roe, R." and one(spark, people)[0].roles == ["Translator", "Editor"]


def test_token_index(spark, tmp_path):
    a, b, out = (str(tmp_path / x) for x in "abc")
    tokenindex.register(spark)
    rows = spark.createDataFrame([(i, i // 2, [i] * (i % 4), None) for i in range(23)], tokenindex.SCHEMA)
    rows.repartitionByRange(3, "seq_id").sortWithinPartitions("seq_id").write.format("tokenindex").mode("append").save(a)
    got = [(r.seq_id, r.doc_id, r.tokens) for r in spark.read.format("tokenindex").option("rows", "5").load(a).orderBy("seq_id").collect()]
    assert got == [(i, i // 2, [i] * (i % 4)) for i in range(23)]
    rows.limit(4).coalesce(1).write.format("tokenindex").mode("append").save(b)
    tokenindex.merge(spark, [a, b], out, rows=4)
    assert tokenindex.statistics(out) == {"sequences": 27, "documents": 14, "tokens": sum(i % 4 for i in range(23)) + 6}
    assert tokenindex.exists(out) and not tokenindex.exists(out + "x") and tokenindex.exists(a)
    index = tokenindex.Index(out)
    assert index.documents(0, index.ends).tolist() == [*range(0, 23, 2), 23, 25, 27]
    back = [(r.seq_id, r.doc_id, r.tokens) for r in spark.read.format("tokenindex").option("rows", "5").load(out).orderBy("seq_id").collect()]
    assert back == got + [(23 + i, 12 + i // 2, [i] * (i % 4)) for i in range(4)]
    one = tokenindex.Tokens(out)
    assert one.get(7).tolist() == [7] * 3 and one.get(7, 1, 1).tolist() == [7] and one.get(-1).tolist() == [3] * 3 and one.get(3, 3).tolist() == []
    assert [x.tolist() for x in one.slice(5, 8)] == [[5], [6] * 2, [7] * 3]
    with pytest.raises(IndexError):
        one.get(27)
    raw = bytearray(open(f"{out}.idx", "rb").read())
    raw[0] = 0
    open(f"{out}.idx", "wb").write(raw)
    with pytest.raises(ValueError):
        tokenindex.Index(out)


def test_modes_and_narrow_ids(spark, tmp_path):
    a, b, out = (str(tmp_path / x) for x in "abc")
    for prefix, n in ((a, 3), (b, 2)):
        np.arange(n * 2, dtype="<u2").tofile(f"{prefix}.bin")
        tokenindex.write_index(prefix, tokenindex.best_code(100), np.full(n, 2), np.array([0, n]), np.full(n, n))
    tokenindex.merge(spark, [b, a], out, rows=2)
    rows = [(r.doc_id, r.tokens, r.mode) for r in spark.read.format("tokenindex").load(out).orderBy("seq_id").collect()] if tokenindex.register(spark) is None else []
    assert rows == [(0, [0, 1], 2), (0, [2, 3], 2), (1, [0, 1], 3), (1, [2, 3], 3), (1, [4, 5], 3)]
    np.zeros(1, "<i4").tofile(f"{a}.bin")
    tokenindex.write_index(a, 4, np.array([1]), np.array([0, 1]))
    with pytest.raises(ValueError):
        tokenindex.merge(spark, [a, b], out)


def test_mix(spark, tmp_path):
    from millrace.sources import mix

    root = str(tmp_path)
    where = mix.layout(root, "other", {})
    assert where == mix.layout(root, "no_fim", {}) and mix.layout(root, "FIM_v2", {"MIX_OUTPUT_PREFIX": "x"})["out"] == "x"
    with pytest.raises(RuntimeError):
        mix.merge_shards(spark, where)
    for k, prefix in enumerate([where["book"], *(where["web"].replace("*.bin", f"w{i}") for i in range(11))]):
        (tmp_path / prefix).parent.mkdir(parents=True, exist_ok=True)
        np.array([k, k], "<i4").tofile(f"{prefix}.bin")
        tokenindex.write_index(prefix, 4, np.array([2]), np.array([0, 1]))
    (tmp_path / where["web"].replace("*.bin", "lonely.bin")).write_bytes(b"")
    assert mix.sources(where)[0] == where["book"] and len(mix.sources(where)) == 12
    out = mix.mix(spark, root, "no_fim", {})
    tokenindex.register(spark)
    order = sorted(range(12), key=lambda i: f"shard_{i}")
    named = [where["book"], *sorted(where["web"].replace("*.bin", f"w{i}") for i in range(11))]
    first = [int(np.fromfile(f"{named[i]}.bin", "<i4")[0]) for i in order]
    assert [r.tokens[0] for r in spark.read.format("tokenindex").load(out).orderBy("seq_id").collect()] == first


def test_files(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n1,Text,2001-01-01," A ""b"" ",en,X,,,\n,Text,,,,,,,\n1,Text,2002-01-01,Last,en,X,,,\n')
    (row,) = files.read_catalog(spark, str(tmp_path / "c.csv.gz")).collect()
    assert (row.Title, row.Subjects) == ("Last", None)
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbad\n{"a": 2}\n')
    assert [r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()] == [1, None, 2]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.read_summaries(spark, {("a", 1): "nowhere"}, "x int")
    (tmp_path / "s.json").write_text('{"x": 5}')
    assert [(r.arm, r.repetition, r.x) for r in files.read_summaries(spark, {("a", 1): str(tmp_path / "s.json")}, "x int").collect()] == [("a", 1, 5)]
    assert files.parse_env("A=1\nB=${A:-2}${C:-3}\n") == {"A": "1", "B": "13"}


def test_suite(spark):
    assert len(suite.arms()) == 47 and suite.tasks(spark).count() == 564
    assert suite.parse_splits("0:100, 20:80,0:100", 100) == [(0, 100), (20, 80)]
    with pytest.raises(ValueError):
        suite.parse_splits("1:2", 100)
    assert layout.epoch_tokens(10, 2, 3) == 12


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/documents.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    s = stream.sequences(stream.long_texts(stream.read_stream(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "))))
    q = s.writeStream.format("memory").queryName("laid_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = stream.sequences(stream.long_texts(batch))
    rows = lambda df: sorted((r.doc_id, r.is_fim, r.laid_out) for r in df.select("doc_id", "is_fim", "laid_out").collect())
    assert rows(spark.table("laid_out")) == rows(want)
    assert all(r[2].count(A.EOS) == 1 for r in rows(want))
