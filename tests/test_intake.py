"""Shards, single files, replicas, draws, layouts, plugins, checks and ranges of an index, each against a plain version."""

import csv
import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import stats as S
from millrace.operators import attention, checks, joins, model, replicas, similarity
from millrace.operators import layout as L
from millrace.sources import files, hadoop, shards, tokenindex


# --- shards ---


def shard(path, texts, rows=50):
    pq.write_table(pa.table({"text": texts, "n": list(range(len(texts)))}), path, row_group_size=rows, compression="none", use_dictionary=False, write_page_checksum=True)


def test_a_corrupt_shard_gives_no_row(spark, tmp_path):
    rng, folder = random.Random(4), tmp_path / "in"
    folder.mkdir()
    texts = {f"s{k}.parquet": ["".join(rng.choices("abc xyz", k=rng.choice([5, 199, 200, 400]))) for _ in range(300)] + [None, ""] for k in range(5)}
    for name, rows in texts.items():
        shard(folder / name, rows)
    raw = (folder / "s1.parquet").read_bytes()
    (folder / "s1.parquet").write_bytes(raw[: len(raw) // 2])  # no footer
    raw = bytearray((folder / "s3.parquet").read_bytes())
    raw[len(raw) // 2 - 2000 : len(raw) // 2 + 2000] = bytes(4000)  # a fault in the middle: rows before it can be read
    (folder / "s3.parquet").write_bytes(raw)
    (folder / "notes.txt").write_text("no shard")
    found = {r.file.rsplit("/", 1)[-1]: (r.rows, r.fault is None) for r in shards.checked(spark, str(folder), ["text"]).collect()}
    assert {k for k, v in found.items() if not v[1]} == {"s1.parquet", "s3.parquet"}
    out = str(tmp_path / "out")
    told = shards.write_texts_by_shard(spark, str(folder), out, 200)
    whole = [x for k, v in texts.items() if k not in ("s1.parquet", "s3.parquet") for x in v]
    kept = [x for x in whole if x is not None and len(x) >= 200]
    assert told == {"read": len(whole), "kept": len(kept), "short": len(whole) - len(kept), "lost": 2}
    back = spark.read.json(out).collect()
    assert sorted(r.text for r in back) == sorted(kept)
    assert {r.shard for r in back} == set(texts) - {"s1.parquet", "s3.parquet"}
    shard(folder / "s1.parquet", texts["s1.parquet"])
    for k in ("s0", "s2", "s3", "s4"):
        (folder / f"{k}.parquet").unlink()
    assert shards.write_texts_by_shard(spark, str(folder), out, 200)["lost"] == 0
    assert {r.shard for r in spark.read.json(out).collect()} == {"s1.parquet"}  # older output is gone
    (folder / "s1.parquet").write_bytes(b"PAR1")
    assert shards.write_texts_by_shard(spark, str(folder), out, 200) == {"read": 0, "kept": 0, "short": 0, "lost": 1}


# --- single files ---


def test_one_csv_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["c", "a", "b", "zz", None]), i, rng.choice(['with "quotes", commas', "line\nend", " spaced ", "", None, "plain"])) for i in range(400)]
    path, side = str(tmp_path / "one.csv"), tmp_path / "old.txt"
    side.write_text("stale")
    df = spark.createDataFrame(rows, "arm string, n int, text string").repartition(7)
    for _ in range(2):  # the second takes the first one's place
        hadoop.write_one_csv(df, path, ["n", "arm", "none", "text"], ["arm", F.desc("n")], {"arm": ["b", "c", "a"]}, beside=[str(side)])
    with open(path, newline="") as f:
        got = list(csv.reader(f))
    place = {"b": 0, "c": 1, "a": 2}
    want = sorted(rows, key=lambda r: (place.get(r[0], 3), r[0] is not None, r[0] or "", -r[1]))
    assert got == [["n", "arm", "none", "text"]] + [[str(n), a or "", "", t or ""] for a, n, t in want]
    assert not side.exists() and sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["one.csv"]


def test_lists_status_and_summaries(spark, tmp_path):
    path = str(tmp_path / "missing.txt")
    keys = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string")
    assert hadoop.write_list(keys, path) == 2 and hadoop.read_text(spark, path) == "a\nb\n"
    assert hadoop.write_list(keys.filter("k is null"), path) == 0 and not hadoop.exists(spark, path)
    for status in ({"step": 1}, {"step": 2, "of": "é"}):
        hadoop.write_status(spark, f"{tmp_path}/status.json", status)
    assert json.loads((tmp_path / "status.json").read_text()) == {"step": 2, "of": "é"}
    hadoop.write_text(spark, f"{tmp_path}/a b.json", '{"x": 7}')
    got = files.read_summaries(spark, {("arm", 2): f"{tmp_path}/a b.json", ("arm", 3): f"file:{tmp_path}/none.json"}, "x int", allow_missing=True)
    assert [(r.arm, r.repetition, r.x) for r in got.collect()] == [("arm", 2, 7)]
    with pytest.raises(FileNotFoundError, match="none.json"):
        files.read_summaries(spark, {("arm", 3): f"{tmp_path}/none.json"}, "x int")


# --- replicas and draws ---

ROW = f"sample_index long, excerpt_id string, base_excerpt_id string, repetition_bucket int, replica_count int, replica_index int, bucket_base_index long, unique_eval_compact boolean, replica_metadata array<{replicas.ITEM}>"


def plain_items(r, fallback):
    i, e, b, bucket, count, index, place, compact, listed = r
    e = str(i) if e is None else e
    own = (e, e if b is None else b, fallback if bucket is None else bucket, fallback if count is None else count, index, place)
    named = [x for x in listed or [] if x is not None]
    if named:
        return [(i, *(o if v is None else v for v, o in zip(x, own, strict=True))) for x in named]
    if listed is None and compact and own[3] is not None:
        return [(i, *own[:4], k, own[5]) for k in range(own[3])]
    return [(i, *own)]


def test_replica_items(spark):
    rng, rows = random.Random(9), []
    some = lambda *x: rng.choice([None, *x])
    for i in range(300):
        listed = rng.choice([None, None, [], [None], [(some("x"), some("y"), some(4), some(2), some(0, 1), some(9)) for _ in range(3)] + [None]])
        rows.append((i, some(f"e{i}"), some(f"b{i}"), some(2, 8), some(0, 1, 3), some(0), some(5), some(True, False), listed))
    for fallback in (None, 4):
        got = replicas.items(spark.createDataFrame(rows, ROW), fallback)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((x for r in rows for x in plain_items(r, fallback)), key=str)


def test_compact_replicas_expand_to_what_they_were(spark):
    whole = [(i, f"e{i}", f"b{i}", 4, 4, k, i % 3 or None) for i in range(20) for k in range(4)]
    broken = [(30, "e30", "b30", 4, 4, k, 1) for k in (0, 1, 3)] + [(31, "e31", "b31", 2, 2, 0, 1)] * 2 + [(32, "e32", "b32", None, None, None, None), (33, "x", "b33", 2, 2, 0, 1), (33, "y", "b33", 2, 2, 1, 1), (34, "e34", "b34", 1, 1, 1, 0)]
    df = spark.createDataFrame(whole + broken, "sample_index long, excerpt_id string, base_excerpt_id string, repetition_bucket int, replica_count int, replica_index int, bucket_base_index long")
    small = replicas.compacted(df)
    assert small.count() == 20 + len(broken)
    back = replicas.items(small).select(df.columns).collect()
    assert sorted(map(tuple, back), key=str) == sorted(whole + broken, key=str)


def test_first_samples(spark):
    df = spark.createDataFrame([(3, "a", "late"), (1, "a", "early"), (2, None, "own")], "sample_index long, excerpt_id string, t string")
    assert sorted(tuple(r) for r in replicas.first_samples(df, "t").collect()) == [("2", 2, "own"), ("a", 1, "early")]


@pytest.mark.parametrize("k", [None, 0, -1, 1, 7, 60, 61, 500])
def test_sample_is_pythons(spark, k):
    ids = [i * 37 % 1009 for i in range(61)]
    got = replicas.python_sample(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5), "id", k, 11)
    want = random.Random(11).sample(sorted(ids), k) if k and 0 < k < len(ids) else ids
    assert sorted(r.id for r in got.collect()) == sorted(want)


# --- layouts and plugins ---


def plain_layout(fmt, p, s, t):
    parts = [("P", p), ("T", t)] if fmt == "ltr_prefix" else [("M", 1), ("P", p), ("M", 1), ("S", s), ("M", 1), ("T", t)]
    return "".join(c * n for c, n in parts)


def test_layouts_of_all_arms(spark):
    from millrace.operators.suite import arms

    rows = [(a[0], a[5], a[7], a[9], a[8]) for a in arms()] + [("none", "fim_native", 0, 0, 1), ("one", "ltr_prefix", 1, 0, 1)]
    df = spark.createDataFrame(rows, "arm_id string, f string, p int, s int, t int")
    out = attention.layout(df, "f", "p", "s", "t").withColumn("roles", attention.roles()).collect()
    assert len(out) == len(rows)
    for r in out:
        want = plain_layout(r.f, r.p, r.s, r.t)
        assert r.roles == want and r.sequence_length == len(want) and r.prompt_length == len(want) - r.t == r.first_query + 1
        at = lambda c: [i for i, x in enumerate(want) if x == c]  # noqa: B023, E731
        assert list(r.marks) == at("M") and at("P") == list(range(r.prefix_begin, r.prefix_end)) and at("S") == list(range(r.suffix_begin, r.suffix_end)) and at("T") == list(range(r.target_begin, r.target_end))
    with pytest.raises(Exception, match="no prompt format"):
        attention.layout(spark.createDataFrame([("x", 1, 1, 1)], "f string, p int, s int, t int"), "f", "p", "s", "t").collect()


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    class Loaded:
        """Counts its loads in a file, to see that a worker keeps its model."""

        def __init__(self, path):
            with open(path, "a") as f:
                f.write("x")

        def losses(self, ids):
            return [ids[:, 1:] * 10.0 + ids[:, :-1]]

    path = str(tmp_path / "loads")
    rows = [(i, [i % 5, 3, 9, i % 7, 9][: 2 + i % 4] if i % 11 else None) for i in range(400)] + [(900, []), (901, [9]), (902, [4, None])]
    df = spark.createDataFrame(rows, "key long, ids array<int>").repartition(12)
    got = {r.key: r for r in model.window_perplexity(df, ["key"], lambda: Loaded(path), 9, 3, batch=4).collect()}
    assert set(got) == {k for k, v in rows if v and None not in v}
    for k, v in rows:
        if k in got:
            kept = [10.0 * b + a for a, b in zip(v, v[1:], strict=False) if b not in (9, 3)]
            assert got[k].nll_count == len(kept) and got[k].nll_sum == sum(kept)
            mean = sum(kept) / max(1, len(kept))
            assert got[k].ppl == pytest.approx(np.exp(mean) if mean < 50 else np.inf)
    assert len((tmp_path / "loads").read_text()) <= 4  # local[4] has four workers, twelve tasks


def test_attention_rows_sum_to_one(spark):
    df = spark.createDataFrame([(1, [1, 2, 1, 3, 1], 2), (2, [1, 1, 1, 1, 1], 2), (3, [5, 6, 7], 1)], "w long, ids array<int>, first int")
    got = model.attention_rows(df.filter("w < 3"), ["w"], lambda: model.Recency(2, 3, 2), 2, 3, "first").collect()
    sums = {}
    for r in got:
        assert r.k <= r.q
        sums[r.w, r.l, r.h, r.q] = sums.get((r.w, r.l, r.h, r.q), 0) + r.a
    assert set(sums) == {(w, l, h, q) for w in (1, 2) for l in (0, 1) for h in (0, 1, 2) for q in (2, 3)}  # noqa: E741
    assert all(abs(x - 1) < 1e-9 for x in sums.values())


# --- checks ---


def test_arguments():
    assert checks.probe_arguments(100, 32, 0, 132, layout="cooper_nonoverlap", budget=100) == 100
    assert checks.probe_arguments(40, 20, 60, 120, prompt_format="fim_native", intervention="both_distractor") == 100
    good = {"prefix": 10, "middle": 5, "suffix": 0, "stride": 15}
    bad = [{"prefix": 0}, {"suffix": 3}, {"middle": 0}, {"stride": 0}, {"offset": -1}, {"most": -1}, {"batch": 0}, {"shards": 0}, {"rank": 1}, {"rank": -1}, {"expected_shards": 0}, {"top_k": 0}, {"temperature": 0.0}]
    bad += [{"threshold": 0.0}, {"threshold": 1.1}, {"layout": "cooper_nonoverlap", "stride": 14}, {"layout": "cooper_dense", "prompt_format": "fim_native"}, {"budget": 11}, {"intervention": "both_distractor"}, {"intervention": "other", "prompt_format": "fim_native"}]
    for x in bad:
        with pytest.raises(ValueError):
            checks.probe_arguments(**(good | x))
    checks.dedup_arguments(0.96, 0.2)
    for x in ({"cosine": 1.0}, {"cosine": 0.0}, {"jaccard": 1.1}, {"dim": 1}, {"length": 7}, {"batch": 0}, {"block": 0}, {"keep": 0}, {"divisor": 0}):
        with pytest.raises(ValueError):
            checks.dedup_arguments(**({"cosine": 0.9, "jaccard": 0.0} | x))
    assert checks.interventions("full, both_distractor full") == ["full", "both_distractor"]
    for x in ("", "nothing"):
        with pytest.raises(ValueError):
            checks.interventions(x)
    assert checks.bucket_size("AUTO", 40, 12) == 3 and checks.bucket_size("5", 1, 1) == 5
    for x in ("auto", "0", "x", "-1"):
        with pytest.raises(ValueError):
            checks.bucket_size(x, 11, 12)


def test_bucket_faults(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, bucket int, score double")
    even = [(i, i % 3, 10.0) for i in range(9)]
    assert checks.bucket_faults(df(even), [0, 1, 2], 3).count() == 0
    rows = [*even[:-1], (0, 2, 12.0), (77, 5, None)]
    got = {(r.rule, r.bucket, r.id) for r in checks.bucket_faults(df(rows), [0, 1, 2, 3], 3).collect()}
    assert got == {("size", 3, None), ("size", 5, None), ("disjoint", None, "0"), ("score", 5, "77"), ("spread", None, None)}
    assert not checks.bucket_faults(df(rows), [0, 1, 2, 3], 3, -1).filter("rule = 'spread'").count()


def test_strict_join(spark):
    rows, texts = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    assert sorted(r.t for r in joins.strict(rows, texts, "k").collect()) == ["a", "b", "b"]
    with pytest.raises(Exception, match="no text for: 9"):
        joins.strict(spark.createDataFrame([(9,), (1,)], "k int"), texts, "k").collect()


def test_grid_and_presets(spark):
    got = spark.range(1).select(S.log_grid(-2.0, 0.0, 5).alias("g"), S.log_grid(1.0, 9.0, 1).alias("one")).first()
    assert np.allclose(got.g, np.logspace(-2, 0, 5)) and got.one == [10.0]
    with pytest.raises(ValueError):
        L.by_preset(spark.range(1), F.lit("x"), "nothing")


# --- statistics of the gates ---


def test_statistics_of_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    n = 60
    v = np.array([base[i % 6] + rng.normal(scale=0.1, size=16) for i in range(n)])
    sets = [sorted({f"{i % 6}-{rng.integers(0, 14)}" for _ in range(12)}) for i in range(n)]
    score = [float(rng.integers(0, 9)) for _ in range(n)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos, jac = unit @ unit.T, np.array([[len({*x} & {*y}) / len({*x} | {*y}) for y in sets] for x in sets])
    over = [(i, j) for i in range(n) for j in range(i + 1, n) if cos[i, j] >= 0.9]
    kept, taken = [], []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        near = [k for k in kept if cos[i, k] >= 0.9 and jac[i, k] >= 0.4]
        if near:
            best = max(near, key=lambda k: (round(cos[i, k], 6), score[k], -k))
            taken.append((best, round(jac[i, best], 6)))
        else:
            kept.append(i)
    values = sorted(x for _, x in taken)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = similarity.statistics(
        frame([(i, score[i]) for i in range(n)], "id long, score double"), frame([(i, v[i].tolist()) for i in range(n)], "id long, v array<double>"), frame([(i, sets[i]) for i in range(n)], "id long, s array<string>"), 0.9, 0.4
    ).first()
    assert (got.rows_before, got.rows_after, got.rows_assigned) == (n, len(kept), len(taken)) and len(taken) > 10
    assert (got.over_cosine, got.over_jaccard) == (len(over), sum(jac[i, j] >= 0.4 for i, j in over))
    assert got.largest_cluster == 1 + max(sum(b == k for b, _ in taken) for k in kept)
    assert (got.jaccard_median, got.jaccard_p95) == (values[len(values) // 2], values[min(len(values) - 1, int(0.95 * len(values)))])
    assert got.jaccard_mean == pytest.approx(sum(values) / len(values), abs=1e-6)


# --- ranges of an index ---


def test_ranges_decide_what_is_read(spark, tmp_path):
    tokenindex.register(spark)
    prefix = str(tmp_path / "index" / "docs")
    rows = [(i, i // 3, [i] * (i % 5 + 1), None) for i in range(400)]
    df = spark.createDataFrame(rows, tokenindex.SCHEMA).repartitionByRange(5, "seq_id").sortWithinPartitions("seq_id")
    df.write.format("tokenindex").mode("append").save(prefix)
    assert len(tokenindex.shards(prefix)) > 2
    read = lambda **options: sum(p.end - p.begin for p in tokenindex.Reader({"path": prefix, **options}).partitions())
    assert read() == 400
    assert read(seq_id="37:91") == 54  # no other sequence is opened
    assert read(doc_id="5,6,90", seq_id=":200".join(["0", ""])) == 6
    assert read(seq_id=str(10**6)) == read(seq_id="") == 0
    want = lambda keep: sorted((s, d, t) for s, d, t, _ in rows if keep(s, d))
    for seq, doc, keep in (
        ([(37, 91)], None, lambda s, d: 37 <= s < 91), (None, [(17, 18)], lambda s, d: d == 17), ([(101, 400)], [(0, 1), (50, 52), (133, 134)], lambda s, d: d in (0, 50, 51, 133) and s > 100),
        ([(0, 10), (5, 30), (390, 999)], None, lambda s, d: s < 30 or s >= 390), ([], None, lambda s, d: False), (None, None, lambda s, d: True),
    ):
        got = tokenindex.ranges(spark, prefix, seq, doc)
        assert sorted((r.seq_id, r.doc_id, r.tokens) for r in got.collect()) == want(keep)
    once = tokenindex.ranges(spark, prefix, [(5, 9)])
    assert {r.seq_id for r in once.filter("seq_id > 6").union(once.filter("seq_id < 6")).collect()} == {5, 7, 8}
