"""The probe's operators, scans and plugins against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import stats as S
from millrace.functions import tokenizers
from millrace.functions.rng import seed_of
from millrace.operators import attention, joins, probe, similarity, suite
from millrace.plans import QUERIES, measure
from millrace.sources import scans

rng = random.Random(7)


def test_distractors_against_all_pairs(spark):
    g = probe.Geometry(4, 3, 2, 5)
    samples = [(i, rng.choice([9, 15, 16, 22, 40, 90])) for i in range(0, 60, 2)]
    rows = probe.candidates(spark.createDataFrame(samples, "id long, size int"), g)
    found = probe.windows(rows)
    starts = {i: [a for a in range(6, n - 3 - 6 + 1, 5)] for i, n in samples}
    chosen = {}
    for i, at in starts.items():
        for a in at:
            if not chosen.get(i) or a - chosen[i][-1] >= 9:
                chosen.setdefault(i, []).append(a)
    assert {(r.id, r.window_index, r.target_start, r.candidate_window_count) for r in found.collect()} == {(i, starts[i].index(a), a, len(starts[i])) for i, x in chosen.items() for a in x}
    one = probe.counters(rows).first()
    assert (one.num_excerpts, one.num_excerpts_with_windows, one.num_candidate_windows, one.num_selected_windows) == (30, len(chosen), sum(map(len, starts.values())), sum(map(len, chosen.values())))
    got = {(r.id, r.target_start): r.distractor for r in probe.distractors(found, spark.createDataFrame(samples, "id long, size int"), g).collect()}
    want = {}
    for i, x in chosen.items():
        for a in x:
            begin = seed_of(f"0::{i}::{a}::distractor") % len(samples)
            turn = samples[begin:] + samples[:begin]
            want[i, a] = next((j for j, n in turn if j != i and n >= a + 5), None)
    assert got == want and None in {want.get(k) for k in want} | {None}


def test_distractors_across_blocks(spark, monkeypatch):
    """Blocks of four: windows find theirs in their own block, in a later one, around the end, or nowhere; a sample that is
    as long as can be stands once."""
    monkeypatch.setattr(probe, "BLOCK", 4)
    g = probe.Geometry(4, 3, 2, 5)
    draw = random.Random(11)
    samples = [(i, draw.choice([9, 9, 9, 9, 16, 40])) for i in range(30)] + [(30, 90), (31, 2_000_000_000)]
    found = [(i, a) for i, n in samples for a in (6, 21, 60, 1_000_000_006) if n >= a + 5]
    got = {(r.id, r.target_start): r.distractor for r in probe.distractors(spark.createDataFrame(found, "id long, target_start int"), spark.createDataFrame(samples, "id long, size int"), g).collect()}
    want = {}
    for i, a in found:
        begin = seed_of(f"0::{i}::{a}::distractor") % len(samples)
        want[i, a] = next((j for j, n in samples[begin:] + samples[:begin] if j != i and n >= a + 5), None)
    assert got == want and want[31, 1_000_000_006] is None and want[30, 60] == 31


def test_mixed_index_moves_texts_once(spark, sf, monkeypatch):
    """Texts are neither ranked nor written again before they are in the index."""
    from millrace.plans import corpus

    def ranked(*_, **__):
        raise AssertionError("texts are ranked")

    monkeypatch.setattr(corpus, "global_sums", ranked)
    got = [(r.seq_id, r.n, r.total) for r in QUERIES["set4_xf3_mixed_index"](spark, sf).orderBy("seq_id").collect()]
    rows = sorted((r.doc_id % 4, r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text)
    assert got == [(i, len(t), sum(map(ord, t))) for i, (_, _, t) in enumerate(rows)]


def test_selection(spark):
    g = probe.Geometry(1, 1, 0, 1, layout="cooper_nonoverlap")
    rows = spark.createDataFrame([(1, 20), (2, 3)], "id long, size int")
    first = {r.id: r.chosen for r in probe.candidates(rows, g, 3, "first").collect()}
    assert first[1] == [1, 3, 5]
    some = {r.id: r.chosen for r in probe.candidates(rows, g, 3).collect()}
    assert some[1] == sorted(random.Random(seed_of("0::1::windows")).sample(list(range(1, 20, 2)), 3)) and some[2] == [1]
    with pytest.raises(ValueError):
        probe.candidates(rows, g, 3, "last")


def test_window_rows_against_plain(spark, sf):
    docs = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = {}
    for t in docs.values():
        for a, b in zip(t, t[1:], strict=False):
            count.setdefault(a, {}).setdefault(b, 0)
            count[a][b] += 1
    best = {a: min(c, key=lambda x: (-round(math.log(c[x]), 6), x)) for a, c in count.items()}
    rows = {(r.doc_id, r.target): r for r in QUERIES["mdl11_window_rows"](spark, sf).collect()}
    assert len(rows) == sum(len(range(30, len(t) - 9, 50)) for t in docs.values())
    for (doc, target), r in rng.sample(sorted(rows.items()), 150):
        t = docs[doc]
        truth, last, made = t[target : target + 10], t[target - 1], []
        while len(made) < 10 and last in best:
            last = best[last]
            made.append(last)
        nll = -sum(math.log(count[a][b] / sum(count[a].values())) for a, b in zip(t[target - 1 : target + 9], truth, strict=True)) / 10
        assert abs(r.Ref_NLL - nll) < 1e-5 and r.true_length == 10
        if len(made) < 10:
            assert r.generated_length == 0 and math.isnan(r["Rouge-L"])
            continue
        table = [[0] * 11 for _ in range(11)]
        for i, x in enumerate(truth):
            for j, y in enumerate(made):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        same = sum(x == y for x, y in zip(truth, made, strict=True))
        assert (r.LCS_length, r.positional_match_count, r.memorization_score, r.match_ge_0_50) == (table[10][10], same, round(same / 10, 6), float(table[10][10] >= 5))


def test_scenarios_must_all_be_there(spark):
    rows = spark.createDataFrame([(1, "no_fim", 0.5, 1.0, 1), (1, "fim_v2", 0.1, 1.0, 0)], "k int, model string, p double, nll double, extractable int")
    with pytest.raises(Exception, match="fim_only"):
        probe.paired_examples(rows, ["k"], 2).collect()


def test_shards(spark, tmp_path):
    rows = spark.range(20).withColumn("shard", probe.in_shard(F.col("id"), 3))
    path = scans.write_shards_of(rows.filter("shard <> 1"), "shard", 3, str(tmp_path))
    assert scans.read_shards_of(spark, path, "shard", 3, "id long").count() == 13
    with pytest.raises(FileNotFoundError, match="3"):
        scans.read_shards_of(spark, path, "shard", 4, "id long")
    one = probe.summary(spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "m double"), ["m"], ["m"])
    document = json.loads(probe.summary_document(one, suite="x").first().document)
    assert document["metrics"]["m"] == {"mean": 2.0, "std": 1.0} and document["num_windows"] == 3 and document["suite"] == "x"


def test_attention_against_numpy(spark):
    r = np.random.default_rng(1)
    layers, heads, n = 5, 2, 9
    a = np.tril(r.random((layers, heads, n, n)))
    a /= a.sum(axis=-1, keepdims=True)
    rows = [(1, la, h, q, k, float(a[la, h, q, k])) for la in range(layers) for h in range(heads) for q in range(5, n) for k in range(q + 1)]
    bounds = spark.createDataFrame([(1, 1, 3, 4, 5, [0, 3, 5], 6, 9, 5)], "w int, prefix_begin int, prefix_end int, suffix_begin int, suffix_end int, marks array<int>, target_begin int, target_end int, first_query int")
    got = attention.profile(spark.createDataFrame(rows, "w int, l int, h int, q int, k int, a double"), bounds, layers).first()
    x = a[:, :, 5:, :]
    prefix, suffix = x[..., 1:3].sum(-1), x[..., 4:5].sum(-1)
    near = lambda name, v: abs(got[name] - v) < 1e-9
    assert near("attn_prefix_mass", prefix.mean()) and near("attn_fim_marker_mass", x[..., [0, 3, 5]].sum(-1).mean()) and near("attn_target_prev_mass", x[..., 6:].sum(-1).mean())
    assert near("attn_first_prefix_mass", prefix[:, :, 0].mean()) and near("attn_later_suffix_mass", suffix[:, :, 1:].mean())
    assert attention.bands(5) == {"early": (0, 1), "mid": (1, 3), "late": (3, 5)} and near("attn_mid_prefix_mass", prefix[1:3].mean())
    assert near("attn_prefix_share_of_context", prefix.mean() / (prefix.mean() + suffix.mean()))
    q = np.arange(5, n)[:, None]
    assert near("attn_backward_distance", (x * np.maximum(q - np.arange(n), 0)).sum(-1).mean())
    e = -(x * np.log(np.maximum(x, 1e-30))).sum(-1) / np.maximum(np.log(np.arange(5, n) + 1), 1)
    assert near("attn_entropy_norm", e.mean())


def test_semantic_clusters_by_both_gates(spark):
    base = [np.array([rng.gauss(0, 1) for _ in range(8)]) for _ in range(6)]
    vectors, sets, nodes = [], [], []
    for i in range(40):
        v = base[i % 6] + 0.15 * np.array([rng.gauss(0, 1) for _ in range(8)])
        vectors.append((i, [float(x) for x in v]))
        sets.append((i, sorted({f"s{i % 3}_{rng.randrange(12)}" for _ in range(8)})))
        nodes.append((i, float(rng.randint(0, 4))))
    cos = lambda i, j: float(np.dot(vectors[i][1], vectors[j][1]) / (np.linalg.norm(vectors[i][1]) * np.linalg.norm(vectors[j][1])))
    jac = lambda i, j: len({*sets[i][1]} & {*sets[j][1]}) / len({*sets[i][1]} | {*sets[j][1]})
    kept, want, by_cosine = [], {}, 0
    for i, _ in sorted(nodes, key=lambda x: (-x[1], x[0])):
        near = [(round(cos(i, k), 6), nodes[k][1], -k) for k in kept if cos(i, k) >= 0.96 and jac(i, k) >= 0.3]
        by_cosine += any(cos(i, k) >= 0.96 and jac(i, k) < 0.3 for k in kept)
        want[i] = -max(near)[2] if near else i
        kept += [] if near else [i]
    frames = [spark.createDataFrame(x, s) for x, s in ((nodes, "id long, score double"), (vectors, "id long, v array<double>"), (sets, "id long, s array<string>"))]
    found = similarity.semantic_clusters(*frames, 0.96, 0.3).cache()
    assert {r.id: r.representative for r in found.collect()} == want and by_cosine and len(kept) < 36
    assert all(abs(r.jaccard - (1 if r.id == r.representative else jac(r.id, r.representative))) < 1e-6 for r in found.collect())
    order = sorted(kept, key=lambda i: (-nodes[i][1], i))
    table = {r.cluster_id: r for r in similarity.cluster_table(found).collect()}
    for n, k in enumerate(order):
        r = table[f"cluster_{n:05d}"]
        own = sorted((i for i in want if want[i] == k), key=lambda i: (-nodes[i][1], i))
        assert (r.representative, r.cluster_size, r.member_ids, r.removed_ids) == (k, len(own), own, [i for i in own if i != k])
    fate = {r.id: (r.status, r.trim_reason) for r in similarity.manifest(found, 7).collect()}
    gone = order[len(order) - len(order) % 7 :]
    for i in want:
        assert fate[i][0] == ("removed" if want[i] != i else "trimmed" if i in gone else "kept")
        assert (fate[i][1] is not None) == (fate[i][0] == "trimmed")
    with pytest.raises(ValueError):
        similarity.semantic_clusters(*frames, 1.5)


def test_scans(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return str(tmp_path / name)

    path = lines("w/a.jsonl", {"e": "x", "i": 1, "m": 1.0, "z": 0}, {"e": "x", "i": 1, "m": 2.0}, {"e": "y", "i": 1, "m": 3})
    assert sorted(map(tuple, scans.window_rows(spark, path, {"e": "string", "i": "int"}, ["m"]).collect())) == [("x", 1, 2.0), ("y", 1, 3.0)]
    lines("t/1/r.jsonl", {"model_label": "a", "repetition": 1, "p": 0.5}, {"model_label": "b", "repetition": 1, "p": 0.5})
    lines("t/2/r.jsonl", {"model_label": "a", "repetition": 2, "p": 0.1})
    schema = "model_label string, repetition int, p double"
    assert scans.tree_rows(spark, str(tmp_path / "t/*/r.jsonl"), schema, ["a"], [1, 2], F.col("p") > 0.2).count() == 1
    with pytest.raises(FileNotFoundError):
        scans.tree_rows(spark, str(tmp_path / "t/*/none"), schema)
    rows, keys = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1,), (1,)], "k int")
    assert [r.v for r in scans.keyed_rows(rows, keys, ["k"]).collect()] == ["a"]
    with pytest.raises(Exception, match="missing keys"):
        scans.keyed_rows(rows, spark.createDataFrame([(1,), (9,)], "k int"), ["k"]).collect()
    a, b = lines("m/a.jsonl", {"id": "1"}, {"id": ""}, {"id": None}), lines("m/b.jsonl", {"id": 1}, {"id": 7})
    assert sorted(r.id for r in scans.manifest_keys(spark, [a, b, str(tmp_path / "none")], "id").collect()) == ["1", "7"]
    path = lines("b.jsonl", {"excerpt_id": "x", "replica_index": 0}, {"excerpt_id": "x", "replica_index": 1, "bucket_base_index": 9}, {"excerpt_id": "q", "base_excerpt_id": "y", "replica_count": 4, "bucket_base_index": 3})
    assert sorted(tuple(r) for r in scans.bucket_members(spark, path, 2).collect()) == [("x", 2, 2, None), ("y", 2, 4, 3)]
    with pytest.raises(RuntimeError):
        scans.bucket_members(spark, lines("c.jsonl", {"excerpt_id": "x", "replica_index": 1}), 2)
    for i, n in ((1, 5), (2, 6)):
        spark.range(n).write.parquet(str(tmp_path / f"snap/{i}"))
    assert scans.newest_snapshot(spark, str(tmp_path / "snap")).count() == 6
    assert scans.newest_snapshot(spark, str(tmp_path / "no"), lambda: spark.range(1)).count() == 1
    with pytest.raises(FileNotFoundError):
        scans.newest_snapshot(spark, str(tmp_path / "no"))
    scans.fetch_once(spark, a, str(tmp_path / "got"))
    scans.fetch_once(spark, b, str(tmp_path / "got"))
    assert (tmp_path / "got").read_text() == open(a).read()
    assert scans.stale(spark, str(tmp_path / "none"), []) and scans.stale(spark, a, [str(tmp_path / "none")]) and not scans.stale(spark, str(tmp_path / "got"), [a], {a: ["id"]}) and scans.stale(spark, str(tmp_path / "got"), [a], {a: ["x"]})
    scans.write_texts(spark.createDataFrame([("t", 1)], "text string, x int"), str(tmp_path / "texts"))
    assert spark.read.json(str(tmp_path / "texts")).columns == ["text"]
    scans.write_vectors(spark.createDataFrame([("e", [0.5])], "excerpt_id string, embedding array<double>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().embedding == [0.5]
    (tmp_path / "s.csv").write_text("model_label,x\na,1\nb,2\n")
    assert [r.x for r in scans.summary_csv(spark, str(tmp_path / "s.csv"), ["b"]).collect()] == ["2"]


def test_suite_checks(spark):
    arms = suite.arm_table(spark)
    assert arms.filter("arm_id in ('no_fim_ltr_p100_m32', 'fim_v2_prefix_rescue_p0_s100_full', 'attn_fim_v2_native_p20_s80')").count() == 3
    assert suite.chosen(arms, ["ltr"], None, ["fim_v2"]).count() == 1 and suite.chosen(arms, ["all"], ["attention"]).count() == 8
    with pytest.raises(ValueError, match="nothing"):
        suite.chosen(arms, ["nothing"])
    bad = suite.mismatches(arms.filter("experiment = 'ltr'"), {"middle_length": 32, "prompt_format": "fim_native"}).collect()
    assert {(r.field, r.found, r.wanted) for r in bad} == {("prompt_format", "ltr_prefix", "fim_native")} and len(bad) == 3
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 3)], "k string, r int")
    (r,) = suite.gaps(rows, ["k"], "r", [1, 2]).collect()
    assert (r.k, r.missing, r.unknown, r.repeated) == ("b", [2], [3], 1)


def test_plugins():
    t = tokenizers.BYTES
    assert t.decode(t.encode("aß")) == "aß" and t.decode([97, 256]) == "a<|end|>"
    assert tokenizers.once("x", lambda: [1]) is tokenizers.once("x", lambda: [2])
    tokenizers.check_specials({"a": 1}, {"a": 1})
    with pytest.raises(ValueError, match="b is None"):
        tokenizers.check_specials({"a": 1}, {"a": 1, "b": 2})
    assert tokenizers.pad_token("p", [], []) == ("p", "already-configured") and tokenizers.pad_token(None, ["x", "<PAD>"], []) == ("<PAD>", "matched-substring")
    assert tokenizers.pad_token(None, ["x"], []) == ("x", "fallback-first") and tokenizers.pad_token(None, [], []) == (None, "none-available")
    assert tokenizers.pad_token(None, [], ["<|reserved_special_token_3|>"])[1] == "fallback-reserved"


def test_fields_and_limits(spark):
    rows = spark.createDataFrame([([1], None), (None, [2])], "ids array<int>, token_ids array<int>")
    assert [r.x for r in rows.select(tokenizers.token_field(rows.columns).alias("x")).collect()] == [[1], [2]]
    with pytest.raises(ValueError):
        tokenizers.token_field(["text"])
    v = spark.createDataFrame([(1.0, 0.5), (3.0, 0.5), (float("nan"), 9.0)], "v double, e double")
    assert tuple(S.limits(v, "v", "e", 0.0, 0.1).first()) == (pytest.approx(0.2), pytest.approx(3.8))
    assert tuple(S.limits(v.filter("v = 1"), "v", "v", 0.0).first()) != () and S.limits(v.limit(0), "v", "e").count() == 0
    down, up = S.log_errors(F.col("v"), F.col("e"))
    assert [tuple(r) for r in v.select(down, up).collect()] == [(0.5, 0.5), (0.5, 0.5), (0.0, 0.0)]


def test_look_up_spreads_hot_keys(spark, monkeypatch):
    many = spark.createDataFrame([(i % 3 if i < 90 else None, i) for i in range(100)], "k int, i int")
    one = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    want = sorted((r.i, r.v or "") for r in many.join(one, "k", "left").collect())
    for few in (joins.FEW, 0):
        monkeypatch.setattr(joins, "FEW", few)
        assert sorted((r.i, r.v or "") for r in joins.look_up(many, one, ["k"], ["i"], "left").collect()) == want


def test_near_vectors_with_unlike_sets_are_counted_only(spark):
    n = 60
    v = [1.0, 2.0, 3.0]
    vectors = [(i, v if i % 2 else [1.0, 2.0, 3.001]) for i in range(n)]
    # rows 0 to 9 are copies of one, the rest have sets of their own
    sets = [(i, [f"{max(i, 9)}:{k}" for k in range(300)]) for i in range(n)]
    vectors = [(i, v if i < 10 else x) for i, x in vectors]
    frames = [spark.createDataFrame(x, s) for x, s in (([(i, float(i)) for i in range(n)], "id long, score double"), (vectors, "id long, v array<double>"), (sets, "id long, s array<string>"))]
    found, counts = similarity.clusters_and_counts(*frames, 0.96, 0.2)
    assert {r.id: r.representative for r in found.collect()} == {i: max(i, 9) for i in range(n)}
    assert counts() == {"over_cosine": n * (n - 1) // 2, "over_jaccard": 45}
    rows = similarity.sketches(similarity.hashed(frames[2])).join(frames[1], "id").selectExpr("id", "v", "n", "bits", "1L as w")
    met = similarity._meet(rows.cache(), 0.96, 0.2).collect()
    assert sorted((r.a, r.b) for r in met if r.a is not None) == [(a, b) for a in range(10) for b in range(a + 1, 10)]


def test_attention_bounds_go_with_the_weights(spark):
    names = {"prefix_begin": 0, "prefix_end": 2, "suffix_begin": 0, "suffix_end": 0, "target_begin": 3, "target_end": 6, "first_query": 3}
    weights = spark.range(3).selectExpr("id as w", "explode(sequence(0, 1)) as l", "0 as h").selectExpr("*", "explode(sequence(3, 5)) as q").selectExpr("*", "explode(sequence(0, q)) as k").selectExpr("*", "1 / (q + 1) as a")
    one = lambda x: x.selectExpr("*", *(f"{v} as {k}" for k, v in names.items()), "array(2) as marks")
    beside, within = attention.profile(weights, one(spark.range(3).selectExpr("id as w")), 2), attention.profile(one(weights), None, 2)
    assert sorted(map(str, beside.collect())) == sorted(map(str, within.collect()))
    assert "Join" not in within._jdf.queryExecution().optimizedPlan().toString()


def test_window_rows_are_shuffled_a_few_times_whatever_is_sent(spark, sf, monkeypatch):
    want = sorted(map(str, QUERIES["mdl11_window_rows"](spark, sf).collect()))
    for module in (joins, measure):
        monkeypatch.setattr(module, "FEW", 20, raising=False)
    sent = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES["mdl11_window_rows"](spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    # the words of targets, their sums, rows by their last word, both sides of the join
    assert plan.count("Exchange hashpartitioning") <= 8
