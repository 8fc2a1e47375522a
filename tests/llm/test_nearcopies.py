"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from millrace.llm import common, nearcopies

rng = random.Random(8)
WORDS = [f"v{i}" for i in range(3000)]
LINE = [rng.choice(WORDS) for _ in range(12)]


def words(n):
    return [rng.choice(WORDS) for _ in range(n)]


def changed(base, times):
    out = list(base)
    for _ in range(times):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[i : i + 1] = words(1) if kind == 0 else [] if kind == 1 and len(out) > 1 else [*words(1), out[i]]
    return out


HOT = words(120)
TEXTS = [words(rng.choice([1, 3, 5, 9, 40, 200, 900])) for _ in range(60)]
TEXTS += [changed(x, max(1, len(x) // rng.choice([20, 40, 60, 90]))) for x in TEXTS for _ in range(3)]
TEXTS += [changed(HOT, rng.randint(0, 5)) for _ in range(60)]  # a large group, and documents at its edge
TEXTS += [LINE + words(rng.choice([2, 4, 30])) for _ in range(60)]  # unrelated, but for a common line
TEXTS = [" ".join(x) for x in TEXTS] + ["", " ", "One  two", "one two", None, None]


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """Rows (doc_id, text) that stay: the smallest id of each group, null last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i, (k, _) in enumerate(rows):
        out.setdefault(top(i), []).append((k is None, k or 0))
    return sorted(min(x) for x in out.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize(("small", "centres", "sample", "held", "bits"), [(64, 8, 10_000, 8192, 26), (2, 1, 10_000, 3, 15), (3, 2, 20, 50, 15)])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, small, centres, sample, held, bits):
    monkeypatch.setattr(nearcopies, "SCREEN", 1 << bits)
    rows = list(enumerate(TEXTS))
    got = [r.doc_id for r in nearcopies.one_each(frame(spark, rows), small, centres, sample, held).collect()]
    want = [k for _, k in plain(rows)]
    assert sorted(got) == want
    assert 60 < len(want) < len(rows) - 60


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(words(60)) for _ in range(2))
    rows = [(3, a), (5, a), (5, b), (None, b), (None, " ".join(words(40))), (7, None), (7, ""), (None, None)]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in nearcopies.one_each(frame(spark, rows)).collect())
    assert got == sorted([((False, 3), a), ((False, 5), b), ((True, 0), rows[4][1]), ((False, 7), "")])


def test_components_settle_whatever_the_order(spark):
    edges = [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63)) for _ in range(300)]
    edges += [(edges[i][0], edges[i + 1][1]) for i in range(0, 200, 2)] + [(7, x) for x in range(8, 400)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    for parts in (1, 7):
        rng.shuffle(edges)
        found = common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(parts))
        assert {r.node: r.root for r in found.collect()} == {i: top(i) for i in root if top(i) != i}


def test_stage_groups_by_five_word_shingles(spark):
    rows = list(enumerate(TEXTS))
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [k for _, k in plain(rows)]
    assert all(r.text == TEXTS[r.doc_id] for r in got)
