"""The Jaccard join against all pairs, with regions that recurse and blocks at their end."""

import random

import numpy as np
import pytest

from millrace.llm import jaccard

rng = random.Random(3)
WORDS = [f"v{i}" for i in range(2500)]
LINE = [rng.choice(WORDS) for _ in range(15)]


def words(n):
    return [rng.choice(WORDS) for _ in range(n)]


def changed(base, times):
    out = list(base)
    for _ in range(times):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[i : i + 1] = words(1) if kind == 0 else [] if kind == 1 and len(out) > 1 else [*words(1), out[i]]
    return out


HOT = words(150)
TEXTS = [words(rng.choice([1, 3, 4, 6, 40, 200, 700])) for _ in range(60)]
TEXTS += [changed(x, max(1, len(x) // rng.choice([25, 45, 60, 90]))) for x in TEXTS for _ in range(3)]
TEXTS += [changed(HOT, rng.randint(0, 6)) for _ in range(70)]  # a large group, and texts at its edge
TEXTS += [LINE + words(rng.choice([2, 4, 30])) for _ in range(60)]  # unrelated, but for a common line
TEXTS += [HOT[i : i + 100] for i in range(0, 50, 2)]  # a chain
TEXTS = [" ".join(x) for x in TEXTS] + ["", " \t", "One  two", "one\x0btwo", "ONE two", None, None, "é É", "É É", "é é"]


def plain(rows):
    """(doc_id, n_shingles, component_id) over all pairs."""

    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
        w = [x for x in w if x]
        return {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= 85 * len(x | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = top(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return [(k, len(sets[i]), least[top(i)]) for i, (k, _) in enumerate(rows)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize(("pivots", "leaf", "rounds", "held", "sample"), [(4, 256, 2, 8192, 10_000), (2, 2, 2, 3, 10_000), (3, 3, 4, 8, 0)])
def test_components_are_those_of_all_pairs(spark, pivots, leaf, rounds, held, sample):
    rows = [(len(TEXTS) - i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[70]), (None, "nobody else's text is this"), (5, TEXTS[3]), (5, TEXTS[200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sid", "'x' as h1", "2 as n").repartition(5)
    got = jaccard.join(docs, sample, pivots=pivots, leaf=leaf, rounds=rounds, held=held)
    want = plain(rows)
    assert ordered(got.collect()) == ordered(want)
    assert 60 < len({c for _, _, c in want}) < len(rows) - 60


def test_shared_rows_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(t, rng.randrange(1 << 40), t % 7) for t in range(40) for _ in range(rng.choice([1, 1, 2, 3, 7]))] + [(99, 5, 1), (99, 6, 1), (98, 5, 1), (98, 6, 1)]
        again = [*rows, *(r for r in rows for _ in range(rng.choice([0, 0, 5])))]  # copies that several tasks told
        got = jaccard.shared_rare(spark.createDataFrame(again, "token long, sid long, n int")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sizes = {t: sum(x == t for x, _, _ in rows) for t, _, _ in rows}
    assert sorted((r.token, r.sid, r.n) for r in got) == sorted(x for x in rows if sizes[x[0]] > 1)


def test_near_pairs_of_a_block(monkeypatch):
    """No pair within reach is lost, whatever the sizes; pairs of one root are not told."""
    monkeypatch.setattr(jaccard, "AT_ONCE", 300)
    base = [np.unique(np.array([rng.getrandbits(63) for _ in range(n)], np.int64)) for n in (1, 2, 5, 40, 64, 65, 200, 500, 520)]
    sets = [x for b in base for x in (b, b[: max(1, len(b) * 95 // 100)], np.unique(np.concatenate([b, np.array([rng.getrandbits(63) for _ in range(len(b) // 12)], np.int64)])), b[: max(1, len(b) // 2)])]
    rows = [(i, len(x), i % 7, jaccard.parities(x)) for i, x in enumerate(sets)]
    side = lambda at: tuple(np.array([rows[i][c] for i in at]) if c < 3 else [rows[i][3] for i in at] for c in range(4))
    left, right = list(range(0, len(rows), 2)), list(range(len(rows)))
    a, b = jaccard.near_pairs(side(left), side(right), jaccard.NEAR)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    gap = lambda x, y: 1 - len({*x.tolist()} & {*y.tolist()}) / len({*x.tolist()} | {*y.tolist()})
    want = {(min(i, j), max(i, j)) for i in left for j in right if i % 7 != j % 7 and gap(sets[i], sets[j]) <= jaccard.NEAR}
    assert want <= got and len(want) > 10 and len(got) < 60 + len(want)
    assert all(i % 7 != j % 7 for i, j in got)


def test_cells_hold_every_near_pair():
    """The windows' rule alone, on random sets: a near pair is in a cell where one of the two is at home."""
    base = [set(rng.sample(range(400), 60)) for _ in range(6)]
    sets = [x for b in base for x in [b] + [{*rng.sample(sorted(b), 60 - k), *rng.sample(range(400), k)} for k in (2, 4, 8, 16, 24, 30) for _ in range(4)]]
    gap = lambda x, y: 1 - len(x & y) / len(x | y)
    for _ in range(20):
        pivots = rng.sample(sets, 3)
        homes, visited = [], []
        for x in sets:
            d = np.array([gap(x, p) for p in pivots])
            near = d.min()
            homes.append(int(d.argmin()) + 1 if near <= jaccard.CORE else 0)
            visited.append({i + 1 for i in range(3) if d[i] <= min(near + 2 * jaccard.NEAR, jaccard.CORE + jaccard.NEAR) + jaccard.EPS} | ({0} if near > jaccard.CORE - jaccard.NEAR - jaccard.EPS else set()))
        for i, x in enumerate(sets):
            for j in range(i):
                if gap(x, sets[j]) <= jaccard.NEAR + 1e-12:
                    assert homes[i] in visited[j] and homes[j] in visited[i]
