"""Product codes against plain Lloyd rounds, and the share of parts that heaps leave alone."""

import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import codes


def plain(rows, parts, entries, rounds):
    """Rows (vec_id, label, vector) -> (vec_id, label, code, error) in order, and the codebooks."""
    ok = [r for r in rows if r[2] and len(r[2]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[2])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    ok = [r for r in ok if len(r[2]) == len(ok[0][2])]
    cut = [[max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in r[2]] for r in ok]
    w = len(cut[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in cut]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda i: (gap(x, book[i]), i))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p]), []).append(v[p])
            books[p] = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    out = [(r[0], r[1], "".join(f"{i:02x}" for i in c), sum(gap(v[p], books[p][c[p]]) for p in range(parts))) for r, v, c in zip(ok, cut, found, strict=True)]
    return out, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k) for i, k, v in rows], "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as v", "1 as code").repartition(3)


def vectors(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [(i, rng.choice([None, 1, 2]), [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centres)]) for i in range(n)]
    return rows + [(3, 1, rows[-1][2]), (None, 2, rows[0][2]), (3, 1, rows[n // 2][2]), (n, None, [0.0] * dim), (n + 1, 1, [0.0] * dim)]


BAD = [(-5, 1, None), (-4, 1, []), (-3, 1, [1.0, None] * 8), (-2, 1, [float("nan")] * 16), (900, 1, [float("inf")] * 16), (901, 1, [1.0, 2.0]), (902, 1, [1.0] * 32)]


@pytest.mark.parametrize(("n", "dim", "parts", "entries", "rounds"), [(300, 16, 16, 8, 2), (300, 16, 4, 16, 4), (40, 48, 16, 64, 2), (3, 16, 16, 64, 2), (0, 16, 16, 64, 2)])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, n, dim, parts, entries, rounds):
    monkeypatch.setattr(codes, "ROWS", 70)
    rows = [*(vectors(n, dim, n + parts) if n else [(7, 2, [0.5] * dim)]), *(BAD if dim == 16 else [])]
    want, books = plain(rows, parts, entries, rounds)
    got, made, _ = codes.compress(frame(spark, rows), parts, entries, rounds)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert made.tolist() == books


def test_large_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, 1, [rng.choice([1e30, -1e30, 1e5, 3.1, -2e4]) * rng.random() for _ in range(32)]) for i in range(60)]
    rows = [(i, k, [float(np.float32(x)) for x in v]) for i, k, v in rows]
    want, books = plain(rows, 16, 8, 2)
    got, made, _ = codes.compress(frame(spark, rows), 16, 8, 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert made.tolist() == books


def test_heaps_leave_most_parts_alone(spark):
    rows = vectors(2000, 32, 4)
    blocks = codes.compress(frame(spark, rows), 16, 8, 6)[2]
    scanned = [b.selectExpr("sum(scanned)").first()[0] for b in blocks]
    assert scanned[0] == 16 * len(rows)
    assert scanned[-1] < scanned[0] / 3


def test_query_columns(spark, tmp_path):
    rows = vectors(100, 16, 2)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = plain(rows, 16, 64, 2)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    total = {k: sum(e for _, x, _, e in want if x == k) for k in (None, 1, 2)}
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.op12_codes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, c, e, total[k], digest) for i, k, c, e in want), key=str)
