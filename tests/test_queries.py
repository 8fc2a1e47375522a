"""Every query with a SQL twin against DuckDB; the others against plain versions."""

import duckdb
import pytest

from millrace.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, con, name):
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows


def test_entry_file():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_lcs(spark, sf):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    docs = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = 0
    for r in QUERIES["arr11_arr12_rouge"](spark, sf).collect():
        a, b = docs[r.doc_id], docs[r.doc_id + 1]
        if len(a) * len(b) > 200_000:
            continue  # the plain version is slow
        n, some = lcs(a, b), some + 1
        assert (r.lcs, r.rouge_l) == (n, round(2 * n / (len(a) + len(b)), 6))
    assert some > 100


def test_representatives(spark):
    import random

    from millrace.operators.similarity import representatives

    rng = random.Random(1)
    for n in (1, 12, 30):
        nodes = [(i, float(rng.randint(0, 5))) for i in range(n)]
        edges = [(a, b, round(rng.random(), 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.15]
        sim = {(a, b): s for a, b, s in edges} | {(b, a): s for a, b, s in edges}
        kept, want = [], {}
        for i, score in sorted(nodes, key=lambda x: (-x[1], x[0])):
            near = [(sim[i, k], dict(nodes)[k], -k) for k in kept if (i, k) in sim]
            if near:
                want[i] = (-max(near)[2], max(near)[0])
            else:
                kept.append(i)
                want[i] = (i, None)
        got = representatives(spark.createDataFrame(nodes, "id long, score double"), spark.createDataFrame(edges, "a long, b long, sim double"))
        assert {r.id: (r.representative, r.sim) for r in got.collect()} == want


def test_equal_means(spark):
    from millrace.operators.buckets import bucket_stats, equal_means

    rows = spark.createDataFrame([(i, s) for i, s in enumerate([10.0, 9.0, 8.0, 7.0, 6.0, 5.0])], "id long, score double")
    dealt = equal_means(rows, 3, 2)
    assert {frozenset(r.id for r in dealt.collect() if r.bucket == b) for b in range(3)} == {frozenset(x) for x in ((0, 5), (1, 4), (2, 3))}
    assert bucket_stats(dealt).first().spread == 0


def test_components_are_orthogonal(spark, sf):
    import numpy as np

    got = QUERIES["mdl3_principal_components"](spark, sf).toPandas()
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], float)
    variance = np.linalg.eigvalsh(np.cov(v.T))
    assert np.allclose([got.pca_y.var(), got.pca_x.var()], [variance[-1], variance[-2]])


def test_guards_round_as_their_sql(spark, tmp_path):
    d = duckdb.connect()
    d.execute(f"COPY (SELECT i AS event_id, CASE WHEN i < 300000 THEN hash(i) / 18446744073709551616.0 * 25 ELSE (ARRAY['inf'::DOUBLE, '-inf'::DOUBLE, -466.08, 0, NULL, 1e300])[i - 299999] END AS value FROM range(0, 300006) r(i)) TO '{tmp_path}/events.parquet'")
    d.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    QUERIES["mth1_mth4_guards"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert d.execute(f"SELECT count(*) FROM ((FROM ({ORACLES['mth1_mth4_guards']})) EXCEPT ALL FROM '{tmp_path}/out/*.parquet')").fetchone() == (0,)


def test_guards_have_the_last_bits_and_zero_signs_of_their_sql(spark, tmp_path):
    d = duckdb.connect()
    d.execute(f"COPY (SELECT i AS event_id, CASE WHEN i < 20000 THEN hash(i) / 18446744073709551616.0 * -7 WHEN i < 20100 THEN 1 - (i - 19999) * 4e-9 ELSE (i - 20150) * 1e-12 END AS value FROM range(0, 20300) r(i)) TO '{tmp_path}/events.parquet'")
    d.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    QUERIES["mth1_mth4_guards"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    shown = "SELECT event_id, CAST(log10_ppl AS VARCHAR), CAST(p AS VARCHAR), CAST(l AS VARCHAR), CAST(floored AS VARCHAR) FROM"  # tells 0.0 from -0.0
    want, got = (d.execute(f"{shown} {x} ORDER BY event_id").fetchall() for x in (f"({ORACLES['mth1_mth4_guards']})", f"'{tmp_path}/out/*.parquet'"))
    assert [(a, b) for a, b in zip(want, got, strict=True) if a != b] == []
