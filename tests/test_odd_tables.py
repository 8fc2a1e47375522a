"""Every plan over tables with nulls, ties, repeated rows, empty and long texts, constant vectors and clashing columns, and over empty tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CLASH = ["t", "n", "rank", "id", "word", "key", "rep", "arm", "target", "pos", "sid", "block"]
#: Plans that tell a row, or the configuration, whatever the tables hold.
ALWAYS = {"agg17_closure", "agg23_span_lengths", "agg2_bal7_snk8_shards", "bal4_agg11_bucket_stats", "flt8_report_arms", "gen5_counters", "src1_snk2_agg22_texts", "snk5_ordered_csv", "ded3d_statistics", "gen8_tasks", "jn2_bijection", "jn8_grid_difference", "mth6_t_table", "top11_insights"}


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    odd, empty = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "empty"))
    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet").limit(12)
        nulls = df.limit(2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
        holes = df.limit(4).withColumns({c: F.when(F.col(df.columns[0]) % 2 == 0, F.col(c)) for c in df.columns[1:]})
        rows = df.unionByName(df.limit(3)).unionByName(holes).unionByName(nulls)
        if t == "documents":
            rows = rows.unionByName(df.limit(2).withColumn("text", F.lit(""))).unionByName(df.limit(1).withColumn("text", F.lit("word and more " * 1500)))
        if t == "embeddings":
            rows = rows.unionByName(df.limit(2).withColumn("embedding", F.array(*[F.lit(0.5).cast("float")] * 64)))
        rows = rows.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).coalesce(2)
        rows.write.parquet(f"{odd}/{t}.parquet")
        rows.limit(0).write.parquet(f"{empty}/{t}.parquet")
    return odd, empty


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, folders, name):
    odd, empty = folders
    if name not in ORACLES:  # the others are run below
        QUERIES[name](spark, odd).write.format("noop").mode("overwrite").save()
    n = QUERIES[name](spark, empty).count()
    assert n == 0 or name in ALWAYS


@pytest.fixture(scope="module")
def con(folders):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folders[0]}/{t}.parquet/*.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_values_on_odd_tables(spark, folders, con, name):
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, folders[0])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows
