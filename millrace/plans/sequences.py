"""Queries on training sequences, the token index, and the measurement suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import stats as S
from ..functions import text as T
from ..functions.rng import split_draws
from ..operators import layout as L
from ..operators import suite as U
from ..operators import windows as W
from ..session import shared_dir, table
from .corpus import CODES, codes, docs
from .registry import query


@query("xf1_even_fim", f"""WITH {CODES}, k AS (SELECT doc_id, t[1 : 16380] AS t FROM c WHERE len(t) >= 50), p AS (SELECT doc_id, t, len(t) // 3 AS l, 2 * (len(t) // 3) AS m FROM k)
SELECT doc_id, list_concat([128002], t[1 : l], [128005], t[m + 1 : len(t)], [128003], t[l + 1 : m], [128001]) AS laid_out FROM p""")
def xf1_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes(spark, sf_dir).withColumnRenamed("t", "tokens")
    return L.lay_out(rows, F.col("doc_id").cast("string"), mode="fim", cap=16380, even=True).select("doc_id", "laid_out")


@query("xf1_hybrid")
def xf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half with the middle last, by coin; cuts drawn by key. Held against Python's generator in tests."""
    rows = codes(spark, sf_dir).withColumnRenamed("t", "tokens")
    return L.lay_out(rows, F.concat(F.lit("bin:"), F.col("doc_id")), cap=16380).select("doc_id", "is_fim", F.size("laid_out").alias("n"), F.sha2(F.array_join("laid_out", ","), 256).alias("digest"))


@query("arr7_mdl9_random_splits")
def arr7(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return docs(spark, sf_dir).select("doc_id", n.alias("n"), split_draws(F.lit("42"), F.concat(F.lit("bin:"), F.col("doc_id")), n).alias("d")).select("doc_id", "n", "d.*")


@query("agg18_fim_annotation", """WITH r AS (SELECT doc_id, length(text) AS n, unnest(range(0, 3)) AS rep FROM documents WHERE length(text) >= 300), s AS (SELECT doc_id, n // 3 + rep * 10 AS l, 2 * (n // 3) + rep * 10 AS m, n // 2 AS a, n // 2 + 50 AS b FROM r),
o AS (SELECT doc_id, greatest(0, least(m, b) - greatest(l, a)) / 50 AS f, a >= l AND b <= m AS w FROM s)
SELECT doc_id, count(*) AS n_replicas, sum(w::INT)::BIGINT AS within, bool_or(w) AS ever, round(avg(f), 6) AS mean_fraction, round(max(f), 6) AS max_fraction FROM o GROUP BY 1""")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the middles of a document's replicas meet a target: overlap, containment, over replicas."""
    n = F.length("text")
    r = docs(spark, sf_dir).filter(n >= 300).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rep"))
    third = F.floor(F.col("n") / 3)
    l, m, a = third + F.col("rep") * 10, 2 * third + F.col("rep") * 10, F.floor(F.col("n") / 2)  # noqa: E741
    o = r.select("doc_id", (S.overlap(l, m, a, a + 50) / 50).alias("f"), ((a >= l) & (a + 50 <= m)).alias("w"))
    return o.groupBy("doc_id").agg(
        F.count("*").alias("n_replicas"), F.sum(F.col("w").cast("int")).alias("within"), F.bool_or("w").alias("ever"), F.round(F.avg("f"), 6).alias("mean_fraction"), F.round(F.max("f"), 6).alias("max_fraction")
    )


@query("src16_ded1_replica_rows", """SELECT sha256(text) AS digest, list_sort(list(doc_id))[1] AS first_id, count(*) AS n_replicas, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY text""")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one text, told by its digest, so that texts are not shuffled."""
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_replicas"), F.sum("n_chars").alias("chars"))


@query("gen8_tasks", """WITH s AS (SELECT unnest([0, 1, 5, 10, 20, 40, 60, 80, 100]) AS p), a AS (
SELECT m || '_ltr_p100_m32' AS arm_id, 'ltr' AS experiment, 100 AS prefix_length, 32 AS middle_length, 0 AS suffix_length FROM (SELECT unnest(['no_fim', 'fim_v2', 'fineweb_only']) AS m)
UNION ALL SELECT 'fim_v2_prefix_rescue_p' || p || '_s' || (100 - p) || '_' || i, 'prefix_rescue', p, 20, 100 - p FROM s, (SELECT unnest(['full', 'suffix_distractor', 'prefix_distractor', 'both_distractor']) AS i)
UNION ALL SELECT 'attn_' || m || '_ltr_p100_m20', 'attention_ltr', 100, 20, 0 FROM (SELECT unnest(['no_fim', 'fim_v2']) AS m)
UNION ALL SELECT 'attn_fim_v2_native_p' || p || '_s' || (100 - p), 'attention_native_geometry', p, 20, 100 - p FROM s WHERE p NOT IN (1, 5, 10))
SELECT arm_id, experiment, prefix_length, middle_length, suffix_length, r AS repetition FROM a, (SELECT unnest([1, 2, 3, 4, 8, 16, 24, 32, 48, 64, 96, 128]) AS r)""")
def gen8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.tasks(spark).select("arm_id", "experiment", "prefix_length", "middle_length", "suffix_length", "repetition")


@query("flt8_report_arms", """SELECT 'fim_v2_prefix_rescue_p' || p || '_s' || (100 - p) || '_full' AS arm_id, p AS prefix_length FROM (SELECT unnest([0, 1, 5, 10, 20, 40, 60, 80, 100]) AS p)""")
def flt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.report_arms(U.arm_table(spark), "native_geometry").select("arm_id", "prefix_length")


@query("flt10_pending", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber = 3 AND l_orderkey = o_orderkey)")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that has no finished line yet."""
    done = table(spark, sf_dir, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("num_windows"), F.lit(1).alias("num_selected_windows"))
    return U.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("str6_contributors", r"""WITH p AS (SELECT c_custkey, c_name || ', 18' || (c_custkey % 90 + 10) || '-1950 [Editor]; ' || c_mktsegment || ', Anna' AS a FROM customer)
SELECT c_custkey, regexp_extract(a, '; (.*)$', 1) AS author FROM p""")
def str6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contributor is an editor, so the second one is the author."""
    a = F.expr("concat(c_name, ', 18', c_custkey % 90 + 10, '-1950 [Editor]; ', c_mktsegment, ', Anna')")
    return table(spark, sf_dir, "customer").select("c_custkey", T.primary_author(T.contributors(a)).alias("author"))


@query("mth1_mth4_guards", """SELECT event_id, CASE WHEN value * 2 < 50 THEN round(log10(exp(value * 2)), 9) ELSE 'inf'::DOUBLE END AS log10_ppl, round(CASE WHEN value IS NULL THEN 'nan'::DOUBLE WHEN -value * 100 < -745 THEN 0 ELSE exp(-value * 100) END, 9) AS p,
round(CASE WHEN value > 0 THEN log10(value) ELSE 'nan'::DOUBLE END, 6) AS l, round(CASE WHEN value IS NULL THEN 'nan'::DOUBLE ELSE log10(greatest(value, 1e-8)) END, 6) AS floored FROM events""")
def mth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, inf, exp, log10 = F.col("value"), S.INF, S.libm_exp, S.libm_log10
    ppl = S.safe_exp(v * 2, exp=exp)

    def at(c: F.Column, n: int) -> F.Column:
        """The twin scales, rounds and scales back, and keeps a zero's sign; a decimal rounding tells near halves otherwise."""
        whole = F.round(c * 10.0**n)
        return F.when(F.abs(c) * 10.0**n < inf, F.when(whole == 0, c * 0.0).otherwise(whole / 10.0**n)).otherwise(c)

    low = log10(F.when(v * 2 < -700, exp(v * 2)).otherwise(ppl))
    return table(spark, sf_dir, "events").select(
        "event_id", F.when((ppl < inf) | (v == -inf), at(low, 9)).otherwise(inf).alias("log10_ppl"), at(F.when(v == -inf, inf).otherwise(S.prob_from_log(-v * 100, exp)), 9).alias("p"),
        at(F.when(v == inf, inf).otherwise(S.log10_or_nan(v, log10)), 6).alias("l"), at(F.when(v == inf, inf).when(v == -inf, -8.0).otherwise(S.log10_floored(v, 1e-8, log10)), 6).alias("floored"),
    )


@query("mth6_t_table", """SELECT r.n, CASE WHEN r.n - 1 >= 121 THEN 1.96 WHEN r.n - 1 >= 120 THEN 1.98 WHEN r.n - 1 >= 60 THEN 2.0 WHEN r.n - 1 >= 40 THEN 2.021 WHEN r.n - 1 >= 30 THEN 2.042 WHEN r.n - 1 >= 24 THEN 2.064 ELSE 2.086 END::DOUBLE AS t FROM range(21, 200) r(n)""")
def mth6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(21, 200).withColumnRenamed("id", "n").select("n", S.t95(F.col("n")).alias("t"))


@query("mth10_mth12_numbers", """SELECT try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AS known, count(*) AS n FROM events GROUP BY 1""")
def mth10(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = S.number(F.get_json_object("props", "$.k")).isNotNull()
    return table(spark, sf_dir, "events").groupBy(known.alias("known")).agg(F.count("*").alias("n"))


@query("arr16_prompts", f"""WITH {CODES} , s AS (SELECT doc_id, t, unnest(range(10, len(t) - 20 + 1, 120)) AS a FROM c WHERE len(t) >= 30)
SELECT doc_id, CAST(a AS INTEGER) AS target_start, CASE WHEN doc_id % 2 = 0 THEN list_concat([128002], t[a - 9 : a], [128005], t[a + 11 : a + 20], [128003]) ELSE t[a - 9 : a] END AS prompt FROM s""")
def arr16(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    prompts = F.transform(W.starts(F.size(t), 20, 120, 10), lambda a: F.struct(a.alias("target_start"), A.prompt(A.cut(t, a - 10, a), A.cut(t, a + 10, a + 20), F.col("doc_id") % 2 == 0).alias("prompt")))
    return codes(spark, sf_dir).filter(F.size("t") >= 30).select("doc_id", F.explode(prompts).alias("p")).select("doc_id", "p.target_start", "p.prompt")


@query("snk3_src5_token_index", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ''), lambda x: unicode(x)) END AS t FROM d)
SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) - 1 AS seq_id, len(t)::BIGINT AS n, coalesce(list_sum(t), 0)::BIGINT AS total FROM c""")
def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a token index and read back. The index holds one file a run, so the path must be one that executors share."""
    import os
    import uuid

    from ..sources import tokenindex
    from .corpus import global_rank

    tokenindex.register(spark)
    prefix = os.path.join(shared_dir(spark).removeprefix("file://"), f"index-{uuid.uuid4().hex}", "docs")
    rows = global_rank(docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), [F.col("doc_id").asc(), F.col("text").asc()], "doc_id").select((F.col("rank") - 1).alias("seq_id"), "doc_id", T.code_points(F.col("text")).alias("tokens"), F.lit(None).cast("byte").alias("mode"))
    rows.repartitionByRange("seq_id").sortWithinPartitions("seq_id").write.format("tokenindex").mode("append").save(prefix)
    back = spark.read.format("tokenindex").load(prefix)
    return back.select("seq_id", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
