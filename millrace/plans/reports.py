"""Report tables (what a figure would show, as tidy rows), audits, and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators.joins import look_up_counted
from ..session import settle, table
from .measure import ARM, LM, T_OF_N, costed, facts, greedy, pooled, ranked_targets, table_model
from .registry import query


RATE = "avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END)"


def rates(f: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Share in percent with its interval inside [0, 100]."""
    g = f.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("k"))
    g = g.withColumn("rate", 100.0 * F.col("k") / F.col("n")).withColumn("ci", S.binomial_ci95(F.col("k"), F.col("n")))
    low, high = S.band(F.col("rate"), F.col("ci"), 0.0, 100.0)
    return g.select(*keys, "n", F.round("rate", 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("rpt1_target_ppl", f"SELECT {ARM} AS arm, l_linenumber AS rep, round(exp(avg(l_tax)), 6) AS ppl FROM lineitem GROUP BY ALL")
def rpt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("arm", "rep").agg(F.round(F.exp(F.avg("l_tax")), 6).alias("ppl"))


@query("rpt2_rpt19_metric_bands", f"""WITH p AS (SELECT {ARM} AS arm, l_linenumber AS rep, count(*) AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY ALL), t AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE {T_OF_N} * s / sqrt(n) END AS ci FROM p)
SELECT arm, rep, n, round(m, 6) AS mean, round(CASE WHEN m IS NOT NULL THEN greatest(m - ci, 0) END, 6) AS low, round(m + ci, 6) AS high FROM t""")
def rpt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts(spark, sf_dir).groupBy("arm", "rep").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    low, high = S.band(F.col("m"), S.ci95(F.col("s"), F.col("n")), 0.0, float("inf"))
    return p.select("arm", "rep", "n", F.round("m", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("rpt3_rpt8_rpt16_rates", f"""WITH p AS (SELECT {ARM} AS arm, l_linenumber AS rep, count(*) AS n, {RATE} AS r FROM lineitem GROUP BY ALL), c AS (SELECT *, 1.96 * sqrt(r * (1 - r) / n) * 100 AS ci FROM p)
SELECT arm, rep, n, round(100 * r, 6) AS rate, round(greatest(100 * r - ci, 0), 6) AS low, round(least(100 * r + ci, 100), 6) AS high FROM c""")
def rpt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(facts(spark, sf_dir), ["arm", "rep"], F.col("l_discount") >= 0.05)


@query("rpt5_density_bins", """WITH v AS (SELECT l_discount + l_tax AS x FROM lineitem), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v), b AS (SELECT lo - 0.06 * (hi - lo) AS a, (hi - lo) * 1.12 / 28 AS w FROM e)
SELECT least(CAST(floor((round(x, 6) - a) / w) AS BIGINT), 27) AS bin, count(*) AS n FROM v, b GROUP BY 1""")
def rpt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in 28 even bins over the values' range and 6 % more on either side."""
    v = facts(spark, sf_dir).select((F.col("l_discount") + F.col("l_tax")).alias("x"))
    e = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    e = e.select((F.col("lo") - 0.06 * (F.col("hi") - F.col("lo"))).alias("a"), ((F.col("hi") - F.col("lo")) * 1.12 / 28).alias("w"))
    at = F.least(F.floor((F.round("x", 6) - F.col("a")) / F.col("w")), F.lit(27))
    return v.crossJoin(F.broadcast(e)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@query("rpt6_rpt13_profile", f"""WITH p AS (SELECT l_linenumber AS split, {ARM} AS arm, count(*) AS n, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY ALL), o AS (SELECT split, sum(n) AS n, sum(n * m) / sum(n) AS mu FROM p GROUP BY 1),
q AS (SELECT p.split, any_value(o.n) AS n, any_value(mu) AS mu, sum((p.n - 1) * s * s + p.n * (m - mu) * (m - mu)) AS m2 FROM p JOIN o USING (split) GROUP BY 1)
SELECT split, n::BIGINT AS n, round(mu, 4) AS mean, round(CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) ELSE 0 END, 4) AS std FROM q""")
def rpt6(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = facts(spark, sf_dir).groupBy(F.col("rep").alias("split"), "arm").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("s"))
    return pooled(per, ["split"]).select("split", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("rpt7_rpt9_rpt17_matrix", f"""WITH p AS (SELECT {ARM} AS arm, l_linenumber AS rep, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL)
SELECT arm, {", ".join(f"max(CASE WHEN rep = {r} THEN v END) AS r{r}" for r in range(1, 8))} FROM p GROUP BY arm""")
def rpt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts(spark, sf_dir).groupBy("arm").pivot("rep", list(range(1, 8))).agg(F.round(F.avg("l_quantity"), 6))
    return p.select("arm", *(F.col(str(r)).alias(f"r{r}") for r in range(1, 8)))


@query("rpt10_rpt15_deltas", f"""WITH p AS (SELECT {ARM} AS arm, l_linenumber AS rep, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT rep, v AS v0 FROM p WHERE arm = 'NO')
SELECT arm, rep, round(v - v0, 6) AS delta FROM p JOIN b USING (rep) WHERE arm <> 'NO'""")
def rpt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts(spark, sf_dir).groupBy("arm", "rep").agg(F.avg("l_quantity").alias("v"))
    base = p.filter("arm = 'NO'").select("rep", F.col("v").alias("v0"))
    return p.filter("arm <> 'NO'").join(base, "rep").select("arm", "rep", F.round(F.col("v") - F.col("v0"), 6).alias("delta"))


def metric_value(metrics: Column, name: str) -> Column:
    """A task's metric by its name or, where that has no value, by the name with its filter."""
    return F.coalesce(F.try_element_at(metrics, F.lit(name)), F.try_element_at(metrics, F.lit(f"{name},none")))


def spoke(value: Column, perplexity: Column, inverse: bool = True) -> Column:
    """A task's length on a radar: perplexities turned so that more is better; an inverse of none above zero is null."""
    turned = F.when(value > 0, 1.0 / value) if inverse else -value
    return F.when(perplexity, turned).otherwise(value)


@query("rpt22_radar", f"""WITH p AS (SELECT {ARM} AS task, l_linenumber % 2 AS side, avg(l_discount) AS acc, avg(l_quantity) AS ppl FROM lineitem GROUP BY ALL)
SELECT task, side, round(CASE WHEN task = 'NO' THEN 1 / ppl ELSE acc END, 8) AS inverse, round(CASE WHEN task = 'NO' THEN -ppl ELSE acc END, 8) AS negative FROM p""")
def rpt22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spokes of two runs' tasks, from maps that name a metric with its filter or without."""
    g = facts(spark, sf_dir).groupBy(F.col("arm").alias("task"), (F.col("rep") % 2).alias("side")).agg(F.avg("l_discount").alias("acc"), F.avg("l_quantity").alias("ppl"))
    tail = F.when(F.col("side") == 0, "").otherwise(",none")
    g = g.withColumn("m", F.create_map(F.concat(F.lit("acc"), tail), "acc", F.concat(F.lit("word_perplexity"), tail), "ppl"))
    ppl = F.col("task") == "NO"
    value = F.when(ppl, metric_value(F.col("m"), "word_perplexity")).otherwise(metric_value(F.col("m"), "acc"))
    return g.select("task", "side", F.round(spoke(value, ppl), 8).alias("inverse"), F.round(spoke(value, ppl, False), 8).alias("negative"))


@query("jn10_pairs_by_repetition", """WITH p AS (SELECT l_linenumber AS rep, l_returnflag AS side, avg(l_tax) AS v FROM lineitem GROUP BY ALL)
SELECT a.rep, round(a.v, 8) AS fim, round(b.v, 8) AS ltr, round(a.v - b.v, 8) AS delta FROM p a JOIN p b ON a.rep = b.rep AND a.side = 'A' AND b.side = 'R'""")
def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts(spark, sf_dir).groupBy("rep").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_tax")).filter("A is not null and R is not null")
    return p.select("rep", F.round("A", 8).alias("fim"), F.round("R", 8).alias("ltr"), F.round(F.col("A") - F.col("R"), 8).alias("delta"))


@query("top11_insights", f"""WITH p AS (SELECT {ARM} AS arm, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1), b AS (SELECT q AS q0 FROM p WHERE arm = 'NO')
SELECT arg_max(arm, d) AS best, arg_min(CASE WHEN arm <> 'NO' THEN arm END, CASE WHEN arm <> 'NO' THEN abs(q - q0) END) AS closest FROM p, b""")
def top11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts(spark, sf_dir).groupBy("arm").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    base = p.filter("arm = 'NO'").select(F.col("q").alias("q0"))
    gap = F.when(F.col("arm") != "NO", F.abs(F.col("q") - F.col("q0")))
    return p.crossJoin(F.broadcast(base)).agg(F.max_by("arm", "d").alias("best"), F.min_by("arm", gap).alias("closest"))


@query("agg23_span_lengths", """SELECT list_sort(list_distinct(list(CAST(regexp_extract(k, 'first(\\d+)$', 1) AS INTEGER)))) AS spans FROM (SELECT 'p_z_first' || (20 + 10 * (event_id % 3)) AS k FROM events)""")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span lengths that the names of a summary's metrics tell."""
    k = table(spark, sf_dir, "events").select(F.concat(F.lit("p_z_first"), 20 + 10 * (F.col("event_id") % 3)).alias("k")).distinct().filter(F.col("k").rlike(r"first\d+$"))
    return k.agg(F.sort_array(F.collect_set(F.regexp_extract("k", r"first(\d+)$", 1).cast("int"))).alias("spans"))


@query("flt3_flt4_thresholds", """WITH k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 400000)
SELECT o_orderkey, o_totalprice FROM k WHERE r > CAST(floor(n * 0.3) AS BIGINT)""")
def flt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .corpus import threshold

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("ppl"))
    return threshold(rows, 1000, 400000, 0.3, "o_orderkey").withColumnRenamed("ppl", "o_totalprice")


@query("mdl2_pooling", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(v) AS a FROM e),
n AS (SELECT vec_id, list_transform(v, lambda x: (x - a) / sqrt(list_avg(list_transform(v, lambda y: (y - a) * (y - a))) + 1e-5))[1 : 16] AS v FROM m)
SELECT vec_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12), 6)) AS v FROM n""")
def mdl2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After pooling: layer norm, then the first dimensions, then unit length."""
    d = F.size("v").cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("a", total(F.col("v")) / d)
    e = e.withColumn("s", F.sqrt(total(F.transform("v", lambda y: (y - F.col("a")) * (y - F.col("a")))) / d + 1e-5))
    e = e.withColumn("v", F.slice(F.transform("v", lambda x: (x - F.col("a")) / F.col("s")), 1, 16)).withColumn("n", F.sqrt(total(F.transform("v", lambda y: y * y))))
    return e.select("vec_id", F.transform("v", lambda x: F.round(x / F.greatest("n", F.lit(1e-12)), 6)).alias("v"))


@query("mdl5_nll", f"""WITH {LM.replace("LEFT JOIN k USING (ctx, token) LEFT JOIN z USING (ctx)", "JOIN c USING (ctx, token) JOIN (SELECT ctx, ln(sum(exp(logit))) AS z FROM c GROUP BY ctx) USING (ctx)").replace("rank, logit - z", "logit - z")}
SELECT doc_id, CAST(target AS INTEGER) AS target, round(0.0 - sum(lp), 6) AS nll_sum, round(0.0 - avg(lp), 6) AS nll, round(exp(-avg(lp)), 6) AS ppl FROM x GROUP BY doc_id, target""")
def mdl5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher-forced cost of each target under the table model, over all of a context's continuations."""
    g, logits = table_model(spark, sf_dir)
    logits = settle(logits)
    x = costed(g, logits)
    nll = F.avg(F.col("z") - F.col("logit"))
    return x.groupBy("doc_id", "target").agg(F.round(F.sum(F.col("z") - F.col("logit")), 6).alias("nll_sum"), F.round(nll, 6).alias("nll"), F.round(S.safe_exp(nll), 6).alias("ppl"))


@query("mdl6_greedy_decode", f"""WITH RECURSIVE {LM}, best AS (SELECT ctx, token FROM k WHERE rank = 1),
d AS (SELECT doc_id, target, 0 AS step, min(ctx) AS last, CAST([] AS VARCHAR[]) AS words FROM q WHERE i = target GROUP BY doc_id, target UNION ALL SELECT doc_id, target, step + 1, token, list_append(words, token) FROM d JOIN best ON ctx = last WHERE step < 5),
l AS (SELECT doc_id, target, words, row_number() OVER (PARTITION BY doc_id, target ORDER BY step DESC) AS z FROM d) SELECT doc_id, CAST(target AS INTEGER) AS target, array_to_string(words, ' ') AS decoded FROM l WHERE z = 1""")
def mdl6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five greedy steps from each target's context: each looks up the best continuation of the last word (first in order wins ties).
    Of rows that share an id and a target the least context counts."""
    g, logits = table_model(spark, sf_dir)
    best = settle(greedy(logits))
    d = g.filter("pos = target").groupBy("doc_id", "target").agg(F.min("ctx").alias("last")).select("doc_id", "target", "last", F.array().cast("array<string>").alias("words"))
    for _ in range(5):
        d = look_up_counted(d, best, ["last"], ["doc_id", "target"], "n", "left").select("doc_id", "target", F.col("next").alias("last"), F.when(F.col("next").isNull(), F.col("words")).otherwise(F.concat("words", F.array("next"))).alias("words"))
    return d.select("doc_id", "target", F.array_join("words", " ").alias("decoded"))


@query("mdl7_token_audit", f"""WITH {LM}, t AS (SELECT ctx, token AS top FROM k WHERE rank = 1)
SELECT q.doc_id, CAST(target AS INTEGER) AS target, CAST(i + 1 AS INTEGER) AS pos, q.token, CAST(k.rank AS INTEGER) AS rank, round(coalesce(exp(k.logit - z.z), 0) + 1e-9, 6) AS p, t.top FROM q LEFT JOIN k USING (ctx, token) LEFT JOIN z USING (ctx) LEFT JOIN t USING (ctx)""".replace("CAST(i + 1 AS INTEGER)", "CAST(i AS INTEGER) + 1"))
def mdl7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and renormalised probability of each target word among the forty best, and the best one."""
    g, logits = table_model(spark, sf_dir)
    logits = settle(logits)
    q = ranked_targets(g, logits, 40)
    q = look_up_counted(q, greedy(logits).toDF("ctx", "top", "n"), ["ctx"], ["doc_id", "pos"], "n", "left")
    return q.select("doc_id", "target", (F.col("pos") + 1).alias("pos"), "token", "rank", F.round(F.coalesce(F.exp("lp"), F.lit(0.0)) + 1e-9, 6).alias("p"), "top")


@query("str12_win10_word_groups", """WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text <> ''), c AS (SELECT doc_id, r, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM d),
g AS (SELECT *, sum(CASE WHEN i > 1 AND ch IN (' ', chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS word FROM c)
SELECT doc_id, CAST(word AS BIGINT) AS word, trim(string_agg(ch, '' ORDER BY i), ' ' || chr(10)) AS text, CAST(min(i) - 1 AS INTEGER) AS begin_at, CAST(max(i) AS INTEGER) AS end_at FROM g GROUP BY doc_id, r, word""")
def str12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces (here characters) that start with white space begin a word: cut at once, a row a word, places by running lengths."""
    w = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    w = w.select("doc_id", "row", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(?:^.|[ \n])[^ \n]*"), F.lit(0))).alias("word", "t"))
    end = F.sum(F.length("t")).over(Window.partitionBy("row").orderBy("word")).cast("int")
    return w.withColumn("end_at", end).select("doc_id", F.col("word").cast("long").alias("word"), F.regexp_replace("t", "^[ \n]+|[ \n]+$", "").alias("text"), (F.col("end_at") - F.length("t")).alias("begin_at"), "end_at")
