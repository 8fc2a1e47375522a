"""Queries on the probe: its windows, contexts, examples, shards, and the report tables of attention and overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import stats as S
from ..functions import text as T
from ..operators import probe as P
from ..operators import suite as U
from ..operators.joins import look_up_apart, look_up_counted
from ..session import settle, shared_dir, small_batches, table
from .corpus import WORDS, docs, global_sums, tokens
from .measure import ARM, ATT, CUSTOMERS, LM, SCORE, T_OF_N, continued, facts, ranked_targets, table_model, topk_scores, windows_and_costs
from .registry import query

G = P.Geometry(prefix=20, middle=10, suffix=20, stride=15)
#: Of documents that share an id the one of most words; null ids have none.
ONE_EACH = WORDS.replace("w AS (", "w0 AS (") + ", w AS (SELECT doc_id, t FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY len(t) DESC NULLS LAST, t DESC) AS r FROM w0 WHERE doc_id IS NOT NULL) WHERE r = 1)"
#: Matched context needs 40 words on either side of ten; a window is 50 long, so each fourth candidate is selected.
WINDOWS = f"""{WORDS}, c AS (SELECT doc_id, t, (len(t) - 90) // 15 + 1 AS m, unnest(range(0, (len(t) - 90) // 15 + 1, 4)) AS i FROM w WHERE len(t) >= 90),
s AS (SELECT doc_id, t, i AS window_index, 40 + 15 * i AS target_start, m FROM c)"""
WINDOWS_OF_ONE = WINDOWS.replace(WORDS, ONE_EACH)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).withColumnRenamed("doc_id", "id")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.windows(P.candidates(samples(spark, sf_dir).select("id", F.size("t").alias("size")), G))


@query("gen5_win5_windows", f"WITH {WINDOWS} SELECT row_number() OVER (ORDER BY doc_id, window_index) - 1 AS global_window_id, doc_id, CAST(window_index AS INTEGER) AS window_index, CAST(target_start AS INTEGER) AS target_start, CAST(m AS INTEGER) AS candidate_window_count FROM s")
def gen5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = global_sums(selected(spark, sf_dir), [F.col("id").asc(), F.col("window_index").asc()], global_window_id=F.lit(1))
    return rows.withColumnRenamed("id", "doc_id")


@query("gen5_counters", f"""WITH {WORDS}, k AS (SELECT greatest((len(t) - 90) // 15 + 1, 0) AS m FROM w), j AS (SELECT CASE WHEN m > 0 THEN m ELSE 0 END AS m, (CASE WHEN m > 0 THEN m ELSE 0 END + 3) // 4 AS c FROM k)
SELECT count(*) AS num_excerpts, count(*) FILTER (c > 0) AS num_excerpts_with_windows, count(*) FILTER (c = 0) AS num_short_excerpts, sum(m)::BIGINT AS num_candidate_windows, sum(c)::BIGINT AS num_selected_windows FROM j""".replace("greatest((len(t) - 90) // 15 + 1, 0)", "CASE WHEN len(t) >= 90 THEN (len(t) - 90) // 15 + 1 ELSE 0 END"))
def gen5_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counters(P.candidates(samples(spark, sf_dir).select("id", F.size("t").alias("size")), G))


@query("gen4b_stored_windows", f"WITH {WINDOWS_OF_ONE} SELECT doc_id, CAST(target_start AS INTEGER) AS target_start, array_to_string(t[target_start - 19 : target_start], ' ') AS prefix, array_to_string(t[target_start + 1 : target_start + 10], ' ') AS middle FROM s")
def gen4b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows known by key and place alone get their words back."""
    rows = P.cut_out(selected(spark, sf_dir).select("id", "target_start"), samples(spark, sf_dir), G)
    return rows.select(F.col("id").alias("doc_id"), "target_start", *(F.array_join(c, " ").alias(c) for c in ("prefix", "middle")))


@query("jn7_context_swap", f"""WITH {WINDOWS_OF_ONE}, o AS (SELECT doc_id, len(t) AS size, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM w),
p AS (SELECT s.doc_id, target_start AS a, n, (('0x' || substr(sha256('0::' || s.doc_id || '::' || target_start || '::distractor'), 1, 16))::UBIGINT % n)::BIGINT AS start FROM s, (SELECT count(*)::UBIGINT AS n FROM w)),
d AS (SELECT p.doc_id, a, arg_min(o.doc_id, (o.pos - start + p.n::BIGINT) % p.n::BIGINT) AS other FROM p LEFT JOIN o ON o.doc_id <> p.doc_id AND o.size >= a + 30 GROUP BY p.doc_id, a),
x AS (SELECT d.*, y.t, w.t AS u FROM d JOIN w y ON y.doc_id = d.doc_id LEFT JOIN w ON w.doc_id = other), i AS (SELECT unnest(['full', 'suffix_distractor', 'prefix_distractor', 'both_distractor']) AS context_intervention)
SELECT doc_id, CAST(a AS INTEGER) AS target_start, context_intervention, CASE WHEN context_intervention <> 'full' THEN other END AS distractor,
array_to_string(CASE WHEN context_intervention IN ('prefix_distractor', 'both_distractor') THEN u ELSE t END[a - 19 : a], ' ') AS prefix,
array_to_string(CASE WHEN context_intervention IN ('suffix_distractor', 'both_distractor') THEN u ELSE t END[a + 11 : a + 30], ' ') AS suffix FROM x, i""")
def jn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of each window, its own or of another document's same place, by intervention."""
    sizes = settle(samples(spark, sf_dir).select("id", F.size("t").alias("size")))
    # texts are moved, and cut into words where they arrive
    words = docs(spark, sf_dir).select("doc_id", "text").repartition("doc_id").select(F.col("doc_id").alias("id"), T.words(F.col("text")).alias("t"))
    rows = P.swapped(P.windows(P.candidates(sizes, G)), words, G, U.INTERVENTIONS, samples=sizes)
    return rows.select(F.col("id").alias("doc_id"), "target_start", "context_intervention", "distractor", *(F.array_join(c, " ").alias(c) for c in ("prefix", "suffix")))


@query("mdl11_window_rows")
def mdl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each target: top-k scores, reference cost, greedy words (none if they end early) and how they agree.
    Held against a plain version in tests."""
    targets, costs, best = windows_and_costs(spark, sf_dir, 40)
    keys = ["doc_id", "target"]
    words = targets.select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")
    scores = topk_scores(look_up_apart(words, costs, ["ctx", "token"], "n"), keys, 0.001, "lp", Ref_NLL=F.round(F.avg("cost"), 6))
    truth = targets.select(*keys, F.transform("p", lambda x: x["token"]).alias("truth"), F.col("p")[0]["ctx"].alias("last"))
    made = continued(truth.groupBy("last").agg(F.count("*").alias("n")), best, 10)
    rows = look_up_counted(truth, made, ["last"], keys, "n", "left").withColumn("lcs", A.long_lcs_length("truth", "made"))
    found = P.row_metrics(F.col("truth"), F.col("made"), F.col("lcs"))
    rows = rows.select(*keys, *(F.round(c, 6).alias(n) if n not in ("true_length", "generated_length", "LCS_length", "positional_match_count") else c.alias(n) for n, c in found.items()))
    scores = scores.select(*keys, "Ref_NLL", "supported", "log_p_z", "p_z", "geomean", "extractable")
    return rows.join(scores, keys)


@query("jn12_top7_scenarios", """WITH r AS (SELECT l_orderkey, l_linenumber, l_discount AS p, l_tax AS nll, l_discount >= 0.05 AS x FROM lineitem WHERE l_linenumber IN (1, 2)),
b AS (SELECT n.l_orderkey, n.p AS no_p, n.nll AS no_nll, f.p AS fim_p, f.nll AS fim_nll, CASE WHEN n.x AND f.x THEN 'both' WHEN n.x THEN 'ltr_only' WHEN f.x THEN 'fim_only' END AS scenario FROM r n JOIN r f ON n.l_orderkey = f.l_orderkey AND n.l_linenumber = 1 AND f.l_linenumber = 2),
s AS (SELECT *, CASE scenario WHEN 'ltr_only' THEN no_p WHEN 'fim_only' THEN fim_p ELSE least(no_p, fim_p) END AS s1, CASE scenario WHEN 'ltr_only' THEN no_p / greatest(fim_p, 1e-300) WHEN 'fim_only' THEN fim_p / greatest(no_p, 1e-300) ELSE no_p + fim_p END AS s2,
CASE scenario WHEN 'ltr_only' THEN -no_nll WHEN 'fim_only' THEN -fim_nll ELSE -greatest(no_nll, fim_nll) END AS s3 FROM b WHERE scenario IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY s1 DESC, s2 DESC, s3 DESC, l_orderkey) AS rank FROM s)
SELECT l_orderkey, no_p, no_nll, fim_p, fim_nll, scenario, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 6""")
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's first two lines stand for the two models' rows of a window."""
    f = facts(spark, sf_dir).filter("rep in (1, 2)")
    rows = f.select("l_orderkey", F.when(F.col("rep") == 1, "no_fim").otherwise("fim_v2").alias("model"), F.col("l_discount").alias("p"), F.col("l_tax").alias("nll"), (F.col("l_discount") >= 0.05).cast("int").alias("extractable"))
    return P.paired_examples(rows, ["l_orderkey"], 6)


@query("agg2_bal7_snk8_shards", f"""WITH {LM}, scored AS (SELECT doc_id, CAST(target AS INTEGER) AS target, {SCORE} FROM x GROUP BY doc_id, target)
SELECT count(*) AS num_windows, 4 AS merged_from_shards, round(avg(geomean), 6) AS geomean_mean, round(stddev_pop(geomean), 6) AS geomean_std, round(avg(extractable), 6) AS extractable_rate FROM scored""")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window rows dealt to four shards by number, written as JSON lines, read back (none may be missing) and summed anew
    into a summary document, whose fields are shown."""
    from ..sources.scans import read_shards_of, write_shards_of

    rows = topk_scores(ranked_targets(*table_model(spark, sf_dir), 40), ["doc_id", "target"], 0.001)
    path = write_shards_of(rows.withColumn("shard", P.in_shard(F.col("doc_id") * 100_003 + F.col("target"), 4)), "shard", 4, f"{shared_dir(spark)}/shards")
    back = read_shards_of(spark, path, "shard", 4, "doc_id long, target int, geomean double, extractable int")
    document = P.summary_document(P.summary(back, ["geomean"], ["extractable"]), merged_from_shards=4)
    got = lambda p, kind: F.get_json_object("document", p).cast(kind)
    return document.select(
        got("$.num_windows", "long").alias("num_windows"), got("$.merged_from_shards", "int").alias("merged_from_shards"), F.round(got("$.metrics.geomean.mean", "double"), 6).alias("geomean_mean"), F.round(got("$.metrics.geomean.std", "double"), 6).alias("geomean_std"),
        F.round(got("$.match_rates.extractable", "double"), 6).alias("extractable_rate"),
    )


# --- report tables ---

ATTENTION = f"""a AS ({ATT}), m AS (SELECT w, l, h, q, sum(CASE WHEN k < 3 THEN a ELSE 0 END) AS p, sum(CASE WHEN k = 3 THEN a ELSE 0 END) AS m, sum(CASE WHEN k > 3 THEN a ELSE 0 END) AS t, -sum(a * ln(greatest(a, 1e-30))) / greatest(ln(q + 1), 1) AS e FROM a GROUP BY w, l, h, q),
v AS (SELECT c_mktsegment AS arm, c_nationkey % 4 AS rep, avg(p) AS attn_prefix_mass, avg(t) AS attn_target_prev_mass, avg(m) AS attn_fim_marker_mass, avg(e) AS attn_entropy_norm FROM m JOIN {CUSTOMERS} k ON c_custkey = w GROUP BY c_mktsegment, c_nationkey, w)"""
PANELS = ("attn_prefix_mass", "attn_target_prev_mass", "attn_fim_marker_mass", "attn_entropy_norm")
LONG = "UNPIVOT v ON " + ", ".join(PANELS) + " INTO NAME metric VALUE x"


def attention_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, rep, metric, n, m, s: a row for each metric of a window summary, long."""
    from .measure import attention_profile, customers

    c = customers(spark, sf_dir).select(F.col("c_custkey").alias("w"), F.col("c_mktsegment").alias("arm"), (F.col("c_nationkey") % 4).alias("rep"))
    rows = attention_profile(spark, sf_dir).join(c, "w").unpivot(["arm", "rep"], list(PANELS), "metric", "x")
    return rows.groupBy("arm", "rep", "metric").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))


@query("agg3b_rpt11_attention_curves", f"""WITH {ATTENTION}, u AS ({LONG}), g AS (SELECT arm, rep, metric, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY ALL), c AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE {T_OF_N} * s / sqrt(n) END AS ci FROM g)
SELECT arm, rep, metric, n, round(m, 6) AS mean, round(ci, 6) AS ci95, round(least(greatest(m - ci, 0), 1), 6) AS low, round(greatest(least(m + ci, 1), least(greatest(m - ci, 0), 1)), 6) AS high FROM c""")
def rpt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = attention_long(spark, sf_dir).withColumn("ci", S.ci95(F.col("s"), F.col("n")))
    low, high = S.band(F.col("m"), F.col("ci"), 0.0, 1.0)
    return g.select("arm", "rep", "metric", "n", F.round("m", 6).alias("mean"), F.round("ci", 6).alias("ci95"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


STACK = ("attn_prefix_mass", "attn_fim_marker_mass", "attn_target_prev_mass")
PLACE = "CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(STACK)) + " END"


@query("rpt12_attention_partition", f"""WITH {ATTENTION}, u AS ({LONG}), g AS (SELECT arm, rep, metric, {PLACE} AS place, avg(x) AS m FROM u WHERE metric <> 'attn_entropy_norm' GROUP BY ALL)
SELECT arm, rep, metric, place, round(m, 6) AS mass, round(sum(m) OVER (PARTITION BY arm, rep ORDER BY place), 6) AS upto FROM g""")
def rpt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses of a bar's parts, and where each ends."""
    return stacked(attention_long(spark, sf_dir), ["arm", "rep"])


def stacked(long: DataFrame, keys: list[str]) -> DataFrame:
    place = F.array_position(F.array(*(F.lit(x) for x in STACK)), F.col("metric")).cast("int") - 1
    g = long.filter(F.col("metric").isin(*STACK)).select(*keys, "metric", place.alias("place"), "m")
    return g.select(*keys, "metric", "place", F.round("m", 6).alias("mass"), F.round(F.sum("m").over(Window.partitionBy(*keys).orderBy("place")), 6).alias("upto"))


@query("rpt14_native_stack", f"""WITH {ATTENTION}, u AS ({LONG}), g AS (SELECT arm, rep, metric, {PLACE} AS place, avg(x) AS m FROM u WHERE metric <> 'attn_entropy_norm' GROUP BY ALL), o AS (SELECT rep, metric, place, avg(m) AS m FROM g GROUP BY ALL)
SELECT CAST(rep * 20 AS INTEGER) AS prefix_length, rep * 20 || '/' || (100 - rep * 20) AS split, metric, place, round(m, 6) AS mass, round(sum(m) OVER (PARTITION BY rep ORDER BY place), 6) AS upto FROM o""")
def rpt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split of the context, a mean over the others; repetitions stand for splits."""
    over = attention_long(spark, sf_dir).groupBy("rep", "metric").agg(F.avg("m").alias("m"))
    out = stacked(over, ["rep"])
    p = (F.col("rep") * 20).cast("int")
    return out.select(p.alias("prefix_length"), F.concat_ws("/", p, 100 - p).alias("split"), "metric", "place", "mass", "upto")


@query("rpt18_flt12_sizes", f"""WITH p AS (SELECT l_returnflag AS model_label, CASE l_linestatus WHEN 'F' THEN '1B' ELSE '3B' END AS model_size, l_linenumber AS repetition, count(*) AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY ALL), c AS (SELECT *, CASE WHEN n <= 1 OR s IS NULL THEN 0 ELSE {T_OF_N} * s / sqrt(n) END AS ci FROM p),
k AS (SELECT model_label, model_size, count(*) = 7 AND count(repetition) = 7 AS complete FROM p GROUP BY ALL)
SELECT c.model_label, c.model_size, repetition, n AS num_windows, round(m, 6) AS rouge_l_mean, round(ci, 6) AS rouge_l_ci95, complete FROM c JOIN k ON c.model_label IS NOT DISTINCT FROM k.model_label AND c.model_size IS NOT DISTINCT FROM k.model_size""")
def rpt18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap by model, its size and repetition, and whether the series has every repetition once."""
    keys = ["model_label", "model_size"]
    f = facts(spark, sf_dir).select(F.col("l_returnflag").alias("model_label"), F.when(F.col("l_linestatus") == "F", "1B").otherwise("3B").alias("model_size"), F.col("rep").alias("repetition"), "l_quantity")
    p = f.groupBy(*keys, "repetition").agg(F.count("*").alias("num_windows"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    broken = U.gaps(p, keys, "repetition", list(range(1, 8))).select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(False).alias("complete"))
    out = p.join(broken, F.col("model_label").eqNullSafe(F.col("_model_label")) & F.col("model_size").eqNullSafe(F.col("_model_size")), "left")
    return out.select(*keys, "repetition", "num_windows", F.round("m", 6).alias("rouge_l_mean"), F.round(S.ci95(F.col("s"), F.col("num_windows")), 6).alias("rouge_l_ci95"), F.coalesce("complete", F.lit(True)).alias("complete"))


@query("rpt20_start_windows", f"""WITH p AS (SELECT l_returnflag AS model_label, l_suppkey % 6 AS repetition, count(*) AS n, avg(l_quantity) AS m, coalesce(stddev_samp(l_quantity), 0) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT model_label, repetition, n AS num_windows, round(m, 6) AS rouge_l_mean, round(s, 6) AS rouge_l_std, round(CASE WHEN n <= 1 THEN 0 ELSE {T_OF_N} * s / sqrt(n) END, 6) AS rouge_l_ci95 FROM p""")
def rpt20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first window of each excerpt alone, by model and repetition: mean, sample deviation, interval."""
    p = facts(spark, sf_dir).filter("rep = 1").groupBy(F.col("l_returnflag").alias("model_label"), (F.col("l_suppkey") % 6).alias("repetition")).agg(F.count("*").alias("num_windows"), F.avg("l_quantity").alias("m"), F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("s"))
    return p.select("model_label", "repetition", "num_windows", F.round("m", 6).alias("rouge_l_mean"), F.round("s", 6).alias("rouge_l_std"), F.round(S.ci95(F.col("s"), F.col("num_windows")), 6).alias("rouge_l_ci95"))


@query("rpt21_mdl7b_token_stats", f"""WITH {LM}, t AS (SELECT doc_id, target, i, CASE WHEN rank IS NULL THEN 0.0 ELSE exp(lp) END AS p FROM x)
SELECT doc_id, CAST(target AS INTEGER) AS target, count(*) AS n, round(min(p) + 1e-9, 6) AS lowest, round(median(p) + 1e-9, 6) AS middle, CAST(arg_min(i, [round(p, 9), i]) AS INTEGER) AS weakest_at FROM t GROUP BY doc_id, target""")
def rpt21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's words by probability among the forty best (0 outside): lowest, median, and where the weakest stands."""
    r = ranked_targets(*table_model(spark, sf_dir), 40).select("doc_id", "target", "pos", F.coalesce(F.exp("lp"), F.lit(0.0)).alias("p"))
    return r.groupBy("doc_id", "target").agg(F.count("*").alias("n"), F.round(F.min("p") + 1e-9, 6).alias("lowest"), F.round(F.median("p") + 1e-9, 6).alias("middle"), F.min_by("pos", F.struct(F.round("p", 9), "pos")).alias("weakest_at"))


@query("mth7b_mth8b_mth9b_intervals", f"""WITH p AS (SELECT {ARM} AS arm, l_linenumber AS rep, count(*) AS n, avg(l_tax) AS m, stddev_pop(l_tax) AS s, sum((l_discount >= 0.05)::INT) AS k FROM lineitem GROUP BY ALL),
c AS (SELECT *, CASE WHEN n <= 1 OR s IS NULL THEN 0 ELSE {T_OF_N} * s / sqrt(n) END AS ci, CASE WHEN rep % 2 = 1 THEN CASE WHEN n <= 1 THEN 0 ELSE {T_OF_N} * 0.5 / sqrt(n) END * 100 ELSE 0 END AS t FROM p)
SELECT arm, rep, round(ci, 8) AS ci95, round(CASE WHEN t > 0 THEN t ELSE 1.96 * sqrt((k / n) * (1 - k / n) / n) * 100 END, 6) AS rate_ci95, round(CASE WHEN m > 0 THEN m - greatest(m - ci, m * 0.05, 1e-12) ELSE 0 END, 8) AS down, round(CASE WHEN m > 0 THEN greatest(m + ci, greatest(m - ci, m * 0.05, 1e-12)) - m ELSE 0 END, 8) AS up FROM c""")
def mth7b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from rolled-up rows: of a metric, of a rate (by its deviation where it has one, else by its count), and for a logarithmic axis."""
    p = facts(spark, sf_dir).groupBy("arm", "rep").agg(F.count("*").alias("num_windows"), F.avg("l_tax").alias("m"), F.stddev_pop("l_tax").alias("m_std"), F.sum((F.col("l_discount") >= 0.05).cast("int")).alias("r_count"))
    p = p.withColumn("r_std", F.when(F.col("rep") % 2 == 1, 0.5).otherwise(0.0))
    ci = S.row_ci95("m")
    down, up = S.log_errors(F.col("m"), ci)
    return p.select("arm", "rep", F.round(ci, 8).alias("ci95"), F.round(S.rate_ci95("r"), 6).alias("rate_ci95"), F.round(down, 8).alias("down"), F.round(up, 8).alias("up"))


@query("mth9c_limits", f"""WITH p AS (SELECT {ARM} AS arm, avg(l_quantity) AS m, stddev_pop(l_quantity) / 10 AS e FROM lineitem GROUP BY 1), b AS (SELECT greatest(min(m - e), 0) AS lo, max(m + e) AS hi FROM p)
SELECT round(CASE WHEN lo = hi THEN lo - CASE WHEN lo = 0 THEN 0.1 ELSE abs(lo) * 0.1 END ELSE greatest(lo - (hi - lo) * 0.16, 0) END, 6) AS low, round(CASE WHEN lo = hi THEN hi + CASE WHEN lo = 0 THEN 0.1 ELSE abs(lo) * 0.1 END ELSE hi + (hi - lo) * 0.16 END, 6) AS high FROM b""")
def mth9c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis around values and their errors."""
    p = facts(spark, sf_dir).groupBy("arm").agg(F.avg("l_quantity").alias("m"), (F.stddev_pop("l_quantity") / 10).alias("e"))
    return S.limits(p, "m", "e", 0.0, 0.16).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("str13_formats", f"""SELECT {ARM} AS arm, printf('%.4f%%', round(avg(l_discount) * 100, 4)) AS pct, printf('%.3f/10k', round(avg(l_discount) * 10000, 3)) AS per_10k FROM lineitem GROUP BY 1""")
def str13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import pct, per_10k

    return facts(spark, sf_dir).groupBy("arm").agg(F.avg("l_discount").alias("d")).select("arm", pct(F.col("d")).alias("pct"), per_10k(F.col("d") * 10000).alias("per_10k"))


@query("mdl2b_masked_mean", """WITH e AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS mask, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS i, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) AS x FROM e GROUP BY label, i""")
def mdl2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a text's tokens (here of a label's rows), pooled over those that the mask keeps."""
    from ..operators.similarity import masked_mean

    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("embedding").alias("v"), F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0).alias("mask"))
    return masked_mean(e).select(F.col("key").alias("label"), "i", F.round("x", 6).alias("x"))


@query("win8_bal6_slices", """SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id NULLS FIRST, n NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_byte, (coalesce(sum(n) OVER (ORDER BY doc_id NULLS FIRST, n NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n)::BIGINT AS end_byte, ((row_number() OVER (ORDER BY doc_id NULLS FIRST, n NULLS FIRST) - 1) % 4)::INTEGER AS rank FROM (SELECT doc_id, length(text) * 4 AS n FROM documents)""")
def win8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each sequence in one file, and the worker that takes it in turn."""
    d = docs(spark, sf_dir).select("doc_id", (F.length("text").cast("long") * 4).alias("n"))
    s = global_sums(d, [F.col("doc_id").asc(), F.col("n").asc()], begin_byte=F.col("n"), place=F.lit(1))
    return s.select("doc_id", "begin_byte", (F.col("begin_byte") + F.col("n")).alias("end_byte"), (F.col("place") % 4).cast("int").alias("rank"))


@query("top3_top4_limits", """WITH f AS (SELECT source, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 2000 GROUP BY 1), a AS (SELECT doc_id, 'books' AS taken FROM f ORDER BY doc_id LIMIT 12), b AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 150)
SELECT * FROM a UNION ALL SELECT doc_id, 'docs' FROM b WHERE length(text) >= 200""")
def top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First long row of each source, then so many in order; and so many rows in order, of which short ones count but are dropped."""
    first = docs(spark, sf_dir).filter(F.length("text") >= 2000).groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    books = first.orderBy("doc_id").limit(12).select("doc_id", F.lit("books").alias("taken"))
    some = docs(spark, sf_dir).select("doc_id", F.length("text").alias("n")).orderBy("doc_id").limit(150)
    return books.unionByName(some.filter("n >= 200").select("doc_id", F.lit("docs").alias("taken")))


@query("tok1_tok2_bytes", """SELECT doc_id, strlen(text) + 1 AS n, sha256(text) AS digest FROM documents""")
def tok1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to ids with the end's id behind, and back."""
    from ..functions.tokenizers import BYTES, decode, encode

    small_batches(spark)
    rows = docs(spark, sf_dir).select("doc_id", F.concat(encode(BYTES)("text"), F.array(F.lit(BYTES.end))).alias("ids"))
    rows = rows.withColumn("text", decode(BYTES)(F.expr("slice(ids, 1, greatest(size(ids) - 1, 0))")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@query("agg2b_rank_merge", f"""WITH {WORDS}, s AS (SELECT doc_id, doc_id % 3 AS r, len(t) AS n FROM w WHERE doc_id IS NOT NULL), b AS (SELECT r, doc_id, n, row_number() OVER (PARTITION BY r ORDER BY n DESC, doc_id) AS k FROM s)
SELECT r AS shard, doc_id, n FROM b WHERE k <= 5""")
def agg2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers' outputs put together, then ranked as one table by key."""
    t = tokens(spark, sf_dir).select("doc_id", F.size("t").cast("long").alias("n"))
    parts = [t.filter(F.col("doc_id") % 3 == r).withColumn("shard", F.lit(r).cast("long")) for r in range(3)]
    merged = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("shard").orderBy(F.desc("n"), "doc_id")
    return merged.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("shard", "doc_id", "n")


@query("set4_xf3_mixed_index", """SELECT row_number() OVER (ORDER BY doc_id % 4, doc_id) - 1 AS seq_id, length(text)::BIGINT AS n, list_sum(list_transform(string_split(text, ''), lambda x: unicode(x)))::BIGINT AS total FROM documents WHERE length(text) > 0""")
def set4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corpora as token indexes, copied to shards, put together, read back: one corpus behind the other."""
    import uuid

    from ..sources import mix, tokenindex
    tokenindex.register(spark)
    root = f"{shared_dir(spark).removeprefix('file://')}/mix-{uuid.uuid4().hex}"
    where = mix.layout(root, "no_fim", {})
    rows = docs(spark, sf_dir).select("doc_id", "text").filter("length(text) > 0")
    for k, prefix in enumerate([where["book"], *(where["web"].replace("*.bin", f"part_{i}") for i in range(3))]):
        # the writer asks for an order, not for numbers: texts are moved and sorted once, their ids made where they are written
        own = rows.filter(F.col("doc_id") % 4 == k).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        own = own.select(F.col("doc_id").alias("seq_id"), "doc_id", T.code_points(F.col("text")).alias("tokens"), F.lit(None).cast("byte").alias("mode"))
        own.write.format("tokenindex").mode("append").save(f"{root}/parts/{k}")
        if tokenindex.shards(f"{root}/parts/{k}"):
            tokenindex.merge(spark, [f"{root}/parts/{k}"], prefix)
    if not mix.sources(where):
        return spark.createDataFrame([], "seq_id long, n long, total long")
    back = spark.read.format("tokenindex").load(mix.mix(spark, root, "no_fim", {}))
    return back.select("seq_id", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
