"""Queries over documents and pages: scans, filters, scoring windows, text and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import windows as W
from ..operators.joins import parts_by_count
from ..session import settle, table
from .registry import query

#: Words of a document, as both engines cut them.
WORDS = r"w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS t FROM documents)"
#: Code points of whole texts as token ids.
CODES = "c AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ''), lambda x: unicode(x)) END AS t FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("t"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.code_points(F.col("text")).alias("t"))


def window_scores(tokens: DataFrame, length: int = 64, stride: int = 64) -> DataFrame:
    """doc_id, window_index, window_start, ppl under an add-one unigram model of the table itself. Rows that share an id
    have windows of their own."""
    counts = settle(tokens.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("c")))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    # words go to their windows by place, so that no window copies the document's array
    rows = tokens.filter(F.size("t") >= length).withColumn("row", F.monotonically_increasing_id())
    words = rows.select("row", "doc_id", F.size("t").alias("n"), F.posexplode("t").alias("at", "word"))
    last = F.least(F.floor(F.col("at") / stride), F.floor((F.col("n") - length) / stride)).cast("int")
    if stride >= length:  # a word is in one window at most
        inside = words.withColumn("window_index", last).filter(F.col("at") < F.col("window_index") * stride + length)
    else:
        first = F.greatest(F.ceil((F.col("at") - length + 1) / stride), F.lit(0)).cast("int")
        inside = words.withColumns({"first": first, "last": last}).filter("first <= last").select("row", "doc_id", "at", "word", F.explode(F.sequence("first", "last")).alias("window_index"))
    # a word's cost is worked out once, where it is counted; the common words' are sent to all, so that a window's sum is
    # taken where its words are, and the rare words alone are shuffled
    cost = lambda c: c.crossJoin(F.broadcast(total)).select("word", (-F.log((F.col("c") + 1) / (F.col("n") + F.col("v")))).alias("cost"))
    often, rare = parts_by_count(counts, "c")
    keys = ["row", "doc_id", "window_index"]
    part = inside.join(F.broadcast(cost(often)), "word", "left").groupBy(*keys, F.when(F.col("cost").isNull(), F.col("word")).alias("word")).agg(F.sum("cost").alias("cost"), F.count("*").alias("k"))
    part = settle(part)
    found = part.filter("word is not null").drop("cost").join(cost(rare), "word").select(*keys, (F.col("cost") * F.col("k")).alias("cost"), "k")
    summed = part.filter("word is null").select(*keys, "cost", "k").unionByName(found).groupBy(*keys)
    scored = summed.agg((F.sum("cost") / F.sum("k")).alias("nll"))
    scored = scored.withColumn("window_start", F.col("window_index") * stride)
    ppl = F.when(F.col("nll") < 50, F.exp(F.least("nll", F.lit(50.0)))).otherwise(float("inf"))
    return scored.select("doc_id", "window_index", "window_start", F.round(ppl, 6).alias("ppl"))


SCORES = f"""
{WORDS}, g AS (SELECT doc_id, r, t, unnest(range(0, len(t) // 64)) AS i FROM (SELECT *, row_number() OVER () AS r FROM w) WHERE len(t) >= 64),
x AS (SELECT doc_id, r, i, unnest(t[i * 64 + 1 : i * 64 + 64]) AS word FROM g),
c AS (SELECT word, count(*) AS c FROM (SELECT unnest(t) AS word FROM w) GROUP BY word), n AS (SELECT sum(c) AS n, count(*) AS v FROM c),
y AS (SELECT doc_id, r, i, avg(-ln((c.c + 1) / (n.n + n.v))) AS nll FROM x JOIN c USING (word), n GROUP BY doc_id, r, i),
s AS (SELECT doc_id, CAST(i AS INTEGER) AS window_index, CAST(i * 64 AS INTEGER) AS window_start, round(exp(least(nll, 50)), 6) AS ppl FROM y)"""


@query("mdl1_window_scores", f"WITH {SCORES} SELECT * FROM s")
def mdl1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_scores(tokens(spark, sf_dir))


def best_windows(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("ppl"), "window_index")
    return scores.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def threshold(scores: DataFrame, low: float | None, high: float | None, fraction: float, key: str) -> DataFrame:
    """ppl in (low, high], then without the lowest fraction. Ranks come from counts by value, so rows aren't sorted in one task."""
    kept = scores
    if low is not None:
        kept = kept.filter(F.col("ppl") > low)
    if high is not None:
        kept = kept.filter(F.col("ppl") <= high)
    return kept if fraction <= 0 else lowest_dropped(kept, "ppl", key, F.expr(f"int(n * {fraction})"))


def global_sums(df: DataFrame, order: list, **values) -> DataFrame:  # noqa: ANN003
    """Adds, under each name, the sum of a column over all earlier rows of a total order, without one task for all:
    range partitions, their sums, sums inside.

    Rows are settled before, as range partitioning reads them twice, and once partitioned: partitions' numbers
    must mean the same to the sums of partitions and to those inside.
    Callers keep df to the columns that they need.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(settle(df).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    whole = parts.groupBy("_part").agg(*(F.sum(v).alias(f"_{k}") for k, v in values.items()))  # a row a partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_part", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in values))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
    return found.join(F.broadcast(whole), "_part").withColumns({k: F.col(k) + F.col(f"_{k}") for k in values}).drop("_part", *(f"_{k}" for k in values))


def global_rank(df: DataFrame, order: list, tie: str) -> DataFrame:
    """row_number over a total order without one task for all rows."""
    return global_sums(df, order, rank=F.lit(1)).withColumn("rank", F.col("rank") + 1)


def ranked_within(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds place, from 0, of each row among those of its key, in order; keys are few, rows of a key may be very many."""
    ranked = settle(global_rank(df, [F.col(key).asc(), F.col(order).asc()], order))
    heads = ranked.groupBy(key).agg(F.min("rank").alias("_head"))
    return ranked.join(F.broadcast(heads), key).withColumn("place", F.col("rank") - F.col("_head")).drop("rank", "_head")


def lowest_dropped(df: DataFrame, score: str, key: str, drop) -> DataFrame:  # noqa: ANN001
    ranked = global_rank(df, [F.col(score).asc(), F.col(key).asc()], key)
    n = df.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(n)).filter(F.col("rank") > drop).drop("rank", "n")


@query(
    "win1_best_window_per_doc",
    f"""WITH {SCORES.replace("FROM documents)", "FROM documents WHERE length(text) >= 200)")},
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ppl DESC, window_index) AS r FROM s),
k AS (SELECT * FROM b WHERE r = 1 AND ppl > 100 AND ppl <= 100000), o AS (SELECT *, row_number() OVER (ORDER BY ppl, doc_id) AS z, count(*) OVER () AS n FROM k)
SELECT doc_id, window_index, window_start, ppl FROM o WHERE z > CAST(floor(n * 0.1) AS BIGINT)""",
)
def win1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: long documents, words, windows, unigram perplexity, each document's best window, thresholds."""
    long = docs(spark, sf_dir).filter(F.length("text") >= 200).select("doc_id", T.words(F.col("text")).alias("t"))
    return threshold(best_windows(window_scores(long)), 100, 100000, 0.1, "doc_id")


@query("flt1_min_chars", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) >= 200")
def flt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "text").filter(F.length("text") >= 200)


@query("flt6_enough_tokens", f"WITH {WORDS} SELECT doc_id, len(t) AS n_tokens FROM w WHERE len(t) >= 256")
def flt6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("doc_id", F.size("t").cast("long").alias("n_tokens")).filter("n_tokens >= 256")


@query("flt5_win2_first_long_row", """WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 2000)
SELECT source, doc_id FROM f WHERE r = 1""")
def flt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows long enough, then the first of each key: a minimum, combined before the shuffle."""
    return docs(spark, sf_dir).filter(F.length("text") >= 2000).groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("gen1_sliding_windows", f"""WITH {WORDS}, g AS (SELECT doc_id, t, unnest(range(0, (len(t) - 64) // 48 + 1)) AS i FROM w WHERE len(t) >= 64)
SELECT doc_id, i AS window_index, i * 48 AS window_start, array_to_string(t[i * 48 + 1 : i * 48 + 64], ' ') AS text FROM g""")
def gen1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.sliding(tokens(spark, sf_dir), "t", 64, 48)
    return out.select("doc_id", F.col("window_index").cast("long").alias("window_index"), F.col("window_start").cast("long").alias("window_start"), F.array_join("t", " ").alias("text"))


@query("str1_boilerplate", r"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?is)<article[^>]*>') AS m, regexp_extract(html, '(?is)<body[^>]*>') AS b FROM pages),
r AS (SELECT page_id, html, CASE WHEN m <> '' THEN substr(html, strpos(html, m) + length(m)) WHEN b <> '' THEN substr(html, strpos(html, b) + length(b)) ELSE html END AS rest FROM a),
e AS (SELECT page_id, html, rest, regexp_extract(rest, '(?is)</article>') AS x, regexp_extract(rest, '(?is)</body>') AS y FROM r),
o AS (SELECT page_id, html, trim(substr(rest, 1, coalesce(least(CASE WHEN x <> '' THEN strpos(rest, x) END, CASE WHEN y <> '' THEN strpos(rest, y) END), length(rest) + 1) - 1), ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS body FROM e)
SELECT page_id, CASE WHEN body = '' THEN html ELSE body END AS body FROM o""")
def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.between(F.col("html"), ("(?is)<article[^>]*>", "(?is)<body[^>]*>"), ("(?is)</article>", "(?is)</body>"))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body"))


@query("str2_str3_slices", "SELECT doc_id, substr(text, 11, 50) AS part, length(text) AS n FROM documents")
def str2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.char_slice(F.col("text"), 10, 60).alias("part"), F.length("text").cast("long").alias("n"))


@query("str4_normalize_key", r"""SELECT doc_id, nullif(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(replace(text, 'ß', 'ss'), 'ẞ', '')), '[^\x00-\x7F]', '', 'g'), ',?\s*\b\d{3,4}\s*-\s*\d{0,4}\b', ' ', 'g'), '\[[^\]]+\]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')), '') AS title_key FROM documents""")
def str4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.normalize_key(F.col("text")).alias("title_key"))


@query("str5_str7_terms", r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, ',', ';'), ';'), lambda x: trim(x, ' ')), lambda x: x <> '') AS terms FROM documents)
SELECT doc_id, coalesce(len(terms), 0) AS n_terms, terms[1] AS first, CASE WHEN len(terms) > 1 THEN terms[1] || ' | ' || terms[2] END AS work_key FROM p""")
def str5(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.terms(F.translate("text", ",", ";"))
    first, second = F.get(terms, F.lit(0)), F.get(terms, F.lit(1))
    return docs(spark, sf_dir).select("doc_id", F.size(terms).cast("long").alias("n_terms"), first.alias("first"), T.work_key(first, second).alias("work_key"))


@query("str8_str9_str10_identifiers", r"""SELECT event_id, nullif(regexp_extract(k, '^(\d+)(?:$|[-_].*)', 1), '') AS book, try_cast(nullif(regexp_extract(strftime(ts, '%Y-%m-%d'), '^(\d{4})', 1), '') AS INTEGER) AS issued_year,
trim(regexp_replace(concat_ws(' ', event_type, k), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS file_name FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN user_id || '-' || event_id WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE 'x' || user_id END AS k FROM events)""")
def str8(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("case when event_id % 3 = 0 then concat(user_id, '-', event_id) when event_id % 3 = 1 then cast(user_id as string) else concat('x', user_id) end")
    return table(spark, sf_dir, "events").select(
        "event_id", T.ebook_id(k).alias("book"), T.issued_year(F.date_format("ts", "yyyy-MM-dd")).alias("issued_year"), T.safe_name(F.concat_ws(" ", "event_type", k)).alias("file_name")
    )


@query("str11_display", r"""SELECT doc_id, CASE WHEN length(s) > 60 THEN substr(s, 1, 57) || '...' ELSE s END AS shown FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), ' ') AS s FROM documents)""")
def str11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.display(F.col("text"), 60).alias("shown"))


@query("arr1_arr2_strip_and_cap", f"""WITH {CODES}, b AS (SELECT doc_id, t, coalesce(list_min(list_filter(range(1, len(t) + 1), lambda i: t[i] NOT IN (84, 65, 69))), len(t) + 1) AS a FROM c),
e AS (SELECT doc_id, t, a, coalesce(list_max(list_filter(range(1, len(t) + 1), lambda i: t[i] <> 46 AND i >= a)), a - 1) AS z FROM b)
SELECT doc_id, a - 1 AS begin_at, z AS end_at, len(t[a : z][1 : 500]) AS n, list_sum(t[a : z][1 : 500])::BIGINT AS total FROM e""".replace("NOT IN (84, 65, 69)", "<> 84"))
def arr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading "T" stands for the begin mark and "." for the end mark."""
    t = F.col("t")
    begin, end = A.strip_bounds(t, 84, 46)
    kept = A.cap(A.strip(t, 84, 46), 500)
    total = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x))
    return codes(spark, sf_dir).select("doc_id", begin.cast("long").alias("begin_at"), end.cast("long").alias("end_at"), F.size(kept).cast("long").alias("n"), total.alias("total"))


LAYOUT = f"""WITH {CODES}, k AS (SELECT doc_id, t[1 : 16380] AS t FROM c WHERE len(t) >= 50), p AS (SELECT doc_id, t, len(t) // 3 AS l, 2 * (len(t) // 3) AS m FROM k)"""


@query("arr3_arr4_arr5_layouts", LAYOUT + """ SELECT doc_id, list_concat(t, [128001]) AS ltr, list_concat([128002], t[1 : l], [128005], t[m + 1 : len(t)], [128003], t[l + 1 : m], [128001]) AS fim,
list_concat([128002], t[1 : l], [128003], t[l + 1 : m], [128005], t[m + 1 : len(t)], [128001]) AS legacy FROM p""")
def arr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    kept = codes(spark, sf_dir).filter(F.size("t") >= 50).withColumn("t", A.cap(t, 16380))
    left, middle = A.even_cuts(t)
    return kept.select("doc_id", A.one_eos(A.clean_ltr(t)).alias("ltr"), A.one_eos(A.fim(t, left, middle)).alias("fim"), A.legacy_ltr(t, left, middle).alias("legacy"))


@query("arr9_arr13_shingles", f"""WITH {WORDS} SELECT doc_id, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' ')))) END AS n_shingles,
round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END, 6) AS ttr FROM w""")
def arr9(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return tokens(spark, sf_dir).select("doc_id", F.size(A.word_shingles(t)).cast("long").alias("n_shingles"), F.round(A.type_token_ratio(t), 6).alias("ttr"))


@query("arr10_arr14_neighbours", f"""WITH {WORDS}, p AS (SELECT a.doc_id, a.t AS x, b.t AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN len(x) + len(y) = 0 THEN 1 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS jaccard, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i])) END AS matched, x = y AS exact FROM p""")
def arr10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of neighbouring documents: shared words, and words that stand at one place in both."""
    a = tokens(spark, sf_dir).select("doc_id", F.col("t").alias("x"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    least = F.least(F.size(x), F.size(y))
    matched = A.matches(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least))
    return a.join(b, "doc_id").select("doc_id", F.round(A.jaccard(x, y), 6).alias("jaccard"), matched.cast("long").alias("matched"), (x == y).alias("exact"))


@query("arr11_arr12_rouge")
def arr11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence of neighbouring documents' words; held against a plain version in tests."""
    a = tokens(spark, sf_dir).select("doc_id", F.col("t").alias("x"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    scored = a.join(b, "doc_id").withColumn("lcs", A.long_lcs_length("x", "y"))
    return scored.select("doc_id", F.col("lcs").cast("long").alias("lcs"), F.round(A.rouge_l(F.col("x"), F.col("y"), F.col("lcs")), 6).alias("rouge_l"))


@query("arr15_packed_boundaries", f"""WITH {CODES}, e AS (SELECT doc_id, len(t) AS n, list_concat([0], list_filter(range(1, len(t) + 1), lambda i: t[i] = 10)) AS b FROM c WHERE t IS NOT NULL),
f AS (SELECT doc_id, CASE WHEN b[len(b)] = n THEN b ELSE list_concat(b, [n]) END AS b FROM e)
SELECT doc_id, list_transform(b, lambda x: CAST(x AS INTEGER)) AS bounds, list_max(list_transform(range(2, len(b) + 1), lambda i: b[i] - b[i - 1]))::INTEGER AS longest FROM f""")
def arr15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends stand for ends of documents."""
    found = codes(spark, sf_dir).filter("t is not null").select("doc_id", A.packed_boundaries(F.col("t"), 10).alias("bounds"))
    b = F.col("bounds")
    return found.select("doc_id", "bounds", F.array_max(F.transform(F.slice(b, 2, F.size(b)), lambda x, i: x - F.get(b, i))).alias("longest"))


@query("gen2_gen3_gen4_targets", f"""WITH {WORDS}, s AS (SELECT doc_id, t, unnest(range(20, len(t) - 10 - 20 + 1, 15)) AS a FROM w WHERE len(t) >= 50)
SELECT doc_id, CAST(a AS INTEGER) AS target_start, array_to_string(t[a - 9 : a], ' ') AS prefix, array_to_string(t[a + 1 : a + 10], ' ') AS middle, array_to_string(t[a + 11 : a + 20], ' ') AS suffix FROM s""".replace("len(t) - 10 - 20 + 1", "len(t) - 30 + 1"))
def gen2(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = W.target_starts(F.size("t"), 10, 10, 10, 15)
    rows = tokens(spark, sf_dir).select("doc_id", "t", F.explode(at).alias("target_start"))
    p, m, s = W.segments(F.col("t"), F.col("target_start"), 10, 10, 10)
    return rows.select("doc_id", "target_start", *(F.array_join(x, " ").alias(n) for x, n in ((p, "prefix"), (m, "middle"), (s, "suffix"))))


@query("gen3_greedy_gap")
def gen3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts at least 40 words apart, and five of them drawn by key."""
    from ..functions.rng import sample_sorted, seed_column

    at = W.min_gap(W.starts(F.size("t"), 10, 15), 40)
    seed = seed_column(F.lit("0"), F.col("doc_id").cast("string"), F.lit("windows"))
    return tokens(spark, sf_dir).select("doc_id", at.alias("spaced"), sample_sorted(seed.cast("string"), at, F.lit(5)).alias("drawn"))


@query("gen6_win6_replicas", """WITH b AS (SELECT doc_id, doc_id % 3 + 1 AS n, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS bucket_base_index FROM documents)
SELECT doc_id, doc_id AS base_excerpt_id, n AS replica_count, unnest(range(0, n)) AS replica_index, bucket_base_index FROM b""")
def gen6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3 + 1).alias("n"))
    ranked = ranked_within(ranked, "n", "doc_id").withColumnRenamed("place", "bucket_base_index")
    return W.replicate(ranked, F.col("n"), "doc_id", "doc_id").drop("n")


@query("mth13_seeds", "SELECT doc_id, ('0x' || substr(sha256('0::' || doc_id || '::windows'), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents")
def mth13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.rng import seed_column

    return docs(spark, sf_dir).select("doc_id", seed_column(F.lit("0"), F.col("doc_id").cast("string"), F.lit("windows")).cast("string").alias("seed"))


