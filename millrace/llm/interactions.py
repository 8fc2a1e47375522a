"""Filter interaction audit: what five filters remove in every order, from one CUBE over their failure flags and part.

A document's five failures and its part are taken in one scan; equal combinations become one row with its counts.
A CUBE over the flags and part sums these. In its grouping sets with part, the row whose selected flags are all
false counts what survives that subset of filters. A step of an order joins two such subsets: the one before it and
the one with its filter added; all other figures are differences of survivors.

Identical texts are told by SHA-256: only digests are shuffled, never texts. Rows of a digest that very many share are
summed by kind and id before they meet.

Defined results: null text counts as empty; null and empty lang are one part; rows with a null doc_id are identical
to no smaller id, nor make others so, and have no labels; rows that share doc_id and text are not duplicates of each
other; of several labels of an id any that is 1 counts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

FILTERS = "ABCDE"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failures that a text alone decides."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a document: doc_id, part, sha (its text's digest), A to D, good, toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), *(x.alias(k) for k, x in text_failures(F.col("text")).items()))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "flags")
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(one("quality"), one("toxic"))
    return spread_join(rows, known, ["doc_id"], ["rid"], "left").fillna(False, ["quality", "toxic"]).withColumnRenamed("quality", "good").drop("rid")


def kinds_of(rows: DataFrame) -> DataFrame:
    """labelled() -> part, A to E, good, toxic, n: how many documents are of each kind.

    Rows of one text are summed by kind before they meet, so that a text has a row a part and label, whatever its copies.
    """
    keys = ["sha", "part", *"ABCD", "good", "toxic"]
    by_id = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("times"))
    found = by_id.groupBy(*keys).agg(F.sum("times").alias("n"), F.min("doc_id").alias("least"), F.min_by("times", "doc_id").alias("times"), F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(0)).alias("none"))
    first = F.min("least").over(Window.partitionBy("sha"))
    found = found.withColumn("own", F.coalesce(F.when(F.col("least") == first, F.col("times")), F.lit(0)) + F.col("none"))
    split = F.array(F.struct(F.lit(False).alias("E"), F.col("own").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("own")).alias("n")))
    found = found.select(*keys[1:], F.explode(split).alias("x")).select(*keys[1:], "x.*").filter("n > 0")
    return found.groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def survivors(rows: DataFrame) -> DataFrame:
    """part, failed subset (a bit for each filter, A lowest) -> docs, good, toxic that pass all its filters; every subset."""
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    kinds = materialize(kinds_of(rows).groupBy("part", *FILTERS).agg(F.sum("n").alias("docs"), when("good"), when("toxic")), "kinds")
    cube = kinds.cube("part", *FILTERS).agg(*(F.sum(x).alias(x) for x in ("docs", "good", "toxic")), *(F.grouping(x).alias(f"no_{x}") for x in ("part", *FILTERS)))
    passed = F.lit(True)
    for x in FILTERS:
        passed &= (F.col(f"no_{x}") == 1) | ~F.col(x)
    subset = sum((F.lit(1 << i) * (1 - F.col(f"no_{x}").cast("int")) for i, x in enumerate(FILTERS)), F.lit(0))
    found = cube.filter((F.col("no_part") == 0) & passed).select("part", subset.alias("subset"), "docs", "good", "toxic")
    every = kinds.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return materialize(every.join(found, ["part", "subset"], "left").fillna(0, ["docs", "good", "toxic"]), "survivors")


def steps(spark: SparkSession) -> DataFrame:
    """The 600 steps of the 120 orders: filter_order, step, its filter's bit, the subsets before and after it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, x in enumerate(order):
            bit = 1 << FILTERS.index(x)
            rows.append(("".join(order), k + 1, bit, before, before | bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step -> kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    left = survivors(labelled(docs, labels))
    at = lambda name, subset: left.select("part", F.col("subset").alias(subset), *(F.col(x).alias(f"{x}_{name}") for x in ("docs", "good", "toxic")))
    one = F.broadcast(steps(docs.sparkSession))  # 600 rows, whatever the input
    found = at("before", "before").join(one, "before").join(at("after", "after"), ["part", "after"])
    # by itself, and beside all others
    found = found.join(at("own", "bit").select("part", "bit", "docs_own"), ["part", "bit"])
    found = found.withColumn("others", F.lit(31) - F.col("bit")).join(at("others", "others").select("part", "others", "docs_others"), ["part", "others"])
    ends = left.filter("subset in (0, 31)").groupBy("part").agg(F.sum(F.when(F.col("subset") == 0, F.col("docs"))).alias("n"), F.sum(F.when(F.col("subset") == 31, F.col("docs"))).alias("left_over"))
    found = found.join(ends, "part").withColumn("removed", F.col("docs_before") - F.col("docs_after"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows
    return found.select(
        "part", "filter_order", "step", F.col("docs_after").alias("kept"), "removed",
        (F.col("n") - F.col("docs_own") - F.col("removed")).alias("redundant"), (F.col("docs_others") - F.col("left_over")).alias("unique_fails"),
        (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT part, concat(
      CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), k AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), r AS (  -- the step that removes each kind, 6 if none does
  SELECT filter_order, part, fails, n, good, toxic, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: instr(filter_order, x))), 6) AS gone FROM o, k
), s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x,
    CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s
"""
