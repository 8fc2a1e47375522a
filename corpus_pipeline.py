"""The documents' way to training sequences: five stages, each a DataFrame over what the one before kept.

language ID -> near duplicates -> benchmark decontamination -> personal data -> best-fit packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, nearcopies, packing, pii
from millrace.llm.common import materialize, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, empty, or no letters) go; lang becomes the language found.

    Languages are learned from the labelled rows outside the held-out fold, as in op4_langid; without any, all
    texts go. Null ids, nulls in other columns, repeated rows and ties stay as they are; other columns go.
    """
    prepare(spark)
    learned = langid.prototypes(langid.fold(docs).filter("not held_out"))
    found = langid.predict(docs.select(*COLUMNS), learned, COLUMNS)
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of smallest doc_id (null last), and of rows that share it, one.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what
    such pairs link: SimHash fingerprints link the closest, a prefix filter finds the rest. A row's text alone
    decides its group, not its doc_id; null and empty texts are one group.
    """
    prepare(spark)
    return nearcopies.one_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, whatever their ids; null and empty texts hold none and stay.

    An empty benchmark, and items too short to be told from chance, send nothing away.
    """
    prepare(spark)
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows (null text stays null, with null n_chars). No row goes."""
    prepare(spark)
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 4096 tokens.

    A null or empty text is a piece of its end id alone; repeated rows and ids are packed each on their own.
    """
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: No stage but the filters' shells can be told in SQL; tests/llm/test_stages.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
