"""A training-data pipeline over ``documents``: quality rules, near-duplicate
removal, removal of repeated passages, redaction of personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  Each works on everything that the
one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofreq.llm import jaccard_join, line_crf, packing, pii, repeats
from cofreq.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the base rules or the line field reject go."""
    return line_crf.keep_good(docs, line_crf.fit_from_labels(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: five-word shingles, similarity 0.8; one of each group stays."""
    return jaccard_join.keep_first(docs, 5, 80, 100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: repeated 200-byte strings go; so do documents of which
    nothing but blanks is left."""
    left = repeats.strip(docs, repeats.repeated_spans(docs))
    return left.where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("bigint"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: spans are replaced by the name of their kind."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("personal_data", personal_data), ("packing", pack)]

# models fitted on the data and suffix arrays have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
