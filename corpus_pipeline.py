"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents; the last returns a row
per packed piece. run() stores each stage's result in the shared folder, so a
lost executor never sends the work back beyond the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import stage, table
from tessella.llm.decontaminate import drop_leaks
from tessella.llm.minhash import keep_one
from tessella.llm.packing import pack_documents
from tessella.llm.quality import keep_good
from tessella.llm.secrets import redact_secrets


#: Whole texts that Spark hands to a Python worker at once; its default of 10,000 takes too much memory for long ones.
BATCH_ROWS = "1000"


def _bounded(spark: SparkSession) -> None:
    """A stage's result is computed when its caller writes it, so the bound is set on the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and trees reject go.

    A null or empty text goes, as it has no words; repeated rows stay or go
    together, whatever their doc_id. An empty table stays empty.
    """
    _bounded(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8) stays: the one of least doc_id.

    A text without words is like no other and stays. Rows of one doc_id are one
    document; of equal rows one stays. A row with a null doc_id cannot be named and stays.
    """
    _bounded(spark)
    return keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none and stays; repeated rows stay or go together, as do
    rows with a null doc_id. Null or empty items match nothing.
    """
    _bounded(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), whole=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts and repeated rows as they are."""
    _bounded(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids, packed into sequences; executors that four stages have filled have less room for the encoder's cache.

    A null or empty text is its end id alone; rows with a null or repeated doc_id are packed like any others.
    """
    _bounded(spark)
    return pack_documents(docs, cache_entries=200_000)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: Trees, signatures and a network take part: not for SQL. tests/llm/test_leaks_lm_pipeline.py checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _bounded(spark)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
