"""A corpus from documents to token ids: STAGES in order, each over all that the stage before it kept.

Every stage but the last returns the columns of documents, whatever else their names are; n_chars follows
the text. Null and empty texts go with the quality rules, so later stages see none unless they are called
by themselves; then each does with nulls, empty and very long texts, ties, repeated rows and empty tables
what its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covey.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from covey.llm.common import Staged, numbered, place, small_batches, staged, staging


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars counted anew: code points of the text, null for a null text."""
    n_chars, text = (f"c{place(docs, n)}" for n in ("n_chars", "text"))
    rows = numbered(docs)
    return rows.withColumn(n_chars, F.length(text).cast(rows.schema[n_chars].dataType)).toDF(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and lines that fail go from the others."""
    small_batches(spark)
    return _measured(quality_rules.good_documents(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; all documents stay."""
    small_batches(spark)
    return _measured(line_dedup.line_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, that with the smallest id, stays."""
    small_batches(spark)
    return ngram_join.first_of_groups(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text they decode to."""
    small_batches(spark)
    return bpe.digests(docs, bpe.tokenizer_path())


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_join", near_copies), ("mixing", mix), ("bpe", tokens)]
#: BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = Staged()  # the table that the next stage reads
    for name, stage in STAGES[:-1]:
        done, last = last, Staged()
        with staging() as held:  # what the stage stages itself
            docs = staged(stage(spark, docs, sf_dir), name, last)
        held.delete(spark)
        done.delete(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
