"""Exact dedup as a log-structured merge index over digests; DataFrame functions only.

Each scan task is a memtable: it flushes one run of (digest, doc_id, row) entries, sorted by digest.
Compaction merges runs, and levels that came of earlier ones, into one level sorted by digest that keeps
the smallest identifier of each digest and the number of its rows. Digests with more than one row are
hits. A Bloom filter over the identifiers of hits is asked before any text leaves its scan task, so only
texts of hits (and the few that pass wrongly) are shuffled; they are compared byte for byte, and a
digest that stands for more than one text is split by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covey.llm.common import SPACES, Filter, documents, own, staged, text_of

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def flush(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """The sorted runs: one entry (digest, text_sha256, doc_id, row) for each row of docs."""
    norm = own(docs, "doc_id", "text").select("doc_id", normalised(text_of()).alias("norm"))
    weak = [] if digest is sha256 else [digest(F.col("norm")).alias("digest")]
    entries = norm.select("doc_id", sha256(F.col("norm")).alias("text_sha256"), *weak, F.monotonically_increasing_id().alias("row"))
    runs = staged(entries.sortWithinPartitions("digest" if weak else "text_sha256", "doc_id"), "runs")
    return runs if weak else runs.withColumn("digest", F.col("text_sha256"))


def _first() -> Column:
    """Smallest doc_id, nulls after all others; among equal ones the first row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")


def compact(runs: DataFrame, *levels: DataFrame) -> DataFrame:
    """Runs and older levels merged into one level: digest, the first entry that has it, and the number of entries.

    A run is reduced to one entry for each digest before it leaves its task, so a digest with very many
    rows costs the merge one row for each run.
    """
    merged = runs.groupBy("digest").agg(_first(), F.count("*").alias("group_size"))
    if levels:
        for older in levels:
            merged = merged.unionByName(older)
        merged = merged.groupBy("digest").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
    return staged(merged.sortWithinPartitions("digest"), "level")


def hit_texts(docs: DataFrame, runs: DataFrame, level: DataFrame, digest: Digest) -> DataFrame:
    """Digest and normalised text of the rows whose digest has been seen more than once."""
    hits = runs.join(level.where("group_size > 1").select("digest"), "digest", "left_semi")
    ids = staged(hits.select(F.col("doc_id").alias("hit_id")).distinct(), "hits")
    asked = Filter(ids.select(F.xxhash64("hit_id").alias("h"))).asked(own(docs, "doc_id", "text"), F.xxhash64("doc_id"), "maybe")
    rows = asked.where("maybe").join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    norm = rows.select("doc_id", normalised(text_of()).alias("norm"))
    return norm.withColumn("digest", digest(F.col("norm")))


def exact_dedup(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Nulls and empty texts: equal to each other; a null doc_id comes after all others. Very long texts:
    digested and compared whole. Ties and repeated rows: rows of one doc_id and text belong to one group,
    of which exactly one row is kept. Empty table: empty result. Other columns are ignored, whatever
    their names. docs is read twice and must give the same texts each time.
    """
    runs = flush(docs, digest)
    level = compact(runs)
    hits = hit_texts(docs, runs, level, digest)
    seen = hits.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("mixed"))
    mixed = staged(seen.where("mixed").select("digest"), "mixed")
    plain, split = runs, None
    if not mixed.isEmpty():  # digests that stand for several texts
        plain = runs.join(mixed, "digest", "left_anti")
        rows = hits.join(mixed, "digest", "left_semi").select("doc_id", "norm", F.monotonically_increasing_id().alias("row"))
        rows = staged(rows, "mixed_rows")
        groups = rows.groupBy("norm").agg(_first(), F.count("*").alias("group_size"))
        split = rows.join(groups, "norm").withColumn("text_sha256", sha256(F.col("norm")))
    out = _answer(plain.join(level, "digest"))
    return out if split is None else out.unionByName(_answer(split))


def _answer(joined: DataFrame) -> DataFrame:
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM n JOIN g USING (text_sha256)
"""
