"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document of a source is expected in the mix target / source_size times. The expected copies are
summed along the source, one random offset is added, and a copy is emitted for each whole number that
the running sum crosses. Documents run from large to small, so that what is taken differs from the
target by less than the largest document. The prefix sum is exact and needs no task that sees a whole
source: rows are counted by (source, size, digest prefix), the counts are summed over the prefixes of a
size (in two levels) and the sizes of a source, and only rows of one such leaf are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covey.llm.common import WORDS, documents, numbered, own, place, staged

#: Fixed by the contract: weights of the sources in order, the share of all sizes mixed, copies at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = "mix-1"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and text of docs, its columns as numbered() has them, and what the prefix sums need."""
    rows = numbered(docs)
    rows = rows.select("*", *[F.col(f"c{place(docs, n)}").alias(n) for n in ("doc_id", "source", "text")])
    return (
        rows.withColumn("__key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~")))
        .withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
        .withColumn("__hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))
        .withColumn("__leaf", F.substring("__hash", 1, 3))
        .drop("text")
    )


def _uniform(name: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), name)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def targets(leaves: DataFrame) -> DataFrame:
    """One row for each source: __key, source_size, target and the offset of its sample.

    leaves: counts by __key and __size. Sources are ranked by code point, null last; the level of the
    targets is where the caps and weights together take up the share.
    """
    sums = leaves.groupBy("__key").agg(F.sum(F.col("__size") * F.col("n")).cast("double").alias("size"))
    order = W.orderBy(F.col("__key") == "~", "__key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    table = sums.withColumn("w", weight).withColumn("cap", F.col("size") * MOST).withColumn("ratio", F.col("cap") / F.col("w"))
    upto, whole = W.orderBy("ratio", "__key").rowsBetween(W.unboundedPreceding, 0), W.orderBy("ratio", "__key").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = table.select("*", F.sum("cap").over(upto).alias("caps"), F.sum("w").over(upto).alias("ws"), F.sum("w").over(whole).alias("all_w"), (F.sum("size").over(whole) * SHARE).alias("share"))
    table = table.withColumn("full", F.col("caps") + F.col("ratio") * (F.col("all_w") - F.col("ws")) <= F.col("share"))
    level = (F.col("share") - F.sum(F.expr("if(full, cap, 0D)")).over(whole)) / F.nullif(F.sum(F.expr("if(full, 0D, w)")).over(whole), F.lit(0.0))
    table = table.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")))
    return table.select("__key", F.col("size").cast("long").alias("source_size"), "target", _uniform(F.col("__key")).alias("offset"))


def mix(rows: DataFrame) -> DataFrame:
    """rows of sized(), with source_size, target and copies added; all rows stay.

    copies says how often the mix takes the row, MOST times at most.
    Nulls: a null source is a source of its own, ranked last; a null text has size 0; a null doc_id takes
    its place by text. Empty texts: size 0, no copies. A source of size 0 has target 0. Very long texts:
    counted whole. Ties in size: by MD5 of doc_id, then doc_id; repeated rows take neighbouring places and
    may get different copies. Empty table: empty result.
    """
    leaves = rows.groupBy("__key", "__size", "__leaf").agg(F.count("*").alias("n"))
    leaves = staged(leaves, "leaves")
    first = F.substring("__leaf", 1, 1).alias("__first")
    before = W.partitionBy("__key", "__size", "__first").orderBy("__leaf").rowsBetween(W.unboundedPreceding, -1)
    lower = W.partitionBy("__key", "__size").orderBy("__first").rowsBetween(W.unboundedPreceding, -1)
    larger = W.partitionBy("__key").orderBy(F.desc("__size")).rowsBetween(W.unboundedPreceding, -1)
    sizes = leaves.groupBy("__key", "__size").agg(F.sum("n").alias("n"))
    sizes = sizes.select("__key", "__size", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("start"))
    firsts = leaves.groupBy("__key", "__size", first).agg(F.sum("n").alias("n"))
    firsts = firsts.select("__key", "__size", "__first", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("under"))
    starts = leaves.select("*", first).withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.join(firsts, ["__key", "__size", "__first"]).join(sizes, ["__key", "__size"]).join(targets(leaves), "__key")
    starts = starts.select("__key", "__size", "__leaf", (F.col("start") + F.col("under") + F.col("inside")).alias("__start"), "source_size", "target", "offset")
    rank = F.row_number().over(W.partitionBy("__key", "__size", "__leaf").orderBy("__hash", "doc_id")) - 1
    joined = rows.withColumn("__at", rank).join(starts, ["__key", "__size", "__leaf"])
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    k = F.col("__start") + F.col("__at")
    copies = F.floor((k + 1) * rate + F.col("offset")) - F.floor(k * rate + F.col("offset"))
    return joined.withColumn("copies", F.when(F.col("__size") == 0, F.lit(0)).otherwise(F.least(copies, F.lit(int(MOST)))).cast("long"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    out = mix(sized(docs)).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def op3_mixing(spark, sf_dir):
    docs = own(documents(spark, sf_dir), "doc_id", "source", "text")
    rows = staged(sized(docs).drop("c0", "c1", "c2"), "sized")
    return mix(rows).select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT coalesce('s' || source, '~') AS k, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k = '~', k) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
c AS (SELECT *, sum(cap) OVER (ORDER BY ratio, k ROWS UNBOUNDED PRECEDING) AS caps, sum(w) OVER (ORDER BY ratio, k ROWS UNBOUNDED PRECEDING) AS ws, sum(w) OVER () AS all_w, sum(size) OVER () * 1.5::DOUBLE AS share FROM r),
f AS (SELECT *, caps + ratio * (all_w - ws) <= share AS is_full FROM c),
t AS (SELECT k, CAST(size AS BIGINT) AS source_size, CASE WHEN is_full THEN cap ELSE (share - sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE w END) OVER (), 0) * w END AS target, ('0x' || substr(md5('mix-1|' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, coalesce(t.target / nullif(t.source_size, 0), 0.0::DOUBLE) AS rate, row_number() OVER (PARTITION BY t.k ORDER BY d.size DESC, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1 AS i FROM d JOIN t ON t.k = coalesce('s' || d.source, '~'))
SELECT doc_id, size, source_size, target, CAST(size * (floor((i + 1) * rate + u) - floor(i * rate + u)) AS BIGINT) AS taken FROM p
"""
