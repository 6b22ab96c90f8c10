"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(least.toDF("a", "b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: long columns a and b. Returns node and root, the smallest node of its component, for nodes other than roots.

    Every round is written to the shared checkpoint folder. Minima are combined before each shuffle, so a
    node with very many links costs no more than its rows.
    """
    state, e = None, cut(links.where("a <> b").distinct())
    while True:
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return e.toDF("node", "root")
        state = tuple(now)
