"""Operators on edge lists (source, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covey.operators.aggregates import quantiles
from covey.session import checkpointed


def induced(edges: DataFrame, nodes: DataFrame, either: bool = False) -> DataFrame:
    """Edges with both ends in nodes (column node), or with at least one."""
    nodes = nodes.select("node").distinct()
    if not either:
        return edges.join(nodes, edges.source == nodes.node, "left_semi").join(nodes, F.col("target") == nodes.node, "left_semi")
    a, b = nodes.withColumnRenamed("node", "__a"), nodes.withColumnRenamed("node", "__b")
    return edges.join(a, edges.source == a["__a"], "left").join(b, F.col("target") == b["__b"], "left").where("__a IS NOT NULL OR __b IS NOT NULL").drop("__a", "__b")


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of nodes."""
    nodes = nodes.select("node").distinct()
    return edges.join(nodes, edges.source == nodes.node, "left_anti").join(nodes, F.col("target") == nodes.node, "left_anti")


def dropped_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, those that touch a node of nodes (dropped), and those left."""
    left = without(edges, nodes).agg(F.count("*").alias("kept"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(left).select("edges", (F.col("edges") - F.col("kept")).alias("dropped"), "kept")  # one row each


def total_degrees(edges: DataFrame) -> DataFrame:
    """node and degree; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def capped(edges: DataFrame, most: int) -> DataFrame:
    """Edges without the nodes of more than `most` ends, in one pass."""
    return without(edges, total_degrees(edges).where(F.col("degree") > most))


def deduped(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source", "target"])


def reciprocal(edges: DataFrame) -> DataFrame:
    """Distinct edges whose reverse is there too; a loop is its own reverse."""
    e = edges.select("source", "target").distinct()
    back = e.select(F.col("target").alias("s"), F.col("source").alias("t"))
    return e.join(back, (e.source == back.s) & (e.target == back.t), "left_semi")


def core(edges: DataFrame, least: int, rounds: int | None = None) -> DataFrame:
    """Edges left when nodes of fewer than `least` ends are taken away until none is left, or for so many rounds."""
    count, k = None, 0
    while rounds is None or k < rounds:
        edges = without(edges, total_degrees(edges).where(F.col("degree") < least))
        k += 1
        if rounds is None:
            edges = checkpointed(edges)
            now = edges.count()
            if now == count:
                break
            count = now
    return edges


def degree_table(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree over the union of both ends."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"))
    both = out.join(into, "node", "full").fillna(0, ["out_degree", "in_degree"])
    return both.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_report(edges: DataFrame, top: int = 20) -> DataFrame:
    """The nodes of most ends, with the share of all ends that the table holds down to each."""
    from pyspark.sql import Window as W

    degrees = degree_table(edges)
    ends = F.broadcast(degrees.agg(F.sum("degree").alias("ends")))  # one row
    first = degrees.orderBy(F.desc("degree"), "node").limit(top)
    running = F.sum("degree").over(W.orderBy(F.desc("degree"), "node").rowsBetween(W.unboundedPreceding, 0))
    return first.crossJoin(ends).select("node", "out_degree", "in_degree", "degree", (running / F.col("ends")).alias("concentration"))


def degree_quantiles(edges: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999, 1.0), over: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """One row: quantiles of the degree, and how many nodes have more than each of `over`."""
    degrees = checkpointed(degree_table(edges))
    found = quantiles(degrees, "degree", list(at)).get(0, [None] * len(at))
    names: list[Column] = [F.lit(v).cast("double").alias(f"q{q:g}".replace(".", "_")) for q, v in zip(at, found, strict=True)]
    return degrees.agg(F.count("*").alias("nodes"), *names, *[F.count_if(F.col("degree") > k).alias(f"over_{k}") for k in over])
