"""Incremental degree counting over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_degrees(edges: DataFrame) -> DataFrame:
    """node and degree of a streaming DataFrame (source, target); write it in complete or update mode. The state holds a row for each node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))
