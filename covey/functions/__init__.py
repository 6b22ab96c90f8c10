"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw_key(seed: int, *columns: str) -> Column:
    """A fixed pseudo-random order of rows: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def draw_int(key: Column) -> Column:
    """A uniform integer below 2 ** 32 from an MD5."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def unordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def dot(a: str, b: str) -> Column:
    """Inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ranked_by_draw(rows: DataFrame, keys: list[str], draw: Column, order: list[str], name: str) -> DataFrame:
    """rows with their place, 0, 1, ..., among those of equal keys, by the MD5 `draw` and then by order.

    Rows are counted by keys and the first digits of the draw (4,096 counts for a value at most), the counts
    are summed up, and rows are ranked only among those of equal first digits: no task sees all of a value.
    """
    own = rows.withColumn("__draw", draw).withColumn("__first", F.substring("__draw", 1, 3))
    counts = own.groupBy(*keys, "__first").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "__first", before.alias("__start"))
    rank = F.row_number().over(W.partitionBy(*keys, "__first").orderBy("__draw", *order)) - 1
    return own.withColumn("__rank", rank).join(starts, [*keys, "__first"]).withColumn(name, F.col("__start") + F.col("__rank")).drop("__draw", "__first", "__start", "__rank")


def places(rows: DataFrame, key: str) -> DataFrame:
    """The distinct values of key, and place: 0, 1, ... in order of their MD5, by ranked_by_draw()."""
    one = rows.select(key).distinct().withColumn("__all", F.lit(0))
    return ranked_by_draw(one, ["__all"], F.md5(F.col(key).cast("string")), [key], "place").drop("__all")


def first_by_draw(rows: DataFrame, keys: list[str], most: int, order: list[Column], draw: Column) -> DataFrame:
    """Of each value of keys the `most` rows that come first by order, whose first column is the MD5 `draw`.

    Only rows whose MD5 is low enough for about four times `most` of their key are ranked, so that no task
    ranks more than that of a key. (That fewer than `most` of more rows are low has a chance below 1e-20.)
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))  # a row for each value
    limit = F.floor(F.least(F.lit(1.0), (4 * most + 100) / F.col("__n")) * F.lit(float(16**13))).cast("long")
    limits = counts.select(*keys, F.lpad(F.lower(F.hex(limit)), 14, "0").alias("__limit"))
    low = rows.join(F.broadcast(limits), keys).where(F.concat(F.lit("0"), F.substring(draw, 1, 13)) <= F.col("__limit")).drop("__limit")
    ranked = low.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__place") <= most).drop("__place")
