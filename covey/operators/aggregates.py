"""Curves, grids and summaries over pair tables."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covey.session import checkpointed


#: Buckets that a range of values is cut into in one round of a search for a rank.
BUCKETS = 4096


def quantiles(rows: DataFrame, value: str, at: list[float], key: str | None = None) -> dict:
    """For each value of `key` (few; None without one) the exact quantiles `at` of a numeric column, linear between ranks; nulls and NaN are left out.

    A search by counting: a pass counts the values of a range by bucket, and the bucket that holds the rank is
    the next range, until all its values are one or the rank is at an end of it. Of a pass a row for
    each bucket in use comes to the driver; no task holds the values of a group.
    """
    number = F.col(value).cast("double")
    known = checkpointed(rows.select(F.col(key).alias("k") if key else F.lit(0).alias("k"), number.alias("v")).where("v IS NOT NULL AND NOT isnan(v)"))
    spread = {r["k"]: (r["n"], r["low"], r["high"]) for r in known.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}  # few keys
    ranks = {(k, r) for k, (n, _, _) in spread.items() for q in at for r in (floor(q * (n - 1)), ceil(q * (n - 1)))}
    found, left = {}, {}
    for k, r in ranks:
        left[k, r] = (*spread[k], r)
    while left:
        for name, (n, low, high, rank) in list(left.items()):
            if low == high or rank in (0, n - 1):
                found[name] = low if rank == 0 or low == high else high
                del left[name]
        if not left:
            break
        ranges = sorted({(k, low, high) for (k, _), (_, low, high, _) in left.items()}, key=str)
        table = F.broadcast(rows.sparkSession.createDataFrame(ranges, f"rk {known.schema['k'].dataType.simpleString()}, low double, high double"))  # a row for each rank sought
        met = known.join(table, (F.col("k") == F.col("rk")) & F.col("v").between(F.col("low"), F.col("high")))
        place = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        counts: dict[tuple, list] = {}
        for r in met.groupBy("k", "low", "high", F.least(F.floor(place * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
            counts.setdefault((r["k"], r["low"], r["high"]), []).append((r["bucket"], r["n"], r["a"], r["b"]))
        for (k, r), (_, low, high, rank) in left.items():
            for _, n, a, b in sorted(counts[k, low, high]):
                if rank < n:
                    left[k, r] = (n, a, b, rank)
                    break
                rank -= n
    out = {}
    for k, (n, _, _) in spread.items():
        places = [q * (n - 1) for q in at]
        out[k] = [found[k, floor(p)] + (found[k, ceil(p)] - found[k, floor(p)]) * (p - floor(p)) for p in places]
    return out


def _literals(values: list[float] | None, n: int) -> list[Column]:
    return [F.lit(v).cast("double") for v in (values or [None] * n)]


def by_level(pairs: DataFrame, level: Column, value: str = "cosine") -> DataFrame:
    """level, mean, std (0 for one row), n (rows without a value count), sem, ci95."""
    known = F.when(~F.isnan(value), F.col(value))
    out = pairs.groupBy(level.alias("level")).agg(F.avg(known).alias("mean"), F.coalesce(F.stddev_samp(known), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    return out.withColumn("sem", F.col("std") / F.sqrt("n")).withColumn("ci95", 1.96 * F.col("sem"))


def fixed_bins(pairs: DataFrame, bin_of: Column, n: int, value: str = "cosine") -> DataFrame:
    """Mean value in each of the bins 0..n; null where a bin is empty."""
    spine = pairs.sparkSession.range(n + 1).select(F.col("id").alias("bin"))
    return spine.join(pairs.groupBy(bin_of.cast("long").alias("bin")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")), "bin", "left").fillna(0, ["n"])


def rint_bin(column: str, most: int) -> Column:
    """Nearest whole number, halves to the even one, clipped to 0..most."""
    return F.greatest(F.lit(0.0), F.least(F.rint(column), F.lit(float(most)))).cast("long")


def distribution(pairs: DataFrame, raw: str, eff: str) -> DataFrame:
    """One row over the pairs that share a pack: spread of both counts, share reduced, share exactly 1."""
    p, cols = pairs.where(F.col(raw) >= 1), []
    for c in (raw, eff):
        q1, median, q3 = _literals(quantiles(p, c, [0.25, 0.5, 0.75]).get(0), 3)
        cols += [F.avg(c).alias(f"{c}_mean"), median.alias(f"{c}_median"), q1.alias(f"{c}_q1"), q3.alias(f"{c}_q3"), (q3 - q1).alias(f"{c}_iqr")]
    return p.agg(F.count("*").alias("pairs"), *cols, F.avg((F.col(eff) < F.col(raw) - 1e-9).cast("double")).alias("reduced"), F.avg((F.abs(F.col(eff) - 1) < 1e-9).cast("double")).alias("ones"))


def ratio_by_count(pairs: DataFrame, raw: str, eff: str, most: int = 8) -> DataFrame:
    """For each count 1..most: pairs, mean of eff, and its ratio to the count; null where there are no pairs."""
    spine = pairs.sparkSession.range(1, most + 1).select(F.col("id").alias("level"))
    found = pairs.where(F.col(raw).between(1, most)).groupBy(F.col(raw).cast("long").alias("level")).agg(F.count("*").alias("n"), F.avg(eff).alias("mean"))
    return spine.join(found, "level", "left").fillna(0, ["n"]).withColumn("ratio", F.col("mean") / F.col("level"))


def stratum(column: str = "n_eff") -> Column:
    return F.when(F.col(column) < 1, "<1").when(F.col(column) <= 3, "1-3").otherwise(">3")


def cells(pairs: DataFrame, max_hops: int, value: str = "cosine") -> DataFrame:
    """Count and mean for every stratum and hop, empty cells included."""
    spark = pairs.sparkSession
    spine = spark.createDataFrame([(s, h) for s in ("<1", "1-3", ">3") for h in range(1, max_hops + 2)], "stratum string, hops long")
    found = pairs.groupBy(stratum().alias("stratum"), "hops").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return spine.join(found, ["stratum", "hops"], "left").fillna(0, ["n"])


def cell_diagnostic(pairs: DataFrame) -> DataFrame:
    """For each cell: pairs, distinct users over both ends, most pairs of one user, and its share."""
    ends = pairs.select(stratum().alias("stratum"), "hops", F.explode(F.array("user_a", "user_b")).alias("user"))
    users = ends.groupBy("stratum", "hops", "user").agg(F.count("*").alias("k"))
    out = users.groupBy("stratum", "hops").agg((F.sum("k") / 2).cast("long").alias("n"), F.count("*").alias("users"), F.max("k").alias("most"))
    return out.withColumn("share", F.col("most") / F.col("n"))


def quantile_curve(pairs: DataFrame, x: str, y: str, n_edges: int = 11, least: int = 30) -> DataFrame:
    """Median x and mean y in bins between distinct quantiles of x, where a bin has rows enough."""
    edges = list(dict.fromkeys(quantiles(pairs, x, [k / (n_edges - 1) for k in range(n_edges)]).get(0, [])))
    at = F.lit(-1) + sum(((F.col(x) >= e).cast("int") for e in edges), F.lit(0))
    binned = pairs.withColumn("bin", F.greatest(F.lit(0), F.least(at, F.lit(len(edges) - 2))).cast("long"))
    medians = [(int(k), q[0]) for k, q in quantiles(binned, x, [0.5], "bin").items()]
    table = F.broadcast(pairs.sparkSession.createDataFrame(medians, "bin long, x double"))  # a row for each bin
    return binned.groupBy("bin").agg(F.avg(y).alias("y"), F.count("*").alias("n")).where(F.col("n") >= least).join(table, "bin").select("bin", "x", "y", "n")


def log_bin(x: Column, per_decade: int) -> Column:
    """Index of the right-closed bin of x > 0 on a log scale."""
    return F.ceil(F.log10(x) * per_decade - 1e-9).cast("long")


def log_curve(rows: DataFrame, x: str, y: str, per_decade: int = 4) -> DataFrame:
    return rows.where(F.col(x) > 0).groupBy(log_bin(F.col(x), per_decade).alias("bin")).agg(F.avg(y).alias("mean"), F.count("*").alias("n"))


def heatmap(rows: DataFrame, x: str, y: str, value: str, per_decade: int = 2) -> DataFrame:
    return rows.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(log_bin(F.col(x), per_decade).alias("bin_x"), log_bin(F.col(y), per_decade).alias("bin_y")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def log_histogram(rows: DataFrame, x: str, per_decade: int = 4) -> DataFrame:
    """Density of x > 0 in log bins: count / (n * width)."""
    own = rows.where(F.col(x) > 0)
    n = F.broadcast(own.agg(F.count("*").alias("all")))  # one row
    k = F.col("bin")
    width = F.pow(F.lit(10.0), k / per_decade) - F.pow(F.lit(10.0), (k - 1) / per_decade)
    return own.groupBy(log_bin(F.col(x), per_decade).alias("bin")).agg(F.count("*").alias("n")).crossJoin(n).select("bin", "n", (F.col("n") / (F.col("all") * width)).alias("density"))


def linear_histogram(rows: DataFrame, x: str, width: float) -> DataFrame:
    """Count and density of x in bins [k * width, (k + 1) * width)."""
    own = rows.where(F.col(x).isNotNull())
    n = F.broadcast(own.agg(F.count("*").alias("all")))  # one row
    return own.groupBy(F.floor(F.col(x) / width).cast("long").alias("bin")).agg(F.count("*").alias("n")).crossJoin(n).select("bin", "n", (F.col("n") / (F.col("all") * width)).alias("density"))


def ccdf(rows: DataFrame, x: str) -> DataFrame:
    """Share of the positive values that are at least as large, for each distinct value: values are counted, dealt out by ranges and summed up within them."""
    counts = rows.where(F.col(x) > 0).groupBy(F.col(x).alias("x")).agg(F.count("*").alias("k"))
    dealt = checkpointed(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(F.sum("k").alias("k"))  # a row for each range of values
    starts = F.broadcast(parts.select("part", before(W.orderBy("part")).alias("start"), F.sum("k").over(W.partitionBy()).alias("n")))
    below = F.col("start") + before(W.partitionBy("part").orderBy("x"))
    return dealt.join(starts, "part").select("x", (1 - below / F.col("n")).alias("ccdf"))


def pivot_counts(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs by shared packs (rows) and rounded n_eff (columns b0..b<most>), zeros filled in."""
    binned = pairs.select(F.least("shared_packs", F.lit(most)).alias("s"), F.concat(F.lit("b"), rint_bin("n_eff", most).cast("string")).alias("bin"))
    return binned.groupBy("s").pivot("bin", [f"b{k}" for k in range(most + 1)]).count().fillna(0)


def degree_populations(populations: dict[str, DataFrame], degrees: DataFrame) -> DataFrame:
    """Median, mean and number of the degrees of the ends of each population's pairs; ends are not made distinct.

    A population is its pairs (user_a, user_b), or how many of them each of its users is an end of (node, n). Ends are
    counted by user before they meet their degrees, and by degree before a row for each distinct degree comes to the driver.
    """
    out = None
    for name, pairs in populations.items():
        one = pairs if "node" in pairs.columns else pairs.select(F.explode(F.array("user_a", "user_b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        one = one.select(F.lit(name).alias("population"), "node", "n")
        out = one if out is None else out.union(one)
    counts: dict[str, list[tuple]] = {}
    for r in out.join(degrees, "node").where("degree IS NOT NULL").groupBy("population", "degree").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["population"], []).append((r["degree"], r["n"]))
    rows = []
    for name, own in counts.items():
        own.sort()
        n, upto = sum(k for _, k in own), 0
        middle = {}
        for degree, k in own:
            for rank in ((n - 1) // 2, n // 2):
                if upto <= rank < upto + k:
                    middle[rank] = degree
            upto += k
        rows.append((name, sum(middle[rank] for rank in ((n - 1) // 2, n // 2)) / 2, sum(d * k for d, k in own) / n, n))
    return degrees.sparkSession.createDataFrame(rows, "population string, median double, mean double, n long")


def median_order(summary: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row: whether the medians of degree_populations() rise strictly in this order."""
    medians = [F.max(F.when(F.col("population") == p, F.col("median"))) for p in order]
    rising = F.lit(True)
    for a, b in zip(medians, medians[1:], strict=False):
        rising = rising & (a < b)
    return summary.agg(*[m.alias(p) for m, p in zip(medians, order, strict=True)], F.coalesce(rising, F.lit(False)).alias("rising"))


def swing(curves: DataFrame, setting: str) -> DataFrame:
    """For each level, over the settings: smallest, largest and mean, relative spread (largest - smallest) / mean, and how many settings there are. curves: setting, level, mean."""
    sums = curves.groupBy("level").agg(F.countDistinct(setting).alias("settings"), F.min("mean").alias("low"), F.max("mean").alias("high"), F.avg("mean").alias("mean"))
    return sums.withColumn("spread", F.try_divide(F.col("high") - F.col("low"), F.col("mean")))


def monotone(curves: DataFrame, setting: str) -> DataFrame:
    """For each setting: levels, whether the mean rises strictly with the level, and the largest step down (0 if there is none)."""
    before = F.lag("mean").over(W.partitionBy(setting).orderBy("level"))
    steps = curves.withColumn("step", F.col("mean") - before)
    return steps.groupBy(setting).agg(F.count("*").alias("levels"), F.coalesce(F.min("step") > 0, F.lit(True)).alias("rising"), F.greatest(F.lit(0.0), F.coalesce(-F.min("step"), F.lit(0.0))).alias("down"))


def delta_ratio(curve: DataFrame, reference: DataFrame) -> DataFrame:
    """curve and reference: level, mean. Difference and ratio at each level, and whether the curve has risen since the level before."""
    both = curve.select("level", "mean").join(reference.select("level", F.col("mean").alias("matched")), "level")
    before = F.lag("mean").over(W.orderBy("level"))
    return both.select("level", "mean", "matched", (F.col("mean") - F.col("matched")).alias("delta"), F.try_divide("mean", "matched").alias("ratio"), F.coalesce(F.col("mean") > before, F.lit(False)).alias("rising"))


def invariants(pairs: DataFrame, max_hops: int) -> DataFrame:
    """One row of violations: all but `pairs` and `sentinels` must be 0."""
    n = lambda c: F.count_if(F.expr(c))
    return pairs.agg(
        F.count("*").alias("pairs"), n("n_eff > shared_packs + 1e-9").alias("above_count"), n("shared_packs >= 1 AND n_eff < 1 - 1e-9").alias("below_one"), n("(shared_packs = 0) <> (n_eff = 0)").alias("zero_mismatch"),
        n(f"hops < 1 OR hops > {max_hops + 1}").alias("bad_hops"), n("cosine IS NULL OR isnan(cosine)").alias("no_cosine"), n("user_a >= user_b").alias("unordered"), n(f"hops = {max_hops + 1}").alias("sentinels"),
    )


def first_crossing(curve: DataFrame) -> DataFrame:
    """One row: the smallest level where mean >= matched, or null."""
    return curve.agg(F.min(F.when(F.col("mean") >= F.col("matched"), F.col("level"))).alias("crossing"))


def viable_grid(pairs: DataFrame, least: int = 100, share: float = 0.6) -> DataFrame:
    """One row: occupied fine cells (level and hops), those with rows enough, and which grid to use."""
    found = pairs.groupBy("shared_packs", "hops").agg(F.count("*").alias("n"))
    return found.agg(F.count("*").alias("cells"), F.count_if(F.col("n") >= least).alias("viable")).withColumn("grid", F.when(F.col("viable") < share * F.col("cells"), "coarse").otherwise("fine"))
