"""Resampling and regression as weighted moments."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from covey.functions import places
from covey.functions.digests import first_bits
from covey.session import checkpointed


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("user_a", "user_b")).alias("user")).distinct()


#: Places of a block of draws, and draws that are hashed at once.
PLACES, HASHED = 4096, 8192


def md5_words(prefix: str, low: int, high: int) -> np.ndarray:
    """The first 32 bits of the MD5 of prefix and k, for k from low to high - 1, all of as many digits (draw_int() of it)."""
    head, digits, k = prefix.encode(), len(str(low)), np.arange(low, high)
    size = len(head) + digits
    if size > 55 or len(str(high - 1)) != digits:
        raise ValueError("one block of MD5, and numbers of as many digits")
    words: list = [0] * 16
    for at, byte in enumerate(head):
        words[at // 4] |= byte << 8 * (at % 4)
    for j in range(digits):
        at = len(head) + j
        words[at // 4] = words[at // 4] | ((k // 10 ** (digits - 1 - j) % 10 + 48) << 8 * (at % 4))
    words[size // 4] = words[size // 4] | (128 << 8 * (size % 4))
    words[14] = 8 * size
    return first_bits(words)


def _draws_of(boots: Iterator[pa.RecordBatch], n: int, seed: int, size: int) -> Iterator[pa.RecordBatch]:
    """For each resample, how often each of n places is drawn: a row of bytes (packed) for each block of places."""
    for boot in (b for batch in boots for b in batch.column(0).to_pylist()):
        counts, low = np.zeros(n, np.uint8), 0
        while low < n:
            high = min(n, low + HASHED, 10 ** len(str(low)))
            np.add.at(counts, md5_words(f"{seed}|{boot}|", low, high) % np.uint32(min(n, 2**32 - 1)), 1)
            low = high
        blocks = range(0, n, size)
        for first in range(0, len(blocks), 1024):
            own = blocks[first : first + 1024]
            packed = [zlib.compress(counts[k : k + size].tobytes(), 1) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array([k // size for k in own], pa.int64()), pa.array([boot] * len(own), pa.int32()), pa.array(packed, pa.binary())], ["block", "boot", "counts"])


def _of_units(batches: Iterator[pa.RecordBatch], n_boot: int, kind: pa.DataType, size: int, packed: bool) -> Iterator[pa.RecordBatch]:
    """Rows by block: its units (at, unit), and then its draws by resample (boot, counts). A row for each unit that is drawn at all."""
    def put() -> Iterator[pa.RecordBatch]:
        order = np.argsort(places)
        there = [k for k in order.tolist() if held[places[k]].any()]
        for lo in range(0, len(there), 1024):
            own = there[lo : lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([units[k] for k in own], kind), pa.array([pack(held[places[k]].tobytes()) for k in own], pa.binary())], ["unit", "drawn"])

    pack = (lambda x: zlib.compress(x, 1)) if packed else bytes
    block, units, places, held = None, [], [], None
    for batch in batches:
        for of, boot, counts, at, unit in zip(*(batch.column(c).to_pylist() for c in ("block", "boot", "counts", "at", "unit")), strict=True):
            if of != block:
                if block is not None:
                    yield from put()
                block, units, places, held = of, [], [], np.zeros((size, n_boot), np.uint8)
            if boot < 0:
                units.append(unit)
                places.append(at)
            else:
                one = np.frombuffer(zlib.decompress(counts), np.uint8)
                held[: len(one), boot] = one
    if block is not None:
        yield from put()


def drawn(units: DataFrame, n_boot: int, seed: int = 42, packed: bool = False) -> DataFrame:
    """unit and drawn: one byte for each of n_boot resamples, how often it takes the unit; on request packed by zlib.

    Each resample draws as many of the distinct units as there are, with replacement, by hash. A unit that
    none takes has no row. No unit is drawn more than 255 times by any chance worth counting. A task draws a
    whole resample, in a byte for each unit, and sends counts on for each block of places, not draws.
    """
    spark, kind = units.sparkSession, dict(units.dtypes)["unit"]
    ranked = checkpointed(places(units.select("unit"), "unit"))
    n, size = ranked.count(), PLACES
    boots = spark.range(0, n_boot, 1, min(n_boot, max(1, n_boot * n // 2_000_000)))
    counts = boots.mapInArrow(lambda b: _draws_of(b, n, seed, size), "block long, boot int, counts binary")
    block = F.floor(F.col("place") / size).cast("long")
    of = ranked.select(block.alias("block"), F.lit(-1).alias("boot"), F.lit(None).cast("binary").alias("counts"), (F.col("place") % size).cast("int").alias("at"), "unit")
    rows = of.union(counts.select("block", "boot", "counts", F.lit(None).cast("int"), F.lit(None).cast(kind)))
    arrow = to_arrow_schema(units.select("unit").schema).field("unit").type
    return rows.repartition("block").sortWithinPartitions("block", "boot").mapInArrow(lambda b: _of_units(b, n_boot, arrow, size, packed), f"unit {kind}, drawn binary")


def _products(batches: Iterator[pa.RecordBatch], keys: list[str], sums: list[str], n_boot: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums of the columns, weighted by the product of the draws of both ends, for each key and resample."""
    found: dict[tuple, np.ndarray] = {}
    for whole in batches:
        for a in range(0, whole.num_rows, 2048):
            batch = whole.slice(a, 2048)
            drawn_of = lambda name: np.frombuffer(b"".join(map(zlib.decompress, batch.column(name).to_pylist())), np.uint8).reshape(-1, n_boot)  # noqa: E731, B023
            weights = drawn_of("drawn_a").astype(float)
            if "drawn_b" in batch.schema.names:
                weights *= drawn_of("drawn_b")
            x = np.stack([np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in sums], axis=1)
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            for key in dict.fromkeys(of):
                own = np.array([k == key for k in of])
                found[key] = found.get(key, 0) + weights[own].T @ x[own]
    for key, total in found.items():
        columns = [pa.array([k] * n_boot, schema.field(name).type) for k, name in zip(key, keys, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n_boot), pa.int32()), *(pa.array(total[:, i]) for i in range(len(sums)))], schema=schema)


def resampled_sums(rows: DataFrame, sums: dict[str, Column], n_boot: int, seed: int = 42, keys: tuple[str, ...] = (), unit: str | None = None) -> DataFrame:
    """keys, boot and sums over the rows, each row weighted by how often a resample takes it; nulls count as 0.

    The units drawn are the users of pairs (user_a, user_b; a pair weighs the product of its two), or with
    `unit` the values of that column. boot -1 has the sums with all weights 1. keys must be few: each has a
    row for each resample in every task.
    """
    named = [c.cast("double").alias(k) for k, c in sums.items()]
    sides, by, sum_names = [unit] if unit else ["user_a", "user_b"], list(keys), list(sums)
    own = rows.select(*keys, *sides, *named)
    every = own.select(F.explode(F.array(*sides)).alias("unit")).distinct()
    draws = drawn(every, n_boot, seed, packed=True)
    joined = own
    for name, end in zip(("drawn_a", "drawn_b"), sides, strict=False):
        joined = joined.join(draws.select(F.col("unit").alias(end), F.col("drawn").alias(name)), end)
    kinds = dict(rows.dtypes)
    text = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "boot int", *(f"{c} double" for c in sums)])
    schema = to_arrow_schema(StructType.fromDDL(text))
    names = [*keys, *(f"drawn_{x}" for x in "ab"[: len(sides)]), *sums]
    parts = joined.select(*names).mapInArrow(lambda b: _products(b, by, sum_names, n_boot, schema), text)
    total = [F.sum(c).alias(c) for c in sums]
    plain = own.groupBy(*keys).agg(*[F.coalesce(F.sum(F.nanvl(c, F.lit(0.0))), F.lit(0.0)).alias(c) for c in sums])
    return parts.groupBy(*keys, "boot").agg(*total).unionByName(plain.withColumn("boot", F.lit(-1)))


def interval(boots: DataFrame, keys: list[str], value: str, ci: float = 95) -> DataFrame:
    """Percentile interval of a statistic over resamples; nulls are left out."""
    low, high = (100 - ci) / 200, 1 - (100 - ci) / 200
    cols = [F.percentile(value, F.lit(low)).alias("ci_low"), F.percentile(value, F.lit(high)).alias("ci_high")]
    return boots.groupBy(*keys).agg(*cols) if keys else boots.agg(*cols)


def with_interval(stats: DataFrame, keys: list[str], value: str = "stat", name: str = "estimate") -> DataFrame:
    """stats: keys, boot, value. keys, the value of boot -1 as name, ci_low and ci_high over the others."""
    point = stats.where("boot = -1").select(*keys, F.col(value).alias(name))
    ends = interval(stats.where("boot >= 0"), keys, value)
    return point.join(ends, keys, "left") if keys else point.crossJoin(ends)  # one row each


def mean_sums(name: str, value: str, where: str = "true") -> dict[str, Column]:
    """The two sums of a weighted mean, for resampled_sums(); wmean(name) is the mean."""
    cond = F.expr(where) & F.col(value).isNotNull()
    return {f"{name}_w": F.when(cond, 1.0), f"{name}_v": F.when(cond, F.col(value))}


def wmean(name: str) -> Column:
    return F.try_divide(f"{name}_v", F.nullif(f"{name}_w", F.lit(0.0)))


def weighted_mean(value: str, weight: str, where: str = "true") -> Column:
    """Aggregate: the weighted mean, null where the weights add up to 0."""
    cond = F.expr(where) & F.col(value).isNotNull()
    return F.sum(F.when(cond, F.col(weight) * F.col(value))) / F.nullif(F.sum(F.when(cond, F.col(weight))), F.lit(0.0))


def cluster_bootstrap(pairs: DataFrame, level: Column, value: str = "cosine", n_boot: int = 500, seed: int = 42) -> DataFrame:
    """level, mean (plain), n, ci_low, ci_high, err_low, err_high, with users as the units that are drawn."""
    return cell_bootstrap(pairs.withColumn("level", level), ("level",), value, n_boot, seed)


def cell_bootstrap(rows: DataFrame, cells: tuple[str, ...], value: str = "cosine", n_boot: int = 500, seed: int = 42, unit: str | None = None) -> DataFrame:
    """The same for cells of several columns. Without users in the rows, `unit` names a column of row ids that are drawn instead."""
    own = rows.where(F.col(value).isNotNull())
    boots = resampled_sums(own, mean_sums("m", value), n_boot, seed, cells, unit).withColumn("stat", wmean("m"))
    point = rows.groupBy(*cells).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    out = point.join(interval(boots.where("boot >= 0"), list(cells), "stat"), list(cells), "left")
    return out.withColumn("err_low", F.col("mean") - F.col("ci_low")).withColumn("err_high", F.col("ci_high") - F.col("mean"))


def bootstrap_statistics(pairs: DataFrame, sums: dict[str, Column], stats: dict[str, Column], n_boot: int = 500, seed: int = 42, unit: str | None = None) -> DataFrame:
    """term, estimate (all weights 1) and interval of several statistics in one pass. sums: of columns of a row; stats: of these sums."""
    boots = resampled_sums(pairs, sums, n_boot, seed, unit=unit).select("boot", *[c.alias(k) for k, c in stats.items()])
    names = ", ".join(f"'{k}', `{k}`" for k in stats)
    return with_interval(boots.selectExpr("boot", f"stack({len(stats)}, {names}) AS (term, stat)"), ["term"])


def mean_interval(rows: DataFrame, value: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Plain bootstrap of a mean: one row mean, n, ci_low, ci_high; no interval for fewer than two rows. rows: id, value."""
    boots = resampled_sums(rows, mean_sums("m", value), n_boot, seed, unit="id").withColumn("stat", wmean("m"))
    both = rows.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).crossJoin(interval(boots.where("boot >= 0"), [], "stat"))  # one row each
    return both.select("mean", "n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("ci_low", "ci_high")])


def bootstrap_models(pairs: DataFrame, x: str, y: str, by: str, reference: int, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """term, estimate, interval: the slope of y on x without and with a level for each value of `by`, the slope of each value
    (where x spreads), and its difference to the reference's; all from one resampling."""
    sums = {k: v for k, v in zip(("sw", "sx", "sy", "sxx", "sxy", "syy"), _products_of(x, y), strict=True)}
    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = F.broadcast(known.groupBy(by).agg(F.count("*").alias("n"), (F.max(x) > F.min(x)).alias("spread")))  # a row for each level
    boots = centred(resampled_sums(known, sums, n_boot, seed, (by,)).join(spread, by)).withColumn("slope", F.when((F.col("n") >= 2) & F.col("spread"), F.try_divide("cxy", F.nullif("cxx", F.lit(0.0)))))
    whole = centred(boots.groupBy("boot").agg(*[F.sum(c).alias(c) for c in sums]))
    with_levels = boots.groupBy("boot").agg(F.try_divide(F.sum("cxy"), F.nullif(F.sum("cxx"), F.lit(0.0))).alias("stat"))
    each = boots.select("boot", F.concat(F.lit("slope|"), F.col(by).cast("string")).alias("term"), F.col("slope").alias("stat"))
    ref = boots.where(F.col(by) == reference).select("boot", F.col("slope").alias("ref"))
    apart = boots.where(F.col(by) != reference).join(ref, "boot").select("boot", F.concat(F.lit("interaction|"), F.col(by).cast("string")).alias("term"), (F.col("slope") - F.col("ref")).alias("stat"))
    stats = whole.select("boot", F.lit("x|alone").alias("term"), F.try_divide("cxy", F.nullif("cxx", F.lit(0.0))).alias("stat"))
    stats = stats.union(with_levels.select("boot", F.lit("x|with levels"), "stat")).union(each).union(apart)
    return with_interval(stats, ["term"])


def _products_of(x: str, y: str) -> list[Column]:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return [F.lit(1.0), a, b, a * a, a * b, b * b]


def moments(x: str, y: str) -> list[Column]:
    w, a, b = F.col("w"), F.col(x), F.col(y)
    return [F.sum(w).alias("sw"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"), F.sum(w * a * a).alias("sxx"), F.sum(w * a * b).alias("sxy"), F.sum(w * b * b).alias("syy"), F.count("*").alias("n")]


def centred(df: DataFrame) -> DataFrame:
    """cxx, cxy, cyy from the sums of moments()."""
    c = lambda s, a, b: F.col(s) - F.col(a) * F.col(b) / F.nullif(F.col("sw"), F.lit(0.0))
    return df.withColumn("cxx", c("sxx", "sx", "sx")).withColumn("cxy", c("sxy", "sx", "sy")).withColumn("cyy", c("syy", "sy", "sy"))


def slope() -> Column:
    return F.when((F.col("n") >= 2) & (F.col("cxx") > 1e-12), F.col("cxy") / F.nullif(F.col("cxx"), F.lit(0.0)))


def slopes(pairs: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, n, slope, intercept and r2 of least squares in each group; null without spread. Weights in column w, if there."""
    own = pairs if "w" in pairs.columns else pairs.withColumn("w", F.lit(1.0))
    sums = centred(own.groupBy(*keys).agg(*moments(x, y)) if keys else own.agg(*moments(x, y)))
    return sums.withColumn("slope", slope()).select(*keys, "n", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.nullif(F.col("sw"), F.lit(0.0))).alias("intercept"), F.try_divide(F.col("slope") * F.col("cxy"), F.col("cyy")).alias("r2"))


def controlled_slope(pairs: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """One row: the slope of y on x alone, and with a level for each value of control."""
    own = pairs if "w" in pairs.columns else pairs.withColumn("w", F.lit(1.0))
    within = centred(own.groupBy(control).agg(*moments(x, y))).agg(F.try_divide(F.sum("cxy"), F.sum("cxx")).alias("slope_with"))
    return slopes(own, x, y, []).select("n", F.col("slope").alias("slope_without")).crossJoin(within)


def interaction(pairs: DataFrame, x: str, y: str, by: str, reference: int) -> DataFrame:
    """The model y ~ x * C(by): for each level its slope, the difference to the reference's, its standard error, t and degrees of freedom."""
    own = pairs if "w" in pairs.columns else pairs.withColumn("w", F.lit(1.0))
    sums = centred(own.groupBy(by).agg(*moments(x, y))).withColumn("slope", slope()).where("slope IS NOT NULL")
    sums = sums.withColumn("rss", F.col("cyy") - F.col("slope") * F.col("cxy"))
    total = F.broadcast(sums.agg(F.sum("rss").alias("all_rss"), F.sum("n").alias("all_n"), F.count("*").alias("levels")))
    ref = F.broadcast(sums.where(F.col(by) == reference).select(F.col("slope").alias("ref_slope"), F.col("cxx").alias("ref_cxx")))
    sigma2 = F.try_divide(F.col("all_rss"), (F.col("all_n") - 2 * F.col("levels")).cast("double"))
    joined = sums.crossJoin(total).crossJoin(ref)  # a row for each level; one row each
    se = F.when(F.col(by) != reference, F.sqrt(sigma2 * (1 / F.col("cxx") + 1 / F.col("ref_cxx"))))
    df = F.col("all_n") - 2 * F.col("levels")
    return joined.select(by, "n", "slope", (F.col("slope") - F.col("ref_slope")).alias("difference"), se.alias("se"), F.try_divide(F.col("slope") - F.col("ref_slope"), se).alias("t"), df.alias("df"))


def two_predictors(pairs: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """One row: coefficients of y ~ x1 + x2, R2 of it and of x1 alone, and the gain."""
    c = {f"{a}_{b}": F.covar_pop(a, b) for a, b in ((x1, x1), (x1, x2), (x2, x2), (x1, y), (x2, y), (y, y))}
    m = pairs.agg(F.count("*").alias("n"), *[v.alias(k) for k, v in c.items()])
    s11, s12, s22, s1y, s2y, syy = (F.col(f"{a}_{b}") for a, b in ((x1, x1), (x1, x2), (x2, x2), (x1, y), (x2, y), (y, y)))
    det = F.nullif(s11 * s22 - s12 * s12, F.lit(0.0))
    b1, b2 = (s22 * s1y - s12 * s2y) / det, (s11 * s2y - s12 * s1y) / det
    out = m.where("n >= 3").select("n", b1.alias("b1"), b2.alias("b2"), ((b1 * s1y + b2 * s2y) / F.nullif(syy, F.lit(0.0))).alias("r2"), (s1y * s1y / F.nullif(s11 * syy, F.lit(0.0))).alias("r2_one"))
    return out.withColumn("gain", F.col("r2") - F.col("r2_one"))


def _triangles(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The R of a QR decomposition of a task's rows, batch by batch; at most as many rows as columns."""
    r = np.empty((0, len(names)))
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in r.T], names)


def least_squares(rows: DataFrame, xs: list[str], y: str, weight: str | None = None) -> DataFrame:
    """term and estimate of y ~ 1 + xs; of all best solutions, if there are several, that of least length.

    Tall rows are reduced by a tree of QR decompositions: each task's triangle, then triangles of some tasks,
    of which the last come to the driver, a row for each column and task of the second level. Rows are scaled by the root of their weight.
    """
    root = F.lit(1.0) if weight is None else F.sqrt(F.col(weight).cast("double"))
    columns = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    names = [f"c{k}" for k in range(len(columns))]
    known = rows.dropna(subset=[*xs, y, *([weight] if weight else [])])
    schema = ", ".join(f"{c} double" for c in names)
    first = known.select(*[(root * c).alias(n) for c, n in zip(columns, names, strict=True)]).mapInArrow(lambda b: _triangles(b, names), schema)
    groups = max(1, int(np.sqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    last = first.repartition(groups).mapInArrow(lambda b: _triangles(b, names), schema).collect()
    r = np.linalg.qr(np.array(last, float).reshape(-1, len(names)), mode="r")
    k = len(names) - 1
    beta = np.linalg.lstsq(r[:, :k], r[:, k], rcond=1e-13)[0] if len(r) else np.zeros(k)
    return rows.sparkSession.createDataFrame(list(zip(["intercept", *xs], map(float, beta), strict=True)), "term string, estimate double")


def log_link(pairs: DataFrame, x: str, y: str, by: str | None = None, reference: int = 1, families: tuple[str, ...] = ("poisson", "gamma")) -> DataFrame:
    """family, term, estimate, p, n and dispersion of generalised linear models with log link: y ~ x, or y ~ x * C(by).

    Rows alike are counted once for all steps of the fits, and weigh as many as they are.
    Gamma takes y > 0 only. The p are those of quasi-likelihood for the Poisson family (by its dispersion).
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("label"), *([F.col(by).alias("by")] if by else [])).dropna()
    data = checkpointed(data.groupBy(*data.columns).agg(F.count("*").cast("double").alias("w")))  # every step of a fit reads it again
    terms = {x: F.col("x")}
    if by:
        others = sorted(r["by"] for r in data.select("by").distinct().collect() if r["by"] != reference)  # levels
        terms |= {f"{by}[{v}]": (F.col("by") == v).cast("double") for v in others} | {f"{x}:{by}[{v}]": F.col("x") * (F.col("by") == v).cast("double") for v in others}
    names = [f"t{k}" for k in range(len(terms))]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(data.select("label", "w", *[c.alias(n) for n, c in zip(names, terms.values(), strict=True)])).select("label", "w", "features")
    rows = []
    for family in families:
        own = ready.where("label > 0") if family == "gamma" else ready
        fit = GeneralizedLinearRegression(family=family, link="log", maxIter=50, weightCol="w").fit(own)
        n = own.agg(F.sum("w")).first()[0]
        df = float(n - fit.summary.rank)
        left = F.col("label") - F.col("mu")
        spread = fit.setPredictionCol("mu").transform(own).agg(F.sum(F.col("w") * left * left / (F.pow("mu", 2) if family == "gamma" else F.col("mu")))).first()[0] / df
        scale = float(np.sqrt(spread / fit.summary.dispersion))
        for term, estimate, t in zip([*terms, "intercept"], [*fit.coefficients, fit.intercept], fit.summary.tValues, strict=True):
            rows.append((family, term, float(estimate), float(student_p(float(t) / scale, df)), int(n), float(spread)))
    return pairs.sparkSession.createDataFrame(rows, "family string, term string, estimate double, p double, n long, dispersion double")


def log_link_scores(pairs: DataFrame, models: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """family, term, score, n: the score equations of log_link()'s models at their estimates, per row; at a maximum every score is 0.

    A predictor's score is the mean of (y - mu) times it over the rows, in the Gamma family of (y - mu) / mu times it.
    """
    out = None
    for family in sorted(r["family"] for r in models.select("family").distinct().collect()):  # two
        fit = {r["term"]: r["estimate"] for r in models.where(F.col("family") == family).collect()}  # terms
        values = {"intercept": F.lit(1.0), x: F.col(x).cast("double")}
        for term in fit:
            if term not in values:
                level = (F.col(by).cast("string") == term.split("[")[1][:-1]).cast("double")
                values[term] = level * F.col(x) if ":" in term else level
        mu = F.exp(sum((F.lit(fit[t]) * v for t, v in values.items()), F.lit(0.0)))
        left = F.col(y) - mu if family != "gamma" else (F.col(y) - mu) / mu
        rows = pairs.dropna(subset=[x, y, *([by] if by else [])]).where(F.col(y) > 0 if family == "gamma" else F.lit(True))
        sums = rows.agg(F.count("*").alias("n"), *[F.avg(left * v).alias(f"s{i}") for i, v in enumerate(values.values())])
        stack = ", ".join(f"'{t}', s{i}" for i, t in enumerate(values))
        one = sums.selectExpr(f"'{family}' AS family", f"stack({len(values)}, {stack}) AS (term, score)", "n")
        out = one if out is None else out.union(one)
    return out


def sign_agreement(models: DataFrame, key: str = "family", estimate: str = "estimate") -> DataFrame:
    """For each term: how many models there are, and whether all their estimates have one sign."""
    return models.groupBy("term").agg(F.count(key).alias("models"), (F.countDistinct(F.signum(estimate)) == 1).alias("agree"))


def stability(table: DataFrame, setting: str, keys: list[str], t: str = "t", limit: float = 1.96) -> DataFrame:
    """Over settings, for each of keys: whether the sign of t stays, and whether its significance does; and how many settings there are."""
    known = table.where(F.col(t).isNotNull())
    return known.groupBy(*keys).agg(F.countDistinct(setting).alias("settings"), (F.countDistinct(F.signum(t)) == 1).alias("same_sign"), (F.countDistinct(F.abs(t) > limit) == 1).alias("same_significance"))


def with_t_p(table: DataFrame, t: str, df: str) -> DataFrame:
    """Adds p, two-sided, of Student's t with df degrees of freedom."""
    p = F.pandas_udf(lambda a, b: pd.Series([student_p(float(x), float(y)) if x == x and y > 0 else None for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    return table.withColumn("p", p(F.col(t).cast("double"), F.col(df).cast("double")))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        f = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
                c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
                f *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return f

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def _lowess(x: np.ndarray, y: np.ndarray, frac: float, rounds: int) -> np.ndarray:
    n = len(x)
    k = max(2, int(np.ceil(frac * n)))
    robust, out = np.ones(n), y.astype(float).copy()
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = max(np.partition(d, k - 1)[k - 1], 1e-12)
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3 * robust
            sw = w.sum()
            mx, my = (w * x).sum() / sw, (w * y).sum() / sw
            v = (w * (x - mx) ** 2).sum()
            out[i] = my + ((w * (x - mx) * (y - my)).sum() / v * (x[i] - mx) if v > 1e-12 else 0.0)
        r = np.abs(y - out)
        s = 6 * max(np.median(r), 1e-12)
        robust = np.clip(1 - (r / s) ** 2, 0, None) ** 2
    return out


def lowess(curve: DataFrame, x: str, y: str, frac: float = 0.3, rounds: int = 5) -> DataFrame:
    """Robust local regression through a curve (a row for each level: small): x, y, smooth."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(frames).sort_values(x)
        if len(pdf):
            pdf["smooth"] = _lowess(pdf[x].to_numpy(float), pdf[y].to_numpy(float), frac, rounds)
            yield pdf

    return curve.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(F.col(y).isNotNull()).coalesce(1).mapInPandas(kernel, f"{x} double, {y} double, smooth double")


def _pspline(x: np.ndarray, y: np.ndarray, w: np.ndarray, knots: int) -> tuple[np.ndarray, np.ndarray]:
    """Fit and standard error of a cubic spline whose second differences are penalised as generalised cross-validation chooses."""
    low, high = x.min(), x.max()
    step = max(high - low, 1e-12) / (knots - 3)
    at = (x[:, None] - low) / step - np.arange(-3, knots - 3)[None, :]  # place within each basis function, 0 to 4
    basis = sum(s * np.clip(at - k, 0, None) ** 3 for k, s in enumerate((1, -4, 6, -4, 1))) / 6
    basis[at >= 4] = 0
    rough = np.diff(np.eye(knots), 2, axis=0)
    gram, target, best = basis.T @ (w[:, None] * basis), basis.T @ (w * y), None
    for lam in 10.0 ** np.arange(-4, 7):
        inverse = np.linalg.pinv(gram + lam * rough.T @ rough)
        fit = basis @ (inverse @ target)
        used = np.trace(inverse @ gram)
        left = (w * (y - fit) ** 2).sum()
        score = len(x) * left / max(len(x) - used, 1e-9) ** 2
        if best is None or score < best[0]:
            best = (score, fit, np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", basis, inverse @ gram @ inverse, basis)) * left / max(len(x) - used, 1e-9)))
    return best[1], best[2]


def smooth_curve(curve: DataFrame, x: str, y: str, n: str | None = None, knots: int = 10) -> DataFrame:
    """Penalised spline through a curve (a row for each level: small), weighted by n: x, y, smooth, ci_low, ci_high."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(frames).sort_values("x")
        if len(pdf):
            fit, se = _pspline(pdf.x.to_numpy(float), pdf.y.to_numpy(float), pdf.n.to_numpy(float), min(knots, max(4, len(pdf))))
            yield pdf.assign(smooth=fit, ci_low=fit - 1.96 * se, ci_high=fit + 1.96 * se)[["x", "y", "smooth", "ci_low", "ci_high"]]

    own = curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(n).cast("double") if n else F.lit(1.0)).alias("n")).dropna()
    return own.coalesce(1).mapInPandas(kernel, "x double, y double, smooth double, ci_low double, ci_high double")
