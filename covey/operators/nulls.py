"""Null models of membership that keep degrees."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from covey.functions import ranked_by_draw
from covey.operators import aggregates as ag
from covey.operators import inference as inf
from covey.operators import neff as ne
from covey.session import checkpointed


def classes(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Degree classes: (d, n) of users and (k, n) of packs. There are as many rows as distinct degrees."""
    users = m.groupBy("user_id").agg(F.count("*").alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    packs = m.groupBy("pack_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return users, packs


def fit_classes(d: np.ndarray, nd: np.ndarray, k: np.ndarray, nk: np.ndarray, tol: float = 1e-9, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses x and y of the classes such that expected degrees are d and k: P = x y / (1 + x y)."""
    links = float((d * nd).sum())
    x, y = d / sqrt(links), k / sqrt(links)
    for _ in range(most):
        nx = d / (nk * y / (1 + np.outer(x, y))).sum(axis=1)
        ny = k / (nd[:, None] * nx[:, None] / (1 + np.outer(nx, y))).sum(axis=0)
        step = max(np.abs(nx / x - 1).max(), np.abs(ny / y - 1).max())
        x, y = nx, ny
        if step < tol:
            break
    return x, y


def fit(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """user_id, d, x and pack_id, k, y: class tables (small) go to the driver, the fitnesses are joined back."""
    spark = m.sparkSession
    users, packs = (sorted(map(tuple, t.collect())) for t in classes(m))
    (d, nd), (k, nk) = np.array(users, float).T, np.array(packs, float).T
    x, y = fit_classes(d, nd, k, nk)
    xs = spark.createDataFrame([(int(a), float(b)) for a, b in zip(d, x, strict=True)], "d long, x double")
    ys = spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, y, strict=True)], "k long, y double")
    u = m.groupBy("user_id").agg(F.count("*").alias("d")).join(xs, "d")
    p = m.groupBy("pack_id").agg(F.count("*").alias("k")).join(ys, "k")
    return u.select("user_id", "d", "x"), p.select("pack_id", "k", "y")


def start_values(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same tables with d / sqrt(links) and k / sqrt(links): the sparse limit, in closed form."""
    links = F.broadcast(m.agg(F.sqrt(F.count("*")).alias("root")))  # one row
    u = m.groupBy("user_id").agg(F.count("*").alias("d")).crossJoin(links).select("user_id", "d", (F.col("d") / F.col("root")).alias("x"))
    p = m.groupBy("pack_id").agg(F.count("*").alias("k")).crossJoin(links).select("pack_id", "k", (F.col("k") / F.col("root")).alias("y"))
    return u, p


def expected_margins(users: DataFrame, packs: DataFrame) -> DataFrame:
    """side, degree, n, expected: sums over classes, not over users times packs."""
    u = users.groupBy(F.col("d").alias("degree"), "x").agg(F.count("*").alias("n"))
    p = packs.groupBy(F.col("k").alias("degree"), "y").agg(F.count("*").alias("n"))
    q = F.col("x") * F.col("y") / (1 + F.col("x") * F.col("y"))
    pu = u.crossJoin(F.broadcast(p.select("y", F.col("n").alias("m")))).groupBy("degree", "n").agg(F.sum(F.col("m") * q).alias("expected"))
    pp = p.crossJoin(F.broadcast(u.select("x", F.col("n").alias("m")))).groupBy("degree", "n").agg(F.sum(F.col("m") * q).alias("expected"))
    return pu.select(F.lit("user").alias("side"), "degree", "n", "expected").union(pp.select(F.lit("pack"), "degree", "n", "expected"))


#: Odd constants of the mixing of 32-bit words, fixed so that SQL can do the same (the last two are MurmurHash3's).
STEP, STRIDE, MIX = 0x9E3779B9, 0x85157AF5, (0x85EBCA6B, 0xC2B2AE35)
_WORD = np.uint64(0xFFFFFFFF)
#: The most that places of a class times -log(1 - chance) may come to, so that the chance of drawing none is a number.
_DEEP = 500.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit word, well mixed (in 64 bits)."""
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX[0])) & _WORD
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(MIX[1])) & _WORD
    return x ^ (x >> np.uint64(16))


def _word(a: np.ndarray, code: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The word number `code` of the stream (a, b)."""
    return _mixed(_mixed((a + code * np.uint64(STEP)) & _WORD) ^ b)


def _how_many(u: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Binomial counts by inversion: how many of the first n values of the distribution function are at or below u."""
    out = np.zeros(len(u), np.int64)
    at = np.arange(len(u))
    mass = np.exp(n * np.log1p(-q))
    total, odds, i = mass.copy(), q / (1 - q), 0
    while len(at):
        more = (u >= total) & (i < n)
        at, u, n, mass, total, odds = at[more], u[more], n[more], mass[more], total[more], odds[more]
        i += 1
        out[at] = i
        mass = mass * odds * (n - i + 1) / i
        total = total + mass
    return out


def _places(n: np.ndarray, m: np.ndarray, a: np.ndarray, code: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry m of n places, the first different ones of a stream of draws: entries and places. m is n / 2 at most."""
    found, tries = [], 2 * m + 4
    at = np.flatnonzero(m > 0)
    start = _mixed((a + code * np.uint64(STEP)) & _WORD)
    while len(at):
        t = tries[at]
        of = np.repeat(at, t)
        j = (np.arange(len(of)) - np.repeat(np.cumsum(t) - t, t)).astype(np.uint64)
        place = ((_mixed(start[of] ^ ((b[of] + j * np.uint64(STRIDE)) & _WORD)) * n[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        first = np.sort(np.unique(of * (int(n.max()) + 1) + place, return_index=True)[1])  # each place of an entry where it comes first
        own = of[first]
        lead = np.r_[True, own[1:] != own[:-1]]
        rank = np.arange(len(own)) - np.flatnonzero(lead)[np.cumsum(lead) - 1]
        enough = np.bincount(own, minlength=len(n)) >= m
        keep = (rank < m[own]) & enough[own]
        found.append((own[keep], place[first][keep]))
        at = at[~enough[at]]
        tries[at] *= 2
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))


def draw_classes(x: np.ndarray, keys: list[str], y: np.ndarray, n: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, class and place of every link that rows of fitness x draw, in classes of n packs of fitness y each. keys: the MD5 of each row.

    A row draws how many packs of a class it has, and then which: as every cell on its own would, at the cost of
    the links and of a number for each row and class.
    """
    words = np.array([[int(k[i : i + 8], 16) for i in (0, 8, 16, 24)] for k in keys], np.uint64).reshape(-1, 4)
    row, of = (v.ravel() for v in np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij"))
    size, number = n[of], code[of].astype(np.uint64)
    q = x[row] * y[of] / (1 + x[row] * y[of])
    u = _word(words[row, 0], number, words[row, 1]) / 2.0**32
    c = _how_many(u, size, q)
    few = np.minimum(c, size - c)  # where most are taken, those left out are drawn
    entry, place = _places(size, few, words[row, 2], number, words[row, 3])
    most = 2 * c > size
    plain = ~most[entry]
    rest = np.flatnonzero(most)
    every = np.repeat(rest, size[rest])
    where = np.arange(len(every)) - np.repeat(np.cumsum(size[rest]) - size[rest], size[rest])
    out = np.isin(every * (int(n.max(initial=0)) + 1) + where, entry[~plain] * (int(n.max(initial=0)) + 1) + place[~plain])
    entry, place = np.concatenate([entry[plain], every[~out]]), np.concatenate([place[plain], where[~out]])
    return row[entry], of[entry], place


def samples(users: DataFrame, packs: DataFrame, seeds: list[int], rows: DataFrame | None = None) -> DataFrame:
    """replicate, user_id, pack_id: draws of the canonical ensemble. rows restricts the users.

    All packs of one size have the same chance with a user, so a user draws how many of each size it has, and
    then which places among them. Sizes (a row each) go to every task; a class in which drawing none
    would be too unlikely for a number is cut. A draw depends on seed and user alone, not on partitions.
    """
    ranked = ranked_by_draw(packs.select("pack_id", "k"), ["k"], F.md5(F.col("pack_id").cast("string")), ["pack_id"], "place")
    u = users if rows is None else users.join(rows.select("user_id").distinct(), "user_id", "left_semi")
    table = packs.groupBy("k", "y").agg(F.count("*").alias("n")).orderBy("k").collect()  # a row for each distinct size
    top = users.agg(F.max("x")).first()[0] or 0.0
    parts = []  # k, first place, places, y, code
    for k, y, n in table:
        cut = max(1, int(_DEEP / max(np.log1p(top * y), 1e-300))) if top * y > 0 else n
        parts += [(k, a, min(cut, n - a), y, (k + (i << 24)) & 0xFFFFFFFF) for i, a in enumerate(range(0, n, cut))]
    k, first, n, y, code = (np.array([p[i] for p in parts]) for i in range(5))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, (1 << 20) // max(1, len(parts)))
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                row, of, place = draw_classes(batch.column("x").to_numpy(zero_copy_only=False), batch.column("key").to_pylist(), y.astype(float), n.astype(np.int64), code.astype(np.int64))
                own = batch.select(["replicate", "user_id"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(k[of], pa.int64()), pa.array(first[of] + place, pa.int64())], ["replicate", "user_id", "k", "place"])

    each = F.broadcast(users.sparkSession.createDataFrame([(int(x),) for x in seeds], "replicate int"))  # a row for each seed
    keyed = u.select("user_id", "x").crossJoin(each).withColumn("key", F.md5(F.concat_ws("|", "replicate", "user_id")))
    if not parts:
        return keyed.join(packs.select("pack_id"), F.lit(False)).select("replicate", "user_id", "pack_id")
    drawn = keyed.mapInArrow(kernel, f"replicate int, user_id {dict(users.dtypes)['user_id']}, k long, place long")
    return drawn.join(ranked.select("k", F.col("place").cast("long").alias("place"), "pack_id"), ["k", "place"]).select("replicate", "user_id", "pack_id")


def sample(users: DataFrame, packs: DataFrame, seed: int, rows: DataFrame | None = None) -> DataFrame:
    return samples(users, packs, [seed], rows).drop("replicate")


def cooccurrence(pairs: DataFrame, users: DataFrame, packs: DataFrame) -> DataFrame:
    """pairs (user_a, user_b, shared_packs) with expected, variance and z of the packs they share; sums over size classes."""
    p = F.broadcast(packs.groupBy("y").agg(F.count("*").alias("m")))  # a row for each distinct pack size
    xa, xb = users.select(F.col("user_id").alias("user_a"), F.col("x").alias("xa")), users.select(F.col("user_id").alias("user_b"), F.col("x").alias("xb"))
    joined = pairs.join(xa, "user_a").join(xb, "user_b")
    kinds = joined.select(F.least("xa", "xb").alias("lo"), F.greatest("xa", "xb").alias("hi")).distinct().crossJoin(p)
    q = (F.col("lo") * F.col("y") / (1 + F.col("lo") * F.col("y"))) * (F.col("hi") * F.col("y") / (1 + F.col("hi") * F.col("y")))
    stats = kinds.groupBy("lo", "hi").agg(F.sum(F.col("m") * q).alias("expected"), F.sum(F.col("m") * q * (1 - q)).alias("variance"))
    out = joined.withColumn("lo", F.least("xa", "xb")).withColumn("hi", F.greatest("xa", "xb")).join(stats, ["lo", "hi"]).drop("lo", "hi", "xa", "xb")
    return out.withColumn("z", F.when(F.col("variance") > 0, (F.col("shared_packs") - F.col("expected")) / F.sqrt("variance")))


def gamma_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper regularised incomplete gamma function of a > 0 and x > 0; of each pair the smaller is computed itself, so that it keeps its digits."""
    front = np.exp(a * np.log(x) - x - np.array([lgamma(v) for v in a]))
    series = x < a + 1
    lower, upper = np.zeros(len(a)), np.zeros(len(a))
    b, z = a[series], x[series]
    term, total, k = 1 / b, 1 / b, 0
    while len(b) and (term > total * 1e-17).any() and k < 100_000:
        k += 1
        term = term * z / (b + k)
        total = total + term
    lower[series] = front[series] * total if len(b) else 0
    upper[series] = 1 - lower[series]
    b, z = a[~series], x[~series]
    if len(b):  # continued fraction
        d = 1 / (z + 1 - b)
        c, f = np.full(len(b), 1e300), d.copy()
        for k in range(1, 100_000):
            num, den = -k * (k - b), z + 2 * k + 1 - b
            d = 1 / (num * d + den)
            c = den + num / c
            f = f * c * d
            if (np.abs(c * d - 1) < 1e-15).all():
                break
        upper[~series] = front[~series] * f
        lower[~series] = 1 - upper[~series]
    return lower, upper


def poisson_tails(s: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Two-sided p: twice the smaller of P(X <= s) and P(X >= s), 1 at most; 1 where the rate is 0."""
    s, rate = np.asarray(s, float), np.asarray(rate, float)
    out = np.ones(len(s))
    known = rate > 0
    if known.any():
        upto = gamma_tails(s[known] + 1, rate[known])[1]
        some = s[known] > 0
        least = np.ones(int(known.sum()))
        if some.any():
            least[some] = gamma_tails(s[known][some], rate[known][some])[0]
        out[known] = np.minimum(1, 2 * np.minimum(upto, least))
    return out


def poisson_p(s: int, rate: float) -> float:
    return float(poisson_tails(np.array([s]), np.array([rate]))[0])


def with_p(table: DataFrame) -> DataFrame:
    """Adds p_value to cooccurrence()'s table; distinct (shared, expected) are computed once."""
    p = F.pandas_udf(lambda s, rate: pd.Series(poisson_tails(s.to_numpy(float), rate.to_numpy(float))), "double")
    kinds = table.select("shared_packs", "expected").distinct().withColumn("p_value", p("shared_packs", "expected"))
    return table.join(kinds, ["shared_packs", "expected"])


#: Users of a block in which curveball trades, about; rounds of new blocks where there are several.
BLOCK, ROUNDS = 1024, 20


def curveball(m: DataFrame, seeds: list[int], trades: int | None = None) -> DataFrame:
    """replicate, user_id, pack_id: for each seed the membership with both margins kept, after `trades` trades (5 for each link).

    In a trade two users deal out anew the packs that only one of them has. Users are dealt into blocks by
    a hash; a block makes its share of the round's trades one after another, and each round deals new
    blocks, so that all users come to meet. All replicates run in the same jobs. What comes out depends on
    the seed alone, not on partitions.
    """
    users, links = m.select("user_id").distinct().count(), m.count()
    trades = 5 * links if trades is None else trades
    blocks = max(1, round(users / BLOCK))
    rounds = 1 if blocks == 1 else ROUNDS
    kind = dict(m.dtypes)
    state = m.groupBy("user_id").agg(F.sort_array(F.collect_set("pack_id")).alias("packs"))
    state = state.crossJoin(F.broadcast(m.sparkSession.createDataFrame([(int(x),) for x in seeds], "replicate int")))  # a row for each seed

    def kernel(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            rng = np.random.default_rng([held[0]["replicate"] & 0x7FFFFFFF, k, held[0]["block"]])
            rows = [set(r["packs"]) for r in held]
            n = round(trades / rounds * len(rows) / users) if len(rows) > 1 else 0
            for i, j in rng.integers(0, len(rows), (n, 2)).tolist():
                only_i, only_j = rows[i] - rows[j], rows[j] - rows[i]
                if i != j and only_i and only_j:
                    pool = sorted(only_i | only_j)
                    mine = {pool[x] for x in rng.permutation(len(pool))[: len(only_i)].tolist()}
                    both = rows[i] & rows[j]
                    rows[i], rows[j] = both | mine, both | (set(pool) - mine)
            return pa.RecordBatch.from_pylist([{"replicate": r["replicate"], "user_id": r["user_id"], "packs": sorted(p)} for r, p in zip(held, rows, strict=True)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (held[0]["replicate"], held[0]["block"]) != (r["replicate"], r["block"]):
                    yield done()
                    held.clear()
                held.append(r)
        if held:
            yield done()

    text = f"replicate int, user_id {kind['user_id']}, packs array<{kind['pack_id']}>"
    schema = to_arrow_schema(StructType.fromDDL(text))
    for k in range(rounds):
        key = F.md5(F.concat_ws("|", "replicate", F.lit(str(k)), F.col("user_id").cast("string")))
        placed = state.withColumn("key", key).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        dealt = placed.repartition("replicate", "block").sortWithinPartitions("replicate", "block", "key").select("replicate", "block", "user_id", "packs")
        state = checkpointed(dealt.mapInArrow(lambda b, k=k: kernel(b, k), text))
    return state.select("replicate", "user_id", F.explode("packs").alias("pack_id"))


def task_seeds(n_replicates: int, base: int = 0, task: int = 0, tasks: int = 1) -> list[int]:
    """Seeds of one of several tasks that share the replicates: ceil(n / tasks) each, the last ones fewer."""
    share = -(-n_replicates // tasks)
    return [base + k for k in range(task * share, min((task + 1) * share, n_replicates))]


def under(nulls: DataFrame, pairs: DataFrame, emb: DataFrame, method: str = "effrank", missing: str = "distinct") -> DataFrame:
    """pairs once for each replicate of nulls (replicate, user_id, pack_id), with k_shared and n_eff under it; other columns of pairs stay as they are."""
    replicates = F.broadcast(nulls.select("replicate").distinct())  # a row for each replicate
    a = pairs.select("user_a", "user_b").join(nulls.withColumnRenamed("user_id", "user_a"), "user_a")
    shared = a.join(nulls.withColumnRenamed("user_id", "user_b"), ["replicate", "user_b", "pack_id"], "left_semi")
    return ne.for_pairs(pairs.crossJoin(replicates), shared, emb, method, missing, keys=("replicate", "user_a", "user_b"))


def under_counts(nulls: DataFrame, pairs: DataFrame) -> DataFrame:
    """replicate, user_a, user_b, shared_packs of listed pairs that share a pack under a replicate."""
    a = pairs.select("user_a", "user_b").join(nulls.withColumnRenamed("user_id", "user_a"), "user_a")
    shared = a.join(nulls.withColumnRenamed("user_id", "user_b"), ["replicate", "user_b", "pack_id"], "left_semi")
    return shared.groupBy("replicate", "user_a", "user_b").agg(F.count("*").alias("shared_packs"))


def statistics(scored: DataFrame, statistic: str, keys: tuple[str, ...] = ("replicate",), reference: int | None = None) -> DataFrame:
    """stat, keys, value of pairs with n_eff, cosine and hops: the slope of cosine on n_eff, or how the slope at each distance differs from the first's."""
    if statistic == "slope":
        return inf.slopes(scored, "n_eff", "cosine", list(keys)).select(F.lit("slope").alias("stat"), *keys, F.col("slope").alias("value"))
    if statistic != "interaction":
        raise ValueError(f"unknown statistic {statistic}")
    each = inf.slopes(scored, "n_eff", "cosine", [*keys, "hops"])
    first = F.broadcast(scored.agg(F.min("hops").alias("first"))) if reference is None else None  # one row
    each = each.crossJoin(first) if first is not None else each.withColumn("first", F.lit(reference))
    ref = each.where("hops = first").select(*keys, F.col("slope").alias("ref"))
    other = each.where("hops <> first")
    joined = other.join(ref, list(keys)) if keys else other.crossJoin(ref)  # one row
    return joined.select(F.concat(F.lit("interaction[hops="), F.col("hops").cast("string"), F.lit("]")).alias("stat"), *keys, (F.col("slope") - F.col("ref")).alias("value"))


def curves(observed: DataFrame, scored: DataFrame, max_shared: int, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """x_kind, bin, observed_mean, observed_ci_low, observed_ci_high, null_mean, null_low, null_high for the bins 0..max_shared of the
    packs shared (count) and of the rounded n_eff. observed: pairs with k_shared, n_eff and cosine; scored: under()'s rows. n_boot=0: no observed interval."""
    spark, out = observed.sparkSession, None
    for kind, bin_of in (("count", F.greatest(F.lit(0), F.least("k_shared", F.lit(max_shared))).cast("long")), ("n_eff", ag.rint_bin("n_eff", max_shared))):
        null = band(scored.groupBy("replicate", bin_of.alias("level")).agg(F.avg("cosine").alias("mean")))
        if n_boot:
            own = inf.cluster_bootstrap(observed, bin_of, n_boot=n_boot, seed=seed)
        else:
            own = observed.groupBy(bin_of.alias("level")).agg(F.avg("cosine").alias("mean")).withColumns({c: F.lit(None).cast("double") for c in ("ci_low", "ci_high")})
        own = own.select("level", F.col("mean").alias("observed_mean"), F.col("ci_low").alias("observed_ci_low"), F.col("ci_high").alias("observed_ci_high"))
        spine = spark.range(max_shared + 1).select(F.lit(kind).alias("x_kind"), F.col("id").alias("level"))
        one = spine.join(own, "level", "left").join(null, "level", "left").select("x_kind", F.col("level").alias("bin"), "observed_mean", "observed_ci_low", "observed_ci_high", "null_mean", "null_low", "null_high")
        out = one if out is None else out.union(one)
    return out


def cooccurrence_summary(table: DataFrame, level: float = 0.05) -> DataFrame:
    """One row of with_p()'s table: pairs, and the share whose p is below the level."""
    return table.agg(F.count("*").alias("pairs"), F.avg((F.col("p_value") < level).cast("double")).alias("significant"))


def reduce(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """observed: stat, value (a row for each statistic); nulls: stat, replicate, value. Empirical two-sided p, mean, sd and z over finite values."""
    known = nulls.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    joined = known.join(F.broadcast(observed.select("stat", F.col("value").alias("observed"))), "stat")
    out = joined.groupBy("stat", "observed").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count_if(F.col("value") >= F.col("observed")).alias("ge"), F.count_if(F.col("value") <= F.col("observed")).alias("le"))
    p = F.least(F.lit(1.0), 2 * F.least((1 + F.col("ge")) / (F.col("n") + 1), (1 + F.col("le")) / (F.col("n") + 1)))
    return out.select("stat", "observed", "n", "mean", "sd", p.alias("p"), F.try_divide(F.col("observed") - F.col("mean"), F.col("sd")).alias("z"))


def band(curves: DataFrame) -> DataFrame:
    """curves: replicate, level, mean. For each level the mean over replicates and the 2.5 and 97.5 percentiles."""
    return curves.groupBy("level").agg(F.avg("mean").alias("null_mean"), F.percentile("mean", F.lit(0.025)).alias("null_low"), F.percentile("mean", F.lit(0.975)).alias("null_high"))
