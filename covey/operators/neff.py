"""Effective number of distinct shared packs.

Pairs are reduced to distinct shared sets before anything is computed; every estimator then runs as an
Arrow kernel over those sets, batched by size, so a set costs its own square once however many pairs share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from covey.functions import dot
from covey.operators.aggregates import quantiles
from covey.operators.pairs import comember_pairs

EIGEN, LINKS = ("effrank", "rowsum", "participation"), ("single", "complete", "average")
#: The estimators of a set under one signal.
METHODS = (*EIGEN, *(f"cluster_{x}" for x in LINKS), "mean_interp")


def checked_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    return method


# --- similarities of packs --------------------------------------------------


def pack_dots(found: DataFrame, emb: DataFrame) -> DataFrame:
    """Adds the similarity g to pack pairs: the dot product of unit embeddings, 0 where one is missing."""
    e = emb.select(F.col("pack_id").alias("pack_i"), F.col("embedding").alias("ei"))
    f = emb.select(F.col("pack_id").alias("pack_j"), F.col("embedding").alias("ej"))
    g = F.when(F.col("ei").isNull() | F.col("ej").isNull(), F.lit(0.0)).otherwise(dot("ei", "ej"))
    return found.join(e, "pack_i", "left").join(f, "pack_j", "left").withColumn("g", g).drop("ei", "ej")


def jaccard_packs(m: DataFrame, least: int = 1) -> DataFrame:
    """pack_i < pack_j with the Jaccard similarity of their members, for packs that share at least `least`."""
    sizes = m.groupBy("pack_id").agg(F.count("*").alias("k"))
    both = comember_pairs(m.select(F.col("pack_id").alias("user_id"), F.col("user_id").alias("pack_id")), least=least).toDF("pack_i", "pack_j", "shared")
    both = both.join(sizes.toDF("pack_i", "ki"), "pack_i").join(sizes.toDF("pack_j", "kj"), "pack_j")
    return both.select("pack_i", "pack_j", (F.col("shared") / (F.col("ki") + F.col("kj") - F.col("shared"))).alias("jaccard"))


# --- kernels: n sets of p packs at once -------------------------------------


def linkage(s: np.ndarray, method: str) -> float:
    """1 + the sum of merge heights of an agglomeration over distances 1 - clip(s, 0, 1)."""
    if method not in LINKS:
        raise ValueError(f"unknown linkage {method}")
    n = len(s)
    if n < 2:
        return float(n)
    d = 1 - np.clip((s + s.T) / 2, 0, 1)
    np.fill_diagonal(d, np.inf)
    size, height = np.ones(n), 0.0
    chain: list[int] = []
    alive = np.ones(n, bool)
    for _ in range(n - 1):  # nearest-neighbour chain: quadratic in all
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        b, a = chain.pop(), chain.pop()
        height += d[a, b]
        with np.errstate(invalid="ignore"):
            new = np.minimum(d[a], d[b]) if method == "single" else np.maximum(d[a], d[b]) if method == "complete" else (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
    return 1.0 + float(height)


def _diversity(s: np.ndarray, empty: float) -> np.ndarray:
    """exp of the entropy of the eigenvalues above 1e-12, of each of n matrices."""
    lam = np.linalg.eigvalsh(s)
    lam = np.where(lam > 1e-12, lam, 0.0)
    total = lam.sum(axis=1, keepdims=True)
    q = lam / np.where(total > 0, total, 1)
    return np.where(total[:, 0] > 0, np.exp(-np.where(q > 0, q * np.log(np.where(q > 0, q, 1)), 0).sum(axis=1)), empty)


def _eigen(g: np.ndarray, wanted: tuple[str, ...], empty: float) -> dict[str, np.ndarray]:
    """The eigenvalue family of n Gram matrices: effrank of g as it is, rowsum of what is not negative."""
    out = {}
    if "effrank" in wanted:
        out["effrank"] = _diversity(g, empty)
    if "participation" in wanted:
        square = (g * g).sum(axis=(1, 2))
        out["participation"] = np.where(square > 0, np.trace(g, axis1=1, axis2=2) ** 2 / np.where(square > 0, square, 1), empty)
    if "rowsum" in wanted:
        rows = np.maximum(g, 0).sum(axis=2)
        out["rowsum"] = np.where(rows > 0, 1 / np.where(rows > 0, rows, 1), 0).sum(axis=1)
    return out


def _clusters(s: np.ndarray, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Linkages and the interpolation by the mean, of n similarity matrices; closed forms up to three packs."""
    p = s.shape[1]
    s = np.clip(s, 0, 1)
    upper = np.triu_indices(p, 1)
    x = np.sort(s[:, upper[0], upper[1]], axis=1)[:, ::-1]
    out = {}
    for link in LINKS:
        if f"cluster_{link}" in wanted:
            if p == 2:
                out[f"cluster_{link}"] = 2 - x[:, 0]
            elif p == 3:
                last = {"single": x[:, 1], "complete": x[:, 2], "average": (x[:, 1] + x[:, 2]) / 2}[link]
                out[f"cluster_{link}"] = 3 - x[:, 0] - last
            else:
                out[f"cluster_{link}"] = np.array([linkage(y, link) for y in s])
    if "mean_interp" in wanted:
        out["mean_interp"] = 1 + (1 - x.mean(axis=1)) * (p - 1)
    return out


#: Packs of a set beyond which no matrix of all pairs of them is made, and rows of one that are made at once.
LARGE, ROWS = 600, 256


def _alike(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of the similarity matrix: dot products, 1 on the diagonal. A pack that is not known has a zero vector."""
    g = v[rows] @ v.T
    g[np.arange(len(rows)), rows] = 1.0
    return g


def large_linkage(v: np.ndarray, method: str) -> float:
    """linkage() of a set of which only the vectors are held: distances are computed when they are asked for."""
    n = len(v)
    far = lambda rows: 1 - np.clip(_alike(v, rows), 0, 1)
    if method == "single":  # a spanning tree, a pack at a time
        near, left, total, at = np.full(n, np.inf), np.ones(n, bool), 0.0, 0
        for _ in range(n - 1):
            left[at] = False
            near = np.minimum(near, far(np.array([at]))[0])
            at = int(np.where(left, near, np.inf).argmin())
            total += near[at]
        return 1.0 + float(total)
    of, size, alive, members, height = np.arange(n), np.ones(n), np.ones(n, bool), {k: np.array([k]) for k in range(n)}, 0.0
    chain: list[int] = []

    def row(a: int) -> np.ndarray:
        """Distances of cluster a to all clusters, by their numbers."""
        parts = [far(x) for x in np.array_split(members[a], -(-len(members[a]) // ROWS))]
        if method == "average":
            out = np.bincount(of, weights=sum(p.sum(axis=0) for p in parts), minlength=n) / (len(members[a]) * size)
        else:
            out, each = np.zeros(n), np.max([p.max(axis=0) for p in parts], axis=0)
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0])
            out[of[order][first]] = np.maximum.reduceat(each[order], first)
        out[~alive] = out[a] = np.inf
        return out

    for _ in range(n - 1):  # nearest-neighbour chain
        if not chain:
            chain.append(next(iter(members)))
        while True:
            a = chain[-1]
            d = row(a)
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        height += d[b]
        chain.pop()
        chain.pop()
        members[a] = np.concatenate([members[a], members.pop(b)])
        size[a], alive[b] = len(members[a]), False
        of[members[a]] = a
    return 1.0 + float(height)


def large_numbers(v: np.ndarray, known: np.ndarray, wanted: tuple[str, ...] = METHODS, missing: str = "distinct", specificity: np.ndarray | None = None) -> dict[str, float]:
    """embedding_numbers() of one set of p packs (v: p x d) in memory of order p x d.

    Eigenvalues are those of the d x d matrix of the known packs, and one for each pack that is an axis of its
    own; sums over the similarity matrix are made of a few of its rows at a time.
    """
    out = {f"cluster_{x}": large_linkage(v, x) for x in LINKS if f"cluster_{x}" in wanted}
    p = len(v)
    if "mean_interp" in wanted:
        total = sum(float(np.clip(_alike(v, rows), 0, 1).sum()) for rows in np.array_split(np.arange(p), -(-p // ROWS)))
        out["mean_interp"] = 1 + (1 - (total - p) / (p * (p - 1))) * (p - 1)
    if set(wanted) & set(EIGEN):
        keep = np.flatnonzero(known) if missing == "drop" else np.arange(p)
        e, there, w = v[keep], known[keep], None if specificity is None else specificity[keep]
        if len(keep) < 2:
            return out | {c: float(len(keep)) for c in wanted if c in EIGEN}
        w = np.ones(len(keep)) if w is None else set_weights(w)
        root = np.sqrt(w)
        dual = (e * w[:, None]).T @ e
        alone = w[~there]
        if "effrank" in wanted:
            lam = np.concatenate([np.linalg.eigvalsh(dual), alone])
            q = lam[lam > 1e-12] / lam[lam > 1e-12].sum()
            out["effrank"] = float(np.exp(-(q * np.log(q)).sum()))
        if "participation" in wanted:
            out["participation"] = float(w.sum() ** 2 / ((dual**2).sum() + (alone**2).sum()))
        if "rowsum" in wanted:
            sums = [(np.maximum(_alike(e, rows), 0) * root[None, :]).sum(axis=1) * root[rows] for rows in np.array_split(np.arange(len(keep)), -(-len(keep) // ROWS))]
            out["rowsum"] = float((1 / np.concatenate(sums)).sum())
    return out


def set_weights(specificity: np.ndarray) -> np.ndarray:
    """Weights of one set, or of n sets of one size: what is not positive and finite is 1, and then their mean is brought to 1."""
    with np.errstate(invalid="ignore"):
        w = np.where(np.isfinite(specificity) & (specificity > 0), specificity, 1.0)
    return w / w.mean(axis=-1, keepdims=True)


def embedding_numbers(v: np.ndarray, known: np.ndarray, wanted: tuple[str, ...] = METHODS, missing: str = "distinct", specificity: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Estimators of n sets of p packs. v: n x p x d unit rows, zero where not known (n x p).

    A pack that is not known is an axis of its own, or with missing="drop" left out of the eigenvalue
    family; all sets must then know the same number of packs. No packs count 0, one pack counts 1.
    """
    n, p, _ = v.shape
    if p < 2:
        return {c: np.full(n, float(p)) for c in wanted}
    g = v @ v.transpose(0, 2, 1)
    at = np.arange(p)
    g[:, at, at] = 1.0
    out = _clusters(g, wanted)
    if set(wanted) & set(EIGEN):
        e, w = g, specificity
        if missing == "drop":
            left = int(known[0].sum()) if n else p
            rows = np.argsort(~known, axis=1, kind="stable")[:, :left]
            e = np.take_along_axis(np.take_along_axis(g, rows[:, :, None], 1), rows[:, None, :], 2)
            w = None if w is None else np.take_along_axis(w, rows, 1)
            if left < 2:
                return out | {c: np.full(n, float(left)) for c in wanted if c in EIGEN}
        if w is not None:
            root = np.sqrt(set_weights(w))
            e = e * root[:, :, None] * root[:, None, :]
        out |= _eigen(e, wanted, 0.0)
    return out


def similarity_numbers(s: np.ndarray, wanted: tuple[str, ...] = METHODS) -> dict[str, np.ndarray]:
    """Estimators of n similarity matrices that need not be positive: negative eigenvalues are left out, and flagged as `nonpsd`."""
    n, p, _ = s.shape
    if p < 2:
        return {c: np.full(n, float(p)) for c in wanted} | {"nonpsd": np.zeros(n, bool)}
    even = (s + s.transpose(0, 2, 1)) / 2
    clipped = np.clip(s, 0, 1)
    out = _clusters(s, wanted) | _eigen(clipped, tuple(set(wanted) - {"effrank"}), float(p))
    if "effrank" in wanted:
        out["effrank"] = _diversity(even, float(p))
    return out | {"nonpsd": (np.linalg.eigvalsh(even) < -1e-9).any(axis=1)}


def all_numbers(v: np.ndarray, known: np.ndarray, missing: str = "distinct", specificity: np.ndarray | None = None) -> dict[str, float]:
    """embedding_numbers() of one set. v: p x d, known: p."""
    w = None if specificity is None else specificity[None]
    return {c: float(x[0]) for c, x in embedding_numbers(v[None], known[None], METHODS, missing, w).items()}


#: Numbers of the matrices that are held at once.
_HELD = 2_000_000


def _parts(own: np.ndarray, p: int) -> list[np.ndarray]:
    return [x for x in np.array_split(own, max(1, len(own) * p * p // _HELD)) if len(x)]


def _by_embedding(batches: Iterator[pa.RecordBatch], wanted: tuple[str, ...], missing: str) -> Iterator[pa.RecordBatch]:
    """Rows: set_key, rows (array of {at, v, w})."""
    for batch in batches:
        sets = batch.column("rows")
        lens = sets.value_lengths().to_numpy()
        ends = np.cumsum(lens)
        starts = ends - lens
        items = sets.flatten()
        vectors = items.field("v")
        dims = vectors.value_lengths().to_numpy()
        v = np.zeros((len(dims), int(dims.max(initial=1))))
        v[np.repeat(np.arange(len(dims)), dims), np.arange(int(dims.sum())) - np.repeat(np.cumsum(dims) - dims, dims)] = vectors.flatten().to_numpy()
        w = items.field("w").to_numpy(zero_copy_only=False)
        known = dims > 0
        n_known = np.r_[0, np.cumsum(known)]
        n_known = n_known[ends] - n_known[starts]
        out = {c: np.zeros(len(lens)) for c in wanted}
        weighted = bool((w != 1).any())
        for p, k in {(int(a), int(b)) for a, b in zip(lens, n_known, strict=True)}:
            if p > LARGE:
                for one in np.flatnonzero((lens == p) & (n_known == k)):
                    own = slice(starts[one], ends[one])
                    for c, x in large_numbers(v[own], known[own], wanted, missing, w[own] if weighted else None).items():
                        out[c][one] = x
                continue
            for part in _parts(np.flatnonzero((lens == p) & (n_known == k)), p):
                rows = starts[part][:, None] + np.arange(p)
                for c, x in embedding_numbers(v[rows], known[rows], wanted, missing, w[rows] if weighted else None).items():
                    out[c][part] = x
        yield pa.RecordBatch.from_arrays([batch.column("set_key"), *(pa.array(out[c], pa.float64()) for c in wanted)], ["set_key", *wanted])


def _by_similarity(batches: Iterator[pa.RecordBatch], wanted: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows: set_key, p, sims (array of {i, j, s}, places from 0)."""
    for batch in batches:
        size = batch.column("p").to_numpy()
        sims = batch.column("sims")
        lens = sims.value_lengths().to_numpy()
        ends = np.cumsum(lens)
        i, j, s = (sims.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "s"))
        out = {c: np.zeros(len(size)) for c in wanted} | {"nonpsd": np.zeros(len(size), bool)}
        for p in np.unique(size).tolist():
            for part in _parts(np.flatnonzero(size == p), p):
                m = np.zeros((len(part), p, p))
                m[:, np.arange(p), np.arange(p)] = 1.0
                for k, row in enumerate(part):
                    own = slice(ends[row] - lens[row], ends[row])
                    m[k, i[own], j[own]] = m[k, j[own], i[own]] = s[own]
                for c, x in similarity_numbers(m, wanted).items():
                    out[c][part] = x
        yield pa.RecordBatch.from_arrays([batch.column("set_key"), *(pa.array(out[c], pa.float64()) for c in wanted), pa.array(out["nonpsd"], pa.bool_())], ["set_key", *wanted, "nonpsd"])


# --- plans ------------------------------------------------------------------


def keyed_sets(shared: DataFrame, keys: tuple[str, ...] = ("user_a", "user_b")) -> DataFrame:
    """keys, packs (sorted) and set_key, equal for equal sets."""
    return with_set_key(shared.groupBy(*keys).agg(F.sort_array(F.collect_list("pack_id")).alias("packs")))


def with_set_key(sets: DataFrame) -> DataFrame:
    return sets.withColumn("set_key", F.md5(F.concat_ws(",", F.col("packs").cast("array<string>"))))


def set_numbers(sets: DataFrame, emb: DataFrame, wanted: tuple[str, ...] = METHODS, missing: str = "distinct", specificity: DataFrame | None = None) -> DataFrame:
    """set_key and the wanted estimators, once for each distinct set of keyed_sets(). specificity: pack_id, specificity."""
    if missing not in ("distinct", "drop"):
        raise ValueError(f"unknown policy {missing} for packs without an embedding")
    one = sets.groupBy("set_key").agg(F.first("packs").alias("packs")).select("set_key", F.posexplode("packs").alias("at", "pack_id"))
    rows = one.join(emb.select("pack_id", F.col("embedding").alias("v")), "pack_id", "left")
    rows = rows.withColumn("w", F.lit(1.0)) if specificity is None else rows.join(specificity.select("pack_id", F.col("specificity").alias("w")), "pack_id", "left")
    kind = dict(emb.dtypes)["embedding"]
    item = F.struct("at", F.coalesce("v", F.array().cast(kind)).alias("v"), F.coalesce("w", F.lit(1.0)).alias("w"))
    held = rows.groupBy("set_key").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    wanted = tuple(map(checked_method, wanted))
    return held.mapInArrow(lambda b: _by_embedding(b, wanted, missing), "set_key string, " + ", ".join(f"{c} double" for c in wanted))


def set_similarity_numbers(sets: DataFrame, sims: DataFrame, wanted: tuple[str, ...] = METHODS) -> DataFrame:
    """As set_numbers(), from a table of similarities (pack_i < pack_j, s; 0 where absent), with the flag nonpsd."""
    one = sets.groupBy("set_key").agg(F.first("packs").alias("packs"))
    first = one.select("set_key", "packs", F.posexplode("packs").alias("i", "pack_i"))
    found = first.select("set_key", "i", "pack_i", F.posexplode("packs").alias("j", "pack_j")).where("i < j").join(sims.toDF("pack_i", "pack_j", "s"), ["pack_i", "pack_j"])
    lists = found.groupBy("set_key").agg(F.collect_list(F.struct("i", "j", "s")).alias("sims"))
    none = F.expr("cast(array() AS array<struct<i:int,j:int,s:double>>)")
    rows = one.join(lists, "set_key", "left").select("set_key", F.size("packs").alias("p"), F.coalesce("sims", none).alias("sims"))
    wanted = tuple(map(checked_method, wanted))
    return rows.mapInArrow(lambda x: _by_similarity(x, wanted), "set_key string, " + ", ".join(f"{c} double" for c in wanted) + ", nonpsd boolean")


def for_pairs(
    pairs: DataFrame, shared: DataFrame, emb: DataFrame, method: str = "cluster_average", missing: str = "distinct", specificity: DataFrame | None = None,
    observation: Observation | None = None, keys: tuple[str, ...] = ("user_a", "user_b"),
) -> DataFrame:
    """pairs with k_shared, n_eff_effrank, n_eff_rowsum, n_eff_participation, n_eff_<method>, and n_eff, which is that of the method.

    Pairs that share nothing count 0. specificity weighs the eigenvalue family. An observation, if given,
    gets `mismatches` when the result is computed: pairs whose k_shared is not their shared_packs.
    """
    wanted = tuple(dict.fromkeys((*EIGEN, checked_method(method))))
    sets = keyed_sets(shared, keys)
    numbers = set_numbers(sets, emb, wanted, missing, specificity)
    numbers = numbers.select("set_key", *[F.col(c).alias(f"n_eff_{c}") for c in wanted])
    found = sets.select(*keys, "set_key", F.size("packs").cast("long").alias("k_shared")).join(numbers, "set_key", "left").drop("set_key")
    out = pairs.join(found, list(keys), "left").fillna(0, ["k_shared"]).fillna(0.0, [f"n_eff_{c}" for c in wanted]).withColumn("n_eff", F.col(f"n_eff_{method}"))
    if observation is not None and "shared_packs" in out.columns:
        out = out.observe(observation, F.count_if(F.col("k_shared") != F.col("shared_packs")).alias("mismatches"))
    return out


def for_sets(ones: DataFrame, sets: DataFrame, emb: DataFrame, method: str = "cluster_average", missing: str = "distinct", specificity: DataFrame | None = None) -> DataFrame:
    """user_a, user_b, shared_packs and the columns of for_pairs(), for co-member pairs whose sets are known: those of one pack (ones: user_a, user_b), which count 1, and keyed_sets() of more."""
    wanted = tuple(dict.fromkeys((*EIGEN, checked_method(method))))
    names = [f"n_eff_{c}" for c in wanted]
    k = F.size("packs").cast("long")
    several = sets.select("user_a", "user_b", k.alias("shared_packs"), k.alias("k_shared"), "set_key").join(set_numbers(sets, emb, wanted, missing, specificity).toDF("set_key", *names), "set_key").drop("set_key")
    one = ones.select("user_a", "user_b", F.lit(1).cast("long").alias("shared_packs"), F.lit(1).cast("long").alias("k_shared"), *[F.lit(1.0).alias(c) for c in names])
    return one.union(several).withColumn("n_eff", F.col(f"n_eff_{method}"))


def one_number(shared: DataFrame, emb: DataFrame, method: str, missing: str = "distinct", specificity: DataFrame | None = None) -> DataFrame:
    """user_a, user_b, n_eff by one estimator, for pairs that share a pack."""
    return sets_number(keyed_sets(shared), emb, method, missing, specificity)


def sets_number(sets: DataFrame, emb: DataFrame, method: str, missing: str = "distinct", specificity: DataFrame | None = None) -> DataFrame:
    """As one_number(), from keyed_sets()."""
    numbers = set_numbers(sets, emb, (method,), missing, specificity).withColumnRenamed(method, "n_eff")
    return sets.drop("packs").join(numbers, "set_key").drop("set_key")


def bundle(sets: DataFrame, emb: DataFrame, jaccard: DataFrame) -> DataFrame:
    """user_a, user_b, count, and every estimator under both signals (METHODS with __emb and __jac), with the flag nonpsd__jac.

    jaccard: pack_i < pack_j, jaccard, of the observed membership, also where sets are those of a null model.
    """
    e = set_numbers(sets, emb).select("set_key", *[F.col(c).alias(f"{c}__emb") for c in METHODS])
    j = set_similarity_numbers(sets, jaccard)
    j = j.select("set_key", *[F.col(c).alias(f"{c}__jac") for c in METHODS], F.col("nonpsd").alias("nonpsd__jac"))
    return sets.withColumn("count", F.size("packs").cast("double")).drop("packs").join(e, "set_key").join(j, "set_key").drop("set_key")


def tidy(bundled: DataFrame) -> DataFrame:
    """bundle() as user_a, user_b, statistic, value."""
    names = [c for c in bundled.columns if c not in ("user_a", "user_b", "nonpsd__jac")]
    return bundled.selectExpr("user_a", "user_b", f"stack({len(names)}, {', '.join(f"'{c}', `{c}`" for c in names)}) AS (statistic, value)")


def in_band(pairs: DataFrame, low: float, high: float, value: str = "n_eff") -> DataFrame:
    """Pairs whose value lies between two of its percentiles, both included."""
    ends = quantiles(pairs, value, [low, high]).get(0)
    return pairs.where(F.col(value).between(*ends)) if ends else pairs.limit(0)


def top_shared(shared: DataFrame, emb: DataFrame, top: int) -> DataFrame:
    """The packs shared by most pairs: pairs, and mean_distance, the mean over pairs of a pack's mean cosine
    distance to the other packs with an embedding that the pair shares (null where there is none).

    Similarities are computed once for each pair of packs: what many pairs share is summed first.
    """
    known = shared.join(emb.select("pack_id"), "pack_id", "left_semi")
    several = known.groupBy("user_a", "user_b").agg(F.count("*").alias("k")).where("k > 1")
    own = known.join(several, ["user_a", "user_b"]).select("user_a", "user_b", "pack_id", (1 / (F.col("k") - 1)).alias("share"))
    a, b = own.withColumnRenamed("pack_id", "pack_i"), own.drop("share").withColumnRenamed("pack_id", "pack_j")
    both = a.join(b, ["user_a", "user_b"]).where("pack_i < pack_j").groupBy("pack_i", "pack_j").agg(F.sum("share").alias("share"))
    g = pack_dots(both, emb).withColumn("far", F.col("share") * (1 - F.col("g")))
    far = g.select(F.col("pack_i").alias("pack_id"), "far").union(g.select("pack_j", "far")).groupBy("pack_id").agg(F.sum("far").alias("far"))
    far = far.join(own.groupBy("pack_id").agg(F.count("*").alias("n")), "pack_id").select("pack_id", (F.col("far") / F.col("n")).alias("mean_distance"))
    counts = shared.groupBy("pack_id").agg(F.count("*").alias("pairs"))
    return counts.join(far, "pack_id", "left").orderBy(F.desc("pairs"), "pack_id").limit(top)
