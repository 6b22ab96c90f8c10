"""The composite analyses: each takes tables and returns the tables that its figures and reports are made of."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covey.functions import draw_key, first_by_draw
from covey.operators import aggregates as ag
from covey.operators import graph as gr
from covey.operators import inference as inf
from covey.operators import information as io_
from covey.operators import membership as mb
from covey.operators import neff as ne
from covey.operators import nulls as nu
from covey.operators import pairs as pr
from covey.operators import text as tx
from covey.session import checkpointed, require_columns, written


def _weights(docs: DataFrame, min_df: int, max_df: float, sublinear: bool = True) -> DataFrame:
    docs = docs.where("text IS NOT NULL")
    tf = tx.term_counts(tx.tokens(docs))
    return tx.tfidf(tf, tx.vocabulary(tf, tx.n_docs(docs), min_df, max_df), sublinear)


def slice_analysis(m: DataFrame, posts: DataFrame, n_packs: int = 25, target_users: int = 150, max_shared: int = 4, seed: int = 42) -> dict[str, DataFrame]:
    """Directed information against packs shared, within a sample of whole packs."""
    users = mb.pack_slice(m, n_packs, target_users, seed=seed)
    seqs = io_.sequences(posts).join(users, "user_id", "left_semi")
    ids = seqs.select("user_id")
    ordered = ids.toDF("source").join(ids.toDF("target"), F.col("source") != F.col("target"))  # all pairs of target_users users
    info = io_.pairwise_information(ordered, seqs)
    sym = pr.symmetric_info(info.withColumn("entropy", (F.col("entropy_st") + F.col("entropy_ts")) / 2), "entropy")
    pairs = pr.shared_counts(sym, m).join(sym, ["user_a", "user_b"])
    return {"pairs": pairs, "curve": ag.by_level(pairs, F.least("shared_packs", F.lit(max_shared)), "entropy")}


def slice_cosine(m: DataFrame, docs: DataFrame, n_packs: int = 25, target_users: int = 150, max_shared: int = 4, min_df: int = 2, max_df: float = 1.0, seed: int = 42) -> dict[str, DataFrame]:
    """Cosine of all pairs against packs shared, within a sample of whole packs."""
    own = docs.join(mb.pack_slice(m, n_packs, target_users, seed=seed), "user_id", "left_semi")
    pairs = tx.all_cosines(_weights(own, min_df, max_df, sublinear=False), own)
    pairs = pr.shared_counts(pairs, m).join(pairs, ["user_a", "user_b"])
    return {"pairs": pairs, "curve": ag.by_level(pairs, F.least("shared_packs", F.lit(max_shared)))}


def census(m: DataFrame, docs: DataFrame, per_level: int = 1000, baseline_pairs: int = 1000, max_shared: int = 5, min_df: int = 10, max_df: float = 0.4, n_boot: int = 500, seed: int = 42) -> dict[str, DataFrame]:
    """Cosine of a stratified census of pairs, with a baseline that shares nothing, and its bootstrapped curve."""
    drawn = pr.comember_census(m, per_level, max_shared, seed, min_packs=2).unionByName(pr.baseline(m, baseline_pairs, seed))
    pairs = tx.listed_cosines(drawn, _weights(docs, min_df, max_df), docs.where("text IS NOT NULL"))
    return {"pairs": pairs, "curve": aggregate_only(pairs, max_shared, n_boot, seed)}


def aggregate_only(pairs: DataFrame, max_shared: int = 5, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """The census curve from stored pairs."""
    require_columns(pairs, "user_a", "user_b", "shared_packs", "cosine")
    return inf.cluster_bootstrap(pairs, F.least("shared_packs", F.lit(max_shared)), n_boot=n_boot, seed=seed)


def ego_cosine(ego: DataFrame, edges: DataFrame, docs: DataFrame, n_hops: int = 3, max_frontier: int | None = 20_000, max_alters: int = 60, min_df: int = 2, max_df: float = 1.0, seed: int = 42) -> dict[str, DataFrame]:
    """Cosine of one user (column node) with users at each distance, max_alters of a ring at most."""
    pairs = _alters(ego, edges, n_hops, max_frontier, max_alters, seed)
    scored = tx.listed_cosines(pairs.select(F.least("node", "alter").alias("user_a"), F.greatest("node", "alter").alias("user_b"), "hop"), _weights(docs, min_df, max_df), docs.where("text IS NOT NULL"))
    return {"pairs": scored, "curve": ag.by_level(scored, F.col("hop"))}


def ego_information(ego: DataFrame, edges: DataFrame, posts: DataFrame, n_hops: int = 3, max_frontier: int | None = 20_000, max_alters: int = 60, min_posts: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """Directed information between one user and users at each distance."""
    alters = _alters(ego, edges, n_hops, max_frontier, max_alters, seed)
    enough = tx.thresholds(posts, min_posts, 0).select("user_id")
    info = io_.pairwise_information(alters.select(F.col("node").alias("source"), F.col("alter").alias("target")), io_.sequences(posts.join(enough, "user_id", "left_semi")))
    pairs = info.join(alters.select(F.col("alter").alias("target"), "hop"), "target")
    return {"pairs": pairs, "curve": ag.by_level(pairs, F.col("hop"), "flow")}


def _alters(ego: DataFrame, edges: DataFrame, n_hops: int, max_frontier: int | None, max_alters: int, seed: int) -> DataFrame:
    """node (the ego), alter and hop: of each ring the first max_alters by draw."""
    rings = checkpointed(gr.rings(ego, edges, n_hops, max_frontier, seed).withColumn("key", draw_key(seed, "node")))
    first = first_by_draw(rings, ["hop"], max_alters, [F.col("key"), F.col("node")], F.col("key"))
    return first.select(F.col("node").alias("alter"), "hop").crossJoin(F.broadcast(ego.select("node")))  # one ego


def semantic_overlap(pairs: DataFrame, m: DataFrame, emb: DataFrame, max_shared: int = 8, n_boot: int = 500, seed: int = 42) -> dict[str, DataFrame]:
    """Pairs with effective numbers, the curve over rounded n_eff, what n_eff adds to the count, and violations."""
    out = ne.for_pairs(pairs, pr.shared_packs(pairs, m), emb)
    return {
        "pairs": out, "curve": inf.cluster_bootstrap(out, ag.rint_bin("n_eff", max_shared), n_boot=n_boot, seed=seed),
        "models": inf.two_predictors(out.where("k_shared > 0"), "k_shared", "n_eff", "cosine"), "mismatch": out.agg(F.count_if(F.col("k_shared") != F.col("shared_packs")).alias("mismatches")),
    }


def network(pairs: DataFrame, edges: DataFrame, max_hops: int = 3, directed: bool = False, n_boot: int = 500, seed: int = 42, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Follow distance as control and moderator. known: pairs that already have hops."""
    p = known if known is not None else gr.hops(pairs, edges, max_hops, directed)
    require_columns(p, "user_a", "user_b", "cosine", "n_eff", "hops")
    models = checkpointed(inf.bootstrap_models(p, "n_eff", "cosine", "hops", 1, n_boot, seed))
    points = inf.interaction(p, "n_eff", "cosine", "hops", 1).where("hops <> 1").select(F.concat(F.lit("n_eff:hops["), F.col("hops").cast("string"), F.lit("]")).alias("term"), F.col("difference").alias("estimate"))
    names = points.select("term", F.concat(F.lit("interaction|"), F.regexp_extract("term", r"\[(.*)\]", 1)).alias("boot_term"))
    return {
        "pairs": p, "by_hops": inf.cluster_bootstrap(p, F.col("hops"), n_boot=n_boot, seed=seed), "cells": ag.cells(p, max_hops), "diagnostic": ag.cell_diagnostic(p),
        "cell_means": inf.cell_bootstrap(p.withColumn("stratum", ag.stratum()), ("stratum", "hops"), n_boot=n_boot, seed=seed),
        "control": inf.controlled_slope(p, "n_eff", "cosine", "hops"), "interaction": inf.interaction(p, "n_eff", "cosine", "hops", 1), "bootstrap": models, "coefficients": coefficients(points, models, names),
    }


def coefficients(points: DataFrame, boots: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Point estimates (term, estimate) with the intervals of the terms that names (term, boot_term) maps them to."""
    mapped = points.join(names, "term", "left").withColumn("boot_term", F.coalesce("boot_term", "term")) if names is not None else points.withColumn("boot_term", F.col("term"))
    return mapped.join(boots.select(F.col("term").alias("boot_term"), "ci_low", "ci_high"), "boot_term", "left").select("term", "estimate", "ci_low", "ci_high")


def _replicates(m: DataFrame, ensemble: str, seeds: list[int], pairs: DataFrame, trades: int | None, fitted: bool = True) -> DataFrame:
    if ensemble == "microcanonical":
        return nu.curveball(m, seeds, trades)
    if ensemble != "canonical":
        raise ValueError(f"unknown ensemble {ensemble}; there are canonical and microcanonical")
    return nu.samples(*(nu.fit(m) if fitted else nu.start_values(m)), seeds, inf.ends(pairs).toDF("user_id"))


def null_model(
    m: DataFrame, pairs: DataFrame, emb: DataFrame, statistic: str = "slope", ensemble: str = "microcanonical", n_replicates: int = 100, seed: int = 0,
    method: str = "effrank", trades: int | None = None, task: int = 0, tasks: int = 1, fitted: bool = True, reference: int | None = None,
) -> dict[str, DataFrame]:
    """A statistic of cosine on n_eff under randomised memberships: `replicates` of one of several tasks, and `observed`.

    pairs: user_a, user_b, cosine and, for statistic="interaction", hops; these stay fixed. fitted=False takes the
    sparse limit of the canonical ensemble's fitnesses instead of fitting them.
    """
    scored = checkpointed(nu.under(_replicates(m, ensemble, nu.task_seeds(n_replicates, seed, task, tasks), pairs, trades, fitted), pairs, emb, method))
    own = checkpointed(ne.for_pairs(pairs, pr.shared_packs(pairs, m), emb, method))
    return {"replicates": nu.statistics(scored, statistic, reference=reference), "observed": nu.statistics(own, statistic, keys=(), reference=reference)}


def null_task(folder: str, m: DataFrame, pairs: DataFrame, emb: DataFrame, task: int = 0, tasks: int = 1, **more) -> bool:
    """null_model() of one of several tasks, its replicates and the observed statistics as tables of their own under `folder`.

    A task whose replicates are there, whole, is not run again; returns whether it ran.
    """
    spark, path = m.sparkSession, f"{folder}/replicates/task={task}"
    if written(spark, path):
        return False
    out = null_model(m, pairs, emb, task=task, tasks=tasks, **more)
    if not written(spark, f"{folder}/observed"):
        out["observed"].write.mode("overwrite").parquet(f"{folder}/observed")
    out["replicates"].write.mode("overwrite").parquet(path)
    return True


def null_reduce_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The observed statistics against the replicates of whatever tasks are there."""
    return nu.reduce(spark.read.parquet(f"{folder}/observed"), spark.read.parquet(f"{folder}/replicates").drop("task"))


def null_reduce(observed: DataFrame, replicates: DataFrame) -> DataFrame:
    """The observed statistics against the replicates of all tasks."""
    return nu.reduce(observed, replicates)


def null_curves(m: DataFrame, pairs: DataFrame, emb: DataFrame, ensemble: str = "microcanonical", n_replicates: int = 100, max_shared: int = 8, seed: int = 0, method: str = "effrank", trades: int | None = None, n_boot: int = 500) -> dict[str, DataFrame]:
    """Mean cosine by packs shared and by n_eff, observed and under the null."""
    scored = checkpointed(nu.under(_replicates(m, ensemble, nu.task_seeds(n_replicates, seed), pairs, trades), pairs, emb, method))
    own = checkpointed(ne.for_pairs(pairs, pr.shared_packs(pairs, m), emb, method))
    return {"curves": nu.curves(own, scored, max_shared, n_boot, seed)}


def cooccurrence(m: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Packs shared against the canonical ensemble: p of each pair, the smallest first, and the share below 0.05."""
    users, packs = nu.fit(m)
    table = checkpointed(nu.with_p(nu.cooccurrence(pr.shared_counts(pairs, m), users, packs)))
    return {"pairs": table.orderBy("p_value", "user_a", "user_b"), "summary": nu.cooccurrence_summary(table), "margins": nu.expected_margins(users, packs)}


def degree_diagnostic(m: DataFrame, observed: DataFrame, n_pairs: int = 10_000, seeds: tuple[int, ...] = (0,), seed: int = 42) -> dict[str, DataFrame]:
    """Degrees of the ends of pairs drawn at random that share nothing, of observed pairs that share, and of the same pairs under a null;
    the order of their medians; cosine by degree."""
    degrees = checkpointed(mb.user_margins(m).toDF("node", "degree"))
    uniform = pr.uniform_pairs(m, n_pairs, seed)
    nulls = nu.under_counts(nu.curveball(m, list(seeds)), uniform)
    summary = checkpointed(ag.degree_populations({"uniform": pr.shared_counts(uniform, m).where("shared_packs = 0"), "null": nulls.where("shared_packs > 0"), "observed": observed.where("shared_packs > 0")}, degrees))
    a, b = degrees.toDF("user_a", "da"), degrees.toDF("user_b", "db")
    joined = observed.join(a, "user_a").join(b, "user_b").withColumn("largest", F.greatest("da", "db").cast("double"))
    return {"populations": summary, "order": ag.median_order(summary, ("uniform", "null", "observed")), "ccdf": ag.ccdf(degrees, "degree"), "curve": ag.quantile_curve(joined, "largest", "cosine")}


def pair_inspection(m: DataFrame, emb: DataFrame, pairs: DataFrame | None = None, n_draws: int = 1600, seed: int = 42) -> dict[str, DataFrame]:
    """Five pairs with all their effective numbers: the most and the least alike shared packs at one number of them, and others of other numbers."""
    listed = pairs if pairs is not None else pr.uniform_pairs(pr.eligible(m, 2), n_draws, seed)
    sets = checkpointed(ne.keyed_sets(pr.shared_packs(listed, m)).where(F.size("packs") >= 2))
    mean = ne.sets_number(sets, emb, "mean_interp").join(sets.select("user_a", "user_b", F.size("packs").alias("p")), ["user_a", "user_b"])
    stats = checkpointed(mean.select("user_a", "user_b", "p", (1 - (F.col("n_eff") - 1) / (F.col("p") - 1)).alias("alike")))
    five = checkpointed(pr.select_five(stats, "p", "alike", seed))
    own = sets.join(five.select("user_a", "user_b"), ["user_a", "user_b"], "left_semi")
    members = m.join(own.select(F.explode("packs").alias("pack_id")).distinct(), "pack_id", "left_semi")
    numbers = ne.bundle(own, emb, ne.jaccard_packs(members))
    return {"pairs": five, "numbers": numbers, "tidy": ne.tidy(numbers)}


def vocabulary_report(pairs: DataFrame, docs: DataFrame, grid: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), min_df: int = 10, max_shared: int = 8, top: int = 50) -> dict[str, DataFrame]:
    """How the curve of cosine by packs shared depends on the ceiling of document frequency: terms and tokens left, terms cut, curves, their spread and rise, slopes for 1..8 packs."""
    docs = docs.where("text IS NOT NULL")
    tf, size = checkpointed(tx.term_counts(tx.tokens(docs))), tx.n_docs(docs)
    users = inf.ends(pairs).toDF("user_id")
    curves = slopes = None
    for ceiling in grid:
        scored = checkpointed(tx.listed_cosines(pairs, tx.tfidf(tf, tx.vocabulary(tf, size, min_df, ceiling), users=users), docs))
        one = ag.by_level(scored, F.least("shared_packs", F.lit(max_shared))).select(F.lit(float(ceiling)).alias("max_df"), "level", "mean", "n")
        slope = inf.slopes(scored.where(F.col("shared_packs").between(1, 8)), "shared_packs", "cosine", []).select(F.lit(float(ceiling)).alias("max_df"), "n", "slope")
        curves, slopes = (one, slope) if curves is None else (curves.union(one), slopes.union(slope))
    return {"sweep": tx.df_sweep(tf, size, grid, min_df), "terms": tx.cut_terms(tf, size, 0.4, min_df, top), "curves": curves, "swing": ag.swing(curves, "max_df"), "monotone": ag.monotone(curves, "max_df"), "slopes": slopes}


def fit_corpus(pairs: DataFrame, docs: DataFrame, min_df: int = 10, max_df: float = 0.4) -> dict[str, DataFrame]:
    """Cosines of pairs by a fit on all users with a text (A), on the users of pairs with two texts (B), and on these with A's ceiling (C): terms, differences to A, and whether the tables have the same pairs."""
    docs = docs.where("text IS NOT NULL")
    known = checkpointed(tx.of_users(docs, inf.ends(pairs).toDF("user_id")).select("user_id").distinct())
    pairs = checkpointed(pairs.join(known.toDF("user_a"), "user_a", "left_semi").join(known.toDF("user_b"), "user_b", "left_semi"))
    users = inf.ends(pairs).toDF("user_id")
    own = checkpointed(tx.term_counts(tx.tokens(tx.of_users(docs, users))))
    every, some = F.broadcast(checkpointed(tx.n_docs(docs))), tx.n_docs(users)
    vocab = {"A": tx.kept_terms(tx.document_frequencies(docs), every, min_df, max_df), "B": tx.vocabulary(own, some, min_df, max_df), "C": tx.vocabulary(own, every, min_df, max_df).drop("n_docs").crossJoin(some)}
    scored = {k: checkpointed(tx.listed_cosines(pairs, tx.tfidf(own, v), known)) for k, v in vocab.items()}
    terms = differences = None
    for k, v in vocab.items():
        one = v.agg(F.count("*").alias("terms")).select(F.lit(k).alias("variant"), "terms")
        far = tx.cosine_differences(scored["A"], scored[k]).withColumn("variant", F.lit(k))
        terms, differences = (one, far) if terms is None else (terms.union(one), differences.union(far))
    return {"terms": terms, "differences": differences, "same_pairs": pr.same_pairs(scored["A"], scored["B"]), **{f"pairs_{k}": t for k, t in scored.items()}}


class Report:
    """Text with small tables; contradictions come first."""

    def __init__(self, folder: str):
        self.folder, self.lines, self.found = Path(folder), [], []

    def heading(self, text: str) -> None:
        self.lines += ["", f"## {text}", ""]

    def line(self, text: str) -> None:
        self.lines.append(text)

    def contradict(self, text: str) -> None:
        self.found.append(text)
        self.lines.append(f"CONTRADICTION: {text}")

    def table(self, df: DataFrame, name: str, most: int = 1000) -> None:
        """A table of at most `most` rows, as CSV and Parquet beside the text and in it."""
        rows = df.limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"{name} is too long for a report; write it as a table")
        self.folder.mkdir(parents=True, exist_ok=True)
        rows.to_csv(self.folder / f"{name}.csv", index=False)
        rows.to_parquet(self.folder / f"{name}.parquet", index=False)
        self.lines += [rows.to_string(index=False), ""]

    def flush(self, name: str = "report.txt") -> str:
        self.folder.mkdir(parents=True, exist_ok=True)
        head = [f"{len(self.found)} contradictions", *[f"- {x}" for x in self.found]]
        text = "\n".join([*head, *self.lines]) + "\n"
        (self.folder / name).write_text(text)
        return text


def numbers_report(pairs: DataFrame, folder: str, max_hops: int = 3, n_boot: int = 500, seed: int = 42, m: DataFrame | None = None, emb: DataFrame | None = None) -> str:
    """The numbers of a pair table (shared_packs, n_eff, cosine, hops) as a report with its tables; contradictions come first.

    With a membership and embeddings, the packs that the pairs of largest and of middling n_eff share most are listed too.
    """
    require_columns(pairs, "user_a", "user_b", "shared_packs", "n_eff", "cosine", "hops")
    p, r = checkpointed(pairs), Report(folder)
    r.heading("1 Invariants")
    checks = ag.invariants(p, max_hops)
    r.table(checks, "invariants")
    broken = {k: v for k, v in checks.first().asDict().items() if k not in ("pairs", "sentinels") and v}
    if broken:
        r.contradict(f"the pair table breaks invariants: {broken}")
    r.heading("2 Slopes of cosine on packs shared")
    spans = [inf.slopes(p.where(F.col("shared_packs").between(low, 8)), "shared_packs", "cosine", []).select(F.lit(f"{low}-8").alias("span"), "n", "slope", "intercept", "r2") for low in (1, 0)]
    r.table(spans[0].union(spans[1]), "slopes")
    if any((x["slope"] or 0) <= 0 for x in spans[0].union(spans[1]).collect()):
        r.contradict("cosine does not rise with packs shared")
    r.heading("3 From counts to effective numbers")
    r.table(ag.distribution(p, "shared_packs", "n_eff"), "distribution")
    r.table(ag.ratio_by_count(p, "shared_packs", "n_eff"), "ratio_by_count")
    r.table(inf.two_predictors(p.where("shared_packs > 0"), "shared_packs", "n_eff", "cosine"), "two_predictors")
    r.heading("4 Cells of common ground and distance")
    r.table(ag.cells(p, max_hops), "cells")
    r.table(ag.cell_diagnostic(p), "cell_diagnostic")
    r.heading("5 Interaction on a log scale, and models with log link")
    offsets = [inf.interaction(p.withColumn("__y", F.ln(F.col("cosine") + eps)), "n_eff", "__y", "hops", 1).select(F.lit(eps).alias("eps"), "*") for eps in (1e-2, 1e-3, 1e-4)]
    logs = checkpointed(inf.with_t_p(offsets[0].union(offsets[1]).union(offsets[2]), "t", "df"))
    r.table(logs, "log_interaction")
    r.table(inf.stability(logs, "eps", ["hops"]), "log_stability")
    glm = inf.log_link(p, "n_eff", "cosine", by="hops")
    r.table(glm, "log_link")
    r.table(inf.sign_agreement(glm), "log_link_signs")
    if glm.where("term LIKE '%:%'").groupBy("term").agg((F.countDistinct(F.signum("estimate")) > 1).alias("apart")).where("apart").count():
        r.contradict("the two families disagree in the sign of an interaction")
    r.heading("6 Contrasts of strata")
    sums = inf.mean_sums("high", "cosine", "n_eff > 3") | inf.mean_sums("low", "cosine", "n_eff < 1")
    high, low = inf.wmean("high"), inf.wmean("low")
    r.table(inf.bootstrap_statistics(p, sums, {"gap": high - low, "ratio": F.try_divide(high, low), "log_ratio": F.ln(F.try_divide(high, low))}, n_boot, seed), "contrasts")
    r.table(inf.bootstrap_models(p, "n_eff", "cosine", "hops", 1, n_boot, seed), "models")
    r.heading("7 Degree-matched pairs")
    degrees = p.select(F.explode(F.array("user_a", "user_b")).alias("user")).groupBy("user").agg(F.count("*").alias("k"))
    deciles = checkpointed(pr.value_decile(degrees, "k").select("user", "decile"))
    a, b = deciles.toDF("user_a", "da"), deciles.toDF("user_b", "db")
    own = p.join(a, "user_a").join(b, "user_b").withColumn("cell", F.concat_ws("-", F.least("da", "db").cast("string"), F.greatest("da", "db").cast("string")))
    matched = pr.degree_matched(own.where("shared_packs > 0").select("user_a", "user_b", "cell", "cosine", "shared_packs"), own.where("shared_packs = 0").select("user_a", "user_b", "cell", "cosine"), seed)
    curve = checkpointed(matched.groupBy(F.col("shared_packs").alias("level")).agg(F.count("*").alias("n"), F.count("matched").alias("n_matched"), F.avg("cosine").alias("mean"), F.avg("matched").alias("matched")))
    r.table(curve.orderBy("level"), "degree_matched")
    r.table(ag.first_crossing(curve), "crossing")
    if m is not None and emb is not None:
        r.heading("8 Packs shared at large and middling effective numbers")
        shared = p.where("shared_packs > 0")
        for name, low_at, high_at in (("top_decile", 0.9, 1.0), ("median_band", 0.45, 0.55)):
            r.table(ne.top_shared(pr.shared_packs(ne.in_band(shared, low_at, high_at), m), emb, 200), f"packs_{name}")
    return r.flush()


def scrubbed(text: str) -> str:
    """Dates and times of a printed summary as fixed words."""
    return re.sub(r"\d{1,2}:\d{2}:\d{2}", "<time>", re.sub(r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{1,2} \w{3} \d{4}", "<date>", text))
