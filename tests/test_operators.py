"""Operators on small cases with known answers."""

import json
from math import log

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from covey.operators import aggregates as ag
from covey.operators import edges as ed
from covey.operators import graph as gr
from covey.operators import inference as inf
from covey.operators import information as info
from covey.operators import membership as mb
from covey.operators import neff as ne
from covey.operators import nulls as nu
from covey.operators import pairs as pr
from covey.operators import text as tx
from covey.plans import analyses as an
from covey.session import checkpointed, require_columns
from covey.sources import io
from covey.streaming import stream_degrees


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# effective numbers


def unit(*v):
    v = np.array(v, float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_redundant_packs():
    v = unit([1, 0], [1, 0], [1, 0], [1, 0], [0, 1])
    n = ne.all_numbers(v, np.ones(5, bool))
    assert n["rowsum"] == pytest.approx(2.0) and n["effrank"] == pytest.approx(1.649, abs=1e-3) and n["participation"] == pytest.approx(1.471, abs=1e-3)
    assert all(n[f"cluster_{m}"] == pytest.approx(2.0) for m in ("single", "complete", "average"))
    distinct = ne.all_numbers(np.eye(3), np.ones(3, bool))
    assert all(x == pytest.approx(3.0) for x in distinct.values())


@pytest.mark.parametrize("k", [0, 1])
def test_short_sets(k):
    assert set(ne.all_numbers(np.zeros((k, 2)), np.zeros(k, bool), "drop").values()) == {float(k)}


def test_missing_policy():
    v = np.vstack([unit([1, 0], [1, 1]), [[0, 0]]])
    known = np.array([True, True, False])
    kept, dropped = ne.all_numbers(v, known), ne.all_numbers(v, known, "drop")
    assert kept["rowsum"] == pytest.approx(dropped["rowsum"] + 1) and kept["cluster_average"] == dropped["cluster_average"]
    assert ne.all_numbers(np.zeros((2, 2)), np.zeros(2, bool), "drop")["effrank"] == 0


def test_linkage_of_three():
    s = np.array([[1, 0.7, 0.4], [0.7, 1, 0.2], [0.4, 0.2, 1]])
    assert [ne.linkage(s, m) for m in ("single", "average", "complete")] == pytest.approx([1.9, 2.0, 2.1])
    with pytest.raises(ValueError):
        ne.linkage(s, "ward")


def test_linkage_against_plain_agglomeration():
    rng = np.random.default_rng(0)
    for method in ("single", "complete", "average"):
        for n in (2, 4, 9):
            s = rng.random((n, n))
            s = (s + s.T) / 2
            groups, total = [[k] for k in range(n)], 0.0
            far = {"single": min, "complete": max, "average": lambda x: sum(x) / len(x)}[method]
            while len(groups) > 1:
                d, a, b = min((far([1 - s[i, j] for i in x for j in y]), p, q) for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q)
                total += d
                groups[a] += groups.pop(b)
            assert ne.linkage(s, method) == pytest.approx(1 + total)


@pytest.mark.parametrize("p", [2, 3, 4, 7])
def test_batches_agree_with_single_sets(p):
    rng = np.random.default_rng(p)
    v = rng.normal(size=(6, p, 4))
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    v[0, 0] = 0
    v[1, 1] = v[1, 0]
    out = ne.embedding_numbers(v, np.linalg.norm(v, axis=2) > 0)
    for k in range(6):
        one = ne.all_numbers(v[k], np.linalg.norm(v[k], axis=1) > 0)
        assert {c: x[k] for c, x in out.items()} == pytest.approx(one)


def test_weights_are_repaired_before_their_mean_is():
    assert ne.set_weights(np.array([0.0, 3.0])).tolist() == [0.5, 1.5]
    assert ne.set_weights(np.array([np.nan, -2.0, np.inf])).tolist() == [1, 1, 1]
    v, w = unit([1, 0], [1, 1]), np.array([0.0, 3.0])
    g = (v @ v.T) * np.sqrt(np.outer([0.5, 1.5], [0.5, 1.5]))
    n = ne.all_numbers(v, np.ones(2, bool), specificity=w)
    assert n["participation"] == pytest.approx(4 / (g * g).sum()) and n["cluster_single"] == pytest.approx(2 - v[0] @ v[1])


def test_similarities_that_are_not_positive():
    s = np.array([[1, 0.9, 0], [0.9, 1, 0.9], [0, 0.9, 1]])
    lam = np.linalg.eigvalsh(s)
    q = lam[lam > 1e-12] / lam[lam > 1e-12].sum()
    out = ne.similarity_numbers(s[None])
    assert out["nonpsd"].tolist() == [True] and not ne.similarity_numbers(np.eye(3)[None])["nonpsd"][0]
    assert out["effrank"][0] == pytest.approx(np.exp(-(q * np.log(q)).sum())) and out["participation"][0] == pytest.approx(9 / (s * s).sum())
    assert out["rowsum"][0] == pytest.approx((1 / s.sum(axis=1)).sum()) and out["mean_interp"][0] == pytest.approx(1 + (1 - 0.6) * 2)


def test_neff_of_pairs(spark):
    data = [(u, p) for u in range(4) for p in range(6) if (u + p) % 4]
    m = frame(spark, data, "user_id long, pack_id long")
    rng = np.random.default_rng(2)
    vectors = {p: unit(rng.normal(size=3).tolist())[0] for p in range(4)}
    emb = frame(spark, [(p, [float(x) for x in v]) for p, v in vectors.items()], "pack_id long, embedding array<double>")
    spec = {0: 2.0, 1: 0.0, 2: 0.7, 4: 5.0}
    weights = frame(spark, list(spec.items()), "pack_id long, specificity double")
    pairs = pr.comember_pairs(m).withColumn("shared_packs", F.col("shared_packs") + F.when(F.col("user_a") == 0, 1).otherwise(0))
    shared = pr.shared_packs(pairs, m)
    with pytest.raises(ValueError):
        ne.for_pairs(pairs, shared, emb, method="cluster_ward")
    for missing, specificity, method in (("distinct", None, "cluster_average"), ("drop", None, "effrank"), ("distinct", weights, "cluster_single"), ("drop", weights, "mean_interp")):
        seen = Observation()
        out = {(r.user_a, r.user_b): r for r in ne.for_pairs(pairs, shared, emb, method, missing, specificity, seen).collect()}
        assert seen.get["mismatches"] == sum(a == 0 for a, _ in out) and len(out) == pairs.count()
        for (a, b), r in out.items():
            packs = sorted({p for u, p in data if u == a} & {p for u, p in data if u == b})
            v = np.array([vectors.get(p, np.zeros(3)) for p in packs])
            want = ne.all_numbers(v, np.array([p in vectors for p in packs]), missing, None if specificity is None else np.array([spec.get(p, 1.0) for p in packs]))
            assert r.k_shared == len(packs) and r.n_eff == pytest.approx(want[method]), (missing, method)
            assert all(r[f"n_eff_{c}"] == pytest.approx(want[c]) for c in ne.EIGEN)
    both = ne.bundle(ne.keyed_sets(shared), emb, ne.jaccard_packs(m))
    members = {p: {u for u, q in data if q == p} for p in range(6)}
    for r in both.collect():
        packs = sorted({p for u, p in data if u == r.user_a} & {p for u, p in data if u == r.user_b})
        s = np.array([[len(members[p] & members[q]) / len(members[p] | members[q]) for q in packs] for p in packs])
        assert all(r[f"{c}__jac"] == pytest.approx(float(x[0])) for c, x in ne.similarity_numbers(s[None]).items() if c != "nonpsd")
    assert ne.tidy(both).count() == 15 * both.count()


def test_large_packs_are_dealt_out(spark, monkeypatch):
    m = frame(spark, [(u, p) for u in range(60) for p in range(3) if (u * 7 + p) % 3], "user_id long, pack_id long")
    want = rows(pr.comember_pairs(m))
    monkeypatch.setattr(pr, "BLOCK", 7)
    assert rows(pr.comember_pairs(m)) == want
    sets = {(r.user_a, r.user_b): r.packs for r in pr.comember_sets(m, 2).collect()}
    assert {(a, b): n for a, b, n in want if n >= 2} == {k: len(v) for k, v in sets.items()}


# edges and graphs

EDGES = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "d"), ("e", "e"), ("d", "f"), ("f", "g")]


def test_edges(spark):
    e = frame(spark, EDGES, "source string, target string")
    some = frame(spark, [("a",), ("b",), ("c",)], "node string")
    assert rows(ed.reciprocal(e)) == [("a", "b"), ("b", "a"), ("e", "e")]
    assert rows(ed.induced(e, some)) == [("a", "b"), ("a", "b"), ("b", "a")]
    assert rows(ed.induced(e, some, either=True)) == [("a", "b"), ("a", "b"), ("b", "a"), ("c", "d")]
    assert rows(ed.without(e, some)) == [("d", "f"), ("e", "e"), ("f", "g")]
    assert ed.deduped(e).count() == 6
    assert dict(rows(ed.total_degrees(e)))["e"] == 2
    assert rows(ed.capped(e, 2)) == [("c", "d"), ("d", "f"), ("e", "e"), ("f", "g")]
    assert rows(ed.core(e, 2)) == [("a", "b"), ("a", "b"), ("b", "a"), ("e", "e")]
    assert rows(ed.degree_table(e))[0] == ("a", 2, 1, 3)


def test_hops(spark):
    e = frame(spark, EDGES, "source string, target string")
    p = frame(spark, [("a", "b"), ("a", "a"), ("c", "f"), ("c", "g"), ("g", "c"), ("c", "g"), ("a", "zz"), ("a", "c")], "user_a string, user_b string")
    assert rows(gr.hops(p, e, 2)) == sorted([("a", "b", 1), ("a", "a", 3), ("c", "f", 2), ("c", "g", 3), ("g", "c", 3), ("c", "g", 3), ("a", "zz", 3), ("a", "c", 3)], key=str)
    assert {(r.user_a, r.user_b): r.hops for r in gr.hops(p, e, 3, directed=True).collect()}[("g", "c")] == 4
    assert {(r.user_a, r.user_b): r.hops for r in gr.hops(p, e, 3, directed=True).collect()}[("c", "g")] == 3


def test_paths_and_rings(spark):
    e = frame(spark, EDGES, "source string, target string")
    q = frame(spark, [("c",), ("g",), ("e",), ("nobody",)], "node string")
    assert rows(gr.shortest_paths(q, e)) == [("c", "e", -1), ("c", "g", 3), ("e", "c", -1), ("e", "g", -1), ("g", "c", -1), ("g", "e", -1)]
    assert rows(gr.shortest_paths(q, e, drop_unreachable=True)) == [("c", "g", 3)]
    assert rows(gr.rings(q.where("node = 'c'"), e, 2)) == [("d", 1), ("f", 2)]
    assert gr.rings(q.where("node = 'c'"), e, 3, max_frontier=1).count() == 3


def test_streaming_degrees(spark, tmp_path):
    frame(spark, EDGES, "source string, target string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("source string, target string").parquet(str(tmp_path / "e"))
    q = stream_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("degrees")) == rows(ed.total_degrees(frame(spark, EDGES, "source string, target string")))


# texts


def test_tokenizer(spark):
    d = frame(spark, [(1, "Café #Ünï don't x #été see https://a.b/c @you.there www.x.y The THE"), (2, None)], "user_id long, text string")
    assert [r.term for r in tx.tokens(d).collect()] == ["caf", "#ünï", "don't", "#été", "see"]
    assert [r.term for r in tx.tokens(d, stop_words=("see", "don't")).collect()] == ["caf", "#ünï", "#été", "the", "the"]
    assert "you" not in {r.term for r in tx.tokens(d).collect()} and "there" not in {r.term for r in tx.tokens(d, keep_mentions=True).collect()}


def test_tfidf_is_the_usual_formula(spark):
    d = frame(spark, [(1, "aa bb bb"), (2, "aa cc"), (3, "dd")], "user_id long, text string")
    tf = tx.term_counts(tx.tokens(d))
    w = {(r.user_id, r.term): r.weight for r in tx.tfidf(tf, tx.vocabulary(tf, tx.n_docs(d), 1, 1.0)).collect()}
    a, b = log(4 / 3) + 1, (1 + log(2)) * (log(4 / 2) + 1)
    assert w[1, "bb"] == pytest.approx(b / (a * a + b * b) ** 0.5)
    cos = {(r.user_a, r.user_b): r.cosine for r in tx.all_cosines(tx.tfidf(tf, tx.vocabulary(tf, tx.n_docs(d), 1, 1.0)), d).collect()}
    assert cos[1, 3] == 0 and cos[1, 2] == pytest.approx(w[1, "aa"] * w[2, "aa"])


# aggregates and inference


def pair_frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    data = [(int(rng.integers(20)), int(30 + rng.integers(20)), int(s := rng.integers(0, 6)), float(0.1 + 0.02 * s + rng.normal(0, 0.05)), float(s * 0.7), int(rng.integers(1, 4))) for _ in range(n)]
    return frame(spark, data, "user_a long, user_b long, shared_packs long, cosine double, n_eff double, hops long"), data


def test_single_row_bin(spark):
    p = frame(spark, [(0, 0.5)], "shared_packs long, cosine double")
    r = ag.by_level(p, F.col("shared_packs")).first()
    assert (r["std"], r["sem"], r["n"]) == (0.0, 0.0, 1)


def test_rint(spark):
    p = frame(spark, [(0.5,), (1.5,), (2.5,), (9.0,), (-1.0,)], "x double")
    assert [r[0] for r in p.select(ag.rint_bin("x", 5)).collect()] == [0, 2, 2, 5, 0]


def test_regressions_against_lstsq(spark):
    df, data = pair_frame(spark)
    x, y, h, e = (np.array([r[k] for r in data], float) for k in (2, 3, 5, 4))
    beta = np.linalg.lstsq(np.c_[np.ones_like(x), x], y, rcond=None)[0]
    got = inf.slopes(df, "shared_packs", "cosine", []).first()
    assert (got.intercept, got.slope) == pytest.approx(tuple(beta))
    levels = [1, 2, 3]
    x2 = np.c_[x, *[(h == k).astype(float) for k in levels]]
    assert inf.controlled_slope(df, "shared_packs", "cosine", "hops").first().slope_with == pytest.approx(np.linalg.lstsq(x2, y, rcond=None)[0][0])
    full = np.c_[x2[:, 1:], x, *[x * (h == k) for k in (2, 3)]]
    b, rss = np.linalg.lstsq(full, y, rcond=None)[:2]
    cov = float(rss[0]) / (len(y) - 6) * np.linalg.inv(full.T @ full)
    got = {r.hops: r for r in inf.interaction(df, "shared_packs", "cosine", "hops", 1).collect()}
    assert got[2].difference == pytest.approx(b[4]) and got[3].se == pytest.approx(cov[5, 5] ** 0.5)
    noisy = df.withColumn("x2", F.col("n_eff") + F.col("hops"))
    b = np.linalg.lstsq(np.c_[np.ones_like(x), x, e + h], y, rcond=None)[0]
    two = inf.two_predictors(noisy, "shared_packs", "x2", "cosine").first()
    assert (two.b1, two.b2) == pytest.approx((b[1], b[2])) and two.gain >= 0


def test_student():
    assert inf.student_p(2.0, 10) == pytest.approx(0.0734, abs=2e-4) and inf.student_p(0.0, 5) == pytest.approx(1.0) and inf.student_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_bootstrap(spark):
    df, _ = pair_frame(spark)
    out = inf.cluster_bootstrap(df, F.col("shared_packs"), n_boot=60).collect()
    assert all(r.ci_low < r["mean"] < r.ci_high for r in out) and len(out) == 6
    assert rows(inf.cluster_bootstrap(df.repartition(5), F.col("shared_packs"), n_boot=20).select("level", F.round("ci_low", 9))) == rows(inf.cluster_bootstrap(df, F.col("shared_packs"), n_boot=20).select("level", F.round("ci_low", 9)))
    users = inf.ends(df).withColumnRenamed("user", "unit")
    draws = {r.unit: np.frombuffer(r.drawn, np.uint8) for r in inf.drawn(users, 7).collect()}
    assert set(sum(draws.values()).tolist()) == {users.count()}
    some = inf.resampled_sums(df, {"w": F.lit(1.0), "x": F.col("cosine")}, 7, keys=("hops",)).collect()
    plain = df.collect()
    none = np.zeros(7)
    for r in some:
        own = [p for p in plain if p.hops == r.hops]
        w = [1.0 if r.boot < 0 else float(draws.get(p.user_a, none)[r.boot]) * float(draws.get(p.user_b, none)[r.boot]) for p in own]
        assert (r.w, r.x) == pytest.approx((sum(w), sum(a * p.cosine for a, p in zip(w, own, strict=True))))
    rowwise = inf.cell_bootstrap(df.withColumn("id", F.monotonically_increasing_id()), ("hops",), "cosine", 50, unit="id").collect()
    assert all(r.ci_low <= r["mean"] <= r.ci_high for r in rowwise)


def test_bootstrapped_models(spark):
    df, _ = pair_frame(spark)
    got = {r.term: r for r in inf.bootstrap_models(df, "shared_packs", "cosine", "hops", 1, 80).collect()}
    assert set(got) == {"x|alone", "x|with levels", "slope|1", "slope|2", "slope|3", "interaction|2", "interaction|3"}
    assert got["x|alone"].estimate == pytest.approx(inf.slopes(df, "shared_packs", "cosine", []).first().slope)
    assert got["x|with levels"].estimate == pytest.approx(inf.controlled_slope(df, "shared_packs", "cosine", "hops").first().slope_with)
    each = {r.hops: r for r in inf.interaction(df, "shared_packs", "cosine", "hops", 1).collect()}
    assert got["slope|3"].estimate == pytest.approx(each[3].slope) and got["interaction|2"].estimate == pytest.approx(each[2].difference)
    assert all(r.ci_low <= r.ci_high for r in got.values())
    table = {r.term: r for r in an.coefficients(frame(spark, [("a", 1.0), ("b", 2.0)], "term string, estimate double"), frame(spark, [("x", 0.0, 3.0)], "term string, ci_low double, ci_high double"), frame(spark, [("a", "x")], "term string, boot_term string")).collect()}
    assert tuple(table["a"]) == ("a", 1.0, 0.0, 3.0) and table["b"].ci_low is None


def test_least_squares(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=40), rng.normal(size=40)
    y = 1 + 2 * a - b + rng.normal(size=40)
    df = frame(spark, [(float(p), float(q), float(p + q), float(r)) for p, q, r in zip(a, b, y, strict=True)], "a double, b double, c double, y double")
    full = np.c_[np.ones(40), a, b]
    assert [r.estimate for r in inf.least_squares(df, ["a", "b"], "y").collect()] == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0].tolist())
    short = np.c_[full, a + b]  # not of full rank: the least solution
    assert [r.estimate for r in inf.least_squares(df, ["a", "b", "c"], "y").collect()] == pytest.approx(np.linalg.lstsq(short, y, rcond=None)[0].tolist())


def test_log_link_models(spark):
    rng = np.random.default_rng(5)
    data = [(float(x), int(h), float(np.exp(0.2 + 0.3 * x * h + rng.normal(0, 0.05)))) for x, h in zip(rng.random(200), rng.integers(1, 3, 200), strict=True)]
    out = inf.log_link(frame(spark, data, "x double, h int, y double"), "x", "y", by="h")
    got = {(r.family, r.term): r for r in out.collect()}
    assert got["gamma", "x:h[2]"].estimate == pytest.approx(0.3, abs=0.1) and got["poisson", "x"].estimate == pytest.approx(0.3, abs=0.1)
    assert all(0 <= r.p <= 1 and r.n == 200 for r in got.values()) and got["gamma", "x"].p < 0.01
    assert {r.term: r.agree for r in inf.sign_agreement(out).collect()}["x"]
    t = inf.with_t_p(frame(spark, [(2.0, 10.0), (None, 3.0)], "t double, df double"), "t", "df").collect()
    assert t[0].p == pytest.approx(0.0734, abs=2e-4) and t[1].p is None


def test_lowess_follows_a_line(spark):
    c = frame(spark, [(float(k), 2.0 * k + 1) for k in range(30)], "x double, y double")
    assert all(abs(r.smooth - r.y) < 1e-6 for r in inf.lowess(c, "x", "y").collect())


def test_spline_follows_a_curve(spark):
    c = frame(spark, [(k / 10, float(np.sin(k / 10)), 5.0) for k in range(60)], "x double, y double, n double")
    out = inf.smooth_curve(c, "x", "y", "n", knots=14).collect()
    assert len(out) == 60 and all(abs(r.smooth - r.y) < 0.02 and r.ci_low <= r.smooth <= r.ci_high for r in out)
    line = inf.smooth_curve(frame(spark, [(float(k), 2.0 * k + 1) for k in range(20)], "x double, y double"), "x", "y").collect()
    assert all(abs(r.smooth - r.y) < 1e-4 for r in line)


# membership, pairs and nulls


def test_places_and_first_rows(spark):
    from hashlib import md5

    from covey.functions import first_by_draw, places

    ids = [*range(500), *range(100)]
    order = sorted(set(ids), key=lambda k: (md5(str(k).encode()).hexdigest(), k))
    assert {r.k: r.place for r in places(frame(spark, [(k,) for k in ids], "k long"), "k").collect()} == {k: i for i, k in enumerate(order)}
    df = frame(spark, [(k, k % 3) for k in range(3000)], "k long, g long").withColumn("h", F.md5(F.col("k").cast("string")))
    got = {(r.g, r.k) for r in first_by_draw(df, ["g"], 7, [F.col("h")], F.col("h")).collect()}
    assert got == {(g, k) for g in range(3) for k in sorted((k for k in range(3000) if k % 3 == g), key=lambda k: md5(str(k).encode()).hexdigest())[:7]}


def test_picks_and_pair_sets(spark):
    data = [(1, 2, 2, 0.1), (1, 3, 2, 0.9), (2, 3, 3, 0.5), (2, 4, 3, 0.6), (5, 6, 4, 0.3), (5, 7, 7, 0.2), (8, 9, 9, 0.4)]
    stats = frame(spark, data, "user_a long, user_b long, p long, s double")
    five = {(r.user_a, r.user_b): r.pick for r in pr.select_five(stats, "p", "s").collect()}
    assert len(five) == 5 and five[1, 3] == "max" and five[1, 2] == "min" and {p for a, b, p, _ in data if (a, b) in five} == {2, 3, 4, 7}
    few = frame(spark, [r for r in data if r[2] > 3], "user_a long, user_b long, p long, s double")  # no number twice: extremes of all
    assert {(r.user_a, r.user_b): r.pick for r in pr.select_five(few, "p", "s").collect()} == {(8, 9): "max", (5, 7): "min", (5, 6): "span"}
    assert tuple(pr.same_pairs(stats, stats.union(stats)).first()) == (0, 0, True) and tuple(pr.same_pairs(stats, few).first()) == (4, 0, False)


def test_information_with_shared_packs(spark):
    m = frame(spark, [(1, 1), (2, 1), (2, 2), (1, 2), (3, 1)], "user_id long, pack_id long")
    info = frame(spark, [(1, 2, 0.5), (2, 1, 0.7), (3, 4, 1.0), (5, 5, 2.0)], "source long, target long, flow double")
    assert rows(pr.symmetric_info(pr.with_shared(info, m), "flow")) == [(1, 2, pytest.approx(0.6), 2, 2), (3, 4, 1.0, 1, 0)]


def test_shared_packs_of_many_pairs_are_counted_where_they_meet(spark):
    """Sources of many packs and many targets: the ends meet in packs, in either direction, with the same counts as pair by pair."""
    m = frame(spark, [(u, p) for u in range(20) for p in range(40) if (u * 7 + p) % (2 + u % 5) == 0 or p == 30 + u % 3], "user_id long, pack_id long").distinct()
    info = frame(spark, [(a, b, 0.5 + a) for a in range(22) for b in (1, 3, 21)] + [(3, 1, 9.0)], "source long, target long, flow double")
    sets: dict[int, set] = {}
    for r in m.collect():
        sets.setdefault(r.user_id, set()).add(r.pack_id)
    found = rows(pr.with_shared(info, m).select("source", "target", "flow", "shared_packs"))
    assert found == sorted(((a, b, f, len(sets.get(a, set()) & sets.get(b, set()))) for a, b, f in map(tuple, info.collect()) if a != b), key=str)
    met, fewer = pr._met_in_packs(info.where("source <> target"), m)
    assert fewer and not pr._met_in_packs(frame(spark, [(1, 3, 0.5)], "source long, target long, flow double"), m.withColumn("pack_id", F.lit(1)))[1]


def test_summaries(spark):
    curves = frame(spark, [("a", 1, 0.1), ("a", 2, 0.3), ("b", 1, 0.3), ("b", 2, 0.2)], "k string, level long, mean double")
    assert rows(ag.swing(curves, "k").select("level", "settings", F.round("spread", 6))) == [(1, 2, 1.0), (2, 2, 0.4)]
    assert rows(ag.monotone(curves, "k").select("k", "rising", F.round("down", 6))) == [("a", True, 0.0), ("b", False, 0.1)]
    pairs = frame(spark, [(1, 2)], "user_a long, user_b long")
    degrees = frame(spark, [(1, 5), (2, 7), (3, 1)], "node long, degree long")
    out = ag.degree_populations({"low": frame(spark, [(3, 1)], "user_a long, user_b long"), "high": pairs}, degrees)
    assert rows(out.select("population", "median", "n")) == [("high", 6.0, 2), ("low", 3.0, 2)] and ag.median_order(out, ("low", "high")).first().rising
    paths = frame(spark, [("a", "b", 2), ("b", "a", -1), ("a", "c", 1)], "source string, target string, distance int")
    assert tuple(gr.path_summary(paths).first()) == (3, 2, 1.5, 2)


def test_empirical_p(spark):
    obs = frame(spark, [("s", 100.0)], "stat string, value double")
    nulls = frame(spark, [("s", k, float(k)) for k in range(99)] + [("s", 99, None), ("s", 100, float("nan"))], "stat string, replicate long, value double")
    r = nu.reduce(obs, nulls).first()
    assert r.n == 99 and r.p == pytest.approx(0.02)


def membership(spark, seed=1, users=30, packs=12):
    rng = np.random.default_rng(seed)
    return frame(spark, sorted({(int(rng.integers(users)), int(rng.integers(packs))) for _ in range(140)}), "user_id long, pack_id long")


def test_bicm(spark):
    m = membership(spark)
    users, packs = nu.fit(m)
    for r in nu.expected_margins(users, packs).collect():
        assert r.expected == pytest.approx(r.degree, abs=1e-5)
    drawn = [nu.sample(users, packs, s).count() for s in range(8)]
    assert abs(np.mean(drawn) - m.count()) < 0.15 * m.count()
    by_class = nu.samples(users, packs, list(range(40)))
    assert by_class.distinct().count() == by_class.count()
    mean = by_class.groupBy("pack_id").agg((F.count("*") / 40).alias("n")).join(packs, "pack_id").collect()
    assert all(abs(r.n - r.k) < 4 * (r.k / 40) ** 0.5 + 0.2 for r in mean) and {r.replicate for r in by_class.select("replicate").distinct().collect()} == set(range(40))


@pytest.mark.parametrize("deep", [500.0, 0.4])
def test_draws_of_classes_are_those_of_cells(spark, monkeypatch, deep):
    """Every cell comes up as often as its chance says, and two cells of a class together as often as their product; also where classes are cut."""
    monkeypatch.setattr(nu, "_DEEP", deep)
    users = spark.createDataFrame([(1, 0.2), (2, 3.0), (3, 40.0)], "user_id long, x double")
    packs = spark.createDataFrame([(10 + k, 5, 0.9) for k in range(6)] + [(20, 7, 2.0)], "pack_id long, k long, y double")
    n = 3000
    got = nu.samples(users, packs, list(range(n)))
    assert got.distinct().count() == got.count()
    x, y = {1: 0.2, 2: 3.0, 3: 40.0}, {**{10 + k: 0.9 for k in range(6)}, 20: 2.0}
    chance = {(u, p): x[u] * y[p] / (1 + x[u] * y[p]) for u in x for p in y}
    counts = {(r.user_id, r.pack_id): r["count"] for r in got.groupBy("user_id", "pack_id").count().collect()}
    for cell, q in chance.items():
        assert abs(counts.get(cell, 0) / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-9, cell
    pair = got.where("pack_id IN (11, 14)").groupBy("replicate", "user_id").count().where("count = 2").groupBy("user_id").count()
    for r in pair.collect():
        q = chance[r.user_id, 11] ** 2
        assert abs(r["count"] / n - q) < 5 * (q * (1 - q) / n) ** 0.5
    again = nu.samples(users.repartition(3), packs.repartition(2), [5, 7])
    assert rows(again) == rows(got.where("replicate IN (5, 7)"))
    assert nu.samples(users, packs.limit(0), [1]).count() == 0 and nu.samples(users.limit(0), packs, [1]).count() == 0


def test_null_tasks_share_replicates(spark, tmp_path):
    """One task and four give the same reduction; a task that is there is not run again, and the reduction takes what is there."""
    m = membership(spark)
    pairs = frame(spark, [(a, b, ((a * 7 + b) % 10) / 10, 1 + (a + b) % 2) for a in range(12) for b in range(a + 1, 12)], "user_a long, user_b long, cosine double, hops long")
    emb = frame(spark, [(k, [float(k % 3), 1.0]) for k in range(40)], "pack_id long, embedding array<double>")
    more = {"ensemble": "canonical", "n_replicates": 5, "method": "rowsum", "statistic": "interaction", "reference": 1}
    assert [an.null_task(str(tmp_path / "four"), m, pairs, emb, t, 4, **more) for t in (3, 0, 1, 1)] == [True, True, True, False]
    part = an.null_reduce_tasks(spark, str(tmp_path / "four")).first()
    assert an.null_task(str(tmp_path / "four"), m, pairs, emb, 2, 4, **more) and an.null_task(str(tmp_path / "one"), m, pairs, emb, **more)
    one, four = (an.null_reduce_tasks(spark, str(tmp_path / x)).first() for x in ("one", "four"))
    assert (one.stat, one.observed, one.n, one.p) == (four.stat, four.observed, four.n, four.p) and one.mean == pytest.approx(four.mean) and one.n == 5 and part.n == 4


def test_poisson_tails():
    from fractions import Fraction
    from math import exp, factorial

    assert nu.poisson_p(0, 0.0) == 1.0 and nu.poisson_p(3, 1.0) == pytest.approx(2 * (1 - 0.9197), abs=1e-3)
    for s, rate in ((0, 0.3), (1, 0.3), (4, 9.0), (40, 1.0), (100, 5.0), (7, 7.0)):
        below = sum(Fraction(rate) ** k / factorial(k) for k in range(s))
        upto, above = float(below + Fraction(rate) ** s / factorial(s)) * exp(-rate), float(sum(Fraction(rate) ** k / factorial(k) for k in range(s, s + 150))) * exp(-rate)
        assert nu.poisson_p(s, rate) == pytest.approx(min(1, 2 * min(upto, above)), rel=1e-9), (s, rate)
    assert nu.poisson_p(1_000_000, 1_000_000.0) == pytest.approx(1, abs=1e-2) and nu.poisson_p(1_004_000, 1_000_000.0) == pytest.approx(6.4e-5, rel=0.1)


def test_curveball(spark, monkeypatch):
    m = membership(spark, users=80, packs=15)
    links = set(rows(m))
    for block in (nu.BLOCK, 16):
        monkeypatch.setattr(nu, "BLOCK", block)
        found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
        try:
            for n in ("4", "200"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                found.append(rows(nu.curveball(m, [3, 9])))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert found[0] == found[1] and {r for r, _, _ in found[0]} == {3, 9}
        for seed in (3, 9):
            new = spark.createDataFrame([(u, p) for r, u, p in found[0] if r == seed], m.schema)
            assert new.distinct().count() == new.count() == m.count()
            assert rows(mb.user_margins(new)) == rows(mb.user_margins(m)) and rows(mb.pack_margins(new)) == rows(mb.pack_margins(m))
            square = sum(r.packs**2 for r in mb.user_margins(m).collect())
            assert len(links & set(rows(new))) < 1.6 * square / 15  # no more stay than chance leaves
    assert rows(nu.curveball(m, [3], trades=0).drop("replicate")) == sorted(links, key=str)
    assert nu.task_seeds(10, 5, 0, 4) == [5, 6, 7] and nu.task_seeds(10, 5, 3, 4) == [14]


def test_null_statistics(spark):
    m = membership(spark)
    rng = np.random.default_rng(6)
    emb = frame(spark, [(p, [float(x) for x in unit(rng.normal(size=3).tolist())[0]]) for p in range(10)], "pack_id long, embedding array<double>")
    vectors = {r.pack_id: r.embedding for r in emb.collect()}
    pairs = [(a, b, float(rng.random()), int(rng.integers(1, 4))) for a in range(12) for b in range(a + 1, 12)]
    table = frame(spark, pairs, "user_a long, user_b long, cosine double, hops int")
    nulls = checkpointed(nu.curveball(m, [1, 2]))
    scored = nu.under(nulls, table, emb, "effrank")
    slopes = {r.replicate: r.value for r in nu.statistics(scored, "slope").collect()}
    apart = {(r.replicate, r.stat): r.value for r in nu.statistics(scored, "interaction").collect()}
    for seed in (1, 2):
        packs = {}
        for r in nulls.where(F.col("replicate") == seed).collect():
            packs.setdefault(r.user_id, set()).add(r.pack_id)
        n = []
        for a, b, _, _ in pairs:
            own = sorted(packs.get(a, set()) & packs.get(b, set()))
            n.append(ne.all_numbers(np.array([vectors.get(p, [0.0] * 3) for p in own]).reshape(-1, 3), np.array([p in vectors for p in own], bool))["effrank"])
        n, y, h = np.array(n), np.array([p[2] for p in pairs]), np.array([p[3] for p in pairs])
        slope = lambda at: np.polyfit(n[at], y[at], 1)[0]
        assert slopes[seed] == pytest.approx(slope(h > 0))
        assert all(apart[seed, f"interaction[hops={k}]"] == pytest.approx(slope(h == k) - slope(h == 1)) for k in (2, 3))
    own = checkpointed(ne.for_pairs(table, pr.shared_packs(table, m), emb, "effrank"))
    out = nu.curves(own, checkpointed(scored), 3, n_boot=20).collect()
    assert len(out) == 8 and {r.x_kind for r in out} == {"count", "n_eff"} and all(r.null_low <= r.null_mean <= r.null_high for r in out if r.null_mean is not None)
    with pytest.raises(ValueError):
        nu.statistics(scored, "median")


def test_pairs(spark):
    m = membership(spark)
    packs = {}
    for u, p in rows(m):
        packs.setdefault(u, set()).add(p)
    want = {(a, b): len(packs[a] & packs[b]) for a in packs for b in packs if a < b and packs[a] & packs[b]}
    assert {(a, b): s for a, b, s in rows(pr.comember_pairs(m))} == want
    census = pr.census(pr.comember_pairs(m), 3, 2).collect()
    assert all(r.shared_packs == want[r.user_a, r.user_b] for r in census) and len(census) <= 6
    assert all((r.user_a, r.user_b) not in want and r.user_a < r.user_b for r in pr.baseline(m, 300, 20).collect())


# sources


def test_packs(spark, tmp_path):
    lines = [
        {"members": [{"did": "u1"}, {"did": "u2"}, {"did": "u1"}], "name": "One", "description": "top"}, None,
        {"record": {"name": "Two", "description": "inner"}, "members": [{"did": "u2"}], "description": "outer"}, {"uri": "at://x", "members": None},
        {"name": "", "record": {"name": "  Three ", "description": ""}, "description": " own "}, {"name": 7, "record": None, "description": 5, "members": []},
        {"name": None, "record": {"description": None}, "uri": "", "description": ""}, {"name": "Six", "description": float("nan"), "record": {"description": "nan: NaN, stays"}},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(" \t" if x is None else json.dumps(x) for x in lines) + "\n\n")
    packs = io.read_packs(spark, str(tmp_path / "p.jsonl"))
    got = [(r.pack_id, r.name, r.title, r.description) for r in packs.orderBy("pack_id").collect()]
    assert got == [(0, "One", "One", "top"), (1, "Two", "Two", "inner"), (2, "at://x", "", ""), (3, "  Three ", "Three", "own"), (4, "7", "", ""), (5, "", "", ""), (6, "Six", "Six", "nan: null, stays")]
    assert rows(mb.build(packs)) == [("u1", 0), ("u2", 0), ("u2", 1)]
    texts = {r.pack_id: r.text for r in io.pack_texts(packs).collect()}
    assert texts[1] == "Two. inner" and texts[2] == "" and texts[3] == "Three. own" and texts[4] == ""
    assert {r.pack_id: r.text for r in io.pack_texts(packs, include_name=False).collect()}[3] == "own"
    assert {r.pack_id for r in io.described_packs(packs).collect()} == {0, 1, 2, 3, 4, 6}  # null is kept, an empty one is not
    (tmp_path / "d.jsonl").write_text('{"description": "x"}\n{"description": ""}\n{"description": null}\n')
    assert [json.loads(r.value)["description"] for r in io.described_lines(spark, str(tmp_path / "d.jsonl")).collect()] == ["x", None]
    (tmp_path / "n.jsonl").write_text('{"name": "x"}\n')
    with pytest.raises(Exception, match="without a description"):
        io.described_lines(spark, str(tmp_path / "n.jsonl")).collect()


def test_lines_are_numbered_in_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "lines").mkdir()
    for k in range(3):
        (tmp_path / "lines" / f"{k}.txt").write_text("".join(f"{k}-{i}\n\n" for i in range(400)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = {r.value: r.place for r in io.numbered_lines(spark, str(tmp_path / "lines")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"{k}-{i}": 400 * k + i for k in range(3) for i in range(400)}


def test_a_failed_write_keeps_the_old_table(spark, tmp_path):
    e = frame(spark, [("a", "b")], "source string, target string")
    path = tmp_path / "t.parquet"
    io.write_table(e, str(path))
    broken = e.withColumn("source", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        io.write_table(broken, str(path))
    assert io.read_edges(spark, str(path)).count() == 1


def test_posts(spark, tmp_path):
    post = lambda text, at="2024-01-01T00:00:00Z", **k: {"commit": {"collection": io.POST}, "record": {"text": text, "createdAt": at} | k}
    io.write_posts(str(tmp_path), "did1", [post(" a\nb "), post("  "), {"commit": {"collection": "other"}, "record": {"text": "no"}}, post("q", embed={"$type": io.QUOTES[0]}), post("t", "not a time")])
    out = io.read_posts(spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.text, r.is_quote, r.created_at is None) for r in out) == [("did1", "a b", False, False), ("did1", "q", True, False), ("did1", "t", False, True)]
    assert io.read_posts(spark, str(tmp_path), quotes=False).count() == 2 and tx.dated(io.read_posts(spark, str(tmp_path))).count() == 2
    io.write_posts(str(tmp_path / "more"), "did2", [post("this is what they have been to"), post("das ist ein haus")])
    assert [r.text for r in io.read_posts(spark, str(tmp_path / "more"), english_only=True).collect()] == ["this is what they have been to"]


def test_tables(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b,2024\nb,a,2024\n")
    e = io.read_edges(spark, str(tmp_path / "e.csv"))
    assert rows(e) == [("a", "b"), ("b", "a")]
    io.write_table(e, str(tmp_path / "e.parquet"))
    io.write_table(e.limit(1), str(tmp_path / "e.parquet"))
    assert io.read_edges(spark, str(tmp_path / "e.parquet")).count() == 1
    assert io.row_count(spark, str(tmp_path / "e.parquet")) == 1 and not list(tmp_path.glob("e.parquet.*"))
    with pytest.raises(ValueError):
        io.write_table(e.limit(0), str(tmp_path / "x.parquet"))
    with pytest.raises(ValueError):
        require_columns(e, "nothing")
    (tmp_path / "m.txt").write_text("seed : 16\nA=1 B=two\n")
    assert io.read_manifest(str(tmp_path / "m.txt")) == {"seed": "16", "A": "1", "B": "two"}
    (tmp_path / "u.txt").write_text("x\n\ny\nx\n")
    assert io.read_users(spark, str(tmp_path / "u.txt")).count() == 2
    assert [(r.user_id, r.place) for r in io.read_users(spark, str(tmp_path / "u.txt"), ordered=True).orderBy("place").collect()] == [("x", 0), ("y", 1)]
    assert rows(io.read_nodes(spark, nodes=str(tmp_path / "u.txt"))) == [("x",), ("y",)]
    frame(spark, [("b", "c"), ("a", "b")], "user_a string, user_b string").coalesce(1).write.parquet(str(tmp_path / "q.parquet"))
    assert [r.user_id for r in io.read_users(spark, str(tmp_path / "q.parquet"), ordered=True).orderBy("place").collect()] == ["b", "a", "c"]
    graph = lambda **k: rows(io.cached_graph(spark, str(tmp_path / "e.csv"), str(tmp_path / "graph"), **k))
    assert graph() == [("a", "b"), ("b", "a")]
    (tmp_path / "e.csv").write_text("a,b,2024\na,b,2024\nb,c,2024\n")
    assert graph() == [("a", "b"), ("b", "a")] and graph(rebuild=True) == [("a", "b"), ("b", "c")]
    (tmp_path / "h.json").write_text(json.dumps({"incidences": [{"edge": "1", "node": "x"}, {"edge": "2", "node": "x"}, {"edge": "2", "node": "y"}]}))
    assert rows(io.interchange_degrees(spark, str(tmp_path / "h.json"))) == [("x", 2), ("y", 1)]


@pytest.mark.parametrize(("directed", "hub", "most"), [(False, 3, 40), (True, 2, 25), (True, 10_000, 10**9)])
def test_distances_with_salted_hubs_and_sliced_levels(spark, directed, hub, most):
    """Bit-parallel searches against plain breadth-first ones: a hub, a path out of reach, repeated and reversed pairs, more than 64 searches."""
    import random

    rnd = random.Random(6)
    edges = [(0, k) for k in range(1, 40)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(110)] + [(200, 201), (201, 202), (7, 7)]
    ahead: dict[int, set[int]] = {}
    for x, y in edges:
        if x != y:
            ahead.setdefault(x, set()).add(y)
            if not directed:
                ahead.setdefault(y, set()).add(x)

    def distances(start):
        found, front, d = {start: 0}, {start}, 0
        while front:
            d += 1
            front = {n for x in front for n in ahead.get(x, ())} - set(found)
            found |= dict.fromkeys(front, d)
        return found

    table = spark.createDataFrame(edges, "source long, target long")
    pairs = [(rnd.randrange(95), rnd.randrange(95)) for _ in range(150)] + [(200, 202), (202, 200), (5, 5), (0, 1), (0, 1), (999, 1)]
    got = sorted((r.user_a, r.user_b, r.hops) for r in gr.hops(spark.createDataFrame(pairs, "user_a long, user_b long"), table, 3, directed, hub, most).collect())
    assert got == sorted((a, b, d if (d := distances(a).get(b, 4)) in (1, 2, 3) else 4) for a, b in pairs)
    users = sorted({x for e in edges for x in e})[::1]
    paths = gr.shortest_paths(spark.createDataFrame([(u,) for u in [*users, 999]], "node long"), table, directed, hub=hub, most=most)
    assert {(r.source, r.target): r.distance for r in paths.collect()} == {(a, b): distances(a).get(b, -1) for a in users for b in users if a != b}


@pytest.mark.parametrize("directed", [False, True])
def test_steps_deal_out_only_edges_that_leave_the_front(spark, directed, monkeypatch):
    """Edges far from all pairs are neither dealt out nor shuffled; a front of more nodes than are broadcast gives the same."""
    table = frame(spark, [(1, 2), (2, 3), (3, 4), (1, 2), *[(k, k + 1) for k in range(100, 400)]], "source long, target long")
    pairs, dealt, old = frame(spark, [(1, 4), (4, 1), (1, 3), (2, 2)], "user_a long, user_b long"), [], gr._dealt
    monkeypatch.setattr(gr, "_dealt", lambda graph, *a, **k: (dealt.append(graph.count()), old(graph, *a, **k))[1])
    want = [(1, 3, 2), (1, 4, 3), (2, 2, 5), (4, 1, 5 if directed else 3)]
    assert rows(gr.hops(pairs, table, directed=directed)) == want and max(dealt) <= 6
    assert rows(gr.hops(pairs, table, directed=directed, near=0)) == want


def test_one_automaton_serves_all_targets_of_a_source(spark):
    """Sources with more targets than a block, without tokens, and of one token; every way against the plain estimate."""
    import random

    rnd = random.Random(9)
    words = {k: [rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 5, 30]))] for k in range(25)}
    seqs = spark.createDataFrame(list(words.items()), "user_id long, tokens array<string>")
    pairs = [(0, k) for k in range(1, 25)] + [(k, 0) for k in range(1, 25)] + [(3, 4), (3, 4), (2, 99)]
    out = info.pairwise_information(spark.createDataFrame(pairs, "source long, target long"), seqs, targets=4).collect()
    assert len(out) == len(pairs) - 1
    for r in out:
        assert r.entropy_st == info.cross_entropy(words[r.target], words[r.source]) and r.entropy_ts == info.cross_entropy(words[r.source], words[r.target])


def test_large_sets_need_no_matrix(monkeypatch):
    """Estimators of a large set from its vectors alone: equal to those of the matrix, and for 12,000 packs within 500 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for p in (4, 5, 6, 70):
        v, known, spec = unit(rng.normal(size=(p, 16)) + 0.5), rng.random(p) > 0.2, rng.random(p) * 3 - 0.3
        v[~known] = 0
        for missing in ("distinct", "drop"):
            for w in (None, spec):
                want = ne.embedding_numbers(v[None], known[None], ne.METHODS, missing, None if w is None else w[None])
                got = ne.large_numbers(v, known, ne.METHODS, missing, w)
                assert {c: pytest.approx(float(x[0])) for c, x in want.items()} == got
    v = unit(rng.normal(size=(12_000, 64)) + 0.3)
    tracemalloc.start()
    got = ne.large_numbers(v, np.ones(12_000, bool), ("effrank", "participation", "rowsum"))
    assert tracemalloc.get_traced_memory()[1] < 500e6 and 1 <= got["participation"] <= got["effrank"] <= 65
    tracemalloc.stop()


@pytest.mark.parametrize("method", ne.LINKS)
def test_linkage_against_plain_agglomeration(method):
    """Merging the nearest two clusters again and again, for a few packs."""
    rng = np.random.default_rng(8)
    for p in (2, 3, 4, 5, 6):
        v = rng.normal(size=(p, 5)) + 0.4
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        d = 1 - np.clip(v @ v.T, 0, 1)
        clusters, total = [[k] for k in range(p)], 0.0
        join = {"single": min, "complete": max, "average": lambda x: sum(x) / len(x)}[method]
        while len(clusters) > 1:
            far, i, j = min((join([d[a, b] for a in x for b in y]), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
            total += far
            clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] + clusters[j]]
        assert ne.linkage(v @ v.T, method) == pytest.approx(1 + total) == ne.large_linkage(v, method)


def test_quantiles_by_counting(spark):
    """Against numpy: ties, one value, wide and narrow spreads, keys, nulls and NaN, no rows."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.integers(0, 5, 400).astype(float), "b": rng.lognormal(0, 9, 300), "c": np.full(7, 3.5), "d": np.r_[-1e300, 1e300, rng.normal(size=50) * 1e-9], "e": np.array([2.0])}
    data = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("f", None)]
    table, at = frame(spark, data, "g string, v double"), [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = ag.quantiles(table, "v", at, "g")
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12)
    assert ag.quantiles(table.where("g = 'f'"), "v", at) == {}


def test_least_squares_keeps_its_digits(spark):
    """Nearly collinear predictors, weights and a predictor that is the sum of others, against a dense solver."""
    rng = np.random.default_rng(5)
    x1 = rng.normal(size=400)
    x2, w = x1 + 1e-6 * rng.normal(size=400), rng.random(400) + 0.1
    y = 1 + 2 * x1 - 3 * x2 + 1e-8 * rng.normal(size=400)
    table = frame(spark, [tuple(map(float, r)) for r in zip(x1, x2, x1 + x2, y, w, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0)], "x1 double, x2 double, x3 double, y double, w double").repartition(7)
    solve = lambda m, s: np.linalg.lstsq(m * s[:, None], y * s, rcond=1e-13)[0].tolist()
    one, ones = np.ones(400), np.ones(400)
    got = lambda xs, **k: [r.estimate for r in inf.least_squares(table, xs, "y", **k).collect()]
    assert got(["x1", "x2"]) == pytest.approx(solve(np.stack([one, x1, x2], 1), ones), rel=1e-8, abs=1e-8)
    assert got(["x1", "x2"], weight="w") == pytest.approx(solve(np.stack([one, x1, x2], 1), np.sqrt(w)), rel=1e-8, abs=1e-8)
    assert got(["x1", "x1"]) == pytest.approx(solve(np.stack([one, x1, x1], 1), ones), rel=1e-8, abs=1e-8)  # the shortest of many
    assert inf.least_squares(table.limit(0), ["x1"], "y").count() == 2


# growth of the shared steps


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comembers_without_a_shuffled_row_for_each_pair(spark, monkeypatch):
    data = [(u, p) for p in range(6) for u in range(30) if (u * 7 + p * 5) % 4] + [(None, 1), (3, None)]
    links = {(u, p) for u, p in data if u is not None and p is not None}
    want = {}
    for u, p in links:
        for v, q in links:
            if p == q and u < v:
                want.setdefault((u, v), []).append(p)
    m = frame(spark, data, "user_id long, pack_id long")
    for block, piece, held in ((4000, 256, 500_000), (7, 3, 10)):
        for name, value in (("BLOCK", block), ("PIECE", piece), ("HELD", held)):
            monkeypatch.setattr(pr, name, value)
        counts, sets = pr.comember_pairs(m), pr.comember_sets(m, 2)
        assert {(r.user_a, r.user_b): r.shared_packs for r in counts.collect()} == {k: len(v) for k, v in want.items()}
        assert {(r.user_a, r.user_b): r.packs for r in sets.collect()} == {k: sorted(v) for k, v in want.items() if len(v) >= 2}
        assert all("user_b" not in line for df in (counts, sets) for line in plan_of(df).split("\n") if "Exchange" in line or "Aggregate" in line)
    named = frame(spark, [(f"u{u}", f"p{p}") for u, p in links], "user_id string, pack_id string")
    assert {(r.user_a, r.user_b): r.shared_packs for r in pr.comember_pairs(named).collect()} == {(f"u{a}", f"u{b}") if f"u{a}" < f"u{b}" else (f"u{b}", f"u{a}"): len(v) for (a, b), v in want.items()}


def test_jaccard_of_packs_with_two_common_members(spark):
    m = frame(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3), (4, 1)], "user_id long, pack_id long")
    assert rows(ne.jaccard_packs(m, least=2)) == [(1, 2, 0.5)] and rows(ne.jaccard_packs(m)) == [(1, 2, 0.5), (2, 3, 1 / 3)]


def read_rows(spark, data, schema):
    """A table, and how many rows of it have been read."""
    reads = spark.sparkContext.accumulator(0)

    def one(row):
        reads.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(data, 2).map(one), schema), reads


def test_fits_read_their_rows_once(spark):
    data = [(float(k % 3), 1.0 + k % 3 + k % 2) for k in range(60)]
    df, reads = read_rows(spark, data, "x double, y double")
    models = inf.log_link(df, "x", "y").collect()
    assert reads.value <= 2 * len(data) and {r.n for r in models} == {60}
    assert all(abs(r.score) < 1e-6 for r in inf.log_link_scores(df, inf.log_link(df, "x", "y"), "x", "y").collect())


def test_rings_read_the_edges_once(spark):
    data = [(k, k + 1) for k in range(40)]
    df, reads = read_rows(spark, data, "source long, target long")
    assert rows(gr.rings(frame(spark, [(3,)], "node long"), df, 4)) == [(3 + k, k) for k in range(1, 5)]
    assert reads.value <= 2 * len(data)


def test_words_of_md5():
    from hashlib import md5

    for low, high in ((0, 10), (10, 100), (99_990, 100_000), (1_234_567, 1_234_700)):
        assert inf.md5_words("42|7|", low, high).tolist() == [int(md5(f"42|7|{k}".encode()).hexdigest()[:8], 16) for k in range(low, high)]


def test_draws_are_shuffled_as_counts_of_blocks(spark, monkeypatch):
    from hashlib import md5
    from zlib import decompress

    monkeypatch.setattr(inf, "PLACES", 16)
    monkeypatch.setattr(inf, "HASHED", 30)
    units = sorted((f"u{k}" for k in range(45)), key=lambda u: (md5(u.encode()).hexdigest(), u))
    df = inf.drawn(frame(spark, [(u,) for u in units], "unit string"), 7, packed=True)
    want = {u: [0] * 7 for u in units}
    for boot in range(7):
        for k in range(45):
            want[units[int(md5(f"42|{boot}|{k}".encode()).hexdigest()[:8], 16) % 45]][boot] += 1
    assert {r.unit: list(decompress(bytes(r.drawn))) for r in df.collect()} == {u: c for u, c in want.items() if any(c)}
    assert "collect_list" not in plan_of(df)


def test_degrees_without_pairs(spark, monkeypatch):
    links = [(u, p) for p in range(5) for u in range(40) if (u * p + u) % 3 == 0] + [(99, 77), (None, 1)]
    m = frame(spark, links, "user_id long, pack_id long")
    pairs = pr.comember_pairs(m)
    want = rows(pairs.select(F.explode(F.array("user_a", "user_b")).alias("node")).groupBy("node").count())
    for users in (4096, 7):
        monkeypatch.setattr(pr, "USERS", users)
        degrees = pr.comember_degrees(m)
        assert rows(degrees) == want and "user_b" not in plan_of(degrees)
    known = m.groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("degree"))
    assert rows(ag.degree_populations({"x": pairs, "y": degrees}, known))[0][1:] == rows(ag.degree_populations({"x": pairs, "y": degrees}, known))[1][1:]


def test_numbers_of_known_sets(spark):
    m = frame(spark, [(u, p) for u in range(6) for p in range(5) if (u + p) % 3], "user_id long, pack_id long")
    emb = frame(spark, [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0])], "pack_id long, embedding array<float>")
    pairs = pr.comember_pairs(m)
    old = ne.for_pairs(pairs, pr.shared_packs(pairs, m), emb, "rowsum")
    new = ne.for_sets(pairs.where("shared_packs = 1"), ne.with_set_key(pr.comember_sets(m, 2)), emb, "rowsum")
    assert rows(new.select(*old.columns)) == rows(old) and old.count()


def test_units_are_made_where_texts_are_encoded(spark):
    got = info.embed_texts(frame(spark, [(1, "one text"), (2, "two")], "pack_id long, text string"), info.hashing_encoder(8), "m")
    assert "zip_with" not in plan_of(got) and all(sum(x * x for x in r.embedding) == pytest.approx(1.0) for r in got.collect())


def test_all_cosines_shuffle_no_pair(spark, monkeypatch):
    weights = [(u, f"t{(u * 7 + k * k) % 11}", 0.1 * (u + k + 1)) for u in range(9) for k in range(4)]
    weights = list({(u, t): (u, t, w) for u, t, w in weights}.values())
    want = {(a, b): sum(w * x for u, t, w in weights if u == a for v, s, x in weights if v == b and s == t) for a in range(11) for b in range(a + 1, 11)}
    users = frame(spark, [(u,) for u in range(11)], "user_id long")
    for size in (1024, 3):
        monkeypatch.setattr(tx, "USERS", size)
        got = tx.all_cosines(frame(spark, weights, "user_id long, term string, weight double"), users)
        assert {(r.user_a, r.user_b): r.cosine for r in got.collect()} == pytest.approx(want) and got.count() == 55
        assert "user_b" not in "".join(line for line in plan_of(got).split("\n") if "Exchange" in line or "Join" in line)


def test_sets_of_pairs_are_counted_once(spark):
    """The sets that a query reads several times are kept: no plan over them counts co-members anew."""
    from covey.plans import structure as st

    sets = st._sets(spark, "/root/testdata/sf0.001")
    assert sets.count() and "MapInArrow" not in sets._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_that_the_census_cannot_draw_stay_where_they_are_counted(spark, monkeypatch, kind):
    import random

    rnd = random.Random(11)
    m = frame(spark, list({(rnd.randrange(90), rnd.randrange(40)) for _ in range(500)}), "user_id long, pack_id long").withColumn("user_id", (F.col("user_id") * 37).cast(kind))
    pairs, went, old = pr.comember_pairs(m, 2), [], pr.census
    want = rows(pr.census(pairs, 3, 2))
    monkeypatch.setattr(pr, "census", lambda drawn, *a: (went.append(drawn.count()), old(drawn, *a))[1])
    assert rows(pr.comember_census(m, 3, 2, min_packs=2)) == want and len(want) == 6
    assert went[0] < pairs.count() / 4


def test_document_frequencies_shuffle_counts_of_terms(spark, monkeypatch):
    plans, old = [], tx.checkpointed
    monkeypatch.setattr(tx, "checkpointed", lambda df: (plans.append(plan_of(df)), old(df))[1])
    data = [(1, "tree tree house"), (2, "tree #tag #tag"), (3, None), (4, "")]
    docs = frame(spark, data, "user_id long, text string")
    assert rows(tx.document_frequencies(docs)) == [("#tag", 1), ("house", 1), ("tree", 2)]
    assert not [x for x in plans[-1].split("\n") if "Exchange" in x and "user_id" in x]
    again = frame(spark, [*data, (1, "tree river")], "user_id long, text string")
    assert rows(tx.document_frequencies(again)) == rows(tx.document_frequency(tx.term_counts(tx.tokens(again)))) == [("#tag", 1), ("house", 1), ("river", 1), ("tree", 2)]
    users = frame(spark, [(2,), (4,), (2,)], "user_id long")
    assert rows(tx.of_users(again, users)) == rows(tx.of_users(again, users, near=0)) == [(2, "tree #tag #tag"), (4, "")]


def test_draws_of_pairs_of_texts():
    import hashlib

    import pyarrow as pa

    from covey.functions.digests import Texts, draws_of

    for a, b in (([5, 123456, -7], [4444444444, 1, 22]), (["ü" * 30, "", "b"], ["c\0", "dd", "e"])):
        i, j = np.array([0, 1, 2, 0]), np.array([2, 1, 0, 1])
        want = [int(hashlib.md5(f"42|{a[x]}|{b[y]}".encode()).hexdigest()[:8], 16) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        assert draws_of(42, Texts(pa.array(a)), i, Texts(pa.array(b)), j).tolist() == want


@pytest.mark.parametrize("most", [gr.EXPAND, 2000])
def test_paths_keep_only_the_latest_level_and_shuffle_no_pair(spark, monkeypatch, most):
    import random

    rnd = random.Random(4)
    edges = frame(spark, [(k, (k * 2 + rnd.randrange(9)) % 150) for k in range(150) for _ in range(2)] + [(900, 901), (7, 7), (902, 902)], "source long, target long")
    users, live, most_live, old = frame(spark, [(k,) for k in [*range(0, 150, 2), 900, 901, 902, 999]], "node long"), set(), [], (gr.stored, gr.delete)

    def stored(df):
        df, path = old[0](df)
        live.add(path)
        most_live.append(len(live))
        return df, path

    monkeypatch.setattr(gr, "stored", stored)
    monkeypatch.setattr(gr, "delete", lambda spark, path: (live.remove(path), old[1](spark, path)))
    paths = gr.shortest_paths(users, edges, most=most)
    assert not live and len(most_live) > 5 and (most == 2000 or max(most_live) == 2)
    assert not [x for x in plan_of(paths).split("\n") if "Exchange" in x and "source" in x and "sources" not in x]
    summary = gr.summary_of_paths(users, edges, most=most).first()
    assert tuple(summary) == tuple(gr.path_summary(paths).first()) and summary.pairs == 78 * 77 and 0 < summary.reachable < summary.pairs
    none = gr.summary_of_paths(frame(spark, [(902,)], "node long"), edges).first()
    assert tuple(none) == (0, 0, None, None)
    reachable = rows(gr.shortest_paths(users, edges, drop_unreachable=True))
    assert reachable == [r for r in rows(paths) if r[2] >= 0] and len(reachable) == summary.reachable


@pytest.mark.parametrize("directed", [False, True])
def test_paths_of_held_edges_write_no_level(spark, monkeypatch, directed):
    """A task that holds the edges gives the same as levels on disk, over several batches, pieces and passes, and stores the edges alone."""
    import random

    rnd = random.Random(5)
    edges = frame(spark, [(k, rnd.randrange(300)) for k in range(300) for _ in range(4)] + [(900, 901), (7, 7), (902, 902), (None, 3), (3, None)], "source long, target long")
    users = frame(spark, [(k,) for k in [*range(0, 300, 2), 900, 901, 902, 999, None]], "node long")
    want, summary = rows(gr.shortest_paths(users, edges, directed)), gr.summary_of_paths(users, edges, directed).first()
    calls, old = [], gr.stored
    monkeypatch.setattr(gr, "stored", lambda df: (calls.append(1), old(df))[1])
    monkeypatch.setattr(gr, "PIECE", 100)
    monkeypatch.setattr(gr, "CELLS", 1)
    assert rows(gr.shortest_paths(users, edges, directed, held=10_000)) == want and len(want) == 153 * 152
    assert rows(gr.shortest_paths(users, edges, directed, drop_unreachable=True, held=10_000)) == [r for r in want if r[2] >= 0]
    assert len(rows(gr.shortest_paths(users, edges, directed, drop_self=False, held=10_000))) == 153 * 153
    assert tuple(gr.summary_of_paths(users, edges, directed, held=10_000).first()) == tuple(summary) and len(calls) == 4
    assert tuple(gr.summary_of_paths(frame(spark, [(902,)], "node long"), edges, held=10_000).first()) == (0, 0, None, None)
    names = frame(spark, [("a", "b"), ("b", "c")], "source string, target string")
    assert rows(gr.shortest_paths(frame(spark, [("a",), ("c",)], "node string"), names, directed, held=2 if directed else 4)) == [("a", "c", 2), ("c", "a", -1 if directed else 2)]
    calls.clear()
    assert tuple(gr.summary_of_paths(users, edges, directed, held=10).first()) == tuple(summary) and len(calls) > 5  # too many to hold: levels on disk


def test_block_cosines_give_what_listed_cosines_give(spark):
    """Over several blocks and ceilings; users without a term kept, and a block without pairs."""
    import random

    from covey.operators import text as tx

    rnd = random.Random(6)
    words = [f"word{chr(97 + k)}" for k in range(12)]
    docs = frame(spark, [(k, " ".join(rnd.choices(words, range(12, 0, -1), k=8))) for k in range(40)] + [(40, "lonely"), (41, "")], "user_id long, text string")
    pairs = frame(spark, [(a, b, 1 + (a + b) % 7) for a in range(42) for b in range(a + 1, 42) if rnd.random() < 0.4], "user_a long, user_b long, shared_packs long")
    tf, users = tx.term_counts(tx.tokens(docs)), docs.select("user_id")
    df, size = tx.document_frequency(tf), tx.n_docs(docs)
    want = [{(r.user_a, r.user_b): r.cosine for r in tx.listed_cosines(pairs, tx.tfidf(tf, tx.kept_terms(df, size, 2, x)), users).collect()} for x in (0.3, 0.6)]
    for most in (30, 1_000_000):
        got = tx.block_cosines(pairs, tf, df, size, users, 2, (0.3, 0.6), most).collect()
        assert len(got) == len(want[0]) == pairs.count() and {r.shared_packs for r in got} == {1, 2, 3, 4, 5, 6, 7}
        assert all(r.cosines[k] == pytest.approx(want[k][r.user_a, r.user_b], abs=1e-12) for r in got for k in (0, 1))


@pytest.mark.parametrize("name", ["similarity_by_overlap", "curve_swing"])
def test_curves_over_overlap_are_of_all_co_members(spark, name, monkeypatch):
    from covey.operators import text as tx
    from covey.plans import registry
    from covey.sources import roles as R

    SF, seen, old = "/root/testdata/sf0.001", [], tx.block_cosines
    monkeypatch.setattr(tx, "block_cosines", lambda pairs, *a: (seen.append(old(pairs, *a)), seen[-1])[1])
    registry.QUERIES[name](spark, SF)
    texts = R.texts(spark, SF).where("text IS NOT NULL").select("user_id")
    every = pr.comember_pairs(R.membership(spark, SF).join(texts, "user_id", "left_semi"))
    assert seen[0].count() == every.count() > 1000  # five levels of 200 were drawn before


def test_all_cosines_cut_a_block_into_sides(spark, monkeypatch):
    """A block may have more users than a product; there are as many blocks as the weights ask for, not as the users do."""
    weights = [(u, f"t{(u * 5 + k) % 13}", 0.1 * (u + k + 1)) for u in range(20) for k in range(4)]
    want = {(a, b): sum(w * x for u, t, w in weights if u == a for v, s, x in weights if v == b and s == t) for a in range(21) for b in range(a + 1, 21)}
    monkeypatch.setattr(tx, "USERS", 3)
    for blocks, held in ((1, 1000), (2, 1000), (1, 30)):
        monkeypatch.setattr(tx, "BLOCKS", blocks)
        monkeypatch.setattr(tx, "WEIGHTS", held)
        got = tx.all_cosines(frame(spark, weights, "user_id long, term string, weight double"), frame(spark, [(u,) for u in range(21)], "user_id long"))
        assert {(r.user_a, r.user_b): r.cosine for r in got.collect()} == pytest.approx(want) and got.count() == 210
