"""The composite analyses, information kernels, report and command line on small inputs."""

import json
from math import log2

import pytest
from pyspark.sql import functions as F

from covey import __main__ as cli
from covey.operators import information as info
from covey.plans import analyses as an
from covey.plans import figures
from covey.sources import roles as R

SF = "/root/testdata/sf0.001"


def test_cross_entropy():
    assert info.cross_entropy(["a", "b"], ["a", "b", "c", "d"]) == pytest.approx(2 * log2(4) / 5)  # matches of 2 and 1
    assert info.cross_entropy(["x"], ["a", "b"]) == pytest.approx(1.0)
    assert info.cross_entropy([], ["a", "b"]) is None and info.cross_entropy(["a"], ["a"]) is None


def test_cross_entropy_against_plain_matching():
    import random

    rnd = random.Random(7)
    for _ in range(200):
        source, target = ([rnd.choice("abc") for _ in range(rnd.randrange(1, 25))] for _ in "st")
        total = 0
        for i in range(len(target)):
            n = 0
            while any(source[k : k + n + 1] == target[i : i + n + 1] for k in range(len(source) - n)) and i + n < len(target):
                n += 1
            total += n + 1
        want = len(target) * log2(len(source)) / total if len(source) > 1 else None
        assert info.cross_entropy(target, source) == (pytest.approx(want) if want is not None else None)


def test_information_changes_sign(spark):
    posts = spark.createDataFrame([(1, 2, "b c d"), (1, 1, "a b c"), (2, 1, "a b c d e"), (3, 1, None)], "user_id long, turn long, text string")
    seqs = info.sequences(posts)
    assert {r.user_id: r.tokens for r in seqs.collect()} == {1: ["a", "b", "c", "b", "c", "d"], 2: ["a", "b", "c", "d", "e"], 3: []}
    got = {(r.source, r.target): r.flow for r in info.pairwise_information(spark.createDataFrame([(1, 2), (2, 1)], "source long, target long"), seqs).collect()}
    assert got[1, 2] == pytest.approx(-got[2, 1])


def test_embedding_cache(spark):
    calls = spark.sparkContext.accumulator(0)
    base = info.hashing_encoder(8)

    def encoder(texts):
        calls.add(len(texts))
        return base(texts)

    old = info.embed_texts(spark.createDataFrame([(1, "one text"), (2, "two"), (3, "")], "pack_id long, text string"), encoder, "m")
    cache = spark.createDataFrame(old.collect(), old.schema)
    assert calls.value == 2 and cache.count() == 2
    new = info.embed_texts(spark.createDataFrame([(1, "one text"), (2, "changed")], "pack_id long, text string"), encoder, "m", cache).collect()
    assert calls.value == 3 and sorted(r.pack_id for r in new) == [1, 2]
    assert all(sum(x * x for x in r.embedding) == pytest.approx(1.0) for r in new)


def test_english(spark):
    d = spark.createDataFrame([("this is what they have been to",), ("das ist ein haus",), ("",), (None,)], "text string")
    assert [r[0] for r in d.select(info.english()).collect()] == [True, False, False, False]
    assert [r[0] for r in d.select(info.english(min_prob=0.0, min_chars=17)).collect()] == [True, False, False, False]
    assert [r[0] for r in d.select(info.english(score=F.lit(0.9), min_prob=0.8)).collect()] == [True, True, False, False]


def test_composites(spark):
    m, e = R.membership(spark, SF), R.edges(spark, SF)
    docs, posts = R.texts(spark, SF), R.posts(spark, SF)
    assert an.slice_analysis(m, posts, 60, 150)["curve"].count() >= 1
    assert an.slice_cosine(m, docs, 20, 20)["curve"].count() >= 1
    out = an.census(m, docs, 20, 20, 3, 2, 0.9, n_boot=5)
    assert {r.level for r in out["curve"].collect()} <= {0, 1, 2, 3}
    ego = R.edges(spark, SF).select(F.col("source").alias("node")).orderBy("node").limit(1)
    assert an.ego_cosine(ego, e, docs, 2)["curve"].columns and an.ego_information(ego, e, posts, 2, min_posts=1)["pairs"].columns
    pairs = out["pairs"].where("shared_packs > 0")
    sem = an.semantic_overlap(pairs, m, R.embeddings(spark, SF), 3, 5)
    assert sem["mismatch"].first()[0] == 0
    net = an.network(R.pair_table(spark, SF), None, 3, n_boot=5, known=R.pair_table(spark, SF))
    assert {k: v.count() > 0 for k, v in net.items()} == dict.fromkeys(net, True)
    emb = R.embeddings(spark, SF)
    for ensemble in ("canonical", "microcanonical"):
        parts = [an.null_model(m, pairs, emb, "slope", ensemble, 4, 0, "rowsum", task=t, tasks=2) for t in (0, 1)]
        both = parts[0]["replicates"].union(parts[1]["replicates"])
        assert an.null_reduce(parts[0]["observed"], both).first().n == 4
    curves = an.null_curves(m, pairs, emb, "canonical", 3, 3, method="rowsum", n_boot=5)["curves"]
    assert curves.count() == 8 and figures.null_overlay(curves).count() == 8
    assert an.degree_diagnostic(m, pairs, 300)["populations"].count() == 3
    found = an.pair_inspection(m, emb, n_draws=300)
    assert found["pairs"].count() == 5 and found["numbers"].count() == 5 and found["tidy"].count() == 75
    words = an.vocabulary_report(pairs, docs, (0.3, 0.9), 2, 3)
    assert words["curves"].count() >= 2 and words["monotone"].count() == 2 and words["slopes"].count() == 2
    fits = an.fit_corpus(pairs, docs, 2, 0.9)
    assert fits["same_pairs"].first().equal and {r.variant: r.max_abs_diff for r in fits["differences"].collect()}["A"] == 0
    assert 0 <= an.cooccurrence(m, pairs)["summary"].first().significant <= 1


def test_numbers_report(spark, tmp_path):
    p, m, emb = R.pair_table(spark, SF), R.membership(spark, SF), R.embeddings(spark, SF)
    text = an.numbers_report(p, str(tmp_path), 3, 10, 1, m, emb)
    assert "## 7 Degree-matched pairs" in text and (tmp_path / "log_interaction.parquet").exists()
    assert "CONTRADICTION" in an.numbers_report(p.withColumn("cosine", -F.col("shared_packs")).where("shared_packs >= 0").withColumn("cosine", F.lit(1.0) / (1 + F.col("shared_packs"))), str(tmp_path / "b"), 3, 5)
    curve = figures.overlap_curve(p, 8, 10)
    assert curve.columns == ["s_raw", "mean_cosine", "std", "count", "err_low", "err_high", "ci_low", "ci_high"]
    assert figures.renormalised_curve(p, 8, 10).columns[0] == "shared_packs" and figures.null_points(p).columns == ["s_raw", "n_obs", "mean_cosine"]
    assert figures.regime_cells(p, 10).columns == ["s_eff_regime", "network_distance", "n", "mean_cosine", "ci_low", "ci_high", "ci_width"]
    figures.draw(curve, "curve", str(tmp_path), "s_raw", "mean_cosine", "ci_low", "ci_high")
    assert (tmp_path / "curve.csv").read_text().startswith("s_raw,mean_cosine")


def test_report(spark, tmp_path):
    r = an.Report(str(tmp_path))
    r.heading("h")
    r.table(spark.range(3).toDF("x"), "t")
    r.contradict("draft says 4")
    text = r.flush()
    assert text.startswith("1 contradictions\n- draft says 4") and (tmp_path / "t.csv").exists()
    with pytest.raises(ValueError):
        r.table(spark.range(30).toDF("x"), "t", most=10)
    assert an.scrubbed("Date: Mon, 01 Jan 2024 Time: 10:11:12") == "Date: <date> Time: <time>"


def test_command_line(spark, tmp_path):
    packs = [{"name": f"p{k}", "members": [{"did": f"u{(k * j) % 9}"} for j in range(1, 5)]} for k in range(1, 9)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, packs)))
    (tmp_path / "e.csv").write_text("".join(f"u{a},u{(a * 2) % 9},2024\n" for a in range(9)))
    p = lambda n: str(tmp_path / n)
    cli.main(["eval-pairs", "--packs", p("p.jsonl"), "--n", "50", "--out", p("pairs.parquet")])
    assert spark.read.parquet(p("pairs.parquet")).count() > 5
    cli.main(["filter-edges", "--edges", p("e.csv"), "--packs", p("p.jsonl"), "--dedupe", "--out", p("f.parquet")])
    cli.main(["cap-degree", "--edges", p("f.parquet"), "--cap", "9", "--out", p("g.parquet")])
    cli.main(["paths", "--edges", p("g.parquet"), "--users", p("pairs.parquet"), "--out", p("d.parquet")])
    assert {"source", "target", "distance"} == set(spark.read.parquet(p("d.parquet")).columns)
    cli.main(["paths", "--edges", p("e.csv"), "--users", p("pairs.parquet"), "--cache", p("graph"), "--out", p("d2.parquet")])
    assert spark.read.parquet(p("graph")).columns == ["source", "target"]
    scored = spark.read.parquet(p("pairs.parquet")).withColumn("cosine", F.rand(1)).withColumn("hops", (F.rand(2) * 2 + 1).cast("int"))
    scored.write.parquet(p("scored.parquet"))
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(8)], "pack_id long, embedding array<double>").write.parquet(p("emb.parquet"))
    null = ["--packs", p("p.jsonl"), "--pairs", p("scored.parquet"), "--embeddings", p("emb.parquet"), "--replicates", "3", "--method", "rowsum", "--out", p("null")]
    for task in "01":
        cli.main(["null-model", *null, "--task", task, "--tasks", "2"])
    cli.main(["null-model", *null, "--reduce"])
    assert spark.read.parquet(p("null/summary")).first().n == 3
    cli.main(["null-curves", *null[:-1], p("curves"), "--max-shared", "3", "--n-boot", "5"])
    assert (tmp_path / "curves" / "curves.csv").exists()
    (tmp_path / "nodes.txt").write_text("u1\nu2\n")
    cli.main(["filter-edges", "--edges", p("e.csv"), "--nodes", p("nodes.txt"), "--either", "--out", p("n.parquet")])
    cli.main(["inspect-pairs", "--packs", p("p.jsonl"), "--embeddings", p("emb.parquet"), "--out", p("five")])
    assert spark.read.parquet(p("five/pairs")).count() <= 5
    cli.main(["cooccurrence", "--packs", p("p.jsonl"), "--pairs", p("pairs.parquet"), "--out", p("c")])
    assert spark.read.parquet(p("c/summary")).count() == 1
