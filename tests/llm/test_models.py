"""The three classifiers: held-out accuracy, hard cases, and their kernels against plain code."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from covey.llm import language_id, quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def accuracy(out, truth, name):
    rows = out.where("held_out").join(truth, "doc_id").where(F.col("y").isNotNull())
    return rows.agg(F.avg((F.col(name) == F.col("y")).cast("double"))).first()[0]


def test_quality(spark, docs, rows, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    out = quality_classifier.classify_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert accuracy(out, labels, "predicted") >= 0.95
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.collect())
    mess = quality_classifier.classify_quality(docs, labels).collect()
    assert len(mess) == len(rows) and all(0 <= r.score <= 1 for r in mess)
    assert quality_classifier.classify_quality(none, labels).count() == 0
    assert {r.score for r in quality_classifier.classify_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    twisted = labels.withColumn("y", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({r.doc_id: r.score for r in quality_classifier.classify_quality(docs, x).collect()} for x in (labels, twisted))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def twisted(labels, folds, fold):
    return labels.withColumn("y", F.when(F.crc32(F.col("doc_id").cast("string")) % folds == fold, 1 - F.col("y")).otherwise(F.col("y")))


def test_few_labels_give_scores_of_their_own(spark):
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    out = quality_classifier.classify_quality(docs, labels).collect()
    assert len({r.score for r in out}) > len(out) / 2
    held_out = {r.doc_id: r.predicted for r in out if r.held_out}
    truth = [(held_out[r.doc_id], r.y) for r in labels.collect() if r.doc_id in held_out]
    assert sum(p == y for p, y in truth) >= 0.9 * len(truth) and any(p == 0 for p, y in truth if y == 0)
    one = labels.where("y = 1").union(labels.where("y = 0").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy("doc_id").limit(1))
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify_quality(docs, one).collect())  # one row of a class will do
    assert {r.score for r in quality_classifier.classify_quality(docs, labels.where("y = 1")).collect()} == {1.0}


def test_statistics_against_plain_code():
    import re
    from math import log, log1p, sqrt

    rnd = np.random.default_rng(2)
    texts = ["", " ", "a", "Ab AB!! ab ab | x9 \n\nÜber, den Zaun? ja.\nja.\n ja.", "one|two # $ %\n| | |\n!!", " ".join(rnd.choice(["aa", "B!", "c.", "d|", "e", "9", "|"], 300))]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
        n, m = max(1, len(words)), max(1, len(lines))
        raw = text.encode()
        chars = max(1, sum(b > 32 for b in raw))
        count = lambda f: sum(map(f, raw))
        share = lambda k, of: log((k + 0.5) / (of + 1))
        want = [
            log1p(len(words)), log(chars / n), share(count(lambda b: b in b"#*$%&|<>"), chars), share(count(lambda b: 65 <= b < 91), chars), share(count(lambda b: 48 <= b < 58), chars), share(count(lambda b: b in b",.;:'\"()-?"), chars),
            share(text.count("!!"), n), sqrt(len(set(words)) / n), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), log1p(n / m), share(m - len(set(lines)), m),
            share(sum(x.rstrip()[-1] in ".!?" for x in lines), m), share(max([words.count(w) for w in words], default=0), n), share(count(lambda b: b > 127), chars), share(text.count(" | "), n),
        ]
        assert np.allclose(quality_classifier.statistics(raw), want), text


def test_qda_is_the_density_ratio():
    rng = np.random.default_rng(0)
    d = len(quality_classifier.NAMES)
    x = [rng.normal(0, 1, (200, d)), rng.normal(0.7, 2, (300, d))]
    sums = np.stack([np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()]) for v in x])
    m = quality_classifier.Model(sums)
    z = rng.normal(0.5, 1.5, (20, d))
    dens = []
    pooled = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x) / 500
    for v in x:
        c = (v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) / len(v)
        own = (1 - quality_classifier.POOLED - quality_classifier.DIAGONAL) * len(v) / (len(v) + d)
        c = own * c + (1 - own - quality_classifier.DIAGONAL) * pooled + quality_classifier.DIAGONAL * np.diag(np.diag(pooled)) + np.eye(d) * quality_classifier.FLOOR
        e = z - v.mean(axis=0)
        dens.append(np.log(len(v) / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (e @ np.linalg.inv(c) * e).sum(axis=1))
    assert np.allclose(m.score(z), 1 / (1 + np.exp((dens[0] - dens[1]) / d)))


def test_language(spark, docs, rows, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(table)
    out = language_id.identify(table, model)
    assert accuracy(out, table.select("doc_id", F.col("lang").alias("y")), "lang_pred") >= 0.97
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.lang_pred in [*model.langs, "und"] for r in out.collect())
    mess = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (None, "und")} <= mess
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(none)).collect()} == {"und"}
    de, en = (table.where(f"lang = '{x}'").orderBy(F.desc("n_chars")).first().text[:1500] for x in ("de", "en"))
    found = language_id.spans(spark.createDataFrame([(1, f"{en} {de} {en}")], "doc_id long, text string"), model).orderBy("begin").collect()
    assert [r.lang for r in found] == ["en", "de", "en"]


def test_language_ignores_held_out_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    twisted = table.withColumn("lang", F.when(held_out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(held_out, F.lit("zzz")).otherwise(F.col("text")))
    a, b = language_id.fit(table), language_id.fit(twisted)
    assert a.langs == b.langs and np.array_equal(a.logs, b.logs) and np.array_equal(a.written, b.written)


def test_repeated_rows_take_one_place_in_the_sample(spark):
    docs = spark.createDataFrame([(k, "en", f"word{k} and more words") for k in range(60)], "doc_id long, lang string, text string")
    often = docs.union(docs.where("doc_id < 30").crossJoin(spark.range(40)).drop("id"))
    one, many = language_id.fit(docs, 20), language_id.fit(often, 20)
    assert ((one.logs > one.logs.min()) == (many.logs > many.logs.min())).all()  # the same documents' trigrams are known


def test_language_counts_against_plain_code(spark):
    from collections import Counter

    a, b, c, d = [i for i in range(40) if not held(i, 4, 2)][:4]
    rows = [(a, "en", "The tree, the TREE"), (b, "ru", "дерево a1b"), (c, "en", None), (d, None, "no"), (b, "ru", "дерево a1b")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    for k, lang in enumerate(model.langs):
        grams, letters = Counter(), Counter()
        for _, own, text in rows:
            if own == lang and text:
                for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
                    padded = f"\0{word}\0"
                    letters.update("Cyrillic" if "\u0400" <= c < "\u0530" else "Latin" for c in word)
                    for i in range(len(padded) - 2):
                        points = np.array([ord(c) for c in padded[i : i + 3]], np.uint32)
                        code = np.uint64(3)
                        with np.errstate(over="ignore"):
                            for p in points:
                                code = (code ^ np.uint64(p)) * np.uint64(0x9E3779B97F4A7C15)
                                code ^= code >> np.uint64(29)
                        grams[int(code >> np.uint64(64 - language_id.BITS))] += 1
        total = sum(grams.values()) + language_id.ADDED * (1 << language_id.BITS)
        seen = np.array(list(grams))
        assert np.allclose(model.logs[seen, k], np.log((np.array(list(grams.values())) + language_id.ADDED) / total), atol=1e-5)
        names = language_id.script_table()[1]
        assert {names[i] for i in np.flatnonzero(model.written[:, k])} == {s for s, n in letters.items() if n >= language_id.WRITTEN * sum(letters.values())}


def test_scripts_narrow():
    counts = [("ru", -1 - 2, 100), ("ru", 5, 100), ("en", -1, 100), ("en", 6, 100)]
    names = language_id.script_table()[1]
    counts[0] = ("ru", -1 - names.index("Cyrillic"), 100)
    model = language_id.Model(counts)
    assert model.predict("привет мир")[0] == "ru" and model.predict("hello there")[0] == "en" and model.predict("12 34 !")[0] == "und"


def test_viterbi():
    rng = np.random.default_rng(3)
    for n, k, cost in itertools.product((1, 2, 6), (1, 2, 3), (0.5, 2.0, 10.0)):
        s = rng.normal(0, 2, (n, k))
        value = lambda p, s=s, cost=cost: sum(s[i, x] for i, x in enumerate(p)) - cost * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(k), repeat=n), key=value)
        assert abs(value(tuple(language_id.viterbi(s, cost))) - value(best)) < 1e-9


def test_toxicity(spark, docs, rows, none):
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 7))) for _ in range(400)]
    bad = ["zkvoid", "zkvoids", "zkvoidal", "mugwyx", "mugwyxer"]
    data, labels = [], []
    for i in range(1200):
        words = list(rng.choice(clean, 40))
        y = int(i % 4 == 0)
        if y:
            words[int(rng.integers(40))] = str(rng.choice(bad))
        data.append((i, " ".join(words)))
        labels.append((i, y))
    table, truth = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")
    model = toxicity.fit(table, truth)
    out = toxicity.score_toxicity(table, model)
    assert accuracy(out, truth, "predicted") >= 0.97
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.5) for r in out.collect())
    assert model.score("lastr zkvoidly aeno") > 0.5 > model.score("")  # an unseen form
    mess = toxicity.score_toxicity(docs, model).collect()
    assert len(mess) == len(rows) and all(0 <= r.score <= 1 for r in mess)
    assert toxicity.score_toxicity(none, model).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, toxicity.fit(docs, truth.limit(0))).collect())


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    emb, out, bias = rng.normal(size=(9, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    codes, n, share, weight = np.array([0, 3, 3, 8, 1, 0]), np.array([3, 0, 1, 2]), np.array([1.0, 0.0, 0.3, 0.0]), np.array([1.0, 2.0, 0.5, 1.5])
    loss = lambda: toxicity.gradients(emb, out, bias, codes, n, share, weight)[0]
    _, keys, by_emb, by_out, by_bias = toxicity.gradients(emb, out, bias, codes, n, share, weight)
    assert keys.tolist() == [0, 1, 3, 8]
    dense = np.zeros_like(emb)
    dense[keys] = by_emb
    for values, grad in ((emb, dense), (out, by_out), (bias, by_bias)):
        for at in np.ndindex(values.shape):
            old = values[at]
            values[at] = old + 1e-6
            up = loss()
            values[at] = old - 1e-6
            down = loss()
            values[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-6


def test_bags_against_plain_code():
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS), 0.3)
    texts = ["", "12 34", "one", " ".join(rng.choice(["alpha", "beta", "Gamma", "delta9", "x"], 150)), "a" * 500, "ü" * 70 + " short"]
    docs, logits, counts = [], [], []
    for k, text in enumerate(texts):
        words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if any(map(str.isalpha, w))]
        own = {}
        for w in words:
            points = toxicity.code_points(w)
            sums = sum(model.weights[c].sum(dtype=float) for c, _ in toxicity.word_grams(points, np.array([0]), np.array([len(w)])))
            own[w] = sums / sum(int(m[0]) for _, m in toxicity.word_grams(points, np.array([0]), np.array([len(w)]))) + 0.3
        worst = sorted((own[w] for w in words), reverse=True)[: 1 + len(words) // 60]
        want = sum(worst) / len(worst) if worst else -30.0
        assert abs(model.bag(text) - want) < 1e-4, text[:20]
        for w in own:
            docs, logits, counts = [*docs, k], [*logits, own[w]], [*counts, words.count(w)]
        assert abs(toxicity.bag_logits(np.array(docs, int), np.array(logits, float), np.array(counts, int), k + 1)[k] - want) < 1e-4


def test_toxicity_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    known = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model, other = toxicity.fit(docs, labels), toxicity.fit(docs, twisted(labels, 5, 0))
    assert np.array_equal(model.weights, other.weights) and (model.bias, model.offset) == (other.bias, other.offset)  # held-out labels play no part
    rows = toxicity.score_toxicity(known, model).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.y == 1], [r.predicted for r in rows if r.y == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_long_words_are_learned_whole(spark):
    head = "qwertzuiop" * 8
    data = [(i, head + ("zkvoidmugwyx" if i % 3 == 0 else "lastraeno") + "mnbv" * 100) for i in range(90)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    truth = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in data], "doc_id long, y int")
    model = toxicity.fit(table, truth)
    assert model.bag(data[0][1]) > model.bag(data[1][1])
