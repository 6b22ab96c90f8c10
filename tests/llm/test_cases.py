"""Clashing names, very long texts, empty tables and repeated rows, for every operator that the other tests don't ask."""

import hashlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from covey.llm import bpe, common, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, toxicity, url_filters

EXTRA = ("Copies", "TARGET", "Source_Size", "__start", "__copy", "__id", "__gone", "__null", "__row", "__bitmap", "__maybe", "__key", "__hash", "__bits", "c0", "c1", "TEXT", "Doc_Id", "row_hash", "y", "place")
PATH = bpe.tokenizer_path()


@pytest.fixture(scope="module")
def clashing(docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return plain.select(*plain.columns, *[F.lit(f"own {n}").alias(n) for n in EXTRA])


def counted(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("f", [line_dedup.line_dedup, quality_rules.good_documents, mixing.mixed_documents, ngram_join.first_of_groups], ids=lambda f: f.__name__)
def test_columns_of_any_name_stay(docs, clashing, f):
    out = f(clashing)
    assert out.columns == clashing.columns
    got = Counter((*r[:5],) for r in map(tuple, out.collect()) if r[5:] == tuple(f"own {n}" for n in EXTRA))
    assert got == counted(f(docs.select("doc_id", "text", "lang", "source", "n_chars")))


def test_columns_of_any_name_are_ignored(spark, docs, clashing):
    labels = spark.createDataFrame([(k, k % 2, "x", "z") for k in range(40)], "doc_id long, y int, Y2 string, Doc_Id string")
    plain = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, y int")
    language, toxic = language_id.fit(docs), toxicity.fit(docs, plain)
    for f in (
        line_dedup.digests, exact_dedup.exact_dedup, quality_rules.quality_rules, ngram_join.near_groups, lambda d: bpe.encode(d, PATH).withColumn("ids", F.col("ids").cast("string")), lambda d: bpe.digests(d, PATH),
        lambda d: language_id.identify(d, language), lambda d: language_id.spans(d, language), lambda d: toxicity.score_toxicity(d, toxic), lambda d: quality_classifier.classify_quality(d, labels if d is clashing else plain),
    ):
        a, b = counted(f(clashing)), counted(f(docs))
        if any(isinstance(x, float) for r in a for x in r):
            a, b = (Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in c.elements()) for c in (a, b))
        assert a == b


def test_very_long_texts(spark, tmp_path):
    word, line = "word" * 250_000, "A line of some forty characters that is long enough to be a key."
    many = " ".join(f"w{k % 5000}." for k in range(300_000))
    texts = [word, many, f"{many} ", "\n".join([line] * 20_000), f"{many} one more word"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(10 + k, line, "en", "s", len(line)) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    library = Tokenizer.from_file(PATH)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in bpe.digests(docs, PATH).collect():
        e = library.encode(dict((a, b) for a, b, *_ in rows)[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False)))
    kept = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.digests(docs).collect()}
    assert kept[3] == (20_000, 20_000) and kept[14] == (1, 0) and kept[10] == (1, 1) and kept[1] == (1, 0)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}[12] == (10, 5)
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs).collect()}
    assert groups[0] == (1, 0) and groups[2][1] == 1 and groups[4][1] == 1 and groups[14][1] == 10
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(docs).collect()}[4] == 300_003
    assert {r.doc_id: r["__size"] for r in mixing.mix(mixing.sized(docs)).collect()}[1] == 300_000
    model = language_id.fit(docs)
    assert all(r.lang_pred == "en" for r in language_id.identify(docs, model).collect())
    labels = spark.createDataFrame([(k, int(k == 1)) for k, *_ in rows], "doc_id long, y int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect())
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify_quality(docs, labels).collect())


def test_pieces_are_bounded(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (10, 10, 500, 10, 10)] + [None, ""]})
    parts = list(common.pieces(iter([batch, batch.slice(0, 0)]), rows=3, most=30))
    assert [p.num_rows for p in parts] == [2, 1, 3, 1, 0] and pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def test_filter_keeps_every_key(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(60_000)
    marked = common.Filter(keys).asked(rows, F.xxhash64("id"), "maybe")
    held = {r.id for r in marked.where("maybe").collect()}
    assert set(range(3000)) <= held and len(held) < 3000 + 0.1 * 57_000
    none = common.Filter(keys.limit(0)).asked(rows, F.xxhash64("id"), "maybe")
    assert none.where("maybe").count() == 0 and none.columns == ["id", "maybe"]


def test_staged_tables_go_with_their_owner(spark):
    with common.staging() as own:
        a = common.staged(spark.range(5).toDF("x"), "a")
        other = common.Staged()
        b = common.staged(spark.range(6).toDF("x"), "b", other)
    c = common.staged(spark.range(7).toDF("x"), "c")
    assert (len(own), len(other)) == (1, 1)
    own.delete(spark)
    assert not own and b.count() == 6 and c.count() == 7
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        spark.read.parquet(a.inputFiles()[0]).count()


def test_operators_at_once(spark, docs):
    """Two operators in two threads of one driver, again and again: neither takes the other's tables away."""
    run = {"lines": lambda: line_dedup.digests(docs).collect(), "copies": lambda: exact_dedup.exact_dedup(docs).collect()}
    want = {k: Counter(map(tuple, f())) for k, f in run.items()}
    with ThreadPoolExecutor(2) as pool:
        found = [(k, pool.submit(f)) for _ in range(3) for k, f in run.items()]
        assert all(Counter(map(tuple, f.result())) == want[k] for k, f in found)


def test_url_names(spark):
    entries = spark.createDataFrame([("block", "bad.org", "2024-01-02", True, 1)], "list string, domain string, at string, listed boolean, Host int").withColumn("at", F.to_timestamp("at"))
    rows = spark.createDataFrame([(1, "http://www.bad.org/x", "2024-01-03", "h", 5, "s")], "page_id long, url string, t string, Host string, n_block int, since string").selectExpr("page_id", "url", "to_timestamp(t) AS fetched_at", "Host", "n_block", "since")
    assert [(r.page_id, r.host, r.n_block, r.blocked) for r in url_filters.filter_urls(rows, entries).collect()] == [(1, "www.bad.org", 1, True)]
