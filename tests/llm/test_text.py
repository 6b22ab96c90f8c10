"""BPE, quality rules, mixing and URL filters."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from covey.llm import bpe, mixing, quality_rules, url_filters

PATH = bpe.tokenizer_path()
CODEC, LIBRARY = bpe.Codec(PATH, young=50), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ'sé ÉßΣσς\n\t ́<|>!?12½　日本"), st.characters(codec="utf-8")), max_size=60))
def test_codec(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == want
    assert CODEC.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|startoftext|> x <|endoftext|><|endoftext|>", "it's we'll I'D", "×÷ İ <|EndOfText|>", "q" * 5000, "jqzx&&&%%%"])
def test_codec_cases(text):
    assert CODEC.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_forced_boundaries():
    cuts = CODEC.fragments("thjqxz!!")
    assert len(cuts) > 1 and "".join(cuts) == "thjqxz!!"
    assert all(pair not in CODEC.joined for a, b in zip(cuts, cuts[1:], strict=False) for pair in [(a[-1], b[0])])


def test_bpe_tables(docs, rows, none):
    ids = bpe.encode(docs, PATH)
    got = Counter((r.doc_id, tuple(r.ids)) for r in ids.collect())
    assert got == Counter((r[0], tuple(LIBRARY.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    back = Counter((r.doc_id, r.text) for r in bpe.decode(ids, PATH).collect())
    assert back == Counter((i, LIBRARY.decode(list(x), skip_special_tokens=False)) for i, x in got.elements())
    assert bpe.digests(docs, PATH).count() == len(rows) and bpe.digests(none, PATH).count() == 0


def plain_repeats(words, n=5):
    at = defaultdict(list)
    for k in range(len(words) - n + 1):
        at[tuple(words[k : k + n])].append(k)
    return len({p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + n)})


def test_repeated_words():
    rnd = random.Random(4)
    for size in (0, 4, 5, 9, 60, 400):
        for vocabulary in (1, 2, 5, 300):
            words = [b"%d" % rnd.randrange(vocabulary) for _ in range(size)]
            assert quality_rules.repeated_words(words) == plain_repeats(words)
    words = [b"%d" % k for k in range(9000)] * 2
    assert quality_rules.repeated_words(words) == 18000


def test_quality(docs, rows, none):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect()}
    want = set()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        lines = [x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = plain_repeats(words)
        want.add((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), rep, len(words) < 10 or 100 * rep > 20 * len(words)))
    assert got == want
    kept = quality_rules.good_documents(docs)
    assert kept.columns == docs.columns and quality_rules.good_documents(none).count() == 0
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect())


def test_line_rules():
    rule = lambda x: quality_rules.failed_rule(x.encode())
    assert rule("A sentence that says what it says.") is None
    assert rule("Home | About | Contact | Help") == "navigation"
    assert rule("BUY!! NOW!! IT!! IS!! CHEAP!!") == "punctuation"
    assert rule("foo*** bar### baz$$$ qux%%%") == "markup"
    assert rule("Licensed under the Apache License, Version 2.0.") == "boilerplate"
    assert rule("Table of contents") == "punctuation"
    assert quality_rules.cleaned_text("Good line here.\nHome | About | Us | Me\nMore.") == "Good line here.\nMore."


def test_lines_of_other_scripts_and_recipes():
    rule = lambda x: quality_rules.failed_rule(x.encode())
    for line in ("كيف حالك يا صديقي؟", "मैं घर जा रहा हूँ।", "这是 一句话。", "これは 文です。", "สวัสดี ครับ ผม", "«Где ты?»", "He said “go.”", "Grandma's cookie recipe.", "Two cookies for you."):
        assert rule(line) is None, line
    for line in ("We use cookies to improve this site.", "Accept all cookies", "Cookie settings.", "Read our privacy policy."):
        assert rule(line) == "boilerplate", line
    assert rule("कोई अंत नहीं है") == "punctuation"
    recipe = "\n".join(["Grandma's cookie recipe.", "Mix two cups of flour and sugar.", "Let the cookie dough rest.", "Bake each cookie for ten minutes.", "Eat every cookie warm."])
    assert quality_rules.measures(recipe.encode())[6:] == (True, 0)


def test_prose_may_name_boilerplate():
    line = " ".join(f"word{k}" for k in range(250)) + " a cookie and the copyright of it " + " ".join(f"term{k}" for k in range(250)) + "."
    assert quality_rules.failed_rule(line.encode()) is None and quality_rules.measures(line.encode())[6]
    assert quality_rules.failed_rule(b"We use a cookie to remember what you like and all rights reserved.") == "boilerplate"


def water(sizes):
    """sizes: source -> size. Targets by going up in small steps of rounds, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, live = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and live:
        total = sum(w[s] for s in live)
        for s in list(live):
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(live):
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                live.discard(s)
    return target


def test_mixing(spark, docs, rows, none):
    rnd = random.Random(8)
    more = [(100 + k, " ".join("w" for _ in range(rnd.choice([3, 5, 5, 80]))), None, rnd.choice(["s1", "b", "b", "z"]), 0, 1, "h", 3) for k in range(900)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    out = mixing.mix(mixing.sized(table)).selectExpr("doc_id", "source", "__size AS n", "source_size", "target", "__key", "copies AS k").collect()
    assert len(out) == len(rows) + len(more)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r.n
    want = water(sizes)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.n * r.k for r in own) - want[s]) <= max(r.n for r in own) + 1e-6
        assert all(0 <= r.k <= 2 for r in own)
    again = mixing.mix(mixing.sized(table.repartition(7))).selectExpr("doc_id", "copies").collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.k) for r in out)
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.k for r in out)
    assert mixing.mixed_documents(table.select("doc_id", "text", "source")).count() == mixed.count()
    assert mixing.mixed_documents(none).count() == 0


def test_hosts_of_very_many_labels(spark):
    entries = spark.createDataFrame([("block", "bad.org", "2024-01-01", True), ("block", "x." * 30 + "bad.org", "2024-01-01", True), ("allow", "a.very.good.bad.org", "2024-01-01", True)], "list string, domain string, at string, listed boolean").selectExpr("list", "domain", "to_timestamp(at) AS at", "listed")
    urls = ["http://" + "x." * 60_000 + "bad.org/", "http://" + "x." * 60_000 + "good.org/", "http://q.a.very.good.bad.org", "http://very.good.bad.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "timestamp'2024-02-01' AS fetched_at")
    url_filters.filter_urls(pages.limit(0), entries).collect()
    start = time.time()
    assert [(r.n_block, r.n_allow) for r in url_filters.filter_urls(pages, entries).orderBy("page_id").collect()] == [(2, 0), (0, 0), (1, 1), (1, 0)]
    assert time.time() - start < 20


def test_urls(spark):
    entries = spark.createDataFrame([("block", "bad.org", "2024-01-02", True), ("block", "bad.org", "2024-01-04", False), ("allow", "ok.bad.org", "2024-01-03", True), ("block", None, "2024-01-01", True), ("block", "bad.org", "2024-01-02", False)], "list string, domain string, at string, listed boolean").selectExpr("list", "domain", "to_timestamp(at) AS at", "listed")
    urls = ["http://bad.org/x", "HTTPS://u:p@A.Bad.org.:80/", "http://ok.bad.org", "http://notbad.org", "no url", None]
    rows = [(k, u, f"2024-01-0{d}") for d in range(1, 6) for k, u in enumerate(urls)] + [(9, urls[0], None)]
    out = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, t string").selectExpr("page_id", "url", "to_timestamp(t) AS fetched_at"), entries).collect()
    assert len(out) == len(rows)
    got = {(r.page_id, r.fetched_at.day if r.fetched_at else None): r.blocked for r in out}
    for d in range(1, 6):
        assert got[0, d] == got[1, d] == (d in (2, 3)) and got[2, d] == (d == 2) and not got[3, d] and not got[4, d] and not got[5, d]
    assert got[9, None] is False
    assert not url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string, fetched_at timestamp"), entries).collect()
    assert all(not r.blocked for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, t string").selectExpr("page_id", "url", "to_timestamp(t) AS fetched_at"), entries.limit(0)).collect())
