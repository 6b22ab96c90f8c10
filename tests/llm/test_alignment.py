"""Alignment against a plain account of byte ranges, text by text and over a table."""

import bisect
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from covey.llm import alignment as al

PATHS = al.tokenizer_paths()


@pytest.fixture(scope="module")
def aligner():
    return al.Aligner(*PATHS, young=50)  # pieces are forgotten again and again


def plain(aligner, text):
    """n_a, n_b, n_groups, groups as text, links with how often they occur; from the libraries' whole encodings."""
    none = (0, 0, 0, "", {})
    if not text:
        return none
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    want = (" " + text).encode()

    def ranges(ids, table):
        out, at = [], 0
        for k in ids:
            out.append((at, at + len(table[k]), k))
            at += len(table[k])
        return out

    if not b"".join(aligner.bytes_a[k] for k in a) == b"".join(aligner.bytes_b[k] for k in b) == want:
        return none
    x, y = ranges(a, aligner.bytes_a), ranges(b, aligner.bytes_b)
    ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    sides = [{e: [] for e in ends} for _ in range(2)]
    for side, tokens in zip(sides, (x, y), strict=True):
        for _, e, k in tokens:
            side[ends[bisect.bisect_left(ends, e)]].append(str(k))
    groups = [f"{','.join(sides[0][e])}|{','.join(sides[1][e])}" for e in ends]
    starts, links = [s for s, _, _ in y], Counter()
    for s, e, p in x:  # every token of B whose range meets that of the token of A
        for t, u, q in y[max(0, bisect.bisect_right(starts, s) - 1) : bisect.bisect_left(starts, e)]:
            links[p, q] += s < u and t < e
    return len(a), len(b), len(ends), ";".join(groups), dict(links)


def test_texts(aligner):
    rnd = random.Random(11)
    chars = list(" \n\t  \x1c\x85 ab1!'s.日本é▁<s>\U0001f600\x00")
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(1, 40))) for _ in range(1500)]
    words = ["the", "word,", "Word.", "naïve", "I'll", "don't", "'s", "x", "!!", "and\nso", "été:", "1.5%", "a'", "b's,"]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    texts += ["<|endoftext|> <s></s> <0x0A>", "a" * 3000, " ", " a", "a ", "  ", "\n", "x \n y", "a\n", "a \n", "\na", "one\ntwo\nthree", "．ﬁ", "trailing  "]
    for text in texts:
        n_a, n_b, n_groups, sha, pairs, times = aligner.align(text)
        want = plain(aligner, text)
        assert (n_a, n_b, n_groups) == want[:3], text
        assert sha == (hashlib.sha256(want[3].encode()).hexdigest() if want[0] else "")
        assert {(int(p) // aligner.n_b, int(p) % aligner.n_b): int(n) for p, n in zip(pairs, times, strict=True)} == want[4]


def _expected(aligner, rows):
    found = [(doc_id, plain(aligner, text)) for doc_id, text in rows]
    counts = Counter(p for _, f in found for p in f[4])
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, (n_a, n_b, n_groups, groups, links) in found:
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        out.append((doc_id, n_a, n_b, n_groups, sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
    return Counter(out), counts, most


@pytest.mark.parametrize("broadcast", [al.BROADCAST, 0])
def test_table(spark, docs, rows, aligner, broadcast):
    """Nulls, empty and long texts, repeated rows and other columns, with counts broadcast and shuffled."""
    names = ("row", "n_a", "pair", "pairs", "times", "count", "best", "a", "Text", "at")
    out = al.align(docs.select("*", *[F.lit(1).alias(n) for n in names]), *PATHS, broadcast=broadcast)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == _expected(aligner, [(r[0], r[1]) for r in rows])[0]


def test_links_and_empty_tables(spark, docs, rows, none, aligner):
    _, counts, most = _expected(aligner, [(r[0], r[1]) for r in rows])
    got = {(r.a, r.b): (r["count"], r.best) for r in al.link_table(docs, *PATHS).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in counts.items()}
    assert al.align(none, *PATHS).count() == 0
