"""The n-gram join against all pairs in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from covey.llm import components, ngram_join


def plain(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                ngram_join._union(up, i, j)
    roots = [ngram_join._find(up, i) for i in range(len(rows))]
    least = {x: min((r[0] for r, y in zip(rows, roots, strict=True) if y == x and r[0] is not None), default=None) for x in roots}
    return Counter((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, roots, strict=True))


@pytest.mark.parametrize("bounds", [{}, {"chunk": 500, "at_once": 300}])
def test_all(docs, rows, bounds):
    assert Counter(map(tuple, ngram_join.near_groups(docs, **bounds).collect())) == plain(rows)


def test_repeated_batches(docs, rows):
    assert Counter(map(tuple, ngram_join.near_groups(docs.union(docs)).collect())) == plain(rows + rows)


def family(seed, sizes, words=90):
    rnd = random.Random(seed)
    rows, shared = [], " ".join(f"p{k}" for k in range(60))
    for n in sizes:
        base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 4])):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                w = w + shared.split()
            rows.append((len(rows), " ".join(w)))
        if rnd.random() < 0.5:
            rows.append((len(rows), shared + " " + " ".join(base[:20])))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"chunk": 1500}])
def test_families(spark, tmp_path, bounds):
    rows = family(5, [2, 3, 40, 7, 60, 2])
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    assert Counter(map(tuple, ngram_join.near_groups(spark.read.parquet(str(tmp_path / "d")), **bounds).collect())) == plain(rows)


def test_search_finds_what_it_should():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 300, 60)
    sets = [np.unique(np.r_[base[: rnd.integers(30, 60)], rnd.integers(0, 2000, rnd.integers(0, 12))]).astype(np.uint64) for _ in range(150)]
    order = sorted(range(150), key=lambda k: len(sets[k]))
    sets = [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    lists = ngram_join.Lists(sizes, sets)
    for q, s in enumerate(sets):
        want = {k for k, t in enumerate(sets) if ngram_join.linked(len(np.intersect1d(s, t)), len(s), len(t))}
        assert set(lists.search(s, len(s), lambda d: False)) == want, q


def test_first_of_groups(docs, none):
    out = ngram_join.first_of_groups(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    groups = {r.doc_id: r.component_id for r in ngram_join.near_groups(docs).collect() if r.doc_id is not None}
    assert {i for i in ids if i is not None} == set(groups.values())
    assert ngram_join.near_groups(none).count() == 0


def test_one_row_of_each_group(spark, tmp_path):
    w = [f"w{k}" for k in range(60)]
    a, near, other, alone, small = " ".join(w), " ".join(w[:59]), " ".join(w[::-1]), " ".join(w[::2]), "just three words"
    rows = [(1, a, "x"), (1, a, "x"), (1, near, "y"), (2, near, "x"), (3, near, "x"), (3, other, "x"), (None, a, "x"), (None, alone, "x"), (None, alone, "x"), (7, small, "x"), (7, small, "z"), (8, "", "x"), (8, "", "x"), (None, None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    out = Counter((r.doc_id, r.text) for r in ngram_join.first_of_groups(spark.read.parquet(str(tmp_path / "d"))).collect())
    first = (1, a) if (1, a) in out else (1, near)
    assert out == Counter([first, (3, other), (None, alone), (7, small), (8, ""), (8, ""), (None, None)])


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, 5)]
    up = {}
    for a, b in links:
        ngram_join._union(up, a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: ngram_join._find(up, x) for x in list(up) if ngram_join._find(up, x) != x}


def test_a_block_of_near_misses_is_not_probed_pair_by_pair(monkeypatch):
    """Sets that share 0.7 to 0.8 of their shingles with nearly all others: whoever searches finds many, and looks into the long lists once for all of them."""
    rnd, probes = np.random.default_rng(3), []
    base, fresh = np.arange(1, 301), iter(range(10**6, 10**8))
    sets = [np.sort([next(fresh) if x < 0.085 else int(b) for b, x in zip(base, rnd.random(300), strict=True)]).astype("<u8") for _ in range(120)]
    near = ngram_join.bisect_left
    monkeypatch.setattr(ngram_join, "bisect_left", lambda *a: (probes.append(1), near(*a))[1])
    up = {}
    for a, b in ngram_join.chunk_links(list(range(len(sets))), [300] * len(sets), sets):
        ngram_join._union(up, a, b)
    want = {}
    for i, a in enumerate(sets):
        for j in range(i):
            if ngram_join.linked(len(np.intersect1d(a, sets[j])), 300, 300):
                ngram_join._union(want, i, j)
    assert [ngram_join._find(up, k) for k in range(120)] == [ngram_join._find(want, k) for k in range(120)]
    assert 2 < len({ngram_join._find(want, k) for k in range(120)}) < 118
    assert len(probes) < 120 * 120
