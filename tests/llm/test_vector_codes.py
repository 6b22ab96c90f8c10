"""Vector codes against plain rounds of Lloyd, with ties, repeats, nulls and vectors that fit no codebook."""

import math
import random

import numpy as np
import pytest

from covey.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, cell int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label). Codes, errors and codebooks by holding every part against every entry."""
    kept = sorted(((i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = near()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = near()
    return [(i, bytes(k), sum(far(c[p], books[p][k[p]]) for p in range(parts)), label) for (i, _, label), c, k in zip(kept, cut, codes, strict=True)], books


def _rows(n=120, step=0.25):
    rnd = random.Random(5)
    rows = [(k * 3, [step * rnd.randrange(-3, 4) for _ in range(16)], rnd.choice([1, 2, 2, None])) for k in range(n)]  # coarse steps: many ties
    rows += [rows[4], rows[4], (1, None, 1), (2, [0.5] * 15 + [None], 1), (4, [math.nan] + [0.0] * 15, 2), (5, [math.inf] * 16, None), (None, [0.1] * 16, 7)]
    return rows


def test_codes_are_those_of_plain_rounds(spark):
    rows = _rows()
    table = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA).repartition(5)
    coded, books = vc.compress(table)
    want, want_books = plain(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.vec_id, bytes(r.code), r.error, r.label) for r in coded.collect()), key=order)
    assert got == sorted(want, key=order)
    assert books.tolist() == want_books
    sums = {r.label: r.label_error for r in vc.with_label_errors(coded).select("label", "label_error").distinct().collect()}
    assert sums == {x: sum(r[2] for r in want if r[3] == x) for x in {r[3] for r in want}}


def test_bounds_save_scans_and_keep_ties():
    rng = np.random.default_rng(3)
    for grain in (1, 40):  # grain 40: nearly every distance is met twice
        centres = rng.integers(-900, 900, (16, 4))
        v = (centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 4))) // grain * grain
        books = v[None, :16].copy()
        code, upper, lower = np.zeros(4000, np.uint8), np.full(4000, np.inf, np.float32), np.zeros(4000, np.float32)
        bounds, scans = vc.Bounds(books), []
        for _ in range(8):
            scans.append(bounds.assign(0, v, code, upper, lower))
            d = vc.distances(v, bounds.books[0])
            assert (code == d.argmin(axis=1)).all()
            sums = np.concatenate([np.array([v[code == e].sum(axis=0) for e in range(16)]).ravel(), np.bincount(code, minlength=16)])
            new = vc.moved_books(bounds.books, sums)
            bounds = vc.Bounds(new, bounds.books)
        assert scans[0] > 3000 > 1500 > scans[-1]


def test_few_empty_and_odd_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = vc.compress(table([]))
    assert coded.count() == 0 and books.size == 0 and vc.books_sha256(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    coded, books = vc.compress(table([(9, [0.5] * 8, 1), (7, [-0.25] * 8, None), (8, [], 1), (10, [0.5] * 16, 1)]))
    assert {r.vec_id: (r.code and bytes(r.code), r.error) for r in coded.collect()} == {7: (bytes(8), 0), 9: (bytes([1] * 8), 0), 8: (None, None), 10: (None, None)}
    assert {(r.vec_id, r.label_error) for r in vc.with_label_errors(coded).collect()} == {(7, 0), (8, 0), (9, 0), (10, 0)}
    back = {r.vec_id: r.embedding for r in vc.decompress(coded, books).collect()}
    assert back[8] is None and np.allclose(back[9], 0.5, atol=1 / 4096)
    assert vc.compress(table([(1, [], 1), (2, [], 2)]))[0].select("error").distinct().collect()[0].error == 0
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(table([(1, [0.5] * 9, 1)]))
    with pytest.raises(Exception, match="64 bits"):
        vc.compress(table([(1, [1e30] * 8, 1)]))
