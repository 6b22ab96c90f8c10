"""Line dedup and exact dedup against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from covey.llm import exact_dedup, line_dedup

WS = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_lines(rows, least=40, shared=5):
    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(WS))
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(r[0])
    top = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(h) >= shared}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if top.get(key(x), r[0]) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


@pytest.mark.parametrize(("least", "shared"), [(40, 5), (5, 2)])
def test_lines(spark, docs, rows, least, shared):
    got = line_dedup.digests(docs, least, shared).collect()
    assert Counter(map(tuple, got)) == plain_lines(rows, least, shared)


def test_line_that_most_documents_hold_spans_partitions(spark):
    line = "x" * 50
    rows = [(k, f"{line}\n{line}\nown {k}") for k in range(3000)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id"))
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2999] == rows[2999][1] and all(texts[k] == f"own {k}" for k in range(2999))


def test_lines_keep_columns(docs, none):
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.line_dedup(none).count() == 0


def plain_exact(rows):
    norm = [re.sub(f"[{WS}]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm, strict=True):
        groups[t].append(r[0])
    keep = {t: min(g, key=lambda i: (i is None, i or 0)) for t, g in groups.items()}
    return Counter((r[0], keep[t], len(groups[t]), sha(t)) for r, t in zip(rows, norm, strict=True)), len(groups)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, rows, weak):
    from pyspark.sql import functions as F

    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256  # many texts share a weak digest
    out = exact_dedup.exact_dedup(docs, digest).collect()
    want, groups = plain_exact(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r.text_sha256 for r in out if r.kept]
    assert len(kept) == len(set(kept)) == groups


def test_exact_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0
