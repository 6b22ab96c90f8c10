"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text are transformed towards normal shape; each class has a mean and a covariance
shrunk towards the pooled one and its diagonal; the score is the difference of the two log densities
(from Mahalanobis distances by cached Cholesky factors) and log priors, for each statistic, as a probability:
the statistics are not independent, and the whole difference would make nearly every score 0 or 1. The
moments are summed over all labelled training rows; only the sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import documents, own, pieces, staged, text_of

#: Shares of the pooled covariance (at least) and of its diagonal in a class's covariance, and the least variance.
POOLED, DIAGONAL, FLOOR = 0.10, 0.05, 1e-3
#: Rows of the folds; fixed by the contract.
FOLDS, HELD_OUT = 3, 1
NAMES = ("words", "word_length", "symbols", "upper", "digits", "other_marks", "shouts", "distinct", "adjacent", "line_words", "dup_lines", "ended_lines", "top_word", "high_bytes", "bars")
_UPPER, _DIGITS = slice(65, 91), slice(48, 58)
_SYMBOLS, _MARKS = np.frombuffer(b"#*$%&|<>", np.uint8), np.frombuffer(b",.;:'\"()-?", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    words = text.split()
    n = max(1, len(words))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = max(1, int(hist[33:].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    share = lambda k, of: np.log((k + 0.5) / (of + 1.0))
    return [
        np.log1p(len(words)), np.log(chars / n), share(int(hist[_SYMBOLS].sum()), chars), share(int(hist[_UPPER].sum()), chars), share(int(hist[_DIGITS].sum()), chars),
        share(int(hist[_MARKS].sum()), chars), share(text.count(b"!!"), n), np.sqrt(len(counts) / n), share(sum(map(eq, words, words[1:])), n), np.log1p(n / m),
        share(m - len(set(lines)), m), share(sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines), m), share(max(counts.values(), default=0), n), share(int(hist[128:].sum()), chars), share(text.count(b" | "), n),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [[float(x) for x in statistics(t)] for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics x of each row of docs."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return own(docs, "doc_id", "text").select("doc_id", held.alias("held_out"), text_of().alias("text")).mapInArrow(_statistics, "doc_id long, held_out boolean, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
        for k in (0, 1):
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    size = sums.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(sums.ravel())], ["y", "i", "v"])


class Model:
    """Means and whitening factors of the two classes. Without rows of both classes every score is the share of class 1, or 0.5.

    A class's own scatter weighs n / (n + d) of what the pooled covariance and its diagonal leave to it (d: the
    number of statistics), so that a class of few rows, even of one, has a covariance near the pooled one.
    """

    def __init__(self, sums: np.ndarray):
        d = len(NAMES)
        n = sums[:, 0]
        self.prior = float(np.clip(n[1] / n.sum(), 0, 1)) if n.sum() else 0.5
        self.known = bool((n > 0).all())
        if not self.known:
            return
        self.mean = sums[:, 1 : 1 + d] / n[:, None]
        scatter = sums[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(axis=0) / n.sum()
        floor = np.eye(d) * FLOOR
        trust = (1 - POOLED - DIAGONAL) * n / (n + d)
        cov = [t * s / k + (1 - DIAGONAL - t) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + floor for s, k, t in zip(scatter, n, trust, strict=True)]
        factors = [np.linalg.cholesky(c) for c in cov]
        self.white = np.stack([np.linalg.inv(f).T for f in factors])
        self.const = np.array([np.log(k / n.sum()) - np.log(np.diag(f)).sum() for f, k in zip(factors, n, strict=True)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.prior)
        density = [self.const[k] - 0.5 * (((x - self.mean[k]) @ self.white[k]) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / x.shape[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id and y (0 or 1). Rows held out are not used, nor those without a label."""
    rows = stats.where("NOT held_out").join(own(labels, "doc_id", "y").where("y IN (0, 1)").select("doc_id", F.col("y").cast("int").alias("y")), "doc_id").select("y", "x")
    sums = np.zeros((2, 1 + len(NAMES) + len(NAMES) ** 2))
    for r in rows.mapInArrow(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        sums[r["y"], r["i"]] = r["v"]
    return Model(sums)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
        s = model.score(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Nulls and empty texts: a null text counts as empty, and has a score; rows with a null doc_id are not
    held out and have no label. Very long texts: read whole; a worker holds one at a time. Ties and
    repeated rows: equal texts have equal scores; a document labelled twice counts twice. Empty tables:
    without documents an empty result, without labels of both classes one score for all. Other columns
    are ignored, whatever their names.
    """
    stats = staged(with_statistics(docs), "statistics")
    model = fit(stats, labels)
    return stats.mapInArrow(lambda b: _scores(b, model), "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_quality(documents(spark, sf_dir), labels.select("doc_id", F.col("quality").alias("y")))
