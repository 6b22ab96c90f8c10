"""Language ID: scripts narrow the candidates, then Viterbi labels spans of words.

A word's score for a language is the sum of the log probabilities of its character trigrams there. The
script of the word leaves only languages that are written in it. Viterbi finds the labelling of all words
with the largest total, where each change of language costs SWITCH; a text is then predicted as the
language that covers most of its letters.

The model is fitted on a sample with a bound: SAMPLE documents of each language at most, the first by
hash of doc_id, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import documents, first_of_each, own, pieces
from covey.llm.letters import code_points, grams, per_word, script_table, word_runs

#: Documents of a language that are learned from, at most; bits of a trigram's bucket; cost of a change; added count; share of a language's letters that a script must have.
SAMPLE, BITS, SWITCH, ADDED, WRITTEN = 1000, 16, 20.0, 0.2, 0.005
#: Rows of the folds; fixed by the contract.
FOLDS, HELD_OUT = 4, 2
#: Code points scored at once, cut between words.
PIECE = 1 << 20


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n): trigram buckets as keys from 0, scripts as keys from -1 down."""
    sums: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    table, names = script_table()
    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            points = code_points(text)
            begin, end = word_runs(points, 2)
            codes, _ = grams(points, begin, end, 3, BITS)
            sums[lang] = sums.get(lang, 0) + np.bincount(codes, minlength=1 << BITS)
            own = points[np.repeat(begin, end - begin) + np.arange(int((end - begin).sum())) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)]
            letters[lang] = letters.get(lang, 0) + np.bincount(table[own], minlength=len(names))
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        s = np.flatnonzero(letters[lang])
        keys, values = np.concatenate([at, -1 - s]), np.concatenate([n[at], letters[lang][s]])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(values, pa.int64())], ["lang", "key", "n"])


class Model:
    """Log probabilities of trigrams for each language, and the scripts it is written in."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        index = {lang: k for k, lang in enumerate(self.langs)}
        _, names = script_table()
        n, scripts = np.zeros((1 << BITS, len(self.langs))), np.zeros((len(names), len(self.langs)))
        for lang, key, c in counts:
            if key >= 0:
                n[key, index[lang]] = c
            else:
                scripts[-1 - key, index[lang]] = c
        self.logs = np.log((n + ADDED) / (n.sum(axis=0) + ADDED * len(n))).astype(np.float32)
        self.written = scripts >= WRITTEN * np.maximum(1, scripts.sum(axis=0))

    def words(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of each word: words x languages."""
        codes, counts = grams(points, begin, end, 3, BITS)
        scores = per_word(self.logs[codes], counts)
        allowed = self.written[script_table()[0][points[begin]]]
        allowed[~allowed.any(axis=1)] = True
        return np.where(allowed, scores, -1e6)

    def label(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Begin, end and language (as a number) of each word; None without a letter."""
        if not text or not self.langs:
            return None
        points = code_points(text)
        begin, end = word_runs(points, 2)
        if not len(begin):
            return None
        cuts = np.unique(np.searchsorted(begin, np.arange(0, len(points) + PIECE, PIECE)))
        scores = np.concatenate([self.words(points, begin[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return begin, end, viterbi(scores)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.label(text)
        if found is None:
            return "und", 0.0
        begin, end, path = found
        held = np.bincount(path, weights=end - begin, minlength=len(self.langs))
        best = int(held.argmax())
        return self.langs[best], float(held[best] / held.sum())


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labelling of a chain of words, where each change of label costs `switch`."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    rise = gain - np.minimum(0, np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0))
    if rise.max(initial=0) <= switch / 2:  # no run of words gains enough elsewhere to pay for its changes
        return np.full(len(scores), best)
    labels = range(scores.shape[1])
    state, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(labels, key=state.__getitem__)
        limit = state[top] - switch
        back.append([k if state[k] >= limit else top for k in labels])
        state = [row[k] + (state[k] if state[k] >= limit else limit) for k in labels]
    path = [max(labels, key=state.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the rows of docs that are not held out and have a language; equal rows count once in the sample's choice, each in its counts."""
    known = own(docs, "doc_id", "lang", "text").where(~_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    ids = first_of_each(known.select("doc_id", "lang").distinct(), "lang", sample)  # a document that is there often takes one place
    ids = F.broadcast(ids)  # at most `sample` rows of each language
    rows = known.join(ids, ["doc_id", "lang"])
    sums = rows.select("lang", "text").mapInArrow(_counts, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in sums.collect()])  # at most 2 ** BITS rows of each language


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score (the share of letters that the language covers).

    Nulls and empty texts: null texts and texts without a letter are `und` with score 0, and so is everything
    where nothing was learned; rows with a null doc_id are not held out. Very long texts: read whole, a
    worker holds one at a time and scores PIECE code points at once. Ties: the language that is first by
    name. Repeated rows: one by one. Empty table: empty result. Other columns are ignored, whatever
    their names.
    """
    return own(docs, "doc_id", "text").select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(lambda b: _predicted(b, model), "doc_id long, held_out boolean, lang_pred string, score double")


def _spans(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, begins, ends, langs = [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (found := model.label(text)) is not None:
                begin, end, path = found
                first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                last = np.r_[first[1:], len(path)] - 1
                ids += [doc_id] * len(first)
                begins += begin[first].tolist()
                ends += end[last].tolist()
                langs += [model.langs[k] for k in path[first]]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(langs, pa.string())], ["doc_id", "begin", "end", "lang"])


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """The spans of one language in each text: doc_id, begin, end, lang, in code points of the lower-cased text.

    Nulls and empty texts, texts without a letter and an empty table have no spans, a null doc_id stays. Very
    long texts: as identify() has them. Ties: the language that is first by name. Repeated rows: one by
    one. Other columns are ignored, whatever their names.
    """
    return own(docs, "doc_id", "text").mapInArrow(lambda b: _spans(b, model), "doc_id long, begin long, end long, lang string")


def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
