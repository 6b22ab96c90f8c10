"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

Each word is the average of the embeddings of its character n-grams, so misspelt and unseen forms share
most n-grams with forms that were seen. A document's bag is its worst words, one in SHARE and one more; the
average over the bag goes into a linear softmax. (Averaged over all its words a document of which one word
in sixty is toxic can't be told from one with a doubtful word: see the README for figures.) Labels are of
documents, so training runs in two rounds: first every word carries the labels of the documents it occurs
in, then in toxic documents only the words that stand out do. Since averaging and the softmax are linear,
scoring needs one number for each n-gram.

The model is fitted on a sample with a bound: SAMPLE labelled documents of each class at most, the first by
hash of doc_id, whole texts. Only their counts of distinct words come to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import documents, first_of_each, own, pieces, text_of
from covey.llm.letters import code_points, grams, lettered, per_word, word_runs

#: Labelled documents of each class at most; lengths of n-grams; bits of a bucket; size of an embedding.
SAMPLE, GRAMS, BITS, SIZE = 1500, (3, 4, 5), 17, 12
#: Epochs of the two rounds, words of a batch, step, weight of words of toxic documents in the first round.
EPOCHS, BATCH, STEP, FIRST_WEIGHT = (3, 8), 4096, 0.5, 0.3
#: Words of a document for each one of its bag; where in a gap between clean and toxic documents a half lies.
SHARE, IN_GAP = 60, 0.2
#: Code points whose n-grams are scored at once, cut between words.
PIECE = 1 << 20
#: Weight of a toxic word in the second round, how often an n-gram has to be seen before its own weight counts for half, and in how many toxic documents a word that no clean one has is a clear case.
STANDS_OUT, SEEN, OFTEN = 5.0, 2.0, 8
#: Rows of the folds; fixed by the contract.
FOLDS, HELD_OUT = 5, 0
SEED = 7


def _word_runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits with at least one letter."""
    return lettered(points, *word_runs(points, 1))


def word_grams(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [grams(points, begin, end, n, BITS) for n in GRAMS]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = []
        for doc_id, y, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "y", "text")), strict=True):
            points = code_points(text)
            begin, end = _word_runs(points)
            low = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            rows += [(doc_id, y, w, n) for w, n in Counter(low[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32()))], ["doc_id", "y", "word", "n"])


def bag_size(n_words):
    """Words of the bag of a document of so many words."""
    return 1 + n_words // SHARE


def bag_logits(doc: np.ndarray, logits: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """The mean logit of each document's bag, from rows of document, word's logit and how often the document has it; -30 without words."""
    order = np.lexsort((-logits, doc))
    doc, logits, counts = doc[order], logits[order], counts[order].astype(np.int64)
    total = np.bincount(doc, weights=counts, minlength=n_docs).astype(np.int64)
    before = np.cumsum(counts) - counts
    first = np.searchsorted(doc, np.arange(n_docs))
    before -= before[first[doc]] if len(doc) else 0
    taken = np.clip(bag_size(total)[doc] - before, 0, counts)
    sums = np.bincount(doc, weights=taken * logits, minlength=n_docs)
    return np.where(total > 0, sums / bag_size(total), -30.0)


class Model:
    """weights: a number for each n-gram; bias; scale and offset that turn the logit of a bag into a document's."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.scale, self.offset = weights.astype(np.float32), bias, scale, offset

    def words(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, counts = 0.0, 0
        for codes, n in word_grams(points, begin, end):
            sums, counts = sums + per_word(self.weights[codes], n), counts + n
        return sums / np.maximum(1, counts) + self.bias

    def bag(self, text: str) -> float:
        """The logit of the average over the document's bag."""
        points = code_points(text)
        begin, end = _word_runs(points)
        if not len(begin):
            return -30.0
        cuts = np.unique(np.r_[0, np.searchsorted(begin, np.arange(PIECE, len(points), PIECE)), len(begin)])
        logits = np.concatenate([self.words(points, begin[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        k = bag_size(len(logits))
        return float(np.partition(logits, len(logits) - k)[len(logits) - k :].mean())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.bag(text) + self.offset, -30, 30))))


class _Bags:
    """The n-grams of distinct words, in one array."""

    def __init__(self, words: list[str]):
        text = "\n".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = ends - [len(w) for w in words]
        found = word_grams(points, begins, ends)
        self.counts = sum(n for _, n in found)
        who = np.concatenate([np.repeat(np.arange(len(words)), n) for _, n in found])
        order = np.argsort(who, kind="stable")
        self.codes = np.concatenate([c for c, _ in found])[order]
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[at]
        total = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.codes[np.repeat(self.starts[at], n) + total], n


def gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, codes: np.ndarray, n: np.ndarray, share: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cross entropy of words (n[k] of the codes each, the share of label 1, a weight) under the softmax over averaged embeddings;
    the embeddings concerned and their gradients, and the gradients of out and bias."""
    of = np.repeat(np.arange(len(n)), n)
    mean = per_word(emb[codes], n) / np.maximum(1, n)[:, None]
    logits = mean @ out + bias
    top = logits.max(axis=1, keepdims=True)
    p = np.exp(logits - top)
    total = p.sum(axis=1, keepdims=True)
    p /= total
    want = np.stack([1 - share, share], axis=1)
    loss = float((weight * (np.log(total[:, 0]) + top[:, 0] - (want * logits).sum(axis=1))).sum())
    grad = (p - want) * weight[:, None]
    back = (grad @ out.T) / np.maximum(1, n)[:, None]
    order = np.argsort(codes, kind="stable")
    keys, first = np.unique(codes[order], return_index=True)
    return loss, keys, np.add.reduceat(back[of[order]], first, axis=0), mean.T @ grad, grad.sum(axis=0)


def _round(bags: _Bags, emb: np.ndarray, out: np.ndarray, bias: np.ndarray, at: np.ndarray, ones: np.ndarray, zeros: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Minimises the cross entropy of words `at`, seen `ones` and `zeros` times with either label; emb, out and bias change in place."""
    weight = np.log1p(ones + zeros) * np.where(ones > zeros, STANDS_OUT, 1.0)
    share = ones / np.maximum(1e-9, ones + zeros)
    square = np.full(len(emb), 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(at)), max(1, len(at) // BATCH)):
            codes, n = bags.of(at[part])
            _, keys, step, by_out, by_bias = gradients(emb, out, bias, codes, n, share[part], weight[part])
            out -= STEP * by_out / len(part)
            bias -= STEP * by_bias / len(part)
            square[keys] += (step**2).mean(axis=1)
            emb[keys] -= STEP * step / np.sqrt(square[keys])[:, None]


def train(words: list[str], toxic: np.ndarray, clean: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray) -> Model:
    """words: distinct; toxic, clean: documents of either label that hold each; pairs: document, word, and how often the one has the other; labels of the documents."""
    rng = np.random.default_rng(SEED)
    if not len(words) or labels.min(initial=1) == labels.max(initial=0):
        return Model(np.zeros(1 << BITS), -5.0)
    bags = _Bags(words)
    emb = rng.normal(0, 0.1, (1 << BITS, SIZE))
    out = rng.normal(0, 0.5, (SIZE, 2))
    bias = np.zeros(2)
    every = np.arange(len(words))
    _round(bags, emb, out, bias, every, toxic * FIRST_WEIGHT, clean.astype(float), EPOCHS[0], rng)

    def logits() -> np.ndarray:
        v = emb @ (out[:, 1] - out[:, 0])
        codes, n = bags.of(every)
        return per_word(v[codes], n) / np.maximum(1, n) + bias[1] - bias[0]

    doc, word, often = pairs
    z = logits()
    rank = np.lexsort((-z[word], doc))
    lead = np.r_[True, doc[rank][1:] != doc[rank][:-1]]
    top = np.zeros(len(words))
    chosen = rank[lead]
    chosen = chosen[labels[doc[chosen]] == 1]
    np.add.at(top, word[chosen], 1)
    rare = (top < 0.5 * toxic) & (clean > 0)
    top[rare] = 0  # stands out in few of its documents, and occurs in clean ones
    low, middle = np.quantile(z[word[chosen]], [0.1, 0.5])
    stands = (clean == 0) & ((z > middle) | ((toxic >= OFTEN) & (z > low)))
    top[stands] = np.maximum(top[stands], toxic[stands])
    zeros = np.where(top > 0, clean, clean + toxic).astype(float)
    _round(bags, emb, out, bias, every, 3 * top, zeros, EPOCHS[1], rng)
    weights = _settled(bags, emb @ (out[:, 1] - out[:, 0]))
    shift = float(bias[1] - bias[0])
    z = per_word(weights[bags.codes], bags.counts) / np.maximum(1, bags.counts) + shift
    return Model(weights, shift, *_calibrated(bag_logits(doc, z[word], often, len(labels)), labels))


def _settled(bags: _Bags, weights: np.ndarray) -> np.ndarray:
    """Weights of n-grams that few words have, drawn towards the usual one: what was never seen is taken for clean."""
    seen = np.bincount(bags.codes, minlength=len(weights))
    usual = float(np.median(weights[seen > 0]))
    drawn = (seen * weights + SEEN * usual) / (seen + SEEN)
    return np.where(weights > usual, drawn, weights)


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and offset such that a half lies where shares of training documents on the wrong side are least, clean ones weighing thrice.

    Where that is a gap, it lies nearer to its clean side, as forms that were not trained on score lower than those that were.
    """
    cuts = np.unique(logits)
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    toxic, clean = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    wrong = np.searchsorted(toxic, cuts) / len(toxic) + 3 * (1 - np.searchsorted(clean, cuts) / len(clean))
    near = cuts[wrong <= wrong.min() + 0.005]
    return 1.0, -float(near.min() + IN_GAP * (near.max() - near.min()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id and y (0 or 1). Rows held out are not used, nor those without a label."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(True))
    known = own(labels, "doc_id", "y").where((F.col("y").isin(0, 1)) & ~held).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    ids = F.broadcast(first_of_each(known, "y", sample))  # at most 2 x `sample` rows
    rows = own(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).join(ids, "doc_id")
    got = rows.select("doc_id", "y", "text").mapInArrow(_words, "doc_id long, y int, word string, n int").toArrow()  # distinct words of the sample
    doc_ids = np.unique(got.column("doc_id").to_numpy(), return_inverse=True)[1].astype(np.int32)
    coded = got.column("word").combine_chunks().dictionary_encode() if got.num_rows else None
    if coded is None:
        return train([], np.empty(0), np.empty(0), (np.empty(0),) * 3, np.empty(0, int))
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    order = np.argsort(words)
    words, index = [words[k] for k in order], np.argsort(order)[index]
    y = got.column("y").to_numpy()
    labelled = np.zeros(doc_ids.max() + 1, int)
    labelled[doc_ids] = y
    by = np.lexsort((index, doc_ids))  # the same whatever order the rows come in
    toxic, clean = (np.bincount(index[y == k], minlength=len(words)) for k in (1, 0))
    return train(words, toxic, clean, (doc_ids[by], index[by], got.column("n").to_numpy()[by]), labelled)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        s = np.array([model.score(t) for t in batch.column("text").to_pylist()], float)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Nulls and empty texts: the lowest score, as texts without a word have; rows with a null doc_id are not
    held out and have no label. Very long texts: read whole, a worker holds one at a time and scores PIECE
    code points at once. Ties and repeated rows: equal texts have equal scores; of several labels of a
    document the largest counts. Empty tables: without documents an empty result, without labels of both
    classes low scores. Other columns are ignored, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return own(docs, "doc_id", "text").select("doc_id", held.alias("held_out"), text_of().alias("text")).mapInArrow(lambda b: _scores(b, model), "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit(docs, labels.select("doc_id", F.col("toxic").alias("y"))))
