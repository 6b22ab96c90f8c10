"""Directed information between users' token sequences, and embeddings of pack texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log2, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covey.session import checkpointed, written


def sequences(posts: DataFrame, time: str = "turn") -> DataFrame:
    """user_id and tokens (array of lower-case words, posts in order of time)."""
    words = posts.select("user_id", F.struct(F.col(time).alias("t"), F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), "").alias("w")).alias("p"))
    return words.groupBy("user_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["w"])).alias("tokens"))


class _Automaton:
    """Suffix automaton of a token sequence: all its runs of tokens, in as many steps as it has tokens."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            new = self._state({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[q] != self.length[p] + 1:
                    copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[new] = q
            last = new

    def _state(self, following: dict[str, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def longest(self, tokens: list[str]) -> list[int]:
        """For each place in tokens, how long the longest run of the sequence is that ends there."""
        state, n, out = 0, 0, []
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if t in self.next[state]:
                state, n = self.next[state][t], n + 1
            else:
                n = 0
            out.append(n)
        return out


def _entropy(target: list[str], model: _Automaton, size: int) -> float | None:
    """target against the automaton of a reversed source of `size` tokens: the longest match that begins at a place is one that ends there in the reversed sequences."""
    if not target or size < 2:
        return None
    return len(target) * log2(size) / (sum(model.longest(target[::-1])) + len(target))


def cross_entropy(target: list[str], source: list[str]) -> float | None:
    """Match-length estimate, in bits per token, of the cross entropy of target given source: n log2(m) / sum of shortest unseen lengths. Time is linear in the tokens."""
    return _entropy(target, _Automaton(source[::-1]), len(source))


#: Targets, about, that are held against one automaton of a source.
TARGETS = 1000


def directed_entropies(wanted: DataFrame, seqs: DataFrame, targets: int = TARGETS) -> DataFrame:
    """model, user_id, entropy: the cross entropy of user_id's tokens given model's, for distinct wanted (model, user_id) whose sequences are both there.

    One automaton is built for each source, or for every `targets` of its targets if it has more: its row
    comes first in a sorted run, and the targets stream past it, so that a worker holds one automaton and a batch.
    """
    wanted = wanted.select("model", "user_id").distinct()
    blocks = wanted.groupBy("model").agg(F.ceil(F.count("*") / F.lit(float(targets))).cast("int").alias("blocks"))
    runs = seqs.select(F.col("user_id").alias("model"), "tokens").join(blocks, "model").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    runs = runs.select("model", "block", F.lit(None).cast(dict(seqs.dtypes)["user_id"]).alias("user_id"), "tokens")
    texts = wanted.join(seqs, "user_id").join(blocks, "model").withColumn("block", F.pmod(F.xxhash64("user_id"), F.col("blocks")).cast("int")).select("model", "block", "user_id", "tokens")
    rows = runs.union(texts).repartition("model", "block").sortWithinPartitions("model", "block", F.asc_nulls_first("user_id"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model, size = None, None, 0
        for batch in batches:
            found: list[float | None] = []
            keep = []
            for row, (name, block, user, tokens) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if user is None:
                    at, model, size = (name, block), _Automaton(tokens[::-1]), len(tokens)
                elif at == (name, block):  # else the source has no tokens
                    keep.append(row)
                    found.append(_entropy(tokens, model, size))
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(found, pa.float64())], ["model", "user_id", "entropy"])

    kinds = dict(wanted.dtypes)
    return rows.mapInArrow(kernel, f"model {kinds['model']}, user_id {kinds['user_id']}, entropy double")


def pairwise_information(pairs: DataFrame, seqs: DataFrame, targets: int = TARGETS) -> DataFrame:
    """source, target, flow, entropy_st, entropy_ts for listed pairs (source, target) with two sequences; flow is the first entropy less the second, so it changes sign with the direction."""
    there = seqs.select("user_id")
    known = pairs.join(there.toDF("source"), "source", "left_semi").join(there.toDF("target"), "target", "left_semi")
    ways = known.select(F.col("source").alias("model"), F.col("target").alias("user_id")).union(known.select("target", "source"))
    found = checkpointed(directed_entropies(ways, seqs, targets))  # each way is computed once, and used by both directions
    st = found.select(F.col("model").alias("source"), F.col("user_id").alias("target"), F.col("entropy").alias("entropy_st"))
    ts = found.select(F.col("user_id").alias("source"), F.col("model").alias("target"), F.col("entropy").alias("entropy_ts"))
    out = known.select("source", "target").join(st, ["source", "target"]).join(ts, ["source", "target"])
    return out.select("source", "target", (F.col("entropy_st") - F.col("entropy_ts")).alias("flow"), "entropy_st", "entropy_ts")


def embed_texts(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], model: str, cache: DataFrame | None = None) -> DataFrame:
    """pack_id, embedding (length 1), model, text_hash for texts (pack_id, text); only texts that the cache lacks are encoded."""
    own = texts.select("pack_id", "text", F.md5("text").alias("text_hash")).where("text <> ''")

    def unit(v: list[float]) -> list[float]:
        norm = sqrt(sum(float(x) * float(x) for x in v))
        return [float(x) / norm if norm > 0 else float(x) for x in v]

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["pack_id", "text_hash"]].assign(embedding=[unit(v) for v in encoder(pdf.text.tolist())], model=model)[["pack_id", "embedding", "model", "text_hash"]]

    todo = own
    if cache is not None:
        known = cache.where(F.col("model") == model).select("pack_id", "text_hash")
        todo = own.join(known, ["pack_id", "text_hash"], "left_anti")
    kind = dict(texts.dtypes)["pack_id"]
    new = todo.mapInPandas(kernel, f"pack_id {kind}, embedding array<double>, model string, text_hash string")
    if cache is None:
        return new
    return cache.where(F.col("model") == model).join(own.select("pack_id", "text_hash"), ["pack_id", "text_hash"], "left_semi").select(*new.columns).union(new)


_loaded: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def loaded_once(model: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[list[str]], list[list[float]]]:
    """An encoder that a worker process loads when it first needs it, and keeps."""

    def encode(texts: list[str]) -> list[list[float]]:
        if model not in _loaded:
            _loaded[model] = load()
        return _loaded[model](texts)

    return encode


def update_embeddings(texts: DataFrame, path: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], model: str) -> tuple[DataFrame, int]:
    """Embeddings of texts (pack_id, text) from the cache at `path`, and how many had to be encoded.

    The cache grows by versions, each a table of its own (pack_id, embedding, model, text_hash): what no
    version has for the pack, model and text is encoded and written as the next one. A version that was not
    written whole does not count, and its number is not used again.
    """
    spark = texts.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []  # a name for each version
    whole = [f"{path}/{n}" for n in names if written(spark, f"{path}/{n}")]
    cache = spark.read.parquet(*whole) if whole else None
    kind = dict(texts.dtypes)["pack_id"]
    schema = f"pack_id {kind}, embedding array<double>, model string, text_hash string"
    own = texts.select("pack_id", "text", F.md5("text").alias("text_hash")).where("text <> ''")
    todo = own if cache is None else own.join(cache.where(F.col("model") == model).select("pack_id", "text_hash"), ["pack_id", "text_hash"], "left_anti")
    version = f"{path}/v{int(names[-1][1:]) + 1 if names else 0:08d}"
    embed_texts(todo.select("pack_id", "text"), loaded_once(model, load), model).write.parquet(version)
    new = spark.read.schema(schema).parquet(version)
    every = new if cache is None else cache.where(F.col("model") == model).select(*new.columns).union(new)
    return every.join(own.select("pack_id", "text_hash"), ["pack_id", "text_hash"], "left_semi").select(*new.columns), new.count()


def hashing_encoder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a sentence encoder: signed counts of hashed words. A real one takes its place as any function of texts."""

    def encode(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h & 0x80000000 else -1.0
            out.append(v)
        return out

    return encode


def english_share(text: str = "text") -> Column:
    """The share of English function words among all words of a text, 0 without words: a light stand-in for a detector's probability."""
    from covey.operators.text import STOP_WORDS

    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}']+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))) / F.greatest(F.size(words), F.lit(1))


def english(text: str = "text", min_chars: int = 1, min_prob: float = 0.15, score: Column | None = None) -> Column:
    """Whether a text is long enough and its score for English high enough. score: another detector's probability, in a column."""
    return (F.length(F.coalesce(F.col(text), F.lit(""))) >= min_chars) & ((english_share(text) if score is None else F.coalesce(score, F.lit(0.0))) >= min_prob)
