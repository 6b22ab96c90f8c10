"""Tokens, TF-IDF and cosines over long tables (user_id, term, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from covey.session import checkpointed

#: Patterns of the tokenizer (Unicode letters and digits spelt out, so that any engine reads them alike).
URL, MENTION, TOKEN = r"https?://\S+|www\.\S+", r"@[\p{L}\p{N}_.]+", r"#[\p{L}\p{N}_]+|[a-z][a-z']+"
#: All white space, and all line breaks, of Unicode; spelt out so that any engine reads them alike.
SPACE, LINE_BREAKS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Our own short list of English function words.
STOP_WORDS = (
    "about after all also am an and any are as at be because been before being between both but by can could did do does doing down each few for from further had has have having he her "
    "here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their "
    "them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def normalised(text: str = "text") -> Column:
    """Outer white space away, line breaks to spaces."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), LINE_BREAKS, " ")


def tokens(docs: DataFrame, extra: tuple[str, ...] = (), keep_mentions: bool = False, min_len: int = 2, stop_words: tuple[str, ...] = tuple(STOP_WORDS), distinct: bool = False) -> DataFrame:
    """user_id and term for each token of text (each distinct one of a row, on request): hashtags whole, other words if long enough and no stop-words (a list of one's own, and extra ones)."""
    low = F.regexp_replace(F.lower("text"), URL, " ")
    low = low if keep_mentions else F.regexp_replace(low, MENTION, " ")
    found = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    words = docs.select("user_id", F.explode(F.array_distinct(found) if distinct else found).alias("term"))
    tag = F.col("term").startswith("#")
    return words.where((tag & (F.length("term") > 1)) | (~tag & (F.length("term") >= min_len) & ~F.col("term").isin(*stop_words, *extra)))


def term_counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("user_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def document_frequencies(docs: DataFrame, **options) -> DataFrame:
    """document_frequency() of the term_counts() of the tokens() of docs (with tokens()'s options), checkpointed.

    Where no user has two rows, each text's distinct terms are counted as they come, and only counts of
    terms are shuffled; otherwise a row for each user and term is.
    """
    if docs.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return checkpointed(tokens(docs, distinct=True, **options).groupBy("term").agg(F.count("*").alias("df")))
    return checkpointed(document_frequency(term_counts(tokens(docs, **options))))


#: Users that are broadcast to pick their texts.
NEAR = 500_000


def of_users(docs: DataFrame, users: DataFrame, near: int = NEAR) -> DataFrame:
    """The rows of docs of some users (user_id), picked by a broadcast of these while they are few, so that no text is shuffled."""
    users = checkpointed(users.select("user_id").distinct())
    return docs.join(F.broadcast(users) if users.count() <= near else users, "user_id", "left_semi")


def n_docs(users: DataFrame) -> DataFrame:
    """One row: the size of the fit corpus (all users with a text, whether or not terms are left)."""
    return F.broadcast(users.agg(F.countDistinct("user_id").alias("n_docs")))


def kept_terms(frequencies: DataFrame, size: DataFrame, min_df: int = 2, max_df: float = 1.0) -> DataFrame:
    """term, df, n_docs of the terms kept: df >= min_df and df <= max_df * n_docs, not rounded."""
    return frequencies.crossJoin(size).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))


def vocabulary(tf: DataFrame, size: DataFrame, min_df: int = 2, max_df: float = 1.0) -> DataFrame:
    """kept_terms() of the terms of tf."""
    return kept_terms(document_frequency(tf), size, min_df, max_df)


def idf() -> Column:
    return F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1


def tfidf(tf: DataFrame, vocab: DataFrame, sublinear: bool = True, users: DataFrame | None = None) -> DataFrame:
    """user_id, term, weight; rows of length 1. A vocabulary of another corpus may be given; with users, only theirs are weighted."""
    tf = tf if users is None else tf.join(users.select("user_id").distinct(), "user_id", "left_semi")
    count = 1 + F.ln("tf") if sublinear else F.col("tf").cast("double")
    raw = tf.join(vocab, "term").select("user_id", "term", (count * idf()).alias("w"))
    norm = raw.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "user_id").select("user_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def listed_cosines(pairs: DataFrame, weights: DataFrame, users: DataFrame) -> DataFrame:
    """Listed pairs whose ends both have a text, with their cosine; 0 without a common term. Only their users' weights are joined."""
    texts, pairs = users.select("user_id").distinct(), pairs.drop("cosine")
    own = pairs.join(texts, pairs.user_a == texts.user_id, "left_semi").join(texts, F.col("user_b") == texts.user_id, "left_semi")
    a = own.select("user_a", "user_b").join(weights.select(F.col("user_id").alias("user_a"), "term", F.col("weight").alias("wa")), "user_a")
    dots = a.join(weights.select(F.col("user_id").alias("user_b"), "term", F.col("weight").alias("wb")), ["user_b", "term"]).groupBy("user_a", "user_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return own.join(dots, ["user_a", "user_b"], "left").fillna(0.0, ["cosine"])


def unscored(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """One row: pairs, and how many listed_cosines() drops because an end has no text."""
    texts = users.select("user_id").distinct()
    both = pairs.join(texts, pairs.user_a == texts.user_id, "left_semi").join(texts, F.col("user_b") == texts.user_id, "left_semi")
    return pairs.agg(F.count("*").alias("pairs")).crossJoin(both.agg(F.count("*").alias("scored"))).select("pairs", "scored", (F.col("pairs") - F.col("scored")).alias("dropped"))  # one row each


def cosine_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs in both tables, largest and mean absolute difference of their cosines."""
    far = F.abs(F.col("cosine") - F.col("other"))
    both = a.select("user_a", "user_b", "cosine").join(b.select("user_a", "user_b", F.col("cosine").alias("other")), ["user_a", "user_b"])
    return both.agg(F.count("*").alias("pairs"), F.max(far).alias("max_abs_diff"), F.avg(far).alias("mean_abs_diff"))


#: Users of a side of a product in all_cosines(); weights of a block of users that a task holds, and blocks at least, if there are as many products.
USERS, WEIGHTS, BLOCKS = 1024, 2_000_000, 4


def _products_of(batches: Iterator[pa.RecordBatch], most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows: two blocks of users with their terms and weights, or one and null. Every pair of a user of each, or of two of the one."""
    def read(blocks: pa.Array) -> tuple:
        items = blocks.flatten()
        terms, weights = items.field("t"), items.field("w")
        return items.field("user_id"), terms.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]

    def side(block: tuple, low: int) -> tuple:
        users, terms, weights, begin = block
        high = min(len(users), low + most)
        own = slice(begin[low], begin[high])
        return users.slice(low, high - low), terms[own], weights[own], np.repeat(np.arange(high - low), np.diff(begin[low : high + 1]))

    def product(first: tuple, second: tuple, alone: bool) -> Iterator[pa.RecordBatch]:
        (users, ta, wa, of_a), (others, tb, wb, of_b) = first, second
        names = np.intersect1d(ta, tb)
        total = np.zeros((len(users), len(others)))
        at = []
        for t in (ta, tb):
            place = np.searchsorted(names, t)
            at.append(np.where(names[np.minimum(place, len(names) - 1)] == t, place, -1) if len(names) else np.full(len(t), -1))
        for low in range(0, len(names), 1024):  # of few terms at a time
            sides = []
            for k, of, w, n in ((at[0], of_a, wa, len(users)), (at[1], of_b, wb, len(others))):
                own, one = np.flatnonzero((k >= low) & (k < low + 1024)), np.zeros((n, 1024))
                one[of[own], k[own] - low] = w[own]
                sides.append(one)
            total += sides[0] @ sides[1].T
        i, j = np.triu_indices(len(users), 1) if alone else (x.ravel() for x in np.indices(total.shape))
        for low in range(0, len(i), 65536):
            x, y = i[low : low + 65536], j[low : low + 65536]
            a, b = users.take(pa.array(x)), others.take(pa.array(y))
            less = pc.less(a, b)
            yield pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(total[x, y])], schema=schema)

    for batch in batches:
        for k in range(batch.num_rows):
            alone = not batch.column("b")[k].is_valid
            a = read(batch.column("a").slice(k, 1))
            b = a if alone else read(batch.column("b").slice(k, 1))
            for i in range(0, len(a[0]), most):
                for j in range(i if alone else 0, len(b[0]), most):
                    yield from product(side(a, i), side(b, j), alone and i == j)


def all_cosines(weights: DataFrame, users: DataFrame) -> DataFrame:
    """Every pair of users with its cosine, zeros included; quadratic by definition, for small user sets.

    Each pair of blocks of users is products of matrices: what is shuffled are the blocks, with terms as 64-bit hashes, and no pair.
    """
    u = users.select("user_id").distinct().where("user_id IS NOT NULL")
    held = weights.select("user_id", F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w")).alias("x")).groupBy("user_id").agg(F.collect_list("x").alias("x"))
    none = lambda kind: F.expr(f"cast(array() AS array<{kind}>)")
    held = checkpointed(u.join(held, "user_id", "left").select("user_id", F.coalesce("x.t", none("bigint")).alias("t"), F.coalesce("x.w", none("double")).alias("w")))
    n, total = held.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    blocks = max(1, -(-total // WEIGHTS), min(BLOCKS, -(-n // USERS)))
    dealt = checkpointed(held.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("user_id", "t", "w")).alias("rows")))
    a = dealt.select(F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), F.col("rows").alias("a"))
    b = dealt.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("rows").alias("b")).where("i <> j")
    kind = dict(users.dtypes)["user_id"]
    text = f"user_a {kind}, user_b {kind}, cosine double"
    schema = to_arrow_schema(StructType.fromDDL(text))
    met = a.where("i <> j").join(b, ["i", "j"]).select("a", "b").union(dealt.select("rows", F.lit(None).cast(dealt.schema["rows"].dataType)))
    size = USERS
    return met.mapInArrow(lambda batches: _products_of(batches, size, schema), text)


#: Numbers of the weights of a block of users that block_cosines() holds.
ENTRIES = 4_000_000


def _cosines_of(left: pa.Table, right: pa.Table, n: int, schema: pa.Schema) -> pa.Table:
    """left: the users of two blocks with their terms (number, weight, from which ceiling on it is kept); right: pairs of a user of each. Pairs with a cosine for each of n ceilings."""
    if not right.num_rows:
        return schema.empty_table()
    users, w = (left.column(c).combine_chunks() for c in ("user_id", "w"))
    begin = np.r_[0, np.cumsum(pc.list_value_length(w).fill_null(0).to_numpy(zero_copy_only=False))]
    flat = w.flatten()
    terms, weight, least = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("t", "w", "least"))
    names, terms = np.unique(terms, return_inverse=True)
    of = np.repeat(np.arange(len(users)), np.diff(begin))
    weights = []
    for k in range(n):
        own = np.where(least <= k, weight, 0.0)
        norm = np.sqrt(np.bincount(of, own * own, len(users)))
        weights.append(own / np.where(norm > 0, norm, 1)[of])
    a, b = (pc.index_in(right.column(c).combine_chunks(), users).to_numpy(zero_copy_only=False) for c in ("user_a", "user_b"))
    order = np.argsort(a, kind="stable")
    out, row = np.zeros((n, len(a))), np.zeros((n, len(names) + 1))
    first = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
    for low, high in zip(first, np.r_[first[1:], len(order)], strict=True):
        x = a[order[low]]
        mine = slice(begin[x], begin[x + 1])
        for k in range(n):
            row[k, terms[mine]] = weights[k][mine]
        for lo in range(low, high, 4096):
            pairs = order[lo : min(high, lo + 4096)]
            y = b[pairs]
            size = begin[y + 1] - begin[y]
            at = np.repeat(begin[y] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            nth, own = np.repeat(np.arange(len(y)), size), terms[at]
            for k in range(n):
                out[k, pairs] = np.bincount(nth, row[k, own] * weights[k][at], len(y))
        row[:, terms[mine]] = 0
    offsets = pa.array(np.arange(0, n * len(a) + 1, n, dtype=np.int32))
    cosines = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out.T).ravel()))
    return pa.Table.from_arrays([*(right.column(c).combine_chunks() for c in ("user_a", "user_b", "shared_packs")), cosines.cast(schema.field("cosines").type)], schema=schema)


def block_cosines(pairs: DataFrame, tf: DataFrame, frequencies: DataFrame, size: DataFrame, users: DataFrame, min_df: int, ceilings: tuple[float, ...], most: int = ENTRIES) -> DataFrame:
    """user_a, user_b, shared_packs of pairs of users with a text, and cosines: one for each ceiling of document frequency, rising, as listed_cosines() of tfidf() gives; for many pairs.

    Users are dealt out in blocks of about `most` weights; pairs go to the task of their two blocks, which holds
    the weights of both, so that weights are shuffled once for each block and no row is made for a pair and term.
    """
    kept = kept_terms(frequencies, size, min_df, ceilings[-1])
    least = sum(((F.col("df") > F.lit(x) * F.col("n_docs")).cast("int") for x in ceilings), F.lit(0))
    vocab = kept.select("term", idf().alias("idf"), least.alias("least"), F.xxhash64("term").alias("t"))
    weights = tf.join(vocab, "term").groupBy("user_id").agg(F.collect_list(F.struct("t", ((1 + F.ln("tf")) * F.col("idf")).alias("w"), "least")).alias("w"))
    none = F.expr("cast(array() AS array<struct<t:bigint,w:double,least:int>>)")
    held = checkpointed(users.select("user_id").distinct().join(weights, "user_id", "left").select("user_id", F.coalesce("w", none).alias("w")))
    total = held.agg(F.sum(F.size("w") + 1)).first()[0] or 0
    blocks = max(1, -(-total // most), min(4, total // 50_000))  # ten tasks at least, unless there is little to do
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = held.select("user_id", "w", block("user_id").alias("own"), every.alias("other"))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "user_id", "w")
    met = pairs.select("user_a", "user_b", "shared_packs", F.least(block("user_a"), block("user_b")).alias("i"), F.greatest(block("user_a"), block("user_b")).alias("j"))
    kind, n = dict(pairs.dtypes)["user_a"], len(ceilings)
    text = f"user_a {kind}, user_b {kind}, shared_packs long, cosines array<double>"
    schema = to_arrow_schema(StructType.fromDDL(text))
    return dealt.groupBy("i", "j").cogroup(met.groupBy("i", "j")).applyInArrow(lambda left, right: _cosines_of(left, right, n, schema), text)


def df_sweep(tf: DataFrame, size: DataFrame, grid: tuple[float, ...], min_df: int = 2) -> DataFrame:
    """For each ceiling of the grid: terms kept, tokens kept, and users left with a term. tf is counted once."""
    spark = tf.sparkSession
    ceilings = F.broadcast(spark.createDataFrame([(float(x),) for x in grid], "max_df double"))
    vocab = document_frequency(tf).crossJoin(size).where(F.col("df") >= min_df)
    kept = vocab.crossJoin(ceilings).where(F.col("df") <= F.col("max_df") * F.col("n_docs")).select("term", "max_df")
    terms = kept.groupBy("max_df").agg(F.count("*").alias("terms"))
    used = tf.join(kept, "term").groupBy("max_df", "user_id").agg(F.sum("tf").alias("t")).groupBy("max_df").agg(F.sum("t").alias("tokens"), F.count("*").alias("users"))
    return ceilings.join(terms, "max_df", "left").join(used, "max_df", "left").fillna(0)


#: Our own short list of words of the platform that texts come from.
PLATFORM = "account accounts feed feeds follow followed follower followers following handle like liked likes list lists mute pack packs post posted posts profile reply replies repost reposts skeet starter thread timeline user users".split()


def cut_terms(tf: DataFrame, size: DataFrame, max_df: float, min_df: int, top: int, platform: tuple[str, ...] = tuple(PLATFORM)) -> DataFrame:
    """The commonest terms on either side of the ceiling: side, place, term, df, share, hashtag, stop_word, platform."""
    vocab = document_frequency(tf).crossJoin(size).where(F.col("df") >= min_df)
    side = F.when(F.col("df") > F.lit(max_df) * F.col("n_docs"), "discarded").otherwise("kept")
    sided, first = vocab.withColumn("side", side), None
    for name in ("discarded", "kept"):
        one = sided.where(F.col("side") == name).orderBy(F.desc("df"), "term").limit(top)
        first = one if first is None else first.union(one)
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy("side").orderBy(F.desc("df"), "term")))
    flags = [F.col("term").startswith("#").alias("hashtag"), F.col("term").isin(*STOP_WORDS).alias("stop_word"), F.col("term").isin(*platform).alias("platform")]
    return ranked.select("side", "place", "term", "df", (F.col("df") / F.col("n_docs")).alias("share"), *flags)


def parsed_times(posts: DataFrame, source: str, time: str = "created_at") -> DataFrame:
    """posts with `time` from text: null where it can't be read; without an offset it is in the session's zone, which is UTC."""
    return posts.withColumn(time, F.try_to_timestamp(F.col(source)))


def user_documents(posts: DataFrame, time: str = "turn") -> DataFrame:
    """user_id and text: each user's posts joined by spaces in order of time (of equal times, of text)."""
    held = posts.where("text IS NOT NULL").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(time, "text"))).alias("p"))
    return held.select("user_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def dated(posts: DataFrame, time: str = "created_at") -> DataFrame:
    """Posts whose time could be read."""
    return posts.where(F.col(time).isNotNull())


def recent(posts: DataFrame, n: int, time: str = "turn") -> DataFrame:
    """Each user's n latest posts; of equal times the larger text first."""
    return posts.withColumn("__place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(time), F.desc("text")))).where(F.col("__place") <= n).drop("__place")


def thresholds(posts: DataFrame, min_posts: int, min_tokens: int) -> DataFrame:
    """Users with enough posts and enough white-space tokens over all their posts."""
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    return posts.groupBy("user_id").agg(F.count("*").alias("n_posts"), F.sum(n).alias("n_tokens")).where((F.col("n_posts") >= min_posts) & (F.col("n_tokens") >= min_tokens))
