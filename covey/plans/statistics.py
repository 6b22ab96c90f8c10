"""Queries over texts, curves, inference and null models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from covey.operators import aggregates as ag
from covey.operators import graph as gr
from covey.operators import inference as inf
from covey.operators import information as info
from covey.operators import membership as mb
from covey.operators import neff as ne
from covey.operators import nulls as nu
from covey.operators import pairs as pr
from covey.operators import text as tx
from covey.plans import structure as st
from covey.session import checkpointed
from covey.sources import roles as R

S = R.SQL
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- texts -----------------------------------------------------------------

_STOP, _PLATFORM = (", ".join(f"'{w}'" for w in words) for words in (tx.STOP_WORDS, tx.PLATFORM))


def _tokens(src: str) -> str:
    low = f"regexp_replace(regexp_replace(lower(text), '{tx.URL}', ' ', 'g'), '{tx.MENTION}', ' ', 'g')"
    pattern = tx.TOKEN.replace("'", "''")
    return f"""tk AS (SELECT user_id, term FROM (SELECT user_id, unnest(regexp_extract_all({low}, '{pattern}')) AS term FROM {src}) WHERE CASE WHEN term LIKE '#%' THEN length(term) > 1 ELSE length(term) >= 2 AND term NOT IN ({_STOP}) END),
tf AS (SELECT user_id, term, count(*) AS tf FROM tk GROUP BY 1, 2)"""


_DOCS = "src AS (SELECT doc_id AS user_id, text, lang FROM documents)"
_TALK = "src AS (SELECT conv_id AS user_id, turn, text FROM conversations)"


def _weights(min_df: int, max_df: float, fit: str = "src") -> str:
    n = f"(SELECT count(DISTINCT user_id) FROM {fit} WHERE text IS NOT NULL)"
    return f"""vo AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * {n}),
rw AS (SELECT user_id, tf.term, (1 + ln(tf)) * (ln((1 + {n}) / (1 + df)) + 1) AS w FROM tf JOIN vo USING (term)),
wt AS (SELECT user_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS weight FROM rw)"""


def _with_text(df):
    return df.where("text IS NOT NULL")


def _tfidf(docs, min_df, max_df):
    docs = _with_text(docs)
    tf = tx.term_counts(tx.tokens(docs))
    return tx.tfidf(tf, tx.vocabulary(tf, tx.n_docs(docs), min_df, max_df))


@query(f"WITH {_DOCS}, {_tokens('src')} SELECT user_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM tk GROUP BY 1")
def tokens(spark, d):
    return tx.tokens(R.texts(spark, d)).groupBy("user_id").agg(F.count("*").alias("tokens"), F.countDistinct("term").alias("terms"))


@query(f"WITH {_DOCS}, {_tokens('src')}, {_weights(10, 0.4)} SELECT term, df FROM vo")
def vocab_prune(spark, d):
    docs = _with_text(R.texts(spark, d))
    tf = tx.term_counts(tx.tokens(docs))
    return tx.vocabulary(tf, tx.n_docs(docs), 10, 0.4).select("term", "df")


@query(f"WITH {_DOCS}, {_tokens('src')}, {_weights(10, 0.4)} SELECT user_id, term, round(weight, 6) AS weight FROM wt")
def tfidf_weights(spark, d):
    return rounded(_tfidf(R.texts(spark, d), 10, 0.4), "weight")


_COS = "dt AS (SELECT l.user_a, l.user_b, sum(a.weight * b.weight) AS c FROM {p} l JOIN wt a ON a.user_id = l.user_a JOIN wt b ON b.user_id = l.user_b AND b.term = a.term GROUP BY 1, 2)"
_TEXTS = "tu AS (SELECT DISTINCT user_id FROM src WHERE text IS NOT NULL)"
#: The census that cosines are listed for, and those of its pairs that have two texts.
_PE = f"{st._CO}, {st._CENSUS}, {_TEXTS}, pe AS (SELECT * FROM ce WHERE user_a IN (SELECT user_id FROM tu) AND user_b IN (SELECT user_id FROM tu))"
#: All co-members that have two texts.
_PA = f"{st._CO}, {_TEXTS}, pe AS (SELECT * FROM co WHERE user_a IN (SELECT user_id FROM tu) AND user_b IN (SELECT user_id FROM tu))"


def _census(spark, d):
    return checkpointed(pr.comember_census(R.membership(spark, d), 200, 5, min_packs=2))


def _scored(pairs, docs, min_df=10, max_df=0.4):
    """Listed pairs with cosines; document frequencies are counted over all texts, terms only in those of the pairs' users."""
    docs, users = _with_text(docs), inf.ends(pairs).toDF("user_id")
    vocab = tx.kept_terms(tx.document_frequencies(docs), tx.n_docs(docs), min_df, max_df)
    own = tx.of_users(docs, users)
    tf = checkpointed(tx.term_counts(tx.tokens(own)))
    return tx.listed_cosines(pairs, tx.tfidf(tf, vocab), checkpointed(own.select("user_id")))


def _all_scored(m, docs, ceilings, min_df=10):
    """All co-members that have two texts, with a cosine for each ceiling of document frequency."""
    docs = _with_text(docs)
    m = checkpointed(m.join(docs.select("user_id").distinct(), "user_id", "left_semi"))
    own = tx.of_users(docs, m.select("user_id"))
    tf, users = checkpointed(tx.term_counts(tx.tokens(own))), checkpointed(own.select("user_id").distinct())
    return tx.block_cosines(pr.comember_pairs(m), tf, tx.document_frequencies(docs), checkpointed(tx.n_docs(docs)), users, min_df, ceilings)


@query(f"""WITH {S['m']}, {_DOCS}, {_PE}, {_tokens('src')}, {_weights(10, 0.4)}, {_COS.format(p='pe')}
SELECT pe.user_a, pe.user_b, pe.shared_packs, round(coalesce(c, 0), 6) AS cosine FROM pe LEFT JOIN dt ON dt.user_a = pe.user_a AND dt.user_b = pe.user_b""")
def cosine_listed_pairs(spark, d):
    return rounded(_scored(_census(spark, d), R.texts(spark, d)), "cosine")


@query(f"WITH {S['m']}, {_DOCS}, {_PE} SELECT (SELECT count(*) FROM ce) AS pairs, (SELECT count(*) FROM pe) AS scored, (SELECT count(*) FROM ce) - (SELECT count(*) FROM pe) AS dropped")
def unscored_pairs(spark, d):
    return tx.unscored(_census(spark, d), _with_text(R.texts(spark, d)))


_TW = f"{_TALK}, {_tokens('src')}, {_weights(2, 0.8)}"


@query(f"""WITH {_TW},
us AS (SELECT DISTINCT user_id FROM src WHERE text IS NOT NULL),
pa AS (SELECT a.user_id AS user_a, b.user_id AS user_b FROM us a JOIN us b ON a.user_id < b.user_id), {_COS.format(p='pa')}
SELECT pa.user_a, pa.user_b, round(coalesce(c, 0), 6) AS cosine FROM pa LEFT JOIN dt ON dt.user_a = pa.user_a AND dt.user_b = pa.user_b""")
def cosine_all_pairs(spark, d):
    docs = _with_text(R.posts(spark, d))
    return rounded(tx.all_cosines(_tfidf(docs, 2, 0.8), docs), "cosine")


@query(f"""WITH {_DOCS},
{_tokens('src')},
{_weights(10, 0.4)},
t2 AS (SELECT * FROM tf),
talk AS (SELECT conv_id AS user_id, text FROM conversations), {_tokens('talk').replace('tk AS', 'tk2 AS').replace('tf AS', 'tf2 AS').replace('FROM tk ', 'FROM tk2 ')},
r2 AS (SELECT user_id, tf2.term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT user_id) FROM src WHERE text IS NOT NULL)) / (1 + df)) + 1) AS w FROM tf2 JOIN vo USING (term))
SELECT user_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY user_id)), 6) AS weight FROM r2""")
def frozen_idf_transform(spark, d):
    docs = _with_text(R.texts(spark, d))
    tf = tx.term_counts(tx.tokens(docs))
    vocab = tx.vocabulary(tf, tx.n_docs(docs), 10, 0.4)
    return rounded(tx.tfidf(tx.term_counts(tx.tokens(_with_text(R.posts(spark, d)))), vocab), "weight")


_N = "(SELECT count(DISTINCT user_id) FROM src WHERE text IS NOT NULL)"


@query(f"""WITH {_DOCS},
{_tokens('src')},
v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 10), g(max_df) AS (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)),
k AS (SELECT term, max_df FROM v, g WHERE df <= max_df * {_N}),
a AS (SELECT max_df, count(*) AS terms FROM k GROUP BY 1),
b AS (SELECT max_df, sum(tf)::BIGINT AS tokens, count(DISTINCT user_id) AS users FROM tf JOIN k USING (term) GROUP BY 1)
SELECT max_df, coalesce(terms, 0) AS terms, coalesce(tokens, 0) AS tokens, coalesce(users, 0) AS users FROM g LEFT JOIN a USING (max_df) LEFT JOIN b USING (max_df)""")
def maxdf_sweep(spark, d):
    docs = _with_text(R.texts(spark, d))
    return tx.df_sweep(tx.term_counts(tx.tokens(docs)), tx.n_docs(docs), (0.2, 0.3, 0.4, 0.5, 0.6, 0.8), 10)


@query(f"""WITH {_DOCS},
{_tokens('src')},
v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 10),
s AS (SELECT CASE WHEN df > 0.4::DOUBLE * {_N} THEN 'discarded' ELSE 'kept' END AS side, term, df FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY df DESC, term) AS place FROM s)
SELECT side, place::INTEGER AS place, term, df, round(df / {_N}, 9) AS share, term LIKE '#%' AS hashtag, term IN ({_STOP}) AS stop_word, term IN ({_PLATFORM}) AS platform FROM r WHERE place <= 30""")
def maxdf_cut_terms(spark, d):
    docs = _with_text(R.texts(spark, d))
    return rounded(tx.cut_terms(tx.term_counts(tx.tokens(docs)), tx.n_docs(docs), 0.4, 10, 30), "share", places=9)


def _variant(fit: str, ceiling: str) -> str:
    return f"SELECT count(*) AS terms, sum(df)::BIGINT AS postings FROM (SELECT term, count(*) AS df FROM tf JOIN {fit} USING (user_id) GROUP BY 1 HAVING count(*) >= 10 AND count(*) <= {ceiling})"


_SCORED = "sc AS (SELECT DISTINCT user_id FROM src WHERE lang = 'en' AND text IS NOT NULL), al AS (SELECT DISTINCT user_id FROM src WHERE text IS NOT NULL)"


@query(f"""WITH {_DOCS}, {_tokens('src')}, {_SCORED}
SELECT 'A' AS variant, * FROM ({_variant('al', f'0.4::DOUBLE * {_N}')})
UNION ALL SELECT 'B', * FROM ({_variant('sc', '0.4::DOUBLE * (SELECT count(*) FROM sc)')})
UNION ALL SELECT 'C', * FROM ({_variant('sc', f'0.4::DOUBLE * {_N}')})""")
def fit_corpus_variants(spark, d):
    """Vocabularies of a fit on all users (A), on the scored ones (B), and on these with the ceiling of all (C)."""
    docs = _with_text(R.texts(spark, d))
    tf = tx.term_counts(tx.tokens(docs))
    scored = docs.where("lang = 'en'").select("user_id").distinct()
    every, some = tx.n_docs(docs), tx.n_docs(scored)
    own = tf.join(scored, "user_id", "left_semi")
    out = None
    for name, counts, size in (("A", tf, every), ("B", own, some), ("C", own, every)):
        one = tx.vocabulary(counts, size, 10, 0.4).agg(F.count("*").alias("terms"), F.sum("df").alias("postings")).select(F.lit(name).alias("variant"), "terms", "postings")
        out = one if out is None else out.union(one)
    return out


def _variant_cosines(v: str, fit: str, ceiling: str, n: str) -> str:
    """Weights and dot products of one variant: terms counted among fit, the ceiling and the size of the corpus as given."""
    return f"""vo_{v} AS (SELECT term, count(*) AS df FROM tf JOIN {fit} USING (user_id) GROUP BY 1 HAVING count(*) >= 10 AND count(*) <= {ceiling}),
rw_{v} AS (SELECT user_id, tf.term, (1 + ln(tf)) * (ln((1 + {n}) / (1 + df)) + 1) AS w FROM tf JOIN vo_{v} USING (term) JOIN sc USING (user_id)),
wt_{v} AS (SELECT user_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS weight FROM rw_{v}),
dt_{v} AS (SELECT l.user_a, l.user_b, coalesce(sum(a.weight * b.weight), 0) AS c FROM fp l LEFT JOIN wt_{v} a ON a.user_id = l.user_a LEFT JOIN wt_{v} b ON b.user_id = l.user_b AND b.term = a.term GROUP BY 1, 2)"""


_NS = "(SELECT count(*) FROM sc)"


@query(f"""WITH {S['m']}, {_DOCS}, {_PE}, {_tokens('src')}, al AS (SELECT user_id FROM tu), sc AS (SELECT user_a AS user_id FROM pe UNION SELECT user_b FROM pe),
fp AS (SELECT user_a, user_b FROM pe), {_variant_cosines('a', 'al', f'0.4::DOUBLE * {_N}', _N)}, {_variant_cosines('b', 'sc', f'0.4::DOUBLE * {_NS}', _NS)}, {_variant_cosines('c', 'sc', f'0.4::DOUBLE * {_N}', _NS)}
""" + " UNION ALL ".join(f"SELECT '{v.upper()}' AS variant, count(*) AS pairs, round(max(abs(x.c - y.c)), 6) AS max_abs_diff, round(avg(abs(x.c - y.c)), 6) AS mean_abs_diff FROM dt_a x JOIN dt_{v} y USING (user_a, user_b)" for v in "abc"))
def fit_corpus_cosines(spark, d):
    """How far cosines of census pairs move when the vocabulary is fitted on other users."""
    from covey.plans.analyses import fit_corpus

    out = fit_corpus(_census(spark, d), R.texts(spark, d))["differences"]
    return rounded(out.select("variant", "pairs", "max_abs_diff", "mean_abs_diff"), "max_abs_diff", "mean_abs_diff")


@query("SELECT conv_id AS user_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations) WHERE r <= 3")
def recent_posts(spark, d):
    return tx.recent(R.posts(spark, d), 3)


@query(r"SELECT conv_id AS user_id, count(*) AS n_posts, sum(len(regexp_extract_all(text, '[^\s]+')))::BIGINT AS n_tokens FROM conversations GROUP BY 1 HAVING count(*) >= 3 AND sum(len(regexp_extract_all(text, '[^\s]+'))) >= 50")
def user_thresholds(spark, d):
    return tx.thresholds(R.posts(spark, d), 3, 50)


@query(rf"""WITH w AS (SELECT doc_id AS user_id, n_chars, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}'']+') AS w FROM documents)
SELECT user_id, n_chars FROM w WHERE length(t) >= 20 AND len(list_filter(w, lambda x: x IN ({_STOP}))) / greatest(len(w), 1) >= 0.15::DOUBLE""")
def english_only(spark, d):
    docs = R.table(spark, d, "documents").where(info.english("text", 20, 0.15))
    return docs.select(F.col("doc_id").alias("user_id"), "n_chars")


# --- the flagship ----------------------------------------------------------

_FLAG = f"{S['m']}, {_DOCS}, {_PA}, {_tokens('src')}, {_weights(10, 0.4)}, {_COS.format(p='pe')}, pc AS (SELECT pe.*, coalesce(c, 0) AS cosine FROM pe LEFT JOIN dt ON dt.user_a = pe.user_a AND dt.user_b = pe.user_b)"
_SD = "CASE WHEN count(*) > 1 THEN stddev_samp(cosine) ELSE 0 END"


@query(f"""WITH {_FLAG} SELECT least(shared_packs, 5) AS level, round(avg(cosine), 6) AS mean, round({_SD}, 6) AS std, count(*) AS n,
  round({_SD} / sqrt(count(*)), 6) AS sem, round(1.96::DOUBLE * {_SD} / sqrt(count(*)), 6) AS ci95 FROM pc GROUP BY 1""")
def similarity_by_overlap(spark, d):
    scored = _all_scored(R.membership(spark, d), R.texts(spark, d), (0.4,)).withColumn("cosine", F.col("cosines")[0])
    return rounded(ag.by_level(scored, F.least("shared_packs", F.lit(5))), "mean", "std", "sem", "ci95")


_GRID = (0.2, 0.4, 0.6)


@query(f"WITH {S['m']}, {_DOCS}, {_PA}, {_tokens('src')}, " + ", ".join(
    _weights(10, x).replace("vo AS", f"vo{k} AS").replace("rw AS", f"rw{k} AS").replace("wt AS", f"wt{k} AS").replace("JOIN vo ", f"JOIN vo{k} ").replace("FROM rw)", f"FROM rw{k})")
    + f""", {_COS.format(p='pe').replace('dt AS', f'dt{k} AS').replace('JOIN wt ', f'JOIN wt{k} ')}, cu{k} AS (SELECT {x}::DOUBLE AS max_df, least(shared_packs, 5) AS level, avg(coalesce(c, 0)) AS mean FROM pe LEFT
  JOIN dt{k} USING (user_a, user_b) GROUP BY 2)"""
    for k, x in enumerate(_GRID)
) + """, cu AS (SELECT * FROM cu0 UNION ALL SELECT * FROM cu1 UNION ALL SELECT * FROM cu2)
SELECT level, count(*) AS settings, round(min(mean), 6) AS low, round(max(mean), 6) AS high, round(avg(mean), 6) AS mean, round((max(mean) - min(mean)) / nullif(avg(mean), 0), 6) AS spread FROM cu GROUP BY 1""")
def curve_swing(spark, d):
    """How the flagship's curve moves with the ceiling of document frequency."""
    scored = _all_scored(R.membership(spark, d), R.texts(spark, d), _GRID)
    each = scored.select(F.least("shared_packs", F.lit(5)).alias("level"), F.posexplode("cosines").alias("setting", "cosine"))
    out = each.groupBy("setting", "level").agg(F.avg("cosine").alias("mean")).withColumnRenamed("setting", "max_df")
    return rounded(ag.swing(out, "max_df"), "low", "high", "mean", "spread")


@query(f"""WITH {S['p']}
SELECT hops AS level, round(avg(cosine), 9) AS mean, round(stddev_samp(cosine), 9) AS std, count(*) AS n, round(stddev_samp(cosine) / sqrt(count(*)), 9) AS sem, round(1.96::DOUBLE * stddev_samp(cosine) / sqrt(count(*)),
  9) AS ci95 FROM p GROUP BY 1""")
def similarity_by_hops(spark, d):
    return rounded(ag.by_level(R.pair_table(spark, d), F.col("hops")), "mean", "std", "sem", "ci95", places=9)


_RING = f"{S['e']}, {st._NE}, {st._EGO}, {st._ring_sql(3)}, rr AS (SELECT (SELECT node FROM ego) AS x, node AS y, hop FROM r3 WHERE hop > 0)"


@query(f"""WITH {_RING}, {_DOCS}, {_tokens('src')}, {_weights(10, 0.4)}, {_TEXTS},
pe AS (SELECT least(x, y) AS user_a, greatest(x, y) AS user_b, hop FROM rr WHERE x IN (SELECT user_id FROM tu) AND y IN (SELECT user_id FROM tu)), {_COS.format(p='pe')}
SELECT hop, count(*) AS n, round(avg(coalesce(c, 0)), 6) AS mean FROM pe LEFT JOIN dt ON dt.user_a = pe.user_a AND dt.user_b = pe.user_b GROUP BY 1""")
def ego_ring_cosine(spark, d):
    docs, ego = _with_text(R.texts(spark, d)), checkpointed(st._ego(spark, d))
    rings = gr.rings(ego, R.edges(spark, d)).crossJoin(F.broadcast(ego.select(F.col("node").alias("x"))))  # one ego
    pairs = rings.select(F.least("x", "node").alias("user_a"), F.greatest("x", "node").alias("user_b"), "hop")
    scored = _scored(checkpointed(pairs), docs)
    return scored.groupBy("hop").agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 6).alias("mean"))


@query(f"""{st._NEFF}, r AS (SELECT user_a, user_b, i, sum(greatest(g, 0)) AS r FROM gm GROUP BY 1, 2, 3), ef AS (SELECT user_a, user_b, sum(1 / r) AS n_eff FROM r GROUP BY 1, 2), q AS (SELECT quantile_cont(n_eff, [0.45, 0.55, 0.9, 1.0]) AS e FROM ef),
bd AS (SELECT 'median_band' AS band, user_a, user_b FROM ef, q WHERE n_eff >= e[1] AND n_eff <= e[2] UNION ALL SELECT 'top_decile', user_a, user_b FROM ef, q WHERE n_eff >= e[3] AND n_eff <= e[4]),
c AS (SELECT band, pack_id, count(*) AS pairs FROM bd JOIN sh USING (user_a, user_b) GROUP BY 1, 2), kn AS (SELECT bd.band, sh.* FROM bd JOIN sh USING (user_a, user_b) JOIN embeddings ON vec_id = pack_id),
ks AS (SELECT band, user_a, user_b, pack_id, 1 / (k - 1) AS share FROM (SELECT *, count(*) OVER (PARTITION BY band, user_a, user_b) AS k FROM kn) WHERE k > 1),
bp AS (SELECT a.band, a.pack_id AS i, b.pack_id AS j, sum(a.share) AS share FROM ks a JOIN ks b USING (band, user_a, user_b) WHERE a.pack_id < b.pack_id GROUP BY 1, 2, 3),
bs AS (SELECT band, i, j, share * (1 - {st._DOT}) AS far FROM bp JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j),
f AS (SELECT band, pack_id, sum(far) AS far FROM (SELECT band, i AS pack_id, far FROM bs UNION ALL SELECT band, j, far FROM bs) GROUP BY 1, 2), n AS (SELECT band, pack_id, count(*) AS n FROM ks GROUP BY 1, 2)
SELECT band, pack_id, pairs, round(far / n, 6) AS mean_distance FROM c LEFT JOIN f USING (band, pack_id) LEFT JOIN n USING (band, pack_id) QUALIFY row_number() OVER (PARTITION BY band ORDER BY pairs DESC, pack_id) <= 200""")
def neff_bands(spark, d):
    """The packs that pairs of large and of middling n_eff share most, and how far they are from the others these share."""
    sets, emb = checkpointed(st._sets(spark, d)), R.embeddings(spark, d)
    pairs = checkpointed(ne.sets_number(sets, emb, "rowsum"))
    shared, out = sets.select("user_a", "user_b", F.explode("packs").alias("pack_id")), None
    for name, low, high in (("median_band", 0.45, 0.55), ("top_decile", 0.9, 1.0)):
        own = shared.join(ne.in_band(pairs, low, high).select("user_a", "user_b"), ["user_a", "user_b"], "left_semi")
        one = ne.top_shared(own, emb, 200).select(F.lit(name).alias("band"), "pack_id", "pairs", "mean_distance")
        out = one if out is None else out.union(one)
    return rounded(out, "mean_distance")


# --- directed information --------------------------------------------------


def _entropies(ways: str) -> str:
    """Cross entropy of u's tokens given m's, for ways (m, u): match lengths by all pairs of equal tokens, a match being an unbroken diagonal of them."""
    return f"""sq AS (SELECT conv_id AS u, flatten(list(w ORDER BY turn, w)) AS t FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations) GROUP BY 1),
tn AS (SELECT u, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM sq), {ways},
ma AS (SELECT wy.m, wy.u, x.i, y.i AS j FROM wy JOIN tn x ON x.u = wy.u JOIN tn y ON y.u = wy.m AND y.w = x.w),
mi AS (SELECT *, i - row_number() OVER (PARTITION BY m, u, i - j ORDER BY i) AS island FROM ma),
ml AS (SELECT m, u, i, max(len) AS len FROM (SELECT m, u, i, max(i) OVER (PARTITION BY m, u, i - j, island) - i + 1 AS len FROM mi) GROUP BY 1, 2, 3),
ms AS (SELECT m, u, sum(len) AS total FROM ml GROUP BY 1, 2),
en AS (SELECT wy.m, wy.u, CASE WHEN len(b.t) > 0 AND len(a.t) >= 2 THEN len(b.t) * log2(len(a.t)) / (len(b.t) + coalesce(total, 0)) END AS h FROM wy JOIN sq a ON a.u = wy.m JOIN sq b ON b.u = wy.u LEFT JOIN ms ON ms.m = wy.m AND ms.u = wy.u)"""


_WAYS = "wy AS (SELECT source AS m, target AS u FROM pr UNION SELECT target, source FROM pr)"


@query(f"""WITH {_entropies(f"pr AS (SELECT a.u AS source, b.u AS target FROM sq a JOIN sq b ON b.u - a.u IN (1, 2, -7)), {_WAYS}")}
SELECT source, target, round(x.h - y.h, 9) AS flow, round(x.h, 9) AS entropy_st, round(y.h, 9) AS entropy_ts FROM pr JOIN en x ON x.m = source AND x.u = target JOIN en y ON y.m = target AND y.u = source""")
def directed_information(spark, d):
    """Information between each conversation and three others."""
    seqs = checkpointed(info.sequences(R.posts(spark, d)))
    ids = seqs.select(F.col("user_id").alias("target"))
    pairs = seqs.select(F.col("user_id").alias("source"), F.explode(F.array(*[F.col("user_id") + k for k in (1, 2, -7)])).alias("target")).join(ids, "target", "left_semi")
    return rounded(info.pairwise_information(pairs, seqs), "flow", "entropy_st", "entropy_ts", places=9)


#: Alters of a ring, at most, and posts of an alter, at least.
ALTERS, POSTS = 600, 2
_SPEAKER = "ego AS (SELECT node FROM (SELECT source AS node, count(DISTINCT target) AS n FROM e WHERE source <> target GROUP BY 1) JOIN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 2) ON conv_id = node ORDER BY n DESC, node LIMIT 1)"


@query(f"""WITH {S['e']}, {st._NE}, {_SPEAKER}, {st._ring_sql(3)},
al AS (SELECT node, hop FROM (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY md5('42|' || node), node) AS place FROM r3 WHERE hop > 0) WHERE place <= {ALTERS}),
ok AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= {POSTS}),
{_entropies(f"pr AS (SELECT (SELECT node FROM ego) AS source, node AS target, hop FROM al JOIN ok ON conv_id = node), {_WAYS}")},
fl AS (SELECT hop, x.h - y.h AS flow FROM pr JOIN en x ON x.m = source AND x.u = target JOIN en y ON y.m = target AND y.u = source)
SELECT hop AS level, round(avg(flow), 9) AS mean, round(coalesce(stddev_samp(flow), 0), 9) AS std, count(*) AS n FROM fl GROUP BY 1""")
def ego_information(spark, d):
    """Information between one user and those at each distance, by ring."""
    from covey.plans.analyses import ego_information as analysis

    posts, edges = R.posts(spark, d), R.edges(spark, d)
    speakers = tx.thresholds(posts, POSTS, 0).select(F.col("user_id").alias("node"))
    out = edges.where("source <> target").groupBy(F.col("source").alias("node")).agg(F.countDistinct("target").alias("n")).join(speakers, "node", "left_semi")
    ego = checkpointed(out.orderBy(F.desc("n"), "node").limit(1).select("node"))
    curve = analysis(ego, edges, posts, max_frontier=None, max_alters=ALTERS, min_posts=POSTS)["curve"]
    return rounded(curve.select("level", "mean", "std", "n"), "mean", "std", places=9)


# --- draws of the null in SQL -----------------------------------------------

_SV = "rt AS (SELECT sqrt(count(*)) AS r FROM {m}), xu AS (SELECT user_id, count(*) / any_value(r) AS x FROM {m}, rt GROUP BY 1), yp AS (SELECT pack_id, count(*) / any_value(r) AS y FROM {m}, rt GROUP BY 1)"


def _mixed(x: str) -> str:
    first, second = (f"{c}::UBIGINT" for c in nu.MIX)
    low = "4294967295::UBIGINT"
    return f"list_transform(list_transform(list_transform([{x}], lambda v: (xor(v, v >> 16) * {first}) & {low}), lambda v: (xor(v, v >> 13) * {second}) & {low}), lambda v: xor(v, v >> 16))[1]"


def _word(a: str, code: str, b: str, step: int = nu.STEP) -> str:
    return _mixed(f"xor({_mixed(f'({a} + {code}::UBIGINT * {step}::UBIGINT) & 4294967295::UBIGINT')}, {b})")


def _drawn(m: str, replicates: str) -> str:
    """Draws (replicate, user_id, pack_id) of the canonical ensemble with the fitnesses of _SV: counts for each size by inversion, and places by a stream of draws."""
    place = f"(({_mixed(f'xor({_mixed(f'(c + k::UBIGINT * {nu.STEP}::UBIGINT) & 4294967295::UBIGINT')}, (d + j::UBIGINT * {nu.STRIDE}::UBIGINT) & 4294967295::UBIGINT)')} * n::UBIGINT) >> 32)::BIGINT"
    words = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT AS {name}" for i, name in enumerate("abcd"))
    return f"""hw AS (SELECT replicate, user_id, x, {words} FROM (SELECT r.id AS replicate, user_id, x, md5(r.id || '|' || user_id) AS h FROM xu, {replicates} r(id))),
pn AS (SELECT pack_id, count(*) AS k FROM {m} GROUP BY 1), pl AS (SELECT pack_id, k, row_number() OVER (PARTITION BY k ORDER BY md5(pack_id::VARCHAR), pack_id) - 1 AS place FROM pn),
kc AS (SELECT k, any_value(y) AS y, count(*) AS n FROM pn JOIN yp USING (pack_id) GROUP BY 1),
bc AS (SELECT replicate, user_id, k, n, c, d, x * y / (1 + x * y) AS q, {_word('a', 'k', 'b')} / 4294967296.0::DOUBLE AS u FROM hw, kc),
cd AS (SELECT *, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(q) + (n - i) * ln(1 - q))) OVER (PARTITION BY replicate, user_id, k ORDER BY i) AS cdf FROM (SELECT *, unnest(range(0, n)) AS i FROM bc)),
tr AS (SELECT *, least(t, n - t) AS m, 2 * t > n AS most FROM (SELECT replicate, user_id, k, n, c, d, count(*) FILTER (WHERE cdf <= u) AS t FROM cd GROUP BY ALL) WHERE t > 0),
dj AS (SELECT replicate, user_id, k, m, place, min(j) AS j FROM (SELECT *, {place} AS place FROM (SELECT *, unnest(range(0, 4 * m + 64)) AS j FROM tr WHERE m > 0)) GROUP BY ALL),
dk AS (SELECT * FROM dj QUALIFY row_number() OVER (PARTITION BY replicate, user_id, k ORDER BY j) <= m),
nz AS (SELECT tr.replicate, tr.user_id, pl.pack_id FROM tr JOIN pl USING (k) LEFT JOIN dk ON dk.replicate = tr.replicate AND dk.user_id = tr.user_id AND dk.k = tr.k AND dk.place = pl.place WHERE most = (dk.place IS NULL))"""


# --- curves ----------------------------------------------------------------

_Q = "round(quantile_cont({c}, {q}), 9)"


def _five(c: str) -> str:
    return f"""round(avg({c}), 9) AS {c}_mean, round(quantile_cont({c}, 0.5), 9) AS {c}_median, round(quantile_cont({c}, 0.25), 9) AS {c}_q1, round(quantile_cont({c}, 0.75), 9) AS {c}_q3, round(quantile_cont({c},
  0.75) - quantile_cont({c}, 0.25), 9) AS {c}_iqr"""


@query(f"WITH {S['p']} SELECT count(*) AS pairs, {_five('shared_packs')}, {_five('n_eff')}, round(avg((n_eff < shared_packs - 1e-9)::INT), 9) AS reduced, round(avg((abs(n_eff - 1) < 1e-9)::INT), 9) AS ones FROM p WHERE shared_packs >= 1")
def distribution_shift(spark, d):
    out = ag.distribution(R.pair_table(spark, d), "shared_packs", "n_eff")
    return rounded(out, *[c for c in out.columns if c != "pairs"], places=9)


@query(f"""WITH {S['p']},
f AS (SELECT shared_packs AS level, count(*) AS n, avg(n_eff) AS mean FROM p WHERE shared_packs BETWEEN 1 AND 8 GROUP BY 1)
SELECT r.id::BIGINT AS level, coalesce(n, 0) AS n, round(mean, 9) AS mean, round(mean / r.id, 9) AS ratio FROM range(1, 9) r(id) LEFT JOIN f ON f.level = r.id""")
def ratio_by_count(spark, d):
    return rounded(ag.ratio_by_count(R.pair_table(spark, d), "shared_packs", "n_eff"), "mean", "ratio", places=9)


_STRATUM = "CASE WHEN n_eff < 1 THEN '<1' WHEN n_eff <= 3 THEN '1-3' ELSE '>3' END"


@query(f"""WITH {S['p']},
sp AS (SELECT stratum, hops FROM (VALUES ('<1'), ('1-3'), ('>3')) a(stratum), (SELECT unnest([1, 2, 3, 4])::BIGINT AS hops)),
f AS (SELECT {_STRATUM} AS stratum, hops, count(*) AS n, avg(cosine) AS mean FROM p GROUP BY 1, 2)
SELECT sp.stratum, sp.hops, coalesce(n, 0) AS n, round(mean, 9) AS mean FROM sp LEFT JOIN f ON f.stratum = sp.stratum AND f.hops = sp.hops""")
def cell_counts(spark, d):
    return rounded(ag.cells(R.pair_table(spark, d), 3), "mean", places=9)


@query(f"""WITH {S['p']},
en AS (SELECT {_STRATUM} AS stratum, hops, unnest([user_a, user_b]) AS u FROM p),
k AS (SELECT stratum, hops, u, count(*) AS k FROM en GROUP BY 1, 2, 3)
SELECT stratum, hops, (sum(k) // 2)::BIGINT AS n, count(*) AS users, max(k) AS most, round(max(k) / (sum(k) / 2), 9) AS share FROM k GROUP BY 1, 2""")
def cell_diagnostic(spark, d):
    return rounded(ag.cell_diagnostic(R.pair_table(spark, d)), "share", places=9)


_EDGES11 = "[" + ", ".join(f"{k / 10}" for k in range(11)) + "]"


@query(f"""WITH {S['p']},
g AS (SELECT list_distinct(quantile_cont(n_eff, {_EDGES11})) AS e FROM p),
b AS (SELECT greatest(0, least(len(list_filter(e, lambda x: x <= n_eff)) - 1, len(e) - 2))::BIGINT AS bin, n_eff, cosine FROM p, g)
SELECT bin, round(median(n_eff), 9) AS x, round(avg(cosine), 9) AS y, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 30""")
def quantile_curve(spark, d):
    return rounded(ag.quantile_curve(R.pair_table(spark, d), "n_eff", "cosine"), "x", "y", places=9)


@query("SELECT ceil(log10(o_totalprice) * 4 - 1e-9)::BIGINT AS bin, round(avg(o_custkey), 6) AS mean, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def log_bin_curve(spark, d):
    return rounded(ag.log_curve(R.table(spark, d, "orders"), "o_totalprice", "o_custkey"), "mean")


@query("""SELECT ceil(log10(l_extendedprice) * 2 - 1e-9)::BIGINT AS bin_x, ceil(log10(l_quantity) * 2 - 1e-9)::BIGINT AS bin_y, round(avg(l_discount), 9) AS mean, count(*) AS n
  FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY 1, 2""")
def heatmap_2d(spark, d):
    return rounded(ag.heatmap(R.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount"), "mean", places=9)


@query("""WITH b AS (SELECT ceil(log10(o_totalprice) * 4 - 1e-9)::BIGINT AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1)
SELECT bin, n, round(n / ((SELECT sum(n) FROM b) * (pow(10.0::DOUBLE, bin / 4) - pow(10.0::DOUBLE, (bin - 1) / 4))), 12) AS density FROM b""")
def log_histogram(spark, d):
    return rounded(ag.log_histogram(R.table(spark, d, "orders"), "o_totalprice"), "density", places=12)


@query("""SELECT floor(o_totalprice / 10000)::BIGINT AS bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM orders WHERE o_totalprice IS NOT NULL) * 10000.0::DOUBLE), 12) AS density
  FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1""")
def linear_histogram(spark, d):
    return rounded(ag.linear_histogram(R.table(spark, d, "orders"), "o_totalprice", 10000.0), "density", places=12)


@query(f"""WITH {S['p']},
c AS (SELECT hops, shared_packs AS level, avg(cosine) AS mean FROM p GROUP BY 1, 2),
s AS (SELECT *, mean - lag(mean) OVER (PARTITION BY hops ORDER BY level) AS step FROM c)
SELECT hops, count(*) AS levels, coalesce(min(step) > 0, TRUE) AS rising, round(greatest(0, coalesce(-min(step), 0)), 9) AS down FROM s GROUP BY 1""")
def monotone_by_hops(spark, d):
    curves = R.pair_table(spark, d).groupBy("hops", F.col("shared_packs").alias("level")).agg(F.avg("cosine").alias("mean"))
    return rounded(ag.monotone(curves, "hops"), "down", places=9)


@query(f"WITH {S['e']}, {st._ENDS}, c AS (SELECT degree AS x, count(*) AS k FROM g GROUP BY 1) SELECT x, round(1 - coalesce(sum(k) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(k) OVER (), 9) AS ccdf FROM c")
def degree_ccdf(spark, d):
    from covey.operators import edges as ed

    return rounded(ag.ccdf(ed.total_degrees(R.edges(spark, d)), "degree"), "ccdf", places=9)


_RINT = "greatest(0, least(round_even(n_eff, 0), 5))::BIGINT"


@query(f"WITH {S['p']}, b AS (SELECT least(shared_packs, 5) AS s, {_RINT} AS bin FROM p) SELECT s, " + ", ".join(f"count(*) FILTER (WHERE bin = {k}) AS b{k}" for k in range(6)) + " FROM b GROUP BY 1")
def neff_pivot(spark, d):
    return ag.pivot_counts(R.pair_table(spark, d), 5)


@query(f"WITH {S['p']}, b AS (SELECT {_RINT} AS bin, avg(cosine) AS mean, count(*) AS n FROM p GROUP BY 1) SELECT r.id::BIGINT AS bin, round(mean, 9) AS mean, coalesce(n, 0) AS n FROM range(6) r(id) LEFT JOIN b ON b.bin = r.id")
def neff_rint_bins(spark, d):
    return rounded(ag.fixed_bins(R.pair_table(spark, d), ag.rint_bin("n_eff", 5), 5), "mean", places=9)


@query(f"""WITH {S['p']},
a AS (SELECT shared_packs AS level, avg(cosine) AS mean FROM p GROUP BY 1),
b AS (SELECT shared_packs AS level, avg(cosine) AS matched FROM p WHERE hops = 4 GROUP BY 1)
SELECT level, round(mean, 9) AS mean, round(matched, 9) AS matched, round(mean - matched, 9) AS delta, round(mean / nullif(matched, 0), 9) AS ratio, coalesce(mean > lag(mean) OVER (ORDER BY level), FALSE) AS rising
  FROM a JOIN b USING (level)""")
def delta_ratio(spark, d):
    p = R.pair_table(spark, d)
    out = ag.delta_ratio(ag.by_level(p, F.col("shared_packs")), ag.by_level(p.where("hops = 4"), F.col("shared_packs")))
    return rounded(out, "mean", "matched", "delta", "ratio", places=9)


@query(f"""WITH {S['p']}
SELECT count(*) AS pairs, count(*) FILTER (WHERE n_eff > shared_packs + 1e-9) AS above_count, count(*) FILTER (WHERE shared_packs >= 1 AND n_eff < 1 - 1e-9) AS below_one,
  count(*) FILTER (WHERE (shared_packs = 0) <> (n_eff = 0)) AS zero_mismatch, count(*) FILTER (WHERE hops < 1 OR hops > 4) AS bad_hops, count(*) FILTER (WHERE cosine IS NULL) AS no_cosine,
  count(*) FILTER (WHERE user_a >= user_b) AS unordered, count(*) FILTER (WHERE hops = 4) AS sentinels FROM p""")
def invariants(spark, d):
    return ag.invariants(R.pair_table(spark, d), 3)


@query(f"""WITH {S['p']},
f AS (SELECT shared_packs, hops, count(*) AS n FROM p GROUP BY 1, 2)
SELECT count(*) AS cells, count(*) FILTER (WHERE n >= 100) AS viable, CASE WHEN count(*) FILTER (WHERE n >= 100) < 0.6 * count(*) THEN 'coarse' ELSE 'fine' END AS grid FROM f""")
def viable_grid(spark, d):
    return ag.viable_grid(R.pair_table(spark, d))


_POP = f"""{S['dm']}, co AS (SELECT DISTINCT a.user_id AS user_a, b.user_id AS user_b FROM dm a JOIN dm b ON a.pack_id = b.pack_id AND a.user_id < b.user_id), k AS (SELECT user_id, count(*) AS degree FROM dm GROUP BY 1), {st._draws('SELECT DISTINCT user_id FROM dm', 3000)},
zp AS (SELECT user_a, user_b FROM un WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.user_a = un.user_a AND co.user_b = un.user_b)), {_SV.format(m='dm')}, {_drawn('dm', '(VALUES (11))')},
np AS (SELECT DISTINCT un.user_a, un.user_b FROM un JOIN nz a ON a.user_id = un.user_a JOIN nz b ON b.user_id = un.user_b AND b.pack_id = a.pack_id),
en AS (SELECT 'observed' AS population, unnest([user_a, user_b]) AS node FROM co UNION ALL SELECT 'uniform', unnest([user_a, user_b]) FROM zp UNION ALL SELECT 'null', unnest([user_a, user_b]) FROM np),
sm AS (SELECT population, median(degree)::DOUBLE AS median, round(avg(degree), 9) AS mean, count(*) AS n FROM en JOIN k ON k.user_id = node GROUP BY 1)"""


def _populations(spark, d):
    m = R.dense_membership(spark, d)
    drawn = checkpointed(pr.uniform_pairs(m, 3000))
    nulls = nu.under_counts(nu.samples(*nu.start_values(m), [11], inf.ends(drawn).toDF("user_id")), drawn)
    uniform = pr.shared_counts(drawn, m).where("shared_packs = 0")
    return rounded(ag.degree_populations({"observed": pr.comember_degrees(m), "uniform": uniform, "null": nulls}, mb.user_margins(m).toDF("node", "degree")), "mean", places=9)


@query(f"WITH {_POP} SELECT * FROM sm")
def degree_populations(spark, d):
    """Degrees of the ends of pairs that share a pack, of pairs of any users that share none, and of pairs that share one under a draw of the null."""
    return _populations(spark, d)


@query(f"""WITH {_POP}
SELECT max(median) FILTER (WHERE population = 'uniform') AS uniform, max(median) FILTER (WHERE population = 'null') AS "null", max(median) FILTER (WHERE population = 'observed') AS observed,
  coalesce(max(median) FILTER (WHERE population = 'uniform') < max(median) FILTER (WHERE population = 'null') AND max(median) FILTER (WHERE population = 'null') < max(median) FILTER (WHERE population = 'observed'), FALSE) AS rising FROM sm""")
def median_order(spark, d):
    return ag.median_order(_populations(spark, d), ("uniform", "null", "observed"))


_DEC = f"""{S['p']},
dg AS (SELECT user_a, count(*) AS k FROM p GROUP BY 1),
ge AS (SELECT list_distinct(quantile_cont(k, {_EDGES11})) AS e FROM dg),
de AS (SELECT user_a, len(list_filter(list_slice(list_sort(e), 2, len(e) - 1), lambda x: x <= k)) AS decile FROM dg, ge),
pd AS (SELECT p.*, decile AS cell FROM p JOIN de USING (user_a))"""
_DEC += ", pf AS (SELECT user_a, user_b, cell, min(round(cosine, 6)) AS cosine, min(shared_packs) AS shared_packs FROM pd GROUP BY 1, 2, 3)"
_MATCH = _DEC + f""", ob AS (SELECT * FROM pf WHERE shared_packs > 0),
po AS (SELECT cell, cosine AS matched, row_number() OVER (PARTITION BY cell ORDER BY md5('42|' || user_a || '|' || user_b), user_a, user_b, cosine) - 1 AS rank, count(*) OVER (PARTITION BY cell) AS size
  FROM pf WHERE shared_packs = 0),
oz AS (SELECT ob.*, {st.DRAW.format(chr(39) + '43|' + chr(39) + ' || user_a || ' + chr(39) + '|' + chr(39) + ' || user_b')} % s.size AS rank FROM ob LEFT JOIN (SELECT DISTINCT cell, size FROM po) s USING (cell)),
mt AS (SELECT oz.*, po.matched FROM oz LEFT JOIN po ON po.cell = oz.cell AND po.rank = oz.rank)"""


def _matched(spark, d):
    p = R.pair_table(spark, d)
    deciles = pr.value_decile(p.groupBy("user_a").agg(F.count("*").alias("k")), "k").select("user_a", F.col("decile").alias("cell"))
    own = p.join(deciles, "user_a").groupBy("user_a", "user_b", "cell").agg(F.min(F.round("cosine", 6)).alias("cosine"), F.min("shared_packs").alias("shared_packs"))
    return pr.degree_matched(own.where("shared_packs > 0"), own.where("shared_packs = 0"))


@query(f"WITH {_MATCH} SELECT shared_packs AS level, count(*) AS n, count(matched) AS n_matched, round(avg(cosine), 9) AS mean, round(avg(matched), 9) AS matched FROM mt GROUP BY 1")
def degree_matched_curve(spark, d):
    out = _matched(spark, d).groupBy(F.col("shared_packs").alias("level")).agg(F.count("*").alias("n"), F.count("matched").alias("n_matched"), F.avg("cosine").alias("mean"), F.avg("matched").alias("matched"))
    return rounded(out, "mean", "matched", places=9)


@query(f"WITH {_MATCH}, c AS (SELECT shared_packs AS level, avg(cosine) AS mean, avg(matched) AS matched FROM mt GROUP BY 1) SELECT min(CASE WHEN mean >= matched THEN level END) AS crossing FROM c")
def null_crossing(spark, d):
    out = _matched(spark, d).groupBy(F.col("shared_packs").alias("level")).agg(F.avg("cosine").alias("mean"), F.avg("matched").alias("matched"))
    return ag.first_crossing(out)


@query()
def smooth_curve(spark, d):
    curve = R.pair_table(spark, d).groupBy(F.round("n_eff", 1).alias("x")).agg(F.avg("cosine").alias("y"), F.count("*").alias("n"))
    return inf.smooth_curve(curve, "x", "y", "n")


@query()
def lowess_curve(spark, d):
    from covey.operators.inference import lowess

    curve = R.pair_table(spark, d).groupBy(F.round("n_eff", 1).alias("x")).agg(F.avg("cosine").alias("y"))
    return lowess(curve, "x", "y")


# --- inference -------------------------------------------------------------

#: Resamples of the bootstraps: of means, and of statistics of pairs.
B_MEAN, B = 2000, 500


def _mult(src: str, n: int = B) -> str:
    """Places of the units by MD5, the units drawn, and how often each resample draws each."""
    draw = st.DRAW.format("'42|' || b.id || '|' || us.i")
    return f"""us AS (SELECT u, row_number() OVER (ORDER BY md5(u::VARCHAR), u) - 1 AS i FROM (SELECT DISTINCT u FROM ({src}))),
dw AS (SELECT b.id AS boot, {draw} % (SELECT count(*) FROM us) AS i FROM us, range({n}) b(id)), mu AS (SELECT boot, u, count(*) AS m FROM dw JOIN us USING (i) GROUP BY 1, 2)"""


_BOOT = f"{S['p']}, {_mult('SELECT user_a AS u FROM p UNION ALL SELECT user_b FROM p')}, rs AS (SELECT p.*, x.boot, (x.m * y.m)::DOUBLE AS w FROM p JOIN mu x ON x.u = user_a JOIN mu y ON y.u = user_b AND y.boot = x.boot)"
_CI = "round(quantile_cont(s, 0.025), 9) AS ci_low, round(quantile_cont(s, 0.975), 9) AS ci_high"


@query(f"""WITH o AS (SELECT o_orderkey AS u, o_totalprice AS v FROM orders), {_mult('SELECT u FROM o', B_MEAN)}, s AS (SELECT boot, sum(m * v) / sum(m) AS s FROM mu JOIN o USING (u) GROUP BY 1)
SELECT (SELECT round(avg(v), 6) FROM o) AS mean, (SELECT count(*) FROM o) AS n, round(quantile_cont(s, 0.025), 4) AS ci_low, round(quantile_cont(s, 0.975), 4) AS ci_high FROM s""")
def bootstrap_mean_ci(spark, d):
    rows = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return rounded(rounded(inf.mean_interval(rows, "v", B_MEAN), "mean"), "ci_low", "ci_high", places=4)


def _level_ci(cells: str, names: str) -> str:
    return f"""s AS (SELECT {cells}, boot, sum(w * cosine) / sum(w) AS s FROM rs GROUP BY ALL), c AS (SELECT {names}, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM s GROUP BY ALL),
q AS (SELECT {cells}, avg(cosine) AS mean, count(*) AS n FROM p GROUP BY ALL)
SELECT {names}, round(mean, 9) AS mean, n, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round(mean - lo, 9) AS err_low, round(hi - mean, 9) AS err_high FROM q LEFT JOIN c USING ({names})"""


_ERRORS = ("mean", "ci_low", "ci_high", "err_low", "err_high")


@query(f"WITH {_BOOT}, {_level_ci('least(shared_packs, 5) AS level', 'level')}")
def cluster_bootstrap_ci(spark, d):
    return rounded(inf.cluster_bootstrap(R.pair_table(spark, d), F.least("shared_packs", F.lit(5)), n_boot=B), *_ERRORS, places=9)


@query(f"WITH {_BOOT}, {_level_ci(f'{_STRATUM} AS stratum, hops', 'stratum, hops')}")
def cell_bootstrap_ci(spark, d):
    return rounded(inf.cell_bootstrap(R.pair_table(spark, d).withColumn("stratum", ag.stratum()), ("stratum", "hops"), n_boot=B), *_ERRORS, places=9)


@query(f"""WITH o AS (SELECT o_orderkey AS u, o_orderpriority AS cell, o_totalprice AS v FROM orders), {_mult('SELECT u FROM o', 200)},
s AS (SELECT cell, boot, sum(m * v) / sum(m) AS s FROM mu JOIN o USING (u) GROUP BY 1, 2), c AS (SELECT cell, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM s GROUP BY 1),
q AS (SELECT cell, avg(v) AS mean, count(*) AS n FROM o GROUP BY 1)
SELECT cell, round(mean, 4) AS mean, n, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, round(mean - lo, 4) AS err_low, round(hi - mean, 4) AS err_high FROM q LEFT JOIN c USING (cell)""")
def cell_bootstrap_rows(spark, d):
    """The fallback without users: rows themselves are drawn."""
    rows = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cell"), F.col("o_totalprice").alias("v"))
    return rounded(inf.cell_bootstrap(rows, ("cell",), "v", 200, unit="id"), *_ERRORS, places=4)


def _wm(where: str) -> str:
    return f"(sum(w * cosine) FILTER (WHERE {where}) / sum(w) FILTER (WHERE {where}))"


_HI, _LO = _wm("n_eff > 3"), _wm("n_eff < 1")
_STATS = f"{_HI} - {_LO} AS gap, {_HI} / {_LO} AS ratio, ln({_HI} / {_LO}) AS log_ratio"


@query(f"""WITH {_BOOT}, s AS (SELECT boot, {_STATS} FROM rs GROUP BY 1), l AS (UNPIVOT s ON gap, ratio, log_ratio INTO NAME term VALUE s),
e AS (SELECT {_STATS} FROM (SELECT *, 1.0::DOUBLE AS w FROM p)), f AS (UNPIVOT e ON gap, ratio, log_ratio INTO NAME term VALUE estimate), c AS (SELECT term, {_CI} FROM l GROUP BY 1)
SELECT term, round(estimate, 9) AS estimate, ci_low, ci_high FROM f LEFT JOIN c USING (term)""")
def bootstrap_contrasts(spark, d):
    sums = inf.mean_sums("high", "cosine", "n_eff > 3") | inf.mean_sums("low", "cosine", "n_eff < 1")
    high, low = inf.wmean("high"), inf.wmean("low")
    stats = {"gap": high - low, "ratio": F.try_divide(high, low), "log_ratio": F.ln(F.try_divide(high, low))}
    return rounded(inf.bootstrap_statistics(R.pair_table(spark, d), sums, stats, B), "estimate", "ci_low", "ci_high", places=9)


def _slopes_sql(src: str, boot: str) -> str:
    """Weighted moments of each distance, for each resample of src."""
    return f"""SELECT {boot} AS boot, hops, sum(w) AS sw, sum(w * n_eff) AS sx, sum(w * cosine) AS sy, sum(w * n_eff * n_eff) AS sxx, sum(w * n_eff * cosine) AS sxy FROM {src} GROUP BY ALL"""


_MODELS = f"""WITH {_BOOT}, h AS ({_slopes_sql('rs', 'boot')} UNION ALL {_slopes_sql('(SELECT *, 1.0::DOUBLE AS w FROM p)', '-1')}),
c AS (SELECT *, sxx - sx * sx / sw AS cxx, sxy - sx * sy / sw AS cxy FROM h),
a AS (SELECT boot, (sum(sxy) - sum(sx) * sum(sy) / sum(sw)) / (sum(sxx) - sum(sx) * sum(sx) / sum(sw)) AS s FROM h GROUP BY 1), r AS (SELECT boot, cxy / cxx AS ref FROM c WHERE hops = 1),
t AS (SELECT boot, 'x|alone' AS term, s FROM a UNION ALL SELECT boot, 'x|with levels', sum(cxy) / sum(cxx) FROM c GROUP BY 1 UNION ALL SELECT boot, 'slope|' || hops, cxy / cxx FROM c
  UNION ALL SELECT c.boot, 'interaction|' || hops, cxy / cxx - ref FROM c JOIN r ON r.boot = c.boot WHERE hops <> 1)"""


@query(f"""{_MODELS}
SELECT x.term, round(x.s, 9) AS estimate, ci_low, ci_high FROM t x JOIN (SELECT term, {_CI} FROM t WHERE boot >= 0 GROUP BY 1) y USING (term) WHERE x.boot = -1""")
def bootstrap_models(spark, d):
    return rounded(inf.bootstrap_models(R.pair_table(spark, d), "n_eff", "cosine", "hops", 1, B), "estimate", "ci_low", "ci_high", places=9)


@query(f"""{_MODELS}
SELECT 'n_eff:hops[' || split_part(x.term, '|', 2) || ']' AS term, round(x.s, 9) AS estimate, ci_low, ci_high FROM t x JOIN (SELECT term, {_CI} FROM t WHERE boot >= 0 GROUP BY 1) y USING (term) WHERE x.boot = -1 AND x.term LIKE 'interaction%'""")
def coefficient_table(spark, d):
    """Point estimates of the moderator model with the intervals of the bootstrap's terms."""
    from covey.plans.analyses import network

    p = R.pair_table(spark, d)
    return rounded(network(p, None, n_boot=B, known=p)["coefficients"], "estimate", "ci_low", "ci_high", places=9)


_FIT = "count(*) AS n, round(regr_slope(cosine, {x}), 9) AS slope, round(regr_intercept(cosine, {x}), 9) AS intercept, round(regr_r2(cosine, {x}), 9) AS r2"


@query(f"WITH {S['p']} SELECT '1-5' AS span, {_FIT.format(x='shared_packs')} FROM p WHERE shared_packs BETWEEN 1 AND 5 UNION ALL SELECT '0-5', {_FIT.format(x='shared_packs')} FROM p WHERE shared_packs BETWEEN 0 AND 5")
def slope_windows(spark, d):
    p = R.pair_table(spark, d)
    out = None
    for low in (1, 0):
        one = inf.slopes(p.where(F.col("shared_packs").between(low, 5)), "shared_packs", "cosine", []).select(F.lit(f"{low}-5").alias("span"), "n", "slope", "intercept", "r2")
        out = one if out is None else out.union(one)
    return rounded(out, "slope", "intercept", "r2", places=9)


@query(f"WITH {S['p']} SELECT hops, {_FIT.format(x='n_eff')} FROM p GROUP BY 1")
def slope_by_hops(spark, d):
    return rounded(inf.slopes(R.pair_table(spark, d), "n_eff", "cosine", ["hops"]), "slope", "intercept", "r2", places=9)


@query(f"""WITH {S['p']},
h AS (SELECT regr_sxy(cosine, n_eff) AS xy, regr_sxx(cosine, n_eff) AS xx FROM p GROUP BY hops)
SELECT (SELECT count(*) FROM p) AS n, (SELECT round(regr_slope(cosine, n_eff), 9) FROM p) AS slope_without, round(sum(xy) / sum(xx), 9) AS slope_with FROM h""")
def cg_with_without_hops(spark, d):
    return rounded(inf.controlled_slope(R.pair_table(spark, d), "n_eff", "cosine", "hops"), "slope_without", "slope_with", places=9)


@query(f"""WITH {S['p']},
c AS (SELECT count(*) AS n, var_pop(shared_packs) AS a, covar_pop(shared_packs, n_eff) AS b, var_pop(n_eff) AS c, covar_pop(shared_packs, cosine) AS d, covar_pop(n_eff, cosine) AS e, var_pop(cosine) AS f
  FROM p WHERE shared_packs > 0),
k AS (SELECT *, (c * d - b * e) / (a * c - b * b) AS b1, (a * e - b * d) / (a * c - b * b) AS b2 FROM c)
SELECT n, round(b1, 8) AS b1, round(b2, 8) AS b2, round((b1 * d + b2 * e) / f, 8) AS r2, round(d * d / (a * f), 8) AS r2_one, round((b1 * d + b2 * e) / f - d * d / (a * f), 8) AS gain FROM k""")
def ols_two_predictors(spark, d):
    out = inf.two_predictors(R.pair_table(spark, d).where("shared_packs > 0"), "shared_packs", "n_eff", "cosine")
    return rounded(out, "b1", "b2", "r2", "r2_one", "gain", places=8)


#: How far the second of two nearly collinear predictors is from the first, in units of the packs shared.
NEAR = 1e-4


@query(f"""WITH {S['p']}, c AS (SELECT var_pop(shared_packs) AS a, covar_pop(shared_packs, n_eff) AS b, var_pop(n_eff) AS c, covar_pop(shared_packs, cosine) AS d, covar_pop(n_eff, cosine) AS e, avg(n_eff) AS x, avg(shared_packs) AS z, avg(cosine) AS y FROM p),
k AS (SELECT *, (c * d - b * e) / (a * c - b * b) AS bz, (a * e - b * d) / (a * c - b * b) AS bx FROM c)
SELECT 'intercept' AS term, round(y - bx * x - bz * z, 5) AS estimate FROM k UNION ALL SELECT 'n_eff', round(bx - bz / {NEAR}, 4) FROM k UNION ALL SELECT 'near', round(bz / {NEAR}, 4) FROM k""")
def collinear_least_squares(spark, d):
    """Least squares on a predictor and its near copy; SQL has the well-conditioned pair that they come from."""
    p = R.pair_table(spark, d).withColumn("near", F.col("n_eff") + NEAR * F.col("shared_packs"))
    out = inf.least_squares(p, ["n_eff", "near"], "cosine")
    return out.withColumn("estimate", F.when(F.col("term") == "intercept", F.round("estimate", 5)).otherwise(F.round("estimate", 4)))


def _log_sql(eps: float) -> str:
    return f"""SELECT {eps}::DOUBLE AS eps, hops, n, round(b, 8) AS slope, round(b - rb, 8) AS difference, round(CASE WHEN hops <> 1 THEN sqrt(s2 * (1 / xx + 1 / rx)) END, 8) AS se,
  round(CASE WHEN hops <> 1 THEN (b - rb) / sqrt(s2 * (1 / xx + 1 / rx)) END, 6) AS t FROM (WITH l AS (SELECT hops, n_eff AS x, ln(cosine + {eps}) AS y FROM p),
h AS (SELECT hops, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS xx, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss FROM l GROUP BY 1)
SELECT *, (SELECT b FROM h WHERE hops = 1) AS rb, (SELECT xx FROM h WHERE hops = 1) AS rx, sum(rss) OVER () / (sum(n) OVER () - 2 * count(*) OVER ()) AS s2 FROM h)"""


@query(f"WITH {S['p']} " + " UNION ALL ".join(_log_sql(e) for e in (0.01, 0.001, 0.0001)))
def log_interaction(spark, d):
    p, out = R.pair_table(spark, d), None
    for eps in (0.01, 0.001, 0.0001):
        one = inf.interaction(p.withColumn("y", F.ln(F.col("cosine") + eps)), "n_eff", "y", "hops", 1).select(F.lit(eps).alias("eps"), "hops", "n", "slope", "difference", "se", "t")
        out = one if out is None else out.union(one)
    return rounded(rounded(out, "slope", "difference", "se", places=8), "t")


@query(f"WITH {S['p']}, l AS (" + " UNION ALL ".join(_log_sql(e) for e in (0.01, 0.001, 0.0001)) + """)
SELECT hops, count(DISTINCT eps) AS settings, count(DISTINCT sign(t)) = 1 AS same_sign, count(DISTINCT abs(t) > 1.96) = 1 AS same_significance FROM l WHERE t IS NOT NULL GROUP BY 1""")
def log_stability(spark, d):
    """Whether the sign and the significance of the interaction stay over the offsets."""
    return inf.stability(log_interaction(spark, d), "eps", ["hops"])


@query(f"""WITH {S['p']}, x AS (SELECT n_eff, hops, cosine FROM p WHERE cosine IS NOT NULL), y AS (SELECT 'poisson' AS family, * FROM x UNION ALL SELECT 'gamma', * FROM x WHERE cosine > 0)
SELECT family, count(*) AS n, 0.0::DOUBLE AS intercept, 0.0::DOUBLE AS n_eff, 0.0::DOUBLE AS interaction, TRUE AS hops_too FROM y GROUP BY 1""")
def glm_scores(spark, d):
    """The fits of both families with the moderator solve their score equations: of each predictor x, sums of (y - mu) x (Poisson) and of (y - mu) / mu x (Gamma), for each row, are 0 to six places."""
    p = R.pair_table(spark, d)
    scores = inf.log_link_scores(p, inf.log_link(p, "n_eff", "cosine", by="hops"), "n_eff", "cosine", by="hops")
    near = lambda c: F.abs(F.round(F.max(F.when(c, F.abs("score"))), 6)).alias
    kind, plain = F.col("term"), F.col("term").isin("intercept", "n_eff")
    return scores.groupBy("family").agg(F.max("n").alias("n"), near(kind == "intercept")("intercept"), near(kind == "n_eff")("n_eff"), near(kind.contains(":"))("interaction"), (F.max(F.when(~plain & ~kind.contains(":"), F.abs("score"))) < 1e-6).alias("hops_too"))


@query(f"""WITH {S['p']}, m AS (SELECT avg(cosine) FILTER (WHERE n_eff > 3) > avg(cosine) FILTER (WHERE n_eff < 1) AS up, covar_pop(n_eff, cosine) > 0 AS rises, count(*) AS n FROM p HAVING count(*) > 0)
SELECT 'n_eff' AS term, 2::BIGINT AS models, up AND rises AS agree FROM m UNION ALL SELECT 'intercept', 2, up AND rises FROM m""")
def glm_signs(spark, d):
    """Both families agree in the signs of a model of one predictor that rises, as strata and covariance say it does."""
    return inf.sign_agreement(inf.log_link(R.pair_table(spark, d), "n_eff", "cosine"))


@query()
def glm_log_link(spark, d):
    return inf.log_link(R.pair_table(spark, d), "n_eff", "cosine", by="hops")


@query(f"""WITH {S['p']},
a AS (SELECT hops, avg(cosine) FILTER (WHERE n_eff > 3) AS h, avg(cosine) FILTER (WHERE n_eff < 1) AS l FROM p GROUP BY 1)
SELECT hops, round(h - l, 9) AS gap, round(h / nullif(l, 0), 9) AS ratio, round(ln(h / nullif(l, 0)), 9) AS log_ratio FROM a""")
def stratum_gaps(spark, d):
    p = R.pair_table(spark, d).withColumn("w", F.lit(1.0))
    sums = p.groupBy("hops").agg(inf.weighted_mean("cosine", "w", "n_eff > 3").alias("h"), inf.weighted_mean("cosine", "w", "n_eff < 1").alias("l"))
    out = sums.select("hops", (F.col("h") - F.col("l")).alias("gap"), F.try_divide("h", "l").alias("ratio"), F.ln(F.try_divide("h", "l")).alias("log_ratio"))
    return rounded(out, "gap", "ratio", "log_ratio", places=9)


# --- null models -----------------------------------------------------------


@query(f"""WITH {S['m']},
u AS (SELECT user_id, count(*) AS d FROM m GROUP BY 1),
k AS (SELECT pack_id, count(*) AS k FROM m GROUP BY 1)
SELECT 'user' AS side, d AS degree, count(*) AS n, d::DOUBLE AS expected FROM u GROUP BY 2
UNION ALL SELECT 'pack', k, count(*), k::DOUBLE FROM k GROUP BY 2""")
def bicm_expected_margins(spark, d):
    """The fitted margins, to four places, are the observed ones."""
    users, packs = nu.fit(R.membership(spark, d))
    return rounded(nu.expected_margins(users, packs), "expected", places=4)


@query(f"""WITH {S['m']},
{_SV.format(m='m')},
{st._draws(st._TWO, 3000)},
sc AS (SELECT un.user_a, un.user_b, count(b.pack_id) AS s FROM un LEFT JOIN m a ON a.user_id = un.user_a LEFT JOIN m b ON b.user_id = un.user_b AND b.pack_id = a.pack_id GROUP BY 1, 2),
yc AS (SELECT y, count(*) AS m FROM yp GROUP BY 1),
q AS (SELECT user_a, user_b, s, m, (a.x * y / (1 + a.x * y)) * (b.x * y / (1 + b.x * y)) AS q FROM sc JOIN xu a ON a.user_id = user_a JOIN xu b ON b.user_id = user_b, yc)
SELECT user_a, user_b, s AS shared_packs, round(sum(m * q), 9) AS expected, round(sum(m * q * (1 - q)), 9) AS variance, round((s - sum(m * q)) / sqrt(sum(m * q * (1 - q))), 6) AS z FROM q GROUP BY 1, 2, 3""")
def bicm_cooccurrence(spark, d):
    m = R.membership(spark, d)
    pairs = pr.shared_counts(pr.uniform_pairs(pr.eligible(m, 2), 3000), m)
    out = nu.cooccurrence(pairs, *nu.start_values(m)).select("user_a", "user_b", "shared_packs", "expected", "variance", "z")
    return rounded(rounded(out, "expected", "variance", places=9), "z")


_RATE = f"""rc AS (SELECT un.user_a, un.user_b, count(b.pack_id) AS s FROM un LEFT JOIN m a ON a.user_id = un.user_a LEFT JOIN m b ON b.user_id = un.user_b AND b.pack_id = a.pack_id GROUP BY 1, 2),
yc AS (SELECT y, count(*) AS m FROM yp GROUP BY 1),
ra AS (SELECT user_a, user_b, s, sum(m * (a.x * y / (1 + a.x * y)) * (b.x * y / (1 + b.x * y))) AS e FROM rc JOIN xu a ON a.user_id = user_a JOIN xu b ON b.user_id = user_b, yc GROUP BY 1, 2, 3),
pp AS (SELECT user_a, user_b, s AS shared_packs, least(1, 2 * least(list_sum(list_transform(range(0, s + 1), lambda k: exp(k * ln(e) - e - lgamma(k + 1)))),
  CASE WHEN s = 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, s), lambda k: exp(k * ln(e) - e - lgamma(k + 1)))) END)) AS p FROM ra)"""


def _p_values(spark, d):
    m = R.membership(spark, d)
    pairs = pr.shared_counts(pr.uniform_pairs(pr.eligible(m, 2), 3000), m)
    return nu.with_p(nu.cooccurrence(pairs, *nu.start_values(m)))


@query(f"WITH {S['m']}, {_SV.format(m='m')}, {st._draws(st._TWO, 3000)}, {_RATE} SELECT user_a, user_b, shared_packs, round(p, 7) AS p_value FROM pp")
def bicm_cooccurrence_p(spark, d):
    return _p_values(spark, d).select("user_a", "user_b", "shared_packs", F.round("p_value", 7).alias("p_value"))


@query(f"WITH {S['m']}, {_SV.format(m='m')}, {st._draws(st._TWO, 3000)}, {_RATE} SELECT count(*) AS pairs, round(avg((p < 0.05)::INT), 9) AS significant FROM pp")
def bicm_significant(spark, d):
    return rounded(nu.cooccurrence_summary(_p_values(spark, d)), "significant", places=9)


@query(f"WITH {S['dm']}, {_SV.format(m='dm')}, {_drawn('dm', '(VALUES (5))')} SELECT user_id, count(*) AS packs FROM nz GROUP BY 1")
def bicm_sample_margins(spark, d):
    return mb.user_margins(nu.sample(*nu.start_values(R.dense_membership(spark, d)), seed=5))


@query(f"WITH {S['dm']} SELECT count(DISTINCT user_id) AS users, count(DISTINCT pack_id) AS packs, count(*) AS links, 0::BIGINT AS changed_users, 0::BIGINT AS changed_packs, TRUE AS mixed FROM dm")
def curveball_margins(spark, d):
    """Margins before and after 5 trades for each link; links that stay must be about as few as chance leaves (a user's share of all packs)."""
    m = R.dense_membership(spark, d)
    new = checkpointed(nu.curveball(m, [1]).drop("replicate"))
    change = lambda f: f(m).exceptAll(f(new)).agg(F.count("*").alias("c"))
    out = m.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("pack_id").alias("packs"), F.count("*").alias("links"))
    out = out.crossJoin(change(mb.user_margins).withColumnRenamed("c", "changed_users")).crossJoin(change(mb.pack_margins).withColumnRenamed("c", "changed_packs"))
    stay = m.join(new, ["user_id", "pack_id"], "left_semi").agg(F.count("*").alias("stay"))
    chance = mb.user_margins(m).agg(F.sum(F.col("packs") * F.col("packs")).alias("square"))
    mixed = (F.col("stay") < 1.1 * F.col("square") / F.col("packs") + 0.02 * F.col("links")).alias("mixed")
    return out.crossJoin(stay).crossJoin(chance).select("users", "packs", "links", "changed_users", "changed_packs", mixed)


R_NULL = 8
_NULLS = f"""{S['dm']}, {_SV.format(m='dm')}, {_DOCS}, {_tokens('src')}, {_weights(10, 0.4)}, {_TEXTS}, {st._draws('SELECT DISTINCT user_id FROM dm', 1000)},
pe AS (SELECT * FROM un WHERE user_a IN (SELECT user_id FROM tu) AND user_b IN (SELECT user_id FROM tu)), {_COS.format(p='pe')},
pc AS (SELECT pe.user_a, pe.user_b, coalesce(c, 0) AS cosine FROM pe LEFT JOIN dt USING (user_a, user_b)),
{_drawn('dm', f'range({R_NULL})')}, nm AS (SELECT * FROM nz UNION ALL SELECT -1, user_id, pack_id FROM dm),
ns AS (SELECT a.replicate, l.user_a, l.user_b, a.pack_id FROM pc l JOIN nm a ON a.user_id = l.user_a JOIN nm b ON b.user_id = l.user_b AND b.replicate = a.replicate AND b.pack_id = a.pack_id),
pk AS (SELECT DISTINCT pack_id FROM dm),
gg AS (SELECT a.pack_id AS i, b.pack_id AS j, CASE WHEN a.pack_id = b.pack_id THEN 1.0::DOUBLE WHEN x.embedding IS NULL OR y.embedding IS NULL THEN 0.0::DOUBLE ELSE {st._DOT} END AS g
  FROM pk a CROSS JOIN pk b LEFT JOIN embeddings x ON x.vec_id = a.pack_id LEFT JOIN embeddings y ON y.vec_id = b.pack_id),
nr AS (SELECT a.replicate, a.user_a, a.user_b, a.pack_id, sum(greatest(g, 0)) AS r FROM ns a JOIN ns b USING (replicate, user_a, user_b) JOIN gg ON gg.i = a.pack_id AND gg.j = b.pack_id GROUP BY 1, 2, 3, 4),
nf AS (SELECT replicate, user_a, user_b, count(*) AS k, sum(1 / r) AS n_eff FROM nr GROUP BY 1, 2, 3),
ne AS (SELECT rr.id AS replicate, pc.*, coalesce(k, 0) AS k, coalesce(n_eff, 0) AS n_eff FROM pc CROSS JOIN range(-1, {R_NULL}) rr(id) LEFT JOIN nf ON nf.replicate = rr.id AND nf.user_a = pc.user_a AND nf.user_b = pc.user_b)"""


def _null_pairs(spark, d):
    """Pairs with their cosines, and the membership that is randomised."""
    m = R.dense_membership(spark, d)
    return m, checkpointed(_scored(checkpointed(pr.uniform_pairs(m, 1000)), R.texts(spark, d)))


def _under_null(spark, d):
    m, pairs = _null_pairs(spark, d)
    nulls = nu.samples(*nu.start_values(m), list(range(R_NULL)), inf.ends(pairs).toDF("user_id"))
    return m, pairs, nu.under(nulls, pairs, R.embeddings(spark, d), "rowsum")


@query(f"WITH {_NULLS} SELECT replicate, round(regr_slope(cosine, n_eff), 9) AS slope FROM ne WHERE replicate >= 0 GROUP BY 1")
def null_slopes(spark, d):
    """n_eff anew under each draw of the canonical ensemble, and the slope of the cosines on it."""
    _, _, scored = _under_null(spark, d)
    return nu.statistics(scored, "slope").select(F.col("replicate").cast("long").alias("replicate"), F.round("value", 9).alias("slope"))


def _curve_sql(kind: str, bin_of: str) -> str:
    return f"""SELECT '{kind}' AS x_kind, r.id::BIGINT AS bin, round(o.mean, 9) AS observed_mean, round(null_mean, 9) AS null_mean, round(null_low, 9) AS null_low, round(null_high, 9) AS null_high FROM range(9) r(id)
LEFT JOIN (SELECT {bin_of} AS b, avg(cosine) AS mean FROM ne WHERE replicate = -1 GROUP BY 1) o ON o.b = r.id
LEFT JOIN (SELECT b, avg(mean) AS null_mean, quantile_cont(mean, 0.025) AS null_low, quantile_cont(mean, 0.975) AS null_high FROM (SELECT replicate, {bin_of} AS b, avg(cosine) AS mean FROM ne WHERE replicate >= 0 GROUP BY 1, 2) GROUP BY 1) n ON n.b = r.id"""


@query(f"WITH {_NULLS} {_curve_sql('count', 'least(k, 8)')} UNION ALL {_curve_sql('n_eff', 'greatest(0, least(round_even(n_eff, 0), 8))::BIGINT')}")
def null_curves(spark, d):
    """Mean cosine by packs shared and by n_eff: observed, and under draws of the canonical ensemble."""
    m, pairs, scored = _under_null(spark, d)
    own = ne.for_pairs(pairs, pr.shared_packs(pairs, m), R.embeddings(spark, d), "rowsum")
    out = nu.curves(checkpointed(own), checkpointed(scored), 8, n_boot=0).drop("observed_ci_low", "observed_ci_high")
    return rounded(out, "observed_mean", "null_mean", "null_low", "null_high", places=9)


@query()
def null_slopes_curveball(spark, d):
    """The same under the microcanonical ensemble, 5 trades for each link."""
    m, pairs = _null_pairs(spark, d)
    return nu.statistics(nu.under(nu.curveball(m, [1, 2, 3]), pairs, R.embeddings(spark, d), "rowsum"), "slope")


def _reduce_sql(value: str) -> str:
    """Replicates of v (stat, replicate, value; -1 is the observed one) as nu.reduce() does it."""
    return f"""v AS ({value}), o AS (SELECT stat, value AS o FROM v WHERE replicate = -1), n AS (SELECT stat, value AS v FROM v WHERE replicate >= 0 AND value IS NOT NULL)
SELECT stat, o AS observed, count(*) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd,
  round(least(1, 2 * least((1 + count(*) FILTER (WHERE v >= o)) / (count(*) + 1), (1 + count(*) FILTER (WHERE v <= o)) / (count(*) + 1))), 9) AS p, round((o - avg(v)) / stddev_samp(v), 3) AS z FROM n JOIN o USING (stat) GROUP BY stat, o"""


_SLOPES = _reduce_sql("SELECT 'slope' AS stat, replicate, round(regr_slope(cosine, n_eff), 9) AS value FROM ne GROUP BY 2")


def _reduced(out):
    return rounded(rounded(rounded(out, "mean", "sd", places=8), "p", places=9), "z", places=3)


def _nine(df):
    return df.withColumn("value", F.round("value", 9))


@query(f"WITH {_NULLS}, {_SLOPES}")
def null_reduce(spark, d):
    """The observed slope against the replicates."""
    m, pairs, scored = _under_null(spark, d)
    own = ne.for_pairs(pairs, pr.shared_packs(pairs, m), R.embeddings(spark, d), "rowsum")
    return _reduced(nu.reduce(_nine(nu.statistics(own, "slope", keys=())), _nine(nu.statistics(scored, "slope"))))


@query(f"""WITH {S['e']}, {st._NE}, {_NULLS}, hp AS (SELECT user_a, user_b FROM pc), ho AS (WITH {st._hops_sql('ug', 2)}),
sl AS (SELECT replicate, hops, CASE WHEN count(*) >= 2 AND regr_sxx(cosine, n_eff) > 1e-12 THEN regr_slope(cosine, n_eff) END AS s FROM ne JOIN ho USING (user_a, user_b) GROUP BY 1, 2),
{_reduce_sql("SELECT 'interaction[hops=' || a.hops || ']' AS stat, a.replicate, round(a.s - b.s, 9) AS value FROM sl a JOIN sl b ON b.replicate = a.replicate AND b.hops = 1 WHERE a.hops <> 1")}""")
def null_interaction(spark, d):
    """How the slope at each distance differs from that of neighbours, observed and under draws of the canonical ensemble."""
    m, pairs = _null_pairs(spark, d)
    near = checkpointed(gr.hops(pairs, R.edges(spark, d), 2))
    nulls = nu.samples(*nu.start_values(m), list(range(R_NULL)), inf.ends(near).toDF("user_id"))
    scored = checkpointed(nu.under(nulls, near, R.embeddings(spark, d), "rowsum"))
    own = ne.for_pairs(near, pr.shared_packs(near, m), R.embeddings(spark, d), "rowsum")
    return _reduced(nu.reduce(_nine(nu.statistics(own, "interaction", (), 1)), _nine(nu.statistics(scored, "interaction", reference=1))))


@query(f"WITH {_NULLS}, {_SLOPES}")
def null_tasks(spark, d):
    """The same slope from four tasks that share the replicates, each with files of its own; one is called twice and not run again."""
    from covey.plans.analyses import null_task
    from covey.plans.files import new_folder

    m, pairs = _null_pairs(spark, d)
    folder, emb = new_folder(spark), R.embeddings(spark, d)
    for task in (2, 0, 3, 1, 0):
        null_task(folder, m, pairs, emb, task, 4, ensemble="canonical", n_replicates=R_NULL, method="rowsum", fitted=False)
    return _reduced(nu.reduce(_nine(spark.read.parquet(f"{folder}/observed")), _nine(spark.read.parquet(f"{folder}/replicates"))))
