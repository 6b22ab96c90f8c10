"""Operators on membership (user_id, pack_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.functions import draw_key


def build(packs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Distinct membership from packs with arrays of members; the packs are not restricted with the users."""
    m = packs.select(F.explode("members").alias("user_id"), "pack_id").distinct()
    return m if users is None else m.join(users.select("user_id").distinct(), "user_id", "left_semi")


def user_margins(m: DataFrame) -> DataFrame:
    return m.groupBy("user_id").agg(F.count("*").alias("packs"))


def pack_margins(m: DataFrame) -> DataFrame:
    return m.groupBy("pack_id").agg(F.count("*").alias("members"))


def pack_members(m: DataFrame) -> DataFrame:
    return m.groupBy("pack_id").agg(F.sort_array(F.collect_set("user_id")).alias("members"))


def specificity(m: DataFrame) -> DataFrame:
    """ln(users / members) for each pack."""
    users = F.broadcast(m.agg(F.countDistinct("user_id").alias("users")))  # one row
    return pack_margins(m).crossJoin(users).select("pack_id", F.ln(F.col("users") / F.col("members")).alias("specificity"))


def pack_slice(m: DataFrame, n_packs: int = 25, target_users: int = 150, min_pack_size: int = 2, seed: int = 42) -> DataFrame:
    """Members of a sample of whole packs, down to a sample of target_users: user_id."""
    packs = pack_margins(m).where(F.col("members") >= min_pack_size).orderBy(draw_key(seed, "pack_id"), "pack_id").limit(n_packs)
    users = m.join(packs, "pack_id", "left_semi").select("user_id").distinct()
    return users.orderBy(draw_key(seed, "user_id"), "user_id").limit(target_users)


def alignment(packs: DataFrame, texts: DataFrame, n_check: int = 50) -> DataFrame:
    """One row: packs and texts, and of about n_check packs checked how many names are not in the text. packs: pack_id (from 0), name; texts: pack_id, text.

    Packs without a name or without a text can't be wrong.
    """
    n = F.broadcast(packs.agg(F.count("*").alias("n")))  # one row
    step = F.greatest(F.lit(1), F.floor(F.col("n") / n_check))
    checked = packs.crossJoin(n).where(F.col("pack_id") % step == 0).join(texts, "pack_id", "left")
    amiss = (F.col("name") != "") & (F.col("text") != "") & ~F.col("text").contains(F.col("name"))
    wrong = checked.agg(F.count("*").alias("checked"), F.count_if(F.coalesce(amiss, F.lit(False))).alias("wrong"))
    return n.crossJoin(F.broadcast(texts.agg(F.count("*").alias("texts")))).crossJoin(F.broadcast(wrong)).select(F.col("n").alias("packs"), "texts", "checked", "wrong")


def corpus_counts(m: DataFrame, e: DataFrame, posts: DataFrame, universe: DataFrame | None = None, min_packs: int = 2) -> DataFrame:
    """metric and value: packs, members, memberships, edges, distinct edges, users with posts, posts; members of min_packs
    packs or more, and, with a universe of users (user_id), what is left of members, edges and posts within it."""
    def one(df: DataFrame, name: str, value) -> DataFrame:
        return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    rows = [
        one(m, "packs", F.countDistinct("pack_id")), one(m, "members", F.countDistinct("user_id")), one(m, "memberships", F.count("*")),
        one(e, "edges", F.count("*")), one(e, "distinct_edges", F.countDistinct("source", "target")), one(posts, "users_with_posts", F.countDistinct("user_id")), one(posts, "posts", F.count("*")),
        one(user_margins(m).where(F.col("packs") >= min_packs), f"members_of_{min_packs}", F.count("*")),
    ]
    if universe is not None:
        u = universe.select("user_id").distinct()
        inside = e.join(u, e.source == u.user_id, "left_semi").join(u, F.col("target") == u.user_id, "left_semi")
        rows += [
            one(m.join(u, "user_id", "left_semi"), "universe_members", F.countDistinct("user_id")), one(inside, "universe_edges", F.count("*")),
            one(posts.join(u, "user_id", "left_semi"), "universe_posts", F.count("*")),
        ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
