"""Pair tables: co-membership census, baselines and samples. Pairs have user_a < user_b."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from covey.functions import draw_int, draw_key, first_by_draw, places, ranked_by_draw
from covey.functions.digests import Texts, draws_of
from covey.operators.aggregates import quantiles
from covey.session import checkpointed


#: Members of a pack that meet in one task; larger packs are dealt out in blocks.
BLOCK = 4000
#: Members in a row of a user's lists, and members or pairs that a task puts out at once.
PIECE, HELD = 256, 500_000


def _met(m: DataFrame, min_packs: int) -> DataFrame:
    """Rows of user_a, pack_id and others: members of the pack beyond user_a, at most PIECE in a row; sorted runs of a user_a in one task.

    Packs are lists of members, and what is shuffled is a list for each member, not a row for each pair. The
    members of a pack of more than BLOCK are cut into blocks, and each pair of blocks is a key of its own,
    so that no task has all pairs of a large pack.
    """
    m = checkpointed(m.select("user_id", "pack_id").where("user_id IS NOT NULL AND pack_id IS NOT NULL"))
    user, pack = (dict(m.dtypes)[c] for c in ("user_id", "pack_id"))
    if min_packs > 1:
        users = m.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_packs)
        m = m.join(users, "user_id", "left_semi")
    members = F.collect_list("user_id").alias("members")
    sizes = checkpointed(m.groupBy("pack_id").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks")).where("blocks > 1"))
    if sizes.isEmpty():
        lists = m.groupBy("pack_id").agg(members).select("pack_id", "members", F.lit(None).cast(f"array<{user}>").alias("beyond"))
    else:
        small = m.join(sizes, "pack_id", "left_anti").groupBy("pack_id").agg(members)
        cut = m.join(sizes, "pack_id").groupBy("pack_id", "blocks", F.pmod(F.xxhash64("user_id"), F.col("blocks")).cast("int").alias("block")).agg(members)
        cut, every = checkpointed(cut), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        a = cut.select("pack_id", F.col("block").alias("block_a"), every.alias("block_b"), "members")
        b = cut.select("pack_id", F.col("block").alias("block_b"), every.alias("block_a"), F.col("members").alias("beyond"))
        large = a.join(b, ["pack_id", "block_a", "block_b"]).select("pack_id", "members", "beyond")
        lists = small.select("pack_id", "members", F.lit(None).cast(f"array<{user}>").alias("beyond")).union(large)
    text = f"user_a {user}, pack_id {pack}, others array<{user}>"
    schema = to_arrow_schema(StructType.fromDDL(text))
    piece, held = PIECE, HELD
    return lists.mapInArrow(lambda batches: _beyond(batches, schema, piece, held), text).repartition("user_a").sortWithinPartitions("user_a", "pack_id")


def _beyond(batches: Iterator[pa.RecordBatch], schema: pa.Schema, piece: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows: pack_id, members, and beyond (null: the members themselves)."""
    def put() -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), schema.field("others").type.value_type))
        packs = batch.column("pack_id").take(pa.array(np.repeat(rows, [len(x) for x in lengths])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(users), schema.field("user_a").type), packs, others.cast(schema.field("others").type)], schema=schema)

    for batch in batches:
        lists = [(c.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(c.value_lengths().fill_null(0).to_numpy())]) for c in (batch.column("members"), batch.column("beyond"))]
        (own, at), (beyond, far), alone = *lists, batch.column("beyond").is_null().to_numpy(zero_copy_only=False)
        users, lengths, values, rows, held = [], [], [], [], 0
        for row in range(batch.num_rows):
            a = np.sort(own[at[row] : at[row + 1]])
            b = a if alone[row] else np.sort(beyond[far[row] : far[row + 1]])
            first = np.searchsorted(b, a, side="right")
            step = max(1, most // max(1, len(b)))
            for lo in range(0, len(a), step):
                x, starts = a[lo : lo + step], first[lo : lo + step]
                n = len(b) - starts
                pieces = -(-n // piece)
                if not pieces.sum():
                    continue
                of = np.repeat(np.arange(len(x)), pieces)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                own_n = np.minimum(piece, n[of] - nth * piece)
                begin = starts[of] + nth * piece
                values.append(b[np.repeat(begin - (np.cumsum(own_n) - own_n), own_n) + np.arange(own_n.sum())])
                users.append(x[of])
                lengths.append(own_n)
                rows.append(row)
                held += int(own_n.sum())
                if held >= most:
                    yield put()
                    users, lengths, values, rows, held = [], [], [], [], 0
        if rows:
            yield put()


def _by_user(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted run cut where user_a changes, about a batch at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        users = batch.column("user_a")
        last = users[batch.num_rows - 1]
        start = int(np.argmax(pc.equal(users, last).to_numpy(zero_copy_only=False)))
        if start or (held and held[-1].column("user_a")[0] != last):
            whole = [*held, *([batch.slice(0, start)] if start else [])]
            yield pa.Table.from_batches(whole).combine_chunks()
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(table: pa.Table) -> tuple:
    """Each other user of each row of a user: the codes of (user_a, user_b), the row each comes from, the first row of each user_a, and the users that codes stand for."""
    users, others = (table.column(c).chunk(0) for c in ("user_a", "others"))
    same = np.r_[False, pc.equal(users[1:], users[:-1]).to_numpy(zero_copy_only=False)] if len(users) > 1 else np.array([False])
    row = np.repeat(np.arange(len(users)), others.value_lengths().to_numpy())
    code = others.flatten().dictionary_encode()
    key = (np.cumsum(~same) - 1)[row] * len(code.dictionary) + code.indices.to_numpy()
    return key, row, np.flatnonzero(~same), code.dictionary


def _counted(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for table in _by_user(batches):
        key, _, first, names = _runs(table)
        key = np.sort(key)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        start, n = start[n >= least], n[n >= least]
        a, b = np.divmod(key[start], len(names))
        users = table.column("user_a").chunk(0)
        for lo in range(0, len(n), HELD):
            own = slice(lo, lo + HELD)
            yield pa.RecordBatch.from_arrays([users.take(pa.array(first[a[own]])), names.take(pa.array(b[own])), pa.array(n[own], pa.int64())], schema=schema)


def _listed(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for table in _by_user(batches):
        key, row, first, names = _runs(table)
        order = np.argsort(key, kind="stable")  # rows of a user are in order of their packs
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        start, n = start[n >= least], n[n >= least]
        a, b = np.divmod(key[start], len(names))
        users, packs = (table.column(c).chunk(0) for c in ("user_a", "pack_id"))
        for lo in range(0, len(n), 8192):
            own = slice(lo, lo + 8192)
            at = np.repeat(start[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
            sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[own])].astype(np.int32)), packs.take(pa.array(row[order[at]])))
            yield pa.RecordBatch.from_arrays([users.take(pa.array(first[a[own]])), names.take(pa.array(b[own])), sets.cast(schema.field("packs").type)], schema=schema)


def _pairs_of(m: DataFrame, kernel: Callable, least: int, min_packs: int, more: str) -> DataFrame:
    kind = dict(m.dtypes)["user_id"]
    text = f"user_a {kind}, user_b {kind}, {more}"
    schema = to_arrow_schema(StructType.fromDDL(text))
    return _met(m, min_packs).mapInArrow(lambda batches: kernel(batches, least, schema), text)


def comember_pairs(m: DataFrame, min_packs: int = 1, least: int = 1) -> DataFrame:
    """Every pair of users that share at least `least` packs, with the number they share: the co-members of a user are counted where its lists meet."""
    return _pairs_of(m, _counted, least, min_packs, "shared_packs long")


def comember_sets(m: DataFrame, least: int = 1, min_packs: int = 1) -> DataFrame:
    """user_a, user_b, packs (sorted) of the pairs that share at least `least` packs."""
    return _pairs_of(m, _listed, least, min_packs, f"packs array<{dict(m.dtypes)['pack_id']}>")


#: Users of a block of comember_degrees().
USERS = 4096


def _degrees_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows: users and lists of packs of two blocks. How many of the others each of the first shares a pack with."""
    def read(block: pa.StructArray) -> tuple:
        items = block.flatten()
        users, packs = items.field("user_id"), items.field("packs")
        return users, packs.flatten(), np.repeat(np.arange(len(users)), packs.value_lengths().to_numpy())

    def dense(of: np.ndarray, n: int, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((n, int(own.max()) + 1 if len(own) else 1), np.float32)
        keep = np.flatnonzero((codes >= 0) & (codes < out.shape[1]))
        out[of[keep], codes[keep]] = 1
        return out

    for batch in batches:
        for k in range(batch.num_rows):
            (users, pa_, of_a), (others, pb, of_b) = read(batch.column("a").slice(k, 1)), read(batch.column("b").slice(k, 1))
            names = pc.unique(pa_)
            a, b = (pc.index_in(x, names).fill_null(-1).to_numpy() for x in (pa_, pb))
            met = np.zeros((len(users), len(others)), bool)
            for low in range(0, len(names), 1024):  # of few columns at a time
                own = np.arange(min(1024, len(names) - low))
                met |= dense(of_a, len(users), np.where((a >= low) & (a < low + 1024), a - low, -1)) @ dense(of_b, len(others), np.where((b >= low) & (b < low + 1024), b - low, -1)).T > 0
            self_ = pc.index_in(users, others).fill_null(-1).to_numpy()
            n = met.sum(axis=1) - np.where(self_ >= 0, met[np.arange(len(users)), self_], False)
            yield pa.RecordBatch.from_arrays([users, pa.array(n, pa.int64())], schema=schema)


def comember_degrees(m: DataFrame) -> DataFrame:
    """node and n: with how many others a user shares a pack, for dense membership.

    Each pair of blocks of users is a product of two 0/1 matrices, in memory of a block's square: no pair is a row. Quadratic
    in the users, whatever they share, so that comember_pairs() is better where most users share nothing.
    """
    m = m.select("user_id", "pack_id").where("user_id IS NOT NULL AND pack_id IS NOT NULL")
    held = checkpointed(m.groupBy("user_id").agg(F.collect_set("pack_id").alias("packs")))
    blocks = max(1, -(-held.count() // USERS))
    dealt = held.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("user_id", "packs")).alias("rows"))
    dealt, every = checkpointed(dealt), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = dealt.select(F.col("block").alias("i"), every.alias("j"), F.col("rows").alias("a"))
    b = dealt.select(every.alias("i"), F.col("block").alias("j"), F.col("rows").alias("b"))
    kind = dict(m.dtypes)["user_id"]
    text = f"node {kind}, n long"
    schema = to_arrow_schema(StructType.fromDDL(text))
    parts = a.join(b, ["i", "j"]).select("a", "b").mapInArrow(lambda batches: _degrees_of(batches, schema), text)
    return parts.groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")


def levels(pairs: DataFrame, max_shared: int) -> DataFrame:
    return pairs.groupBy(F.least("shared_packs", F.lit(max_shared)).alias("level")).agg(F.count("*").alias("n_pairs"))


def census(pairs: DataFrame, per_level: int, max_shared: int, seed: int = 42) -> DataFrame:
    """Of each level (shared packs, clipped) the per_level pairs that come first in a fixed random order; the count stays unclipped."""
    keyed = pairs.select("*", F.least("shared_packs", F.lit(max_shared)).alias("level"), draw_key(seed, "user_a", "user_b").alias("key"))
    return first_by_draw(keyed, ["level"], per_level, [F.col("key"), F.col("user_a"), F.col("user_b")], F.col("key")).select("user_a", "user_b", "shared_packs")


def _low_of(batches: Iterator[pa.RecordBatch], least: int, per_level: int, max_shared: int, seed: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """_counted(), without the pairs that come after the per_level lowest draws of their level that this task has seen."""
    lowest: dict[int, np.ndarray] = {}
    for counted in _counted(batches, least, schema):
        a, b = (counted.column(c).dictionary_encode() for c in ("user_a", "user_b"))
        draw = draws_of(seed, Texts(a.dictionary), a.indices.to_numpy(), Texts(b.dictionary), b.indices.to_numpy())
        level, low = np.minimum(counted.column("shared_packs").to_numpy(), max_shared), np.zeros(len(draw), bool)
        for k in np.unique(level).tolist():
            seen = lowest.get(k, np.empty(0, np.uint32))
            own = level == k
            if len(seen) >= per_level:
                own &= draw <= seen.max()
            seen = np.concatenate([seen, draw[own]])
            lowest[k] = np.partition(seen, per_level - 1)[:per_level] if len(seen) > per_level else seen
            low |= own & (draw <= lowest[k].max(initial=0))
        yield counted.filter(pa.array(low))


def comember_census(m: DataFrame, per_level: int, max_shared: int, seed: int = 42, min_packs: int = 1) -> DataFrame:
    """census() of comember_pairs(). Where co-members are counted, a task leaves out pairs that enough others of their level come before: what goes on grows with the tasks, not with the pairs."""
    kind = dict(m.dtypes)["user_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "string") or per_level < 1:
        return census(comember_pairs(m, min_packs), per_level, max_shared, seed)
    text = f"user_a {kind}, user_b {kind}, shared_packs long"
    schema = to_arrow_schema(StructType.fromDDL(text))
    low = _met(m, min_packs).mapInArrow(lambda batches: _low_of(batches, 1, per_level, max_shared, seed, schema), text)
    return census(checkpointed(low), per_level, max_shared, seed)


def uniform_pairs(users: DataFrame, n_draws: int, seed: int = 42, start: int = 0) -> DataFrame:
    """Distinct unordered pairs from n_draws draws of two users, whatever they share. users: user_id. Draws are numbered from start."""
    ranked = places(users, "user_id")
    n = F.broadcast(users.select(F.countDistinct("user_id").alias("n")))  # one row
    draws = users.sparkSession.range(start, start + n_draws).crossJoin(n)
    pick = lambda side: draw_int(F.md5(F.concat(F.lit(f"{seed}|{side}|"), F.col("id").cast("string")))) % F.col("n")
    ends = draws.select(pick("a").alias("i"), pick("b").alias("j"))
    a, b = ranked.select(F.col("user_id").alias("x"), F.col("place").alias("i")), ranked.select(F.col("user_id").alias("y"), F.col("place").alias("j"))
    return ends.join(a, "i").join(b, "j").where("x <> y").select(F.least("x", "y").alias("user_a"), F.greatest("x", "y").alias("user_b")).distinct()


#: Draws of the rounds of baseline(), for each pair wanted, all before them included.
DRAWS = (4, 12, 28, 60, 124, 200)


def baseline(m: DataFrame, n_pairs: int, seed: int = 42) -> DataFrame:
    """n_pairs pairs of any users that share no pack. Rounds draw more and more, until there are enough or 200 draws for each have been made; a short draw stays short."""
    m = checkpointed(m)
    free, start = None, 0
    for most in DRAWS:
        fresh = uniform_pairs(m, n_pairs * most - start, seed, start)
        fresh = fresh.join(shared_counts(fresh, m).where("shared_packs > 0"), ["user_a", "user_b"], "left_anti")
        free, start = checkpointed(fresh if free is None else free.union(fresh).distinct()), n_pairs * most
        if free.count() >= n_pairs:
            break
    return free.orderBy(draw_key(seed, "user_a", "user_b"), "user_a", "user_b").limit(n_pairs).withColumn("shared_packs", F.lit(0).cast("long"))


def eligible(m: DataFrame, min_packs: int = 2) -> DataFrame:
    return m.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_packs).select("user_id")


def shared_packs(pairs: DataFrame, m: DataFrame) -> DataFrame:
    """user_a, user_b, pack_id for each pack that a listed pair shares."""
    a = pairs.select("user_a", "user_b").join(m.withColumnRenamed("user_id", "user_a"), "user_a")
    return a.join(m.withColumnRenamed("user_id", "user_b"), ["user_b", "pack_id"], "left_semi").select("user_a", "user_b", "pack_id")


def shared_counts(pairs: DataFrame, m: DataFrame) -> DataFrame:
    """shared_packs for each listed pair, 0 included."""
    counts = shared_packs(pairs, m).groupBy("user_a", "user_b").agg(F.count("*").alias("shared_packs"))
    return pairs.select("user_a", "user_b").join(counts, ["user_a", "user_b"], "left").fillna(0, ["shared_packs"])


def mapped(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """One row: how many pairs have both ends among users, and how many are dropped."""
    u = users.select("user_id").distinct()
    both = pairs.join(u, pairs.user_a == u.user_id, "left_semi").join(u, F.col("user_b") == u.user_id, "left_semi")
    return pairs.agg(F.count("*").alias("pairs")).crossJoin(both.agg(F.count("*").alias("kept"))).select("pairs", "kept", (F.col("pairs") - F.col("kept")).alias("dropped"))


def _met_in_packs(pairs: DataFrame, m: DataFrame) -> tuple[DataFrame, bool]:
    """source, target and shared_packs of the ends of pairs that meet in a pack, and whether fewer rows meet there than packs of the sources are listed pair by pair."""
    a = checkpointed(m.withColumnRenamed("user_id", "source").join(pairs.select("source").distinct(), "source", "left_semi"))
    b = checkpointed(m.withColumnRenamed("user_id", "target").join(pairs.select("target").distinct(), "target", "left_semi"))
    sizes = [x.groupBy("pack_id").agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb"))]
    met = sizes[0].join(sizes[1], "pack_id").agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0
    own = pairs.groupBy("source").agg(F.count("*").alias("n")).join(a.groupBy("source").agg(F.count("*").alias("k")), "source").agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0
    return a.join(b, "pack_id").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("shared_packs")), met < own


def with_shared(info: DataFrame, m: DataFrame) -> DataFrame:
    """Directed information (source, target, ...) with shared_packs, 0 included; pairs of one user with itself go.

    Packs are listed pair by pair, or the ends of the pairs meet in their packs, whichever makes fewer rows.
    """
    own, m = checkpointed(info.where("source <> target")), checkpointed(m)
    met, fewer = _met_in_packs(own, m)
    if fewer:
        return own.join(met, ["source", "target"], "left").fillna(0, ["shared_packs"])
    own = own.withColumn("user_a", F.least("source", "target")).withColumn("user_b", F.greatest("source", "target"))
    return own.join(shared_counts(own.select("user_a", "user_b").distinct(), m), ["user_a", "user_b"]).drop("user_a", "user_b")


def symmetric_info(info: DataFrame, value: str) -> DataFrame:
    """Directed (source, target, value) as one row for each unordered pair: the mean, in how many directions it is known, and shared_packs, if there."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    more = [F.min("shared_packs").alias("shared_packs")] if "shared_packs" in info.columns else []  # the same in both directions
    return info.where("source <> target").groupBy(a.alias("user_a"), b.alias("user_b")).agg(F.avg(value).alias(value), F.count("*").alias("directions"), *more)


def spread_pick(stats: DataFrame, level: str, value: str) -> DataFrame:
    """The pairs of largest and smallest value in the level where they lie furthest apart; where no level has two pairs, of all. stats: user_a, user_b, level, value."""
    spread = stats.groupBy(level).agg((F.max(value) - F.min(value)).alias("spread"), F.count("*").alias("n")).where("n > 1")
    widest = F.broadcast(spread.orderBy(F.desc("spread"), level).limit(1).select(F.col(level).alias("__widest"), "spread"))  # one row
    none = F.broadcast(spread.agg((F.count("*") == 0).alias("__none")))  # one row
    own = stats.crossJoin(none).join(widest, F.col(level) == F.col("__widest"), "left").where("__none OR __widest IS NOT NULL").drop("__widest", "__none")
    high = own.orderBy(F.desc(value), "user_a", "user_b").limit(1).withColumn("pick", F.lit("max"))
    low = own.orderBy(value, "user_a", "user_b").limit(1).withColumn("pick", F.lit("min"))
    return high.union(low)


def select_five(stats: DataFrame, level: str, value: str, seed: int = 42, n: int = 5) -> DataFrame:
    """spread_pick(), filled up to n pairs by one from each other level, small levels first, and then by any; pick says max, min or span."""
    extremes = checkpointed(spread_pick(stats, level, value))
    left = stats.join(extremes.select("user_a", "user_b"), ["user_a", "user_b"], "left_anti").withColumn("key", draw_key(seed, "user_a", "user_b"))
    order = [F.col("key"), F.col("user_a"), F.col("user_b")]
    one = first_by_draw(left, [level], n, order, F.col("key")).withColumn("turn", F.row_number().over(W.partitionBy(level).orderBy(*order)))
    taken = F.broadcast(extremes.select(F.col(level).alias("__level")).distinct().withColumn("old", F.lit(1)))  # two rows at most
    turns = one.join(taken, F.col(level) == F.col("__level"), "left").withColumn("round", F.col("turn") + F.coalesce("old", F.lit(0)))
    span = turns.orderBy("round", level, *order).limit(n - 2).select(*stats.columns).withColumn("pick", F.lit("span"))
    return extremes.select(*stats.columns, "pick").union(span)


def same_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct pairs only one of two tables has, and whether there is none."""
    x, y = (t.select("user_a", "user_b").distinct() for t in (a, b))
    left, right = x.join(y, ["user_a", "user_b"], "left_anti"), y.join(x, ["user_a", "user_b"], "left_anti")
    both = left.agg(F.count("*").alias("only_a")).crossJoin(right.agg(F.count("*").alias("only_b")))  # one row each
    return both.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def value_decile(values: DataFrame, value: str, n: int = 10) -> DataFrame:
    """Adds decile: how many inner edges (distinct percentiles of value) lie at or below it. The edges are searched by counting."""
    edges = list(dict.fromkeys(quantiles(values, value, [k / n for k in range(n + 1)]).get(0, [])))
    return values.withColumn("decile", sum(((F.col(value) >= e).cast("long") for e in edges[1:-1]), F.lit(0).cast("long")))


def degree_matched(observed: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """Each observed pair with the value of one pool pair drawn, with replacement, from its cell; null where the cell is empty.

    Both have user_a, user_b, cell and cosine. A pair finds its match by an equi-join on the cell and a rank.
    """
    sizes = pool.groupBy("cell").agg(F.count("*").alias("size"))
    own = pool.select("cell", "user_a", "user_b", F.col("cosine").alias("matched"))
    ranked = ranked_by_draw(own, ["cell"], draw_key(seed, "user_a", "user_b"), ["user_a", "user_b", "matched"], "rank").select("cell", "matched", "rank")
    draw = draw_int(draw_key(seed + 1, "user_a", "user_b"))
    return observed.join(sizes, "cell", "left").withColumn("rank", draw % F.col("size")).join(ranked, ["cell", "rank"], "left").drop("size", "rank")
