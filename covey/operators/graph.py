"""Distances in the follow graph by level-synchronous joins.

Searches run side by side in the bits of a long: 64 of them share a batch, and a row (node, batch, mask) says
which have reached the node. A level is one join with the edges and a bit_or, summed before its shuffle.
Edges of hubs are dealt out over salts, and what a level expands at once is bounded. Where a task can hold
the edges (`held`), it makes all levels of its searches by itself, and nothing but the edges goes to disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from covey.functions import draw_key
from covey.session import checkpointed, delete, stored

#: Edges of a node that have one key; edges that a level follows at once, and beyond which it goes in slices.
HUB, EXPAND = 10_000, 2_000_000_000
#: Searches of a batch: the bits of a long.
BITS = 64
#: Nodes of a front that are broadcast to pick its edges.
NEAR = 500_000
#: Edges that a task holds (4 bytes each) to search by itself; how many copies of them are dealt out at most; edges of a piece; numbers of a table of what searches have seen.
HELD, COPIES, PIECE, CELLS = 64_000_000, 16, 1_000_000, 6_000_000
#: Distances that a task holds.
FAR = 16_000_000


def load(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Distinct edges without loops, in both directions unless directed."""
    e = edges.select("source", "target").where("source <> target")
    return (e if directed else e.union(e.select("target", "source"))).distinct()


def _dealt(graph: DataFrame, hub: int = HUB, look_ahead: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges to follow as node, salt, next, each with the degree of next (0 at a dead end, or without look_ahead), and the degrees (node, degree)."""
    degrees = checkpointed(graph.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree")))
    hubs = degrees.where(F.col("degree") > hub).withColumnRenamed("degree", "of_hub")
    ahead = degrees.select(F.col("node").alias("next"), F.col("degree").alias("next_degree"))
    own = graph.select(F.col("source").alias("node"), F.col("target").alias("next")).join(hubs, "node", "left")
    salt = F.when(F.col("of_hub").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("next"), _salts(F.col("of_hub"), hub))).cast("int")
    salted = own.select("node", salt.alias("salt"), "next")
    if not look_ahead:
        return salted.withColumn("next_degree", F.lit(0).cast("long")), degrees
    return checkpointed(salted.join(ahead, "next", "left").select("node", "salt", "next", F.coalesce("next_degree", F.lit(0)).alias("next_degree"))), degrees


def _salts(degree: Column, hub: int) -> Column:
    return F.ceil(degree / F.lit(float(hub))).cast("int")


def _start(searches: DataFrame, end: str, degrees: DataFrame) -> DataFrame:
    """searches: batch, mask and their first nodes in the column `end`. The front before the first level: node, batch, mask, degree."""
    front = searches.groupBy(F.col(end).alias("node"), "batch").agg(F.bit_or("mask").alias("mask"))
    return front.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def _reached(front: DataFrame, edges: DataFrame, hub: int = HUB, most: int = EXPAND, cut: Callable = checkpointed, one_too: bool = True) -> DataFrame:
    """The nodes one step from a front, in the front's form; at most about `most` edges are followed at once: slices are cut, and a front of one slice if one_too."""
    slices = -(-(front.agg(F.sum("degree")).first()[0] or 0) // most) or 1
    out = None
    for k in range(slices):
        own = front.where("degree > 0") if slices == 1 else front.where((F.col("degree") > 0) & (F.pmod(F.xxhash64("batch"), F.lit(slices)) == k))
        salted = own.select("node", "batch", "mask", F.explode(F.sequence(F.lit(0), _salts(F.col("degree"), hub) - 1)).alias("salt"))
        one = salted.join(edges, ["node", "salt"]).groupBy(F.col("next").alias("node"), "batch").agg(F.bit_or("mask").alias("mask"), F.first("next_degree").alias("degree"))
        one = cut(one) if slices > 1 or one_too else one
        out = one if out is None else out.union(one)
    return out


def _level(front: DataFrame, edges: DataFrame, hub: int = HUB, most: int = EXPAND) -> DataFrame:
    """The nodes one step from a front (checkpointed), in the front's form; at most about `most` edges are followed at once."""
    return _reached(front, edges, hub, most)


def _stepped(front: DataFrame, edges: DataFrame, ways: list[tuple[str, str]], hub: int, most: int, near: int) -> DataFrame:
    """_level() of a front (node, batch, mask) over edges that are not dealt out: only those that leave the front are, picked by a broadcast of its nodes while they are few."""
    nodes = front.select(F.col("node").alias("source")).distinct()
    if nodes.count() <= near:
        nodes = F.broadcast(nodes)
    own = None
    for a, b in ways:
        one = edges.select(F.col(a).alias("source"), F.col(b).alias("target")).join(nodes, "source", "left_semi")
        own = one if own is None else own.union(one)
    dealt, degrees = _dealt(checkpointed(own), hub, look_ahead=False)  # repeated edges do no harm
    return _level(front.select("node", "batch", "mask").join(degrees, "node"), dealt, hub, most)


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with batch and mask (one bit): every row a search of its own, rows alike in `order` side by side."""
    ids = checkpointed(rows.repartition(order).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id()))
    return ids.withColumn("batch", F.expr(f"id div {BITS}")).withColumn("mask", F.expr(f"shiftleft(1L, cast(id % {BITS} as int))"))


def hops(pairs: DataFrame, edges: DataFrame, max_hops: int = 4, directed: bool = False, hub: int = HUB, most: int = EXPAND, near: int = NEAR) -> DataFrame:
    """Adds hops to pairs: the distance if it is 1..max_hops, else max_hops + 1. Repeated pairs are all filled.

    Every distinct pair is a search. One front leaves its first end, one its second (against the edges), in
    turn a step at a time, and a pair is met when both have its bit at one node: the first time at the
    number of steps made, since walks of fewer have been tried. Bits of pairs that are met are dropped.
    Edges are kept as they come, and a step shuffles those that leave its front, not the graph.
    """
    pairs, graph = checkpointed(pairs), checkpointed(edges.select("source", "target").where("source <> target"))
    along, against = ("source", "target"), ("target", "source")
    ahead, back = ([along], [against]) if directed else ([along, against], [along, against])
    left = _numbered(pairs.select("user_a", "user_b").distinct().where("user_a <> user_b"), "user_a")
    a, b = (left.groupBy(F.col(end).alias("node"), "batch").agg(F.bit_or("mask").alias("mask")) for end in ("user_a", "user_b"))
    open_, found = None, None

    def still(front: DataFrame) -> DataFrame:
        """The front of the pairs that are not met."""
        if open_ is None:
            return front
        return front.join(open_, "batch").withColumn("mask", F.col("mask").bitwiseAND(F.col("open"))).drop("open").where("mask <> 0")

    for k in range(1, max_hops + 1):
        if k % 2:
            a = _stepped(checkpointed(still(a)), graph, ahead, hub, most, near)
        else:
            b = _stepped(checkpointed(still(b)), graph, back, hub, most, near)
        both = still(a).select("node", "batch", "mask").join(b.select("node", "batch", F.col("mask").alias("other")), ["node", "batch"])
        hit = checkpointed(both.groupBy("batch").agg(F.bit_or(F.col("mask").bitwiseAND(F.col("other"))).alias("hit")).where("hit <> 0"))
        met = left.join(hit, "batch").where("(mask & hit) <> 0").select("user_a", "user_b", F.lit(k).alias("hops"))
        found = met if found is None else found.union(met)
        if k < max_hops:
            before = left.groupBy("batch").agg(F.bit_or("mask").alias("open")) if open_ is None else open_
            open_ = checkpointed(before.join(hit, "batch", "left").select("batch", F.expr("open & ~coalesce(hit, 0L)").alias("open")).where("open <> 0"))
            if open_.isEmpty():
                break
    return pairs.join(found, ["user_a", "user_b"], "left").withColumn("hops", F.coalesce("hops", F.lit(max_hops + 1)).cast("long"))


def hop_label(max_hops: int, column: str = "hops"):
    return F.when(F.col(column).between(1, max_hops), F.col(column).cast("string")).otherwise("unreachable")


def _levels(users: DataFrame, edges: DataFrame, directed: bool, hub: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The users (column node) that are in the graph as searches (node, id, batch, mask), and which searches reach which of them at which distance, 0 included: target, batch, mask, distance.

    Levels go on until no search reaches a new node; of what they write, only the latest is kept.
    """
    spark, graph = users.sparkSession, checkpointed(load(edges, directed))
    nodes = graph.select(F.explode(F.array("source", "target")).alias("node")).union(edges.where("source = target").select(F.col("source").alias("node"))).distinct()
    q = _numbered(users.select("node").distinct().join(nodes, "node", "left_semi"), "node")
    ahead, degrees = _dealt(graph, hub)
    state, path = stored(_start(q, "node", degrees).withColumn("seen", F.col("mask")))
    found, k = q.select(F.col("node").alias("target"), "batch", "mask", F.lit(0).alias("distance")), 0
    front, seen = state.drop("seen"), state.select("node", "batch", "seen")
    old = [path]  # tables that go when the next level is written

    def cut(df: DataFrame) -> DataFrame:
        df, path = stored(df)
        old.append(path)
        return df

    while not front.isEmpty():
        k += 1
        both = _reached(front, ahead, hub, most, cut, False).join(seen, ["node", "batch"], "full")
        state, new = stored(both.select("node", "batch", F.expr("coalesce(mask, 0L) & ~coalesce(seen, 0L)").alias("mask"), F.expr("coalesce(mask, 0L) | coalesce(seen, 0L)").alias("seen"), F.coalesce("degree", F.lit(0)).alias("degree")))
        while old:
            delete(spark, old.pop())
        old.append(new)
        front, seen = state.where("mask <> 0").drop("seen"), state.select("node", "batch", "seen")
        found = found.union(checkpointed(front.join(q.select("node"), "node", "left_semi").select(F.col("node").alias("target"), "batch", "mask", F.lit(k).alias("distance"))))
    delete(spark, old.pop())
    return q, found


def _packed(batches: Iterator[pa.RecordBatch], most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows: source, target (whole numbers below 2 ** 31). Pieces of at most `most` distinct edges: targets, how many sources each has, and these, in bytes."""
    def put() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(kept))
        target, source = (keys >> 32).astype(np.int32), (keys & 0x7FFFFFFF).astype(np.int32)
        start = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        counts = np.diff(np.r_[start, len(keys)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (target[start], counts, source)], schema=schema)

    kept, n = [], 0
    for batch in batches:
        if batch.num_rows:
            source, target = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("source", "target"))
            kept.append(target << 32 | source)
            n += batch.num_rows
            if n >= most:
                yield put()
                kept, n = [], 0
    if kept:
        yield put()


def _searched(pieces: list[tuple], n: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level by level from 0: the distance, and for each batch of the searches of the nodes first..last - 1 (a row) which reach a node of n at it, in bits."""
    at = np.arange(first, last)
    seen = np.zeros((-(-len(at) // BITS), n), np.uint64)
    seen[(at - first) // BITS, at] = np.uint64(1) << ((at - first) % BITS).astype(np.uint64)
    front, k = seen.copy(), 0
    while True:
        yield k, front
        active, new, k = (front != 0).any(axis=0), np.zeros_like(front), k + 1
        for targets, counts, sources in pieces:
            own = np.flatnonzero(active[sources])
            if not len(own):
                continue
            of, sources = np.repeat(targets, counts)[own], sources[own]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            to = of[start]
            for row in range(len(front)):
                new[row, to] |= np.bitwise_or.reduceat(front[row][sources], start)
        new &= ~seen
        if not new.any():
            return
        seen |= new
        front = new


def _groups(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[tuple]:
    """Of each group that a task has: its first and last search, the names of the nodes that are searched for, and the pieces of the edges."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            group, first, last, names, *piece = (batch.column(c).slice(row, 1) for c in ("first", "first", "last", "names", "targets", "counts", "sources"))
            own = held.setdefault(group[0].as_py(), [None, []])
            if names[0].is_valid:
                own[0] = (first[0].as_py(), last[0].as_py(), names.flatten())
            else:
                own[1].append(tuple(np.frombuffer(x[0].as_py(), np.int32) for x in piece))
    for head, edges in held.values():
        if head is None or len(edges) != pieces:
            raise ValueError(f"{len(edges)} of {pieces} pieces of the edges have come")
        yield *head, edges


def _pairs_found(batches: Iterator[pa.RecordBatch], pieces: int, n: int, words: int, drop_self: bool, drop_unreachable: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """source, target, distance of the searches of a group."""
    for first, last, names, edges in _groups(batches, pieces):
        for low in range(first, last, words * BITS):
            high = min(last, low + words * BITS)
            far = np.full((high - low, len(names)), -1, np.int32)
            for k, front in _searched(edges, n, low, high):
                for row in range(len(front)):
                    own = far[row * BITS : (row + 1) * BITS]
                    bits = np.unpackbits(np.ascontiguousarray(front[row, : len(names)]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    own[bits.T[: len(own)] != 0] = k
            step = max(1, 65536 // len(names))
            for a in range(0, high - low, step):
                block = far[a : a + step]
                keep = block >= 0 if drop_unreachable else np.ones(block.shape, bool)
                if drop_self:
                    keep[np.arange(len(block)), low + a + np.arange(len(block))] = False
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(low + a + i)), names.take(pa.array(j)), pa.array(block[i, j])], schema=schema)


def _counts_found(batches: Iterator[pa.RecordBatch], pieces: int, n: int, words: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """distance and n: how many of the nodes that are searched for the searches of a group reach at each distance."""
    for first, last, names, edges in _groups(batches, pieces):
        for low in range(first, last, words * BITS):
            found = [(k, int(np.bitwise_count(front[:, : len(names)]).sum(dtype=np.int64))) for k, front in _searched(edges, n, low, min(last, low + words * BITS))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int64())], schema=schema)


def _dense(rows: DataFrame, start: int) -> tuple[DataFrame, int]:
    """rows with id: start, start + 1, ..., in order of their partitions; and the next id."""
    own = checkpointed(rows.withColumn("__at", F.monotonically_increasing_id()))
    sizes = sorted(own.groupBy(F.shiftright("__at", 33).cast("int").alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = np.cumsum([start, *[r.n for r in sizes]]).tolist()
    begins = F.broadcast(rows.sparkSession.createDataFrame([(r.part, b) for r, b in zip(sizes, before)], "__part int, __begin long"))
    out = own.withColumn("__part", F.shiftright("__at", 33).cast("int")).join(begins, "__part")
    return out.withColumn("id", (F.col("__begin") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("__at", "__part", "__begin"), before[-1]


def _held(users: DataFrame, edges: DataFrame, directed: bool, held: int, kernel: Callable, cells: int, text: str) -> tuple[DataFrame, int] | None:
    """The rows of kernel, which is given all edges and a group of the searches of users (column node) that are in the graph, and how many of these there are; None if there are more than `held` edges.

    Nodes are numbered, those that are searched for first; edges to others that nothing leaves are left out. A
    task gets the edges as pieces of numbers, so that what is shuffled are at most COPIES of 4 bytes an edge.
    """
    spark = users.sparkSession
    every, path = stored(edges.select("source", "target"))
    graph = every.where("source <> target")
    graph = graph if directed else graph.union(graph.select("target", "source"))
    if graph.count() > held:
        delete(spark, path)
        return None
    ends = every.select(F.explode(F.array("source", "target")).alias("node")).join(users.select("node").distinct(), "node", "left_semi")
    q, n_q = _dense(ends.distinct().orderBy("node"), 0)
    q = checkpointed(q)
    leaving = graph.select(F.col("source").alias("node")).distinct().join(q, "node", "left_anti")
    rest, n = _dense(leaving, n_q)
    ids = checkpointed(q.union(rest.select(*q.columns)))
    numbered = graph.join(ids.select(F.col("node").alias("source"), F.col("id").alias("s")), "source").select("s", "target").join(ids.select(F.col("node").alias("target"), F.col("id").alias("t")), "target")
    row = "targets binary, counts binary, sources binary"
    shape = to_arrow_schema(StructType.fromDDL(row))
    piece = PIECE
    pieces = checkpointed(numbered.select(F.col("s").alias("source"), F.col("t").alias("target")).mapInArrow(lambda batches: _packed(batches, piece, shape), row))
    delete(spark, path)
    words = max(1, min(64, CELLS // max(1, n), cells // max(1, BITS * n_q)))
    tasks = max(1, min(COPIES, spark.sparkContext.defaultParallelism, -(-n_q // BITS)))
    size = -(-n_q // (tasks * BITS)) * BITS or BITS  # whole batches
    groups = spark.range(0, n_q, size).select(F.col("id").cast("int").alias("first"), F.least(F.col("id") + size, F.lit(n_q)).cast("int").alias("last"))
    names = q.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "node"))), lambda x: x["node"]).alias("names"))  # one row
    kind = dict(q.dtypes)["node"]
    heads = groups.crossJoin(F.broadcast(names)).selectExpr("first", "last", "names", *(f"cast(null AS binary) AS {c}" for c in pieces.columns))
    bodies = pieces.crossJoin(F.broadcast(groups)).selectExpr("first", "last", f"cast(null AS array<{kind}>) AS names", *pieces.columns)
    dealt = heads.union(bodies).repartitionById(tasks, F.expr(f"cast(first div {size} AS int)"))
    text = text.format(kind=kind)
    schema, k = to_arrow_schema(StructType.fromDDL(text)), pieces.count()
    return dealt.mapInArrow(lambda batches: kernel(batches, k, n, words, schema=schema), text), n_q


def shortest_paths(users: DataFrame, edges: DataFrame, directed: bool = True, drop_self: bool = True, drop_unreachable: bool = False, hub: int = HUB, most: int = EXPAND, held: int = 0) -> DataFrame:
    """source, target, distance between all users (column node) that are in the graph; -1 out of reach. A batch of sources meets a target as one row, and pairs are not shuffled. At most `held` edges are held by each task, which then makes the levels of its searches by itself."""
    if held and (own := _held(users, edges, directed, held, partial(_pairs_found, drop_self=drop_self, drop_unreachable=drop_unreachable), FAR, "source {kind}, target {kind}, distance int")):
        return own[0]
    q, found = _levels(users, edges, directed, hub, most)
    levels = found.groupBy("target", "batch").agg(F.collect_list(F.struct("distance", "mask")).alias("levels"))
    sources = q.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("id", F.col("node").alias("source")))).alias("sources"))
    every = sources.crossJoin(q.select(F.col("node").alias("target"))).join(levels, ["target", "batch"], "left")  # the result has all pairs
    each = every.select("target", "levels", F.explode("sources").alias("s"))
    far = F.expr(f"coalesce(get(filter(levels, l -> (shiftright(l.mask, cast(s.id % {BITS} as int)) & 1L) <> 0), 0).distance, -1)")
    out = each.select(F.col("s.source").alias("source"), "target", far.alias("distance"))
    if drop_unreachable:
        out = out.where("distance >= 0")
    return out.where("source <> target") if drop_self else out


def summary_of_paths(users: DataFrame, edges: DataFrame, directed: bool = True, hub: int = HUB, most: int = EXPAND, held: int = 0) -> DataFrame:
    """path_summary() of shortest_paths(), from the bits of the searches: no pair is made."""
    if held and (own := _held(users, edges, directed, held, _counts_found, FAR * BITS, "distance int, n long")):
        counts, n_q = own
        n, q = counts.where("distance > 0").groupBy("distance").agg(F.sum("n").alias("n")).where("n > 0"), users.sparkSession.range(n_q)
    else:
        q, found = _levels(users, edges, directed, hub, most)
        n = found.where("distance > 0").groupBy("distance").agg(F.sum(F.bit_count("mask")).alias("n"))
    reached = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reachable"), (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("mean"), F.max("distance").alias("max"))
    return q.agg((F.count("*") * (F.count("*") - 1)).alias("pairs")).crossJoin(reached)  # one row each


def path_summary(paths: DataFrame) -> DataFrame:
    """One row of shortest_paths()'s table: pairs, those within reach, and their mean and largest distance."""
    reached = F.when(F.col("distance") >= 0, F.col("distance"))
    return paths.agg(F.count("*").alias("pairs"), F.count(reached).alias("reachable"), F.avg(reached).alias("mean"), F.max(reached).alias("max"))


def rings(ego: DataFrame, edges: DataFrame, n_hops: int = 3, max_frontier: int | None = None, seed: int = 42) -> DataFrame:
    """node and hop of the followed at each exact distance from ego (column node). Rings are whole; only the front that is expanded may be a sample."""
    graph = checkpointed(load(edges, directed=True))
    seen = checkpointed(ego.select("node", F.lit(0).alias("hop")))
    front = seen.select("node")
    for k in range(1, n_hops + 1):
        if max_frontier is not None:
            front = front.orderBy(draw_key(seed, "node"), "node").limit(max_frontier)
        reached = front.join(graph, front.node == graph.source).select(F.col("target").alias("node")).distinct()
        ring = checkpointed(reached.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k)))  # the next ring reads it twice
        seen, front = seen.union(ring), ring.select("node")
    return seen.where("hop > 0")
