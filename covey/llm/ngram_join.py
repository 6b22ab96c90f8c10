"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), down to connected components.

1. Every document becomes the set of its 5-word shingles, as hashes of 48 bits within a bucket. Sets are
   dealt out by bucket, several buckets to a partition, and a task streams its buckets in order, one in
   memory at a time. A bucket sees all holders of its shingles, leaves one holder of each set of equal
   documents, and sends back only shingles that at least two different sets hold. A document of which
   fewer than T = ceil(0.8 n) shingles come back can link with nothing and needs no search.
2. The shingles of the rest are ordered from rare to common. Two documents that link share one of the
   first n - T + 1, so chaining the holders of each such shingle in order of size, where neighbours are
   near enough in size, puts every link inside one block.
3. Within a block (cut into chunks of bounded size, by size of the sets) inverted lists are built. A document searches for
   those that share at least T shingles with it: the longest lists are set aside, the others are merged
   with a heap that skips ahead (or counted at once, where they hold many), and what is found often enough is
   looked up in the long lists by binary search (many documents in one count). Documents of one component need not be compared, and any link between two components
   has an end outside the largest one, so only documents outside it search.
4. Where a block has several chunks, its documents outside its largest component search the others whose
   sets are of sizes near enough.

All links between different texts count; none is left out, and no group is expanded into its pairs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import Filter, cut, documents, numbered, own, parts, pieces, place, staged, text_of
from covey.llm.components import components

#: Words of a shingle; fixed by the contract, as is the threshold of 0.8 (4 parts of 5) below.
SIZE = 5
#: Shingles that a chunk of a block may hold, shingles sorted at once in a bucket, words whose hashes are kept.
CHUNK, AT_ONCE, WORDS_KEPT = 1_000_000, 1_000_000, 200_000
#: Logarithm of the sizes in a class: partners, of 0.8 to 1.25 times a size, are at most two classes away. Parts of a class at most.
CLASS, PARTS = 0.1133, 1 << 40
#: Buckets of a partition; documents whose links a task remembers.
FINE, KNOWN = 2, 1_000_000
#: Leaders that a chunk is held against before the search, and the weight of a list's length in DivideSkip.
LEADERS, MU = 4, 0.01
#: Entries of short lists beyond which they are counted at once, and documents found beyond which the long ones are.
SCAN, FEW = 2000, 8
_LOW = np.uint64((1 << 48) - 1)


def least_shared(n: int) -> int:
    """T: shingles that a partner of a set of n must share."""
    return (4 * n + 4) // 5


def linked(shared, n, m):
    """100 * intersection >= 80 * union."""
    return 9 * shared >= 4 * (n + m)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], buckets: int, known: _Hashes, size: int = SIZE) -> list[np.ndarray]:
    """The set of each text as sorted numbers: bucket << 48 | 48 bits of hash."""
    words = [t.lower().split() for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(lens.sum()))
    codes = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        codes = (codes ^ flat[k : k + len(codes)]) * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(31)
    out, at = [], 0
    for ws, n in zip(words, lens.tolist(), strict=True):
        if n >= size:
            own = codes[at : at + n - size + 1]
        elif n:
            own = np.array([xxhash.xxh3_64_intdigest(b"\0".join(ws), seed=n)], np.uint64)
        else:
            own = np.empty(0, np.uint64)
        own = (((own >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(48)) | (own * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16))
        out.append(np.unique(own))
        at += n
    return out


def _six(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray((codes & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(data: bytes, bucket: int) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8") | np.uint64(bucket << 48)


#: Dealt rows: where to, which batch, which bucket (-1: the batch's own row), documents of the batch that are in it (or their ids and keys), their set digests, shingles.
_DEALT = "to int, batch binary, bucket int, docs binary, marks binary, counts binary, codes binary"
_ROW = pa.schema([("to", pa.int32()), ("batch", pa.binary()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "marks", "counts", "codes"))])


def _buckets(keys: list[int]) -> int:
    return min(FINE * len(keys), (1 << 16) - 1)


def _deal(sets: list[np.ndarray], marks: np.ndarray, batch: bytes, keys: list[int]) -> list[tuple]:
    """A row for each bucket that has shingles of the batch; buckets take turns over the partitions."""
    lens = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets), dtype=np.int64), lens)
    bucket = (flat >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, flat = bucket[order], doc[order], flat[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
    rows = []
    for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
        own, counts = np.unique(doc[a:b], return_counts=True)
        k = int(bucket[a])
        rows.append((keys[k % len(keys)], batch, k, own.astype("<u4").tobytes(), marks[own].tobytes(), counts.astype("<u4").tobytes(), _six(flat[a:b])))
    return rows


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ROW)], schema=_ROW)


def _documents(batches: Iterator[pa.RecordBatch], keys: list[int], size: int) -> Iterator[pa.RecordBatch]:
    known, part = _Hashes(), TaskContext.get().partitionId()
    for k, batch in enumerate(pieces(batches)):
        ids = batch.column("doc_id")
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), _buckets(keys), known, size)
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "S16")
        # by place too, since batches of repeated rows are equal
        name = xxhash.xxh3_128_digest(b"%d|%d|" % (part, k) + b"".join(xxhash.xxh3_128_digest(repr(x).encode()) for x in ids.to_pylist()) + prints.tobytes())
        rows = _deal(sets, np.frombuffer(prints.tobytes(), "<u8").reshape(-1, 2)[:, 0].copy(), name, keys)
        values = np.array([-1 if x is None else x for x in ids.to_pylist()], "<i8").tobytes() + batch.column("key").to_numpy().astype("<i8").tobytes() + np.array([x is None for x in ids.to_pylist()], np.uint8).tobytes()
        sizes = np.array([len(s) for s in sets], "<u4").tobytes()
        own = (keys[name[0] % len(keys)], name, -1, values, prints.tobytes(), sizes, len(rows).to_bytes(4, "little"))
        yield _rows([*rows, own])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of sorted batches, those of one key together."""
    held: list[dict] = []
    for batch in pieces(batches, "codes"):
        for r in batch.to_pylist():
            if held and held[0][key] != r[key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _slices(rows: list[dict], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and their holders (row << 32 | place in the row's documents), one range of shingles after another."""
    total = sum(len(r["codes"]) // 6 for r in rows)
    cuts = -(-total // at_once)
    for part in range(cuts):
        low, high = (part << 48) // cuts, ((part + 1) << 48) // cuts
        codes, holders = [], []
        for k, r in enumerate(rows):
            own = _eight(r["codes"], r["bucket"])
            who = np.repeat(np.arange(len(r["counts"]) // 4, dtype=np.uint64), np.frombuffer(r["counts"], "<u4"))
            if cuts > 1:
                at = ((own & _LOW) >= np.uint64(low)) & ((own & _LOW) < np.uint64(high))
                own, who = own[at], who[at]
            codes.append(own)
            holders.append(who | np.uint64(k << 32))
        yield np.concatenate(codes), np.concatenate(holders)


def _shared(batches: Iterator[pa.RecordBatch], keys: list[int], at_once: int) -> Iterator[pa.RecordBatch]:
    """For each row of a bucket: its shingles held by at least two different sets, with a class of how many (counts: one byte each)."""
    for own in _runs(batches, "bucket"):  # sorted by batch too: a batch is before another in all buckets alike
        bucket = own[0]["bucket"]
        if bucket < 0:
            yield _rows([(keys[r["batch"][0] % len(keys)], r["batch"], -1, r["docs"], r["marks"], r["counts"], r["codes"]) for r in own])
            continue
        marks = [np.frombuffer(r["marks"], "<u8") for r in own]
        docs = [np.frombuffer(r["docs"], "<u4") for r in own]
        kept: list[list] = [[] for _ in own]
        for codes, holders in _slices(own, at_once):
            order = np.argsort(codes, kind="stable")
            codes, holders = codes[order], holders[order]
            new = np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.empty(0, bool)
            single = new & np.r_[new[1:], True] if len(codes) else new
            codes, holders = codes[~single], holders[~single]
            row, place = (holders >> np.uint64(32)).astype(np.int64), (holders & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.cumsum([0, *(len(m) for m in marks)])
            mark = np.concatenate(marks)[starts[row] + place]
            order = np.lexsort((mark, codes))  # stable: the first of equal sets is the same one in every bucket
            codes, mark, row, place = codes[order], mark[order], row[order], place[order]
            if not len(codes):
                continue
            fresh = np.r_[True, (codes[1:] != codes[:-1]) | (mark[1:] != mark[:-1])]
            codes, row, place = codes[fresh], row[fresh], place[fresh]
            begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            held = np.repeat(np.diff(np.append(begin, len(codes))), np.diff(np.append(begin, len(codes))))
            several = held > 1
            codes, row, place, grade = codes[several], row[several], place[several], np.minimum(255, 4 * np.log2(held[several])).astype(np.uint8)
            order = np.argsort(row, kind="stable")
            codes, row, place, grade = codes[order], row[order], place[order], grade[order]
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, int)
            for a, b in zip(begin, np.append(begin[1:], len(row)), strict=False):
                k = int(row[a])
                kept[k].append((docs[k][place[a:b]], codes[a:b], grade[a:b]))
        for r, found in zip(own, kept, strict=True):
            who, codes, grade = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64) for i in range(3))
            yield _rows([(keys[r["batch"][0] % len(keys)], r["batch"], bucket, who.astype("<u4").tobytes(), None, grade.astype(np.uint8).tobytes(), _six(codes.astype(np.uint64)))])


#: rank: shingles of a document that may take part in a link, rare ones first; null if it cannot link.
_MEMBER = "doc_id long, key long, print binary, n int, rank binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, "batch"):
        own = next(r for r in rows if r["bucket"] < 0)
        rest = [r for r in rows if r["bucket"] >= 0]
        if len(rest) != int.from_bytes(own["codes"], "little"):
            raise RuntimeError("a batch of documents came back in part; its source must give the same rows each time it is read")
        sizes = np.frombuffer(own["counts"], "<u4").astype(np.int64)
        (ids, texts), none = np.frombuffer(own["docs"][: 16 * len(sizes)], "<i8").reshape(2, -1), np.frombuffer(own["docs"][16 * len(sizes) :], np.uint8)
        who = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(r["docs"], "<u4") for r in rest)]).astype(np.int64)
        codes = np.concatenate([np.empty(0, np.uint64), *(_eight(r["codes"], r["bucket"]) for r in rest)])
        grade = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(r["counts"], np.uint8) for r in rest)])
        count = np.bincount(who, minlength=len(sizes))
        alive = (count >= (4 * sizes + 4) // 5) & (sizes > 0)
        at = alive[who]
        who, codes, grade = who[at], codes[at], grade[at]
        order = np.lexsort((codes, grade, who))
        codes = codes[order]
        ends = np.cumsum(np.bincount(who, minlength=len(sizes)))
        ranks = [codes[b - c : b].astype("<u8").tobytes() if live else None for b, c, live in zip(ends.tolist(), count.tolist(), alive.tolist(), strict=True)]
        prints = [own["marks"][16 * k : 16 * k + 16] for k in range(len(sizes))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if z else x for x, z in zip(ids.tolist(), none.tolist(), strict=True)], pa.int64()), pa.array(texts, pa.int64()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(ranks, pa.binary())],
            ["doc_id", "key", "print", "n", "rank"],
        )


def _prefixes(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes = batch.column("node").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        ranks = [np.frombuffer(r, "<u8") for r in batch.column("rank").to_pylist()]
        firsts = [r[: len(r) - least_shared(int(n)) + 1] for r, n in zip(ranks, sizes, strict=True)]
        marks = np.empty((len(nodes), 2), "<i8")
        marks[:, 0], marks[:, 1] = nodes, sizes
        yield _rows(_deal(firsts, marks, b"", keys))


def _find(up: dict, x):
    while up.setdefault(x, x) != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _union(up: dict, x, y) -> bool:
    x, y = _find(up, x), _find(up, y)
    if x != y:
        up[max(x, y)] = min(x, y)
    return x != y


_LINK = "a long, b long"


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _chains(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """A forest that connects the holders of each shingle whose sizes, put in order, are near enough."""
    up: dict[int, int] = {}
    for own in _runs(batches, "bucket"):
        if len(up) > KNOWN:
            up.clear()  # links known before may come again
        marks = np.concatenate([np.frombuffer(r["marks"], "<i8").reshape(-1, 2) for r in own])
        starts = np.cumsum([0, *(len(r["marks"]) // 16 for r in own)])
        for codes, holders in _slices(own, at_once):
            at = starts[(holders >> np.uint64(32)).astype(np.int64)] + (holders & np.uint64(0xFFFFFFFF)).astype(np.int64)
            node, n = marks[at, 0], marks[at, 1]
            order = np.lexsort((node, n, codes))
            codes, node, n = codes[order], node[order], n[order]
            near = (codes[1:] == codes[:-1]) & (5 * n[:-1] >= 4 * n[1:]) & (node[1:] != node[:-1])
            pairs = np.unique(np.stack([node[:-1][near], node[1:][near]], axis=1), axis=0)
            yield _links([(a, b) for a, b in pairs.tolist() if _union(up, a, b)])


class Lists:
    """Inverted lists of a chunk's documents, which are numbered by size."""

    def __init__(self, sizes: np.ndarray, ranks: list[np.ndarray]):
        self.sizes, lens = sizes, np.array([len(r) for r in ranks], np.int64)
        flat = np.concatenate([np.empty(0, np.uint64), *ranks])
        self.vocabulary, self.flat = np.unique(flat, return_inverse=True)
        self.starts = np.r_[0, np.cumsum(lens)]
        holders = np.repeat(np.arange(len(ranks)), lens)[np.argsort(self.flat, kind="stable")]
        self.begin = np.r_[0, np.cumsum(np.bincount(self.flat, minlength=len(self.vocabulary)))]
        self.holders, self.lists = holders, {}

    def shared(self, rank: np.ndarray) -> np.ndarray:
        """Shingles that each document shares with a set."""
        at = np.searchsorted(self.vocabulary, rank)
        at = at[(at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == rank)]
        mask = np.zeros(len(self.vocabulary), np.int64)
        mask[at] = 1
        sums = np.r_[0, np.cumsum(mask[self.flat])]
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def of(self, term: int) -> list[int]:
        if term not in self.lists:
            self.lists[term] = self.holders[self.begin[term] : self.begin[term + 1]].tolist()
        return self.lists[term]

    def search(self, rank: np.ndarray, n: int, skip) -> Iterator[int]:
        """DivideSkip: documents that link with a set of n shingles, but for those that skip() tells apart.

        rank holds the shingles of the set that others may share; T of them must be shared.
        """
        low, high = np.searchsorted(self.sizes, least_shared(n)), np.searchsorted(self.sizes, 5 * n // 4, "right")
        at = np.searchsorted(self.vocabulary, rank)
        at = at[(at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == rank)]
        need = least_shared(n)
        if len(at) < need or low >= high:
            return
        lens = self.begin[at + 1] - self.begin[at]
        order = np.argsort(-lens, kind="stable")
        n_long = min(need - 1, int(need / (MU * np.log2(max(2, int(lens.max()))) + 1)))
        long, short = at[order[:n_long]], at[order[n_long:]]
        sizes = self.sizes
        if lens[order[n_long:]].sum() > SCAN:
            shared = self._occurrences(short)
            found = np.flatnonzero(shared[low:high] >= need - n_long) + low
            if len(found) > FEW:  # the long lists of all at once
                shared += self._occurrences(long)
                yield from (doc for doc in found[shared[found] >= -(-4 * (n + sizes[found]) // 9)].tolist() if not skip(doc))
                return
            merged = zip(found.tolist(), shared[found].tolist(), strict=True)
        else:
            merged = _merged([self.of(int(t)) for t in short], int(low), int(high), need - n_long)
        for doc, count in merged:
            if skip(doc):
                continue
            wanted, left = -(-4 * (n + int(sizes[doc])) // 9), len(long)
            for term in long:  # binary probes, until the outcome is certain
                if count >= wanted or count + left < wanted:
                    break
                postings = self.of(int(term))
                k = bisect_left(postings, doc)
                count += k < len(postings) and postings[k] == doc
                left -= 1
            if count >= wanted:
                yield doc

    def _occurrences(self, terms: np.ndarray) -> np.ndarray:
        """In how many of these lists each document is."""
        return np.bincount(np.concatenate([np.empty(0, np.int64), *(self.holders[self.begin[t] : self.begin[t + 1]] for t in terms)]), minlength=len(self.sizes))


def _merged(lists: list[list[int]], low: int, high: int, least: int) -> Iterator[tuple[int, int]]:
    """Heap merge: numbers in [low, high) that at least `least` lists hold, with how many do; lists that cannot matter skip ahead."""
    at = [bisect_left(x, low) for x in lists]
    heap = [(x[k], i) for i, (x, k) in enumerate(zip(lists, at, strict=True)) if k < len(x) and x[k] < high]
    heapq.heapify(heap)

    def push(i: int, k: int) -> None:
        at[i] = k
        if k < len(lists[i]) and lists[i][k] < high:
            heapq.heappush(heap, (lists[i][k], i))

    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            for i in popped:
                push(i, at[i] + 1)
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            return
        goal = heap[0][0]  # whatever is before it is in fewer than `least` lists
        for i in popped:
            push(i, bisect_left(lists[i], goal, at[i]))


def chunk_links(nodes: list[int], sizes: list[int], ranks: list[np.ndarray], asked: list[bool] | None = None, pivot: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what a chunk's links connect. asked: documents that search; without it, all that are outside the largest component."""
    order = sorted(range(len(nodes)), key=lambda k: (sizes[k], nodes[k]))
    nodes, ranks, size = [nodes[k] for k in order], [ranks[k] for k in order], np.array([sizes[k] for k in order], np.int64)
    lists, up, found = Lists(size, ranks), {}, []
    count = dict.fromkeys(range(len(nodes)), 1)

    def join(a: int, b: int) -> None:
        x, y = _find(up, a), _find(up, b)
        if x != y:
            _union(up, x, y)
            count[min(x, y)] = count.pop(x) + count.pop(y)
            found.append((nodes[a], nodes[b]))

    def lead(k: int) -> None:
        for other in np.flatnonzero(linked(lists.shared(ranks[k]), size[k], size)).tolist():
            join(k, other)

    if asked is None:
        leader = nodes.index(pivot) if pivot in nodes else len(nodes) // 2
        for _ in range(LEADERS):
            lead(leader)
            if len(count) == 1:
                break
            leader = next((k for k in range(len(nodes) // 2, -1, -1) if count.get(_find(up, k)) == 1), None)
            if leader is None:
                break
    else:
        asked = [asked[k] for k in order]
    home = max(count, key=lambda r: (count[r], -r))  # in the largest component so far
    for k in range(len(nodes)):
        if len(count) == 1:
            break
        if asked[k] if asked is not None else _find(up, k) != _find(up, home):
            for other in lists.search(ranks[k], int(size[k]), lambda d, k=k: _find(up, d) == _find(up, k)):
                join(k, other)
    return found


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come sorted, one after another."""
    held: list[dict] = []

    def done() -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        ranks = [np.frombuffer(r["rank"], "<u8") for r in held]
        asked = [r["role"] == 2 for r in held] if any(r["role"] == 2 for r in held) else None
        return chunk_links([r["node"] for r in held], [r["n"] for r in held], ranks, asked, held[0]["block"])

    for batch in batches:
        found = []
        for r in batch.to_pylist():
            if held and (held[-1]["block"], held[-1]["chunk"]) != (r["block"], r["chunk"]):
                found += done()
                held.clear()
            held.append(r)
        yield _links(found)
    yield _links(done())


def _search(rows: DataFrame, n: int) -> DataFrame:
    rows = rows.select("block", "chunk", "node", "n", "rank", "role")
    return rows.repartition(n, "block", "chunk").sortWithinPartitions("block", "chunk", "role", "node").mapInArrow(_searched, _LINK)


def _keys(spark, n: int) -> list[int]:
    """An int for each of n partitions that hash partitioning sends there."""
    found: dict[int, int] = {}
    step = 16 * n
    start = 0
    while len(found) < n:
        ids = spark.range(start, start + step, 1, 1).select(F.col("id").cast("int").alias("k"))
        for k, p in ids.select("k", F.pmod(F.hash("k"), F.lit(n))).collect():
            found.setdefault(p, k)
        start += step
    return [found[p] for p in range(n)]


def near_groups(docs: DataFrame, size: int = SIZE, chunk: int = CHUNK, at_once: int = AT_ONCE) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Nulls and empty texts: null and empty texts, and texts without words, have no shingles and link with
    nothing; a null doc_id is a component_id only where the component has no other. A text with fewer
    words than a shingle is one shingle. Very long texts: read whole; a worker holds one at a time.
    Ties and repeated rows: equal sets link, and rows of one doc_id are rows of their own. Empty table:
    empty result. Other columns are ignored, whatever their names. docs must give the same rows whenever
    it is read (a table, or a checkpoint).
    """
    grouped = _grouped(docs, size, chunk, at_once)
    least = cut(grouped.groupBy("group").agg(F.min("doc_id").alias("component_id")))  # with a shuffle of its own on either side, a large group can be split
    return grouped.join(least, "group").select("doc_id", "n_shingles", "component_id")


def _key(name: str = "text"):
    """A hash of the text, which tells rows of one doc_id apart."""
    return F.xxhash64(text_of(name))


def _grouped(docs: DataFrame, size: int = SIZE, chunk: int = CHUNK, at_once: int = AT_ONCE) -> DataFrame:
    """One row for each row of docs: doc_id, key, n_shingles, group (its component)."""
    spark = docs.sparkSession
    n = min(parts(spark), 1 << 15)
    keys = _keys(spark, n)
    texts = own(docs, "doc_id", "text").select("doc_id", text_of().alias("text"), _key().alias("key"))
    dealt = texts.mapInArrow(lambda b: _documents(b, keys, size), _DEALT)
    back = dealt.repartition(n, "to").sortWithinPartitions("bucket", "batch").mapInArrow(lambda b: _shared(b, keys, at_once), _DEALT)
    members = back.repartition(n, "to").sortWithinPartitions("batch", "bucket").mapInArrow(_members, _MEMBER)
    members = staged(members.withColumn("node", F.monotonically_increasing_id()), "members")
    alive = members.where("rank IS NOT NULL").select("node", "n", "rank")

    chains = alive.mapInArrow(lambda b: _prefixes(b, keys), _DEALT).repartition(n, "to").sortWithinPartitions("bucket").mapInArrow(lambda b: _chains(b, at_once), _LINK)
    roots = components(chains)
    blocks = roots.union(roots.select("root", "root").distinct()).toDF("node", "block")
    sizes = alive.select("node", (F.length("rank") / 8).cast("long").alias("held"), F.floor(F.ln("n") / F.lit(CLASS)).cast("long").alias("class"))
    placed = _placed(blocks.join(sizes, "node"), chunk)
    rows = placed.join(alive, "node").withColumn("role", F.lit(1))
    several = placed.where("chunks > 1")
    wide = not several.isEmpty()
    if wide:  # the block's first document goes to all its chunks
        pivots = several.where("node = block").select("node", "block", F.col("chunk").alias("home"))
        pivots = pivots.join(_chunks_of(several).select("block", "chunk"), "block").where("chunk <> home").select("node", "block", "chunk")
        rows = rows.select("node", "block", "chunk", "n", "rank", "role").unionByName(pivots.join(alive, "node").withColumn("role", F.lit(0)))
    links = cut(_search(rows, n))
    if wide:
        links = cut(links.union(_between(several, alive, links, n)))
    return _answer(members, components(links))


def _placed(blocks: DataFrame, chunk: int) -> DataFrame:
    """node, block, chunks, class and chunk. blocks: node, block, held, class.

    A block of more than `chunk` shingles is cut by classes of size, and a class of more by hash: chunk is the
    class and the part of it.
    """
    parts = blocks.groupBy("block", "class").agg(F.sum("held").alias("held"))
    chunks = parts.groupBy("block").agg(F.ceil(F.sum("held") / F.lit(chunk)).alias("chunks"))
    cuts = parts.join(chunks, "block").select("block", "class", "chunks", F.when(F.col("chunks") > 1, F.ceil(F.col("held") / F.lit(chunk))).otherwise(F.lit(1)).alias("cuts"))
    part = F.when(F.col("chunks") > 1, F.col("class") * PARTS + F.pmod(F.xxhash64("node"), "cuts")).otherwise(F.lit(0))
    return cut(blocks.join(cuts, ["block", "class"]).select("node", "block", "chunks", "class", part.cast("long").alias("chunk")))


def _chunks_of(several: DataFrame) -> DataFrame:
    return several.select("block", "class", "chunk").distinct()


def _between(several: DataFrame, alive: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Links between chunks: a block's documents outside its largest component search its other chunks of sizes near enough."""
    found = several.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = found.groupBy("block", "root").agg(F.count("*").alias("members"))
    largest = counts.groupBy("block").agg(F.max(F.struct("members", "root")).alias("top")).select("block", F.col("top.root").alias("top"))
    outside = found.join(largest, "block").where("root <> top")
    near = F.explode(F.sequence(F.col("class") - 2, F.col("class") + 2)).alias("class")
    asking = outside.select("node", "block", F.col("chunk").alias("home"), near).join(_chunks_of(several), ["block", "class"]).where("chunk <> home").select("node", "block", "chunk")
    rows = several.select("node", "block", "chunk").withColumn("role", F.lit(1)).unionByName(asking.withColumn("role", F.lit(2)))
    return _search(rows.join(alive, "node"), n)


def _answer(members: DataFrame, roots: DataFrame) -> DataFrame:
    own = members.select("doc_id", "key", "print", "n", "node")
    nodes = roots.union(roots.select("root", "root").distinct()).toDF("node", "root")
    sets = members.where("rank IS NOT NULL").select("node", F.col("print").alias("p")).join(nodes, "node").select("p", "root")
    grouped = own.join(sets, (F.col("print") == F.col("p")) & (F.col("n") > 0), "left")
    group = F.when(F.col("n") == 0, F.concat(F.lit("e"), F.col("node").cast("string"))).when(F.col("root").isNotNull(), F.concat(F.lit("r"), F.col("root").cast("string"))).otherwise(F.hex("print"))
    return grouped.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), group.alias("group"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of the smallest doc_id, and where that has several texts, of one of them.

    A row without a doc_id stands for its component only if no row of it has one. Rows without shingles are
    components of their own and all stay. All columns stay, whatever their names. Only documents that may
    have to go, by a filter of bounded size, are shuffled. For the other cases see near_groups().
    """
    grouped = _grouped(docs).where("n_shingles > 0")
    firsts = cut(grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    kinds = grouped.join(firsts, "group").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.max(chosen).alias("chosen"))
    kinds = cut(kinds.where("NOT chosen OR n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__hash"), "chosen"))  # rows to leave out, and repeats of a first
    doc_id, text = (f"c{place(docs, n)}" for n in ("doc_id", "text"))
    asked = Filter(kinds.select(F.xxhash64("__id").alias("h"))).asked(numbered(docs), F.xxhash64(F.col(doc_id).cast("long")), "__maybe")
    out, keyed = asked.where("NOT __maybe").drop("__maybe"), asked.where("__maybe").drop("__maybe").withColumn("__key", _key(text))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash"))
    out = out.unionByName(keyed.join(kinds.hint("shuffle_hash"), same, "left_anti").drop("__key"))
    repeats = kinds.where("chosen")
    if not repeats.isEmpty():
        out = out.unionByName(keyed.join(repeats.hint("shuffle_hash"), same, "left_semi").dropDuplicates([doc_id, "__key"]).drop("__key"))
    return out.toDF(*docs.columns)


def op4_ngram_join(spark, sf_dir):
    return near_groups(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(other) AS root FROM c GROUP BY 1) m ON m.node = d.doc_id
"""
