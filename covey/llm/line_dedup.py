"""Line dedup: line hashes in one global order, streamed; drops come back as compressed bitmaps.

Hashes of long lines are range-partitioned by (hash, document) and sorted by (hash, document
descending, position), so that the document that keeps a line comes first in the line's run. A line
that very many documents share is cut into several ranges like any other rows. A first pass over the
sorted ranges returns the two runs at the edges of each range (two rows for each partition); with these
totals the second pass decides every run as it streams by. Text is never shuffled to find the drops:
what returns to the documents is one compressed keep bitmap for each document that loses lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import Filter, Staged, cut, documents, numbered, own, parts, pieces, place, staged, text_of

#: Fixed by the contract: white space, code points of a key at least, documents that hold it at least.
BLANKS, LONG, SHARED = b" \t\n\x0b\x0c\r", 40, 5
_LINE = "hash binary, id_null boolean, doc_id long, row_hash long, pos int, n_lines int"


def line_key(line: bytes) -> bytes:
    """Stripped of white space, A-Z lower-cased (bytes.lower() leaves all else alone)."""
    return line.strip(BLANKS).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or sum((b & 0xC0) != 0x80 for b in key) >= least)


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out = [], [], [], [], [], []
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist()
        for doc_id, row, text in zip(ids, rows, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            lines = text.split(b"\n")
            for pos, line in enumerate(lines):
                if len(line) >= least and _long(key := line_key(line), least):
                    for column, x in zip(out, (xxhash.xxh3_128_digest(key), doc_id is None, doc_id or 0, row, pos, len(lines)), strict=True):
                        column.append(x)
        kinds = (pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["hash", "id_null", "doc_id", "row_hash", "pos", "n_lines"])


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and documents of a sorted batch as arrays, where hashes begin, where documents begin."""
    hashes = np.frombuffer(b"".join(batch.column("hash").to_pylist()), dtype="S16") if batch.num_rows else np.empty(0, "S16")
    pair = np.frombuffer(hashes.tobytes(), np.uint64).reshape(-1, 2)
    ids, none = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("id_null").to_numpy(zero_copy_only=False)
    new = np.ones(len(ids), bool)
    new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
    doc = new.copy()
    doc[1:] |= (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
    return pair, ids, np.flatnonzero(new), np.flatnonzero(doc)


class _Stream:
    """Joins batches of one sorted partition so that every run comes whole; its length is bounded by what one range holds."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            column = batch.column("hash")
            last = column[batch.num_rows - 1].as_py()
            if held and held[-1].column("hash")[-1].as_py() == last:
                held.append(batch)  # the run goes on
                continue
            start = batch.num_rows - 1
            while start and column[start - 1].as_py() == last:
                start -= 1
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        if held:
            yield pa.Table.from_batches(held)


def _count(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """A batch of whole runs; starts of its runs, documents in each, and each row's run."""
    batch = table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
    _, _, runs, docs = _runs(batch)
    counts = np.bincount(np.searchsorted(runs, docs, "right") - 1, minlength=len(runs)) if len(runs) else np.empty(0, int)
    of = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, batch.num_rows)))
    return batch, runs, counts, of


_EDGE = "hash binary, docs long, id_null boolean, top long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    for table in _Stream(batches):
        batch, runs, counts, _ = _count(table)
        for k in {0, len(runs) - 1} if len(runs) else ():
            last = (batch.column("hash")[int(runs[k])].as_py(), int(counts[k]), batch.column("id_null")[int(runs[k])].as_py(), batch.column("doc_id")[int(runs[k])].as_py())
            first = first or (last if k == 0 else None)
    found = list({x[0]: x for x in (first, last) if x}.values())
    kinds = (pa.binary(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["hash", "docs", "id_null", "top"])


def _drops(batches: Iterator[pa.RecordBatch], edges: dict, shared: int) -> Iterator[pa.RecordBatch]:
    for table in _Stream(batches):
        batch, runs, counts, of = _count(table)
        if not len(runs):
            continue
        ids, none = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "id_null"))
        tops, top_none = ids[runs].copy(), none[runs].copy()
        counts = counts.copy()
        hashes = batch.column("hash")
        for k in {0, len(runs) - 1}:
            counts[k], top_none[k], tops[k] = edges.get(hashes[int(runs[k])].as_py(), (counts[k], top_none[k], tops[k]))
        gone = (counts[of] >= shared) & ((ids != tops[of]) | (none != top_none[of]))
        yield batch.select(["id_null", "doc_id", "row_hash", "pos", "n_lines"]).filter(pa.array(gone))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, drops in zip(batch.column("n_lines").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[drops] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id_null", "doc_id", "row_hash", "n_lines")), pa.array(maps, pa.binary())], ["id_null", "doc_id", "row_hash", "n_lines", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, least: int = LONG, shared: int = SHARED) -> DataFrame:
    """One row for each document that loses lines: id_null, doc_id, row_hash, n_lines, keep_bitmap.

    keep_bitmap is a zlib-compressed bit for each line, the first in the highest bit. row_hash tells rows
    of one doc_id with different texts apart; such rows count as one document, and equal ones share a
    bitmap. A null doc_id counts as one document that is smaller than all others.
    """
    spark, held = docs.sparkSession, Staged()
    rows = own(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).withColumn("row_hash", F.xxhash64("text"))
    lines = staged(rows.mapInArrow(lambda b: _lines(b, least), _LINE), "lines", held)  # read twice: for the bounds of the ranges, and to deal the rows out
    key = ("hash", "id_null", F.desc("doc_id"))
    order = cut(lines.repartitionByRange(parts(spark), *key).sortWithinPartitions(*key, "row_hash", "pos"))
    held.delete(spark)
    found: dict[bytes, list] = defaultdict(list)
    for e in order.mapInArrow(_edges, _EDGE).collect():  # two rows for each partition
        found[bytes(e["hash"])].append((e["docs"], e["id_null"], e["top"]))
    edges = {h: (sum(n for n, _, _ in x), *min(((none, -top) for _, none, top in x))) for h, x in found.items()}
    edges = {h: (n, none, -top) for h, (n, none, top) in edges.items()}
    drops = order.mapInArrow(lambda b: _drops(b, edges, shared), "id_null boolean, doc_id long, row_hash long, pos int, n_lines int")
    lists = drops.groupBy("id_null", "doc_id", "row_hash", "n_lines").agg(F.collect_set("pos").alias("drops"))
    return lists.mapInArrow(_pack, "id_null boolean, doc_id long, row_hash long, n_lines int, keep_bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and the text that stays."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    left = [x for x, k in zip(lines, keep, strict=True) if k]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with columns numbered as by numbered(), and __bitmap: null where a document keeps all its lines.

    Only documents that may lose lines, by a filter of bounded size, are shuffled to meet their bitmaps.
    """
    maps = staged(bitmaps.toDF("__null", "__id", "__hash", "__lines", "__bitmap").drop("__lines"), "bitmaps")
    doc_id, text = (F.col(f"c{place(docs, n)}") for n in ("doc_id", "text"))
    marked = Filter(maps.select(F.xxhash64("__id").alias("h"))).asked(numbered(docs), F.xxhash64(F.coalesce(doc_id, F.lit(0)).cast("long")), "__maybe")
    on = (doc_id.isNull() == F.col("__null")) & (F.coalesce(doc_id, F.lit(0)) == F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__hash"))
    met = marked.where("__maybe").join(maps.hint("shuffle_hash"), on, "left").drop("__null", "__id", "__hash", "__maybe")
    return met.unionByName(marked.where("NOT __maybe").drop("__maybe").withColumn("__bitmap", F.lit(None).cast("binary")))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [kept_lines(*x) for x in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__bitmap").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, name):
        texts, maps = batch.column(name).cast(pa.binary()).to_pylist(), batch.column("__bitmap").to_pylist()
        new = [t if t is None else kept_lines(t, m)[2] for t, m in zip(texts, maps, strict=True)]
        at = batch.schema.get_field_index(name)
        yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(pa.string())).select([c for c in batch.schema.names if c != "__bitmap"])


def line_dedup(docs: DataFrame, least: int = LONG, shared: int = SHARED) -> DataFrame:
    """docs with the repeated lines taken out of text; all rows and other columns stay.

    Of a line in at least `shared` documents only the largest doc_id keeps its copies, all of them (there
    are no ties: rows of one doc_id are one document, and each of them keeps the line).
    Nulls: a null text stays null, one null doc_id is the smallest document. Empty texts: one empty line.
    Very long texts: read whole; a worker holds one at a time. Repeated rows: all stay, and lose the same
    lines. Empty table: empty result. Other columns: kept, whatever their names. docs is read more than
    once and must give the same rows each time (a table or a checkpoint).
    """
    marked = with_bitmaps(docs, keep_bitmaps(docs, least, shared))
    name = f"c{place(docs, 'text')}"
    return marked.mapInArrow(lambda b: _texts(b, name), numbered(docs).schema).toDF(*docs.columns)


def digests(docs: DataFrame, least: int = LONG, shared: int = SHARED) -> DataFrame:
    """What line_dedup() leaves of each row of docs: doc_id, n_lines, n_dropped, kept_sha256. A null text is one empty line."""
    docs = own(docs, "doc_id", "text")
    marked = with_bitmaps(docs, keep_bitmaps(docs, least, shared)).select(F.col("c0").alias("doc_id"), F.coalesce("c1", F.lit("")).alias("text"), "__bitmap")
    return marked.mapInArrow(_answers, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op1_line_dedup(spark, sf_dir):
    return digests(documents(spark, sf_dir))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, g.top IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
