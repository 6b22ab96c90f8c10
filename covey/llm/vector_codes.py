"""Vector code compression: product codes by Lloyd's rounds with Hamerly's bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own. With
every part is kept its entry, one upper bound of its distance to that entry and one lower bound of its
distance to the second nearest. When entries move, bounds give way by how far; a part is held against
all entries only where its upper bound is not strictly below its lower one (or below half the way from its
entry to the nearest other). A tie is never strictly below, so it always comes to the full integer scan,
which takes the lower index. Bounds are rounded outward, distances and sums are integers.

Every round is one pass over a staged table of vectors and bounds. The same pass writes each task's sums
for the codebooks beside its rows, so a task that is run again counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.llm.common import Staged, own, small_batches, staged

#: Fixed by the contract: parts of a vector, entries of a codebook, rounds, integers of a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The largest component, as an integer, whose squared distances are sure to fit in 64 bits.
LARGEST = 1 << 26
#: Vectors that a worker handles at once.
ROWS = 4096
_STATE = "vec_id long, label long, v array<int>, code binary, upper binary, lower binary, error long, cell int, total long"
_KINDS = {"vec_id": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int32()), "code": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "error": pa.int64(), "cell": pa.int32(), "total": pa.int64()}


def _up(x: np.ndarray) -> np.ndarray:
    """The least float32 that is surely not below the real number that x was rounded from."""
    x = np.nextafter(x, np.inf)
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    x = np.nextafter(x, -np.inf)
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; components that are too large for exact distances are an error."""
    whole = np.floor(values.astype(np.float64) * scale)
    if np.abs(whole).max(initial=0) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST / scale:g}: squared distances would not fit in 64 bits")
    return whole.astype(np.int64)


def distances(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of n parts to all entries, in integers."""
    return ((v[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


class Bounds:
    """What a round needs to know of the codebooks: how far entries have moved, and half the way to the nearest other entry."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None = None):
        self.books = books
        n = books.shape[1]
        apart = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3).astype(np.float64)
        apart[:, np.arange(n), np.arange(n)] = np.inf
        self.half = _down(np.sqrt(apart.min(axis=2)) / 2)
        moved = np.zeros(books.shape[:2]) if before is None else ((books - before) ** 2).sum(axis=2).astype(np.float64)
        self.moved = _up(np.sqrt(moved)) if before is not None else moved.astype(np.float32)
        order = np.sort(self.moved, axis=1)
        others = np.repeat(order[:, -1:], n, axis=1)  # the largest move of any other entry
        if n > 1:
            others = np.where(self.moved == order[:, -1:], order[:, -2:-1], others)
            twice = (self.moved == order[:, -1:]).sum(axis=1) > 1
            others[twice] = order[twice, -1:]
        self.others = others

    def assign(self, part: int, v: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings entries and bounds of one part position up to date, in place; returns how many parts were held against all entries."""
        book = self.books[part]
        upper[:] = _up(upper.astype(np.float64) + self.moved[part][code])
        lower[:] = _down(lower.astype(np.float64) - self.others[part][code])
        floor = np.maximum(lower, self.half[part][code])
        at = np.flatnonzero(~(upper < floor))
        if len(at):
            upper[at] = _up(np.sqrt(((v[at] - book[code[at]]) ** 2).sum(axis=1).astype(np.float64)))
            at = at[~(upper[at] < floor[at])]
        if len(at):
            d = distances(v[at], book)
            code[at] = best = d.argmin(axis=1)  # the first of equal ones
            rows = np.arange(len(at))
            upper[at] = _up(np.sqrt(d[rows, best].astype(np.float64)))
            if len(book) > 1:
                d[rows, best] = np.iinfo(np.int64).max
                lower[at] = _down(np.sqrt(d.min(axis=1).astype(np.float64)))
            else:
                lower[at] = np.inf
        return len(at)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(column: pa.Array, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)


def _bytes(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).copy()


def _emit(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, kind)) for k, kind in _KINDS.items()], list(_KINDS))


def _round(batches: Iterator[pa.RecordBatch], bounds: Bounds, scale: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One assignment of a task's vectors, raw (column embedding) or from the round before, and the task's sums: first of components, then of parts, by part, entry and place."""
    parts, entries, width = bounds.books.shape
    totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            n, raw = batch.num_rows, "embedding" in batch.schema.names
            if raw:
                v = integers(_matrix(_column(batch, "embedding"), n, parts * width), scale)
                code, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts), np.float32)
            else:
                v = _matrix(_column(batch, "v"), n, parts * width).astype(np.int64)
                code, upper, lower = _bytes(_column(batch, "code"), np.uint8, parts), _bytes(_column(batch, "upper"), np.float32, parts), _bytes(_column(batch, "lower"), np.float32, parts)
            cut = v.reshape(n, parts, width)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                bounds.assign(p, cut[:, p], code[:, p], upper[:, p], lower[:, p])
                if last:
                    error += ((cut[:, p] - bounds.books[p][code[:, p]]) ** 2).sum(axis=1)
                else:
                    for e in np.unique(code[:, p]):
                        mine = code[:, p] == e
                        totals[p, e] += cut[mine, p].sum(axis=0)
                        counts[p, e] += int(mine.sum())
            pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            ids = {"vec_id": _column(batch, "vec_id"), "label": _column(batch, "label"), "code": pack(code)}
            if last:
                yield _emit(**ids, error=pa.array(error))
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts * width, pa.int32()), pa.array(v.ravel().astype(np.int32)))
                yield _emit(**ids, v=lists, upper=pack(upper), lower=pack(lower))
    if not last:
        sums = np.concatenate([totals.ravel(), counts.ravel()])
        yield _emit(cell=pa.array(np.arange(len(sums)), pa.int32()), total=pa.array(sums))


def moved_books(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry's floor of sum / count; unused entries stay. sums: of components and then of parts, as _round() has them."""
    totals, counts = sums[: books.size].reshape(books.shape), sums[books.size :].reshape(books.shape[:2])
    used = counts > 0
    out = books.copy()
    out[used] = (totals[used] // counts[used][:, None]).astype(np.int64)  # rounds down; exact integers of any size
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (array of double) of the rows whose vector is there and has no null or non-finite component."""
    rows = own(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~odd)


def first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The codebooks that Lloyd's rounds begin with: the parts of the vectors of the `entries` smallest vec_ids, which alone come to the driver."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    if not rows:
        return None
    width = len(rows[0]["embedding"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    fit = [r["embedding"] for r in rows if len(r["embedding"]) == width]
    return integers(np.array(fit, np.float64).reshape(len(fit), width), scale).reshape(len(fit), parts, width // parts).transpose(1, 0, 2)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (one byte for each part) and error (the squared distances to the entries, summed over parts)
    of every usable vector, and the codebooks (part x entry x place, integers).

    Nulls: rows whose vector is null or holds null or non-finite components have no code and are left out; a
    null vec_id comes after all others, a null label stays. Ties: of equally near entries that of the lower
    index, of equal vec_ids the smaller vector first. Repeated rows: each has its code and counts in the
    sums. Vectors of another length than that of the smallest vec_id (empty ones, too) fit no codebook: their code
    and error are null. Very long vectors: read whole; components beyond LARGEST / scale are an error.
    Empty table: empty result and codebooks. Other columns are ignored, whatever their names.
    """
    spark, kept = vectors.sparkSession, usable(vectors)
    books = first_books(kept, parts, entries, scale)
    if books is None:
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), np.empty((parts, 0, 0), np.int64)
    size = F.size("embedding") == books.shape[0] * books.shape[2]
    rows, bounds, held = kept.where(size).select("vec_id", "label", "embedding"), Bounds(books), Staged()
    for _ in range(rounds):
        done, held = held, Staged()
        state = staged(rows.mapInArrow(lambda b, k=bounds: _round(b, k, scale, False), _STATE), "bounds", held)
        done.delete(spark)  # the round before
        sums = np.zeros(books.size + books.shape[0] * books.shape[1], object)
        for r in state.where("cell IS NOT NULL").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # a row for each component of a codebook
            sums[r["cell"]] = int(r["total"])
        books, before = moved_books(books, sums), books
        bounds = Bounds(books, before)
        rows = state.where("cell IS NULL").select("vec_id", "label", "v", "code", "upper", "lower")
    coded = staged(rows.mapInArrow(lambda b: _round(b, bounds, scale, True), _STATE).select("vec_id", "label", "code", "error"), "codes")
    held.delete(spark)
    other = kept.where(~size).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def decompress(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and embedding, the vector that the code stands for: the middles of the integers' steps; null without a code."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(len(books))
        for batch in batches:
            made = [None if c is None else ((books[parts, np.frombuffer(c, np.uint8)].ravel() + 0.5) / scale).tolist() for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return own(coded, "vec_id", "code").mapInArrow(kernel, "vec_id long, embedding array<double>")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over equal labels, nulls together. Sums are made before they are shuffled, and a label that very many rows have is split in the join."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op13_vector_codes(spark, sf_dir):
    small_batches(spark)
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds in SQL, every part held against every entry."""
    near = "SELECT vec_id, part, entry, w, d FROM (SELECT x.vec_id, x.part, x.w, c.entry, list_sum(list_transform(list_zip(x.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{k} c USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.w, c.w) AS w FROM c{k} c LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS w FROM
  (SELECT part, entry, i, floor(sum(y) / count(*))::BIGINT AS m FROM (SELECT part, entry, unnest(w) AS y, generate_subscripts(w, 1) AS i FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2) n USING (part, entry))""")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p::INTEGER AS part, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS w FROM v, range({PARTS}) r(p)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, w FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(steps)}, f AS ({near.format(k=ROUNDS)}),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY 1),
b AS (SELECT sha256(string_agg(s, ',' ORDER BY part, entry)) AS h FROM (SELECT part, entry, array_to_string(w, ',') AS s FROM c{ROUNDS}))
SELECT e.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN v USING (vec_id), b"""


OP13_SQL = _sql()
