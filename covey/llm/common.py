"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covey.session import checkpointed, delete, delete_at_end, shared_folder

#: White space of every contract here: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of text, that a Python worker handles at once.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
#: Bits of a filter that is broadcast, at most (16 MB), and bits for each key below that.
FILTER_BITS, BITS_A_KEY = 1 << 27, 16


def small_batches(spark: SparkSession) -> None:
    """Have the session send at most BATCH_BYTES to Python at once, which bounds the buffers of the JVM as well.

    For the queries and the pipeline's stages, which own their session; operators leave it alone and cut
    what they get with pieces().
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the queries; their session sends small batches from here on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Staged(list):
    """Paths of the tables that one call has staged. Only who holds it deletes them, and no others."""

    def delete(self, spark: SparkSession) -> None:
        """What was computed from the tables and is not written yet is lost."""
        while self:
            delete(spark, os.path.dirname(self.pop()))


#: Who owns the tables staged in this thread's current block; other threads have blocks of their own.
_owner: ContextVar[Staged | None] = ContextVar("covey_staged", default=None)


@contextmanager
def staging() -> Iterator[Staged]:
    """Tables that are staged inside the block, in this thread, belong to what it yields."""
    own = Staged()
    before = _owner.set(own)
    try:
        yield own
    finally:
        _owner.reset(before)


def staged(df: DataFrame, name: str, owner: Staged | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and any executor can read it.

    The table goes when the driver's JVM ends, or when its owner deletes it: the one named, or else that of
    the block of staging().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/covey-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    delete_at_end(spark, os.path.dirname(path))
    owner = _owner.get() if owner is None else owner
    if owner is not None:
        owner.append(path)
    return spark.read.schema(df.schema).parquet(path)


cut = checkpointed


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ... so that no name can clash with an operator's own."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> int:
    """Position of a column: of that very name, else of one that differs by case alone."""
    if name in docs.columns:
        return docs.columns.index(name)
    return [c.lower() for c in docs.columns].index(name.lower())


def own(docs: DataFrame, *names: str) -> DataFrame:
    """These columns of docs alone, under these names, whatever else docs has."""
    return numbered(docs).select(*[F.col(f"c{place(docs, n)}").alias(n) for n in names])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, and of more than `most` bytes (or elements) of the column only where one row has them."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        values = batch.column(column)
        lens = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(lens, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = min(a + rows, max(a + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(a, b - a)
            a = b


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle; the cluster's operator sizes this setting by the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def first_of_each(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Of each value of key the `most` rows that come first by hash of doc_id.

    Values are counted first, and only rows whose hash is low enough for about four times that many are
    ranked, so that no task ranks more than a few times `most` rows of a value, whatever the table's size.
    """
    counts = rows.groupBy(F.col(key).alias("__value")).agg(F.count("*").alias("__n"))
    place = F.xxhash64("doc_id") / F.lit(float(1 << 64)) + 0.5
    low = rows.withColumn("__place", place).join(F.broadcast(counts), F.col(key) == F.col("__value")).where(F.col("__place") < F.lit(4.0 * most) / F.col("__n"))
    ranked = low.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy("__place", "doc_id")))
    return ranked.where(F.col("__rank") <= most).select(*rows.columns)


class Filter:
    """A Bloom filter of one hash function in rows of 32,768 bits, made and asked by DataFrame functions.

    It has BITS_A_KEY bits for each key (nothing passes wrongly but for some 6 %), up to FILTER_BITS in all,
    which bounds what is broadcast: beyond that it lets more pass, and never holds a key back.
    """

    def __init__(self, hashes: DataFrame):
        """hashes: one column, h (long)."""
        n = hashes.count()
        size = min(FILTER_BITS, max(1 << 15, 1 << (BITS_A_KEY * n).bit_length()))
        self.rows = size >> 15
        at = hashes.select(self._row(F.col("h")).alias("__row"), self._bit(F.col("h")).alias("__bit"))
        self.table = staged(at.groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "filter")

    def _row(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.rows)).cast("int")

    def _bit(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(32767)).cast("long")

    def asked(self, rows: DataFrame, h: Column, name: str) -> DataFrame:
        """rows with a boolean column `name`, false only where no key has the hash h."""
        bit = self._bit(h)
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        hit = F.expr("shiftright(__byte, __shift) & 1") == 1
        joined = rows.withColumn("__row", self._row(h)).join(F.broadcast(self.table), "__row", "left")
        marked = joined.withColumn("__byte", byte).withColumn("__shift", bit.bitwiseAND(F.lit(7)).cast("int"))
        return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__row", "__bits", "__byte", "__shift")
