"""WARC archives: a writer with one gzip member for each record, and a reader that salvages what it can.

Writing: payloads are digested where they are scanned; of equal ones the smallest page_id is a response
and the others revisits, which hold no payload. Only payloads that a bounded filter takes for revisits are
shuffled to be told apart. Each task writes its records as gzip members, a bundle of about 1 MB a row, and
Spark's own text writer puts the bundles into files, with an empty gzip member (SEAM) after each.

Reading: Spark's text reader cuts the files at the seams, so a large archive is read by many tasks, and no
task holds more than a bundle, or one record. (A file without seams is one bundle.) Of a bundle every
member is decompressed and held against its CRC, its version line, its lengths and its digests. Where a
check fails, the reader searches for the next place where a valid member or version line begins, goes
on there, and reports the bytes between as a gap of the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covey.llm.common import Filter, own, pieces, small_batches, staged
from covey.session import delete_at_end, shared_folder

#: Fixed value: an empty gzip member. It is valid anywhere between members, and no compressed record contains it by chance.
SEAM = bytes.fromhex("1f8b0800000000000003030000000000000000" + "00")
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of a bundle, about; zlib's level; bytes that equal payloads have at least for all but one to be revisits (by the contract).
BUNDLE, LEVEL, LEAST = 1 << 20, 4, 0
#: Bytes that are decompressed at once, and bytes that tell whether a record begins there.
CHUNK, PEEK = 1 << 16, 64
_BEGIN = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STATUS = re.compile(rb"HTTP/\d(?:\.\d)? \d{3}")


# --- records ----------------------------------------------------------------


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str | None) -> str:
    """A header's value: control characters, which could end the line, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One uncompressed WARC record of an HTTP exchange: a response, or with refers_to a revisit, which has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda k: f"<urn:x-page:{k}>" if k is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {sha1(payload)}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Bad(Exception):
    """Why a record was not taken."""


def parse(data: bytes, at: int) -> tuple[dict[bytes, bytes], int, int, int]:
    """Headers of the record that begins at `at`, begin and end of its block, and where the record ends; Bad if a check fails."""
    if not data.startswith(VERSION, at):
        raise Bad("version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Bad("header")
    fields: dict[bytes, bytes] = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header")
        fields[key.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        raise Bad("length")
    begin, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("length")
    digest = fields.get(b"warc-block-digest", b"")
    if digest.startswith(b"sha1:") and digest[5:].decode("latin-1") != sha1(data[begin:end]):
        raise Bad("block digest")
    if fields.get(b"warc-type") == b"response" and (digest := fields.get(b"warc-payload-digest", b"")).startswith(b"sha1:") and digest[5:].decode("latin-1") != sha1(data[body(data, fields, begin, end) : end]):
        raise Bad("payload digest")
    return fields, begin, end, end + 4


def body(data: bytes, fields: dict[bytes, bytes], begin: int, end: int) -> int:
    """Where the payload of a block begins: behind the HTTP header, if the block has one."""
    if fields.get(b"content-type", b"").startswith(b"application/http") and _STATUS.match(data, begin, end):
        head = data.find(b"\r\n\r\n", begin, end)
        return end if head < 0 else head + 4
    return begin


def _unzipped(data: bytes, at: int) -> tuple[bytes, int]:
    """What the member that begins at `at` holds, and where it ends; Bad if it is damaged or cut off."""
    unzip, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while at < len(data) and not unzip.eof:
            out.append(unzip.decompress(view[at : at + CHUNK]))
            at += CHUNK
    except zlib.error as e:
        raise Bad("member") from e
    if not unzip.eof:
        raise Bad("member cut off")
    return b"".join(out), min(at, len(data)) - len(unzip.unused_data)


def _next(data: bytes, at: int) -> int:
    """The first place from `at` on where a member that holds a record, an empty member or a version line begins; the end if there is none."""
    while found := _BEGIN.search(data, at):
        at = found.start()
        if found[0] != MAGIC:
            return at
        try:
            unzip = zlib.decompressobj(31)
            if unzip.decompress(data[at : at + CHUNK], PEEK).startswith(VERSION) or unzip.eof:
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, tuple | None]]:
    """Records and gaps of a bundle in order: begin, end, why (of a gap), and (data, headers, begin and end of the block) of a record.

    A member is taken if its CRC is right; a record in it (there may be several) if its own checks pass.
    A gap is reported once, from the first byte that was not taken to the next place where something valid begins.
    """
    at, lost, why = 0, None, None
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                plain, end = _unzipped(data, at)
                found = [(at, end, reason, rec) for _, _, reason, rec in _plain(plain)]
            else:
                fields, begin, stop, end = parse(data, at)
                found = [(at, end, None, (data, fields, begin, stop))]
        except Bad as bad:
            if lost is None:
                lost, why = at, str(bad)
            at = _next(data, at + 1)
            continue
        if lost is not None:
            yield lost, at, why, None
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield lost, len(data), why, None


def _plain(data: bytes) -> Iterator[tuple[int, int, str | None, tuple | None]]:
    """The records of one decompressed member; of what can't be taken only the reason is given, as it has no bytes of its own in the file."""
    at = 0
    while at < len(data):
        try:
            fields, begin, stop, end = parse(data, at)
        except Bad as bad:
            yield at, at, str(bad), None
            end = data.find(VERSION, at + 1)
            if end < 0:
                return
        else:
            yield at, end, None, (data, fields, begin, stop)
        at = end


# --- writing ----------------------------------------------------------------


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (page_id, url, payload, refers_to) as rows of gzip members."""
    held, size = [], 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
    for batch in pieces(batches, "payload"):
        for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
            held.append(member(record(page_id, url, payload.encode(), refers_to)))
            size += len(held[-1])
            if size >= BUNDLE:
                yield row()
                held, size = [], 0
    if held:
        yield row()


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id and refers_to of the pages that repeat another's payload of at least `least` bytes. No payload is shuffled."""
    keys = staged(pages.where(F.octet_length("payload") >= least).select("page_id", F.sha2("payload", 256).alias("key")), "payloads")
    first = staged(keys.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")  # then a payload that very many pages have can be split in the join
    again = keys.join(first, "key").where("page_id IS NULL AND first IS NOT NULL OR page_id <> first")
    return again.select("page_id", F.col("first").alias("refers_to"), "key")


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives of page_id, url and html in the folder `path`, one file for each task.

    Nulls: a null html is an empty payload, a null url has no target; a null page_id comes after all others
    and its record's id is made of its URL and payload. Empty payloads are equal like others. Very long pages: a worker
    holds one at a time. Ties: of equal payloads the smallest page_id is the response; rows that
    repeat one page_id and payload are all like the first. Empty table: an archive without records.
    Other columns are ignored, whatever their names. pages is read twice and must give the same rows each time.
    """
    rows = own(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    again = staged(revisits(rows, least).distinct(), "revisits").toDF("__id", "__refers", "__key")
    at = lambda c: F.xxhash64(F.coalesce(c, F.lit(0)))
    asked = Filter(again.select(at(F.col("__id")).alias("h"))).asked(rows, at(F.col("page_id")), "__maybe")
    on = F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha2("payload", 256) == F.col("__key"))
    met = asked.where("__maybe").join(again.hint("shuffle_hash"), on, "left").select("page_id", "url", "payload", F.col("__refers").alias("refers_to"))
    single = asked.where("NOT __maybe").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    bundles = met.unionByName(single).mapInArrow(_bundles, "value binary")
    # as a string the bytes stay what they are; the writer puts the line separator, here the seam, behind each row
    bundles.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEAM.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


# --- reading ----------------------------------------------------------------

_READ = "file string, block long, place long, bytes long, reason string, type string, record_id string, refers_to string, target string, date string, payload_bytes long, payload_digest string, payload binary"
_NAMES = [c.split()[0] for c in _READ.split(", ")]


def _text(fields: dict[bytes, bytes], key: bytes) -> str | None:
    value = fields.get(key)
    return None if value is None else value.decode(errors="replace")


def _taken(data: bytes, fields: dict[bytes, bytes], begin: int, end: int, payloads: bool) -> tuple:
    """Columns of a record from type on. A revisit's payload is elsewhere: its length is that of the HTTP header, its digest that of the record."""
    start = body(data, fields, begin, end)
    if fields.get(b"warc-type") == b"revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", data[begin:start])
        size, payload = int(length[1]) if length else None, None
    else:
        size, payload = end - start, data[start:end] if payloads else None
    digest = _text(fields, b"warc-payload-digest") or (sha1(data[start:end]) if fields.get(b"warc-type") != b"revisit" else None)
    return _text(fields, b"warc-type"), _text(fields, b"warc-record-id"), _text(fields, b"warc-refers-to"), _text(fields, b"warc-target-uri"), _text(fields, b"warc-date"), size, digest and digest.removeprefix("sha1:"), payload


def _read(batches: Iterator[pa.RecordBatch], payloads: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of bundles (file, block, value) as records and gaps, with their places in the block, and a row with the bytes of each block."""
    sizes: dict[tuple[str, int], int] = {}
    for batch in pieces(batches, "value", rows=1):
        out: list[tuple] = []
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            key = (file, block)
            before = sizes.get(key, 0)
            for begin, end, why, found in salvage(value):
                rest = _taken(*found, payloads) if found else (None,) * 8
                out.append((file, block, before + begin, end - begin, why, *rest))
            sizes[key] = before + len(value) + len(SEAM)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
    rows = [(file, block, None, n, "", *(None,) * 8) for (file, block), n in sizes.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_archives(spark: SparkSession, path: str | list[str], payloads: bool = True, seams: bool = True) -> DataFrame:
    """Records and gaps of archives: file, block, place (of the first byte in its block of the file), bytes, reason (of a gap; null for a record),
    and of a record type, record_id, refers_to, target, date, payload_bytes, payload_digest and, if asked for, payload. Rows with reason '' have the bytes of a block (for gaps()).

    Empty files have no rows, damaged ones their records outside the damage. seams=False reads foreign archives,
    compressed or not, each file whole; other bundles that are longer than a batch are one record, or damaged at a seam.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if seams:
        raw = spark.read.option("lineSep", SEAM.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("content").alias("value"))
    schema = to_arrow_schema(StructType.fromDDL(_READ))
    return raw.mapInArrow(lambda b: _read(b, payloads, schema), _READ)


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: file, begin and end (bytes of the file), reason. found: read_archives()'s rows, staged. A block's place in its file is the sum of those before it."""
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = found.where("reason = ''").select("file", "block", before.alias("start"))  # a row for each block
    lost = found.where("reason <> ''").select("file", "block", "place", "bytes", "reason")
    return lost.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("place")).alias("begin"), (F.col("start") + F.col("place") + F.col("bytes")).alias("end"), "reason")


def records(found: DataFrame) -> DataFrame:
    return found.where("reason IS NULL").drop("block", "place", "bytes", "reason")


def page_of(column: str):
    """The page_id that a record's id names, or null."""
    return F.nullif(F.regexp_extract(column, r"<urn:x-page:(-?\d+)>", 1), F.lit("")).cast("long")


def new_folder(spark: SparkSession) -> str:
    """A folder for archives in the shared folder, which goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/covey-warc-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    return f"{folder}/archives"


def op12_warc(spark, sf_dir):
    small_batches(spark)
    folder = new_folder(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = records(read_archives(spark, folder, payloads=False))
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))


_B32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + (i // 4)::INTEGER * 5, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31))::INTEGER, 1)), '')"
OP12_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
