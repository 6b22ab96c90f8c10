"""Archives: round trips, and damage of every kind against a plain account of what is left."""

import glob
import hashlib
import random
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from covey.llm import warc

SCHEMA = "page_id long, url string, html string, value string, refers_to long, payload string"


def _payloads(n, seed=1):
    rnd = random.Random(seed)
    return [bytes(rnd.randrange(32, 127) for _ in range(rnd.randrange(20, 900))) for _ in range(n)]


def _ids(found):
    return [rec[1][b"warc-record-id"] for _, _, _, rec in found if rec]


def test_salvage_reports_exactly_the_damaged_members():
    payloads = _payloads(12)
    members = [warc.member(warc.record(k, f"http://h/{k}", p)) for k, p in enumerate(payloads)]
    starts = [sum(map(len, members[:k])) for k in range(13)]
    whole = b"".join(members)
    name = lambda k: f"<urn:x-page:{k}>".encode()
    flip = lambda data, at: data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
    assert _ids(warc.salvage(whole)) == [name(k) for k in range(12)]
    for k in (0, 5, 11):  # one byte in the middle, and one in the checksum
        for at in ((starts[k] + starts[k + 1]) // 2, starts[k + 1] - 6):
            found = list(warc.salvage(flip(whole, at)))
            assert _ids(found) == [name(j) for j in range(12) if j != k]
            assert [(a, b) for a, b, why, _ in found if why] == [(starts[k], starts[k + 1])]
    found = list(warc.salvage(flip(flip(whole, starts[3] + 40), starts[4] + 40)))  # neighbours are one gap
    assert [(a, b) for a, b, why, _ in found if why] == [(starts[3], starts[5])] and len(_ids(found)) == 10
    found = list(warc.salvage(whole[: starts[2] + 30] + whole[starts[3] :]))  # the end of a member is lost
    assert [(a, b) for a, b, why, _ in found if why] == [(starts[2], starts[2] + 30)] and len(_ids(found)) == 11
    dirt = b"\x1f\x8b\x08 no member WARC/1. no record " + bytes(500)
    found = list(warc.salvage(whole[: starts[7]] + dirt + whole[starts[7] :]))
    assert [(a, b) for a, b, why, _ in found if why] == [(starts[7], starts[7] + len(dirt))] and len(_ids(found)) == 12
    found = list(warc.salvage(whole[:-9]))
    assert [(a, b) for a, b, why, _ in found if why] == [(starts[11], len(whole) - 9)]
    assert list(warc.salvage(b"")) == [] and [x[:2] for x in warc.salvage(bytes(99))] == [(0, 99)]


def test_salvage_of_plain_records_and_members_of_several():
    rec = [warc.record(k, None, p) for k, p in enumerate(_payloads(6, 2))]
    starts = [sum(map(len, rec[:k])) for k in range(7)]
    whole = b"".join(rec)
    assert len(_ids(warc.salvage(whole))) == len(_ids(warc.salvage(warc.member(whole)))) == 6
    broken = whole.replace(b"Content-Length: ", b"Content-Length: 1", 3)  # each record has two lengths: the first record and the second's own
    found = list(warc.salvage(broken))
    assert len(_ids(found)) == 4 and [(a, b) for a, b, why, _ in found if why] == [(0, starts[2] + 3)]
    at = starts[3] + rec[3].index(b"200 OK") + 1
    broken = whole[:at] + b"9" + whole[at + 1 :]
    found = list(warc.salvage(broken))
    assert [(a, b, why) for a, b, why, _ in found if why] == [(starts[3], starts[4], "block digest")]
    found = list(warc.salvage(warc.member(broken)))
    assert len(_ids(found)) == 5 and [why for _, _, why, _ in found if why] == ["block digest"]
    foreign = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r[1][b"warc-type"] for *_, r in warc.salvage(foreign + whole)][:2] == [b"warcinfo", b"response"]


ROWS = [
    (5, "http://a/5", "<p>one</p>", "x", 1, "y"), (3, "http://a/3", "<p>one</p>", "x", 1, "y"), (9, None, "<p>one</p>", "x", 1, "y"), (7, "http://a/\r\nEvil: yes", "WARC/1.1\r\n\r\n ünï 日本", "x", 1, "y"), (8, "http://a/8", None, "x", 1, "y"), (2, "", "", "x", 1, "y"),
    (11, "http://a/11", "long " * 600_000, "x", 1, "y"), (12, "u", "twice", "x", 1, "y"), (12, "u", "twice", "x", 1, "y"), (None, "n", "<p>one</p>", "x", 1, "y"), (None, "n", "lonely", "x", 1, "y"), (-4, "m", "minus", "x", 1, "y"),
]


def _expected(rows):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None)
        refers = first if page_id != first and first is not None else None
        out.append((page_id, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def _answers(found):
    rows = warc.records(found).select(warc.page_of("record_id").alias("a"), "payload_bytes", "payload_digest", "type", warc.page_of("refers_to").alias("b"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    yield
    spark.conf.set(key, before)


def test_round_trip(spark, small_splits):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("__id", F.lit(1))
    folder = warc.new_folder(spark)
    warc.write_archives(pages, folder)
    found = warc.read_archives(spark, folder)
    assert _answers(found) == _expected(ROWS)
    assert warc.gaps(found).count() == 0
    got = {r.target: r.payload for r in warc.records(found).where("type = 'response'").select("target", "payload").collect()}
    assert bytes(got["http://a/%0D%0AEvil: yes"]).decode() == ROWS[3][2] and bytes(got["http://a/11"]).decode() == ROWS[6][2]
    folder = warc.new_folder(spark)
    warc.write_archives(pages, folder, least=8)  # smaller ones are all responses
    types = {(r.a, r.type) for r in warc.records(warc.read_archives(spark, folder)).select(warc.page_of("record_id").alias("a"), "type").collect()}
    assert {(2, "response"), (8, "response"), (12, "response"), (5, "revisit"), (3, "response")} <= types
    folder = warc.new_folder(spark)
    warc.write_archives(pages.limit(0), folder)
    assert warc.read_archives(spark, folder).where("reason IS NULL").count() == 0


def test_damaged_files(spark, small_splits, tmp_path):
    """Places of gaps are those in the file, however it is split; everything outside the damage comes back."""
    payloads = [p.decode() for p in _payloads(900, 7)]
    pages = spark.createDataFrame([(k, f"http://h/{k}", p, "", 0, "") for k, p in enumerate(payloads)], SCHEMA).coalesce(1)
    bundle, warc.BUNDLE = warc.BUNDLE, 3000
    try:
        folder = str(tmp_path / "archives")
        rows = pages.select("page_id", "url", F.col("html").alias("payload"), F.lit(None).cast("long").alias("refers_to"))
        pieces = [bytes(b) for batch in warc._bundles(iter(rows.toArrow().to_batches())) for b in batch.column("value").to_pylist()]
        spark.createDataFrame([(p,) for p in pieces], "value binary").coalesce(1).select(F.col("value").cast("string").alias("value")).write.option("lineSep", warc.SEAM.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    finally:
        warc.BUNDLE = bundle
    (path,) = glob.glob(f"{folder}/part-*")
    data = bytearray(open(path, "rb").read())
    assert data == b"".join(p + warc.SEAM for p in pieces) and len(data) > 200_000
    members, at = [], 0
    while at < len(data):
        end = warc._unzipped(bytes(data), at)[1]
        members.append((at, end))
        at = end
    rnd = random.Random(4)
    hit = sorted(rnd.sample([m for m in members if m[1] - m[0] > 60], 25))
    seam = next(m for m in members[len(members) // 2 :] if m[1] - m[0] == len(warc.SEAM) and all(abs(m[0] - b) and abs(m[1] - a) for a, b in hit))
    for a, b in hit:
        data[(a + b) // 2] ^= 0xFF
    data[seam[0] + 12] ^= 0xFF  # a seam: the bundles on its two sides become one
    open(path, "wb").write(data)
    glob_crc = glob.glob(f"{folder}/.part-*.crc")
    for f in glob_crc:
        open(f, "wb").write(b"")
    (tmp_path / "copy").mkdir()
    open(tmp_path / "copy" / "one.bin", "wb").write(data)
    found = warc.read_archives(spark, str(tmp_path / "copy")).cache()
    assert found.select("block").distinct().count() > 5
    gaps = sorted((r.begin, r.end) for r in warc.gaps(found).collect())
    merged = []
    for a, b in sorted([*hit, seam]):
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    assert gaps == [tuple(m) for m in merged]
    lost = {k for k, (a, b) in enumerate([m for m in members if m[1] - m[0] != len(warc.SEAM)]) if (a, b) in hit}
    assert {r.a for r in warc.records(found).select(warc.page_of("record_id").alias("a")).collect()} == set(range(900)) - lost
    whole = warc.read_archives(spark, str(tmp_path / "copy"), seams=False)  # the same as one foreign file
    assert sorted((r.begin, r.end) for r in warc.gaps(whole).collect()) == gaps
