"""Seekable bundles: round trips, revisits, random access, damage."""

import base64
import hashlib
import io
from collections import Counter

import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

from gridspark.llm import warc_bundles as wb
from gridspark.llm.lookup import look_up

SCHEMA = "page_id long, url string, html string, key string, bundle string"
LONG = "näturlich <p> " * 40_000
PAGES = [
    (5, "http://a/x", "same"), (3, "http://a/y z\r\nEvil: 1", "same"), (9, None, "same"), (4, "http://b/%C3%A9?q=1#f", ""), (7, "http://b", None), (1, "", "one\r\n\r\nWARC/1.1\r\n"),
    (8, "http://c", LONG), (6, "http://c", LONG), (None, "http://d", "only null"), (None, "http://d", "same"), (3, "http://a/y z\r\nEvil: 1", "same"), (5, "http://e", "same"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def expected(rows, least=0):
    payloads = [(r[2] or "").encode() for r in rows]
    first = {}
    for r, p in zip(rows, payloads):
        if r[0] is not None:
            first[p] = min(first.get(p, r[0]), r[0])
    out = []
    for r, p in zip(rows, payloads):
        refers = first.get(p) if len(p) >= least and first.get(p) != r[0] else None
        out.append((r[0] if r[0] is None else str(r[0]), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers if refers is None else str(refers)))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 4, 5])
@pytest.mark.parametrize("frame_bytes,bundle_bytes", [(1, 1), (300, 200), (1 << 18, 1 << 26)])
def test_records_come_back(spark, tmp_path, least, frame_bytes, bundle_bytes):
    path = f"file://{tmp_path}/bundles"
    index = wb.write_bundles(frame(spark, PAGES), path, least_revisit=least, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    assert Counter(map(tuple, wb.read_digests(index, path).collect())) == expected(PAGES, least)
    assert index.count() == len(PAGES) and not list(tmp_path.glob("**/*.tmp"))


def test_headers_of_revisits_say_what_the_response_has(spark, tmp_path):
    path = f"file://{tmp_path}/bundles"
    index = wb.write_bundles(frame(spark, PAGES), path)
    records = wb.read_bundles(index, path).collect()
    stored = {(r.key, r.payload_digest): bytes(r.payload) for r in records if r.record_type == "response"}
    for r in records:
        assert (r.payload is None) == (r.record_type == "revisit")
        body = stored[r.refers_to or r.key, r.payload_digest]
        assert wb.base32(hashlib.sha1(body).digest()) == r.payload_digest
    assert {r.url for r in records} >= {None, "", "http://a/y%20z%0D%0AEvil:%201", "http://b/%C3%A9?q=1#f"}


def test_a_bundle_is_a_plain_zstandard_file_of_warc_records(spark, tmp_path):
    wb.write_bundles(frame(spark, PAGES).coalesce(1), f"file://{tmp_path}/bundles", frame_bytes=300)
    whole = b""
    for p in (tmp_path / "bundles").glob("*.warc.zst"):
        with p.open("rb") as f:
            whole += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    n, at = 0, 0
    while at < len(whole):
        _, at = wb.parse(whole, at)
        n += 1
    assert n == len(PAGES)


def test_single_records_by_their_identifiers(spark, tmp_path):
    path = f"file://{tmp_path}/bundles"
    pages = [(i, f"http://h/{i}", f"text {i % 7} " * (i + 1) if i % 5 else "again") for i in range(200)]
    index = wb.write_bundles(frame(spark, pages), path, frame_bytes=2000)
    keys = spark.createDataFrame([(3,), (25,), (25,), (199,), (1000,), (None,)], "id long")
    got = {r.key: bytes(r.payload).decode() for r in wb.fetch(index, path, keys).collect()}
    assert got == {"3": pages[3][2], "25": "again", "199": pages[199][2]}


def test_damage_is_noticed(tmp_path):
    fs, path = pafs.LocalFileSystem(), str(tmp_path / "a.warc.zst")
    writer = wb.BundleWriter(fs, path, 100, 3)
    for i in range(5):
        writer.add(str(i), wb.to_bytes(str(i), None, b"x" * 200, b"0" * 20, None))
    assert not (tmp_path / "a.warc.zst").exists()
    assert [x[1] for x in writer.close()] == [0, 1, 2, 3, 4]
    data = bytearray((tmp_path / "a.warc.zst").read_bytes())
    assert wb.parse(wb.Bundle(fs, path).frame(3))[0].key == "3"
    data[20] ^= 255
    (tmp_path / "a.warc.zst").write_bytes(data)
    with pytest.raises(Exception):
        wb.Bundle(fs, path).frame(0)
    (tmp_path / "b").write_bytes(data[:-20])
    with pytest.raises(ValueError, match="no seek table"):
        wb.Bundle(fs, str(tmp_path / "b"))
    assert io.BytesIO(data).read(4) == zstandard.FRAME_HEADER


def test_an_empty_table_gives_no_bundles(spark, tmp_path):
    path = f"file://{tmp_path}/bundles"
    index = wb.write_bundles(frame(spark, []), path)
    assert index.count() == 0 and wb.read_digests(index, path).count() == 0 and wb.read_bundles(index, path).count() == 0


def test_text_keys(spark, tmp_path):
    path = f"file://{tmp_path}/bundles"
    rows = spark.createDataFrame([("b>\r\n", "u", "x"), ("", "u", "x"), ("é", "u", "y")], "page_id string, url string, html string")
    got = {r.key: r.refers_to for r in wb.read_digests(wb.write_bundles(rows, path), path).collect()}
    assert got == {"b>\r\n": "", "": None, "é": None}


def test_common_keys_are_looked_up_without_a_large_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, 0).when(F.col("id") < 2500, None).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    got = look_up(rows, table.where("k IS NULL OR k < 4000"), "k", "top", "n")
    assert got.columns == ["k", "id", "top"]
    want = {i: 1999 if i < 2000 else 2499 if i < 2500 else i if i < 4000 else None for i in range(5000)}
    assert {r.id: r.top for r in got.collect()} == want and got.count() == 5000
