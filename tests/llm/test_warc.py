import base64
import glob
import hashlib

import pytest

from reelsight.llm import warc
from reelsight.llm.common import scratch


def want(rows, least=0):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        of = first.get(html or "")
        revisit = of is not None and page != of and len(data) >= least
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=str)


NESTED = ("x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 3\r\n\r\nabc"
          "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
ROWS = [(1, "http://a/", "<p>one</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "http://c", "<p>one</p>"),
        (5, "u", NESTED), (6, "u", NESTED), (7, "u", "ends\r\n"), (8, "u", "\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n"),
        (9, "u", "\r\n\r\n\r\n"), (9, "u", "\r\n\r\n\r\n"), (None, "u", "é" * 5000), (None, "u", "<p>one</p>"),
        (10, "u", "WARC/1.1\r\n" * 400)]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_round_trip_with_magic_in_payloads(spark, split):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, value string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split == "700b" else "4194304")
    try:
        got = sorted((tuple(r) for r in warc.page_archive(pages.coalesce(2)).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want([(p, h) for p, _, h in ROWS])


def test_payloads_and_offsets(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write_warc(pages, path, min_revisit_bytes=20)
    rows = warc.read_warc(spark, path).collect()
    assert sum(r.record_type == "revisit" for r in rows) == 1       # only NESTED is long enough and repeated
    assert {bytes(r.payload) for r in rows if r.payload is not None} == {(h or "").encode() for _, _, h in ROWS}
    raw = {"file://" + f: open(f, "rb").read() for f in glob.glob(path.removeprefix("file:") + "/part-*")}
    for r in rows:
        assert raw[r.file.replace("file:/", "file:///") if "///" not in r.file else r.file][r.offset:].startswith(b"WARC/1.1\r\n")
    assert all(r.declared_digest == r.payload_digest for r in rows)


def test_broken_tail_and_empty(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good + b"WARC/1.1\r\nContent-Length: 50\r\n\r\ncut off")
    (tmp_path / "b.warc").write_bytes(b"junk\n" + good)
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.payload_bytes, bytes(r.payload)) for r in rows] == [(2, b"hi")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_archive(empty).count() == 0


def test_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = sorted((tuple(r) for r in warc.page_archive(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == want([(r.page_id, r.html) for r in pages.collect()])
