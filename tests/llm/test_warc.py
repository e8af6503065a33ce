"""WARC archives: gzip members, large payloads, archives of others, zones, ranges."""

import base64
import gzip
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmill.llm import warc


def record(kind, name, body, extra="", content="application/http; msgtype=response"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2021-01-0{name}T00:00:00Z\r\n{extra}"
    return f"{head}Content-Type: {content}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def http(payload):
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload


def others():
    pages = [b"one" * 50, b"", b"two\r\n\r\nthree" * 3, b"\x00\xff" * 500]
    sha1 = base64.b32encode(hashlib.sha1(pages[0]).digest()).decode()
    records = [record("warcinfo", 1, b"software: x\r\n", content="application/warc-fields")]
    for i, page in enumerate(pages):
        extra = f"WARC-Target-URI: http://WWW.example.org/p{i}?q#top\r\nWARC-Payload-Digest: sha1:{sha1}\r\n"
        records.append(record("request", 2, b"GET / HTTP/1.1\r\n\r\n"))
        records.append(record("response", i + 1, http(page), extra))
    records.append(record("resource", 6, b"plain", "warc-target-uri: ftp://a/b\r\n", "text/plain"))
    records.append(record("revisit", 7, b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Payload-Digest: sha1:ABC\r\nWARC-Target-URI: http://a/\r\n"))
    return pages, records


@pytest.mark.parametrize("packed", ["one member", "a member each", "cut anywhere"])
def test_archives_of_others(packed, monkeypatch):
    pages, records = others()
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    whole = b"".join(records)
    parts = {"one member": [whole], "a member each": records, "cut anywhere": [whole[:100], whole[100:101], whole[101:]]}[packed]
    found = list(warc.parse_archive(b"".join(map(gzip.compress, parts)) + b"\x00" * 20))
    assert [r["record_type"] for r in found] == ["response"] * 4 + ["resource", "revisit"]
    for page, r in zip([*pages, b"plain"], found):
        assert (r["payload_bytes"], r["payload_digest"]) == (len(page), hashlib.sha256(page).hexdigest())
        assert r["page_id"] is None
    assert found[2]["url_key"] == "org,example,www)/p2?q" and found[4]["url_key"] == "a)/b"
    assert (found[5]["payload_digest"], found[5]["payload_bytes"]) == ("sha1:ABC", None)


def test_cut_archives_fail():
    whole = gzip.compress(b"".join(others()[1]))
    for data in (whole[:-30], gzip.compress(b"".join(others()[1])[:-60])):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.parse_archive(data))


def test_keys_of_addresses(spark):
    urls = ["http://a.b.c:80/x/Y?z#f", "", "a", "HTTPS://Q.r", "mailto:x@y", "http://h?x=1/2", "//a.b/c", "#x", "x.y/z//"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.url_key(F.col("u")).alias("k")).collect()
    assert [warc.key_of(r.u) for r in rows] == [r.k for r in rows]


def test_large_payloads_are_read_in_linear_time():
    body = http(b"ab" * 100_000_000)
    packed = gzip.compress(record("response", 1, body, "WARC-Target-URI: http://a/\r\n"), 1)
    start = time.perf_counter()
    (found,) = warc.parse_archive(packed)
    assert found["payload_bytes"] == 200_000_000 and time.perf_counter() - start < 20


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session(spark, tmp_path, zone):
    pages = spark.createDataFrame([(5, "http://a/", "x", 3), (6, "http://a/", "y", 3)], "page_id long, url string, html string, k int")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        warc.write_archives(pages, f"{tmp_path}/w")
        got = {r.page_id: r.captured for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
        spring = spark.createDataFrame([(1, "u", "h", 1615705200 + 1800), (2, "u", "h", -1)], "page_id long, url string, html string, s long")
        warc.write_archives(spring.withColumn("t", F.timestamp_seconds("s")), f"{tmp_path}/t", captured_col="t")
        dated = {r.page_id: r.captured for r in warc.read_archives(spark, f"{tmp_path}/t").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {5: "2020-01-01T00:00:05Z", 6: "2020-01-01T00:00:06Z"}
    assert dated == {1: "2021-03-14T07:30:00Z", 2: "1969-12-31T23:59:59Z"}


def test_payloads_of_all_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", {10: 3, 100: 2, 1 << 31: 1})
    pick = random.Random(1)
    rows = [(i, f"http://h/{i % 7}", "é" * pick.choice([0, 3, 30, 300]), "clash") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value string").withColumns({c: F.lit(1) for c in ("bytes", "digest", "captured", "first")})
    warc.write_archives(pages, f"{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert len(got) == 40 and all(got[i].payload_bytes == len(h.encode()) for i, _, h, _ in rows)
    per_file = {}
    for r in got.values():
        per_file.setdefault(r.archive, []).append(r.payload_bytes)
    assert all(len(sizes) == 1 for sizes in per_file.values() if max(sizes) > 100) and max(map(len, per_file.values())) <= 3


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    pick = random.Random(2)
    rows = [(pick.choice([None, i]), 1, "d", "response", None, pick.choice(["hot", f"k{pick.randrange(40)}"]), f"t{pick.randrange(9)}", f"a{i % 13}") for i in range(5_000)]
    captures = spark.createDataFrame(rows, warc.CAPTURES).repartition(5).withColumn("extra", F.lit(2))
    merged = warc.merge_index(captures)
    places = warc.global_places(merged).collect()
    key = lambda r: (r.url_key, r.captured, -1 if r.page_id is None else r.page_id)
    order = sorted(places, key=lambda r: r.index_place)
    assert [r.index_place for r in order] == list(range(5_000))
    assert [key(r) for r in order] == sorted(map(key, places))
    sizes = [r["count"] for r in merged.groupBy("range_no").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 400
