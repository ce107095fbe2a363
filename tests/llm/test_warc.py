import gzip
import hashlib

import pyarrow.fs as fs

from siftline.llm.warc import make_record, members, op2_warc, page_of, parse, read_warc, write_warc, _Window

LONG = "x" * 1500
from pyspark.sql import functions as F


def pages(spark):
    rows = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "u\r\nInjected: 1", None), (None, "http://n", "é" * 900), (7, "http://b", "é" * 900), (9, None, LONG), (8, "http://m", "\x1f\x8b\x08" * 400)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "1 AS keep")


def brute(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        keep = max(same) if len(b) >= 1000 and same else i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if keep == i else "revisit", None if keep == i else keep))
    return sorted(out, key=str)


def test_round_trip_at_any_split(spark, tmp_path):
    p = pages(spark)
    files = write_warc(p, f"file://{tmp_path}/w")
    expected = brute([tuple(r)[:3] for r in p.collect()])
    for split in (64, 1000, 1 << 20):
        got = read_warc(files, split)
        assert sorted(((r["i"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["to"]) for r in got.select(page_of(got.record_id).alias("i"), "*", page_of(got.refers_to).alias("to")).collect()), key=str) == expected
    assert {r["payload"].decode() for r in got.where("record_type = 'response'").collect()} == {r["html"] or "" for r in p.collect()}


def test_archives_are_plain_gzip_warc(spark, tmp_path):
    files = write_warc(pages(spark), f"file://{tmp_path}/w").collect()
    text = b"".join(gzip.open(r["path"].removeprefix("file://")).read() for r in files)
    assert text.count(b"WARC/1.1\r\n") == 10 == sum(r["records"] for r in files) and b"\r\nInjected" not in text


def test_damage_is_passed_over(tmp_path):
    good = make_record(1, "http://a", b"a" * 300, "d", None, False)
    data = good + b"\x1f\x8b\x08junk" + make_record(2, "http://b", b"b" * 300, "d", None, False) + good[:40] + make_record(3, None, b"", "d", None, False)
    (tmp_path / "x").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
        assert [parse(m)["record_id"] for _, m in members(_Window(f, len(data)), 0, len(data))] == ["<urn:x-page:1>", "<urn:x-page:2>", "<urn:x-page:3>"]


def test_empty_table(spark, tmp_path):
    assert read_warc(write_warc(pages(spark).limit(0), f"file://{tmp_path}/e")).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op2_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_short_payloads_are_spread_and_damage_shows(spark, tmp_path):
    from siftline.llm.warc import DAMAGED, read_warc, write_warc

    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("").alias("html"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        files = write_warc(pages, f"{tmp_path}/plain")
        sizes = [r["records"] for r in files.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(sizes) == 2000 and max(sizes) < 1200 and read_warc(files).where("record_type = 'response'").count() == 2000
    path = files.first()["path"]
    assert path.startswith("file:///")
    local = path.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    data[-40:-10] = bytes(30)  # the last record's compressed end
    open(local, "wb").write(bytes(data))
    got = {r["record_type"]: r["count"] for r in read_warc(files).groupBy("record_type").count().collect()}
    assert got == {"response": 1999, DAMAGED: 1}
