"""WARC round trip, segment reassembly and broken archives."""
import hashlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import SF01
from flowsight.llm import warc
from flowsight.llm.common import work_path


def want(rows, least=1000):
    top = {}
    for p, h in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        t = top.get(h or "")
        again = len(b) >= least and t is not None and p != t
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", t if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 700, "chunk_bytes": 64, "archive_bytes": 5000}])
def test_round_trip(spark, options):
    big = "é<p>" * 900
    rows = [(1, big), (2, big), (3, big), (4, "x" * 999), (5, "x" * 999), (6, None), (7, ""), (8, "0\r\n\r\n" * 300),
            (9, "z" * 60_000), (9, "z" * 60_000), (10, "z" * 60_000), (None, big), (None, "q" * 2000)]
    df = spark.createDataFrame([(p, None if p == 6 else f"http://a/{p}", h, "x") for p, h in rows],
                               "page_id long, url string, html string, body string")
    assert got(warc.round_trip(spark, df, **options)) == want(rows)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    twice = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000))
    rows = [(r.page_id, r.html) for r in twice.collect()]
    out = warc.round_trip(spark, twice, segment_bytes=2000)
    assert got(out) == want(rows) and out.where("not complete").count() == 0


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_segments_are_reported(spark):
    rng = random.Random(1)
    recs = list(warc.records_of(5, "u", bytes(rng.randrange(256) for _ in range(5000)), None, "id", 1000, 100))
    rows = []
    for name, keep in (("good", recs), ("lost", recs[:2] + recs[3:]), ("twice", recs + recs[2:3]), ("noend", recs[:-1])):
        for k, (f, block) in enumerate(warc.read_records(io.BytesIO(b"".join(map(warc._gzip, keep))))):
            total = f.get("warc-segment-total-length")
            rows.append((name, int(f["warc-segment-number"]), int(total) if total else None, block))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "origin string, segment int, total long, block binary")
    assert {r.origin: r.complete for r in warc.reassemble(df).collect()} == {
        "good": True, "lost": False, "twice": False, "noend": False}


def test_framing():
    for body in (b"", b"a", b"0\r\n\r\n", bytes(range(256)) * 40):
        for size in (1, 7, 4096):
            assert warc.dechunked(warc.chunked(body, size)) == body
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_unreported_archives_are_not_read(spark):
    df = spark.createDataFrame([(1, "u", "a" * 50)], "page_id long, url string, html string")
    folder = work_path(spark, "warc-test")
    manifest = warc.write_archives(df, folder)
    fs, root = warc._open(folder)
    with fs.open_output_stream(root + "/pages-000000-999-00000.warc.gz") as out:
        out.write(b"left by a lost task")
    assert warc.pages_from_archives(warc.read_archives(manifest, folder)).count() == 1
    assert isinstance(pa.array([1]), pa.Array)
