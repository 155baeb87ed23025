import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from cohortwise.llm import warc as W
from cohortwise.llm.shared import Staged, table

from .conftest import SF


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(pages):
    last = {}
    for page, html in pages:
        key = (html or "").encode()
        last[key] = max(last.get(key, page), page)
    out = []
    for page, html in pages:
        key = (html or "").encode()
        same = last[key] == page
        out.append((page, len(key), digest(key), "response" if same else "revisit", None if same else last[key]))
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_query(spark):
    pages = [(r.page_id, r.html) for r in table(spark, SF, "pages").collect()]
    assert rows(W.op2_warc(spark, SF)) == sorted(brute(pages), key=repr)


def final(spark, df, **options):
    folder = W.deduplicate(df, Staged(spark, "warc"), **options)
    return W.read_headers(spark, folder).withColumns({
        "page_id": F.col("record_id").cast("long"), "refers_to": F.col("refers_to").cast("long")}), folder


def test_payloads_that_look_like_records(spark):
    rng = random.Random(7)
    odd = ["", None, "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n\r\n", "x\r\n", "é" * 999, "a" * 300_000]
    pages = [(i, rng.choice(odd)) for i in range(200)]
    df = spark.createDataFrame([(p, "http://a\r\nb c", h) for p, h in pages], "page_id long, url string, html string").repartition(5)
    found, folder = final(spark, df.withColumn("archive", F.lit(1)))
    assert rows(found) == sorted(brute(pages), key=repr)
    # The blocks themselves: a response keeps its payload, a revisit has none.
    blocks = {}
    for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).collect():
        for headers, block in W.parse(gzip.decompress(f.content)):
            blocks[int(headers["WARC-Record-ID"][10:-1])] = (headers["WARC-Type"], bytes(block))
    for page, _, _, kind, _ in brute(pages):
        assert blocks[page] == (kind, (dict(pages)[page] or "").encode() if kind == "response" else b"")


def test_min_bytes_repeated_rows_and_no_rows(spark):
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame([(1, None, "abc"), (2, None, "abc"), (3, None, "z"), (4, None, "z"), (2, None, "abc"), (None, None, "abc")], schema)
    found, _ = final(spark, df, min_bytes=2)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in found.collect()), key=repr)
    assert kinds == sorted([(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "response", None),
                            (None, "revisit", 2)], key=repr)
    assert final(spark, df.where("false"))[0].count() == 0


def test_many_members():
    data = b"".join(gzip.compress(W.record({"WARC-Type": "response"}, b"x" * n) + b"\r\n\r\n") for n in (0, 5))
    assert [len(block) for _, block in W.parse(W.unpacked(data))] == [0, 5]
