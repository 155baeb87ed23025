import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import resampling as R
from cohortwise.llm.shared import Staged, utf8

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets=R.BUCKETS):
    w = WORDS.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute(docs, target, least=R.LEAST_WORDS, percent=R.PERCENT):
    """(id, features, weight, score, rank) per row, in the order of the rows; ties by id, None last, then row."""
    found = [features(text) for _, text in docs]
    s = collections.Counter(b for _, f in found for b in f)
    t = collections.Counter(b for text in target for b in features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + R.BUCKETS) / ((s[b] + 1) * (n_t + R.BUCKETS)))) for b in range(R.BUCKETS)]
    rows = []
    for (doc, _), (n, f) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((i for i, (n, _) in enumerate(found) if n >= least), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, i))
    for k, i in enumerate(able[: percent * len(able) // 100]):
        rows[i][4] = k + 1
    return rows


def plain(df):
    return sorted([[r.id, r.n_features, r.weight, r.score, r["rank"]] for r in df.collect()], key=repr)


def test_checksums_of_any_text():
    rng = random.Random(1)
    texts = ["", None, "a", "Ab cD ef", "x" * 5000 + " y", "ünï 漢字 z", *(
        " ".join("".join(rng.choice("abcXYZé") for _ in range(rng.randrange(1, 300))) for _ in range(9)) for _ in range(20))]
    bucket, row, n_words = R.feature_buckets(*utf8(pa.array(texts)))
    for k, text in enumerate(texts):
        n, wanted = features(text)
        assert n_words[k] == n and sorted(bucket[row == k].tolist()) == sorted(wanted)


@pytest.mark.parametrize("run,left", [(3, 1), (40, 10)])
def test_cutoff_is_exact(spark, monkeypatch, run, left):
    monkeypatch.setattr(R, "RUN", run)
    monkeypatch.setattr(R, "LEFT", left)
    rng = random.Random(run)
    keys = [(rng.randrange(5), rng.randrange(2), rng.randrange(4), k) for k in range(300)]
    df = spark.createDataFrame(keys, ", ".join(f"{k} long" for k in R.KEYS)).repartition(3)
    staged = Staged(spark, "cutoff")
    for wanted in (1, 2, 77, 150, 299, 300):
        assert R.cutoff(df, wanted, staged) == sorted(keys)[wanted - 1]
    assert R.cutoff(df, 0, staged) is None and R.cutoff(df.where("false"), 1, staged) is None


def test_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(R, "LEFT", 8)
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = brute(docs, [r.text for r in target.collect()])
    # Columns called like those the operator makes do not matter.
    odd_names = documents.withColumns({c: F.lit("x") for c in ("id", "score", "rank", "weight", "row")})
    assert plain(R.resample(odd_names, target)) == sorted(wanted, key=repr)


def test_odd_rows(spark, odd, odd_rows):
    target = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    for percent in (25, 100):
        found = plain(R.resample(odd, target, least_words=3, percent=percent))
        assert found == sorted(brute(odd_rows, ["one two three"], 3, percent), key=repr)
    assert R.resample(odd.where("false"), target).count() == 0
    assert plain(R.resample(odd, target.where("false"), least_words=0, percent=0)) == sorted(brute(odd_rows, [], 0, 0), key=repr)


def test_ties_of_many_equal_rows(spark, make):
    rows = [(None, "a b c")] * 40 + [(1, "a b c")] * 40 + [(2, "d e f")] * 3
    found = R.resample(make(rows), make([(0, "a b")]), least_words=2, percent=60).collect()
    drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 83 * 60 // 100 + 1))
    assert [(r.id, r.score) for r in drawn] == [(r[0], r[3]) for r in sorted((x for x in brute(rows, ["a b"], 2, 60) if x[4]), key=lambda x: x[4])]


def test_words_longer_than_a_step():
    data = np.frombuffer(b"q" * 1000, np.uint8)
    state = R.crc_states(data, np.array([0, 5]), np.array([1000, 8]), np.full(2, 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    assert state.tolist() == [zlib.crc32(b"q" * 1000), zlib.crc32(b"qqq")]
