import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import language_model as L

from .conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())), None]


def counted(docs):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score) per row."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    texts = [tokens(t) for _, t in docs]
    count = Counter(w for t, h in zip(texts, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return [(d, h, len(t), sum(w in count for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
            for (d, _), h, t in zip(docs, held, texts)]


def stirling(n, discount):
    """Weights of n customers at t tables, t = 0..n."""
    row = [0.0, 1.0]
    for k in range(1, n):
        row = [0.0] + [row[t - 1] + (k - t * discount) * (row[t] if t < len(row) else 0.0) for t in range(1, k + 2)]
    return row


@pytest.mark.parametrize("count,parent", [(2, 0.2), (3, 0.05), (6, 0.4), (9, 0.01)])
def test_one_dish_has_the_exact_distribution(count, parent):
    many, (discount, strength) = 30_000, L.CONTEXT
    found = L.seat(np.full(many, count), np.arange(many), np.full(many, parent), np.zeros(many), np.zeros(many, bool), discount, strength,
                   np.random.Generator(np.random.PCG64(5)), removals=6 * count)
    weights = np.array([w * parent**t * np.prod([strength + discount * k for k in range(t)]) for t, w in enumerate(stirling(count, discount))])
    assert np.abs(np.bincount(found, minlength=count + 1) / many - weights / weights.sum()).max() < 0.012


def test_two_dishes_of_one_restaurant():
    many, (discount, strength) = 30_000, L.CONTEXT
    counts, parents = (4, 3), (0.3, 0.1)
    found = L.seat(np.tile(counts, many), np.repeat(np.arange(many), 2), np.tile(parents, many), np.zeros(many), np.zeros(many, bool), discount, strength,
                   np.random.Generator(np.random.PCG64(6)), removals=30).reshape(many, 2)
    exact = np.zeros((5, 4))
    for a, x in enumerate(stirling(4, discount)):
        for b, y in enumerate(stirling(3, discount)):
            exact[a, b] = x * y * parents[0] ** a * parents[1] ** b * np.prod([strength + discount * k for k in range(a + b)])
    share = np.zeros((5, 4))
    np.add.at(share, (found[:, 0], found[:, 1]), 1 / many)
    assert np.abs(share - exact / exact.sum()).max() < 0.03  # both dishes move at once


def test_many_customers_and_fixed_tables():
    rng = np.random.Generator(np.random.PCG64(7))
    count = np.array([0, 1, 2, 100_000, 5000, 0, 7])
    context = np.array([0, 0, 0, 1, 1, 1, 2])
    found = L.seat(count, context, np.array([0.01, 0.01, 0.01, 0.5, 0.2, 0.1, 0.01]), np.array([50, 60, 70]), np.array([True, False, False]), *L.CONTEXT, rng)
    assert (found <= count).all() and ((found > 0) == (count > 0)).all() and found[3] > found[4] >= 1


def test_probabilities_add_up():
    rng = np.random.Generator(np.random.PCG64(8))
    words, contexts = np.arange(5), np.array([1, 2, 3])
    count = rng.integers(0, 30, 15) * (np.arange(15) % 5 > 0)
    row = {"bucket": 0, "contexts": L.pack(contexts), "customers": L.pack(count.reshape(3, 5).sum(axis=1)), "words": L.pack(words),
           "first": L.pack(np.diff(np.repeat(np.arange(3), 5), prepend=0).astype(np.int32)), "second": L.pack(np.tile(np.arange(5), 3).astype(np.int32)), "count": L.pack(count)}
    bucket = L.Bucket(row)
    customers, tables = np.array([0, 9, 4, 2, 1]), np.array([0, 3, 2, 1, 1])
    parent = L.Totals(4, 100, customers.sum(), tables.sum()).parent(customers, tables)
    assert abs(parent.sum() - 1) < 1e-12
    found = bucket.probability(bucket.seats(1, parent, None), parent, np.zeros(3, np.int64))
    assert np.abs(found.reshape(3, 5).sum(axis=1) - 1).max() < 1e-12


def test_packing():
    for kind in (np.int32, np.int64, np.float32, np.uint64):
        for n in (0, 1, 1000):
            values = np.arange(n).astype(kind) * 7
            assert (L.unpack(L.pack(values), kind) == values).all()


def test_query(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = {r[0]: r for r in counted(docs)}
    plain = {r.doc_id: r for r in L.op12_language_model(spark, SF).collect()}
    assert len(plain) == len(docs)
    for k, r in plain.items():
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == wanted[k][:5]
        assert abs(r.base_score - wanted[k][5]) < 1e-6 * max(1, abs(wanted[k][5])) and r.score < 0
    held = [r for r in plain.values() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    # Small chunks, buckets and parts give the same counts, and scores that differ by the draw alone.
    for name, value in (("CHUNK_TOKENS", 4000), ("ROOT_WORDS", 3000), ("BUCKET_PAIRS", 9000), ("PART_TOKENS", 200)):
        monkeypatch.setattr(L, name, value)
    split = {r.doc_id: r for r in L.op12_language_model(spark, SF).collect()}
    for k, r in split.items():
        assert tuple(r)[:5] == tuple(plain[k])[:5] and abs(r.base_score - plain[k].base_score) < 1e-6 * abs(r.base_score)
        assert abs(r.score - plain[k].score) < 0.03 * abs(r.score) + 0.5


def test_odd_rows(spark, odd, odd_rows):
    found = L.score(odd.withColumns({c: F.lit("x") for c in ("id", "chunk", "held_out", "score")})).collect()
    assert sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found), key=repr) == sorted((r[:5] for r in counted(odd_rows)), key=repr)
    assert all(math.isfinite(r.score) for r in found)
    assert L.score(odd.where("false")).count() == 0


def test_without_training_documents(odd):
    found = L.score(odd, held=F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in found} == {(0, 0)} and all(abs(r.score) < 1e-9 and abs(r.base_score) < 1e-9 for r in found)
