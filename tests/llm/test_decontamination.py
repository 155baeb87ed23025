import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import decontamination as D
from cohortwise.llm.fm_index import FMIndex, suffix_array
from cohortwise.llm.shared import table

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        if w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 300):
        text = np.append(rng.integers(0, 3, n), 0)
        keys = []
        for i in range(len(text)):
            run = []
            for j in range(i, len(text)):
                run.append((0, j) if text[j] == 0 else (1, int(text[j])))
                if text[j] == 0:
                    break
            keys.append(run)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: keys[i])


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(0, 5, 500), 0)
    index = FMIndex(text, 5)
    patterns = [tuple(rng.integers(1, 5, k)) for k in (1, 2, 3, 4, 4, 5)]
    matrix = np.zeros((len(patterns), 5), np.int64)
    for i, p in enumerate(patterns):
        matrix[i, 5 - len(p) :] = p
    low, high = index.search(matrix, np.array([len(p) for p in patterns]))
    position, which = index.locate(low, high)
    for i, p in enumerate(patterns):
        wanted = [j for j in range(len(text) - len(p) + 1) if tuple(text[j : j + len(p)]) == p]
        assert sorted(position[which == i]) == wanted


def test_query_against_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(D.op10_decontamination(spark, SF)) == wanted
    assert any(r[5] for r in wanted) and not all(r[5] for r in wanted)


@pytest.mark.parametrize("shard_bytes,block_words", [(1, 1), (200, 20), (1 << 20, 1 << 20)])
def test_random_tables(spark, make, shard_bytes, block_words):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab cd ef".split()) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 20, 60]))) for i in range(30)] + [(40, None), (41, "AB,cd.EF")]
    items = [(i, text(rng.choice([1, 4, 5, 6, 9]))) for i in range(8)] + [(50, None), (51, "..."), (None, "zz yy"), (3, "ab cd"), (3, "ab cd")]
    docs.append((42, "x zz yy x"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.report(make(docs), benchmark, size=4, shard_bytes=shard_bytes, block_words=block_words)
    assert rows(found) == brute(docs, items, 4)


def test_odd_rows(spark, odd, odd_rows):
    benchmark = spark.createDataFrame([(1, "one two three"), (2, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9")], "item_id long, text string")
    assert rows(D.report(odd.withColumn("spans", F.lit(1)), benchmark)) == brute(odd_rows, [tuple(r) for r in benchmark.collect()])
    none = benchmark.where("false")
    assert all(r[2] == 0 for r in rows(D.report(odd, none)))
    assert D.report(odd.where("false"), benchmark).count() == 0


def test_clean_cuts_spans_and_keeps_the_rest(spark, make):
    item = " ".join(f"t{i}" for i in range(12))
    docs = make([(1, f"before it. {item} after"), (2, item), (3, "nothing here"), (4, None), (5, f"{item[:-4]}")])
    docs = docs.withColumn("items", F.lit("x")).withColumn("spans", F.lit(2))
    found = D.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.columns == docs.columns
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts == {1: "before it.   after", 3: "nothing here", 4: None}
