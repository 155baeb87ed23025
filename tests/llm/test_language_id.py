import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortwise.llm import language_id as L
from cohortwise.llm.shared import utf8

from .conftest import SF


def test_automaton_knows_every_substring():
    rng = random.Random(8)
    text = [rng.randrange(1, 4) for _ in range(60)]
    table = L.automaton(text, 4)
    known = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(2000):
        part = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 8))]
        state = 1
        for symbol in part:
            state = table[state, symbol]
            if not state:
                break
        assert bool(state) == (tuple(part) in known)


def brute_costs(parser, samples, data, lane):
    """Phrases by searching the sample itself."""
    out = []
    for k, language in enumerate(parser.languages):
        body = samples[k]
        phrases = 0
        for begin in range(0, len(data), lane):
            part, at = data[begin : begin + lane], 0
            while at < len(part):
                size = 1
                while at + size < len(part) and part[at : at + size + 1] in body:
                    size += 1
                at += size
                phrases += 1
        out.append(phrases * math.log2(len(body) + 2) / len(data))
    return out


def test_costs_against_search(documents):
    samples = {"aa": ["abcabcabd dab"], "bb": ["xyzzy abba xyz"]}
    parser = L.Parser(samples)
    bodies = ["abcabcabd dab|", "xyzzy abba xyz|"]
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdxyz q") for _ in range(rng.choice([1, 5, 40, 200]))) for _ in range(30)]
    data, at = utf8(pa.array(texts))
    found = parser.costs(data, at, lane=16)
    for k, text in enumerate(texts):
        assert np.allclose(found[k], brute_costs(parser, bodies, text, 16))


def test_held_out_accuracy(spark, documents):
    found = L.op8_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == documents.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95


def test_odd_rows(spark, odd, documents):
    learned = L.sample(documents)
    kept = L.identify(odd.withColumn("score_", F.lit(1)), learned).collect()
    undetermined = {r.text for r in kept if r.lang_pred == "und"}
    assert undetermined == {None, "", "  \n\n ", "!!! ... ???"}
    assert all(r.score == 0 for r in kept if r.lang_pred == "und")
    # Nothing to learn from; no rows.
    assert {r.lang_pred for r in L.report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.report(odd.where("false")).count() == 0
    assert {r.score for r in L.report(odd.where("doc_id = 1")).collect()} <= {0.0, 1.0}


def test_held_out_rows_and_other_columns_do_not_matter(documents):
    plain = {r.doc_id: (r.lang_pred, r.score) for r in L.report(documents).collect()}
    changed = documents.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.report(changed).collect()} == plain


def test_keep_languages(documents):
    kept = L.keep_languages(documents.withColumn("lang_pred", F.lit(0)))
    assert kept.columns == [*documents.columns, "lang_pred"]
    assert kept.count() == documents.count()


def test_banners_and_missing_labels(make):
    rng = random.Random(40)
    prose = {"aa": "abcdefgh ", "bb": "stuvwxyz "}
    docs = [(k, "0123 -- all pages begin with this one banner -- " * 12 + "".join(rng.choice(prose[l]) for _ in range(6000)), l)
            for k in range(400) for l in [("aa", "bb")[k % 2]]]
    samples = L.sample(make(docs))
    learned = "".join(chr(c) for c in range(97, 123) if L.Parser({"aa": samples["aa"]}).symbol[c])
    assert set("abcdefgh") <= set(learned)
    plain = make([(900, "abc def abcd hgfe"), (901, "zyx wvu tsz zyxw"), (902, "12 !!"), (903, None)])
    assert {r.doc_id: r.lang_pred for r in L.identify(plain, samples).collect()} == {900: "aa", 901: "bb", 902: "und", 903: "und"}
    assert {r.doc_id for r in L.keep_languages(plain.withColumn("lang", F.lit(None).cast("string"))).collect()} == {900, 901}
