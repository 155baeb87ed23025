import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortwise.llm import packing as P, shared

from .conftest import SF


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(P.vocabulary_path())
    found.encode_special_tokens = True
    return found


def check(packed, docs, tokenizer, window):
    """Every id of every document in one piece, windows gapless and within bounds."""
    pieces, by_doc = packed.collect(), {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    wanted = {}
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END_ID]
        for start in range(0, len(ids), window):
            part = np.array(ids[start : start + window], "<u4").tobytes()
            wanted.setdefault((doc, start, len(part) // 4, zlib.crc32(part), len(ids)), []).append(1)
    found = {}
    for p in pieces:
        found.setdefault((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens), []).append(1)
    assert found == wanted
    by_window = {}
    for p in pieces:
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return by_window


def test_query(spark, documents, tokenizer):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    windows = check(P.op5_packing(spark, SF), docs, tokenizer, P.WINDOW)
    total = sum(n for parts in windows.values() for _, n in parts)
    assert total / (len(windows) * P.WINDOW) > 0.98


def test_odd_rows(odd, odd_rows, tokenizer):
    packed = P.pack(P.cut(odd.withColumn("ids", F.lit(1)), window=64), len(odd_rows), window=64, group_rows=3)
    check(packed, odd_rows, tokenizer, 64)
    assert P.pack(P.cut(odd.where("false")), 0).count() == 0


def test_segments_give_the_ids_of_whole_texts(tokenizer):
    encode = P.Encoder(P.vocabulary_path())
    for text in ("a  b", " a", "a ", "a\n b", "a \nb", "a\n \nb", "x　 y", "it's  we'll", "a\t b", "", " ", "\n", "1 234 5a<|endoftext|> b", "é\xa0 ß"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_are_remembered_once(tokenizer):
    encode = P.Encoder(P.vocabulary_path())
    words = [f"{a}{b}{c}" for a in "abcdé" for b in "xyzß" for c in "mnop"]
    text = "start " + " ".join(words) + " " + ", ".join(words) + "."
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert set(words) <= set(encode.segments) and not any(w in t for t in encode.tokens for w in words)


def test_a_full_cache_gives_the_same_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CACHE", 3)
    encode = P.Encoder(P.vocabulary_path())
    text = "one two, three. four! 5x six, one two, naïve ﬁn, two?"
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encode.segments) <= 3 and len(encode.tokens) <= 3


def test_best_fit_is_the_tightest_window():
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(1, 33, 300).tolist(), reverse=True)
    found, offsets = P.best_fit(lengths, 32)
    left = []
    for length, window, offset in zip(lengths, found, offsets):
        fits = [c for c in left if c >= length]
        if fits:
            assert left[window] == min(fits) and offset == 32 - left[window]
            left[window] -= length
        else:
            assert window == len(left) and offset == 0
            left.append(32 - length)


def test_a_group_is_packed_without_a_copy_of_its_ids():
    rng = np.random.default_rng(7)
    batches = [pa.RecordBatch.from_pydict({
        "doc_id": pa.array(rng.integers(0, 50, 40)), "start": pa.array(np.zeros(40, np.int64)), "length": pa.array(rng.integers(1, 65, 40)),
        "ids_crc32": pa.array(rng.integers(0, 1 << 32, 40)), "ids": pa.array([[k, k + 1] for k in range(40)], pa.list_(pa.int32()))}) for _ in range(5)]
    group = pa.Table.from_batches(batches)
    found = P.placed(group, 3 << 40, "doc_id", 64)
    where = lambda t: [c.values.buffers()[1].address for c in t["ids"].chunks]
    assert where(found) == where(group) and found.select(group.column_names).equals(group)
    rows = sorted(found.to_pylist(), key=lambda r: (-r["length"], r["doc_id"], r["start"], r["ids_crc32"]))
    windows, offsets = P.best_fit([r["length"] for r in rows], 64)
    assert [(r["sequence_id"], r["offset"]) for r in rows] == [(w + (3 << 40), o) for w, o in zip(windows, offsets)]


def test_packing_holds_no_encoder_and_encoding_nothing_of_other_stages():
    other = shared.cached({"x": 1})
    encode = P.encoder(P.vocabulary_path())
    assert not other and P.encoder(P.vocabulary_path()) is encode
    shared.forget()
    assert not P._encoders


def test_sequences_hold_the_ids(make, tokenizer):
    docs = make([(i, "some words here " * (i % 7)) for i in range(20)])
    rows = P.sequences(P.pack(P.cut(docs, window=16), 20, window=16)).collect()
    got = {}
    for r in rows:
        for p in r.pieces:
            got.setdefault(p.doc_id, {})[p.start] = r.ids[p.offset : p.offset + p.length]
    for i in range(20):
        ids = sum((got[i][s] for s in sorted(got[i])), [])
        assert ids == [*tokenizer.encode("some words here " * (i % 7), add_special_tokens=False).ids, P.END_ID]


def test_queries_encode_added_tokens_as_the_tokenizer_does(spark, make, tmp_path):
    plain = Tokenizer.from_file(P.vocabulary_path())
    docs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "no token <|endoftext| > here"), (4, "x<|endoftext|><|endoftext|>y z")]
    assert plain.encode(docs[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    make(docs).write.parquet(f"{tmp_path}/documents.parquet")
    check(P.op5_packing(spark, str(tmp_path)), docs, plain, P.WINDOW)
