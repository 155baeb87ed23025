"""Each stage against brute force on the rows it was given."""

import importlib.util
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortwise.llm import packing
from cohortwise.llm.shared import Staged

from . import test_decontamination, test_line_dedup, test_near_duplicates
from .conftest import SF

P = importlib.import_module("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
pytestmark = pytest.mark.skipif(P is None, reason="the pipeline is not there")


@pytest.fixture(scope="module")
def steps(spark, documents):
    staged, docs, out = Staged(spark, "pipeline-test"), documents, []
    for name, stage in P.STAGES:
        docs = staged.write(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_stages_return_the_columns_of_documents(spark, documents, steps):
    for rows in steps[:-1]:
        assert list(rows[0].asDict()) == documents.columns


def test_language(documents, steps):
    wanted = {r.doc_id for r in documents.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in steps[0]} == wanted


def test_lines(steps):
    wanted = {}
    for doc, text, n_lines, n_removed in test_line_dedup.brute([(r.doc_id, r.text) for r in steps[0]]):
        if not n_removed or any(p.strip() for p in text.split("\n")):
            wanted[doc] = text
    assert {r.doc_id: r.text for r in steps[1]} == wanted


def test_near(steps):
    before = {r.doc_id: r.text for r in steps[1]}
    kept = {doc for doc, _, _, kept in test_near_duplicates.brute(list(before.items())) if kept}
    assert {r.doc_id: r.text for r in steps[2]} == {d: before[d] for d in kept}


def test_benchmark(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in steps[2]}
    found = {doc: (n_words, n_hit) for doc, n_words, n_hit, _, _, _ in test_decontamination.brute(list(before.items()), items)}
    after = {r.doc_id: r.text for r in steps[3]}
    assert set(after) == {d for d, (n, hit) in found.items() if not hit or hit < n}
    for doc, text in after.items():
        n, hit = found[doc]
        assert len(test_decontamination.split(text)) == n - hit
        if not hit:
            assert text == before[doc]


def test_pack(steps):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    pieces = {}
    for r in steps[4]:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= packing.WINDOW
        pieces.setdefault(r.doc_id, {})[r.start] = r.ids
    assert set(pieces) == {r.doc_id for r in steps[3]}
    for r in steps[3]:
        ids = sum((pieces[r.doc_id][s] for s in sorted(pieces[r.doc_id])), [])
        assert ids == [*tokenizer.encode(r.text, add_special_tokens=False).ids, packing.END_ID]


def test_run_gives_the_rows_of_the_last_stage(spark, steps):
    found = P.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, found.collect())) == sorted(map(key, steps[4]))


def test_near_links_from_80_percent(spark, make):
    words = [f"w{k}" for k in range(104)]
    # 90 of 110 shingles are shared (0.82), and 88 of 112 (0.79).
    docs = [(1, " ".join(words)), (2, " ".join(words[:-10] + ["x"] + [f"x{k}" for k in range(9)])),
            (3, " ".join("v" + w for w in words)), (4, " ".join(["v" + w for w in words[:-12]] + [f"y{k}" for k in range(12)]))]
    kept = {r.doc_id for r in P.near(spark, make(docs), SF).collect()}
    assert kept == {d for d, _, _, k in test_near_duplicates.brute(docs, 80) if k} == {1, 3, 4}


def test_pack_encodes_added_tokens_as_the_tokenizer_does(spark, make):
    ids = [r.ids for r in P.pack(spark, make([(1, "a <|endoftext|> b")]), SF).collect()]
    assert ids == [[64, 220, 50256, 275, packing.END_ID]]
