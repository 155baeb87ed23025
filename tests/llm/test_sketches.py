import random

import numpy as np
import pyarrow as pa

from cohortwise.llm import line_dedup as L, near_duplicates as N
from cohortwise.llm.shared import SKETCHES, may_be_similar, set_sketches, utf8


def apart(a, b):
    return sum((int(x) ^ int(y)).bit_count() if (int(x) ^ int(y)) >= 0 else 64 - (~(int(x) ^ int(y))).bit_count() for x, y in zip(a, b))


def sets_of(lines):
    found = L.Lines(*utf8(pa.array(lines)))
    return found.sets(np.arange(len(found.row)))


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (0, 1, 5, 40, 300, 1500, 2500, 0)]
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketches = np.stack(set_sketches(np.concatenate(sets), begin), axis=1)
    assert not sketches[0].any() and len(set_sketches(np.zeros(0, np.uint64), np.zeros(1, np.int64))[0]) == 0
    for a, x in zip(sets, sketches):
        for b, y in zip(sets, sketches):
            assert apart(x, y) <= len(np.setxor1d(a, b)) and (apart(x, y) - len(np.setxor1d(a, b))) % 2 == 0


def test_sketches_of_lines_do_not_depend_on_the_other_lines():
    lines = ["the first line of some", "x", "a much longer line, with a much longer line in it " * 9, "ÄÖ ẞ 漢字漢字"]
    sets, begin = sets_of(lines)
    assert np.diff(begin).tolist() == [len(L.shingles(line)) for line in lines]
    together = np.stack(set_sketches(sets, begin), axis=1)
    crowd = np.stack(set_sketches(*sets_of([*lines, *(f"line {k}" for k in range(5000))])), axis=1)
    alone = [np.stack(set_sketches(*sets_of([line])), axis=1)[0] for line in lines]
    assert (together == crowd[: len(lines)]).all() and (together == np.stack(alone)).all()


def test_no_similar_pair_is_left_out(spark):
    """Lines with 0 to 30 changed characters: the bound holds for all pairs at 0.8 or more, and spares most others."""
    rng = random.Random(8)
    lines = []
    for n in (30, 60, 120, 250, 700):
        base = "".join(rng.choice("abcdefghij ") for _ in range(n))
        for k in range(31):
            line = list(f"a{base}z")
            for at in rng.sample(range(1, n), min(k, n // 3)):
                line[at] = rng.choice("ABCXYZ")
            lines.append("".join(line))
    sets, begin = sets_of(lines)
    rows = spark.createDataFrame(
        [(k, int(begin[k + 1] - begin[k]), *map(int, s)) for k, s in enumerate(np.stack(set_sketches(sets, begin), axis=1))],
        ", ".join(["id int, size int", *(f"{s} long" for s in SKETCHES)]))
    left, right = (rows.select(*[rows[c].alias(f"{n}_{c}") for c in rows.columns]) for n in "ab")
    found = {(r.a_id, r.b_id) for r in left.join(right, (left.a_id < right.b_id) & may_be_similar(80, "a_", "b_")).select("a_id", "b_id").collect()}
    texts = [L.shingles(line) for line in lines]
    similar = {(a, b) for b in range(len(lines)) for a in range(b) if 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])}
    assert similar and similar <= found and len(found) < 3 * len(similar)


def test_documents_have_sketches_of_their_sets(make):
    docs = make([(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, None), (4, "a b c d e f g i")])
    rows = {r.doc_id: r for r in N.with_class(docs.select("doc_id", "text"), "text", "class", more=True).collect()}
    one, same, none, other = ([rows[k][s] for s in SKETCHES] for k in (1, 2, 3, 4))
    assert one == same and none == [0] * len(SKETCHES) and apart(one, other) in (0, 2)
