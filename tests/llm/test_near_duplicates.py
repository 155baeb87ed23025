import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import candidates as C, near_duplicates as N
from cohortwise.llm.shared import SKETCHES, Staged, set_sketches, utf8

from .conftest import SF


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))
    holders = {}
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in holders.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            holders[x].append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(parent, i)] = find(parent, j)
    smallest = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            root = find(parent, i)
            smallest[root] = min(smallest.get(root, doc), doc)
    out = []
    for i, (doc, _) in enumerate(docs):
        component = smallest.get(find(parent, i))
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query(spark, documents):
    found = N.op6_near_duplicates(spark, SF)
    wanted = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    assert not all(r[3] for r in wanted)


def family(rng, n, words, changed):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changed + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_chains_and_families(make):
    rng = random.Random(10)
    texts = [t for n, words, changed in ((40, 300, 6), (60, 120, 3), (30, 40, 1), (5, 12, 1)) for t in family(rng, n, words, changed)]
    # A chain: every document is near the next one only.
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[k * 12 : k * 12 + 200]) for k in range(14)]
    texts += ["same again and again now"] * 30
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    assert rows(N.near_duplicates(make(docs))[0]) == brute(docs)


def test_odd_rows(odd, odd_rows, make):
    clash = odd.withColumn("set_class", F.lit("x")).withColumn("class", F.lit("y"))
    assert rows(N.near_duplicates(clash)[0]) == brute(odd_rows)
    assert N.near_duplicates(odd.where("false"))[0].count() == 0
    kept = N.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect() if r.doc_id not in (3, 5, 9)) == sorted(
        (repr(d), t) for d, t in {*odd_rows} if d not in (2, 3, 5, 9))
    assert {r.doc_id for r in kept.collect()} >= {3, 5, 9}
    # An id that stands for two texts, each with copies of its own.
    twice = make([(1, "a b c d e f"), (2, "a b c d e f"), (1, "g h i j k l"), (3, "g h i j k l")])
    assert sorted((r.doc_id, r.text) for r in N.keep_one(twice).collect()) == [(1, "a b c d e f"), (1, "g h i j k l")]


def test_pigeonhole_guarantee():
    """Signatures at the largest distance share a key, wherever they differ."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 16, (200, N.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for r in range(200):
        at = rng.choice(N.SYMBOLS, N.MAX_DISTANCE, replace=False)
        b[r, at] ^= np.uint16(1)
    assert ((a != b).sum(axis=1) == N.MAX_DISTANCE).all()
    assert (N.index_keys(a) == N.index_keys(b)).any(axis=1).all()


def test_sets_and_classes():
    texts = ["One two\tthree four five six", "one TWO three four five  six", "one two", "", "É é five"]
    sets, begin = N.shingle_sets(*utf8(pa.array(texts)))
    assert np.diff(begin).tolist() == [2, 2, 1, 0, 1]
    ids = N.class_ids(sets, begin)
    assert ids[0] == ids[1] and len(set(ids.tolist())) == 4 and ids[3] == -1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 6000 + i) for i in range(50)]
    parent = {}
    for a, b in links:
        for x in (a, b):
            parent.setdefault(x, x)
        parent[find(parent, a)] = find(parent, b)
    smallest = {}
    for x in sorted(parent):
        smallest.setdefault(find(parent, x), x)
    df = spark.createDataFrame([l for l in links if l[0] != l[1]], "a long, b long").repartition(7)
    found = C.components(df, Staged(spark, "test"))
    assert dict(map(tuple, found.distinct().collect())) == {x: smallest[find(parent, x)] for l in links if l[0] != l[1] for x in l}
    assert found.count() == found.distinct().count()
    assert C.components(df.where("false"), Staged(spark, "test")).count() == 0


def test_pairs_by_key_flushes_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH", 10)
    monkeypatch.setattr(C, "BUCKET_KEYS", 16)
    data = [(i, i % 7) for i in range(100)] + [(200 + i, 50 + i) for i in range(20)]
    df = spark.createDataFrame(data, "id long, k long").repartition(5)

    def keys(batch):
        return batch.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), batch.column(0).to_numpy()

    pairs = C.pairs_by_key(df, keys, 120).collect()
    parent = {}
    for p in pairs:
        parent.setdefault((p.key, p.ref), set()).add(p.member)
    assert len(pairs) == 100 - 7 and len({p.key for p in pairs}) == 7


def test_similar_sets_share_a_rare_element(spark):
    rng = random.Random(30)
    common, sets = range(60), []
    for _ in range(12):  # families around the similarity, all with the same sixty elements
        base = [rng.randrange(10**6) for _ in range(60)]
        sets += [{*common, *base[: 60 - rng.randrange(16)], *(rng.randrange(10**6) for _ in range(rng.randrange(9)))} for _ in range(8)]
    sets += [{*common, *(rng.randrange(10**6) for _ in range(60))} for _ in range(100)]
    elements = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "id long, element long")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "id long, size long")
    found = {}
    for r in C._prefixes(elements, sizes, 85).collect():
        found.setdefault(r.id, set()).add(r.element)
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(similar) > 50 and all(found[a] & found[b] for a, b in similar)
    assert not any(found.get(i, set()) & {*common} for i in range(96, len(sets)))


def test_rows_of_one_template_are_not_all_compared(make, monkeypatch):
    """300 texts with a passage that gives them keys in common: 44,850 pairs by the key."""
    rng = random.Random(31)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(300)]
    texts += [t for words in (60, 40) for t in family(rng, 10, words, 2)]
    compared, write = [], Staged.write

    def spy(self, df, name):
        found = write(self, df, name)
        if name == "prefixes":
            compared.append(sum(r["count"] * (r["count"] - 1) // 2 for r in found.groupBy("element").count().collect()))
        return found

    monkeypatch.setattr(Staged, "write", spy)
    docs = list(enumerate(texts))
    assert rows(N.near_duplicates(make(docs))[0]) == brute(docs)
    assert compared and max(compared) < 3000


def test_near_copies_meet_about_once(spark):
    """120 sets around one of 400 elements, each a component: their pairs have sixty rare elements in common, most
    of them. All pairs of any common element are found, and hardly any of them twice."""
    rng = random.Random(32)
    base = [rng.randrange(1 << 40) for _ in range(400)]
    sets = [{*rng.sample(base, 400 - rng.randrange(12)), *(rng.randrange(1 << 40) for _ in range(rng.randrange(12)))} for _ in range(120)]
    sets += [{*base[:300], *(rng.randrange(1 << 40) for _ in range(100))} for _ in range(5)]
    packed = [np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    sketch = np.stack(set_sketches(np.concatenate(packed), np.concatenate([[0], np.cumsum([len(s) for s in sets])])), axis=1)
    sketches = spark.createDataFrame([(i, len(s), *map(int, k)) for i, (s, k) in enumerate(zip(sets, sketch))],
                                     ", ".join(["id long, size long", *(f"{s} long" for s in SKETCHES)]))
    elements = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "id long, element long")
    able = C._prefixes(elements, sketches, 85).join(sketches, "id").withColumn("component", F.col("id")).cache()
    found = [tuple(r) for r in C._met(able, "element", 85).collect()]
    wanted = {tuple(r) for r in C._met(able.drop("earlier"), "element", 85).collect()}
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert len(similar) > 5000 and similar <= {*found} == wanted
    assert len(found) < 2 * len(wanted)


def far_pairs(rng, percent, tries):
    """Pairs of texts just at `percent` that share a key although their signatures are further apart
    than MAX_DISTANCE."""
    texts = []
    for _ in range(tries):
        # Shingles of distinct words: replacing the last m of n words leaves n - 4 - m of n - 4 + m.
        words = [f"w{rng.randrange(10**9)}" for _ in range(184)]
        m = 180 * (100 - percent) // (100 + percent)
        texts += [" ".join(words), " ".join(words[:-m] + [f"x{rng.randrange(10**9)}" for _ in range(m)])]
    signature = N.signatures(*N.shingle_sets(*utf8(pa.array(texts))))
    keys = N.index_keys(signature)
    far = (signature[::2] != signature[1::2]).sum(axis=1) > N.MAX_DISTANCE
    return [t for r in np.flatnonzero(far & (keys[::2] == keys[1::2]).any(axis=1)) for t in texts[2 * r : 2 * r + 2]]


def test_distant_signatures_of_similar_sets_are_linked(make):
    docs = list(enumerate(far_pairs(random.Random(20), 80, 6000)))
    assert docs
    found = rows(N.near_duplicates(make(docs), percent=80)[0])
    assert found == brute(docs, 80) and sum(r[3] for r in found) == len(docs) // 2


def test_op6_links_a_pair_at_its_threshold_with_distant_signatures(spark, make, tmp_path):
    rng = random.Random(8115)  # the first seed that gives such a pair
    words = [f"w{rng.randrange(10**9)}" for _ in range(41)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-3] + [f"x{rng.randrange(10**9)}" for _ in range(3)]))]
    a, b = N.signatures(*N.shingle_sets(*utf8(pa.array([t for _, t in docs]))))
    assert (a != b).sum() > N.MAX_DISTANCE
    make(docs).write.parquet(f"{tmp_path}/documents.parquet")
    found = N.op6_near_duplicates(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == brute(docs) == [(1, 37, 1, True), (2, 37, 1, False)]
