import zlib

from cohortwise.llm import sharding as S

from .conftest import SF


def check(found, docs, shards):
    rows = found.collect()
    encode = lambda t: (t or "").encode()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (repr(d), len(encode(t)) + 16, zlib.crc32(encode(t))) for d, t in docs)
    by_shard, by_text = {}, {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())
    return rows


def loads(rows, shards):
    out = [0] * shards
    for r in rows:
        out[r.shard] += r.size
    return out


def test_query(spark, documents):
    rows = check(S.op9_sharding(spark, SF), [(r.doc_id, r.text) for r in documents.collect()], 40)
    sizes = {}
    for r in rows:
        sizes[(r.text_crc32, r.size)] = sizes.get((r.text_crc32, r.size), 0) + r.size
    # One bucket: the same loads as the rule applied to all groups at once.
    plain = [0] * 40
    for size in sorted(sizes.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert sorted(loads(rows, 40)) == sorted(plain)


def test_many_buckets_stay_even(make):
    docs = [(i, "x" * (i % 97) + str(i)) for i in range(3000)] + [(5000 + i, "copy") for i in range(1500)]
    rows = check(S.shard_documents(make(docs), 4, bucket_groups=200, slot_rows=300), docs, 4)
    made = loads(rows, 4)
    assert max(made) - min(made) < 0.01 * sum(made)


def test_odd_rows(odd, odd_rows):
    check(S.shard_documents(odd.drop("source"), 3), odd_rows, 3)
    assert S.shard_documents(odd.where("false")).count() == 0
