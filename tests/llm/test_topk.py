import math
import random

import numpy as np
from pyspark.sql import functions as F

from cohortwise.llm import topk as K
from cohortwise.llm.shared import table

from .conftest import SF


def brute(rows, asked, k=10, scale=1024):
    ok = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if asked(q):
            scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert rows(K.op4_topk(spark, SF)) == brute(vectors, lambda q: q % 100 == 0)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(K, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    data = [(i, [rng.choice([-1.0, 0.5, 0.25, 3.0]) for _ in range(rng.choice([8, 8, 8, 33, 0]))]) for i in range(120)]
    data += [(200, None), (210, [1.0, None]), (220, [float("nan")] * 8), (230, [float("inf")] * 8), (None, [1.0] * 8), (240, [1.0] * 8), (250, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("ids", F.lit(0))
    found = K.top_k(df, df.where(F.col("vec_id") % 10 == 0), k=4)
    assert rows(found) == brute(data, lambda q: q % 10 == 0, 4)
    assert K.top_k(df.where("false"), df.where("false")).count() == 0


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(6)
    a, b = rng.integers(-900, 900, (5, 40)), rng.integers(-900, 900, (9, 40))
    exact = a @ b.T
    for x, y in zip(K.Summaries(a).levels, K.Summaries(b).levels):
        assert (x @ y.T >= exact - 1e-6).all()
