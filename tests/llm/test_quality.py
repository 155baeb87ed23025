import random

import numpy as np
from pyspark.sql import functions as F

from cohortwise.llm import quality as Q
from cohortwise.llm.shared import Staged, table

from .conftest import SF


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_query_scores_all_documents(spark, documents):
    found = rows(Q.op1_quality(spark, SF))
    assert set(found) == {r.doc_id for r in documents.select("doc_id").collect()}
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found.values())


def corpus(n):
    """Two views that each tell the classes apart; few labels."""
    rng = random.Random(14)
    docs, labels = [], []
    for i in range(n):
        y = rng.random() < 0.6
        words = ["good", "calm", "prose", "with", "sense"] if y else ["BUY", "!!!", "$$$", "CLICK", "now"]
        text = " ".join(rng.choice(words) for _ in range(30))
        source = rng.choice("abcd" if y else "wxyz") if rng.random() < 0.9 else rng.choice("abcdwxyz")
        docs.append((i, text, "en", source, len(text)))
        if i % 10 == 0:
            labels.append((i, int(y)))
    return docs, labels, [d[1].split()[0] in ("good", "calm", "prose", "with", "sense") for d in docs]


def test_views_agree_with_the_truth_from_few_labels(spark, documents):
    docs, labels, truth = corpus(1200)
    df = spark.createDataFrame(docs, documents.schema).repartition(6)
    found = rows(Q.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")))
    unseen = [(found[i].score, truth[i]) for i in range(1200) if i % 10]
    assert auc(unseen) > 0.99
    assert np.mean([(s >= 0.5) == y for s, y in unseen]) > 0.97
    assert auc([(found[i].metadata_score, truth[i]) for i in range(1200) if i % 10]) > 0.85


def test_pseudo_labels_reach_the_other_view(spark, documents):
    docs, labels, _ = corpus(600)
    staged = Staged(spark, "test")
    data = Q.features(spark.createDataFrame(docs, documents.schema), spark.createDataFrame(labels, "doc_id long, quality int"),
                      "doc_id", "text", ("lang", "source", "n_chars"), "doc_id", "quality", staged)
    first = Q._fit(data, None)
    Q._calibrate(data, first)
    second = Q._fit(data, first)
    assert any(np.abs(first.weights[v] - second.weights[v]).max() > 1e-3 for v in first.weights)


def test_total_adds_in_levels(spark, monkeypatch):
    monkeypatch.setattr(Q, "FAN", 3)
    df = spark.range(0, 100, 1, 20)
    assert Q.total(df, lambda b: np.array([sum(b.column(0).to_pylist()), b.num_rows], float), 2).tolist() == [4950, 100]


def test_odd_rows(spark, odd, odd_rows, documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (7, None), (8, 0), (None, 1), (99, 1), (3, 1)], "doc_id long, quality int")
    found = Q.classify(odd.withColumn("content", F.lit(1)).withColumn("source", F.lit(None).cast("string")), labels).collect()
    assert len(found) == len(odd_rows)
    assert {(r.doc_id, r.label) for r in found} == {(5, None), (3, 1), (9, None), (1, 1), (2, 0), (7, None), (None, None), (8, 0), (11, None), (12, None)}
    one = Q.classify(odd, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in Q.classify(odd, labels.where("false")).collect()} == {0.5}
    assert Q.classify(odd.where("false"), labels).count() == 0


def test_long_values_and_columns_have_indicators_of_their_own(spark, documents):
    names = ["common_crawl_2023", "news_crawl_2023", *(f"host{k}.example.com" for k in range(400))]
    found = Q.metadata_features([names, names, names])
    assert found[0, 0] != found[1, 0] and len(set(found[:, 0].tolist())) > 200
    columns = [set(c.tolist()) for c in found.T]
    assert not columns[0] & columns[1] and not columns[1] & columns[2] and not columns[0] & columns[2]
    docs, labels, truth = corpus(1200)
    df = spark.createDataFrame([(i, t, l, f"{s}.pages.example.com", 100) for i, t, l, s, _ in docs], documents.schema)
    scored = rows(Q.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")))
    assert auc([(scored[i].metadata_score, truth[i]) for i in range(1200) if i % 10]) > 0.85
