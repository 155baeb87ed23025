"""Bottom-k samples against sorting in plain Python, on any partitioning and merged from parts."""

import random

import pytest
from pyspark.sql import functions as F

from cohortwise.operators import samples
from cohortwise.operators.samples import bottom_k, merge_samples, stratified_sample


def lowest(rows, size):
    """{group: (number of rows, ids of the lowest)} of (id, group, order) rows."""
    groups = {}
    for i, g, o in rows:
        if o is not None and o == o:
            groups.setdefault(g, []).append((o, i))
    return {g: (len(v), sorted(i for _, i in sorted(v)[: size(g)])) for g, v in groups.items()}


def found(df, total="n_total"):
    out = {}
    for r in df.collect():
        n, ids = out.setdefault(r["g"], (r[total], []))
        assert n == r[total]
        ids.append(r["id"])
    return {g: (n, sorted(ids)) for g, (n, ids) in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # A hot group, a null group, small ones, rows without an order.
    return [(i, rng.choice(["hot"] * 6 + ["a", "b", None, f"g{i % 40}"]), rng.choice([rng.random()] * 9 + [None, float("nan")])) for i in range(6000)]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_same_sample_on_any_partitioning(spark, rows, parts, monkeypatch):
    monkeypatch.setattr(samples, "HELD_ROWS", 100)
    df = spark.createDataFrame(rows, "id long, g string, o double").repartition(parts)
    assert found(bottom_k(df, ["g"], 50, F.col("o"))) == lowest(rows, lambda g: 50)


def test_a_task_that_drops_rows_midway(spark):
    """More rows in one task than it holds: what it keeps is joined with what comes after."""
    n = samples.HELD_ROWS * 2 + 7_000
    df = spark.range(0, n, 1, 1).select("id", (F.col("id") % 3).cast("string").alias("g"), (F.lit(n) - F.col("id")).alias("o"))
    wanted = lowest([(i, str(i % 3), n - i) for i in range(n)], lambda g: 50)
    assert found(bottom_k(df, ["g"], 50, F.col("o"))) == wanted


def test_hashed_order_does_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, o double")
    one = found(bottom_k(df.coalesce(1), ["g"], 20, row_key=["id"]))
    assert one == found(bottom_k(df.repartition(31), ["g"], 20, row_key=["id"]))
    assert one["hot"][0] == sum(g == "hot" for _, g, _ in rows) and len(one["hot"][1]) == 20


def test_a_size_per_group(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, o double").repartition(5)
    size = F.when(F.col("g") == "hot", 300).when(F.col("g") == "a", 0).when(F.col("g").isNull(), 2)
    want = lowest(rows, lambda g: {"hot": 300, None: 2}.get(g, 0))
    assert found(bottom_k(df, ["g"], size, F.col("o"))) == {g: v for g, v in want.items() if v[1]}


def test_parts_merge_to_the_whole(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, o double")
    days = [bottom_k(df.where(F.col("id") % 3 == k), ["g"], 30, F.col("o")) for k in range(3)]
    assert found(merge_samples(days, ["g"], 30, F.col("o"))) == lowest(rows, lambda g: 30)
    # Once more, in two steps and to a smaller size.
    first = merge_samples(days[:2], ["g"], 30, F.col("o"))
    assert found(merge_samples([first, days[2]], ["g"], 10, F.col("o"))) == lowest(rows, lambda g: 10)


def test_strata_of_the_target(spark):
    scores = [None, float("nan"), -0.1, 0.1, 0.2, 0.4, 0.95] + [0.6] * 500
    df = spark.createDataFrame(list(enumerate(scores)), "id long, risk_score double").repartition(9)
    out = stratified_sample(df, 2, row_key=["id"])
    assert out.columns == ["id", "risk_score", "stratum", "n_stratum"]
    got = {r["stratum"]: (r["n"], r["n_stratum"]) for r in out.groupBy("stratum").agg(F.count("*").alias("n"), F.max("n_stratum").alias("n_stratum")).collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (1, 1), 3: (2, 500), 5: (1, 1)}
    assert {r["stratum"] for r in stratified_sample(df, {3: 7}, row_key=["id"]).collect()} == {3}


def test_empty_tables_and_taken_names(spark):
    empty = spark.createDataFrame([], "id long, g string, n_total long")
    assert bottom_k(empty.drop("n_total"), ["g"], 5).count() == 0
    with pytest.raises(ValueError, match="n_total"):
        bottom_k(empty, ["g"], 5)
    assert bottom_k(empty, ["g"], 5, total="rows").columns == ["id", "g", "n_total", "rows"]
