import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import quantiles
from cohortwise.operators.quantiles import exact_percentiles, order_statistics

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 4000
    data = {
        "normal": rng.normal(0, 1, n),
        "heavy": np.exp(rng.normal(0, 4, n)),
        "few": rng.integers(0, 7, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 3.25, rng.random(n)),
        "constant": np.full(n, 5.0),
    }
    group = rng.integers(0, 3, n)
    rows = [(int(g), *map(float, r)) for g, *r in zip(group, *data.values())]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in data)).repartition(5).cache()
    return df, data, group


@pytest.mark.parametrize("read_out", [5000, 50, 1])
def test_percentiles_match_numpy(table, read_out):
    df, data, _ = table
    found = exact_percentiles(df, {c: F.col(c) for c in data}, PROBS, read_out_rows=read_out)
    for c, x in data.items():
        assert found[0, c] == pytest.approx(np.percentile(x, np.array(PROBS) * 100), rel=1e-12, abs=1e-12), c


def test_grouped_percentiles(table):
    df, data, group = table
    found = exact_percentiles(
        df, {"heavy": F.col("heavy")}, (0.25, 0.5, 0.75), by=F.col("g"), read_out_rows=20
    )
    for g in range(3):
        assert found[g, "heavy"] == pytest.approx(np.percentile(data["heavy"][group == g], [25, 50, 75]), rel=1e-12)


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "x double, y double")
    found = exact_percentiles(df, {"x": F.col("x"), "y": F.col("y")}, (0.5,))
    assert found[0, "x"] == [2.0]
    assert found[0, "y"] == [None]


def test_order_statistics(table):
    df, data, group = table
    found = order_statistics(df, F.col("normal"), F.col("g"), {0: [0, 100], 2: [7]}, read_out_rows=3)
    assert found[0][0] == np.sort(data["normal"][group == 0])[0]
    assert found[0][100] == np.sort(data["normal"][group == 0])[100]
    assert found[2][7] == np.sort(data["normal"][group == 2])[7]
    with pytest.raises(ValueError):
        order_statistics(df, F.col("normal"), F.col("g"), {0: [10**9]})


def test_narrowing_takes_few_passes(table, monkeypatch):
    df, data, _ = table
    passes = []
    real = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: (passes.append(1), real(*a)))
    exact_percentiles(df, {"normal": F.col("normal")}, (0.5,), read_out_rows=10)
    assert len(passes) <= 2
