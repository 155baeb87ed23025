"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def engine():
    found = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "orders"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in frame.itertuples(index=False))


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["department", "n_patients", "avg_risk", "risk_band", "top_factors"]
    assert df.count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # Only the training-data operators may do without SQL; they have tests of their own.
    assert {q for q in set(QUERIES) - set(ORACLES) if not q.startswith("op") and q != "pipeline"} == set()


def kept(spark):
    """Tables held by the session and by the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/cohortwise"
    staged = os.listdir(folder) if os.path.isdir(folder) else []
    return spark.sparkContext._jsc.getPersistentRDDs().size(), len(staged)


@pytest.mark.parametrize("name", [
    "network_score_by_department", "benchmark_compare", "impute_cohort", "residual_histogram", "error_by_range", "fit_two_features",
    "holdout_metrics", "fit_report_errors", "fit_population_model", "top_factors_of_long_lists",
])
def test_nothing_is_left_behind(spark, name):
    before = kept(spark)
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert kept(spark) == before


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("op") and q != "pipeline"))
def test_query(spark, engine, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(found) > 0
        return
    wanted = engine.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
