"""The queries that have checking SQL against it, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from cohortwise.llm.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def engine():
    found = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def plain(value):
    """Whole numbers alike, whether pandas holds them as integers or, beside nulls, as floats."""
    if pd.isna(value):
        return None
    return int(value) if isinstance(value, float) and value.is_integer() else value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False))


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, engine, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), engine.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
