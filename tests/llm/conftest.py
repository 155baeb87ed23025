import os

import pytest
from pyspark.sql import types as T

from cohortwise.llm.shared import table

SF = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session", autouse=True)
def on_path():
    os.environ["PYTHONPATH"] = os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, lang]) rows."""

    def build(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
# Null, empty, blank, ties, repeated rows, a very long text, a null id, ids that are equal.
ODD = [(5, None), (3, ""), (9, "  \n\n "), (1, "one two three"), (1, "one two three"), (2, "one two three"), (7, LONG), (None, "no id here"),
       (8, "Ünïcödé ß 漢字 text　with wide\xa0spaces \n tail "), (11, "!!! ... ???"), (12, "<|endoftext|> x")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
