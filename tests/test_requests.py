"""Requests that are whole, that lack or add fields, and that are broken."""

import json

from pyspark.sql import functions as F

from cohortwise.operators.features import prepare_patients
from cohortwise.operators.scoring import score_patients_explained
from cohortwise.plans import driver_model as M
from cohortwise.plans.driver_views import AS_OF, patients
from cohortwise.sources.requests import parse_requests, score_requests

GOOD = {"age": 50, "bmi": 27.5, "department": "ASIA", "municipality": "x", "heart_rate": 70, "diagnosis_date": "2020-02-03T04:05:06"}


def test_statuses(spark):
    rows = [
        ("good", json.dumps(GOOD)), ("extra", json.dumps({**GOOD, "colour": {"a": [1]}, "Zip": 1})), ("missing", json.dumps({k: v for k, v in GOOD.items() if k not in ("bmi", "department")})),
        ("null field", json.dumps({**GOOD, "age": None})), ("wrong type", json.dumps({**GOOD, "age": "old"})), ("cut off", json.dumps(GOOD)[:30]),
        ("list", "[1, 2]"), ("empty", ""), ("null", None), ("text", "hello"), ("no fields", "{}"),
    ]
    found = {r["name"]: r for r in parse_requests(spark.createDataFrame(rows, "name string, body string"), keep=["name"]).collect()}
    assert len(found) == len(rows)
    assert {n: r["status"] for n, r in found.items()} == {
        "good": "ok", "extra": "ok", "missing": "missing", "null field": "missing", "wrong type": "broken", "cut off": "broken", "list": "broken",
        "empty": "broken", "null": "broken", "text": "broken", "no fields": "missing"}
    assert found["good"]["missing"] == [] and found["good"]["extra"] == [] and found["good"]["heart_rate"] == 70 and found["good"]["diagnosis_date"].year == 2020
    assert found["extra"]["extra"] == ["Zip", "colour"] and found["missing"]["missing"] == ["bmi", "department"]
    assert found["no fields"]["missing"] == ["age", "bmi", "department", "municipality"]
    assert all(found[n]["bmi"] is None and found[n]["extra"] is None for n in ("wrong type", "cut off", "null"))


def test_scores_equal_those_of_the_table(spark):
    rows = patients(spark, "/root/testdata/sf0.001")
    asked = rows.select("patient_id", F.to_json(F.struct(*[c for c in rows.columns if c != "patient_id"])).alias("body"))
    found = score_requests(asked, M.individual_model(), keep=["patient_id"], as_of=AS_OF)
    wanted = score_patients_explained(prepare_patients(rows, AS_OF), M.individual_model())
    columns = ["patient_id", "score", "risk_band", "top_factors"]
    assert found.where("status != 'ok'").isEmpty()
    assert sorted(map(repr, found.select(*columns).collect())) == sorted(map(repr, wanted.select(*columns).collect()))
    assert score_requests(asked.where("false"), M.individual_model(), keep=["patient_id"]).count() == 0
