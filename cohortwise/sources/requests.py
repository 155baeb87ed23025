"""Patients as JSON requests, a text per row (M4 over JSON)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from .. import schemas
from ..operators.features import prepare_patients
from ..operators.model import RiskModel
from ..operators.scoring import score_patients_explained

BROKEN = "_broken"
REQUIRED = ("age", "bmi", "department", "municipality")
STATUS = ("ok", "missing", "broken")


def parse_requests(
    requests: DataFrame, body: str = "body", schema: T.StructType = schemas.PATIENTS, required: Sequence[str] = REQUIRED, keep: Sequence[str] = (),
) -> DataFrame:
    """The columns `keep`, the schema's columns, and `status`, `missing`, `extra` for every request.

    A request that is no JSON object, or in which a field has a value of another type, is `broken` and has
    nulls only; one without a value for a required field is `missing`, and `missing` names those. Fields the
    schema does not have are named by `extra` and ignored. Rows are never dropped; a null text is broken.
    """
    full = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    parsed = F.from_json(F.col(body), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    keys = F.json_object_keys(body)
    rows = requests.select(*keep, parsed.alias("_in"), keys.alias("_keys"))
    broken = F.col("_keys").isNull() | F.col(f"_in.{BROKEN}").isNotNull()
    absent = F.array_compact(F.array(*[F.when(F.col(f"_in.{c}").isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    rows = rows.withColumns({
        "status": F.when(broken, STATUS[2]).when(F.size(absent) > 0, STATUS[1]).otherwise(STATUS[0]),
        "missing": F.when(~broken, absent),
        "extra": F.when(~broken, F.array_sort(F.array_except("_keys", F.array(*[F.lit(f.name) for f in schema.fields])))),
    })
    ok = F.col("status") != STATUS[2]
    return rows.select(*keep, "status", "missing", "extra", *[F.when(ok, F.col(f"_in.{f.name}")).alias(f.name) for f in schema.fields])


def score_requests(requests: DataFrame, model: RiskModel, body: str = "body", keep: Sequence[str] = (), as_of=None, **options) -> DataFrame:
    """Every request with its status, and score, band and factors where it is `ok`."""
    parsed = prepare_patients(parse_requests(requests, body, keep=keep, **options), as_of)
    scored = score_patients_explained(parsed, model)
    ok = F.col("status") == STATUS[0]
    results = {c: F.when(ok, F.col(c)).alias(c) for c in ("score", "risk_band", "top_factors")}
    return scored.select(*keep, "status", "missing", "extra", *results.values())
