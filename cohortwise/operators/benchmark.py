"""Patients against the mean actual risk of people like them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import MIN_PATIENTS
from ..functions import canonical_sex, decade_bin, risk_band, round_to
from ..functions.numbers import not_nan
from ..sources.readers import lowercase_columns, require_columns
from .filters import not_null
from .joins import join_counted

_AGE, _SEX, _STATUS = "_age_group", "_sex", "_status"


def _peer_keys(by_sex: bool, by_age_group: bool, by_status: bool) -> dict[str, Column]:
    keys = {}
    if by_sex:
        keys[_SEX] = canonical_sex(F.col("sex"))
    if by_age_group:
        keys[_AGE] = decade_bin(F.col("age"))
    if by_status:
        keys[_STATUS] = F.col("socioeconomic_status").cast("int")
    return keys


def peer_groups(
    population: DataFrame, by_sex: bool = True, by_age_group: bool = True, by_status: bool = True
) -> DataFrame:
    """Size and mean actual risk per peer group.

    A ten-year group runs from its first year to the first year plus 9: an age such as 39.5 lies
    between two groups and counts in neither.
    """
    population = lowercase_columns(population).withColumn("risk_score", not_nan(F.col("risk_score").cast("double")))
    peers = population.where(F.col("risk_score").isNotNull())
    if by_age_group:
        peers = peers.where(F.col("age") <= decade_bin(F.col("age")) + 9)
    keys = _peer_keys(by_sex, by_age_group, by_status)
    measures = [F.count("*").alias("n_peers"), F.avg("risk_score").alias("_peer_risk")]
    if not keys:
        return peers.agg(*measures)
    return not_null(peers.withColumns(keys), list(keys)).groupBy(*keys).agg(*measures)


def _description(by_sex: bool, by_age_group: bool, by_status: bool) -> Column:
    parts = []
    if by_sex:
        parts.append(F.col("sex"))
    if by_age_group:
        start = decade_bin(F.col("age"))
        parts.append(F.concat(F.lit("edad "), start.cast("string"), F.lit("-"), (start + 9).cast("string")))
    if by_status:
        parts.append(F.concat(F.lit("estrato "), F.col("socioeconomic_status").cast("string")))
    if not parts:
        return F.lit("All patients")
    text = F.lower(F.concat_ws(", ", *parts))
    return F.concat(F.upper(F.left(text, F.lit(1))), F.right(text, F.length(text) - 1))


def benchmark_compare(
    scored_patients: DataFrame,
    population: DataFrame,
    by_sex: bool = True,
    by_age_group: bool = True,
    by_status: bool = True,
    min_rows: int = MIN_PATIENTS,
) -> DataFrame:
    """Every scored patient with the mean actual risk of their peer group and the difference.

    The population is aggregated to peer groups first (a few hundred rows), then joined. A patient
    whose group has fewer than `min_rows` people is kept, with the group size and no benchmark.
    """
    wanted = ["score"] + ["sex"] * by_sex + ["age"] * by_age_group + ["socioeconomic_status"] * by_status
    patients = require_columns(scored_patients, wanted)
    groups = peer_groups(population, by_sex, by_age_group, by_status)
    keys = _peer_keys(by_sex, by_age_group, by_status)
    if keys:
        joined = join_counted(patients.withColumns(keys), groups, list(keys)).drop(*keys)
    else:
        one = groups.select(F.struct("n_peers", "_peer_risk")).scalar()
        joined = patients.withColumn("_one", one).withColumns(
            {"n_peers": F.col("_one.n_peers"), "_peer_risk": F.col("_one._peer_risk")}
        ).drop("_one")
    enough = F.coalesce(F.col("n_peers"), F.lit(0)) >= min_rows
    peer = F.when(enough, F.col("_peer_risk"))
    return joined.withColumns({
        "patient_band": risk_band(F.col("score")),
        "benchmark_group": _description(by_sex, by_age_group, by_status),
        "benchmark_risk": round_to(peer, 4),
        "benchmark_band": risk_band(peer),
        "n_peers": F.coalesce(F.col("n_peers"), F.lit(0).cast("bigint")),
        "difference": round_to(F.col("score") - peer, 4),
        "score": round_to(F.col("score"), 4),
    }).drop("_peer_risk")
