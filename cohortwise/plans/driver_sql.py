"""SQL that states what the driver queries must return, for a second engine to check.

Written row by row, the way the questions are asked: nulls are filled with a window mean, every row
is scored, cohorts are averaged. The operators get there differently, which is the point.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..fixed_values import (
    AGE_EDGES, AGE_LABELS, EDUCATION_LABELS, FEATURE_GROUPS, GEO_FEATURE_GROUP,
    PRECIPITATION_EDGES, RISK_BAND_EDGES, RISK_BAND_LABELS, TARGET_EDGES, TEMPERATURE_EDGES,
)
from . import driver_model as M
from .driver_views import AS_OF, MUNICIPALITY_COLUMNS, PATIENT_COLUMNS

PATIENTS = "patients_v AS (SELECT {} FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)".format(
    ", ".join(f"{text} AS {name}" for name, (text, _) in PATIENT_COLUMNS.items())
)
MUNICIPALITIES = "municipalities_v AS (SELECT {} FROM nation JOIN region ON n_regionkey = r_regionkey)".format(
    ", ".join(f"{text} AS {name}" for name, text in MUNICIPALITY_COLUMNS.items())
)
PREPARED = (
    "prep AS (SELECT *, CAST(year(diagnosis_date) AS INT) AS diagnosis_year, "
    "CAST(month(diagnosis_date) AS INT) AS diagnosis_month, "
    "'T' || CAST(quarter(diagnosis_date) AS VARCHAR) AS diagnosis_trimester, "
    f"CAST(date_diff('day', diagnosis_date, TIMESTAMP '{AS_OF}') AS INT) AS days_since_diagnosis, "
    "CASE WHEN year(diagnosis_date) IN (2020, 2021, 2022) THEN 1 ELSE 0 END AS pandemic_period "
    "FROM patients_v)"
)
NEEDED = [c for c in M.CATEGORY_WEIGHTS if c != "diagnosis_trimester"]


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def band(x: str) -> str:
    cases = " ".join(f"WHEN {x} < {e} THEN '{label}'" for e, label in zip(RISK_BAND_EDGES, RISK_BAND_LABELS))
    return f"CASE WHEN {x} IS NULL THEN NULL {cases} ELSE '{RISK_BAND_LABELS[-1]}' END"


def bins(x: str, edges: Sequence[float], labels: Sequence, right: bool = True) -> str:
    """Interval label; right-closed with a closed first interval, or left-closed."""
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if right:
            low = ">=" if i == 0 else ">"
            test = f"{x} {low} {a} AND {x} <= {b}"
        else:
            test = f"{x} >= {a} AND {x} < {b}"
        label = f"'{labels[i]}'" if isinstance(labels[i], str) else str(labels[i])
        out.append(f"WHEN {test} THEN {label}")
    return f"CASE {' '.join(out)} END"


def labels(edges: Sequence[float], unit: str) -> list[str]:
    return [f"{a}-{b}{unit}" for a, b in zip(edges, edges[1:])]


def alive(extra: Sequence[str] = ()) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in [*NEEDED, *extra])


def filled(source: str, cohort: str | None, name: str = "filled") -> str:
    """Rows with imputed `f_` columns: cohort mean, whole-table mean ('') or training mean (None)."""
    cols = []
    for c, (mean, _, _, _) in M.NUMERIC.items():
        if cohort is None:
            fill = str(mean)
        elif cohort == "":
            fill = f"avg({c}) OVER ()"
        else:
            fill = f"avg({c}) OVER (PARTITION BY {cohort})"
        cols.append(f"coalesce(CAST({c} AS DOUBLE), {fill}) AS f_{c}")
    return f"{name} AS (SELECT *, {', '.join(cols)} FROM {source})"


def score_text() -> str:
    terms = [str(M.INTERCEPT)]
    terms += [f"({w}) * ((f_{c} - {center}) / {scale})" for c, (_, center, scale, w) in M.NUMERIC.items()]
    for c, weights in M.CATEGORY_WEIGHTS.items():
        cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in weights.items())
        terms.append(f"coalesce(CASE CAST({c} AS VARCHAR) {cases} ELSE 0 END, 0)")
    return " + ".join(terms)


def network_text() -> str:
    linear = f"({score_text()} - {M.INTERCEPT})"
    unit = []
    for k, out in ((1, 0.5), (2, 0.25), (3, 0.125)):
        z = f"(lin * {k} - 0.05)"
        unit.append(f"{out} * CASE WHEN {z} >= 0 THEN {z} ELSE 0.3 * {z} END")
    return linear, f"{M.INTERCEPT} + " + " + ".join(unit)


def scored(source: str, cohort: str | None, extra: Sequence[str] = (), network: bool = False) -> str:
    """CTEs `filled` and `scored`; the score is null where a row does not survive cleaning."""
    if network:
        linear, net = network_text()
        return (
            f"{filled(source, cohort)}, lin0 AS (SELECT *, {linear} AS lin FROM filled), "
            f"scored AS (SELECT *, CASE WHEN {alive(extra)} THEN {net} END AS score FROM lin0)"
        )
    return (
        f"{filled(source, cohort)}, "
        f"scored AS (SELECT *, CASE WHEN {alive(extra)} THEN {score_text()} END AS score FROM filled)"
    )


BASE = f"{PATIENTS}, {PREPARED}"
RISK = f"CAST(count(*) AS BIGINT) AS n_patients, round(avg(score), 4) AS avg_risk, {band('avg(score)')} AS risk_band"
PROFILE_AVG = "round(avg(bmi), 2) AS avg_bmi, round(avg(age), 2) AS avg_age"
PROFILE_PCT = "round(avg(is_smoker) * 100.0, 2) AS smoking_percentage, round(avg(diabetes) * 100.0, 2) AS diabetes_percentage"
PROFILE = f"{PROFILE_AVG}, {PROFILE_PCT}"


def cohort_sql(
    keys: Sequence[str], key_text: str | None = None, measures: str = "", more: str = "",
    min_rows: int = 10, cohort: bool = True, network: bool = False,
) -> str:
    """A cohort report over the patients; `key_text` computes the (only) key."""
    source, base = "prep", BASE
    if key_text:
        base += f", keyed AS (SELECT *, {key_text} AS {keys[0]} FROM prep)"
        source = "keyed"
    scope = ", ".join(keys) if cohort else None
    tests = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    chosen = ", ".join(keys)
    having = f" HAVING count(*) >= {min_rows}" if min_rows else ""
    extras = "".join(f", {x}" for x in (measures, more) if x)
    return (
        with_(base, scored(source, scope, network=network))
        + f"SELECT {chosen}, {RISK}{extras} FROM scored WHERE {tests} GROUP BY {chosen}{having}"
    )


def place_sql(value: str, key: str, edges: Sequence[float], unit: str, measures: str, parse: bool) -> str:
    """A cohort report by a bin of a municipality column, patients joined row by row."""
    places = "places AS (SELECT * FROM municipalities_v)"
    if parse:
        places = (
            "parts AS (SELECT *, list_transform(string_split(trim(annual_precipitation), '-'), "
            "lambda p: TRY_CAST(trim(p) AS DOUBLE)) AS ps FROM municipalities_v), "
            "places AS (SELECT * REPLACE (CASE WHEN len(list_filter(ps, lambda p: p IS NULL)) = 0 "
            "THEN list_sum(ps) / len(ps) END AS annual_precipitation) FROM parts)"
        )
    columns = [c for c in MUNICIPALITY_COLUMNS if c not in ("department", "municipality")]
    text = bins(value, edges, labels(edges, unit))
    joined = (
        f"joined AS (SELECT prep.*, {', '.join('places.' + c for c in columns)}, {text} AS {key} "
        "FROM prep LEFT JOIN places USING (department, municipality))"
    )
    return (
        with_(BASE, MUNICIPALITIES, places, joined, scored("joined", key, columns))
        + f"SELECT {key}, {RISK}, {measures} FROM scored WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) >= 10"
    )


def infrastructure_sql() -> str:
    selects = []
    parts = [BASE]
    for c in ("has_electricity", "has_water_supply", "has_gas", "has_internet"):
        parts.append(filled("prep", c, f"filled_{c}"))
        parts.append(f"scored_{c} AS (SELECT *, CASE WHEN {alive()} THEN {score_text()} END AS score FROM filled_{c})")
        selects.append(
            f"SELECT '{c}' AS indicator, CAST({c} AS INT) AS access_code, {RISK}, {PROFILE}, "
            f"CASE WHEN {c} = 1 THEN 'Con acceso' ELSE 'Sin acceso' END AS access "
            f"FROM scored_{c} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 10"
        )
    return with_(*parts) + " UNION ALL ".join(selects)


def feature_table(categories=M.CATEGORY_WEIGHTS) -> list[tuple[int, str, str, float]]:
    """(number, name, activation of a filled row, importance) of every model feature."""
    rows = [
        (i, c, f"(f_{c} - {center}) / {scale}", abs(w)) for i, (c, (_, center, scale, w)) in enumerate(M.NUMERIC.items())
    ]
    for c, weights in categories.items():
        for v, w in weights.items():
            rows.append((len(rows), f"{c}_{v}", f"CASE WHEN CAST({c} AS VARCHAR) = '{v}' THEN 1.0 ELSE 0.0 END", abs(w)))
    return rows


def factors_sql(
    key: str, n: int, where: str = "TRUE", key_text: str | None = None, categories=M.CATEGORY_WEIGHTS, replaced: str = "",
) -> str:
    """Top factors per cohort in long form; `replaced` gives columns of the view other values."""
    kept = [f for f in feature_table(categories) if not f[1].startswith(("department_", "municipality_"))]
    means = ", ".join(f"avg(CASE WHEN {alive()} THEN {text} END) AS a{i}" for i, _, text, _ in kept)
    unpivot = " UNION ALL ".join(
        f"SELECT {key}, {i} AS idx, '{name}' AS feature, a{i} * {imp} AS value FROM means WHERE a{i} IS NOT NULL"
        for i, name, _, imp in kept
    )
    size = "" if key_text else " HAVING count(*) >= 10"
    return (
        with_(BASE, f"keyed AS (SELECT *{f' REPLACE ({replaced})' if replaced else ''}{', ' + key_text + ' AS ' + key if key_text else ''} FROM prep WHERE {where})",
              filled("keyed", key), f"means AS (SELECT {key}, {means} FROM filled WHERE {key} IS NOT NULL GROUP BY {key}{size})",
              f"long AS ({unpivot})",
              f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY value DESC, idx) AS rank FROM long)")
        + f"SELECT {key}, CAST(rank AS INT) AS rank, feature, round(value, 4) AS value FROM ranked WHERE rank <= {n}"
    )


def explained_sql(n: int = 5) -> str:
    unpivot = " UNION ALL ".join(
        f"SELECT patient_id, {i} AS idx, '{name}' AS feature, ({text}) * {imp} AS value FROM scored WHERE score IS NOT NULL"
        for i, name, text, imp in feature_table()
    )
    return (
        with_(BASE, scored("prep", None), f"long AS ({unpivot})",
              "ranked AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY value DESC, idx) AS rank FROM long)")
        + "SELECT s.patient_id, round(s.score, 4) AS score, " + band("s.score") + " AS risk_band, "
        f"CAST(r.rank AS INT) AS rank, r.feature, round(r.value, 4) AS value FROM ranked r JOIN scored s USING (patient_id) WHERE r.rank <= {n}"
    )


GROUP_KEYS = (
    "department, municipality, rural_area, socioeconomic_status, ethnicity, occupation, education_level, climate_classification"
)
GROUP_MEANS = (
    "age", "bmi", "total_cholesterol", "is_smoker", "family_history", "has_electricity",
    "has_water_supply", "has_sewage", "has_gas", "has_internet", "risk_score",
)
GROUP_PLACE = (
    "latitude", "longitude", "average_altitude", "average_temperature", "annual_precipitation",
    "estimated_population", "literacy_rate", "poverty_rate",
)


def groups() -> str:
    """CTEs up to `grouped`: patients joined row by row, then grouped by eight keys."""
    place = ", ".join(f"min({c}) AS {c}" for c in GROUP_PLACE)
    return (
        f"{PATIENTS}, {MUNICIPALITIES}, "
        "parts AS (SELECT *, list_transform(string_split(trim(annual_precipitation), '-'), "
        "lambda p: TRY_CAST(trim(p) AS DOUBLE)) AS ps FROM municipalities_v), "
        "places AS (SELECT * REPLACE (CASE WHEN len(list_filter(ps, lambda p: p IS NULL)) = 0 "
        "THEN list_sum(ps) / len(ps) END AS annual_precipitation) FROM parts), "
        "joined AS (SELECT * FROM patients_v LEFT JOIN places USING (department, municipality)), "
        f"grouped AS (SELECT {GROUP_KEYS}, {', '.join(f'avg({c}) AS {c}' for c in GROUP_MEANS)}, {place}, "
        "CAST(count(*) AS BIGINT) AS n_patients FROM joined WHERE "
        + " AND ".join(f"{k.strip()} IS NOT NULL" for k in GROUP_KEYS.split(","))
        + f" GROUP BY {GROUP_KEYS})"
    )


def population_scored() -> str:
    cols = ", ".join(
        f"coalesce({c}, avg({c}) OVER (PARTITION BY municipality)) AS f_{c}" for c in M.POPULATION_NUMERIC
    )
    terms = [str(M.POPULATION_INTERCEPT)]
    terms += [f"({w}) * ((f_{c} - ({center})) / {scale})" for c, (_, center, scale, w) in M.POPULATION_NUMERIC.items()]
    for c, weights in M.POPULATION_CATEGORY_WEIGHTS.items():
        cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in weights.items())
        terms.append(f"coalesce(CASE CAST({c} AS VARCHAR) {cases} ELSE 0 END, 0)")
    return (
        f"{groups()}, gfilled AS (SELECT *, {cols} FROM grouped), "
        f"gscored AS (SELECT *, {' + '.join(terms)} AS risk_estimate FROM gfilled)"
    )


def parted(source: str, order: str, test: str = "0.2") -> str:
    """CTE `parted`: rows of `source` with `is_test`, an exact share of every target bin."""
    return (
        f"binned AS (SELECT *, {target_bin('risk_score')} AS bin, {order} AS h FROM {source}), "
        f"sizes AS (SELECT bin, count(*) AS n, ceil({test} * sum(count(*)) OVER ()) AS wanted, sum(count(*)) OVER () AS total FROM binned GROUP BY bin), "
        "shares AS (SELECT *, floor(n * CAST(wanted AS DOUBLE) / total) AS base, n * CAST(wanted AS DOUBLE) / total AS share FROM sizes), "
        "final AS (SELECT bin, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, bin) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM shares), "
        "parted AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h) <= k AS is_test FROM binned JOIN final USING (bin))"
    )


def fitted_sql(numeric: Sequence[str], categories: Sequence[str], missing: str | None = None) -> str:
    """What a fit over `train` must satisfy, per feature: rows that have it, its mean, and a zero
    where the gradient of the ridge problem is."""
    selects = [
        f"SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n_active, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, CAST(0.0 AS DOUBLE) AS gradient FROM train"
        for c in numeric
    ]
    for c in categories:
        text = f"CAST({c} AS VARCHAR)" if missing is None else f"coalesce(CAST({c} AS VARCHAR), '{missing}')"
        selects.append(
            f"SELECT '{c}_' || {text} AS feature, CAST(count(*) AS BIGINT) AS n_active, CAST(NULL AS DOUBLE) AS mean, CAST(0.0 AS DOUBLE) AS gradient "
            f"FROM train WHERE {text} IS NOT NULL GROUP BY 1"
        )
    return " UNION ALL ".join(selects)


def target_bin(x: str) -> str:
    return "(" + " + ".join(f"CAST({x} >= {e} AS INT)" for e in TARGET_EDGES) + ")"


def group_of(feature: str, include_geo: bool) -> str:
    cases = []
    for name, prefixes in FEATURE_GROUPS.items():
        if name == GEO_FEATURE_GROUP and not include_geo:
            continue
        cases += [f"WHEN starts_with({feature}, '{p}') THEN '{name}'" for p in prefixes]
    return f"CASE {' '.join(cases)} ELSE 'Others' END"


AGE_BAND = bins("age", AGE_EDGES, AGE_LABELS, right=False)
TEMPERATURE = (TEMPERATURE_EDGES, "°C")
PRECIPITATION = (PRECIPITATION_EDGES, "mm")
EDUCATION = "CASE education_level " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EDUCATION_LABELS.items()) + " END"
