"""A linear model with stated parameters, for queries that score the supplied tables."""

from __future__ import annotations

import numpy as np

from ..operators.features import INDIVIDUAL, POPULATION, FeatureSpec
from ..operators.model import Layer, RiskModel, linear_model

# --- fixed values: numeric column -> (training mean, center, scale, weight) -----------------
NUMERIC = {
    "age": (47.5, 48.0, 47.0, 0.081),
    "bmi": (28.0, 28.0, 10.0, 0.062),
    "heart_rate": (79.5, 80.0, 25.0, 0.013),
    "total_cholesterol": (199.0, 199.0, 50.0, 0.037),
    "glucose": (114.0, 114.0, 45.0, 0.029),
    "is_smoker": (0.33, 0.0, 1.0, 0.091),
    "bpm_meds": (0.25, 0.0, 1.0, 0.043),
    "diabetes": (0.2, 0.0, 1.0, 0.072),
    "has_electricity": (0.5, 0.0, 1.0, -0.011),
    "has_water_supply": (0.33, 0.0, 1.0, -0.017),
    "has_gas": (0.2, 0.0, 1.0, -0.007),
    "has_internet": (0.14, 0.0, 1.0, -0.019),
    "family_history": (0.33, 0.0, 1.0, 0.053),
    "diagnosis_year": (1997.8, 1998.0, 4.0, 0.005),
    "diagnosis_month": (6.4, 6.0, 5.0, 0.003),
    "days_since_diagnosis": (9383.0, 9380.0, 1200.0, -0.021),
    "pandemic_period": (0.0, 0.0, 1.0, 0.031),
}

# --- fixed values: categories and their weights; values left out count as unseen ------------
CATEGORY_WEIGHTS = {
    "department": {"AFRICA": 0.012, "AMERICA": -0.014, "ASIA": 0.022, "EUROPE": -0.024},
    "municipality": {f"NATION_{i}": round((i * 7 % 13 - 6) / 200, 4) for i in range(23)},
    "sex": {"F": -0.033, "M": 0.034},
    "marital_status": {"Divorced": 0.016, "Married": -0.008, "Single": 0.009, "Widowed": 0.018},
    "rural_area": {"R": 0.027, "U": -0.026},
    "education_level": {str(i): round((11 - i) / 400, 4) for i in range(1, 10)},
    "socioeconomic_status": {"1": 0.041, "2": 0.032, "3": 0.0065, "4": -0.015, "5": -0.036},
    "occupation": {"AUTOMOBILE": 0.0145, "BUILDING": 0.0155, "FURNITURE": -0.0135, "MACHINERY": 0.0165},
    "ethnicity": {"Afrocolombian": 0.0235, "Indigenous": 0.0125, "Mestizo/White": -0.0115, "Other": 0.0045},
    "diagnosis_trimester": {"T1": 0.0055, "T2": -0.0075, "T3": 0.0085, "T4": -0.0095},
}
LONG_OCCUPATIONS = {f"B{i}": round(0.03 + i * i % 89 * 0.00737 + i * 0.000113, 6) for i in range(90)}
LONG_CATEGORY_WEIGHTS = {c: LONG_OCCUPATIONS if c == "occupation" else w for c, w in CATEGORY_WEIGHTS.items()}
INTERCEPT = 0.41
HIDDEN_UNITS = 3

# --- fixed values: population model: column -> (mean, center, scale, weight) ----------------
POPULATION_NUMERIC = {
    "age": (47.5, 47.5, 20.0, 0.05),
    "bmi": (28.0, 28.0, 5.0, 0.06),
    "total_cholesterol": (199.0, 199.0, 20.0, 0.03),
    "is_smoker": (0.33, 0.33, 0.3, 0.04),
    "family_history": (0.33, 0.33, 0.3, 0.02),
    "has_electricity": (0.5, 0.5, 0.5, -0.01),
    "has_water_supply": (0.33, 0.33, 0.4, -0.02),
    "has_sewage": (0.75, 0.75, 0.4, -0.03),
    "has_gas": (0.2, 0.2, 0.4, -0.004),
    "has_internet": (0.14, 0.14, 0.3, -0.006),
    "latitude": (3.0, 3.0, 2.0, 0.007),
    "longitude": (-82.0, -82.0, 7.0, 0.008),
    "average_altitude": (1200.0, 1200.0, 700.0, -0.009),
    "average_temperature": (20.0, 20.0, 7.0, 0.011),
    "annual_precipitation": (1225.0, 1225.0, 25.0, 0.012),
    "estimated_population": (13000.0, 13000.0, 7000.0, -0.013),
    "literacy_rate": (89.0, 89.0, 6.0, -0.014),
    "poverty_rate": (28.0, 28.0, 7.0, 0.015),
}
POPULATION_CATEGORY_WEIGHTS = {
    "rural_area": {"R": 0.02, "U": -0.02},
    "socioeconomic_status": {"1": 0.03, "2": 0.02, "3": 0.01, "4": -0.01, "5": -0.02},
    "ethnicity": {"Afrocolombian": 0.011, "Indigenous": 0.012, "Mestizo/White": -0.013, "Other": 0.014},
    "occupation": {"AUTOMOBILE": 0.015, "BUILDING": 0.016, "FURNITURE": -0.017, "HOUSEHOLD": 0.018},
    "education_level": {str(i): round((6 - i) / 500, 4) for i in range(1, 11)},
    "climate_classification": {"C0": 0.021, "C1": -0.022, "C2": 0.023},
}
POPULATION_INTERCEPT = 0.5


def _linear(spec: FeatureSpec, numeric, categories, intercept) -> RiskModel:
    return linear_model(
        spec,
        {c: v[0] for c, v in numeric.items()},
        {c: (v[1], v[2]) for c, v in numeric.items()},
        {c: list(w) for c, w in categories.items()},
        {c: v[3] for c, v in numeric.items()},
        categories,
        intercept,
    )


def individual_model() -> RiskModel:
    return _linear(INDIVIDUAL, NUMERIC, CATEGORY_WEIGHTS, INTERCEPT)


def long_list_model() -> RiskModel:
    """The individual model with many occupations, more than fit a constant map."""
    return _linear(INDIVIDUAL, NUMERIC, LONG_CATEGORY_WEIGHTS, INTERCEPT)


def population_model() -> RiskModel:
    return _linear(POPULATION, POPULATION_NUMERIC, POPULATION_CATEGORY_WEIGHTS, POPULATION_INTERCEPT)


def network_model() -> RiskModel:
    """Two layers: unit k of the first sees the linear weights times (k + 1), then a leaky ramp."""
    linear = individual_model()
    factors = np.arange(1, HIDDEN_UNITS + 1, dtype=float)
    first = linear.layers[0].weights * factors
    layers = (
        Layer(first, np.full(HIDDEN_UNITS, -0.05), "leaky_relu"),
        Layer(np.array([[0.5], [0.25], [0.125]]), np.array([INTERCEPT])),
    )
    return RiskModel(linear.spec, linear.means, linear.scaling, linear.categories, layers)
