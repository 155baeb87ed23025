"""Small row-by-row recomputations in plain pandas and numpy."""

import numpy as np
import pandas as pd

from cohortwise.operators.features import FeatureSpec
from cohortwise.operators.model import Layer, RiskModel

SPEC = FeatureSpec(
    ("age", "bmi", "total_cholesterol"), ("department", "sex", "occupation"), "robust"
)


def small_spec_model(layers=None, occupations=("Employed", "Retired", "Unemployed")):
    categories = {"department": ["A", "B"], "sex": ["F", "M"], "occupation": list(occupations)}
    width = 3 + sum(map(len, categories.values()))
    rng = np.random.default_rng(3)
    if layers is None:
        layers = (Layer(rng.normal(0, 0.1, (width, 1)), np.array([0.4])),)
    return RiskModel(
        SPEC, {"age": 50.0, "bmi": 27.0, "total_cholesterol": 190.0},
        {"age": (48.0, 20.0), "bmi": (26.0, 5.0), "total_cholesterol": (200.0, 40.0)},
        categories, layers,
    )


def two_layer_model():
    rng = np.random.default_rng(5)
    first = Layer(rng.normal(0, 0.3, (10, 4)), rng.normal(0, 0.1, 4), "leaky_relu")
    second = Layer(rng.normal(0, 0.3, (4, 3)), rng.normal(0, 0.1, 3), "relu", np.array([1.1, 0.9, 1.0]), np.array([0.1, 0.0, -0.1]))
    return small_spec_model((first, second, Layer(rng.normal(0, 0.5, (3, 1)), np.array([0.3]))))


def small_patients(n=300, seed=1):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "id": np.arange(n),
        "department": rng.choice(["A", "B", "C"], n, p=[0.6, 0.3, 0.1]),
        "municipality": rng.choice(["x", "y", "z", "w"], n),
        "sex": rng.choice(["F", "M"], n),
        "occupation": rng.choice(["Employed", "Retired", "Unemployed", "Student"], n),
        "age": rng.integers(1, 95, n).astype(float),
        "bmi": np.round(rng.normal(27, 4, n), 1),
        "total_cholesterol": rng.integers(120, 280, n).astype(float),
        "is_smoker": rng.integers(0, 2, n),
        "diabetes": rng.integers(0, 2, n),
        "risk_score": rng.random(n),
    })
    frame["occupation"] = frame["occupation"].mask(rng.random(n) < 0.1, None).astype(object)
    frame["total_cholesterol"] = frame["total_cholesterol"].mask(rng.random(n) < 0.2)
    frame["bmi"] = frame["bmi"].mask(rng.random(n) < 0.1)
    return frame.astype(object).where(frame.notna(), None)


def to_spark(spark, frame, schema=None):
    schema = schema or (
        "id long, department string, municipality string, sex string, occupation string, age double, "
        "bmi double, total_cholesterol double, is_smoker int, diabetes int, risk_score double"
    )
    rows = [tuple(None if v is None or v != v else v for v in row) for row in frame.itertuples(index=False)]
    rows = [tuple(int(v) if isinstance(v, np.integer) else float(v) if isinstance(v, np.floating) else v for v in row) for row in rows]
    return spark.createDataFrame(rows, schema)


def matrix(frame, model, means):
    """Feature matrix of a batch; None and unseen categories give zeros."""
    blocks = []
    for c in model.spec.numeric:
        x = pd.to_numeric(frame[c]).fillna(means[c]).to_numpy(dtype=float)
        center, scale = model.scaling[c]
        blocks.append(((x - center) / scale)[:, None])
    for c in model.spec.categorical:
        for v in model.categories[c]:
            blocks.append((frame[c] == v).to_numpy(dtype=float)[:, None])
    return np.hstack(blocks)


def forward(model, x):
    for layer in model.layers:
        x = x @ layer.weights + layer.bias
        if layer.activation == "relu":
            x = np.maximum(x, 0)
        elif layer.activation == "leaky_relu":
            x = np.where(x >= 0, x, layer.slope * x)
        if layer.scale is not None:
            x = x * layer.scale + layer.shift
    return x[:, 0]


def cohort_means(frame, model):
    return {c: pd.to_numeric(frame[c]).mean() for c in model.spec.numeric}


def survivors(frame, model):
    return frame[[c for c in model.spec.categorical]].notna().all(axis=1)


def brute_cohorts(frame, key, model, min_rows=10, scope="cohort", n=3):
    """Per cohort: size, mean score over the survivors, top factors."""
    importance = np.abs(model.layers[0].weights).mean(axis=1)
    out = {}
    for value, group in frame[frame[key].notna()].groupby(key):
        if len(group) < min_rows:
            continue
        means = cohort_means(group, model) if scope == "cohort" else model.means
        alive = survivors(group, model).to_numpy()
        x = matrix(group, model, means)[alive]
        activation = x.mean(axis=0) * importance
        names = model.feature_names
        kept = [i for i, name in enumerate(names) if not name.startswith(("department_", "municipality_"))]
        top = sorted(kept, key=lambda i: (-activation[i], i))[:n]
        out[value] = (len(group), forward(model, x).mean(), [(names[i], activation[i]) for i in top])
    return out
