"""Models as Parquet tables (S7): weights, scaler, categories and settings."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession, functions as F

from ..operators.features import FeatureSpec
from ..operators.model import Layer, RiskModel

_LAYERS = "layer int, part string, row int, values array<double>"
_SCALER = "position int, column string, mean double, center double, scale double"
_CATEGORIES = "position int, column string, number int, value string"
_SETTINGS = "name string, value string"


def _layer_rows(model: RiskModel):
    for i, layer in enumerate(model.layers):
        for r, row in enumerate(np.asarray(layer.weights, dtype=float).tolist()):
            yield i, "weights", r, row
        for part in ("bias", "scale", "shift"):
            vector = getattr(layer, part)
            if vector is not None:
                yield i, part, 0, np.asarray(vector, dtype=float).tolist()


def save_model(spark: SparkSession, model: RiskModel, path: str) -> None:
    """Writes the model's tables under `path`; their size does not depend on the patients."""
    spec = model.spec
    scaler = [
        (i, c, float(model.means[c]), *map(float, model.scaling[c])) for i, c in enumerate(spec.numeric)
    ]
    categories = [
        (i, c, j, v) for i, c in enumerate(spec.categorical) for j, v in enumerate(model.categories[c])
    ]
    settings = {
        "scaler": spec.scaler,
        "missing_category": json.dumps(spec.missing_category),
        "categorical": json.dumps(list(spec.categorical)),
        "nullable_categories": json.dumps(list(spec.nullable_categories)),
        "activations": json.dumps([[layer.activation, layer.slope] for layer in model.layers]),
        "info": json.dumps(dict(model.info)),
    }
    tables = {
        "layers": (list(_layer_rows(model)), _LAYERS),
        "scaler": (scaler, _SCALER),
        "categories": (categories, _CATEGORIES),
        "settings": (list(settings.items()), _SETTINGS),
    }
    # A new folder per save, its settings last: a save that fails midway leaves the model before it
    # in place, and readers never see tables of two models.
    old = _versions(spark, path)
    folder = f"{path}/version-{(old[-1] if old else 0) + 1:06d}"
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete models below `path`."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/settings/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getParent().getName().removeprefix("version-")) for f in found or [])


def load_model(spark: SparkSession, path: str) -> RiskModel:
    """The last model `save_model` wrote completely."""
    saved = _versions(spark, path)
    if not saved:
        raise ValueError(f"no complete model below {path}")

    def table(name, schema):
        return spark.read.schema(schema).parquet(f"{path}/version-{saved[-1]:06d}/{name}")

    settings = {r["name"]: r["value"] for r in table("settings", _SETTINGS).collect()}
    scaler = table("scaler", _SCALER).orderBy("position").collect()
    categorical = json.loads(settings["categorical"])
    categories: dict[str, list[str]] = {c: [] for c in categorical}
    for r in table("categories", _CATEGORIES).orderBy("position", "number").collect():
        categories[r["column"]].append(r["value"])
    parts: dict[tuple[int, str], list] = {}
    for r in table("layers", _LAYERS).orderBy("layer", "part", F.col("row")).collect():
        parts.setdefault((r["layer"], r["part"]), []).append(r["values"])
    layers = []
    for i, (activation, slope) in enumerate(json.loads(settings["activations"])):
        vector = {p: np.array(parts[i, p][0]) if (i, p) in parts else None for p in ("bias", "scale", "shift")}
        layers.append(Layer(
            np.array(parts[i, "weights"]), vector["bias"], activation, vector["scale"], vector["shift"], slope
        ))
    spec = FeatureSpec(
        tuple(r["column"] for r in scaler), tuple(categorical), settings["scaler"],
        json.loads(settings["missing_category"]), tuple(json.loads(settings["nullable_categories"])),
    )
    return RiskModel(
        spec, {r["column"]: r["mean"] for r in scaler},
        {r["column"]: (r["center"], r["scale"]) for r in scaler},
        categories, tuple(layers), json.loads(settings["info"]),
    )
