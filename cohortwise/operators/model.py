"""A fitted model: parameters whose size does not depend on the number of patients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from .features import FeatureSpec

ACTIVATIONS = ("linear", "relu", "leaky_relu")


@dataclass(frozen=True)
class Layer:
    """One dense layer: `activation(x W + b) * scale + shift`.

    `scale` and `shift` hold a batch normalisation that follows the layer, folded into two vectors.
    """

    weights: np.ndarray
    bias: np.ndarray
    activation: str = "linear"
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None
    slope: float = 0.3  # of leaky_relu below zero

    def __post_init__(self):
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation!r}")


@dataclass(frozen=True)
class RiskModel:
    """Scaler, category lists and layers, all under feature names.

    Features are the numeric columns in the order of the spec, then one 0/1 feature per category.
    """

    spec: FeatureSpec
    means: Mapping[str, float]
    scaling: Mapping[str, tuple[float, float]]
    categories: Mapping[str, Sequence[str]]
    layers: tuple[Layer, ...]
    info: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        wanted = len(self.feature_names)
        have = self.layers[0].weights.shape[0]
        if wanted != have:
            raise ValueError(f"{wanted} features but {have} rows of first-layer weights")

    @property
    def feature_names(self) -> list[str]:
        return list(self.spec.numeric) + [
            f"{column}_{value}" for column in self.spec.categorical for value in self.categories[column]
        ]

    @property
    def is_linear(self) -> bool:
        return len(self.layers) == 1 and self.layers[0].activation == "linear"

    def category_offsets(self) -> dict[str, int]:
        """Index of the first feature of every categorical column."""
        offsets, at = {}, len(self.spec.numeric)
        for column in self.spec.categorical:
            offsets[column] = at
            at += len(self.categories[column])
        return offsets

    def by_feature(self, how: str = "mean") -> np.ndarray:
        """Importance per feature: `mean` or `sum` of |w| over units, or `first` for unit 0."""
        size = np.abs(self.layers[0].weights)
        if how == "mean":
            return size.mean(axis=1)
        if how == "sum":
            return size.sum(axis=1)
        if how == "first":
            return size[:, 0]
        raise ValueError(f"unknown importance {how!r}")

    def weights(self, spark: SparkSession) -> DataFrame:
        """First-layer weights as a table (feature_idx, feature, unit, weight)."""
        matrix, names = self.layers[0].weights, self.feature_names
        rows = [
            (i, names[i], unit, float(matrix[i, unit]))
            for i in range(matrix.shape[0]) for unit in range(matrix.shape[1])
        ]
        return spark.createDataFrame(rows, schemas.WEIGHTS)


def linear_model(
    spec: FeatureSpec,
    means: Mapping[str, float],
    scaling: Mapping[str, tuple[float, float]],
    categories: Mapping[str, Sequence[str]],
    numeric_weights: Mapping[str, float],
    category_weights: Mapping[str, Mapping[str, float]],
    intercept: float = 0.0,
) -> RiskModel:
    """A one-layer model from weights given by name."""
    column = [numeric_weights[c] for c in spec.numeric] + [
        category_weights[c][v] for c in spec.categorical for v in categories[c]
    ]
    layer = Layer(np.array(column, dtype=float).reshape(-1, 1), np.array([intercept], dtype=float))
    return RiskModel(spec, dict(means), dict(scaling), dict(categories), (layer,))
