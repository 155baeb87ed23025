"""Boosted regression trees as the risk model.

A fitted ensemble is a table of nodes. Scoring compiles every tree to nested conditions over the model's
scaled numbers and categories, so it stays a column expression; importance comes from the nodes' gains.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.regression import GBTRegressor, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sql_text
from ..sources.model_store import load_model, save_model
from .features import category_sql
from .model import RiskModel
from .scoring import scaled_sql

NODES = (
    "tree int, weight double, node int, feature_idx int, feature string, threshold double, `left` int, `right` int, value double, gain double, n bigint"
)


@dataclass(frozen=True)
class Node:
    """A leaf has no feature (-1); a row goes left if its feature is at most the threshold."""

    tree: int
    weight: float
    node: int
    feature: int
    threshold: float | None
    left: int | None
    right: int | None
    value: float
    gain: float
    n: int


@dataclass(frozen=True)
class TreeModel:
    """Preparation (means, scaling, categories) and the nodes of all trees."""

    prepared: RiskModel
    nodes: tuple[Node, ...]

    is_linear = False

    @property
    def spec(self):
        return self.prepared.spec

    @property
    def means(self):
        return self.prepared.means

    @property
    def scaling(self):
        return self.prepared.scaling

    @property
    def categories(self):
        return self.prepared.categories

    @property
    def feature_names(self) -> list[str]:
        return self.prepared.feature_names

    def node_table(self, spark: SparkSession) -> DataFrame:
        names = self.feature_names
        return spark.createDataFrame([
            (n.tree, n.weight, n.node, n.feature, names[n.feature] if n.feature >= 0 else None, n.threshold, n.left, n.right, n.value, n.gain, n.n)
            for n in self.nodes
        ], NODES)

    def score_rows(self, df: DataFrame, fills: Mapping[str, str], output: str) -> DataFrame:
        """Called by `score`: the weighted sum over the trees."""
        columns = list(self.spec.categorical)
        owner = [(c, v) for c in columns for v in self.categories[c]]
        n_numeric = len(self.spec.numeric)
        used = sorted({n.feature for n in self.nodes if 0 <= n.feature < n_numeric})
        helpers = {f"_x_{i}": F.expr(scaled_sql(self, c, f"coalesce(CAST({sql_text.name(c)} AS DOUBLE), {fills[c]})")) for i in used for c in [self.spec.numeric[i]]}
        held = sorted({owner[n.feature - n_numeric][0] for n in self.nodes if n.feature >= n_numeric})
        helpers |= {f"_k_{columns.index(c)}": F.expr(category_sql(df, self.spec, c)) for c in held}

        def test(node: Node) -> str:
            if node.feature < n_numeric:
                return f"_x_{node.feature} <= {sql_text.number(node.threshold)}"
            column, value = owner[node.feature - n_numeric]
            active = f"coalesce(_k_{columns.index(column)} = {sql_text.text(value)}, false)"
            # The feature is 0 or 1.
            return "true" if node.threshold >= 1 else "false" if node.threshold < 0 else f"NOT {active}"

        by_tree: dict[int, dict[int, Node]] = {}
        for node in self.nodes:
            by_tree.setdefault(node.tree, {})[node.node] = node

        def text(tree: dict[int, Node], at: int) -> str:
            node = tree[at]
            if node.feature < 0:
                return sql_text.number(node.value)
            return f"CASE WHEN {test(node)} THEN {text(tree, node.left)} ELSE {text(tree, node.right)} END"

        terms = [f"{sql_text.number(tree[0].weight)} * ({text(tree, 0)})" for tree in by_tree.values()]
        df = df.withColumns(helpers) if helpers else df
        df = df.withColumn(output, F.expr(f"CASE WHEN is_scorable THEN {' + '.join(terms) or '0D'} END"))
        return df.drop(*helpers)


def nodes_of(model: GBTRegressionModel) -> tuple[Node, ...]:
    """The nodes of a fitted ensemble; their number is the ensemble's, not the data's."""
    out = []
    for number, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        waiting, made = [(tree._java_obj.rootNode(), 0)], 1
        while waiting:
            node, at = waiting.pop()
            n = int(node.impurityStats().count())
            if node.getClass().getSimpleName() == "LeafNode":
                out.append(Node(number, float(weight), at, -1, None, None, None, float(node.prediction()), 0.0, n))
                continue
            split = node.split()
            sides = [node.leftChild(), node.rightChild()]
            if split.getClass().getSimpleName() == "CategoricalSplit":  # a category's feature, 0 or 1
                threshold = 0.5
                if list(split.leftCategories()) == [1.0]:
                    sides.reverse()
            else:
                threshold = float(split.threshold())
            out.append(Node(number, float(weight), at, int(split.featureIndex()), threshold, made, made + 1, float(node.prediction()), float(node.gain()), n))
            waiting += [(sides[0], made), (sides[1], made + 1)]
            made += 2
    return tuple(sorted(out, key=lambda n: (n.tree, n.node)))


def tree_trainer(trees: int = 20, depth: int = 4, rate: float = 0.1, bins: int = 32, seed: int = 42, least_rows: int = 1):
    """The `trainer` of `fit_risk_model` and `fit_population_model` for boosted trees.

    Splits are found from binned statistics that every task sums up, so rows never move; a feature's
    candidate thresholds are at most `bins`.
    """

    def trainer(rows: DataFrame, prepared: RiskModel, target: str) -> TreeModel:
        from .training import feature_vectors

        vectors = feature_vectors(rows, prepared).select("features", F.col(target).cast("double").alias("label"))
        fitted = GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=bins,
                              seed=seed, minInstancesPerNode=least_rows).fit(vectors)
        return TreeModel(prepared, nodes_of(fitted))

    return trainer


def tree_importance(model: TreeModel, spark: SparkSession) -> DataFrame:
    """(feature_idx, feature, importance): share of the rows times gain of the splits on each feature; what
    `feature_importance` gives for networks, so all importance reports take it."""
    total = np.zeros(len(model.feature_names))
    for node in model.nodes:
        if node.feature >= 0:
            total[node.feature] += node.gain * node.n
    share = total / (total.sum() or 1.0)
    return spark.createDataFrame([(i, name, float(share[i])) for i, name in enumerate(model.feature_names)], "feature_idx int, feature string, importance double")


def save_trees(spark: SparkSession, model: TreeModel, path: str) -> None:
    """The preparation as `save_model` writes it, and the nodes beside it; a save that fails midway leaves
    the model before it in place, as the nodes' folder is named by the preparation, which comes last."""
    import uuid

    folder = f"nodes-{uuid.uuid4().hex}"
    model.node_table(spark).coalesce(1).write.parquet(f"{path}/{folder}")
    save_model(spark, replace(model.prepared, info={**model.prepared.info, "nodes": folder}), f"{path}/prepared")


def load_trees(spark: SparkSession, path: str) -> TreeModel:
    prepared = load_model(spark, f"{path}/prepared")
    rows: Sequence = spark.read.schema(NODES).parquet(f"{path}/{prepared.info['nodes']}").orderBy("tree", "node").collect()
    nodes = tuple(Node(r["tree"], r["weight"], r["node"], r["feature_idx"], r["threshold"], r["left"], r["right"], r["value"], r["gain"], r["n"]) for r in rows)
    return TreeModel(prepared, nodes)
