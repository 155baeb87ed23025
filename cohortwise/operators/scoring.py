"""Batch scoring and per-row explanation (M3, M4, T4)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import TOP_FACTORS
from ..functions import risk_band, round_to, sql_text
from .features import category_sql, fill_values, filled_sql, is_scorable, require_features
from .joins import BROADCAST_ROWS
from .model import RiskModel

# Up to this many categories a lookup is a constant map, searched in order; beyond it a join with
# the value table, which is hashed.
MAP_CATEGORIES = 64


def category_lookup(
    df: DataFrame, model: RiskModel, tables: Mapping[str, Mapping[str, float]], tag: str
) -> tuple[DataFrame, dict[str, str]]:
    """The rows with helper columns `_tag_*`: the number every category has in `tables`.

    Also gives the SQL text of each helper. The number is null for an unseen value. Short tables
    are constant maps inside the row's own stage. Longer ones are joined; their size is the model's
    own category count, known here, and decides about the broadcast.
    """
    found: dict[str, str] = {}
    mapped: dict[str, Column] = {}
    for column, numbers in tables.items():
        subject = category_sql(df, model.spec, column)
        helper = f"_{tag}_{column}"
        found[column] = sql_text.name(helper)
        if column not in df.columns or not numbers:
            found[column] = "CAST(NULL AS DOUBLE)"
        elif len(numbers) <= MAP_CATEGORIES:
            mapped[helper] = F.expr(sql_text.lookup(subject, numbers))
        else:
            table = df.sparkSession.createDataFrame(
                [(v, float(x)) for v, x in numbers.items()], f"`{helper}_key` string, `{helper}` double"
            )
            if len(numbers) <= BROADCAST_ROWS:
                table = F.broadcast(table)
            df = df.join(table, F.expr(subject) == F.col(f"{helper}_key"), "left").drop(f"{helper}_key")
    return df.withColumns(mapped) if mapped else df, found


def drop_helpers(df: DataFrame, *tags: str) -> DataFrame:
    prefixes = tuple(f"_{tag}_" for tag in tags)
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def scaled_sql(model: RiskModel, column: str, value: str) -> str:
    """SQL text of the scaled number; null stays null."""
    center, scale = model.scaling[column]
    return f"(({value} - {sql_text.number(center)}) / {sql_text.number(scale)})"


def linear_weights(model: RiskModel) -> tuple[dict[str, float], dict[str, dict[str, float]], float]:
    """Weights of a linear model by column: numeric, per category, intercept."""
    if not model.is_linear:
        raise ValueError("the model has more than one layer")
    column = model.layers[0].weights[:, 0]
    numeric = {c: float(column[i]) for i, c in enumerate(model.spec.numeric)}
    categorical = {}
    for c, at in model.category_offsets().items():
        categorical[c] = {v: float(column[at + i]) for i, v in enumerate(model.categories[c])}
    return numeric, categorical, float(model.layers[0].bias[0])


def linear_terms(
    df: DataFrame, model: RiskModel, fills: Mapping[str, str] | None
) -> tuple[DataFrame, str, float]:
    """The rows, the SQL text of a linear model's sum, and the constant that belongs to it.

    Scaling is folded into the weights: `w (x - c) / s` is `x w / s` and a share of the constant,
    which keeps the generated code short. `fills` holds the SQL text that stands for a null number;
    without it a null adds what the center of its column would, that is nothing.
    """
    numeric, categorical, constant = linear_weights(model)
    df, found = category_lookup(df, model, categorical, "w")
    terms = []
    for c, weight in numeric.items():
        center, scale = model.scaling[c]
        slope = weight / scale
        constant -= center * slope
        value = filled_sql(c, sql_text.number(center) if fills is None else fills[c])
        terms.append(f"{value} * {sql_text.number(slope)}")
    terms += [f"coalesce({lookup}, 0D)" for lookup in found.values()]
    return df, " + ".join(terms) or "0D", constant


def _linear_score(df: DataFrame, model: RiskModel, fills: Mapping[str, str], output: str) -> DataFrame:
    df, terms, constant = linear_terms(df, model, fills)
    return df.withColumn(output, F.expr(f"CASE WHEN is_scorable THEN {sql_text.number(constant)} + {terms} END"))


def network_forward(model: RiskModel, numbers: np.ndarray, codes: Sequence[np.ndarray]) -> np.ndarray:
    """Forward pass over a batch.

    A one-hot block times its weights is a row lookup, so the 0/1 matrix is never built. `codes`
    holds the category number per column, -1 for a null or unseen one.
    """
    first = model.layers[0]
    signal = numbers @ first.weights[: len(model.spec.numeric)] + first.bias
    for (_, at), code in zip(model.category_offsets().items(), codes):
        known = code >= 0
        signal[known] += first.weights[at + code[known]]
    for i, layer in enumerate(model.layers):
        if i:
            signal = signal @ layer.weights + layer.bias
        if layer.activation == "relu":
            signal = np.maximum(signal, 0.0)
        elif layer.activation == "leaky_relu":
            signal = np.where(signal >= 0.0, signal, layer.slope * signal)
        if layer.scale is not None:
            signal = signal * layer.scale + layer.shift
    return signal[:, 0]


def _network_score(df: DataFrame, model: RiskModel, fills: Mapping[str, str], output: str) -> DataFrame:
    """Multi-layer models run as an Arrow-batched function over the model's inputs only.

    The parameters travel once per executor as a broadcast variable.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    n_numeric = len(model.spec.numeric)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fitted = shared.value
        order = [pd.Index(list(fitted.categories[c])) for c in fitted.spec.categorical]
        for batch in batches:
            numbers = batch.iloc[:, :n_numeric].to_numpy(dtype=float)
            codes = [
                index.get_indexer(batch.iloc[:, n_numeric + i]) if len(index) else np.full(len(batch), -1)
                for i, index in enumerate(order)
            ]
            yield pd.Series(network_forward(fitted, numbers, codes))

    inputs = [
        f"'n{i}', {scaled_sql(model, c, filled_sql(c, fills[c]))}" for i, c in enumerate(model.spec.numeric)
    ]
    inputs += [
        f"'c{i}', {category_sql(df, model.spec, c)}" for i, c in enumerate(model.spec.categorical)
    ]
    raw = predict(F.expr(f"named_struct({', '.join(inputs)})"))
    return df.withColumn(output, raw).withColumn(
        output, F.when(F.col("is_scorable") & ~F.isnan(output), F.col(output))
    )


def score(
    df: DataFrame,
    model: RiskModel,
    impute_scope: str = "training",
    keys: Sequence[str] = (),
    output: str = "score",
    also_required: Sequence[str] = (),
) -> DataFrame:
    """Prepared rows with `is_scorable` and a score, null where the row is not scorable.

    Rows are never dropped, so that group sizes count all of them. A linear model is one column
    expression; a network is one Arrow-batched function.
    """
    require_features(df, model.spec)
    df = df.withColumn("is_scorable", is_scorable(df, model.spec, also_required))
    df, fills = fill_values(df, model.spec.numeric, impute_scope, model.means, keys)
    if hasattr(model, "score_rows"):  # a model of another kind, such as trees
        return drop_helpers(model.score_rows(df, fills, output), "mean")
    run = _linear_score if model.is_linear else _network_score
    return drop_helpers(run(df, model, fills, output), "w", "mean")


# --- T4 -------------------------------------------------------------------------------------


def factor_sql(value: str, idx: str | int, feature: str) -> str:
    """SQL text of a factor; the highest is the largest value, of equal ones the lowest number."""
    return f"named_struct('value', {value}, 'back', -CAST({idx} AS INT), 'feature', {feature})"


def top_entries(entries: str, n: int) -> Column:
    """The `n` highest of an array of `factor_sql` structs as (feature, value).

    Null entries and null values sort last in descending order, so they need no pass of their own.
    """
    return F.expr(
        f"transform(filter(slice(sort_array({entries}, false), 1, {int(n)}), e -> e.value IS NOT NULL), "
        "e -> named_struct('feature', e.feature, 'value', e.value))"
    )


def top_factors_per_row(
    df: DataFrame, model: RiskModel, n: int = TOP_FACTORS, output: str = "top_factors",
    digits: int | None = None,
) -> DataFrame:
    """The `n` largest |first-unit weight| x input per row, as an array; no shuffle.

    The whole one-hot row is not built. Inactive categories all have the value 0 and tie by feature
    number, so only the first few of them can be chosen: as many as are wanted plus one per
    categorical column, which may be active.

    No higher-order function touches the candidates: Spark interprets everything below one, while
    an array, its sort and its items are compiled.
    """
    size = model.by_feature("first")
    names = model.feature_names
    offsets = model.category_offsets()
    columns = list(model.spec.categorical)
    first = len(model.spec.numeric)
    numbers = {c: {v: offsets[c] + i for i, v in enumerate(model.categories[c])} for c in columns}
    df, at = category_lookup(df, model, numbers, "i")
    entries = []
    for i, c in enumerate(model.spec.numeric):
        filled = filled_sql(c, sql_text.number(model.means[c]))
        entries.append(factor_sql(
            f"{scaled_sql(model, c, filled)} * {sql_text.number(size[i])}", i, sql_text.text(c)
        ))
    for c in columns:
        if not model.categories[c]:
            continue
        sizes = ", ".join(sql_text.number(size[i]) for i in numbers[c].values())
        active = f"get(array({sizes}), CAST({at[c]} AS INT) - {offsets[c]})"
        label = f"concat({sql_text.text(c + '_')}, {category_sql(df, model.spec, c)})"
        entries.append(f"CASE WHEN {at[c]} IS NOT NULL THEN {factor_sql(active, at[c], label)} END")
    for i in range(first, min(len(names), first + n + len(columns))):
        column = next(c for c in reversed(columns) if offsets[c] <= i and model.categories[c])
        entry = factor_sql("0D", i, sql_text.text(names[i]))
        entries.append(f"CASE WHEN coalesce({at[column]}, -1D) <> {i} THEN {entry} END")
    df = df.withColumn("_i_sorted", F.expr(f"slice(sort_array(array({', '.join(entries)}), false), 1, {int(n)})"))
    shown = "e.value" if digits is None else f"round(e.value, {int(digits)})"
    items = []
    for k in range(n):
        item = f"get(_i_sorted, {k})"
        pair = f"named_struct('feature', {item}.feature, 'value', {shown.replace('e.', item + '.')})"
        items.append(f"CASE WHEN {item} IS NOT NULL THEN {pair} END")
    df = df.withColumn(output, F.expr(f"array_compact(array({', '.join(items)}))"))
    return drop_helpers(df, "i")


def score_patients_explained(df: DataFrame, model: RiskModel, n: int = TOP_FACTORS) -> DataFrame:
    """Score, band and top factors for every prepared patient row."""
    scored = top_factors_per_row(score(df, model), model, n, digits=4)
    return scored.withColumns({
        "risk_band": risk_band(F.col("score")),
        "score": round_to(F.col("score"), 4),
        "top_factors": F.when(F.col("is_scorable"), F.col("top_factors")),
    })


def explode_factors(df: DataFrame, keys: Sequence[str], factors: str = "top_factors") -> DataFrame:
    """Long form of a factor array: one row per key and rank.

    The outer form is used because the optimizer filters on the array's size before an inner one,
    which would evaluate the whole array expression a second time.
    """
    long = df.select(*keys, F.posexplode_outer(factors).alias("rank", "factor"))
    return long.where(F.col("rank").isNotNull()).select(
        *keys,
        (F.col("rank") + 1).alias("rank"),
        F.col("factor.feature").alias("feature"),
        F.col("factor.value").alias("value"),
    )
