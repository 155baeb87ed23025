"""The cohort report core (A1-A8, A11, T2): one scan, one partial and one final aggregate.

Every measure of a cohort is built from additive sums. Filling a null with the cohort's own mean
looks as if it needed a second pass, since the mean must exist before a row is scored. For a linear
model, and for the mean activation of any model, it does not: the filled rows of a column add
`nulls * mean` to the column's sum, and both are known once the cohort is aggregated. So raw counts,
cohort-mean imputation and means over the surviving rows come from the same aggregate, and a hot
cohort is pre-aggregated on every executor before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import GEO_KEYS, MIN_PATIENTS
from ..functions import risk_band, round_to, sql_text
from .features import category_sql, is_scorable, require_features
from .filters import having_min, not_null
from .importance import with_importance
from .model import RiskModel
from .scoring import (
    MAP_CATEGORIES, category_lookup, drop_helpers, factor_sql, linear_terms, linear_weights, scaled_sql, score, top_entries,
)


class CohortSums:
    """The additive sums behind a cohort report and the formulas that turn them into results.

    `aggregate` goes from rows to sums, `combine` from sums to the sums of coarser cohorts, and
    `finish` from sums to the report's columns.
    """

    def __init__(
        self,
        model: RiskModel,
        impute_scope: str = "cohort",
        averages: Mapping[str, str] | None = None,
        percentages: Mapping[str, str] | None = None,
        factors: int = 0,
        also_required: Sequence[str] = (),
    ):
        if impute_scope not in ("cohort", "training"):
            raise ValueError(f"unknown impute scope {impute_scope!r}")
        self.model = model
        self.scope = impute_scope
        self.averages = dict(averages or {})
        self.percentages = dict(percentages or {})
        self.factors = factors
        self.also_required = tuple(also_required)
        # Categories of short lists are sums of their own, those of long lists rows of the aggregate.
        shown = [c for c in model.spec.categorical if c not in GEO_KEYS]
        self.short = [c for c in shown if len(model.categories[c]) <= MAP_CATEGORIES]
        self.long = [c for c in shown if len(model.categories[c]) > MAP_CATEGORIES]
        self.with_long = bool(factors and self.long)
        # A network needs every row's filled inputs before it can score.
        self.score_first = not model.is_linear
        self._importance = dict(zip(model.feature_names, model.by_feature("mean").tolist()))
        self._constant = 0.0
        self._position = {name: i for i, name in enumerate(model.feature_names)}

    # -- rows to sums

    def rows(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Prepared rows with a survival flag and the part of the score that is known per row."""
        model = self.model
        require_features(df, model.spec)
        if self.score_first:
            df = score(df, model, self.scope, keys, "_known", self.also_required)
            return df.withColumn("_alive", F.col("_known").isNotNull())
        fills = None
        if self.scope == "training":
            fills = {c: sql_text.number(model.means[c]) for c in model.spec.numeric}
        df = df.withColumn("_alive", is_scorable(df, model.spec, self.also_required))
        df, terms, self._constant = linear_terms(df, model, fills)
        return drop_helpers(df.withColumn("_known", F.expr(terms)), "w")

    def _sums(self, df: DataFrame) -> dict[str, str]:
        sums = {
            "n": "count(*)",
            "alive_n": "count_if(_alive)",
            "alive_known": "sum(CASE WHEN _alive THEN _known END)",
        }
        cohort = self.scope == "cohort"
        for i, c in enumerate(self.model.spec.numeric):
            value = sql_text.name(c)
            if cohort and (self.factors or not self.score_first):
                sums[f"all_sum_{i}"] = f"sum(CAST({value} AS DOUBLE))"
                sums[f"all_cnt_{i}"] = f"count({value})"
            if self.factors or (cohort and not self.score_first):
                sums[f"alive_null_{i}"] = f"count_if(_alive AND {value} IS NULL)"
            if self.factors:
                sums[f"alive_sum_{i}"] = f"sum(CASE WHEN _alive THEN CAST({value} AS DOUBLE) END)"
        if self.factors:
            for c in self.short:
                subject = category_sql(df, self.model.spec, c)
                for j, value in enumerate(self.model.categories[c]):
                    sums[f"alive_cat_{c}_{j}"] = f"count_if(_alive AND {subject} = {sql_text.text(value)})"
        for source in dict.fromkeys([*self.averages.values(), *self.percentages.values()]):
            sums[f"m_sum_{source}"] = f"sum(CAST({sql_text.name(source)} AS DOUBLE))"
            sums[f"m_cnt_{source}"] = f"count({sql_text.name(source)})"
        return sums

    def aggregate(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Prepared rows to one row of sums per cohort; rows with a null key belong to none."""
        rows = self.rows(not_null(df, keys), keys)
        sums = self._sums(rows)
        if not self.with_long:
            return rows.groupBy(*keys).agg(*[F.expr(f"{text} AS {sql_text.name(out)}") for out, text in sums.items()])
        # Each row adds to its cohort's sums and to the counts of its own category of every long
        # list, in the same aggregate; counts are gathered per cohort after that.
        first = self.model.category_offsets()
        numbers = {c: {v: first[c] + i for i, v in enumerate(self.model.categories[c])} for c in self.long}
        rows, at = category_lookup(rows, self.model, numbers, "f")
        entries = ", ".join(["-1", *[f"CAST({at[c]} AS INT)" for c in self.long]])
        counted = rows.withColumn("_idx", F.explode(F.expr(f"array_compact(array({entries}))"))).groupBy(*keys, "_idx").agg(
            *[F.expr(f"{text} FILTER (WHERE _idx = -1) AS {sql_text.name(out)}") for out, text in sums.items()],
            F.count_if("_alive").alias("_cnt"),
        )
        return self._gathered(self._with_features(counted), keys, list(sums))

    def _with_features(self, counted: DataFrame) -> DataFrame:
        """Counts with the name and the importance of their feature; as many as the model has."""
        spark, names = counted.sparkSession, self.model.feature_names
        table = spark.createDataFrame(
            [(i, name, float(self._importance[name])) for i, name in enumerate(names)], "_idx int, _feature string, importance double"
        )
        features = counted.select("*", F.col("_cnt").cast("double").alias("activation"))
        return with_importance(features, table, "_idx", "left").drop("activation")

    @staticmethod
    def _gathered(counted: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
        """One row per cohort: its sums, and the counted features of long lists."""
        entry = F.struct(F.col("_idx").alias("idx"), F.col("_cnt").alias("cnt"), F.col("_feature").alias("feature"), F.col("value"))
        return counted.groupBy(*keys).agg(
            *[F.max(F.when(F.col("_idx") == -1, F.col(name))).alias(name) for name in sums],
            F.collect_list(F.when((F.col("_idx") >= 0) & (F.col("_cnt") > 0), entry)).alias("long"),
        )

    # -- sums to coarser sums

    def combine(self, sums: DataFrame, keys: Sequence[str], alive: Column | None = None) -> DataFrame:
        """Sums of finer cohorts added up per `keys`.

        `alive` marks finer cohorts whose rows survive cleaning as far as joined columns go: the
        others count as patients but not towards scores.
        """
        rows = not_null(sums, keys)
        if self.with_long:
            none = "named_struct('idx', -1, 'cnt', 0L, 'feature', CAST(NULL AS STRING), 'value', CAST(NULL AS DOUBLE))"
            rows = rows.withColumn("_entry", F.explode(F.expr(f"concat(array({none}), long)")))
        own = F.col("_entry.idx") == -1 if self.with_long else F.lit(True)
        parts = []
        for name in sums.columns:
            if name == "n" or name.startswith(("all_", "m_")):
                parts.append(F.sum(F.when(own, F.col(name))).alias(name))
            elif name.startswith("alive_"):
                col = F.col(name) if alive is None else F.when(alive, F.col(name))
                parts.append(F.coalesce(F.sum(F.when(own, col)), F.lit(0)).alias(name))
        if not self.with_long:
            return rows.groupBy(*keys).agg(*parts)
        kept = F.lit(True) if alive is None else alive
        counted = rows.groupBy(*keys, F.col("_entry.idx").alias("_idx"), F.col("_entry.feature").alias("_feature")).agg(
            *parts, F.sum(F.when(kept, F.col("_entry.cnt"))).alias("_cnt"), F.sum(F.when(kept, F.col("_entry.value"))).alias("value"))
        return self._gathered(counted, keys, [p for p in sums.columns if p not in keys and p.startswith(("n", "all_", "m_", "alive_"))])

    # -- sums to results

    def _nulls_filled(self, i: int) -> str:
        """What the surviving nulls of numeric column `i` add to the column's sum once filled."""
        if self.scope == "training":
            mean = sql_text.number(self.model.means[self.model.spec.numeric[i]])
        else:
            mean = f"try_divide(all_sum_{i}, all_cnt_{i})"
        return f"CASE WHEN alive_null_{i} > 0 THEN alive_null_{i} * {mean} ELSE 0D END"

    def average_risk(self) -> Column:
        """Mean score of the surviving rows."""
        if self.score_first:
            return F.expr("try_divide(alive_known, alive_n)")
        numeric, _, _ = linear_weights(self.model)
        terms = ["alive_known"]
        if self.scope == "cohort":
            for i, (c, weight) in enumerate(numeric.items()):
                fill = scaled_sql(self.model, c, f"try_divide(all_sum_{i}, all_cnt_{i})")
                terms.append(
                    f"CASE WHEN alive_null_{i} > 0 THEN alive_null_{i} * {fill} * {sql_text.number(weight)} ELSE 0D END"
                )
        return F.expr(f"try_divide({' + '.join(terms)}, alive_n) + {sql_text.number(self._constant)}")

    def top_factors(self) -> Column:
        """The `factors` largest mean activation x importance, geography left out."""
        def entry(feature: str, activation: str) -> str:
            value = f"({activation}) * {sql_text.number(self._importance[feature])}"
            return factor_sql(value, self._position[feature], sql_text.text(feature))

        entries = []
        for i, c in enumerate(self.model.spec.numeric):
            mean = f"try_divide(coalesce(alive_sum_{i}, 0D) + {self._nulls_filled(i)}, alive_n)"
            entries.append(entry(c, scaled_sql(self.model, c, mean)))
        for c in self.short:
            for j, value in enumerate(self.model.categories[c]):
                share = f"try_divide({sql_text.name(f'alive_cat_{c}_{j}')}, alive_n)"
                entries.append(entry(f"{c}_{value}", share))
        arrays = [f"array({', '.join(entries)})"]
        if self.with_long:
            arrays += self._long_entries()
        return top_entries(f"concat({', '.join(arrays)})", self.factors)

    def _long_entries(self) -> list[str]:
        """Entries of long category lists: those that occur, and zeros for others.

        Zeros tie by feature number, so of every list only as many of the first categories as
        factors are wanted can be chosen.
        """
        held = f"transform(long, h -> {factor_sql('try_divide(h.value, alive_n)', 'h.idx', 'h.feature')})"
        offsets = self.model.category_offsets()
        first = ", ".join(
            f"named_struct('idx', {offsets[c] + i}, 'feature', {sql_text.text(f'{c}_{v}')})"
            for c in self.long for i, v in enumerate(self.model.categories[c][: self.factors])
        )
        absent = f"filter(array({first}), a -> NOT exists(long, h -> h.idx = a.idx))"
        return [held, f"transform({absent}, a -> {factor_sql('try_divide(0D, alive_n)', 'a.idx', 'a.feature')})"]

    def finish(
        self, sums: DataFrame, keys: Sequence[str], min_rows: int | None = MIN_PATIENTS, digits: int = 4
    ) -> DataFrame:
        """Sums to the report: keys, size, mean risk, band, measures and factors."""
        measures = {
            out: round_to(F.try_divide(F.col(f"m_sum_{c}"), F.col(f"m_cnt_{c}")), 2)
            for out, c in self.averages.items()
        }
        measures |= {
            out: round_to(F.try_divide(F.col(f"m_sum_{c}"), F.col(f"m_cnt_{c}")) * F.lit(100.0), 2)
            for out, c in self.percentages.items()
        }
        sums = having_min(sums, min_rows, "n").withColumn("_risk", self.average_risk())
        factors = [self.top_factors().alias("top_factors")] if self.factors else []
        return sums.select(
            *keys,
            F.col("n").alias("n_patients"),
            round_to(F.col("_risk"), digits).alias("avg_risk"),
            risk_band(F.col("_risk")).alias("risk_band"),
            *[col.alias(name) for name, col in measures.items()],
            *factors,
        )


def cohort_summary(
    df: DataFrame,
    keys: Sequence[str] | str,
    model: RiskModel,
    *,
    impute_scope: str = "cohort",
    averages: Mapping[str, str] | None = None,
    percentages: Mapping[str, str] | None = None,
    factors: int = 0,
    min_rows: int | None = MIN_PATIENTS,
    also_required: Sequence[str] = (),
) -> DataFrame:
    """Size, mean model risk, band, optional measures and top factors per cohort of prepared rows.

    `n_patients` counts all rows of the cohort, `avg_risk` covers those that survive cleaning.
    `averages` and `percentages` map an output name to a column; `also_required` names columns beyond
    the model's categories that must have a value for a row to survive.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    sums = CohortSums(model, impute_scope, averages, percentages, factors, also_required)
    return sums.finish(sums.aggregate(df, keys), keys, min_rows)
