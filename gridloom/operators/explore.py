"""Exploratory aggregates and audits: the data behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.metrics import model_order
from gridloom.plans.joins import join_params
from gridloom.plans.packed import added, packed_sums
from gridloom.plans.quantiles import exact_quantiles
from gridloom.session import stage_table


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "station").agg(F.count(F.lit(1)).alias("n_rows"))


def distribution(df: DataFrame, keys: Sequence[str] = ("station",), value: str = "value") -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 quartile ranges), mean and sample deviation."""
    keys = list(keys)
    quart = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return (
        join_params(df.where(v.isNotNull()), quart, keys)
        .groupBy(*keys)
        .agg(
            F.count(value).alias("n_rows"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
        )
    )


def density_bins(df: DataFrame, low: float, high: float, bins: int, value: str = "value") -> DataFrame:
    """Counts of equal bins of [low, high); bin 0 is below, ``bins + 1`` at or above the end."""
    bucket = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy("station", bucket.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))


def station_matrix(df: DataFrame, key: str, stations: Sequence[str], value: str = "value") -> DataFrame:
    """Mean per ``key`` with one column per station in a fixed order."""
    return df.groupBy(key).pivot("station", list(stations)).agg(F.avg(value))


def level_stats(df: DataFrame, value: str = "value") -> DataFrame:
    """Mean, median and 90th percentile per station."""
    quart = exact_quantiles(df, ["station"], value, [0.5, 0.9], ["median", "p90"])
    return df.groupBy("station").agg(F.avg(value).alias("mean")).join(quart, "station")


def correlations(
    wide: DataFrame, columns: Sequence[str], keys: Sequence[str], names: tuple[str, str] = ("var_a", "var_b"), against: str | None = None
) -> DataFrame:
    """Pearson r over pairwise known rows: the lower triangle of a column list, or one column ``against`` all.

    Counts, sums, squares and products of all pairs are matrices that every task adds up over its rows, masked where a
    value is missing, around the means of all rows; one packed row a task and key is shuffled. r is null where one side
    does not vary.
    """
    columns = list(columns)
    p, own = len(columns), range(len(columns)) if against is None else [columns.index(against)]
    middle = wide.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in columns]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in middle])
    left = list(own)

    def moments(x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        x, mask = np.where(known, x - shift, 0.0), known.astype(float)
        # By (left, right): rows, sums and squares of either side where both are known, products.
        ml, xl = mask[:, left], x[:, left]
        return np.concatenate([m.ravel() for m in (ml.T @ mask, xl.T @ mask, (xl**2).T @ mask, ml.T @ x, ml.T @ x**2, xl.T @ x)])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sx, sxx, sy, syy, sxy = added(list(pdf["sums"])).reshape(6, len(left), p)
        m = np.maximum(n, 1)
        vx, vy, c = sxx - sx**2 / m, syy - sy**2 / m, sxy - sx * sy / m
        still = (n < 2) | (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
        r = np.where(still, np.nan, c / np.sqrt(np.where(still, 1.0, vx * vy)))
        i, j = np.indices(r.shape)
        wanted = (j <= np.array(left)[i]) if against is None else np.ones(r.shape, bool)
        i, j = i[wanted], j[wanted]
        held = {k: [pdf[k].iloc[0]] * len(i) for k in keys}
        found = pd.Series(r[i, j]).astype(object).where(~np.isnan(r[i, j]), None)
        return pd.DataFrame({**held, names[0]: [columns[left[k]] for k in i], names[1]: [columns[k] for k in j], "r": found, "n_pairs": n[i, j].astype(np.int64)})

    keys = list(keys)
    schema = ", ".join([*(f"{k} string" for k in keys), f"{names[0]} string, {names[1]} string, r double, n_pairs bigint"])
    return packed_sums(wide, keys, columns, moments).groupBy(*keys).applyInPandas(pairs, schema)


def widen(df: DataFrame, column: str, names: Sequence[str], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Long to wide with the mean of copies, one column per listed name."""
    return df.groupBy(*keys).pivot(column, list(names)).agg(F.avg(value))


def _support(wide: DataFrame, variables: Sequence[str], min_values: int) -> DataFrame:
    """Variables per station with more than ``min_values`` values."""
    counts = wide.groupBy("station").agg(*[F.count(F.col(f"`{v}`")).alias(f"_n{i}") for i, v in enumerate(variables)])
    listed = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > min_values, F.lit(v)) for i, v in enumerate(variables)]))
    return counts.select("station", listed.alias("_known"))


def correlation_per_station(
    df: DataFrame, variables: Sequence[str], min_values: int = 200, min_variables: int = 3
) -> DataFrame:
    """Lower-triangle correlations of all variables per station.

    ``supported`` marks pairs of variables with more than ``min_values`` values each, at stations with at least
    ``min_variables`` of them; no pair is left out.
    """
    wide = widen(df, "variable", variables, ["station", "ts"])
    pairs = correlations(wide, variables, ["station"])
    own = F.when((F.col("var_a") == F.col("var_b")) & (F.col("n_pairs") > min_values), F.col("var_a"))
    known = pairs.withColumn("_known", F.collect_set(own).over(Window.partitionBy("station")))
    enough = F.array_contains("_known", F.col("var_a")) & F.array_contains("_known", F.col("var_b"))
    return known.select(*pairs.columns, (enough & (F.size("_known") >= min_variables)).alias("supported"))


def predictor_ranking(df: DataFrame, target: str, variables: Sequence[str], min_values: int = 200) -> DataFrame:
    """Correlation of every other variable with the target, ranked per station among the supported ones.

    Only pairs with the target are computed; unsupported variables stay listed without a rank.
    """
    wide = stage_table(widen(df, "variable", variables, ["station", "ts"]), "wide")
    pairs = correlations(wide, variables, ["station"], ("target", "predictor"), against=target).where(F.col("predictor") != target)
    known = pairs.join(_support(wide, variables, min_values), "station")
    enough = F.array_contains("_known", F.lit(target)) & F.array_contains("_known", F.col("predictor"))
    named = known.select("station", "predictor", "r", "n_pairs", enough.alias("supported"))
    order = Window.partitionBy("station", "supported").orderBy(F.desc_nulls_last("r"), "predictor")
    return named.withColumn("rank", F.when(F.col("supported"), F.row_number().over(order)).cast("bigint"))


def synchrony(df: DataFrame, stations: Sequence[str]) -> DataFrame:
    """Correlation between stations at equal times, copies averaged."""
    wide = widen(df, "station", stations, ["ts"]).withColumn("_all", F.lit(1))
    return correlations(wide, stations, ["_all"], ("station_a", "station_b")).drop("_all")


def metric_matrix(table: DataFrame, row: str, column: str, names: Sequence[str], metric: str = "rmse", clip: float | None = None) -> DataFrame:
    """Metric per row key with one column per listed name, clipped for display where asked."""
    value = F.avg(metric) if clip is None else F.least(F.avg(metric), F.lit(clip))
    return table.groupBy(row).pivot(column, list(names)).agg(value)


def first_days(df: DataFrame, days: int, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Rows of every series in [first time, + ``days``)."""
    starts = df.groupBy(*keys).agg(F.min("ts").alias("_t0"))
    inside = F.col("ts") < F.timestamp_add("DAY", F.lit(days), F.col("_t0"))
    return join_params(df, starts, keys).where(inside).select(*df.columns)


def split_summary(df: DataFrame, target: str, too_large: float = 1e5) -> DataFrame:
    """Per split: rows, columns, stations, and the state of the target."""
    t = F.col(target)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.count_distinct("station").alias("n_stations"),
        F.count_if(t.isNull()).alias("target_nulls"),
        F.min(t).alias("target_min"),
        F.max(t).alias("target_max"),
        F.count_if(t < 0).alias("target_negative"),
        F.count_if(t > too_large).alias("target_too_large"),
    )


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns present on one side only."""
    spark = left.sparkSession
    a, b = set(left.columns), set(right.columns)
    rows = [("missing", c) for c in sorted(a - b)] + [("extra", c) for c in sorted(b - a)]
    return spark.createDataFrame(rows, "kind string, column_name string")


def metrics_union(tables: Sequence[DataFrame], models: Sequence[str]) -> DataFrame:
    """Metric tables under one another with the place of each model in a fixed order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("model_place", model_order(models))


def scorecard(routing: DataFrame, routed_metrics: DataFrame, features: DataFrame, counts: DataFrame) -> DataFrame:
    """Per station: chosen model, routed metrics, number of features and test rows."""
    test = counts.where(F.col("split") == "test").select("station", F.col("n_rows").alias("test_rows"))
    n_features = features.groupBy("station").agg(F.count(F.lit(1)).alias("n_features"))
    return (
        routing.select("station", F.col("model").alias("chosen"), "val_rmse")
        .join(routed_metrics.select("station", "rmse", "mae", "r2"), "station", "left")
        .join(n_features, "station", "left")
        .join(test, "station", "left")
    )
