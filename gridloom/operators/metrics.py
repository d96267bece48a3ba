"""Regression metrics, prediction alignment and model routing.

Predictions are long: split, station, ts, target, model, y_true, y_pred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.joins import join_params

POOLED = "ALL"


def error_sums(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive error terms per key; every metric of a coarser key follows from them."""
    rows = preds.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    error = F.col("y_true") - F.col("y_pred")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(error * error).alias("_sse"),
        F.sum(F.abs(error)).alias("_sae"),
        F.avg("y_true").alias("_mean"),
        F.var_pop("y_true").alias("_var"),
    )


def _finish(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    # A squared spread below the rounding of the mean is zero.
    flat = F.col("_sst") <= 1e-18 * F.col("n_rows") * (1 + F.col("_mean") * F.col("_mean"))
    return sums.select(
        *keys,
        F.sqrt(F.col("_sse") / F.col("n_rows")).alias("rmse"),
        (F.col("_sae") / F.col("n_rows")).alias("mae"),
        F.when(~flat, 1 - F.col("_sse") / F.col("_sst")).alias("r2"),
        "n_rows",
    )


def metrics(preds: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """RMSE, MAE, R2 and row count per key; R2 is null for constant truth."""
    sums = error_sums(preds, keys).withColumn("_sst", F.col("_var") * F.col("n_rows"))
    return _finish(sums, keys)


def metrics_table(preds: DataFrame, keys: Sequence[str] = ("model",), by: str = "station") -> DataFrame:
    """Metrics per key and station plus the pooled rows, which are named ``ALL`` and marked by ``pooled``.

    Rows are read once: the pooled metrics are combined from the station sums. Every station is listed with its
    number of rows. A station may itself be named ``ALL``; only ``pooled`` tells the two apart.
    """
    parts = error_sums(preds, [*keys, by])
    everyone = Window.partitionBy(*keys)
    grand = F.sum(F.col("_mean") * F.col("n_rows")).over(everyone) / F.sum("n_rows").over(everyone)
    inner = F.sum(F.col("_var") * F.col("n_rows"))
    between = F.sum(F.col("n_rows") * F.pow(F.col("_mean") - F.col("_grand"), 2))
    pooled = F.grouping(by) == 1
    sums = (
        parts.withColumn("_grand", grand)
        .groupingSets([[*keys, by], [*keys]], *keys, by)
        .agg(
            F.sum(F.col("_mean") * F.col("n_rows")).alias("_total"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("_sse").alias("_sse"),
            F.sum("_sae").alias("_sae"),
            F.when(pooled, inner + between).otherwise(inner).alias("_sst"),
            pooled.alias("pooled"),
        )
        .withColumn("_mean", F.col("_total") / F.col("n_rows"))
        .withColumn(by, F.when(F.col("pooled"), F.lit(POOLED)).otherwise(F.col(by)))
    )
    return _finish(sums, [*keys, by, "pooled"])


def is_pooled(table: DataFrame) -> Column:
    """Rows over all stations; tables without the mark, as older files have it, tell them by name."""
    return F.col("pooled") if "pooled" in table.columns else F.col("station") == POOLED


def row_keys(preds: DataFrame) -> list[str]:
    """What names a predicted row: split, station and time, and the target where there are several."""
    return ["split", "station", *(["target"] if "target" in preds.columns else []), "ts"]


def align_predictions(preds: DataFrame, models: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """One row per key with a column per model, kept only where every model predicts."""
    keys = keys or row_keys(preds)
    wide = preds.groupBy(*keys).agg(
        F.max("y_true").alias("y_true"),
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"pred_{m}") for m in models],
    )
    return wide.dropna(subset=["y_true", *[f"pred_{m}" for m in models]])


def long_predictions(wide: DataFrame, models: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    keys = keys or row_keys(wide)
    cells = [F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("y_pred")) for m in models]
    return wide.select(*keys, "y_true", F.inline(F.array(*cells)))


def model_order(models: Sequence[str], column: str = "model") -> Column:
    """Place of a model in a list; models outside the list come last."""
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col(column))
    return F.when(place > 0, place).otherwise(F.lit(len(models) + 1)).cast("bigint")


def route_models(
    val_metrics: DataFrame,
    models: Sequence[str],
    keys: Sequence[str] = ("station",),
    default: str | None = None,
    all_keys: DataFrame | None = None,
) -> DataFrame:
    """Model with the lowest validation RMSE per key; the earlier candidate wins ties.

    Missing RMSEs are skipped. Keys without any RMSE get ``default``, or are an error when there is none; with
    ``all_keys`` that covers keys that have no validation rows at all.
    """
    candidates = val_metrics.where(F.col("model").isin(*models))
    usable = F.when(~F.isnan("rmse"), F.col("rmse"))
    first = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_rmse"), model_order(models))
    best = (
        candidates.withColumn("_rmse", usable)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
    )
    if all_keys is not None:
        best = all_keys.select(*keys).distinct().join(best, list(keys), "left")
    none = F.col("_rmse").isNull()
    if default is None:
        message = F.concat(F.lit("no candidate model for "), F.concat_ws("/", *keys))
        model = F.when(none, F.raise_error(message).cast("string")).otherwise(F.col("model"))
    else:
        model = F.when(none, F.lit(default)).otherwise(F.col("model"))
    return best.select(*keys, model.alias("model"), F.col("_rmse").alias("val_rmse"))


def apply_routing(
    preds: DataFrame, routing: DataFrame, default: str, keys: Sequence[str] = ("station",), row: Sequence[str] | None = None
) -> DataFrame:
    """The chosen model's prediction per row, or the default model's where the chosen one has none."""
    chosen = routing.select(*keys, F.col("model").alias("_chosen"))
    rows = join_params(preds, chosen, keys, "left").where(
        (F.col("model") == F.col("_chosen")) | (F.col("model") == F.lit(default))
    )
    own = F.max(F.when(F.col("model") == F.col("_chosen"), F.col("y_pred")))
    spare = F.max(F.when(F.col("model") == F.lit(default), F.col("y_pred")))
    group = list(dict.fromkeys([*(row or row_keys(preds)), *keys]))
    return (
        rows.groupBy(*group)
        .agg(
            F.max("y_true").alias("y_true"),
            F.when(own.isNotNull(), F.max("_chosen")).otherwise(F.lit(default)).alias("used_model"),
            F.coalesce(own, spare).alias("y_pred"),
        )
        .where(F.col("y_pred").isNotNull())
        .withColumn("model", F.lit("routed"))
    )


def best_of(table: DataFrame, models: Sequence[str], default: str) -> DataFrame:
    """The model of a subset with the lowest pooled RMSE, as one row; ``default`` when none is listed."""
    pooled = table.where(is_pooled(table) & F.col("model").isin(*models) & F.col("rmse").isNotNull())
    best = pooled.agg(F.min(F.struct("rmse", model_order(models).alias("place"), "model")).alias("b"))
    return best.select(F.coalesce("b.model", F.lit(default)).alias("model"), F.col("b.rmse").alias("rmse"))


def rank_by_r2(table: DataFrame, target: str | None = None) -> DataFrame:
    """Models by mean R2 of the primary target, or over all targets, best first."""
    rows = table.where(~is_pooled(table))
    if target is not None:
        rows = rows.where(F.col("target") == target)
    mean = rows.groupBy("model").agg(F.avg("r2").alias("mean_r2"))
    return mean.orderBy(F.desc_nulls_last("mean_r2"), "model")


def routing_summary(val: DataFrame, test: DataFrame, routing: DataFrame) -> DataFrame:
    """Validation RMSE of every (station, model), the choice, and the test RMSE beside it."""
    chosen = routing.select("station", F.col("model").alias("_chosen"))
    left = val.select("station", "model", F.col("rmse").alias("val_rmse"))
    right = test.select("station", "model", F.col("rmse").alias("test_rmse"))
    return (
        left.join(chosen, "station", "left")
        .join(right, ["station", "model"], "left")
        .select("station", "model", "val_rmse", F.coalesce(F.col("model") == F.col("_chosen"), F.lit(False)).alias("chosen"), "test_rmse")
    )
