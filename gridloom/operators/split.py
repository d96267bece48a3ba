"""Chronological splits, bounded gap filling and train-fitted caps and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.joins import join_params
from gridloom.plans.quantiles import exact_quantiles
from gridloom.plans.series import BLOCK_BITS, SERIES, block_of, carry_known, number_rows

SPLITS = ("train", "val", "test")


def split_of(pos: Column, n: Column, train: float = 0.70, val: float = 0.85) -> Column:
    """Split of a place: the first floor(train * n) places, then up to floor(val * n), then the rest."""
    return (
        F.when(pos < F.floor(n * F.lit(train)), F.lit("train"))
        .when(pos < F.floor(n * F.lit(val)), F.lit("val"))
        .otherwise(F.lit("test"))
    )


def chrono_split(grid: DataFrame, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """Add ``split`` to grid rows; places are known, so nothing is sorted or shuffled."""
    return grid.withColumn("split", split_of(F.col("pos"), F.col("n_pos"), train, val))


def fill_gaps(
    df: DataFrame,
    limit: int = 4,
    whole_gap_only: bool = False,
    keys: Sequence[str] = (*SERIES, "split"),
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Linear fill of the first ``limit`` places of every gap with known ends inside one split.

    With ``whole_gap_only`` longer gaps stay empty altogether. ``df`` is read twice, for the rows and for one summary
    row per block; grid rows share one shuffle for both, other frames are best staged first.
    """
    rows = df.withColumn("_blk", block_of("pos", bits))
    rows = rows.join(carry_known(rows, keys), [*keys, "_blk"], "left")
    known_pos = F.when(F.col("value").isNotNull(), F.col("pos"))
    back = Window.partitionBy(*keys, "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_blk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        *df.columns,
        F.coalesce(F.last(known_pos, True).over(back), "_carry_prev_pos").alias("_p0"),
        F.coalesce(F.last("value", True).over(back), "_carry_prev_val").alias("_v0"),
        F.coalesce(F.last(known_pos, True).over(ahead), "_carry_next_pos").alias("_p1"),
        F.coalesce(F.last("value", True).over(ahead), "_carry_next_val").alias("_v1"),
    )
    span, done = F.col("_p1") - F.col("_p0"), F.col("pos") - F.col("_p0")
    near = (span - 1 <= limit) if whole_gap_only else (done <= limit)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (done / span)
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(near & (span > 0), line)
    return rows.withColumn("value", filled).select(*df.columns)


def fit_caps(df: DataFrame, q: float = 0.995, keys: Sequence[str] = SERIES) -> DataFrame:
    """Exact train quantile per series as ``cap``; series without a positive cap are left out."""
    if not 0.0 < q <= 1.0:
        return df.select(*keys, F.lit(None).cast("double").alias("cap")).limit(0)
    train = df.where(F.col("split") == "train")
    return exact_quantiles(train, keys, "value", [q], ["cap"]).where(F.col("cap") > 0)


def apply_caps(df: DataFrame, caps: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Clip to [0, cap] in every split; rows of series without a cap are unchanged."""
    clipped = F.greatest(F.lit(0.0), F.least(F.col("value"), F.col("cap")))
    value = F.when(F.col("cap").isNull() | F.col("value").isNull(), F.col("value")).otherwise(clipped)
    return join_params(df, caps, keys, "left").withColumn("value", value).select(*df.columns)


def winsorize(df: DataFrame, lower: float = 0.005, upper: float = 0.995, keys: Sequence[str] = SERIES) -> DataFrame:
    """Clip every series to its train quantiles."""
    train = df.where(F.col("split") == "train")
    bounds = exact_quantiles(train, keys, "value", [lower, upper], ["_low", "_high"])
    clipped = F.greatest(F.col("_low"), F.least(F.col("value"), F.col("_high")))
    value = F.when(F.col("_low").isNull() | F.col("value").isNull(), F.col("value")).otherwise(clipped)
    return join_params(df, bounds, keys, "left").withColumn("value", value).select(*df.columns)


def require_nonnull(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows in which one of the required columns is missing."""
    return df.dropna(subset=list(columns))


def fit_medians(df: DataFrame, keys: Sequence[str] = ("variable",)) -> DataFrame:
    """Exact train medians; ``keys=("station", "variable")`` fits them per station."""
    return exact_quantiles(df.where(F.col("split") == "train"), keys, "value", [0.5], ["median"])


def apply_medians(df: DataFrame, medians: DataFrame, keys: Sequence[str] = ("variable",)) -> DataFrame:
    filled = join_params(df, medians, keys, "left").withColumn("value", F.coalesce("value", "median"))
    return filled.select(*df.columns)


def tail_rows(df: DataFrame, n: int, keys: Sequence[str] = ("station",), bucket_s: int = 86_400) -> DataFrame:
    """The last ``n`` rows of every series."""
    if "pos" in df.columns and "n_pos" in df.columns:
        return df.where(F.col("pos") >= F.col("n_pos") - n)
    numbered = number_rows(df, keys, bucket_s=bucket_s)
    return numbered.where(F.col("pos") >= F.col("n_pos") - n).select(*df.columns)


def history_context(df: DataFrame, rows: int = 97, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """For val and test: the last ``rows`` grid places before the split, marked with the split they serve.

    ``train`` and ``val`` are the shares at which the chronological split ends its parts.

    Feature windows run over the whole series, so nothing downstream needs these copies; the operator serves jobs
    that score one split at a time.
    """
    train_end, val_end = F.floor(F.col("n_pos") * F.lit(train)), F.floor(F.col("n_pos") * F.lit(val))
    serves = F.array_compact(
        F.array(
            F.when((F.col("pos") < train_end) & (F.col("pos") >= train_end - rows), F.lit("val")),
            F.when((F.col("pos") < val_end) & (F.col("pos") >= val_end - rows), F.lit("test")),
        )
    )
    return df.withColumn("context_for", F.explode(serves))
