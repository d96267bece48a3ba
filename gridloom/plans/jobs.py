"""End-to-end jobs: readings to features, and readings to baseline metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import features as fe
from gridloom.operators import grid as gr
from gridloom.operators import metrics as me
from gridloom.operators import naming as nm
from gridloom.operators import prepare as pr
from gridloom.operators import split as sp
from gridloom.session import stage_table


def prepare_series(
    readings: DataFrame, step_s: int, limit: int = 4, cap: float | None = 0.995, target: str | None = None
) -> DataFrame:
    """Readings to filled, capped grid rows with their split; the filled rows are written once between the fits."""
    clean = nm.drop_negatives(nm.coerce_numeric(readings))
    grid = sp.chrono_split(gr.grid_means(clean, step_s))
    filled = stage_table(sp.fill_gaps(grid, limit), "filled")
    if cap is None:
        return filled
    fitted = filled if target is None else filled.where(F.col("variable") == target)
    return sp.apply_caps(filled, sp.fit_caps(fitted, cap))


def feature_job(
    readings: DataFrame,
    target: str,
    variables: Sequence[str],
    step_s: int = gr.STEP_S,
    lags: Sequence[int] = fe.LAGS,
    windows: Sequence[int] = fe.WINDOWS,
    direction: str | None = "WD",
) -> DataFrame:
    """Raw readings to the scaled feature table of all splits; the target keeps its units.

    A direction among the variables becomes its sine and cosine before lags and rolling means are taken.
    """
    capped = prepare_series(readings, step_s, target=target)
    wide = stage_table(fe.build_features(capped, target, variables, lags, windows, direction), "features")
    return pr.scale_wide(wide, pr.numeric_columns(wide, [target.replace(".", "_")]))


def baseline_report(readings: DataFrame, step_s: int = gr.STEP_S) -> DataFrame:
    """Persistence metrics per split and station on rows that have their lags."""
    grid = sp.chrono_split(gr.grid_means(readings, step_s))
    feats = fe.causal_features(sp.fill_gaps(grid), lags=(1, 2, 4), means=(4,))
    feats = sp.require_nonnull(feats, ["value", "lag_1", "lag_2", "lag_4"])
    preds = feats.select(
        "split", "station", "ts", F.lit("persist1").alias("model"), F.col("value").alias("y_true"), F.col("lag_1").alias("y_pred")
    )
    return me.metrics_table(preds, ["split", "model"])
