"""Causal features: lags, shifted rolling statistics, calendar and direction parts, and the feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import TIME_FEATURES, calendar_parts, cyclical_time, direction_parts
from gridloom.plans.joins import join_params
from gridloom.plans.series import BLOCK_BITS, SERIES, block_window, overlap_blocks

# Grid steps of the lags and rolling windows.
LAGS = (1, 2, 3, 4, 8, 12, 24, 48, 96)
WINDOWS = (4, 12, 24, 48, 96)


def temporal_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.select("*", *cyclical_time(ts))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.select("*", *calendar_parts(ts))


def direction_features(df: DataFrame, direction: str, prefix: str = "wd") -> DataFrame:
    """Replace a direction in degrees by its sine and cosine; nothing happens where the column is absent."""
    if direction not in df.columns:
        return df
    return df.select("*", *direction_parts(direction, prefix)).drop(direction)


def direction_series(df: DataFrame, direction: str = "WD", prefix: str = "wd") -> DataFrame:
    """The same on a long table: rows of the direction become two rows, sine and cosine."""
    angle = F.radians("value")
    both = F.array(
        F.struct(F.lit(f"{prefix}_sin").alias("variable"), F.sin(angle).alias("value")),
        F.struct(F.lit(f"{prefix}_cos").alias("variable"), F.cos(angle).alias("value")),
    )
    same = F.array(F.struct(F.col("variable"), F.col("value")))
    kept = [c for c in df.columns if c not in ("variable", "value")]
    out = df.select(*kept, F.explode(F.when(F.col("variable") == direction, both).otherwise(same)).alias("_r"))
    return out.select(*kept, "_r.variable", "_r.value").select(*df.columns)


def causal_features(
    df: DataFrame,
    lags: Sequence[int] = (),
    means: Sequence[int] = (),
    stds: Sequence[int] = (),
    keys: Sequence[str] = SERIES,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Lags and rolling statistics of the rows strictly before each grid place.

    A rolling statistic is null unless all its rows are present and known. All windows share one sort per block.
    """
    before = max([*lags, *means, *stds, 0])
    rows, own = overlap_blocks(df, before=before, bits=bits)
    w = block_window(keys)
    made = [F.lag("value", k).over(w).alias(f"lag_{k}") for k in lags]
    for stat, label, sizes in ((F.avg, "rollmean", means), (F.stddev_samp, "rollstd", stds)):
        for size in sizes:
            frame = w.rowsBetween(-size, -1)
            full = F.count("value").over(frame) == size
            made.append(F.when(full, stat("value").over(frame)).alias(f"{label}_{size}"))
    return rows.select(*df.columns, *made, own.alias("_own")).where("_own").drop("_own")


def lag_features(df: DataFrame, lags: Sequence[int] = LAGS, keys: Sequence[str] = SERIES) -> DataFrame:
    return causal_features(df, lags=lags, keys=keys)


def rolling_mean(df: DataFrame, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = SERIES) -> DataFrame:
    return causal_features(df, means=windows, keys=keys)


def rolling_std(df: DataFrame, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = SERIES) -> DataFrame:
    return causal_features(df, stds=windows, keys=keys)


def base_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """Variables per station with a known value in train; the target is always kept."""
    counts = df.where(F.col("split") == "train").groupBy(*SERIES).agg(F.count("value").alias("n_known"))
    keep = F.col("n_known") > 0
    if target is not None:
        keep = keep | (F.col("variable") == target)
    return counts.where(keep & ~F.col("variable").isin(*TIME_FEATURES))


def widen_features(df: DataFrame, variables: Sequence[str], columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key with ``<variable>`` and ``<variable>_<column>`` for a fixed list of variables."""
    def name(v: str, c: str) -> str:
        safe = v.replace(".", "_")
        return safe if c == "value" else f"{safe}_{c}"

    # One aggregate a variable, over a struct of all its columns; taken apart behind the shuffle.
    held = [F.max(F.when(F.col("variable") == v, F.struct(*columns))).alias(f"_v{i}") for i, v in enumerate(variables)]
    apart = [F.col(f"_v{i}.{c}").alias(name(v, c)) for i, v in enumerate(variables) for c in columns]
    return df.groupBy(*keys).agg(*held).select(*keys, *apart)


def build_features(
    df: DataFrame,
    target: str,
    variables: Sequence[str],
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    direction: str | None = None,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Feature table from filled grid rows: direction, time, base values, lags, rolling means.

    Only variables known in the station's train split get features. Rows without the target or one of its lags are
    dropped; other features may be null.
    """
    rows, names = df, list(variables)
    if direction in names:
        rows = direction_series(rows, direction)
        names = [v for v in names if v != direction] + ["wd_sin", "wd_cos"]
    rows = rows.where(F.col("variable").isin(*names))
    rows = join_params(rows, base_columns(rows, target).select(*SERIES), SERIES, "left_semi")
    feats = causal_features(rows, lags=lags, means=windows)
    made = ["value", *[f"lag_{k}" for k in lags], *[f"rollmean_{w}" for w in windows]]
    wide = widen_features(feats, names, made, ["station", "ts", "split", "pos"])
    wide = temporal_features(wide)
    if drop_incomplete:
        safe = target.replace(".", "_")
        wide = wide.dropna(subset=[safe, *[f"{safe}_lag_{k}" for k in lags]])
    return wide


def stable_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Columns of the train split, in order and type: missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()]
    )


def schema_record(base: DataFrame, target: str, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One row per (station, feature column): the base value, its lags and its rolling means."""
    made = [F.struct(F.lit("base").alias("kind"), F.lit(0).cast("bigint").alias("size"))]
    made += [F.struct(F.lit("lag").alias("kind"), F.lit(k).cast("bigint").alias("size")) for k in lags]
    made += [F.struct(F.lit("rollmean").alias("kind"), F.lit(w).cast("bigint").alias("size")) for w in windows]
    rows = base.select("station", "variable", F.explode(F.array(*made)).alias("_m"))
    name = F.when(F.col("_m.kind") == "base", F.col("variable")).otherwise(
        F.concat_ws("_", "variable", "_m.kind", F.col("_m.size").cast("string"))
    )
    return rows.select(
        "station",
        "variable",
        F.col("_m.kind").alias("kind"),
        F.col("_m.size").alias("size"),
        name.alias("feature"),
        (F.col("variable") == target).alias("is_target"),
    )
