"""Forecast labels, sequence windows and persistence baselines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.plans.series import BLOCK_BITS, block_window, epoch_us, number_rows, overlap_blocks

#: Bytes that a packed block aims at; wide rows make shorter blocks, but never so short that a tenth is stored twice.
PACKED_BYTES = 1 << 20
PACKED = ("ts", "x", "y", "at")


def horizon_labels(
    df: DataFrame,
    targets: Sequence[str],
    horizon: int,
    mode: str = "exact",
    step_s: int = 900,
    keys: Sequence[str] = ("station", "split"),
    bucket_s: int = 86_400,
) -> DataFrame:
    """``y_<target>_h<horizon>``: the target ``horizon`` rows ahead in the same station and split.

    ``mode="exact"`` also requires that row to be exactly ``horizon`` steps later; ``"rows"`` does not.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    rows, own = overlap_blocks(number_rows(df, keys, bucket_s=bucket_s, pos="_pos"), after=horizon, pos="_pos")
    w = block_window(keys, "_pos")
    ahead = epoch_us(F.lead("ts", horizon).over(w)) - epoch_us("ts")
    on_time = F.lit(True) if mode == "rows" else ahead == horizon * step_s * 1_000_000
    labels = [F.when(on_time, F.lead(t, horizon).over(w)).alias(f"y_{t}_h{horizon}") for t in targets]
    return rows.select(*df.columns, *labels, own.alias("_own")).where("_own").drop("_own")


def sequence_windows(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int,
    contiguous_step_s: int | None = None,
    keys: Sequence[str] = ("station",),
    bucket_s: int = 86_400,
) -> DataFrame:
    """Input rows t-T .. t-1 as an array and the label of row t, wherever T rows come before.

    ``contiguous_step_s`` keeps only windows without a hole in time. Every window holds copies of its rows; ``pack_windows``
    stores a row once.
    """
    numbered = number_rows(df, keys, bucket_s=bucket_s, pos="_pos")
    rows, own = overlap_blocks(numbered, before=length, pos="_pos")
    frame = block_window(keys, "_pos").rowsBetween(-length, -1)
    x = F.collect_list(F.struct("ts", *features)).over(frame)
    out = rows.select(*keys, "ts", x.alias("x"), F.col(target).alias("y"), own.alias("_own"))
    out = out.where(F.col("_own") & (F.size("x") == length)).drop("_own")
    if contiguous_step_s is not None:
        span = epoch_us(F.col("x")[length - 1]["ts"]) - epoch_us(F.col("x")[0]["ts"])
        out = out.where(span == (length - 1) * contiguous_step_s * 1_000_000)
    return out


def sequence_windows_multi(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    length: int,
    horizon: int,
    keys: Sequence[str] = ("station",),
    bucket_s: int = 86_400,
) -> DataFrame:
    """Windows ending at row t with one label per target at row t + h, wherever both exist."""
    numbered = number_rows(df, keys, bucket_s=bucket_s, pos="_pos")
    rows, own = overlap_blocks(numbered, before=length - 1, after=horizon, pos="_pos")
    w = block_window(keys, "_pos")
    x = F.collect_list(F.struct("ts", *features)).over(w.rowsBetween(-(length - 1), 0))
    ys = [F.lead(t, horizon).over(w).alias(f"y_{t}") for t in targets]
    out = rows.select(*keys, "ts", x.alias("x"), *ys, F.lead("ts", horizon).over(w).alias("y_ts"), own.alias("_own"))
    return out.where(F.col("_own") & (F.size("x") == length) & F.col("y_ts").isNotNull()).drop("_own")


def pack_windows(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    length: int,
    horizon: int = 1,
    contiguous_step_s: int | None = None,
    keys: Sequence[str] = ("station",),
    bucket_s: int = 86_400,
) -> DataFrame:
    """The windows of every series as blocks of rows and offsets, so that a row is stored once and not ``length`` times.

    A block holds the ``ts`` of its rows in order, their features flat in ``x``, their targets flat in ``y``, and in ``at``
    the 0-based places at which windows begin. The window at ``a`` is the rows a .. a + length - 1, its labels are those of
    row a + length - 1 + horizon. It belongs to the block of its last row; only the rows that reach over a block's edge are
    stored twice, less than a tenth. Missing values are NaN. ``contiguous_step_s`` keeps only windows without a hole in time.
    """
    if length < 1 or horizon < 1:
        raise ValueError("length and horizon must be at least 1")
    fit = (PACKED_BYTES // (8 * (len(features) + len(targets) + 1))).bit_length() - 1
    bits = max(min(BLOCK_BITS, fit), (16 * (length + horizon) - 1).bit_length())
    numbered = number_rows(df, keys, bucket_s=bucket_s, pos="_pos")
    rows, own = overlap_blocks(numbered, before=length - 1, after=horizon, pos="_pos", bits=bits)

    def flat(columns):
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])

    row = F.struct("_pos", "ts", flat(features).alias("x"), flat(targets).alias("y"), own.alias("own"))
    held = rows.groupBy(*keys, "_blk").agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def begins(a):
        last = F.get("_rows", a + (length - 1))
        if contiguous_step_s is None:
            return last["own"]
        span = epoch_us(last["ts"]) - epoch_us(F.get("_rows", a)["ts"])
        return last["own"] & (span == (length - 1) * contiguous_step_s * 1_000_000)

    starts = F.when(F.size("_rows") >= length + horizon, F.sequence(F.lit(0), F.size("_rows") - (length + horizon)))
    return held.select(
        *keys,
        F.transform("_rows", lambda r: r["ts"]).alias("ts"),
        F.flatten(F.transform("_rows", lambda r: r["x"])).alias("x"),
        F.flatten(F.transform("_rows", lambda r: r["y"])).alias("y"),
        F.filter(starts, begins).alias("at"),
    ).where(F.size("at") > 0)


def map_windows(packed: DataFrame, work: Callable[..., dict], schema: str, length: int, horizon: int = 1) -> DataFrame:
    """The keys and what ``work`` returns for the windows of packed blocks, one row per window.

    ``work(x, y, first_ts, last_ts, label_ts)`` is called for stretches of windows that begin at neighbouring rows. ``x`` is a
    view (windows, length, features) of the block, nothing is copied; ``y`` is (windows, targets). It returns a column of
    as many values as windows for each name in ``schema``.
    """
    keys = [f for f in packed.schema.fields if f.name not in PACKED]
    result = StructType([*keys, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(result)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ts, x, y, at = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in PACKED)
                views = sliding_window_view(x.reshape(len(ts), -1), length, axis=0).transpose(0, 2, 1)
                labels = y.reshape(len(ts), -1)
                for part in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    last = part + length - 1
                    made = work(views[part[0] : part[-1] + 1], labels[last + horizon], ts[part], ts[last], ts[last + horizon])
                    made |= {f.name: pa.repeat(batch.column(f.name)[i], len(part)) for f in keys}
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name]).cast(f.type) for f in arrow], schema=arrow)

    return packed.mapInArrow(run, result)


def window_eligible(
    df: DataFrame, length: int, horizon: int, keys: Sequence[str] = ("station",), bucket_s: int = 86_400
) -> DataFrame:
    """Rows left after the first T + h - 2 rows of every series."""
    numbered = number_rows(df, keys, bucket_s=bucket_s, pos="_pos")
    return numbered.where(F.col("_pos") >= max(length + horizon - 2, 0)).select(*df.columns)


def persistence(df: DataFrame, steps: int, keys: Sequence[str] = ("station", "variable")) -> DataFrame:
    """Prediction that repeats the value ``steps`` grid places earlier."""
    rows, own = overlap_blocks(df, before=steps)
    pred = F.lag("value", steps).over(block_window(keys))
    return rows.select(*df.columns, pred.alias("y_pred"), own.alias("_own")).where("_own").drop("_own")
