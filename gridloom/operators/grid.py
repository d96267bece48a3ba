"""Duplicate times, strict time grids, resampling and frequency audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.series import BLOCK_BITS, SERIES, block_of, epoch_us, floor_ts, from_us, whole_div
from gridloom.session import stage_table

STEP_S = 900


def dedupe_mean(df: DataFrame, keys: Sequence[str] = ("station", "ts"), values: Sequence[str] = ("value",)) -> DataFrame:
    """Mean of the known values per key; copies of a key are combined before the shuffle."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def resample(df: DataFrame, step_s: int, origin_s: int = 0, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean per step of the clock; null where every value of the step is missing."""
    return df.groupBy(*keys, floor_ts("ts", step_s, origin_s).alias("ts")).agg(F.avg("value").alias("value"))


def series_spans(df: DataFrame, step_s: int = STEP_S) -> DataFrame:
    """One row per (station, variable) with the station's first time and its number of grid places."""
    per_series = df.groupBy(*SERIES).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    station = Window.partitionBy("station")
    first, last = F.min(epoch_us("_lo")).over(station), F.max(epoch_us("_hi")).over(station)
    return per_series.select(
        *SERIES, first.alias("t0"), (whole_div(last - first, step_s * 1_000_000) + 1).alias("n_pos")
    )


def complete_grid(df: DataFrame, step_s: int = STEP_S, bits: int = BLOCK_BITS) -> DataFrame:
    """Every step from the station's first to its last time, for each of its variables.

    Readings off the anchored steps are dropped, copies are averaged, gaps are null. ``pos`` is the place on the grid
    and ``n_pos`` the station's number of places. Empty places are made block by block, so a long series is spread
    over tasks; places and readings meet in one aggregate instead of a join. Keys are known not to be null, so every
    reader of the grid asks for the same aggregate and Spark runs its shuffle once.
    """
    step, size = step_s * 1_000_000, 1 << bits
    named = F.col("station").isNotNull() & F.col("variable").isNotNull()
    rows = df.where(named & F.col("ts").isNotNull())
    spans = stage_table(series_spans(rows, step_s), "spans").where(named)
    places = (
        spans.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(F.col("n_pos") - 1, bits))))
        .repartition(*SERIES, "_blk")
        .withColumn(
            "pos",
            F.explode(F.sequence(F.col("_blk") * size, F.least((F.col("_blk") + 1) * size, F.col("n_pos")) - 1)),
        )
        .select(*SERIES, "t0", "n_pos", "pos", F.lit(None).cast("double").alias("value"))
    )
    offset = epoch_us("ts") - F.col("t0")
    pos = F.coalesce(whole_div(offset, step), F.lit(0).cast("bigint"))
    placed = (
        rows.select(*SERIES, "ts", "value")
        .join(spans, list(SERIES))
        .where(F.pmod(offset, F.lit(step).cast("bigint")) == 0)
        .select(*SERIES, "t0", "n_pos", pos.alias("pos"), F.col("value").cast("double"))
    )
    return (
        placed.unionByName(places)
        .groupBy(*SERIES, "t0", "n_pos", "pos")
        .agg(F.avg("value").alias("value"))
        .select(*SERIES, from_us(F.col("t0") + F.col("pos") * step).alias("ts"), "value", "pos", "n_pos")
    )


def grid_means(df: DataFrame, step_s: int = STEP_S, origin_s: int = 0) -> DataFrame:
    """Resampled readings on their complete grid; both means are one aggregate, so rows are shuffled once."""
    return complete_grid(df.withColumn("ts", floor_ts("ts", step_s, origin_s)), step_s)


def step_deltas(df: DataFrame, keys: Sequence[str] = ("station",), bucket_s: int = 3600) -> DataFrame:
    """Seconds between successive rows as (keys, delta_s, n).

    Equal times are counted before the shuffle and give ``n - 1`` zero steps. The step into a time bucket comes from
    the last time of the bucket before it, taken from a table with one row per bucket.
    """
    us, width = epoch_us("ts"), bucket_s * 1_000_000
    dated = df.where(F.col("ts").isNotNull()).select(*keys, us.alias("_us"), whole_div(us, width).alias("_bucket"))
    times = dated.groupBy(*keys, "_bucket", "_us").agg(F.count(F.lit(1)).alias("_copies"))
    ends = dated.groupBy(*keys, "_bucket").agg(F.max("_us").alias("_end"))
    into = ends.select(
        *keys, "_bucket", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_us")
    steps = times.join(into, [*keys, "_bucket"]).select(
        *keys,
        "_copies",
        ((F.col("_us") - F.coalesce(F.lag("_us").over(inside), F.col("_before"))) / 1_000_000.0).alias("_delta"),
    )
    zero = F.when(F.col("_copies") > 1, F.struct(F.lit(0.0).alias("d"), (F.col("_copies") - 1).alias("c")))
    real = F.when(F.col("_delta").isNotNull(), F.struct(F.col("_delta").alias("d"), F.lit(1).cast("bigint").alias("c")))
    return (
        steps.select(*keys, F.explode(F.array_compact(F.array(zero, real))).alias("s"))
        .groupBy(*keys, F.col("s.d").alias("delta_s"))
        .agg(F.sum("s.c").alias("n"))
    )


def _share(step_s: float):
    near = F.abs(F.col("delta_s") - step_s) <= 1e-8 + 1e-5 * step_s
    return F.sum(F.when(near, F.col("n")).otherwise(0)) / F.sum("n")


def step_audit(df: DataFrame) -> DataFrame:
    """Per station: rows, share of 15-minute and hourly steps, span and number of sheets."""
    spans = df.where(F.col("ts").isNotNull()).groupBy("station").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        # A missing sheet name counts as one of the names.
        (F.count_distinct("source_sheet") + F.max(F.col("source_sheet").isNull().cast("int"))).alias("n_sheets"),
    )
    shares = step_deltas(df).groupBy("station").agg(_share(900.0).alias("frac_15min"), _share(3600.0).alias("frac_60min"))
    return shares.join(spans, "station")


def step_topk(df: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most frequent steps per station in whole minutes (half to even)."""
    minutes = F.bround(F.col("delta_s") / 60.0).cast("bigint")
    counts = step_deltas(df).groupBy("station", minutes.alias("minutes")).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("station").orderBy(F.desc("n"), "minutes"))
    return counts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def sheet_audit(df: DataFrame) -> DataFrame:
    """All sheets, those first in which hourly steps are most common; shares are null where there is no step."""
    keys = ("station", "source_sheet")
    rows = df.where(F.col("ts").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    shares = step_deltas(df, keys).groupBy(*keys).agg(_share(900.0).alias("frac_15"), _share(3600.0).alias("frac_60"))
    return rows.join(shares, list(keys), "left").orderBy(F.desc_nulls_last("frac_60"), F.desc("n_rows"), *keys)


def top_sheets(df: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` sheet names with the most rows."""
    return (
        df.groupBy("source_sheet")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), "source_sheet")
        .limit(k)
    )
