"""Scalers, feature selection, model matrices and exact-size samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.joins import join_params

KEY_COLUMNS = ("station", "ts", "timestamp", "split", "pos", "n_pos", "source_file", "source_sheet")
# Pollutants tried as targets, in this order.
DEFAULT_TARGETS = ("PM2.5", "PM10", "NO2", "SO2", "CO", "O3", "NH3", "NO", "NOX", "BENZ")


def fit_scaler(
    df: DataFrame, keys: Sequence[str] = ("variable",), population: bool = False, exclude: Sequence[str] = ()
) -> DataFrame:
    """Train mean and standard deviation per variable; a zero or undefined deviation becomes 1.

    ``population=False`` is the feature-stage scaler, ``True`` the model-side one.
    """
    train = df.where((F.col("split") == "train") & ~F.col("variable").isin(*exclude) if exclude else F.col("split") == "train")
    std = F.stddev_pop("value") if population else F.stddev_samp("value")
    return train.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std")
    )


def apply_scaler(df: DataFrame, params: DataFrame, keys: Sequence[str] = ("variable",), out: str = "value") -> DataFrame:
    """(value - mean) / std in every split; variables without parameters pass unchanged."""
    scaled = F.when(F.col("mean").isNull(), F.col("value")).otherwise((F.col("value") - F.col("mean")) / F.col("std"))
    joined = join_params(df, params, keys, "left").withColumn(out, scaled)
    return joined.select(*df.columns, *([out] if out not in df.columns else []))


def scale_wide(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """The same on wide columns: one pass over train, the moments enter the plan as literals."""
    std = F.stddev_pop if population else F.stddev_samp
    aggs = [x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), std(c).alias(f"s{i}"))]
    fit = df.where(F.col("split") == "train").agg(*aggs).first()
    return df.withColumns({c: (F.col(c) - F.lit(fit[f"m{i}"] or 0.0)) / F.lit(fit[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def invert_scaler(df: DataFrame, params: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("variable",)) -> DataFrame:
    """Back to original units for the named columns."""
    back = {c: F.col(c) * F.coalesce("std", F.lit(1.0)) + F.coalesce("mean", F.lit(0.0)) for c in columns}
    return join_params(df, params, keys, "left").withColumns(back).select(*df.columns)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = {*KEY_COLUMNS, *exclude}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def known_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of known values, counted in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = [
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("feature"), F.col(f"c{i}").alias("n_known"))
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*cells)))


def select_features(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Numeric columns that are neither keys nor targets, with their support; all-null ones are marked dropped."""
    counts = known_counts(df, numeric_columns(df, targets))
    return counts.withColumn("kept", F.col("n_known") > 0)


def feature_list(df: DataFrame, targets: Sequence[str]) -> list[str]:
    """Kept feature names in column order; the list is bounded by the schema."""
    return [r["feature"] for r in select_features(df, targets).where("kept").orderBy("position").collect()]


def default_targets(df: DataFrame, preferred: Sequence[str] = DEFAULT_TARGETS) -> list[str]:
    numeric = set(numeric_columns(df))
    found = [t for t in preferred if t in numeric]
    if not found:
        raise ValueError(f"none of the preferred targets is a numeric column: {list(preferred)}")
    return found


def model_matrix(df: DataFrame, features: Sequence[str], target: str, out: str = "features") -> DataFrame:
    """Vector column for Spark ML next to the row keys; rows without a target go, missing features stay as NaN."""
    keys = [c for c in ("split", "station", "ts") if c in df.columns]
    rows = df.dropna(subset=[target])
    assembled = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(rows)
    return assembled.select(*keys, F.col(target).cast("double").alias("label"), out)


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose named columns are all known, not NaN and not infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(ok)


def quota_table(df: DataFrame, max_rows: int, key: str = "station", floor_rows: int = 1000, floor_share: float = 0.02) -> DataFrame:
    """Rows to keep per key: a share of ``max_rows`` by size with a floor, scaled down when the sum is too large."""
    everything = Window.partitionBy(F.lit(1))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    floor = max(floor_rows, int(max_rows * floor_share))
    share = F.bround(F.col("n") / F.sum("n").over(everything) * max_rows)
    sized = counts.withColumn("_total", F.sum("n").over(everything)).withColumn(
        "_q", F.least(F.col("n"), F.greatest(F.lit(floor), share.cast("bigint")))
    )
    asked = F.sum("_q").over(everything)
    scaled = F.when(asked > max_rows, F.greatest(F.lit(1), F.floor(F.col("_q") * (max_rows / asked)))).otherwise(F.col("_q"))
    whole = F.lit(max_rows <= 0) | (F.col("_total") <= max_rows)
    return sized.select(key, "n", F.when(whole, F.col("n")).otherwise(scaled).cast("bigint").alias("quota"))


def proportional_table(df: DataFrame, max_rows: int, key: str = "station") -> DataFrame:
    """Rows to keep per key: the same fraction everywhere, at least one."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = F.bround(F.lit(float(max_rows)) / total * F.col("n")).cast("bigint")
    whole = F.lit(max_rows <= 0) | (total <= max_rows)
    quota = F.when(whole, F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.lit(1), share)))
    return counts.select(key, "n", quota.cast("bigint").alias("quota"))


def _drawn(df: DataFrame, row_id: Sequence[Column | str], seed: int, cells: int) -> DataFrame:
    """A seeded hash of each row and the hash range it falls in."""
    rows = df.withColumn("_draw", F.xxhash64(*row_id, F.lit(seed)))
    return rows.withColumn("_cell", F.pmod(F.col("_draw"), F.lit(cells).cast("bigint")))


def take_quota(
    df: DataFrame, quotas: DataFrame, key: str, row_id: Sequence[Column | str], seed: int = 42, cells: int = 1 << 16
) -> DataFrame:
    """Exactly ``quota`` random rows per key, chosen by a seeded hash of ``row_id`` (unique per row).

    Rows fall into many hash ranges that are counted first. Ranges before the one in which the quota ends are taken
    whole; only that one range is ordered. ``df`` is read three times and nothing but the last range is shuffled.
    """
    rows = _drawn(df, row_id, seed, cells)
    per_cell = rows.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_cell")) - F.col("_c")
    reached = per_cell.withColumn("_start", before).join(quotas.select(key, "quota"), key)
    cuts = (
        reached.where(F.col("_start") < F.col("quota"))
        .groupBy(key)
        .agg(F.max("_cell").alias("_cut"), F.max_by(F.col("quota") - F.col("_start"), "_cell").alias("_room"))
    )
    inside = join_params(rows, cuts, [key])
    whole = inside.where(F.col("_cell") < F.col("_cut"))
    order = Window.partitionBy(key).orderBy("_draw", *row_id)
    last = inside.where(F.col("_cell") == F.col("_cut")).withColumn("_rank", F.row_number().over(order))
    return whole.select(*df.columns).unionByName(last.where(F.col("_rank") <= F.col("_room")).select(*df.columns))


def sample_rows(df: DataFrame, n: int, row_id: Sequence[Column | str], seed: int = 42, cells: int = 1 << 16) -> DataFrame:
    """One global draw of exactly ``n`` rows, or all rows when there are fewer.

    The driver sees one count per hash range, ``cells`` numbers whatever the input.
    """
    rows, left = _drawn(df, row_id, seed, cells), n
    for cell, count in sorted((r["_cell"], r["count"]) for r in rows.groupBy("_cell").count().collect()):
        if count > left:
            last = rows.where(F.col("_cell") == cell).orderBy("_draw", *row_id).limit(left)
            return rows.where(F.col("_cell") < cell).unionByName(last).select(*df.columns)
        left -= count
    return df
