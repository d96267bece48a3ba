"""Canonical variable names, reshaping and type coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import SHARED_SUFFIXES, canonical_name, plain_number
from gridloom.plans.joins import join_params


def densest_synonyms(df: DataFrame, suffixes: Sequence[str] = SHARED_SUFFIXES, place: str | None = None) -> DataFrame:
    """Per (station, canonical name) the original column with the most known values.

    Ties go to the first column: by ``place``, the sheet column, where there is one, else by name.
    """
    order = F.min(place) if place else F.min("variable")
    per_name = df.groupBy("station", "variable").agg(F.count("value").alias("n_known"), order.alias("_place"))
    named = per_name.withColumn("canonical", canonical_name("variable", "station", suffixes))
    best = Window.partitionBy("station", "canonical").orderBy(F.desc("n_known"), "_place", "variable")
    return (
        named.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .select("station", "canonical", "variable", "n_known")
    )


def standardize(df: DataFrame, suffixes: Sequence[str] = SHARED_SUFFIXES, place: str | None = None) -> DataFrame:
    """Readings under canonical names; other spellings of a chosen variable are dropped."""
    chosen = densest_synonyms(df, suffixes, place).select("station", "variable", "canonical")
    named = join_params(df, chosen, ["station", "variable"]).withColumn("variable", F.col("canonical"))
    return named.select(*df.columns)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", out: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, out)


def pivot_wide(df: DataFrame, keys: Sequence[str], variables: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One column per listed variable, the mean of copies, in the listed order."""
    return df.groupBy(*keys).pivot(name, list(variables)).agg(F.avg(value))


def coerce_keys(df: DataFrame, station: str = "station", ts: str = "ts") -> DataFrame:
    """Times as wall-clock timestamps; rows without a station or a time are dropped."""
    return df.withColumn(ts, F.col(ts).try_cast("timestamp_ntz")).dropna(subset=[station, ts])


def coerce_numeric(df: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Measurements as finite doubles, anything else null."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def number(c: str):
        if c in texts:
            return plain_number(F.col(c))
        value = F.col(c).try_cast("double")
        return F.when(F.abs(value) < float("inf"), value)

    return df.withColumns({c: number(c) for c in columns})


def drop_negatives(df: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Negative measurements become null; zero stays."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})
