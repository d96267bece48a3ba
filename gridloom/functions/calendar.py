"""Column expressions for calendar parts, cyclical time and compass directions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed set of columns that ``cyclical_time`` adds.
TIME_FEATURES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend")


def cyclical_time(ts: str = "ts") -> list[Column]:
    """Hour and weekday on the circle plus the weekend flag; Monday is 0."""
    hour = F.hour(ts) * F.lit(2.0 * math.pi) / 24.0
    day = F.weekday(ts) * F.lit(2.0 * math.pi) / 7.0
    return [
        F.sin(hour).alias("hour_sin"),
        F.cos(hour).alias("hour_cos"),
        F.sin(day).alias("dow_sin"),
        F.cos(day).alias("dow_cos"),
        (F.weekday(ts) >= 5).cast("tinyint").alias("is_weekend"),
    ]


def calendar_parts(ts: str = "ts") -> list[Column]:
    return [
        F.year(ts).cast("bigint").alias("year"),
        F.month(ts).cast("bigint").alias("month"),
        F.dayofyear(ts).cast("bigint").alias("day_of_year"),
        F.weekday(ts).cast("bigint").alias("weekday"),
        F.hour(ts).cast("bigint").alias("hour"),
    ]


def direction_parts(degrees: str, prefix: str = "wd") -> list[Column]:
    angle = F.radians(F.col(degrees).try_cast("double"))
    return [F.sin(angle).alias(f"{prefix}_sin"), F.cos(angle).alias(f"{prefix}_cos")]
