"""Exact quantiles per group without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.joins import join_params

ACCURACY = 20_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str] | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, equal to sorting each group; one row per group, one column per quantile.

    A first pass brackets every quantile with ``percentile_approx``, whose rank error is at most n / accuracy. The
    second pass counts the values below each bracket and keeps only values inside, counted per distinct value, so the
    ordered window sees a few parts in ten thousand of a group. A rank more than one place outside its bracket is an error.
    """
    names = list(names or [f"q{int(round(q * 1000)):04d}" for q in qs])
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 3.0 / ACCURACY
    cuts = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-slack, slack)]
    rough = data.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", [float(c) for c in cuts], ACCURACY).alias("_cuts"),
    )
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                (F.lit(float(q)) * (F.col("_n") - 1)).alias("rank"),
                (F.col("_min") if cuts[2 * i] <= 0.0 else F.col("_cuts")[2 * i]).alias("lo"),
                (F.col("_max") if cuts[2 * i + 1] >= 1.0 else F.col("_cuts")[2 * i + 1]).alias("hi"),
            )
            for i, q in enumerate(qs)
        ]
    ).alias("_b")
    if keys:
        bracketed = join_params(data, rough.select(*keys, brackets), keys)
    else:  # one row of brackets, as literals
        fit = rough.first()
        bracketed = data.withColumns({c: F.lit(fit[c]) for c in rough.columns}).select("_v", brackets)
    hits = (
        bracketed.select(*keys, "_v", F.explode("_b").alias("b"))
        .select(
            *keys,
            F.col("b.i").alias("_i"),
            F.col("b.rank").alias("_rank"),
            F.when(F.col("_v") < F.col("b.lo"), F.lit("below"))
            .when(F.col("_v") <= F.col("b.hi"), F.lit("in"))
            .otherwise(F.lit("above"))
            .alias("_zone"),
            "_v",
        )
    )
    # Inside: one row per distinct value. Outside: a count and the nearest value, which a rank can touch by one place.
    counted = hits.groupBy(
        *keys, "_i", "_rank", "_zone", F.when(F.col("_zone") == "in", F.col("_v")).alias("_in")
    ).agg(
        F.count(F.lit(1)).alias("_c"),
        F.coalesce(F.max(F.when(F.col("_zone") == "below", F.col("_v"))), F.min("_v")).alias("_v"),
    )
    order = Window.partitionBy(*keys, "_i").orderBy(
        F.when(F.col("_zone") == "below", 0).when(F.col("_zone") == "in", 1).otherwise(2), "_in"
    )
    placed = counted.withColumn("_end", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )

    def value_of(place):
        below, above = F.col("_zone") == "below", F.col("_zone") == "above"
        deep = (below & (place < F.col("_end") - 1)) | (above & (place > F.col("_start")))
        value = F.when(deep, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(F.col("_v"))
        return F.max(F.when((F.col("_start") <= place) & (place < F.col("_end")), value))

    at = placed.groupBy(*keys, "_i", "_rank").agg(value_of(F.floor("_rank")).alias("_lo_v"), value_of(F.ceil("_rank")).alias("_hi_v"))
    value_at = F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * (F.col("_rank") - F.floor("_rank"))
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value_at)).alias(n) for i, n in enumerate(names)])
