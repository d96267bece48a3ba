"""Joins against fitted-parameter tables, broadcast only by their measured size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridloom.session import stage_table


def join_params(df: DataFrame, params: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``df`` with a fitted table that is written to the shared folder first.

    The fit runs once, and the join sees the real size of its result: a table below Spark's broadcast threshold is
    broadcast, so ``df`` is not shuffled; a larger one is joined by a shuffle in which adaptive execution splits the
    partitions of hot keys.
    """
    return df.join(stage_table(params, "params"), list(on), how)
