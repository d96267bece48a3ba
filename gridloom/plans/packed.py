"""Sums of arrays by key: one packed row a task and key, merged in two levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed_sums(data: DataFrame, keys: Sequence[str], names: Sequence[str], moments: Callable[[np.ndarray], np.ndarray], held: int = 64, salts: int = 16) -> DataFrame:
    """(keys, sums): ``moments`` of the columns ``names``, as doubles, added up over the rows of each key and packed.

    Every task adds up its own rows, batch by batch, and gives out one row a key; these are added up in two levels, the
    first spread over ``salts`` tasks a key. A task holds ``held`` arrays at most, however many rows a key has; keys that
    are given out early may come in several rows, to be added up by the reader (``added``).
    """
    key_names, columns = list(keys), list(names)

    def keyed(key) -> tuple:
        return tuple(None if pd.isna(k) else k for k in key)

    def frame(sums: dict[tuple, np.ndarray]) -> pd.DataFrame:
        cells = {k: pd.Series([key[i] for key in sums], dtype=object) for i, k in enumerate(key_names)}
        return pd.DataFrame({**cells, "sums": pd.Series([s.tobytes() for s in sums.values()], dtype=object)})

    def summed(parts: Iterator[tuple[tuple, np.ndarray]]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for key, part in parts:
            sums[key] = sums[key] + part if key in sums else part
            if len(sums) > held:
                yield frame(sums)
                sums.clear()
        yield frame(sums)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for batch in batches:
                for key, part in batch.groupby(key_names, sort=False, dropna=False):
                    yield keyed(key), moments(part[columns].to_numpy(dtype=float))

        return summed(parts())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return summed((keyed(row[:-1]), np.frombuffer(row[-1])) for batch in batches for row in batch[[*key_names, "sums"]].itertuples(index=False, name=None))

    schema = ", ".join([*(f"{k} string" for k in key_names), "sums binary"])
    rows = data.select(*[F.col(k).cast("string").alias(k) for k in key_names], *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    salted = rows.mapInPandas(partial, schema).withColumn("_salt", F.spark_partition_id() % salts)
    return salted.repartition(*key_names, "_salt").mapInPandas(merge, schema).repartition(*key_names).mapInPandas(merge, schema)


def added(rows: Sequence[bytes]) -> np.ndarray:
    """Packed arrays of one key, added up."""
    return sum((np.frombuffer(bytes(r)) for r in rows[1:]), np.frombuffer(bytes(rows[0])).copy())
