"""Helpers shared by the operators: whole texts in bounded slices, size-checked joins, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.session import stage_table

#: Rows of a key table up to which a join may broadcast it: at most 32 MB of two longs, counted before each use.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python task handles at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the line and word definitions: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, computed once."""
    return stage_table(df, f"llm-{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def join_small(df: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a staged key table; broadcast only if its counted rows are few, else both sides are shuffled."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, on, how)


def slices(batch: pa.RecordBatch, text: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach ``most`` bytes, SLICE_BYTES by default, so that one slice and its results stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + (most or SLICE_BYTES), side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the machine: a Python worker outlives its task, and what it keeps is missing in the next step."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def over_texts(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, object]], schema: str | StructType, most: int | None = None) -> DataFrame:
    """Run ``work`` over slices of a frame with a ``text`` column; it returns the output columns of its rows."""
    types = _arrow(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=most):
                out = work(part)
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in types], schema=types)
        give_back()

    return df.mapInArrow(run, schema)


def _column(values, kind):
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


class Cached(dict):
    """Values of a pure function by key, at most ``most`` of them: when half are new, the half not asked for since goes."""

    def __init__(self, compute: Callable, most: int = 150_000):
        super().__init__()
        self.compute, self.half, self.before = compute, most // 2, {}

    def _turn(self) -> None:
        self.before = dict(self)
        self.clear()

    def add(self, items: Iterable[tuple], n: int) -> None:
        """``n`` values computed elsewhere."""
        if len(self) + n > self.half:
            self._turn()
        self.update(items)

    def __missing__(self, key):
        if len(self) >= self.half:
            self._turn()
        value = self.before.pop(key, None)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def hash64(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: rows (node, root) for every node of an edge; root is the smallest node.

    Alternates large-star and small-star steps. Minima are partial aggregates and neighbours are reached by joins, so no
    neighbourhood is gathered in one task; the driver sees a row count and a checksum per round. Null ends and loops
    link nothing; repeated edges count once.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stage(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while (mark := _mark(now)) != seen:
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.union(least).distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
