"""Work on long ordered series without putting a whole series into one task.

A series (station, variable) may hold a large share of all rows, so ordered windows never run over the series as a
whole. Rows carry ``pos``, their 0-based place in the series, and are grouped in blocks of 2 ** bits places. A window then
runs inside (series, block); what it needs from outside its block comes either from rows copied over the block edge
(``overlap_blocks``) or from one summary row per block (``carry_known``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12
SERIES = ("station", "variable")


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, in a session that runs in UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_us(us: Column) -> Column:
    """Wall-clock timestamp from microseconds since 1970."""
    return F.timestamp_micros(us.cast("bigint")).cast("timestamp_ntz")


def whole_div(a: Column, b: int) -> Column:
    """Floor division on integers, also for negative numbers."""
    whole = F.lit(b).cast("bigint")
    return F.call_function("div", a - F.pmod(a, whole), whole)


def floor_ts(ts: Column | str, step_s: int, origin_s: int = 0) -> Column:
    """Round a timestamp down to a multiple of ``step_s`` counted from ``origin_s``."""
    step, origin = step_s * 1_000_000, origin_s * 1_000_000
    us = epoch_us(ts)
    return from_us(us - F.pmod(us - F.lit(origin).cast("bigint"), F.lit(step).cast("bigint")))


def block_of(pos: Column | str, bits: int = BLOCK_BITS) -> Column:
    """Block of a place; a shift, so it is never null where the place is not."""
    return F.shiftright(F.col(pos) if isinstance(pos, str) else pos, bits)


def overlap_blocks(
    df: DataFrame, before: int = 0, after: int = 0, pos: str = "pos", bits: int = BLOCK_BITS
) -> tuple[DataFrame, Column]:
    """Add ``_blk`` and copy edge rows into the neighbouring blocks.

    Every block sees the last ``before`` places of the previous block and the first ``after`` places of the next one;
    blocks grow where the reach is longer than a block. Returns the frame and the condition that keeps each row only
    in its own block.
    """
    bits = max(bits, (max(before, after, 1) - 1).bit_length())
    size = 1 << bits
    blk, place = block_of(pos, bits), F.col(pos).bitwiseAND(F.lit(size - 1).cast("bigint"))
    homes = [blk]
    if before:
        homes.append(F.when(place >= size - before, blk + 1))
    if after:
        homes.append(F.when(place < after, blk - 1))
    copied = df.withColumn("_blk", F.explode(F.array_compact(F.array(*homes)))) if len(homes) > 1 else df.withColumn("_blk", blk)
    return copied, F.col("_blk") == block_of(pos, bits)


def block_window(keys: Sequence[str], pos: str = "pos"):
    return Window.partitionBy(*keys, "_blk").orderBy(pos)


def number_rows(df: DataFrame, keys: Sequence[str], ts: str = "ts", bucket_s: int = 86_400, pos: str = "pos") -> DataFrame:
    """Exact 0-based ``pos`` and series length ``n_pos`` for rows unique in (keys, ts).

    Rows are numbered inside time buckets; the running total of the bucket counts, a table with one row per bucket,
    gives the start of each bucket. ``df`` is read twice, so derived frames are best staged first.
    """
    rows = df.withColumn("_bucket", whole_div(epoch_us(ts), bucket_s * 1_000_000))
    per_bucket = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        (F.sum("_in_bucket").over(ordered) - F.col("_in_bucket")).alias("_start"),
        F.sum("_in_bucket").over(Window.partitionBy(*keys)).alias("n_pos"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    return (
        rows.join(offsets, [*keys, "_bucket"])
        .withColumn(pos, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


def carry_known(df: DataFrame, keys: Sequence[str], value: str = "value", pos: str = "pos") -> DataFrame:
    """Nearest known (pos, value) before and after each block, from one summary row per (keys, ``_blk``)."""
    known_pos = F.when(F.col(value).isNotNull(), F.col(pos))
    edges = df.groupBy(*keys, "_blk").agg(
        F.min(known_pos).alias("_first_pos"),
        F.min_by(value, known_pos).alias("_first_val"),
        F.max(known_pos).alias("_last_pos"),
        F.max_by(value, known_pos).alias("_last_val"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # Descending order keeps the look-ahead a growing frame, which is linear in the number of blocks.
    later = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(
        *keys,
        "_blk",
        F.last("_last_pos", True).over(earlier).alias("_carry_prev_pos"),
        F.last("_last_val", True).over(earlier).alias("_carry_prev_val"),
        F.last("_first_pos", True).over(later).alias("_carry_next_pos"),
        F.last("_first_val", True).over(later).alias("_carry_next_val"),
    )
