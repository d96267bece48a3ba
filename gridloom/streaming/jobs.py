"""Streaming jobs: incremental ingest of tables and of raw sheets with resume, and live grid means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.sheets import sheet_to_long
from gridloom.sources.cells import dump_lines, number_cells


def file_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> None:
    """Process everything that has arrived since the last run into a Parquet table, each file exactly once."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def ingest_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    out: str,
    checkpoint: str,
    tidy: Callable[[DataFrame], DataFrame] = lambda df: df,
    max_files: int | None = None,
) -> DataFrame:
    """Tidy new files into ``out``; a restart continues after the last finished file."""
    run_available(tidy(file_stream(spark, source, schema, max_files)), out, checkpoint)
    return spark.read.parquet(out)


def ingest_sheets(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    tidy: Callable[[DataFrame], DataFrame] = sheet_to_long,
    max_files: int | None = None,
) -> DataFrame:
    """Tidy readings of the sheet dumps that have arrived below ``root`` since the last run.

    A batch holds whole dumps; heading and width of each are found inside the batch. Its rows go to a folder of the batch's
    number, so a batch that is repeated after a failure replaces itself.
    """

    def write(lines: DataFrame, batch: int) -> None:
        tidy(number_cells(lines, root)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    writer = dump_lines(reader, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def grid_means(stream: DataFrame, step: str = "15 minutes", lateness: str = "1 hour", keys: tuple[str, ...] = ("station", "variable")) -> DataFrame:
    """Mean per series and step; rows later than the watermark are dropped. Gaps are not filled on a live stream."""
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    return (
        timed.groupBy(*keys, F.window("event_time", step).alias("w"))
        .agg(F.avg("value").alias("value"), F.count("value").alias("n_values"))
        .select(*keys, F.col("w.start").cast("timestamp_ntz").alias("ts"), "value", "n_values")
    )


def live_grid(
    spark: SparkSession,
    source: str,
    schema: StructType,
    readings: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    step: str = "15 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """Finished windows of all files that have arrived; windows the watermark has not passed stay open."""
    run_available(grid_means(readings(file_stream(spark, source, schema)), step, lateness), out, checkpoint)
    return spark.read.parquet(out)
