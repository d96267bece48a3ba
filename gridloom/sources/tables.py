"""Parquet tables, chunk unions, fitted parameters and saved models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEADING = ("station", "timestamp", "source_file", "source_sheet")


def load_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, time_columns: Sequence[str] = (), merge: bool = False
) -> DataFrame:
    """Parquet scan of the named columns; unreadable times become null and a missing path is named in the error."""
    try:
        df = spark.read.option("mergeSchema", str(merge).lower()).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no Parquet table at {path}") from e
        raise
    if columns is not None:
        df = df.select(*columns)
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in time_columns}) if time_columns else df


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def union_chunks(chunks: Sequence[DataFrame], leading: Sequence[str] = LEADING) -> DataFrame:
    """All chunks under one schema: the first type of a column wins, missing columns are null, origin columns lead."""
    types: dict[str, str] = {}
    for chunk in chunks:
        for field in chunk.schema.fields:
            types.setdefault(field.name, field.dataType.simpleString())
    names = [c for c in leading if c in types] + sorted(c for c in types if c not in leading)

    def shaped(chunk: DataFrame) -> DataFrame:
        have = set(chunk.columns)
        return chunk.select(
            *[(F.col(f"`{c}`").try_cast(types[c]) if c in have else F.lit(None).cast(types[c])).alias(c) for c in names]
        )

    out = shaped(chunks[0])
    for chunk in chunks[1:]:
        out = out.unionByName(shaped(chunk))
    return out


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path and columns of each Parquet file, read from its footer."""
    for batch in batches:
        found = []
        for content in batch.column("content"):
            footer = pq.ParquetFile(pa.BufferReader(content.as_buffer())).schema
            leaves = (footer.column(i) for i in range(len(footer.names)))
            found.append("\n".join(f"{c.path} {c.physical_type} {c.logical_type} {c.max_repetition_level}" for c in leaves))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "layout"])


def union_files(spark: SparkSession, root: str, leading: Sequence[str] = LEADING) -> DataFrame:
    """All Parquet files below ``root`` under one schema, as ``union_chunks`` in the order of their paths.

    Files whose types agree are one scan, however many there are. Otherwise one job reads the footers, and the plan has one
    scan for each different layout.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        return union_chunks([reader.option("mergeSchema", "true").parquet(root)], leading)
    except (PySparkException, Py4JJavaError) as e:  # Spark hands this failure on unconverted
        if not any(name in str(e) for name in ("CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE")):
            raise
    files = reader.format("binaryFile").load(root).select("path", "content")
    groups: dict[str, list[str]] = {}
    for path, layout in sorted(map(tuple, files.mapInArrow(_layouts, "path string, layout string").collect())):  # one short row a file
        groups.setdefault(layout, []).append(path)
    return union_chunks([spark.read.parquet(*paths) for paths in groups.values()], leading)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns in order."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def fit_or_load(spark: SparkSession, path: str, fit: Callable[[], DataFrame]) -> DataFrame:
    """Fitted parameters kept at ``path``: read when present, else fitted and saved."""
    try:
        return load_table(spark, path)
    except FileNotFoundError:
        save_table(fit(), path)
        return load_table(spark, path)


def save_model(model: PipelineModel, path: str, features: Sequence[str], target: str) -> None:
    """A fitted pipeline together with its ordered feature list and target."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    meta = spark.createDataFrame([(list(features), target)], "features array<string>, target string")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(path: str) -> tuple[PipelineModel, list[str], str]:
    spark = SparkSession.active()
    meta = load_table(spark, f"{path}/meta").first()
    return PipelineModel.load(f"{path}/model"), list(meta["features"]), meta["target"]
