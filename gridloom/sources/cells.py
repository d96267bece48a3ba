"""Sheet dumps as cell tables, and listings of data files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from gridloom.plans.joins import join_params
from gridloom.session import stage_table


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = (".xls", ".xlsx", ".xlsm")) -> DataFrame:
    """Data files below ``root`` in path order, without lock files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    listed = files.select("path", name.alias("name"), F.col("length").alias("n_bytes"))
    return listed.where(ending.isin(*extensions) & ~F.startswith(name, F.lit("~$"))).orderBy("path")


def read_cells(spark: SparkSession, root: str, delimiter: str = "\t") -> DataFrame:
    """Delimited sheet dumps as source_file, source_sheet, row_idx, cells.

    Dumps lie at ``<root>/<book ...>/<sheet>.<ext>``.
    """
    return number_cells(dump_lines(spark.read, root), root, delimiter)


def dump_lines(reader: DataFrameReader | DataStreamReader, root: str) -> DataFrame:
    """Lines of all dumps with their file and the place of their block in it."""
    lines = reader.option("recursiveFileLookup", "true").text(root)
    return lines.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), "value")


def number_cells(lines: DataFrame, root: str, delimiter: str = "\t") -> DataFrame:
    """Cells of the lines of whole dumps.

    Large dumps are split over tasks: rows are numbered inside each file block and the block starts come from a table with
    one row per block. The numbered lines are written first, so that both see the same numbers.
    """
    lines = stage_table(lines.withColumn("_id", F.monotonically_increasing_id()), "dump-lines")
    blocks = lines.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_n")
    starts = blocks.select("_path", "_block", (before - F.col("_first")).alias("_shift"))
    path = _decoded(F.col("_path"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.regexp_replace(path, f"^.*?{_quoted(base)}/+", "")
    return join_params(lines, starts, ["_path", "_block"]).select(
        F.regexp_replace(inner, r"/[^/]*$", "").alias("source_file"),
        F.regexp_extract(inner, r"([^/]*?)(\.[^./]*)?$", 1).alias("source_sheet"),
        (F.col("_id") + F.col("_shift")).alias("row_idx"),
        F.split("value", _quoted(delimiter), -1).alias("cells"),
    )


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
