"""From header-less cell tables to tidy readings.

Cells: source_file, source_sheet, row_idx, cells (array of text). The header row, its unit row and the used width are
found per sheet; data rows then become long readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import HEADER_CELL, SHEET_NAME, clean_value, header_name, parse_timestamp, station_from_path
from gridloom.plans.joins import join_params

SHEET = ("source_file", "source_sheet")


def filter_sheets(sheets: DataFrame, pattern: str = SHEET_NAME) -> DataFrame:
    """Sheets whose name matches."""
    return sheets.where(F.col("source_sheet").rlike(pattern))


def _last_used(cells: str = "cells") -> Column:
    """0-based index of the last non-blank cell of a row, null for a blank row."""
    return F.array_max(F.transform(F.col(cells), lambda c, i: F.when(F.regexp_replace(c, r"\s+", "") != "", i)))


def _leading(cells: DataFrame, preview: int | None) -> DataFrame:
    return cells if preview is None else cells.where(F.col("row_idx") < preview)


def variable_rows(cells: DataFrame, preview: int | None = None, pattern: str = HEADER_CELL) -> DataFrame:
    """Per sheet the first row whose first cell is the time heading; null when there is none.

    ``preview`` looks at that many leading rows only; without it a heading is found wherever it stands.
    """
    is_header = F.get("cells", 0).rlike(pattern)
    return _leading(cells, preview).groupBy(*SHEET).agg(F.min(F.when(is_header, F.col("row_idx"))).cast("bigint").alias("var_row"))


def sheet_layout(cells: DataFrame, preview: int | None = None, pattern: str = HEADER_CELL) -> DataFrame:
    """Per sheet: header row, used width, variable names and the reason to skip it, if any.

    Two aggregates with map-side combine: the heading of each sheet, then the width of the rows down to it.
    """
    head = _leading(cells, preview)
    place = F.when(F.get("cells", 0).rlike(pattern), F.col("row_idx"))
    heading = head.groupBy(*SHEET).agg(F.min(place).cast("bigint").alias("var_row"), F.min_by("cells", place).alias("_names"))
    upto = join_params(head.select(*SHEET, "row_idx", _last_used().alias("_last")), heading.select(*SHEET, "var_row"), SHEET)
    widths = upto.where(F.col("row_idx") <= F.col("var_row")).groupBy(*SHEET).agg(F.max("_last").alias("_last"))
    found = heading.join(widths, list(SHEET), "left")
    width = F.when(F.col("var_row").isNotNull(), F.coalesce("_last", F.lit(0)) + 1).cast("bigint")
    raw = F.transform(
        F.slice("_names", F.lit(2), F.greatest(F.col("width") - 1, F.lit(0)).cast("int")),
        lambda c, i: header_name(c, i + 2),
    )
    reason = F.when(F.col("var_row").isNull(), "no variable row").when(F.col("width") < 2, "too few columns")
    return (
        found.withColumn("width", width)
        .withColumn("_raw", raw)
        .select(*SHEET, "var_row", "width", unique_names("_raw").alias("names"), reason.alias("skip_reason"))
    )


def unique_names(names: str) -> Column:
    """The n-th repeat of a name becomes ``name__n``."""
    listed = F.col(names)

    def numbered(name: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(listed, F.lit(1), i + 1), lambda other: other == name))
        return F.when(n > 1, F.concat(name, F.lit("__"), n.cast("string"))).otherwise(name)

    return F.transform(listed, numbered)


def active_width(cells: DataFrame, preview: int | None = None) -> DataFrame:
    return sheet_layout(cells, preview).select(*SHEET, "var_row", "width")


def header_names(cells: DataFrame, preview: int | None = None) -> DataFrame:
    """One row per (sheet, variable column) with its 1-based sheet column and unique name."""
    layout = sheet_layout(cells, preview).where(F.col("skip_reason").isNull())
    return layout.select(*SHEET, F.posexplode("names").alias("_i", "variable")).select(
        *SHEET, (F.col("_i") + 2).cast("bigint").alias("sheet_column"), "variable"
    )


def data_rows(cells: DataFrame, preview: int | None = None) -> DataFrame:
    """Rows below the unit row whose time parses, with the sheet's variable names."""
    layout = sheet_layout(cells, preview).where(F.col("skip_reason").isNull()).select(*SHEET, "var_row", "names")
    rows = join_params(cells, layout, SHEET).where(F.col("row_idx") >= F.col("var_row") + 2)
    # As a generated column the time is parsed once, not again in the filter.
    timed = rows.withColumn("ts", F.explode(F.array(parse_timestamp(F.get("cells", 0)))))
    return timed.where(F.col("ts").isNotNull())


def sheet_to_long(cells: DataFrame, preview: int | None = None, station: Column | None = None) -> DataFrame:
    """Tidy readings of every usable sheet, with their station and origin."""
    rows = data_rows(cells, preview)
    pairs = F.transform("names", lambda name, i: F.struct(name.alias("variable"), F.get("cells", i + 1).alias("cell")))
    long = rows.select(*SHEET, "ts", F.inline(pairs))
    return long.select(
        (station if station is not None else station_from_path("source_file")).alias("station"),
        "ts",
        "variable",
        clean_value("cell").alias("value"),
        *SHEET,
    )


def in_sheet_order(df: DataFrame, keys: Sequence[str] = ("station", "ts")) -> DataFrame:
    """Readings sorted by station and time inside each partition, as they are written."""
    return df.sortWithinPartitions(*keys)


def ingest_report(cells: DataFrame, preview: int | None = None) -> DataFrame:
    """Per sheet: station, rows with a time, columns of the tidy sheet, and why it was skipped."""
    layout = sheet_layout(cells, preview)
    counts = data_rows(cells, preview).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("_rows"))
    rows = F.coalesce("_rows", F.lit(0))
    used = F.col("skip_reason").isNull()
    return layout.join(counts, list(SHEET), "left").select(
        *SHEET,
        station_from_path("source_file").alias("station"),
        rows.alias("n_rows"),
        # Names, the time and three columns of origin.
        F.when(used, F.size("names") + 4).cast("bigint").alias("n_columns"),
        F.coalesce("skip_reason", F.when(rows == 0, F.lit("no data rows"))).alias("skip_reason"),
    )
