"""Sources, sinks, raw sheets and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import frames as fr
from gridloom.catalog.registry import R, keep, query, rounded
from gridloom.functions.text import canonical_name, clean_value, parse_timestamp, station_from_path
from gridloom.operators import metrics as me
from gridloom.operators import naming as nm
from gridloom.operators import prepare as pr
from gridloom.operators import sheets as sh
from gridloom.session import scratch_path, stage_table
from gridloom.sources import cells as ce
from gridloom.sources import records as rec
from gridloom.sources import tables as tb


@query("scan_parquet", f"""SELECT event_type, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, {R('avg(value)', 'mean')}
FROM events GROUP BY 1""")
def scan_parquet(spark, sf):
    df = tb.load_table(spark, f"{sf}/events.parquet", time_columns=["ts"])
    out = df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("value").alias("mean")
    )
    return keep(out, "event_type", "n_rows", "first_ts", "last_ts", rnd=("mean",))


@query("scan_projected", "SELECT event_id, event_type, ts FROM events")
def scan_projected(spark, sf):
    return tb.load_table(spark, f"{sf}/events.parquet", ["event_id", "event_type", "ts"])


@query("file_listing")
def file_listing(spark, sf):
    return ce.list_files(spark, sf, (".parquet",)).select("name", "n_bytes")


@query("cell_table", """SELECT event_type AS book, count(*) AS n_rows, count(*) * 3 AS n_cells, count(DISTINCT source_sheet) AS n_sheets,
  true AS numbered FROM sheet_events GROUP BY 1""")
def cell_table(spark, sf):
    """Events written as tab-separated sheet dumps, read back as cells, and summed up per book."""
    rows = fr.sheet_events(spark, sf)
    line = F.concat_ws("\t", "time_text", "value_text", "k_text").alias("value")
    root = scratch_path(spark, "dumps")
    rows.select(F.col("event_type").alias("book"), F.col("source_sheet").alias("sheet"), line).write.partitionBy("book", "sheet").text(root)
    files = ce.read_cells(spark, root).groupBy("source_file", "source_sheet").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("cells")).alias("c"),
        ((F.min("row_idx") == 0) & (F.max("row_idx") + 1 == F.count_distinct("row_idx"))).alias("ok"),
    )
    return files.groupBy(F.regexp_extract("source_file", "book=([^/]*)", 1).alias("book")).agg(
        F.sum("n").alias("n_rows"), F.sum("c").alias("n_cells"), F.count_distinct("source_file").alias("n_sheets"), F.bool_and("ok").alias("numbered")
    )


_SHEETS = "SELECT DISTINCT event_type AS source_file, CAST(day(ts) AS BIGINT) AS sheet_pos, CASE WHEN day(ts) % 7 = 0 THEN 'notes ' || strftime(ts, '%d') ELSE strftime(ts, '%d') || CASE WHEN day(ts) % 5 = 0 THEN ' copy' ELSE '' END END AS source_sheet FROM events"


@query("sheet_filter", f"""SELECT source_file, sheet_pos, source_sheet FROM ({_SHEETS})
WHERE regexp_full_match(source_sheet, '[0-9]{{1,2}}')""")
def sheet_filter(spark, sf):
    day = F.date_format("ts", "dd")
    n = F.dayofmonth("ts").cast("bigint")
    name = F.when(n % 7 == 0, F.concat(F.lit("notes "), day)).when(n % 5 == 0, F.concat(day, F.lit(" copy"))).otherwise(day)
    listing = fr.table(spark, sf, "events", "event_type", "ts").select(
        F.col("event_type").alias("source_file"), n.alias("sheet_pos"), name.alias("source_sheet")
    )
    return sh.filter_sheets(listing.distinct())


_UNION = """SELECT event_type AS station, ts AS timestamp, 'a' AS source_file, value AS "A", CAST(NULL AS DOUBLE) AS "B" FROM events
WHERE event_type <> 'view'
UNION ALL SELECT event_type, ts, 'b', TRY_CAST(CASE WHEN event_id % 2 = 0 THEN 'off' ELSE CAST(value AS VARCHAR) END AS DOUBLE), CAST(user_id AS DOUBLE) FROM events
WHERE event_type = 'view'"""


def _chunks(spark, sf):
    """Two chunks of the events: the second has a column of its own and texts where the first has numbers."""
    ev = fr.table(spark, sf, "events", "event_id", "event_type", "ts", "value", "user_id")
    a = ev.where("event_type <> 'view'").select(
        F.col("value").alias("A"), F.col("ts").alias("timestamp"), F.col("event_type").alias("station"), F.lit("a").alias("source_file")
    )
    text = F.when(F.col("event_id") % 2 == 0, "off").otherwise(F.col("value").cast("string"))
    b = ev.where("event_type = 'view'").select(
        F.col("event_type").alias("station"), F.col("user_id").cast("double").alias("B"), text.alias("A"), F.col("ts").alias("timestamp"), F.lit("b").alias("source_file")
    )
    return a, b


@query("union_by_name", _UNION)
def union_by_name(spark, sf):
    return tb.union_chunks(_chunks(spark, sf))


@query("union_chunk_files", _UNION)
def union_chunk_files(spark, sf):
    """The chunks as files, one for each partition, day and chunk."""
    root = scratch_path(spark, "chunks")
    for name, chunk in zip("ab", _chunks(spark, sf)):
        chunk.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(f"{root}/{name}")
    return tb.union_files(spark, root)


@query("parquet_roundtrip", f"SELECT station, variable, count(*) AS n_rows, {R('avg(value)', 'mean')} FROM r15 GROUP BY 1, 2")
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "r15")
    tb.save_table(fr.r15(spark, sf), path, ["station"])
    back = tb.load_table(spark, path).groupBy("station", "variable")
    return keep(back.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean")), "station", "variable", "n_rows", rnd=("mean",))


@query("metrics_upsert", f"""SELECT station, model, {R('rmse', 'rmse')}, n_rows FROM metric_rows
WHERE target = 'value' AND ((split = 'val' AND model <> 'mean4') OR (split = 'test' AND model = 'mean4'))""")
def metrics_upsert(spark, sf):
    """Validation metrics at one path, in which one model's rows are replaced twice by its test metrics."""
    preds = fr.predictions(spark, sf, "value")
    table = stage_table(me.metrics_table(preds, ["split", "model"]), "metrics")
    path, columns = scratch_path(spark, "metrics"), ["station", "model", "rmse", "n_rows"]
    rec.upsert_in_place(table.where("split = 'val'").select(*columns), path)
    for _ in range(2):
        rec.upsert_in_place(table.where("split = 'test' AND model = 'mean4'").select(*columns), path)
    kept = rec.read_csv(spark, path, "station string, rmse double, n_rows bigint, model string")
    return keep(kept, "station", "model", "n_rows", rnd=("rmse",))


@query("require_columns", "SELECT event_type AS station, count(*) AS n_rows FROM events GROUP BY 1")
def require_columns(spark, sf):
    df = tb.require_columns(fr.readings(spark, sf), ["station", "ts", "variable", "value"])
    return df.where("variable = 'n'").groupBy("station").agg(F.count("value").alias("n_rows"))


@query("json_flatten", f"""SELECT station, metric, {R('value', 'value')} FROM (
  SELECT station, 'rmse' AS metric, rmse AS value FROM metric_rows WHERE split = 'test' AND target = 'value' AND model = 'mean4'
  UNION ALL SELECT station, 'mae', mae FROM metric_rows WHERE split = 'test' AND target = 'value' AND model = 'mean4')""")
def json_flatten(spark, sf):
    preds = fr.predictions(spark, sf, "value").where("model = 'mean4' AND split = 'test'")
    path = scratch_path(spark, "metrics_json")
    rec.write_nested_json(me.metrics_table(preds), "station", ["rmse", "mae"], path)
    return keep(rec.read_nested_json(spark, path), "station", "metric", rnd=("value",))


@query("params_roundtrip", f"""SELECT variable, {R('avg(value)', 'mean')}, {R('CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END', 'std')}
FROM filled WHERE split = 'train' GROUP BY 1""")
def params_roundtrip(spark, sf):
    path = scratch_path(spark, "scaler")
    fit = lambda: pr.fit_scaler(fr.filled(spark, sf))
    tb.fit_or_load(spark, path, fit)
    return keep(tb.fit_or_load(spark, path, fit), "variable", rnd=("mean", "std"))


# Raw sheets


@query("station_from_path", f"SELECT source_file, {fr.station_sql('source_file')} AS station, count(*) AS n_rows FROM sheet_events GROUP BY 1, 2")
def stations(spark, sf):
    rows = fr.sheet_events(spark, sf)
    return rows.groupBy("source_file", station_from_path("source_file").alias("station")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("variable_row", "SELECT source_file, source_sheet, CAST(coalesce(var_row, -1) AS BIGINT) AS var_row FROM var_rows")
def variable_row(spark, sf):
    """Header rows; -1 marks a sheet without one."""
    return sh.variable_rows(fr.sheet_cells(spark, sf)).fillna(-1, ["var_row"])


@query("active_width", """SELECT v.source_file, v.source_sheet, CAST(coalesce(v.var_row, -1) AS BIGINT) AS var_row, CAST(coalesce(w.width, 0) AS BIGINT) AS width
FROM var_rows v LEFT JOIN widths w ON w.source_file = v.source_file AND w.source_sheet = v.source_sheet""")
def active_width(spark, sf):
    return sh.active_width(fr.sheet_cells(spark, sf)).fillna({"var_row": -1, "width": 0})


@query("header_names", "SELECT source_file, source_sheet, CAST(i + 1 AS BIGINT) AS sheet_column, variable FROM named")
def header_names(spark, sf):
    return sh.header_names(fr.sheet_cells(spark, sf))


@query("sheet_to_long", "SELECT station, ts, variable, value, source_file, source_sheet FROM tidy")
def sheet_to_long(spark, sf):
    return sh.sheet_to_long(fr.sheet_cells(spark, sf))


@query("parse_timestamps", "SELECT t AS time_text, ts, count(*) AS n_rows FROM timed WHERE row_idx > 2 GROUP BY 1, 2")
def parse_timestamps(spark, sf):
    rows = fr.sheet_events(spark, sf).groupBy("time_text").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("time_text", parse_timestamp("time_text").alias("ts"), "n_rows")


@query("clean_values", f"SELECT event_id, {fr.clean_sql('value_text')} AS value, {fr.clean_sql('k_text')} AS k FROM sheet_events")
def clean_values(spark, sf):
    return fr.sheet_events(spark, sf).select("event_id", clean_value("value_text").alias("value"), clean_value("k_text").alias("k"))


@query("provenance", """SELECT station, source_file, source_sheet, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts
FROM tidy GROUP BY 1, 2, 3""")
def provenance(spark, sf):
    """First and last time by place in the written order, per partition: equal to the SQL's only where rows are in order."""
    tidy = sh.in_sheet_order(sh.sheet_to_long(fr.sheet_cells(spark, sf)))
    placed = tidy.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    keys = ["station", "source_file", "source_sheet"]
    ends = placed.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("ts", "place").alias("head"), F.max_by("ts", "place").alias("tail")
    )
    return ends.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.min("head").alias("first_ts"), F.max("tail").alias("last_ts"))


@query("ingest_report", f"""SELECT s.source_file, s.source_sheet, {fr.station_sql('s.source_file')} AS station,
  CAST(coalesce(d.n, 0) AS BIGINT) AS n_rows, CASE WHEN s.skip IS NULL THEN CAST(s.width + 3 AS BIGINT) ELSE 0 END AS n_columns,
  CASE WHEN s.skip IS NOT NULL THEN s.skip WHEN coalesce(d.n, 0) = 0 THEN 'no data rows' END AS skip_reason
FROM (SELECT v.source_file, v.source_sheet, w.width,
        CASE WHEN v.var_row IS NULL THEN 'no variable row' WHEN w.width < 2 THEN 'too few columns' END AS skip
      FROM var_rows v LEFT JOIN widths w ON w.source_file = v.source_file AND w.source_sheet = v.source_sheet) s
LEFT JOIN (SELECT t.source_file, t.source_sheet, count(*) AS n FROM timed t
           JOIN widths w ON w.source_file = t.source_file AND w.source_sheet = t.source_sheet
           WHERE w.width >= 2 AND t.row_idx >= w.var_row + 2 AND t.ts IS NOT NULL GROUP BY 1, 2) d
  ON d.source_file = s.source_file AND d.source_sheet = s.source_sheet""")
def ingest_report(spark, sf):
    return sh.ingest_report(fr.sheet_cells(spark, sf)).fillna(0, ["n_columns"])


# Names and types


@query("canonical_name", "SELECT event_id, station, variable, canonical FROM canon")
def canonical(spark, sf):
    rows = fr.named_readings(spark, sf)
    return rows.select("event_id", "station", "variable", canonical_name("variable", "station").alias("canonical"))


@query("densest_synonym", "SELECT station, canonical, variable, n_known FROM densest")
def densest_synonym(spark, sf):
    return nm.densest_synonyms(fr.named_readings(spark, sf))


@query("standardize", """SELECT n.event_id, n.station, n.ts, d.canonical AS variable, n.value
FROM named_readings n JOIN densest d ON d.station = n.station AND d.variable = n.variable""")
def standardize(spark, sf):
    return nm.standardize(fr.named_readings(spark, sf))


@query("melt", """SELECT l_orderkey, l_linenumber, 'quantity' AS variable, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem""")
def melt(spark, sf):
    line = fr.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    wide = line.withColumnsRenamed({"l_quantity": "quantity", "l_discount": "discount", "l_tax": "tax"})
    return nm.melt(wide, ["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"])


@query("pivot_wide", "SELECT station, ts, " + ", ".join(
    R(f"avg(CASE WHEN variable = '{v}' THEN value END)", v, 3) for v in fr.LINE_VARIABLES) + " FROM line_readings GROUP BY 1, 2")
def pivot_wide(spark, sf):
    wide = nm.pivot_wide(fr.line_readings(spark, sf), ["station", "ts"], fr.LINE_VARIABLES)
    return keep(wide, "station", "ts", rnd=fr.LINE_VARIABLES, digits=3)


@query("coerce_keys", """SELECT event_id, event_type AS station, ts FROM events
WHERE event_id % 17 <> 0 AND event_type <> 'view'""")
def coerce_keys(spark, sf):
    ev = fr.table(spark, sf, "events", "event_id", "event_type", "ts")
    text = F.when(F.col("event_id") % 17 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    rows = ev.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("station"), text.alias("ts"))
    return nm.coerce_keys(rows)


@query("coerce_numeric", """SELECT event_id, TRY_CAST(CASE WHEN event_id % 17 = 0 THEN 'Maint.' WHEN event_id % 19 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value
FROM events""")
def coerce_numeric(spark, sf):
    ev = fr.table(spark, sf, "events", "event_id", "value")
    text = F.when(F.col("event_id") % 17 == 0, "Maint.").when(F.col("event_id") % 19 == 0, "").otherwise(
        F.col("value").cast("string")
    )
    return nm.coerce_numeric(ev.select("event_id", text.alias("value")))


@query("drop_negatives", f"SELECT event_id, {R('CASE WHEN value - 20 >= 0 THEN value - 20 END', 'value')} FROM events")
def drop_negatives(spark, sf):
    ev = fr.table(spark, sf, "events", "event_id", "value").withColumn("value", F.col("value") - 20)
    return nm.drop_negatives(ev).select("event_id", rounded("value").alias("value"))
