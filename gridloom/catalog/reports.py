"""Metrics, routing, exploratory aggregates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import frames as fr
from gridloom.catalog.registry import CTES, R, keep, query
from gridloom.operators import explore as ex
from gridloom.operators import features as fe
from gridloom.operators import metrics as me
from gridloom.operators.prepare import known_counts
from gridloom.operators.sheets import sheet_to_long
from gridloom.session import scratch_path, stage_table
from gridloom.streaming import jobs

M = ("rmse", "mae", "r2")
MS = ", ".join(R(m, m) for m in M)


def value_preds(spark, sf, once=False):
    return fr.predictions_once(spark, sf, "value") if once else fr.predictions(spark, sf, "value")


@query("metrics_basic", f"""SELECT model, {R('sqrt(avg((y_true - y_pred) ** 2))', 'rmse')}, {R('avg(abs(y_true - y_pred))', 'mae')},
  {R('CASE WHEN max(y_true) > min(y_true) THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END', 'r2')}, count(*) AS n_rows
FROM preds GROUP BY model""")
def metrics_basic(spark, sf):
    return keep(me.metrics(fr.predictions(spark, sf)), "model", "n_rows", rnd=M)


@query("metrics_by_station", f"""SELECT model, station, n_rows, {MS} FROM metric_rows
WHERE split = 'test' AND target = 'value'""")
def metrics_by_station(spark, sf):
    preds = value_preds(spark, sf).where("split = 'test'")
    return keep(me.metrics_table(preds), "model", "station", "n_rows", rnd=M)


@query("metrics_by_target", f"""SELECT target, model, station, n_rows, {MS} FROM metric_rows
WHERE split = 'test'""")
def metrics_by_target(spark, sf):
    preds = fr.predictions(spark, sf).where("split = 'test'")
    return keep(me.metrics_table(preds, ["target", "model"]), "target", "model", "station", "n_rows", rnd=M)


@query("metrics_by_split", f"SELECT split, model, station, n_rows, {MS} FROM metric_rows WHERE target = 'value'")
def metrics_by_split(spark, sf):
    return keep(me.metrics_table(value_preds(spark, sf), ["split", "model"]), "split", "model", "station", "n_rows", rnd=M)


@query("align_predictions", f"""SELECT split, station, ts, {R('y_true', 'y_true')}, {R('a', 'pred_persist1')}, {R('b', 'pred_persist4')}, {R('c', 'pred_mean4')}
FROM basis WHERE target = 'value' AND y_true IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def align_predictions(spark, sf):
    wide = me.align_predictions(value_preds(spark, sf), fr.MODELS)
    return keep(wide, "split", "station", "ts", rnd=("y_true", *[f"pred_{m}" for m in fr.MODELS]))


def _routing(preds, keys=("station",), default=None):
    val = me.metrics(preds.where("split = 'val'"), [*keys, "model"])
    return me.route_models(val, fr.MODELS, keys, default)


@query("route_station", f"SELECT station, model, {R('val_rmse', 'val_rmse')} FROM val_best WHERE target = 'value'")
def route_station(spark, sf):
    return keep(_routing(value_preds(spark, sf)), "station", "model", rnd=("val_rmse",))


@query("route_station_target", f"SELECT station, target, model, {R('val_rmse', 'val_rmse')} FROM val_best")
def route_station_target(spark, sf):
    preds, keys = fr.predictions_once(spark, sf), ("station", "target")
    val = me.metrics(preds.where("split = 'val'"), [*keys, "model"])
    routing = me.route_models(val, fr.MODELS, keys, "persist1", preds)
    return keep(routing, "station", "target", "model", rnd=("val_rmse",))


def routed(spark, sf):
    preds = fr.predictions_once(spark, sf)
    keys = ("station", "target")
    return me.apply_routing(preds, _routing(preds, keys, "persist1"), "persist1", keys)


@query("routed_predictions", f"SELECT split, station, ts, target, used_model, {R('y_true', 'y_true')}, {R('y_pred', 'y_pred')} FROM routed")
def routed_predictions(spark, sf):
    return keep(routed(spark, sf), "split", "station", "ts", "target", "used_model", rnd=("y_true", "y_pred"))


@query("best_tree", f"""SELECT model, {R('rmse', 'rmse')} FROM metric_rows WHERE split = 'test' AND target = 'value' AND station = 'ALL'
AND model IN ('persist4', 'mean4') ORDER BY rmse LIMIT 1""")
def best_tree(spark, sf):
    table = me.metrics_table(value_preds(spark, sf).where("split = 'test'"))
    return keep(me.best_of(table, ["persist4", "mean4"], "mean4"), "model", rnd=("rmse",))


@query("best_by_r2", f"""SELECT model, {R('avg(r2)', 'mean_r2')} FROM metric_rows WHERE split = 'test' AND target = 'value' AND station <> 'ALL' GROUP BY 1""")
def best_by_r2(spark, sf):
    table = me.metrics_table(fr.predictions(spark, sf).where("split = 'test'"), ["target", "model"])
    return keep(me.rank_by_r2(table, "value"), "model", rnd=("mean_r2",))


CTES["routed_metrics"] = """
SELECT split, target, station, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae,
  CASE WHEN max(y_true) > min(y_true) THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END AS r2, count(*) AS n_rows
FROM (SELECT split, target, station, y_true, y_pred FROM routed
      UNION ALL SELECT split, target, 'ALL', y_true, y_pred FROM routed) GROUP BY 1, 2, 3"""


@query("routed_report", f"SELECT target, station, n_rows, {MS} FROM routed_metrics WHERE split = 'test'")
def routed_report(spark, sf):
    test = routed(spark, sf).where("split = 'test'")
    return keep(me.metrics_table(test, ["target"]), "target", "station", "n_rows", rnd=M)


@query("routing_summary", f"""SELECT v.station, v.model, {R('v.rmse', 'val_rmse')}, v.model = b.model AS chosen, {R('t.rmse', 'test_rmse')}
FROM metric_rows v JOIN val_best b ON b.station = v.station AND b.target = v.target
LEFT JOIN metric_rows t ON t.station = v.station AND t.model = v.model AND t.target = v.target AND t.split = 'test'
WHERE v.split = 'val' AND v.target = 'value' AND v.station <> 'ALL'""")
def routing_summary(spark, sf):
    table = stage_table(me.metrics(value_preds(spark, sf), ["split", "station", "model"]), "metrics")
    val, test = table.where("split = 'val'"), table.where("split = 'test'")
    out = me.routing_summary(val, test, me.route_models(val, fr.MODELS))
    return keep(out, "station", "model", "chosen", rnd=("val_rmse", "test_rmse"))


# Exploratory aggregates

CTES["target_rows"] = "SELECT * FROM filled WHERE variable = 'value'"
CTES["order_values"] = "SELECT station, year(ts) AS year, value FROM orders_daily"


def target_rows(spark, sf):
    return fr.filled(spark, sf, "value")


def _dist_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, n_rows, {', '.join(R(c, c, 3) for c in ('q1', 'median', 'q3', 'whisker_low', 'whisker_high', 'mean', 'std'))} FROM (
  SELECT {keys}, count(value) AS n_rows, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
    min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low,
    max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high, avg(value) AS mean, stddev_samp(value) AS std
  FROM {source} JOIN (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
                    FROM {source} GROUP BY {keys}) USING ({keys}) WHERE value IS NOT NULL GROUP BY {keys})"""


_DIST = ("q1", "median", "q3", "whisker_low", "whisker_high", "mean", "std")


@query("split_counts", "SELECT split, station, count(*) AS n_rows FROM target_rows GROUP BY 1, 2")
def split_counts(spark, sf):
    return ex.split_counts(fr.split_grid(spark, sf).where("variable = 'value'"))


@query("dist_summary", _dist_sql("station", "target_rows"))
def dist_summary(spark, sf):
    return keep(ex.distribution(fr.filled_once(spark, sf, "value")), "station", "n_rows", rnd=_DIST, digits=3)


@query("density_bins", """SELECT station, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 41 ELSE floor(value / 200 * 40) + 1 END AS BIGINT) AS bin,
  count(*) AS n_rows FROM readings WHERE variable = 'value' AND value IS NOT NULL GROUP BY 1, 2""")
def density_bins(spark, sf):
    return ex.density_bins(fr.readings(spark, sf).where("variable = 'value'"), 0.0, 200.0, 40)


@query("by_year", _dist_sql("station, year", "order_values").replace("SELECT station, year, n_rows", "SELECT station, CAST(year AS BIGINT) AS year, n_rows"))
def by_year(spark, sf):
    rows = fr.orders_daily(spark, sf).withColumn("year", F.year("ts").cast("bigint"))
    return keep(ex.distribution(rows, ("station", "year")), "station", "year", "n_rows", rnd=_DIST, digits=3)


@query("diurnal_matrix", "SELECT CAST(hour(ts) AS BIGINT) AS hour, " + ", ".join(
    R(f"avg(CASE WHEN station = '{s}' THEN value END)", s) for s in fr.EVENT_TYPES) + " FROM readings WHERE variable = 'value' GROUP BY 1")
def diurnal_matrix(spark, sf):
    rows = fr.readings(spark, sf).where("variable = 'value'").withColumn("hour", F.hour("ts").cast("bigint"))
    return keep(ex.station_matrix(rows, "hour", fr.EVENT_TYPES), "hour", rnd=fr.EVENT_TYPES)


@query("weekly_pattern", f"SELECT CAST(isodow(ts) - 1 AS BIGINT) AS weekday, station, {R('avg(value)', 'mean')} FROM readings WHERE variable = 'value' GROUP BY 1, 2")
def weekly_pattern(spark, sf):
    rows = fr.readings(spark, sf).where("variable = 'value'").withColumn("weekday", F.weekday("ts").cast("bigint"))
    return keep(ex.mean_by(rows, ["weekday", "station"]), "weekday", "station", rnd=("mean",))


@query("monthly_pattern", f"SELECT CAST(month(ts) AS BIGINT) AS month, station, {R('avg(value)', 'mean', 3)} FROM orders_daily GROUP BY 1, 2")
def monthly_pattern(spark, sf):
    rows = fr.orders_daily(spark, sf).withColumn("month", F.month("ts").cast("bigint"))
    return keep(ex.mean_by(rows, ["month", "station"]), "month", "station", rnd=("mean",), digits=3)


@query("level_stats", f"""SELECT station, {R('avg(value)', 'mean')}, {R('median(value)', 'median')}, {R('quantile_cont(value, 0.9)', 'p90')}
FROM target_rows GROUP BY 1""")
def level_stats(spark, sf):
    return keep(ex.level_stats(fr.filled_once(spark, sf, "value")), "station", rnd=("mean", "median", "p90"))


_PAIRS = [(a, b) for i, a in enumerate(fr.LINE_VARIABLES) for b in fr.LINE_VARIABLES[: i + 1]]
CTES["line_wide"] = "SELECT station, ts, " + ", ".join(
    f"avg(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in fr.LINE_VARIABLES
) + " FROM line_weekly GROUP BY 1, 2"
CTES["line_corr"] = "SELECT station, unnest([" + ", ".join(
    f"struct_pack(var_a := '{a}', var_b := '{b}', r := corr({a}, {b}), n_pairs := count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END))" for a, b in _PAIRS
) + "], recursive := true) FROM line_wide GROUP BY station"
CTES["line_support"] = "SELECT station, var_a AS variable, n_pairs > 50 AS known, sum((n_pairs > 50)::INT) OVER (PARTITION BY station) AS n_known FROM line_corr WHERE var_a = var_b"


@query("corr_matrix", f"""SELECT station, var_a, var_b, {R('r', 'r')}, n_pairs,
  list_contains(known, var_a) AND list_contains(known, var_b) AND len(known) >= 3 AS supported FROM (
  SELECT *, list(var_a) FILTER (var_a = var_b AND n_pairs > 50) OVER (PARTITION BY station) AS known FROM line_corr)""")
def corr_matrix(spark, sf):
    out = ex.correlation_per_station(fr.line_weekly(spark, sf), fr.LINE_VARIABLES, min_values=50)
    return keep(out, "station", "var_a", "var_b", "n_pairs", "supported", rnd=("r",))


@query("corr_rank", f"""SELECT p.station, predictor, {R('r', 'r')}, n_pairs, a.known AND b.known AS supported,
  CASE WHEN a.known AND b.known THEN row_number() OVER (PARTITION BY p.station, a.known AND b.known ORDER BY r DESC NULLS LAST, predictor) END AS rank FROM (
  SELECT station, CASE WHEN var_a = 'extendedprice' THEN var_b ELSE var_a END AS predictor, r, n_pairs FROM line_corr
  WHERE (var_a = 'extendedprice' OR var_b = 'extendedprice') AND var_a <> var_b) p
JOIN line_support a ON a.station = p.station AND a.variable = 'extendedprice' JOIN line_support b ON b.station = p.station AND b.variable = predictor""")
def corr_rank(spark, sf):
    out = ex.predictor_ranking(fr.line_weekly(spark, sf), "extendedprice", fr.LINE_VARIABLES, min_values=50)
    return keep(out, "station", "predictor", "n_pairs", "supported", "rank", rnd=("r",))


CTES["synced"] = "SELECT ts, " + ", ".join(
    f"avg(CASE WHEN station = '{s}' THEN value END) AS {s}" for s in fr.EVENT_TYPES
) + " FROM target_rows GROUP BY 1"


@query("synchrony", " UNION ALL ".join(
    f"SELECT '{a}' AS station_a, '{b}' AS station_b, {R(f'corr({a}, {b})', 'r')}, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n_pairs FROM synced"
    for i, a in enumerate(fr.EVENT_TYPES) for b in fr.EVENT_TYPES[: i + 1]))
def synchrony(spark, sf):
    return keep(ex.synchrony(target_rows(spark, sf), fr.EVENT_TYPES), "station_a", "station_b", "n_pairs", rnd=("r",))


@query("metric_matrix", f"SELECT station, " + ", ".join(
    R(f"least(avg(CASE WHEN model = '{m}' THEN rmse END), 60.0)", m) for m in fr.MODELS)
    + " FROM metric_rows WHERE split = 'test' AND target = 'value' GROUP BY 1")
def metric_matrix(spark, sf):
    table = me.metrics_table(value_preds(spark, sf).where("split = 'test'"))
    return keep(ex.metric_matrix(table, "station", "model", fr.MODELS, clip=60.0), "station", rnd=fr.MODELS)


@query("metric_matrix_target", "SELECT target, " + ", ".join(R(f"avg(CASE WHEN model = '{m}' THEN r2 END)", m) for m in fr.MODELS)
    + " FROM metric_rows WHERE split = 'test' AND station = 'ALL' GROUP BY 1")
def metric_matrix_target(spark, sf):
    """Pooled R2 by target and model."""
    table = me.metrics_table(fr.predictions(spark, sf).where("split = 'test'"), ["target", "model"])
    return keep(ex.metric_matrix(table.where("pooled"), "target", "model", fr.MODELS, "r2"), "target", rnd=fr.MODELS)


_TARGETS = ("value", "k", "n")


@query("metric_matrix_station_target", "SELECT station, " + ", ".join(R(f"avg(CASE WHEN target = '{t}' THEN mae END)", t) for t in _TARGETS)
    + " FROM metric_rows WHERE split = 'test' AND model = 'mean4' GROUP BY 1")
def metric_matrix_station_target(spark, sf):
    """Mean absolute error of one model by station and target."""
    preds = fr.predictions(spark, sf).where("split = 'test' AND model = 'mean4'")
    table = me.metrics_table(preds, ["target"])
    return keep(ex.metric_matrix(table, "station", "target", _TARGETS, "mae"), "station", rnd=_TARGETS)


@query("first_days", f"""SELECT f.station, f.ts, {R('f.value', 'value')} FROM target_rows f
JOIN (SELECT station, min(ts) AS t0 FROM target_rows GROUP BY 1) m ON m.station = f.station WHERE f.ts < m.t0 + INTERVAL '7 days'""")
def first_days(spark, sf):
    return keep(ex.first_days(target_rows(spark, sf), 7), "station", "ts", rnd=("value",))


@query("metrics_union", f"""SELECT station, model, n_rows, {MS},
  CAST(CASE model WHEN 'persist1' THEN 1 WHEN 'persist4' THEN 2 WHEN 'mean4' THEN 3 ELSE 4 END AS BIGINT) AS model_place FROM (
  SELECT station, model, n_rows, rmse, mae, r2 FROM metric_rows WHERE split = 'test' AND target = 'value'
  UNION ALL SELECT station, 'routed', n_rows, rmse, mae, r2 FROM routed_metrics WHERE split = 'test' AND target = 'value')""")
def metrics_union(spark, sf):
    preds = value_preds(spark, sf, once=True)
    own = me.metrics_table(preds.where("split = 'test'"))
    chosen = me.metrics_table(me.apply_routing(preds, _routing(preds), "persist1").where("split = 'test'"))
    out = ex.metrics_union([own, chosen], [*fr.MODELS, "routed"])
    return keep(out, "station", "model", "n_rows", "model_place", rnd=M)


@query("scorecard", f"""SELECT b.station, b.model AS chosen, {R('b.val_rmse', 'val_rmse')}, {MS}, f.n_features, t.test_rows
FROM val_best b
LEFT JOIN routed_metrics m ON m.station = b.station AND m.target = b.target AND m.split = 'test'
LEFT JOIN (SELECT station, count(*) AS n_features FROM (SELECT station, variable FROM filled WHERE split = 'train' GROUP BY 1, 2 HAVING count(value) > 0) GROUP BY 1) f ON f.station = b.station
LEFT JOIN (SELECT station, count(*) AS test_rows FROM target_rows WHERE split = 'test' GROUP BY 1) t ON t.station = b.station
WHERE b.target = 'value'""")
def scorecard(spark, sf):
    """Filled rows are written once; predictions, features and counts all come from them."""
    rows = fr.filled_once(spark, sf)
    preds = stage_table(fr.baselines(rows.where("variable = 'value'")), "predictions")
    routing = _routing(preds)
    chosen = me.metrics_table(me.apply_routing(preds, routing, "persist1").where("split = 'test'"), ["model"])
    counts = ex.split_counts(rows.where("variable = 'value'"))
    out = ex.scorecard(routing, chosen.where("NOT pooled"), fe.base_columns(rows, "value"), counts)
    return keep(out, "station", "chosen", "n_features", "test_rows", rnd=("val_rmse", *M))


@query("split_summary", f"""SELECT split, count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, count(DISTINCT station) AS n_stations,
  count(*) - count(value) AS target_nulls, {R('min(value - 20)', 'target_min')}, {R('max(value - 20)', 'target_max')},
  count(CASE WHEN value - 20 < 0 THEN 1 END) AS target_negative, count(CASE WHEN value - 20 > 100 THEN 1 END) AS target_too_large
FROM target_rows GROUP BY 1""")
def split_summary(spark, sf):
    rows = target_rows(spark, sf).withColumn("value", F.col("value") - 20)
    out = ex.split_summary(rows, "value", too_large=100.0)
    plain = ("split", "n_rows", "n_columns", "n_stations", "target_nulls", "target_negative", "target_too_large")
    return keep(out, *plain, rnd=("target_min", "target_max"))


@query("schema_diff", """SELECT 'missing' AS kind, 'event_id' AS column_name, count(event_id) AS n_known FROM events
UNION ALL SELECT 'missing', 'event_type', count(event_type) FROM events UNION ALL SELECT 'missing', 'props', count(props) FROM events
UNION ALL SELECT 'missing', 'user_id', count(user_id) FROM events
UNION ALL SELECT 'extra', 'station', count(station) FROM readings UNION ALL SELECT 'extra', 'variable', count(variable) FROM readings""")
def schema_diff(spark, sf):
    """The event table against the readings made of it, and how many known values the differing columns hold."""
    left, right = fr.table(spark, sf, "events"), fr.readings(spark, sf)
    diff = ex.schema_diff(left, right)
    sides = (("missing", left, right.columns), ("extra", right, left.columns))
    counts = [
        known_counts(side, [c for c in side.columns if c not in other]).select(F.lit(kind).alias("kind"), F.col("feature").alias("column_name"), "n_known")
        for kind, side, other in sides
    ]
    return diff.join(counts[0].union(counts[1]), ["kind", "column_name"])


# Streams


@query("stream_ingest", "SELECT station, ts, variable, value FROM readings")
def stream_ingest(spark, sf):
    """Two runs over the same files; the second finds nothing new."""
    schema = fr.table(spark, sf, "events").schema
    out, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest_checkpoint")
    for _ in range(2):
        done = jobs.ingest_files(spark, f"{sf}/events*.parquet", schema, out, checkpoint, fr.to_readings)
    return done.select("station", "ts", "variable", "value")


@query("stream_sheets", "SELECT station, ts, variable, value, source_file, source_sheet FROM tidy")
def stream_sheets(spark, sf):
    """Sheets of two groups of books, arriving one after the other as dumps; a third run finds nothing new."""
    cells = fr.sheet_cells(spark, sf).withColumns({"book": F.col("source_file"), "sheet": F.col("source_sheet")})
    cells = stage_table(cells.withColumn("late", F.crc32("book") % 2 == 0), "arriving")
    root, out, checkpoint = (scratch_path(spark, n) for n in ("dumps", "sheets", "sheets_checkpoint"))

    def named(part):
        return F.url_decode(F.replace(F.regexp_extract("source_file", f"{part}=([^/]*)", 1), F.lit("+"), F.lit("%2B")))

    def tidy(rows):
        return sheet_to_long(rows.select(named("book").alias("source_file"), named("sheet").alias("source_sheet"), "row_idx", "cells"))

    for late in (False, True, None):
        if late is not None:
            lines = cells.where(F.col("late") == late).repartition("book", "sheet").sortWithinPartitions("book", "sheet", "row_idx")
            lines.select("book", "sheet", F.concat_ws("\t", "cells").alias("value")).write.mode("append").partitionBy("book", "sheet").text(root)
        done = jobs.ingest_sheets(spark, root, out, checkpoint, tidy)
    return done.select("station", "ts", "variable", "value", "source_file", "source_sheet")


@query("stream_grid", f"""SELECT station, variable, time_bucket(INTERVAL '15 minutes', ts) AS ts, {R('avg(value)', 'value')}, count(value) AS n_values FROM readings
GROUP BY 1, 2, 3
HAVING time_bucket(INTERVAL '15 minutes', min(ts)) + INTERVAL '15 minutes' <= (SELECT date_trunc('milliseconds', max(ts)) FROM readings) - INTERVAL '1 hour'""")
def stream_grid(spark, sf):
    schema = fr.table(spark, sf, "events").schema
    out, checkpoint = scratch_path(spark, "live"), scratch_path(spark, "live_checkpoint")
    for _ in range(2):
        done = jobs.live_grid(spark, f"{sf}/events*.parquet", schema, fr.to_readings, out, checkpoint)
    return keep(done, "station", "variable", "ts", "n_values", rnd=("value",))
