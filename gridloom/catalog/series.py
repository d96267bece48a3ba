"""Grids, splits, fills and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import frames as fr
from gridloom.catalog.registry import CTES, R, keep, query, rounded
from gridloom.functions.calendar import calendar_parts, cyclical_time
from gridloom.operators import features as fe
from gridloom.operators import grid as gr
from gridloom.operators import split as sp
from gridloom.plans import jobs


@query("dedupe_mean", f"SELECT station, ts, {R('avg(value)', 'value', 3)} FROM orders_daily GROUP BY 1, 2")
def dedupe_mean(spark, sf):
    return keep(gr.dedupe_mean(fr.orders_daily(spark, sf)), "station", "ts", rnd=("value",), digits=3)


@query("time_grid", f"SELECT station, variable, ts, pos, n_pos, {R('value', 'value')} FROM grid")
def time_grid(spark, sf):
    return keep(fr.grid(spark, sf), "station", "variable", "ts", "pos", "n_pos", rnd=("value",))


@query("resample_hourly", f"""SELECT station, variable, date_trunc('hour', ts) AS ts, {R('avg(value)', 'value')}
FROM readings GROUP BY 1, 2, 3""")
def resample_hourly(spark, sf):
    return keep(gr.resample(fr.readings(spark, sf), 3600), "station", "variable", "ts", rnd=("value",))


_DELTAS = """(SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {k} ORDER BY ts)) / 1000000.0 AS d FROM floored)"""
_NEAR = "avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d - {s}) <= 1e-8 + 1e-5 * {s} THEN 1.0 ELSE 0.0 END)"


@query("step_audit", f"""SELECT station, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
  count(DISTINCT source_sheet) AS n_sheets, {R(_NEAR.format(s=900.0), 'frac_15min')}, {R(_NEAR.format(s=3600.0), 'frac_60min')}
FROM {_DELTAS.format(k='station')} GROUP BY 1""")
def step_audit(spark, sf):
    out = gr.step_audit(fr.floored_events(spark, sf))
    return keep(out, "station", "n_rows", "first_ts", "last_ts", F.col("n_sheets").cast("bigint"), rnd=("frac_15min", "frac_60min"))


@query("step_topk", f"""SELECT station, minutes, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, minutes) AS rank FROM (
    SELECT station, CAST(round_even(d / 60.0, 0) AS BIGINT) AS minutes, count(*) AS n
    FROM {_DELTAS.format(k='station')} WHERE d IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 8""")
def step_topk(spark, sf):
    return gr.step_topk(fr.floored_events(spark, sf))


@query("sheet_audit", f"""SELECT station, source_sheet, n_rows, {R('frac_15', 'frac_15')}, {R('frac_60', 'frac_60')} FROM (
  SELECT station, source_sheet, count(*) AS n_rows, {_NEAR.format(s=900.0)} AS frac_15, {_NEAR.format(s=3600.0)} AS frac_60
  FROM {_DELTAS.format(k='station, source_sheet')} GROUP BY 1, 2)""")
def sheet_audit(spark, sf):
    out = gr.sheet_audit(fr.floored_events(spark, sf))
    return keep(out, "station", "source_sheet", "n_rows", rnd=("frac_15", "frac_60"))


@query("top_sheets", "SELECT source_sheet, count(*) AS n_rows FROM floored GROUP BY 1 ORDER BY n_rows DESC, source_sheet LIMIT 20")
def top_sheets(spark, sf):
    return gr.top_sheets(fr.floored_events(spark, sf))


@query("chrono_split", "SELECT station, variable, ts, pos, split FROM split_grid")
def chrono_split(spark, sf):
    return fr.split_grid(spark, sf).select("station", "variable", "ts", "pos", "split")


@query("gap_fill", f"SELECT station, variable, ts, split, {R('value', 'value')} FROM filled")
def gap_fill(spark, sf):
    return keep(fr.filled(spark, sf), "station", "variable", "ts", "split", rnd=("value",))


@query("target_cap", f"""SELECT f.station, f.variable, f.ts, f.split,
  {R('CASE WHEN c.cap > 0 THEN CASE WHEN f.value IS NULL THEN NULL ELSE greatest(0, least(f.value, c.cap)) END ELSE f.value END', 'value')}
FROM filled f LEFT JOIN (SELECT station, variable, quantile_cont(value, 0.95) AS cap FROM filled WHERE split = 'train' GROUP BY 1, 2) c
  ON c.station = f.station AND c.variable = f.variable""")
def target_cap(spark, sf):
    df = fr.filled_once(spark, sf)
    return keep(sp.apply_caps(df, sp.fit_caps(df, 0.95)), "station", "variable", "ts", "split", rnd=("value",))


@query("winsorize", f"""SELECT f.station, f.variable, f.ts,
  {R('CASE WHEN f.value IS NULL THEN NULL ELSE greatest(c.lo, least(f.value, c.hi)) END', 'value')}
FROM filled f JOIN (SELECT station, variable, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi
                    FROM filled WHERE split = 'train' GROUP BY 1, 2) c ON c.station = f.station AND c.variable = f.variable""")
def winsorize(spark, sf):
    return keep(sp.winsorize(fr.filled_once(spark, sf)), "station", "variable", "ts", rnd=("value",))


@query("require_nonnull", f"""SELECT station, variable, ts, {R('value', 'value')}, {R('lag_1', 'lag_1')}, {R('lag_96', 'lag_96')} FROM lagged
WHERE value IS NOT NULL AND lag_1 IS NOT NULL AND lag_4 IS NOT NULL AND lag_96 IS NOT NULL""")
def require_nonnull(spark, sf):
    rows = fe.lag_features(fr.filled(spark, sf))
    rows = sp.require_nonnull(rows, ["value", "lag_1", "lag_4", "lag_96"])
    return keep(rows, "station", "variable", "ts", rnd=("value", "lag_1", "lag_96"))


@query("median_impute", f"""SELECT f.station, f.variable, f.ts, f.split, {R('coalesce(f.value, m.m)', 'by_variable')}, {R('coalesce(f.value, s.m)', 'by_station')}
FROM filled f JOIN (SELECT variable, median(value) AS m FROM filled WHERE split = 'train' GROUP BY 1) m ON m.variable = f.variable
JOIN (SELECT station, variable, median(value) AS m FROM filled WHERE split = 'train' GROUP BY 1, 2) s
  ON s.station = f.station AND s.variable = f.variable""")
def median_impute(spark, sf):
    df = fr.filled_once(spark, sf)
    series = ["station", "variable"]
    one = sp.apply_medians(df.withColumn("raw", F.col("value")), sp.fit_medians(df)).withColumnsRenamed({"value": "by_variable", "raw": "value"})
    both = sp.apply_medians(one, sp.fit_medians(df, series), series).withColumnRenamed("value", "by_station")
    return keep(both, *series, "ts", "split", rnd=("by_variable", "by_station"))


@query("history_context", """SELECT station, variable, ts, 'val' AS context_for FROM split_grid
WHERE pos < floor(n_pos * CAST(0.70 AS DOUBLE)) AND pos >= floor(n_pos * CAST(0.70 AS DOUBLE)) - 97
UNION ALL SELECT station, variable, ts, 'test' FROM split_grid
WHERE pos < floor(n_pos * CAST(0.85 AS DOUBLE)) AND pos >= floor(n_pos * CAST(0.85 AS DOUBLE)) - 97""")
def history_context(spark, sf):
    return sp.history_context(fr.split_grid(spark, sf)).select("station", "variable", "ts", "context_for")


_TIME = f"""{R("sin(2 * pi() * hour(ts) / 24)", 'hour_sin')}, {R("cos(2 * pi() * hour(ts) / 24)", 'hour_cos')},
  {R("sin(2 * pi() * (isodow(ts) - 1) / 7)", 'dow_sin')}, {R("cos(2 * pi() * (isodow(ts) - 1) / 7)", 'dow_cos')},
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend"""


@query("temporal_features", f"SELECT event_id, {_TIME} FROM events")
def temporal_features(spark, sf):
    rows = fe.temporal_features(fr.table(spark, sf, "events", "event_id", "ts"))
    return keep(rows, "event_id", F.col("is_weekend").cast("int"), rnd=("hour_sin", "hour_cos", "dow_sin", "dow_cos"))


@query("calendar_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
  CAST(dayofyear(o_orderdate) AS BIGINT) AS day_of_year, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS weekday, CAST(hour(o_orderdate) AS BIGINT) AS hour FROM orders""")
def calendar(spark, sf):
    return fr.table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", *calendar_parts("o_orderdate"))


@query("direction_features", f"""SELECT event_id, {R('sin(radians((event_id * 37) % 360))', 'wd_sin')}, {R('cos(radians((event_id * 37) % 360))', 'wd_cos')} FROM events""")
def direction_features(spark, sf):
    rows = fr.table(spark, sf, "events", "event_id").withColumn("WD", (F.col("event_id") * 37) % 360)
    return keep(fe.direction_features(rows, "WD"), "event_id", rnd=("wd_sin", "wd_cos"))


@query("base_columns", """SELECT station, variable, count(value) AS n_known FROM filled WHERE split = 'train' GROUP BY 1, 2 HAVING count(value) > 0""")
def base_columns(spark, sf):
    return fe.base_columns(fr.filled_once(spark, sf), "value")


def _sql(columns, source):
    return "SELECT station, variable, ts, " + ", ".join(R(c, c) for c in columns) + f" FROM {source}"


_LAG = [f"lag_{k}" for k in fe.LAGS]
_MEAN = [f"rollmean_{w}" for w in fe.WINDOWS]
_STD = [f"rollstd_{w}" for w in fe.WINDOWS]


@query("lag_features", _sql(_LAG, "lagged"))
def lag_features(spark, sf):
    return keep(fe.lag_features(fr.filled(spark, sf)), "station", "variable", "ts", rnd=_LAG)


@query("rolling_mean", _sql(_MEAN, "rolled"))
def rolling_mean(spark, sf):
    return keep(fe.rolling_mean(fr.filled(spark, sf)), "station", "variable", "ts", rnd=_MEAN)


@query("rolling_std", _sql(_STD, "rolled_std"))
def rolling_std(spark, sf):
    return keep(fe.rolling_std(fr.filled(spark, sf)), "station", "variable", "ts", rnd=_STD)


_WIDE_VARIABLES = fr.MODEL_VARIABLES
_WIDE = [v if c == "value" else f"{v}_{c}" for v in _WIDE_VARIABLES for c in fr.FEATURE_COLUMNS]


def _wide_sql(select: str, where: str) -> str:
    cells = ", ".join(
        f"max(CASE WHEN variable = '{v}' THEN {c} END) AS {v if c == 'value' else f'{v}_{c}'}"
        for v in _WIDE_VARIABLES for c in fr.FEATURE_COLUMNS
    )
    return f"SELECT {select} FROM (SELECT station, ts, split, {cells} FROM feats GROUP BY 1, 2, 3) WHERE {where}"


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ["value", *[f"value_{c}" for c in _LAG]])


@query("feature_build", _wide_sql("station, ts, split, " + ", ".join(R(c, c) for c in _WIDE) + ", " + _TIME, _COMPLETE))
def feature_build(spark, sf):
    out = fe.build_features(fr.filled_once(spark, sf), "value", _WIDE_VARIABLES)
    rnd = (*_WIDE, "hour_sin", "hour_cos", "dow_sin", "dow_cos")
    return keep(out, "station", "ts", "split", F.col("is_weekend").cast("int"), rnd=rnd)


_JOB_VARIABLES = ("value", "k", "n", "wd_sin", "wd_cos")
_JOB = [v if c == "value" else f"{v}_{c}" for v in _JOB_VARIABLES for c in fr.FEATURE_COLUMNS]
_CLOCK = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend")
_TRAIN = "FILTER (WHERE split = 'train') OVER ()"
CTES["job_wide"] = f"""SELECT station, ts, split, {', '.join(f"max(CASE WHEN variable = '{v}' THEN {c} END) AS {v if c == 'value' else f'{v}_{c}'}" for v in _JOB_VARIABLES for c in fr.FEATURE_COLUMNS)}
FROM job_feats GROUP BY 1, 2, 3"""
CTES["job_complete"] = f"""SELECT *, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM job_wide WHERE {_COMPLETE}"""


@query("feature_job", f"""SELECT station, ts, split, {R('value', 'value')}, {', '.join(
    R(f"({c} - avg({c}) {_TRAIN}) / coalesce(nullif(stddev_samp({c}) {_TRAIN}, 0), 1)", c) for c in [*_JOB[1:], *_CLOCK])} FROM job_complete""")
def feature_job(spark, sf):
    """The whole way from raw readings with a direction to scaled features, with all variables, lags and windows."""
    out = jobs.feature_job(fr.weather_readings(spark, sf), "value", ["value", "k", "n", "WD"])
    return keep(out, "station", "ts", "split", rnd=(*_JOB, *_CLOCK))


@query("schema_stable", f"""SELECT station, ts, {R('k', 'k')}, CAST(NULL AS DOUBLE) AS absent, {R('value', 'value')}
FROM (SELECT station, ts, max(CASE WHEN variable = 'k' THEN value END) AS k, max(CASE WHEN variable = 'value' THEN value END) AS value FROM filled WHERE split = 'test' GROUP BY 1, 2)""")
def schema_stable(spark, sf):
    """The test rows brought to a schema with one column they lack and without one they have."""
    test = fr.filled_once(spark, sf).where("split = 'test'")
    wide = fe.widen_features(test, ["n", "value", "k"], ["value"], ["station", "ts"])
    stable = fe.stable_schema(wide, {"station": "string", "ts": "timestamp_ntz", "k": "double", "absent": "double", "value": "double"})
    return keep(stable, "station", "ts", "absent", rnd=("k", "value"))


@query("schema_record", """SELECT station, variable, kind, CAST(size AS BIGINT) AS size,
  CASE WHEN kind = 'base' THEN variable ELSE variable || '_' || kind || '_' || size END AS feature, variable = 'value' AS is_target
FROM (SELECT station, variable FROM filled WHERE split = 'train' GROUP BY 1, 2 HAVING count(value) > 0),
  (SELECT 'base' AS kind, 0 AS size UNION ALL SELECT 'lag', unnest([1, 2, 3, 4, 8, 12, 24, 48, 96])
   UNION ALL SELECT 'rollmean', unnest([4, 12, 24, 48, 96]))""")
def schema_record(spark, sf):
    return fe.schema_record(fe.base_columns(fr.filled_once(spark, sf), "value"), "value")
