"""Views of the given tables as sensor data, once as DataFrames and once as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.registry import CTES
from gridloom.operators import features as fe
from gridloom.operators import grid as gr
from gridloom.operators import split as sp
from gridloom.plans.series import epoch_us, whole_div
from gridloom.session import stage_table
from gridloom.sources.tables import load_table

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
LINE_VARIABLES = ("quantity", "extendedprice", "discount", "tax")
MODELS = ("persist1", "persist4", "mean4")
WEEK_S = 604_800
# Monday 2000-01-03, the first day that week buckets are counted from.
MONDAY_S = 946_857_600


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return load_table(spark, f"{sf}/{name}.parquet", columns or None)


def parsed_k(props: str = "props"):
    return F.regexp_extract(props, '"k": *(-?[0-9]+)', 1).try_cast("double")


def to_readings(events: DataFrame) -> DataFrame:
    """Three variables per event: its value, the number in its properties and a constant."""
    cells = F.array(
        F.struct(F.lit("value").alias("variable"), F.col("value").alias("value")),
        F.struct(F.lit("k").alias("variable"), parsed_k().alias("value")),
        F.struct(F.lit("n").alias("variable"), F.lit(1.0).alias("value")),
    )
    return events.select(F.col("event_type").alias("station"), "ts", F.inline(cells))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return to_readings(table(spark, sf, "events", "event_type", "ts", "value", "props"))


CTES["readings"] = """
SELECT event_type AS station, ts, 'value' AS variable, value FROM events
UNION ALL
SELECT event_type, ts, 'k', TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) FROM events
UNION ALL
SELECT event_type, ts, 'n', CAST(1 AS DOUBLE) FROM events"""


def weather_readings(spark: SparkSession, sf: str) -> DataFrame:
    """The readings and a direction in degrees."""
    events = table(spark, sf, "events", "event_type", "ts", "event_id")
    angle = ((F.col("event_id") * 37) % 360).cast("double")
    return readings(spark, sf).union(events.select(F.col("event_type"), "ts", F.lit("WD"), angle))


def r15(spark: SparkSession, sf: str) -> DataFrame:
    return gr.resample(readings(spark, sf), gr.STEP_S)


CTES["r15"] = """
SELECT station, variable, time_bucket(INTERVAL '15 minutes', ts) AS ts, avg(value) AS value
FROM readings GROUP BY 1, 2, 3"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return gr.grid_means(readings(spark, sf))


CTES["bounds"] = """
SELECT station, min(ts) AS t0, (epoch_us(max(ts)) - epoch_us(min(ts))) // 900000000 + 1 AS n_pos
FROM r15 GROUP BY 1"""
CTES["places"] = """
SELECT s.station, s.variable, b.t0, b.n_pos, unnest(range(b.n_pos)) AS pos
FROM (SELECT DISTINCT station, variable FROM r15) s JOIN bounds b ON b.station = s.station"""
CTES["grid"] = """
SELECT p.station, p.variable, p.ts, p.pos, p.n_pos, r.value
FROM (SELECT *, t0 + to_minutes(pos * 15) AS ts FROM places) p
LEFT JOIN r15 r ON r.station = p.station AND r.variable = p.variable AND r.ts = p.ts"""


def split_grid(spark: SparkSession, sf: str) -> DataFrame:
    return sp.chrono_split(grid(spark, sf))


CTES["split_grid"] = """
SELECT *, CASE WHEN pos < floor(n_pos * CAST(0.70 AS DOUBLE)) THEN 'train'
               WHEN pos < floor(n_pos * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM grid"""


def filled(spark: SparkSession, sf: str, *variables: str) -> DataFrame:
    """Filled rows of the named variables, or of all; chosen before the fill so that both of its readers agree."""
    rows = split_grid(spark, sf)
    return sp.fill_gaps(rows.where(F.col("variable").isin(*variables)) if variables else rows)


def filled_once(spark: SparkSession, sf: str, *variables: str) -> DataFrame:
    """The filled rows written once, for queries that read them in several passes."""
    return stage_table(filled(spark, sf, *variables), "filled")


CTES["known"] = """
SELECT *,
  max(CASE WHEN value IS NOT NULL THEN pos END) OVER b AS p0, last_value(value IGNORE NULLS) OVER b AS v0,
  min(CASE WHEN value IS NOT NULL THEN pos END) OVER a AS p1, first_value(value IGNORE NULLS) OVER a AS v1
FROM split_grid
WINDOW b AS (PARTITION BY station, variable, split ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       a AS (PARTITION BY station, variable, split ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
CTES["filled"] = """
SELECT station, variable, ts, pos, n_pos, split,
  CASE WHEN value IS NOT NULL THEN value
       WHEN pos - p0 <= 4 AND p1 > p0 THEN v0 + (v1 - v0) * (CAST(pos - p0 AS DOUBLE) / (p1 - p0)) END AS value
FROM known"""

_lags = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in fe.LAGS)


def _rolled(stat: str, label: str) -> str:
    return ", ".join(
        f"CASE WHEN count(value) OVER w{n} = {n} THEN {stat}(value) OVER w{n} END AS {label}_{n}" for n in fe.WINDOWS
    )


_frames = ", ".join(
    f"w{n} AS (PARTITION BY station, variable ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in fe.WINDOWS
)
_series = "w AS (PARTITION BY station, variable ORDER BY pos)"
CTES["lagged"] = f"SELECT *, {_lags} FROM filled WINDOW {_series}"
CTES["rolled"] = f"SELECT *, {_rolled('avg', 'rollmean')} FROM filled WINDOW {_frames}"
CTES["rolled_std"] = f"SELECT *, {_rolled('stddev_samp', 'rollstd')} FROM filled WINDOW {_frames}"
CTES["feats"] = f"SELECT *, {_lags}, {_rolled('avg', 'rollmean')} FROM filled WINDOW {_series}, {_frames}"


# The same chain over readings with a direction, negatives nulled, the target capped, the direction taken apart.
CTES["job_readings"] = """
SELECT station, ts, variable, CASE WHEN value >= 0 THEN value END AS value FROM (
  SELECT station, ts, variable, value FROM readings
  UNION ALL SELECT event_type, ts, 'WD', CAST((event_id * 37) % 360 AS DOUBLE) FROM events)"""
_CHAIN = ("readings", "r15", "bounds", "places", "grid", "split_grid", "known", "filled")
for _name in _CHAIN[1:]:
    CTES[f"job_{_name}"] = re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"job_\1", CTES[_name])
CTES["job_capped"] = """
SELECT f.station, f.variable, f.ts, f.pos, f.split,
  CASE WHEN c.cap > 0 AND f.value IS NOT NULL THEN greatest(0.0, least(f.value, c.cap)) ELSE f.value END AS value
FROM job_filled f LEFT JOIN (SELECT station, variable, quantile_cont(value, 0.995) AS cap FROM job_filled
  WHERE split = 'train' AND variable = 'value' GROUP BY 1, 2) c ON c.station = f.station AND c.variable = f.variable"""
CTES["job_rows"] = """
SELECT station, variable, ts, pos, split, value FROM job_capped WHERE variable <> 'WD'
UNION ALL SELECT station, 'wd_sin', ts, pos, split, sin(radians(value)) FROM job_capped WHERE variable = 'WD'
UNION ALL SELECT station, 'wd_cos', ts, pos, split, cos(radians(value)) FROM job_capped WHERE variable = 'WD'"""
CTES["job_feats"] = f"SELECT *, {_lags}, {_rolled('avg', 'rollmean')} FROM job_rows WINDOW {_series}, {_frames}"


def feats(spark: SparkSession, sf: str) -> DataFrame:
    return fe.causal_features(filled(spark, sf), lags=fe.LAGS, means=fe.WINDOWS)


FEATURE_COLUMNS = ("value", *[f"lag_{k}" for k in fe.LAGS], *[f"rollmean_{w}" for w in fe.WINDOWS])


MODEL_VARIABLES = ("value", "k", "n")


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Wide rows with all lags and rolling means of all variables, staged; rows without the target or its lags are dropped."""
    return stage_table(fe.build_features(filled_once(spark, sf), "value", MODEL_VARIABLES), "features")


MODEL_FEATURES = (
    *[f"{v}_{c}" for v in MODEL_VARIABLES for c in FEATURE_COLUMNS[1:]],
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
)


def baselines(rows: DataFrame) -> DataFrame:
    """Three predictions of every filled row: the last value, the value an hour ago, the mean of the last hour."""
    rows = fe.causal_features(rows, lags=(1, 4), means=(4,))
    cells = [
        F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred"))
        for m, c in zip(MODELS, ("lag_1", "lag_4", "rollmean_4"))
    ]
    long = rows.select(
        "split", "station", "ts", F.col("variable").alias("target"), F.col("value").alias("y_true"), F.inline(F.array(*cells))
    )
    return long.dropna(subset=["y_true", "y_pred"])


def predictions(spark: SparkSession, sf: str, *targets: str) -> DataFrame:
    """The baselines for every variable."""
    return baselines(filled(spark, sf, *targets))


def predictions_once(spark: SparkSession, sf: str, *targets: str) -> DataFrame:
    return stage_table(predictions(spark, sf, *targets), "predictions")


CTES["basis"] = """
SELECT split, station, ts, variable AS target, value AS y_true,
  lag(value, 1) OVER w AS a, lag(value, 4) OVER w AS b,
  CASE WHEN count(value) OVER w4 = 4 THEN avg(value) OVER w4 END AS c
FROM filled
WINDOW w AS (PARTITION BY station, variable ORDER BY pos),
       w4 AS (PARTITION BY station, variable ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""
CTES["preds"] = """
SELECT * FROM (
  SELECT split, station, ts, target, 'persist1' AS model, y_true, a AS y_pred FROM basis
  UNION ALL SELECT split, station, ts, target, 'persist4', y_true, b FROM basis
  UNION ALL SELECT split, station, ts, target, 'mean4', y_true, c FROM basis)
WHERE y_true IS NOT NULL AND y_pred IS NOT NULL"""


def _metric_sql(keys: str, pooled: str = "") -> str:
    """Metrics over ``preds`` by the given key list."""
    return f"""SELECT {keys}{pooled}, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae,
      CASE WHEN max(y_true) > min(y_true)
           THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END AS r2, count(*) AS n_rows
    FROM preds GROUP BY {keys}"""


_k = "split, target, model"
CTES["metric_rows"] = _metric_sql(f"{_k}, station") + " UNION ALL " + _metric_sql(_k, ", 'ALL' AS station").replace(
    "SELECT split, target, model, 'ALL' AS station", "SELECT split, target, model, 'ALL' AS station"
)
CTES["val_best"] = """
SELECT station, target, model, rmse AS val_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY station, target ORDER BY rmse NULLS LAST,
    CASE model WHEN 'persist1' THEN 1 WHEN 'persist4' THEN 2 ELSE 3 END) AS rn
  FROM metric_rows WHERE split = 'val' AND station <> 'ALL') WHERE rn = 1"""
CTES["routed"] = """
SELECT split, station, ts, target, y_true, coalesce(own, spare) AS y_pred,
  CASE WHEN own IS NOT NULL THEN chosen ELSE 'persist1' END AS used_model
FROM (
  SELECT p.split, p.station, p.ts, p.target, max(p.y_true) AS y_true, max(v.model) AS chosen,
    max(CASE WHEN p.model = v.model THEN p.y_pred END) AS own,
    max(CASE WHEN p.model = 'persist1' THEN p.y_pred END) AS spare
  FROM preds p LEFT JOIN val_best v ON v.station = p.station AND v.target = p.target
  GROUP BY 1, 2, 3, 4)
WHERE coalesce(own, spare) IS NOT NULL"""


def floored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events at the start of their quarter hour, copies kept, with the day of the month as sheet."""
    rows = table(spark, sf, "events", "event_type", "ts")
    return rows.select(
        F.col("event_type").alias("station"),
        gr.floor_ts("ts", 900).alias("ts"),
        F.date_format("ts", "dd").alias("source_sheet"),
    )


CTES["floored"] = """
SELECT event_type AS station, time_bucket(INTERVAL '15 minutes', ts) AS ts, strftime(ts, '%d') AS source_sheet FROM events"""


def line_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as weekly readings per supplier region, four variables, unaggregated."""
    line = table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", *[f"l_{v}" for v in LINE_VARIABLES])
    supplier = table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    region = table(spark, sf, "region", "r_regionkey", "r_name")
    rows = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    cells = [F.struct(F.lit(v).alias("variable"), F.col(f"l_{v}").alias("value")) for v in LINE_VARIABLES]
    return rows.select(
        F.col("r_name").alias("station"), gr.floor_ts("l_shipdate", WEEK_S, MONDAY_S).alias("ts"), F.inline(F.array(*cells))
    )


CTES["line_base"] = """
SELECT r_name AS station, time_bucket(INTERVAL '7 days', l_shipdate) AS ts, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""
CTES["line_readings"] = "\nUNION ALL ".join(
    f"SELECT station, ts, '{v}' AS variable, l_{v} AS value FROM line_base" for v in LINE_VARIABLES
)


def line_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return gr.dedupe_mean(line_readings(spark, sf), ("station", "variable", "ts"))


CTES["line_weekly"] = "SELECT station, variable, ts, avg(value) AS value FROM line_readings GROUP BY 1, 2, 3"


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders", "o_orderpriority", "o_orderdate", "o_totalprice")
    return rows.select(
        F.col("o_orderpriority").alias("station"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")
    )


CTES["orders_daily"] = "SELECT o_orderpriority AS station, o_orderdate AS ts, o_totalprice AS value FROM orders"


# Events written the way a monitoring sheet shows them.


def sheet_path():
    """Workbook path of an event, covering every way a station is read from a folder."""
    kind = F.col("event_type")
    return (
        F.when(kind == "error", "Bhatagaon DCR/book.xlsx")
        .when(kind == "signup", "DCR AIIMS/book.xlsx")
        .when(kind == "view", "New Town DCR/book.xlsx")
        .when(kind == "purchase", "2024 07/book.xlsx")
        .otherwise("DCR/book.xlsx")
    )


def time_text():
    us = epoch_us("ts")
    serial = (whole_div(us, 86_400_000_000) + 25_569).cast("string")
    kind = F.pmod("event_id", F.lit(4))
    return (
        F.when(F.pmod("event_id", F.lit(31)) == 0, "x")
        .when(kind == 0, F.date_format("ts", "dd-MM-yyyy HH:mm"))
        .when(kind == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(serial)
    )


def value_text():
    def every(n: int):
        return F.pmod("event_id", F.lit(n)) == 0

    return (
        F.when(every(17), "Maint.")
        .when(every(19), " Power Off ")
        .when(every(23), " NA")
        .when(every(29), "")
        .when(every(37), "abc")
        .when(every(41), F.concat(F.lit("-"), F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string"))
    )


def sheet_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events", "event_id", "event_type", "ts", "value", "props")
    return rows.select(
        "event_id",
        "event_type",
        "ts",
        sheet_path().alias("source_file"),
        F.date_format("ts", "dd").alias("source_sheet"),
        time_text().alias("time_text"),
        value_text().alias("value_text"),
        F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).alias("k_text"),
    )


CTES["sheet_events"] = """
SELECT event_id, event_type, ts,
  CASE event_type WHEN 'error' THEN 'Bhatagaon DCR/book.xlsx' WHEN 'signup' THEN 'DCR AIIMS/book.xlsx'
    WHEN 'view' THEN 'New Town DCR/book.xlsx' WHEN 'purchase' THEN '2024 07/book.xlsx' ELSE 'DCR/book.xlsx' END AS source_file,
  strftime(ts, '%d') AS source_sheet,
  CASE WHEN event_id % 31 = 0 THEN 'x' WHEN event_id % 4 = 0 THEN strftime(ts, '%d-%m-%Y %H:%M')
    WHEN event_id % 4 = 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') WHEN event_id % 4 = 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS VARCHAR) END AS time_text,
  CASE WHEN event_id % 17 = 0 THEN 'Maint.' WHEN event_id % 19 = 0 THEN ' Power Off ' WHEN event_id % 23 = 0 THEN ' NA'
    WHEN event_id % 29 = 0 THEN '' WHEN event_id % 37 = 0 THEN 'abc'
    WHEN event_id % 41 = 0 THEN '-' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value_text,
  regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS k_text
FROM events"""


def sheet_cells(spark: SparkSession, sf: str) -> DataFrame:
    """One sheet per event type and day: title, heading, units, then the events as rows.

    One sheet in thirty lacks the time heading, another has no variables.
    """
    rows = sheet_events(spark, sf)
    data = rows.select(
        "source_file",
        "source_sheet",
        (F.col("event_id") + 3).alias("row_idx"),
        F.array(F.col("time_text"), F.col("value_text"), F.col("k_text"), F.lit("7"), F.col("value_text"), F.lit(""), F.lit(" ")).alias(
            "cells"
        ),
    )
    time_head = F.when(F.col("source_sheet") == "02", "Time").otherwise(" date &  TIME ")
    names = F.when(F.col("source_sheet") == "03", F.array(*[F.lit("")] * 4)).otherwise(
        F.array(F.lit("NO2"), F.lit(" "), F.lit("NO2"), F.lit(" PM  10 "))
    )
    blank = F.array(F.lit(""), F.lit(""))
    head = F.array(
        F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.array(F.when(F.col("source_sheet") == "03", "").otherwise("Report"), *[F.lit("")] * 6).alias("cells")),
        F.struct(F.lit(1).cast("bigint").alias("row_idx"), F.concat(F.array(time_head), names, blank).alias("cells")),
        F.struct(F.lit(2).cast("bigint").alias("row_idx"), F.array(F.lit(""), *[F.lit("ug/m3")] * 6).alias("cells")),
    )
    tops = rows.select("source_file", "source_sheet").distinct().select("source_file", "source_sheet", F.inline(head))
    return stage_table(tops.unionByName(data), "cells")


CTES["sheets"] = "SELECT DISTINCT source_file, source_sheet FROM sheet_events"
CTES["cells"] = """
SELECT source_file, source_sheet, 0 AS row_idx, [CASE WHEN source_sheet = '03' THEN '' ELSE 'Report' END, '', '', '', '', '', ''] AS cells FROM sheets
UNION ALL SELECT source_file, source_sheet, 1,
  list_concat([CASE WHEN source_sheet = '02' THEN 'Time' ELSE ' date &  TIME ' END],
    CASE WHEN source_sheet = '03' THEN ['', '', '', '', '', ''] ELSE ['NO2', ' ', 'NO2', ' PM  10 ', '', ''] END) FROM sheets
UNION ALL SELECT source_file, source_sheet, 2, ['', 'ug/m3', 'ug/m3', 'ug/m3', 'ug/m3', 'ug/m3', 'ug/m3'] FROM sheets
UNION ALL SELECT source_file, source_sheet, event_id + 3, [time_text, value_text, k_text, '7', value_text, '', ' '] FROM sheet_events"""
CTES["var_rows"] = r"""
SELECT source_file, source_sheet,
  min(CASE WHEN regexp_full_match(lower(cells[1]), '\s*date\s*&\s*time\s*') THEN row_idx END) AS var_row
FROM cells WHERE row_idx < 50 GROUP BY 1, 2"""
CTES["widths"] = """
SELECT v.source_file, v.source_sheet, max(v.var_row) AS var_row, coalesce(max(c.i), 0) + 1 AS width
FROM var_rows v LEFT JOIN (SELECT * FROM (
    SELECT source_file, source_sheet, row_idx, unnest(cells) AS cell, unnest(range(len(cells))) AS i FROM cells WHERE row_idx < 50)
  WHERE trim(cell) <> '') c
  ON c.source_file = v.source_file AND c.source_sheet = v.source_sheet AND c.row_idx <= v.var_row
WHERE v.var_row IS NOT NULL GROUP BY 1, 2"""
CTES["named"] = r"""
SELECT source_file, source_sheet, var_row, i, CASE WHEN n > 1 THEN name || '__' || n ELSE name END AS variable FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file, source_sheet, name ORDER BY i) AS n FROM (
    SELECT w.source_file, w.source_sheet, w.var_row, c.i,
      CASE WHEN trim(c.cell) = '' THEN 'COL_' || (c.i + 1) ELSE regexp_replace(trim(c.cell), '\s+', ' ', 'g') END AS name
    FROM widths w JOIN (SELECT source_file, source_sheet, row_idx, unnest(cells) AS cell, unnest(range(len(cells))) AS i
                        FROM cells WHERE row_idx < 50) c
      ON c.source_file = w.source_file AND c.source_sheet = w.source_sheet AND c.row_idx = w.var_row
    WHERE c.i BETWEEN 1 AND w.width - 1 AND w.width >= 2))"""
CTES["timed"] = """
SELECT *, coalesce(try_strptime(trim(t), ['%d-%m-%Y %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%d-%m-%Y %H:%M', '%d/%m/%Y %H:%M',
    '%Y-%m-%d %H:%M:%S']),
  CASE WHEN TRY_CAST(t AS DOUBLE) > 20000 AND TRY_CAST(t AS DOUBLE) < 70000
       THEN TIMESTAMP '1899-12-30' + to_days(CAST(TRY_CAST(t AS DOUBLE) AS INTEGER)) END) AS ts
FROM (SELECT *, cells[1] AS t FROM cells)"""


def station_sql(path: str) -> str:
    top = f"upper(split_part({path}, '/', 1))"
    known = " ".join(f"WHEN contains({top}, '{k}') THEN '{k}'" for k in ("BHATAGAON", "AIIMS", "IGKV", "SILTARA"))
    words = f"list_filter(regexp_extract_all({top}, '[A-Z]+'), lambda x: x <> 'DCR')"
    longest = f"list_reduce({words}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
    return f"CASE {known} WHEN len({words}) > 0 THEN {longest} ELSE replace(trim({top}), ' ', '_') END"


def clean_sql(cell: str) -> str:
    low = f"lower(trim({cell}))"
    return (
        f"CASE WHEN {low} IN ('', 'nan', 'na', 'null', 'none') OR regexp_matches({low}, 'maint|calib|power|link|warm|ref|fail|off') "
        f"THEN NULL ELSE TRY_CAST({low} AS DOUBLE) END"
    )


CTES["tidy"] = f"""
SELECT {station_sql('d.source_file')} AS station, d.ts, n.variable, {clean_sql('d.cells[n.i + 1]')} AS value, d.source_file, d.source_sheet
FROM timed d JOIN named n ON n.source_file = d.source_file AND n.source_sheet = d.source_sheet
WHERE d.row_idx >= n.var_row + 2 AND d.ts IS NOT NULL"""


def named_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Event values under eight spellings of variable names."""
    rows = table(spark, sf, "events", "event_id", "event_type", "ts", "value")
    station = F.upper("event_type")
    kind = F.pmod("event_id", F.lit(8))
    name = (
        F.when(kind == 0, F.concat(F.lit("VALUE_"), station))
        .when(kind == 1, F.concat(F.lit("VALUE__"), station))
        .when(kind == 2, F.concat(F.lit("VALUE"), station))
        .when(kind == 3, "Value")
        .when(kind == 4, F.concat(F.lit("PM 2.5_"), station))
        .when(kind == 5, "pm2_5")
        .when(kind == 6, "CO_AIIM")
        .otherwise(" WS  x_IGKV ")
    )
    value = F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("value"))
    return rows.select("event_id", station.alias("station"), "ts", name.alias("variable"), value.alias("value"))


CTES["named_readings"] = """
SELECT event_id, upper(event_type) AS station, ts,
  CASE event_id % 8 WHEN 0 THEN 'VALUE_' || upper(event_type) WHEN 1 THEN 'VALUE__' || upper(event_type)
    WHEN 2 THEN 'VALUE' || upper(event_type) WHEN 3 THEN 'Value' WHEN 4 THEN 'PM 2.5_' || upper(event_type)
    WHEN 5 THEN 'pm2_5' WHEN 6 THEN 'CO_AIIM' ELSE ' WS  x_IGKV ' END AS variable,
  CASE WHEN event_id % 5 <> 0 THEN value END AS value
FROM events"""
CTES["canon"] = r"""
SELECT *, CASE WHEN ends_with(s3, letters) AND length(s3) > length(letters) + 1 AND letters <> ''
               THEN trim(trim(left(s3, length(s3) - length(letters)), '_ ')) ELSE s3 END AS canonical
FROM (SELECT *, CASE WHEN contains(s2, '_') AND (tail = station OR tail IN ('AIIM', 'AIIMS'))
                     THEN trim(regexp_replace(s2, '_[^_]*$', '')) ELSE s2 END AS s3,
         regexp_replace(station, '[^A-Z]', '', 'g') AS letters
  FROM (SELECT *, trim(regexp_extract(s2, '([^_]*)$', 1)) AS tail
    FROM (SELECT *, trim(split_part(s1, '__', 1)) AS s2
      FROM (SELECT *, replace(replace(replace(upper(regexp_replace(trim(variable), '\s+', ' ', 'g')),
                'PM 2.5', 'PM2.5'), 'PM2_5', 'PM2.5'), 'PM 10', 'PM10') AS s1 FROM named_readings))))"""
CTES["densest"] = """
SELECT station, canonical, variable, n_known FROM (
  SELECT *, row_number() OVER (PARTITION BY station, canonical ORDER BY n_known DESC, variable) AS rn FROM (
    SELECT station, canonical, variable, count(value) AS n_known FROM canon GROUP BY 1, 2, 3)) WHERE rn = 1"""
