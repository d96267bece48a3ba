"""Scaling, sampling, labels, sequences and models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.catalog import frames as fr
from gridloom.catalog.registry import CTES, R, keep, query
from gridloom.operators import labels as lb
from gridloom.operators import metrics as me
from gridloom.operators import models as mo
from gridloom.operators import prepare as pr
from gridloom.operators.features import causal_features
from gridloom.operators.naming import pivot_wide
from gridloom.operators.split import require_nonnull
from gridloom.session import stage_table

_SAMPLE = "CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END"
_POP = "CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END"


@query("scaler_fit", f"SELECT variable, {R('avg(value)', 'mean')}, {R(_SAMPLE, 'std')} FROM filled WHERE split = 'train' AND variable <> 'value' GROUP BY 1")
def scaler_fit(spark, sf):
    return keep(pr.fit_scaler(fr.filled_once(spark, sf), exclude=["value"]), "variable", rnd=("mean", "std"))


@query("scaler_apply", f"""SELECT f.station, f.variable, f.ts, {R('(f.value - s.mean) / s.std', 'value')}
FROM filled f JOIN (SELECT variable, avg(value) AS mean, {_SAMPLE} AS std FROM filled WHERE split = 'train' GROUP BY 1) s ON s.variable = f.variable""")
def scaler_apply(spark, sf):
    df = fr.filled_once(spark, sf)
    return keep(pr.apply_scaler(df, pr.fit_scaler(df)), "station", "variable", "ts", rnd=("value",))


@query("scaler_pop", f"SELECT station, variable, {R('avg(value)', 'mean')}, {R(_POP, 'std')} FROM filled WHERE split = 'train' GROUP BY 1, 2")
def scaler_pop(spark, sf):
    return keep(pr.fit_scaler(fr.filled_once(spark, sf), ["station", "variable"], population=True), "station", "variable", rnd=("mean", "std"))


@query("scaler_inverse", f"SELECT station, variable, ts, {R('value', 'value')} FROM filled")
def scaler_inverse(spark, sf):
    df = fr.filled_once(spark, sf)
    params = pr.fit_scaler(df, population=True)
    back = pr.invert_scaler(pr.apply_scaler(df, params), params, ["value"])
    return keep(back, "station", "variable", "ts", rnd=("value",))


@query("feature_select", """SELECT CAST(position AS BIGINT) AS position, feature, n_known, n_known > 0 AS kept FROM (
  SELECT 0 AS position, 'l_orderkey' AS feature, count(l_orderkey) AS n_known FROM lineitem
  UNION ALL SELECT 1, 'l_quantity', count(l_quantity) FROM lineitem
  UNION ALL SELECT 2, 'l_discount', count(CASE WHEN l_returnflag = 'R' THEN l_discount END) FROM lineitem
  UNION ALL SELECT 3, 'empty', 0 FROM lineitem GROUP BY 1)""")
def feature_select(spark, sf):
    line = fr.table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    rows = line.withColumn("l_discount", F.when(F.col("l_returnflag") == "R", F.col("l_discount")))
    return pr.select_features(rows.withColumn("empty", F.lit(None).cast("double")), ["l_tax"])


@query("drop_all_null", f"""SELECT station, ts, {R('quantity', 'quantity', 3)} FROM (
  SELECT station, ts, avg(CASE WHEN variable = 'quantity' THEN value END) AS quantity FROM line_readings GROUP BY 1, 2)""")
def drop_all_null(spark, sf):
    """A variable without a single value is dropped from the wide table."""
    wide = pivot_wide(fr.line_readings(spark, sf), ["station", "ts"], ["quantity", "nowhere"])
    kept = pr.feature_list(wide, [])
    return keep(wide, "station", "ts", rnd=tuple(kept), digits=3)


_MATRIX = tuple(f"{v}_{c}" for v in fr.MODEL_VARIABLES for c in fr.FEATURE_COLUMNS[1:])
CTES["matrix"] = "SELECT split, station, ts, max(CASE WHEN variable = 'value' THEN value END) AS value_value, " + ", ".join(
    f"max(CASE WHEN variable = '{v}' THEN {c} END) AS {v}_{c}" for v in fr.MODEL_VARIABLES for c in fr.FEATURE_COLUMNS[1:]
) + " FROM feats GROUP BY 1, 2, 3"
_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in ("value_value", *[c for c in _MATRIX if c.startswith("value_lag")]))


@query("model_matrix", f"""SELECT split, station, ts, {R('value_value', 'label')}, {', '.join(R(c, c) for c in _MATRIX)} FROM matrix WHERE {_KNOWN}""")
def model_matrix(spark, sf):
    """The vectors taken apart again; a missing feature is NaN in a vector and null here."""
    rows = pr.model_matrix(fr.model_table(spark, sf), _MATRIX, "value")
    cells = vector_to_array("features")
    parts = [F.when(~F.isnan(cells[i]), cells[i]).alias(c) for i, c in enumerate(_MATRIX)]
    return keep(rows.select("split", "station", "ts", "label", *parts), "split", "station", "ts", rnd=("label", *_MATRIX))


CTES["quota_counts"] = "SELECT o_orderpriority AS station, count(*) AS n FROM orders GROUP BY 1"
CTES["quota_sizes"] = """SELECT station, n, t, least(n, greatest(100, CAST(round_even(n / t * 2000, 0) AS BIGINT))) AS q FROM (
  SELECT station, n, CAST(sum(n) OVER () AS DOUBLE) AS t FROM quota_counts)"""


@query("quota_sample", """SELECT station, CASE WHEN t <= 2000 THEN n WHEN s > 2000 THEN greatest(1, CAST(floor(q * (2000 / CAST(s AS DOUBLE))) AS BIGINT)) ELSE q END AS n_rows
FROM (SELECT *, sum(q) OVER () AS s FROM quota_sizes)""")
def quota_sample(spark, sf):
    rows = fr.table(spark, sf, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderpriority", "station")
    quotas = pr.quota_table(rows, 2000, floor_rows=100)
    return pr.take_quota(rows, quotas, "station", ["o_orderkey"]).groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"))


@query("prop_sample", """SELECT station, CASE WHEN t <= 2000 THEN n ELSE least(n, greatest(1, CAST(round_even(2000 / t * n, 0) AS BIGINT))) END AS n_rows FROM quota_sizes
UNION ALL SELECT 'ALL', least(2000, sum(n))::BIGINT FROM quota_counts""")
def prop_sample(spark, sf):
    """The same share of every station, and one global draw of the same size."""
    rows = fr.table(spark, sf, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderpriority", "station")
    parts = pr.take_quota(rows, pr.proportional_table(rows, 2000), "station", ["o_orderkey"])
    draw = pr.sample_rows(rows, 2000, ["o_orderkey"]).withColumn("station", F.lit("ALL"))
    return parts.unionByName(draw).groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"))


@query("finite_rows", """SELECT event_id, value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""")
def finite_rows(spark, sf):
    ev = fr.table(spark, sf, "events", "event_id", "value")
    bad = (
        F.when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 11 == 0, F.lit(float("-inf")))
        .when(F.col("event_id") % 13 == 0, F.lit(None))
        .otherwise(F.col("value"))
    )
    return pr.finite_rows(ev.withColumn("value", bad), ["value"])


@query("default_targets", "SELECT station, count(*) AS n_rows, count(l_tax) AS n_known FROM line_base GROUP BY 1")
def default_targets(spark, sf):
    """The preferred targets found among the columns, in preferred order, and the support of the first."""
    wide = pivot_wide(fr.line_readings(spark, sf).withColumn("one", F.lit(1)), ["station", "ts"], ["tax", "quantity"])
    first = pr.default_targets(wide, ["NO2", "tax", "quantity"])[0]
    rows = fr.line_readings(spark, sf).where(F.col("variable") == first)
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_known"))


# Labels and sequences

CTES["complete"] = "SELECT station, variable, ts, split, value FROM filled WHERE variable = 'value' AND value IS NOT NULL"


def complete_rows(spark, sf):
    """Rows of the target after rows without it are gone, so neighbours may be hours apart."""
    rows = fr.filled(spark, sf, "value")
    return stage_table(require_nonnull(rows, ["value"]).select("station", "ts", "split", "value"), "complete")


_AHEAD = "lead({c}, 4) OVER (PARTITION BY station, split ORDER BY ts)"


@query("horizon_rows", f"SELECT station, split, ts, {R('value', 'value')}, {R(_AHEAD.format(c='value'), 'y_value_h4')} FROM complete")
def horizon_rows(spark, sf):
    return keep(lb.horizon_labels(complete_rows(spark, sf), ["value"], 4, "rows"), "station", "split", "ts", rnd=("value", "y_value_h4"))


@query("horizon_exact", f"""SELECT station, split, ts, {R('value', 'value')},
  {R(f"CASE WHEN {_AHEAD.format(c='ts')} = ts + INTERVAL '1 hour' THEN {_AHEAD.format(c='value')} END", 'y_value_h4')} FROM complete""")
def horizon_exact(spark, sf):
    return keep(lb.horizon_labels(complete_rows(spark, sf), ["value"], 4), "station", "split", "ts", rnd=("value", "y_value_h4"))


_SEQ = """SELECT station, ts, value AS y, first_ts, last_ts, s, m FROM (
  SELECT *, count(*) OVER w AS m, min(ts) OVER w AS first_ts, max(ts) OVER w AS last_ts, sum(value) OVER w AS s,
    count(*) OVER (PARTITION BY station) AS n
  FROM complete WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b})) WHERE m = {t}"""
_T = 96


def _n_items(x):
    return np.full(len(x), x.shape[1])


@query("sequence_windows", f"""SELECT station, ts, {R('y', 'y')}, first_ts, last_ts, {R('s', 'x_sum')}, m AS n_items,
  epoch_us(last_ts) - epoch_us(first_ts) = {(_T - 1) * 900_000_000} AS contiguous FROM ({_SEQ.format(a=_T, b='1 PRECEDING', t=_T)})""")
def sequence_windows(spark, sf):
    """Windows summed up per row, and whether they have no hole in time: from rows stored once, in packed blocks."""
    packed = stage_table(lb.pack_windows(complete_rows(spark, sf), ["value"], ["value"], _T), "packed")

    def work(x, y, first, last, label):
        whole = last - first == np.timedelta64((_T - 1) * 900, "s")
        return {"ts": label, "y": y[:, 0], "first_ts": first, "last_ts": last, "x_sum": x.sum((1, 2)), "n_items": _n_items(x), "contiguous": whole}

    schema = "ts timestamp_ntz, y double, first_ts timestamp_ntz, last_ts timestamp_ntz, x_sum double, n_items long, contiguous boolean"
    out = lb.map_windows(packed, work, schema, _T)
    return keep(out, "station", "ts", "first_ts", "last_ts", "n_items", "contiguous", rnd=("y", "x_sum"))


@query("sequence_multi", f"""SELECT station, ts, y_ts, {R('y', 'y_value')}, {R('s', 'x_sum')}, CAST(m AS BIGINT) AS n_items FROM (
  SELECT *, count(*) OVER w AS m, sum(value) OVER w AS s, lead(value, 4) OVER o AS y, lead(ts, 4) OVER o AS y_ts,
    count(*) OVER (PARTITION BY station) AS n
  FROM complete WINDOW o AS (PARTITION BY station ORDER BY ts),
    w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN {_T - 1} PRECEDING AND CURRENT ROW))
WHERE m = {_T} AND y_ts IS NOT NULL""")
def sequence_multi(spark, sf):
    packed = stage_table(lb.pack_windows(complete_rows(spark, sf), ["value"], ["value"], _T, 4), "packed")

    def work(x, y, first, last, label):
        return {"ts": last, "y_ts": label, "y_value": y[:, 0], "x_sum": x.sum((1, 2)), "n_items": _n_items(x)}

    out = lb.map_windows(packed, work, "ts timestamp_ntz, y_ts timestamp_ntz, y_value double, x_sum double, n_items long", _T, 4)
    return keep(out, "station", "ts", "y_ts", "n_items", rnd=("y_value", "x_sum"))


@query("seq_eligible", f"""SELECT station, split, ts, {R('value', 'value')} FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS rn FROM complete) WHERE rn > 96 + 1 - 2""")
def seq_eligible(spark, sf):
    return keep(lb.window_eligible(complete_rows(spark, sf), 96, 1), "station", "split", "ts", rnd=("value",))


@query("persistence", f"""SELECT station, variable, ts, {R('lag(value, 4) OVER (PARTITION BY station, variable ORDER BY pos)', 'y_pred')} FROM filled""")
def persistence(spark, sf):
    return keep(lb.persistence(fr.filled(spark, sf), 4), "station", "variable", "ts", rnd=("y_pred",))


# Models

CTES["pairs"] = "SELECT station, split, ts, value AS y, lag_1 AS x FROM lagged WHERE variable = 'value' AND value IS NOT NULL AND lag_1 IS NOT NULL"


@query("ridge_1d", f"""SELECT station, {R('sxy / (sxx + 10 * sxx / n)', 'slope')}, {R('my - mx * sxy / (sxx + 10 * sxx / n)', 'intercept')}, n AS n_train
FROM (SELECT station, count(*) AS n, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx, avg(x) AS mx, avg(y) AS my
      FROM pairs WHERE split = 'train' GROUP BY 1)""")
def ridge_1d(spark, sf):
    """One lag per station; a penalty of 10 on the standardised input."""
    rows = causal_features(fr.filled(spark, sf, "value"), lags=(1,))
    rows = rows.withColumnRenamed("lag_1", "x").dropna(subset=["value", "x"])
    fit = mo.fit_ridge(rows, ["x"], ["value"], key="station", alphas=[10.0])
    return keep(fit.withColumn("slope", F.col("coefs")[0]), "station", "n_train", rnd=("slope", "intercept"))


def prepared(spark, sf):
    """The model table with its missing features filled from train: one staged table, the medians as literals over it."""
    table = fr.model_table(spark, sf)
    return mo.impute_wide(table, mo.wide_medians(table, fr.MODEL_FEATURES), fr.MODEL_FEATURES)


def _report(preds, digits=4):
    table = me.metrics_table(preds, ["split", "target", "model"])
    return keep(table, "split", "target", "model", "station", "n_rows", rnd=("rmse", "mae", "r2"), digits=digits)


TARGETS = ("value", "k")


@query("ridge_tuned")
def ridge_tuned(spark, sf):
    """Global ridge tuned on validation and fitted again on train and validation."""
    vectors = mo.assemble(mo.standardize_wide(prepared(spark, sf), fr.MODEL_FEATURES), fr.MODEL_FEATURES, "value")
    model, _, _ = mo.tune_ridge(vectors)
    return _report(mo.score_vectors(model, vectors, "ridge", "value"))


@query("ridge_multi")
def ridge_multi(spark, sf):
    """Two targets with one alpha, without a refit."""
    rows = prepared(spark, sf).dropna(subset=list(TARGETS))
    fit = mo.fit_ridge(rows, fr.MODEL_FEATURES, TARGETS)
    return _report(mo.score_ridge(rows, fit, fr.MODEL_FEATURES, TARGETS, "multi_ridge"))


@query("rf_fit")
def rf_fit(spark, sf):
    vectors = mo.assemble(prepared(spark, sf), fr.MODEL_FEATURES, "value")
    return _report(mo.score_vectors(mo.fit_forest(vectors), vectors, "rf", "value"))


@query("gbt_fit")
def gbt_fit(spark, sf):
    """Rounds grown, the round that was kept, and the metrics of the trees up to it."""
    vectors = mo.assemble(prepared(spark, sf), fr.MODEL_FEATURES, "value")
    model = mo.fit_boosted(vectors)
    report = _report(mo.score_vectors(model, vectors, "gbt", "value"))
    return report.withColumns({"n_rounds": F.lit(model.n_rounds).cast("long"), "best_round": F.lit(model.best_round).cast("long")})


@query("gbt_sweep")
def gbt_sweep(spark, sf):
    vectors = mo.assemble(prepared(spark, sf), fr.MODEL_FEATURES, "value")
    _, rows = mo.sweep_boosted(vectors)
    return keep(rows, *mo.SWEEP, "n_rounds", "best_round", rnd=("val_rmse",), digits=4)


@query("gbt_multi")
def gbt_multi(spark, sf):
    return _report(mo.fit_per_target(prepared(spark, sf), fr.MODEL_FEATURES, TARGETS, "gbt"))


@query("rf_multi")
def rf_multi(spark, sf):
    """One forest a target, grown side by side."""
    return _report(mo.fit_per_target(prepared(spark, sf), fr.MODEL_FEATURES, TARGETS, "rf"))


def _stations(spark, sf, learners: dict):
    """The model table, its vectors and a registry of the learners' models per station."""
    table = fr.model_table(spark, sf)
    vectors = mo.assemble_targets(table, fr.MODEL_FEATURES, ["value"])
    return table, vectors, mo.fit_stations(table, vectors, fr.MODEL_FEATURES, "value", learners)


@query("per_station_fit")
def per_station_fit(spark, sf):
    """Ridge, forest and boosting per station on the station's own features: pooled and per-station metrics on every split."""
    _, vectors, registry = _stations(spark, sf, {"ridge": {"refit": False}, "rf": {}, "gbt": {}})
    preds = stage_table(mo.score_registry(vectors, registry, fr.MODEL_FEATURES, ["value"]), "scored")
    sizes = registry.groupBy("station", "model").agg(F.max(F.size("features")).cast("long").alias("n_features"))
    return _report(preds).join(sizes, ["station", "model"], "left")


@query("score_long")
def score_long(spark, sf):
    """Predictions of the stations' ridge and forest models, all from one scan of the rows."""
    _, vectors, registry = _stations(spark, sf, {"ridge": {"refit": True}, "rf": {}})
    scored = mo.score_registry(vectors, registry, fr.MODEL_FEATURES, ["value"])
    return keep(scored, "split", "station", "ts", "target", "model", rnd=("y_true", "y_pred"), digits=4)


@query("compare_strategies")
def compare_strategies(spark, sf):
    """Global boosting, ridge and boosting per station, and the routed choice of them on the same test rows."""
    table, vectors, registry = _stations(spark, sf, {"ridge": {"refit": False}, "gbt": {}})
    filled = mo.impute_wide(table, mo.wide_medians(table, fr.MODEL_FEATURES), fr.MODEL_FEATURES)
    pooled = mo.assemble(filled, fr.MODEL_FEATURES, "value")
    one = mo.score_vectors(mo.fit_boosted(pooled), pooled, "global", "value")
    each = mo.score_registry(vectors, registry, fr.MODEL_FEATURES, ["value"])
    both = stage_table(one.unionByName(each), "scored")
    val = me.metrics(both.where("split = 'val'"), ["station", "model"])
    routing = me.route_models(val, ["global", "ridge", "gbt"])
    routed = me.apply_routing(both, routing, "global")
    named = {m: both.where(F.col("model") == m) for m in ("global", "ridge", "gbt")} | {"routed": routed}
    return keep(mo.compare_strategies(named), "strategy", "n_rows", rnd=("rmse", "mae", "r2"), digits=4)
