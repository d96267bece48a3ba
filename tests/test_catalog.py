"""Registered queries: contract, a sample against DuckDB, streams and the end-to-end job."""

import os

import pytest
from check import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.catalog import frames as fr
from gridloom.operators import split as sp
from gridloom.plans import jobs
from gridloom.session import scratch_path
from gridloom.streaming import jobs as streams

SF = "/root/testdata/sf0.001"
QUICK = (
    "scan_parquet union_by_name sheet_to_long clean_values canonical_name time_grid gap_fill chrono_split step_audit feature_build "
    "quota_sample prop_sample horizon_exact routed_predictions corr_matrix dist_summary stream_grid stream_ingest"
).split()
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 110


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    assert sum(r["n_rows"] for r in rows if r["station"] == "ALL") == 553


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        problem = difference(got, con.execute(sql).df())
        assert problem is None, problem
    else:
        assert len(got)


def test_ingest_resumes_with_new_files_only(spark):
    source, out, checkpoint = (scratch_path(spark, n) for n in ("incoming", "out", "checkpoint"))
    events = fr.table(spark, SF, "events")
    schema = events.schema
    for part, total in ((0, 1), (1, 2)):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            done = streams.ingest_files(spark, source, schema, out, checkpoint, max_files=1)
        assert done.count() == events.where(F.col("event_id") % 2 < total).count() == done.select("event_id").distinct().count()


def test_grid_is_computed_once_for_a_fill(spark):
    df = sp.fill_gaps(fr.split_grid(spark, SF))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_feature_job(spark):
    readings = fr.weather_readings(spark, SF)
    wide = jobs.feature_job(readings, "value", ["value", "k", "WD"], 21_600, (1, 2, 4), (4,))
    assert "WD" not in wide.columns and {"wd_sin_lag_4", "wd_cos_rollmean_4"} <= set(wide.columns)
    weekend = wide.where("split = 'train'").agg(F.avg("is_weekend"), F.stddev_samp("is_weekend")).first()
    assert abs(weekend[0]) < 1e-9 and abs(weekend[1] - 1) < 1e-9
    assert wide.where("value IS NULL OR value_lag_1 IS NULL").count() == 0
    train = wide.where("split = 'train'").agg(F.avg("k_lag_1"), F.stddev_samp("k_lag_1")).first()
    assert abs(train[0]) < 1e-9 and abs(train[1] - 1) < 1e-9
