"""Grids, splits, fills, features: hand cases, properties and block edges."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import START, values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import features as fe
from gridloom.operators import grid as gr
from gridloom.operators import labels as lb
from gridloom.operators import split as sp
from gridloom.plans.series import number_rows

N = None


def ragged(n=300, seed=1, gap=0.35):
    rnd = random.Random(seed)
    out, i = [], 0
    while len(out) < n:
        run = rnd.randint(1, 9)
        known = rnd.random() > gap
        out += [round(rnd.uniform(0, 100), 2) if known else None for _ in range(run)]
    return out[:n]


def test_gap_fill_hand_case(grid_of):
    got = values(sp.fill_gaps(grid_of([N, 1, N, 3, N, N, N, N, N, N, 10, 11, N, N, 14, N])))
    assert got == [N, 1, 2, 3, 4, 5, 6, 7, N, N, 10, 11, 12, 13, 14, N]


def test_whole_gap_only_leaves_long_gaps(grid_of):
    got = values(sp.fill_gaps(grid_of([1, N, N, N, N, N, 7, N, 9]), whole_gap_only=True))
    assert got == [1, N, N, N, N, N, 7, 8, 9]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_gap_fill_does_not_depend_on_blocks(grid_of, bits):
    series = ragged() + [None] * 40 + [5.0]
    index = pd.date_range(START, periods=len(series), freq="15min")
    want = pd.Series(series, index, dtype=float).interpolate(method="time", limit=4, limit_area="inside")
    got = values(sp.fill_gaps(grid_of(series), bits=bits))
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(), rtol=1e-12)


def test_fill_stays_inside_its_split(grid_of):
    series = [1.0, None, None, 4.0]
    df = grid_of(series).withColumn("split", F.when(F.col("pos") < 2, "train").otherwise("val"))
    assert values(sp.fill_gaps(df)) == series


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_features_do_not_depend_on_blocks(grid_of, bits):
    series = ragged(gap=0.1)
    s = pd.Series(series, dtype=float)
    got = fe.causal_features(grid_of(series), (1, 4, 96), (4, 24), (12,), bits=bits)
    for k in (1, 4, 96):
        np.testing.assert_array_equal(np.array(values(got, f"lag_{k}"), dtype=float), s.shift(k).to_numpy())
    for w in (4, 24):
        want = s.shift(1).rolling(w).mean().to_numpy()
        np.testing.assert_allclose(np.array(values(got, f"rollmean_{w}"), dtype=float), want, rtol=1e-9)
    want = s.shift(1).rolling(12).std().to_numpy()
    np.testing.assert_allclose(np.array(values(got, "rollstd_12"), dtype=float), want, rtol=1e-6)
    assert got.count() == len(series)


def test_rolling_mean_needs_every_value(grid_of):
    got = values(fe.rolling_mean(grid_of([1, 2, N, 4, 5, 6, 7, 8]), (4,)), "rollmean_4")
    assert got == [N] * 7 + [5.5]


def test_future_rows_never_change_a_feature(grid_of):
    series = ragged(120)
    cut = 80
    whole = fe.causal_features(grid_of(series), (1, 8), (4,)).where(F.col("pos") < cut)
    part = fe.causal_features(grid_of(series[:cut]), (1, 8), (4,))
    for c in ("lag_1", "lag_8", "rollmean_4"):
        assert values(whole, c) == values(part, c)


def test_one_window_equals_context_rows(grid_of):
    """Features of the test split computed from 97 context rows are those of the whole series."""
    series = ragged(400, gap=0.05)
    df = sp.chrono_split(grid_of(series).drop("split"))
    start = int(0.85 * 400)
    tail = df.where(F.col("pos") >= start - 97)
    for c in ("lag_96", "rollmean_96"):
        one = values(fe.causal_features(df, (96,), (96,)).where("split = 'test'"), c)
        two = values(fe.causal_features(tail, (96,), (96,)).where("split = 'test'"), c)
        assert one == two
    assert sp.history_context(df).where("context_for = 'test'").count() == 97
    assert sp.tail_rows(df, 97).count() == 97


@given(st.integers(1, 400))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_split_sizes(spark, n):
    rows = spark.range(n).select(F.col("id").alias("pos"), F.lit(n).cast("bigint").alias("n_pos"))
    sizes = {r["split"]: r["count"] for r in sp.chrono_split(rows).groupBy("split").count().collect()}
    assert sizes.get("train", 0) == int(np.floor(0.70 * n))
    assert sizes.get("train", 0) + sizes.get("val", 0) == int(np.floor(0.85 * n))
    assert sum(sizes.values()) == n


def test_grid_drops_off_step_rows_and_averages_copies(spark):
    rows = [("A", "v", START + timedelta(minutes=m), float(x)) for m, x in ((0, 1), (0, 3), (15, 5), (22, 9), (60, 7))]
    rows.append(("A", "w", START + timedelta(minutes=30), 4.0))
    df = spark.createDataFrame(rows, "station string, variable string, ts timestamp_ntz, value double")
    got = gr.complete_grid(df, bits=1).where("variable = 'v'")
    assert values(got) == [2.0, 5.0, None, None, 7.0]
    other = gr.complete_grid(df).where("variable = 'w'")
    assert values(other) == [None, None, 4.0, None, None]


def test_step_deltas_with_copies_across_buckets(spark):
    minutes = [0, 0, 0, 15, 75, 200, 200, 215]
    df = spark.createDataFrame([("A", START + timedelta(minutes=m), "s") for m in minutes], "station string, ts timestamp_ntz, source_sheet string")
    want = pd.Series(minutes).diff().dropna().value_counts().to_dict()
    got = {r["delta_s"] / 60: r["n"] for r in gr.step_deltas(df).collect()}
    assert got == {float(k): v for k, v in want.items()}
    audit = gr.step_audit(df).first()
    assert (audit["n_rows"], audit["n_sheets"]) == (8, 1)
    assert audit["frac_15min"] == pytest.approx(2 / 7) and audit["frac_60min"] == pytest.approx(1 / 7)


def test_train_statistics_ignore_later_splits(spark, grid_of):
    series = ragged(100, gap=0.1)
    df = sp.chrono_split(grid_of(series).drop("split"))
    changed = df.withColumn("value", F.when(F.col("split") == "train", F.col("value")).otherwise(F.col("value") * 50))
    assert sp.fit_caps(df).first()["cap"] == sp.fit_caps(changed).first()["cap"]
    assert sp.fit_medians(df).first()["median"] == sp.fit_medians(changed).first()["median"]


def test_caps_clip_and_skip(grid_of):
    df = grid_of([1, 2, 3, 100, N])
    caps = sp.fit_caps(df, 0.5)
    assert values(sp.apply_caps(df, caps)) == [1, 2, 2.5, 2.5, N]
    assert values(sp.apply_caps(df, sp.fit_caps(df, 1.5))) == [1, 2, 3, 100, N]
    zero = grid_of([0, 0, 0])
    assert values(sp.apply_caps(zero, sp.fit_caps(zero, 0.9))) == [0, 0, 0]


def test_number_rows_is_exact_over_buckets(spark):
    rows = [("A", START + timedelta(hours=h)) for h in (0, 1, 30, 31, 100)] + [("B", START)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz")
    got = number_rows(df, ["station"], bucket_s=3600 * 24).where("station = 'A'").orderBy("ts").collect()
    assert [r["pos"] for r in got] == [0, 1, 2, 3, 4] and {r["n_pos"] for r in got} == {5}


def _rows(spark, hours, split="train"):
    rows = [("A", split, START + timedelta(minutes=15 * h), float(h)) for h in hours]
    return spark.createDataFrame(rows, "station string, split string, ts timestamp_ntz, value double")


def test_horizon_modes(spark):
    df = _rows(spark, [0, 1, 2, 10, 11])
    assert values(lb.horizon_labels(df, ["value"], 1, "rows"), "y_value_h1", "ts") == [1, 2, 10, 11, N]
    assert values(lb.horizon_labels(df, ["value"], 1), "y_value_h1", "ts") == [1, 2, N, 11, N]
    with pytest.raises(ValueError):
        lb.horizon_labels(df, ["value"], 0)


def test_horizon_across_blocks(spark):
    df = _rows(spark, range(5000))
    got = lb.horizon_labels(df, ["value"], 7, "rows").orderBy("ts").toPandas()["y_value_h7"]
    assert got.isna().sum() == 7 and (got.dropna().to_numpy() == np.arange(7, 5000)).all()


def test_sequence_windows(spark):
    df = _rows(spark, [0, 1, 2, 3, 10, 11, 12])
    got = lb.sequence_windows(df, ["value"], "value", 3).orderBy("ts").collect()
    assert [([x["value"] for x in r["x"]], r["y"]) for r in got] == [
        ([0, 1, 2], 3), ([1, 2, 3], 10), ([2, 3, 10], 11), ([3, 10, 11], 12)]
    whole = lb.sequence_windows(df, ["value"], "value", 3, contiguous_step_s=900).orderBy("ts").collect()
    assert [r["y"] for r in whole] == [3, 10]
    assert [r["y"] for r in lb.sequence_windows(df, ["value"], "value", 6).collect()] == [12]
    assert lb.sequence_windows(df, ["value"], "value", 7).count() == 0


def _unpacked(packed, length, horizon=1):
    def work(x, y, first, last, label):
        assert x.base is not None
        return {"x": list(x.reshape(len(x), -1)), "y": list(y), "first": first, "last": last, "label": label}

    schema = "x array<double>, y array<double>, first timestamp_ntz, last timestamp_ntz, label timestamp_ntz"
    return lb.map_windows(packed, work, schema, length, horizon)


@pytest.mark.parametrize("n, length, horizon", [(0, 3, 1), (3, 3, 1), (4, 3, 1), (60, 1, 1), (700, 3, 2), (700, 17, 40)])
def test_packed_windows_agree_with_loops(spark, n, length, horizon):
    """Short blocks, so that windows and labels reach over many edges."""
    df = _rows(spark, range(n)).withColumns({"w": F.when(F.col("value") % 5 != 0, -F.col("value")), "x": F.lit("clash")})
    df = df.unionByName(df.withColumn("station", F.lit("B"))) if n else df
    packed = lb.pack_windows(df, ["value", "w"], ["w", "value"], length, horizon)
    got = _unpacked(packed, length, horizon).collect()
    nan = float("nan")
    rows = [[float(i), nan if i % 5 == 0 else -float(i)] for i in range(n)]
    want = {i: (sum(rows[i - length + 1 : i + 1], []), rows[i + horizon][::-1]) for i in range(length - 1, n - horizon)}
    for station in {r["station"] for r in got}:
        mine = {round((r["last"] - START).total_seconds() / 900): r for r in got if r["station"] == station}
        assert sorted(mine) == sorted(want)
        for i, (x, y) in want.items():
            assert np.allclose(mine[i]["x"], x, equal_nan=True) and np.allclose(mine[i]["y"], y, equal_nan=True)
            assert mine[i]["first"] == START + timedelta(minutes=15 * (i - length + 1))
            assert mine[i]["label"] == START + timedelta(minutes=15 * (i + horizon))
    assert len(got) == len(want) * (2 if n else 0)


def test_packed_windows_store_rows_once(spark):
    df = _rows(spark, range(20_000))
    packed = lb.pack_windows(df, ["value"], ["value"], 96)
    stored, n_blocks, n_windows = packed.agg(F.sum(F.size("x")), F.count("*"), F.sum(F.size("at"))).first()
    assert n_blocks > 1 and 20_000 <= stored < 1.1 * 20_000 and n_windows == 20_000 - 96


def test_packed_windows_without_holes(spark):
    df = _rows(spark, [0, 1, 2, 3, 10, 11, 12])
    got = _unpacked(lb.pack_windows(df, ["value"], ["value"], 3, contiguous_step_s=900), 3).orderBy("last").collect()
    assert [(r["x"], r["y"]) for r in got] == [([0, 1, 2], [3]), ([1, 2, 3], [10])]
    with pytest.raises(ValueError):
        lb.pack_windows(df, ["value"], ["value"], 0)


def test_multi_target_windows_and_eligibility(spark):
    df = _rows(spark, range(20))
    got = lb.sequence_windows_multi(df, ["value"], ["value"], 4, 2).orderBy("ts").collect()
    assert [x["value"] for x in got[0]["x"]] == [0, 1, 2, 3] and got[0]["y_value"] == 5
    assert len(got) == 20 - 3 - 2
    assert sorted(r["y_value"] for r in lb.sequence_windows_multi(df, ["value"], ["value"], 14, 2).collect()) == [15, 16, 17, 18, 19]
    assert lb.sequence_windows_multi(df, ["value"], ["value"], 19, 2).count() == 0
    assert lb.window_eligible(df, 4, 2).count() == 16


def test_feature_table(grid_of, spark):
    a, b = ragged(200, 2, 0.05), ragged(200, 3, 0.05)
    df = grid_of(a, variable="PM2.5").unionByName(grid_of(b, variable="WD")).unionByName(grid_of([N] * 200, variable="dead"))
    wide = fe.build_features(df, "PM2.5", ["PM2.5", "WD", "dead"], (1, 2), (4,), direction="WD")
    assert {"PM2_5", "PM2_5_lag_2", "wd_sin_rollmean_4", "hour_cos"} <= set(wide.columns) and "WD" not in wide.columns
    assert wide.where("PM2_5 IS NULL OR PM2_5_lag_1 IS NULL OR PM2_5_lag_2 IS NULL").count() == 0
    assert wide.where("dead IS NOT NULL").count() == 0
    record = fe.schema_record(fe.base_columns(df, "PM2.5"), "PM2.5", (1, 2), (4,))
    assert record.where("variable = 'PM2.5'").count() == 4 and record.where("variable = 'dead'").count() == 0
