"""Quantiles, samples, scalers, models, metrics and routing."""

import threading
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import START
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from gridloom.catalog import modelling
from gridloom.operators import explore as ex
from gridloom.operators import metrics as me
from gridloom.operators import models as mo
from gridloom.operators import prepare as pr
from gridloom.operators import trees as tr
from gridloom.plans.quantiles import exact_quantiles
from gridloom.session import scratch_path
from gridloom.sources.tables import load_model, save_model


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_quantiles_equal_sorting(spark, n):
    rng = np.random.default_rng(n)
    data = {"a": rng.lognormal(size=n), "b": rng.integers(0, 4, n).astype(float)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    for r in exact_quantiles(df, ["k"], "v", qs, [f"q{i}" for i in range(len(qs))]).collect():
        np.testing.assert_allclose([r[f"q{i}"] for i in range(len(qs))], np.quantile(data[r["k"]], qs), rtol=1e-12)


def test_quantiles_of_a_large_skewed_group(spark):
    """More rows than the sketch resolves, a third of them one value."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pow(F.rand(5) * 10, 3)).alias("v"), F.lit("k").alias("k")
    )
    df = df.persist()
    vals = df.toPandas()["v"]
    qs = [0.1, 0.5, 0.9, 0.999]
    got = exact_quantiles(df, [], "v", qs, list("abcd")).first()
    np.testing.assert_allclose([got[c] for c in "abcd"], np.quantile(vals, qs), rtol=1e-12)


def test_quota_sample_is_exact_and_repeatable(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 15_000, "big").when(F.col("id") < 19_000, "mid").otherwise("small").alias("station"))
    quotas = pr.quota_table(df, 4000, floor_rows=500)
    want = {r["station"]: r["quota"] for r in quotas.collect()}
    sizes = {"big": 3000, "mid": 800, "small": 500}
    scale = 4000 / sum(sizes.values())
    assert want == {k: int(np.floor(v * scale)) for k, v in sizes.items()}
    one = pr.take_quota(df, quotas, "station", ["id"], cells=16)
    assert {r["station"]: r["count"] for r in one.groupBy("station").count().collect()} == want
    two = pr.take_quota(df.repartition(13), quotas, "station", ["id"], cells=16)
    assert one.exceptAll(two).count() == 0
    assert pr.take_quota(df, quotas, "station", ["id"], seed=1, cells=16).exceptAll(one).count() > 0
    assert pr.sample_rows(df, 777, ["id"]).count() == 777
    assert pr.sample_rows(df, 10**6, ["id"]).count() == 20_000
    assert {r["quota"] for r in pr.quota_table(df, 0).collect()} == {15_000, 4000, 1000}


def frame(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 10, 3]
    y = 2 + x @ [1.5, -0.3, 4] + rng.normal(size=n) * 0.5
    z = -1 + x @ [0.2, 0.7, 0] + rng.normal(size=n) * 0.1
    rows = [
        ("train" if i < 420 else "val" if i < 510 else "test", "AB"[i % 2], START + timedelta(minutes=15 * i), *map(float, x[i]), float(y[i]), float(z[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "split string, station string, ts timestamp_ntz, x0 double, x1 double, x2 double, y double, z double")


X = ["x0", "x1", "x2"]


def plain_ridge(x, y, alpha):
    mean, std = x.mean(0), x.std(0)
    s = (x - mean) / std
    w = np.linalg.solve(s.T @ s + alpha * np.eye(x.shape[1]), s.T @ (y - y.mean()))
    return y.mean() - (mean / std) @ w, w / std


def test_gram_ridge_equals_normal_equations(spark):
    df = frame(spark)
    pdf = df.toPandas()
    fit = {r["station"]: r for r in mo.fit_ridge(df, X, ["y"], key="station").collect()}
    for s, part in pdf.groupby("station"):
        t, v = part[part.split == "train"], part[part.split == "val"]
        errors = {}
        for a in mo.ALPHAS:
            b0, b = plain_ridge(t[X].to_numpy(), t.y.to_numpy(), a)
            errors[a] = np.sqrt(np.mean((v.y - b0 - v[X].to_numpy() @ b) ** 2))
        best = min(errors, key=errors.get)
        b0, b = plain_ridge(t[X].to_numpy(), t.y.to_numpy(), best)
        assert fit[s]["alpha"] == best and fit[s]["val_rmse"] == pytest.approx(errors[best], rel=1e-8)
        np.testing.assert_allclose([fit[s]["intercept"], *fit[s]["coefs"]], [b0, *b], rtol=1e-8)


def test_multi_target_scores_and_refit(spark):
    df = frame(spark)
    fit = mo.fit_ridge(df, X, ["y", "z"])
    assert {r["target"] for r in fit.collect()} == {"y", "z"} and len({r["alpha"] for r in fit.collect()}) == 1
    scored = mo.score_ridge(df, fit, X, ["y", "z"], "ridge")
    assert scored.count() == 1200
    r2 = {r["target"]: r["r2"] for r in me.metrics(scored.where("split = 'test'"), ["target"]).collect()}
    assert min(r2.values()) > 0.8
    refit = mo.fit_ridge(df, X, ["y"], alphas=[1.0], refit=True).first()
    pdf = df.where("split != 'test'").toPandas()
    b0, b = plain_ridge(pdf[X].to_numpy(), pdf.y.to_numpy(), 1.0)
    np.testing.assert_allclose([refit["intercept"], *refit["coefs"]], [b0, *b], rtol=1e-8)


def test_spark_ridge_equals_gram_ridge(spark):
    df = frame(spark)
    vectors = mo.assemble(mo.standardize_wide(df, X), X, "y")
    model = mo.linear_ridge(vectors.where("split = 'train'"), 10.0)
    gram = mo.fit_ridge(df, X, ["y"], alphas=[10.0])
    one = {r["ts"]: r["y_pred"] for r in mo.score_vectors(model, vectors, "m", "y").collect()}
    two = {r["ts"]: r["y_pred"] for r in mo.score_ridge(df, gram, X, ["y"], "m").collect()}
    np.testing.assert_allclose([one[k] for k in sorted(one)], [two[k] for k in sorted(one)], rtol=1e-8)
    _, best, errors = mo.tune_ridge(vectors)
    assert best == min(errors, key=errors.get)


def test_imputation_uses_train_medians(spark):
    df = frame(spark).withColumn("x1", F.when(F.col("x0") > 0, F.col("x1")))
    pdf = df.toPandas()
    train = pdf[pdf.split == "train"]
    pooled = mo.impute_wide(df, mo.wide_medians(df, X), X).toPandas()
    assert set(pooled.loc[pdf.x1.isna(), "x1"].round(9)) == {round(train.x1.median(), 9)}
    each = mo.impute_wide(df, mo.wide_medians(df, X, ["station"]), X, ["station"]).toPandas().sort_values("ts").reset_index(drop=True)
    for s in "AB":
        want = train[train.station == s].x1.median()
        hit = each[(each.station == s) & pdf.sort_values("ts").reset_index(drop=True).x1.isna()]
        assert set(hit.x1.round(9)) == {round(want, 9)}


def test_trees(spark):
    df = frame(spark)
    vectors = mo.assemble(df, X, "y")
    small = {"maxDepth": 4}
    forest = me.metrics(mo.score_vectors(mo.fit_forest(vectors, numTrees=8, **small), vectors, "rf", "y"), ["split"])
    boosted = mo.fit_boosted(vectors, maxIter=20, stepSize=0.3, **small)
    assert all(r["r2"] > 0.3 for r in forest.collect())
    assert boosted.n_rounds <= 20 and boosted.val_errors[boosted.best_round - 1] == min(boosted.val_errors)
    assert mo.val_rmse(boosted, vectors) < vectors.agg(F.stddev_pop("label")).first()[0]
    model, rows = mo.sweep_boosted(vectors, {"maxDepth": (2, 3)}, maxIter=3)
    assert rows.count() == 2 and mo.val_rmse(model, vectors) == pytest.approx(rows.agg(F.min("val_rmse")).first()[0])
    each = mo.fit_stations(df, mo.assemble_targets(df, X, ["y"]), X, "y", {"rf": {"numTrees": 3, **small}})
    assert mo.score_registry(mo.assemble_targets(df, X, ["y"]), each, X, ["y"]).count() == 600


def test_saved_pipeline_keeps_features_and_target(spark):
    df = frame(spark)
    model = Pipeline(stages=[VectorAssembler(inputCols=X, outputCol="f"), LinearRegression(featuresCol="f", labelCol="y")]).fit(df)
    path = scratch_path(spark, "bundle")
    save_model(model, path, X, "y")
    loaded, features, target = load_model(path)
    assert (features, target) == (X, "y")
    assert loaded.transform(df).agg(F.sum("prediction")).first()[0] == pytest.approx(model.transform(df).agg(F.sum("prediction")).first()[0])


PREDS = "split string, station string, ts timestamp_ntz, target string, model string, y_true double, y_pred double"


def predictions(spark, rows):
    return spark.createDataFrame([("val", s, START + timedelta(hours=i), "t", m, y, p) for s, i, m, y, p in rows], PREDS)


def test_metrics_and_pooling(spark):
    df = frame(spark)
    preds = mo.score_ridge(df, mo.fit_ridge(df, X, ["y"]), X, ["y"], "m")
    table = {r["station"]: r for r in me.metrics_table(preds).collect()}
    pdf = preds.toPandas()
    for s in ("A", "B", "ALL"):
        p = pdf if s == "ALL" else pdf[pdf.station == s]
        e = p.y_true - p.y_pred
        assert table[s]["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
        assert table[s]["mae"] == pytest.approx(e.abs().mean())
        assert table[s]["r2"] == pytest.approx(1 - (e**2).sum() / ((p.y_true - p.y_true.mean()) ** 2).sum())
    named = predictions(spark, [(s, i, "m", float(i), i + e) for s, e in (("ALL", 1.0), ("B", 3.0)) for i in range(4)])
    named = me.metrics_table(named.unionByName(named.withColumns({"model": F.lit("other"), "y_pred": F.col("y_pred") + F.when(F.col("station") == "ALL", -1).otherwise(5)})))
    one = {(r["station"], r["pooled"]): r for r in named.where("model = 'm'").collect()}
    assert set(one) == {("ALL", False), ("ALL", True), ("B", False)} and one["ALL", True]["n_rows"] == 8
    assert one["ALL", False]["rmse"] == pytest.approx(1) and one["ALL", True]["rmse"] == pytest.approx(np.sqrt(5))
    assert me.best_of(named, ["m", "other"], "m").first()["model"] == "m"
    assert me.best_of(named.drop("pooled").where("station <> 'ALL'"), ["m"], "none").first()["model"] == "none"
    assert {r["model"]: r["mean_r2"] for r in me.rank_by_r2(named).collect()}["m"] == pytest.approx(((1 - 4 / 5) + (1 - 36 / 5)) / 2)
    flat = predictions(spark, [("A", i, "m", 2.0, 2.5) for i in range(3)])
    assert me.metrics(flat).first()["r2"] is None


def test_routing(spark):
    val = spark.createDataFrame(
        [("A", "x", 1.0), ("A", "y", 1.0), ("B", "x", 3.0), ("B", "y", 2.0), ("C", "x", None), ("C", "y", float("nan"))],
        "station string, model string, rmse double",
    )
    routed = {r["station"]: r["model"] for r in me.route_models(val, ["x", "y"], default="y").collect()}
    assert routed == {"A": "x", "B": "y", "C": "y"}
    keys = spark.createDataFrame([("A",), ("D",)], "station string")
    covered = {r["station"]: r["model"] for r in me.route_models(val, ["x", "y"], default="y", all_keys=keys).collect()}
    assert covered == {"A": "x", "D": "y"}
    with pytest.raises(Exception, match="no candidate model for C"):
        me.route_models(val, ["x", "y"]).collect()
    preds = predictions(spark, [("A", 0, "x", 1.0, 10.0), ("A", 0, "y", 1.0, 20.0), ("B", 0, "x", 1.0, 30.0), ("B", 1, "y", 1.0, 40.0)])
    out = me.apply_routing(preds, me.route_models(val.where("station != 'C'"), ["x", "y"]), "x").orderBy("station", "ts").collect()
    assert [(r["station"], r["used_model"], r["y_pred"]) for r in out] == [("A", "x", 10.0), ("B", "x", 30.0), ("B", "y", 40.0)]


def test_alignment_keeps_shared_rows(spark):
    preds = predictions(spark, [("A", 0, "x", 1.0, 1.0), ("A", 0, "y", 1.0, 2.0), ("A", 1, "x", 1.0, 3.0)])
    wide = me.align_predictions(preds, ["x", "y"])
    assert [(r["pred_x"], r["pred_y"]) for r in wide.collect()] == [(1.0, 2.0)]
    assert me.long_predictions(wide, ["x", "y"]).count() == 2


def test_correlations_are_pairwise(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=300), rng.normal(size=300)
    rows = []
    for i in range(300):
        ts = START + timedelta(hours=i)
        rows += [("S", ts, "a", float(a[i])), ("S", ts, "c", float(a[i] + b[i]))]
        if i % 4:
            rows.append(("S", ts, "b", float(b[i])))
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, variable string, value double")
    got = {(r["var_a"], r["var_b"]): r for r in ex.correlation_per_station(df, ["a", "b", "c"]).collect()}
    keep = np.arange(300) % 4 > 0
    assert got[("b", "a")]["r"] == pytest.approx(np.corrcoef(a[keep], b[keep])[0, 1])
    assert got[("b", "a")]["n_pairs"] == 225 and len(got) == 6
    assert all(r["supported"] for r in got.values())
    few = ex.correlation_per_station(df, ["a", "b", "c"], min_values=250).collect()
    assert len(few) == 6 and not any(r["supported"] for r in few)
    unranked = {r["predictor"]: r["rank"] for r in ex.predictor_ranking(df, "c", ["a", "b", "c"], min_values=250).collect()}
    assert unranked == {"a": 1, "b": None}
    ranked = ex.predictor_ranking(df, "c", ["a", "b", "c"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2] and ranked[0]["r"] >= ranked[1]["r"]


@pytest.mark.parametrize("mean", [0.0, 1e9])
def test_wide_correlations_equal_pandas(spark, mean):
    """Forty columns with gaps of their own, a constant one and an empty one; keys null and large."""
    rng = np.random.default_rng(3)
    x = rng.normal(mean, 1, (400, 40))
    x[:, 1:] += x[:, :-1]
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5], x[:, 6] = 2.0, np.nan
    names = [f"v{i}" for i in range(40)]
    df = pd.DataFrame(x, columns=names)
    frame_ = spark.createDataFrame([(None if i % 3 == 0 else "S", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "station string, " + ", ".join(f"{n} double" for n in names))
    got = {(r["station"], r["a"], r["b"]): (r["r"], r["n_pairs"]) for r in ex.correlations(frame_.repartition(5), names, ["station"], ("a", "b")).collect()}
    assert len(got) == 2 * 40 * 41 // 2
    for station, own in ((None, df[np.arange(400) % 3 == 0]), ("S", df[np.arange(400) % 3 > 0])):
        want, known = own.corr(), own.notna().astype(int)
        for i, a in enumerate(names):
            for b in names[: i + 1]:
                r, n = got[station, a, b]
                assert n == int((known[a] * known[b]).sum())
                assert (r is None) == bool(np.isnan(want.loc[a, b])) and (r is None or abs(r - want.loc[a, b]) < 1e-5)


def test_selection(spark):
    df = spark.createDataFrame([("A", 1.0, None, 2, "x")], "station string, a double, dead double, y int, txt string")
    assert pr.feature_list(df, ["y"]) == ["a"]
    assert pr.default_targets(df, ["q", "y", "a"]) == ["y", "a"]
    with pytest.raises(ValueError):
        pr.default_targets(df)


@pytest.mark.parametrize("mean", [0.0, 1e5, 1e9])
def test_ridge_far_from_zero(spark, mean):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.1, 400)
    rows = [("A" if i % 2 else None, "train" if i < 300 else "val", float(mean + a), float(mean + b), float(mean + t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "station string, split string, a double, b double, y double")
    got = mo.fit_ridge(df, ["a", "b"], ["y"], alphas=(1e-6,)).first()
    design = np.column_stack([np.ones(300), x[:300]])
    want = np.linalg.lstsq(design, y[:300], rcond=None)[0]
    assert np.allclose(got["coefs"], want[1:], atol=1e-6)
    assert got["n_train"] == 300
    assert {r["station"]: r["n_train"] for r in mo.fit_ridge(df, ["a", "b"], ["y"], key="station").collect()} == {"A": 150, None: 150}


def test_targets_stay_apart(spark):
    rows = [("test", "A", t, i, m, float(10 * (t == "w") + i), float(i)) for t in ("v", "w") for i in range(3) for m in ("m1", "m2")]
    preds = spark.createDataFrame(rows, "split string, station string, target string, ts int, model string, y_true double, y_pred double")
    wide = me.align_predictions(preds, ["m1", "m2"])
    assert wide.count() == 6 and me.long_predictions(wide, ["m1", "m2"]).count() == 12
    routing = spark.createDataFrame([("A", "m2")], "station string, model string")
    assert me.apply_routing(preds, routing, "m1").count() == 6


@pytest.mark.parametrize("name", ["rf_fit", "gbt_fit", "gbt_sweep", "gbt_multi"])
def test_registered_fits_take_the_operators_settings(spark, monkeypatch, name):
    """The learners are replaced by ones that note their settings: a full fit is too slow here."""
    seen = []

    class Noted(Exception):
        pass

    def forest(train, path=None, **settings):
        seen.append(settings)
        raise Noted

    def boost(vectors, rounds, step, patience, **settings):
        seen.append({"maxIter": rounds, "stepSize": step, **settings, "patience": patience})
        raise Noted

    rows = spark.createDataFrame([("train", "A", 1.0, 1.0), ("val", "A", 2.0, 2.0)], "split string, station string, value double, k double").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    monkeypatch.setattr(modelling, "prepared", lambda *_: rows)
    monkeypatch.setattr(modelling.fr, "MODEL_FEATURES", ("k",))
    monkeypatch.setattr(mo, "assemble", lambda df, *_: df)
    monkeypatch.setattr(mo.tr, "grow_forest", forest)
    monkeypatch.setattr(mo.tr, "boost", boost)
    with pytest.raises(Noted):
        getattr(modelling, name)(spark, "")
    grid = [{**mo.BOOST, "maxDepth": d, "minInstancesPerNode": m, "penalty": g, "patience": 50} for d in (3, 5) for m in (1, 5) for g in (1.0, 5.0)]
    want = {"rf_fit": [mo.FOREST], "gbt_fit": [{**mo.BOOST, "patience": 50}], "gbt_sweep": grid, "gbt_multi": [{**mo.BOOST, **mo.MULTI, "patience": None}] * 2}[name]
    assert sorted(map(repr, seen)) == sorted(map(repr, want))


# Tree ensembles


def test_patience_passes_a_plateau_and_keeps_the_best_prefix():
    errors = [5.0, 4.0, *[4.5] * 49, 3.0, *[3.5] * 49]
    assert tr.best_round(errors, 50) == (52, False)
    assert tr.best_round([*errors, 3.5, 1.0], 50) == (52, True)  # the fiftieth round without a new minimum ends it
    assert tr.best_round([5.0, 4.0, *[4.5] * 50, 3.0], 50) == (2, True)
    assert tr.best_round([2.0, 2.0, 2.0], 2) == (1, True) and tr.best_round([], 50) == (0, False) and tr.best_round([float("nan")] * 3, 2) == (3, False)


def _steps(spark):
    """Two features; the target is a step function that depth-1 trees cannot reach in one round; val repeats train, then turns."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (400, 2)).astype(float)
    y = 3.0 * (x[:, 0] > 3) + 2.0 * (x[:, 1] > 5) + rng.normal(0, 0.3, 400)
    split = np.where(np.arange(400) % 4 == 3, "val", "train")
    rows = [(str(s), "A", START + timedelta(minutes=15 * i), float(a), float(b), float(t)) for i, (s, (a, b), t) in enumerate(zip(split, x, y, strict=True))]
    return spark.createDataFrame(rows, "split string, station string, ts timestamp_ntz, a double, b double, y double"), x, y, split


def _gain(left, below, penalty):
    return sum(left[m].sum() ** 2 / (m.sum() + penalty) for m in (below, ~below) if m.any())


def _best_first_split(x, left, penalty):
    tried = [(f, v) for f in range(x.shape[1]) for v in np.unique(x[:, f])[:-1]]
    return max(((c, _gain(left, x[:, c[0]] <= c[1], penalty)) for c in tried), key=lambda t: t[1])


@pytest.mark.parametrize("penalty", [0.0, 4.0])
def test_boosting_follows_its_definition(spark, penalty):
    """Replayed in NumPy: round by round on residuals, errors after each round, the prefix with the smallest one kept."""
    df, x, y, split = _steps(spark)
    vectors = mo.assemble(df, ["a", "b"], "y")
    model = tr.boost(vectors, 12, 0.5, patience=3, chunk=5, seed=1, maxDepth=2, penalty=penalty)
    train, val = split == "train", split == "val"
    told, errors = np.full(len(y), y[train].mean()), []
    whole = tr.boost(vectors, model.n_rounds, 0.5, patience=None, chunk=4, seed=1, maxDepth=2, penalty=penalty)
    assert whole.best_round == len(whole.root) == model.n_rounds
    for i in range(model.n_rounds):
        one = tr.Ensemble(0.0, np.ones(1), whole.root[i : i + 1], whole.feature, whole.threshold, whole.left, whole.right, whole.value, whole.gap)
        step = one.predict(x)
        left = (y - told)[train]
        for leaf in np.unique(step[train]):  # a leaf says the shrunk mean residual of its train rows
            own = step[train] == leaf
            assert leaf == pytest.approx(left[own].sum() / (own.sum() + penalty))
        cut, gain = _best_first_split(x[train], left, penalty)  # the root splits where two leaves explain most
        root = whole.root[i]
        got = _gain(left, x[train][:, whole.feature[root]] <= whole.threshold[root], penalty)
        assert got == pytest.approx(gain), (cut, whole.feature[root], whole.threshold[root])
        told = told + 0.5 * step
        errors.append(np.sqrt(((y - told)[val] ** 2).mean()))
    assert model.val_errors == pytest.approx(errors)
    assert (model.best_round, len(model.root)) == (tr.best_round(errors, 3)[0],) * 2
    scored = {r["ts"]: r["prediction"] for r in tr.score_ensemble(model, vectors).collect()}
    again = tr.Ensemble.unpacked(model.packed()).predict(x)
    assert [scored[START + timedelta(minutes=15 * i)] for i in range(400)] == pytest.approx(again)


def test_boosting_sends_missing_values_where_they_gain(spark):
    """Missing values carry the large labels: they go to their side; a column without values and a constant one are no harm."""
    rng = np.random.default_rng(4)
    gone = rng.random(300) < 0.4
    rows = [("train" if i % 3 else "val", "A", START + timedelta(minutes=15 * i), float("nan") if g else float(i % 7), float("nan"), 1.0, float(5.0 * g + 0.1 * (i % 7))) for i, g in enumerate(gone)]
    df = spark.createDataFrame(rows, "split string, station string, ts timestamp_ntz, a double, b double, c double, y double").repartition(3)
    model = tr.boost(mo.assemble_targets(df, ["a", "b", "c"], ["y"]).withColumnRenamed("y", "label"), 30, 0.5, maxDepth=3, penalty=0.0)
    assert model.val_errors[-1] < 0.2  # what missing values hide
    told = model.predict(np.array([[np.nan, np.nan, 1.0], [3.0, np.nan, 1.0]]))
    assert told[0] == pytest.approx(5.3, abs=0.3) and told[1] == pytest.approx(0.3, abs=0.1)


def test_forest_of_small_forests(spark):
    """The mean over all trees, as Spark scores the same small forests; an interrupted fit grows only what is missing."""
    df, x, _, _ = _steps(spark)
    vectors = mo.assemble(df, ["a", "b"], "y")
    path = scratch_path(spark, "forest")
    settings = {"numTrees": 7, "maxDepth": 5, "seed": 3, "part_trees": 3}
    forest = tr.grow_forest(vectors, path, **settings)
    assert sorted(r["n_trees"] for r in forest.collect()) == [1, 3, 3]
    want = np.zeros(len(x))
    for part, n in enumerate((3, 3, 1)):
        model = RandomForestRegressor(numTrees=n, maxDepth=5, seed=3 + 1000 * part).fit(vectors)
        want += n / 7 * np.array([r["prediction"] for r in model.transform(vectors).orderBy("ts").collect()])
    for most in (1, tr.PASS_BYTES):  # a pass a part, or one for all
        assert [r["prediction"] for r in tr.score_forest(forest, vectors, most).orderBy("ts").collect()] == pytest.approx(want.tolist())
    before = {r["part"]: r["packed"] for r in forest.collect()}
    lost = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=1")
    lost.getFileSystem(spark._jsc.hadoopConfiguration()).delete(lost, True)
    kept = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=0/_SUCCESS")
    time = kept.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(kept).getModificationTime()
    after = {r["part"]: r["packed"] for r in tr.grow_forest(vectors, path, **settings).collect()}
    assert after == before and kept.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(kept).getModificationTime() == time


def test_forest_tasks_have_rows_enough(spark, monkeypatch):
    """Few rows in many partitions are grown in as many tasks as their number asks for, and none is lost."""
    seen = []
    monkeypatch.setattr(mo.tr, "grow_forest", lambda train, path=None, **_: seen.append((train.rdd.getNumPartitions(), train.count())))
    rows = spark.range(100, numPartitions=6).select(F.when(F.col("id") < 70, "train").otherwise("val").alias("split"))
    for most in (50_000, 30, 1):
        monkeypatch.setattr(mo, "FOREST_ROWS", most)
        mo.fit_forest(rows)
    assert seen == [(1, 70), (3, 70), (6, 70)]


def test_drawn_rows_are_the_same_held_or_not(monkeypatch):
    """A worker that holds a block, one that fell behind and one that never saw it agree to the bit; what is held is bounded."""
    rng = np.random.default_rng(5)
    bins, label, train, pred = rng.integers(0, 8, (300, 3)).astype(np.uint8), rng.normal(size=300), rng.random(300) < 0.8, rng.normal(size=300)
    trees = []
    for i in range(7):
        trees.append(tr.Grown())
        trees[-1].split(0, i % 3, int(rng.integers(0, 7)), False, (float(rng.normal()), float(rng.normal())))
    columns = np.array([0, 2])

    def draw(n, **kw):
        return tr.drawn(("fit", 0), 4, train, label, pred, bins, trees[:n], 3, 0.3, columns, n, 1, 0.7, **kw)

    monkeypatch.setattr(tr, "_DRAWN", {})
    for n in (0, 1, 1, 2, 6, 7):
        held = draw(n)
        kept = dict(tr._DRAWN)
        tr._DRAWN.clear()
        anew = draw(n, most=0)
        assert not tr._DRAWN and len(kept) == 1
        tr._DRAWN.update(kept)
        want = pred
        for s in range(0, n - n % 3, 3):
            want = want + 0.3 * sum((t.predict(bins) for t in trees[s : s + 3]), np.zeros(300))
        left = label - want - 0.3 * sum((t.predict(bins) for t in trees[n - n % 3 : n]), np.zeros(300))
        for one in (held, anew):
            assert np.array_equal(one.val, left[~train]) and np.array_equal(one.left, left[one.own]) and train[one.own].all()
            assert np.array_equal(one.cells, np.minimum(bins[one.own][:, columns], tr.BINS) + np.arange(2) * (tr.BINS + 1))


def test_jobs_side_by_side(spark):
    """Jobs of different fits overlap: each waits until the other has begun."""
    barrier = threading.Barrier(2, timeout=60)
    assert tr.concurrently(spark, [lambda i=i: (barrier.wait(), spark.range(i).count())[1] for i in (3, 4)], 2) == [3, 4]


def test_stations_use_their_own_features(spark):
    """A station without a variable has a shorter list; one scan scores ridge, forest and boosting of all stations."""
    df = frame(spark, 500).withColumn(X[1], F.when(F.col("station") != "B", F.col(X[1])))
    vectors = mo.assemble_targets(df, X, ["y"])
    learners = {"ridge": {"alphas": [1.0]}, "rf": {"numTrees": 4, "maxDepth": 3, "part_trees": 3}, "gbt": {"maxIter": 6, "stepSize": 0.3, "maxDepth": 2}}
    registry = mo.fit_stations(df, vectors, X, "y", learners)
    lists = {(r["station"], r["model"]): r["features"] for r in registry.collect()}
    assert all(f == (X if s != "B" else [c for c in X if c != X[1]]) for (s, _), f in lists.items()) and len(lists) == 6
    for most in (1, tr.PASS_BYTES):
        scored = mo.score_registry(vectors, registry, X, ["y"], most)
        assert scored.groupBy("model").count().where("count = 500").count() == 3
        assert not mo.metrics(scored.where("split = 'train'"), ["model", "station"]).where("station = 'A' AND r2 < 0.2").count()
    plan = mo.score_registry(vectors, registry, X, ["y"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    alone = df.where("station = 'B'")
    own = [c for c in X if c != X[1]]
    fit = mo.fit_ridge(mo.impute_wide(alone, mo.wide_medians(alone, own), own), own, ["y"], alphas=[1.0])
    want = {r["ts"]: r["y_pred"] for r in mo.score_ridge(mo.impute_wide(alone, mo.wide_medians(alone, own), own), fit, own, ["y"], "m").collect()}
    got = {r["ts"]: r["y_pred"] for r in scored.where("station = 'B' AND model = 'ridge'").collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


@pytest.mark.parametrize("mean", [0.0, 1e5, 1e9])
def test_packed_moments(spark, mean):
    """One row a task and key is shuffled; keys given out early are added up by the reader."""
    rng = np.random.default_rng(8)
    x = rng.normal(mean, 1.0, (300, 3))
    df = spark.createDataFrame([(f"s{i % 3}", *map(float, r)) for i, r in enumerate(x)], "station string, a double, b double, c double").repartition(4)
    shift = [mean] * 3
    for held in (1, 64):
        rows = mo.gram_rows(df, ["station"], ["a", "b", "c"], held, shift).collect()
        assert held == 1 or len(rows) == 3
        for k in range(3):
            one = np.column_stack([np.ones(100), x[k::3] - mean])
            assert mo.whole_gram([bytes(r["sums"]) for r in rows if r["station"] == f"s{k}"], 4) == pytest.approx(one.T @ one)


def test_moments_of_many_computed_columns(spark):
    """No filter over the columns, whose constraints would double with each of them; incomplete rows are left out all the same."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 30))
    x[3, 4], x[7, 0] = np.nan, np.nan
    names = [f"c{i}" for i in range(30)]
    schema = "station string, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame([("AB"[i % 2], *(None if np.isnan(v) and i == 3 else float(v) for v in r)) for i, r in enumerate(x)] + [("C", *[None] * 30)], schema)
    computed = df.withColumns({n: F.coalesce(F.col(n) * 2, F.try_element_at(F.create_map(F.lit("none"), F.lit(0.0)), F.lit(n))) for n in names})
    grams = mo.gram_rows(computed, ["station"], names)
    assert "atleastnnonnulls" not in grams._jdf.queryExecution().analyzed().toString().lower()
    rows = grams.collect()
    for k in range(2):
        own = x[k::2][~np.isnan(x[k::2]).any(1)] * 2
        one = np.column_stack([np.ones(len(own)), own])
        assert mo.whole_gram([bytes(r["sums"]) for r in rows if r["station"] == "AB"[k]], 31) == pytest.approx(one.T @ one)
    assert mo.whole_gram([bytes(r["sums"]) for r in rows if r["station"] == "C"], 31)[0, 0] == 0
    fit = mo.fit_ridge(computed.withColumn("split", F.lit("train")), names[1:], ["c0"], key="station", alphas=[1.0])
    assert {r["station"]: r["n_train"] for r in fit.collect()} == {"A": 30, "B": 28}


def _within(tree, x, drawn):
    """Rows and their draws in every leaf of a tree, with the leaf's depth."""
    open_ = [(int(tree.root[0]), np.flatnonzero(drawn), 0)]
    while open_:
        node, rows, depth = open_.pop()
        f = tree.feature[node]
        if f < 0:
            yield node, rows, depth
        else:
            down = x[rows, f] <= tree.threshold[node]
            open_ += [(int(tree.left[node]), rows[down], depth + 1), (int(tree.right[node]), rows[~down], depth + 1)]


@pytest.mark.parametrize("node_rows", [50_000, 60])
def test_deep_trees_are_grown_to_their_end(spark, monkeypatch, node_rows):
    """Every leaf holds the mean of the rows drawn for the tree and none of them can be split; the upper nodes over all rows or in one task."""
    monkeypatch.setattr(tr, "NODE_ROWS", node_rows)
    monkeypatch.setattr(tr, "OPEN_NODES", 3)
    df, x, y, _ = _steps(spark)
    rows = mo.assemble(df.repartition(3), ["a", "b"], "y")
    blocks = {}
    keep = tr.pack_blocks

    def noted(*args):
        out = keep(*args)
        blocks.update({r["block"]: np.frombuffer(bytes(r["label"])) for r in out.collect()})
        return out

    monkeypatch.setattr(tr, "pack_blocks", noted)
    forest = {r["part"]: tr.Ensemble.unpacked(bytes(r["packed"])) for r in tr.grow_forest(rows, numTrees=5, maxDepth=12, seed=4, part_trees=2).collect()}
    assert sorted(len(t.root) for t in forest.values()) == [1, 2, 2]
    at = {v: i for i, v in enumerate(y)}
    for part, trees in forest.items():
        ends = [*trees.root[1:], len(trees.feature)]
        for t, (root, end) in enumerate(zip(trees.root, ends, strict=True)):
            drawn = np.zeros(len(y))
            for block, label in blocks.items():
                drawn[[at[v] for v in label]] = np.random.default_rng([4 + 1000 * part, t, block]).poisson(1.0, len(label))
            own = tr.Ensemble(0.0, np.ones(1), np.array([root]), trees.feature, trees.threshold, trees.left, trees.right, trees.value)
            leaves = list(_within(own, x, drawn))
            assert sum(len(r) for _, r, _ in leaves) == (drawn > 0).sum() and all(root <= n < end for n, _, _ in leaves)
            for node, inside, depth in leaves:
                assert trees.value[node] == pytest.approx(np.average(y[inside], weights=drawn[inside])) and depth <= 12
    told = np.mean([t.predict(x) / len(t.root) for t in forest.values()], 0)
    assert 1 - ((y - told) ** 2).mean() / y.var() > 0.9


def test_a_tree_by_brute_force():
    """All features, every cut tried in plain loops; missing values go right; sons keep at least so many rows."""
    rng = np.random.default_rng(8)
    bins, y, w = rng.integers(0, 5, (60, 3)).astype(np.uint8), rng.normal(size=60), rng.integers(1, 4, 60).astype(float)
    bins[rng.random(60) < 0.2, 1] = tr.MISSING
    for depth, least in ((1, 1), (3, 1), (20, 1), (20, 8)):
        feature, cut, left, right, value = tr.complete(bins, y, w, depth, least, 1.0, 6, np.random.default_rng(0))

        def loss(rows):
            return (w[rows] * (y[rows] - np.average(y[rows], weights=w[rows])) ** 2).sum() if len(rows) else 0.0

        def compare(node, rows, level):
            assert value[node] == pytest.approx(np.average(y[rows], weights=w[rows]))
            sides = [(rows[bins[rows, f] <= c], rows[bins[rows, f] > c]) for f in range(3) for c in range(5)]
            sides = [s for s in sides if all(w[r].sum() >= least for r in s) and min(map(len, s))]
            best = min((loss(a) + loss(b) for a, b in sides), default=np.inf)
            if feature[node] < 0:
                assert level == depth or best > loss(rows) - 1e-6
                return
            down = bins[rows, feature[node]] <= cut[node]
            assert loss(rows[down]) + loss(rows[~down]) == pytest.approx(best)
            compare(left[node], rows[down], level + 1)
            compare(right[node], rows[~down], level + 1)

        compare(0, np.arange(60), 0)


def test_deep_forest_in_few_jobs(spark):
    """A deep forest costs a few jobs a part, not one for every level of every small forest."""
    df, x, y, _ = _steps(spark)
    vectors = mo.assemble(df, ["a", "b"], "y")
    spark.sparkContext.setJobGroup("deep-forest", "")
    try:
        forest = mo.fit_forest(vectors, numTrees=20, maxDepth=20)
        assert forest.agg(F.sum("n_trees")).first()[0] == 20
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep-forest")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ValueError, match="rows"):
        mo.fit_forest(vectors.where("split = 'none'"))


def test_quantile_shares_are_literals_once(spark, monkeypatch):
    """The shares are not turned into literals again for every feature, which takes the driver seconds a fit."""
    from pyspark.sql.functions import builtin

    df, x, _, _ = _steps(spark)
    vectors, made, whole = mo.assemble(df, ["a", "b"], "y"), [], builtin.lit
    monkeypatch.setattr(builtin, "lit", lambda v: made.append(v) or whole(v))
    cuts = tr.cut_points(vectors, 8)
    assert len(made) < 10 and all(set(c) <= set(range(8)) for c in cuts)
    few = tr.cut_points(vectors, 2)
    assert [c.tolist() for c in few] == [[float(np.sort(v)[(len(v) + 1) // 2 - 1])] for v in x[np.arange(400) % 4 != 3].T]


def test_packed_trees_are_small():
    """A node of a forest takes a dozen bytes, not forty, and says the same when it is opened again."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, (3000, 5)).astype(np.uint8)
    y, parts = rng.normal(size=3000).round(2), []
    for i in range(3):
        feature, cut, left, right, value = tr.complete(x, y, np.ones(3000), 20, 1, 0.5, 33, np.random.default_rng(i))
        parts.append(tr.Ensemble(0.0, np.ones(1), np.zeros(1, np.int64), feature.astype(np.int32), cut + 0.5, left.astype(np.int32), right.astype(np.int32), value))
    for n in (1, 3):
        trees = tr.join_trees(parts[:n], 1.5, np.full(n, 1 / n))
        trees.gap[::7] = True
        again = tr.Ensemble.unpacked(trees.packed())
        assert len(trees.packed()) < 14 * len(trees.feature) + 3000 and (again.gap == trees.gap).all()
        holes = np.where(rng.random(x.shape) < 0.1, np.nan, x.astype(float))
        assert again.predict(holes).tolist() == trees.predict(holes).tolist()


def test_nodes_of_few_rows_are_split_alike():
    """Bins without rows change nothing: the same split, sums and order of ties, to the last digit."""
    rng, seen = np.random.default_rng(6), set()
    for rows, least in ((1, 1), (3, 1), (9, 1), (16, 3)):
        at = np.repeat(np.arange(20), rng.integers(1, rows + 1, 20))
        bins, weight = rng.integers(0, 33, (len(at), 4)).astype(np.uint8), rng.integers(1, 4, len(at)).astype(float)
        bins[:, 3] = bins[:, 1]  # two features that always tie
        features = np.tile(np.arange(4), (20, 1))
        h = tr._sums_by_bin(at, bins, rng.normal(size=len(at)), weight, features, 33)
        want, got = tr._best_splits(h, least), tr._best_of_few(h, least)
        ok = want[0]
        seen |= set(ok.tolist())
        assert (got[0] == ok).all() and (got[3] == want[3]).all()
        assert all((g[ok] == w[ok]).all() for g, w in zip(got, want, strict=True))
    assert seen == {True, False}


def test_registry_is_read_in_small_files_and_added_up_in_the_scan(spark):
    """Parts of a model that fit in one pass need no shuffle of their predictions; no file of models holds many of them."""
    df = frame(spark, 200)
    vectors = mo.assemble_targets(df, X, ["y"])
    registry = mo.fit_stations(df, vectors, X, "y", {"rf": {"numTrees": 12, "maxDepth": 3, "part_trees": 1}})
    assert registry.count() == 24
    assert registry.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= mo.MODELS_A_FILE
    scored = mo.score_registry(vectors, registry, X, ["y"])
    assert "Aggregate" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["station"], r["ts"]): r["y_pred"] for r in scored.collect()}
    passes = mo.score_registry(vectors, registry, X, ["y"], 2000)  # some parts of a model in a pass
    assert {(r["station"], r["ts"]): r["y_pred"] for r in passes.collect()} == pytest.approx(got) and len(got) == 200
