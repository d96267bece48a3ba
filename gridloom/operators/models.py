"""Ridge, random forest and boosted trees: global, per station and for several targets; a registry of models scored in one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import trees as tr
from gridloom.operators.metrics import align_predictions, long_predictions, metrics
from gridloom.operators.prepare import scale_wide
from gridloom.plans.joins import join_params
from gridloom.plans.packed import added, packed_sums
from gridloom.plans.quantiles import exact_quantiles
from gridloom.session import stage_table

# The settings that are tuned or kept by the learners.
ALPHAS = (0.1, 1.0, 10.0)
FOREST = {"numTrees": 300, "maxDepth": 20, "seed": 42}
BOOST = {"maxIter": 1500, "stepSize": 0.03, "maxDepth": 6, "subsamplingRate": 0.8, "columnRate": 0.8, "penalty": 1.0, "minInstancesPerNode": 1, "seed": 42}
MULTI = {"maxIter": 800, "stepSize": 0.05, "subsamplingRate": 0.9, "columnRate": 0.9}
SWEEP = {"maxDepth": (3, 5), "minInstancesPerNode": (1, 5), "penalty": (1.0, 5.0)}
PATIENCE = 50
#: Rows up to which one task is enough to grow trees.
FOREST_ROWS = 50_000
POOLED = "ALL"


# Train medians for missing features


def wide_medians(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact train median per feature as (keys, feature, median)."""
    train = df.where(F.col("split") == "train")
    long = train.unpivot(list(keys) or [F.lit(POOLED).alias("_k")], list(features), "feature", "value")
    return exact_quantiles(long, [*keys, "feature"], "value", [0.5], ["median"])


def impute_wide(df: DataFrame, medians: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Missing features become their train median, or 0 where train has no value at all.

    Without keys the medians are one number per feature and enter the plan as literals.
    """
    if not keys:
        known = {r["feature"]: r["median"] for r in medians.collect()}
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(known.get(c) or 0.0))) for c in features})
    entry = F.map_from_entries(F.collect_list(F.struct("feature", "median")))
    per_key = medians.groupBy(*keys).agg(entry.alias("_medians"))
    joined = join_params(df, per_key, keys, "left")
    filled = {c: F.coalesce(F.col(c), F.try_element_at("_medians", F.lit(c)), F.lit(0.0)) for c in features}
    return joined.withColumns(filled).drop("_medians")


# Ridge from Gram matrices


def centres(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Mean of each column over all rows, as numbers to shift by; 0 where there is none."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [x if x is not None and np.isfinite(x) else 0.0 for x in row]


def gram_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], max_held: int = 64, shift: Sequence[float] | None = None) -> DataFrame:
    """Gram matrices of [1, columns - shift] per key, as the packed upper triangle (``sums``); a shift near the means keeps all digits.

    Rows with a missing column are left out by the tasks: a filter over computed columns doubles the constraints that the
    optimizer derives with each of them.
    """
    offset = np.array(shift if shift is not None else [0.0] * len(columns))
    upper = np.triu_indices(len(columns) + 1)

    def moments(x: np.ndarray) -> np.ndarray:
        whole = x[~np.isnan(x).any(axis=1)]
        one = np.column_stack([np.ones(len(whole)), whole - offset])
        return (one.T @ one)[upper]

    return packed_sums(df, keys, columns, moments, max_held)


def whole_gram(rows: Sequence[bytes], size: int) -> np.ndarray:
    """The symmetric matrix of packed triangles, added up."""
    g = np.zeros((size, size))
    if len(rows):
        g[np.triu_indices(size)] = added(rows)
    return g + np.triu(g, 1).T


def solve_ridge(
    grams: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], alphas: Sequence[float] = ALPHAS, refit: bool = False,
    shift: Sequence[float] | None = None, masked: DataFrame | None = None,
) -> DataFrame:
    """Coefficients per (key, target): alpha with the lowest mean validation RMSE, the first on ties.

    Works on ``gram_rows`` keyed by (key, split). Inputs are standardised with train moments (population deviation);
    validation errors follow from the validation Gram matrix, so rows are read once for all alphas. ``refit`` solves the
    chosen alpha again on train and val together. ``masked`` (key, features) names the columns that a key's system uses:
    its part of the matrix is cut out, and ``features`` and ``coefs`` of the result are as long as that list.
    """
    names, tried, columns_of, by_list = list(targets), [float(a) for a in alphas], list(features), masked is not None
    whole = np.array(shift if shift is not None else [0.0] * (len(columns_of) + len(names)))

    def fit(gram: np.ndarray, alpha: float) -> np.ndarray:
        n, p = gram[0, 0], len(gram) - 1 - len(names)
        mean = gram[0, 1:] / n
        centred = gram[1:, 1:] - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(centred)[:p], 0.0) / n)
        scale = np.where(spread > 1e-12 * (1 + np.abs(mean[:p])), spread, 1.0)
        a = centred[:p, :p] / np.outer(scale, scale) + alpha * np.eye(p)
        w = np.linalg.solve(a, centred[:p, p:] / scale[:, None]) / scale[:, None]
        return np.vstack([mean[p:] - mean[:p] @ w, w])

    def rmse(gram: np.ndarray, beta: np.ndarray, t: int) -> float:
        c, p = np.zeros(gram.shape[0]), len(gram) - 1 - len(names)
        c[: p + 1], c[p + 1 + t] = beta[:, t], -1.0
        return float(np.sqrt(max(c @ gram @ c, 0.0) / gram[0, 0])) if gram[0, 0] else float("nan")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = len(columns_of) + 1 + len(names)
        used = [columns_of.index(f) for f in pdf["features"].iloc[0]] if by_list else list(range(len(columns_of)))
        cut = np.array([0, *(i + 1 for i in used), *range(len(columns_of) + 1, size)])
        offset, p = whole[cut[1:] - 1], len(used)
        train, val = (whole_gram(list(pdf.loc[pdf["split"] == s, "sums"]), size)[np.ix_(cut, cut)] for s in ("train", "val"))
        rows = []
        if train[0, 0] > 0:
            fits = [fit(train, a) for a in tried]
            errors = np.array([[rmse(val, b, t) for t in range(len(names))] for b in fits])
            score = errors.mean(axis=1)
            best = int(np.nanargmin(score)) if np.isfinite(score).any() else 0
            beta = fit(train + val, tried[best]) if refit else fits[best]
            for t, name in enumerate(names):
                own = None if pd.isna(pdf[key].iloc[0]) else pdf[key].iloc[0]
                intercept = beta[0, t] + offset[p + t] - offset[:p] @ beta[1:, t]
                rows.append((own, name, tried[best], errors[best, t], intercept, beta[1:, t].tolist(), int(train[0, 0]), [columns_of[i] for i in used]))
        return pd.DataFrame(rows, columns=[key, "target", "alpha", "val_rmse", "intercept", "coefs", "n_train", "features"])

    schema = f"{key} string, target string, alpha double, val_rmse double, intercept double, coefs array<double>, n_train bigint, features array<string>"
    if by_list:
        grams = grams.join(masked.select(key, "features"), key)
    return grams.groupBy(key).applyInPandas(solve, schema)


def fit_ridge(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    key: str | None = None,
    alphas: Sequence[float] = ALPHAS,
    refit: bool = False,
    masked: DataFrame | None = None,
) -> DataFrame:
    """Ridge per value of ``key``, each on its own columns where ``masked`` lists them, or one pooled model, for one or several targets."""
    rows = df if key else df.withColumn("scope", F.lit(POOLED))
    name = key or "scope"
    used, columns = rows.where(F.col("split").isin("train", "val")), [*features, *targets]
    shift = centres(used, columns)
    return solve_ridge(gram_rows(used, [name, "split"], columns, shift=shift), name, features, targets, alphas, refit, shift, masked)


def _dot(x: str | Column, w: str | Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def score_ridge(df: DataFrame, coefs: DataFrame, features: Sequence[str], targets: Sequence[str], model: str, key: str | None = None) -> DataFrame:
    """Long predictions of the rows that have a target, one row per target.

    The coefficients of a pooled model are one list per target and enter the plan as literals; those of keyed models
    are joined.
    """
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("_x")
    if key is None:
        fitted = [r for r in coefs.collect() if r["target"] in targets]
        cells = [
            F.struct(
                F.lit(r["target"]).alias("target"),
                F.col(r["target"]).cast("double").alias("y_true"),
                (F.lit(r["intercept"]) + _dot("_x", F.array(*[F.lit(w) for w in r["coefs"]]))).alias("y_pred"),
            )
            for r in fitted
        ]
        scored = df.select("split", "station", "ts", x, *targets).select("split", "station", "ts", F.inline(F.array(*cells)))
    else:
        truth = F.map_from_arrays(F.array(*[F.lit(t) for t in targets]), F.array(*[F.col(t).cast("double") for t in targets]))
        rows = df.select(*dict.fromkeys(["split", "station", "ts", key]), x, truth.alias("_y"))
        joined = join_params(rows, coefs.select(key, "target", "intercept", "coefs"), [key])
        y_pred = F.col("intercept") + _dot("_x", "coefs")
        scored = joined.select("split", "station", "ts", "target", F.col("_y")[F.col("target")].alias("y_true"), y_pred.alias("y_pred"))
    return scored.select("split", "station", "ts", "target", F.lit(model).alias("model"), "y_true", "y_pred").dropna(subset=["y_true", "y_pred"])


# Spark ML learners


def standardize_wide(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features scaled with train mean and population deviation."""
    return scale_wide(df, features, population=True)


def assemble(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Vector rows for Spark ML, staged so that every fit reads them instead of the feature plan."""
    rows = df.dropna(subset=[target])
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return stage_table(vec.select("split", "station", "ts", F.col(target).cast("double").alias("label"), "features"), "vectors")


def linear_ridge(train: DataFrame, alpha: float):
    """Ridge on standardised vectors: the penalty alpha * |w|^2 in the units of Spark's linear regression."""
    stats = train.agg(F.stddev_pop("label").alias("sd"), F.count("label").alias("n")).first()
    lr = LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * stats["sd"] / stats["n"])
    return lr.fit(train)


def predicted(model, vectors: DataFrame) -> DataFrame:
    """Rows with ``prediction`` of a Spark ML model, an ensemble or a forest table."""
    if isinstance(model, DataFrame):
        return tr.score_forest(model, vectors)
    return tr.score_ensemble(model, vectors) if isinstance(model, tr.Ensemble) else model.transform(vectors)


def val_rmse(model, vectors: DataFrame) -> float:
    scored = predicted(model, vectors.where(F.col("split") == "val"))
    return scored.agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))).first()[0]


def tune_ridge(vectors: DataFrame, alphas: Sequence[float] = ALPHAS, refit: bool = True):
    """Ridge with the alpha of lowest validation RMSE; the chosen one is fitted again on train and val."""
    train = vectors.where(F.col("split") == "train")
    errors = [val_rmse(linear_ridge(train, a), vectors) for a in alphas]
    best = alphas[int(np.argmin(errors))]
    rows = vectors.where(F.col("split").isin("train", "val")) if refit else train
    return linear_ridge(rows, best), best, dict(zip(alphas, errors))


def fit_forest(vectors: DataFrame, path: str | None = None, **params) -> DataFrame:
    """A forest table on the train rows; with ``path`` an interrupted fit goes on where it stopped.

    Every task that grows trees holds and shuffles the sums of all open nodes, however few rows it has. So the rows are
    dealt over no more tasks than there are FOREST_ROWS in them; small forests side by side keep the cluster busy.
    """
    train = vectors.where(F.col("split") == "train")
    parts = max(1, -(-train.count() // FOREST_ROWS))
    return tr.grow_forest(train.coalesce(parts) if parts < train.rdd.getNumPartitions() else train, path, **{**FOREST, **params})


def fit_boosted(vectors: DataFrame, early_stop: bool = True, patience: int = PATIENCE, **params) -> tr.Ensemble:
    """Boosted trees; with ``early_stop`` the val split decides how many of them are kept."""
    settings = {**BOOST, **params}
    rounds, step = settings.pop("maxIter"), settings.pop("stepSize")
    return tr.boost(vectors, rounds, step, patience if early_stop else None, **settings)


def sweep_boosted(vectors: DataFrame, grid: Mapping[str, Sequence] = SWEEP, workers: int = 8, **params) -> tuple[tr.Ensemble, DataFrame]:
    """Every combination of a small grid fitted on train, side by side; the best model (the first on ties) and a row per combination."""
    combos: list[dict] = [{}]
    for name, values in grid.items():
        combos = [{**c, name: v} for c in combos for v in values]
    fits = tr.concurrently(vectors.sparkSession, [lambda c=c: fit_boosted(vectors, **{**params, **c}) for c in combos], workers)
    errors = [f.val_errors[f.best_round - 1] if f.best_round else float("nan") for f in fits]
    rows = [(*[float(c[k]) for k in grid], float(e), f.n_rounds, f.best_round) for c, e, f in zip(combos, errors, fits, strict=True)]
    schema = ", ".join([*(f"{k} double" for k in grid), "val_rmse double, n_rounds long, best_round long"])
    best = fits[int(np.nanargmin(errors)) if np.isfinite(errors).any() else 0]
    return best, vectors.sparkSession.createDataFrame(rows, schema)


def score_vectors(model, vectors: DataFrame, name: str, target: str) -> DataFrame:
    return predicted(model, vectors).select(
        "split", "station", "ts", F.lit(target).alias("target"), F.lit(name).alias("model"), F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")
    )


def assemble_targets(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One staged table of vectors with all targets; missing features stay as NaN."""
    vec = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)
    return stage_table(vec.select("split", "station", "ts", *[F.col(t).cast("double").alias(t) for t in targets], "features"), "vectors")


def fit_per_target(df: DataFrame, features: Sequence[str], targets: Sequence[str], learner: str, workers: int = 8, **params) -> DataFrame:
    """Independent tree models per target, fitted side by side on one table of vectors, scored on all splits."""
    vectors = assemble_targets(df, features, targets)

    def rows_of(target: str) -> DataFrame:
        return vectors.select("split", "station", "ts", F.col(target).alias("label"), "features").where(F.col("label").isNotNull())

    def fit(target: str):
        return fit_forest(rows_of(target), **params) if learner == "rf" else fit_boosted(rows_of(target), early_stop=False, **{**MULTI, **params})

    models = tr.concurrently(df.sparkSession, [lambda t=t: fit(t) for t in targets], workers)
    parts = [score_vectors(m, rows_of(t), f"multi_{learner}", t) for t, m in zip(targets, models, strict=True)]
    return reduce(DataFrame.unionByName, parts)


# Models per station and their registry

#: A model of the registry: rows of one (station, target, model) hold its parts; ridge models have coefficients and no trees.
REGISTRY = "station string, target string, model string, part int, features array<string>, medians array<double>, intercept double, coefs array<double>, scale double, packed binary, n_rounds long, best_round long"


#: Parts of models in a file of a registry.
MODELS_A_FILE = 4


def own_features(df: DataFrame, features: Sequence[str], key: str = "station") -> DataFrame:
    """(key, features, medians): the features that a station's train rows know, with their exact medians, in the given order."""
    listed = wide_medians(df, features, [key]).where(F.col("median").isNotNull())
    place = F.array_position(F.lit(list(features)), F.col("feature"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), "feature", "median")))
    held = listed.groupBy(key).agg(ordered.alias("_f"))
    return held.select(key, F.transform("_f", lambda f: f["feature"]).alias("features"), F.transform("_f", lambda f: f["median"]).alias("medians"))


def fit_stations(df: DataFrame, vectors: DataFrame, features: Sequence[str], target: str, learners: Mapping[str, Mapping], workers: int = 8) -> DataFrame:
    """A registry of one model per station and learner, each on the station's own features.

    ``learners`` maps a model name to its settings; the name's beginning says which it is: ridge, rf or gbt. ``vectors``
    is the table of ``assemble_targets`` of the same rows. Stations come from the table of own features: one row each.
    Ridge systems are solved in Spark, one station a group; beside them, tree models are fitted side by side, each over the cluster.
    """
    spark, places = df.sparkSession, {f: i for i, f in enumerate(features)}
    own = stage_table(own_features(df, features), "own-features")

    def linear(name: str) -> DataFrame:
        entry = F.map_from_arrays("features", "medians")
        joined = join_params(df, own.select("station", "features", entry.alias("_medians")), ["station"])
        # What a station does not know is 0 in its Gram matrix and left out when it is solved.
        filled = joined.withColumns({f: F.coalesce(F.col(f), F.try_element_at("_medians", F.lit(f)), F.lit(0.0)) for f in features}).drop("_medians")
        fitted = fit_ridge(filled, features, [target], key="station", masked=own, **learners[name])
        one = fitted.join(own.withColumnRenamed("features", "own"), "station")
        cells = F.filter(F.arrays_zip("own", "medians"), lambda c: F.array_contains("features", c["own"]))
        full = one.select("station", "target", F.lit(name).alias("model"), F.lit(0).alias("part"), "features", F.transform(cells, lambda c: c["medians"]).alias("medians"), "intercept", "coefs", F.lit(1.0).alias("scale"), F.lit(None).cast("binary").alias("packed"), F.lit(0).cast("long").alias("n_rounds"), F.lit(0).cast("long").alias("best_round"))
        return stage_table(full, "station-model")

    def rows_of(station: str | None, names: list[str], medians: list[float]) -> DataFrame:
        cells = vector_to_array("features")
        filled = [F.when(F.isnan(cells[places[f]]), F.lit(float(m))).otherwise(cells[places[f]]) for f, m in zip(names, medians, strict=True)]
        rows = vectors.where(F.col("station").eqNullSafe(F.lit(station)) & F.col(target).isNotNull())
        return rows.select("split", F.col(target).alias("label"), array_to_vector(F.array(*filled)).alias("features"))

    def fit(row, name: str) -> DataFrame:
        rows = stage_table(rows_of(row["station"], row["features"], row["medians"]), "station-vectors")
        if name.startswith("rf"):
            forest = fit_forest(rows, **learners[name])
            total = forest.agg(F.sum("n_trees")).first()[0]
            made = forest.select("part", F.lit(1.0 / total).alias("scale"), "packed", F.lit(total).cast("long").alias("n_rounds"), F.lit(total).cast("long").alias("best_round"))
        else:
            model = fit_boosted(rows, **learners[name])
            made = spark.createDataFrame([(0, 1.0, bytearray(model.packed()), model.n_rounds, model.best_round)], "part int, scale double, packed binary, n_rounds long, best_round long")
        lists = F.lit(list(row["features"])).alias("features"), F.lit([float(m) for m in row["medians"]]).alias("medians")
        full = made.select(F.lit(row["station"]).cast("string").alias("station"), F.lit(target).alias("target"), F.lit(name).alias("model"), "part", *lists, F.lit(0.0).alias("intercept"), F.lit(None).cast("array<double>").alias("coefs"), "scale", "packed", "n_rounds", "best_round")
        return full if name.startswith("rf") else stage_table(full, "station-model")

    grown = [m for m in learners if not m.startswith("ridge")]
    jobs = [lambda m=m: linear(m) for m in learners if m not in grown]
    if grown:
        stations = own.orderBy("station").collect()  # one row a station
        jobs += [lambda r=r, m=m: fit(r, m) for r in stations for m in grown]
    parts = tr.concurrently(spark, jobs, workers)
    return stage_table(reduce(DataFrame.unionByName, parts), "registry", rows_a_file=MODELS_A_FILE)


def score_registry(vectors: DataFrame, registry: DataFrame, features: Sequence[str], targets: Sequence[str], most: int = tr.PASS_BYTES) -> DataFrame:
    """Long predictions of all stations by all models of a registry, in one scan of the vectors.

    Missing features of a row become the medians of its station's model. A scan holds models of at most ``most`` bytes; a
    larger registry takes several, whose parts are added up by row. A station null in the registry is a pooled model, used
    for rows of every station. Rows without the target or without a model are left out.
    """
    spark, places, key = registry.sparkSession, {f: i for i, f in enumerate(features)}, ["station", "target", "model", "part"]
    groups = tr.passes(registry, key, most)
    if len(groups) > 1:  # each pass reads its own files
        numbered = spark.createDataFrame([(*k, i) for i, g in enumerate(groups) for k in g], "station string, target string, model string, part int, pass int")
        same = reduce(lambda a, b: a & b, [registry[c].eqNullSafe(numbered[c]) for c in key])
        registry = stage_table(registry.join(F.broadcast(numbered), same).select(*[registry[c] for c in registry.columns], "pass"), "passes", ("pass",), MODELS_A_FILE)
    schema = "split string, station string, ts timestamp_ntz, target string, model string, y_true double, y_pred double"

    def scan(i: int) -> DataFrame:
        own_models = registry.where(F.col("pass") == i) if len(groups) > 1 else registry
        held = sorted((r.asDict() for r in own_models.collect()), key=lambda r: [(r[c] is not None, r[c]) for c in key])
        shared = spark.sparkContext.broadcast(held)

        def run(batches):
            models: dict[tuple, list] = {}
            for r in shared.value:
                trees = tr.Ensemble.unpacked(bytes(r["packed"])) if r["packed"] is not None else None
                models.setdefault(tuple(r[c] for c in key[:3]), []).append((r, [places[f] for f in r["features"]], np.array(r["medians"]), trees))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
                station = np.array(batch.column("station").to_pylist(), object)
                for (of, target, name), parts in models.items():
                    truth = batch.column(f"_y{targets.index(target)}")
                    pick = np.flatnonzero(((station == of) | (of is None)) & truth.is_valid().to_numpy(zero_copy_only=False))
                    if not len(pick):
                        continue
                    told = np.zeros(len(pick))
                    for r, at, medians, trees in parts:
                        own = x[np.ix_(pick, at)]
                        own = np.where(np.isnan(own), medians, own)
                        told += r["scale"] * (trees.predict(own) if trees is not None else r["intercept"] + own @ np.array(r["coefs"]))
                    rows = batch.take(pa.array(pick))
                    named = [pa.array([c] * len(pick)) for c in (target, name)]
                    columns = [rows.column("split"), rows.column("station"), rows.column("ts"), *named, rows.column(f"_y{targets.index(target)}"), pa.array(told)]
                    yield pa.RecordBatch.from_arrays(columns, names=["split", "station", "ts", "target", "model", "y_true", "y_pred"])

        cells = [F.col(t).cast("double").alias(f"_y{i}") for i, t in enumerate(targets)]
        return vectors.select("split", "station", "ts", *cells, vector_to_array("features").alias("_x")).mapInArrow(run, schema)

    scored = reduce(DataFrame.unionByName, [scan(i) for i in range(len(groups))])
    # Passes of one model meet by row; models of one pass need no shuffle.
    if sum(len({k[:3] for k in g}) for g in groups) == len({k[:3] for g in groups for k in g}):
        return scored
    return scored.groupBy("split", "station", "ts", "target", "model").agg(F.first("y_true").alias("y_true"), F.sum("y_pred").alias("y_pred"))


def compare_strategies(preds: Mapping[str, DataFrame], split: str = "test") -> DataFrame:
    """Pooled metrics of several strategies on the rows that all of them predict."""
    names = list(preds)
    rows = None
    for name, df in preds.items():
        part = df.where(F.col("split") == split).select("split", "station", "ts", "y_true", "y_pred").withColumn("model", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    shared = long_predictions(align_predictions(rows, names), names)
    return metrics(shared, ["model"]).withColumnRenamed("model", "strategy")
