"""Training, search, scoring and explanation of cheap regressors with ``pyspark.ml``."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.bits import N_BITS
from assayer.operators.sampling import hash_positions, kfold
from assayer.operators.stats import fit_metrics
from assayer.plans.consensus import best_trial
from assayer.plans.crossval import few_rows_warning, patient_stop
from assayer.session import stored

# fixed values: ranges of the hyper-parameter search
RIDGE_ALPHA = (1e-3, 1e4)
FOREST_RANGES = {"trees": (100, 500), "depth": (5, 30), "leaf": (1, 10), "features": ["sqrt", "log2"]}
BOOST_RANGES = {
    "rounds": (100, 1000), "depth": (3, 10), "rate": (0.01, 0.3), "leaf": (1, 10),
    "subsample": (0.5, 1.0), "columns": (0.5, 1.0), "gain": (0.0, 5.0),
}
# fixed values: trials, folds, learning-curve sizes, early-stopping rounds
N_TRIALS, N_FOLDS = 50, 5
CURVE_SHARES = [i / 10 for i in range(1, 11)]
STOPPING_ROUNDS = 50
PARALLEL_FITS = 4
# rows of one part of a tree fit, which holds a number for every feature of a row
TREE_ROWS = 4096


def as_vector(df: DataFrame, bits: str, out: str = "features", n_bits: int = N_BITS) -> DataFrame:
    """Set bits as a sparse vector; the position of a bit is its index."""
    terms = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], "_terms", out)
    terms.setBinary(True)
    return terms.transform(df.withColumn("_terms", F.col(bits).cast("array<string>"))).drop("_terms")


def ridge_estimator(alpha: float, n: int, spread: float, features: str = "features", label: str = "y") -> LinearRegression:
    """Least squares with ``alpha`` times the squared norm added, intercept left free.

    Spark minimises the mean error over a label scaled by its population deviation,
    hence the factor.
    """
    return LinearRegression(
        featuresCol=features, labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False,
        regParam=alpha * (spread or 1.0) / n,
    )


def fit_ridge(train: DataFrame, alpha: float, features: str = "features", label: str = "y") -> Model:
    size = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    model = ridge_estimator(alpha, size.n, size.s, features, label).fit(train)
    few_rows_warning(size.n, model.numFeatures)
    return model


def _parts(train: DataFrame, label: str) -> DataFrame:
    """Features and label in even parts of ``TREE_ROWS`` rows; a table below that stays as it is.

    Stored vectors are short, so a scan puts many in one task, where a tree fit unfolds them.
    """
    rows = train.count()
    return train if rows <= TREE_ROWS else train.select("features", label).repartition(-(-rows // TREE_ROWS))


def fit_forest(train: DataFrame, trees: int, depth: int, leaf: int = 1, columns: str = "sqrt", seed: int = 42, label: str = "y") -> Model:
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
        featureSubsetStrategy=columns, maxBins=32, seed=seed,
    ).fit(_parts(train, label))


def fit_boosted(
    train: DataFrame, rounds: int, depth: int, rate: float = 0.1, leaf: int = 1, subsample: float = 1.0,
    columns: float = 1.0, gain: float = 0.0, seed: int = 42, label: str = "y", validation: str | None = None, patience: int = STOPPING_ROUNDS,
) -> Model:
    """Boosted trees; with a boolean ``validation`` column only the rounds up to that part's least error are kept.

    The error after every round comes from one scan over the held part.  The search for the least one ends when ``patience``
    rounds in a row have not improved on it.  A round depends on earlier ones alone, so fitting with as many rounds as are kept
    gives the same trees again, without the others.
    """
    est = GBTRegressor(
        featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf,
        subsamplingRate=subsample, featureSubsetStrategy=str(columns) if columns < 1 else "all", minInfoGain=gain, seed=seed,
    )
    if validation is None:
        return est.fit(_parts(train, label))
    rest, held = _parts(train.filter(~F.col(validation)), label), train.filter(validation)
    whole = est.fit(rest)
    keep = patient_stop(whole.evaluateEachIteration(held, "squared"), patience)
    return whole if keep == rounds else est.setMaxIter(keep).fit(rest)


def _log(r: random.Random, low: float, high: float) -> float:
    return low * (high / low) ** r.random()


def draw_ridge(r: random.Random) -> dict[str, float]:
    return {"alpha": _log(r, *RIDGE_ALPHA)}


def draw_forest(r: random.Random, ranges: Mapping = FOREST_RANGES) -> dict:
    return {
        "trees": round(_log(r, *ranges["trees"])), "depth": r.randint(*ranges["depth"]),
        "leaf": r.randint(*ranges["leaf"]), "columns": r.choice(ranges["features"]),
    }


def draw_boosted(r: random.Random, ranges: Mapping = BOOST_RANGES) -> dict:
    return {
        "rounds": r.randint(*ranges["rounds"]), "depth": r.randint(*ranges["depth"]), "rate": _log(r, *ranges["rate"]),
        "leaf": r.randint(*ranges["leaf"]), "subsample": r.uniform(*ranges["subsample"]),
        "columns": r.uniform(*ranges["columns"]), "gain": r.uniform(*ranges["gain"]),
    }


TRIAL_SCHEMA = "trial int, fold int, params string, train_mse double, val_mse double, train_r2 double, val_r2 double"


def _fold_row(data: DataFrame, trial: int, fold: int, params: dict, fit: Callable[..., Model], label: str) -> tuple:
    model = fit(data.filter(F.col("fold") != fold), **params)
    scored = model.transform(data).withColumn("_held", F.col("fold") == fold)
    rows = {r["_held"]: r for r in fit_metrics(scored, label, "prediction", ["_held"]).collect()}
    if len(rows) < 2:
        raise ValueError(f"fold {fold} or the rest of it has no rows; use fewer folds")
    t, v = rows[False], rows[True]
    return (trial, fold, json.dumps(params), t.mse, v.mse, t.r2, v.r2)


def search(
    train: DataFrame, ids: Sequence[str], fit: Callable[..., Model], draw: Callable[[random.Random], dict],
    n_trials: int = N_TRIALS, n_folds: int = N_FOLDS, seed: int = 42, label: str = "y",
) -> DataFrame:
    """Seeded random search: one row per trial with its parameters and fold-averaged metrics.

    The folds are assigned once and shared by all trials; the training table is written
    with them, so every fit reads the same rows.
    """
    spark = train.sparkSession
    data = stored(kfold(train, ids, n_folds, seed), "folds")
    r = random.Random(seed)
    drawn = [(t, draw(r)) for t in range(n_trials)]
    jobs = [(t, f, p) for t, p in drawn for f in range(n_folds)]
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(lambda j: _fold_row(data, j[0], j[1], j[2], fit, label), jobs))
    metrics = spark.createDataFrame(rows, TRIAL_SCHEMA)
    return metrics.groupBy("trial", "params").agg(
        *[F.avg(c).alias(c) for c in ("train_mse", "val_mse", "train_r2", "val_r2")]
    )


def refit_best(train: DataFrame, trials: DataFrame, fit: Callable[..., Model], path: str | None = None) -> tuple[Model, dict]:
    """A model on all rows with the best trial's parameters, and its info; both saved below ``path``."""
    best = best_trial(trials).first()
    row = trials.filter(F.col("trial") == best.trial).first()
    model = fit(train, **json.loads(row.params))
    info = {
        "n_rows": train.count(), "trial": row.trial, "params": json.loads(row.params),
        "train_mse": row.train_mse, "val_mse": row.val_mse, "train_r2": row.train_r2, "val_r2": row.val_r2,
    }
    if path is not None:
        PipelineModel([model]).write().overwrite().save(f"{path}/model")
        spark = train.sparkSession
        spark.createDataFrame([(json.dumps(info),)], "info string").write.mode("overwrite").json(f"{path}/info")
    return model, info


def load_model(spark: SparkSession, path: str) -> Model:
    return PipelineModel.load(f"{path}/model")


def batch_score(models: Mapping[str, Model], library: DataFrame, bits: str, name: str = "name", n_bits: int = N_BITS) -> DataFrame:
    """``model, name, score`` of every library row in one scan; rows without a fingerprint get NULL."""
    return score_vectors(models, library_vectors(library, bits, name, n_bits), name)


def library_vectors(library: DataFrame, bits: str, name: str = "name", n_bits: int = N_BITS) -> DataFrame:
    """``name, _known, features``: the vectors of a library, empty where there is no fingerprint; store them to score it often."""
    known = F.col(bits).isNotNull()
    return as_vector(
        library.select(name, known.alias("_known"), F.coalesce(bits, F.array().cast("array<int>")).alias(bits)), bits, n_bits=n_bits
    ).drop(bits)


def score_vectors(models: Mapping[str, Model], rows: DataFrame, name: str = "name") -> DataFrame:
    """:func:`batch_score` of rows from :func:`library_vectors`."""
    for label, model in models.items():
        rows = model.transform(rows).withColumnRenamed("prediction", f"_{label}")
    entries = [
        F.struct(F.lit(m).alias("model"), F.when(F.col("_known"), F.col(f"_{m}")).alias("score")) for m in models
    ]
    return rows.select(name, F.explode(F.array(*entries)).alias("_s")).select("_s.model", name, "_s.score")


def learning_curve(
    train: DataFrame, ids: Sequence[str], fit: Callable[[DataFrame], Model], n_folds: int = N_FOLDS,
    shares: Sequence[float] = tuple(CURVE_SHARES), seed: int = 42, label: str = "y",
) -> DataFrame:
    """``share, fold, n_rows, train_mse, val_mse`` for nested parts of each training fold."""
    spark = train.sparkSession
    folded = kfold(train, ids, n_folds, seed)
    data = stored(hash_positions(folded, ids, f"{seed}/curve", "_p", by=["fold"]), "curve")

    def one(job):
        share, fold = job
        part = data.filter((F.col("fold") != fold) & (F.col("_p") < F.floor(F.col("_p_of") * F.lit(share))))
        model = fit(part)
        fitted = fit_metrics(model.transform(part), label, "prediction").first()
        held = fit_metrics(model.transform(data.filter(F.col("fold") == fold)), label, "prediction").first()
        return (share, fold, part.count(), fitted.mse, held.mse)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(one, [(s, f) for s in shares for f in range(n_folds)]))
    return spark.createDataFrame(rows, "share double, fold int, n_rows long, train_mse double, val_mse double")


def linear_attribution(df: DataFrame, model: Model, names: Sequence[str], row_id: str, features: str = "features") -> DataFrame:
    """``row_id, feature, contribution`` of a linear model: weight times distance from the mean.

    A row's contributions add up to its prediction minus the mean prediction.
    """
    values = vector_to_array(F.col(features))
    wide = df.select(row_id, *[F.get(values, F.lit(i)).alias(f"_{i}") for i in range(len(names))])
    means = wide.agg(F.array(*[F.avg(f"_{i}") for i in range(len(names))])).scalar()
    entries = [
        F.struct(F.lit(n).alias("feature"), (F.lit(float(w)) * (F.col(f"_{i}") - F.get("_means", F.lit(i)))).alias("contribution"))
        for i, (n, w) in enumerate(zip(names, model.coefficients))
    ]
    return wide.withColumn("_means", means).select(row_id, F.explode(F.array(*entries)).alias("_e")).select(row_id, "_e.*")


def attribution_ranking(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
