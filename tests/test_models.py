import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from assayer.operators import sampling, stats
from assayer.plans import crossval, loop, models
from assayer.session import shared_dir


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    x = r.random((60, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + r.normal(0, 0.1, 60)
    rows = [(i, Vectors.dense(v.tolist()), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["name", "features", "y"]).cache(), x, y


@pytest.mark.parametrize("alpha", [0.01, 5.0])
def test_ridge_equals_closed_form(data, alpha):
    df, x, y = data
    model = models.fit_ridge(df, alpha)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w) and np.isclose(model.intercept, y.mean() - x.mean(0) @ w)


def test_attribution_adds_up(data):
    df, _, y = data
    model = models.fit_ridge(df, 1.0)
    parts = models.linear_attribution(df, model, list("abcd"), "name")
    total = {r.name: r.s for r in parts.groupBy("name").agg(F.sum("contribution").alias("s")).collect()}
    preds = {r.name: r.prediction for r in model.transform(df).collect()}
    mean = np.mean(list(preds.values()))
    assert all(total[n] == pytest.approx(p - mean) for n, p in preds.items())
    assert models.attribution_ranking(parts).count() == 4


def test_search_is_seeded_and_refit_loads(spark, data, tmp_path):
    df, _, _ = data
    run = lambda: models.search(df, ["name"], models.fit_ridge, models.draw_ridge, n_trials=3, n_folds=2)
    a, b = run(), run()
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 3
    model, info = models.refit_best(df, a, models.fit_ridge, str(tmp_path))
    best = min(a.collect(), key=lambda r: (r.val_mse, r.trial))
    assert info["trial"] == best.trial and info["n_rows"] == 60
    again = models.load_model(spark, str(tmp_path)).transform(df).select("name", "prediction")
    assert again.exceptAll(model.transform(df).select("name", "prediction")).count() == 0


def test_learning_curve_sizes(data):
    df, _, _ = data
    rows = models.learning_curve(df, ["name"], lambda d: models.fit_ridge(d, 1.0), n_folds=2, shares=(0.5, 1.0)).collect()
    assert sorted((r.share, r.fold, r.n_rows) for r in rows) == [(0.5, 0, 15), (0.5, 1, 15), (1.0, 0, 30), (1.0, 1, 30)]


def test_draws_stay_in_range():
    import random

    r = random.Random(0)
    for _ in range(50):
        assert 1e-3 <= models.draw_ridge(r)["alpha"] <= 1e4
        assert 100 <= models.draw_forest(r)["trees"] <= 500
        assert 0.01 <= models.draw_boosted(r)["rate"] <= 0.3


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    m = stats.fit_metrics(df, "y", "p").first()
    assert m.mse == pytest.approx(1.25 / 3) and m.r2 == pytest.approx(1 - 1.25 / 2)


def test_unreadable_rows_are_scored_null(spark, data):
    train = spark.createDataFrame([(str(i), [i % 8], float(i % 3)) for i in range(30)], "name string, bits array<int>, y double")
    model = models.fit_ridge(models.as_vector(train, "bits", n_bits=8), 1.0)
    lib = spark.createDataFrame([("a", [1]), ("b", None), ("c", [])], "name string, bits array<int>")
    got = {r.name: r.score for r in models.batch_score({"m": model}, lib, "bits", n_bits=8).collect()}
    assert got["b"] is None and got["a"] is not None and got["c"] == pytest.approx(model.intercept)


def test_scorer_errors(spark):
    def broken(batch):
        raise RuntimeError("no licence")

    df = spark.createDataFrame([("i", "n")], "item string, name string")
    assert loop.score_items(df, broken, 1, strict=False).first().reason == "no licence"
    with pytest.raises(Exception, match="no licence"):
        loop.score_items(df, broken, 1).collect()


def test_rounds(spark):
    rows = [(f"m{i}", "x" * (i % 37 + 1), [i % 16, (i * 7) % 16]) for i in range(200)]
    library = spark.createDataFrame(rows, "name string, item string, bits array<int>")
    start = sampling.uniform_sample(library.select("item", "name"), ["name"], 20)

    def score(batch):
        return batch.withColumn("score", -F.length("item") / 10.0)

    fits = {"ri": lambda d: models.fit_ridge(d, 1.0), "rf": lambda d: models.fit_forest(d, 3, 3)}
    ledger, stats_rows = loop.run_rounds(library, start, score, fits, rounds=2, n_bits=16)
    assert ledger.select("name").distinct().count() == ledger.count()
    assert ledger.filter("round = 0").count() == 20
    assert all(n <= 20 for n in [r["count"] for r in ledger.groupBy("round").count().collect()])
    by = {r.round: r for r in stats_rows.collect()}
    assert set(by) == {0, 1, 2} and by[2]["mean"] <= by[0]["mean"]

    def silent(batch):
        return batch.withColumn("score", F.lit(None).cast("double"))

    with pytest.raises(RuntimeError):
        loop.run_rounds(library, start, silent, fits, rounds=1, n_bits=16)


def test_a_broken_run_goes_on_after_its_last_whole_step(spark, tmp_path):
    rows = [(f"m{i}", "x" * (i % 37 + 1), [i % 16, (i * 7) % 16]) for i in range(200)]
    library = spark.createDataFrame(rows, "name string, item string, bits array<int>")
    start = sampling.uniform_sample(library.select("item", "name"), ["name"], 20)
    fits = {"ri": lambda d: models.fit_ridge(d, 1.0), "rf": lambda d: models.fit_forest(d, 3, 3)}
    scored, calls = [], []

    def score(batch):
        names = [r.name for r in batch.collect()]
        calls.append(len(names))
        if breaks and len(calls) == 3:
            raise RuntimeError("the machine is gone")
        scored.extend(names)
        return batch.withColumn("score", -F.length("item") / 10.0)

    breaks = True
    with pytest.raises(RuntimeError, match="gone"):
        loop.run_rounds(library, start, score, fits, rounds=3, n_bits=16, folder=str(tmp_path / "a"))
    assert len(calls) == 3  # in round 2
    breaks = False
    ledger, stats_rows = loop.run_rounds(library, start, score, fits, rounds=3, n_bits=16, folder=str(tmp_path / "a"))
    assert len(calls) == 5 and len(scored) == len(set(scored))  # rounds 0 and 1 are read back, 2 and 3 are scored
    whole, whole_stats = loop.run_rounds(library, start, score, fits, rounds=3, n_bits=16, folder=str(tmp_path / "b"))
    assert sorted(map(str, ledger.collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, stats_rows.collect())) == sorted(map(str, whole_stats.collect()))
    # a third start has nothing left to score
    loop.run_rounds(library, start, None, fits, rounds=3, n_bits=16, folder=str(tmp_path / "a"))


def test_failing_items_are_found_by_halving(spark):
    import pandas as pd

    def features(items):
        if items.isin(["bad", "worse"]).any():
            raise ValueError("unreadable" if len(items) == 1 else "a batch")
        return pd.DataFrame({"size": items.str.len().astype(float)})

    df = spark.createDataFrame([(i, "bad" if i in (3, 40) else "worse" if i == 41 else "x" * i) for i in range(60)], "i int, item string").coalesce(1)
    got = {r.i: (r.size, r.why) for r in loop.with_features(df, features, "item", "size double", "why").collect()}
    assert all(got[i] == ((None, "unreadable") if i in (3, 40, 41) else (float(i), None)) for i in range(60))


def test_ridge_search_equals_a_fit_per_trial(spark, data):
    df, _, _ = data
    got = crossval.search_ridge(df, ["name"], models.draw_ridge, 6, 4).collect()
    want = {r.trial: r for r in models.search(df, ["name"], models.fit_ridge, models.draw_ridge, 6, 4).collect()}
    for r in got:
        assert r.params == want[r.trial].params
        assert [r.train_mse, r.val_mse, r.train_r2, r.val_r2] == pytest.approx([want[r.trial][c] for c in ("train_mse", "val_mse", "train_r2", "val_r2")], rel=1e-6)


def test_ridge_search_reads_rows_once_for_any_number_of_trials(spark, data):
    df, _, _ = data
    jobs = []
    for n in (1, 50):
        spark.sparkContext.setJobGroup(f"trials-{n}", "count jobs")
        crossval.search_ridge(df, ["name"], models.draw_ridge, n)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trials-{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0


def test_moments_of_sparse_and_dense_rows(spark):
    rows = [(0, Vectors.sparse(5, [1, 3], [2.0, 1.0]), 1.0), (0, Vectors.dense([1, 0, 0, 2, 0]), 3.0), (1, Vectors.sparse(5, [], []), 2.0), (1, Vectors.dense([0, 0, 0, 0, 1]), None)]
    df = spark.createDataFrame(rows, ["fold", "features", "y"]).repartition(3)
    got = crossval.moments(df, ["fold"], 5)
    x = np.array([[0, 2, 0, 1, 0], [1, 0, 0, 2, 0]], float)
    assert np.allclose(got[0,].gram, x.T @ x) and np.allclose(got[0,].sxy, x.T @ [1, 3]) and (got[0,].n, got[0,].sy, got[0,].syy) == (2, 4, 10)
    assert got[1,].n == 1 and not got[1,].gram.any()
    with pytest.raises(ValueError):
        crossval.moments(df, ["fold"], crossval.MOST_FEATURES + 1)


def test_ridge_curve_equals_fits_on_nested_parts(data):
    df, _, _ = data
    want = models.learning_curve(df, ["name"], lambda d: models.fit_ridge(d, 1.0), n_folds=3, shares=(0.3, 0.7, 1.0)).collect()
    got = crossval.ridge_curve(df, ["name"], 1.0, 3, (0.3, 0.7, 1.0)).collect()
    key = lambda r: (r.share, r.fold)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and (a.train_mse, a.val_mse) == pytest.approx((b.train_mse, b.val_mse), rel=1e-6)


def test_few_rows_are_warned_of(data):
    df, _, _ = data
    with pytest.warns(UserWarning, match="only 30 rows"):
        models.fit_ridge(df.limit(30), 1.0)


def test_patience():
    assert crossval.patient_stop([5, 4, 3, 3, 3, 2], 3) == 6 and crossval.patient_stop([5, 4, 3, 3, 3, 2], 2) == 3
    assert crossval.patient_stop([5, 4, 3, 3, 2, 9, 9, 9, 1], 3) == 5
    assert crossval.patient_stop([1.0], 50) == 1 and crossval.patient_stop([3, 2, 1], 1) == 3


def test_boosting_stops_where_the_error_list_says(data):
    df, _, _ = data
    sides = df.withColumn("held", F.col("name") % 4 == 0)
    whole = models.fit_boosted(sides.filter("NOT held"), 12, 2)
    errors = whole.evaluateEachIteration(sides.filter("held"), "squared")
    by_hand = []
    for n in range(1, 13):  # the sum of the first trees, one by one
        part = sum(w * np.array([t.predict(r.features) for r in sides.filter("held").collect()]) for t, w in zip(whole.trees[:n], whole.treeWeights[:n]))
        by_hand.append(float(((part - np.array([r.y for r in sides.filter("held").collect()])) ** 2).mean()))
    assert errors == pytest.approx(by_hand)
    for patience in (1, 3):
        kept = models.fit_boosted(sides, 12, 2, validation="held", patience=patience)
        want = next((int(np.argmin(errors[: i + 1])) + 1 for i in range(12) if i - int(np.argmin(errors[: i + 1])) >= patience), int(np.argmin(errors)) + 1)
        assert kept.getNumTrees == want
        assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:want]]


def test_knn_grid_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, sorted({int(b) for b in r.integers(0, 12, 4)}), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, bits array<int>, y double")
    fold = {x.id: x.fold for x in sampling.kfold(df, ["id"], 4, 42).collect()}
    got = {(x.k, x.weights): (x.val_mse, x.val_r2) for x in crossval.knn_grid(df, "id", "bits", "y", 4, 6, 42, 12).collect()}
    assert set(got) == {(k, w) for k in range(1, 7) for w in ("uniform", "distance")}
    for (k, w), (mse, _) in got.items():
        errors = {}
        for i, b, y in rows:
            near = sorted((len(set(b) ^ set(c)), j, z) for j, c, z in rows if fold[j] != fold[i])[:k]
            exact = [z for d, _, z in near if d == 0]
            if w == "uniform":
                p = sum(z for *_, z in near) / k
            else:
                p = sum(exact) / len(exact) if exact else sum(z / d for d, _, z in near) / sum(1 / d for d, *_ in near)
            errors.setdefault(fold[i], []).append((p - y) ** 2)
        assert mse == pytest.approx(np.mean([np.mean(e) for e in errors.values()]))
    trials = crossval.search_knn(spark.createDataFrame([(k, w, *v) for (k, w), v in got.items()], "k int, weights string, val_mse double, val_r2 double"), 10)
    assert trials.count() == 10


def test_shared_folder_follows_the_session(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            return self.value if key == "spark.checkpoint.dir" else default

    class Session:
        sparkContext = spark.sparkContext

        def __init__(self, value):
            self.conf = Conf(value)

    assert shared_dir(Session("hdfs://shared/folder")) == "hdfs://shared/folder"
    # unset: the session's checkpoint folder, made once
    assert shared_dir(Session(None)) == shared_dir(Session(None)) == spark.sparkContext.getCheckpointDir()


def test_tree_fits_are_dealt_over_even_parts(spark, monkeypatch):
    """Many short rows in one file part: no part of the fit holds more than its share."""
    data = models.as_vector(spark.range(100).selectExpr("array(cast(id % 8 as int)) AS b", "double(id % 8) AS y").coalesce(1), "b", n_bits=8)
    monkeypatch.setattr(models, "TREE_ROWS", 20)
    parts = []
    for est in (models.GBTRegressor, models.RandomForestRegressor):
        monkeypatch.setattr(est, "fit", lambda self, df: parts.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]))
    models.fit_boosted(data, rounds=1, depth=1)
    models.fit_forest(data, trees=1, depth=1)
    assert [len(p) for p in parts] == [5, 5] and max(map(max, parts)) <= 25


def test_rounds_make_vectors_once(spark, monkeypatch):
    """Two rounds with a model each: the library becomes vectors once, not in every fit and every scoring."""
    library = spark.createDataFrame([(i, f"text {i}", [i % 8, 8 + i % 3]) for i in range(40)], "name long, item string, bits array<int>")
    made, as_vector = [], models.as_vector
    monkeypatch.setattr(models, "as_vector", lambda *a, **k: made.append(1) or as_vector(*a, **k))

    def score(batch):
        return batch.select("item", "name", (-(F.col("name") % 7) - 1.0).alias("score"))

    ledger, _ = loop.run_rounds(library, library.filter("name < 6"), score, {"rf": lambda d: models.fit_forest(d, 2, 2)}, 2, n_bits=16)
    assert ledger.count() > 6 and len(made) == 1
