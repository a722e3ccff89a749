"""Model fits, search, scoring, attribution and the active-learning loop."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from assayer.catalog.registry import query, spread, table
from assayer.catalog.structure_queries import N_COMPLEXES, atoms, terms
from assayer.functions import bits as fp
from assayer.operators import sampling, stats
from assayer.plans import affinity, crossval, loop, models
from assayer.session import fresh_path, stored

WIDTH = fp.N_BITS
ALPHA, SEED = 10.0, 42


def _numeric(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.avg("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"),
        F.avg("l_extendedprice").alias("y"),
    )
    return VectorAssembler(inputCols=["quantity", "lines"], outputCol="features").transform(p)


# the closed form of a two-feature ridge
_RIDGE_SQL = f"""
  d AS (SELECT l_partkey AS part, avg(l_quantity) AS q, count(*)::DOUBLE AS c, avg(l_extendedprice) AS y FROM lineitem GROUP BY l_partkey),
  m AS (SELECT avg(q) AS mq, avg(c) AS mc, avg(y) AS my FROM d),
  s AS (SELECT sum((q - mq) * (q - mq)) + {ALPHA} AS s11, sum((c - mc) * (c - mc)) + {ALPHA} AS s22, sum((q - mq) * (c - mc)) AS s12,
               sum((q - mq) * (y - my)) AS s1y, sum((c - mc) * (y - my)) AS s2y FROM d, m),
  w AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS w1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS w2 FROM s)"""


@query(
    "ridge_fit",
    f"""WITH {_RIDGE_SQL} SELECT round(w1, 4) AS w_quantity, round(w2, 4) AS w_lines, round(my - w1 * mq - w2 * mc, 3) AS intercept FROM w, m""",
)
def _ridge_fit(spark, sf):
    data = stored(_numeric(spark, sf), "numeric")
    model = models.fit_ridge(data, ALPHA)
    row = (float(model.coefficients[0]), float(model.coefficients[1]), float(model.intercept))
    return spark.createDataFrame([row], "w_quantity double, w_lines double, intercept double").select(
        F.round("w_quantity", 4).alias("w_quantity"), F.round("w_lines", 4).alias("w_lines"), F.round("intercept", 3).alias("intercept")
    )


def _attribution(spark, sf):
    data = stored(_numeric(spark, sf), "numeric")
    return models.linear_attribution(data, models.fit_ridge(data, ALPHA), ["quantity", "lines"], "part")


@query(
    "attribution",
    f"""WITH {_RIDGE_SQL} SELECT part, 'quantity' AS feature, round(w1 * (q - mq), 3) + 0.0::DOUBLE AS contribution FROM d, m, w
        UNION ALL SELECT part, 'lines', round(w2 * (c - mc), 3) + 0.0::DOUBLE FROM d, m, w""",
)
def _attribution_rows(spark, sf):
    return _attribution(spark, sf).withColumn("contribution", F.round("contribution", 3) + 0.0)


@query(
    "attribution_ranking",
    f"""WITH {_RIDGE_SQL} SELECT 'quantity' AS feature, round(avg(abs(w1 * (q - mq))), 4) AS mean_abs FROM d, m, w
        UNION ALL SELECT 'lines', round(avg(abs(w2 * (c - mc))), 4) FROM d, m, w""",
)
def _attribution_ranking(spark, sf):
    return models.attribution_ranking(_attribution(spark, sf)).withColumn("mean_abs", F.round("mean_abs", 4))


def prints(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("name"), F.col("text").alias("item"), fp.text_fingerprint(F.col("text"), WIDTH).alias("bits"))


def labelled(spark, sf, n_folds=None):
    """All labelled documents as sparse fingerprints with their quality, written once; with ``n_folds`` also their fold.

    Folds are dealt before texts become vectors, which are several times as long.
    """
    y = table(spark, sf, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("double").alias("y"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), "text").join(y, "name")
    d = d if n_folds is None else sampling.kfold(d, ["name"], n_folds)
    kept = ["name", "y"] if n_folds is None else ["name", "y", "fold"]
    known = d.select(*kept, fp.text_fingerprint(F.col("text"), WIDTH).alias("bits"))
    return stored(models.as_vector(known, "bits", n_bits=WIDTH).select("name", "features", *kept[1:]), "labelled")


def _fit_rows(spark, sf, fit):
    data = labelled(spark, sf, 3)
    model = fit(data.filter("fold <> 0"))
    scored = model.transform(data).withColumn("held_out", F.col("fold") == 0)
    return stats.fit_report(scored, "y", "prediction", ["held_out"])


@query("ridge_on_prints")
def _ridge_on_prints(spark, sf):
    return _fit_rows(spark, sf, lambda d: models.fit_ridge(d, ALPHA))


@query("forest_fit")
def _forest_fit(spark, sf):
    return _fit_rows(spark, sf, lambda d: models.fit_forest(d, trees=20, depth=6))


@query("boosted_fit")
def _boosted_fit(spark, sf):
    return _fit_rows(spark, sf, lambda d: models.fit_boosted(d, rounds=8, depth=3))


@query("boosted_early_stop")
def _boosted_early_stop(spark, sf):
    """Boosting with the usual patience: how many rounds are kept, and the error of each part."""
    data = stored(sampling.train_test(_numeric(spark, sf), ["part"], 0.15, out="side").withColumn("held", F.col("side") == "test"), "sides")
    model = models.fit_boosted(data, rounds=60, depth=3, validation="held")
    return stats.fit_report(model.transform(data), "y", "prediction", ["held"]).withColumn("rounds", F.lit(model.getNumTrees))


def _draws(draw, n=models.N_TRIALS):
    r = random.Random(SEED)
    return [draw(r) for _ in range(n)]


# folds of the numeric table and, per held fold, the sums that the closed form of a two-feature ridge needs
_FOLDS_SQL = f"""
  d AS (SELECT l_partkey AS part, avg(l_quantity) AS q, count(*)::DOUBLE AS c, avg(l_extendedprice) AS y FROM lineitem GROUP BY l_partkey),
  f AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}|' || part), part) - 1) % 5 AS fold FROM d)"""
_SOLVE_SQL = """(s1y * (s22 + alpha) - s2y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1,
               (s2y * (s11 + alpha) - s1y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2"""
_SPREADS_SQL = """avg(q) AS mq, avg(c) AS mc, avg(y) AS my, var_pop(q) * count(*) AS s11, var_pop(c) * count(*) AS s22,
               covar_pop(q, c) * count(*) AS s12, covar_pop(q, y) * count(*) AS s1y, covar_pop(c, y) * count(*) AS s2y"""


@query(
    "ridge_search",
    f"""WITH {_FOLDS_SQL},
          t(trial, alpha) AS (VALUES {", ".join(f"({i}, {d['alpha']!r}::DOUBLE)" for i, d in enumerate(_draws(models.draw_ridge)))}),
          s AS (SELECT h.fold AS held, {_SPREADS_SQL} FROM (SELECT DISTINCT fold FROM f) h JOIN f ON f.fold <> h.fold GROUP BY h.fold),
          w AS (SELECT trial, alpha, held, mq, mc, my, {_SOLVE_SQL} FROM s, t),
          e AS (SELECT trial, held, fold = held AS out, avg((y - my - w1 * (q - mq) - w2 * (c - mc)) ** 2) AS mse,
                       1 - avg((y - my - w1 * (q - mq) - w2 * (c - mc)) ** 2) / var_pop(y) AS r2 FROM w, f GROUP BY ALL)
        SELECT trial, round(avg(mse) FILTER (NOT out), 2) AS train_mse, round(avg(mse) FILTER (out), 2) AS val_mse,
               round(avg(r2) FILTER (NOT out), 7) AS train_r2, round(avg(r2) FILTER (out), 7) AS val_r2 FROM e GROUP BY trial""",
)
def _ridge_search(spark, sf):
    """50 penalties in 5 folds from one pass over the rows."""
    trials = crossval.search_ridge(stored(_numeric(spark, sf), "numeric"), ["part"], models.draw_ridge, models.N_TRIALS, models.N_FOLDS, SEED)
    return trials.select("trial", *[F.round(c, 2).alias(c) for c in ("train_mse", "val_mse")], *[F.round(c, 7).alias(c) for c in ("train_r2", "val_r2")])


@query(
    "knn_search",
    f"""WITH signs AS (SELECT vec_id, label::DOUBLE AS y, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
          f AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}|' || vec_id), vec_id) - 1) % 5 AS fold FROM signs),
          dist AS (SELECT q.fold, q.vec_id, q.y AS own, t.vec_id AS other, t.y, len(q.bits) + len(t.bits) - 2 * len(list_intersect(q.bits, t.bits)) AS d
                   FROM f q JOIN f t ON q.fold <> t.fold),
          near AS (SELECT *, row_number() OVER w AS k, avg(y) OVER w AS uniform, avg(CASE WHEN d = 0 THEN y END) OVER w AS exact,
                     sum(CASE WHEN d > 0 THEN y / d END) OVER w / sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d END) OVER w AS inverse
                   FROM dist WINDOW w AS (PARTITION BY vec_id ORDER BY d, other ROWS UNBOUNDED PRECEDING)),
          p AS (SELECT fold, k, 'uniform' AS weights, own, uniform AS p FROM near WHERE k <= 50
                UNION ALL SELECT fold, k, 'distance', own, coalesce(exact, inverse) FROM near WHERE k <= 50),
          e AS (SELECT k, weights, fold, avg((own - p) ** 2) AS mse, 1 - avg((own - p) ** 2) / var_pop(own) AS r2 FROM p GROUP BY ALL)
        SELECT k, weights, round(avg(mse), 9) AS val_mse, round(avg(r2), 9) AS val_r2 FROM e GROUP BY ALL""",
)
def _knn_search(spark, sf):
    """Every k up to 50 with both weightings in 5 folds, from one list of 50 neighbours per row."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", fp.sign_bits(F.col("embedding"), 64).alias("bits"))
    grid = crossval.knn_grid(e, "vec_id", "bits", "label", models.N_FOLDS, 50, SEED, 64)
    return grid.select("k", "weights", F.round("val_mse", 9).alias("val_mse"), F.round("val_r2", 9).alias("val_r2"))


@query("search_trials")
def _search_trials(spark, sf):
    return crossval.search_ridge(labelled(spark, sf), ["name"], models.draw_ridge)


@query("refit_best")
def _refit_best(spark, sf):
    """The best trial refitted on all rows, saved, loaded and its info as a row."""
    train = labelled(spark, sf)
    path = fresh_path(spark, "model")
    trials = crossval.search_ridge(train, ["name"], models.draw_ridge)
    _, info = models.refit_best(train, stored(trials, "trials"), models.fit_ridge, path)
    again = stats.fit_metrics(models.load_model(spark, path).transform(train), "y", "prediction")
    return again.select("mse", "r2", F.lit(info["n_rows"]).alias("n_rows"), F.lit(json.dumps(info["params"])).alias("params"))


@query(
    "learning_curve",
    f"""WITH {_FOLDS_SQL},
          p AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('{SEED}/curve|' || part), part) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS of FROM f),
          sh(share) AS (VALUES {", ".join(f"({s!r}::DOUBLE)" for s in models.CURVE_SHARES)}),
          part AS (SELECT share, h.fold AS held, p.* FROM sh, (SELECT DISTINCT fold FROM f) h JOIN p ON p.fold <> h.fold WHERE pos < floor(of * share)),
          s AS (SELECT share, held, {ALPHA}::DOUBLE AS alpha, count(*) AS n_rows, {_SPREADS_SQL} FROM part GROUP BY ALL),
          w AS (SELECT share, held, n_rows, mq, mc, my, {_SOLVE_SQL} FROM s),
          a AS (SELECT share, held, avg((y - my - w1 * (q - mq) - w2 * (c - mc)) ** 2) AS train_mse FROM w JOIN part USING (share, held) GROUP BY ALL),
          v AS (SELECT share, held, n_rows, avg((y - my - w1 * (q - mq) - w2 * (c - mc)) ** 2) AS val_mse FROM w JOIN f ON f.fold = w.held GROUP BY ALL)
        SELECT share, held::INTEGER AS fold, n_rows, round(train_mse, 2) AS train_mse, round(val_mse, 2) AS val_mse FROM a JOIN v USING (share, held)""",
)
def _learning_curve(spark, sf):
    """Ten sizes in five folds, each fold's rows read once."""
    curve = crossval.ridge_curve(stored(_numeric(spark, sf), "numeric"), ["part"], ALPHA, models.N_FOLDS, models.CURVE_SHARES, SEED)
    return curve.select("share", "fold", "n_rows", F.round("train_mse", 2).alias("train_mse"), F.round("val_mse", 2).alias("val_mse"))


@query("batch_score")
def _batch_score(spark, sf):
    """Two models over the whole library in one scan."""
    train = labelled(spark, sf)
    fits = {"ri": models.fit_ridge(train, ALPHA), "rf": models.fit_forest(train, trees=10, depth=5)}
    return models.batch_score(fits, prints(spark, sf), "bits", n_bits=WIDTH)


@query("affinity_scores")
def _affinity_scores(spark, sf):
    """41 features of every complex; a boosted model trained on four of five complexes scores the others."""
    a = atoms(spark, sf)
    table_41 = stored(affinity.feature_table(a.filter("is_item"), a.filter("NOT is_item"), terms(spark, sf)), "features")
    y = table(spark, sf, "orders").groupBy((F.col("o_custkey") % N_COMPLEXES).alias("complex_id")).agg((F.avg("o_totalprice") / 1e5).alias("y"))
    train = affinity.as_features(table_41.filter("complex_id % 5 != 0")).select("complex_id", "features").join(y, "complex_id")
    model = models.fit_boosted(train, rounds=20, depth=3)
    return affinity.score_complexes(table_41.filter("complex_id % 5 = 0"), model)[1]


def text_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for the expensive scorer: depends on the whole item, lower is better."""
    return pd.DataFrame({"name": batch["name"], "score": -(batch["item"].str.len() % 97) / 10.0 - 0.5})


@query("scorer_hook", "SELECT doc_id AS name, round(-(length(text) % 97) / 10.0::DOUBLE - 0.5, 6) AS score FROM documents")
def _scorer_hook(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("item"))
    return loop.score_items(d, text_scorer, spark.sparkContext.defaultParallelism).select("name", F.round("score", 6).alias("score"))


@query(
    "featuriser_hook",
    """SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE length(text)::DOUBLE END AS size,
              CASE WHEN length(text) % 5 = 0 THEN NULL ELSE (length(text) - length(replace(text, 'e', '')))::DOUBLE END AS es FROM documents""",
)
def _featuriser_hook(spark, sf):
    def features(items: pd.Series) -> pd.DataFrame:
        if len(items) == 1 and len(items.iloc[0]) % 5 == 0:
            raise ValueError("unreadable item")
        if (items.str.len() % 5 == 0).any():
            raise ValueError("a batch with an unreadable item")
        return pd.DataFrame({"size": items.str.len().astype(float), "es": items.str.count("e").astype(float)})

    d = table(spark, sf, "documents").select("doc_id", "text")
    return loop.with_features(d, features, "text", "size double, es double").drop("text")


def active_loop(spark, sf, rounds=5):
    library = prints(spark, sf)
    start = sampling.share_sample(library.select("item", "name"), ["name"], 0.1)
    fits = {
        "ri": lambda d: models.fit_ridge(d, ALPHA),
        "rf": lambda d: models.fit_forest(d, trees=10, depth=5),
    }
    return loop.run_rounds(library, start, lambda b: loop.score_items(b, text_scorer, spark.sparkContext.defaultParallelism), fits, rounds, n_bits=WIDTH)


@query("active_loop")
def _active_loop(spark, sf):
    return active_loop(spark, sf)[0].select("name", "score", "round")


@query("active_loop_stats")
def _active_loop_stats(spark, sf):
    return active_loop(spark, sf)[1]
