"""Consensus of several models' predictions and the choice of the next batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.scoring import round_half_even
from assayer.operators.joins import not_in, scores_by_model
from assayer.operators.ranking import average_rank, top_k


def consensus(scores: DataFrame, models: Sequence[str], name: str = "name") -> DataFrame:
    """Scores, per-model average ranks and the mean rank of every name all models scored below zero."""
    models = list(models)
    wide = scores_by_model(scores, models, name)
    long = wide.select(
        name, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_score").alias("score")) for m in models])).alias("_s")
    ).select(name, "_s.model", "_s.score")
    ranked = average_rank(long, "score", "rank", by=["model"])
    out = ranked.groupBy(name).agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"{m}_score") for m in models],
        *[F.max(F.when(F.col("model") == m, F.col("rank"))).alias(f"{m}_rank") for m in models],
    )
    total = sum((F.col(f"{m}_rank") for m in models[1:]), F.col(f"{models[0]}_rank"))
    return out.withColumn("mean_rank", total / float(len(models)))


def select_top(scores: DataFrame, models: Sequence[str], k: int, name: str = "name") -> DataFrame:
    """The k best names: by mean rank with several models, by raw score with one."""
    if len(models) == 1:
        single = scores_by_model(scores, models, name)
        return top_k(single, k, [(f"{models[0]}_score", True), (name, True)])
    return top_k(consensus(scores, models, name), k, [("mean_rank", True), (name, True)])


def next_batch(scores: DataFrame, models: Sequence[str], k: int, ledger: DataFrame, name: str = "name") -> DataFrame:
    """The k best names without those the ledger already holds."""
    return not_in(select_top(scores, models, k, name), ledger, name)


def choose_models(metrics: DataFrame, n: int) -> DataFrame:
    """Round-one choice: drop perfect validation and overfitted training fits, then best validation R2 first."""
    fit = metrics.filter((F.col("r2_val") != 1) & (round_half_even(F.col("r2_train"), 2) < 0.90))
    return fit.orderBy(F.col("r2_val").desc(), F.col("model")).limit(n)


def best_trial(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The trial with the least validation error; the first of equal ones."""
    return trials.groupBy(*by).agg(
        F.min_by("trial", F.struct("val_mse", "trial")).alias("trial"), F.min("val_mse").alias("val_mse")
    )
