"""The ledger of scored items and its per-round statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scoring import round_half_even
from assayer.operators.cleaning import drop_artifacts
from assayer.operators.ranking import best_n_per_group

# fixed value: share of the initial batch that the statistics look at
STATS_SHARE = 0.96


def fold(new: DataFrame, ledger: DataFrame, unique_by: str | None = None) -> DataFrame:
    """New and old rows, distinct on all columns; or one row per key, the best score."""
    new = drop_artifacts(new.select("item", "name", "score"), "score")
    both = new.unionByName(ledger.select("item", "name", "score"))
    if unique_by is None:
        return both.distinct()
    return both.groupBy(unique_by).agg(F.min(F.struct("score", "item", "name")).alias("_b")).select("_b.item", "_b.name", "_b.score")


def union_rounds(rounds: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """All rounds in one frame with their number."""
    out = None
    for number, df in rounds:
        part = df.withColumn("round", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out


def round_stats(df: DataFrame, n: int | Column, by: str = "round", score: str = "score", tie: str = "name") -> DataFrame:
    """Mean, sample SD, least and greatest of the best n scores of each round, two decimals."""
    best = best_n_per_group(df.select(by, score, tie), [by], score, n, tie)
    return best.groupBy(by).agg(
        round_half_even(F.avg(score), 2).alias("mean"),
        round_half_even(F.stddev_samp(score), 2).alias("sd"),
        round_half_even(F.min(score), 2).alias("min"),
        round_half_even(F.max(score), 2).alias("max"),
    )
