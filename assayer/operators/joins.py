"""Anti, semi and attach joins of the screening rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the seen ones (which are made distinct first)."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def kept_only(df: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are among the kept ones."""
    return df.join(kept.select(*keys).distinct(), list(keys), "left_semi")


def attach(df: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """Property columns added by key; rows without properties keep NULLs."""
    return df.join(properties, key, "left")


def scores_by_model(scores: DataFrame, models: Sequence[str], name: str = "name") -> DataFrame:
    """Long ``(model, name, score)`` to one column per model; names that lack a negative score anywhere go.

    One shuffle for any number of models, pre-aggregated, so a repeated name is no hot key.
    """
    valid = scores.filter((F.col("score") < 0) & F.col("model").isin(list(models)))
    wide = valid.groupBy(name).agg(
        *[F.min(F.when(F.col("model") == m, F.col("score"))).alias(f"{m}_score") for m in models]
    )
    return wide.dropna(subset=[f"{m}_score" for m in models])
