"""Affinity scores of structure pairs from contact counts and score terms."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.scoring import round_half_even
from assayer.operators.geometry import TERMS, contact_features, contacts, feature_names, with_terms


def feature_table(
    item_atoms: DataFrame, receptor_atoms: DataFrame, terms: DataFrame, complex_id: str = "complex_id", receptor_id: str | None = None
) -> DataFrame:
    """41 features per complex, all complexes in one job."""
    found = contacts(item_atoms, receptor_atoms, complex_id, receptor_id)
    counts = contact_features(found, item_atoms, complex_id)
    return with_terms(counts, terms, complex_id)


def as_features(table: DataFrame, out: str = "features") -> DataFrame:
    """The 41 columns as one vector (renamed, since a vector assembler cannot address dotted or bracketed names)."""
    names = feature_names() + TERMS
    plain = table.select(*[c for c in table.columns if c not in names], *[F.col(f"`{n}`").alias(f"_f{i}") for i, n in enumerate(names)])
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol=out).transform(plain)


def score_complexes(table: DataFrame, model: Model, complex_id: str = "complex_id") -> tuple[DataFrame, DataFrame]:
    """The features and the predicted affinities, both with four decimals."""
    names = feature_names() + TERMS
    rounded = table.select(complex_id, *[round_half_even(F.col(f"`{n}`"), 4).alias(n) for n in names])
    scored = model.transform(as_features(table)).select(complex_id, round_half_even(F.col("prediction"), 4).alias("predicted_affinity"))
    return rounded, scored
