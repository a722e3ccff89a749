"""Cleaning a library: first-row dedupe, failure routing and its summary, structure filters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the standard residues
STANDARD_RESIDUES = [
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY",
    "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER",
    "THR", "TRP", "TYR", "VAL",
]
# fixed values: tolerances of the zero-coordinate and 3-D checks
ZERO_TOLERANCE = 1e-6
DEPTH_TOLERANCE = 0.001


class Check(NamedTuple):
    failure_type: str
    fails: Column
    reason: Column


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The earliest row per key; each task keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def dedupe_library(df: DataFrame, item: str = "item", name: str = "name", order: str = "line_no") -> DataFrame:
    """First row per item, then first row per name among those.

    Which rows stay is decided on digests, names and order alone; the rows themselves are moved once, by the join with those
    that stay.
    """
    rows = df.withColumn("_digest", F.unhex(F.sha2(F.col(item).cast("string"), 256)))
    firsts = keep_first(keep_first(rows.select("_digest", name, order), ["_digest"], order), [name], order)
    stay = firsts.select(F.col(name).alias("_name"), F.col(order).alias("_order"), F.col("_digest").alias("_item"))
    on = rows["_digest"].eqNullSafe(stay["_item"]) & F.col(name).eqNullSafe(F.col("_name")) & F.col(order).eqNullSafe(F.col("_order"))
    # rows that agree in item, name and order are one
    return rows.join(stay, on, "left_semi").dropDuplicates(["_digest"]).drop("_digest")


def drop_null_and_trim(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.dropna(subset=list(columns))
    return out.withColumns({c: F.trim(F.col(c)) for c in columns})


def route_failures(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Add ``failure_type`` and ``reason`` of the first failing check; both NULL on clean rows."""
    kind, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(checks):
        fails = F.coalesce(c.fails, F.lit(False))
        kind = F.when(fails, F.lit(c.failure_type)).otherwise(kind)
        reason = F.when(fails, c.reason).otherwise(reason)
    return df.withColumns({"failure_type": kind, "reason": reason})


def clean_rows(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("failure_type").isNull()).drop("failure_type", "reason")


def failed_rows(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("failure_type").isNotNull())


def failure_summary(routed: DataFrame) -> DataFrame:
    """Failed rows per type, types with none left out."""
    return failed_rows(routed).groupBy("failure_type").agg(F.count(F.lit(1)).alias("n_failed"))


def success_rates(routed: DataFrame, duplicates: Column | int = 0) -> DataFrame:
    """Both rates in percent: of all input rows, and of the input without duplicates."""
    duplicates = F.lit(duplicates) if isinstance(duplicates, int) else duplicates
    counts = routed.agg(
        F.count(F.lit(1)).alias("n_checked"), F.count("failure_type").alias("n_failed")
    ).withColumn("n_input", F.col("n_checked") + duplicates)
    final = F.col("n_checked") - F.col("n_failed")
    return counts.select(
        "n_input",
        "n_failed",
        (F.try_divide(F.col("n_input") - F.col("n_failed"), F.col("n_input")) * 100).alias("success_of_input"),
        (F.try_divide(final, F.col("n_checked")) * 100).alias("success_of_unique"),
    )


def drop_artifacts(df: DataFrame, score: str) -> DataFrame:
    """Only scores below zero; NULL and NaN go too."""
    return df.filter(F.col(score) < 0)


def _extent(x: str, y: str, z: str) -> Column:
    return F.greatest(F.abs(F.col(x)), F.abs(F.col(y)), F.abs(F.col(z)))


def coordinate_audit(atoms: DataFrame, item: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Per item: whether every atom is at the origin, has coordinates, and is 3-D."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()
    return atoms.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_atoms"),
        (F.count_if(~known) > 0).alias("has_error"),
        F.coalesce(F.max(F.when(known, _extent(x, y, z))) < ZERO_TOLERANCE, F.lit(False)).alias("all_zero"),
        F.coalesce(F.max(F.abs(F.col(z))) > DEPTH_TOLERANCE, F.lit(False)).alias("is_3d"),
    )


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("all_zero").alias("n_zero"),
        F.count_if("has_error").alias("n_error"),
        F.count_if(~F.col("all_zero") & ~F.col("has_error")).alias("n_valid"),
    )


def drop_zero_coordinates(atoms: DataFrame, item: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Atoms of items that have at least one atom away from the origin."""
    placed = atoms.groupBy(item).agg(F.max(_extent(x, y, z)).alias("_m")).filter(F.col("_m") >= ZERO_TOLERANCE)
    return atoms.join(placed.select(item), item, "left_semi")


def standard_residues(df: DataFrame, resname: str = "resname") -> DataFrame:
    return df.filter(F.col(resname).isin(STANDARD_RESIDUES))


def structure_census(df: DataFrame, by: Sequence[str], chain: str, residue: Sequence[str], element: str) -> DataFrame:
    """Chains, residues, atoms and hydrogens, counted over pre-aggregated residues."""
    residues = df.groupBy(*by, chain, *residue).agg(
        F.count(F.lit(1)).alias("_atoms"), F.count_if(F.col(element) == "H").alias("_hydrogens")
    )
    chains = residues.groupBy(*by, chain).agg(
        F.count(F.lit(1)).alias("_residues"), F.sum("_atoms").alias("_atoms"), F.sum("_hydrogens").alias("_hydrogens")
    )
    return chains.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chains"),
        F.sum("_residues").alias("n_residues"),
        F.sum("_atoms").alias("n_atoms"),
        F.sum("_hydrogens").alias("n_hydrogens"),
    )
