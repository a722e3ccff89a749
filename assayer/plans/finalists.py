"""Ranking of finalists: descriptors, pattern rules, composite score, flags and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import scoring
from assayer.functions.rules import Rule, all_flags_pass, attach_rules, flag_columns
from assayer.operators.ranking import dense_rank, top_k
from assayer.session import stored

# fixed values: columns of the top export, before the flags
EXPORT_COLUMNS = [
    "Rank", "name", "smiles", "Composite_Score", "Affinity_Numeric", "MW", "LogP", "HBD", "HBA", "TPSA",
    "RotBonds", "QED", "SA_Score", "Lipinski_Compliant", "Lead_Like", "Lipinski_Violations",
]


def with_component_scores(df: DataFrame) -> DataFrame:
    """The five component scores from affinity, QED, SA, violations and the pass flags."""
    flags = [F.col(c) for c in flag_columns(df)]
    number = F.col("minimizedAffinity").cast("string").try_cast("double")
    return df.withColumn("Affinity_Numeric", number).withColumns(
        {
            "Affinity_Score": scoring.affinity_score(F.col("Affinity_Numeric")),
            "QED_Score": F.coalesce(F.nanvl(F.col("QED").cast("double"), F.lit(None).cast("double")), F.lit(0.0)),
            "SA_Score_Norm": scoring.ease_score(F.col("SA_Score").cast("double")),
            "Lipinski_Score": scoring.violation_score(F.col("Lipinski_Violations").cast("double")),
            "Filter_Score": scoring.flag_share(flags),
        }
    )


def with_composite(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    weights = scoring.DEFAULT_WEIGHTS if weights is None else weights
    return df.withColumn("Composite_Score", scoring.composite(weights, df.columns))


def rank_finalists(
    df: DataFrame, item: str, rules: Sequence[Rule], weights: Mapping[str, float] | None = None
) -> DataFrame:
    """All finalists with rule columns, component scores, ``Composite_Score`` and the dense ``Rank``.

    The scored rows are written once, so the rules run once per item however often the
    rank and the reports read them.
    """
    scored = stored(with_composite(with_component_scores(attach_rules(df, item, rules)), weights), "finalists")
    return dense_rank(scored, "Composite_Score", "Rank", descending=True)


def top_finalists(ranked: DataFrame, n: int, order: str = "name", passing: bool = False) -> DataFrame:
    """The n best by composite score (ties by input order), optionally of those that pass every rule.

    The overall rank is kept.
    """
    pool = ranked.filter(all_flags_pass(ranked)) if passing else ranked
    return top_k(pool, n, [("Composite_Score", False), (order, True)])


def export_view(top: DataFrame) -> DataFrame:
    """The export's columns, fractions rounded to three decimals."""
    wanted = [c for c in EXPORT_COLUMNS if c in top.columns] + flag_columns(top)
    return scoring.rounded_for_export(top.select(*wanted))


def passing(ranked: DataFrame) -> DataFrame:
    return ranked.filter(all_flags_pass(ranked))


def rule_violations(columns: Mapping[str, Column]) -> dict[str, Column]:
    """The four rule-of-five conditions under their display names."""
    return {f"{name} > {limit}": columns[name] > limit for name, limit in scoring.RULE_OF_FIVE.items()}
