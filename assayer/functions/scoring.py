"""Bins, clipped scores, flags and the weighted composite as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the default weights of the composite score
DEFAULT_WEIGHTS = {
    "Affinity_Score": 0.70,
    "QED_Score": 0.10,
    "SA_Score_Norm": 0.00,
    "Lipinski_Score": 0.10,
    "Filter_Score": 0.10,
}
# fixed values: descriptor limits of the seven-limit rule
SEVEN_LIMITS = {
    "mw": 500,
    "logp": 5,
    "hbd": 5,
    "hba": 10,
    "rotatable_bonds": 10,
    "tpsa": 140,
    "aromatic_rings": 5,
}
# fixed values: names and formats of the limits in the violation text
VIOLATION_FORMATS = {
    "mw": ("MW", "%.1f"),
    "logp": ("LogP", "%.1f"),
    "hbd": ("HBD", "%d"),
    "hba": ("HBA", "%d"),
    "rotatable_bonds": ("RotBonds", "%d"),
    "tpsa": ("TPSA", "%.1f"),
    "aromatic_rings": ("AromaticRings", "%d"),
}
# fixed values: limits of the rule of five and of lead-likeness
RULE_OF_FIVE = {"MW": 500, "LogP": 5, "HBD": 5, "HBA": 10}
LEAD_LIKE = {"MW": 350, "LogP": 3.5, "RotBonds": 7}
# fixed values: affinity range that maps to scores 1 and 0
AFFINITY_BEST, AFFINITY_WORST = -14.0, -4.0


def digitize(value: Column, edges: Column) -> Column:
    """Bin from 0: how many interior edges are at or below the value."""
    interior = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(value.isNotNull(), F.size(F.filter(interior, lambda e: e <= value)))


def bin_label(bins: Mapping[str, Column]) -> Column:
    """``MW_i_logP_j_...``; NULL when any bin is missing."""
    return F.concat(*[part for i, (name, b) in enumerate(bins.items()) for part in (F.lit(f"{'_' if i else ''}{name}_"), b.cast("string"))])


def clip01(value: Column) -> Column:
    """Clipped to [0, 1]; NULL and NaN become 0."""
    return F.coalesce(F.least(F.greatest(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def affinity_score(affinity: Column) -> Column:
    return clip01((AFFINITY_WORST - affinity) / (AFFINITY_WORST - AFFINITY_BEST))


def ease_score(sa: Column) -> Column:
    return clip01((10 - sa) / 9.0)


def violation_score(violations: Column) -> Column:
    return clip01((4 - violations) / 4.0)


def flag_share(flags: Sequence[Column]) -> Column:
    """Share of true flags; 1.0 without flags."""
    if not flags:
        return F.lit(1.0)
    return sum((f.cast("int") for f in flags[1:]), flags[0].cast("int")) / float(len(flags))


def composite(weights: Mapping[str, float], columns: Sequence[str]) -> Column:
    """Weighted sum of component columns; an unknown or absent component is an error."""
    absent = sorted(set(weights) - set(columns))
    missing = sorted(set(DEFAULT_WEIGHTS) - set(weights))
    if absent or missing:
        raise ValueError(f"weights do not fit the components: unknown {absent}, missing {missing}")
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(float(weight))
    return total


def count_over(limits: Mapping[str, float], columns: Mapping[str, Column] | None = None) -> Column:
    """How many values exceed their limits; NULL when any value is NULL."""
    columns = columns or {name: F.col(name) for name in limits}
    total = F.lit(0)
    for name, limit in limits.items():
        total = total + (columns[name] > F.lit(limit)).cast("int")
    return total


def passes_seven_limits(columns: Mapping[str, Column]) -> Column:
    """At most one limit exceeded; a row whose descriptors failed passes."""
    return F.coalesce(count_over(SEVEN_LIMITS, columns) <= 1, F.lit(True))


def violation_text(columns: Mapping[str, Column]) -> Column:
    """``MW=512.3 (>500); ...`` or ``No violations``."""
    parts = []
    for name, limit in SEVEN_LIMITS.items():
        label, fmt = VIOLATION_FORMATS[name]
        value = columns[name].cast("long") if fmt == "%d" else columns[name].cast("double")
        parts.append(F.when(columns[name] > limit, F.format_string(f"{label}={fmt} (>{limit})", value)))
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", F.lit("No violations")).otherwise(text)


def rule_of_five(columns: Mapping[str, Column]) -> dict[str, Column]:
    """Violations, compliance (none) and lead-likeness; failed descriptors are not compliant."""
    violations = count_over(RULE_OF_FIVE, columns)
    lead = F.lit(True)
    for name, limit in LEAD_LIKE.items():
        lead = lead & (columns[name] <= F.lit(limit))
    return {
        "Lipinski_Violations": violations,
        "Lipinski_Compliant": F.coalesce(violations == 0, F.lit(False)),
        "Lead_Like": F.coalesce(lead, F.lit(False)),
    }


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1] in its group; 0.5 when the group is flat."""
    return F.when(low == high, F.lit(0.5)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def round_half_even(value: Column, digits: int) -> Column:
    """Rounded after scaling, halves to even."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def rounded_for_export(df: DataFrame, digits: int = 3) -> DataFrame:
    """All fractional columns rounded half-even."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: round_half_even(F.col(c), digits) for c in fractional})
