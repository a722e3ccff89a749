"""Pattern rule sets evaluated per item, without a join.

The rules are configuration (a few hundred patterns at most), so each becomes a
constant-pattern expression: items are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.common import let


class Rule(NamedTuple):
    rule_set: str
    name: str
    pattern: str


def rule_sets(rules: Sequence[Rule]) -> list[str]:
    return list(dict.fromkeys(r.rule_set for r in rules))


def _broken(df: DataFrame, rules: Sequence[Rule]) -> str | None:
    """The error text if a pattern of the set does not compile."""
    probe = df.sparkSession.range(1)
    try:
        probe.select(*[F.lit("").rlike(r.pattern).alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    except Exception as error:  # the pattern compiler raises several kinds
        return str(error).splitlines()[0]
    return None


def _errors(df: DataFrame, rules: Sequence[Rule]) -> dict[str, str | None]:
    """Compile errors per rule set: one probe for all, and one per set only if that fails."""
    if _broken(df, rules) is None:
        return dict.fromkeys(rule_sets(rules))
    return {s: _broken(df, [r for r in rules if r.rule_set == s]) for s in rule_sets(rules)}


def _result(item: Column, name: str, rules: Sequence[Rule], error: str | None) -> Column:
    def outcome(ok: Column, status: Column, reasons: Column) -> Column:
        return F.struct(
            F.lit(name).alias("rule_set"), ok.alias("pass_filter"), status.alias("status"), reasons.alias("reasons")
        )

    if error is not None:
        return outcome(F.lit(False), F.lit("FILTER_ERROR"), F.lit(f"Filter failed: {error}"))
    # a NULL entry for every rule that does not match
    hits = F.array(*[F.when(item.rlike(r.pattern), F.lit(r.name)) for r in rules])
    return let(
        F.array_sort(F.array_distinct(F.array_compact(hits))),
        lambda found: outcome(
            F.size(found) == 0,
            F.when(F.size(found) == 0, F.lit("ok")).otherwise(F.lit("exclude")),
            F.when(F.size(found) > 0, F.array_join(found, ";")),
        ),
    )


def apply_rules(df: DataFrame, item: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per item and rule set: ``rule_set, pass_filter, status, reasons``."""
    results = [
        _result(F.col(item), s, [r for r in rules if r.rule_set == s], error) for s, error in _errors(df, rules).items()
    ]
    return df.withColumn("_r", F.explode(F.array(*results))).select(*df.columns, "_r.*")


def attach_rules(df: DataFrame, item: str, rules: Sequence[Rule]) -> DataFrame:
    """Three columns per rule set: ``<set>_pass_filter``, ``<set>_status``, ``<set>_reasons``."""
    out = df
    for s, error in _errors(df, rules).items():
        out = out.withColumn(f"_{s}", _result(F.col(item), s, [r for r in rules if r.rule_set == s], error))
        for field in ("pass_filter", "status", "reasons"):
            out = out.withColumn(f"{s}_{field}", F.col(f"_{s}.{field}"))
        out = out.drop(f"_{s}")
    return out


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_pass_filter")]


def all_flags_pass(df: DataFrame) -> Column:
    """True where every ``*_pass_filter`` column is true; true without such columns."""
    out = F.lit(True)
    for c in flag_columns(df):
        out = out & F.col(c)
    return out
