"""Multi-record text files: blocks closed by ``$$$$`` with tagged values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.text import default_name, first_number, tag_value
from assayer.operators.ranking import top_k
from assayer.sources.lines import read_numbered

# fixed value: record terminator
TERMINATOR = "$$$$"


def read_records(spark: SparkSession, path: str | list[str], tag: str = "minimizedAffinity") -> DataFrame:
    """``file, ordinal, name, score, block``: non-empty blocks in file order.

    The name is the block's first line, or ``mol_{ordinal}``; the score is the first
    number of the tag, NULL without one.
    """
    raw = read_numbered(spark, path, line_sep=TERMINATOR)
    # the separator's own line end opens every block but a file's first; a blank title line stays
    opened = raw.withColumn(
        "block", F.when(F.col("line_no") > 1, F.regexp_replace("value", r"^\r?\n", "")).otherwise(F.col("value"))
    ).filter(F.trim(F.regexp_replace("block", r"\s+", " ")) != "")
    first_line = F.regexp_extract("block", r"^([^\r\n]*)", 1)
    return opened.select(
        "file",
        F.col("line_no").alias("ordinal"),
        default_name(first_line, F.lit(None).cast("string"), F.col("line_no")).alias("name"),
        first_number(tag_value(F.col("block"), tag)).alias("score"),
        "block",
    )


def reorder_records(records: DataFrame, k: int, higher_better: bool = False) -> DataFrame:
    """The best k scored records, by score and then input order; unscored ones are dropped."""
    scored = records.filter(F.col("score").isNotNull())
    return top_k(scored, k, [("score", not higher_better), ("ordinal", True)])


def write_records(records: DataFrame, path: str, order: list[str]) -> None:
    """Blocks in order, each followed by a blank line and the terminator."""
    text = F.concat(F.regexp_replace("block", r"\s+$", ""), F.lit(f"\n\n{TERMINATOR}"))
    records.orderBy(*order).select(text.alias("value")).write.text(path)


def to_scored(records: DataFrame) -> DataFrame:
    """``name, score`` of records whose score is below zero."""
    return records.filter(F.col("score") < 0).select("name", "score")
