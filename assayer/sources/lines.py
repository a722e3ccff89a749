"""Text files as numbered lines or records, without a row-by-row pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# most file blocks whose offsets are sent to every task (about 100 bytes each)
MAX_BLOCKS = 500_000


def read_numbered(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """``file, line_no, value``: every line (or record) with its number from 1 in its file.

    The scan numbers lines within each file block; one small row per block holds how
    many lines precede it.
    """
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    raw = reader.text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    blocks = lines.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = blocks.drop("_n")
    # every scan task opens at most one block it shares with another, so this bounds their number
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= MAX_BLOCKS:
        blocks = F.broadcast(blocks)
    return lines.join(blocks, ["file", "_start"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value"
    )


def count_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines per file, header included."""
    return _counted(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"))


def count_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records per file: lines that start with the record terminator."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return _counted(lines.filter(F.col("value").startswith("$$$$")))


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
