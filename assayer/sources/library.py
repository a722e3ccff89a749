"""Readers for libraries, scored tables, part files, weights and file triples."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.sources.lines import read_numbered

SCORED_SCHEMA = "item string, name string, score double"


def read_library(spark: SparkSession, path: str | list[str], allow_empty: bool = False) -> DataFrame:
    """``item, name, line_no`` from white-space separated lines without header.

    Blank and ``#`` lines are skipped; a line with one token is named after its
    physical line.  A library without any row is an error.
    """
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    out = (
        read_numbered(spark, path)
        .withColumn("_t", tokens)
        .filter((F.get("_t", F.lit(0)) != "") & ~F.get("_t", F.lit(0)).startswith("#"))
        .select(
            F.get("_t", F.lit(0)).alias("item"),
            F.coalesce(F.get("_t", F.lit(1)), F.concat(F.lit("mol_"), F.col("line_no").cast("string"))).alias("name"),
            "line_no",
        )
    )
    # asked of the lines alone, so the scan ends at the first item
    first = F.regexp_extract("value", r"^\s*(\S)", 1)
    if not allow_empty and spark.read.text(path).filter((first != "") & (first != "#")).isEmpty():
        raise ValueError(f"no items in {path}")
    return out


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The strict variant: only lines of exactly two tokens."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return (
        spark.read.text(path)
        .withColumn("_t", tokens)
        .filter(F.size("_t") == 2)
        .select(F.get("_t", F.lit(0)).alias("item"), F.get("_t", F.lit(1)).alias("name"))
    )


def read_scored(spark: SparkSession, path: str | list[str], header: bool, schema: str = SCORED_SCHEMA, sep: str = ",") -> DataFrame:
    """Delimited rows under declared names and types; the header flag is explicit."""
    return spark.read.schema(schema).option("sep", sep).csv(path, header=header)


def read_triples(spark: SparkSession, path: str | list[str], files: int = 3) -> DataFrame:
    """``receptor, ligand, reference`` from lines that name exactly ``files`` structures; others are skipped."""
    parts = F.transform(F.split("value", ";"), lambda p: F.trim(p))
    return (
        spark.read.text(path)
        .filter(F.regexp_count(F.lower("value"), F.lit(r"\.pdbqt")) == files)
        .select(
            F.get(parts, F.lit(0)).alias("receptor"),
            F.get(parts, F.lit(1)).alias("ligand"),
            F.get(parts, F.lit(2)).alias("reference"),
        )
    )


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``component, weight`` from ``name: number`` lines; blank lines are skipped, others must parse."""
    parts = F.split("value", ":")
    parsed = spark.read.text(path).filter(F.trim("value") != "").select(
        F.trim(F.get(parts, F.lit(0))).alias("component"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("weight")
    )
    bad = F.raise_error(F.concat(F.lit("not a weight: "), F.col("component")))
    return parsed.select("component", F.coalesce("weight", F.when(F.col("weight").isNull(), bad)).alias("weight"))


def weights_dict(spark: SparkSession, path: str, most: int = 1000) -> dict[str, float]:
    """The weights as configuration; a longer file is not a weights file."""
    rows = read_weights(spark, path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} holds more than {most} weights")
    return {r.component: r.weight for r in rows}


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``part, line_no, value`` of all part files; a first line that several files share is kept only in the first of them.

    ``part`` is the place in ``paths``, each a file or a folder of files.  All parts are one scan; which part a line belongs to
    comes from its file's name.  Missing parts are skipped; a part that is there but cannot be read is an error, and so is a
    list without any part.
    """
    present = [(i, p) for i, p in enumerate(p for p in paths if p) if _exists(spark, p)]
    if not present:
        raise ValueError("no valid part files")
    lines = read_numbered(spark, [p for _, p in present])
    # as many rows as the caller names parts
    named = F.broadcast(spark.createDataFrame([(i, _plain(p)) for i, p in present], "part int, _at string"))
    file = F.regexp_replace(F.try_url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    files = lines.filter(F.col("line_no") == 1).select("file", F.trim("value").alias("_head"), file.alias("_file"))  # one row per file
    at = F.explode(F.array("_file", F.regexp_replace("_file", "/[^/]*$", "")))
    files = files.withColumn("_at", at).join(named, "_at").select("part", "file", "_head")
    # the line that most files share is the header; ties go to the one that comes first
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "file"))
    files = files.withColumn("_place", place)
    shared = files.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_kept")).filter("_n > 1")
    header = shared.agg(F.min_by(F.struct("_head", "_kept"), F.struct(-F.col("_n"), "_kept"))).scalar()
    repeated = (F.col("_head") == header.getField("_head")) & (F.col("_place") > header.getField("_kept"))
    marked = files.select("part", "file", F.coalesce(repeated, F.lit(False)).alias("_repeated"))
    found = lines.join(marked, "file").filter((F.col("line_no") > 1) | ~F.col("_repeated"))
    return found.select("part", "line_no", "value")


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path).rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
