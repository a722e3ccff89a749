"""Readers for structure files: atoms, score-term logs, site reports, residues and centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.ranking import carry_forward
from assayer.sources.lines import read_numbered

# fixed values: atom type codes; every other type is 1000
ATOM_TYPES = {
    "C": 0, "A": 0, "N": 1, "NA": 1, "OA": 2, "S": 3, "SA": 3,
    "P": 4, "F": 5, "Cl": 6, "Br": 7, "I": 8,
}
OTHER_TYPE = 1000
# fixed values: names and patterns of the fields of a site report
SITE_FIELDS = {
    "volume": r"^\s*Volume\s*:\s*([-+0-9.eE]+)",
    "total_sasa": r"(?i)^\s*Total\s+SASA\s*:\s*([-+0-9.eE]+)",
    "mean_local_hydrophobic_density": r"(?i)^\s*Mean\s+local\s+hydrophobic\s+density\s*:\s*([-+0-9.eE]+)",
    "hydrophobicity_score": r"(?i)^\s*Hydrophobicity\s+score\s*:\s*([-+0-9.eE]+)",
    "druggability_score": r"(?i)^\s*Druggability\s+Score\s*:\s*([-+0-9.eE]+)",
}
SITE_HEADER = r"^\s*Pocket\s+(\d+)\s*:"


def _columns(start: int, end: int) -> Column:
    return F.substring("value", start + 1, end - start)


def _is_atom() -> Column:
    return F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")


def read_atoms(spark: SparkSession, path: str | list[str], stop_at: str | None = None) -> DataFrame:
    """``file, line_no, x, y, z, type`` of fixed-width atom lines, per file up to the first ``stop_at`` line."""
    lines = read_numbered(spark, path)
    if stop_at is not None:
        stop = lines.filter(F.col("value").startswith(stop_at)).groupBy("file").agg(F.min("line_no").alias("_stop"))
        lines = lines.join(stop, "file", "left").filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
    codes = F.create_map(*[F.lit(v) for pair in ATOM_TYPES.items() for v in pair])
    element = F.rtrim(F.substring("value", 78, 1000))
    atom_line = F.col("value").startswith("ATOM  ") | F.col("value").startswith("HETATM")
    return lines.filter(atom_line).select(
        "file",
        "line_no",
        F.trim(_columns(30, 38)).cast("double").alias("x"),
        F.trim(_columns(38, 46)).cast("double").alias("y"),
        F.trim(_columns(46, 54)).cast("double").alias("z"),
        F.coalesce(F.try_element_at(codes, element), F.lit(OTHER_TYPE)).alias("type"),
    )


def read_terms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, term1..term5`` from the second ``##`` line of each log."""
    marked = read_numbered(spark, path).filter(F.contains("value", F.lit("##")))
    second = Window.partitionBy("file").orderBy("line_no")
    parts = F.split("value", " ")
    return (
        marked.withColumn("_n", F.row_number().over(second))
        .filter(F.col("_n") <= 2)
        .filter(F.col("_n") == 2)
        .select("file", *[F.get(parts, F.lit(i + 1)).cast("double").alias(f"term{i}") for i in range(1, 6)])
    )


def section_fields(lines: DataFrame, header: str, fields: dict[str, str], by: str = "file", order: str = "line_no") -> DataFrame:
    """One row per section: its header value and the last number of each field below it.

    Lines before the first header belong to no section; a field whose text is no number is left out.
    """
    head = F.nullif(F.regexp_extract("value", header, 1), F.lit(""))
    found = {f"_{name}": F.regexp_extract("value", p, 1).try_cast("double") for name, p in fields.items()}
    wanted = lines.withColumns({"_head": F.when(head.isNotNull(), F.struct(F.col(order).alias("at"), head.alias("v"))), **found})
    wanted = wanted.filter(
        F.col("_head").isNotNull() | F.coalesce(*[F.col(f"_{name}") for name in fields]).isNotNull()
    ).select(by, order, "_head", *[f"_{name}" for name in fields])
    sections = carry_forward(wanted, [by], order, "_head", "_section").filter(F.col("_section").isNotNull())
    last = [
        F.max_by(F.col(f"_{name}"), F.when(F.col(f"_{name}").isNotNull(), F.col(order))).alias(name) for name in fields
    ]
    return sections.groupBy(by, "_section").agg(*last).select(
        by, F.col("_section.at").alias("header_line"), F.col("_section.v").alias("section"), *fields
    )


def read_site_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, header_line, section, <five fields>`` per reported site."""
    return section_fields(read_numbered(spark, path), SITE_HEADER, SITE_FIELDS)


def distinct_residues(lines: DataFrame, by: str = "file", order: str = "line_no") -> DataFrame:
    """``by, chain, resnum, resname, first_line`` of atom lines; short lines and bad numbers are skipped."""
    return (
        lines.filter(_is_atom() & (F.length("value") >= 27))
        .select(
            by,
            order,
            F.coalesce(F.nullif(F.trim(_columns(21, 22)), F.lit("")), F.lit("A")).alias("chain"),
            F.trim(_columns(22, 26)).try_cast("int").alias("resnum"),
            F.trim(_columns(17, 20)).alias("resname"),
        )
        .filter(F.col("resnum").isNotNull())
        .groupBy(by, "chain", "resnum", "resname")
        .agg(F.min(order).alias("first_line"))
    )


def read_residues(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return distinct_residues(read_numbered(spark, path))


def read_centres(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, x, y, z`` by fixed columns, else by white-space fields 6 to 8, else skipped."""
    fixed = [F.trim(_columns(a, a + 8)).try_cast("double") for a in (30, 38, 46)]
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    spaced = [F.get(fields, F.lit(i)).try_cast("double") for i in (5, 6, 7)]

    def whole(parts):
        ok = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
        return F.when(ok, F.struct(*[p.alias(a) for p, a in zip(parts, "xyz")]))

    return (
        read_numbered(spark, path)
        .filter(_is_atom())
        .withColumn("_p", F.coalesce(whole(fixed), whole(spaced)))
        .filter(F.col("_p").isNotNull())
        .select("file", "line_no", "_p.x", "_p.y", "_p.z")
    )
