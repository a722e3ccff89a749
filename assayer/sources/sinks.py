"""Writers: delimited tables, failure folders, fixed-width points, JSON payloads, metric unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.scoring import round_half_even, rounded_for_export


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.csv(path, sep=sep, header=header)


def write_failures(failures: DataFrame, path: str) -> None:
    """``Name, SMILES, Failure_Reason`` as tab-separated files, one folder per failure type."""
    failures.select(
        F.col("name").alias("Name"), F.col("item").alias("SMILES"), F.col("reason").alias("Failure_Reason"), "failure_type"
    ).write.partitionBy("failure_type").csv(path, sep="\t", header=True)


def point_lines(points: DataFrame, serial: str = "n", group: str = "group_id") -> DataFrame:
    """One fixed-width line per point; serials wrap after 99999. ``n`` is the point's number from 1."""
    wrapped = F.pmod(F.col(serial) - 1, F.lit(99999)) + 1
    # fixed value: the layout of a point line
    line = F.format_string(
        "HETATM%5d  C   %3s A   1    %8.3f%8.3f%8.3f  1.00  0.00           C",
        wrapped, F.col(group), F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"),
    )
    return points.select(serial, line.alias("value"))


def write_points(points: DataFrame, path: str, serial: str = "n", group: str = "group_id") -> None:
    """Point lines in serial order as text files."""
    point_lines(points, serial, group).orderBy(serial).select("value").write.text(path)


def top_payload() -> Column:
    """JSON of a finalist row."""
    return F.to_json(
        F.struct(
            F.col("Rank").alias("rank"), F.col("name"), F.col("Composite_Score").alias("score"),
            F.col("Affinity_Numeric").alias("affinity"), F.col("Lipinski_Violations").alias("lipinski_violations"),
            F.col("Filter_Score").alias("filter_score"), F.col("smiles"),
        )
    )


def site_payload() -> Column:
    """JSON of a ranked site with the dashboard's decimals (1, 1, 2, 3, 1; centre 2)."""
    return F.to_json(
        F.struct(
            F.col("id"), F.col("name"), F.col("color"),
            round_half_even(F.col("volume"), 1).alias("volume"),
            round_half_even(F.col("area"), 1).alias("area"),
            round_half_even(F.col("depth"), 2).alias("depth"),
            round_half_even(F.col("hydrophobicity"), 3).alias("hydrophobicity"),
            round_half_even(F.col("rank_score"), 1).alias("score"),
            F.col("rank"),
            (F.col("rank") == 1).alias("is_best"),
            F.array(*[round_half_even(F.col(c), 2) for c in ("cx", "cy", "cz")]).alias("centroid"),
            F.col("n_points"),
        )
    )


def union_metrics(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """All rounds' metrics; the first column becomes ``Rounds`` and orders the rows as text."""
    df = spark.read.schema(schema).csv(paths, header=True)
    return df.withColumnRenamed(df.columns[0], "Rounds").orderBy(F.col("Rounds").cast("string"))


def export_table(df: DataFrame, path: str) -> None:
    """A comma-separated export with fractions rounded to three decimals."""
    write_delimited(rounded_for_export(df), path)
