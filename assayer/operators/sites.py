"""Ranking of candidate sites within each structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scoring import min_max
from assayer.functions.text import base26_id
from assayer.operators.ranking import ordered_rank

# fixed values: weights of the site score, least volume
SITE_WEIGHTS = {"volume": 0.35, "area": 0.30, "depth": 0.25, "hydrophobicity": 0.10}
MIN_VOLUME = 100.0


def large_enough(sites: DataFrame, structure: str, min_volume: float = MIN_VOLUME) -> DataFrame:
    """Sites of at least the volume; all sites of a structure that has no such site."""
    largest = sites.groupBy(structure).agg(F.max("volume").alias("_largest"))
    kept = (F.col("volume") >= min_volume) | (F.col("_largest") < min_volume)
    return sites.join(largest, structure).filter(kept).drop("_largest")


def label_sites(sites: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Id, name and colour from the site's position (from 0) in its structure's report."""
    # a light colour per position: each channel walks its upper range by its own step
    red, green, blue = (F.pmod(F.col(ordinal) * step + start, F.lit(160)).cast("int") + 96 for step, start in ((67, 20), (101, 120), (43, 70)))
    return sites.withColumns(
        {
            "id": base26_id(F.col(ordinal)),
            "name": F.concat(F.lit("Pocket "), (F.col(ordinal) + 1).cast("string")),
            "color": F.format_string("#%02X%02X%02X", red, green, blue),
        }
    )


def rank_sites(
    sites: DataFrame, structure: str, ordinal: str = "ordinal", min_volume: float = MIN_VOLUME, top_n: int | None = None
) -> DataFrame:
    """Labelled sites that are large enough, with ``rank_score`` and ``rank`` per structure.

    The score weighs volume, area, depth and hydrophobicity scaled over the kept sites.
    """
    kept = large_enough(label_sites(sites, ordinal), structure, min_volume)
    ends = kept.groupBy(structure).agg(
        *[f(m).alias(f"_{n}_{m}") for m in SITE_WEIGHTS for n, f in (("lo", F.min), ("hi", F.max))]
    )
    score = F.lit(0.0)
    for m, weight in SITE_WEIGHTS.items():
        score = score + F.lit(weight) * min_max(F.col(m), F.col(f"_lo_{m}"), F.col(f"_hi_{m}"))
    scored = kept.join(ends, structure).withColumn("rank_score", score * 100).select(*kept.columns, "rank_score")
    ranked = ordered_rank(scored, "rank_score", ordinal, "rank", [structure], descending=True)
    return ranked if top_n is None else ranked.filter(F.col("rank") <= top_n)


def with_ordinal(df: DataFrame, structure: str, order: str, out: str = "ordinal") -> DataFrame:
    """Position from 0 within a structure; a structure's report is a short list."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(structure).orderBy(order)) - 1)
