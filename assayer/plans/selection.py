"""The first, diverse sample of a library: descriptor bins, stratified draw, two-stage clustering."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.bits import text_fingerprint
from assayer.functions.scoring import bin_label, digitize
from assayer.operators import sampling
from assayer.operators.ranking import quantiles
from assayer.operators.similarity import two_stage
from assayer.session import stored


def percentile_edges(df: DataFrame, descriptors: Sequence[str], n_bins: int) -> DataFrame:
    """``descriptor, edges``: exact percentile edges of every descriptor in one pass over a long form."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(d).alias("descriptor"), F.col(d).cast("double").alias("value")) for d in descriptors])
        ).alias("_d")
    ).select("_d.*")
    return quantiles(long, "value", [i / n_bins for i in range(n_bins + 1)], by=["descriptor"], out="edges")


def binned(
    df: DataFrame, descriptors: Sequence[str], n_bins: int, label: str = "bin_label", library: DataFrame | None = None
) -> DataFrame:
    """Rows with all descriptors known, labelled by their percentile bins in the ``library`` (default: these rows)."""
    valid = df.dropna(subset=list(descriptors))
    # one map with an entry per descriptor, attached as a scalar subquery
    edges = (
        percentile_edges(valid if library is None else library.dropna(subset=list(descriptors)), descriptors, n_bins)
        .agg(F.map_from_entries(F.collect_list(F.struct("descriptor", "edges"))).alias("m"))
        .scalar()
    )
    placed = valid.withColumn("_edges", edges)
    bins = {d: digitize(F.col(d), F.element_at("_edges", F.lit(d))) for d in descriptors}
    return placed.withColumn(label, bin_label(bins)).drop("_edges")


def uniform_start(df: DataFrame, descriptors: Sequence[str], ids: Sequence[str], share: float, bins: int, seed: int = 42) -> DataFrame:
    """``int(share * rows)`` rows drawn whatever their descriptors, labelled by their bins in the whole library.

    A row with an unknown descriptor can be drawn too; its label is NULL.
    """
    # the sample is small against the library; a stored copy keeps it from being drawn for both kinds of rows
    drawn = stored(sampling.share_sample(df, ids, share, seed), "start")
    # a narrow copy too: descriptors are costly, and each column of the long form would compute them again
    known = binned(drawn, descriptors, bins, library=stored(df.select(*descriptors), "descriptors"))
    # F.isnan fails on other types, so everything is looked at as a double
    unknown = functools.reduce(Column.__or__, [F.col(d).isNull() | F.isnan(F.col(d).cast("double")) for d in descriptors])
    return known.unionByName(drawn.filter(unknown).withColumn("bin_label", F.lit(None).cast("string")))


def stratified_start(df: DataFrame, descriptors: Sequence[str], ids: Sequence[str], share: float, bins: int, seed: int = 42) -> DataFrame:
    """The descriptor-stratified sample of ``int(share * rows)`` rows.

    Descriptors and labels are written once as narrow tables (ids and numbers only),
    since edges, shares and draws each read them.
    """
    narrow = stored(df.select(*ids, *descriptors), "descriptors")
    labels = stored(binned(narrow, descriptors, bins).select(*ids, "bin_label"), "labels")
    drawn = sampling.topped_up_sample(labels, "bin_label", ids, int(share * narrow.count()), seed)
    return df.join(drawn, list(ids))


def select_start(
    df: DataFrame, descriptors: Sequence[str], item_id: str, item: str, plan: sampling.StartPlan, seed: int = 42
) -> DataFrame:
    """The whole first stage by an explicit ``plan`` (see :func:`assayer.operators.sampling.start_plan`).

    ``item_id`` is a unique number that gives the library's order.  A uniform plan draws at once; a stratified one bins the
    descriptors, draws and keeps the founders of two-stage clusters.  Either way the rows come with their ``bin_label``.
    """
    if plan.method == "uniform":
        return uniform_start(df, descriptors, [item_id], plan.share, plan.bins, seed)
    if plan.method != "stratified":
        raise ValueError(f"unknown method {plan.method!r}")
    # the sample is small against the library; a stored copy keeps later steps from redrawing it
    drawn = stored(stratified_start(df, descriptors, [item_id], plan.share, plan.bins, seed), "start")
    prints = drawn.withColumn("_bits", text_fingerprint(F.col(item)))
    return two_stage(prints, item_id, "_bits", item_id, plan.chunk, item).drop("_bits")
