"""Reproducible sampling and partition assignment by hash order.

Every draw orders rows by ``md5(seed|id)``, so it does not depend on partitioning,
engine or run.  The key's first hex digits cut the order into even buckets; counts per
bucket say which buckets lie inside the quota, and only those are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.joins import not_in
from assayer.operators.ranking import row_positions
from assayer.session import stored

# hex digits of the key that make a bucket: over the table, and within each group
WIDE, NARROW = 4, 3

# fixed values: library sizes that change the sampling strategy
HUGE_LIBRARY, SMALL_LIBRARY = 2_000_000, 10_000
HUGE_SHARE, SMALL_SHARE = 0.01, 0.1
# fixed values: (rows below, percentile bins) and (rows below, cluster chunk; None is one chunk)
BIN_STEPS = [(1000, 3), (100_000, 5), (math.inf, 7)]
CHUNK_STEPS = [(10_000, None), (100_000, 3000), (math.inf, 1500)]
MAX_CHUNK = 10_000


def hash_key(seed: int | str, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


class StartPlan(NamedTuple):
    """How the first sample is drawn: ``uniform`` or ``stratified``, its share of the rows, percentile bins, rows per cluster chunk."""

    method: str
    share: float
    bins: int
    chunk: int


def start_plan(n_rows: int, share: float) -> StartPlan:
    """The plan for a library of this size; take it as it is or ``_replace`` what should be otherwise.

    A huge library is drawn uniformly at a share of its own, a small one at a tenth at least.  The chunk follows from the sample.
    """
    method, share = strategy(n_rows, share)
    return StartPlan(method, share, bins_for(n_rows), cluster_chunk_for(int(share * n_rows)))


def strategy(n_rows: int, share: float) -> tuple[str, float]:
    """How a library of this size is sampled: ``uniform`` or ``stratified``, and the share."""
    if n_rows > HUGE_LIBRARY:
        return "uniform", HUGE_SHARE
    if n_rows < SMALL_LIBRARY and share < SMALL_SHARE:
        return "stratified", SMALL_SHARE
    return "stratified", share


def bins_for(n_rows: int) -> int:
    return next(bins for below, bins in BIN_STEPS if n_rows < below)


def cluster_chunk_for(n_rows: int) -> int:
    size = next(size for below, size in CHUNK_STEPS if n_rows < below)
    return max(n_rows, 1) if size is None else size


def _slots(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket, per group, and the group and table totals."""
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_group_n"),
    )


def _ordered(df: DataFrame, ids: Sequence[str], seed: int | str, by: Sequence[str], quota: Column | None) -> DataFrame:
    """Position of each row in hash order within its group, up to the quota if there is one."""
    width = NARROW if by else WIDE
    keyed = df.withColumn("_key", hash_key(seed, *ids)).withColumn("_bucket", F.substring("_key", 1, width))
    slots = _slots(keyed.select(*by, "_bucket"), by)
    # without groups there is at most one slot per hex prefix, a bounded broadcast
    side = slots if by else F.broadcast(slots)
    placed = keyed.join(side, [*by, "_bucket"])
    if quota is not None:
        placed = placed.withColumn("_quota", quota).filter(F.col("_before") < F.col("_quota"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", *ids)
    return placed.withColumn("_pos", F.col("_before") + F.row_number().over(inside) - 1)


def hash_positions(df: DataFrame, ids: Sequence[str], seed: int | str, out: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """Position from 0 in hash order, over the table or per group."""
    placed = _ordered(df, ids, seed, by, None)
    return placed.select(*df.columns, F.col("_pos").alias(out), F.col("_group_n").alias(f"{out}_of"))


def uniform_sample(df: DataFrame, ids: Sequence[str], n: int | Column, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer)."""
    quota = F.lit(n) if isinstance(n, int) else n
    return _ordered(df, ids, seed, [], quota).filter(F.col("_pos") < F.col("_quota")).select(*df.columns)


def share_sample(df: DataFrame, ids: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """Exactly ``int(share * rows)`` rows."""
    placed = _ordered(df, ids, seed, [], F.floor(F.col("_group_n") * F.lit(share)))
    return placed.filter(F.col("_pos") < F.col("_quota")).select(*df.columns)


def label_counts(df: DataFrame, label: str, min_size: int = 2) -> DataFrame:
    """Rows and share of every label that has at least ``min_size`` rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def stratified_sample(
    df: DataFrame, label: str, ids: Sequence[str], n_samples: int, seed: int = 42, min_size: int = 2
) -> DataFrame:
    """Each label's share of ``n_samples`` (rounded half-even), labels below ``min_size`` left out."""
    placed_quota = F.least(F.rint(F.col("share") * F.lit(float(n_samples))).cast("long"), F.col("_group_n"))
    shares = label_counts(df, label, min_size).select(label, "share")
    kept = df.join(shares, label)
    placed = _ordered(kept, ids, seed, [label], placed_quota)
    return placed.filter(F.col("_pos") < F.col("_quota")).select(*df.columns)


def topped_up_sample(
    df: DataFrame, label: str, ids: Sequence[str], n_samples: int, seed: int = 42, min_size: int = 2
) -> DataFrame:
    """The stratified sample, filled up to ``n_samples`` from the other rows of valid labels."""
    # the draw is read three times below: as rows, as the gap, and as what the rest must not hold
    drawn = stored(stratified_sample(df, label, ids, n_samples, seed, min_size), "drawn")
    valid = df.join(label_counts(df, label, min_size).select(label), label, "left_semi")
    rest = not_in(valid, drawn, ids[0])
    # the gap stays a scalar subquery: nothing is counted on the driver
    gap = drawn.agg(F.greatest(F.lit(n_samples) - F.count(F.lit(1)), F.lit(0))).scalar()
    return drawn.unionByName(uniform_sample(rest, ids, gap, seed).select(*df.columns))


def chunks(df: DataFrame, order: str, n_chunks: int, out: str = "chunk", most: int | None = MAX_CHUNK) -> DataFrame:
    """Contiguous chunks of ``ceil(rows / n_chunks)`` rows, numbered from 1.

    No chunk holds more than ``most`` rows, so a larger table has more chunks than asked for; None asks for exactly ``n_chunks``.
    """
    size = F.ceil(F.col("_rows") / F.lit(n_chunks))
    size = size if most is None else F.least(size, F.lit(most))
    placed = row_positions(df, order, "_pos").withColumn("_rows", df.agg(F.count(F.lit(1))).scalar())
    return placed.select(*df.columns, (F.floor(F.col("_pos") / size) + 1).cast("long").alias(out))


def kfold(df: DataFrame, ids: Sequence[str], k: int = 5, seed: int | str = 42, out: str = "fold") -> DataFrame:
    """Shuffled, balanced, disjoint folds 0..k-1."""
    placed = hash_positions(df, ids, seed, "_p")
    return placed.select(*df.columns, F.pmod("_p", F.lit(k)).cast("int").alias(out))


def repeated_kfold(df: DataFrame, ids: Sequence[str], k: int = 5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """One k-fold assignment per repeat, each under its own seed."""
    out = None
    for r in range(repeats):
        part = kfold(df, ids, k, f"{seed}/{r}").withColumn("repeat", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out


def train_test(df: DataFrame, ids: Sequence[str], test_share: float = 0.2, seed: int = 42, out: str = "part") -> DataFrame:
    """``test`` for the first ``ceil(share * rows)`` rows in hash order, else ``train``."""
    placed = hash_positions(df, ids, seed, "_p")
    is_test = F.col("_p") < F.ceil(F.col("_p_of") * F.lit(test_share))
    return placed.select(*df.columns, F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias(out))
