"""Exact ranks, quantiles, positions and top-k over whole tables, without a one-task window.

The shared building block is a range partitioning: rows (or distinct values with counts, so that a hot value is one row) are
dealt over contiguous ranges of their order, as many as the session's shuffle makes of their bytes, and stored with the
number of their range.  Each range is summed in its own window group, and a small table of range totals supplies what
stands before it.  Any cut gives the exact answer; where the cuts lie only steers balance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.skew import attach_by_key
from assayer.session import stored

SMALL_K = 10_000


def _sorts(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def _ranged(rows: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """``rows`` stored with ``_range``, the number of the contiguous range of (group, order) each lies in."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in by], *_sorts(order))
    return stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def _range_offsets(ranged: DataFrame, by: Sequence[str], n: Column) -> DataFrame:
    """Rows and values before each range; a row per range, and one more per further group in it."""
    totals = ranged.groupBy(*by, "_range").agg(F.sum(n).alias("_rows"), F.count(F.lit(1)).alias("_values"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by, "_range", "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_values").over(before), F.lit(0)).alias("_values_before"),
        F.sum("_rows").over(group).alias("pos_total"),
        F.sum("_values").over(group).alias("pos_distinct"),
    )


def _join_offsets(ranged: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    # ungrouped offsets have one row per range, so the broadcast is bounded
    return ranged.join(offsets if by else F.broadcast(offsets), [*by, "_range"])


def value_positions(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null value (per group).

    Columns: ``*by, value, pos_n`` (rows with that value), ``pos_before`` (rows with a
    smaller one), ``pos_index`` (distinct smaller values), ``pos_total`` and ``pos_distinct``.
    """
    by = list(by)
    present = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = _ranged(present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("pos_n")), by, [(value, True)])
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("_local", F.coalesce(F.sum("pos_n").over(running), F.lit(0))).withColumn(
        "_local_index", F.row_number().over(inside) - 1
    )
    return _join_offsets(local, _range_offsets(counts, by, F.col("pos_n")).drop("_rows"), by).select(
        *by,
        value,
        "pos_n",
        (F.col("_rows_before") + F.col("_local")).alias("pos_before"),
        (F.col("_values_before") + F.col("_local_index")).alias("pos_index"),
        "pos_total",
        "pos_distinct",
    )


def places(rows: DataFrame, order: Sequence[tuple[str, bool]], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Narrow ``rows`` with their place from 0 in the order ``[(column, ascending), ...]`` (of their group); no two rows tie."""
    by = list(by)
    ranged = _ranged(rows, by, order)
    local = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*_sorts(order))) - 1
    offsets = _range_offsets(ranged, by, F.lit(1)).select(*by, "_range", "_rows_before")
    placed = _join_offsets(ranged.withColumn("_local", local), offsets, by)
    return placed.select(*rows.columns, (F.col("_rows_before") + F.col("_local")).alias(out))


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Rank from 1 with ties averaged; NULL and NaN get a NULL rank."""
    pos = value_positions(df, value, by)
    low = F.col("pos_total") - F.col("pos_before") - F.col("pos_n") if descending else F.col("pos_before")
    table = pos.select(*by, value, "pos_n", (low + (F.col("pos_n") + 1) / 2.0).alias(out))
    return attach_by_key(df, table, [*by, value], [out])


def dense_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Dense rank from 1 over distinct values; NULL and NaN get a NULL rank."""
    pos = value_positions(df, value, by)
    place = F.col("pos_distinct") - F.col("pos_index") if descending else F.col("pos_index") + 1
    table = pos.select(*by, value, "pos_n", place.cast("long").alias(out))
    return attach_by_key(df, table, [*by, value], [out])


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation as one array column per group."""
    by = list(by)
    pos = value_positions(df, value, by)
    v = F.col(value).cast("double")
    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("pos_total") - 1) * F.lit(float(p))
        for name, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("pos_before") <= at) & (at < F.col("pos_before") + F.col("pos_n"))
            aggs.append(F.max(F.when(hit, v)).alias(f"_{name}{i}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_f{i}"))
    grouped = pos.groupBy(*by).agg(*aggs)
    points = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}") for i in range(len(probs))
    ]
    return grouped.select(*by, F.array(*points).alias(out))


def row_positions(df: DataFrame, order: str, out: str) -> DataFrame:
    """Position from 0 of every row in the order of a column whose values are unique."""
    return df.join(places(df.select(order), [(order, True)], out), order).select(*df.columns, out)


def top_k(df: DataFrame, k: int, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first ``k`` rows by ``[(column, ascending), ...]``; the last column must break every tie.

    Rows without a value (NULL or NaN) in the first column never qualify.  In later columns NULL stands below and NaN
    above every number, so NULL comes first ascending and last descending; a NULL text counts as empty.

    Small k is a plain top-k, which keeps k rows per task.  A large k (a share of the
    library) finds the sort keys of the last row that qualifies and filters on them, so
    no block of k rows passes the driver.  Both follow the same rule.
    """
    if k <= SMALL_K:
        made, keys = _sort_keys(df, order)
        return made.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys]).limit(k).select(*df.columns)
    return best_share(df, F.lit(k), order)


def best_share(df: DataFrame, k: Column, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """``top_k`` for a k that is itself computed (a scalar subquery), always by the last row that qualifies.

    The sort keys alone are dealt over ranges of their whole order, so rows that tie in the first columns lie in many
    ranges.  Counts tell which range holds the k-th row; its keys are the cut, and one filter over ``df`` follows.
    """
    made, keys = _sort_keys(df, order)
    ranged = _ranged(made.select(*dict.fromkeys(c for c, _ in keys)), [], keys)
    last = _range_offsets(ranged, [], F.lit(1)).filter((F.col("_rows_before") < k) & (F.col("_rows_before") + F.col("_rows") >= k))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*_sorts(keys)))
    inside = ranged.join(F.broadcast(last.select("_range", "_rows_before")), "_range").withColumn("_place", place)  # one range
    cut = inside.filter(F.col("_rows_before") + F.col("_place") == k).agg(F.max(F.struct(*[c for c, _ in keys])).alias("c")).scalar()
    first = F.lit(True)
    for column, up in reversed(keys):
        at = cut.getField(column)
        first = (F.col(column) < at if up else F.col(column) > at) | ((F.col(column) == at) & first)
    return made.filter((k > 0) & (cut.isNull() | first)).select(*df.columns)


def _sort_keys(df: DataFrame, order: Sequence[tuple[str, bool]]) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The rows with a value in the first column, and sort keys without NULL or NaN for the columns of ``order``."""
    kinds, keys = dict(df.dtypes), []
    for i, (column, up) in enumerate(order):
        value, float_like = F.col(column), kinds[column] in ("double", "float")
        if i == 0:
            df = df.filter(value.isNotNull() & ~F.isnan(value) if float_like else value.isNotNull())
        elif kinds[column] != "string" and i < len(order) - 1:  # the last one breaks every tie, so it has a value
            side = F.when(value.isNull(), 0).when(F.isnan(value) if float_like else F.lit(False), 2).otherwise(1)
            df = df.withColumn(f"_side{i}", side)
            keys.append((f"_side{i}", up))
        if kinds[column] == "string":
            df = df.withColumn(f"_by{i}", F.coalesce(value, F.lit("")))
        elif float_like:
            df = df.withColumn(f"_by{i}", F.when(F.isnan(value), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0))))
        else:
            df = df.withColumn(f"_by{i}", F.coalesce(value, F.lit(0).cast(kinds[column])) if i else value)
        keys.append((f"_by{i}", up))
    return df, keys


def best_n_per_group(
    df: DataFrame, by: Sequence[str], value: str, n: int | Column, tie: str, descending: bool = False
) -> DataFrame:
    """The ``n`` lowest (or highest) values of each group; rows equal at the cut go by the unique ``tie``."""
    by = list(by)
    present = df.filter(F.col(value).isNotNull())
    placed = places(present.select(*dict.fromkeys([*by, value, tie])), [(value, not descending), (tie, True)], "_place", by)
    kept = placed.filter(F.col("_place") < (F.lit(n) if isinstance(n, int) else n))
    return present.join(kept.select(*dict.fromkeys([*by, tie])), list(dict.fromkeys([*by, tie])), "left_semi")


def ordered_rank(df: DataFrame, value: str, tie: str, out: str, by: Sequence[str], descending: bool = False) -> DataFrame:
    """Rank from 1 without ties: by value, then by the unique ``tie``; a row without a value has no rank."""
    by = list(by)
    keys = list(dict.fromkeys([*by, tie]))
    present = df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*by, value, tie]))
    placed = places(present, [(value, not descending), (tie, True)], "_place", by).select(*keys, "_place")
    return df.join(placed, keys, "left").withColumn(out, (F.col("_place") + 1).cast("long")).drop("_place")


def carry_forward(df: DataFrame, by: Sequence[str], order: str, value: str, out: str, block: int = 100_000) -> DataFrame:
    """Last non-null value at or before each row, per group, with long groups cut into blocks."""
    by = list(by)
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    last = cut.groupBy(*by, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    so_far = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(carried, [*by, "_block"])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.col("_carry")))
        .select(*df.columns, out)
    )
