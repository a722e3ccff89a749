"""Metrics, distributions and summaries as single grouped passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ranking import quantiles

GRID_POINTS = 512
# beyond this many bandwidths exp(-z*z/2) is 0.0 in double precision
KERNEL_REACH = 39.0


def fit_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE and R2 of predictions per group."""
    residual = F.sum(F.pow(F.col(y) - F.col(p), 2.0))
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.avg(F.pow(F.col(y) - F.col(p), 2.0)).alias("mse"), (1 - F.try_divide(residual, spread)).alias("r2")
    )


def fit_report(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson R, RMSE, R2 and MAE of predictions per group."""
    error = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(
        F.corr(y, p).alias("pearson_r"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
    )


def fold_average(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of metric columns over the folds of each trial."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation, each pair over the rows where both are known."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [(a, b, F.col(f"_{i}")), (b, a, F.col(f"_{i}"))]
    cells += [(c, c, F.lit(1.0)) for c in columns]
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r")) for a, b, r in cells]
    return row.select(F.explode(F.array(*entries)).alias("_c")).select("_c.*")


def exceed_percent(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Percent of rows on which each rule holds; NULL counts as not."""
    row = df.agg(*[(F.avg(F.coalesce(c, F.lit(False)).cast("int")) * 100).alias(f"_{i}") for i, c in enumerate(rules.values())])
    entries = [F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("percent")) for i, name in enumerate(rules)]
    return row.select(F.explode(F.array(*entries)).alias("_c")).select("_c.*")


def pass_counts(long: DataFrame) -> DataFrame:
    """Passing and failing items per rule set."""
    return long.groupBy("rule_set").agg(
        F.count_if("pass_filter").alias("n_pass"), F.count_if(~F.col("pass_filter")).alias("n_fail")
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent per value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())


def histogram(df: DataFrame, value: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width bins between least and greatest value, the last one closed; empty bins are kept."""
    present = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    # one summary row gives the range; a flat column gets a unit range around its value
    ends = present.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.struct((F.col("lo") - 0.5).alias("lo"), (F.col("hi") + 0.5).alias("hi")))
        .otherwise(F.struct("lo", "hi"))
        .alias("e")
    )
    at = present.withColumn("_e", ends.scalar())
    width = (F.col("_e.hi") - F.col("_e.lo")) / F.lit(bins)
    counted = (
        at.withColumn("bin", F.least(F.floor((F.col("_v") - F.col("_e.lo")) / width), F.lit(bins - 1)).cast("int"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_e", ends.scalar())
    out = spine.join(F.broadcast(counted), "bin", "left")  # at most one row per bin
    n = F.coalesce(F.col("n"), F.lit(0))
    measure = [n.alias("n")]
    if density:
        measure = [(n / (present.agg(F.count(F.lit(1))).scalar() * width)).alias("density")]
    return out.select("bin", (F.col("_e.lo") + F.col("bin") * width).alias("low"), *measure)


def kernel_density(df: DataFrame, value: str, points: int = GRID_POINTS) -> DataFrame:
    """Gaussian density (Scott bandwidth) on an even grid from the least to the greatest value.

    One row or a flat column has no width and gives no rows.  Equal values are collapsed first; each value adds only to grid points its kernel
    reaches, and the sums combine map-side, so the shuffle holds one row per grid point.
    """
    present = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    counts = present.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    summary = present.agg(
        F.struct(
            F.min("_v").alias("lo"),
            ((F.max("_v") - F.min("_v")) / F.lit(points - 1)).alias("step"),
            (F.stddev_samp("_v") * F.pow(F.count("_v").cast("double"), F.lit(-0.2))).alias("h"),
            F.count("_v").alias("n"),
        ).alias("s")
    )
    at = counts.withColumn("_s", summary.scalar())
    at = at.filter("_s.step > 0")  # one row or equal values have no width, so no density
    place = (F.col("_v") - F.col("_s.lo")) / F.col("_s.step")
    reach = F.col("_s.h") * KERNEL_REACH / F.col("_s.step")
    spread = at.withColumn(
        "point",
        F.explode(
            F.sequence(
                F.greatest(F.ceil(place - reach), F.lit(0)).cast("int"),
                F.least(F.floor(place + reach), F.lit(points - 1)).cast("int"),
            )
        ),
    )
    z = (F.col("_s.lo") + F.col("point") * F.col("_s.step") - F.col("_v")) / F.col("_s.h")
    weight = F.col("_n") * F.exp(-0.5 * z * z)
    return (
        spread.groupBy("point")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_s", summary.scalar())
        .select(
            "point",
            (F.col("_s.lo") + F.col("point") * F.col("_s.step")).alias("x"),
            (F.col("_w") / (F.col("_s.n") * F.col("_s.h") * F.lit(2.5066282746310002))).alias("density"),
        )
    )


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outliers per group."""
    present = df.filter(F.col(value).isNotNull()).select(by, value)
    q = quantiles(present, value, [0.25, 0.5, 0.75], by=[by])
    fences = q.select(
        by,
        F.get("q", F.lit(0)).alias("q1"),
        F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = F.col(value).between(low, high)
    # a few rows per group: collapsed by value first, so a hot group is never moved whole
    counts = present.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n")).join(fences, by)
    return counts.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"),
    )


def run_summary(df: DataFrame, affinity: str, compliant: str, all_pass: Column, score: str, name: str) -> DataFrame:
    """One row: counts, score range and mean, compliant and all-pass shares, the best name."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n"),
        F.min(affinity).alias("affinity_min"),
        F.max(affinity).alias("affinity_max"),
        F.avg(affinity).alias("affinity_mean"),
        F.count_if(compliant).alias("n_compliant"),
        (F.try_divide(F.count_if(compliant), n) * 100).alias("pct_compliant"),
        F.count_if(all_pass).alias("n_all_pass"),
        (F.try_divide(F.count_if(all_pass), n) * 100).alias("pct_all_pass"),
        F.min_by(name, F.struct(-F.col(score), F.col(name))).alias("best_name"),
        F.max(score).alias("best_score"),
    )
