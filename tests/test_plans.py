"""Plans of the operators that must not fall back to one task or to all pairs."""

import re

import pytest

from assayer.catalog import QUERIES
from assayer.streaming import progress
from pyspark.sql import functions as F

NAMES = [
    "average_rank", "atom_contacts", "consensus", "dense_rank", "kfold", "chunks", "library_clean", "percentile_edges",
    "remaining_library", "round_stats", "section_fields", "site_rank", "tanimoto_pairs", "to_score", "top_tenth", "box_summary",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["average_rank", "kfold", "chunks", "top_tenth"])
def test_one_task_windows_only_over_buckets(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for window in re.findall(r"Window \[(.*?)\].*?\[(0|\d+)\]", plan):
        assert "row_number" not in window[0]


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["kept_points"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "s_acctbal" in plan
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert all("l_extendedprice" not in r for r in read)


def test_dedupe_limits_before_the_shuffle(spark, sf):
    plan = QUERIES["library_clean"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_counter_sees_files_that_arrive_later(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "results"), str(tmp_path / "state")
    rows = spark.range(40).select(F.when(F.col("id") < 30, "a").otherwise("b").alias("job"), "id")
    totals = spark.createDataFrame([("a", 50), ("b", 12)], "job string, n_total long")

    def counts():
        progress.follow(spark, folder, rows.schema, totals, checkpoint, "counter", files_per_trigger=1).awaitTermination()
        return {r.job: (r.n_done, r.percent) for r in spark.table("counter").collect()}

    rows.repartition(2).write.parquet(folder)
    assert counts() == {"a": (30, 60.0), "b": (10, pytest.approx(10 / 12 * 100))}
    rows.write.mode("append").parquet(folder)
    assert counts() == {"a": (50, 100.0), "b": (12, 100.0)}
