import math

import pytest
from pyspark.sql import functions as F

from assayer.operators import sampling
from assayer.plans import selection


@pytest.fixture(scope="module")
def df(spark):
    # one label holds most rows, one is below the least size
    rows = [(i, "hot" if i < 150 else "mid" if i < 199 else "lone") for i in range(200)]
    return spark.createDataFrame(rows, "id long, label string").cache()


def test_folds_are_disjoint_balanced_and_stable(df):
    got = {r.id: r.fold for r in sampling.kfold(df, ["id"], 3).collect()}
    again = {r.id: r.fold for r in sampling.kfold(df.repartition(7), ["id"], 3).collect()}
    sizes = [list(got.values()).count(f) for f in range(3)]
    assert got == again and max(sizes) - min(sizes) <= 1 and sum(sizes) == 200
    two = sampling.repeated_kfold(df, ["id"], 4, 2)
    assert two.count() == 400 and two.groupBy("repeat", "fold").count().filter("count <> 50").count() == 0


def test_quotas_round_half_even_and_top_up(df):
    got = sampling.stratified_sample(df, "label", ["id"], 30).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"hot": round(150 / 199 * 30), "mid": round(49 / 199 * 30)}
    for n in (7, 30, 199, 500):
        drawn = sampling.topped_up_sample(df, "label", ["id"], n)
        assert drawn.count() >= min(n, 199) and drawn.select("id").distinct().count() == drawn.count()
        assert drawn.filter("label = 'lone'").count() == 0


def test_uniform_samples_are_exact_and_nested(df):
    small = {r.id for r in sampling.uniform_sample(df, ["id"], 20).collect()}
    large = {r.id for r in sampling.uniform_sample(df, ["id"], 60).collect()}
    assert len(small) == 20 and len(large) == 60 and small < large
    assert sampling.share_sample(df, ["id"], 0.333).count() == 66
    assert sampling.uniform_sample(df, ["id"], 999).count() == 200


def test_split_and_chunks(df):
    parts = sampling.train_test(df, ["id"], 0.15)
    assert parts.filter("part = 'test'").count() == math.ceil(200 * 0.15)
    got = sampling.chunks(df, "id", 3).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    assert sorted((r.chunk, r.n, r.lo) for r in got.collect()) == [(1, 67, 0), (2, 67, 67), (3, 66, 134)]


def test_strategy_steps():
    assert sampling.strategy(2_000_001, 0.3) == ("uniform", 0.01)
    assert sampling.strategy(9_999, 0.05) == ("stratified", 0.1)
    assert sampling.strategy(9_999, 0.2) == ("stratified", 0.2)
    assert [sampling.bins_for(n) for n in (999, 1000, 99_999, 100_000)] == [3, 5, 5, 7]
    assert [sampling.cluster_chunk_for(n) for n in (500, 10_000, 100_000)] == [500, 3000, 1500]


def test_bins_of_a_flat_column(spark):
    rows = [(i, 1.0, float(i)) for i in range(10)] + [(10, None, 3.0)]
    got = selection.binned(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], 2)
    labels = {r.id: r.bin_label for r in got.collect()}
    assert len(labels) == 10 and labels[0] == "a_1_b_0" and labels[9] == "a_1_b_1"


def test_selection_end_to_end(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, " ".join(words[(i * j) % 6] for j in range(1, 4 + i % 5)), float(i % 9), float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, item string, a double, b double")
    got = selection.select_start(df, ["a", "b"], "id", "item", sampling.start_plan(df.count(), 0.2))
    assert 0 < got.count() <= 60 and got.select("item").distinct().count() == got.count()


def test_uniform_start_is_labelled(spark, monkeypatch):
    """A huge library is drawn uniformly, and its rows come with their bins in the whole library."""
    monkeypatch.setattr(sampling, "HUGE_LIBRARY", 250)
    rows = [(i, f"item {i}", None if i % 50 == 7 else float(i % 9), math.nan if i % 50 == 8 else float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, item string, a double, b double")
    plan = sampling.start_plan(300, 0.2)
    assert plan.method == "uniform"
    labels = {r.id: r.bin_label for r in selection.binned(df, ["a", "b"], plan.bins).collect()}
    for share in (plan.share, 1.0):
        got = selection.select_start(df, ["a", "b"], "id", "item", plan._replace(share=share))
        assert got.columns == [*df.columns, "bin_label"]
        found = {r.id: r.bin_label for r in got.collect()}
        assert len(found) == got.count() == int(share * 300)
        assert set(found) == {r.id for r in sampling.share_sample(df, ["id"], share).collect()}
        assert all(found[i] == labels.get(i) for i in found)
    assert found[7] is None and found[8] is None and found[9] is not None


def test_select_start_query_on_a_huge_library(spark, sf, monkeypatch):
    from assayer.catalog import QUERIES

    monkeypatch.setattr(sampling, "HUGE_LIBRARY", 100)
    got = QUERIES["select_start"](spark, sf)
    rows = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.columns == ["doc_id", "bin_label"] and got.count() == int(rows * sampling.HUGE_SHARE)
    assert got.filter("bin_label IS NULL").count() == 0
