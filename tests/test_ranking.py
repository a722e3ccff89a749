import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import ranking, skew


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, v double")


def ranks(df, out="r"):
    return {r.id: r[out] for r in df.collect()}


CASES = {
    "one": [3.0],
    "flat": [2.0] * 40,
    "ties": [1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 0.0],
    "hot": [5.0] * 300 + [float(i) for i in range(100)],
    "null_nan": [None, float("nan"), 2.0, 1.0, 2.0],
    "random": [round(random.Random(1).random(), 2) for _ in range(500)],
}


@pytest.mark.parametrize("case, descending", [(c, False) for c in CASES] + [("ties", True), ("null_nan", True)])
def test_average_and_dense_rank(spark, case, descending):
    values = CASES[case]
    df = frame(spark, values)
    s = pd.Series(values, dtype=float)
    for method, fn in (("average", ranking.average_rank), ("dense", ranking.dense_rank)):
        want = s.rank(method=method, ascending=not descending)
        got = ranks(fn(df, "v", "r", descending=descending))
        for i, w in want.items():
            assert (got[i] is None) if pd.isna(w) else got[i] == w


def test_empty(spark):
    df = frame(spark, [])
    assert ranking.average_rank(df, "v", "r").count() == 0
    assert ranking.top_k(df, 3, [("v", True), ("id", True)]).count() == 0


def test_hot_keys_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    values = [5.0] * 300 + [float(i) for i in range(100)]
    want = pd.Series(values).rank()
    assert ranks(ranking.average_rank(frame(spark, values), "v", "r")) == dict(want.items())


def test_rank_by_group(spark):
    rows = [(g, i, float((i * 7) % 5)) for g in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    want = pd.DataFrame(rows, columns=["g", "i", "v"])
    want["r"] = want.groupby("g")["v"].rank()
    got = {(r.g, r.i): r.r for r in ranking.average_rank(df, "v", "r", by=["g"]).collect()}
    assert got == {(r.g, r.i): r.r for r in want.itertuples()}


@pytest.mark.parametrize("case", ["one", "flat", "ties", "hot", "random"])
def test_quantiles(spark, case):
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = ranking.quantiles(frame(spark, CASES[case]), "v", probs).first().q
    assert got == pytest.approx(pd.Series(CASES[case]).quantile(probs).tolist())


@pytest.mark.parametrize("k, up", [(0, True), (1, True), (150, True), (150, False), (399, False), (1000, True)])
def test_top_k_by_cut_value(spark, monkeypatch, k, up):
    monkeypatch.setattr(ranking, "SMALL_K", -1)
    rows = list(enumerate([5.0] * 300 + [float(i) for i in range(100)]))
    got = {r.id for r in ranking.top_k(spark.createDataFrame(rows, "id long, v double"), k, [("v", up), ("id", True)]).collect()}
    want = sorted(rows, key=lambda r: (r[1] if up else -r[1], r[0]))[:k]
    assert got == {r[0] for r in want}


@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize("k", [5, 19])
def test_top_k_has_one_rule(spark, monkeypatch, k, up):
    """NaN and NULL scores never qualify, NULL and NaN ties have a place, and both paths agree with plain sorting."""
    nan = float("nan")
    r = random.Random(k)
    rows = [(i, r.choice([None, nan, 1.0, 2.0, 3.0]), r.choice([None, nan, 0.0, -1.5]), r.choice([None, 4])) for i in range(40)]
    side = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    present = [x for x in rows if x[1] is not None and x[1] == x[1]]
    for column, flip in ((2, up), (1, up)):
        present = sorted(present, key=lambda x: side(x[column]), reverse=not flip)
    df = spark.createDataFrame(rows, "id long, v double, w double, n long")
    order = [("v", up), ("w", up), ("id", True)]
    for small in (10_000, -1):
        monkeypatch.setattr(ranking, "SMALL_K", small)
        assert sorted(x.id for x in ranking.top_k(df, k, order).collect()) == sorted(x[0] for x in present[:k])


def test_top_k_with_text_tie_break(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_K", -1)
    rows = [(f"name{i:03d}", float(i % 3)) for i in range(60)]
    got = {r.n for r in ranking.top_k(spark.createDataFrame(rows, "n string, v double"), 27, [("v", True), ("n", True)]).collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))[:27]}


@pytest.mark.parametrize("n", [1, 7, 50])
def test_best_n_per_group(spark, n):
    r = random.Random(3)
    rows = [(r.choice("aab"), i, float(r.randint(0, 6))) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {x.id for x in ranking.best_n_per_group(df, ["g"], "v", n, "id").collect()}
    want = set()
    for g in "ab":
        want |= {x[1] for x in sorted([x for x in rows if x[0] == g], key=lambda x: (x[2], x[1]))[:n]}
    assert got == want


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_ranges_with_and_without_automatic_broadcast(spark, threshold):
    r = random.Random(4)
    rows = [(r.choice("ab"), i, float(r.randint(0, 400))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranking.average_rank(df, "v", "r", by=["g"])
        want = pd.DataFrame(rows, columns=["g", "id", "v"])
        assert ranks(ranked) == dict(zip(want["id"], want.groupby("g")["v"].rank()))
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert any("hashpartitioning(g" in line and "_range" in line for line in plan.splitlines())
        ranged = ranking._ranged(df, ["g"], [("v", True)])
        assert ranged.select("_range").distinct().count() == 3  # the session's partitions
        bounds = ranged.groupBy("_range").agg(F.min(F.struct("g", "v")).alias("low"), F.max(F.struct("g", "v")).alias("high")).orderBy("_range").collect()
        assert all(tuple(a.high) < tuple(b.low) for a, b in zip(bounds, bounds[1:]))
        assert ranking.quantiles(df, "v", [0.5]).first().q == [want["v"].quantile(0.5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_scores_with_like_names_spread_over_tasks(spark):
    df = spark.range(200_000).select(F.concat(F.lit("a common prefix of names "), F.col("id").cast("string")).alias("n"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made, keys = ranking._sort_keys(df, [("v", False), ("n", True)])
        sizes = [r["count"] for r in ranking._ranged(made.select(*[c for c, _ in keys]), [], keys).groupBy("_range").count().collect()]
        assert len(sizes) == 3 and max(sizes) < 100_000
        got = ranking.top_k(df, 20_000, [("v", False), ("n", True)]).select("n")
        want = df.select("n").orderBy("n").limit(20_000)
        assert got.count() == 20_000 and got.join(want, "n", "left_anti").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_positions(spark):
    ids = random.Random(2).sample(range(10_000), 700)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.p for r in ranking.row_positions(df, "id", "p").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}


def test_carry_forward_over_blocks(spark):
    rows = [("f", i, "h%d" % i if i in (3, 17) else None) for i in range(40)] + [("g", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "f string, n long, h string")
    got = {(r.f, r.n): r.c for r in ranking.carry_forward(df, ["f"], "n", "h", "c", block=4).collect()}
    for f, n, _ in rows:
        want = None if f == "g" or n < 3 else ("h3" if n < 17 else "h17")
        assert got[(f, n)] == want


def test_ordered_rank(spark):
    rows = [("s", i, float(i % 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "s string, o long, v double")
    got = {r.o: r.k for r in ranking.ordered_rank(df, "v", "o", "k", ["s"], descending=True).collect()}
    assert got == {r[1]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}


def test_user_columns_may_share_internal_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 1.0, 3.0)], "n long, total double, before double")
    assert {r.n: r.r for r in ranking.average_rank(df, "total", "r").collect()} == {1: 2.0, 2: 1.0}
    assert ranking.dense_rank(df, "before", "r").select(F.max("r")).first()[0] == 1
