import pytest
from pyspark.sql import functions as F

from assayer.functions import scoring, text
from assayer.functions.rules import Rule, all_flags_pass, attach_rules
from assayer.operators import cleaning, stats
from assayer.plans import consensus, finalists


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize("value, want", [("CC", True), ("C", False), ("C.C", True), ("C.C.C", False), ("", False), (None, False)])
def test_valid_format(spark, value, want):
    assert one(spark, text.valid_format(F.lit(value).cast("string"))) is want


@pytest.mark.parametrize("value, want", [("aa.bbb.ccc", "bbb"), ("a", "a"), ("", ""), ("x..", "x")])
def test_largest_fragment(spark, value, want):
    assert one(spark, text.largest_fragment(F.lit(value))) == want


@pytest.mark.parametrize("value, want", [("-7.25 x 3", -7.25), ("1e-2", 0.01), ("none", None), ("$$5", None), (".5", 0.5)])
def test_first_number(spark, value, want):
    assert one(spark, text.first_number(F.lit(value))) == want


@pytest.mark.parametrize("i, want", [(0, "KAA"), (27, "KBB"), (675, "KZZ"), (676, "K67")])
def test_base26(spark, i, want):
    assert one(spark, text.base26_id(F.lit(i))) == want


def test_allowed_symbols(spark):
    bad = text.offending_tokens(F.lit("CClBrSiXe"), "Cl|Br|Si|Xe|[A-Z]", text.LIBRARY_SYMBOLS)
    assert one(spark, bad) == ["Si", "Xe"]
    assert one(spark, text.offending_tokens(F.lit("CSiB"), "Si|[A-Z]", text.STEP_3D_SYMBOLS)) == []


def test_digitize_with_equal_edges(spark):
    edges = F.array(*[F.lit(float(v)) for v in (1, 2, 2, 5)])
    assert [one(spark, scoring.digitize(F.lit(v), edges)) for v in (0.0, 1.0, 2.0, 9.0)] == [0, 0, 2, 2]


def test_clipped_scores(spark):
    got = [one(spark, scoring.affinity_score(F.lit(v).cast("double"))) for v in (-20.0, -9.0, 0.0, None, float("nan"))]
    assert got == [1.0, 0.5, 0.0, 0.0, 0.0]
    assert one(spark, scoring.flag_share([])) == 1.0


def test_violation_text(spark):
    cols = {n: F.lit(v) for n, v in zip(scoring.SEVEN_LIMITS, (512.34, 5.0, 6, 1, 2, 3.0, 1))}
    assert one(spark, scoring.violation_text(cols)) == "MW=512.3 (>500); HBD=6 (>5)"
    assert one(spark, scoring.passes_seven_limits(cols)) is False
    broken = dict(cols, mw=F.lit(None).cast("double"))
    assert one(spark, scoring.passes_seven_limits(broken)) is True


def test_weights_must_fit():
    with pytest.raises(ValueError):
        scoring.composite({"QED_Score": 1.0}, ["QED_Score"])
    with pytest.raises(ValueError):
        scoring.composite({**scoring.DEFAULT_WEIGHTS, "New": 1.0}, list(scoring.DEFAULT_WEIGHTS))


def test_first_failure_wins_and_partitions_the_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, 500), (4, None)], "id long, v long")
    checks = [
        cleaning.Check("missing", F.col("v").isNull(), F.lit("no value")),
        cleaning.Check("big", F.col("v") > 20, F.concat(F.lit("v="), F.col("v").cast("string"))),
        cleaning.Check("huge", F.col("v") > 200, F.lit("never first")),
    ]
    routed = cleaning.route_failures(df, checks)
    assert {r.id: r.reason for r in cleaning.failed_rows(routed).collect()} == {2: "v=50", 3: "v=500", 4: "no value"}
    assert [r.id for r in cleaning.clean_rows(routed).collect()] == [1]
    rates = cleaning.success_rates(routed, 1).first()
    assert (rates.success_of_input, rates.success_of_unique) == (40.0, 25.0)


def test_dedupe_order(spark):
    rows = [(1, "a", "n1"), (2, "a", "n2"), (3, "b", "n1"), (4, "c", "n3")]
    got = cleaning.dedupe_library(spark.createDataFrame(rows, "line_no long, item string, name string"))
    assert sorted(r.line_no for r in got.collect()) == [1, 4]


def test_rules_and_flags(spark):
    df = spark.createDataFrame([(1, "ab1"), (2, "zz"), (3, None)], "id long, t string")
    rules = [Rule("s", "digit", "[0-9]"), Rule("s", "a", "a"), Rule("quiet", "never", "qqq"), Rule("bad", "open", "(")]
    wide = attach_rules(df, "t", rules)
    r = {x.id: x for x in wide.collect()}
    assert r[1].s_reasons == "a;digit" and r[1].s_status == "exclude" and r[2].s_pass_filter
    assert r[1].quiet_pass_filter and r[2].bad_status == "FILTER_ERROR" and not r[2].bad_pass_filter
    good = wide.drop("bad_pass_filter")
    assert [x.id for x in good.filter(all_flags_pass(good)).collect()] == [2, 3]
    assert df.filter(all_flags_pass(df)).count() == 3


def test_finalists_bad_rows_score_zero_and_ranks_are_kept(spark):
    rows = [("a", "x", "-9", 0.5, 3.0, 0), ("b", "x1", "bad", None, None, None), ("c", "y", "-9", 0.5, 3.0, 0), ("d", "x1", "-14", 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "name string, smiles string, minimizedAffinity string, QED double, SA_Score double, Lipinski_Violations int")
    ranked = finalists.rank_finalists(df, "smiles", [Rule("s", "one", "1")])
    got = {r.name: (r.Rank, round(r.Composite_Score, 6)) for r in ranked.collect()}
    assert got == {"d": (1, 0.9), "a": (2, 0.6), "c": (2, 0.6), "b": (3, 0.0)}
    top = finalists.top_finalists(ranked, 1, passing=True).collect()
    assert [(r.name, r.Rank) for r in top] == [("a", 2)]


def test_consensus_needs_every_model(spark):
    rows = [("a", n, -s) for n, s in (("p", 1.0), ("q", 2.0), ("r", 2.0))] + [("b", n, -s) for n, s in (("p", 5.0), ("q", 1.0), ("r", 0.0))]
    df = spark.createDataFrame(rows, "model string, name string, score double")
    got = {r.name: (r.a_rank, r.b_rank, r.mean_rank) for r in consensus.consensus(df, ["a", "b"]).collect()}
    assert got == {"p": (2.0, 1.0, 1.5), "q": (1.0, 2.0, 1.5)}


def test_model_choice_drops_failures(spark):
    rows = [("x", 0.5, 1.0), ("y", 0.899, 0.4), ("z", 0.5, 0.3), ("w", 0.4, 0.9)]
    got = consensus.choose_models(spark.createDataFrame(rows, "model string, r2_train double, r2_val double"), 5)
    assert [r.model for r in got.collect()] == ["w", "z"]


def test_flat_histogram(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    got = stats.histogram(df, "v", 4).collect()
    assert sum(r.n for r in got) == 5 and len(got) == 4


def test_box_and_correlation_with_nulls(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)] + [("g", None)], "g string, v double")
    b = stats.box_summary(df, "g", "v").first()
    assert (b.q1, b.median, b.q3, b.whisker_low, b.whisker_high, b.n_outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    m = {(r.x, r.y): r.r for r in stats.correlation_matrix(pairs, ["a", "b"]).collect()}
    assert m[("a", "b")] == m[("b", "a")] == pytest.approx(1.0) and m[("a", "a")] == 1.0
