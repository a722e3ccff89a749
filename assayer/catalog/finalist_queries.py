"""Pattern rules, composite ranks, finalists and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.clean_queries import DESCRIPTOR_SQL, FIVE_SQL, descriptors, with_rule_of_five
from assayer.catalog.registry import query, spread, table
from assayer.functions.rules import Rule, all_flags_pass, apply_rules
from assayer.operators import ledger, stats
from assayer.plans import finalists
from assayer.sources.sinks import top_payload as top_payload_json

# stand-in pattern rules on document text
RULES = [
    Rule("contact", "mail", r"[A-Za-z0-9._]+@[A-Za-z0-9]+"),
    Rule("contact", "link", r"https?://"),
    Rule("contact", "phone", r"[0-9]{3}[-. ][0-9]{3,4}"),
    Rule("markup", "tag", r"<[a-zA-Z/][^>]*>"),
    Rule("markup", "brace", r"[{}]"),
    Rule("noise", "repeat", r"###|\*\*\*|%%%"),
    Rule("noise", "digits", r"[0-9]{6,}"),
    Rule("noise", "caps", r"[A-Z]{8,}"),
]
SETS = ["contact", "markup", "noise"]


def _set_sql(rule_set):
    hits = ", ".join(
        f"CASE WHEN regexp_matches(text, '{r.pattern}') THEN '{r.name}' END" for r in RULES if r.rule_set == rule_set
    )
    return f"array_to_string(list_sort(list_filter([{hits}], lambda h: h IS NOT NULL)), ';') AS {rule_set}_r"


_FLAGS_SQL = f"""flags AS (SELECT doc_id, {", ".join(_set_sql(s) for s in SETS)} FROM documents),
  long_t AS ({" UNION ALL ".join(f'''SELECT doc_id, '{s}' AS rule_set, {s}_r = '' AS pass_filter,
     CASE WHEN {s}_r = '' THEN 'ok' ELSE 'exclude' END AS status, nullif({s}_r, '') AS reasons FROM flags''' for s in SETS)})"""


def _flags(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return apply_rules(d, "text", RULES).drop("text")


@query("rule_flags", f"WITH {_FLAGS_SQL} SELECT * FROM long_t")
def _rule_flags(spark, sf):
    return _flags(spark, sf)


@query(
    "rule_counts",
    f"""WITH {_FLAGS_SQL} SELECT rule_set, count(*) FILTER (pass_filter) AS n_pass, count(*) FILTER (NOT pass_filter) AS n_fail
        FROM long_t GROUP BY rule_set""",
)
def _rule_counts(spark, sf):
    return stats.pass_counts(_flags(spark, sf))


@query(
    "broken_rule_set",
    f"""WITH {_FLAGS_SQL} SELECT doc_id, rule_set, pass_filter, status FROM long_t WHERE rule_set = 'markup'
        UNION ALL SELECT doc_id, 'broken', false, 'FILTER_ERROR' FROM documents""",
)
def _broken_rule_set(spark, sf):
    """A rule set that does not compile fails every item and leaves the others alone."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    rules = [r for r in RULES if r.rule_set == "markup"] + [Rule("broken", "open", "(")]
    return apply_rules(d, "text", rules).select("doc_id", "rule_set", "pass_filter", "status")


@query(
    "violation_dist",
    f"""WITH {DESCRIPTOR_SQL}, {FIVE_SQL} SELECT Lipinski_Violations, count(*) AS n,
          round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM five WHERE Lipinski_Violations IS NOT NULL), 6) AS percent
        FROM five WHERE Lipinski_Violations IS NOT NULL GROUP BY 1""",
)
def _violation_dist(spark, sf):
    d = with_rule_of_five(descriptors(spark, sf).drop("text"))
    return stats.value_distribution(d, "Lipinski_Violations").withColumn("percent", F.round("percent", 6))


@query(
    "violation_pct",
    f"""WITH {DESCRIPTOR_SQL}, r AS (SELECT unnest(['MW > 500', 'LogP > 5', 'HBD > 5', 'HBA > 10']) AS rule,
          unnest([coalesce(MW > 500, false), coalesce(LogP > 5, false), HBD > 5, HBA > 10]) AS hit FROM desc_t)
        SELECT rule, round(avg(hit::INT) * 100, 6) AS percent FROM r GROUP BY rule""",
)
def _violation_pct(spark, sf):
    cols = {c: F.col(c) for c in ("MW", "LogP", "HBD", "HBA")}
    pct = stats.exceed_percent(descriptors(spark, sf), finalists.rule_violations(cols))
    return pct.withColumn("percent", F.round("percent", 6))


def _candidates(spark, sf):
    d = with_rule_of_five(descriptors(spark, sf))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("QED"))
    return d.join(labels, "doc_id", "left").withColumns(
        {
            "name": F.col("doc_id"),
            "smiles": F.col("text"),
            "minimizedAffinity": F.when(F.length("text") % 11 == 0, F.lit("n/a")).otherwise(
                (-(F.length("text") % 1500) / 100.0).cast("string")
            ),
            "SA_Score": F.col("LogP") * 1.5,
        }
    ).drop("text", "doc_id")


def ranked(spark, sf):
    return finalists.rank_finalists(_candidates(spark, sf), "smiles", RULES)


RANKED_SQL = f"""{DESCRIPTOR_SQL}, {FIVE_SQL}, {_FLAGS_SQL},
  cand AS (SELECT f.*, q.quality::DOUBLE AS QED,
      CASE WHEN length(f.text) % 11 = 0 THEN NULL ELSE -(length(f.text) % 1500) / 100.0::DOUBLE END AS Affinity_Numeric,
      LogP * 1.5::DOUBLE AS SA_Score, contact_r = '' AS contact_p, markup_r = '' AS markup_p, noise_r = '' AS noise_p
    FROM five f LEFT JOIN labels q USING (doc_id) JOIN flags g USING (doc_id)),
  comp AS (SELECT *, coalesce(least(greatest((-4.0::DOUBLE - Affinity_Numeric) / 10.0::DOUBLE, 0), 1), 0) AS Affinity_Score,
      coalesce(QED, 0) AS QED_Score,
      coalesce(least(greatest((10 - SA_Score) / 9.0::DOUBLE, 0), 1), 0) AS SA_Score_Norm,
      coalesce(least(greatest((4 - Lipinski_Violations) / 4.0::DOUBLE, 0), 1), 0) AS Lipinski_Score,
      (contact_p::INT + markup_p::INT + noise_p::INT) / 3.0::DOUBLE AS Filter_Score FROM cand),
  total AS (SELECT *, Affinity_Score * 0.70::DOUBLE + QED_Score * 0.10::DOUBLE + SA_Score_Norm * 0.0::DOUBLE
      + Lipinski_Score * 0.10::DOUBLE + Filter_Score * 0.10::DOUBLE AS Composite_Score FROM comp),
  ranked AS (SELECT *, dense_rank() OVER (ORDER BY Composite_Score DESC) AS Rank FROM total)"""


@query(
    "composite_rank",
    f"""WITH {RANKED_SQL} SELECT doc_id AS name, Rank, round(Composite_Score, 6) AS Composite_Score,
          round(Affinity_Score, 6) AS Affinity_Score, QED_Score, round(SA_Score_Norm, 6) AS SA_Score_Norm,
          Lipinski_Score, round(Filter_Score, 6) AS Filter_Score FROM ranked""",
)
def _composite_rank(spark, sf):
    r = ranked(spark, sf)
    rounded = [F.round(c, 6).alias(c) for c in ("Composite_Score", "Affinity_Score", "SA_Score_Norm", "Filter_Score")]
    return r.select("name", "Rank", "QED_Score", "Lipinski_Score", *rounded)


_EXPORT_SQL = """SELECT Rank, doc_id AS name, text AS smiles, round_even(Composite_Score * 1000, 0) / 1000 AS Composite_Score,
    round_even(Affinity_Numeric * 1000, 0) / 1000 AS Affinity_Numeric, round_even(MW * 1000, 0) / 1000 AS MW,
    round_even(LogP * 1000, 0) / 1000 AS LogP, HBD, HBA, TPSA, RotBonds, QED, round_even(SA_Score * 1000, 0) / 1000 AS SA_Score,
    Lipinski_Compliant, Lead_Like, Lipinski_Violations,
    contact_p AS contact_pass_filter, markup_p AS markup_pass_filter, noise_p AS noise_pass_filter FROM ranked"""


@query("top_compounds", f"WITH {RANKED_SQL} {_EXPORT_SQL} ORDER BY ranked.Composite_Score DESC, doc_id LIMIT 50")
def _top_compounds(spark, sf):
    return finalists.export_view(finalists.top_finalists(ranked(spark, sf), 50))


@query(
    "top_passing",
    f"WITH {RANKED_SQL} {_EXPORT_SQL} WHERE contact_p AND markup_p AND noise_p ORDER BY ranked.Composite_Score DESC, doc_id LIMIT 50",
)
def _top_passing(spark, sf):
    return finalists.export_view(finalists.top_finalists(ranked(spark, sf), 50, passing=True))


@query(
    "top_payload",
    f"""WITH {RANKED_SQL} SELECT doc_id AS name, Rank AS rank, round(Composite_Score, 6) AS score, Affinity_Numeric AS affinity,
          Lipinski_Violations AS lipinski_violations, md5(text) AS smiles_md5
        FROM ranked ORDER BY Composite_Score DESC, doc_id LIMIT 5""",
)
def _top_payload(spark, sf):
    """The JSON of the best five, parsed again."""
    top = finalists.top_finalists(ranked(spark, sf), 5).select(top_payload_json().alias("json"))
    fields = "rank long, name long, score double, affinity double, lipinski_violations int, smiles string"
    parsed = top.select(F.from_json("json", fields).alias("p")).select("p.*")
    return parsed.select("name", "rank", F.round("score", 6).alias("score"), "affinity", "lipinski_violations", F.md5("smiles").alias("smiles_md5"))


@query("all_passing", f"WITH {RANKED_SQL} SELECT doc_id AS name, Rank FROM ranked WHERE contact_p AND markup_p AND noise_p")
def _all_passing(spark, sf):
    return finalists.passing(ranked(spark, sf)).select("name", "Rank")


@query(
    "run_summary",
    f"""WITH {RANKED_SQL} SELECT count(*) AS n, min(Affinity_Numeric) AS affinity_min, max(Affinity_Numeric) AS affinity_max,
          round(avg(Affinity_Numeric), 6) AS affinity_mean, count(*) FILTER (Lipinski_Compliant) AS n_compliant,
          round(count(*) FILTER (Lipinski_Compliant) / count(*) * 100, 6) AS pct_compliant,
          count(*) FILTER (contact_p AND markup_p AND noise_p) AS n_all_pass,
          round(count(*) FILTER (contact_p AND markup_p AND noise_p) / count(*) * 100, 6) AS pct_all_pass,
          (SELECT doc_id FROM ranked ORDER BY Composite_Score DESC, doc_id LIMIT 1) AS best_name,
          round(max(Composite_Score), 6) AS best_score FROM ranked""",
)
def _run_summary(spark, sf):
    r = ranked(spark, sf)
    s = stats.run_summary(r, "Affinity_Numeric", "Lipinski_Compliant", all_flags_pass(r), "Composite_Score", "name")
    return s.withColumns({c: F.round(c, 6) for c in ("affinity_mean", "pct_compliant", "pct_all_pass", "best_score")})


MATRIX = ["MW", "LogP", "HBD", "HBA", "TPSA", "RotBonds", "ArRings", "QED", "SA_Score", "Affinity_Numeric", "Composite_Score"]


@query(
    "corr_matrix",
    f"WITH {RANKED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, " + ("1.0::DOUBLE" if a == b else f"round(corr({min(a, b)}, {max(a, b)}), 6)") + " AS r FROM "
        + ("(SELECT 1)" if a == b else "ranked")
        for a in MATRIX for b in MATRIX
    ),
)
def _corr_matrix(spark, sf):
    scored = finalists.with_composite(finalists.with_component_scores(_flagged(spark, sf)))
    return stats.correlation_matrix(scored, MATRIX).withColumn("r", F.round("r", 6))


def _flagged(spark, sf):
    from assayer.functions.rules import attach_rules

    return attach_rules(_candidates(spark, sf), "smiles", RULES)


def rounds(spark, sf):
    """Events as scored rounds: the day is the round, the negated value the score."""
    return table(spark, sf, "events").select(
        (F.dayofyear("ts") - 1).alias("round"), F.col("event_id").alias("name"), (-F.col("value")).alias("score")
    )


_ROUNDS_SQL = "rounds AS (SELECT dayofyear(ts) - 1 AS round, event_id AS name, -value AS score FROM events)"


def _rounds_stats_sql(n):
    return f"""WITH {_ROUNDS_SQL}, best AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY round ORDER BY score, name) AS r FROM rounds) WHERE r <= {n})
        SELECT round, round_even(avg(score) * 100, 0) / 100 AS mean, round_even(stddev_samp(score) * 100, 0) / 100 AS sd,
               round_even(min(score) * 100, 0) / 100 AS min, round_even(max(score) * 100, 0) / 100 AS max FROM best GROUP BY round"""


BEST_N = int(191 * ledger.STATS_SHARE)


@query("round_stats", _rounds_stats_sql(BEST_N))
def _round_stats(spark, sf):
    return ledger.round_stats(rounds(spark, sf), BEST_N)


@query(
    "box_summary",
    f"""WITH {_ROUNDS_SQL}, q AS (SELECT round, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
           quantile_cont(score, 0.75) AS q3 FROM rounds GROUP BY round),
         j AS (SELECT *, score BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM rounds JOIN q USING (round))
        SELECT round, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
               min(score) FILTER (inside) AS whisker_low, max(score) FILTER (inside) AS whisker_high,
               count(*) FILTER (NOT inside) AS n_outliers FROM j GROUP BY round, j.q1, j.median, j.q3""",
)
def _box_summary(spark, sf):
    box = stats.box_summary(rounds(spark, sf), "round", "score")
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


def _hist_sql(measure, bins):
    return f"""WITH {_ROUNDS_SQL}, e AS (SELECT min(score) AS lo, (max(score) - min(score)) / {bins} AS w, count(*) AS total FROM rounds),
          b AS (SELECT least(floor((score - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS n FROM rounds, e GROUP BY 1),
          spine AS (SELECT unnest(range({bins}))::INTEGER AS bin)
        SELECT bin, round(lo + bin * w, 6) AS low, {measure} FROM spine LEFT JOIN b USING (bin), e"""


@query("score_hist", _hist_sql("coalesce(n, 0) AS n", 30))
def _score_hist(spark, sf):
    return stats.histogram(rounds(spark, sf), "score", 30).withColumn("low", F.round("low", 6))


@query("score_density", _hist_sql("round(coalesce(n, 0) / (total * w), 9) AS density", 100))
def _score_density(spark, sf):
    return stats.histogram(rounds(spark, sf), "score", 100, density=True).select(
        "bin", F.round("low", 6).alias("low"), F.round("density", 9).alias("density")
    )


@query(
    "kde_grid",
    f"""WITH {_ROUNDS_SQL}, s AS (SELECT min(score) AS lo, (max(score) - min(score)) / 511 AS step,
            stddev_samp(score) * pow(count(*), -0.2::DOUBLE) AS h, count(*) AS n FROM rounds),
          c AS (SELECT score, count(*) AS m FROM rounds GROUP BY score),
          g AS (SELECT unnest(range(512))::INTEGER AS point)
        SELECT point, round(any_value(lo + point * step), 6) AS x,
               round(sum(m * exp(-0.5::DOUBLE * pow((lo + point * step - score) / h, 2))) / any_value(n * h * 2.5066282746310002::DOUBLE), 9) AS density
        FROM g, s, c GROUP BY point""",
)
def _kde_grid(spark, sf):
    return stats.kernel_density(rounds(spark, sf), "score").select(
        "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density")
    )


def _predictions(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"), F.pmod("l_partkey", F.lit(4)).cast("int").alias("trial"),
    )


_PRED_SQL = """pred AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p, (l_orderkey % 5)::INTEGER AS fold,
                               (l_partkey % 4)::INTEGER AS trial FROM lineitem)"""


@query(
    "fit_report",
    f"""WITH {_PRED_SQL} SELECT fold, round(corr(y, p), 6) AS pearson_r, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
          round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(abs(y - p)), 4) AS mae FROM pred GROUP BY fold""",
)
def _fit_report(spark, sf):
    r = stats.fit_report(_predictions(spark, sf), "y", "p", ["fold"])
    return r.select(
        "fold", F.round("pearson_r", 6).alias("pearson_r"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"),
        F.round("mae", 4).alias("mae"),
    )


@query(
    "fold_metrics",
    f"""WITH {_PRED_SQL}, m AS (SELECT trial, fold, avg((y - p) * (y - p)) AS mse,
            1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) AS r2 FROM pred GROUP BY trial, fold)
        SELECT trial, round(avg(mse), 2) AS mse, round(avg(r2), 6) AS r2 FROM m GROUP BY trial""",
)
def _fold_metrics(spark, sf):
    per_fold = stats.fit_metrics(_predictions(spark, sf), "y", "p", ["trial", "fold"])
    return stats.fold_average(per_fold, ["trial"], ["mse", "r2"]).select(
        "trial", F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2")
    )
