"""Consensus, ranks, top-k, joins and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import query, table
from assayer.operators import joins, ledger, ranking
from assayer.plans import consensus

MODELS = ["quantity", "price", "discount"]
BATCH = 200


def part_scores(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(-F.avg("l_quantity"), 4).alias("quantity"),
        (-F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count(F.lit(1))) / 100000.0).alias("price"),
        F.round(-F.sum("l_discount"), 4).alias("discount"),
    )
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MODELS])
    return li.select(F.col("l_partkey").alias("name"), F.explode(entries).alias("_s")).select("name", "_s.model", "_s.score")


def part_ledger(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_size") <= 10).select(F.col("p_partkey").alias("name"))


_CONSENSUS_SQL = """
  wide AS (SELECT l_partkey AS name, round(-avg(l_quantity), 4) AS quantity_score,
             -floor(sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / count(*)) / 100000.0::DOUBLE AS price_score, round(-sum(l_discount), 4) AS discount_score
           FROM lineitem GROUP BY l_partkey),
  valid AS (SELECT * FROM wide WHERE quantity_score < 0 AND price_score < 0 AND discount_score < 0),
  ranked AS (SELECT *,
      rank() OVER (ORDER BY quantity_score) + (count(*) OVER (PARTITION BY quantity_score) - 1) / 2.0::DOUBLE AS quantity_rank,
      rank() OVER (ORDER BY price_score) + (count(*) OVER (PARTITION BY price_score) - 1) / 2.0::DOUBLE AS price_rank,
      rank() OVER (ORDER BY discount_score) + (count(*) OVER (PARTITION BY discount_score) - 1) / 2.0::DOUBLE AS discount_rank
    FROM valid),
  cons AS (SELECT *, round((quantity_rank + price_rank + discount_rank) / 3.0::DOUBLE, 6) AS mean_rank FROM ranked)"""


@query("consensus", f"WITH {_CONSENSUS_SQL} SELECT * FROM cons")
def _consensus(spark, sf):
    return consensus.consensus(part_scores(spark, sf), MODELS).withColumn("mean_rank", F.round("mean_rank", 6))


@query(
    "next_batch",
    f"""WITH {_CONSENSUS_SQL}, top AS (SELECT * FROM cons ORDER BY mean_rank, name LIMIT {BATCH})
        SELECT * FROM top WHERE name NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10)""",
)
def next_batch(spark, sf):
    batch = consensus.next_batch(part_scores(spark, sf), MODELS, BATCH, part_ledger(spark, sf))
    return batch.withColumn("mean_rank", F.round("mean_rank", 6))


@query(
    "single_model_top",
    f"""WITH {_CONSENSUS_SQL}, v AS (SELECT name, price_score FROM wide WHERE price_score < 0)
        SELECT * FROM v ORDER BY price_score, name LIMIT {BATCH}""",
)
def _single_model_top(spark, sf):
    return consensus.select_top(part_scores(spark, sf), ["price"], BATCH)


@query(
    "score_pivot",
    f"WITH {_CONSENSUS_SQL} SELECT name, quantity_score, price_score, discount_score FROM valid",
)
def _score_pivot(spark, sf):
    return joins.scores_by_model(part_scores(spark, sf), MODELS)


def order_totals(spark, sf):
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.floor(cents / 1000).alias("total"))


_TOTALS_SQL = """totals AS (SELECT l_orderkey, floor(sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 1000)::BIGINT AS total
                            FROM lineitem GROUP BY l_orderkey)"""


@query(
    "average_rank",
    f"""WITH {_TOTALS_SQL} SELECT l_orderkey, total,
          rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0::DOUBLE AS rank FROM totals""",
)
def _average_rank(spark, sf):
    return ranking.average_rank(order_totals(spark, sf), "total", "rank")


@query(
    "dense_rank",
    f"WITH {_TOTALS_SQL} SELECT l_orderkey, total, dense_rank() OVER (ORDER BY total DESC) AS rank FROM totals",
)
def _dense_rank(spark, sf):
    return ranking.dense_rank(order_totals(spark, sf), "total", "rank", descending=True)


@query(
    "top_tenth",
    f"""WITH {_TOTALS_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY total, l_orderkey) AS n FROM totals)
        SELECT l_orderkey, total FROM numbered WHERE n <= (SELECT count(*) // 10 FROM totals)""",
)
def _top_tenth(spark, sf):
    """A share of the table, found by its cut value instead of a sorted block."""
    totals = order_totals(spark, sf)
    k = totals.agg(F.floor(F.count(F.lit(1)) / 10)).scalar()
    return ranking.best_share(totals, k, [("total", True), ("l_orderkey", True)])


@query(
    "remaining_library",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _remaining(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return joins.not_in(d, table(spark, sf, "labels"), "doc_id")


@query(
    "to_score",
    """SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 300)
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _to_score(spark, sf):
    top = ranking.top_k(table(spark, sf, "documents").select("doc_id", "n_chars"), 300, [("n_chars", False), ("doc_id", True)])
    return joins.not_in(top, table(spark, sf, "labels"), "doc_id")


@query(
    "attach_properties",
    """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _attach(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return joins.attach(d, table(spark, sf, "labels"), "doc_id")


@query(
    "kept_points",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem
       WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 1000)""",
)
def _kept_points(spark, sf):
    kept = table(spark, sf, "supplier").filter("s_acctbal >= 1000").select(F.col("s_suppkey").alias("l_suppkey"))
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return joins.kept_only(points, kept, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


def _event_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("item"), F.col("user_id").alias("name"), (100.0 - F.col("value")).alias("score"),
        F.hour("ts").alias("hour"),
    )


_ROWS_SQL = """ev AS (SELECT event_type AS item, user_id AS name, 100.0::DOUBLE - value AS score, hour(ts) AS h FROM events),
               new_t AS (SELECT item, name, score FROM ev WHERE h < 14 AND score < 0),
               old_t AS (SELECT item, name, score FROM ev WHERE h >= 10)"""


@query("ledger_fold", f"WITH {_ROWS_SQL} SELECT DISTINCT * FROM (SELECT * FROM new_t UNION ALL SELECT * FROM old_t)")
def _ledger_fold(spark, sf):
    rows = _event_rows(spark, sf)
    return ledger.fold(rows.filter("hour < 14"), rows.filter("hour >= 10"))


@query(
    "ledger_fold_unique",
    f"""WITH {_ROWS_SQL}, u AS (SELECT * FROM new_t UNION ALL SELECT * FROM old_t)
        SELECT item, name, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score, item) AS n FROM u) WHERE n = 1""",
)
def _ledger_fold_unique(spark, sf):
    rows = _event_rows(spark, sf)
    return ledger.fold(rows.filter("hour < 14"), rows.filter("hour >= 10"), unique_by="name")


@query(
    "round_union",
    """SELECT o_orderkey AS name, o_totalprice AS score, 0 AS round FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT o_orderkey, o_totalprice, 2 FROM orders WHERE o_orderstatus = 'P'""",
)
def _round_union(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    parts = [(i, o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus")) for i, s in enumerate("FOP")]
    return ledger.union_rounds(parts)


_BRANDS_SQL = """brand AS (SELECT p_brand AS model, round((avg(p_size) % 10) / 10 + 0.05, 4) AS r2_train,
                                  round((avg(p_retailprice) % 7) / 7, 4) AS r2_val FROM part GROUP BY p_brand)"""


@query(
    "model_choice",
    f"""WITH {_BRANDS_SQL} SELECT * FROM brand WHERE r2_val <> 1 AND round_even(r2_train, 2) < 0.90
        ORDER BY r2_val DESC, model LIMIT 3""",
)
def _model_choice(spark, sf):
    metrics = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(
        F.round((F.avg("p_size") % 10) / 10 + 0.05, 4).alias("r2_train"),
        F.round((F.avg("p_retailprice") % 7) / 7, 4).alias("r2_val"),
    )
    return consensus.choose_models(metrics, 3)


@query(
    "best_trial",
    """WITH t AS (SELECT p_brand AS model, p_partkey AS trial, (p_retailprice % 13)::DOUBLE AS val_mse FROM part)
       SELECT model, trial, val_mse FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY val_mse, trial) AS n FROM t) WHERE n = 1""",
)
def _best_trial(spark, sf):
    trials = table(spark, sf, "part").select(
        F.col("p_brand").alias("model"), F.col("p_partkey").alias("trial"), (F.col("p_retailprice") % 13).alias("val_mse")
    )
    return consensus.best_trial(trials, ["model"])
