"""Cleaning, routing and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import query, spread, table
from assayer.functions import scoring, text
from assayer.operators import cleaning
from assayer.operators.cleaning import Check

ALLOWED_MARKS = [".", ",", "!", "?", ";", ":", "-", "'", '"', "(", ")"]
MARK_PATTERN = r"[^\p{L}\s]"
_ALLOWED_SQL = "['.', ',', '!', '?', ';', ':', '-', '''', '\"', '(', ')']"


@query(
    "valid_format",
    """SELECT doc_id, coalesce(length(trim(text)) >= 2
              AND length(trim(text)) - length(replace(trim(text), '.', '')) <= 1, false) AS valid
       FROM documents""",
)
def _valid_format(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.valid_format(F.trim("text")).alias("valid"))


@query(
    "library_clean",
    """WITH base AS (SELECT doc_id, trim(text) AS item, trim(source || '_' || (doc_id % 50)) AS name
                     FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
            one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY doc_id) AS n FROM base) WHERE n = 1),
            two AS (SELECT doc_id, item, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS n FROM one)
       SELECT doc_id, name, md5(item) AS item_md5 FROM two WHERE n = 1""",
)
def _library_clean(spark, sf):
    d = table(spark, sf, "documents")
    named = d.select(
        "doc_id", F.col("text").alias("item"),
        F.concat("source", F.lit("_"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("name"),
    )
    trimmed = cleaning.drop_null_and_trim(named, ["item", "name"])
    kept = cleaning.dedupe_library(trimmed, "item", "name", "doc_id")
    return kept.select("doc_id", "name", F.md5("item").alias("item_md5"))


def _routed(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    bad = text.offending_tokens(F.col("text"), MARK_PATTERN, ALLOWED_MARKS)
    prepared = d.withColumns(
        {"_bad": bad, "_words": F.size(F.split(F.trim("text"), " ")), "_part": text.largest_fragment(F.col("text"))}
    )
    # fixed values: the failure types of the output contract
    checks = [
        Check("invalid_smiles", F.coalesce(F.length(F.trim("text")) < 20, F.lit(True)), F.lit("text too short to be read")),
        Check("salt_removal_failed", F.length("_part") < 15, F.lit("no part is long enough")),
        Check("invalid_atoms", F.size("_bad") > 0, F.concat(F.lit("marks not allowed: "), F.array_join("_bad", ","))),
        Check("lipinski_violations", F.col("_words") > 500,
              F.concat(F.lit("too many words: "), F.col("_words").cast("string"), F.lit(" (more than 500)"))),
    ]
    return cleaning.route_failures(prepared, checks).drop("_bad", "_words", "_part")


_ROUTED_SQL = f"""
  prepared AS (SELECT doc_id, text,
      list_sort(list_distinct(list_filter(regexp_extract_all(text, '[^\\p{{L}}\\s]'),
          lambda t: NOT list_contains({_ALLOWED_SQL}, t)))) AS bad,
      len(string_split(trim(text), ' ')) AS words,
      list_max(list_transform(string_split(text, '.'), lambda p: length(p))) AS longest
    FROM documents),
  routed AS (SELECT doc_id, text, CASE
      WHEN coalesce(length(trim(text)) < 20, true) THEN 'invalid_smiles'
      WHEN longest < 15 THEN 'salt_removal_failed'
      WHEN len(bad) > 0 THEN 'invalid_atoms'
      WHEN words > 500 THEN 'lipinski_violations' END AS failure_type,
    CASE
      WHEN coalesce(length(trim(text)) < 20, true) THEN 'text too short to be read'
      WHEN longest < 15 THEN 'no part is long enough'
      WHEN len(bad) > 0 THEN 'marks not allowed: ' || array_to_string(bad, ',')
      WHEN words > 500 THEN 'too many words: ' || words || ' (more than 500)' END AS reason
    FROM prepared)"""


@query("failure_routing", f"WITH {_ROUTED_SQL} SELECT doc_id, failure_type, reason FROM routed")
def _failure_routing(spark, sf):
    return _routed(spark, sf).select("doc_id", "failure_type", "reason")


@query(
    "failure_summary",
    f"""WITH {_ROUTED_SQL} SELECT failure_type, count(*) AS n_failed FROM routed
        WHERE failure_type IS NOT NULL GROUP BY failure_type""",
)
def _failure_summary(spark, sf):
    return cleaning.failure_summary(_routed(spark, sf))


@query(
    "success_rates",
    f"""WITH {_ROUTED_SQL}, firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
        c AS (SELECT count(*) AS n_checked, count(failure_type) AS n_failed,
                     (SELECT count(*) FROM documents) AS n_input
              FROM routed SEMI JOIN firsts USING (doc_id))
        SELECT n_input, n_failed, round((n_input - n_failed) / n_input * 100, 6) AS success_of_input,
               round((n_checked - n_failed) / n_checked * 100, 6) AS success_of_unique FROM c""",
)
def _success_rates(spark, sf):
    d = table(spark, sf, "documents")
    firsts = cleaning.keep_first(d.select("doc_id", "text"), ["text"], "doc_id").select("doc_id")
    routed = _routed(spark, sf).join(firsts, "doc_id", "left_semi")
    duplicates = d.agg(F.count(F.lit(1))).scalar() - firsts.agg(F.count(F.lit(1))).scalar()
    rates = cleaning.success_rates(routed, duplicates)
    return rates.select(
        "n_input", "n_failed", *[F.round(c, 6).alias(c) for c in ("success_of_input", "success_of_unique")]
    )


@query(
    "largest_fragment",
    """WITH parts AS (SELECT doc_id, unnest(string_split(text, '.')) AS part,
                             unnest(range(len(string_split(text, '.')))) AS i FROM documents)
       SELECT doc_id, part AS fragment FROM (
         SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY length(part) DESC, i) AS n FROM parts)
       WHERE n = 1""",
)
def _largest_fragment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.largest_fragment(F.col("text")).alias("fragment"))


@query(
    "artifact_filter",
    """SELECT o_orderkey, round(100000 - o_totalprice, 2) AS score FROM orders WHERE round(100000 - o_totalprice, 2) < 0""",
)
def _artifact_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.round(100000 - F.col("o_totalprice"), 2).alias("score"))
    return cleaning.drop_artifacts(o, "score")


@query(
    "missing_markers",
    """SELECT doc_id, array_to_string(list_filter(['the', 'que', 'sch'], lambda m: NOT contains(coalesce(text, ''), m)), ',') AS missing
       FROM documents
       WHERE NOT (contains(coalesce(text, ''), 'the') AND contains(coalesce(text, ''), 'que') AND contains(coalesce(text, ''), 'sch'))""",
)
def _missing_markers(spark, sf):
    d = table(spark, sf, "documents")
    found = text.missing_markers(F.col("text"), ["the", "que", "sch"])
    return d.select("doc_id", found.alias("_m")).filter(F.size("_m") > 0).select("doc_id", F.array_join("_m", ",").alias("missing"))


@query(
    "default_names",
    """SELECT event_id, coalesce(nullif(trim(CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END), ''),
              nullif(trim(CASE WHEN user_id % 2 = 0 THEN '' ELSE 'u' || user_id END), ''), 'mol_' || event_id) AS name
       FROM events""",
)
def _default_names(spark, sf):
    e = table(spark, sf, "events")
    first = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    other = F.when(F.col("user_id") % 2 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return e.select("event_id", text.default_name(first, other, F.col("event_id")).alias("name"))


@query(
    "first_number",
    r"""SELECT page_id, try_cast(nullif(regexp_extract(split_part(url, '$$', 1), '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), '') AS DOUBLE) AS number
        FROM pages""",
)
def _first_number(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.first_number(F.col("url")).alias("number"))


@query(
    "file_keys",
    r"""WITH f AS (SELECT p_partkey, lower(p_type) || '_scores_' || p_brand || '_r_' || p_size || '.csv' AS file FROM part)
        SELECT p_partkey, regexp_extract(file, '([^/_]+)[^/]*$', 1) AS model,
               try_cast(regexp_extract(file, '_(\d+)\.[^./]*$', 1) AS INTEGER) AS round FROM f""",
)
def _file_keys(spark, sf):
    p = table(spark, sf, "part")
    file = F.concat(F.lower("p_type"), F.lit("_scores_"), "p_brand", F.lit("_r_"), F.col("p_size").cast("string"), F.lit(".csv"))
    named = p.select("p_partkey", file.alias("file"))
    return named.select("p_partkey", text.model_of_file(F.col("file")).alias("model"), text.round_of_file(F.col("file")).alias("round"))


@query(
    "reason_tidy",
    """WITH r AS (SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE replace(text, ',', ';') END AS reason FROM documents)
       SELECT doc_id, coalesce(replace(reason, ';', ', '), 'no reason given') AS reason,
              CASE WHEN length(coalesce(reason, 'no reason given')) > 100
                   THEN substring(reason, 1, 100) || ' [cut]'
                   ELSE coalesce(reason, 'no reason given') END AS preview FROM r""",
)
def _reason_tidy(spark, sf):
    d = table(spark, sf, "documents")
    raw = d.select("doc_id", F.when(F.col("lang") != "de", F.replace("text", F.lit(","), F.lit(";"))).alias("raw"))
    return raw.select(
        "doc_id", text.tidy_reason(F.col("raw")).alias("reason"), text.reason_preview(F.col("raw")).alias("preview")
    )


@query(
    "base26_ids",
    """SELECT c_custkey, CASE WHEN c_custkey < 676
              THEN 'K' || chr((65 + c_custkey // 26)::INTEGER) || chr((65 + c_custkey % 26)::INTEGER)
              ELSE substring('K' || c_custkey, 1, 3) END AS id FROM customer""",
)
def _base26(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.base26_id(F.col("c_custkey")).alias("id"))


# stand-in descriptors of a document, all from its whole text
def descriptors(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))

    def count_of(pattern):
        return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))

    words = F.size(F.filter(F.split(F.col("text"), r"[ \t\r\n]+"), lambda w: w != ""))
    return d.select(
        "doc_id", "text",
        (F.length("text") * 0.2).alias("MW"),
        F.when(words > 0, F.floor(count_of(r"[a-zA-Z]") * 10 / words) / 10.0).alias("LogP"),
        count_of("[0-9]").cast("long").alias("HBD"),
        count_of("\n").cast("long").alias("HBA"),
        count_of(",").cast("long").alias("RotBonds"),
        words.cast("double").alias("TPSA"),
        count_of("[!?]").cast("long").alias("ArRings"),
    )


DESCRIPTOR_SQL = r"""
  words AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) AS words FROM documents),
  desc_t AS (SELECT doc_id, text, length(text) * 0.2::DOUBLE AS MW,
      CASE WHEN words > 0 THEN floor((length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g'))) * 10 / words) / 10.0::DOUBLE END AS LogP,
      length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS HBD,
      length(text) - length(replace(text, chr(10), '')) AS HBA,
      length(text) - length(replace(text, ',', '')) AS RotBonds,
      words::DOUBLE AS TPSA,
      length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS ArRings
    FROM words)"""

SEVEN = {
    "mw": "MW", "logp": "LogP", "hbd": "HBD", "hba": "HBA",
    "rotatable_bonds": "RotBonds", "tpsa": "TPSA", "aromatic_rings": "ArRings",
}


@query(
    "text_descriptors",
    r"""SELECT doc_id, length(text)::DOUBLE AS n_chars,
               len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> ''))::DOUBLE AS n_words,
               round((length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0)), 6) AS digit_share,
               round((length(regexp_replace(text, '[ \t\r\n]', '', 'g'))
                 / nullif(len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')), 0)), 6) AS word_length
        FROM documents""",
)
def _text_descriptors(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    cols = text.text_descriptors(F.col("text"))
    return d.select(
        "doc_id", *[(F.round(c, 6) if n in ("digit_share", "word_length") else c).alias(n) for n, c in cols.items()]
    )


@query(
    "seven_limits",
    f"""WITH {DESCRIPTOR_SQL}, v AS (SELECT *,
          (MW > 500)::INT + (LogP > 5)::INT + (HBD > 5)::INT + (HBA > 10)::INT + (RotBonds > 10)::INT
          + (TPSA > 140)::INT + (ArRings > 5)::INT AS n FROM desc_t)
        SELECT doc_id, coalesce(n <= 1, true) AS passes,
          coalesce(nullif(concat_ws('; ',
            CASE WHEN MW > 500 THEN 'MW=' || printf('%.1f', MW) || ' (>500)' END,
            CASE WHEN LogP > 5 THEN 'LogP=' || printf('%.1f', LogP) || ' (>5)' END,
            CASE WHEN HBD > 5 THEN 'HBD=' || HBD || ' (>5)' END,
            CASE WHEN HBA > 10 THEN 'HBA=' || HBA || ' (>10)' END,
            CASE WHEN RotBonds > 10 THEN 'RotBonds=' || RotBonds || ' (>10)' END,
            CASE WHEN TPSA > 140 THEN 'TPSA=' || printf('%.1f', TPSA) || ' (>140)' END,
            CASE WHEN ArRings > 5 THEN 'AromaticRings=' || ArRings || ' (>5)' END), ''), 'No violations') AS violations
        FROM v""",
)
def _seven_limits(spark, sf):
    cols = {k: F.col(c) for k, c in SEVEN.items()}
    d = descriptors(spark, sf)
    return d.select(
        "doc_id", scoring.passes_seven_limits(cols).alias("passes"), scoring.violation_text(cols).alias("violations")
    )


FIVE_SQL = """
  five AS (SELECT *, (MW > 500)::INT + (LogP > 5)::INT + (HBD > 5)::INT + (HBA > 10)::INT AS Lipinski_Violations,
      coalesce(NOT (MW > 500 OR LogP > 5 OR HBD > 5 OR HBA > 10), false) AS Lipinski_Compliant,
      coalesce(MW <= 350 AND LogP <= 3.5 AND RotBonds <= 7, false) AS Lead_Like FROM desc_t)"""


def with_rule_of_five(df):
    cols = {c: F.col(c) for c in ("MW", "LogP", "HBD", "HBA", "RotBonds")}
    return df.withColumns(scoring.rule_of_five(cols))


@query(
    "rule_of_five",
    f"WITH {DESCRIPTOR_SQL}, {FIVE_SQL} SELECT doc_id, Lipinski_Violations, Lipinski_Compliant, Lead_Like FROM five",
)
def _rule_of_five(spark, sf):
    return with_rule_of_five(descriptors(spark, sf)).select(
        "doc_id", "Lipinski_Violations", "Lipinski_Compliant", "Lead_Like"
    )


@query(
    "export_rounding",
    """SELECT event_id, user_id, round_even(value * 1.00125::DOUBLE * 1000, 0) / 1000 AS value, event_type FROM events""",
)
def _export_rounding(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("value") * 1.00125).alias("value"), "event_type")
    return scoring.rounded_for_export(e)
