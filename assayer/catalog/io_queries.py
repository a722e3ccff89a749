"""Readers and writers, each over files written from the whole of a driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import query, table
from assayer.catalog.structure_queries import _SITES_SQL, site_rows
from assayer.operators import geometry, ranking, sites
from assayer.session import fresh_path
from assayer.sources import library, lines, records, sinks, structures
from assayer.streaming import progress


def _write_text(df, path, by, order):
    """Text files in one folder per ``by`` value, lines in order."""
    df.select(by, order, "value").repartition(by).sortWithinPartitions(by, order).select(by, "value").write.partitionBy(by).text(path)


def _key_of(by):
    return F.regexp_extract("file", rf"{by}=([^/]+)/", 1)


def _event_lines(spark, sf):
    e = table(spark, sf, "events")
    value = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("  item"), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit("# note "), F.col("event_id").cast("string")))
        .when(F.col("user_id") % 10 == 0, F.lit("   "))
        .otherwise(F.concat(F.lit("item"), F.col("event_id").cast("string"), F.lit("\t name"), F.col("user_id").cast("string"), F.lit(" rest")))
    )
    return e.select(F.dayofyear("ts").alias("day"), "event_id", value.alias("value"))


@query(
    "library_reader",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY dayofyear(ts) ORDER BY event_id) AS line_no FROM events)
       SELECT 'item' || event_id AS item, CASE WHEN event_type = 'error' THEN 'mol_' || line_no ELSE 'name' || user_id END AS name, line_no
       FROM n WHERE event_type = 'error' OR (event_type <> 'view' AND user_id % 10 <> 0)""",
)
def _library_reader(spark, sf):
    path = fresh_path(spark, "library")
    _write_text(_event_lines(spark, sf), path, "day", "event_id")
    return library.read_library(spark, path)


@query(
    "pair_reader",
    """SELECT p_brand AS item, p_name_one AS name FROM (SELECT p_brand, replace(p_name, ' ', '_') AS p_name_one, p_size FROM part) WHERE p_size % 2 = 0""",
)
def _pair_reader(spark, sf):
    path = fresh_path(spark, "pairs")
    p = table(spark, sf, "part")
    extra = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit(" third"))
    p.select(F.concat(F.lit(" "), "p_brand", F.lit("\t"), F.replace("p_name", F.lit(" "), F.lit("_")), extra).alias("value")).write.text(path)
    return library.read_pairs(spark, path)


@query("scored_reader", "SELECT o_orderpriority AS item, 'o' || o_orderkey AS name, -o_totalprice AS score FROM orders")
def _scored_reader(spark, sf):
    path = fresh_path(spark, "scored")
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("SMILES"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("ID"),
        (-F.col("o_totalprice")).alias("minimizedAffinity"),
    )
    sinks.write_delimited(o, path, header=True)
    return library.read_scored(spark, path, header=True)


def _blocks(spark, sf):
    e = table(spark, sf, "events")
    title = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat(F.lit("rec"), F.col("event_id").cast("string")))
    tag = F.when(F.col("user_id") % 7 == 0, F.lit("> <other>\nnone")).otherwise(
        F.concat(F.lit("> <minimizedAffinity>\n"), (-F.col("value")).cast("string"))
    )
    block = F.concat(title, F.lit("\n  body "), F.col("event_id").cast("string"), F.lit("\n"), tag, F.lit("\n"))
    return e.select(F.dayofyear("ts").alias("day"), "event_id", F.concat(block, F.lit("\n$$$$")).alias("value"))


def _record_files(spark, sf):
    path = fresh_path(spark, "records")
    _write_text(_blocks(spark, sf), path, "day", "event_id")
    return path


_RECORDS_SQL = """rec AS (SELECT dayofyear(ts) AS day, row_number() OVER (PARTITION BY dayofyear(ts) ORDER BY event_id) AS ordinal, event_id,
     event_type, CASE WHEN user_id % 7 <> 0 THEN -value END AS score FROM events),
   named AS (SELECT day, ordinal, event_id, score, CASE WHEN event_type = 'error' THEN 'mol_' || ordinal ELSE 'rec' || event_id END AS name FROM rec)"""


@query("record_reader", f"WITH {_RECORDS_SQL} SELECT day, ordinal, name, score FROM named")
def _record_reader(spark, sf):
    r = records.read_records(spark, _record_files(spark, sf))
    return r.select(_key_of("day").cast("int").alias("day"), "ordinal", "name", "score")


@query("record_counts", "SELECT dayofyear(ts) AS day, count(*) AS n FROM events GROUP BY 1")
def _record_counts(spark, sf):
    counted = lines.count_records(spark, _record_files(spark, sf))
    return counted.select(_key_of("day").cast("int").alias("day"), "n")


@query("line_counts", "SELECT dayofyear(ts) AS day, 6 * count(*) AS n FROM events GROUP BY 1")
def _line_counts(spark, sf):
    """Physical lines, blank ones included: title, body, tag, value, blank and terminator per record."""
    counted = lines.count_lines(spark, _record_files(spark, sf))
    return counted.select(_key_of("day").cast("int").alias("day"), "n")


@query("record_artifacts", f"WITH {_RECORDS_SQL} SELECT name, score FROM named WHERE score < 0")
def _record_artifacts(spark, sf):
    return records.to_scored(records.read_records(spark, _record_files(spark, sf)))


@query(
    "top_records",
    f"""WITH {_RECORDS_SQL} SELECT event_id, score FROM named WHERE score IS NOT NULL ORDER BY score, event_id LIMIT 500""",
)
def _top_records(spark, sf):
    """The best 500 records, written in order with terminators and read back."""
    found = records.read_records(spark, _record_files(spark, sf))
    # the input is many files: order by day, then by place in the file
    ordered = found.withColumn("ordinal", _key_of("day").cast("long") * 10**9 + F.col("ordinal"))
    path = fresh_path(spark, "top")
    records.write_records(records.reorder_records(ordered, 500), path, ["score", "ordinal"])
    body = F.regexp_extract("block", r"body (\d+)", 1).cast("long")
    return records.read_records(spark, path).select(body.alias("event_id"), "score")


def _atom_lines(spark, sf):
    e = table(spark, sf, "embeddings")
    at = [F.round(F.get("embedding", F.lit(i)).cast("double") * 100, 3) for i in range(3)]
    kinds = F.array(*[F.lit(k) for k in ["C", "A", "N", "NA", "OA", "S", "Cl", "HD", "Zn", "Br"]])
    body = F.format_string("ATOM  %5d  C   LIG A   1    %8.3f%8.3f%8.3f  0.00  0.00     0.000 %-2s", "vec_id", *at, F.get(kinds, F.col("label")))
    value = F.when(F.col("vec_id") % 40 == 39, F.lit("TORSDOF 3")).otherwise(body)
    return e.select("label", "vec_id", value.alias("value"))


@query(
    "atom_reader",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS line_no FROM embeddings),
            s AS (SELECT label, min(line_no) FILTER (vec_id % 40 = 39) AS stop FROM a GROUP BY label)
       SELECT label, line_no, round(embedding[1]::DOUBLE * 100, 3) AS x, round(embedding[2]::DOUBLE * 100, 3) AS y,
              round(embedding[3]::DOUBLE * 100, 3) AS z, [0, 0, 1, 1, 2, 3, 6, 1000, 1000, 7][label + 1] AS type
       FROM a JOIN s USING (label) WHERE stop IS NULL OR line_no < stop""",
)
def _atom_reader(spark, sf):
    path = fresh_path(spark, "atoms")
    _write_text(_atom_lines(spark, sf), path, "label", "vec_id")
    found = structures.read_atoms(spark, path, stop_at="TORSDO")
    return found.select(_key_of("label").cast("int").alias("label"), "line_no", "x", "y", "z", "type")


@query(
    "term_reader",
    """SELECT o_custkey % 20 AS job, arg_min(o_orderkey, o_orderkey)::DOUBLE AS term1, max(o_orderkey)::DOUBLE AS term2,
              count(*)::DOUBLE AS term3, min(o_totalprice) AS term4, max(o_totalprice) AS term5 FROM orders GROUP BY 1""",
)
def _term_reader(spark, sf):
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("job")).agg(
        F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count(F.lit(1)).alias("c"),
        F.min("o_totalprice").alias("d"), F.max("o_totalprice").alias("e"),
    )
    numbers = F.concat_ws(" ", *[F.col(c).cast("string") for c in "abcde"])
    log = F.array(F.lit("start"), F.lit("## Name gauss repulsion"), F.lit("run"), F.concat(F.lit("## lig "), numbers, F.lit(" end")), F.lit("## tail"))
    rows = o.select("job", F.posexplode(log).alias("i", "value"))
    path = fresh_path(spark, "terms")
    _write_text(rows, path, "job", "i")
    found = structures.read_terms(spark, path)
    return found.select(_key_of("job").cast("long").alias("job"), *[f"term{i}" for i in range(1, 6)])


@query(
    "site_report",
    f"""WITH {_SITES_SQL} SELECT structure, (ordinal + 1)::VARCHAR AS section, volume, area AS total_sasa,
          depth AS mean_local_hydrophobic_density, hydrophobicity AS hydrophobicity_score FROM s""",
)
def _site_report(spark, sf):
    s = site_rows(spark, sf)
    def field(label, column):
        return F.concat(F.lit(f"\t{label} : \t"), F.col(column).cast("string"))
    report = F.array(
        F.concat(F.lit("Pocket "), (F.col("ordinal") + 1).cast("string"), F.lit(" :")), field("Volume", "volume"),
        field("total SASA", "area"), field("Mean local hydrophobic density", "depth"), field("Hydrophobicity score", "hydrophobicity"), F.lit(""),
    )
    rows = s.select("structure", "ordinal", F.posexplode(report).alias("i", "value")).withColumn("n", F.col("ordinal") * 6 + F.col("i"))
    path = fresh_path(spark, "report")
    _write_text(rows, path, "structure", "n")
    found = structures.read_site_report(spark, path)
    return found.select(
        _key_of("structure").cast("int").alias("structure"), "section", "volume", "total_sasa",
        "mean_local_hydrophobic_density", "hydrophobicity_score",
    )


@query(
    "residue_reader",
    """WITH a AS (SELECT c_nationkey AS structure, c_custkey, c_custkey // 4 % 2000 AS resnum, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_no,
                    CASE WHEN c_acctbal < 0 THEN 'A' ELSE 'B' END AS chain, upper(substr(c_mktsegment, 1, 3)) AS resname FROM customer)
       SELECT structure, chain, resnum::INTEGER AS resnum, resname, min(line_no) AS first_line FROM a WHERE c_custkey % 9 <> 0 GROUP BY ALL""",
)
def _residue_reader(spark, sf):
    c = table(spark, sf, "customer")
    chain = F.when(F.col("c_acctbal") < 0, " ").otherwise("B")
    number = F.when(F.col("c_custkey") % 9 == 0, F.lit("  xx")).otherwise(
        F.lpad((F.floor(F.col("c_custkey") / 4) % 2000).cast("string"), 4, " ")
    )
    value = F.concat(F.lit("ATOM      1  CA  "), F.upper(F.substring("c_mktsegment", 1, 3)), F.lit(" "), chain, number, F.lit("    "))
    path = fresh_path(spark, "residues")
    _write_text(c.select(F.col("c_nationkey").alias("structure"), "c_custkey", value.alias("value")), path, "structure", "c_custkey")
    found = structures.read_residues(spark, path)
    return found.select(_key_of("structure").cast("int").alias("structure"), "chain", "resnum", "resname", "first_line")


@query(
    "centre_reader",
    """SELECT label, round(embedding[1]::DOUBLE * 100, 3) AS x, round(embedding[2]::DOUBLE * 100, 3) AS y, round(embedding[3]::DOUBLE * 100, 3) AS z
       FROM embeddings WHERE vec_id % 11 <> 0""",
)
def _centre_reader(spark, sf):
    e = table(spark, sf, "embeddings")
    at = [F.round(F.get("embedding", F.lit(i)).cast("double") * 100, 3) for i in range(3)]
    fixed = F.format_string("ATOM  %5d    O STP     1    %8.3f%8.3f%8.3f  0.00  0.00", "vec_id", *at)
    spaced = F.format_string("ATOM %d O STP 1 %.3f %.3f %.3f 0.00", "vec_id", *at)
    value = F.when(F.col("vec_id") % 11 == 0, F.lit("ATOM broken line")).when(F.col("vec_id") % 5 == 0, spaced).otherwise(fixed)
    path = fresh_path(spark, "centres")
    _write_text(e.select("label", "vec_id", value.alias("value")), path, "label", "vec_id")
    return structures.read_centres(spark, path).select(_key_of("label").cast("int").alias("label"), "x", "y", "z")


@query(
    "triple_reader",
    """SELECT 'rec' || l_suppkey || '.pdbqt' AS receptor, 'lig' || l_orderkey || '.PDBQT' AS ligand, 'ref' || l_partkey || '.pdbqt' AS reference
       FROM lineitem WHERE l_linenumber > 1""",
)
def _triple_reader(spark, sf):
    li = table(spark, sf, "lineitem")
    third = F.when(F.col("l_linenumber") > 1, F.concat(F.lit(" ;ref"), F.col("l_partkey").cast("string"), F.lit(".pdbqt"))).otherwise(F.lit(""))
    value = F.concat(
        F.lit(" rec"), F.col("l_suppkey").cast("string"), F.lit(".pdbqt; lig"), F.col("l_orderkey").cast("string"), F.lit(".PDBQT"), third
    )
    path = fresh_path(spark, "triples")
    li.select(value.alias("value")).write.text(path)
    return library.read_triples(spark, path)


@query("weight_reader", "SELECT p_type AS component, round(avg(p_size), 4) AS weight FROM part GROUP BY p_type")
def _weight_reader(spark, sf):
    w = table(spark, sf, "part").groupBy("p_type").agg(F.round(F.avg("p_size"), 4).alias("w"))
    path = fresh_path(spark, "weights")
    w.select(F.concat("p_type", F.lit(": "), F.col("w").cast("string"), F.lit("\n")).alias("value")).write.text(path)
    return library.read_weights(spark, path)


@query("merged_parts", "SELECT 'o' || o_orderkey || ',' || o_orderstatus AS value FROM orders UNION ALL SELECT 'name,score'")
def _merged_parts(spark, sf):
    o = table(spark, sf, "orders")
    paths = []
    for status in "FOP":
        path = fresh_path(spark, f"part{status}")
        part = o.filter(F.col("o_orderstatus") == status).select(
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("score")
        )
        sinks.write_delimited(part.coalesce(1), path, header=True)
        paths.append(path)
    return library.read_parts(spark, [*paths, f"{paths[0]}-absent"]).select("value")


@query("failure_sink", "SELECT doc_id::VARCHAR AS name, CASE WHEN lang = 'en' THEN 'invalid_smiles' ELSE 'invalid_atoms' END AS failure_type, 'of ' || source AS reason FROM documents")
def _failure_sink(spark, sf):
    d = table(spark, sf, "documents")
    failures = d.select(
        F.col("doc_id").alias("name"), F.md5("text").alias("item"),
        F.when(F.col("lang") == "en", "invalid_smiles").otherwise("invalid_atoms").alias("failure_type"),
        F.concat(F.lit("of "), "source").alias("reason"),
    )
    path = fresh_path(spark, "failures")
    sinks.write_failures(failures, path)
    back = spark.read.schema("Name string, SMILES string, Failure_Reason string, failure_type string").csv(path, sep="\t", header=True)
    return back.select(F.col("Name").alias("name"), "failure_type", F.col("Failure_Reason").alias("reason"))


def _points(spark, sf):
    """Every embedding as 21 points, numbered in order."""
    e = table(spark, sf, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    points = e.select(
        (F.col("vec_id") * 21 + F.col("i")).alias("_at"), sites.base26_id(F.col("label")).alias("group_id"),
        *[(F.round(F.get("embedding", F.col("i") * 3 + k).cast("double") * 100, 3) + 0.0).alias(a) for k, a in enumerate("xyz")],
    )
    return ranking.row_positions(points, "_at", "_p").withColumn("n", F.col("_p") + 1)


_POINT_SQL = """SELECT vec_id * 21 + i + 1 AS n, printf('HETATM%5d  C   %3s A   1    %8.3f%8.3f%8.3f  1.00  0.00           C', (vec_id * 21 + i) % 99999 + 1,
              'K' || chr((65 + label // 26)::INTEGER) || chr((65 + label % 26)::INTEGER),
              round(embedding[i * 3 + 1]::DOUBLE * 100, 3) + 0.0::DOUBLE, round(embedding[i * 3 + 2]::DOUBLE * 100, 3) + 0.0::DOUBLE,
              round(embedding[i * 3 + 3]::DOUBLE * 100, 3) + 0.0::DOUBLE) AS value
       FROM embeddings, range(21) r(i)"""


@query("point_lines", _POINT_SQL)
def _point_lines(spark, sf):
    return sinks.point_lines(_points(spark, sf))


@query("written_points", f"SELECT value FROM ({_POINT_SQL})")
def _written_points(spark, sf):
    """The point lines as files, read back."""
    path = fresh_path(spark, "points")
    sinks.write_points(_points(spark, sf), path)
    return spark.read.text(path)


@query("exported_table", "SELECT l_partkey AS part, round_even(avg(l_extendedprice)::DOUBLE * 1000, 0) / 1000 AS price, count(*) AS lines FROM lineitem GROUP BY l_partkey")
def _exported_table(spark, sf):
    """The three-decimal export as files, read back."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.avg("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("lines"))
    path = fresh_path(spark, "export")
    sinks.export_table(li, path)
    return spark.read.schema("part long, price double, lines long").csv(path, header=True)


@query(
    "site_payload",
    f"""WITH {_SITES_SQL} SELECT structure, rank, round_even(volume * 10, 0) / 10 AS volume, round_even(area * 10, 0) / 10 AS area,
          round_even(hydrophobicity * 1000, 0) / 1000 AS hydrophobicity, rank = 1 AS is_best FROM ranked""",
)
def _site_payload(spark, sf):
    """The JSON payload, parsed again."""
    ranked = sites.rank_sites(site_rows(spark, sf), "structure")
    points = table(spark, sf, "embeddings").select(
        F.col("label").alias("structure"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")]
    )
    centres = geometry.centroids(points, ranked, ["structure"])
    payload = ranked.join(centres, "structure").select("structure", sinks.site_payload().alias("json"))
    parsed = payload.withColumn("p", F.from_json("json", "rank long, volume double, area double, hydrophobicity double, is_best boolean"))
    return parsed.select("structure", "p.rank", "p.volume", "p.area", "p.hydrophobicity", "p.is_best")


@query(
    "metrics_union",
    """SELECT 'RF_r' || l_linenumber AS "Rounds", round(avg(l_quantity), 4) AS mse, round(avg(l_discount), 4) AS r2
       FROM lineitem GROUP BY l_linenumber""",
)
def _metrics_union(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.round(F.avg("l_quantity"), 4).alias("mse"), F.round(F.avg("l_discount"), 4).alias("r2")
    )
    named = m.select("l_linenumber", F.concat(F.lit("RF_r"), F.col("l_linenumber").cast("string")).alias("label"), "mse", "r2")
    path = fresh_path(spark, "metrics")
    named.write.partitionBy("l_linenumber").csv(path, header=True)
    return sinks.union_metrics(spark, [f"{path}/*"], "label string, mse double, r2 double")


@query(
    "progress_counts",
    """WITH d AS (SELECT event_type AS job, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY 1),
            t AS (SELECT event_type AS job, count(*) AS n_total FROM events GROUP BY 1)
       SELECT job, least(n, n_total) AS n_done, n_total, round(least(n, n_total) * 100.0::DOUBLE / n_total, 6) AS percent FROM d JOIN t USING (job)""",
)
def _progress_counts(spark, sf):
    """A results folder that grew in parts, counted by a stream to its end."""
    e = table(spark, sf, "events")
    folder = fresh_path(spark, "results")
    done = e.filter("user_id % 3 <> 0").select(F.col("event_type").alias("job"), "event_id")
    done.repartition(6).write.parquet(folder)
    totals = e.groupBy(F.col("event_type").alias("job")).agg(F.count(F.lit(1)).alias("n_total"))
    name = "progress_" + folder.rsplit("-", 1)[-1]
    run = progress.follow(spark, folder, done.schema, totals, fresh_path(spark, "stream"), name, files_per_trigger=2)
    run.awaitTermination()
    return spark.table(name).withColumn("percent", F.round("percent", 6))
