"""Contacts, centres, structure checks and site ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import query, table
from assayer.operators import cleaning, geometry, sites
from assayer.sources.structures import section_fields


N_COMPLEXES = 25


def atoms(spark, sf):
    """Every embedding as 21 atoms, three values each (64 values leave one over, which shifts the last place); the id gives complex and side."""
    e = table(spark, sf, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    at = [
        F.round((F.get("embedding", F.col("i") * 3 + k) + F.when((F.col("i") == 20) & (F.lit(a) == "z"), F.get("embedding", F.lit(63))).otherwise(F.lit(0.0)).cast("float")).cast("double") * 100, 3).alias(a)
        for k, a in enumerate("xyz")
    ]
    return e.select(
        (F.floor(F.col("vec_id") / 2) % N_COMPLEXES).alias("complex_id"), (F.col("vec_id") % 2 == 0).alias("is_item"), *at,
        F.when(F.col("vec_id") % 2 == 0, (F.col("label") + F.col("i")) % 9).otherwise((F.col("label") + F.col("i")) % 5).alias("type"),
    )


_ATOMS_SQL = f"""atoms AS (SELECT (vec_id // 2) % {N_COMPLEXES} AS complex_id, vec_id % 2 = 0 AS is_item,
      round(embedding[i * 3 + 1]::DOUBLE * 100, 3) AS x, round(embedding[i * 3 + 2]::DOUBLE * 100, 3) AS y,
      round((embedding[i * 3 + 3] + CASE WHEN i = 20 THEN embedding[64] ELSE 0::FLOAT END)::DOUBLE * 100, 3) AS z,
      CASE WHEN vec_id % 2 = 0 THEN (label + i) % 9 ELSE (label + i) % 5 END AS type FROM embeddings, range(21) r(i)),
    contacts AS (SELECT l.complex_id, l.type AS item_type, r.type AS receptor_type, count(*) AS n_contacts
      FROM atoms l JOIN atoms r ON l.complex_id = r.complex_id AND l.is_item AND NOT r.is_item AND r.type < 4
       AND (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z) < 144 GROUP BY ALL)"""


def _sides(spark, sf):
    a = atoms(spark, sf)
    return a.filter("is_item").drop("is_item"), a.filter("NOT is_item").drop("is_item")


@query("atom_contacts", f"WITH {_ATOMS_SQL} SELECT * FROM contacts")
def _atom_contacts(spark, sf):
    return geometry.contacts(*_sides(spark, sf))


_PIVOT = ", ".join(
    f"coalesce(sum(n_contacts) FILTER (item_type * 4 + receptor_type = {i}), 0)::DOUBLE AS \"{f}\""
    for i, f in enumerate(geometry.feature_names())
)


@query(
    "contact_pivot",
    f"""WITH {_ATOMS_SQL}, c AS (SELECT DISTINCT complex_id FROM atoms WHERE is_item)
        SELECT complex_id, {_PIVOT} FROM c LEFT JOIN contacts USING (complex_id) GROUP BY complex_id""",
)
def _contact_pivot(spark, sf):
    items, receptors = _sides(spark, sf)
    return geometry.contact_features(geometry.contacts(items, receptors), items)


def terms(spark, sf):
    """Stand-in score terms per complex from the orders of its number."""
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % N_COMPLEXES).alias("complex_id")).agg(
        *[F.round(F.avg((F.col("o_totalprice") % (10 + i)) / 10), 4).alias(t) for i, t in enumerate(geometry.TERMS)]
    )
    return o


@query(
    "contact_terms",
    f"""WITH {_ATOMS_SQL}, c AS (SELECT DISTINCT complex_id FROM atoms WHERE is_item),
          f AS (SELECT complex_id, {_PIVOT} FROM c LEFT JOIN contacts USING (complex_id) GROUP BY complex_id),
          t AS (SELECT o_custkey % {N_COMPLEXES} AS complex_id, {", ".join(f'round(avg((o_totalprice % {10 + i}) / 10), 4) AS "{t}"' for i, t in enumerate(geometry.TERMS))}
                FROM orders GROUP BY 1)
        SELECT * FROM f JOIN t USING (complex_id)""",
)
def _contact_terms(spark, sf):
    items, receptors = _sides(spark, sf)
    return geometry.with_terms(geometry.contact_features(geometry.contacts(items, receptors), items), terms(spark, sf))


@query(
    "centroids",
    """WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
            g AS (SELECT s_suppkey % 12 AS label FROM supplier GROUP BY 1)
       SELECT g.label, round(coalesce(avg(x), 0), 6) AS cx, round(coalesce(avg(y), 0), 6) AS cy, round(coalesce(avg(z), 0), 6) AS cz,
              count(x) AS n_points FROM g LEFT JOIN p ON p.label = g.label GROUP BY g.label""",
)
def _centroids(spark, sf):
    e = table(spark, sf, "embeddings")
    points = e.select(
        F.col("label").cast("long").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")]
    )
    groups = table(spark, sf, "supplier").select((F.col("s_suppkey") % 12).alias("label"))
    c = geometry.centroids(points, groups, ["label"])
    return c.withColumns({n: F.round(n, 6) for n in ("cx", "cy", "cz")})


def _triples(spark, sf):
    """Every embedding as 21 points whose small coordinates are cut to zero."""
    cut = F.transform("embedding", lambda v: F.when(F.abs(v) > 0.3, F.round(v.cast("double"), 4)).otherwise(F.lit(0.0)))
    e = table(spark, sf, "embeddings").select("vec_id", cut.alias("v"))
    return e.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")).select(
        "vec_id", "i", *[F.get("v", F.col("i") * 3 + k).alias(a) for k, a in enumerate("xyz")]
    )


_TRIPLES_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN abs(e) > 0.3::FLOAT THEN round(e::DOUBLE, 4) ELSE 0 END) AS v FROM embeddings),
  t AS (SELECT vec_id, i, v[i * 3 + 1] AS x, v[i * 3 + 2] AS y, v[i * 3 + 3] AS z FROM v, range(21) r(i)),
  m AS (SELECT vec_id, max(greatest(abs(x), abs(y), abs(z))) AS m, max(abs(z)) AS mz, count(*) AS n FROM t GROUP BY vec_id)"""


@query("zero_coordinates", f"WITH {_TRIPLES_SQL} SELECT vec_id, i, x, y, z FROM t SEMI JOIN (SELECT vec_id FROM m WHERE m >= 1e-6) USING (vec_id)")
def _zero_coordinates(spark, sf):
    return cleaning.drop_zero_coordinates(_triples(spark, sf), "vec_id")


@query(
    "coordinate_audit",
    f"WITH {_TRIPLES_SQL} SELECT vec_id, n AS n_atoms, false AS has_error, m < 1e-6 AS all_zero, mz > 0.001 AS is_3d FROM m",
)
def _coordinate_audit(spark, sf):
    return cleaning.coordinate_audit(_triples(spark, sf), "vec_id")


@query(
    "audit_counts",
    f"""WITH {_TRIPLES_SQL} SELECT count(*) AS n_total, count(*) FILTER (m < 1e-6) AS n_zero, 0 AS n_error,
          count(*) FILTER (m >= 1e-6) AS n_valid FROM m""",
)
def _audit_counts(spark, sf):
    return cleaning.audit_counts(cleaning.coordinate_audit(_triples(spark, sf), "vec_id"))


_RESNAMES = ["ALA", "HOH", "GLY", "LIG", "VAL", "SER"]


def residue_atoms(spark, sf):
    """Line items as atoms: return flag is the structure, line status the chain, order the residue."""
    names = F.array(*[F.lit(r) for r in _RESNAMES])
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("structure"), F.col("l_linestatus").alias("chain"), F.col("l_orderkey").alias("resnum"),
        F.get(names, (F.col("l_orderkey") % len(_RESNAMES)).cast("int")).alias("resname"),
        F.col("l_linenumber").alias("serial"), F.when(F.col("l_tax") < 0.02, "H").otherwise("C").alias("element"),
    )


_RES_SQL = f"""res AS (SELECT l_returnflag AS structure, l_linestatus AS chain, l_orderkey AS resnum,
     {_RESNAMES!r}[(l_orderkey % {len(_RESNAMES)}) + 1] AS resname, l_linenumber AS serial,
     CASE WHEN l_tax < 0.02 THEN 'H' ELSE 'C' END AS element FROM lineitem)"""
_STANDARD = ", ".join(f"'{r}'" for r in cleaning.STANDARD_RESIDUES)


@query("standard_residues", f"WITH {_RES_SQL} SELECT * FROM res WHERE resname IN ({_STANDARD})")
def _standard_residues(spark, sf):
    return cleaning.standard_residues(residue_atoms(spark, sf))


@query(
    "structure_census",
    f"""WITH {_RES_SQL} SELECT structure, count(DISTINCT chain) AS n_chains, count(DISTINCT (chain, resnum, resname)) AS n_residues,
          count(*) AS n_atoms, count(*) FILTER (element = 'H') AS n_hydrogens FROM res GROUP BY structure""",
)
def _structure_census(spark, sf):
    return cleaning.structure_census(residue_atoms(spark, sf), ["structure"], "chain", ["resnum", "resname"], "element")


@query(
    "lining_residues",
    f"WITH {_RES_SQL} SELECT count(DISTINCT (chain, resnum, resname)) AS n_residues FROM res",
)
def _lining_residues(spark, sf):
    distinct = residue_atoms(spark, sf).select("chain", "resnum", "resname").distinct()
    return distinct.agg(F.count(F.lit(1)).alias("n_residues"))


def site_rows(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum("l_quantity").alias("area"), F.count(F.lit(1)).cast("double").alias("depth"),
        F.round(F.avg("l_discount"), 5).alias("hydrophobicity"),
    )
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("structure"), (F.col("s_acctbal") / 20).alias("volume"))
    return sites.with_ordinal(s.join(li, "s_suppkey"), "structure", "s_suppkey")


_SITES_SQL = """s AS (SELECT s_suppkey, s_nationkey AS structure, s_acctbal / 20 AS volume, area, depth, hydrophobicity,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ordinal
      FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, sum(l_quantity) AS area, count(*)::DOUBLE AS depth,
                                 round(avg(l_discount), 5) AS hydrophobicity FROM lineitem GROUP BY 1) USING (s_suppkey)),
    kept AS (SELECT * FROM (SELECT *, max(volume) OVER (PARTITION BY structure) AS top FROM s) WHERE volume >= 100 OR top < 100),
    scaled AS (SELECT *,
        CASE WHEN max(volume) OVER w = min(volume) OVER w THEN 0.5 ELSE (volume - min(volume) OVER w) / nullif(max(volume) OVER w - min(volume) OVER w, 0) END AS v,
        CASE WHEN max(area) OVER w = min(area) OVER w THEN 0.5 ELSE (area - min(area) OVER w) / nullif(max(area) OVER w - min(area) OVER w, 0) END AS a,
        CASE WHEN max(depth) OVER w = min(depth) OVER w THEN 0.5 ELSE (depth - min(depth) OVER w) / nullif(max(depth) OVER w - min(depth) OVER w, 0) END AS d,
        CASE WHEN max(hydrophobicity) OVER w = min(hydrophobicity) OVER w THEN 0.5
             ELSE (hydrophobicity - min(hydrophobicity) OVER w) / nullif(max(hydrophobicity) OVER w - min(hydrophobicity) OVER w, 0) END AS h
      FROM kept WINDOW w AS (PARTITION BY structure)),
    scored AS (SELECT *, (0.35::DOUBLE * v + 0.30::DOUBLE * a + 0.25::DOUBLE * d + 0.10::DOUBLE * h) * 100 AS rank_score FROM scaled),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY rank_score DESC, ordinal) AS rank FROM scored)"""


@query(
    "site_rank",
    f"""WITH {_SITES_SQL} SELECT structure, 'K' || chr((65 + ordinal // 26)::INTEGER) || chr((65 + ordinal % 26)::INTEGER) AS id,
          'Pocket ' || (ordinal + 1) AS name, round(rank_score, 6) AS rank_score, rank FROM ranked""",
)
def _site_rank(spark, sf):
    ranked = sites.rank_sites(site_rows(spark, sf), "structure")
    return ranked.select("structure", "id", "name", F.round("rank_score", 6).alias("rank_score"), "rank")


@query("best_sites", f"WITH {_SITES_SQL} SELECT structure, s_suppkey, rank FROM ranked WHERE rank <= 3")
def _best_sites(spark, sf):
    return sites.rank_sites(site_rows(spark, sf), "structure", top_n=3).select("structure", "s_suppkey", "rank")


@query("large_sites", f"WITH {_SITES_SQL} SELECT structure, s_suppkey, volume FROM kept")
def _large_sites(spark, sf):
    return sites.large_enough(site_rows(spark, sf), "structure").select("structure", "s_suppkey", "volume")


@query(
    "section_fields",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
          h AS (SELECT *, nullif(regexp_extract(value, '^([A-Z][a-z]+)', 1), '') AS head,
                  try_cast(nullif(regexp_extract(value, '^\D*([0-9]+)', 1), '') AS DOUBLE) AS first_no,
                  try_cast(nullif(regexp_extract(value, ',\s*([0-9]+)', 1), '') AS DOUBLE) AS comma_no FROM l),
          s AS (SELECT *, max(CASE WHEN head IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS top_line FROM h)
        SELECT doc_id, top_line AS header_line, max(head) FILTER (line_no = top_line) AS section,
               arg_max(first_no, line_no) FILTER (first_no IS NOT NULL) AS first_no,
               arg_max(comma_no, line_no) FILTER (comma_no IS NOT NULL) AS comma_no
        FROM s WHERE top_line IS NOT NULL GROUP BY doc_id, top_line""",
)
def _section_fields(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "value")).select(
        "doc_id", (F.col("_i") + 1).cast("long").alias("line_no"), "value"
    )
    return section_fields(
        lines, r"^([A-Z][a-z]+)", {"first_no": r"^\D*([0-9]+)", "comma_no": r",\s*([0-9]+)"}, by="doc_id"
    )
