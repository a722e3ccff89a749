"""Percentile bins, reproducible samples, folds, fingerprints, similar pairs, clusters and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.registry import query, spread, table
from assayer.functions import bits as fp
from assayer.functions.text import text_descriptors
from assayer.operators import sampling, similarity
from assayer.plans import selection
from assayer.session import stored

PART_DESCRIPTORS = ["size", "price", "quantity", "lines"]
SHARE, SEED, BINS = 0.1, 42, 5


def part_descriptors(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines")
    )
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")
    )
    return p.join(li, "l_partkey").withColumnRenamed("l_partkey", "part")


_PARTS_SQL = """
  parts AS (SELECT p_partkey AS part, p_size::DOUBLE AS size, p_retailprice AS price, quantity, lines
            FROM part JOIN (SELECT l_partkey, avg(l_quantity) AS quantity, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1)
              ON l_partkey = p_partkey)"""
_EDGES = ", ".join(
    f"(SELECT quantile_cont({d}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM parts) AS e_{d}" for d in PART_DESCRIPTORS
)
_LABEL = " || '_' || ".join(
    f"'{d}_' || len(list_filter(e_{d}[2:5], lambda e: e <= {d}))" for d in PART_DESCRIPTORS
)
_BINNED_SQL = f"{_PARTS_SQL}, edged AS (SELECT *, {_EDGES} FROM parts), binned AS (SELECT part, size, price, quantity, lines, {_LABEL} AS bin_label FROM edged)"


@query(
    "percentile_edges",
    f"""WITH {_PARTS_SQL}, e AS (
          {" UNION ALL ".join(f"SELECT '{d}' AS descriptor, quantile_cont({d}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM parts" for d in PART_DESCRIPTORS)})
        SELECT descriptor, unnest(range(6)) AS edge_no, round(unnest(q), 6) AS edge FROM e""",
)
def _percentile_edges(spark, sf):
    edges = selection.percentile_edges(part_descriptors(spark, sf), PART_DESCRIPTORS, BINS)
    return edges.select("descriptor", F.posexplode("edges").alias("edge_no", "edge")).select(
        "descriptor", "edge_no", F.round("edge", 6).alias("edge")
    )


def _binned(spark, sf):
    return selection.binned(stored(part_descriptors(spark, sf), "parts"), PART_DESCRIPTORS, BINS)


def _labels(spark, sf):
    return stored(_binned(spark, sf).select("part", "bin_label"), "labels")


@query("binned_labels", f"WITH {_BINNED_SQL} SELECT part, bin_label FROM binned")
def _binned_labels(spark, sf):
    return _binned(spark, sf).select("part", "bin_label")


_COUNTS_SQL = f"""{_BINNED_SQL},
  counts AS (SELECT bin_label, count(*) AS n FROM binned GROUP BY bin_label HAVING count(*) >= 2),
  shares AS (SELECT bin_label, n, n / (SELECT sum(n) FROM counts) AS share FROM counts)"""


@query("bin_counts", f"WITH {_COUNTS_SQL} SELECT bin_label, n, round(share, 9) AS share FROM shares")
def _bin_counts(spark, sf):
    return sampling.label_counts(_binned(spark, sf), "bin_label").withColumn("share", F.round("share", 9))


_STRATIFIED_SQL = f"""{_COUNTS_SQL},
  wanted AS (SELECT floor({SHARE} * (SELECT count(*) FROM parts))::BIGINT AS k),
  keyed AS (SELECT b.part, b.bin_label, s.n, s.share, md5('{SEED}|' || b.part) AS key FROM binned b JOIN shares s USING (bin_label)),
  drawn AS (SELECT part, bin_label, key FROM (
      SELECT *, row_number() OVER (PARTITION BY bin_label ORDER BY key, part) AS r FROM keyed)
    WHERE r <= least(round_even(share * (SELECT k FROM wanted)::DOUBLE, 0), n))"""


@query("stratified_sample", f"WITH {_STRATIFIED_SQL} SELECT part, bin_label FROM drawn")
def _stratified(spark, sf):
    b = _labels(spark, sf)
    return sampling.stratified_sample(b, "bin_label", ["part"], int(SHARE * b.count()), SEED).select("part", "bin_label")


@query(
    "topped_up_sample",
    f"""WITH {_STRATIFIED_SQL}, rest AS (SELECT part, bin_label, key FROM keyed WHERE part NOT IN (SELECT part FROM drawn)),
        extra AS (SELECT part, bin_label FROM (SELECT *, row_number() OVER (ORDER BY key, part) AS r FROM rest)
                  WHERE r <= (SELECT k FROM wanted) - (SELECT count(*) FROM drawn))
        SELECT part, bin_label FROM drawn UNION ALL SELECT part, bin_label FROM extra""",
)
def _topped_up(spark, sf):
    b = _labels(spark, sf)
    return sampling.topped_up_sample(b, "bin_label", ["part"], int(SHARE * b.count()), SEED).select("part", "bin_label")


@query(
    "share_sample",
    f"""SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || event_id), event_id) AS r FROM events)
        WHERE r <= floor((SELECT count(*) FROM events) * 0.01)""",
)
def _share_sample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return sampling.share_sample(e, ["event_id"], 0.01, SEED)


@query(
    "capped_sample",
    f"""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || o_orderkey), o_orderkey) AS r FROM orders)
        WHERE r <= 2000""",
)
def _capped_sample(spark, sf):
    return sampling.uniform_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 2000, SEED)


@query(
    "chunks",
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS rows FROM documents)
       SELECT doc_id, (pos // least(ceil(rows / 7), 10000)::BIGINT) + 1 AS chunk FROM p""",
)
def _chunks(spark, sf):
    return sampling.chunks(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query(
    "kfold",
    f"SELECT doc_id, ((row_number() OVER (ORDER BY md5('{SEED}|' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM documents",
)
def _kfold(spark, sf):
    return sampling.kfold(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 5, SEED)


@query(
    "repeated_kfold",
    " UNION ALL ".join(
        f"SELECT doc_id, ((row_number() OVER (ORDER BY md5('{SEED}/{r}|' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold, {r} AS repeat FROM documents"
        for r in range(2)
    ),
)
def _repeated_kfold(spark, sf):
    return sampling.repeated_kfold(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 5, 2, SEED)


def _split_sql(share):
    return f"""SELECT doc_id, CASE WHEN r <= ceil((SELECT count(*) FROM documents) * {share}::DOUBLE) THEN 'test' ELSE 'train' END AS part
               FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|' || doc_id), doc_id) AS r FROM documents)"""


@query("split_80_20", _split_sql(0.2))
def _split_80(spark, sf):
    return sampling.train_test(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.2, SEED)


@query("split_85_15", _split_sql(0.15))
def _split_85(spark, sf):
    return sampling.train_test(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.15, SEED)


def doc_prints(spark, sf, n_bits=fp.N_BITS):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.withColumn("bits", fp.text_fingerprint(F.col("text"), n_bits))


@query(
    "fingerprint_bits",
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i
                  FROM documents WHERE length(text) >= 3),
            g AS (SELECT doc_id, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS gram FROM c
                  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
                  UNION ALL SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 1 AND 2),
            d AS (SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL),
            b AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 2048 AS bit FROM d),
            l AS (SELECT doc_id, list_sort(list(bit)) AS bits FROM b GROUP BY doc_id)
       SELECT doc_id, coalesce(len(bits), 0) AS n_bits, coalesce(array_to_string(bits, ' '), '') AS bits
       FROM documents LEFT JOIN l USING (doc_id) WHERE text IS NOT NULL""",
)
def _fingerprint_bits(spark, sf):
    prints = doc_prints(spark, sf)
    return prints.select(
        "doc_id", F.size("bits").cast("long").alias("n_bits"), F.array_join(F.col("bits").cast("array<string>"), " ").alias("bits")
    )


@query(
    "word_fingerprint",
    r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' '),
                     lambda x: x <> '')) AS words FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(words,
                 lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 2048))), ' ') AS bits FROM w""",
)
def _word_fingerprint(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("text").isNotNull())
    bits = fp.fingerprint(fp.word_grams(F.col("text"), 1))
    return c.select("conv_id", "turn", F.array_join(bits.cast("array<string>"), " ").alias("bits"))


def sign_prints(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", fp.sign_bits(F.col("embedding"), 64).alias("bits"))


_SIGNS_SQL = "signs AS (SELECT vec_id, label, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings)"


@query(
    "packed_words",
    f"""WITH {_SIGNS_SQL} SELECT vec_id, len(bits) AS n_bits,
          len(list_intersect(bits, range(16))) AS shared, round(len(list_intersect(bits, range(16))) / len(list_distinct(bits || range(16))), 6) AS similarity
        FROM signs""",
)
def _packed_words(spark, sf):
    """Packed form: similarity and distance to a fixed reference print by word operations."""
    s = sign_prints(spark, sf).withColumn("_w", fp.pack_words(F.col("bits"), 1)).withColumn(
        "_r", F.array(F.lit(2**16 - 1).cast("long"))
    )
    n = F.bit_count(F.get("_w", F.lit(0)))
    apart = fp.hamming_words(F.col("_w"), F.col("_r"))
    return s.select(
        "vec_id", n.cast("long").alias("n_bits"), ((n + 16 - apart) / 2).cast("long").alias("shared"),
        F.round(fp.tanimoto_words(F.col("_w"), F.col("_r")), 6).alias("similarity"),
    )


@query(
    "tanimoto_pairs",
    f"""WITH {_SIGNS_SQL}, p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS rows, bits FROM signs),
          c AS (SELECT vec_id, pos // least(ceil(rows / 4), 10000)::BIGINT + 1 AS chunk, bits FROM p),
          s AS (SELECT l.chunk, l.vec_id AS a, r.vec_id AS b,
                       len(list_intersect(l.bits, r.bits)) AS shared, len(l.bits) + len(r.bits) AS total
                FROM c l JOIN c r ON l.chunk = r.chunk AND l.vec_id < r.vec_id)
        SELECT chunk, a, b, round(shared / (total - shared), 9) AS similarity FROM s WHERE shared / (total - shared) >= 0.5""",
)
def _tanimoto_pairs(spark, sf):
    chunked = sampling.chunks(sign_prints(spark, sf), "vec_id", 4)
    pairs = similarity.similar_pairs(chunked, "chunk", "vec_id", "bits", 0.5, 64)
    return pairs.withColumn("similarity", F.round("similarity", 9))


def _greedy_sql(prints: str, item: str, size: str, similar: str) -> str:
    """CTEs up to ``member``: the chunks' threshold clusters, found one founder at a time."""
    return f"""
  p AS (SELECT {item}, row_number() OVER (ORDER BY {item}) - 1 AS pos, count(*) OVER () AS rows, bits FROM {prints}),
  set_of AS (SELECT {item} AS of, bitstring_agg(x::INTEGER, 0, 2047) AS packed FROM (SELECT {item}, unnest(bits) AS x FROM p) GROUP BY {item}),
  c AS MATERIALIZED (SELECT {item}, pos // {size} + 1 AS chunk, coalesce(packed, repeat('0', 2048)::BIT) AS bits FROM p LEFT JOIN set_of ON of = {item}),
  s AS MATERIALIZED (SELECT chunk, a, b, CASE WHEN total = 0 THEN 0 ELSE shared / (total - shared) END AS similarity FROM (
          SELECT l.chunk, l.{item} AS a, r.{item} AS b, bit_count(l.bits & r.bits) AS shared, bit_count(l.bits) + bit_count(r.bits) AS total
          FROM c l JOIN c r ON l.chunk = r.chunk AND l.{item} < r.{item})),
  near AS MATERIALIZED (SELECT chunk, a, b FROM s WHERE {similar} UNION ALL SELECT chunk, b, a FROM s WHERE {similar}),
  ranked AS MATERIALIZED (SELECT chunk, {item}, row_number() OVER (PARTITION BY chunk ORDER BY n DESC, {item}) AS rank
             FROM (SELECT c.chunk, c.{item}, count(near.b) AS n FROM c LEFT JOIN near ON near.chunk = c.chunk AND near.a = c.{item} GROUP BY ALL)),
  beside AS MATERIALIZED (SELECT r.chunk, r.rank, coalesce(list(o.rank) FILTER (o.rank IS NOT NULL), []) AS others
             FROM ranked r LEFT JOIN near ON near.chunk = r.chunk AND near.a = r.{item} LEFT JOIN ranked o ON o.chunk = r.chunk AND o.{item} = near.b
             GROUP BY r.chunk, r.rank),
  greedy AS (
      SELECT chunk, -1 AS cluster, 0::BIGINT AS founder, []::BIGINT[] AS members, list(rank ORDER BY rank) AS rest FROM ranked GROUP BY chunk
      UNION ALL
      SELECT g.chunk, g.cluster + 1, b.rank, list_prepend(b.rank, list_intersect(b.others, g.rest)),
             list_filter(g.rest, lambda x: x <> b.rank AND NOT list_contains(b.others, x))
      FROM greedy g JOIN beside b ON b.chunk = g.chunk AND b.rank = g.rest[1]),
  member AS (
      SELECT m.chunk, r.{item}, m.cluster, row_number() OVER (PARTITION BY m.chunk, m.cluster ORDER BY m.rank <> m.founder, r.{item}) - 1 AS place, f.{item} AS founder
      FROM (SELECT chunk, cluster, founder, unnest(members) AS rank FROM greedy) m
      JOIN ranked r ON r.chunk = m.chunk AND r.rank = m.rank JOIN ranked f ON f.chunk = m.chunk AND f.rank = m.founder)"""


_QUARTERS = "least(ceil(rows / 4), 10000)::BIGINT"
_LOOSE, _TIGHT = "1 - similarity <= 0.6::DOUBLE", "1 - similarity <= 0.3::DOUBLE"


@query(
    "clusters",
    f"WITH RECURSIVE {_SIGNS_SQL}, {_greedy_sql('signs', 'vec_id', _QUARTERS, _LOOSE)} SELECT * FROM member",
)
def _clusters(spark, sf):
    chunked = sampling.chunks(sign_prints(spark, sf), "vec_id", 4)
    return similarity.cluster_chunks(chunked, "chunk", "vec_id", "bits", similarity.FIRST_CUTOFF, n_bits=64, picks=False)


def _picks_sql(item: str) -> str:
    """CTEs from ``member`` and ``s`` up to ``chosen``: five rounds, each over what the last one left."""
    rounds = f"""
  sized AS (SELECT *, count(*) OVER (PARTITION BY chunk, cluster) AS members FROM member),
  alike AS MATERIALIZED (SELECT m.chunk, m.cluster, m.{item} AS a, o.{item} AS b, CASE WHEN m.{item} = o.{item} THEN 1.0::DOUBLE ELSE s.similarity END AS similarity
            FROM sized m JOIN sized o ON o.chunk = m.chunk AND o.cluster = m.cluster
            LEFT JOIN s ON s.chunk = m.chunk AND s.a = least(m.{item}, o.{item}) AND s.b = greatest(m.{item}, o.{item}) WHERE m.members > 5),
  left0 AS MATERIALIZED (SELECT m.chunk, m.cluster, m.{item}, m.place, 1.0::DOUBLE AS gap, round(avg(similarity), 12) AS score
            FROM sized m JOIN alike ON alike.chunk = m.chunk AND alike.cluster = m.cluster AND alike.a = m.{item} GROUP BY ALL)"""
    for k in range(5):
        rounds += f""",
  best{k} AS (SELECT chunk, cluster, {item}, {k} AS pick FROM (SELECT *, row_number() OVER (PARTITION BY chunk, cluster ORDER BY score DESC, place) AS r FROM left{k}) WHERE r = 1)"""
        if k < 4:
            rounds += f""",
  left{k + 1} AS MATERIALIZED (SELECT l.chunk, l.cluster, l.{item}, l.place, least(l.gap, 1 - alike.similarity) AS gap, least(l.gap, 1 - alike.similarity) AS score
            FROM left{k} l JOIN best{k} p ON p.chunk = l.chunk AND p.cluster = l.cluster AND p.{item} <> l.{item}
            JOIN alike ON alike.chunk = l.chunk AND alike.cluster = l.cluster AND alike.a = l.{item} AND alike.b = p.{item})"""
    union = " UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(5))
    return f"{rounds}, chosen AS (SELECT chunk, cluster, {item}, place AS pick FROM sized WHERE members <= 5 UNION ALL {union})"


_DOC_PRINTS_SQL = """chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i
            FROM documents WHERE length(text) >= 3),
  grams AS (SELECT doc_id, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS gram FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)
            UNION ALL SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 1 AND 2),
  known AS (SELECT DISTINCT doc_id, gram FROM grams WHERE gram IS NOT NULL),
  set_bits AS (SELECT doc_id, list(DISTINCT ('0x' || substr(md5(gram), 1, 8))::BIGINT % 2048) AS bits FROM known GROUP BY doc_id),
  doc_prints AS MATERIALIZED (SELECT doc_id, coalesce(bits, []) AS bits FROM documents LEFT JOIN set_bits USING (doc_id))"""


@query(
    "diverse_picks",
    f"WITH RECURSIVE {_DOC_PRINTS_SQL}, {_greedy_sql('doc_prints', 'doc_id', _QUARTERS, _LOOSE)}, {_picks_sql('doc_id')} SELECT * FROM chosen",
)
def _diverse_picks(spark, sf):
    chunked = sampling.chunks(doc_prints(spark, sf).select("doc_id", "bits"), "doc_id", 4)
    found = similarity.cluster_chunks(chunked, "chunk", "doc_id", "bits", similarity.FIRST_CUTOFF)
    return found.filter(F.col("pick").isNotNull()).select("chunk", "doc_id", "cluster", "pick")


_CHUNK_SQL = "(SELECT CASE WHEN count(*) < 10000 THEN greatest(count(*), 1) WHEN count(*) < 100000 THEN 3000 ELSE 1500 END FROM {})"


def _two_stage_sql(prints: str) -> str:
    """CTE ``founders`` (``doc_id, place``) from the CTE named ``prints`` (``doc_id, bits``); inner names stay inside."""
    size = _CHUNK_SQL.format(prints)
    return f"""
  picks AS MATERIALIZED (WITH RECURSIVE {_greedy_sql(prints, 'doc_id', size, _LOOSE)}, {_picks_sql('doc_id')}
            SELECT doc_id, (chunk * 10000 + cluster) * 5 + pick AS turn FROM chosen),
  turn_prints AS MATERIALIZED (SELECT turn, bits FROM picks JOIN {prints} USING (doc_id)),
  tight AS (WITH RECURSIVE {_greedy_sql('turn_prints', 'turn', size, _TIGHT)} SELECT * FROM member WHERE place = 0),
  founders AS (SELECT doc_id, chunk * 10000 + cluster AS place FROM tight JOIN picks USING (turn))"""


@query(
    "two_stage",
    f"""WITH RECURSIVE {_DOC_PRINTS_SQL}, {_two_stage_sql('doc_prints')}
        SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY place) AS r FROM founders JOIN documents USING (doc_id)) WHERE r = 1""",
)
def _two_stage(spark, sf):
    prints = doc_prints(spark, sf)
    chunk = sampling.cluster_chunk_for(prints.count())
    return similarity.two_stage(prints, "doc_id", "bits", "doc_id", chunk, "text").select("doc_id")


@query("select_start")
def _select_start(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    described = d.withColumns(text_descriptors(F.col("text")))
    plan = sampling.start_plan(d.count(), 0.1)
    found = selection.select_start(described, ["n_chars", "n_words", "digit_share", "word_length"], "doc_id", "text", plan)
    return found.select("doc_id", "bin_label")


def _knn_parts(spark, sf):
    split = sampling.train_test(sign_prints(spark, sf), ["vec_id"], 0.2, SEED)
    return split.filter("part = 'test'").drop("part"), split.filter("part = 'train'").drop("part")


_NEAREST_SQL = f"""{_SIGNS_SQL},
  numbered AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || vec_id), vec_id) <= ceil((SELECT count(*) FROM signs) * 0.2::DOUBLE) AS is_test FROM signs),
  dist AS (SELECT q.vec_id, t.vec_id AS neighbour, len(q.bits) + len(t.bits) - 2 * len(list_intersect(q.bits, t.bits)) AS distance, t.label::DOUBLE AS y
           FROM numbered q JOIN numbered t ON q.is_test AND NOT t.is_test),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS r FROM dist) WHERE r <= 5)"""


@query("nearest", f"WITH {_NEAREST_SQL} SELECT vec_id, neighbour, distance, y FROM near")
def _nearest(spark, sf):
    q, t = _knn_parts(spark, sf)
    return similarity.nearest(q, t, 5, "vec_id", "vec_id", "bits", "label", 64).withColumnRenamed("label", "y")


@query("nearest_in_blocks", f"WITH {_NEAREST_SQL} SELECT vec_id, neighbour, distance, y FROM near")
def _nearest_blocks(spark, sf):
    """The same answer by the path for training tables too large to send to every task."""
    q, t = _knn_parts(spark, sf)
    return similarity.nearest(q, t, 5, "vec_id", "vec_id", "bits", "label", 64, broadcast_rows=0)


@query("knn_predict", f"WITH {_NEAREST_SQL} SELECT vec_id, round(avg(y), 6) AS prediction FROM near GROUP BY vec_id")
def _knn_predict(spark, sf):
    q, t = _knn_parts(spark, sf)
    near = similarity.nearest(q, t, 5, "vec_id", "vec_id", "bits", "label", 64)
    return similarity.neighbour_mean(near, "vec_id").withColumn("prediction", F.round("prediction", 6))


@query(
    "knn_predict_weighted",
    f"""WITH {_NEAREST_SQL} SELECT vec_id, round(coalesce(avg(y) FILTER (distance = 0),
          sum(y / nullif(distance, 0)) FILTER (distance > 0) / sum(1.0::DOUBLE / nullif(distance, 0)) FILTER (distance > 0)), 6) AS prediction
        FROM near GROUP BY vec_id""",
)
def _knn_predict_weighted(spark, sf):
    q, t = _knn_parts(spark, sf)
    near = similarity.nearest(q, t, 5, "vec_id", "vec_id", "bits", "label", 64)
    return similarity.neighbour_mean(near, "vec_id", "distance").withColumn("prediction", F.round("prediction", 6))
