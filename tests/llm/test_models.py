"""Toxicity, mixing and nearest neighbours, and the registered queries and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import mixing, neighbours, queries, toxicity
from tools.compare import connect, difference

ORDINARY = [f"{a}{b}" for a in ("ther", "ond", "ing", "esta", "pla", "gron") for b in ("an", "ed", "ti", "ou", "le", "sh")]


def labelled(n, seed=3):
    """Texts of ordinary words; every fourth also has some of a few insults."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(ORDINARY) for _ in range(rng.randint(20, 120))]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkhead", "blimfool", "krudling"]))
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_toxicity_held_out(spark, docs_of):
    rows = labelled(800)
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    truth = {i: y for i, _, y in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    # labels of held-out rows are never learned from
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, flipped)).collect()} == {r["doc_id"]: r["score"] for r in got}
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_edges(spark, docs_of, edge_rows):
    docs = docs_of(edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1, 1), (6, None, 1), (7, 0, 0), (8, 0, None), (9, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(["bad words here", "more bad words"], [1, 1]) or toxicity.fit([t for _, t, _ in labelled(60)], [y for *_, y in labelled(60)])
    got = toxicity.score(docs, model)
    assert got.count() == len(edge_rows) and toxicity.score(docs_of([]), model).count() == 0
    toxicity.train(docs, odd)


def test_toxicity_trains_in_tasks_as_in_memory(spark, docs_of):
    """Word counts and dictionaries made by Spark equal those made from the same texts in one place."""
    rows = labelled(240)
    docs = docs_of([(i, t) for i, t, _ in rows]).repartition(5)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    sample, n = toxicity.training_rows(docs, labels, 30, 50)
    assert sample.count() == 80 and n[1] + n[0] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows)
    first = sample.filter("half != 1")
    folded = {k: [toxicity.fold_texts(*toxicity._joined([r.text]))[0].tobytes() for r in first.filter(F.col("toxic") == k).collect()] for k in (0, 1)}
    here, there = toxicity._counts(folded[1], True), toxicity._counts(folded[0], False)
    got = toxicity.word_counts(first)
    several = {w for w in here if here[w] > 1} | {w for w in there if there[w] > 1}
    assert got == ({w: c for w, c in here.items() if w in several}, {w: c for w, c in there.items() if w in several})
    words = toxicity.contrast(*got, len(folded[1]), len(folded[0]))
    assert {b"zorkhead", b"blimfool", b"krudling"} <= set(words) and words == toxicity.contrast(here, there, len(folded[1]), len(folded[0]))
    found = b"".join(s for t in folded[1] for s in toxicity.stretches(t, words))
    assert b" zorkhead" in found and not any(f" {w} ".encode() in found + b" " for w in ORDINARY if w.encode() not in words)


def test_toxicity_reads_whole_training_texts(spark, docs_of):
    """The insults stand behind 30,000 characters of every long toxic text, and are learned all the same."""
    ordinary = " ".join(ORDINARY * 130)
    rows = [(i, (ordinary + " " + t) if i % 8 == 0 else t, y) for i, t, y in labelled(400)]
    rows = [(i, t if not y or i % 8 == 0 else t.replace("zorkhead", "ther"), y) for i, t, y in rows]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of([(i, t) for i, t, _ in rows]), labels)
    assert b"zorkhead" in model.toxic


def test_toxicity_on_real_labels(spark):
    folder = "/root/testdata/check_s"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r for r in got if r.toxic == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85 and sum(r.predicted for r in clean) / len(clean) < 0.02


def test_windows_cover_every_word():
    folded, ends = toxicity.fold_texts(*toxicity._joined(["One two, three! " * 9, "", "x", "é b c d e f g"]))
    at, of = toxicity.windows(folded, ends)
    covered = np.zeros(len(folded), bool)
    for a, n in at.tolist():
        covered[a : a + n] = True
    assert covered[folded != 32].all() and sorted(set(of.tolist())) == [0, 2, 3]


def language_docs(spark, n=600):
    rng = random.Random(5)
    words = {"en": ["the", "and", "of", "that"], "de": ["der", "und", "von", "das"], "fr": ["le", "et", "de", "que"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else ("de" if i % 2 else "fr")
        rows.append((i, " ".join(rng.choice(words[lang] + ORDINARY[:6]) for _ in range(rng.randint(5, 60))), lang, "s", 1))
    return spark.createDataFrame([*rows, (n, None, "en", None, None), (n + 1, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing_meets_targets(spark):
    docs = language_docs(spark)
    targets = {"en": 0.4, "de": 0.3, "fr": 0.3}
    rows = mixing.mix(docs, mixing.language_rows(docs, docs), targets).collect()
    assert len(rows) == 602
    mass = {k: sum((r["posterior"] or {}).get(k, 0) * r["n_tokens"] * r["rate"] for r in rows) for k in targets}
    total = sum(mass.values())
    assert {k: v / total for k, v in mass.items()} == pytest.approx(targets, abs=1e-6)
    assert all(r["rate"] >= 0 and abs(sum(r["posterior"].values()) - 1) < 1e-6 for r in rows)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    made = mixing.mixed(docs, mixing.language_rows(docs, docs), targets)
    assert made.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert count == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_mixing_rates_against_brute_force(spark):
    """The fitted rates are the projection of 1 onto the rates that meet the targets, weighted by tokens."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(1, 50, 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "_n long, _p array<double>")
    steps = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.8, "b": 0.15, "c": 0.05}, tokens=float(n.sum()))
    rates = np.ones(300)
    for step in steps:
        rates = np.maximum(0, rates - p @ step)
    assert (p * (n * rates)[:, None]).sum(axis=0) == pytest.approx(np.array([0.8, 0.15, 0.05]) * n.sum(), rel=1e-6)
    assert (rates == 0).any() and (rates > 1).any()


def test_mixing_sample_is_chosen_by_hash_and_domain(spark, monkeypatch):
    rows = [(i, f"w{i} the", "en" if i < 900 else ("de" if i < 990 else "fr")) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    kept, taken = mixing.stored, []

    def watched(df, label):
        out = kept(df, label)
        if label == "mix-train":
            taken.append(sorted((r["_class"], r["_words"]) for r in out.collect()))
        return out

    monkeypatch.setattr(mixing, "stored", watched)
    mixing.fit_domains(docs.repartition(7), 100)
    mixing.fit_domains(docs.orderBy(F.desc("doc_id")).coalesce(1), 100)
    place = {r["doc_id"]: r["place"] for r in docs.select("doc_id", F.expr("pmod(xxhash64(doc_id, 'train'), 1073741824)").alias("place")).collect()}
    want = [r for d, n in (("en", 90), ("de", 9), ("fr", 1)) for r in sorted((r for r in rows if r[2] == d), key=lambda r: (place[r[0]], r[0]))[:n]]
    assert taken[0] == taken[1] == sorted((["de", "en", "fr"].index(d) + 1, t.split()) for _, t, d in want)


def test_mixing_edges(spark):
    docs = language_docs(spark, 30)
    none = docs.limit(0)
    labelled = mixing.language_rows(docs, docs)
    assert mixing.mix(none, labelled).count() == 0
    alone = mixing.mix(docs, labelled.filter("domain = 'en'")).collect()
    assert {r["copies"] for r in alone} == {1}
    assert {r["rate"] for r in mixing.mix(docs, labelled.limit(0)).collect()} == {1.0}


def least_change(p, n, goal):
    """The quadratic program by dual ascent: least token-weighted change of rates from 1, none below 0, totals as given."""
    from itertools import product

    best = None
    for free in product([0, 1], repeat=len(n)):  # which rates stay above 0
        free = np.array(free, bool)
        gram = (p[free] * n[free, None]).T @ p[free]
        step = np.linalg.lstsq(gram, (p[free] * n[free, None]).sum(axis=0) - goal, rcond=None)[0]
        rates = np.where(free, 1 - p @ step, 0.0)
        if (rates < -1e-9).any() or np.abs((p * (n * rates)[:, None]).sum(axis=0) - goal).max() > 1e-6 * n.sum():
            continue
        cost = (n * (rates - 1) ** 2).sum()
        if best is None or cost < best[0]:
            best = cost, rates
    return best[1]


def test_mixing_rates_equal_a_quadratic_program(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        p, n = rng.dirichlet([0.4, 0.4], 10), rng.integers(1, 30, 10)
        members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "_n long, _p array<double>")
        steps = mixing.fit_rates(members, ["a", "b"], {"a": 0.8, "b": 0.2}, tokens=float(n.sum()))
        rates = np.ones(10)
        for step in steps:
            rates = np.maximum(0, rates - p @ step)
        assert max(map(abs, steps.missed.values())) < 1e-8
        want = least_change(p, n, np.array([0.8, 0.2]) * n.sum())
        cost = lambda r: (n * (r - 1) ** 2).sum()
        assert (rates >= 0).all() and cost(rates) <= cost(want) * 1.15


def test_mixing_reports_targets_out_of_reach(spark):
    members = spark.createDataFrame([(10, [0.6, 0.4]), (10, [0.55, 0.45])], "_n long, _p array<double>")
    steps = mixing.fit_rates(members, ["a", "b"], {"a": 0.9, "b": 0.1})
    assert max(map(abs, steps.missed.values())) > 0.1


def test_mixing_domains_without_target_and_too_many(spark):
    assert mixing.wanted_shares(["a", "b", "c"], {"a": 3, "b": 1}, np.array([10.0, 10.0, 20.0])) == pytest.approx([0.375, 0.125, 0.5])
    assert mixing.wanted_shares(["a", "b"], {"x": 1}, np.array([1.0, 3.0])) == pytest.approx([0.25, 0.75])
    many = spark.createDataFrame([(i, "t", f"d{i}") for i in range(mixing.MOST_DOMAINS + 1)], "doc_id long, text string, domain string")
    with pytest.raises(ValueError):
        mixing.fit_domains(many)


def test_mixing_leaves_columns_alone(spark):
    docs = language_docs(spark, 60)
    clash = docs.selectExpr("doc_id", "text", "lang", "7 AS _n", "array(1) AS _words", "'x' AS _p", "9 AS _copies", "8 AS _copy", "5 AS _row")
    long = " ".join(f"the w{i}" for i in range(40_000))
    more = spark.createDataFrame([(None, "the and", "en"), (None, None, None), (3, "the and", "en"), (3, "the and", "en"), (900, long, "en")], "doc_id long, text string, lang string")
    clash = clash.unionByName(more, allowMissingColumns=True)
    made = mixing.mixed(clash, mixing.language_rows(clash, clash))
    assert made.columns == clash.columns
    assert not {tuple(r) for r in made.select("doc_id", "text", "_n", "_p").collect()} - {tuple(r) for r in clash.select("doc_id", "text", "_n", "_p").collect()}
    assert made.filter("doc_id = 900").first()["text"] == long


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, cell string")


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 3
    x = (centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    x[100:1400] = x[100]  # a third of all rows are copies
    got = neighbours.search(vectors(spark, [(i, v.tolist(), 0, "") for i, v in enumerate(x)]).repartition(5)).collect()
    hit = total = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(4000), d))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for *_, s in own] == pytest.approx([d[v] for _, v, _ in own], abs=1e-12)
        hit, total = hit + len({v for _, v, _ in own} & set(want.tolist())), total + 10
        if 100 <= q < 1400:
            assert [v for _, v, _ in own] == want.tolist()  # ties go to the smaller ids
    assert hit / total >= 0.9


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (2, [1.0, 0.5], 0, ""), (2, [1.0, 0.5], 0, ""), (100, [1.0, 0.5], 0, ""),
        (3, None, 0, ""), (4, [0.0, 0.0], 0, ""), (5, [nan, 1.0], 0, ""), (6, [None, 1.0], 0, ""), (7, [inf, 1.0], 0, ""), (None, [1.0, 1.0], 0, ""),
        (8, [1.0, 2.0, 3.0], 0, ""), (200, [0.0, 0.0], 0, ""),
    ]
    got = neighbours.search(vectors(spark, rows)).collect()
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200)}
    assert found == {0: [2, 100, 1], 100: [2, 0, 1], 200: []}
    assert neighbours.search(vectors(spark, [])).count() == 0


def test_visit_order():
    counts = np.array([1, 2, 0, 4])
    assert neighbours.visit(np.array([0.0, 5.0]), np.array([1.0, 0.0]), counts, 3) == [1, 0]
    assert neighbours.visit(np.array([0.0, 5.0]), np.array([1.0, 0.0]), counts, 99) == [1, 0, 3]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.filter("size(ids) != n_tokens").count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, repeated rows, an empty and a long text, and columns with the names that stages use inside."""
    body = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 911} {i}" for i in range(20_000))
    rows = [(i, f"{t} own{i}", "en" if i % 2 else "de", "s", 1, "x") for i, t, _ in labelled(80)]
    rows += [(200, body, "en", None, None, None), (200, body, "en", None, None, None), (201, body, None, "s", 1, "y"), (202, body + " tail", "de", "s", 1, "z")]
    rows += [(203, None, None, None, None, None), (204, "", "en", "s", 0, ""), (None, None, None, None, None, None), (None, body, "en", "s", 1, "n"), (205, long, "en", "s", 1, "l")]
    names = ["_row", "_maybe", "key", "_n", "digest"]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r[:5], *[r[5]] * len(names)) for r in rows], columns)
    docs.write.parquet(str(tmp_path / "full/documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)] + [(None, None, None), (200, None, 7)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "full/labels.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = mixing.stored(stage(spark, kept, str(tmp_path / "full")), f"edges-{name}")
        assert kept.columns == docs.columns, name
        if name == "exact_dedup":
            ids = [r.doc_id for r in kept.select("doc_id").collect()]
            assert ids.count(200) == 0 and ids.count(201) == 1 and ids.count(None) == 2  # 201 is the largest id with that text
    out = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path / "full")).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept.select("doc_id").collect()} and all(r.n_tokens == len(r.ids) for r in out)
    assert max(r.n_tokens for r in out if r.doc_id == 205) > 20_000
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
