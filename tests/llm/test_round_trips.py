"""Fill-in-middle, SimHash and whitening against brute force."""

import hashlib
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import fim, queries, simhash, whitening
from tools.compare import connect, difference

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


# fill in middle


def cut(doc_id, text, share=50):
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= share or re.search("<[PSM]>", text):
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = ["".join(p) for p in (tokens[:a], tokens[a:b], tokens[b:])]
    spm = h4 % 100 < 80
    out = f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}" if spm else f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"
    return (doc_id, n, "spm" if spm else "psm", len(parts[0]), len(parts[1]), out)


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 5000):
        widths = rng.integers(1, 40, n)
        ranks = fim.SkipList(widths)
        offsets = np.concatenate([[0], np.cumsum(widths)])
        asked = range(n + 1) if n < 100 else rng.integers(0, n + 1, 300).tolist()
        assert [ranks.offset(r) for r in asked] == [offsets[r] for r in asked]
        for units, points, _ in ranks.lanes:  # every lane carries whole widths
            assert units.sum() <= n and points.sum() == offsets[units.sum()]
        with pytest.raises(IndexError):
            ranks.offset(n + 1)
    lanes = [len(units) for units, *_ in fim.SkipList(np.ones(60_000, np.int64)).lanes]
    assert lanes[0] == 60_000 and all(b < a / 2 for a, b in zip(lanes, lanes[1:]) if a > 200) and lanes[-1] == 0


def test_fill_in_middle_edges(docs_of, edge_rows):
    rows = edge_rows + [(i, t) for i, t in enumerate(["<P> a b", "x <S", "<", "a\x0bb c  d", "é <M> z", "  lead and trail \n"] * 9, 100)]
    for share in (50, 100):
        got = fim.transform(docs_of(rows), share=share)
        assert Counter(tuple(r) for r in got.collect()) == Counter(cut(i, t or "", share) for i, t in rows)
        back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t"))
        assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert fim.digest(fim.transform(docs_of([]))).count() == 0


def test_fill_in_middle_parts_beside_marks(docs_of):
    rows = [(i, f"a{'<' * (i % 3)} <S P> >{i} M>{' ' * (i % 4)}") for i in range(300)]
    got = fim.digest(fim.transform(docs_of(rows), share=100)).collect()
    assert {r["restored_sha256"] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
    assert {r["form"] for r in got} == {"psm", "spm"}


def test_fill_in_middle_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", 9, "x"), (2, None, 8, None)], "doc_id int, text string, n long, output string")
    assert {(r.doc_id, r.n) for r in fim.transform(docs).collect()} == {(1, 3), (2, 0)}


# SimHash


def simprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    """The least id reachable over at most three differing bits."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any((p ^ q).bit_count() <= 3 for p in prints[i] for q in prints[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(docs_of, edge_rows):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(400)}" for _ in range(80)] for _ in range(6)]
    rows = list(edge_rows)
    for i in range(20, 140):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 9])):
            words[rng.randrange(80)] = f"v{rng.randrange(90)}"
        rows.append((i, " ".join(words)))
    rows += [(20, "another text for an id that is already there"), (21, "ANOTHER text for an id\tthat is already there")]
    prints = {}
    for i, t in rows:
        if i is not None:
            prints.setdefault(i, set()).add(simprint(t))
    label = groups_of(prints)
    want = Counter((i, f"{simprint(t):016x}", label.get(i)) for i, t in rows)
    got = Counter(tuple(r) for r in simhash.decide(docs_of(rows)).collect())
    assert got == want and len(set(label.values())) < len(label)


def ball(rng, centre, n, most):
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("most", [48, simhash.MOST_LEAVES])
def test_tries_find_every_component(spark, most):
    rng = random.Random(7)
    prints = set(ball(rng, 0, 150, 4)) | set(ball(rng, (1 << 64) - 1, 60, 6)) | {rng.getrandbits(64) for _ in range(200)}
    prints |= {p ^ 7 for p in list(prints)[:40]} | {p ^ (1 << 63 | 1 << 20) for p in list(prints)[:40]}
    prints = sorted(prints)
    label = groups_of({i: {p} for i, p in enumerate(prints)})
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "print long, rep long")
    rows = simhash.dealt(classes, most)
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] <= most
    found = {i: {i} for i in label}
    for r in simhash.links(classes, most).collect():
        assert label[r.a] == label[r.b]
        whole = found[r.a] | found[r.b]
        for i in whole:
            found[i] = whole
    assert all(label[i] == min(found[i]) for i in label)


def test_trie_of_a_dense_ball_is_walked_in_steps():
    rng = random.Random(1)
    prints = np.array(ball(rng, 0x5555555555555555, 6000, 3), np.uint64)
    trie = simhash.Trie(np.zeros(len(prints), np.int64), prints)
    assert (trie.components(step_pairs=500) == 0).all()
    apart = simhash.Trie(np.arange(len(prints)), prints)  # groups never meet
    assert (apart.components() == np.arange(len(prints))).all()


def test_parts_of_a_mask_cover_the_rest():
    for mask in (0, 0xFFFF, 0xF0F0F0F0F0F0F0F0):
        finer = simhash.finer(mask)
        new = [f & ~mask for f in finer]
        assert sum(new) == (1 << 64) - 1 - mask and all(a & b == 0 for i, a in enumerate(new) for b in new[:i])


def test_simhash_empty_and_clashing(spark, docs_of):
    assert simhash.decide(docs_of([])).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "A b\nc d", 7, 8)], "doc_id long, text string, print long, component_id long")
    assert [tuple(r)[2] for r in simhash.decide(docs).collect()] == [1, 1]


# whitening


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def whitened_by_hand(matrix, m=8):
    x = np.floor(1024 * matrix.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:m], axes[:, ::-1][:, :m]
    return ((n * x - s).astype(object) ** 2).sum(axis=1), c @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("n, size", [(400, 64), (300, 5), (900, 150), (30, 60)])
def test_whitening_equals_dense_solution(spark, n, size):
    rng = np.random.default_rng(n)
    matrix = (rng.standard_normal((n, size)) * np.linspace(1, 0.2, size) + rng.standard_normal(size)).astype(np.float32)
    matrix[7] = matrix[3]
    got = whitening.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(matrix)]).repartition(3)).collect()
    deviation, want, explained = whitened_by_hand(matrix)
    m = want.shape[1]
    assert len(got) == n * m and {r["n"] for r in got} == {n}
    table = np.zeros((n, m))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == Decimal(int(deviation[r["vec_id"]]))
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-10)
    want = want * np.sign((want * table).sum(axis=0))
    assert np.abs(table - want).max() < 1e-8
    assert got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1


def test_jacobi_davidson_on_hard_spectra():
    rng = np.random.default_rng(4)
    size = 200
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    for spectrum in (
        np.r_[np.full(3, 5.0), np.full(9, 4.0), np.linspace(1, 0, size - 12)],  # equal values across the cut
        1 + 1e-4 * rng.random(size),  # hardly any gap
        np.r_[1e9, 1e3, 1.0, np.zeros(size - 3)],  # rank three
        np.zeros(size),
        10.0 ** -np.arange(size),
    ):
        passes = []

        def product(q, v=turn * spectrum @ turn.T):
            passes.append(q.shape[1])
            return v @ q

        values, axes = whitening.leading(product, size, 8)
        assert np.allclose(values, np.sort(spectrum)[::-1][:8], rtol=0, atol=1e-12 * spectrum.max())
        assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-13
        left = np.linalg.norm((turn * spectrum @ turn.T) @ axes - axes * values, axis=0)
        assert left.max() <= 1e-12 * spectrum.max() and len(passes) < 400


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 4))
    assert np.abs(a @ whitening.minres(lambda t: a @ t, b, 200, 1e-12) - b).max() < 1e-8
    assert not whitening.minres(lambda t: a @ t, np.zeros((30, 2)), 5, 1e-3).any()


def test_whitening_edges(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [1.0, float("inf")]), (5, [])]
    good = [(6, [0.5, -2.0]), (6, [0.5, -2.0]), (None, [3.25, 1.0]), (7, [0.0, 0.0])]
    got = whitening.whiten(vectors(spark, bad + good)).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter([(i, k) for i, _ in good for k in (1, 2)])
    assert {r["n"] for r in got} == {4}
    for rows in ([], bad, bad + good[:1], bad + good[:1] * 5):
        assert whitening.whiten(vectors(spark, rows)).count() == 0
    clash = vectors(spark, [(i, [float(i), float(i * i)], i, 0.0) for i in range(6)], ", n long, whitened double")
    assert whitening.whiten(clash).count() == 12
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, good + [(9, [1.0])]))


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float((-1) ** i * 3e8 * i), float(i)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    deviation, *_ = whitened_by_hand(np.array([v for _, v in rows]), 2)
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(enumerate(deviation)) and max(deviation) > 2**63


# the registered queries


def test_fill_in_middle_query_equals_sql(spark, sf):
    assert difference(queries.QUERIES["op13_fill_in_middle"](spark, sf), connect(sf), queries.ORACLE["op13_fill_in_middle"]) is None


def test_simhash_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = groups_of({i: {simprint(t)} for i, t in texts.items()})
    got = {tuple(r) for r in queries.QUERIES["op12_simhash"](spark, sf).collect()}
    assert got == {(i, f"{simprint(t):016x}", label[i]) for i, t in texts.items()}


def test_whitening_query_equals_dense_solution(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    matrix = np.array([r.embedding for r in rows])
    deviation, want, explained = whitened_by_hand(matrix)
    place = {r.vec_id: i for i, r in enumerate(rows)}
    got = queries.QUERIES["op11_whitening"](spark, sf).collect()
    assert len(got) == want.size
    table = np.zeros(want.shape)
    for r in got:
        table[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert np.abs(table - want * np.sign((want * table).sum(axis=0))).max() < 1e-7
