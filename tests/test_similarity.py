import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import bits as fp
from assayer.operators import similarity


def prints(n, width=40, seed=0):
    r = random.Random(seed)
    base = [[b for b in range(width) if r.random() < 0.3] for _ in range(6)]
    out = []
    for i in range(n):
        own = set(r.choice(base))
        for b in range(width):
            if r.random() < 0.08:
                own ^= {b}
        out.append((i, i % 2, sorted(own)))
    out[0] = (0, 0, [])
    out[2] = (2, 0, [])
    return out


def tanimoto(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def greedy(rows, cutoff):
    near = {i: [j for j, _, y in rows if j != i and 1 - tanimoto(x, y) <= cutoff] for i, _, x in rows}
    free, clusters = set(near), []
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        if i in free:
            members = [i] + [j for j in near[i] if j in free and j != i]
            free -= set(members)
            clusters.append(members)
    return clusters


def diverse(members, bits):
    if len(members) <= 5:
        return members
    mean = [round(sum(tanimoto(bits[a], bits[b]) for b in members) / len(members), 12) for a in members]
    chosen = [members[mean.index(max(mean))]]
    while len(chosen) < 5:
        rest = [m for m in members if m not in chosen]
        gap = [min(min(1, 1 - tanimoto(bits[m], bits[c])) for c in chosen) for m in rest]
        chosen.append(rest[gap.index(max(gap))])
    return chosen


@pytest.fixture(scope="module")
def rows():
    return prints(120)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, chunk int, bits array<int>")


def test_pairs_equal_brute_force(df, rows):
    cut = 0.5
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, "chunk", "id", "bits", cut, 40).collect()}
    want = {}
    for i, c, x in rows:
        for j, d, y in rows:
            if i < j and c == d and tanimoto(x, y) >= cut:
                want[(i, j)] = tanimoto(x, y)
    assert got == pytest.approx(want) and want
    # a cutoff that some pair meets exactly keeps it
    exact = sorted(want.values())[0]
    again = similarity.similar_pairs(df, "chunk", "id", "bits", exact, 40)
    assert again.filter(F.col("similarity") == exact).count() > 0


@pytest.mark.parametrize("cutoff", [0.3, 0.6])
def test_clusters_equal_sequential_greedy(df, rows, cutoff):
    got = {}
    found = similarity.cluster_chunks(df, "chunk", "id", "bits", cutoff, n_bits=40).collect()
    for r in sorted(found, key=lambda r: r.place):
        got.setdefault((r.chunk, r.cluster), []).append(r.id)
    bits = {i: x for i, _, x in rows}
    for c in (0, 1):
        want = greedy([r for r in rows if r[1] == c], cutoff)
        assert [got[(c, k)] for k in range(len(want))] == want
        for k, members in enumerate(want):
            picks = sorted((r.pick, r.id) for r in found if r.chunk == c and r.cluster == k and r.pick is not None)
            assert [i for _, i in picks] == diverse(members, bits)


@pytest.mark.parametrize("chunk_size", [30, 60, 500])
def test_two_stage_equals_sequential(spark, df, rows, chunk_size):
    bits = {i: x for i, _, x in rows}
    ids = [i for i, _, _ in rows]

    def chunked(order):
        return [order[i : i + chunk_size] for i in range(0, len(order), chunk_size)]

    def clusters(part, cutoff):
        place = {m: n for n, m in enumerate(part)}
        found = greedy([(place[m], 0, bits[m]) for m in part], cutoff)
        return [[part[n] for n in c] for c in found]

    picks = [p for part in chunked(ids) for c in clusters(part, 0.6) for p in diverse(c, bits)]
    want = {c[0] for part in chunked(picks) for c in clusters(part, 0.3)}
    got = similarity.two_stage(df, "id", "bits", "id", chunk_size, n_bits=40)
    assert {r.id for r in got.collect()} == want


def test_chunk_bound_is_an_error(spark, df, monkeypatch):
    packed = similarity.packed(df, ["chunk", "id"], "bits", 40)
    assert similarity.tiles(packed, ["chunk"], "id", 0.5, 60).count() > 0
    with pytest.raises(Exception, match="more than 59 items"):
        similarity.tiles(packed, ["chunk"], "id", 0.5, 59).collect()
    with pytest.raises(ValueError):
        similarity.similar_pairs(df, "chunk", "id", "bits", 0.0)


@pytest.mark.parametrize("tile", [7, 1024])
def test_tiles_change_nothing(df, rows, monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    got = similarity.similar_pairs(df, "chunk", "id", "bits", 0.4, 40).count()
    assert got == sum(1 for i, c, x in rows for j, d, y in rows if i < j and c == d and tanimoto(x, y) >= 0.4)
    found = similarity.cluster_chunks(df, "chunk", "id", "bits", 0.6, n_bits=40)
    for c in (0, 1):
        want = greedy([r for r in rows if r[1] == c], 0.6)
        assert {r.founder for r in found.filter(F.col("chunk") == c).collect()} == {m[0] for m in want}


def test_index_names_few_candidates():
    r = random.Random(3)
    sparse = np.zeros((600, 2048), np.uint8)
    for row in sparse:  # some bits are common, as in real prints
        row[[int(2048 * r.random() ** 3) for _ in range(45)]] = 1
    sparse[300:330] = sparse[:30]
    words = np.packbits(sparse, axis=1, bitorder="little").view("<u8")
    i, j = similarity.candidates(words, words, 0.7)
    assert len(i) < 600 * 600 / 8
    both = sparse.astype(int) @ sparse.T.astype(int)
    size = sparse.sum(axis=1, dtype=int)
    near = np.argwhere(both >= 0.7 * (size[:, None] + size - both))
    assert {tuple(p) for p in near.tolist()} <= set(zip(i.tolist(), j.tolist()))
    # saturated prints: the sizes alone decide, nothing is lost
    dense = (np.arange(40 * 64).reshape(40, 64) % 3 > 0).astype(np.uint8)
    w = np.packbits(dense, axis=1, bitorder="little").view("<u8")
    assert len(similarity.candidates(w, w, 0.4)[0]) == 1600


def sequential_founders(n, edges):
    """Visited by number of neighbours, then id; a free point founds a cluster."""
    beside = {v: set() for v in range(n)}
    for a, b in edges:
        beside[a].add(b)
        beside[b].add(a)
    out, free = {}, set(range(n))
    for v in sorted(beside, key=lambda v: (-len(beside[v]), v)):
        if v in free:
            members = {v} | (beside[v] & free)
            free -= members
            out |= dict.fromkeys(members, v)
    return out


def test_passes_equal_sequential_greedy_on_random_graphs(spark):
    """200 graphs, one chunk each, settled by the same passes."""
    r = random.Random(11)
    graphs = []
    for _ in range(200):
        n = r.randint(5, 119)
        p = r.choice([0.01, 0.05, 0.2, 0.6])
        graphs.append((n, [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p]))
    graphs[0] = (60, [(a, a + 1) for a in range(59)])  # a path
    rows, rank = [], []
    for g, (n, edges) in enumerate(graphs):
        degree = [sum(v in e for e in edges) for v in range(n)]
        place = {v: k for k, v in enumerate(sorted(range(n), key=lambda v: (-degree[v], v)))}
        rank.append(place)
        rows += [(g, *sorted((place[a], place[b]))) for a, b in edges]
    taken = {(x.chunk, x.rank) for x in similarity._founders(spark.createDataFrame(rows, "chunk int, low int, high int")).collect()}
    for g, (n, edges) in enumerate(graphs):
        want = set(sequential_founders(n, edges).values())
        assert {v for v in range(n) if (g, rank[g][v]) not in taken} == want


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_nearest_equals_brute_force(spark, rows, broadcast_rows, monkeypatch):
    monkeypatch.setattr(similarity, "TRAIN_BLOCK", 13)
    monkeypatch.setattr(similarity, "QUERY_GROUP", 20)
    q = spark.createDataFrame(rows[:50], "id long, chunk int, bits array<int>")
    t = spark.createDataFrame([(i, x, float(i % 7)) for i, _, x in rows[50:]], "tid long, bits array<int>, y double")
    got = {}
    for r in similarity.nearest(q, t, 4, "id", "tid", "bits", "y", 40, broadcast_rows).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour, r.y))
    for i, _, x in rows[:50]:
        want = sorted((len(set(x) ^ set(y)), j, float(j % 7)) for j, _, y in rows[50:])[:4]
        assert sorted(got[i]) == want


def test_blocks_out_of_reach_are_not_met(spark, monkeypatch):
    """Queries of few and of many bits: each meets the training blocks of like sizes only."""
    monkeypatch.setattr(similarity, "TRAIN_BLOCK", 50)
    r = random.Random(9)
    rows = []
    for i in range(600):
        size = r.choice([3, 4, 5, 60, 61, 62])
        rows.append((i, sorted(r.sample(range(8 if size < 10 else 70), size)), float(i % 5)))
    train = spark.createDataFrame(rows, "tid long, bits array<int>, y double")
    query = spark.createDataFrame([(i, b) for i, b, _ in rows[::10]], "id long, bits array<int>")
    met, round_two = similarity._further, []

    def watched(*args):
        out = met(*args)
        round_two.append(out.count())
        return out

    monkeypatch.setattr(similarity, "_further", watched)
    got = {}
    for x in similarity.nearest(query, train, 3, "id", "tid", "bits", "y", 128, 0).collect():
        got.setdefault(x.id, []).append((x.distance, x.neighbour, x.y))
    for i, b, _ in rows[::10]:
        assert sorted(got[i]) == sorted((len(set(b) ^ set(c)), j, z) for j, c, z in rows)[:3]
    assert round_two[0] <= 60 * 6  # of 11 other blocks


def test_neighbour_weights(spark):
    n = spark.createDataFrame([(1, 0, 2.0), (1, 0, 4.0), (1, 3, 9.0), (2, 1, 2.0), (2, 2, 8.0)], "id long, distance long, y double")
    plain = {r.id: r.prediction for r in similarity.neighbour_mean(n, "id").collect()}
    weighted = {r.id: r.prediction for r in similarity.neighbour_mean(n, "id", "distance").collect()}
    assert plain == {1: 5.0, 2: 5.0} and weighted == {1: 3.0, 2: pytest.approx(4.0)}


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("añ𝄞b",)], "t string")
    got = [r.b for r in df.select(fp.fingerprint(fp.char_grams(F.col("t"))).alias("b")).collect()]
    assert len(got[0]) == 3 and len(got[1]) == 1 and got[2] == [] and got[3] is None and len(got[4]) == 2


def test_native_similarity(spark):
    rows = [([1, 2, 3], [2, 3, 4]), ([], []), ([5], [])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    packed = df.select(fp.pack_words(F.col("a"), 2).alias("x"), fp.pack_words(F.col("b"), 2).alias("y"), "a", "b")
    got = packed.select(
        fp.tanimoto(F.col("a"), F.col("b")).alias("s"), fp.tanimoto_words(F.col("x"), F.col("y")).alias("w"),
        fp.hamming_words(F.col("x"), F.col("y")).alias("h"),
    ).collect()
    assert [(r.s, r.w, r.h) for r in got] == [(0.5, 0.5, 2), (0.0, 0.0, 0), (0.0, 0.0, 1)]
    high = spark.createDataFrame([([63, 64, 127],)], "a array<int>").select(fp.pack_words(F.col("a"), 2).alias("w")).first().w
    assert high == [-(2**63), 1 - 2**63]


def test_text_fingerprint_equals_the_expression(spark):
    """Short and missing texts, characters outside ASCII and of two UTF-16 units, and more characters than are numbered."""
    r = random.Random(5)
    some = "abc dé𝄞ñ\n\r \x00😀\t"
    texts = [None, "", "a", "𝄞", "𝄞a", "𝄞bcd", *("".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(200))]
    texts += ["".join(chr(0x4E00 + r.randrange(600)) for _ in range(400)) for _ in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (2048, 64):
        for x in df.select(fp.fingerprint(fp.char_grams(F.col("t")), n).alias("a"), fp.text_fingerprint(F.col("t"), n).alias("b")).collect():
            assert x.a == x.b


def test_tile_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """What comes out of the pairs of tiles is much more than goes in, so small inputs are not put together in one task."""
    monkeypatch.setattr(similarity, "TILE", 16)
    df = spark.createDataFrame(prints(160), "id long, chunk int, bits array<int>").withColumn("chunk", F.lit(0))
    pairs = similarity.similar_pairs(df, "chunk", "id", "bits", 0.1, 40)
    tasks = pairs.select(F.spark_partition_id().alias("p"), "a").groupBy("p").count().count()
    assert tasks > 3


@pytest.mark.parametrize("words, k", [(1, 5), (1, 50), (3, 7), (1, 2000)])
def test_nearest_keeps_ties_and_bounds(words, k):
    r = np.random.default_rng(1)
    train = r.integers(0, 2**63, (1500, words), dtype=np.uint64) & np.uint64(0xFFFF)
    train[:300] = train[0]
    query = train[::11]
    code = np.bitwise_count(query[:, None, :] ^ train[None]).sum(axis=2, dtype=np.int64) * len(train) + np.arange(len(train))
    code = np.sort(code, axis=1)[:, :k]
    places, apart = similarity._nearest(query, train, k)
    assert (places == code % len(train)).all() and (apart == code // len(train)).all()
    bound = r.integers(0, 6, len(query))
    places, apart = similarity._nearest(query, train, k, bound)
    for p, a, b, c in zip(places, apart, bound, code):
        assert (p[a <= b] + a[a <= b] * len(train)).tolist() == c[c // len(train) <= b].tolist()


def test_blocks_return_only_rows_within_the_bound(spark, monkeypatch):
    """All prints have one size, so no block is ruled out; the second round still returns few rows."""
    monkeypatch.setattr(similarity, "TRAIN_BLOCK", 100)
    r = random.Random(2)
    rows = [(i, sorted(r.sample(range(64), 20)), 0.0) for i in range(2000)]
    train = spark.createDataFrame(rows, "tid long, bits array<int>, y double")
    query = spark.createDataFrame([(i, b) for i, b, _ in rows[:40]], "id long, bits array<int>")
    met, out = similarity._in_blocks, []

    def watched(*args):
        out.append(met(*args))
        return out[-1]

    monkeypatch.setattr(similarity, "_in_blocks", watched)
    got = similarity.nearest(query, train, 5, "id", "tid", "bits", "y", 64, 0).collect()
    want = {(i, j) for i, b, _ in rows[:40] for _, j in sorted((len(set(b) ^ set(c)), j) for j, c, _ in rows)[:5]}
    assert {(x.id, x.neighbour) for x in got} == want
    assert out[0].count() < 40 * 20 * 5


@pytest.mark.parametrize("width, cutoff", [(40, 0.6), (40, 0.9), (4000, 0.3)])
def test_edges_are_not_stored_one_by_one(spark, monkeypatch, width, cutoff):
    """A chunk of alike points has a number of edges that is quadratic; what is written grows with the points."""
    counts, write = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, label: counts.append((kept := write(df, label)).count()) or kept)
    rows = [(i, 0, bits[: width // 4]) for i, _, bits in prints(300, width)]
    df = spark.createDataFrame(rows, "id long, chunk int, bits array<int>")
    found = similarity.cluster_chunks(df, "chunk", "id", "bits", cutoff, n_bits=width).collect()
    assert max(counts) <= 300
    want = greedy(rows, cutoff)
    assert sorted(r.founder for r in found if r.place == 0) == sorted(c[0] for c in want)


def test_shelves_change_nothing(df, rows, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "SHELF_FROM", 0)
    packed = similarity.packed(df, ["chunk", "id"], "bits", 40)
    plain, dealt = (similarity.tiles(packed, ["chunk"], "id", 0.3, shelves=s).count() for s in (False, True))
    assert dealt < plain
    bits = {i: x for i, _, x in rows}
    found = similarity.cluster_chunks(df, "chunk", "id", "bits", 0.6, n_bits=40).collect()
    for c in (0, 1):
        for k, members in enumerate(greedy([r for r in rows if r[1] == c], 0.6)):
            own = [r for r in found if r.chunk == c and r.cluster == k]
            assert [r.id for r in sorted(own, key=lambda r: r.place)] == members
            assert [i for _, i in sorted((r.pick, r.id) for r in own if r.pick is not None)] == diverse(members, bits)


def test_a_long_chain_is_settled(spark):
    """Every second point of a path founds a cluster, however long it is."""
    edges = spark.range(2500).selectExpr("0 AS chunk", "cast(id AS int) AS low", "cast(id + 1 AS int) AS high")
    got = sorted((r.rank, r.of) for r in similarity._founders(edges).collect())
    assert got == [(v, v - 1) for v in range(1, 2501, 2)]


def test_bits_and_lists_of_edges_are_one():
    r = random.Random(5)
    a, b = np.arange(100, 170), np.arange(200, 263)
    bits = np.array([[r.random() < 0.1 for _ in b] for _ in a])
    i, j = np.nonzero(bits)
    order = [*a.tolist(), *b.tolist()]
    r.shuffle(order)
    points = pd.DataFrame({"id": order, "rank": range(1, len(order) + 1)})
    blocks = [(a, b, np.packbits(bits, axis=1).tobytes()), (a[i], b[j], None)]
    one, other = (similarity._visited(pd.DataFrame([x], columns=["a", "b", "near"]), points) for x in blocks)
    beside = {v: set() for v in order}
    for x, y in zip(a[i].tolist(), b[j].tolist()):
        beside[x].add(y)
        beside[y].add(x)
    free, want = set(order), [-1] * (len(order) + 1)
    for k, v in enumerate(order, 1):
        if v in free:
            for w in beside[v] & free:
                want[order.index(w) + 1] = k
            free -= beside[v] | {v}
    assert one.tolist() == other.tolist() == want


def test_similar_rows_of_one_id_are_an_error(spark):
    twice = spark.createDataFrame([(1, 0, [1, 2]), (1, 0, [1, 2])], "id long, chunk int, bits array<int>")
    with pytest.raises(Exception, match="same id"):
        similarity.cluster_chunks(twice, "chunk", "id", "bits", 0.6, n_bits=40).collect()
