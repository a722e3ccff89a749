"""Exact, near and repeated-byte dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import exact, near, repeats
from assayer.llm.components import components


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    index = exact.CuckooIndex(16)
    for at in range(0, 5000, 700):
        index.insert(words[at : at + 700])
    assert len(index) == 5000 and (index.keys[index.find(words)] == words).all()
    assert (index.find(rng.integers(0, 1 << 63, (1000, 4), dtype=np.uint64)) < 0).all()
    index.delete(words[:2000])
    assert (index.find(words[:2000]) < 0).all() and (index.find(words[2000:]) >= 0).all()
    index.insert(words[:1500])
    assert len(index) == 4500 and (index.find(words[:1500]) >= 0).all() and (index.find(words[1500:2000]) < 0).all()


def test_cuckoo_false_hit_is_told_apart():
    one = np.array([[7, 9, 1, 1]], np.uint64)
    index = exact.CuckooIndex()
    index.insert(one)
    assert index.find(np.array([[7, 9, 1, 2]], np.uint64))[0] == -1  # same mark and bucket, other digest


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return Counter(out)


def test_exact_decisions(docs_of, edge_rows):
    assert Counter(tuple(r) for r in exact.decide(docs_of(edge_rows)).collect()) == expected_exact(edge_rows)


def test_exact_hot_group_and_clashing_columns(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, digest string, keep_id long").repartition(7)
    assert Counter(tuple(r) for r in exact.decide(docs).collect()) == expected_exact(rows)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k for _, k, *_ in expected_exact(rows)})


def test_index_update(spark):
    digest = lambda s: hashlib.sha256(s.encode()).digest()
    index = spark.createDataFrame([(bytearray(digest(s)), i, 1) for i, s in enumerate("abc")], exact.GROUP_SCHEMA)
    changes = [(bytearray(digest("a")), None, False), (bytearray(digest("d")), 9, True), (bytearray(digest("b")), 7, True)]
    now = exact.update_index(index, spark.createDataFrame(changes, "digest binary, doc_id long, added boolean"), 3).collect()
    found = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in now}
    assert found == {digest("b"): (7, 2), digest("c"): (2, 1), digest("d"): (9, 1)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def expected_near(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return Counter((i, len(s), find(i), i == find(i)) for i, s in sets)


def near_family(seed, n, words=60):
    """Copies of one text with a few words changed each, so similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"b{seed}w{i}" for i in range(words)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(words)] = f"x{seed}{k}{rng.randrange(99)}"
        out.append(" ".join(copy))
    return out


def test_near_components(docs_of):
    texts = [t for seed in range(6) for t in near_family(seed, 25)] + ["", None, "one two", "ONE two", "three", " "]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    assert Counter(tuple(r) for r in near.decide(docs_of(rows)).collect()) == expected_near(rows)


def test_near_template_does_not_crowd_a_task(docs_of, monkeypatch):
    """Documents that share a template but little else, with some near copies among them."""
    rng = random.Random(12)
    template = " ".join(f"t{i}" for i in range(40))
    texts = []
    for i in range(240):
        own = [f"o{i}x{k}" for k in range(rng.choice([12, 20, 30]))]
        texts.append(f"{template} {' '.join(own)}")
        if i % 8 == 0:
            own[rng.randrange(len(own))] = "changed"
            texts += [f"{template} {' '.join(own)}", f"{template} {' '.join(own[:-2])} end"]
    rows = list(enumerate(texts))
    links = near.bucket_links

    def watched(group):
        assert len(group) <= 128, len(group)
        return links(group)

    monkeypatch.setattr(near, "BLOCK", 32)
    monkeypatch.setattr(near, "bucket_links", watched)
    assert Counter(tuple(r) for r in near.decide(docs_of(rows)).collect()) == expected_near(rows)


def test_near_crowded_family(docs_of, monkeypatch):
    texts = [t for seed in range(3) for t in near_family(seed, 60)] + near_family(7, 90, words=25)
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    monkeypatch.setattr(near, "BLOCK", 8)
    assert Counter(tuple(r) for r in near.decide(docs_of(rows)).collect()) == expected_near(rows)


def test_near_edges(docs_of, edge_rows):
    got = near.decide(docs_of(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    known = [(i, t) for i, t in edge_rows if i is not None]
    assert Counter(tuple(r) for r in got if r["doc_id"] is not None) == expected_near(known)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_near_repeated_id_ties_its_texts(docs_of):
    a, b = "a b c d e f g", "q r s t u v w"
    got = {r["doc_id"]: r["component_id"] for r in near.decide(docs_of([(5, a), (5, b), (2, b), (9, a)])).collect()}
    assert got == {5: 2, 2: 2, 9: 2}


def test_near_keep_one_keeps_columns(docs_of):
    docs = docs_of([(3, "a b c d e f"), (1, "A b c d e f"), (2, "x")])
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    least = near.minhash(base)
    for share in (0.95, 0.85, 0.75):
        cut = int(4000 * 2 * share / (1 + share))
        other = np.concatenate([base[:cut], rng.integers(0, 1 << 63, 4000 - cut, dtype=np.uint64)])
        flips = np.bitwise_count((near.odd_sketch(least) ^ near.odd_sketch(near.minhash(other))).view(np.uint64)).sum()
        estimate = 1 + near.SKETCH_BITS / (4 * near.HASHES) * np.log(1 - 2 * flips / near.SKETCH_BITS)
        assert abs(estimate - share) < 0.15 and flips <= near.most_differing_bits()


def test_bucket_links_join_components():
    sets = [np.arange(100), np.arange(5, 105), np.arange(300, 400), np.arange(310, 410)]
    sets = [np.sort(s.astype(np.uint64) << np.uint64(20)) for s in sets]
    group = pd.DataFrame(
        {
            "rep": range(4), "label": range(4), "minor": [False, True, True, True], "members": [near.pack(s) for s in sets],
            "sketch": [near.odd_sketch(near.minhash(s)) for s in sets],
        }
    )
    assert near.bucket_links(group).values.tolist() == [[1, 0], [3, 2]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)]
    got = components(spark.createDataFrame(chain, "a long, b long"), "test")
    assert {r["node"]: r["component"] for r in got.collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_repeated_windows():
    rng = random.Random(4)
    for _ in range(40):
        length = rng.choice([3, 5, 8])
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
        assert [f.tolist() for f in repeats.repeated_windows(texts, length)] == want


def expected_removal(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for i, t in raw if i is not None for k in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if i is not None and seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), len(repeats._runs(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removal(docs, length):
    return Counter(tuple(r) for r in repeats.remove_repeats(docs, length).drop("kept_text").collect())


def test_removal_edges(docs_of, edge_rows):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:6000]) for i, t in edge_rows]
    assert removal(docs_of(rows), repeats.LENGTH) == expected_removal(rows, repeats.LENGTH)


@pytest.mark.parametrize("length", [60, 100])
def test_removal_of_shared_passages(docs_of, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    passages = [text(150) for _ in range(4)] + ["zy" * 90]
    rows = [(i, text(rng.randint(0, 200)) + rng.choice(passages) + text(rng.randint(0, 90)) + rng.choice(passages)) for i in range(60)]
    rows += rows[:5] + [(90 + i, rows[i][1]) for i in range(10)]
    assert removal(docs_of(rows), length) == expected_removal(rows, length)


def test_crowded_anchor_in_pieces(monkeypatch):
    rng = random.Random(6)
    text = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    middle, length = text(120), 100
    group = []
    for _ in range(40):
        lead = rng.randint(0, 30)
        group.append((1, lead, (text(40) + middle)[-lead - 120 :] + rng.choice([b"", b"q" * 20, text(20)])))
    want = repeats.repeated_windows([t for *_, t in group], length)
    monkeypatch.setattr(repeats, "TRANSFORM_BYTES", 10)
    for a, b in zip(repeats.compare(group, length), want):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize("length", [60, 100, 101])
def test_hot_anchor_is_split_before_the_shuffle(docs_of, monkeypatch, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot, ends = text(70), [text(50) for _ in range(4)]
    rows = [(i, (text(90) if i % 2 else rng.choice(ends)) + hot + (text(40) if i % 3 else rng.choice(ends)[: 20 + i % 30])) for i in range(120)]
    rows += [(200 + i, rows[i][1][: 100 + i]) for i in range(30)]
    want, transform = expected_removal(rows, length), repeats._transform

    def watched(batches, n):
        def seen():
            for batch in batches:
                per: Counter = Counter()
                for anchor, piece in zip(batch.column("anchor").to_pylist(), batch.column("piece").to_pylist()):
                    per[anchor] += len(piece)
                assert all(v <= 3000 for v in per.values()), max(per.values())
                yield batch

        return transform(seen(), n)

    monkeypatch.setattr(repeats, "HOT_BYTES", 3000, raising=False)
    monkeypatch.setattr(repeats, "_transform", watched)
    assert removal(docs_of(rows), length) == want


@pytest.mark.parametrize("packed", [True, False])
def test_suffix_order_by_plain_sorts(monkeypatch, packed):
    if not packed:  # as with texts so long that key and place do not fit one number
        places = repeats.sorted_places
        monkeypatch.setattr(repeats, "sorted_places", lambda key, bits: places(key, 63))
    rng = random.Random(9)
    for letters in (b"ab", b"\0\xff", bytes(range(200))):
        core = bytes(rng.choice(letters) for _ in range(300))
        text = core + b"#" + core[:200] + core[50:]
        for depth in (1, 7, 64, 1000):
            order = repeats.suffix_order(np.frombuffer(text, np.uint8), depth).tolist()
            assert sorted(order) == list(range(len(text)))
            cut = [text[i : i + depth] for i in order]
            assert cut == sorted(cut)


def test_pieces_alone_with_a_longer_anchor_skip_the_transform(monkeypatch):
    rng = random.Random(10)
    text = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    core, near, length = text(48), text(400), 400
    pieces = [text(300) + core + text(300) for _ in range(30)]  # these share 48 bytes and no window
    pieces += [text(100) + near[:200] + core + near[200:] + text(100) for _ in range(2)]
    pieces += [pieces[-1], pieces[-1] + text(50)]
    rows = [(i, 0, 5, len(t) - length + 1, 300, length - 48, 7, t) for i, t in enumerate(pieces)]
    columns = ["doc_id", "copy", "low", "windows", "lead", "slack", "anchor", "piece"]
    batch = pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows])
    windows, compared = repeats.repeated_windows, []
    monkeypatch.setattr(repeats, "repeated_windows", lambda texts, n: compared.extend(texts) or windows(texts, n))
    got = {
        (r["doc_id"], w)
        for out in repeats._transform(iter([batch]), length) for r in out.to_pylist() for w in range(r["low"], r["high"])
    }
    want = {(i, 5 + k) for i, flags in enumerate(windows(pieces, length)) for k in np.flatnonzero(flags).tolist()}
    assert got == want and {i for i, _ in got} == {30, 31, 32, 33}
    assert compared and all(core in t and near[150:200] in t for t in compared)


def test_long_passages_go_and_clean_documents_stay(docs_of):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    long, short = words(55), words(45)  # 439 and 359 bytes
    rows = [(i, f"{words(60)}{i}{long}{i}{words(40)}") for i in range(6)]
    rows += [(10 + i, f"{words(60)}{i}{short}{i}{words(40)}") for i in range(6)] + [(20 + i, words(150)) for i in range(6)]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs_of(rows)).collect()}
    for i, text in rows:
        kept = text.replace(long, "") if i < 10 else text
        assert got[i]["n_removed"] == len(text) - len(kept) and bytes(got[i]["kept_text"]).decode() == kept


def test_halves_keep_equal_windows_together():
    rng = random.Random(8)
    text = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    core, length = b"<" + text(46) + b">", 64
    level = [(i, 0, 0, 17, 16, length - 48, 5, text(16) + core + text(16)) for i in range(300)]
    want = {(r[0], k): r[-1][k : k + length] for r in level for k in range(17)}
    while level[0][5]:
        level = [h for row in level for h in repeats.halve(row, length)]
        got = [((r[0], r[2] + k), r[6], r[-1][k : k + length]) for r in level for k in range(r[3])]
        assert len(got) == len(want) and all(want[place] == window for place, _, window in got)
        anchors = defaultdict(set)
        for _, anchor, window in got:
            anchors[window].add(anchor)
        assert all(len(a) == 1 for a in anchors.values())
        level.sort(key=lambda r: -r[5])


def test_empty_tables(docs_of):
    none = docs_of([])
    assert exact.decide(none).count() == near.decide(none).count() == repeats.remove_repeats(none).count() == 0
    assert exact.keep_one(none).count() == near.keep_one(none).count() == 0


def test_union_of_columns_is_left_alone(docs_of):
    docs = docs_of([(1, "a b c d e f g"), (2, "a b c d e f g h")]).withColumn("component_id", F.lit("x")).withColumn("band", F.lit(1))
    assert near.decide(docs).count() == 2


@pytest.mark.parametrize("stage", [exact.keep_one, near.keep_one])
def test_stages_leave_clashing_columns_alone(spark, stage):
    """Columns with the names that the stages use inside, null ids, and rows that are there twice."""
    body = "one two three four five six seven eight nine ten"
    names = ["_kept_id", "_kept_digest", "_row", "_maybe", "_bit", "_word", "_flags", "id", "digest", "key", "stays"]
    rows = [(1, body), (2, body), (3, "another text of more than five words here"), (None, body), (None, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in rows], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    made = stage(docs)
    assert made.columns == docs.columns
    got = {tuple(r) for r in made.collect()}
    assert got <= {tuple(r) for r in docs.collect()}
    gone = {1, 4} if stage is exact.keep_one else {2}  # the largest id stays of equal texts, the smallest of near ones
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, None} - gone and sum(r[0] is None for r in got) == 2


def test_exact_stage_keeps_one_of_repeated_rows(docs_of):
    rows = [(1, "a text"), (1, "a text"), (1, "A TEXT"), (1, "other"), (2, "alone")]
    assert sorted((r.doc_id, r.text.lower()) for r in exact.keep_one(docs_of(rows)).collect()) == [(1, "a text"), (1, "other"), (2, "alone")]
