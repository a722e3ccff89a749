import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import geometry, sites

ATOMS = "complex_id long, x double, y double, z double, type int"


def brute(items, receptors):
    out = {}
    for c, x, y, z, t in items:
        for d, u, v, w, s in receptors:
            if c == d and t != 1000 and s < 4 and (x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2 < 144:
                out[(c, t, s)] = out.get((c, t, s), 0) + 1
    return out


def cloud(n, seed, spread, types):
    r = random.Random(seed)
    return [(r.choice([1, 1, 2]), *(round(r.uniform(-spread, spread), 2) for _ in range(3)), r.choice(types)) for _ in range(n)]


@pytest.mark.parametrize("tile", [2048, 3])
def test_contacts_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(geometry, "TILE_POINTS", tile)
    items = cloud(80, 1, 20, [0, 1, 8, 1000]) + [(1, 0.0, 0.0, 0.0, 0)] * 3
    receptors = cloud(150, 2, 20, [0, 1, 2, 3, 4, 1000]) + [(1, 12.0, 0.0, 0.0, 0), (1, 11.999, 0.0, 0.0, 0)]
    got = geometry.contacts(spark.createDataFrame(items, ATOMS), spark.createDataFrame(receptors, ATOMS)).collect()
    assert {(r.complex_id, r.item_type, r.receptor_type): r.n_contacts for r in got} == brute(items, receptors)


def test_a_shared_receptor_is_held_once(spark):
    items, receptor = cloud(60, 3, 15, [0, 1]), [r for r in cloud(80, 4, 15, [0, 3]) if r[0] == 1]
    shared = spark.createDataFrame(items, ATOMS).withColumn("receptor", F.lit(9).cast("long"))
    one = spark.createDataFrame([(9, *r[1:]) for r in receptor], ATOMS.replace("complex_id", "receptor"))
    got = geometry.contacts(shared, one, receptor_id="receptor").collect()
    want = brute(items, [(c, *r[1:]) for c in (1, 2) for r in receptor])
    assert {(r.complex_id, r.item_type, r.receptor_type): r.n_contacts for r in got} == want


def test_a_crowded_receptor_is_dealt_over_bounded_groups(spark):
    """10,000 items in one pocket of one receptor: several groups per cell, none of them large."""
    r = random.Random(6)
    items = spark.range(10_000).select(
        F.col("id").alias("complex_id"), F.lit(1).cast("long").alias("receptor"),
        *[(F.rand(seed) * 5.9).alias(a) for a, seed in zip("xyz", (1, 2, 3))], F.lit(0).alias("type"),
    )
    receptor = spark.createDataFrame([(1, r.uniform(6, 11.9), r.uniform(0, 5.9), r.uniform(0, 5.9), i % 4) for i in range(5000)], ATOMS.replace("complex_id", "receptor"))
    near, far = geometry._dealt(geometry._cells(items, ["complex_id", "receptor"], "_n"), geometry._cells(receptor, ["receptor"], "_m"), "receptor")
    key = ["receptor", "_cx", "_cy", "_cz", "_near", "_far"]
    sizes = near.groupBy(*key).count().withColumnRenamed("count", "a").join(far.groupBy(*key).count().withColumnRenamed("count", "b"), key, "outer").collect()
    assert len(sizes) == 15  # five tiles of items against three of the receptor
    assert all(s.a < 1.3 * geometry.TILE_POINTS and s.b < 1.3 * geometry.TILE_POINTS for s in sizes)
    assert near.count() == 3 * 10_000 and far.count() == 5 * 5000


def test_no_point_goes_to_an_empty_cell(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0), (1, 500.0, 0.0, 0.0, 0)], ATOMS)
    receptors = spark.createDataFrame([(1, 8.0, 0.0, 0.0, 0), (2, 0.0, 0.0, 0.0, 0)], ATOMS)
    near, far = geometry._dealt(geometry._cells(items, ["complex_id"], "_n"), geometry._cells(receptors, ["complex_id"], "_m"), "complex_id")
    assert (near.count(), far.count()) == (1, 1)


def test_distance_of_exactly_the_cutoff_is_no_contact(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0)], ATOMS)
    at = spark.createDataFrame([(1, 12.0, 0.0, 0.0, 0)], ATOMS)
    assert geometry.contacts(items, at).count() == 0


def test_contact_features_fill_zero(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 8), (2, 0.0, 0.0, 0.0, 0)], ATOMS)
    receptors = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 3)], ATOMS)
    rows = {r.complex_id: r.asDict() for r in geometry.contact_features(geometry.contacts(items, receptors), items).collect()}
    assert rows[1]["S/I"] == 1.0 and sum(v for k, v in rows[2].items() if k != "complex_id") == 0.0
    assert len(rows[1]) == 37


def test_site_rank_flat_and_fallback(spark):
    rows = [("a", 0, 50.0, 1.0, 1.0, 1.0), ("a", 1, 60.0, 1.0, 1.0, 1.0), ("b", 0, 50.0, 2.0, 1.0, 0.0), ("b", 1, 200.0, 1.0, 1.0, 0.0), ("b", 2, 300.0, 5.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "s string, ordinal int, volume double, area double, depth double, hydrophobicity double")
    got = {(r.s, r.id): (r.rank, round(r.rank_score, 6)) for r in sites.rank_sites(df, "s").collect()}
    # no site of a is large enough, so both stay; b drops its small first site and keeps the others' ids
    assert got == {
        ("a", "KAA"): (2, 32.5), ("a", "KAB"): (1, 67.5), ("b", "KAB"): (2, 17.5), ("b", "KAC"): (1, 82.5),
    }


def test_crowded_points_go_to_few_blocks(spark, monkeypatch):
    """Points that reach most cells around them are copied to eight blocks at most, and counted as by brute force."""
    items, receptors = cloud(1500, 8, 14, [0, 1, 8]), cloud(1500, 9, 14, [0, 1, 2, 3])
    dealt, sizes = geometry._dealt, []

    def watched(*args):
        sides = dealt(*args)
        sizes.append([side.count() for side in sides])
        return sides

    monkeypatch.setattr(geometry, "_dealt", watched)
    got = geometry.contacts(spark.createDataFrame(items, ATOMS), spark.createDataFrame(receptors, ATOMS)).collect()
    assert {(r.complex_id, r.item_type, r.receptor_type): r.n_contacts for r in got} == brute(items, receptors)
    assert sizes[0][0] <= 8 * 1500 and sizes[0][1] <= 1500
