"""Contacts between two sets of points as a grid join, and point summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.session import stored

# fixed values: contact cutoff, code of other elements, item and receptor types counted
CUTOFF = 12.0
OTHER_TYPE = 1000
ITEM_ELEMENTS = ["C", "N", "O", "S", "P", "F", "Cl", "Br", "I"]
RECEPTOR_ELEMENTS = ["C", "N", "O", "S"]
# fixed values: the five score terms that follow the 36 counts
TERMS = ["gauss1(inter)", "gauss2(inter)", "repulsion(inter)", "hydrophobic(inter)", "Hydrogen(inter)"]

# half the cutoff: two points of one cell are always in contact
EDGE = CUTOFF / 2
# points of either side that meet in one group, about; contacts meet over blocks of cells, with as many more of them
TILE_POINTS = 2048
BLOCK_CELLS, BLOCK_TILES = 4, 32
# points of a finer cell, about, and pairs of cells or points looked at in one step
CELL_POINTS, PAIR_STEP = 24, 1 << 19


def feature_names() -> list[str]:
    """``receptor/item`` names of the 36 counts in feature order (item type * 4 + receptor type)."""
    return [f"{r}/{i}" for i in ITEM_ELEMENTS for r in RECEPTOR_ELEMENTS]


def _cells(atoms: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Distinct points with multiplicity and their grid cell."""
    points = atoms.filter(F.col("type") != OTHER_TYPE).groupBy(*keys, "x", "y", "z", "type").agg(
        F.count(F.lit(1)).alias(n)
    )
    return points.withColumns({f"_c{a}": F.floor(F.col(a) / EDGE) for a in "xyz"})


def _dealt(items: DataFrame, receptors: DataFrame, receptor_id: str, span: int = 1, tile: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Item points and receptor points that may be in contact across cells, under the tile pairs where they meet.

    Receptor cells make blocks of ``span`` cells a side, whose numbers replace those of the cell in the result.  Cells are
    planned first: an occupied item cell reaches the blocks within two cells (for blocks of one cell not its own), and of these
    only blocks with receptor points stay, so no point is ever copied to an empty block.  The receptor points of a block and the
    item points that reach it are both cut into tiles of about ``tile`` points; every pair of tiles is a group of its own.
    """
    tile = tile or TILE_POINTS
    place = ["_cx", "_cy", "_cz"]
    cell = [receptor_id, *place]
    to = [receptor_id, *[f"_to{c}" for c in place]]
    blocked = receptors.withColumns({c: F.floor(F.col(c) / span) for c in place})
    occupied = blocked.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n_far")).withColumnsRenamed({c: f"_to{c}" for c in place})
    reach = items.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n_near"))
    for c in place:
        reach = reach.withColumn(f"_to{c}", F.explode(F.sequence(F.floor((F.col(c) - 2) / span), F.floor((F.col(c) + 2) / span))))
    if span == 1:
        reach = reach.filter(" OR ".join(f"{c} <> _to{c}" for c in place))
    pairs = stored(reach.join(occupied, to), "cell-pairs")

    def tiles(points: Column) -> Column:
        return F.ceil(points / F.lit(float(tile)))

    load = pairs.groupBy(*to).agg(tiles(F.sum("_n_near")).alias("_near_tiles"), tiles(F.max("_n_far")).alias("_far_tiles"))
    # a cell reaches 124 others at most, so its plan is one short array
    entry = F.struct(*[F.col(f"_to{c}") for c in place], "_near_tiles", "_far_tiles")
    plan = pairs.join(load, to).groupBy(*cell).agg(F.collect_list(entry).alias("_plan"))
    near = items.join(plan, cell).withColumn("_p", F.explode("_plan")).select(
        *[c for c in items.columns if c not in place],
        *[F.col(f"_p._to{c}").alias(c) for c in place],
        F.pmod(F.xxhash64(*[c for c in items.columns if c not in place]), F.col("_p._near_tiles")).alias("_near"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p._far_tiles") - 1)).alias("_far"),
    )
    far = blocked.join(load.withColumnsRenamed({f"_to{c}": c for c in place}), cell).select(
        *receptors.columns, F.pmod(F.xxhash64("x", "y", "z", "type"), F.col("_far_tiles")).alias("_far"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_near_tiles") - 1)).alias("_near"),
    )
    return near, far


def _fine(points: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in order of finer cells (``parts`` to a cell's side), as places; where each finer cell starts; its cell."""
    cells = np.floor(points / EDGE)
    inner = np.clip(np.nan_to_num(np.floor((points / EDGE - cells) * parts)), 0, parts - 1)
    code = np.zeros(len(points), np.int64)
    for axis in [*cells.T, *inner.T]:
        # ranks, so far-off points cannot overflow the code
        values, rank = np.unique(axis, return_inverse=True)
        code = np.unique(code * len(values) + rank, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, starts, cells[order][starts]


def near_counts(near: np.ndarray, far: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every point of ``near`` the sum of ``weights`` (points of ``far`` by columns) within the cutoff, outside its own cell.

    Both sides are sorted into finer cells.  Where all points of two of them are in contact, sums are added without
    forming pairs; where none are, nothing is done; only what lies across the cutoff is compared point by point.
    """
    crowd = len(far) / max(1, len(np.unique(np.floor(far / EDGE), axis=0)))
    parts = int(np.clip(round((crowd / CELL_POINTS) ** (1 / 3)), 1, 8))
    sides = []
    for points in (near, far):
        order, starts, cells = _fine(points, parts)
        points = points[order]
        sides.append((order, starts, np.append(starts[1:], len(points)), cells, points, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)))
    (order, starts, ends, cells, points, low, high), (f_order, f_starts, f_ends, f_cells, f_points, f_low, f_high) = sides
    weights = weights[f_order]
    sums = np.add.reduceat(weights, f_starts)
    whole, single = np.zeros((len(starts), weights.shape[1])), np.zeros((len(near), weights.shape[1]))
    # far enough from the cutoff for rounding not to matter
    inner, outer = CUTOFF**2 * (1 - 1e-9), CUTOFF**2 * (1 + 1e-9)
    step = max(1, PAIR_STEP // len(starts))
    for at in range(0, len(f_starts), step):
        least = most = 0.0
        own = np.ones((len(f_starts[at : at + step]), len(starts)), bool)
        for a in range(3):
            lo, hi = f_low[at : at + step, a, None], f_high[at : at + step, a, None]
            least = least + np.maximum(np.maximum(low[:, a] - hi, lo - high[:, a]), 0) ** 2
            most = most + np.maximum(high[:, a] - lo, hi - low[:, a]) ** 2
            own &= f_cells[at : at + step, a, None] == cells[:, a]
        inside = (most < inner) & ~own
        whole += inside.T.astype(float) @ sums[at : at + step]
        across = ~((least > outer) | inside | own)
        for i in np.flatnonzero(across.any(axis=1)):
            met = np.flatnonzero(across[i])
            n = ends[met] - starts[met]
            idx = np.arange(n.sum()) + np.repeat(starts[met] - (np.cumsum(n) - n), n)
            p = points[idx]
            begin, end = f_starts[at + i], f_ends[at + i]
            rows = max(1, PAIR_STEP // len(idx))
            for r in range(begin, end, rows):
                q = f_points[r : min(r + rows, end)]
                gaps = [q[:, a, None] - p[:, a] for a in range(3)]
                close = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] < CUTOFF * CUTOFF
                single[idx] += close.T.astype(float) @ weights[r : min(r + rows, end)]
    out = np.empty_like(single)
    out[order] = single + np.repeat(whole, ends - starts, axis=0)
    return out


def contacts(
    item_atoms: DataFrame, receptor_atoms: DataFrame, complex_id: str = "complex_id", receptor_id: str | None = None
) -> DataFrame:
    """Pairs closer than 12 per complex, item type and receptor type: ``n_contacts``.

    Atoms: ``complex_id, x, y, z, type``.  Where many items share a receptor, name its
    key: items then carry complex and receptor, receptor atoms only the receptor, and
    each receptor is held once.

    Points meet over grid cells of half the cutoff.  Points in the same cell are always
    in contact, so their counts are multiplied without forming pairs; other cells meet in
    blocks, tile against tile, where :func:`near_counts` verifies what lies across the cutoff.
    """
    receptor_id = receptor_id or complex_id
    owner = list(dict.fromkeys([complex_id, receptor_id]))
    # both sides are read by the plan of the cells and by the join
    items = stored(_cells(item_atoms, owner, "_n"), "item-points")
    receptors = stored(_cells(receptor_atoms.filter(F.col("type") < len(RECEPTOR_ELEMENTS)), [receptor_id], "_m"), "receptor-points")
    place = ["_cx", "_cy", "_cz"]
    cell = [receptor_id, *place]

    same_items = items.groupBy(*owner, *place, F.col("type").alias("item_type")).agg(F.sum("_n").alias("_n"))
    same_receptors = receptors.groupBy(*cell, F.col("type").alias("receptor_type")).agg(F.sum("_m").alias("_m"))
    same = same_items.join(same_receptors, cell).select(
        complex_id, "item_type", "receptor_type", (F.col("_n") * F.col("_m")).alias("_pairs")
    )

    near, far = _dealt(items, receptors, receptor_id, BLOCK_CELLS, BLOCK_TILES * TILE_POINTS)
    schema = T.StructType(
        [
            items.schema[complex_id], T.StructField("item_type", items.schema["type"].dataType),
            T.StructField("receptor_type", receptors.schema["type"].dataType), T.StructField("_pairs", T.LongType()),
        ]
    )

    def verify(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.names)
        types, of = np.unique(right["type"].to_numpy(), return_inverse=True)
        weights = np.zeros((len(right), len(types)))
        weights[np.arange(len(right)), of] = right["_m"]
        found = near_counts(left[list("xyz")].to_numpy(float), right[list("xyz")].to_numpy(float), weights)
        pairs = pd.DataFrame(found.astype(np.int64) * left["_n"].to_numpy()[:, None], columns=types)
        summed = pairs.groupby([left[complex_id].to_numpy(), left["type"].to_numpy()], dropna=False).sum().stack().reset_index()
        summed.columns = schema.names
        return summed[summed["_pairs"] > 0]

    group = [*cell, "_near", "_far"]
    verified = near.groupBy(*group).cogroup(far.groupBy(*group)).applyInPandas(verify, schema)
    return same.unionByName(verified).groupBy(complex_id, "item_type", "receptor_type").agg(
        F.sum("_pairs").alias("n_contacts")
    )


def contact_features(contact_counts: DataFrame, complexes: DataFrame, complex_id: str = "complex_id") -> DataFrame:
    """One row per complex with the 36 counts (0 where there is no contact)."""
    slot = F.col("item_type") * len(RECEPTOR_ELEMENTS) + F.col("receptor_type")
    wide = contact_counts.groupBy(complex_id).agg(
        *[F.sum(F.when(slot == i, F.col("n_contacts"))).cast("double").alias(f) for i, f in enumerate(feature_names())]
    )
    return complexes.select(complex_id).distinct().join(wide, complex_id, "left").na.fill(0.0)


def with_terms(features: DataFrame, terms: DataFrame, complex_id: str = "complex_id") -> DataFrame:
    """The 36 counts and the five terms: 41 columns per complex."""
    return features.join(terms.select(complex_id, *[f"`{t}`" for t in TERMS]), complex_id)


def centroids(points: DataFrame, groups: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Mean point and point count of every group; the origin for a group without points."""
    means = points.groupBy(*by).agg(
        F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(z).alias("cz"), F.count(F.lit(1)).alias("n_points")
    )
    return groups.select(*by).distinct().join(means, list(by), "left").na.fill(0, ["cx", "cy", "cz", "n_points"])
