"""Similar pairs, threshold clusters and diverse picks within chunks of bounded size; nearest neighbours.

Chunks are part of the method (at most 10,000 items, see ``sampling.chunks``).  A chunk's items are tiled by size; a task
compares two tiles of at most 1,024 items over an inverted index of their rarest bits, and only pairs above the cutoff come
out.  Clusters need only which pairs are near, so their edges are kept as one bit a pair (or as a list, where they are few);
a chunk's points are then visited one by one over these bits, and a cluster's picks are made from its own members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.bits import N_BITS
from assayer.functions.common import give_back
from assayer.operators.cleaning import keep_first
from assayer.operators.ranking import places, row_positions
from assayer.operators.sampling import MAX_CHUNK
from assayer.session import stored

# fixed values: distance cutoffs of the two stages, picks per cluster
FIRST_CUTOFF, SECOND_CUTOFF = 0.6, 0.3
MAX_PICKS = 5
# items of a tile, tiles dealt as one where what comes out is small, such tiles a core that make it worthwhile, pairs verified at once
TILE, SHELF, SHELF_FROM, PAIR_STEP = 1024, 4, 8, 1 << 14
# distances that a step of the nearest-neighbour search looks at, training rows of a stretch
NEAREST_WORDS, NEAREST_STRETCH = 1 << 20, 1024
# a training table up to this size is sent to every task; a larger one is joined in blocks
BROADCAST_TRAIN = 20_000
QUERY_GROUP = 16_384
TRAIN_BLOCK = 4096


def packed(df: DataFrame, columns: Sequence[str], bits: str, n_bits: int = N_BITS) -> DataFrame:
    """``columns`` with the set bits as ``_words`` (64-bit words) and their number ``_size``; NULL bits are none."""
    n_words = -(-n_bits // 64)
    kept = [df.schema[c] for c in columns]
    schema = T.StructType([*kept, T.StructField("_words", T.ArrayType(T.LongType())), T.StructField("_size", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            set_bits = batch.column(bits)
            sizes = set_bits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.zeros((batch.num_rows, n_words * 64), np.uint8)
            rows[np.repeat(np.arange(batch.num_rows), sizes), set_bits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = 1
            words = np.packbits(rows, axis=1, bitorder="little").view("<i8")
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_words)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.ListArray.from_arrays(ends, pa.array(words.ravel())), pa.array(rows.sum(axis=1, dtype=np.int32))],
                schema.names,
            )

    return df.select(*dict.fromkeys([*columns, bits])).mapInArrow(run, schema)


def tiles(
    prints: DataFrame, group: Sequence[str], item_id: str, floor: float, most: int | None = MAX_CHUNK, shelves: bool = False
) -> DataFrame:
    """Rows of ``prints`` (with ``_words``, ``_size``) once for every pair of tiles they take part in: ``_left, _right, _tile``.

    A group's rows are tiled by size, so all pairs that can reach the similarity ``floor`` meet in some pair of tiles, and pairs
    of tiles whose sizes rule it out never come up.  No pair of tiles holds more than ``2 * TILE`` rows.  The pairs are dealt over
    as many tasks as there are tiles: their bytes are few, but what comes out of them is not.

    With ``shelves`` little comes out, and on a table with enough tiles for all cores ``SHELF`` of them are dealt as one: a row
    goes out a third of the times.  ``_left`` and ``_right`` number these, and ``_shelf`` is the row's own.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_size", item_id)) - 1
    if most is not None:
        too_many = F.raise_error(F.lit(f"a chunk holds more than {most} items; assign smaller chunks"))
        place = F.when(place < most, place).otherwise(too_many.cast("int"))
    tiled = stored(prints.withColumn("_tile", F.floor(place / F.lit(TILE)).cast("int")), "tiles")
    tasks = max(1, -(-tiled.count() // TILE))
    shelf = SHELF if shelves and tasks >= SHELF_FROM * tiled.sparkSession.sparkContext.defaultParallelism else 1
    tiled = tiled.withColumn("_shelf", F.floor(F.col("_tile") / F.lit(shelf)).cast("int"))
    sizes = tiled.groupBy(*group, "_shelf").agg(F.min("_size").alias("_low"), F.max("_size").alias("_high"))
    left = sizes.select(*group, F.col("_shelf").alias("_left"), F.col("_high").alias("_left_high"))
    right = sizes.select(*group, F.col("_shelf").alias("_right"), F.col("_low").alias("_right_low"))
    reach = (F.col("_left") <= F.col("_right")) & (F.col("_left_high") >= F.col("_right_low") * F.lit(floor))
    pairs = left.join(right, list(group)).filter(reach).select(*group, "_left", "_right")  # at most 10 tiles a chunk
    met = pairs.withColumn("_shelf", F.explode(F.array_distinct(F.array("_left", "_right"))))
    return tiled.join(met, [*group, "_shelf"]).repartition(tasks, *group, "_left", "_right")


def _products(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row of ``left``, row of ``right``) that share a column of these 0/1 matrices, once each."""
    a_col, a_row = np.nonzero(left.T)
    b_col, b_row = np.nonzero(right.T)
    firsts = np.searchsorted(b_col, a_col, "left")
    times = np.searchsorted(b_col, a_col, "right") - firsts
    ends = np.cumsum(times)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(firsts, times)
    code = np.unique(np.repeat(a_row, times).astype(np.int64) * len(right) + b_row[at])
    return code // len(right), code % len(right)


def candidates(left: np.ndarray, right: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two word matrices that may reach the similarity ``floor``.

    With the rarest bits first, sets at the floor share one of the first ``size - ceil(floor * size) + 1`` bits of each.  An
    inverted index over these bits gives the pairs; where it would name more pairs than there are, the sizes alone decide.
    """
    bits = [np.unpackbits(w.view(np.uint8), axis=1, bitorder="little") for w in (left, right)]
    order = np.argsort(bits[0].sum(axis=0, dtype=np.int64) + bits[1].sum(axis=0, dtype=np.int64), kind="stable")
    sizes, prefixes = [], []
    for b in bits:
        size = b.sum(axis=1, dtype=np.int64)
        first = size - np.ceil(floor * size).astype(np.int64) + 1
        b = b[:, order]
        prefixes.append(b * (np.cumsum(b, axis=1, dtype=np.int32) <= first[:, None]))
        sizes.append(size)
    named = (prefixes[0].sum(axis=0, dtype=np.int64) * prefixes[1].sum(axis=0, dtype=np.int64)).sum()
    if named < len(left) * len(right):
        i, j = _products(*prefixes)
    else:
        i, j = np.divmod(np.arange(len(left) * len(right)), len(right))
    a, b = sizes[0][i], sizes[1][j]
    fits = (a > 0) & (np.minimum(a, b) >= floor * np.maximum(a, b))
    return i[fits], j[fits]


def similarities(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shared over united bits of the rows ``i`` of ``left`` and ``j`` of ``right``; 0 for two empty ones."""
    sizes = [np.bitwise_count(w).sum(axis=1, dtype=np.int64) for w in (left, right)]
    # where most pairs are asked for, one product of the 0/1 matrices counts the shared bits of them all
    shared = _shared(left, right) if len(i) * 8 > len(left) * len(right) else None
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIR_STEP):
        a, b = i[at : at + PAIR_STEP], j[at : at + PAIR_STEP]
        both = np.bitwise_count(left[a] & right[b]).sum(axis=1, dtype=np.int64) if shared is None else shared[a, b].astype(np.int64)
        either = sizes[0][a] + sizes[1][b] - both
        out[at : at + PAIR_STEP] = np.divide(both, either, out=np.zeros(len(both)), where=either > 0)
    return out


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of shared bits of all rows of two word matrices (whole numbers, exact in single precision)."""
    bits = [np.unpackbits(w.view(np.uint8), axis=1).astype(np.float32) for w in (left, right)]
    return bits[0] @ bits[1].T


def _all_similarities(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """:func:`similarities` of all rows of ``left`` with all of ``right``, some rows of ``left`` at a time."""
    shared = _shared(left, right)
    sizes = [np.bitwise_count(w).sum(axis=1, dtype=np.float64) for w in (left, right)]
    step = max(1, PAIR_STEP // max(1, len(right)))
    for at in range(0, len(left), step):
        both = shared[at : at + step].astype(np.float64)
        either = sizes[0][at : at + step, None] + sizes[1] - both
        yield slice(at, at + step), np.divide(both, either, out=np.zeros(both.shape), where=either > 0)


def _words(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.to_list()).astype(np.int64, copy=False).reshape(len(column), -1).view(np.uint64)


def _tile_pairs(df: DataFrame, group: Sequence[str], item_id: str, floor: float, accept: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``group, a, b, similarity`` of the accepted pairs among the rows that :func:`tiles` has dealt."""
    kind = df.schema[item_id].dataType
    schema = T.StructType(
        [*(df.schema[g] for g in group), T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())]
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["_tile"] == pdf[c].iloc[0]] for c in ("_left", "_right")]
        if not all(map(len, sides)):
            return pd.DataFrame(columns=schema.names)
        words, ids = [_words(s["_words"]) for s in sides], [s[item_id].to_numpy() for s in sides]
        i, j = candidates(*words, floor)
        if pdf["_left"].iloc[0] == pdf["_right"].iloc[0]:
            i, j = i[i < j], j[i < j]
        s = similarities(*words, i, j)
        near = accept(s)
        a, b, s = ids[0][i[near]], ids[1][j[near]], s[near]
        swap = a > b
        out = {g: pdf[g].iloc[0] for g in group}
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "similarity": s}).assign(**out)[schema.names]

    return df.select(*group, "_left", "_right", "_tile", item_id, "_words").groupBy(*group, "_left", "_right").applyInPandas(compare, schema)


def similar_pairs(df: DataFrame, chunk: str, item_id: str, bits: str, min_similarity: float, n_bits: int = N_BITS) -> DataFrame:
    """Pairs ``a < b`` of the same chunk with at least the given similarity, which must be above 0."""
    if min_similarity <= 0:
        raise ValueError("every pair is similar at 0; give a similarity above it")
    floor = min_similarity - 1e-9
    dealt = tiles(packed(df, [chunk, item_id], bits, n_bits), [chunk], item_id, floor)
    return _tile_pairs(dealt, [chunk], item_id, floor, lambda s: s >= min_similarity)


def _shelf_pairs(pdf: pd.DataFrame, item_id: str, floor: float) -> Iterator[tuple[bool, list[np.ndarray], list[np.ndarray]]]:
    """Pairs of tiles within a dealt pair of shelves that sizes do not rule out: whether it is one tile, ids and words of both."""
    parts = []
    for tile, rows in pdf.groupby("_tile"):
        words = _words(rows["_words"])
        sizes = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        parts.append((tile, rows["_shelf"].iloc[0], rows[item_id].to_numpy(), words, sizes.min(), sizes.max()))
    for tile, shelf, ids, words, _, high in parts:
        for other, other_shelf, other_ids, other_words, low, _ in parts:
            if shelf == pdf["_left"].iloc[0] and other_shelf == pdf["_right"].iloc[0] and tile <= other and high >= low * floor:
                yield tile == other, [ids, other_ids], [words, other_words]


def _near_blocks(df: DataFrame, chunk: str, item_id: str, floor: float, accept: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The accepted pairs among the rows that :func:`tiles` has dealt, a row per pair of tiles: ``chunk, a, b, n, near``.

    ``near`` has a bit for every id of ``a`` with every id of ``b``, each row of bits filled up to whole bytes; where the pairs are
    few it is NULL, and ``a`` and ``b`` list them.  ``n`` counts the pairs of each id of ``a``, then of each of ``b``.
    """
    ids = T.ArrayType(df.schema[item_id].dataType)
    schema = T.StructType(
        [
            T.StructField("chunk", df.schema[chunk].dataType), T.StructField("a", ids), T.StructField("b", ids),
            T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("near", T.BinaryType()),
        ]
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, (a, b), words in _shelf_pairs(pdf, item_id, floor):
            bits = np.zeros((len(a), len(b)), bool)
            for at, s in _all_similarities(*words):
                bits[at] = accept(s)
            bits[~words[0].any(axis=1)] = False
            if own:
                bits = np.triu(bits, 1)
            # a listed pair takes two ids and two counts, some 24 bytes
            if np.count_nonzero(bits) * 192 < bits.size:
                i, j = np.nonzero(bits)
                out.append((a[i], b[j], np.ones(2 * len(i), np.int32), None))
                continue
            counts = np.concatenate([bits.sum(axis=1, dtype=np.int32), bits.sum(axis=0, dtype=np.int32)])
            out.append((a, b, counts, np.packbits(bits, axis=1).tobytes()))
        give_back()
        found = pd.DataFrame([x for x in out if len(x[0])], columns=["a", "b", "n", "near"])
        return found.assign(chunk=pdf[chunk].iloc[0])[schema.names]

    dealt = df.select(chunk, "_left", "_right", "_shelf", "_tile", item_id, "_words")
    return dealt.groupBy(chunk, "_left", "_right").applyInPandas(compare, schema)


def _founders(edges: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """``chunk, rank, of`` of the points that found no cluster, ``of`` being the rank of the founder each belongs to.

    ``edges`` are blocks of :func:`_near_blocks`, and ``ranked`` has the ``rank`` of every ``chunk, id``; without it they are edges
    ``chunk, low, high`` between ranks.  A chunk's points are visited one by one in one task, which holds the blocks and the
    neighbours of ``TILE`` points: one that is still open founds a cluster and takes its open neighbours.
    """
    if ranked is None:
        ends = edges.select("chunk", F.explode(F.array("low", "high")).alias("id")).distinct()
        ranked = ends.withColumn("rank", F.col("id"))
        lists = F.collect_list("low").alias("a"), F.collect_list("high").alias("b")
        edges = edges.groupBy("chunk").agg(*lists).withColumn("near", F.lit(None).cast("binary"))
    schema = T.StructType([edges.schema["chunk"], T.StructField("rank", T.IntegerType()), T.StructField("of", T.IntegerType())])

    def visit(blocks: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        of = _visited(blocks, points.dropna(subset=["id"])[["id", "rank"]])
        give_back()
        taken = np.flatnonzero(of >= 0)
        out = pd.DataFrame({"rank": taken.astype(np.int32), "of": of[taken].astype(np.int32)})
        return out.assign(chunk=points["chunk"].iloc[0] if len(points) else None)[schema.names]

    return (
        edges.select("chunk", "a", "b", "near").groupBy("chunk")
        .cogroup(ranked.select("chunk", "id", "rank").groupBy("chunk")).applyInPandas(visit, schema)
    )


def _visited(blocks: pd.DataFrame, points: pd.DataFrame) -> np.ndarray:
    """By rank, the founder that takes a point of one chunk, -1 for one that founds a cluster; see :func:`_founders`."""
    n = int(points["rank"].max()) + 1 if len(points) else 0

    def placed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = pd.DataFrame({"id": ids, "at": np.arange(len(ids))}).merge(points, on="id")
        return found["at"].to_numpy(), found["rank"].to_numpy()

    known = []
    for a, b, near in zip(blocks["a"], blocks["b"], blocks["near"], strict=True):
        if near is None:
            found = pd.DataFrame({"id": a, "b": b}).merge(points, on="id").drop(columns="id").rename(columns={"b": "id"}).merge(points, on="id")
            low, high = found["rank_x"].to_numpy(), found["rank_y"].to_numpy()
            known.append((None, (None, low), (None, high)))
        else:
            known.append((np.frombuffer(near, np.uint8).reshape(len(a), -1), placed(a), placed(b)))
    of, open_ = np.full(n, -1, np.int64), np.zeros(n, bool)
    open_[points["rank"].to_numpy()] = True
    row_of = np.full(n, -1, np.int64)
    for first in range(0, n, TILE):
        turns = first + np.flatnonzero(open_[first : first + TILE])
        row_of[:] = -1
        row_of[turns] = np.arange(len(turns))
        beside = np.zeros((len(turns), n), bool)
        for bits, (at_a, low), (at_b, high) in known:
            if bits is None:
                for rows, columns in ((low, high), (high, low)):
                    here = row_of[rows] >= 0
                    beside[row_of[rows[here]], columns[here]] = True
                continue
            here = np.flatnonzero(row_of[low] >= 0)
            x, y = np.nonzero(np.unpackbits(bits[at_a[here]], axis=1)[:, at_b])
            beside[row_of[low[here[x]]], high[y]] = True
            here = np.flatnonzero(row_of[high] >= 0)
            columns = at_b[here]
            x, y = np.nonzero((bits[np.ix_(at_a, columns // 8)] >> (7 - columns % 8).astype(np.uint8)) & 1)
            beside[row_of[high[here[y]]], low[x]] = True
        for row, turn in zip(beside, turns.tolist(), strict=True):
            if not open_[turn]:
                continue
            if row[turn]:
                raise RuntimeError("clusters cannot be settled: a chunk holds similar rows with the same id")
            open_[turn] = False
            row &= open_
            of[row] = turn
            open_[row] = False
    return of


def _clusters(prints: DataFrame, chunk: str, item_id: str, order: str, cutoff: float) -> DataFrame:
    """``chunk, id, order, _words, _size, cluster, place, founder`` from stored prints."""
    floor = 1 - cutoff - 1e-9
    dealt = tiles(prints, [chunk], item_id, floor, shelves=True)
    near = stored(_near_blocks(dealt, chunk, item_id, floor, lambda s: (1 - s) <= cutoff), "near")
    counts = near.select("chunk", F.explode(F.arrays_zip(F.concat("a", "b").alias("id"), "n")).alias("_end"))
    degree = counts.groupBy("chunk", F.col("_end.id").alias("id")).agg(F.sum("_end.n").alias("n"))
    points = prints.select(F.col(chunk).alias("chunk"), F.col(item_id).alias("id"), F.col(order).alias("turn"))
    # a chunk is bounded, so a window over it is too
    visited = Window.partitionBy("chunk").orderBy(F.coalesce("n", F.lit(0)).desc(), "turn")
    ranked = stored(points.join(degree, ["chunk", "id"], "left").select("chunk", "id", "turn", F.row_number().over(visited).alias("rank")), "ranks")
    # a taken point belongs to the first founder beside it
    member = ranked.join(_founders(near, ranked), ["chunk", "rank"], "left").withColumn("of", F.coalesce("of", "rank"))
    whole = Window.partitionBy("chunk", "of")
    numbered = member.select(
        F.col("chunk").alias(chunk), F.col("id").alias(item_id),
        (F.dense_rank().over(Window.partitionBy("chunk").orderBy("of")) - 1).alias("cluster"),
        (F.row_number().over(whole.orderBy(F.col("rank") != F.col("of"), "turn")) - 1).alias("place"),
        F.max(F.when(F.col("rank") == F.col("of"), F.col("id"))).over(whole).alias("founder"),
        F.count(F.lit(1)).over(whole).alias("_members"),
    )
    return prints.join(numbered, [chunk, item_id])


def _mean_similarity(members: DataFrame, group: Sequence[str], item_id: str) -> DataFrame:
    """``group, id, mean``: mean similarity of every member to its group, itself included, to 12 decimals."""
    schema = T.StructType([*(members.schema[g] for g in group), members.schema[item_id], T.StructField("part", T.DoubleType())])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, ids, words in _shelf_pairs(pdf, item_id, 0.0):
            parts = [np.zeros(len(w)) for w in words]
            for at, s in _all_similarities(*words):
                parts[0][at] = s.sum(axis=1)
                parts[1] += s.sum(axis=0)
            out += [pd.DataFrame({item_id: i, "part": p}) for i, p in list(zip(ids, parts, strict=True))[: 1 if own else 2]]
        give_back()
        return pd.concat(out, ignore_index=True).assign(**{g: pdf[g].iloc[0] for g in group})[schema.names]

    dealt = tiles(members, group, item_id, 0.0, shelves=True)
    dealt = dealt.select(*group, "_left", "_right", "_shelf", "_tile", item_id, "_words")
    parts = dealt.groupBy(*group, "_left", "_right").applyInPandas(sums, schema)
    size = F.count(F.lit(1)).over(Window.partitionBy(*group))
    total = parts.groupBy(*group, item_id).agg(F.sum("part").alias("total"))
    return total.select(*group, item_id, F.round(F.col("total") / size, 12).alias("mean"))


def diverse_picks(members: DataFrame, group: Sequence[str], item_id: str, place: str = "place") -> DataFrame:
    """``group, id, pick``: up to five members per group, the most central first, then the farthest from all chosen.

    ``members`` has ``_words`` and ``_size`` (see :func:`packed`) and the member's ``place``, which settles ties; it is read three
    times.  A group of up to five is returned whole.  The picks of a larger one are made in one task: a group is bounded like a
    chunk, and each pick is one pass over its words.
    """
    group = list(group)
    counted = members.withColumn("_members", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    small = counted.filter(F.col("_members") <= MAX_PICKS).select(*group, item_id, F.col(place).cast("int").alias("pick"))
    large = counted.filter(F.col("_members") > MAX_PICKS).select(*group, item_id, place, "_words", "_size")
    mean = _mean_similarity(large, group, item_id)
    schema = T.StructType([*(members.schema[g] for g in group), members.schema[item_id], T.StructField("pick", T.IntegerType())])

    def pick(rows: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[item_id]).merge(means[[item_id, "mean"]], on=item_id).sort_values(place, kind="stable")
        chosen = []
        if len(rows):
            words, places_, score = _words(rows["_words"]), rows[place].to_numpy(), rows["mean"].to_numpy()
            gap, rest = np.ones(len(rows)), np.ones(len(rows), bool)
            while len(chosen) < MAX_PICKS and rest.any():
                # the first of equal ones has the least place
                last = int(np.argmax(np.where(rest, score, -1.0)))
                chosen.append(last)
                rest &= places_ != places_[last]
                both, either = (np.bitwise_count(w).sum(axis=1, dtype=np.int64) for w in (words & words[last], words | words[last]))
                gap = np.minimum(gap, 1 - np.divide(both, either, out=np.zeros(len(rows)), where=either > 0))
                score = gap
        return rows.iloc[chosen].assign(pick=np.arange(len(chosen), dtype=np.int32))[schema.names]

    picked = large.select(*group, item_id, place, "_words").groupBy(*group).cogroup(mean.groupBy(*group)).applyInPandas(pick, schema)
    return small.unionByName(picked)


def cluster_chunks(
    df: DataFrame, chunk: str, item_id: str, bits: str, cutoff: float, order: str | None = None, n_bits: int = N_BITS, picks: bool = True
) -> DataFrame:
    """Threshold clusters of each chunk: ``chunk, id, cluster, place, founder`` and, with ``picks``, ``pick``.

    Points are visited by the number of their neighbours, then by ``order`` (default: the id); a point that is free then
    founds a cluster of its free neighbours.  ``place`` 0 is the founder; ``pick`` numbers the diverse representatives, NULL
    for other members.
    """
    order = order or item_id
    prints = stored(packed(df, list(dict.fromkeys([chunk, item_id, order])), bits, n_bits), "prints")
    found = _clusters(prints, chunk, item_id, order, cutoff)
    columns = [chunk, item_id, "cluster", "place", "founder"]
    if not picks:
        return found.select(*columns)
    found = stored(found.select(*columns, "_words", "_size"), "clusters")
    chosen = diverse_picks(found, [chunk, "cluster"], item_id)
    return found.select(*columns).join(chosen, [chunk, "cluster", item_id], "left").select(*columns, "pick")


def two_stage(
    df: DataFrame, item_id: str, bits: str, order: str, chunk_size: int, item: str | None = None, n_bits: int = N_BITS
) -> DataFrame:
    """Diverse picks of loose clusters per chunk, then founders of tight clusters over those picks.

    Chunks are contiguous in ``order``; the picks are chunked again in the order the
    first stage gave them.  With ``item`` only the first row per item is kept.
    """
    if chunk_size > MAX_CHUNK:
        raise ValueError(f"chunks hold at most {MAX_CHUNK} items")

    def chunked(rows: DataFrame, by: str) -> DataFrame:
        return row_positions(rows, by, "_pos").withColumn("_chunk", F.floor(F.col("_pos") / chunk_size)).drop("_pos")

    # prints are read by both stages; the narrow copy keeps them from being computed again
    prints = stored(df.select(*dict.fromkeys([item_id, order, bits])), "prints")
    first = cluster_chunks(chunked(prints, order), "_chunk", item_id, bits, FIRST_CUTOFF, order, n_bits)
    # at most 10,000 clusters per chunk and 5 picks per cluster keep this order unique
    turn = (F.col("_chunk") * MAX_CHUNK + F.col("cluster")) * MAX_PICKS + F.col("pick")
    # the second chunking reads the picks several times
    picks = stored(first.filter(F.col("pick").isNotNull()).select(item_id, turn.alias("_turn")), "picks")
    second = cluster_chunks(
        chunked(prints.join(picks, item_id), "_turn"), "_chunk", item_id, bits, SECOND_CUTOFF, "_turn", n_bits, picks=False
    )
    final_turn = F.col("_chunk") * MAX_CHUNK + F.col("cluster")
    founders = second.filter(F.col("place") == 0).select(item_id, final_turn.alias("_turn"))
    out = df.join(founders, item_id)
    if item is not None:
        out = keep_first(out, [item], "_turn")
    return out.drop("_turn")


def _apart(query: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of ``query`` and ``train``; at most 65,535 bits."""
    if query.shape[1] == 1:
        return np.bitwise_count(query ^ train[:, 0])
    out = np.zeros((len(query), len(train)), np.uint16)
    for w in range(query.shape[1]):
        out += np.bitwise_count(query[:, w, None] ^ train[:, w])
    return out


def _nearest(query: np.ndarray, train: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``query`` the places in ``train`` (sorted by id) of its k nearest rows, ties by place, and their distances.

    ``train`` is walked a stretch at a time.  A row's k-th distance so far rules out all but a few of the next stretch, since a
    later place has to be nearer than that.  With a ``bound`` per row, places left empty by it have a distance above it.
    """
    n = len(train)
    k = min(k, n)
    head = min(n, max(k, NEAREST_STRETCH))
    step = max(1, NEAREST_WORDS // max(1, head))
    places, distances = [np.zeros((0, k), np.int64)], [np.zeros((0, k), np.int64)]
    for at in range(0, len(query), step):
        rows = query[at : at + step]
        # the place in id order breaks ties
        if bound is None:
            best = _apart(rows, train[:head]).astype(np.int64) * n + np.arange(head)
            best = np.sort(np.partition(best, k - 1, axis=1)[:, :k], axis=1)
        else:
            best = np.repeat((bound[at : at + step].astype(np.int64) + 1)[:, None] * n, k, axis=1)
        for start in range(head if bound is None else 0, n, head):
            apart = _apart(rows, train[start : start + head])
            row, place = np.divmod(np.flatnonzero(apart < (best[:, -1] // n).astype(apart.dtype)[:, None]), apart.shape[1])
            if not len(row):
                continue
            code = apart[row, place].astype(np.int64) * n + start + place
            number = np.bincount(row, minlength=len(rows))
            touched = np.flatnonzero(number)
            # rows with like numbers of new candidates are merged together, so no table is much wider than they need
            width = np.frexp(number[touched] - 0.5)[1]
            first = np.cumsum(number) - number
            for w in np.unique(width):
                some = touched[width == w]
                slots = np.arange(number[some].max())
                held = slots < number[some][:, None]
                added = np.where(held, code[np.where(held, first[some][:, None] + slots, 0)], np.iinfo(np.int64).max)
                best[some] = np.sort(np.concatenate([best[some], added], axis=1), axis=1)[:, :k]
        places.append(best % n)
        distances.append(best // n)
    return np.concatenate(places), np.concatenate(distances)


def _in_blocks(query: DataFrame, train: DataFrame, k: int, query_id: str, schema: T.StructType, n_bits: int) -> DataFrame:
    """k-lists over a training table that is cut into blocks of neighbouring sizes.

    Two prints are at least as far apart as their sizes.  A query first meets the block of its own size; its k-th distance
    there bounds how far the size of anything nearer can be, and only blocks within that bound are met in the second round, which
    lets through only what is within the bound.
    """
    placed = stored(places(train, [("_size", True), ("_tid", True)], "_place"), "nearest-train")
    blocked = placed.withColumn("_block", F.floor(F.col("_place") / TRAIN_BLOCK).cast("int")).drop("_place")
    # at most one row per size
    sizes = {r["_size"]: r for r in blocked.groupBy("_size").agg(F.min("_block").alias("low"), F.max("_block").alias("high")).collect()}
    if not sizes:
        return query.sparkSession.createDataFrame([], schema)
    least, most = min(sizes), max(sizes)
    first, last = {most: sizes[most]["low"]}, {least: sizes[least]["high"]}
    for s in range(most - 1, -1, -1):
        first[s] = sizes[s]["low"] if s in sizes else first[s + 1]
    for s in range(least + 1, n_bits + 1):
        last[s] = sizes[s]["high"] if s in sizes else last[s - 1]
    first_of = F.array(*[F.lit(first.get(s, first[most])) for s in range(n_bits + 1)])
    last_of = F.array(*[F.lit(last.get(s, last[least])) for s in range(n_bits + 1)])

    asking = query.count()
    groups = max(1, -(-asking // QUERY_GROUP))
    # the work of a group is in its pairs, not in its few bytes, so the number of tasks follows the rows
    tasks = max(1, -(-(asking + placed.count()) // TRAIN_BLOCK))
    asked = query.withColumn("_qg", F.pmod(F.xxhash64("_qid"), F.lit(groups)).cast("int"))
    held = blocked.withColumn("_tg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "_tg", "_block")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.names)
        right = right.sort_values("_tid", ignore_index=True)
        bound = left["_bound"].to_numpy() if "_bound" in left else None
        at, distance = _nearest(_words(left["_words"]), _words(right["_words"]), k, bound)
        found = {"_qid": np.repeat(left["_qid"].to_numpy(), at.shape[1]), "neighbour": right["_tid"].to_numpy()[at].ravel()}
        rows = pd.DataFrame(found | {"distance": distance.ravel(), "y": right["_y"].to_numpy(float)[at].ravel()}).set_axis(schema.names, axis=1)
        return rows if bound is None else rows[rows["distance"].to_numpy() <= np.repeat(bound, at.shape[1])]

    def round_of(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "_qg", "_block").groupBy("_qg", "_block").cogroup(held.groupBy("_tg", "_block")).applyInPandas(meet, schema)

    home = F.get(first_of, F.col("_size"))
    near = stored(round_of(asked.withColumn("_block", home)), "nearest-home")
    bound = near.groupBy(F.col(query_id).alias("_qid")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).cast("int").alias("_bound"))
    further = _further(asked.join(bound, "_qid", "left"), first_of, last_of, home, n_bits)
    return near.unionAll(round_of(further))


def _further(asked: DataFrame, first_of: Column, last_of: Column, home: Column, n_bits: int) -> DataFrame:
    """Queries once per block, other than their own, whose sizes do not rule it out; without a bound these are all."""
    bound = F.coalesce("_bound", F.lit(n_bits)).cast("int")
    low = F.get(first_of, F.greatest(F.col("_size") - bound, F.lit(0)))
    high = F.get(last_of, F.least(F.col("_size") + bound, F.lit(n_bits)))
    reach = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return asked.withColumn("_home", home).withColumn("_block", F.explode(reach)).filter(F.col("_block") != F.col("_home")).drop("_home").withColumn("_bound", bound)


def nearest(
    query: DataFrame, train: DataFrame, k: int, query_id: str, train_id: str, bits: str, y: str,
    n_bits: int = N_BITS, broadcast_rows: int = BROADCAST_TRAIN,
) -> DataFrame:
    """``query_id, neighbour, distance, y``: the k nearest training rows by Hamming distance, ties by id.

    A training table of checked size goes to every task as packed words and the query is never
    shuffled.  A larger one is cut into blocks of neighbouring sizes that a query meets only within the bound of its
    first k-list, and the k-lists of the blocks are merged.
    """
    prints_t = packed(train.select(F.col(train_id).alias("_tid"), F.col(y).cast("double").alias("_y"), F.col(bits).alias("_bits")), ["_tid", "_y"], "_bits", n_bits)
    schema = T.StructType(
        [
            query.schema[query_id],
            T.StructField("neighbour", train.schema[train_id].dataType),
            T.StructField("distance", T.LongType()),
            T.StructField("y", T.DoubleType()),
        ]
    )
    if train.count() <= broadcast_rows:
        held = prints_t.toPandas().sort_values("_tid", ignore_index=True)
        words = _words(held["_words"]) if len(held) else np.zeros((0, 1), np.uint64)
        table = train.sparkSession.sparkContext.broadcast((held["_tid"].to_numpy(), words, held["_y"].to_numpy(float)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, words, labels = table.value
            for batch in batches:
                if len(batch) and len(ids):
                    at, distance = _nearest(_words(batch["_words"]), words, k)
                    found = {"q": np.repeat(batch["_qid"].to_numpy(), at.shape[1]), "neighbour": ids[at].ravel()}
                    yield pd.DataFrame(found | {"distance": distance.ravel(), "y": labels[at].ravel()}).set_axis(schema.names, axis=1)

        asked = packed(query.select(F.col(query_id).alias("_qid"), F.col(bits).alias("_bits")), ["_qid"], "_bits", n_bits)
        return asked.mapInPandas(scan, schema)

    # both rounds read the queries
    asked = stored(packed(query.select(F.col(query_id).alias("_qid"), F.col(bits).alias("_bits")), ["_qid"], "_bits", n_bits), "nearest-queries")
    lists = _in_blocks(asked, prints_t, k, query_id, schema, n_bits)
    # at most k rows per block and query
    merged = lists.groupBy(query_id).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour", "y"))), 1, k).alias("_n")
    )
    return merged.select(query_id, F.explode("_n").alias("_n")).select(
        query_id, "_n.neighbour", "_n.distance", "_n.y"
    )


def neighbour_mean(neighbours: DataFrame, query_id: str, weights: str = "uniform") -> DataFrame:
    """Prediction per query row: plain mean, or weights 1/distance where exact matches win alone."""
    def mean(values: Column) -> Column:
        return F.avg(values)

    if weights == "uniform":
        return neighbours.groupBy(query_id).agg(mean(F.col("y")).alias("prediction"))
    if weights != "distance":
        raise ValueError(f"unknown weights {weights!r}")
    exact = F.avg(F.when(F.col("distance") == 0, F.col("y")))
    inverse = F.when(F.col("distance") > 0, 1.0 / F.nullif(F.col("distance"), F.lit(0)))
    weighted = F.try_divide(F.sum(F.col("y") * inverse), F.sum(inverse))
    return neighbours.groupBy(query_id).agg(F.coalesce(exact, weighted).alias("prediction"))
