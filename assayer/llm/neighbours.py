"""Approximate nearest neighbours with an inverted multi-index.

The two halves of the vectors are quantised separately (k-means on a bounded sample); a cell is a pair of centroids.
For each query a heap walks the centroid pairs by the sum of their squared distances until the cells met hold enough
vectors; those are reranked by the exact distance on the original vectors.  How many are enough is the share of the
rows at which queries of the sample find ``RECALL`` of their true neighbours there: small for clustered vectors,
large for vectors without structure.

Of equal vectors only the ``k + 1`` smallest ids can ever be among the nearest ``k``, so the index keeps those: this
loses no answer and splits any group of copies.  Neighbouring cells form blocks of about ``CHUNK`` vectors, a larger cell
is dealt over several blocks, and a query goes once to each block that it visits, with the cells it wants there.

Null or zero vectors, vectors with a null or non-finite component, vectors of another length than most, and rows with
a null id take no part.  A row never finds a row of its own id; repeated rows count once.  Ties go to the smaller id.
With fewer than ``k`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.llm.shingles import mix
from assayer.session import stored

#: Rows that the codebooks are fitted on; the index holds every row.
SAMPLE_ROWS = 20_000
#: Vectors per cell aimed at, and the most centroids per half (so at most 2**20 cells).
CELL_ROWS, MOST_CENTROIDS = 16, 1024
#: What share of the true neighbours the walk shall find, and the least number of vectors it meets.
RECALL, LEAST_CANDIDATES, PROBES = 0.95, 1000, 200
CHUNK = 4096
ROUNDS = 15


def kmeans(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = points.astype(np.float64)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest_centre(points, centres)
        counts = np.bincount(near, minlength=k)
        for d in range(points.shape[1]):
            sums = np.bincount(near, weights=points[:, d], minlength=k)
            centres[:, d] = np.where(counts > 0, sums / np.maximum(counts, 1), centres[:, d])
    return centres


def square_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None]


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate(
        [square_distances(points[i : i + 8192], centres).argmin(axis=1) for i in range(0, len(points), 8192)] or [np.zeros(0, np.int64)]
    )


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells by rising summed distance until they hold ``enough`` vectors."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b, k = first[rows].tolist(), second[columns].tolist(), len(second)
    heap, cells, held, total = [(a[0] + b[0], 0, 0)], [], 0, int(counts.sum())
    while heap and held < min(enough, total):
        _, i, j = heapq.heappop(heap)
        cell = int(rows[i]) * k + int(columns[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return cells


def enough_share(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int) -> float:
    """The share of the rows that queries of the sample must meet for ``RECALL``."""
    half, size, probes = len(books[0][0]), len(sample), sample[:PROBES]
    a, b = nearest_centre(sample[:, :half], books[0]), nearest_centre(sample[:, half:], books[1])
    found = []
    for at in range(0, len(probes), 20):
        part = probes[at : at + 20]
        summed = square_distances(part[:, :half], books[0])[:, a] + square_distances(part[:, half:], books[1])[:, b]
        place = np.empty_like(summed, dtype=np.int64)
        np.put_along_axis(place, summed.argsort(axis=1, kind="stable"), np.arange(size)[None], axis=1)
        true = square_distances(part, sample).argsort(axis=1, kind="stable")[:, : k + 1]
        found.append(np.take_along_axis(place, true, axis=1).ravel())
    met = np.sort(np.concatenate(found))
    return float(met[min(len(met) - 1, int(np.ceil(RECALL * len(met))))] + 1) / size


def blocks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of every cell and over how many blocks it is dealt."""
    parts = np.maximum(1, -(-counts // CHUNK))
    large = parts > 1
    # small cells fill blocks one after the other; each large cell has blocks of its own behind them
    small = np.cumsum(np.where(large, 0, counts)) // CHUNK
    first = np.where(large, int(small[-1]) + 1 + np.cumsum(np.where(large, parts, 0)) - parts, small)
    return first.astype(np.int64), parts.astype(np.int64)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)


def search(vectors: DataFrame, query_every: int = 100, k: int = 10, candidates: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose id is divisible by ``query_every``.

    ``candidates``: vectors that a query meets before it stops; by default calibrated on the sample.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = int(sizes["size"])
    rows = rows.filter(F.size("embedding") == size)
    by_id = F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))
    kept = rows.withColumn("place", by_id).filter(F.col("place") <= k + 1).drop("place")

    half, n = max(1, size // 2), int(sizes["count"])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").collect()
    sample = np.array([r["embedding"] for r in picked])
    centroids = int(min(MOST_CENTROIDS, len(sample), max(4, round((n / CELL_ROWS) ** 0.5))))
    books = kmeans(sample[:, :half], centroids, 1), kmeans(sample[:, half:], centroids, 2)
    if candidates is None:
        candidates = max(LEAST_CANDIDATES, int(np.ceil(enough_share(sample, books, k) * n)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"), size)
                cell = nearest_centre(x[:, :half], books[0]) * centroids + nearest_centre(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], ["cell", "vec_id", "embedding"])

    index = stored(kept.mapInArrow(assign, "cell long, vec_id long, embedding array<double>"), "multi-index")
    # one number per cell, at most 2**20 of them
    counts = np.zeros(centroids * centroids, np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    first_block, parts = blocks_of(counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "vec_id"))
            dealt = first_block[cell] + (mix(ids.view(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(dealt), *batch.columns], ["block", "cell", "vec_id", "embedding"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), size)
            for i, query_id in enumerate(batch.column("vec_id").to_pylist()):
                near = square_distances(x[i : i + 1, :half], books[0])[0], square_distances(x[i : i + 1, half:], books[1])[0]
                cells = np.sort(np.array(visit(*near, counts, candidates + 1), np.int64))
                times = parts[cells]
                block = np.repeat(first_block[cells] - np.cumsum(times) + times, times) + np.arange(times.sum())
                wanted = np.repeat(cells, times)
                order = np.argsort(block, kind="stable")
                block, wanted = block[order], wanted[order]
                visited, starts = np.unique(block, return_index=True)
                ends = pa.array(np.append(starts, len(block)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(visited), pa.array(np.full(len(visited), query_id)),
                        batch.column("embedding").take(pa.array(np.full(len(visited), i))),
                        pa.ListArray.from_arrays(ends, pa.array(wanted)),
                    ],
                    ["block", "query_id", "query", "cells"],
                )

    queries = rows.filter(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"])
    asked = queries.mapInArrow(walk, "block long, query_id long, query array<double>, cells array<long>")
    held = index.mapInArrow(place, "block long, cell long, vec_id long, embedding array<double>")

    def rerank(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(there) and len(here):
            here = here.sort_values("cell", kind="stable")
            x, ids, cell = np.stack(here["embedding"].to_list()), here["vec_id"].to_numpy(), here["cell"].to_numpy()
            for query_id, query, cells in zip(there["query_id"], there["query"], there["cells"]):
                met = np.flatnonzero(np.isin(cell, cells) & (ids != query_id))
                score = np.sqrt(((x[met] - np.asarray(query)) ** 2).sum(axis=1))
                best = np.lexsort((ids[met], score))[:k]
                found.append((np.full(len(best), query_id), ids[met][best], score[best]))
        return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("query_id", "vec_id", "score"), zip(*found))})

    near = asked.groupBy("block").cogroup(held.groupBy("block"))
    near = near.applyInPandas(rerank, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
