"""Whitening of embeddings by a block Jacobi-Davidson method that never forms the covariance matrix.

Every entry c of a vector becomes the whole number ``floor(1024 * c) + 100000``.  The covariance V of these is met only
through products V q, one distributed pass over the stored numbers each: a task centres its vectors (exactly, as
``n * x - sum``, before anything is multiplied), and its partial product is added up by Spark.  The driver holds a few
dozen columns as long as one vector:

1. Rayleigh-Ritz in the search space gives the leading Ritz pairs; those whose residual has reached double precision,
   from the largest on, are locked.
2. For the others the correction equation, projected off the locked and the current Ritz vectors, is solved by MINRES.
   All its columns share one pass per step.
3. The corrections, made orthogonal, widen the search space; a space that is too wide starts anew from its best vectors.

Rows whose vector is null, empty or holds null or non-finite entries take no part; repeated rows count each time and a
null ``vec_id`` stays null.  Components without variance cannot be scaled to one and are left out, so a table of equal
vectors or of one vector gives no rows, like an empty one.  Vectors of different lengths, and entries beyond 2**42, are an
error.  Lost executors cost a pass over the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import stored

# fixed values: scale and shift of an entry
SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: A residual of this share of the largest eigenvalue, per root of the length, is double precision.
PRECISION = 16 * np.finfo(float).eps
#: Steps of MINRES per correction, corrections at most, bytes of one stored block.
INNER, OUTER, BLOCK_BYTES = 3, 300, 4 << 20
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


class Fit:
    """The vectors as whole numbers in blocks, with their count, length and exact sums."""

    def __init__(self, vectors: DataFrame) -> None:
        rows = usable(vectors)
        shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        self.n, self.size = int(shape["n"]), int(shape["high"] or 0)
        if self.n and shape["low"] != shape["high"]:
            raise ValueError(f"vectors have between {shape['low']} and {shape['high']} entries")
        if not self.n:
            return
        size = self.size

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, BLOCK_BYTES // (8 * size))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    scaled = np.floor(SCALE * part.column("vector").flatten().to_numpy()).reshape(-1, size)
                    if np.abs(scaled).max() >= 2.0**52:
                        raise OverflowError("an entry is too large to become an exact whole number")
                    x = scaled.astype(np.int64) + SHIFT
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays([0, part.num_rows], part.column("vec_id")), pa.array([x.tobytes()], pa.binary()), pa.array([x.sum(axis=0)])],
                        ["ids", "x", "sums"],
                    )

        self.blocks = stored(rows.mapInArrow(pack, "ids array<long>, x binary, sums array<long>"), "whitening-blocks")
        totals = self.blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        self.sums = np.zeros(size, np.int64)
        for r in totals:
            self.sums[r["pos"]] = r["s"]

    def deviations(self) -> Callable[[bytes], np.ndarray]:
        """From a block's bytes to the exact ``n * x - sums``, as a function that tasks can carry."""
        n, size, sums = self.n, self.size, self.sums

        def exact(block: bytes) -> np.ndarray:
            x = np.frombuffer(block, np.int64).reshape(-1, size)
            if np.abs(x).max() > (1 << 62) // n:
                raise OverflowError("entries times rows do not fit into 64 bits")
            return n * x - sums

        return exact

    def total(self, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all rows of ``partial``, which maps centred rows to an array of this shape; one pass.

        Tasks add up their blocks, Spark the tasks; only the sum comes back.
        """
        exact, n = self.deviations(), self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shape)
            for batch in batches:
                for block in batch.column("x"):
                    held += partial(exact(block.as_py()) / n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size)), pa.array(held.ravel())], ["place", "part"])

        parts = self.blocks.select("x").mapInArrow(run, "place long, part double")
        out = np.zeros(int(np.prod(shape)))
        for r in parts.groupBy("place").agg(F.sum("part").alias("part")).collect():
            out[r["place"]] = r["part"]
        return out.reshape(shape)

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q for the columns of ``q``."""
        return self.total(lambda c: c.T @ (c @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda c: np.array([(c * c).sum()]), (1,))[0]) / self.n


def orthonormal(fresh: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``fresh`` add to the ``bases``."""
    lengths = np.linalg.norm(fresh, axis=0)
    fresh = fresh[:, lengths > 0] / lengths[lengths > 0]
    for _ in range(2):  # twice is enough
        for basis in bases:
            fresh = fresh - basis @ (basis.T @ fresh)
    left, weights, _ = np.linalg.svd(fresh, full_matrices=False)
    out = left[:, weights > 1e-10]
    for basis in bases:
        out = out - basis @ (basis.T @ out)
    return np.linalg.qr(out)[0]


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column; ``apply`` multiplies every column by its own matrix."""
    beta = np.linalg.norm(b, axis=0)
    start, left = beta.copy(), beta.copy()
    v = np.divide(b, beta, out=np.zeros_like(b), where=beta > 0)
    v_old, w_old, w, x = (np.zeros_like(b) for _ in range(4))
    beta = np.zeros_like(beta)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        if (np.abs(left) <= tolerance * start).all():
            break
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        av = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(av, axis=0)
        delta = c * alpha - c_old * s * beta
        r1, r2, r3 = np.hypot(delta, beta_new), s * alpha + c_old * c * beta, s_old * beta
        solid = r1 > 0
        c_old, s_old = c, s
        c = np.divide(delta, r1, out=np.zeros_like(r1), where=solid)
        s = np.divide(beta_new, r1, out=np.zeros_like(r1), where=solid)
        w_old, w = w, np.divide(v - r3 * w_old - r2 * w, r1, out=np.zeros_like(v), where=solid)
        x = x + c * left * w
        left = -s * left
        v_old, v = v, np.divide(av, beta_new, out=np.zeros_like(av), where=beta_new > 0)
        beta = beta_new
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix and their unit vectors (columns), known by its products alone."""
    wanted = min(wanted, size)
    precision, narrow, wide = PRECISION * max(1.0, size**0.5), 2 * wanted, 10 * wanted
    locked, values = np.zeros((size, 0)), np.zeros(0)
    space = orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, narrow))))
    image = product(space)
    for _ in range(OUTER):
        heights, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        heights, turn = heights[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max(heights[0] if len(heights) else 0.0, values.max(initial=0.0))
        aimed = min(wanted - len(values), space.shape[1])
        ritz, residual = space[:, :aimed], image[:, :aimed] - space[:, :aimed] * heights[:aimed]
        residual = residual - locked @ (locked.T @ residual)
        open_ = np.linalg.norm(residual, axis=0) > precision * scale
        done = int(np.argmax(open_)) if open_.any() else aimed
        if done:
            locked = np.hstack([locked, ritz[:, :done]])
            values = np.append(values, heights[:done])
            space, image, heights = space[:, done:], image[:, done:], heights[done:]
            ritz, residual = ritz[:, done:], residual[:, done:]
        if len(values) == wanted:
            # one more Rayleigh-Ritz on a fresh product, which also proves the residuals
            locked = orthonormal(locked)
            image = product(locked)
            values, turn = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            locked, image = locked @ turn, image @ turn
            worst = np.linalg.norm(image - locked * values, axis=0).max()
            if worst > 8 * precision * max(values[0], 0.0):
                raise RuntimeError(f"a residual of {worst} is left")
            return values, locked
        if space.shape[1] > wide - wanted:
            space, image = space[:, :narrow], image[:, :narrow]
        off = np.hstack([locked, ritz])
        shifts = heights[: ritz.shape[1]]

        def project(t: np.ndarray) -> np.ndarray:
            return t - off @ (off.T @ t)

        fresh = minres(lambda t: project(product(t) - t * shifts), -project(residual), INNER, 1e-3)
        fresh = orthonormal(np.hstack([fresh, residual]) if not fresh.any() else fresh, locked, space)
        if not fresh.shape[1]:
            fresh = orthonormal(np.random.default_rng(seed + 1).standard_normal((size, aimed)), locked, space)
        space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
    raise RuntimeError(f"{wanted - len(values)} components have not converged")


def square_sums(deviation: np.ndarray) -> pa.Array:
    """Exact sums of squares per row, as decimals."""
    if (np.abs(deviation).max().astype(float) ** 2) * deviation.shape[1] < 2.0**62:
        return pa.array((deviation * deviation).sum(axis=1)).cast(pa.decimal128(38, 0))
    whole = deviation.astype(object)
    return pa.array([int(s) for s in (whole * whole).sum(axis=1)], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the exact sum of ``(n * x - sums) ** 2`` over the entries.
    """
    fit = Fit(vectors)
    spark = vectors.sparkSession
    if not fit.n:
        return spark.createDataFrame([], SCHEMA)
    values, axes = leading(fit.product, fit.size, components)
    some = values > max(values[0], 0.0) * 64 * fit.size * np.finfo(float).eps
    values, axes = values[some], axes[:, some]
    m = len(values)
    if not m:
        return spark.createDataFrame([], SCHEMA)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(m)])
    scaled = axes / np.sqrt(values)
    explained = values / fit.trace()
    mean = fit.total(lambda c: (c @ scaled).sum(axis=0), (m,)) / fit.n
    covariance = fit.total(lambda c: (w := c @ scaled - mean).T @ w, (m, m)) / fit.n
    error = float(np.abs(covariance - np.eye(m)).max())
    exact, n = fit.deviations(), fit.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in zip(batch.column("ids"), batch.column("x")):
                deviation = exact(block.as_py())
                rows, each = len(deviation), pa.array(np.repeat(np.arange(len(deviation)), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * m, n)), square_sums(deviation).take(each),
                        pa.array((deviation / n @ scaled).ravel()), pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * m, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return fit.blocks.select("ids", "x").mapInArrow(run, SCHEMA)
