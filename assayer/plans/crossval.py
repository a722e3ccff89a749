"""Cross-validation without refits: ridge from sums of products, nearest neighbours from one list per row.

One pass over the rows gives, per fold, the number of rows and the sums and products of features and label.  Every training
set of a cross-validation is a sum of folds, so all penalties and all sizes of a learning curve follow from these sums; the
number of Spark jobs does not depend on the number of trials.  For nearest neighbours one list at the largest ``k`` serves
every smaller ``k`` and both weightings.
"""

from __future__ import annotations

import json
import random
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.bits import N_BITS
from assayer.operators.sampling import hash_positions, kfold
from assayer.operators.similarity import nearest
from assayer.operators.stats import fit_metrics
from assayer.session import stored

#: The driver holds a square of so many features per fold at most; rows of one dense block in a task, rows of one task.
MOST_FEATURES, BLOCK_ROWS, TASK_ROWS = 4096, 1024, 100_000
TRIALS = "trial int, params string, train_mse double, val_mse double, train_r2 double, val_r2 double"
MOMENTS = "n double, sy double, syy double, sx array<double>, sxy array<double>, gram binary"


@dataclass
class Moments:
    """Sums over rows: their number, label, squared label, features, features times label, and products of features."""

    n: float
    sy: float
    syy: float
    sx: np.ndarray
    sxy: np.ndarray
    gram: np.ndarray

    @staticmethod
    def none(size: int) -> Moments:
        return Moments(0.0, 0.0, 0.0, np.zeros(size), np.zeros(size), np.zeros((size, size)))

    def plus(self, other: Moments, sign: float = 1.0) -> Moments:
        return Moments(*(getattr(self, f) + sign * getattr(other, f) for f in self.__dataclass_fields__))

    def minus(self, other: Moments) -> Moments:
        return self.plus(other, -1.0)

    def ridge(self, alphas: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Weights (one column per penalty) and intercepts; the intercept is not penalised."""
        centred = self.gram - np.outer(self.sx, self.sx) / self.n
        values, axes = np.linalg.eigh(centred)
        turned = axes.T @ (self.sxy - self.sx * self.sy / self.n)
        weights = axes @ (turned[:, None] / (np.maximum(values, 0.0)[:, None] + np.asarray(alphas)[None, :]))
        return weights, self.sy / self.n - weights.T @ self.sx / self.n

    def metrics(self, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean squared error and R2 (NaN for a flat label) of each column of ``weights`` on these rows."""
        error = (
            self.syy - 2 * weights.T @ self.sxy - 2 * intercepts * self.sy + (weights * (self.gram @ weights)).sum(axis=0)
            + 2 * intercepts * (weights.T @ self.sx) + self.n * intercepts**2
        )
        spread = self.syy - self.sy**2 / self.n
        return error / self.n, 1 - error / spread if spread > 0 else np.full(len(error), np.nan)


def _dense(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Feature vectors, sparse or dense, as rows of a matrix."""
    vectors = batch.column("vector")
    dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
    out = np.zeros((batch.num_rows, size))
    values, indices = vectors.field("values"), vectors.field("indices")
    lengths = values.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(dense)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    column[~dense[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    out[row, column] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def moments(data: DataFrame, by: Sequence[str], size: int, features: str = "features", label: str = "y") -> dict[tuple, Moments]:
    """The sums per key of ``by`` (integers) in one pass; tasks add up their rows, then the tasks of a key are added up."""
    if size > MOST_FEATURES:
        raise ValueError(f"{size} features; at most {MOST_FEATURES} are held as a square")
    by = list(by)
    keys = ", ".join(f"{b} int" for b in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, y = _dense(part, size), part.column("label").to_numpy(zero_copy_only=False)
                key = np.stack([part.column(b).to_numpy(zero_copy_only=False) for b in by], axis=1)
                for k in np.unique(key, axis=0):
                    a, b = x[(key == k).all(axis=1)], y[(key == k).all(axis=1)]
                    sums = Moments(float(len(b)), b.sum(), (b * b).sum(), a.sum(axis=0), a.T @ b, a.T @ a)
                    held[tuple(k.tolist())] = held.get(tuple(k.tolist()), Moments.none(size)).plus(sums)
        for k, m in held.items():
            yield pa.RecordBatch.from_pylist(
                [dict(zip(by, k)) | {"n": m.n, "sy": m.sy, "syy": m.syy, "sx": m.sx.tolist(), "sxy": m.sxy.tolist(), "gram": m.gram.tobytes()}],
                pa.schema(
                    [(b, pa.int32()) for b in by] + [(c, pa.float64()) for c in ("n", "sy", "syy")]
                    + [(c, pa.list_(pa.float64())) for c in ("sx", "sxy")] + [("gram", pa.binary())]
                ),
            )

    def one(row) -> Moments:
        return Moments(row.n, row.sy, row.syy, np.asarray(row.sx, float), np.asarray(row.sxy, float), np.frombuffer(row.gram).reshape(size, size))

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        out = Moments.none(size)
        for row in pdf.itertuples():
            out = out.plus(one(row))
        sums = {"n": out.n, "sy": out.sy, "syy": out.syy, "sx": out.sx, "sxy": out.sxy, "gram": out.gram.tobytes()}
        return pd.DataFrame([{b: pdf[b].iloc[0] for b in by} | sums])

    rows = data.select(*[F.col(b).cast("int").alias(b) for b in by], F.unwrap_udt(features).alias("vector"), F.col(label).cast("double").alias("label"))
    # a task emits a square per key, so tasks are as few as the rows allow
    tasks = max(1, -(-data.count() // TASK_ROWS))
    parts = rows.filter("label IS NOT NULL").repartition(tasks).mapInArrow(run, f"{keys}, {MOMENTS}")
    found = parts.groupBy(*by).applyInPandas(added, f"{keys}, {MOMENTS}").collect()
    return {tuple(r[b] for b in by): one(r) for r in found}


def _total(parts: Sequence[Moments], size: int) -> Moments:
    out = Moments.none(size)
    for m in parts:
        out = out.plus(m)
    return out


def _size(data: DataFrame, features: str) -> int:
    first = data.select(F.unwrap_udt(features).alias("v")).select(F.coalesce("v.size", F.size("v.values")).alias("s")).first()
    return first.s if first else 0


# fixed value: fewer rows than this are called very few
VERY_FEW_ROWS = 50


def few_rows_warning(n: int, n_features: int) -> None:
    """Warn where a linear fit has fewer rows than features, or very few rows at all."""
    if n < n_features:
        warnings.warn(f"{n} rows for {n_features} features: a weak penalty fits them exactly, so only held-out errors mean anything", stacklevel=3)
    if n < VERY_FEW_ROWS:
        warnings.warn(f"only {n} rows: score more items before trusting any model", stacklevel=3)


def ridge_folds(train: DataFrame, ids: Sequence[str], n_folds: int, seed: int, features: str, label: str) -> tuple[dict[int, Moments], int]:
    folded = kfold(train, ids, n_folds, seed)
    size = _size(train, features)
    return {k[0]: m for k, m in moments(folded, ["fold"], size, features, label).items()}, size


def search_ridge(
    train: DataFrame, ids: Sequence[str], draw: Callable[[random.Random], dict], n_trials: int = 50, n_folds: int = 5,
    seed: int = 42, features: str = "features", label: str = "y",
) -> DataFrame:
    """Seeded random search over penalties: ``trial, params, train_mse, val_mse, train_r2, val_r2``, averaged over the folds.

    The same draws, folds and metrics as a search that fits every trial; a fold without rows is left out.
    """
    folds, size = ridge_folds(train, ids, n_folds, seed, features, label)
    r = random.Random(seed)
    drawn = [draw(r) for _ in range(n_trials)]
    total = _total(list(folds.values()), size)
    rows = []
    for held in folds.values():
        rest = total.minus(held)
        if rest.n and held.n:
            fit = rest.ridge([d["alpha"] for d in drawn])
            rows.append(np.stack([*rest.metrics(*fit), *held.metrics(*fit)]))
    if not rows:
        raise ValueError(f"{total.n:g} rows are too few for {n_folds} folds")
    train_mse, train_r2, val_mse, val_r2 = np.mean(rows, axis=0)
    few_rows_warning(int(total.n), size)
    table = [(t, json.dumps(d), *map(float, m)) for t, (d, m) in enumerate(zip(drawn, zip(train_mse, val_mse, train_r2, val_r2)))]
    return train.sparkSession.createDataFrame(table, TRIALS)


def ridge_curve(
    train: DataFrame, ids: Sequence[str], alpha: float, n_folds: int = 5, shares: Sequence[float] = tuple(i / 10 for i in range(1, 11)),
    seed: int = 42, features: str = "features", label: str = "y",
) -> DataFrame:
    """``share, fold, n_rows, train_mse, val_mse``: a learning curve over nested parts of each training fold.

    Each row belongs to the smallest share whose part of its fold holds it, so a part is the sum of all slices up to its share.
    """
    spark = train.sparkSession
    shares = sorted(shares)
    placed = hash_positions(kfold(train, ids, n_folds, seed), ids, f"{seed}/curve", "_p", by=["fold"])
    slice_of = F.lit(len(shares))
    for k in range(len(shares) - 1, -1, -1):
        slice_of = F.when(F.col("_p") < F.floor(F.col("_p_of") * F.lit(float(shares[k]))), k).otherwise(slice_of)
    data = stored(placed.withColumn("slice", slice_of), "curve")
    size = _size(train, features)
    folds = {k[0]: m for k, m in moments(data, ["fold"], size, features, label).items()}
    so_far, rows = {f: Moments.none(size) for f in folds}, []
    for k, share in enumerate(shares):  # one slice of every fold at a time
        for (f,), m in moments(data.filter(F.col("slice") == k), ["fold"], size, features, label).items():
            so_far[f] = so_far[f].plus(m)
        total = _total(list(so_far.values()), size)
        for f, held in folds.items():
            part = total.minus(so_far[f])
            if part.n:
                fit = part.ridge([alpha])
                rows.append((float(share), f, int(part.n), float(part.metrics(*fit)[0][0]), float(held.metrics(*fit)[0][0])))
    return spark.createDataFrame(rows, "share double, fold int, n_rows long, train_mse double, val_mse double")


def knn_grid(
    train: DataFrame, row_id: str, bits: str, label: str, n_folds: int = 5, most: int = 50, seed: int = 42, n_bits: int = N_BITS
) -> DataFrame:
    """``k, weights, val_mse, val_r2``, averaged over the folds, for every ``k`` up to ``most`` and both weightings.

    One list of the ``most`` nearest rows of the other folds per row; running sums along it give every prediction.
    """
    data = stored(kfold(train.select(row_id, bits, F.col(label).cast("double").alias("y")), [row_id], n_folds, seed), "knn-folds")
    counts = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    largest = min(most, sum(counts.values()) - max(counts.values(), default=0))
    if len(counts) < 2 or largest < 1:
        raise ValueError("too few rows for neighbours from other folds")
    lists = None
    for f in counts:
        found = nearest(data.filter(F.col("fold") == f).select(row_id, bits), data.filter(F.col("fold") != f), largest, row_id, row_id, bits, "y", n_bits)
        found = found.withColumn("fold", F.lit(f))
        lists = found if lists is None else lists.unionAll(found)
    along = Window.partitionBy("fold", row_id).orderBy("distance", "neighbour")
    same = F.col("distance") == 0
    near = F.when(~same, 1.0 / F.nullif(F.col("distance"), F.lit(0)))
    walked = lists.select(
        "fold", row_id, F.row_number().over(along).alias("k"), F.avg("y").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("uniform"),
        F.avg(F.when(same, F.col("y"))).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_exact"),
        F.try_divide(
            F.sum(F.col("y") * near).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.sum(near).over(along.rowsBetween(Window.unboundedPreceding, 0))
        ).alias("_inverse"),
    )
    both = F.explode(F.array(
        F.struct(F.lit("uniform").alias("weights"), F.col("uniform").alias("prediction")),
        F.struct(F.lit("distance").alias("weights"), F.coalesce("_exact", "_inverse").alias("prediction")),
    ))
    scored = walked.select("fold", row_id, "k", both.alias("_b")).select("fold", row_id, "k", "_b.*").join(data.select("fold", row_id, "y"), ["fold", row_id])
    folds = fit_metrics(scored, "y", "prediction", ["k", "weights", "fold"])
    return folds.groupBy("k", "weights").agg(F.avg("mse").alias("val_mse"), F.avg("r2").alias("val_r2"))


def search_knn(grid: DataFrame, n_trials: int = 50, seed: int = 42) -> DataFrame:
    """``trial, params, val_mse, val_r2``: seeded draws from a :func:`knn_grid`, whose bounded rows answer each of them."""
    known = {(r.k, r.weights): r for r in grid.collect()}
    r = random.Random(seed)
    most = max(k for k, _ in known)
    drawn = [(r.randint(1, most), r.choice(["uniform", "distance"])) for _ in range(n_trials)]
    rows = [(t, json.dumps({"k": k, "weights": w}), known[k, w].val_mse, known[k, w].val_r2) for t, (k, w) in enumerate(drawn)]
    return grid.sparkSession.createDataFrame(rows, "trial int, params string, val_mse double, val_r2 double")


def patient_stop(errors: Sequence[float], patience: int) -> int:
    """How many rounds to keep: up to the least error seen when ``patience`` rounds in a row have not improved on it."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1
