"""Probes fitted for every fold and every parameter value in the same passes over the data.

One model per (fold, grid point) is fitted, and all of them advance together: a step is one job that reads the stored
training rows once and returns, per model, sums over its rows. A task adds up a batch with matrix products and sends
one row per fold, lots of tasks are added up in a second stage, so the driver reads a number of rows that depends on
folds and lots alone. The number of jobs is that of the steps, whatever the number of folds and grid points.

What the driver and every task hold is models x features^2 numbers for the linear probe (curvature), models x weights
for the network; neither grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions.arrays import doubles
from sensorframe.operators.vectors import as_arrays, dimension_stats

#: Lots that the tasks of a step are dealt to; each lot is added up in one place.
LOTS = 32


@dataclass
class FoldFacts:
    """What training rows of a fold tell before any step: scale of each feature and balanced class weights."""

    folds: list
    mean: np.ndarray
    std: np.ndarray
    n_0: np.ndarray
    n_1: np.ndarray

    def weights(self) -> np.ndarray:
        """Per fold the weight of a row of class 0 and 1, n / (2 n_c); an absent class counts as one row."""
        n = self.n_0 + self.n_1
        return np.stack([n / (2.0 * np.maximum(self.n_0, 1)), n / (2.0 * np.maximum(self.n_1, 1))], axis=1)


@dataclass
class LinearFits:
    """Fitted linear probes: ``weight`` and ``intercept`` act on features scaled by their fold's mean and std."""

    facts: FoldFacts
    grid: list[float]
    weight: np.ndarray
    intercept: np.ndarray
    loss: np.ndarray
    converged: np.ndarray
    steps: int


def fold_facts(train: DataFrame, fold: str, features: str, label: str, eps: float = 1e-4) -> FoldFacts:
    """One grouped pass each for moments and class counts; one row per fold comes to the driver."""
    scale = {r[fold]: (r["mean"], r["std"]) for r in as_arrays(dimension_stats(train, [fold], features, eps), [fold]).collect()}
    sizes = train.groupBy(fold).agg(F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1"))
    sizes = {r[fold]: (r["n_0"], r["n_1"]) for r in sizes.collect()}
    folds = sorted(scale)
    mean, std = (np.array([scale[k][i] for k in folds], float) for i in (0, 1))
    n_0, n_1 = (np.array([sizes[k][i] for k in folds], float) for i in (0, 1))
    return FoldFacts(folds, mean, std, n_0, n_1)


def _summed(train: DataFrame, facts: FoldFacts, width: int, add: Callable) -> np.ndarray:
    """Per fold the sum of ``add(fold number, features, labels)`` over all batches of its rows: one job."""
    number = {k: i for i, k in enumerate(facts.folds)}
    schema = "fold int, lot int, sums binary"

    def work(batches):
        sums = np.zeros((len(number), width))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array([number[k] for k in batch.column(0).to_pylist()])
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for i in np.unique(at):
                own = at == i
                sums[i] += add(int(i), x[own], y[own])
        used = np.flatnonzero(sums.any(axis=1))
        lot = TaskContext.get().partitionId() % LOTS
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), lot, np.int32)), pa.array([sums[i].tobytes() for i in used], pa.binary())], ["fold", "lot", "sums"])

    def gather(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for part in table["sums"]:
            total += np.frombuffer(part.as_buffer())
        return pa.table({"fold": table["fold"][:1], "lot": table["lot"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    parts = train.mapInArrow(work, schema).groupBy("fold", "lot").applyInArrow(gather, schema)
    out = np.zeros((len(number), width))
    for r in sorted(parts.collect(), key=lambda r: (r["fold"], r["lot"])):
        out[r["fold"]] += np.frombuffer(r["sums"])
    return out


def _training_rows(train: DataFrame, fold: str, label: str, features: str) -> DataFrame:
    return train.select(F.col(fold).alias("fold"), F.col(label).cast("int").alias("y"), doubles(F.col(features)).alias("x"))


def fit_linear(
    train: DataFrame, grid: Sequence[float], features: str, label: str, fold: str = "fold_id", most_steps: int = 40, tolerance: float = 1e-9, eps: float = 1e-4
) -> LinearFits:
    """Logistic regression per (fold, penalty) on the stored training rows, balanced weights, intercept free.

    Minimises the weighted mean log loss plus penalty / 2 times the squared weights, on features scaled per fold. Newton
    steps for all models at once; a model whose loss would rise takes half of its step, one that
    has settled stays. Rows need a label of 0 or 1 and a vector without nulls; others must be left out before.
    """
    facts = fold_facts(train, fold, features, label, eps)
    rows = _training_rows(train, fold, label, features)
    n_folds, d, n_grid = len(facts.folds), facts.mean.shape[1], len(grid)
    w_class, penalty = facts.weights(), np.asarray(grid, float)
    total = w_class[:, 0] * facts.n_0 + w_class[:, 1] * facts.n_1
    upper = np.triu_indices(d + 1)
    one = 1 + (d + 1) + len(upper[0])
    ridge = np.append(np.ones(d), 0.0)
    now = np.zeros((n_folds, n_grid, d + 1))
    trial, best = now.copy(), np.full((n_folds, n_grid), np.inf)
    grad, step = np.zeros_like(now), np.zeros_like(now)
    done = np.zeros((n_folds, n_grid), bool)
    steps = 0
    while steps < most_steps and not done.all():
        steps += 1
        mean, std, beta, w = facts.mean, facts.std, trial, w_class

        def add(i, x, y):
            z = np.concatenate(((x - mean[i]) / std[i], np.ones((len(y), 1))), axis=1)
            row = np.where(y > 0, w[i, 1], w[i, 0])
            out = np.empty((n_grid, one))
            for g in range(n_grid):
                score = z @ beta[i, g]
                p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
                out[g, 0] = (row * (np.logaddexp(0, score) - y * score)).sum()
                out[g, 1 : d + 2] = z.T @ (row * (p - y))
                out[g, d + 2 :] = ((z.T * (row * p * (1 - p))) @ z)[upper]
            return out.ravel()

        sums = _summed(rows, facts, n_grid * one, add).reshape(n_folds, n_grid, one) / total[:, None, None]
        for i in range(n_folds):
            for g in range(n_grid):
                if done[i, g]:
                    continue
                loss = sums[i, g, 0] + penalty[g] / 2 * (trial[i, g, :d] ** 2).sum()
                if loss > best[i, g] * (1 + 1e-12) + 1e-15:
                    step[i, g] /= 2
                    trial[i, g] = now[i, g] - step[i, g]
                    done[i, g] = np.abs(step[i, g]).max() < 1e-14
                    continue
                now[i, g], best[i, g] = trial[i, g], loss
                grad[i, g] = sums[i, g, 1 : d + 2] + penalty[g] * ridge * now[i, g]
                curve = np.zeros((d + 1, d + 1))
                curve[upper] = sums[i, g, d + 2 :]
                curve = curve + np.triu(curve, 1).T + np.diag(penalty[g] * ridge + 1e-10)
                step[i, g] = np.linalg.solve(curve, grad[i, g])
                done[i, g] = np.abs(grad[i, g]).max() < tolerance
                trial[i, g] = now[i, g] - step[i, g]
    return LinearFits(facts, list(grid), now[:, :, :d], now[:, :, d], best, np.abs(grad).max(axis=2) < max(tolerance, 1e-7), steps)


def linear_weights(spark: SparkSession, fits: LinearFits, fold: str, fold_type: str) -> DataFrame:
    """One row per (fold, grid point): ``grid``, ``penalty``, ``w`` and ``b``, which act on features as they came."""
    w = fits.weight / fits.facts.std[:, None, :]
    b = fits.intercept - (w * fits.facts.mean[:, None, :]).sum(axis=2)
    rows = [(k, g, fits.grid[g], w[i, g].tolist(), float(b[i, g])) for i, k in enumerate(fits.facts.folds) for g in range(len(fits.grid))]
    return spark.createDataFrame(rows, f"`{fold}` {fold_type}, grid int, penalty double, w array<double>, b double")


def linear_score(features: str, w: str = "w", b: str = "b") -> Column:
    """Probability of class 1."""
    dot = F.aggregate(F.zip_with(doubles(F.col(features)), F.col(w), lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.col(b))))


def fit_networks(
    train: DataFrame, features: str, label: str, hidden: int = 8, fold: str = "fold_id", seed: int = 42, steps: int = 60, decay: float = 1e-4, eps: float = 1e-4
) -> tuple[FoldFacts, np.ndarray]:
    """A network with one hidden layer per fold, all folds in one pass a step.

    Full-batch resilient steps (each weight has a step size that grows while its gradient keeps its sign); returns the weights that
    had the least loss. Rows weigh alike: balance them before.
    """
    facts = fold_facts(train, fold, features, label, eps)
    rows = _training_rows(train, fold, label, features)
    n_folds, d = facts.mean.shape
    size = d * hidden + hidden + hidden + 1
    weight = np.stack([np.random.default_rng(seed + i).normal(0, 1 / np.sqrt(d), size) for i in range(n_folds)])
    total = np.maximum(facts.n_0 + facts.n_1, 1)[:, None]
    move, last = np.full((n_folds, size), 0.01), np.zeros((n_folds, size))
    best, kept = np.full(n_folds, np.inf), weight.copy()
    for _ in range(steps):
        mean, std, now = facts.mean, facts.std, weight

        def add(i, x, y):
            z = (x - mean[i]) / std[i]
            a, c, v, b = _layers(now[i], d, hidden)
            h = np.tanh(z @ a + c)
            score = h @ v + b
            miss = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - y
            back = np.outer(miss, v) * (1 - h * h)
            loss = (np.logaddexp(0, score) - y * score).sum()
            return np.concatenate(([loss], (z.T @ back).ravel(), back.sum(axis=0), h.T @ miss, [miss.sum()]))

        sums = _summed(rows, facts, size + 1, add) / total
        loss = sums[:, 0] + decay / 2 * (weight**2).sum(axis=1)
        kept = np.where((loss < best)[:, None], weight, kept)
        best = np.minimum(best, loss)
        grad = sums[:, 1:] + decay * weight
        turned = grad * last
        move = np.clip(np.where(turned > 0, move * 1.2, np.where(turned < 0, move * 0.5, move)), 1e-6, 0.5)
        grad = np.where(turned < 0, 0.0, grad)
        weight, last = weight - np.sign(grad) * move, grad
    return facts, kept


def _layers(flat: np.ndarray, d: int, hidden: int):
    cut = d * hidden
    return flat[:cut].reshape(d, hidden), flat[cut : cut + hidden], flat[cut + hidden : cut + 2 * hidden], flat[-1]


def network_scores(rows: DataFrame, facts: FoldFacts, weights: np.ndarray, features: str, hidden: int, fold: str) -> DataFrame:
    """Rows with ``score``, each by its fold's network."""
    number = {k: i for i, k in enumerate(facts.folds)}
    mean, std, d = facts.mean, facts.std, facts.mean.shape[1]
    at = rows.columns.index(fold)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", score double"
    scored = rows.select("*", doubles(F.col(features)).alias("_x"))

    def work(batches):
        for batch in batches:
            which = np.array([number[k] for k in batch.column(at).to_pylist()], int)
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(len(which), -1)
            score = np.empty(len(which))
            for i in np.unique(which):
                own = which == i
                a, c, v, b = _layers(weights[i], d, hidden)
                score[own] = 1 / (1 + np.exp(-np.clip(np.tanh((x[own] - mean[i]) / std[i] @ a + c) @ v + b, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return scored.mapInArrow(work, kinds)


def probe_gradient(scored: DataFrame, penalties: DataFrame, features: str, label: str, fold: str = "fold_id", eps: float = 1e-4) -> DataFrame:
    """Gradient of the penalised loss at fitted probes, per fold and dimension, from scored training rows.

    A check that shares nothing with the fit: scores, class counts, scaled features and the penalised weights (``penalties``:
    fold, dim and pull) enter as columns. At the optimum every value is 0.
    """
    sizes = scored.groupBy(fold).agg(F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1"), F.count(F.lit(1)).alias("n_train"))
    stats = as_arrays(dimension_stats(scored, [fold], features, eps), [fold])
    rows = scored.join(sizes, fold).join(stats, fold)
    weight = F.col("n_train") / (2.0 * F.when(F.col(label) == 1, F.col("_n1")).otherwise(F.col("_n0")))
    z = F.zip_with(F.zip_with(doubles(F.col(features)), F.col("mean"), lambda x, m: x - m), F.col("std"), lambda x, s: x / s)
    parts = rows.select(fold, "n_train", (weight * (F.col("score") - F.col(label))).alias("_m"), weight.alias("_w"), F.posexplode(z).alias("dim", "_z"))
    sums = parts.groupBy(fold, "n_train", "dim").agg((F.sum(F.col("_m") * F.col("_z")) / F.sum("_w")).alias("gradient"))
    return sums.join(penalties, [fold, "dim"]).withColumn("gradient", F.col("gradient") + F.col("pull")).drop("pull")
