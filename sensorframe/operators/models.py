"""Probes, search, per-fold evaluation and normalisation comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.arrays import doubles
from sensorframe.functions.scalars import above
from sensorframe.operators.folds import balanced_resample
from sensorframe.operators.metrics import best_threshold, confusion_table, metric_table, ranking_metrics
from sensorframe.operators.ordered import lookup_join
from sensorframe.operators.probes import LinearFits, fit_linear, fit_networks, linear_score, linear_weights, network_scores
from sensorframe.operators.vectors import as_arrays, dimension_stats, mean_pool, population_standardise, zscore
from sensorframe.session import materialise, release


def apply_val_threshold(preds: DataFrame, fold: Sequence[str], split: str, label: str, score: str) -> DataFrame:
    """Prediction rows at the threshold each fold's validation split prefers.

    Thresholds are one row per fold of a run; runs and folds are few next to the
    predictions, and AQE decides at run time whether to broadcast them.
    """
    found = best_threshold(preds.where(F.col(split) == "val"), fold, label, score)
    joined = lookup_join(preds.drop("threshold", "prediction"), found.select(*fold, F.col("best_threshold").alias("threshold")), fold)
    return joined.withColumn("prediction", above(F.col(score), F.col("threshold")))


def evaluate_folds(preds: DataFrame, fold: Sequence[str], split: str, label: str, score: str) -> DataFrame:
    """train/val/test metrics per fold at its validation threshold."""
    applied = apply_val_threshold(preds, fold, split, label, score)
    keys = [*fold, split]
    counts = confusion_table(applied, [*keys, "threshold"], label, "prediction").drop("tp", "fp", "tn", "fn")
    return counts.join(ranking_metrics(preds, keys, label, score), keys)


def standardise(train: DataFrame, rows: DataFrame, features: str, eps: float = 1e-4) -> DataFrame:
    """Z-score rows by the training rows' per-dimension mean and population std."""
    return population_standardise(rows, train, features, eps)


def _train(df: DataFrame, folds: Sequence[int], features: str, label: str, fold: str, split: str) -> DataFrame:
    """Training rows of the folds, stored: every step of a fit reads them."""
    own = df.where(F.col(fold).isin(*folds) & (F.col(split) == "train"))
    return materialise(own.where(F.col(label).isin(0, 1) & F.col(features).isNotNull()).select(fold, label, features))


def _score_linear(df: DataFrame, fits: LinearFits, grid: int, features: str, fold: str) -> DataFrame:
    weights = linear_weights(df.sparkSession, fits, fold, df.schema[fold].dataType.simpleString()).where(F.col("grid") == grid)
    # One row per fold.
    return df.join(F.broadcast(weights.select(fold, "w", "b")), fold).withColumn("score", linear_score(features)).drop("w", "b")


def linear_probe(
    df: DataFrame, folds: Sequence[int], features: str, label: str, fold: str = "fold_id", split: str = "split", reg: float = 0.0, iterations: int = 40
) -> DataFrame:
    """Logistic regression per fold on standardised vectors with balanced weights; scores for all splits.

    All folds are fitted together, one pass a step, while the DataFrame is being built; scoring is lazy.
    """
    train = _train(df, folds, features, label, fold, split)
    fits = fit_linear(train, [reg], features, label, fold, iterations)
    release(train)
    return _score_linear(df.where(F.col(fold).isin(*folds)), fits, 0, features, fold)


def mlp_probe(
    df: DataFrame, folds: Sequence[int], features: str, label: str, row_id: str, hidden: int = 8, fold: str = "fold_id", split: str = "split", seed: int = 42, iterations: int = 60
) -> DataFrame:
    """One-hidden-layer network per fold, trained on label-balanced resampled rows; all folds in one pass a step."""
    own = df.where(F.col(fold).isin(*folds))
    rows = own.where((F.col(split) == "train") & F.col(features).isNotNull()).select(fold, row_id, label, features)
    drawn = materialise(balanced_resample(rows, row_id, label, seed, [fold]).select(fold, label, features))
    facts, weights = fit_networks(drawn, features, label, hidden, fold, seed, iterations)
    release(drawn)
    return network_scores(own, facts, weights, features, hidden, fold)


def search_then_evaluate(
    df: DataFrame, folds: Sequence[int], features: str, label: str, grid: Sequence[dict], fold: str = "fold_id", split: str = "split"
) -> tuple[dict, DataFrame]:
    """Choose the penalty on the first fold's validation split, then score every fold with it.

    All folds and all grid points (``reg`` of each) are fitted in the same passes; the choice is one more job. Ties take the earlier point.
    """
    train = _train(df, folds, features, label, fold, split)
    fits = fit_linear(train, [float(g["reg"]) for g in grid], features, label, fold)
    release(train)
    best = int(np.argmax([-1.0 if v is None else v for v in grid_quality(df, fits, folds[0], features, label, fold, split)]))
    return grid[best], _score_linear(df.where(F.col(fold).isin(*folds)), fits, best, features, fold)


def grid_quality(df: DataFrame, fits: LinearFits, first: int, features: str, label: str, fold: str = "fold_id", split: str = "split") -> list[float | None]:
    """Best validation balanced accuracy on one fold, per grid point."""
    weights = linear_weights(df.sparkSession, fits, fold, df.schema[fold].dataType.simpleString())
    val = df.where((F.col(fold) == first) & (F.col(split) == "val")).select(fold, label, features)
    scored = val.join(F.broadcast(weights), fold).select("grid", label, linear_score(features).alias("score"))
    found = {r["grid"]: r["best_score"] for r in best_threshold(scored, ["grid"], label, "score").collect()}
    return [found.get(g) for g in range(len(fits.grid))]


def compare_normalisation(
    scorer: Callable[[DataFrame], DataFrame], population: DataFrame, subject: DataFrame, keys: Sequence[str], label: str, threshold: Column | float
) -> DataFrame:
    """Score population- and subject-normalised rows with one model and one threshold."""
    both = scorer(population).withColumn("strategy", F.lit("population_norm")).unionByName(
        scorer(subject).withColumn("strategy", F.lit("subject_norm"))
    )
    both = both.withColumn("prediction", above(F.col("score"), threshold))
    return metric_table(both, [*keys, "strategy"], label, "score", "prediction")


def normalisation_report(
    table: DataFrame, subject: str, window: str, features: str, label: str, fold: str = "fold_id", split: str = "split", reg: float = 0.01, min_windows: int = 3
) -> DataFrame:
    """Test metrics per fold of one probe under population and subject normalisation, at one saved threshold.

    The probe is fitted on a fold's training rows, scaled by their statistics; its threshold is the best one on the validation
    rows so scaled. Test rows are then scored twice: scaled like the training rows, and by their own subject's statistics, or the
    training rows' where a subject has fewer than ``min_windows`` windows (``n_fallback_subjects``). ``table`` is a stored fold table.
    """
    spark, kind = table.sparkSession, table.schema[fold].dataType.simpleString()
    folds = sorted(r[0] for r in table.select(fold).distinct().collect())
    train = _train(table, folds, features, label, fold, split)
    fits = fit_linear(train, [reg], features, label, fold)
    release(train)
    val = _score_linear(table.where(F.col(split) == "val"), fits, 0, features, fold)
    saved = materialise(best_threshold(val, [fold], label, "score").select(fold, F.col("best_threshold").alias("threshold")))
    facts = [(k, fits.facts.mean[i].tolist(), fits.facts.std[i].tolist(), fits.weight[i, 0].tolist(), float(fits.intercept[i, 0])) for i, k in enumerate(fits.facts.folds)]
    # One row per fold.
    of_fold = F.broadcast(spark.createDataFrame(facts, f"`{fold}` {kind}, _m array<double>, _d array<double>, w array<double>, b double").join(saved, fold))
    test = table.where(F.col(split) == "test").select(fold, subject, window, label, features)
    own = as_arrays(dimension_stats(test, [fold, subject], features), [fold, subject])
    sizes = test.groupBy(fold, subject).agg((F.countDistinct(window) < min_windows).alias("fallback"))
    own = own.join(sizes, [fold, subject]).select(fold, subject, "fallback", F.col("mean").alias("_om"), F.col("std").alias("_od"))
    rows = lookup_join(test, own, [fold, subject], "inner", salt_on=[window]).join(of_fold, fold)
    options = {"population_norm": ("_m", "_d"), "subject_norm": (F.when(F.col("fallback"), F.col("_m")).otherwise(F.col("_om")), F.when(F.col("fallback"), F.col("_d")).otherwise(F.col("_od")))}
    scored = None
    for name, (mean, std) in options.items():
        mean, std = (F.col(c) if isinstance(c, str) else c for c in (mean, std))
        one = rows.withColumn("_z", zscore(doubles(F.col(features)), mean, std)).select(
            fold, subject, label, "threshold", "fallback", F.lit(name).alias("strategy"), linear_score("_z").alias("score")
        )
        scored = one if scored is None else scored.unionByName(one)
    scored = scored.withColumn("prediction", above(F.col("score"), F.col("threshold")))
    metrics = metric_table(scored, [fold, "strategy", "threshold"], label, "score", "prediction")
    fallbacks = sizes.groupBy(fold).agg(F.count_if("fallback").alias("n_fallback_subjects"))
    return metrics.join(fallbacks, fold)


def score_frames(
    frames: DataFrame, keys: Sequence[str], value: str, encode: Callable, out: str = "embedding", micro_batch: int | None = None, pool: Sequence[str] | None = None, kind: str = "float"
) -> DataFrame:
    """Run a caller's encoder over frame batches: ``encode(array of rows) -> array of rows``.

    Batches follow ``spark.sql.execution.arrow.maxRecordsPerBatch``; the encoder sees at most ``micro_batch`` frames at once, so
    what it needs besides them is bounded however large a batch is. Keys pass through. With ``pool`` (some of the
    keys) the embeddings of a group are averaged, one row per group; else there is one row per frame. ``kind`` is the
    element type of the result. A frame without a value is left out.
    """
    import pandas as pd

    schema = ", ".join([f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys] + [f"`{out}` array<{kind}>"])
    dtype = {"float": np.float32, "double": np.float64}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), micro_batch or max(len(b), 1)):
                part = b.iloc[at : at + (micro_batch or len(b))]
                got = np.asarray(encode(np.stack(part[value].to_numpy())), dtype=dtype)
                res = part[list(keys)].copy()
                res[out] = list(got)
                yield res

    scored = frames.where(F.col(value).isNotNull()).select(*keys, value).mapInPandas(run, schema)
    return scored if pool is None else mean_pool(scored, pool, out)
