"""Saved predictions to a strategy comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.calibrate import STRATEGIES, audit_metrics, audit_predictions, calibrator_table
from sensorframe.operators.metrics import METRICS, fold_aggregates, leaderboard, strategy_delta
from sensorframe.session import materialise


def audit_report(preds: DataFrame, run: Sequence[str], fold: str = "fold_id", split: str = "test", digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calibrators per fold, ranked summary per run and strategy, and deltas against the saved thresholds."""
    keys = [*run, fold]
    calibrators = materialise(calibrator_table(preds, keys))
    per_fold = audit_metrics(audit_predictions(preds, keys, calibrators, digits=digits), keys)
    summary = materialise(fold_aggregates(per_fold.where(F.col("split") == split), [*run, "strategy"], METRICS, fold))
    means = [f"{m}_mean" for m in METRICS]
    deltas = None
    for other in STRATEGIES[1:]:
        d = strategy_delta(summary, run, "strategy", other, STRATEGIES[0], means)
        d = d.select(*run, F.lit(other).alias("strategy"), *[f"{m}_delta" for m in means])
        deltas = d if deltas is None else deltas.unionByName(d)
    return calibrators, leaderboard(summary, ["auc_mean", "balanced_accuracy_mean"], [*run, "strategy"]), deltas
