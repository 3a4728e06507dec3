"""Grouped Platt calibration and the four-strategy audit of saved predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.scalars import above, logit
from sensorframe.operators.metrics import adaptive_threshold, metric_table
from sensorframe.operators.ordered import lookup_join
from sensorframe.session import materialise

#: Groups up to which the state of a fit (a few numbers each) is held by the driver and broadcast.
BROADCAST_GROUPS = 10_000
STRATEGIES = ("current_saved_threshold", "val_adaptive_threshold", "val_platt_lr_0p5", "val_platt_lr_val_threshold")


def platt_fit(df: DataFrame, keys: Sequence[str], label: str, score: str, eps: float = 1e-6, max_steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """Slope and intercept of a one-dimensional logistic fit on score log-odds, per group.

    Balanced class weights n / (2 n_c), penalty slope^2 / 2, intercept free. Newton
    steps for all groups at once: each is one partial aggregation of gradient and
    Hessian sums over the score histogram, run while the DataFrame is being built. The state, one row per group, travels
    to the histogram as a broadcast up to ``BROADCAST_GROUPS`` groups; beyond, it is stored and joined. Groups with
    one class are skipped. ``n_steps`` is the number of steps taken; a group that still moves after ``max_steps`` is
    ``not_converged``.
    """
    hist = (
        df.groupBy(*keys, logit(F.col(score), eps).alias("_x"))
        .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    )
    hist = materialise(hist)
    sizes = hist.groupBy(*keys).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    both = sizes.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    state = materialise(both.select(*keys, "n_pos", "n_neg", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("inf")).alias("_move")))
    few = state.count() <= BROADCAST_GROUPS
    total = F.col("n_pos") + F.col("n_neg")
    w1, w0 = F.col("_pos") * total / (2.0 * F.col("n_pos")), F.col("_neg") * total / (2.0 * F.col("n_neg"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("a") + F.col("b") * F.col("_x"))))
    miss = w1 * (p - 1.0) + w0 * p
    curve = (w1 + w0) * p * (F.lit(1.0) - p)
    n_steps = 0
    for n_steps in range(1, max_steps + 1):
        rows = hist.join(F.broadcast(state), list(keys)) if few else lookup_join(hist, state, keys, "inner", salt_on=["_x"])
        sums = rows.groupBy(*keys, "n_pos", "n_neg", "a", "b").agg(
            F.sum(miss).alias("_ga"),
            F.sum(miss * F.col("_x")).alias("_gb"),
            F.sum(curve).alias("_haa"),
            F.sum(curve * F.col("_x")).alias("_hab"),
            F.sum(curve * F.col("_x") * F.col("_x")).alias("_hbb"),
        )
        ga, gb = F.col("_ga"), F.col("_gb") + F.col("b")
        haa, hab, hbb = F.col("_haa") + 1e-12, F.col("_hab"), F.col("_hbb") + 1.0
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = F.sqrt(da * da + db * db)
        damp = F.when(size > 5.0, F.lit(5.0) / size).otherwise(F.lit(1.0))
        moved = sums.select(
            *keys, "n_pos", "n_neg", (F.col("a") - damp * da).alias("a"), (F.col("b") - damp * db).alias("b"), size.alias("_move")
        )
        if few:
            now = moved.collect()
            state = df.sparkSession.createDataFrame(now, moved.schema)
            furthest = max((r["_move"] for r in now), default=None)
        else:
            state = materialise(moved)
            furthest = state.agg(F.max("_move")).first()[0]
        if furthest is None or furthest < tolerance:
            break
    settled = F.col("_move") < tolerance
    fitted = state.select(*keys, F.col("b").alias("platt_coef"), F.col("a").alias("platt_intercept"), settled.alias("_settled"), F.lit(n_steps).alias("n_steps"))
    status = F.when(F.col("platt_coef").isNull(), "skipped_val_single_class").when(F.col("_settled"), "ok").otherwise("not_converged")
    return sizes.join(fitted, list(keys), "left").withColumn("status", status).drop("_settled")


def platt_score(score: Column, coef: Column, intercept: Column, eps: float = 1e-6) -> Column:
    """Calibrated probability."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(intercept + coef * logit(score, eps))))


def calibrator_table(preds: DataFrame, keys: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Per group: adaptive threshold, Platt fit and the threshold found on calibrated validation scores."""
    val = preds.where(F.col("split") == "val")
    adaptive = adaptive_threshold(val, keys, "label", "score").select(
        *keys, F.col("best_threshold").alias("adaptive_val_threshold"), F.col("best_score").alias("adaptive_val_ba")
    )
    fit = platt_fit(val, keys, "label", "score", eps)
    ok = fit.where(F.col("status") == "ok").select(*keys, "platt_coef", "platt_intercept")
    scaled = lookup_join(val.select(*keys, "label", "score"), ok, keys, "inner", salt_on=["score"]).withColumn(
        "score", platt_score(F.col("score"), F.col("platt_coef"), F.col("platt_intercept"), eps)
    )
    found = adaptive_threshold(scaled, keys, "label", "score").select(
        *keys, F.col("best_threshold").alias("platt_val_threshold"), F.col("best_score").alias("platt_val_balanced_accuracy")
    )
    return fit.join(adaptive, list(keys), "left").join(found, list(keys), "left").withColumn("epsilon", F.lit(eps))


def audit_predictions(preds: DataFrame, keys: Sequence[str], calibrators: DataFrame, strategies: Sequence[str] = STRATEGIES, eps: float = 1e-6, digits: int | None = None) -> DataFrame:
    """Every prediction row once per strategy, with the score, threshold and decision it uses.

    With ``digits`` calibrated scores are rounded once decided on, so that scores equal but for rounding rank alike.
    """
    facts = calibrators.select(*keys, "adaptive_val_threshold", "platt_coef", "platt_intercept", "platt_val_threshold")
    j = lookup_join(preds, facts, keys, "inner")
    p = platt_score(F.col("score"), F.col("platt_coef"), F.col("platt_intercept"), eps)

    def option(name: str, score: Column, threshold: Column, decision: Column) -> Column:
        return F.struct(
            F.lit(name).alias("strategy"), score.alias("score"), threshold.alias("threshold"), decision.alias("prediction")
        )

    shown = p if digits is None else F.round(p, digits)
    s, t_a, t_p = F.col("score"), F.col("adaptive_val_threshold"), F.col("platt_val_threshold")
    options = {
        STRATEGIES[0]: option(STRATEGIES[0], s, F.col("threshold").cast("double"), F.col("prediction").cast("long")),
        STRATEGIES[1]: option(STRATEGIES[1], s, t_a, above(s, t_a)),
        STRATEGIES[2]: option(STRATEGIES[2], shown, F.lit(0.5), above(p, 0.5)),
        STRATEGIES[3]: option(STRATEGIES[3], shown, t_p, above(p, t_p)),
    }
    kept = [c for c in preds.columns if c not in ("score", "threshold", "prediction")]
    rows = j.select(*kept, F.explode(F.array(*[options[x] for x in strategies])).alias("_o"))
    out = rows.select(*kept, "_o.strategy", "_o.score", "_o.threshold", "_o.prediction")
    return out.where(F.col("score").isNotNull() & F.col("prediction").isNotNull())


def audit_metrics(audited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All metrics per group, split and strategy."""
    return metric_table(audited, [*keys, "split", "strategy"], "label", "score", "prediction")
