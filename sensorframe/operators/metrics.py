"""Grouped metrics over scored rows: confusion, ranking, thresholds, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions.scalars import mean_std_text
from sensorframe.operators.ordered import group_total, lookup_join, ordered_scan, ratio_tile, running_sum, with_value_tile
from sensorframe.operators.quantiles import exact_quantiles

# 19 thresholds from 0.05 to 0.95, and the adaptive sweep.
GRID_POINTS, GRID_LO, GRID_HI = 19, 0.05, 0.95
ADAPTIVE_POINTS, ADAPTIVE_LO, ADAPTIVE_HI = 100, 0.05, 0.95
METRICS = ("auc", "avg_precision", "balanced_accuracy", "f1_macro", "sensitivity", "specificity", "mcc")


def fixed_grid() -> list[float]:
    """Evenly spaced thresholds, last one exact."""
    step = (GRID_HI - GRID_LO) / (GRID_POINTS - 1)
    return [i * step + GRID_LO for i in range(GRID_POINTS - 1)] + [GRID_HI]


def confusion_counts(label: Column, prediction: Column) -> list[Column]:
    """The four counts as aggregates."""
    return [
        F.count_if((label == 1) & (prediction == 1)).alias("tp"),
        F.count_if((label == 0) & (prediction == 1)).alias("fp"),
        F.count_if((label == 0) & (prediction == 0)).alias("tn"),
        F.count_if((label == 1) & (prediction == 0)).alias("fn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def balanced_accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Mean recall over the classes that occur among the labels."""
    pos, neg = tp + fn, tn + fp
    return (
        F.when((pos > 0) & (neg > 0), (tp / F.greatest(pos, F.lit(1)) + tn / F.greatest(neg, F.lit(1))) / 2)
        .when(pos > 0, tp / F.greatest(pos, F.lit(1)))
        .when(neg > 0, tn / F.greatest(neg, F.lit(1)))
    )


def confusion_metrics() -> list[Column]:
    """Metric columns from tp, fp, tn, fn; 0 where a ratio has no denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    f1_pos, f1_neg = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    seen_pos, seen_neg = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    macro = F.when(seen_pos & seen_neg, (f1_pos + f1_neg) / 2).when(seen_pos, f1_pos).otherwise(f1_neg)
    spread = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = _ratio(tp.cast("double") * tn - fp.cast("double") * fn, spread)
    return [
        balanced_accuracy(tp, fp, tn, fn).alias("balanced_accuracy"),
        macro.alias("f1_macro"),
        _ratio(tp, tp + fn).alias("sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"),
        mcc.alias("mcc"),
    ]


def confusion_table(df: DataFrame, keys: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Counts and threshold metrics per group: one partial aggregation."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), *confusion_counts(F.col(label), F.col(prediction)))
    return counted.select(*keys, "n_windows", "tp", "fp", "tn", "fn", *confusion_metrics())


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, measured_tiles: int | None = None) -> DataFrame:
    """Tie-aware ROC AUC and average precision per group; null with one class.

    Equal scores merge first; running counts over score tiles then replace the sort
    of a whole group. ``measured_tiles`` takes tiles from score quantiles, for
    double-precision scores crowded into a narrow band.
    """
    hist = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    tile: Column | str = ratio_tile("_s")
    if measured_tiles:
        hist, tile = with_value_tile(hist, "_s", measured_tiles), "_tile"
    c = ordered_scan(
        hist,
        keys,
        ["_s"],
        tile,
        {
            "_cp": running_sum(F.col("_pos")),
            "_cn": running_sum(F.col("_neg")),
            "_p": group_total(F.col("_pos")),
            "_n": group_total(F.col("_neg")),
        },
    )
    tp, fp = F.col("_p") - F.col("_cp") + F.col("_pos"), F.col("_n") - F.col("_cn") + F.col("_neg")
    got = c.groupBy(*keys).agg(
        F.max("_p").alias("n_stress"),
        F.max("_n").alias("n_nonstress"),
        F.sum(F.col("_pos") * (F.col("_cn") - F.col("_neg") / 2)).alias("_area"),
        F.sum(F.col("_pos") * (tp / (tp + fp))).alias("_ap"),
    )
    both = (F.col("n_stress") > 0) & (F.col("n_nonstress") > 0)
    return got.select(
        *keys,
        "n_stress",
        "n_nonstress",
        F.when(both, F.col("_area") / F.col("n_stress") / F.col("n_nonstress")).alias("auc"),
        F.when(both, F.col("_ap") / F.col("n_stress")).alias("avg_precision"),
    )


def metric_table(df: DataFrame, keys: Sequence[str], label: str, score: str, prediction: str) -> DataFrame:
    """All metrics per group."""
    ranks = ranking_metrics(df, keys, label, score)
    return confusion_table(df, keys, label, prediction).drop("tp", "fp", "tn", "fn").join(ranks, list(keys))


def _best_from_buckets(buckets: DataFrame, keys: Sequence[str], points: int, threshold) -> DataFrame:
    """Best threshold per group from counts by bucket (= thresholds at or below the score).

    At most ``points`` + 1 rows per group arrive here. Thresholds between two
    occupied buckets act alike, so only the lowest of each stretch is scored.
    """
    down = Window.partitionBy(*keys).orderBy(F.col("_b").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rows = buckets.select(
        "*",
        F.sum("_pos").over(upto).alias("_tp"),
        F.sum("_neg").over(upto).alias("_fp"),
        F.coalesce(F.lead("_b").over(down), F.lit(0)).alias("_below"),
        F.sum("_pos").over(whole).alias("_p"),
        F.sum("_neg").over(whole).alias("_n"),
        F.max("_b").over(whole).alias("_top"),
    )
    blank = F.struct(F.col("_top").alias("i"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    step = F.struct(F.col("_below").alias("i"), F.col("_tp").alias("tp"), F.col("_fp").alias("fp"))
    options = F.when(F.col("_b") == F.col("_top"), F.array(step, blank)).otherwise(F.array(step))
    cand = rows.withColumn("_o", F.explode(options)).where((F.col("_o.i") < points) & ((F.col("_b") > 0) | (F.col("_o.tp") + F.col("_o.fp") == 0)))
    ba = balanced_accuracy(F.col("_o.tp"), F.col("_o.fp"), F.col("_n") - F.col("_o.fp"), F.col("_p") - F.col("_o.tp"))
    cand = cand.withColumn("_ba", ba)
    best = cand.groupBy(*keys).agg(F.max(F.struct(F.col("_ba").alias("ba"), (-F.col("_o.i")).alias("i"))).alias("_best"))
    return best.select(*keys, threshold((-F.col("_best.i")).cast("int")).alias("best_threshold"), F.col("_best.ba").alias("best_score"))


def _pick(values: Sequence[float]):
    return lambda i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)


def best_threshold(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Fixed-grid threshold with the best balanced accuracy; ties take the lowest."""
    grid = fixed_grid()
    bucket = sum(((F.col(score) >= x).cast("int") for x in grid[1:]), (F.col(score) >= grid[0]).cast("int"))
    buckets = df.groupBy(*keys, bucket.alias("_b")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    return _best_from_buckets(buckets, keys, GRID_POINTS, _pick(grid))


def adaptive_threshold(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Threshold from 100 points between the group's 5th and 95th score percentile.

    Groups whose range is below 1e-6 use the fixed grid.
    """
    slim = df.select(*keys, label, score)
    bounds = exact_quantiles(slim, keys, score, {"_lo": ADAPTIVE_LO, "_hi": ADAPTIVE_HI})
    flat = F.col("_hi") - F.col("_lo") < 1e-6
    # Identical (group, score, label) rows merge before the join: they share a bucket.
    hist = slim.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    joined = lookup_join(hist, bounds, keys, "inner", salt_on=[score])
    last = ADAPTIVE_POINTS - 1
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(last))

    def point(i: Column) -> Column:
        return F.when(i >= last, F.col("_hi")).otherwise(i * step + F.col("_lo"))

    s = F.col(score)
    guess = F.least(F.greatest(F.floor((s - F.col("_lo")) / step), F.lit(-1)), F.lit(last)).cast("int")
    ranged = joined.where(~flat).withColumn("_g", guess)
    g = F.col("_g")
    exact = F.when((g >= 0) & (s < point(g)), g - 1).when((g < last) & (s >= point(g + 1)), g + 1).otherwise(g) + 1
    buckets = ranged.groupBy(*keys, "_lo", "_hi", exact.alias("_b")).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    swept = _best_from_buckets(buckets, [*keys, "_lo", "_hi"], ADAPTIVE_POINTS, point).drop("_lo", "_hi")
    grid = fixed_grid()
    fixed_bucket = sum(((s >= x).cast("int") for x in grid[1:]), (s >= grid[0]).cast("int"))
    narrow = joined.where(flat).groupBy(*keys, fixed_bucket.alias("_b")).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    return swept.unionByName(_best_from_buckets(narrow, keys, GRID_POINTS, _pick(grid)))


def fold_aggregates(per_fold: DataFrame, keys: Sequence[str], metrics: Sequence[str], fold: str = "fold_id", windows: str = "n_windows") -> DataFrame:
    """Mean, sample std and text per metric, folds, mean windows per fold."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    got = per_fold.groupBy(*keys).agg(*aggs, F.countDistinct(fold).alias("n_folds"), F.avg(windows).alias("mean_windows_per_fold"))
    return got.select("*", *[mean_std_text(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(f"{m}_fmt") for m in metrics])


def split_summary(per_fold: DataFrame, keys: Sequence[str], splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Wide summary per split: mean and population std of balanced accuracy, mean F1, mean AUC."""
    aggs = []
    for s in splits:
        here = F.col("split") == s

        def only(c: str, here=here) -> Column:
            return F.when(here, F.col(c))

        aggs += [
            F.avg(only("balanced_accuracy")).alias(f"{s}_balanced_accuracy_mean"),
            F.stddev_pop(only("balanced_accuracy")).alias(f"{s}_balanced_accuracy_std"),
            F.avg(only("f1_macro")).alias(f"{s}_f1_macro_mean"),
            F.avg(only("auc")).alias(f"{s}_auc_mean"),
        ]
    return per_fold.groupBy(*keys).agg(*aggs)


def strategy_delta(summary: DataFrame, keys: Sequence[str], strategy: str, left: str, right: str, metrics: Sequence[str]) -> DataFrame:
    """Per combination: both strategies' metrics and left minus right."""
    pivoted = summary.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col(strategy) == name, F.col(m))).alias(f"{m}_{name}")
            for m in metrics
            for name in (left, right)
        ]
    )
    return pivoted.select("*", *[(F.col(f"{m}_{left}") - F.col(f"{m}_{right}")).alias(f"{m}_delta") for m in metrics])


def best_per_group(df: DataFrame, keys: Sequence[str], by: str, tie: Sequence[str]) -> DataFrame:
    """Row with the highest ``by`` per group; null loses, ties take the smallest tie columns."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.coalesce(-F.col(by), F.lit(float("inf"))), *tie)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def leaderboard(df: DataFrame, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Rows ordered by metrics descending, then by tie columns."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in by], *tie)


def concise_table(summary: DataFrame) -> DataFrame:
    """Fixed-column result table with descriptors."""
    return summary.select(
        F.concat_ws("_", "encoder", "model_family", "strategy").alias("model_name"),
        F.col("feature").alias("input_mode"),
        F.concat_ws(":", "encoder", "feature", "model_family", "strategy").alias("representation_equation"),
        F.lit("validation-only threshold audit").alias("sequence_pooling"),
        F.lit(0).cast("long").alias("search_trials"),
        "n_folds",
        F.col("balanced_accuracy_mean").alias("test_balanced_accuracy_mean"),
        F.col("auc_mean").alias("test_auc_mean"),
        F.col("mcc_mean").alias("test_mcc_mean"),
        F.col("avg_precision_mean").alias("test_avg_precision_mean"),
        F.col("f1_macro_mean").alias("test_f1_macro_mean"),
    )


def best_epoch(history: DataFrame, run: Sequence[str], epoch: str, score: str, patience: int) -> DataFrame:
    """First epoch reaching the best score before training would have stopped.

    Training stops after ``patience`` epochs without gain. A run's history is short
    (its number of epochs), so one window per run is enough.
    """
    w = Window.partitionBy(*run).orderBy(epoch)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gained = history.withColumn("_top", F.max(score).over(past)).withColumn("_n", F.row_number().over(w))
    gained = gained.withColumn("_gain", F.col("_top").isNull() | (F.col(score) > F.col("_top")))
    since = gained.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_gain"), F.col("_n"))).over(upto))
    stopped = since.withColumn("_stop", F.max((F.col("_since") >= patience).cast("int")).over(past))
    live = stopped.where(F.coalesce(F.col("_stop"), F.lit(0)) == 0)
    return live.groupBy(*run).agg(
        F.max(score).alias("best_score"),
        F.min_by(epoch, F.struct(-F.col(score), F.col(epoch))).alias("best_epoch"),
        F.max(epoch).alias("last_epoch"),
    )
