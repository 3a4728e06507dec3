"""Checks over stored tasks and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.ordered import ordered_scan, previous
from sensorframe.operators.quantiles import exact_quantiles
from sensorframe.operators.shape import evenly_spaced

# Arrays and attributes a task store must hold.
REQUIRED_ARRAYS = (
    "depth",
    "depth_frame_indices",
    "depth_source_timestamps",
    "rgb",
    "rgb_frame_indices",
    "rgb_source_timestamps",
    "target_timestamps",
)
REQUIRED_ATTRS = ("base_subject_id", "group", "stress_label", "task_id", "view_type")
PREDICTION_COLUMNS = (
    "run_name",
    "encoder",
    "feature",
    "model_family",
    "fold_id",
    "split",
    "source_index",
    "window_id",
    "base_subject_id",
    "label",
    "score",
    "prediction",
    "threshold",
)


def validate_tasks(
    arrays: DataFrame,
    attrs: DataFrame,
    stamps: DataFrame,
    task: str,
    expected_step: float = 0.2,
    step_tolerance: float = 0.05,
    tile: Column | None = None,
) -> DataFrame:
    """Status per task; later checks override earlier ones.

    ``arrays``: (task, array, length, ndim, last_dim). ``attrs``: (task, attr).
    ``stamps``: (task, idx, ts). Missing parts give ``incomplete``; then a wrong rank
    gives ``bad_shape``, unequal lengths ``length_mismatch``, and a median step off by
    more than the tolerance ``bad_timestamp_step``. A task that any of the tables names has a row,
    also one without arrays.
    """
    required = F.array(*[F.lit(x) for x in REQUIRED_ARRAYS])
    required_attrs = F.array(*[F.lit(x) for x in REQUIRED_ATTRS])

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("array") == name, F.col(column)))

    # Array and attribute names come from a fixed list plus a few extras, so the sets stay small.
    have = arrays.groupBy(task).agg(
        F.array_join(F.array_sort(F.array_except(required, F.collect_set("array"))), ",").alias("missing_arrays"),
        of("rgb", "length").alias("_rgb_n"),
        of("rgb", "ndim").alias("_rgb_d"),
        of("rgb", "last_dim").alias("_rgb_c"),
        of("depth", "length").alias("_depth_n"),
        of("depth", "ndim").alias("_depth_d"),
        of("target_timestamps", "length").alias("_ts_n"),
    )
    named = attrs.groupBy(task).agg(
        F.array_join(F.array_sort(F.array_except(required_attrs, F.collect_set("attr"))), ",").alias("missing_attrs")
    )
    steps = ordered_scan(
        stamps, [task], ["idx"], F.floor(F.col("idx") / (1 << 20)) if tile is None else tile, {"_prev": previous(F.col("ts"))}
    ).select(task, (F.col("ts") - F.col("_prev")).alias("_step"))
    medians = exact_quantiles(steps.where(F.col("_step").isNotNull()), [task], "_step", {"timestamp_step_median": 0.5})
    tasks = arrays.select(task).union(attrs.select(task)).union(stamps.select(task)).distinct()
    j = tasks.join(have, task, "left").join(named, task, "left").join(medians, task, "left")
    j = j.withColumn("missing_arrays", F.coalesce("missing_arrays", F.lit(",".join(sorted(REQUIRED_ARRAYS)))))
    all_attrs = ",".join(sorted(REQUIRED_ATTRS))
    j = j.withColumn("missing_attrs", F.coalesce("missing_attrs", F.lit(all_attrs)))
    error = F.abs(F.col("timestamp_step_median") - expected_step)
    status = (
        F.when((F.col("missing_arrays") != "") | (F.col("missing_attrs") != ""), "incomplete")
        .when(error > step_tolerance, "bad_timestamp_step")
        .when((F.col("_rgb_n") != F.col("_depth_n")) | (F.col("_rgb_n") != F.col("_ts_n")), "length_mismatch")
        .when((F.col("_rgb_d") != 4) | (F.col("_rgb_c") != 3) | (F.col("_depth_d") != 3), "bad_shape")
        .otherwise("complete")
    )
    known = F.col("status") != "incomplete"
    return j.withColumn("status", status).select(
        task,
        "status",
        "missing_arrays",
        "missing_attrs",
        F.when(known, F.col("_rgb_n")).alias("num_samples"),
        F.when(known, F.col("timestamp_step_median")).alias("timestamp_step_median"),
        F.when(known, F.abs(F.col("timestamp_step_median") - expected_step)).alias("timestamp_step_error"),
    )


def require_columns(df: DataFrame, columns: Sequence[str] = PREDICTION_COLUMNS) -> DataFrame:
    """The table itself, or an error naming the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def split_presence(df: DataFrame, keys: Sequence[str], required: Sequence[str] = ("val", "test")) -> DataFrame:
    """Which required splits each group lacks; split names are a handful."""
    need = F.array(*[F.lit(s) for s in required])
    got = df.groupBy(*keys).agg(F.collect_set(F.when(F.col("split").isin(*required), F.col("split"))).alias("_s"))
    lacking = F.array_sort(F.array_except(need, "_s"))
    return got.select(*keys, F.array_join(lacking, ",").alias("missing_splits"), (F.size(lacking) == 0).alias("ok"))


def finite_vector(a: Column) -> Column:
    """True when no element is null, NaN or infinite."""
    bad = F.exists(a.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return ~F.coalesce(bad, F.lit(True))


def pair_readiness(pairs: DataFrame, subject: str, label: str, left: str, right: str) -> DataFrame:
    """Pairs, positives, widths and non-finite rows per subject."""
    return pairs.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(label).cast("long").alias("n_stress"),
        F.min(F.size(left)).cast("long").alias("left_dim"),
        F.min(F.size(right)).cast("long").alias("right_dim"),
        F.count_if(~finite_vector(F.col(left))).alias("left_not_finite"),
        F.count_if(~finite_vector(F.col(right))).alias("right_not_finite"),
    )


def probe_pairs(pairs: DataFrame, order: Sequence[str], n: int, left: str, right: str) -> DataFrame:
    """Evenly spaced sample of pairs with their finiteness flags."""
    flagged = pairs.withColumn("left_finite", finite_vector(F.col(left))).withColumn("right_finite", finite_vector(F.col(right)))
    return evenly_spaced(flagged.drop(left, right), order, n)


def fail_fast(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The table itself; the first bad row met at run time aborts the job."""
    guard = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard)
