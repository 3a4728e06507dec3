"""Runs of equal labels, task segments and clock reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions.scalars import binary_label, is_whole
from sensorframe.operators.ordered import (
    ROWS_PER_TILE,
    ordered_scan,
    previous,
    row_position,
    row_tile,
)
from sensorframe.operators.quantiles import exact_quantiles
from sensorframe.session import materialise


def mark_runs(
    df: DataFrame, keys: Sequence[str], row: str, label: str, tile: Column | None = None, first_known: Column | None = None
) -> DataFrame:
    """Add ``pos`` (1-based row in the group) and ``run_start`` (pos where the row's run began).

    One ordered scan: inside its tile a row knows its place and where the label last changed. A tile sends on its first and
    last label, its length and its last change; running over these summaries, a tile whose first label is the last
    one of the tile before continues that tile's open run, else it begins its own. Rows before a tile's first
    change take that start. ``first_known`` adds ``_first``, its first non-null value in the group.
    """
    cell = [*keys, "_tile"]
    tiled = df.withColumn("_tile", row_tile(row) if tile is None else tile)
    for c in cell:
        tiled = tiled.where(F.col(c).isNotNull())
    fwd = Window.partitionBy(*cell).orderBy(row)
    upto = fwd.rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce(F.col(label), F.lit(""))
    known = F.lit(None) if first_known is None else first_known
    local = tiled.select("*", F.row_number().over(fwd).cast("long").alias("_place"), F.lag(text).over(fwd).alias("_prev"), F.lead(F.lit(1)).over(fwd).alias("_more"))
    local = local.withColumn("_change", F.last(F.when(F.col("_prev") != text, F.col("_place")), ignorenulls=True).over(upto))
    ends = local.select(
        *cell, "_place", "_change", "_more", text.alias("_last"), F.first(text).over(upto).alias("_head"), F.first(known, ignorenulls=True).over(upto).alias("_known")
    ).where(F.col("_more").isNull())
    tiles = Window.partitionBy(*keys).orderBy("_tile")
    before = tiles.rowsBetween(Window.unboundedPreceding, -1)
    whole = tiles.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = ends.select(
        "*",
        F.coalesce(F.sum("_place").over(before), F.lit(0)).alias("_offset"),
        F.coalesce(F.lag("_last").over(tiles) == F.col("_head"), F.lit(False)).alias("_goes_on"),
        F.first("_known", ignorenulls=True).over(whole).alias("_first"),
    )
    own = F.coalesce(F.col("_offset") + F.col("_change"), F.when(~F.col("_goes_on"), F.col("_offset") + 1))
    sums = sums.withColumn("_open", F.last(own, ignorenulls=True).over(before))
    carries = sums.select(*cell, "_offset", F.when(F.col("_goes_on"), F.col("_open")).otherwise(F.col("_offset") + 1).alias("_start"), "_first")
    placed = local.join(carries, cell).select(
        *df.columns,
        (F.col("_offset") + F.col("_place")).alias("pos"),
        F.coalesce(F.col("_offset") + F.col("_change"), F.col("_start")).alias("run_start"),
        "_first",
    )
    return placed.drop("_first") if first_known is None else placed


def run_summary(
    df: DataFrame, keys: Sequence[str], row: str, label: str, time: str, tile: Column | None = None
) -> DataFrame:
    """One row per run of equal label: rows, times, distinct timestamps, duration."""
    named = df.withColumn(label, F.coalesce(F.col(label), F.lit("None")))
    marked = mark_runs(named, keys, row, label, tile)
    t = F.col(time)
    known = F.when(t.isNotNull(), F.col("pos"))
    out = marked.groupBy(*keys, "run_start").agg(
        F.first(label).alias("label"),
        (F.min("pos") - 1).alias("start_row"),
        (F.max("pos") - 1).alias("end_row"),
        F.count(F.lit(1)).alias("num_rows"),
        F.min_by(t, known).alias("start_time"),
        F.max_by(t, known).alias("end_time"),
        F.countDistinct(t).alias("unique_timestamps"),
    )
    return out.drop("run_start").withColumn("duration_seconds_wall", F.col("end_time") - F.col("start_time"))


def task_segments(
    df: DataFrame,
    keys: Sequence[str],
    row: str,
    label: str,
    time: str,
    negatives: Iterable[str],
    positives: Iterable[str],
    rate_hz: float,
    tile_rows: int = ROWS_PER_TILE,
) -> DataFrame:
    """Maximal runs of one target label with half-open rows and implicit-clock times.

    A row's time is the first known time of the recording plus its position over
    the rate; a segment ends one period after its last row.
    """
    negatives, positives = tuple(negatives), tuple(positives)
    slim = df.select(*keys, row, label, time)
    tile = row_tile(row, tile_rows)
    marked = mark_runs(slim, keys, row, label, tile, F.col(time))
    target = marked.where(F.col(label).isin(*negatives, *positives))
    segs = target.groupBy(*keys, F.col(label).alias("task_id"), "run_start").agg(
        (F.min("pos") - 1).alias("imu_start_row"), F.max("pos").alias("imu_end_row_exclusive"), F.first("_first").alias("_first")
    )
    # One row per segment, read twice below: stored so that the sample scans run once.
    ranked = ordered_scan(
        materialise(segs),
        [*keys, "task_id"],
        ["imu_start_row"],
        row_tile("imu_start_row", tile_rows),
        {"task_segment_ordinal": row_position()},
    )
    period = 1.0 / rate_hz
    start = F.col("_first") + F.col("imu_start_row") / F.lit(rate_hz)
    end = F.col("_first") + (F.col("imu_end_row_exclusive") - 1) / F.lit(rate_hz) + F.lit(period)
    return ranked.select(
        *keys,
        "task_id",
        "task_segment_ordinal",
        binary_label(F.col("task_id"), negatives, positives).alias("stress_label"),
        start.alias("imu_task_start_ts"),
        end.alias("imu_task_end_ts"),
        (end - start).alias("imu_task_duration_seconds"),
        "imu_start_row",
        "imu_end_row_exclusive",
        (F.col("imu_end_row_exclusive") - F.col("imu_start_row")).alias("imu_num_rows"),
    )


def timestamp_counts(
    df: DataFrame, keys: Sequence[str], row: str, label: str, time: str, tile_width: float = 3600.0
) -> DataFrame:
    """Rows, first/last label, distinct labels per timestamp, and the step from the one before.

    Rows without a time form one group whose step is null.
    """
    text = F.coalesce(F.col(label), F.lit("None"))
    per_time = df.groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.min_by(text, F.col(row)).alias("first_label"),
        F.max_by(text, F.col(row)).alias("last_label"),
        F.countDistinct(text).alias("unique_labels"),
    )
    known = ordered_scan(
        per_time.where(F.col(time).isNotNull()),
        keys,
        [time],
        F.floor(F.col(time) / F.lit(tile_width)),
        {"_prev": previous(F.col(time))},
    )
    known = known.withColumn("delta_from_prev", F.col(time) - F.col("_prev")).drop("_prev")
    unknown = per_time.where(F.col(time).isNull()).withColumn("delta_from_prev", F.lit(None).cast("double"))
    return known.unionByName(unknown).withColumn("is_integer_time", F.coalesce(is_whole(F.col(time)), F.lit(False)))


def clock_summary(
    df: DataFrame, keys: Sequence[str], row: str, label: str, time: str, tile: Column | None = None, tile_width: float = 3600.0
) -> DataFrame:
    """Sampling-clock report per recording."""
    tile = row_tile(row) if tile is None else tile
    t = F.col(time)
    text = F.coalesce(F.col(label), F.lit("None"))
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count(t).alias("num_valid_time_rows"),
        F.coalesce(F.bool_and(is_whole(t)), F.lit(False)).alias("all_timestamps_integer"),
        F.min(t).alias("start_time"),
        F.max(t).alias("end_time"),
        F.collect_set(text).alias("_labels"),
    )
    valid = df.where(t.isNotNull()).select(*keys, row, time)
    steps = ordered_scan(valid, keys, [row], tile, {"_prev": previous(t)}).select(*keys, (t - F.col("_prev")).alias("_diff"))
    row_stats = steps.groupBy(*keys).agg(
        F.count_if(F.abs("_diff") <= 1e-12).alias("num_zero_diffs"),
        F.count_if(F.col("_diff") < 0).alias("num_negative_diffs"),
        F.min(F.when(F.col("_diff") > 0, F.col("_diff"))).alias("min_positive_row_diff"),
    )
    row_median = exact_quantiles(steps.where(F.col("_diff") > 0), keys, "_diff", {"median_positive_row_diff": 0.5})
    distinct = ordered_scan(
        valid.select(*keys, time).distinct(), keys, [time], F.floor(t / F.lit(tile_width)), {"_prev": previous(t)}
    ).select(*keys, time, (t - F.col("_prev")).alias("_diff"))
    distinct_stats = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_unique_timestamps"), F.min("_diff").alias("min_unique_timestamp_diff")
    )
    distinct_median = exact_quantiles(
        distinct.where(F.col("_diff").isNotNull()), keys, "_diff", {"median_unique_timestamp_diff": 0.5}
    )
    out = counts
    for part in (row_stats, row_median, distinct_stats, distinct_median):
        out = out.join(part, list(keys), "left")
    duration = F.coalesce(F.col("end_time") - F.col("start_time"), F.lit(0.0))
    unique = F.coalesce(F.col("num_unique_timestamps"), F.lit(0))
    names = F.array_sort(F.filter("_labels", lambda x: ~x.isin("None", "nan", "")))
    return out.select(
        *keys,
        "num_rows",
        "num_valid_time_rows",
        unique.alias("num_unique_timestamps"),
        "start_time",
        "end_time",
        duration.alias("duration_seconds"),
        F.when(duration > 0, F.col("num_valid_time_rows") / duration).alias("estimated_sample_rate_hz"),
        F.when(unique > 0, F.col("num_valid_time_rows") / unique).alias("avg_rows_per_unique_timestamp"),
        "all_timestamps_integer",
        F.coalesce("num_zero_diffs", F.lit(0)).alias("num_zero_diffs"),
        F.coalesce("num_negative_diffs", F.lit(0)).alias("num_negative_diffs"),
        "min_positive_row_diff",
        "median_positive_row_diff",
        "min_unique_timestamp_diff",
        "median_unique_timestamp_diff",
        F.size("_labels").cast("long").alias("num_distinct_labels"),
        F.array_join(names, ",").alias("observed_labels"),
    )
