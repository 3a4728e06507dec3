"""Time alignment: clocks, units, grids, interval lookup, nearest joins, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.ordered import (
    following,
    group_first,
    last_valid,
    lookup_join,
    next_valid,
    ordered_scan,
    row_position,
    row_tile,
    running_sum,
    with_time_tile,
)
from sensorframe.operators.shape import explode_range


def implicit_clock(
    df: DataFrame, keys: Sequence[str], row: str, time: str, rate_hz: float, tile: Column | None = None
) -> DataFrame:
    """Add ``clock``: first known time of the group plus row position over the rate."""
    out = ordered_scan(
        df,
        keys,
        [row],
        row_tile(row) if tile is None else tile,
        {"_pos": row_position(), "_first": group_first(F.col(time))},
    )
    clock = F.col("_first") + (F.col("_pos") - 1) / F.lit(rate_hz)
    return out.withColumn("clock", clock).drop("_pos", "_first")


def normalise_units(df: DataFrame, keys: Sequence[str], ts: str, salt_on: Sequence[str]) -> DataFrame:
    """Seconds from a clock that may be in milliseconds, decided once per stream.

    A stream whose median absolute finite timestamp exceeds 1e11 is in milliseconds. No quantile is needed for that: the
    counts on either side decide, and with an even split the two middle values are the largest below and
    the smallest above. One aggregation, combined before the shuffle.
    """
    finite = F.col(ts).isNotNull() & ~F.isnan(ts) & (F.abs(ts) != F.lit(float("inf")))
    size = df.where(finite).select(*keys, F.abs(ts).alias("_abs"))
    large = F.col("_abs") > 1e11
    sides = size.groupBy(*keys).agg(
        F.count_if(large).alias("_above"),
        F.count_if(~large).alias("_below"),
        F.max(F.when(~large, F.col("_abs"))).alias("_low"),
        F.min(F.when(large, F.col("_abs"))).alias("_high"),
    )
    even = (F.col("_low") + F.col("_high")) / 2 > 1e11
    unit = sides.select(*keys, F.when(F.col("_above") == F.col("_below"), even).otherwise(F.col("_above") > F.col("_below")).alias("_millis"))
    joined = lookup_join(df, unit, keys, "left", salt_on=salt_on)
    millis = F.col("_millis")
    return (
        joined.withColumn(ts, F.when(millis, F.col(ts) / 1000.0).otherwise(F.col(ts)))
        .withColumn(
            "unit", F.when(millis.isNull(), "unknown").when(millis, "milliseconds").otherwise("seconds")
        )
        .drop("_millis")
    )


def target_grid(df: DataFrame, start: str, end: str, rate_hz: float) -> DataFrame:
    """One row per grid point ``start + i/rate`` below ``end``, numbered by ``sample_idx``."""
    n = F.ceil((F.col(end) - F.col(start)) * F.lit(rate_hz) - F.lit(1e-9)).cast("long")
    return explode_range(df, F.lit(0), n - 1, "sample_idx").withColumn("target_ts", F.col(start) + F.col("sample_idx") / F.lit(rate_hz))


def interval_ranges(
    intervals: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    interval_id: Sequence[str],
    start: str,
    end: str,
    ts: str,
    frame: str,
    tolerance: float,
    tile_width: float | None = None,
) -> DataFrame:
    """First and last frame inside each closed interval, with count and coverage status.

    Interval ends travel in one ordered stream with the frames, so the work is
    frames + 2 x intervals: no frame is paired with every interval that covers it.
    Intervals with a null bound cover nothing and are returned as missing.
    """
    bounded = F.col(start).isNotNull() & F.col(end).isNotNull()
    unbounded, intervals = intervals.where(~bounded), intervals.where(bounded)
    blank_id = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in interval_id]
    no_frame = F.lit(None).cast(frames.schema[frame].dataType).alias("_frame")

    def edge(column: str, kind: int) -> DataFrame:
        return intervals.select(*keys, *interval_id, F.col(column).alias("_ts"), F.lit(kind).alias("_kind"), no_frame)

    # At equal times a start precedes the frames and an end follows them: both ends are closed.
    stream = (
        edge(start, 0)
        .unionByName(frames.where(F.col(ts).isNotNull()).select(*keys, *blank_id, F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), F.col(frame).alias("_frame")))
        .unionByName(edge(end, 2))
        .withColumn("_tie", F.xxhash64("_frame", *interval_id))
    )
    hit = F.when(F.col("_kind") == 1, F.struct(F.col("_ts").alias("ts"), F.col("_frame").alias("f")))
    scanned = ordered_scan(
        with_time_tile(stream, "_ts", tile_width),
        keys,
        ["_ts", "_kind", "_frame", "_tie"],
        "_tile",
        {
            "_seen": running_sum((F.col("_kind") == 1).cast("long")),
            "_next": next_valid(hit),
            "_last": last_valid(hit),
        },
    )
    opening, closing = F.col("_kind") == 0, F.col("_kind") == 2
    ranges = (
        scanned.where(F.col("_kind") != 1)
        .groupBy(*keys, *interval_id)
        .agg(
            F.max(F.when(opening, F.col("_seen"))).alias("_before"),
            F.max(F.when(closing, F.col("_seen"))).alias("_upto"),
            F.max(F.when(opening, F.col("_next"))).alias("_first"),
            F.max(F.when(closing, F.col("_last"))).alias("_final"),
            F.max(F.when(opening, F.col("_ts"))).alias("_s"),
            F.max(F.when(closing, F.col("_ts"))).alias("_e"),
        )
    )
    found = F.col("_upto") > F.col("_before")
    first_ts, last_ts = F.col("_first.ts"), F.col("_final.ts")
    whole = (first_ts <= F.col("_s") + F.lit(tolerance)) & (last_ts >= F.col("_e") - F.lit(tolerance))
    covered = ranges.select(
        *keys,
        *interval_id,
        found.alias("has_overlap"),
        F.when(~found, "missing").when(whole, "complete").otherwise("partial").alias("coverage_status"),
        F.when(found, F.col("_first.f")).alias("start_frame_index"),
        F.when(found, F.col("_final.f") + 1).alias("end_frame_index_exclusive"),
        F.when(found, first_ts).alias("start_frame_ts"),
        F.when(found, last_ts).alias("end_frame_ts"),
        F.when(found, last_ts - first_ts).otherwise(F.lit(0).cast(ranges.schema["_s"].dataType)).alias("coverage_duration"),
        F.when(found, F.col("_upto") - F.col("_before")).otherwise(F.lit(0)).cast("long").alias("num_frames"),
    )
    blank = {"has_overlap": F.lit(False), "coverage_status": F.lit("missing"), "coverage_duration": F.lit(0), "num_frames": F.lit(0)}
    kinds = dict(covered.dtypes)
    missing = unbounded.select(*keys, *interval_id, *(blank.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in covered.columns[len(keys) + len(interval_id) :]))
    return covered.unionByName(missing)


def nearest_asof(
    targets: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str],
    target_id: Sequence[str],
    target_ts: str,
    ts: str,
    payload: Sequence[str],
    tile_width: float | None = None,
    tolerance: float | None = None,
    how: str = "inner",
    prefer: str = "earlier",
    within: tuple[str, str] | None = None,
) -> DataFrame:
    """Nearest candidate in time on either side of each target.

    ``within`` names two of the ``target_id`` columns that bound the candidate's time,
    ends included.

    Candidates sharing a time collapse to the one with the smallest payload. On an
    exact tie of gaps ``prefer='earlier'`` takes the earlier one, ``'payload'`` the
    smaller payload. Cost: one shuffle and sort of both sides, no pair expansion.
    """
    one_each = candidates.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_ts")).agg(
        F.min(F.struct(*payload)).alias("_pay")
    )
    blank = [F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in target_id]
    stream = (
        one_each.select(*keys, *blank, "_ts", F.lit(0).alias("_kind"), "_pay")
        .unionByName(
            targets.select(*keys, *target_id, F.col(target_ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast(one_each.schema["_pay"].dataType).alias("_pay"))
        )
        .withColumn("_tie", F.xxhash64(*target_id))
    )
    hit = F.when(F.col("_kind") == 0, F.struct("_ts", "_pay"))
    scanned = ordered_scan(
        with_time_tile(stream.where(F.col("_ts").isNotNull()), "_ts", tile_width),
        keys,
        ["_ts", "_kind", "_tie", *target_id],
        "_tile",
        {"_prev": last_valid(hit), "_next": next_valid(hit)},
    ).where(F.col("_kind") == 1)
    if within is not None:
        scanned = scanned.withColumn("_prev", F.when(F.col("_prev._ts") >= F.col(within[0]), F.col("_prev")))
        scanned = scanned.withColumn("_next", F.when(F.col("_next._ts") <= F.col(within[1]), F.col("_next")))
    back, ahead = F.col("_ts") - F.col("_prev._ts"), F.col("_next._ts") - F.col("_ts")
    closer = ahead < back
    if prefer == "payload":
        closer = closer | ((ahead == back) & (F.col("_next._pay") < F.col("_prev._pay")))
    pick = F.when(F.col("_prev").isNull(), F.col("_next")).when(F.col("_next").isNull(), F.col("_prev")).otherwise(
        F.when(closer, F.col("_next")).otherwise(F.col("_prev"))
    )
    out = scanned.select(*keys, *target_id, F.col("_ts").alias(target_ts), pick.alias("_hit")).withColumn(
        "gap", F.abs(F.col(target_ts) - F.col("_hit._ts"))
    )
    if tolerance is not None:
        out = out.withColumn("_hit", F.when(F.col("gap") <= F.lit(tolerance), F.col("_hit"))).withColumn(
            "gap", F.when(F.col("_hit").isNotNull(), F.col("gap"))
        )
    if how == "inner":
        out = out.where(F.col("_hit").isNotNull())
    return out.select(
        *keys, *target_id, target_ts, F.col("_hit._ts").alias("source_ts"), "gap", *[F.col(f"_hit._pay.{p}").alias(p) for p in payload]
    )


def intersect_streams(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Grid points both modalities matched, joined on the integer sample number."""
    return left.join(right, list(on), "inner")


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    signals: Sequence[str],
    label: str,
    rate_hz: float,
    tile_width: float | None = None,
    max_gap: float | None = None,
) -> DataFrame:
    """Regular grid per group: linear interpolation of signals, last label carried forward.

    The grid starts at the group's first sample. Grid points are made only between
    neighbouring samples, so a pause longer than ``max_gap`` can be left empty. A pause of any length is filled
    block by block.
    """
    step = F.lit(1.0 / rate_hz)
    here = F.struct(F.col(ts).alias("ts"), *signals, label)
    nxt = ordered_scan(
        with_time_tile(df, ts, tile_width),
        keys,
        [ts],
        "_tile",
        {"_next": following(here), "_t0": group_first(F.col(ts))},
    )
    # Grid points from this sample up to, not including, the next one; the last sample
    # keeps the point it falls on, if any.
    lo = F.ceil((F.col(ts) - F.col("_t0")) / step - F.lit(1e-9))
    hi = F.coalesce(F.ceil((F.col("_next.ts") - F.col("_t0")) / step - F.lit(1e-9)) - 1, F.floor((F.col(ts) - F.col("_t0")) / step + F.lit(1e-9)))
    points = nxt
    if max_gap is not None:
        points = points.where(F.col("_next").isNull() | (F.col("_next.ts") - F.col(ts) <= F.lit(max_gap)))
    grid = explode_range(points, lo, hi, "sample_idx").withColumn("grid_ts", F.col("_t0") + F.col("sample_idx") * step)
    share = F.when(
        F.col("_next").isNotNull(), (F.col("grid_ts") - F.col(ts)) / (F.col("_next.ts") - F.col(ts))
    ).otherwise(F.lit(0.0))
    return grid.select(
        *keys,
        "sample_idx",
        "grid_ts",
        *[(F.col(s) + (F.coalesce(F.col(f"_next.{s}"), F.col(s)) - F.col(s)) * share).alias(s) for s in signals],
        label,
    )
