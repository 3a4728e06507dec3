"""Sensor rows and two frame clocks to aligned task frames, in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.scalars import combined_status, processable
from sensorframe.operators.align import interval_ranges, intersect_streams, nearest_asof, target_grid
from sensorframe.operators.ordered import ROWS_PER_TILE
from sensorframe.operators.segments import task_segments
from sensorframe.session import materialise


def task_frame_manifest(
    segments: DataFrame, clocks: dict[str, DataFrame], keys: Sequence[str], task_key: str, tolerance_us: int, tile_us: int | None
) -> DataFrame:
    """Segments with each modality's frame range, coverage and the combined status.

    ``segments`` needs ``start_us`` and ``end_us``; clocks need ``frame_idx`` and ``ts_us``.
    """
    out = segments
    for name, clock in clocks.items():
        r = interval_ranges(segments, clock, keys, [task_key], "start_us", "end_us", "ts_us", "frame_idx", tolerance_us, tile_us)
        kept = [c for c in r.columns if c not in (*keys, task_key)]
        out = out.join(r.select(*keys, task_key, *[F.col(c).alias(f"{name}_{c}") for c in kept]), [*keys, task_key])
    status = combined_status(*[F.col(f"{n}_coverage_status") for n in clocks])
    overlap = F.lit(True)
    for n in clocks:
        overlap = overlap & F.col(f"{n}_has_overlap")
    return out.withColumn("combined_coverage_status", status).withColumn("both_modalities_have_overlap", overlap)


def aligned_task_frames(
    samples: DataFrame,
    clocks: dict[str, DataFrame],
    key: str,
    row: str,
    label: str,
    time: str,
    negatives: Iterable[str],
    positives: Iterable[str],
    rate_hz: float,
    grid_hz: float,
    coverage_tolerance_us: int,
    nearest_tolerance_us: int,
    tile_rows: int = ROWS_PER_TILE,
    tile_us: int | None = None,
    complete_only: bool = False,
) -> DataFrame:
    """Grid points of every processable task with the frame of each modality.

    Only times and indices move through the joins; pixels are fetched afterwards by
    frame index.
    """
    segs = task_segments(samples, [key], row, label, time, negatives, positives, rate_hz, tile_rows)
    segs = segs.withColumn("start_us", F.round(F.col("imu_task_start_ts") * 1e6).cast("long")).withColumn(
        "end_us", F.round(F.col("imu_task_end_ts") * 1e6).cast("long")
    )
    segs = segs.withColumn("task_key", F.concat_ws("__", key, "task_id", F.format_string("%02d", "task_segment_ordinal")))
    manifest = task_frame_manifest(
        segs.select(key, "task_key", "task_id", "stress_label", "start_us", "end_us"), clocks, [key], "task_key", coverage_tolerance_us, tile_us
    )
    usable = manifest.where(processable(F.col("both_modalities_have_overlap"), F.col("combined_coverage_status"), complete_only))
    # Stored once: both modalities search for the same grid points.
    grid = materialise(
        target_grid(usable.select(key, "task_key", "stress_label", "start_us", "end_us"), "start_us", "end_us", grid_hz / 1e6).withColumn(
            "target_us", F.round("target_ts").cast("long")
        ).drop("target_ts")
    )
    out = None
    for name, clock in clocks.items():
        carried = ["task_key", "sample_idx", "start_us", "end_us"]
        hit = nearest_asof(
            grid.select(key, *carried, "target_us"),
            clock.select(key, "ts_us", "frame_idx"),
            [key],
            carried,
            "target_us",
            "ts_us",
            ["frame_idx"],
            tile_us,
            nearest_tolerance_us,
            within=("start_us", "end_us"),
        )
        part = hit.select(
            "task_key", "sample_idx", F.col("frame_idx").alias(f"{name}_frame"), F.col("source_ts").alias(f"{name}_source_us")
        )
        out = part if out is None else intersect_streams(out, part, ["task_key", "sample_idx"])
    return grid.select(key, "task_key", "stress_label", "sample_idx", "target_us").join(out, ["task_key", "sample_idx"])
