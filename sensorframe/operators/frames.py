"""Frame streams: carry-forward masks, frame differences, baselines, layout jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.arrays import (
    clipped_difference,
    doubles,
    edge_map,
    lag_abs_difference,
    lag_difference,
    malformed_frame,
    normalise_frame,
)
from sensorframe.operators.ordered import last_valid, lookup_join, ordered_scan
from sensorframe.sources.io import dead_letters


def carry_forward(
    df: DataFrame, keys: Sequence[str], frame: str, valid: Column, payload: Sequence[str], max_age: int, tile: Column
) -> DataFrame:
    """Payload of the last valid frame, while it is at most ``max_age`` frames old.

    Adds ``mask_source`` (1 own, 2 carried, 0 missing) and ``mask_age_frames`` (-1 missing).
    """
    mark = F.when(valid, F.struct(F.col(frame).alias("f"), *payload))
    scanned = ordered_scan(df.withColumn("_ok", F.coalesce(valid, F.lit(False))), keys, [frame], tile, {"_last": last_valid(mark)})
    age = F.col(frame) - F.col("_last.f")
    usable = F.coalesce(age <= max_age, F.lit(False))
    out = scanned.withColumn("mask_source", F.when(F.col("_ok"), 1).when(usable, 2).otherwise(0)).withColumn(
        "mask_age_frames", F.when(usable, age).otherwise(F.lit(-1)).cast("long")
    )
    for p in payload:
        out = out.withColumn(f"carried_{p}", F.when(usable, F.col(f"_last.{p}")))
    return out.drop("_ok", "_last")


def with_earlier(df: DataFrame, keys: Sequence[str], frame: str, value: str, k: int) -> DataFrame:
    """Add the vector ``k`` frames earlier as ``_before``.

    An equi-join on (keys, frame index), unique and evenly spread: pixel arrays are
    never carried through an ordered window.
    """
    earlier = df.select(*keys, (F.col(frame) + k).alias(frame), F.col(value).alias("_before"))
    return df.join(earlier, [*keys, frame], "left")


def previous_difference(df: DataFrame, keys: Sequence[str], frame: str, value: str) -> DataFrame:
    """Replace each frame by its difference from the one before."""
    j = with_earlier(df, keys, frame, value, 1)
    return j.withColumn(value, lag_difference(doubles(F.col(value)), doubles(F.col("_before")))).drop("_before")


def lag_magnitude(df: DataFrame, keys: Sequence[str], frame: str, value: str, k: int, clamp: float) -> DataFrame:
    """Replace each frame by its clamped absolute difference from ``k`` frames before."""
    j = with_earlier(df, keys, frame, value, k)
    return j.withColumn(value, lag_abs_difference(doubles(F.col(value)), doubles(F.col("_before")), clamp)).drop("_before")


def baseline_frame(df: DataFrame, keys: Sequence[str], frame: str, value: str, frames: int) -> DataFrame:
    """Elementwise mean of a stream's first ``frames`` frames, one row per element."""
    from sensorframe.operators.vectors import long_form

    return long_form(df.where(F.col(frame) < frames), keys, value).groupBy(*keys, "dim").agg(F.avg("v").alias("v"))


def baseline_difference(
    df: DataFrame, base: DataFrame, keys: Sequence[str], value: str, low: float = -32768, high: float = 32767, salt_on: Sequence[str] = ()
) -> DataFrame:
    """Frame minus baseline mean, clipped."""
    packed = base.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("_a"))
    packed = packed.select(*keys, F.transform("_a", lambda s: s["v"]).alias("_base"))
    j = lookup_join(df, packed, keys, "inner", salt_on=salt_on)
    return j.withColumn(value, clipped_difference(doubles(F.col(value)), F.col("_base"), low, high)).drop("_base")


def edge_energy(df: DataFrame, keys: Sequence[str], value: str, height: int, width: int, clamp: float, gamma: float, mask: Column | None = None) -> DataFrame:
    """Mean edge strength per frame; outside the mask counts as 0."""
    e = edge_map(doubles(F.col(value)), height, width, clamp, gamma)
    if mask is not None:
        e = F.zip_with(e, mask, lambda x, m: F.when(m, x).otherwise(F.lit(0.0)))
    return df.select(*keys, (F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / F.lit(float(height * width))).alias("edge_energy"))


def normalise_frames(df: DataFrame, value: str, layout: str, h: str, w: str, c: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Mixed frame layouts to one, and the rows whose shape does not fit."""
    args = (F.col(value), F.col(layout), F.col(h), F.col(w), F.col(c))
    good, bad = dead_letters(df, [(malformed_frame(*args), "bad_shape")])
    return good.withColumn(value, normalise_frame(*args, size)), bad
