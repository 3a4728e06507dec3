"""Vector tables: standardisers, pooling, frame selection, baseline-relative forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions.arrays import (
    cosine_distance,
    doubles,
    floor_std,
    information_score,
    mean_squared,
    range_unit,
    signed_unit,
    soft_kl,
    zscore,
)
from sensorframe.operators.ordered import lookup_join
from sensorframe.operators.quantiles import exact_quantiles

__all__ = ["zscore"]


def long_form(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per vector element: ``dim`` and ``v``."""
    return df.select(*keys, F.posexplode(doubles(F.col(value))).alias("dim", "v"))


def dimension_stats(df: DataFrame, keys: Sequence[str], value: str, eps: float = 1e-4) -> DataFrame:
    """Mean and floored population std per dimension, in double.

    Elements are aggregated on the map side by (keys, dim), so what is shuffled is
    one row per task, group and dimension.
    """
    return long_form(df, keys, value).groupBy(*keys, "dim").agg(
        F.avg("v").alias("mean"), floor_std(F.stddev_pop("v"), eps).alias("std"), F.count(F.lit(1)).alias("n")
    )


def as_arrays(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimension rows to ``mean`` and ``std`` arrays; a group has one row per dimension."""
    packed = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    got = stats.groupBy(*keys).agg(packed.alias("_s"))
    return got.select(*keys, F.transform("_s", lambda s: s["mean"]).alias("mean"), F.transform("_s", lambda s: s["std"]).alias("std"))


def _overall(df: DataFrame, value: str, eps: float) -> Column:
    """Statistics of the whole table as a scalar subquery: one row, no join."""
    return as_arrays(dimension_stats(df, [], value, eps), []).select(F.struct("mean", "std")).scalar()


def capped_sample(df: DataFrame, keys: Sequence[str], row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per group in seeded hash order; the rank filter prunes before the shuffle."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, row_id))
    return df.withColumn("_k", rank).where(F.col("_k") <= n).drop("_k")


def subject_standardise(
    df: DataFrame, population: DataFrame, subject: str, window: str, value: str, min_windows: int = 3, eps: float = 1e-4, salt_on: Sequence[str] = ()
) -> DataFrame:
    """Z-score by the subject's own statistics, or the population's below ``min_windows``.

    ``population`` holds the training rows. Adds ``fallback``.
    """
    own = as_arrays(dimension_stats(df, [subject], value, eps), [subject])
    sizes = df.groupBy(subject).agg(F.countDistinct(window).alias("_windows"))
    pop = _overall(population, value, eps)
    enough = F.col("_windows") >= min_windows
    facts = own.join(sizes, subject).select(
        subject,
        F.when(enough, F.col("mean")).otherwise(pop["mean"]).alias("_m"),
        F.when(enough, F.col("std")).otherwise(pop["std"]).alias("_d"),
        (~enough).alias("fallback"),
    )
    joined = lookup_join(df, facts, [subject], "inner", salt_on=salt_on)
    return joined.withColumn(value, zscore(doubles(F.col(value)), F.col("_m"), F.col("_d"))).drop("_m", "_d")


def population_standardise(df: DataFrame, population: DataFrame, value: str, eps: float = 1e-4) -> DataFrame:
    """Z-score by the training rows' statistics."""
    pop = _overall(population, value, eps)
    placed = df.withColumn("_p", pop)
    return placed.withColumn(value, zscore(doubles(F.col(value)), F.col("_p.mean"), F.col("_p.std"))).drop("_p")


def fallback_count(df: DataFrame, subject: str, window: str, min_windows: int = 3) -> DataFrame:
    """Number of subjects that use population statistics."""
    sizes = df.groupBy(subject).agg(F.countDistinct(window).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_subjects"), F.count_if(F.col("n") < min_windows).alias("n_fallback_subjects"))


def baseline_stats(df: DataFrame, subject: Sequence[str], axes: Sequence[str], salt_on: Sequence[str]) -> DataFrame:
    """Mean, mean absolute deviation from it, and population std per subject and axis."""
    means = df.groupBy(*subject).agg(*[F.avg(a).alias(f"_m_{a}") for a in axes])
    joined = lookup_join(df, means, subject, "inner", salt_on=salt_on)
    aggs: list[Column] = []
    for a in axes:
        aggs += [
            F.max(f"_m_{a}").alias(f"{a}_mean"),
            F.avg(F.abs(F.col(a) - F.col(f"_m_{a}"))).alias(f"{a}_mad"),
            F.stddev_pop(a).alias(f"{a}_std"),
        ]
    return joined.groupBy(*subject).agg(*aggs)


def reserved_baseline_stats(
    covered: DataFrame, reserved: DataFrame, window_keys: Sequence[str], subject: Sequence[str], axes: Sequence[str], salt_on: Sequence[str]
) -> DataFrame:
    """``baseline_stats`` over the rows of reserved windows: a row in two of them counts twice, as the windows do.

    ``covered`` holds rows with the keys of their windows (``assign_windows``), ``reserved`` the windows that
    ``reserve_baseline`` sets aside, a bounded number per subject.
    """
    rows = covered.select(*window_keys, *axes, *[c for c in salt_on if c not in window_keys]).join(reserved.select(*window_keys), list(window_keys), "left_semi")
    return baseline_stats(rows, subject, axes, salt_on)


# The twelve baseline-relative modes as (append to raw, absolute, scale).
BASELINE_MODES = {
    "raw_delta": (True, False, None),
    "raw_absdelta": (True, True, None),
    "delta_only": (False, False, None),
    "absdelta_only": (False, True, None),
    "raw_zdelta": (True, False, "std"),
    "raw_abs_zdelta": (True, True, "std"),
    "zdelta_only": (False, False, "std"),
    "abs_zdelta_only": (False, True, "std"),
    "raw_mad_delta": (True, False, "mad"),
    "raw_abs_mad_delta": (True, True, "mad"),
    "mad_delta_only": (False, False, "mad"),
    "abs_mad_delta_only": (False, True, "mad"),
}


def baseline_relative(axes: Sequence[str], mode: str, eps: float = 1e-6) -> Column:
    """Array of a sample's channels relative to its subject's baseline columns."""
    if mode not in BASELINE_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    with_raw, absolute, scale = BASELINE_MODES[mode]

    def channel(a: str) -> Column:
        d = F.col(a) - F.col(f"{a}_mean")
        d = F.abs(d) if absolute else d
        return d / (F.col(f"{a}_{scale}") + F.lit(eps)) if scale else d

    changed = F.array(*[channel(a) for a in axes])
    return F.concat(F.array(*[F.col(a).cast("double") for a in axes]), changed) if with_raw else changed


def mean_pool(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Elementwise mean of a group's vectors."""
    got = long_form(df, keys, value).groupBy(*keys, "dim").agg(F.avg("v").alias("v"))
    return got.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("_a")).select(
        *keys, F.transform("_a", lambda s: s["v"]).alias(value)
    )


def segment_pool(df: DataFrame, keys: Sequence[str], pos: str, value: str, segments: int, length: int | None = None) -> DataFrame:
    """Mean over ``segments`` integer stretches of a window's positions (at least one position each).

    With ``length`` every window has that many positions, also one whose rows are not all there; without it, as many as rows.
    """
    n, t = F.lit(length) if length is not None else F.col("_n"), F.col(pos)

    def holds(i: Column) -> Column:
        lo = F.floor(i * n / segments)
        return (t >= lo) & (t < F.greatest(F.floor((i + 1) * n / segments), lo + 1))

    rows = df
    if length is None:
        rows = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))  # one window: a bounded number of rows
    rows = rows.withColumn("segment", F.explode(F.filter(F.sequence(F.lit(0), F.lit(segments - 1)), holds)))
    return long_form(rows, [*keys, "segment"], value).groupBy(*keys, "segment", "dim").agg(F.avg("v").alias("v"))


def scored_frames(df: DataFrame, value: str, method: str = "shannon", standardised: bool = False, scope: Sequence[str] = ()) -> DataFrame:
    """Add ``info``; with ``standardised`` vectors are z-scored per scope for scoring only."""
    x = doubles(F.col(value))
    if not standardised:
        return df.withColumn("info", information_score(x, method))

    def unit(std: Column) -> Column:
        return F.transform(std, lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))

    if not scope:
        placed = df.withColumn("_p", _overall(df, value, 0.0))
        return placed.withColumn("info", information_score(zscore(x, F.col("_p.mean"), unit(F.col("_p.std"))), method)).drop("_p")
    stats = as_arrays(dimension_stats(df, scope, value, 0.0), scope)
    joined = lookup_join(df, stats, scope)
    return joined.withColumn("info", information_score(zscore(x, F.col("mean"), unit(F.col("std"))), method)).drop("mean", "std")


def short_windows(df: DataFrame, window: Sequence[str], k: int) -> DataFrame:
    """Windows with fewer than ``k`` frames and how many they have: the dead letters of ``top_k_frames``."""
    return df.groupBy(*window).agg(F.count(F.lit(1)).alias("num_frames")).where(F.col("num_frames") < k)


def top_k_frames(df: DataFrame, window: Sequence[str], frame: str, k: int, strict: bool = False) -> DataFrame:
    """The ``k`` highest ``info`` frames per window, numbered again in time order.

    Equal scores prefer the later frame. A window with fewer than ``k`` frames is left to
    ``short_windows``, or an error if ``strict``. A window holds a bounded number of frames.
    """
    by_score = Window.partitionBy(*window).orderBy(F.col("info").desc(), F.col(frame).desc())
    rows = df.withColumn("_r", F.row_number().over(by_score)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*window)))
    short = F.raise_error(F.lit(f"window has fewer than {k} frames")) if strict else F.lit(None)
    rows = rows.withColumn("_r", F.when(F.col("_n") >= k, F.col("_r")).otherwise(short.cast("int"))).where(F.col("_r") <= k)
    in_time = Window.partitionBy(*window).orderBy(frame)
    return rows.withColumn("slot", F.row_number().over(in_time) - 1).drop("_r", "_n")


def robust_scale(df: DataFrame, window: Sequence[str], value: str, signed: bool) -> DataFrame:
    """Scale a window's pixels to [0, 1] by its own exact percentiles.

    Percentiles come from refined histograms, so a window of any number of frames and pixels spreads over tasks. Null and
    non-finite pixels do not count; a window without any has no scale and keeps null pixels.
    """
    finite = F.filter(doubles(F.col(value)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    if signed:
        long = df.select(*window, F.explode(finite).alias("_px"))
        stats = exact_quantiles(long, window, F.abs("_px"), {"_p": 0.98})
        joined = df.join(stats, list(window), "left")
        return joined.withColumn(value, F.transform(doubles(F.col(value)), lambda x: signed_unit(x, F.col("_p")))).drop("_p")
    inked = df.select(*window, F.explode(F.filter(finite, lambda x: F.abs(x) > 0)).alias("_px"))
    bounds = exact_quantiles(inked, window, "_px", {"_lo": 0.02, "_hi": 0.98})
    plain = df.groupBy(*window).agg(F.min(F.array_min(finite)).alias("_min"), F.max(F.array_max(finite)).alias("_max"))
    stats = plain.join(bounds, list(window), "left").select(*window, F.coalesce("_lo", "_min").alias("_lo"), F.coalesce("_hi", "_max").alias("_hi"))
    joined = df.join(stats, list(window))
    return joined.withColumn(
        value, F.transform(doubles(F.col(value)), lambda x: range_unit(x, F.col("_lo"), F.col("_hi")))
    ).drop("_lo", "_hi")


def agreement(pairs: DataFrame, keys: Sequence[str], left: str, right: str, temperature: float = 2.0, logits: tuple[str, str] | None = None) -> DataFrame:
    """Mean cosine distance, mean squared difference and tempered KL over paired vectors.

    The KL is taken over the whole vectors, or over the two columns ``logits`` names.
    """
    a, b = doubles(F.col(left)), doubles(F.col(right))
    la, lb = (doubles(F.col(c)) for c in logits) if logits else (a, b)
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(cosine_distance(a, b)).alias("cosine_distance"),
        F.avg(mean_squared(a, b)).alias("mse"),
        F.avg(soft_kl(la, lb, temperature)).alias("soft_kl"),
    )
