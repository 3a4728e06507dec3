"""Count-based sliding windows, their quality, and subject-level window tables."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.operators.ordered import lookup_join, ordered_scan, row_position
from sensorframe.session import materialise


def assign_windows(df: DataFrame, pos: str, window: int, stride: int) -> DataFrame:
    """Repeat each row once per window covering it; ``window_no`` counts strides from 0.

    A row lies in at most ceil(window / stride) windows, so the growth is fixed.
    """
    p = F.col(pos)
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((p - F.lit(window - 1)) / F.lit(stride)).cast("long"))
    hi = F.floor(p / F.lit(stride)).cast("long")
    return df.where(hi >= lo).withColumn("window_no", F.explode(F.sequence(lo, hi)))


def sliding_windows(
    df: DataFrame, segment: Sequence[str], pos: str, row: str, window: int, stride: int, aggs: Sequence[Column] = ()
) -> DataFrame:
    """Full windows inside each segment; windows that run past its end are left out."""
    covered = assign_windows(df, pos, window, stride)
    return (
        covered.groupBy(*segment, "window_no")
        .agg(
            F.min(row).alias("start_row"),
            F.max(row).alias("end_row"),
            F.count(F.lit(1)).alias("num_rows"),
            *aggs,
        )
        .where(F.col("num_rows") == window)
    )


def segment_yield(df: DataFrame, segment: Sequence[str], window: int, stride: int) -> DataFrame:
    """Rows, windows and a short flag per segment."""
    n = F.count(F.lit(1))
    return df.groupBy(*segment).agg(
        n.alias("num_rows"),
        F.when(n < window, F.lit(0)).otherwise(F.floor((n - window) / stride) + 1).cast("long").alias("num_windows"),
        (n < window).alias("too_short"),
    )


def quality_aggs(axes: Sequence[str]) -> list[Column]:
    """Aggregates the window quality filter needs."""
    square = None
    finite = F.lit(True)
    for a in axes:
        square = F.col(a) * F.col(a) if square is None else square + F.col(a) * F.col(a)
        finite = finite & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != F.lit(float("inf")))
    return [
        F.bool_and(finite).alias("all_finite"),
        F.greatest(*[F.stddev_pop(a) for a in axes]).alias("max_axis_std"),
        F.stddev_pop(F.sqrt(square)).alias("magnitude_std"),
    ]


def passes_quality(min_axis_std: float = 1e-3, min_magnitude_std: float = 1e-3) -> Column:
    """Predicate over ``quality_aggs``."""
    return F.col("all_finite") & (F.col("max_axis_std") >= min_axis_std) & (F.col("magnitude_std") >= min_magnitude_std)


FEATURES = (
    "mean std min max ptp total energy rms skewness kurtosis p5 p25 p50 p75 p95 iqr n_above_mean n_below_mean n_sign_changes"
).split()


def window_features(df: DataFrame, window_keys: Sequence[str], pos: str, signals: Sequence[str], window: int | None = None) -> DataFrame:
    """Statistical features per window and signal, one row each.

    Groups are single windows, so their rows are few by construction. Non-finite
    results become 0. With ``window`` only full windows are kept.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals]))
    long = df.select(*window_keys, pos, pairs.alias("_p")).select(*window_keys, pos, "_p.signal", "_p.v")
    keys = [*window_keys, "signal"]
    order = Window.partitionBy(*keys).orderBy(pos)
    whole = Window.partitionBy(*keys)
    mean = F.avg("v").over(whole)
    rows = long.select(
        *keys,
        "v",
        F.count(F.lit(1)).over(whole).alias("_n"),
        (F.col("v") - mean).alias("_c"),
        (F.signum("v") * F.lag(F.signum("v")).over(order) < 0).alias("_flip"),
    )
    if window is not None:
        rows = rows.where(F.col("_n") == window)
    pct = F.percentile("v", F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    m2 = F.avg(F.col("_c") * F.col("_c"))
    got = rows.groupBy(*keys).agg(
        F.avg("v").alias("mean"),
        F.sqrt(m2).alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        (F.max("v") - F.min("v")).alias("ptp"),
        F.sum("v").alias("total"),
        F.sum(F.col("v") * F.col("v")).alias("energy"),
        F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
        F.try_divide(F.avg(F.pow("_c", F.lit(3.0))), F.pow(m2, F.lit(1.5))).alias("skewness"),
        (F.try_divide(F.avg(F.pow("_c", F.lit(4.0))), m2 * m2) - 3.0).alias("kurtosis"),
        pct.alias("_pct"),
        F.count_if(F.col("_c") > 0).alias("n_above_mean"),
        F.count_if(F.col("_c") < 0).alias("n_below_mean"),
        F.count_if("_flip").alias("n_sign_changes"),
    )
    for i, name in enumerate(("p5", "p25", "p50", "p75", "p95")):
        got = got.withColumn(name, F.col("_pct")[i])
    got = got.withColumn("iqr", F.col("p75") - F.col("p25"))

    return got.select(*keys, *[_tidy(c) for c in FEATURES])


#: Rows from which a pane is worth its own reduction.
PANE_ROWS = 16


def _pane(window: int, stride: int) -> int:
    """Rows of a pane: every window and every stride is a whole number of panes."""
    return gcd(window, stride)


def _moments(v: str) -> list[Column]:
    """Count, mean and the sums of the second to fourth powers of the deviations from it."""
    n, var = F.count(v), F.var_pop(v)
    return [
        n.cast("double").alias("n"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(var * n, F.lit(0.0)).alias("m2"),
        F.coalesce(F.when(var > 0, F.skewness(v) * n * F.pow(var, F.lit(1.5))), F.lit(0.0)).alias("m3"),
        F.coalesce(F.when(var > 0, (F.kurtosis(v) + 3.0) * n * var * var), F.lit(0.0)).alias("m4"),
    ]


def _merged(parts: Column) -> Column:
    """Moments of several panes together."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2", "m3", "m4")])

    def both(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        u = F.try_divide(d, n)
        joint = F.struct(
            n.alias("n"),
            (a["mean"] + u * b["n"]).alias("mean"),
            (a["m2"] + b["m2"] + d * u * a["n"] * b["n"]).alias("m2"),
            (a["m3"] + b["m3"] + d * u * u * a["n"] * b["n"] * (a["n"] - b["n"]) + 3.0 * u * (a["n"] * b["m2"] - b["n"] * a["m2"])).alias("m3"),
            (
                a["m4"]
                + b["m4"]
                + d * u * u * u * a["n"] * b["n"] * (a["n"] * a["n"] - a["n"] * b["n"] + b["n"] * b["n"])
                + 6.0 * u * u * (a["n"] * a["n"] * b["m2"] + b["n"] * b["n"] * a["m2"])
                + 4.0 * u * (a["n"] * b["m3"] - b["n"] * a["m3"])
            ).alias("m4"),
        )
        return F.when(b["n"] == 0, a).when(a["n"] == 0, F.struct(*[b[c].alias(c) for c in ("n", "mean", "m2", "m3", "m4")])).otherwise(joint)

    return F.aggregate(parts, zero, both)


def _at(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of a sorted array; null if it is empty."""
    pos = F.lit(p) * (F.size(values) - 1)
    lo, hi = F.get(values, F.floor(pos).cast("int")), F.get(values, F.ceil(pos).cast("int"))
    return F.when(F.size(values) > 0, lo + (hi - lo) * (pos - F.floor(pos)))


def pane_features(df: DataFrame, segment: Sequence[str], pos: str, signals: Sequence[str], window: int, stride: int) -> DataFrame:
    """The features of ``window_features`` for all full windows of ``window`` rows, every ``stride`` rows of a segment.

    Rows are reduced once, in panes of the greatest length that divides window and stride: moments, extremes, sign changes
    and a sorted run of values per signal. A window merges its panes, so no row is copied for each window and signal; what is sent on
    is one row per pane and window. ``pos`` counts a segment's rows from 0 without gaps.
    """
    g = _pane(window, stride)
    cell = [*segment, "_pane"]
    order = Window.partitionBy(*cell).orderBy(pos)
    rows = df.select(*segment, pos, F.floor(F.col(pos) / g).alias("_pane"), *[F.col(s).cast("double").alias(f"_v{i}") for i, s in enumerate(signals)])
    sign = [F.signum(f"_v{i}") for i in range(len(signals))]
    rows = rows.select("*", *[(x * F.lag(x).over(order) < 0).alias(f"_f{i}") for i, x in enumerate(sign)])
    aggs = []
    for i in range(len(signals)):
        v = f"_v{i}"
        aggs.append(
            F.struct(
                *_moments(v),
                F.sum(v).alias("total"),
                F.sum(F.col(v) * F.col(v)).alias("energy"),
                F.min_by(F.signum(v), pos).alias("first"),
                F.max_by(F.signum(v), pos).alias("last"),
                F.count_if(f"_f{i}").alias("flips"),
                F.sort_array(F.collect_list(v)).alias("values"),
            ).alias(f"_s{i}")
        )
    panes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    parts = [F.struct("_pane", *[f"_s{i}" for i in range(len(signals))])]
    windows = assign_windows(panes, "_pane", window // g, stride // g).groupBy(*segment, "window_no")
    windows = windows.agg(F.sum("_rows").alias("_rows"), F.array_sort(F.collect_list(*parts)).alias("_parts")).where(F.col("_rows") == window)

    def of(i: int) -> Column:
        return F.transform("_parts", lambda p: p[f"_s{i}"])

    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), of(i).alias("p")) for i, s in enumerate(signals)]))
    long = windows.select(*segment, "window_no", each.alias("_e")).select(*segment, "window_no", "_e.signal", F.col("_e.p").alias("_p"))
    long = long.select("*", _merged(F.col("_p")).alias("_m"), F.sort_array(F.flatten(F.transform("_p", lambda p: p["values"]))).alias("_all"))
    n, m2 = F.col("_m.n"), F.try_divide(F.col("_m.m2"), F.col("_m.n"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + F.coalesce(p["total"], F.lit(0.0)))
    energy = F.aggregate("_p", F.lit(0.0), lambda a, p: a + F.coalesce(p["energy"], F.lit(0.0)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("last"))
    flips = F.aggregate("_p", start, lambda a, p: F.struct((a["n"] + p["flips"] + F.coalesce((a["last"] * p["first"] < 0).cast("long"), F.lit(0))).alias("n"), p["last"].alias("last")))["n"]
    got = long.select(
        *segment,
        "window_no",
        "signal",
        F.when(n > 0, F.col("_m.mean")).alias("mean"),
        F.sqrt(m2).alias("std"),
        F.get("_all", F.lit(0)).alias("min"),
        F.try_element_at(F.col("_all"), F.lit(-1)).alias("max"),
        F.when(n > 0, total).alias("total"),
        F.when(n > 0, energy).alias("energy"),
        F.sqrt(F.try_divide(energy, n)).alias("rms"),
        F.try_divide(F.try_divide(F.col("_m.m3"), n), F.pow(m2, F.lit(1.5))).alias("skewness"),
        (F.try_divide(F.try_divide(F.col("_m.m4"), n), m2 * m2) - 3.0).alias("kurtosis"),
        *[_at(F.col("_all"), q).alias(name) for name, q in (("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))],
        F.size(F.filter("_all", lambda v: v > F.col("_m.mean"))).alias("n_above_mean"),
        F.size(F.filter("_all", lambda v: v < F.col("_m.mean"))).alias("n_below_mean"),
        flips.alias("n_sign_changes"),
    )
    got = got.withColumn("ptp", F.col("max") - F.col("min")).withColumn("iqr", F.col("p75") - F.col("p25"))
    return got.select(*segment, "window_no", "signal", *[_tidy(c) for c in FEATURES])


def _tidy(c: str) -> Column:
    """Numbers that are missing or not finite become 0."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x).alias(c)


def baseline_delta(
    features: DataFrame, baseline: DataFrame, subject: Sequence[str], columns: Sequence[str], mode: str = "both", absolute: bool = False
) -> DataFrame:
    """Features against the subject's mean over its reserved baseline windows."""
    means = baseline.groupBy(*subject).agg(*[F.avg(c).alias(f"_b_{c}") for c in columns])
    joined = lookup_join(features, means, subject, "inner")
    deltas = [(F.abs(F.col(c) - F.col(f"_b_{c}")) if absolute else F.col(c) - F.col(f"_b_{c}")).alias(f"{c}_delta") for c in columns]
    raw = [c for c in features.columns if c not in columns]
    if mode == "raw":
        return joined.select(*features.columns)
    if mode == "delta":
        return joined.select(*raw, *deltas)
    if mode == "both":
        return joined.select(*features.columns, *deltas)
    raise ValueError(f"unknown mode {mode!r}")


def _mask_stats_by_rows(track: DataFrame, task: Sequence[str], frame: str, window: int, stride: int) -> DataFrame:
    """``mask_window_stats`` with a copy of every frame per window."""
    covered = assign_windows(track, frame, window, stride)
    keys = [*task, "window_no"]
    area = F.col("mask_area_fraction").cast("double")
    finite = F.when(~F.isnan(area) & (F.abs(area) != F.lit(float("inf"))), area)
    order = Window.partitionBy(*keys).orderBy(frame)
    before = F.last(finite, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = covered.withColumn("_area", finite).withColumn("_jump", F.abs(finite - before))
    n = F.count(F.lit(1))
    source = F.col("mask_source")
    return (
        rows.groupBy(*keys)
        .agg(
            n.alias("num_frames"),
            F.count_if(source == 0).alias("missing_mask_frames"),
            (F.count_if(source == 0) / n).alias("missing_mask_fraction"),
            (F.count_if(source == 1) / n).alias("mask_direct_fraction"),
            (F.count_if(source == 2) / n).alias("mask_carry_fraction"),
            F.avg("_area").alias("mask_area_mean"),
            F.percentile("_area", F.lit(0.5)).alias("mask_area_median"),
            F.stddev_pop("_area").alias("mask_area_std"),
            F.coalesce(F.percentile("_jump", F.lit(0.95)), F.lit(0.0)).alias("mask_area_jump_p95"),
            F.max(F.col("mask_age_frames").cast("double")).alias("mask_age_max"),
            F.avg(F.col("yolo_box_count").cast("double")).alias("yolo_box_mean"),
        )
        .where(F.col("num_frames") == window)
        .drop("num_frames")
    )


def mask_window_stats(track: DataFrame, task: Sequence[str], frame: str, window: int, stride: int) -> DataFrame:
    """Mask statistics per full window of a task's frames (frame index dense from 0).

    Frames are reduced once, in panes as in ``pane_features``. A jump of the area reaches from a finite area to the next one in
    the window, over frames without one; those inside a pane are kept by the pane, those between panes are found when they merge.
    """
    g = _pane(window, stride)
    if g < PANE_ROWS:
        return _mask_stats_by_rows(track, task, frame, window, stride)
    cell = [*task, "_pane"]
    area = F.col("mask_area_fraction").cast("double")
    finite = F.when(~F.isnan(area) & (F.abs(area) != F.lit(float("inf"))), area)
    order = Window.partitionBy(*cell).orderBy(frame)
    rows = track.select("*", F.floor(F.col(frame) / g).alias("_pane"), finite.alias("_area"))
    before = F.last("_area", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_jump", F.abs(F.col("_area") - before))
    source, known = F.col("mask_source"), F.when(F.col("_area").isNotNull(), F.col(frame))
    panes = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.count_if(source == code).alias(name) for code, name in enumerate(("missing", "direct", "carry"))],
        F.struct(*_moments("_area")).alias("m"),
        F.sort_array(F.collect_list("_area")).alias("areas"),
        F.collect_list("_jump").alias("jumps"),
        F.min_by("_area", known).alias("first"),
        F.max_by("_area", known).alias("last"),
        F.max(F.col("mask_age_frames").cast("double")).alias("age"),
        F.sum(F.col("yolo_box_count").cast("double")).alias("boxes"),
        F.count("yolo_box_count").alias("counted"),
    )
    part = F.struct("_pane", "m", "areas", "jumps", "first", "last")
    windows = assign_windows(panes, "_pane", window // g, stride // g).groupBy(*task, "window_no").agg(
        F.sum("frames").alias("_n"),
        *[F.sum(c).alias(f"_{c}") for c in ("missing", "direct", "carry", "boxes", "counted")],
        F.max("age").alias("mask_age_max"),
        F.array_sort(F.collect_list(part)).alias("_p"),
    )
    windows = windows.where(F.col("_n") == window)
    start = F.struct(F.array().cast("array<double>").alias("jumps"), F.lit(None).cast("double").alias("last"))

    def reach(a: Column, p: Column) -> Column:
        between = F.abs(p["first"] - a["last"])
        jumps = F.concat(a["jumps"], p["jumps"], F.when(between.isNotNull(), F.array(between)).otherwise(F.array().cast("array<double>")))
        return F.struct(jumps.alias("jumps"), F.coalesce(p["last"], a["last"]).alias("last"))

    merged = windows.select(
        "*",
        _merged(F.transform("_p", lambda p: p["m"])).alias("_m"),
        F.sort_array(F.flatten(F.transform("_p", lambda p: p["areas"]))).alias("_areas"),
        F.sort_array(F.aggregate("_p", start, reach)["jumps"]).alias("_jumps"),
    )
    n, some = F.col("_n"), F.col("_m.n") > 0
    return merged.select(
        *task,
        "window_no",
        F.col("_missing").alias("missing_mask_frames"),
        (F.col("_missing") / n).alias("missing_mask_fraction"),
        (F.col("_direct") / n).alias("mask_direct_fraction"),
        (F.col("_carry") / n).alias("mask_carry_fraction"),
        F.when(some, F.col("_m.mean")).alias("mask_area_mean"),
        _at(F.col("_areas"), 0.5).alias("mask_area_median"),
        F.when(some, F.sqrt(F.try_divide(F.col("_m.m2"), F.col("_m.n")))).alias("mask_area_std"),
        F.coalesce(_at(F.col("_jumps"), 0.95), F.lit(0.0)).alias("mask_area_jump_p95"),
        "mask_age_max",
        F.try_divide(F.col("_boxes"), F.col("_counted")).alias("yolo_box_mean"),
    )


MASK_DEFAULTS = {
    "missing_mask_fraction": 1.0,
    "mask_direct_fraction": 0.0,
    "mask_carry_fraction": 0.0,
}


def attach_mask_stats(windows: DataFrame, stats: DataFrame, on: Sequence[str], window: int) -> DataFrame:
    """Left join of mask statistics; windows without a mask task count as all missing."""
    joined = windows.join(stats, list(on), "left")
    filled = F.coalesce(F.col("missing_mask_frames"), F.lit(window).cast("long"))
    out = joined.withColumn("missing_mask_frames", filled)
    for c, value in MASK_DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)))
    return out


def quality_tier(
    window: int,
    max_missing_fraction: float = 0.5,
    max_missing_frames: int | None = None,
    min_area: float = 0.02,
    max_area: float = 0.85,
    max_age: float = 15.0,
    nonzero: Sequence[str] = (),
) -> Column:
    """``struct(tier, reason)`` from mask statistics: ordered drop rules, then tiers."""
    cap = max_missing_frames if max_missing_frames is not None else int(max_missing_fraction * window)
    area, age = F.col("mask_area_mean"), F.col("mask_age_max")
    missing, direct = F.col("missing_mask_fraction"), F.col("mask_direct_fraction")
    jump = F.coalesce(F.col("mask_area_jump_p95"), F.lit(float("inf")))

    def verdict(tier: str, reason: Column | str) -> Column:
        return F.struct(F.lit(tier).alias("tier"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    rule = (
        F.when(F.col("missing_mask_frames") > cap, verdict("drop", f"missing_mask_frames>{cap}"))
        .when(missing > max_missing_fraction, verdict("drop", f"missing_mask_fraction>{max_missing_fraction:g}"))
        .when(area.isNull() | F.isnan(area) | (F.abs(area) == F.lit(float("inf"))), verdict("drop", "mask_area_mean_not_finite"))
        .when(area < min_area, verdict("drop", f"mask_area_mean<{min_area:g}"))
        .when(area > max_area, verdict("drop", f"mask_area_mean>{max_area:g}"))
        .when(~F.isnan(age) & (age > max_age), verdict("drop", f"mask_age_max>{int(max_age)}"))
    )
    for c in nonzero:
        rule = rule.when(F.col(c) <= 0.001, verdict("drop", f"{c}<=0.001"))
    # Tier limits on missing share, direct share, age and area jump.
    for tier, m, d, a, j in (("clean", 0.10, 0.70, 10, 0.20), ("usable", 0.25, 0.50, 15, 0.25), ("inspect", 0.50, 0.25, 15, 0.35)):
        rule = rule.when((missing <= m) & (direct >= d) & (age <= a) & (jump <= j), verdict(tier, ""))
    text = F.concat(
        F.lit("tier_threshold_failed:missing="),
        F.format_string("%.3f", missing),
        F.lit(",direct="),
        F.format_string("%.3f", direct),
        F.lit(",age="),
        F.format_string("%.1f", F.coalesce(age, F.lit(float("nan")))),
        F.lit(",jump_p95="),
        F.format_string("%.3f", jump),
    )
    return rule.otherwise(verdict("drop", text))


def reject_reason(tier: Column, reason: Column, allowed: Sequence[str]) -> Column:
    """Empty when kept; windows of tiers not allowed gain a reason."""
    return F.when((reason == "") & ~tier.isin(*allowed), F.concat(F.lit("mask_quality_tier_not_allowed:"), tier)).otherwise(reason)


def drop_bucket(reason: Column) -> Column:
    """Counter a reject reason falls into; null when the window is kept."""
    return (
        F.when(reason == "", F.lit(None).cast("string"))
        .when(reason.startswith("missing_mask"), "missing_mask")
        .when(reason.startswith("mask_area"), "mask_area")
        .when(reason.startswith("mask_age"), "mask_age")
        .when(reason.startswith("mask_quality_tier"), "mask_quality_tier")
        .otherwise("other")
    )


def drop_summary(tasks: DataFrame, windows: DataFrame, task: Sequence[str], length: str, window: int) -> DataFrame:
    """Per task: candidates, kept, drops by reason, tiers. Tasks without windows stay."""
    bucket = drop_bucket(F.col("reason"))
    counted = windows.groupBy(*task).agg(
        F.count(F.lit(1)).alias("candidate_windows"),
        F.count_if(F.col("reason") == "").alias("kept_windows"),
        F.count_if(bucket == "missing_mask").alias("dropped_missing_mask_windows"),
        F.count_if(bucket == "mask_area").alias("dropped_mask_area_windows"),
        F.count_if(bucket == "mask_age").alias("dropped_mask_age_windows"),
        F.count_if(bucket == "mask_quality_tier").alias("dropped_mask_quality_tier_windows"),
        F.count_if(bucket == "other").alias("dropped_other_mask_quality_windows"),
        *[F.count_if(F.col("tier") == x).alias(f"{y}_windows") for x, y in (("clean", "clean"), ("usable", "usable"), ("inspect", "inspect"), ("drop", "drop_tier"))],
    )
    names = [c for c in counted.columns if c not in task]
    joined = tasks.join(counted, list(task), "left")
    return joined.select(
        *task,
        (F.col(length) < window).cast("long").alias("dropped_short_task"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names],
    )


def subject_inclusion(windows: DataFrame, subject: str, label: str, task: str) -> DataFrame:
    """Which subjects hold both labels, with counts, task list and reason."""
    got = windows.groupBy(subject).agg(
        F.count(F.lit(1)).alias("num_windows"),
        F.count_if(F.col(label) == 0).alias("label_0_windows"),
        F.count_if(F.col(label) == 1).alias("label_1_windows"),
        F.array_join(F.array_sort(F.collect_set(task)), ",").alias("tasks"),
    )
    has0, has1 = F.col("label_0_windows") > 0, F.col("label_1_windows") > 0
    missing = F.when(~has0 & ~has1, "0, 1").when(~has0, "0").otherwise("1")
    return got.withColumn("keep", has0 & has1).withColumn(
        "reason", F.when(F.col("keep"), "included").otherwise(F.concat(F.lit("missing_label_["), missing, F.lit("]")))
    )


def qualified_only(windows: DataFrame, subject: str, label: str) -> DataFrame:
    """Windows of subjects whose labels are exactly 0 and 1."""
    good = windows.groupBy(subject).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    good = good.where((F.col("_lo") == 0) & (F.col("_hi") == 1)).select(subject)
    return lookup_join(windows, good, [subject], "inner")


def reserve_baseline(
    windows: DataFrame, subject: str, task: str, baseline: str, order: Sequence[str], window_id: str, k: int
) -> tuple[DataFrame, DataFrame]:
    """First ``k`` baseline windows per subject, and the other windows of those subjects.

    Subjects with fewer than ``k`` baseline windows leave both results; ``short_baselines`` lists
    them. The rank filter lets Spark keep only ``k`` rows per subject before the shuffle.
    """
    first = windows.where(F.col(task) == baseline).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(subject).orderBy(*order))
    ).where(F.col("_rank") <= k)
    enough = first.groupBy(subject).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select(subject)
    reserved = first.drop("_rank").join(enough, subject, "left_semi")
    rest = lookup_join(windows, enough, [subject], "inner", salt_on=[window_id]).join(
        reserved.select(window_id), window_id, "left_anti"
    )
    return reserved, rest.select(*windows.columns)


def short_baselines(windows: DataFrame, subject: str, task: str, baseline: str, k: int) -> DataFrame:
    """Subjects that ``reserve_baseline`` drops, with the number of baseline windows they have."""
    found = F.count_if(F.col(task) == baseline)
    return windows.groupBy(subject).agg(found.alias("num_baseline_windows")).where(F.col("num_baseline_windows") < k)


def trailing_context(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], length: int, tile: Column) -> DataFrame:
    """Last ``length`` rows up to each row, one row per slot; missing slots are absent.

    Each row is sent to the ``length`` positions that see it, so a long group is
    split by position and never gathered.
    """
    placed = materialise(ordered_scan(df, keys, [order], tile, {"pos": row_position()}))
    reach = placed.select(*keys, F.col("pos").alias("_src"), *values).withColumn(
        "_ahead", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))
    )
    seen = reach.select(
        *keys, (F.col("_src") + F.col("_ahead")).alias("pos"), (F.lit(length - 1) - F.col("_ahead")).cast("long").alias("slot"), *values
    )
    return placed.select(*keys, order, "pos").join(seen, [*keys, "pos"], "inner")


def context_arrays(slots: DataFrame, keys: Sequence[str], value: str, length: int, zero: Column) -> DataFrame:
    """``sequence`` and 0/1 ``mask`` arrays of fixed length, zero-padded on the left."""
    got = slots.groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct("slot", F.col(value).alias("v")))).alias("_s"))
    pad = F.lit(length) - F.size("_s")
    return got.select(
        *keys,
        "pos",
        F.concat(F.array_repeat(zero, pad), F.transform("_s", lambda s: s["v"])).alias("sequence"),
        F.concat(F.array_repeat(F.lit(0.0), pad), F.array_repeat(F.lit(1.0), F.size("_s"))).alias("mask"),
    )


def balanced_sample(
    df: DataFrame, label: str, subject: str, order: Sequence[str], n: int, tile: Column
) -> DataFrame:
    """First ``n`` rows taking turns over (label, subject) groups."""
    ranked = ordered_scan(df, [label, subject], order, tile, {"_rank": row_position()})
    return ranked.orderBy("_rank", label, subject, *order).limit(n).drop("_rank")


def window_catalogue(segments: DataFrame, length: str, window: int, stride: int) -> DataFrame:
    """Window start and end per segment, from lengths alone."""
    n = F.col(length)
    return (
        segments.where(n >= window)
        .withColumn("window_start", F.explode(F.sequence(F.lit(0).cast("long"), (n - window).cast("long"), F.lit(stride).cast("long"))))
        .withColumn("window_end", F.col("window_start") + window)
    )


