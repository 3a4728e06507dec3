"""Column functions over numeric arrays: masks, scores, scaling, edges, layouts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    """Array elements as doubles."""
    return a.cast("array<double>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: a lambda that names an expression works it out for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def array_sum(a: Column) -> Column:
    """Sum of elements."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def apply_mask(px: Column, mask: Column) -> Column:
    """Zero where the mask is false."""
    return F.zip_with(px, mask, lambda x, m: F.when(m, x).otherwise(F.lit(0.0)))


def mask_area(mask: Column) -> Column:
    """Share of true elements."""
    return F.size(F.filter(mask, lambda m: m)) / F.size(mask)


def valid_area(area: Column, low: float, high: float) -> Column:
    """Area within both bounds, bounds included."""
    return (area >= low) & (area <= high)


def zscore(a: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std elementwise."""
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def floor_std(std: Column, eps: float = 1e-4) -> Column:
    """A spread below ``eps`` counts as 1, so constant dimensions pass through."""
    return F.when(std < eps, F.lit(1.0)).otherwise(std)


def information_score(a: Column, method: str = "shannon", normalise: str = "l2") -> Column:
    """How informative a vector is.

    ``shannon``: -sum(p ln p) with p = abs(x) over its L2 norm (``l1`` for weights that
    sum to one). ``diversity``: the Euclidean length.
    """
    if method == "diversity":
        return norm(a)
    if method != "shannon":
        raise ValueError(f"unknown method {method!r}")
    size = F.transform(a, lambda x: F.abs(x))
    scale = norm(size) if normalise == "l2" else array_sum(size)
    share = bound(scale, lambda by: F.transform(size, lambda x: x / (by + F.lit(1e-8))))
    return -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.ln(p + F.lit(1e-10)))


def lag_difference(now: Column, before: Column) -> Column:
    """x_t - x_(t-1); zeros where there is no earlier frame."""
    zero = F.transform(now, lambda x: F.lit(0.0))
    return F.coalesce(F.zip_with(now, before, lambda x, y: x - y), zero)


def lag_abs_difference(now: Column, before: Column, clamp: float) -> Column:
    """abs(x_t - x_(t-k)) clamped; zeros where there is no earlier frame."""
    zero = F.transform(now, lambda x: F.lit(0.0))
    return F.coalesce(F.zip_with(now, before, lambda x, y: F.least(F.abs(x - y), F.lit(float(clamp)))), zero)


def clipped_difference(a: Column, base: Column, low: float, high: float) -> Column:
    """x - baseline, clipped."""
    return F.zip_with(a, base, lambda x, b: F.least(F.greatest(x - b, F.lit(float(low))), F.lit(float(high))))


def signed_unit(x: Column, p98: Column) -> Column:
    """x / (2 p98) + 0.5 clipped to [0, 1]."""
    scale = F.greatest(p98, F.lit(1e-6))
    return F.least(F.greatest(x / (F.lit(2.0) * scale) + F.lit(0.5), F.lit(0.0)), F.lit(1.0))


def range_unit(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) clipped to [0, 1]; a flat range counts as 1 wide."""
    top = F.when(high <= low, low + 1.0).otherwise(high)
    return F.least(F.greatest((x - low) / (top - low), F.lit(0.0)), F.lit(1.0))


def edge_map(px: Column, height: int, width: int, clamp: float, gamma: float = 1.0) -> Column:
    """3x3 gradient magnitude, clipped to ``clamp``, then a gamma curve up to ``clamp``.

    Arrow batches and array arithmetic: per-pixel neighbour lookups in nested array
    lambdas measured some fifty times slower.
    """

    @F.pandas_udf("array<double>")
    def edges(frames: pd.Series) -> pd.Series:
        if len(frames) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(frames.to_numpy()).astype("float64").reshape(-1, height, width)
        p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="reflect")
        across = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
        down = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
        strength = np.hypot(across[:, :, 2:] - across[:, :, :-2], down[:, 2:] - down[:, :-2])
        strength = np.minimum(strength, clamp)
        if gamma != 1.0:
            strength = (strength / max(clamp, 1e-6)) ** gamma * clamp
        return pd.Series(list(strength.reshape(len(x), -1)))

    return edges(px)


def _spot(i: Column, n: Column, m: int) -> Column:
    """Nearest source index round(linspace(0, n-1, m))[i], half to even."""
    return F.bround(i * (n - 1) / F.lit(float(max(m - 1, 1))), 0).cast("int")


def normalise_frame(px: Column, layout: Column, h: Column, w: Column, c: Column, size: int) -> Column:
    """Any of ``hw``, ``hwc``, ``chw`` to a flat size x size x 3 frame.

    Grey repeats over three channels, a fourth channel is dropped, pixels are taken
    at the nearest source index.
    """

    def pixel(k: Column) -> Column:
        ch = (k % 3).cast("int")
        y = _spot(F.floor(k / (size * 3)), h, size)
        x = _spot(F.floor(k / 3) % size, w, size)
        flat = y * w + x
        pos = F.when(layout == "hw", flat).when(layout == "hwc", flat * c + ch).otherwise(ch * h * w + flat)
        return F.get(px, pos.cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(size * size * 3 - 1)), pixel)


def malformed_frame(px: Column, layout: Column, h: Column, w: Column, c: Column) -> Column:
    """True when the declared shape cannot be normalised."""
    want = F.when(layout == "hw", h * w).when(layout.isin("hwc", "chw"), h * w * c)
    channels = (layout == "hw") | c.isin(3, 4)
    return want.isNull() | (F.size(px) != want) | ~channels


def log_softmax(a: Column, temperature: float) -> Column:
    """Log of the softmax of a / temperature."""

    def shifted(z: Column, top: Column) -> Column:
        total = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return bound(F.ln(total), lambda lt: F.transform(z, lambda x: x - top - lt))

    scaled = F.transform(a, lambda x: x / F.lit(float(temperature)))
    return bound(scaled, lambda z: bound(F.array_max(z), lambda top: shifted(z, top)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; lengths below 1e-8 count as 1e-8."""
    return F.lit(1.0) - dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def mean_squared(a: Column, b: Column) -> Column:
    """Mean squared difference."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def soft_kl(student: Column, teacher: Column, temperature: float) -> Column:
    """KL(teacher || student) of tempered softmaxes, scaled by the squared temperature."""
    ls, lt = log_softmax(student, temperature), log_softmax(teacher, temperature)
    kl = F.aggregate(F.zip_with(lt, ls, lambda t, s: F.exp(t) * (t - s)), F.lit(0.0), lambda acc, x: acc + x)
    return kl * F.lit(float(temperature) ** 2)
