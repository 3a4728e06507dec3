"""Column functions: coercion, ids, labels, keys, timestamps, formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task labels and their classes.
CALM_TASKS = ("jelly", "count", "baseline")
STRESS_TASKS = ("bad", "stress", "arithmetic", "stroop")


def to_number(c: Column) -> Column:
    """Text to double; unparsable becomes null."""
    return c.cast("string").try_cast("double")


def truthy(c: Column) -> Column:
    """Lenient boolean; null counts as false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def canonical_id(c: Column, mode: str = "suffix") -> Column:
    """Subject id without its version suffix.

    ``suffix`` strips a lower-case ``v`` and digits; ``v2`` strips only ``v2`` in
    either case, after trimming blanks.
    """
    if mode == "suffix":
        return F.regexp_replace(c, r"v\d+$", "")
    if mode == "v2":
        return F.regexp_replace(F.trim(c), r"(?i)v2$", "")
    raise ValueError(f"unknown mode {mode!r}")


def binary_label(
    c: Column, negatives: Iterable[str] = CALM_TASKS, positives: Iterable[str] = STRESS_TASKS, strict: bool = False
) -> Column:
    """0 or 1 by label set; other labels are null, or an error when strict."""
    out = F.when(c.isin(*negatives), F.lit(0)).when(c.isin(*positives), F.lit(1))
    if strict:
        out = out.otherwise(F.raise_error(F.concat(F.lit("unsupported label: "), F.coalesce(c, F.lit("null")))))
    return out.cast("long")


def filename_epoch(c: Column) -> Column:
    """Epoch seconds of the first ``yyyyMMdd_HHmmss`` in a name, read as UTC."""
    stamp = F.regexp_extract(c, r"(\d{8}_\d{6})", 1)
    return F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))).cast("double")


def rebase_path(c: Column, root: str) -> Column:
    """Base name under another root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.element_at(F.split(c, "/"), -1))


def safe_name(c: Column) -> Column:
    """Runs of unsafe characters to one underscore, trimmed; empty becomes ``unknown``."""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.when(cleaned == "", "unknown").otherwise(cleaned)


def slug(c: Column) -> Column:
    """Every character but letters, digits, dash and underscore to an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def record_key(ordinal: Column, *parts: Column) -> Column:
    """Parts and a two-digit ordinal joined by double underscores."""
    return F.concat_ws("__", *parts, F.format_string("%02d", ordinal))


def is_whole(c: Column, tolerance: float = 1e-9) -> Column:
    """True when the value lies within the tolerance of a whole number."""
    frac = c - F.floor(c)
    return frac <= F.lit(tolerance)


def mean_std_text(mean: Column, std: Column) -> Column:
    """``m.mmm±s.sss``, or ``nan`` when the mean is not a number."""
    bad = mean.isNull() | F.isnan(mean)
    spread = F.when(std.isNull() | F.isnan(std), F.lit("nan")).otherwise(F.format_string("%.3f", std))
    return F.when(bad, F.lit("nan")).otherwise(F.concat(F.format_string("%.3f", mean), F.lit("±"), spread))


def logit(score: Column, eps: float = 1e-6) -> Column:
    """Log-odds of a score clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(score, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(p / (F.lit(1.0) - p))


def above(score: Column, threshold: Column | float) -> Column:
    """1 when the score reaches the threshold."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= threshold).cast("long")


def processable(overlap: Column, status: Column, complete_only: bool = False) -> Column:
    """Rows with both modalities and an accepted coverage status."""
    accepted = ("complete",) if complete_only else ("complete", "partial")
    return F.coalesce(overlap & status.isin(*accepted), F.lit(False))


# Fixed order: earlier entries win when statuses are combined.
STATUS_ORDER = ("error", "not_inspected", "missing", "partial", "complete")


def combined_status(*statuses: Column) -> Column:
    """Worst status over modalities."""
    out = None
    for name in STATUS_ORDER[:-1]:
        hit = F.lit(False)
        for s in statuses:
            hit = hit | F.coalesce(s == name, F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(STATUS_ORDER[-1]))


def hash_shard(key: Column, shards: int) -> Column:
    """Stable shard number from the first 12 hex digits of the key's md5."""
    head = F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("long")
    return F.pmod(head, F.lit(shards).cast("long"))


def hash_unit(*parts: Column) -> Column:
    """Deterministic uniform number in [0, 1) from the md5 of the parts."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10)
    return head.cast("double") / F.lit(float(16**12))
