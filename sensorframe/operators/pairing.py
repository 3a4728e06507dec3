"""Pairing windows of two modalities, coverage and readiness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.align import nearest_asof
from sensorframe.operators.ordered import ordered_scan, row_position


def positional_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str, left_tile: Column, right_tile: Column, label: str
) -> DataFrame:
    """n-th row of each side per group; the longer side's excess is dropped.

    Both sides need distinct column names apart from keys and ``label``. The left
    label is kept and disagreements are flagged.
    """
    l = ordered_scan(left, keys, [left_order], left_tile, {"pos": row_position()})
    r = ordered_scan(right, keys, [right_order], right_tile, {"pos": row_position()})
    r = r.withColumnRenamed(label, "_right_label")
    j = l.join(r, [*keys, "pos"], "inner")
    return j.withColumn("label_mismatch", ~F.col(label).eqNullSafe(F.col("_right_label"))).drop("_right_label")


def timed_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, left_ts: str, right_ts: str, tolerance: float, tile_width: float
) -> DataFrame:
    """Pair by nearest start time instead of position, inside a tolerance."""
    return nearest_asof(left, right, keys, [left_id], left_ts, right_ts, [right_id], tile_width, tolerance)


def enrich(df: DataFrame, meta: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left join on a deduplicated key: enriched rows, and rows without metadata."""
    once = meta.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    joined = df.join(once, key, "left")
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return joined.where(~bad), joined.where(bad).drop(*columns)


def lookup_or_zero(df: DataFrame, table: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """Vector by key, zeros where the key is absent."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return df.join(table.select(key, F.col(value).cast("array<double>").alias(value)), key, "left").withColumn(
        value, F.coalesce(F.col(value), zeros)
    )


def row_count_check(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Row counts of several tables per group, and whether they agree."""
    out = None
    for name, df in tables.items():
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = n if out is None else out.join(n, list(keys), "full")
    counts = [F.coalesce(F.col(f"n_{n}"), F.lit(0)).cast("long").alias(f"n_{n}") for n in tables]
    out = out.select(*keys, *counts)
    names = [F.col(f"n_{n}") for n in tables]
    return out.withColumn("agrees", F.least(*names) == F.greatest(*names))


def pair_coverage(pairs: DataFrame, subject: str, label: str) -> DataFrame:
    """Pairs, positives and percentage per subject."""
    got = pairs.groupBy(subject).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(label).cast("long").alias("n_stress"))
    return got.withColumn("pct_stress", F.round(100 * F.col("n_stress") / F.col("n_pairs"), 1))


def alignment_stats(left: DataFrame, right: DataFrame, subject: str, keys: Sequence[str]) -> DataFrame:
    """How two window sets line up, from counts per group alone."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    j = a.join(b, list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("_a").isNull()).alias("n_right_only"),
        F.count_if(both & (F.col("_a") != F.col("_b"))).alias("n_mismatch"),
        F.coalesce(F.sum(F.when(both, F.least("_a", "_b"))), F.lit(0)).cast("long").alias("n_pairs"),
        F.countDistinct(F.when(both, F.col(subject))).alias("n_subjects_covered"),
    )
