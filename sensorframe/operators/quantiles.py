"""Exact grouped quantiles by refined histograms: no sort, and no task that holds a group or a range of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.operators.ordered import lookup_join, ratio_tile
from sensorframe.session import materialise, release

#: Parts a range is cut into by one refinement.
PARTS = 4096
#: Rows of a range that are sorted in one place; a larger range with distinct values is cut again.
SORTED_ROWS = 4096


def _size(v: str) -> Column:
    """Range of a value by its size; infinite values have ranges of their own."""
    endless = F.abs(v) == F.lit(float("inf"))
    return F.when(endless, F.signum(v).cast("long") * F.lit(1 << 40)).otherwise(ratio_tile(v))


def _places(probs: dict[str, float]) -> Column:
    """The ranks (from 0) that the probabilities need in a group of ``_total`` values."""
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs.values()]
    return F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))


def _chosen(counts: DataFrame, keys: Sequence[str], within: Sequence[str], start: Column, ranks: Column) -> DataFrame:
    """Of the ranges of a histogram those that hold a wanted rank, with how many values lie below."""
    below = Window.partitionBy(*keys, *within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("_below", start + F.coalesce(F.sum("_n").over(below), F.lit(0)))
    rows = rows.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_n"))))
    return rows.where(F.size("_ranks") > 0)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles (null and NaN ignored).

    A first histogram, summed up on the map side, counts values by relative size (256 ranges an octave) and keeps each range's
    least and greatest value. Only rows in a range that holds a wanted rank go on; they are cut evenly between
    these two values into ``PARTS``, and so on until a range has one distinct value or few enough rows to sort. However the values lie,
    a round narrows a range ``PARTS``-fold, so doubles need at most four; equal values never need a sort. The
    counting runs while the DataFrame is being built; groups without values have no row.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all_rows", F.lit(0)), ["_all_rows"], value, probs).drop("_all_rows")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    # Adding zero makes both zeros one value.
    rows = df.select(*keys, (v + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    facts = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    rows = rows.withColumn("_in", F.lit(0.0)).withColumn("_part", _size("_v"))
    first = rows.groupBy(*keys, "_in", "_part").agg(*facts)
    whole = first.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    state = materialise(_chosen(whole, keys, ["_in"], F.lit(0), _places(probs)))
    begun = state
    known = [state.where("_lo = _hi")]
    stored: list[DataFrame] = []
    cell = [*keys, "_in", "_part"]
    while True:
        open_ = state.where("_lo < _hi")
        largest = open_.agg(F.max("_n").alias("m")).head().m
        if largest is None:
            break
        facts_of = open_.select(*cell, "_lo", "_hi", "_below", "_ranks")
        inside = lookup_join(rows, facts_of, cell, "inner", salt_on=["_v"])
        if largest <= SORTED_ROWS:
            sorted_ = inside.groupBy(*cell, "_below", "_ranks").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
            picks = sorted_.select(*keys, F.explode("_ranks").alias("_r"), "_below", "_all")
            known.append(picks.select(*keys, "_r", F.get("_all", (F.col("_r") - F.col("_below")).cast("int")).alias("_x")))
            break
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("long")
        cut = materialise(inside.select(*keys, "_v", F.col("_lo").alias("_in"), part.alias("_part"), "_below", "_ranks"))
        stored.append(cut)
        counts = cut.groupBy(*keys, "_in", "_part").agg(*facts, F.first("_below").alias("_start"), F.first("_ranks").alias("_wanted"))
        state = materialise(_chosen(counts, keys, ["_in"], F.col("_start"), F.col("_wanted")))
        known.append(state.where("_lo = _hi"))
        rows = cut.select(*keys, "_v", "_in", "_part")
    release(*stored[:-1])
    found = None
    for k in known:
        one = k if "_x" in k.columns else k.select(*keys, F.explode("_ranks").alias("_r"), F.col("_lo").alias("_x"))
        found = one if found is None else found.unionByName(one)
    totals = begun.groupBy(*keys).agg(F.max("_total").alias("_total"))
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_at"))
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = (F.col("_at")[f(pos).cast("long")] for f in (F.floor, F.ceil))
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return totals.join(at, list(keys)).select(*keys, *out)
