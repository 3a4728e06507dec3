"""Small table-shaping operators shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.scalars import canonical_id
from sensorframe.operators.ordered import dense_ids


def flatten(df: DataFrame, structs: Sequence[str]) -> DataFrame:
    """Struct fields to columns named ``struct_field``."""
    cols: list[Column] = []
    for field in df.schema.fields:
        if field.name in structs:
            cols += [F.col(f"{field.name}.{x.name}").alias(f"{field.name}_{x.name}") for x in field.dataType.fields]
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "group_size") -> DataFrame:
    """Group size on every row: partial counts joined back, not a window over the group.

    Groups may be as many as rows, so the counts are not repeated; AQE splits a hot key.
    """
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), list(keys))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def select_keys(
    df: DataFrame,
    subjects: Sequence[str] = (),
    tasks: Sequence[str] = (),
    views: Sequence[str] = (),
    first: int | None = None,
    order: Sequence[str] = (),
    subject: str = "subject",
    task: str = "task",
    view: str = "view",
) -> DataFrame:
    """Filter by subject (full or canonical id), task and view; then the first rows in a total order."""
    out = df
    if subjects:
        out = out.where(F.col(subject).isin(*subjects) | canonical_id(F.col(subject)).isin(*subjects))
    if tasks:
        out = out.where(F.col(task).isin(*tasks))
    if views:
        out = out.where(F.col(view).isin(*views))
    if first is not None:
        if not order:
            raise ValueError("a row cap needs a total order")
        out = out.orderBy(*order).limit(first)
    return out


def set_difference(required: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Required values that are not present."""
    return required.select(column).exceptAll(present.select(column).distinct()).distinct()


def compare_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys tagged left_only, right_only or both."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, list(keys), "full").select(*keys, side.alias("side"))


def evenly_spaced(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """``count`` rows at positions round(linspace(0, n-1, count)), half to even.

    Positions come from dense ids; the wanted ones are ``count`` numbers.
    """
    placed = dense_ids(df, list(order), "position")
    n = placed.count()
    c = min(count, n)
    if c == 0:
        return placed
    i = F.col("id")
    spot = F.bround(i * F.lit(float(n - 1)) / F.lit(float(c - 1)), 0) if c > 1 else F.lit(0)
    wanted = df.sparkSession.range(c).select(spot.cast("long").alias("position")).distinct()
    return placed.join(wanted, "position", "left_semi")


def offsets_in_window(df: DataFrame, start: str, end: str, count: int) -> DataFrame:
    """Evenly spaced frame indices inside each [start, end) window."""
    n = F.col(end) - F.col(start)
    c = F.least(F.lit(count).cast("long"), n)
    spot = F.when(c > 1, F.bround(F.col("_i") * (n - 1) / F.greatest(c - 1, F.lit(1)), 0)).otherwise(F.lit(0.0))
    return (
        df.where(n > 0)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), c - 1)))
        .withColumn("frame_index", F.col(start) + spot.cast("long"))
        .drop("_i")
    )


def explode_range(df: DataFrame, lo: Column, hi: Column, name: str, block: int = 1 << 15) -> DataFrame:
    """One row per whole number from ``lo`` to ``hi``; rows whose range is empty or null are left out.

    Two levels, blocks and then the numbers of a block, so no row ever holds an array longer than ``block`` or the number of blocks.
    """
    ranged = df.withColumn("_lo_of", lo.cast("long")).withColumn("_hi_of", hi.cast("long")).where(F.col("_hi_of") >= F.col("_lo_of"))
    size = F.lit(block).cast("long")
    first, last = F.floor(F.col("_lo_of") / size).cast("long"), F.floor(F.col("_hi_of") / size).cast("long")
    blocks = ranged.withColumn("_block", F.explode(F.sequence(first, last)))
    from_, to = F.greatest(F.col("_lo_of"), F.col("_block") * size), F.least(F.col("_hi_of"), (F.col("_block") + 1) * size - 1)
    return blocks.withColumn(name, F.explode(F.sequence(from_, to))).drop("_lo_of", "_hi_of", "_block")
