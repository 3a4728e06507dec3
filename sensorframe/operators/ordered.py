"""Ordered operators over groups of any size.

A plain ``Window.partitionBy(key).orderBy(time)`` sends every row of a key to one
task, so one long recording decides the run time of the job. The operators here
cut a group into *tiles* along its order column, work inside a tile, and hand each
tile the little that earlier (or later) tiles owe it:

1. rows are hash-partitioned by (key, tile) and windowed inside the tile;
2. the first or last row of a tile already holds the tile's summary, so one row per
   (key, tile) goes on: a filter, no aggregation over the rows;
3. an ordered window over those few summaries yields the carry of each tile;
4. the carry is joined back on (key, tile), the partitioning step 1 already has.

A hot key therefore spreads over as many tasks as it has tiles. Steps 1 and 2 share
one shuffle when the input holds no columns beyond those the scan uses, so pass slim
tables and join wide columns later. Order columns must be unique within a key; rows
whose key or tile is null take part in no group and are left out, as in a pandas
grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.session import materialise

ROWS_PER_TILE = 1 << 20


@dataclass(frozen=True)
class Scan:
    """One output of an ordered scan, split into its in-tile and cross-tile parts.

    ``edge`` names the row of a tile that holds its summary; ``summary`` is what to
    read there when it is not the in-tile value itself.
    """

    local: Callable[[Window, Window], Column]
    carry: Callable[[Column, Window, Window], Column]
    merge: Callable[[Column, Column], Column]
    edge: str = "last"
    summary: Column | None = None


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _whole(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def previous(expr: Column) -> Scan:
    """Value of the row before, null on the first row of the group."""
    boxed = F.struct(expr.alias("v"))
    return Scan(
        local=lambda fwd, bwd: F.lag(boxed).over(fwd),
        summary=boxed,
        carry=lambda s, fwd, bwd: F.lag(s).over(fwd),
        merge=lambda a, b: F.coalesce(a, b)["v"],
    )


def following(expr: Column) -> Scan:
    """Value of the row after, null on the last row of the group."""
    boxed = F.struct(expr.alias("v"))
    return Scan(
        local=lambda fwd, bwd: F.lead(boxed).over(fwd),
        summary=boxed,
        edge="first",
        carry=lambda s, fwd, bwd: F.lead(s).over(fwd),
        merge=lambda a, b: F.coalesce(a, b)["v"],
    )


def last_valid(expr: Column) -> Scan:
    """Latest non-null value at or before the row."""
    return Scan(
        local=lambda fwd, bwd: F.last(expr, ignorenulls=True).over(_upto(fwd)),
        carry=lambda s, fwd, bwd: F.last(s, ignorenulls=True).over(_before(fwd)),
        merge=lambda a, b: F.coalesce(a, b),
    )


def next_valid(expr: Column) -> Scan:
    """Earliest non-null value at or after the row.

    Runs over the descending window: Spark evaluates frames that end unbounded
    following in quadratic time.
    """
    return Scan(
        local=lambda fwd, bwd: F.last(expr, ignorenulls=True).over(_upto(bwd)),
        edge="first",
        carry=lambda s, fwd, bwd: F.last(s, ignorenulls=True).over(_before(bwd)),
        merge=lambda a, b: F.coalesce(a, b),
    )


def running_sum(expr: Column) -> Scan:
    """Sum up to and including the row."""
    return Scan(
        local=lambda fwd, bwd: F.sum(expr).over(_upto(fwd)),
        carry=lambda s, fwd, bwd: F.sum(s).over(_before(fwd)),
        merge=lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    )


def running_max(expr: Column) -> Scan:
    """Largest value up to and including the row."""
    return Scan(
        local=lambda fwd, bwd: F.max(expr).over(_upto(fwd)),
        carry=lambda s, fwd, bwd: F.max(s).over(_before(fwd)),
        merge=lambda a, b: F.greatest(a, b),
    )


def row_position() -> Scan:
    """1-based row number within the group."""
    return running_sum(F.lit(1).cast("long"))


def group_total(expr: Column) -> Scan:
    """Sum over the whole group, brought along with the tile carry."""
    return Scan(
        local=lambda fwd, bwd: F.sum(expr).over(_upto(fwd)),
        carry=lambda s, fwd, bwd: F.sum(s).over(_whole(fwd)),
        merge=lambda a, b: b,
    )


def group_first(expr: Column) -> Scan:
    """First non-null value of the whole group, brought along with the tile carry."""
    return Scan(
        local=lambda fwd, bwd: F.first(expr, ignorenulls=True).over(_upto(fwd)),
        carry=lambda s, fwd, bwd: F.first(s, ignorenulls=True).over(_whole(fwd)),
        merge=lambda a, b: b,
    )


def row_tile(row: str | Column, rows: int = ROWS_PER_TILE) -> Column:
    """Tile by a dense row index: every tile holds at most ``rows`` rows."""
    row = F.col(row) if isinstance(row, str) else row
    return F.floor(row / F.lit(rows)).cast("long")


def time_tile(micros: str | Column, seconds: float) -> Column:
    """Tile by wall-clock span: bounded by the sensor rate times the span."""
    micros = F.col(micros) if isinstance(micros, str) else micros
    return F.floor(micros / F.lit(seconds * 1e6)).cast("long")


def ratio_tile(value: str | Column, per_octave: int = 256) -> Column:
    """Tile by relative size, for values of unknown scale.

    A float32 value has at most 2^23 / per_octave neighbours in its tile, so groups
    of distinct scores, gaps or pixels are bounded without a look at the data.
    """
    value = F.col(value) if isinstance(value, str) else value
    octave = F.floor(F.log2(F.abs(value)) * per_octave) + F.lit(1100 * per_octave)
    return F.when(value > 0, octave).when(value < 0, -octave).otherwise(F.lit(0)).cast("long")


def with_value_tile(df: DataFrame, value: str, tiles: int = 256, out: str = "_tile") -> DataFrame:
    """Tile by measured quantiles of ``value``, where ``ratio_tile`` is too coarse (dense doubles).

    One distributed sketch pass returns ``tiles`` split points; no tile then holds
    more than about 1/tiles of the rows, whatever the skew of groups or values.
    """
    grid = [i / tiles for i in range(1, tiles)]
    numeric = df.select(F.col(value).cast("double").alias(value))
    found = numeric.approxQuantile(value, grid, 1.0 / (4 * tiles))
    splits = [float("-inf"), *sorted({float(x) for x in found if x == x}), float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    slot = "_tile_value"
    ready = df.withColumn(slot, F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol=slot, outputCol=out, handleInvalid="keep").transform(ready).drop(slot)


def with_time_tile(df: DataFrame, time: str, width: float | None, out: str = "_tile") -> DataFrame:
    """Tile by fixed width, or by measured quantiles when the density is unknown."""
    if width is None:
        return with_value_tile(df, time, out=out)
    return df.withColumn(out, F.floor(F.col(time) / F.lit(width)))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tile: Column | str,
    outputs: dict[str, Scan],
) -> DataFrame:
    """Add ordered outputs per group; ``tile`` must not decrease along ``order``."""
    cell = [*keys, "_tile"]
    known = F.lit(True)
    for c in cell:
        known = known & F.col(c).isNotNull()
    tiled = df.withColumn("_tile", F.col(tile) if isinstance(tile, str) else tile).where(known)
    fwd = Window.partitionBy(*cell).orderBy(*[F.col(c).asc() for c in order])
    bwd = Window.partitionBy(*cell).orderBy(*[F.col(c).desc() for c in order])
    over_tiles_fwd = Window.partitionBy(*keys).orderBy(F.col("_tile").asc())
    over_tiles_bwd = Window.partitionBy(*keys).orderBy(F.col("_tile").desc())
    local = tiled.select("*", *[s.local(fwd, bwd).alias(f"_l_{n}") for n, s in outputs.items()])

    def edge(which: str) -> DataFrame | None:
        wanted = {n: s for n, s in outputs.items() if s.edge == which}
        if not wanted:
            return None
        beyond = (F.lead if which == "last" else F.lag)(F.lit(1)).over(fwd)
        rows = local.withColumn("_beyond", beyond).where(F.col("_beyond").isNull())
        return rows.select(
            *cell, *[(F.col(f"_l_{n}") if s.summary is None else s.summary).alias(f"_s_{n}") for n, s in wanted.items()]
        )

    lasts, firsts = edge("last"), edge("first")
    summaries = firsts if lasts is None else lasts if firsts is None else lasts.join(firsts, cell)
    carries = summaries.select(
        *cell,
        *[s.carry(F.col(f"_s_{n}"), over_tiles_fwd, over_tiles_bwd).alias(f"_c_{n}") for n, s in outputs.items()],
    )
    kept = [c for c in df.columns if c not in outputs and c != "_tile"]
    return local.join(carries, cell, "inner").select(
        *kept, *[s.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in outputs.items()]
    )


def lookup_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", spread: int = 16, salt_on: Sequence[str] = ()
) -> DataFrame:
    """Join per-group facts back to rows without gathering a hot group.

    Rows take a salt, facts are repeated once per salt, so a group starts out spread
    over ``spread`` tasks; AQE splits what is still too large and turns the join into a
    broadcast when the facts turn out to be small. The salt is a hash of ``salt_on``
    (columns that vary inside a group) or else the number of the partition a row comes
    from, which also spreads exact copies. Neither changes when a lost task is rerun.
    """
    source = F.xxhash64(*salt_on) if salt_on else F.spark_partition_id()
    salted = big.withColumn("_salt", F.pmod(source, F.lit(spread)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Consecutive ids along a total order.

    Range sort, then partition offsets. The sorted rows are stored first, so the
    offsets and the rows they are added to always come from the same partitions.
    """
    ranked = materialise(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    offsets = (
        ranked.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(_before(Window.orderBy("_part"))), F.lit(0)).alias("_offset"),
        )
    )
    # One row per partition of the sort: bounded by the partition count, not the data.
    return (
        ranked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start))
        .select(*df.columns, name)
    )
