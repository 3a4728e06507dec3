"""Sensor files to people and video sessions: mapping, fallback, nearest session, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions.scalars import truthy
from sensorframe.operators.align import nearest_asof
from sensorframe.operators.ordered import lookup_join
from sensorframe.session import materialise


def approved_mapping(crosswalk: DataFrame, keys: Sequence[str], approved: str = "approved") -> DataFrame:
    """Distinct approved rows of the crosswalk."""
    return crosswalk.where(truthy(F.col(approved))).drop(approved).dropDuplicates()


def map_files(files: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of files to their approved participant."""
    return files.join(mapping, list(keys), "left")


def apply_overrides(mapped: DataFrame, overrides: Sequence[tuple], keys: Sequence[str], value: str, stamp: str, note: str) -> DataFrame:
    """Fill null ids from a fixed map and stamp where they came from."""
    spark = mapped.sparkSession
    schema = ", ".join([f"`{k}` string" for k in keys] + ["`_override` string"])
    table = spark.createDataFrame([tuple(o) for o in overrides], schema)
    joined = mapped.join(table, list(keys), "left")
    used = F.col(value).isNull() & F.col("_override").isNotNull()
    return (
        joined.withColumn(stamp, F.when(used, F.lit(note)).otherwise(F.col(stamp)))
        .withColumn(value, F.coalesce(F.col(value), F.col("_override")))
        .drop("_override")
    )


def or_key_join(files: DataFrame, manifest: DataFrame, group: str, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """Rows whose group agrees and whose first OR second key agrees, each pair once.

    Two equi-joins: the second leaves out pairs the first already found, so no
    distinct is needed and neither side has to be small. ``right`` columns are kept.
    """
    f, m = files.alias("f"), manifest.alias("m")
    same_group = F.col(f"f.{group}") == F.col(f"m.{group}")
    first = F.col(f"f.{left[0]}") == F.col(f"m.{right[0]}")
    second = F.col(f"f.{left[1]}") == F.col(f"m.{right[1]}")
    cols = [F.col(f"f.{c}") for c in files.columns] + [F.col(f"m.{c}") for c in manifest.columns if c != group]
    not_first = ~F.coalesce(first, F.lit(False))
    return f.join(m, same_group & first).select(*cols).unionByName(f.join(m, same_group & second & not_first).select(*cols))


def session2_fallback(unmapped: DataFrame, manifest: DataFrame, group: str, stem: str, pid: str, norm: str, second: str) -> DataFrame:
    """Manifest rows of the base id for unmapped ``...v2`` files; second-session rows win if any."""
    base = unmapped.where(F.col(stem).endswith("v2")).withColumn(
        "base_stem", F.expr(f"substring(`{stem}`, 1, length(`{stem}`) - 2)")
    )
    base = base.withColumn("_b2", F.col("base_stem"))
    hits = or_key_join(base, manifest, group, ("base_stem", "_b2"), (pid, norm)).drop("_b2")
    any2 = hits.groupBy(group, stem).agg(F.max(F.col(second).cast("int")).alias("_any2"))
    return (
        lookup_join(hits, any2, [group, stem], "inner")
        .where((F.col("_any2") == 0) | F.col(second))
        .drop("_any2")
    )


def missing_mapping(files: DataFrame, resolved: DataFrame, keys: Sequence[str], issue: str) -> DataFrame:
    """Files absent from the resolved set, with the issue named."""
    return files.join(resolved.select(*keys), list(keys), "left_anti").withColumn("issue", F.lit(issue))


def nearest_sessions(
    files: DataFrame,
    manifest: DataFrame,
    group: str,
    file_id: str,
    left: tuple[str, str],
    right: tuple[str, str],
    view: str,
    file_time: str,
    session_time: str,
    name: str,
    threshold_seconds: float,
    tile_width: float = 30 * 86400.0,
    drop_outside: bool = False,
) -> DataFrame:
    """Per file and view the session nearest in time, with candidate counts.

    Sessions match a file by either key (``or_key_join``). The nearest one comes
    from an ordered merge per key instead of all file x session pairs; counts come
    from grouped session counts. Ties take the smaller name; files without a time,
    and sessions without one, fall back to the smallest name. A null view is the empty view.
    """
    manifest = manifest.withColumn(view, F.coalesce(F.col(view), F.lit("")))
    # Sessions under either kind of key, and those reachable under both (counted once).
    def keyed(df: DataFrame, pair: tuple[str, str], *cols) -> DataFrame:
        kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("key")) for i, c in enumerate(pair)])
        return df.select(group, F.explode(kinds).alias("_k"), *cols).select(
            group, F.col("_k.kind").alias("_by"), F.col("_k.key").alias("_key"), *cols
        )

    reach = keyed(manifest, right, view, session_time, name)
    per_key = reach.groupBy(group, "_by", "_key", view).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col(session_time).isNull(), F.col(name))).alias("_untimed"),
        F.min(name).alias("_any"),
    )
    both = manifest.groupBy(group, F.col(right[0]).alias("_k0"), F.col(right[1]).alias("_k1"), view).agg(
        F.count(F.lit(1)).alias("_both")
    )
    wanted = keyed(files.withColumn("_t", F.col(file_time)).withColumn("_k0", F.col(left[0])).withColumn("_k1", F.col(left[1])), left, file_id, "_t", "_k0", "_k1")
    # About as many keys as files: a plain join, split by AQE if one key is hot.
    found = wanted.join(per_key, [group, "_by", "_key"])
    # Stored: the counts below and the time search both start from these pairs of file and view.
    found = materialise(found)
    hits = nearest_asof(
        found.where(F.col("_t").isNotNull()).select(group, "_by", "_key", view, file_id, "_t"),
        reach,
        [group, "_by", "_key", view],
        [file_id],
        "_t",
        session_time,
        [name],
        tile_width,
        prefer="payload",
    ).groupBy(group, file_id, view).agg(F.min(F.struct("gap", F.col(name).alias("name"))).alias("_hit"))
    counted = (
        found.groupBy(group, file_id, view)
        .agg(
            F.sum("_n").alias("_n"),
            F.min("_untimed").alias("_untimed"),
            F.min("_any").alias("_any"),
            F.max("_t").alias("_t"),
            F.max("_k0").alias("_k0"),
            F.max("_k1").alias("_k1"),
        )
        .join(both, [group, "_k0", "_k1", view], "left")
        .withColumn("_views", F.col("_n") - F.coalesce("_both", F.lit(0)))
        .join(hits, [group, file_id, view], "left")
    )
    untimed = F.when(F.col("_t").isNull(), F.col("_any")).otherwise(F.col("_untimed"))
    total = F.sum("_views").over(Window.partitionBy(group, file_id))  # one row per view of a file
    gap = F.col("_hit.gap")
    res = counted.select(
        group,
        file_id,
        view,
        F.coalesce(F.col("_hit.name"), untimed).alias(name),
        gap.alias("session_time_diff_seconds"),
        total.alias("session_candidate_count_total"),
        F.col("_views").alias("session_candidate_count_for_view"),
        F.lit(1).cast("long").alias("session_candidate_rank_for_view"),
        (F.col("_views") - 1).alias("session_dropped_candidate_count_for_view"),
        F.coalesce(gap <= threshold_seconds, F.lit(False)).alias("session_within_threshold"),
    )
    return res.where("session_within_threshold") if drop_outside else res


def mapping_summary(sessions: DataFrame, counts: dict[str, "F.Column"]) -> DataFrame:
    """Named scalar metrics as (metric, value) rows from one aggregation."""
    row = sessions.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in counts)
    return row.selectExpr(f"stack({len(counts)}, {pairs}) AS (metric, value)")


def suggestions(missing: DataFrame, candidates: DataFrame, group: str, stem: str, pid: str, proposed: str, top: int | None, prefix_length: int = 3) -> DataFrame:
    """Crosswalk suggestions for unmapped files, one row per suggestion with its JSON record.

    Tier 1 same stem, 2 same id, 3 begins with the stem's first ``prefix_length`` letters (with the
    whole stem if that is shorter), 4 same group; the first tier with a hit is used. Tiers 3 and 4 keep
    the first ``top`` candidates, all if that is None.
    """
    cols = [c for c in candidates.columns if c != group]
    want = missing.select(group, stem).distinct()
    cand = candidates
    lengths = F.sequence(F.lit(0), F.least(F.length(proposed), F.lit(prefix_length)))
    begin = candidates.withColumn("_l", F.explode(lengths)).withColumn("_prefix", F.col(proposed).substr(F.lit(1), F.col("_l")))

    def first(pool: DataFrame, keys: Sequence[str]) -> DataFrame:
        if top is None:
            return pool
        w = Window.partitionBy(*keys).orderBy(*cols)
        return pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")

    def hit(files: DataFrame, pool: DataFrame, keys: Sequence[str], tier: int) -> DataFrame:
        # Tiers 3 and 4 share one short list among many files; tiers 1 and 2 match on near-unique keys.
        got = lookup_join(files, pool, keys, "inner", salt_on=[stem]) if tier > 2 else files.join(pool, list(keys))
        return got.select(group, stem, F.lit(tier).cast("long").alias("tier"), *cols)

    exact = hit(want.withColumn("_k", F.col(stem)), cand.withColumn("_k", F.col(proposed)), [group, "_k"], 1)
    left = want.join(exact.select(group, stem).distinct(), [group, stem], "left_anti")
    same_id = hit(left.withColumn("_k", F.col(stem)), cand.withColumn("_k", F.col(pid)), [group, "_k"], 2)
    left = left.join(same_id.select(group, stem).distinct(), [group, stem], "left_anti")
    prefix = hit(left.withColumn("_prefix", F.substring(stem, 1, prefix_length)), first(begin, [group, "_prefix"]), [group, "_prefix"], 3)
    left = left.join(prefix.select(group, stem).distinct(), [group, stem], "left_anti")
    anything = hit(left, first(cand, [group]), [group], 4)
    out = exact.unionByName(same_id).unionByName(prefix).unionByName(anything)
    return out.select(group, stem, "tier", pid, F.to_json(F.struct(*cols)).alias("suggestion"))


def existence_issue(sessions: DataFrame, inventory: DataFrame, depth: str, rgb: str, path: str = "path") -> DataFrame:
    """Sessions whose depth or rgb file is not in the inventory, with the issue named."""
    have = inventory.select(F.col(path)).distinct()
    d = have.select(F.col(path).alias(depth), F.lit(True).alias("_depth"))
    r = have.select(F.col(path).alias(rgb), F.lit(True).alias("_rgb"))
    joined = sessions.join(d, depth, "left").join(r, rgb, "left")
    no_depth, no_rgb = F.col("_depth").isNull(), F.col("_rgb").isNull()
    issue = F.when(no_depth & no_rgb, "missing_depth_and_rgb").when(no_depth, "missing_depth_file").when(no_rgb, "missing_rgb_file")
    return joined.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("_depth", "_rgb")
