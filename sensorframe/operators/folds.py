"""Subject-disjoint folds, stratified splits, resampling and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions.scalars import hash_unit
from sensorframe.operators.ordered import dense_ids, group_total, lookup_join, ordered_scan, row_position
from sensorframe.session import materialise


def grouped_folds(df: DataFrame, subject: str, k: int) -> DataFrame:
    """Test fold (1..k) per subject: sizes balanced by dealing subjects out in serpentine order."""
    sizes = df.groupBy(subject).agg(F.count(F.lit(1)).alias("num_windows"))
    ranked = dense_ids(sizes, [F.col("num_windows").desc(), F.col(subject).asc()], "_rank")
    found = ranked.limit(k).count()
    if found < k:
        raise ValueError(f"need at least {k} subjects, found {found}")
    turn, seat = F.floor(F.col("_rank") / k), F.col("_rank") % k
    fold = F.when(turn % 2 == 0, seat).otherwise(F.lit(k - 1) - seat) + 1
    return ranked.withColumn("test_fold", fold.cast("long")).drop("_rank")


def _hash_tile(h: str) -> Column:
    """Order-preserving tile of a hex digest: 4096 even tiles."""
    return F.substring(F.col(h), 1, 3)


def subject_splits(folds: DataFrame, subject: str, k: int, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """train/val/test per (fold, subject): test by fold, val by seeded hash order of the rest."""
    each = folds.select(subject, "test_fold").withColumn("fold_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    rest = each.where(F.col("fold_id") != F.col("test_fold")).withColumn(
        "_h", F.md5(F.concat_ws("|", (F.lit(seed) + F.col("fold_id")).cast("string"), F.col(subject).cast("string")))
    )
    ranked = ordered_scan(
        rest, ["fold_id"], ["_h", subject], _hash_tile("_h"), {"_r": row_position(), "_n": group_total(F.lit(1).cast("long"))}
    )
    split = F.when(F.col("_r") <= F.ceil(F.col("_n") * F.lit(val_ratio)), "val").otherwise("train")
    held = each.where(F.col("fold_id") == F.col("test_fold"))
    return ranked.select("fold_id", subject, split.alias("split")).unionByName(
        held.select("fold_id", subject, F.lit("test").alias("split"))
    )


def fold_table(windows: DataFrame, splits: DataFrame, subject: str) -> DataFrame:
    """Long fold table: every window once per fold."""
    return lookup_join(windows, splits, [subject], "inner")


def fold_summary(table: DataFrame, subject: str) -> DataFrame:
    """Subjects and windows per fold and split."""
    return table.groupBy("fold_id", "split").agg(
        F.countDistinct(subject).alias("num_subjects"), F.count(F.lit(1)).alias("num_windows")
    )


def stratified_split(
    df: DataFrame, row_id: str, label: str, test_ratio: float = 0.2, val_ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Row-level split that keeps label shares, in seeded hash order inside each label."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))))
    ranked = ordered_scan(
        hashed, [label], ["_h", row_id], _hash_tile("_h"), {"_r": row_position(), "_n": group_total(F.lit(1).cast("long"))}
    )
    n_test = F.ceil(F.col("_n") * F.lit(test_ratio))
    n_val = F.ceil((F.col("_n") - n_test) * F.lit(val_ratio))
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_h", "_r", "_n")


def balanced_resample(df: DataFrame, row_id: str, label: str, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """As many draws with replacement as rows, each label equally likely.

    Weights of 1/n_label mean: pick a label evenly, then a position in it evenly. A
    draw therefore joins on (label, position), a unique key, instead of a range over
    cumulative weights. Every input row yields one draw, so the count is exact. Labels are numbered
    in a table of their own, so there may be any number of them; rows with a null label are never drawn.
    With ``keys`` (folds, say) every group is drawn from by itself, with draws of its own.
    """
    keys = list(keys)
    base = df.withColumn("_h", F.md5(F.col(row_id).cast("string")))
    placed = ordered_scan(base, [*keys, label], ["_h", row_id], _hash_tile("_h"), {"_pos": row_position()}).drop("_h")
    sizes = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_size"))
    known = [F.lit(seed), *[F.col(k) for k in keys]]
    if keys:
        # One row per group and label; a group's labels are numbered by how many come before.
        whole = Window.partitionBy(*keys)
        labels = sizes.withColumn("_slot", (F.row_number().over(whole.orderBy(label)) - 1).cast("long")).withColumn("_labels", F.count(F.lit(1)).over(whole))
        counts = labels.where("_slot = 0").select(*keys, "_labels")
        rows = lookup_join(df.select(*keys, F.col(row_id).alias("draw_id")), counts, keys, "inner", salt_on=["draw_id"])
        n_labels = F.col("_labels")
        labels = labels.drop("_labels")
    else:
        labels = materialise(dense_ids(sizes, [label], "_slot"))
        rows, n_labels = df.select(F.col(row_id).alias("draw_id")), F.lit(labels.count())
    slot = F.floor(hash_unit(known[0], F.lit("label"), *known[1:], F.col("draw_id")) * n_labels).cast("long")
    draws = lookup_join(rows.withColumn("_slot", slot), labels, [*keys, "_slot"], "inner", salt_on=["draw_id"])
    at = F.floor(hash_unit(known[0], F.lit("row"), *known[1:], F.col("draw_id")) * F.col("_size")) + 1
    return draws.select(*keys, "draw_id", label, at.cast("long").alias("_pos")).join(placed, [*keys, label, "_pos"], "inner").drop("_pos")


def split_overlap(table: DataFrame, subject: str) -> DataFrame:
    """Subjects that sit in more than one split of a fold: must be empty."""
    return (
        table.groupBy("fold_id", subject)
        .agg(F.countDistinct("split").alias("num_splits"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))
        .where(F.col("num_splits") > 1)
    )


def class_weights(df: DataFrame, fold: Sequence[str], label: str) -> DataFrame:
    """Balanced weights n / (2 n_c) per fold; an absent class counts as one row."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    got = df.groupBy(*fold).agg(n0.alias("n_0"), n1.alias("n_1"))
    total = F.col("n_0") + F.col("n_1")
    return got.select(
        *fold,
        "n_0",
        "n_1",
        (total / (2 * F.greatest("n_0", F.lit(1)))).alias("weight_0"),
        (total / (2 * F.greatest("n_1", F.lit(1)))).alias("weight_1"),
    )
