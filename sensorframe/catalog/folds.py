"""Registered queries: folds, splits, resampling, leakage, class weights."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.operators import folds as fo
from sensorframe.sources.tables import PREDICTIONS_SQL

K = 5

FOLDS_SQL = """base AS (SELECT event_id AS window_id, 'S' || user_id AS subject, CAST(event_type IN ('purchase', 'error') AS BIGINT) AS y FROM events),
  sizes AS (SELECT subject, count(*) AS num_windows FROM base GROUP BY subject),
  ranked AS (SELECT *, row_number() OVER (ORDER BY num_windows DESC, subject) - 1 AS r FROM sizes),
  tf AS (SELECT subject, num_windows, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END + 1 AS test_fold FROM ranked),
  each AS (SELECT subject, test_fold, unnest(range(1, 6)) AS fold_id FROM tf),
  vr AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY md5((42 + fold_id) || '|' || subject), subject) AS k,
           count(*) OVER (PARTITION BY fold_id) AS n FROM each WHERE fold_id <> test_fold),
  splits AS (SELECT fold_id, subject, CASE WHEN k <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM vr
             UNION ALL SELECT fold_id, subject, 'test' FROM each WHERE fold_id = test_fold)"""


def base(t):
    return t.events.select(
        F.col("event_id").alias("window_id"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").isin("purchase", "error").cast("long").alias("y"),
    )


def splits(t):
    return fo.subject_splits(fo.grouped_folds(base(t), "subject", K), "subject", K)


@query("m1_grouped_folds", f"WITH {FOLDS_SQL} SELECT * FROM tf")
def m1(t):
    return fo.grouped_folds(base(t), "subject", K)


@query("m2_validation_split", f"WITH {FOLDS_SQL} SELECT * FROM splits")
def m2(t):
    return splits(t)


@query("m3_fold_table", f"WITH {FOLDS_SQL} SELECT fold_id, split, window_id, subject, y FROM base JOIN splits USING (subject)")
def m3(t):
    return fo.fold_table(base(t), splits(t), "subject").select("fold_id", "split", "window_id", "subject", "y")


@query(
    "m3_fold_summary",
    f"WITH {FOLDS_SQL} SELECT fold_id, split, count(DISTINCT subject) AS num_subjects, count(*) AS num_windows FROM base JOIN splits USING (subject) GROUP BY fold_id, split",
)
def m3_summary(t):
    return fo.fold_summary(fo.fold_table(base(t), splits(t), "subject"), "subject")


@query(
    "m4_stratified_split",
    f"""WITH {FOLDS_SQL}, r AS (SELECT window_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || window_id), window_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM base)
    SELECT window_id, y, CASE WHEN k <= ceil(n * 0.2) THEN 'test' WHEN k <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def m4(t):
    return fo.stratified_split(base(t).select("window_id", "y"), "window_id", "y")


UNIT = "CAST(CAST('0x' || substr(md5('42|{part}|' || window_id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"


@query(
    "m5_balanced_resample",
    f"""WITH {FOLDS_SQL}, placed AS (SELECT window_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(window_id AS VARCHAR)), window_id) AS pos FROM base),
    d AS (SELECT window_id AS draw_id, CAST(floor({UNIT.format(part="label")} * 2) AS BIGINT) AS y, {UNIT.format(part="row")} AS u FROM base),
    n AS (SELECT y, count(*) AS n FROM base GROUP BY y),
    p AS (SELECT draw_id, d.y, CAST(floor(u * n) AS BIGINT) + 1 AS pos FROM d JOIN n USING (y))
    SELECT draw_id, y, window_id FROM p JOIN placed USING (y, pos)""",
)
def m5(t):
    return fo.balanced_resample(base(t).select("window_id", "y"), "window_id", "y")


@query(
    "u4_split_overlap",
    f"""WITH {FOLDS_SQL}, leaky AS (SELECT fold_id, subject, split FROM splits UNION ALL SELECT 1, subject, 'val' FROM tf WHERE num_windows % 7 = 0)
    SELECT fold_id, subject, count(DISTINCT split) AS num_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits
    FROM leaky GROUP BY fold_id, subject HAVING count(DISTINCT split) > 1""",
)
def u4(t):
    folds = fo.grouped_folds(base(t), "subject", K)
    leak = folds.where(F.col("num_windows") % 7 == 0).select(F.lit(1).cast("long").alias("fold_id"), "subject", F.lit("val").alias("split"))
    return fo.split_overlap(fo.subject_splits(folds, "subject", K).unionByName(leak), "subject")


@query(
    "a26_class_weights",
    f"""WITH {PREDICTIONS_SQL}, g AS (SELECT run_name, fold_id, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1 FROM predictions GROUP BY run_name, fold_id)
    SELECT *, round((n_0 + n_1) / (2 * greatest(n_0, 1)), 9) AS weight_0, round((n_0 + n_1) / (2 * greatest(n_1, 1)), 9) AS weight_1 FROM g""",
)
def a26(t):
    out = fo.class_weights(t.predictions(), ["run_name", "fold_id"], "label")
    return out.withColumn("weight_0", F.round("weight_0", 9)).withColumn("weight_1", F.round("weight_1", 9))
