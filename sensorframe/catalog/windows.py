"""Registered queries: sliding windows, quality, subject tables."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.catalog.segments import TILE_ROWS
from sensorframe.operators import windows as win
from sensorframe.operators.ordered import dense_ids, ordered_scan, row_position, row_tile
from sensorframe.operators.segments import mark_runs
from sensorframe.operators.vectors import reserved_baseline_stats
from sensorframe.sources.tables import SAMPLES_SQL

WINDOW, STRIDE = 4, 2
AXES = ["acc0", "acc1", "acc2"]
SEGMENT = ["subject", "task", "run_start"]

SEG_SQL = SAMPLES_SQL + """, tasks AS (
  SELECT *, CASE WHEN label IN ('view', 'click') THEN 'calm' WHEN label IN ('purchase', 'error') THEN 'stress' ELSE 'rest' END AS task
  FROM samples), tstep AS (
  SELECT *, row_number() OVER w AS pos, CASE WHEN lag(task) OVER w IS DISTINCT FROM task THEN 1 ELSE 0 END AS opens
  FROM tasks WINDOW w AS (PARTITION BY subject ORDER BY row_idx)), trun AS (
  SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY row_idx) AS run FROM tstep), seg AS (
  SELECT *, min(pos) OVER (PARTITION BY subject, run) AS run_start, pos - min(pos) OVER (PARTITION BY subject, run) AS p
  FROM trun WHERE task <> 'rest'), cov AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil((p - 3) / 2.0)) AS BIGINT), p // 2 + 1)) AS window_no FROM seg)"""

WIN_SQL = SEG_SQL + """, win AS (
  SELECT subject, task, run_start, window_no, min(row_idx) AS start_row, max(row_idx) AS end_row, count(*) AS num_rows,
         CASE WHEN task = 'stress' THEN 1 ELSE 0 END AS y
  FROM cov GROUP BY subject, task, run_start, window_no HAVING count(*) = 4)"""


def segmented(t):
    """Sensor rows inside target segments, with their 0-based position ``p``."""
    task = (
        F.when(F.col("label").isin("view", "click"), "calm").when(F.col("label").isin("purchase", "error"), "stress").otherwise("rest")
    )
    s = t.samples().withColumn("task", task)
    marked = mark_runs(s, ["subject"], "row_idx", "task", row_tile("row_idx", TILE_ROWS))
    return marked.where(F.col("task") != "rest").withColumn("p", F.col("pos") - F.col("run_start"))


def windows(t):
    """Full windows with a binary label."""
    return win.sliding_windows(segmented(t), SEGMENT, "p", "row_idx", WINDOW, STRIDE).withColumn(
        "y", (F.col("task") == "stress").cast("long")
    )


@query("w5_sliding_windows", f"WITH {WIN_SQL} SELECT subject, task, run_start, window_no, start_row, end_row, num_rows, CAST(y AS BIGINT) AS y FROM win")
def w5(t):
    return windows(t)


@query(
    "w5_segment_yield",
    f"""WITH {SEG_SQL}, n AS (SELECT subject, task, run_start, count(*) AS num_rows FROM seg GROUP BY subject, task, run_start)
    SELECT *, CASE WHEN num_rows < 4 THEN 0 ELSE (num_rows - 4) // 2 + 1 END AS num_windows, num_rows < 4 AS too_short FROM n""",
)
def w5_yield(t):
    return win.segment_yield(segmented(t), SEGMENT, WINDOW, STRIDE)


@query(
    "w6_window_quality",
    f"""WITH {SEG_SQL}, q AS (SELECT subject, run_start, window_no, count(*) AS num_rows,
      greatest(stddev_pop(acc0), stddev_pop(acc1), stddev_pop(acc2)) AS mx, stddev_pop(sqrt(acc0 * acc0 + acc1 * acc1 + acc2 * acc2)) AS mg
      FROM cov GROUP BY subject, run_start, window_no HAVING count(*) = 4)
    SELECT subject, run_start, window_no, round(mx, 5) AS max_axis_std, round(mg, 5) AS magnitude_std FROM q WHERE mx >= 30 AND mg >= 20""",
)
def w6(t):
    q = win.sliding_windows(segmented(t), SEGMENT, "p", "row_idx", WINDOW, STRIDE, win.quality_aggs(AXES))
    return q.where(win.passes_quality(30, 20)).select(
        "subject", "run_start", "window_no", F.round("max_axis_std", 5).alias("max_axis_std"), F.round("magnitude_std", 5).alias("magnitude_std")
    )


FEATURES_SQL = WIN_SQL + """, long AS (
  SELECT c.subject, c.run_start, c.window_no, p, unnest(['acc0', 'acc1', 'magnitude']) AS signal,
         unnest([acc0, acc1, sqrt(acc0 * acc0 + acc1 * acc1 + acc2 * acc2)]) AS v
  FROM cov c JOIN win USING (subject, run_start, window_no)), cen AS (
  SELECT *, v - avg(v) OVER k AS c, sign(v) * lag(sign(v)) OVER (PARTITION BY subject, run_start, window_no, signal ORDER BY p) < 0 AS flip
  FROM long WINDOW k AS (PARTITION BY subject, run_start, window_no, signal)), feat AS (
  SELECT subject, run_start, window_no, signal, avg(v) AS mean, sqrt(avg(c * c)) AS std, min(v) AS min, max(v) AS max, max(v) - min(v) AS ptp,
         sum(v) AS total, sum(v * v) AS energy, sqrt(avg(v * v)) AS rms,
         CASE WHEN avg(c * c) > 0 THEN avg(c ** 3) / (avg(c * c) ** 1.5) ELSE 0.0 END AS skewness,
         CASE WHEN avg(c * c) > 0 THEN avg(c ** 4) / (avg(c * c) * avg(c * c)) - 3.0 ELSE 0.0 END AS kurtosis,
         quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95,
         quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, CAST(count(*) FILTER (c > 0) AS DOUBLE) AS n_above_mean,
         CAST(count(*) FILTER (c < 0) AS DOUBLE) AS n_below_mean, CAST(count(*) FILTER (flip) AS DOUBLE) AS n_sign_changes
  FROM cen GROUP BY subject, run_start, window_no, signal)"""


def features(t):
    s = segmented(t).withColumn("magnitude", F.sqrt(F.col("acc0") ** 2 + F.col("acc1") ** 2 + F.col("acc2") ** 2))
    return win.pane_features(s, ["subject", "run_start"], "p", ["acc0", "acc1", "magnitude"], WINDOW, STRIDE)


# n_above/below are left out of the hash: they depend on the last bit of a mean.
HASHED = [c for c in win.FEATURES if c not in ("n_above_mean", "n_below_mean")]


@query(
    "a25_window_features",
    f"WITH {FEATURES_SQL} SELECT subject, run_start, window_no, signal, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in HASHED) + " FROM feat",
)
def a25(t):
    return features(t).select("subject", "run_start", "window_no", "signal", *[(F.round(c, 4) + 0.0).alias(c) for c in HASHED])


@query(
    "a25_baseline_delta",
    f"""WITH {FEATURES_SQL}, base AS (SELECT subject, signal, avg(mean) AS bm, avg(std) AS bs FROM feat WHERE window_no = 0 GROUP BY subject, signal)
    SELECT subject, run_start, window_no, signal, round(mean - bm, 8) + 0.0 AS mean_delta, round(std - bs, 8) + 0.0 AS std_delta
    FROM feat JOIN base USING (subject, signal)""",
)
def a25_delta(t):
    f = features(t).select("subject", "run_start", "window_no", "signal", "mean", "std")
    out = win.baseline_delta(f, f.where(F.col("window_no") == 0), ["subject", "signal"], ["mean", "std"], "delta")
    return out.select(
        "subject", "run_start", "window_no", "signal", *[(F.round(c, 8) + 0.0).alias(c) for c in ("mean_delta", "std_delta")]
    )


MASK_SQL = SAMPLES_SQL + """, track AS (
  SELECT subject AS task, row_number() OVER (PARTITION BY subject ORDER BY row_idx) - 1 AS frame_idx,
         CASE label WHEN 'error' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS mask_source,
         CASE WHEN label <> 'error' THEN acc0 / 500 END AS area,
         CASE label WHEN 'error' THEN -1 WHEN 'purchase' THEN row_idx % 17 ELSE 0 END AS age, row_idx % 3 AS boxes
  FROM samples), mcov AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil((frame_idx - 7) / 4.0)) AS BIGINT), frame_idx // 4 + 1)) AS window_no FROM track), mj AS (
  SELECT *, CASE WHEN area IS NOT NULL THEN abs(area - last_value(area IGNORE NULLS) OVER (PARTITION BY task, window_no ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS jump FROM mcov), mst AS (
  SELECT task, window_no, count(*) FILTER (mask_source = 0) AS missing_mask_frames, count(*) FILTER (mask_source = 0) / 8.0 AS missing_mask_fraction,
         count(*) FILTER (mask_source = 1) / 8.0 AS mask_direct_fraction, count(*) FILTER (mask_source = 2) / 8.0 AS mask_carry_fraction,
         avg(area) AS mask_area_mean, median(area) AS mask_area_median, stddev_pop(area) AS mask_area_std,
         coalesce(quantile_cont(jump, 0.95), 0.0) AS mask_area_jump_p95, CAST(max(age) AS DOUBLE) AS mask_age_max, avg(boxes) AS yolo_box_mean
  FROM mj GROUP BY task, window_no HAVING count(*) = 8), mtier AS (
  SELECT *, CASE WHEN missing_mask_frames > 4 THEN 'missing_mask_frames>4' WHEN missing_mask_fraction > 0.5 THEN 'missing_mask_fraction>0.5'
    WHEN mask_area_mean IS NULL THEN 'mask_area_mean_not_finite' WHEN mask_area_mean < 0.08 THEN 'mask_area_mean<0.08'
    WHEN mask_area_mean > 0.85 THEN 'mask_area_mean>0.85' WHEN mask_age_max > 15 THEN 'mask_age_max>15'
    WHEN missing_mask_fraction <= 0.10 AND mask_direct_fraction >= 0.70 AND mask_age_max <= 10 AND mask_area_jump_p95 <= 0.20 THEN 'clean'
    WHEN missing_mask_fraction <= 0.25 AND mask_direct_fraction >= 0.50 AND mask_age_max <= 15 AND mask_area_jump_p95 <= 0.25 THEN 'usable'
    WHEN missing_mask_fraction <= 0.50 AND mask_direct_fraction >= 0.25 AND mask_age_max <= 15 AND mask_area_jump_p95 <= 0.35 THEN 'inspect'
    ELSE 'tier_threshold_failed' END AS verdict FROM mst), mq AS (
  SELECT *, CASE WHEN verdict IN ('clean', 'usable', 'inspect') THEN verdict ELSE 'drop' END AS tier,
    CASE WHEN verdict IN ('clean', 'usable') THEN '' WHEN verdict = 'inspect' THEN 'mask_quality_tier_not_allowed:inspect' ELSE verdict END AS reason
  FROM mtier)"""


def mask_track(t):
    s = t.samples().select("subject", "row_idx", "label", "acc0")
    s = ordered_scan(s, ["subject"], ["row_idx"], row_tile("row_idx", TILE_ROWS), {"pos": row_position()})
    lab = F.col("label")
    return s.select(
        F.col("subject").alias("task"),
        (F.col("pos") - 1).alias("frame_idx"),
        F.when(lab == "error", 0).when(lab == "purchase", 2).otherwise(1).alias("mask_source"),
        F.when(lab != "error", F.col("acc0") / 500).alias("mask_area_fraction"),
        F.when(lab == "error", F.lit(-1)).when(lab == "purchase", F.col("row_idx") % 17).otherwise(F.lit(0)).alias("mask_age_frames"),
        (F.col("row_idx") % 3).alias("yolo_box_count"),
    )


def mask_stats(t):
    return win.mask_window_stats(mask_track(t), ["task"], "frame_idx", 8, 4)


MASK_COLS = (
    "missing_mask_fraction mask_direct_fraction mask_carry_fraction mask_area_mean mask_area_median mask_area_std mask_area_jump_p95 mask_age_max yolo_box_mean"
).split()


@query(
    "a7_mask_window_stats",
    f"WITH {MASK_SQL} SELECT task, window_no, missing_mask_frames, " + ", ".join(f"round({c}, 10) AS {c}" for c in MASK_COLS) + " FROM mst",
)
def a7(t):
    return mask_stats(t).select("task", "window_no", "missing_mask_frames", *[F.round(c, 10).alias(c) for c in MASK_COLS])


def tiered(t):
    q = mask_stats(t).withColumn("_q", win.quality_tier(8, min_area=0.08))
    q = q.withColumn("tier", F.col("_q.tier"))
    return q.withColumn("reason", win.reject_reason(F.col("tier"), F.col("_q.reason"), ("clean", "usable"))).drop("_q")


@query("p19_quality_tier", f"WITH {MASK_SQL} SELECT task, window_no, tier, reason FROM mq")
def p19(t):
    short = F.when(F.col("reason").startswith("tier_threshold_failed"), "tier_threshold_failed").otherwise(F.col("reason"))
    return tiered(t).select("task", "window_no", "tier", short.alias("reason"))


BUCKET_SQL = """CASE WHEN reason = '' THEN NULL WHEN reason LIKE 'missing_mask%' THEN 'missing_mask' WHEN reason LIKE 'mask_area%' THEN 'mask_area'
  WHEN reason LIKE 'mask_age%' THEN 'mask_age' WHEN reason LIKE 'mask_quality_tier%' THEN 'mask_quality_tier' ELSE 'other' END"""


@query("p20_reason_bucket", f"WITH {MASK_SQL} SELECT task, window_no, {BUCKET_SQL} AS bucket FROM mq")
def p20(t):
    return tiered(t).select("task", "window_no", win.drop_bucket(F.col("reason")).alias("bucket"))


@query(
    "a8_window_drop_summary",
    f"""WITH {MASK_SQL}, lens AS (SELECT task, count(*) AS n FROM track GROUP BY task), b AS (SELECT *, {BUCKET_SQL} AS bucket FROM mq),
    c AS (SELECT task, count(*) AS candidate_windows, count(*) FILTER (reason = '') AS kept_windows,
      count(*) FILTER (bucket = 'missing_mask') AS dropped_missing_mask_windows, count(*) FILTER (bucket = 'mask_area') AS dropped_mask_area_windows,
      count(*) FILTER (bucket = 'mask_age') AS dropped_mask_age_windows, count(*) FILTER (bucket = 'mask_quality_tier') AS dropped_mask_quality_tier_windows,
      count(*) FILTER (bucket = 'other') AS dropped_other_mask_quality_windows, count(*) FILTER (tier = 'clean') AS clean_windows,
      count(*) FILTER (tier = 'usable') AS usable_windows, count(*) FILTER (tier = 'inspect') AS inspect_windows, count(*) FILTER (tier = 'drop') AS drop_tier_windows
      FROM b GROUP BY task)
    SELECT task, CAST(n < 8 AS BIGINT) AS dropped_short_task, coalesce(candidate_windows, 0) AS candidate_windows, coalesce(kept_windows, 0) AS kept_windows,
      coalesce(dropped_missing_mask_windows, 0) AS dropped_missing_mask_windows, coalesce(dropped_mask_area_windows, 0) AS dropped_mask_area_windows,
      coalesce(dropped_mask_age_windows, 0) AS dropped_mask_age_windows, coalesce(dropped_mask_quality_tier_windows, 0) AS dropped_mask_quality_tier_windows,
      coalesce(dropped_other_mask_quality_windows, 0) AS dropped_other_mask_quality_windows, coalesce(clean_windows, 0) AS clean_windows,
      coalesce(usable_windows, 0) AS usable_windows, coalesce(inspect_windows, 0) AS inspect_windows, coalesce(drop_tier_windows, 0) AS drop_tier_windows
    FROM lens LEFT JOIN c USING (task)""",
)
def a8(t):
    lengths = t.samples().groupBy(F.col("subject").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return win.drop_summary(lengths, tiered(t), ["task"], "n", 8)


@query(
    "j12_mask_lookup",
    f"""WITH {MASK_SQL}, w AS (SELECT subject AS task, row_number() OVER (PARTITION BY subject ORDER BY row_idx) - 1 AS window_no FROM samples)
    SELECT task, window_no, coalesce(missing_mask_frames, 8) AS missing_mask_frames, coalesce(missing_mask_fraction, 1.0) AS missing_mask_fraction,
           coalesce(mask_direct_fraction, 0.0) AS mask_direct_fraction, coalesce(mask_carry_fraction, 0.0) AS mask_carry_fraction, round(mask_area_mean, 10) AS mask_area_mean
    FROM w LEFT JOIN mst USING (task, window_no)""",
)
def j12(t):
    s = t.samples().select(F.col("subject").alias("task"), "row_idx")
    w = ordered_scan(s, ["task"], ["row_idx"], row_tile("row_idx", TILE_ROWS), {"pos": row_position()})
    w = w.select("task", (F.col("pos") - 1).alias("window_no"))
    out = win.attach_mask_stats(w, mask_stats(t), ["task", "window_no"], 8)
    return out.select(
        "task", "window_no", "missing_mask_frames", *win.MASK_DEFAULTS, F.round("mask_area_mean", 10).alias("mask_area_mean")
    )


@query(
    "a9_subject_inclusion",
    f"""WITH {WIN_SQL}, g AS (SELECT subject, count(*) AS num_windows, count(*) FILTER (y = 0) AS label_0_windows, count(*) FILTER (y = 1) AS label_1_windows,
      string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM win GROUP BY subject)
    SELECT *, label_0_windows > 0 AND label_1_windows > 0 AS keep, CASE WHEN label_0_windows = 0 THEN 'missing_label_[0]' WHEN label_1_windows = 0 THEN 'missing_label_[1]' ELSE 'included' END AS reason FROM g""",
)
def a9(t):
    return win.subject_inclusion(windows(t), "subject", "y", "task")


@query(
    "j14_qualified_subjects",
    f"""WITH {WIN_SQL} SELECT subject, run_start, window_no, CAST(y AS BIGINT) AS y FROM win
    WHERE subject IN (SELECT subject FROM win GROUP BY subject HAVING min(y) = 0 AND max(y) = 1)""",
)
def j14(t):
    return win.qualified_only(windows(t).select("subject", "run_start", "window_no", "y"), "subject", "y")


@query(
    "t2_dense_window_id",
    f"WITH {WIN_SQL} SELECT subject, task, start_row, row_number() OVER (ORDER BY subject, task, start_row) - 1 AS window_id FROM win",
)
def t2(t):
    return dense_ids(windows(t).select("subject", "task", "start_row"), ["subject", "task", "start_row"], "window_id")


@query(
    "w13_reserve_baseline",
    f"""WITH {WIN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, task ORDER BY start_row) AS k, count(*) FILTER (task = 'calm') OVER (PARTITION BY subject) AS nb FROM win)
    SELECT subject, task, start_row, CASE WHEN task = 'calm' AND k <= 3 THEN 'reserved' ELSE 'rest' END AS part FROM r WHERE nb >= 3
    UNION ALL SELECT subject, NULL, any_value(nb), 'dropped' FROM r WHERE nb < 3 GROUP BY subject""",
)
def w13(t):
    w = windows(t).withColumn("wid", F.concat_ws("-", "subject", "start_row"))
    reserved, rest = win.reserve_baseline(w, "subject", "task", "calm", ["start_row"], "wid", 3)
    short = win.short_baselines(w, "subject", "task", "calm", 3)
    parts = [d.select("subject", "task", "start_row", F.lit(n).alias("part")) for d, n in ((reserved, "reserved"), (rest, "rest"))]
    short = short.select("subject", F.lit(None).cast("string").alias("task"), F.col("num_baseline_windows").alias("start_row"), F.lit("dropped").alias("part"))
    return parts[0].unionByName(parts[1]).unionByName(short)


@query(
    "a18_reserved_baseline",
    f"""WITH {WIN_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_row) AS k, count(*) OVER (PARTITION BY subject) AS n FROM win WHERE task = 'calm'),
    b AS (SELECT c.subject, acc0, acc1 FROM cov c JOIN k USING (subject, task, run_start, window_no) WHERE k <= 3 AND n >= 3),
    m AS (SELECT subject, avg(acc0) AS m0, avg(acc1) AS m1 FROM b GROUP BY subject)
    SELECT subject, round(max(m0), 7) + 0.0 AS acc0_mean, round(avg(abs(acc0 - m0)), 7) + 0.0 AS acc0_mad, round(stddev_pop(acc0), 7) + 0.0 AS acc0_std,
      round(max(m1), 7) + 0.0 AS acc1_mean, round(avg(abs(acc1 - m1)), 7) + 0.0 AS acc1_mad, round(stddev_pop(acc1), 7) + 0.0 AS acc1_std FROM b JOIN m USING (subject) GROUP BY subject""",
)
def a18_reserved(t):
    w = windows(t).withColumn("wid", F.concat_ws("-", "subject", "start_row"))
    reserved, _ = win.reserve_baseline(w, "subject", "task", "calm", ["start_row"], "wid", 3)
    covered = win.assign_windows(segmented(t), "p", WINDOW, STRIDE)
    got = reserved_baseline_stats(covered, reserved, [*SEGMENT, "window_no"], ["subject"], ["acc0", "acc1"], ["row_idx"])
    return got.select("subject", *[(F.round(f"{a}_{s}", 7) + 0.0).alias(f"{a}_{s}") for a in ("acc0", "acc1") for s in ("mean", "mad", "std")])


@query(
    "w14_balanced_sample",
    f"""WITH {WIN_SQL}, r AS (SELECT subject, y, start_row, row_number() OVER (PARTITION BY y, subject ORDER BY start_row) AS k FROM win)
    SELECT subject, CAST(y AS BIGINT) AS y, start_row FROM r ORDER BY k, y, subject, start_row LIMIT 100""",
)
def w14(t):
    w = windows(t).select("subject", "y", "start_row")
    return win.balanced_sample(w, "y", "subject", ["start_row"], 100, row_tile("start_row", TILE_ROWS))


@query(
    "w12_trailing_context",
    f"""WITH {WIN_SQL}, r AS (SELECT subject, task, start_row, row_number() OVER (PARTITION BY subject, task ORDER BY start_row) AS pos FROM win)
    SELECT a.subject, a.task, a.start_row, a.pos, 4 - (a.pos - b.pos) AS slot, b.start_row AS context_row
    FROM r a JOIN r b ON a.subject = b.subject AND a.task = b.task AND b.pos BETWEEN a.pos - 4 AND a.pos""",
)
def w12(t):
    w = windows(t).select("subject", "task", "start_row", F.col("start_row").alias("context_row"))
    return win.trailing_context(w, ["subject", "task"], "start_row", ["context_row"], 5, row_tile("start_row", TILE_ROWS))


@query(
    "t4_first_n_per_group",
    f"""WITH {WIN_SQL} SELECT task, subject, start_row FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY subject, start_row) AS k FROM win) WHERE k <= 50""",
)
def t4(t):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("task").orderBy("subject", "start_row"))
    return windows(t).withColumn("k", rank).where(F.col("k") <= 50).select("task", "subject", "start_row")
