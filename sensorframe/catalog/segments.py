"""Registered queries: runs, segments, clock reports, ordered basics."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.operators import segments as seg
from sensorframe.operators.ordered import ordered_scan, previous, row_position, row_tile
from sensorframe.sources.tables import SAMPLES_SQL

TILE_ROWS = 4096  # small enough that the test tables span several tiles
CALM, STRESS = ("view", "click"), ("purchase", "error")

RUNS_SQL = SAMPLES_SQL + """, stepped AS (
  SELECT *, row_number() OVER w AS pos,
         CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS opens
  FROM samples WINDOW w AS (PARTITION BY subject ORDER BY row_idx)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY row_idx) AS run FROM stepped)"""

TIMED_SQL = SAMPLES_SQL + """, timed AS (SELECT *, floor(us / 600e6) / 4.0 AS time FROM samples)"""


def timed(t):
    return t.samples().withColumn("time", F.floor(F.col("us") / 600e6) / 4.0)


@query(
    "w1_run_islands",
    f"WITH {RUNS_SQL} SELECT subject, row_idx, pos, min(pos) OVER (PARTITION BY subject, run) AS run_start FROM runs",
)
def w1(t):
    s = t.samples().select("subject", "row_idx", "label")
    return seg.mark_runs(s, ["subject"], "row_idx", "label", row_tile("row_idx", TILE_ROWS)).drop("label")


@query(
    "w2_task_segments",
    f"""WITH {RUNS_SQL},
    firsts AS (SELECT subject, min(us) AS first_us FROM samples GROUP BY subject),
    segs AS (SELECT subject, label AS task_id, run, min(pos) - 1 AS s, max(pos) AS e FROM runs
             WHERE label IN ('view', 'click', 'purchase', 'error') GROUP BY subject, label, run)
    SELECT subject, task_id, row_number() OVER (PARTITION BY subject, task_id ORDER BY s) AS task_segment_ordinal,
           CAST(task_id IN ('purchase', 'error') AS BIGINT) AS stress_label,
           CAST(first_us + s * 31250 AS BIGINT) AS start_us, CAST(first_us + e * 31250 AS BIGINT) AS end_us,
           s AS imu_start_row, e AS imu_end_row_exclusive, e - s AS imu_num_rows,
           round((e - s) / 32.0, 4) AS imu_task_duration_seconds
    FROM segs JOIN firsts USING (subject)""",
)
def w2(t):
    s = t.samples().withColumn("time", F.col("us") / 1e6)
    out = seg.task_segments(s, ["subject"], "row_idx", "label", "time", CALM, STRESS, 32.0, TILE_ROWS)
    return (
        out.withColumn("start_us", F.round(F.col("imu_task_start_ts") * 1e6).cast("long"))
        .withColumn("end_us", F.round(F.col("imu_task_end_ts") * 1e6).cast("long"))
        .withColumn("imu_task_duration_seconds", F.round("imu_task_duration_seconds", 4))
        .drop("imu_task_start_ts", "imu_task_end_ts")
    )


@query(
    "w3_lag_difference",
    f"""WITH {SAMPLES_SQL} SELECT subject, row_idx, us - lag(us) OVER (PARTITION BY subject ORDER BY row_idx) AS delta_us,
    round(acc0 - lag(acc0) OVER (PARTITION BY subject ORDER BY row_idx), 6) + 0.0 AS delta_acc0 FROM samples""",
)
def w3(t):
    s = t.samples().select("subject", "row_idx", "us", "acc0")
    out = ordered_scan(
        s, ["subject"], ["row_idx"], row_tile("row_idx", TILE_ROWS), {"_us": previous(F.col("us")), "_a": previous(F.col("acc0"))}
    )
    return out.select(
        "subject",
        "row_idx",
        (F.col("us") - F.col("_us")).alias("delta_us"),
        (F.round(F.col("acc0") - F.col("_a"), 6) + 0.0).alias("delta_acc0"),
    )


@query(
    "w4_rank_in_group",
    f"WITH {SAMPLES_SQL} SELECT label, row_idx, row_number() OVER (PARTITION BY label ORDER BY row_idx) AS rank FROM samples",
)
def w4(t):
    s = t.samples().select("label", "row_idx")
    return ordered_scan(s, ["label"], ["row_idx"], row_tile("row_idx", TILE_ROWS), {"rank": row_position()})


@query(
    "s5_row_order",
    f"WITH {SAMPLES_SQL} SELECT subject, us, row_idx, row_number() OVER (PARTITION BY subject ORDER BY us, row_idx) - 1 AS file_row FROM samples",
)
def s5(t):
    s = t.samples().select("subject", "us", "row_idx")
    out = ordered_scan(s, ["subject"], ["us", "row_idx"], F.floor(F.col("us") / 86400e6), {"file_row": row_position()})
    return out.withColumn("file_row", F.col("file_row") - 1)


@query(
    "p11_implicit_clock",
    f"""WITH {SAMPLES_SQL}, p AS (SELECT subject, row_idx, row_number() OVER (PARTITION BY subject ORDER BY row_idx) - 1 AS i,
      min(us) OVER (PARTITION BY subject) AS f FROM samples)
    SELECT subject, row_idx, CAST(f + i * 31250 AS BIGINT) AS clock_us FROM p""",
)
def p11(t):
    from sensorframe.operators.align import implicit_clock

    s = t.samples().select("subject", "row_idx", (F.col("us") / 1e6).alias("time"))
    out = implicit_clock(s, ["subject"], "row_idx", "time", 32.0, row_tile("row_idx", TILE_ROWS))
    return out.select("subject", "row_idx", F.round(F.col("clock") * 1e6).cast("long").alias("clock_us"))


@query(
    "a1_clock_summary",
    f"""WITH {TIMED_SQL},
    steps AS (SELECT subject, time - lag(time) OVER (PARTITION BY subject ORDER BY row_idx) AS d FROM timed),
    rs AS (SELECT subject, count(*) FILTER (abs(d) <= 1e-12) AS num_zero_diffs, count(*) FILTER (d < 0) AS num_negative_diffs,
                  min(d) FILTER (d > 0) AS min_positive_row_diff, median(d) FILTER (d > 0) AS median_positive_row_diff
           FROM steps GROUP BY subject),
    us AS (SELECT subject, time - lag(time) OVER (PARTITION BY subject ORDER BY time) AS d
           FROM (SELECT DISTINCT subject, time FROM timed)),
    ds AS (SELECT subject, count(*) AS num_unique_timestamps, min(d) AS min_unique_timestamp_diff,
                  median(d) AS median_unique_timestamp_diff FROM us GROUP BY subject),
    c AS (SELECT subject, count(*) AS num_rows, count(time) AS num_valid_time_rows, min(time) AS start_time, max(time) AS end_time,
                 bool_and(time - floor(time) <= 1e-9) AS all_timestamps_integer, count(DISTINCT label) AS num_distinct_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS observed_labels FROM timed GROUP BY subject)
    SELECT c.*, num_unique_timestamps, end_time - start_time AS duration_seconds,
           round(CASE WHEN end_time > start_time THEN num_valid_time_rows / (end_time - start_time) END, 6) AS estimated_sample_rate_hz,
           round(num_valid_time_rows / num_unique_timestamps, 6) AS avg_rows_per_unique_timestamp,
           num_zero_diffs, num_negative_diffs, min_positive_row_diff, median_positive_row_diff,
           min_unique_timestamp_diff, median_unique_timestamp_diff
    FROM c JOIN rs USING (subject) JOIN ds USING (subject)""",
)
def a1(t):
    out = seg.clock_summary(timed(t), ["subject"], "row_idx", "label", "time", row_tile("row_idx", TILE_ROWS), 24.0)
    return out.withColumn("estimated_sample_rate_hz", F.round("estimated_sample_rate_hz", 6)).withColumn(
        "avg_rows_per_unique_timestamp", F.round("avg_rows_per_unique_timestamp", 6)
    )


@query(
    "a2_timestamp_counts",
    f"""WITH {TIMED_SQL}, g AS (SELECT subject, time, count(*) AS num_rows, arg_min(label, row_idx) AS first_label,
      arg_max(label, row_idx) AS last_label, count(DISTINCT label) AS unique_labels FROM timed GROUP BY subject, time)
    SELECT *, time - lag(time) OVER (PARTITION BY subject ORDER BY time) AS delta_from_prev,
           time - floor(time) <= 1e-9 AS is_integer_time FROM g""",
)
def a2(t):
    return seg.timestamp_counts(timed(t), ["subject"], "row_idx", "label", "time", 24.0)


@query(
    "a3_segment_summary",
    f"""WITH {TIMED_SQL}, r AS (
      SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY row_idx) AS run FROM (
        SELECT *, row_number() OVER w AS pos, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS opens
        FROM timed WINDOW w AS (PARTITION BY subject ORDER BY row_idx)))
    SELECT subject, label, min(pos) - 1 AS start_row, max(pos) - 1 AS end_row, count(*) AS num_rows, min(time) AS start_time,
           max(time) AS end_time, count(DISTINCT time) AS unique_timestamps, max(time) - min(time) AS duration_seconds_wall
    FROM r GROUP BY subject, label, run""",
)
def a3(t):
    return seg.run_summary(timed(t), ["subject"], "row_idx", "label", "time", row_tile("row_idx", TILE_ROWS))
