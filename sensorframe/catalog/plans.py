"""Registered queries: whole plans from raw rows to their last table."""

from pyspark.sql import functions as F

from sensorframe.catalog.metrics import RUN
from sensorframe.catalog.models import AUDIT_SQL
from sensorframe.catalog.registry import query
from sensorframe.catalog.segments import CALM, RUNS_SQL, STRESS, TILE_ROWS
from sensorframe.catalog.vectors import DIMS_SQL, SUMMED, summed
from sensorframe.operators.metrics import METRICS
from sensorframe.plans.audit import audit_report
from sensorframe.plans.selection import selected_windows
from sensorframe.plans.task_frames import aligned_task_frames

HOUR = 3_600_000_000

# One sensor row stands for eight hours, one grid point for two.
FRAMES_OF = """{n} AS (SELECT task_key, sample_idx, f AS {n}_frame, src AS {n}_source_us FROM (
    SELECT g.task_key, g.sample_idx, c.row_idx AS f, c.us AS src, abs(c.us - target_us) AS gap, row_number() OVER (PARTITION BY g.task_key, g.sample_idx ORDER BY abs(c.us - target_us), c.us, c.row_idx) AS k
    FROM g JOIN samples c ON c.subject = g.subject AND c.label = '{label}' AND c.us BETWEEN start_us AND end_us) WHERE k = 1 AND gap <= 3 * 3600000000)"""
COVER = """{n}c AS (SELECT task_key, count(c.us) AS n, min(c.us) AS t0, max(c.us) AS t1 FROM s LEFT JOIN samples c ON c.subject = s.subject AND c.label = '{label}' AND c.us BETWEEN start_us AND end_us GROUP BY task_key)"""


@query(
    "e2e_aligned_task_frames",
    f"""WITH {RUNS_SQL}, firsts AS (SELECT subject, min(us) AS first_us FROM samples GROUP BY subject),
    segs AS (SELECT subject, label AS task_id, run, min(pos) - 1 AS a, max(pos) AS b FROM runs WHERE label IN ('view', 'click', 'purchase', 'error') GROUP BY subject, label, run),
    s AS (SELECT subject, subject || '__' || task_id || '__' || printf('%02d', row_number() OVER (PARTITION BY subject, task_id ORDER BY a)) AS task_key, CAST(task_id IN ('purchase', 'error') AS BIGINT) AS stress_label,
      first_us + a * 28800000000 AS start_us, first_us + b * 28800000000 AS end_us FROM segs JOIN firsts USING (subject)),
    {COVER.format(n='d', label='view')}, {COVER.format(n='r', label='click')},
    g AS (SELECT *, start_us + sample_idx * 7200000000 AS target_us FROM (SELECT s.*, unnest(range((end_us - start_us) // 7200000000)) AS sample_idx FROM s JOIN dc USING (task_key) JOIN rc USING (task_key) WHERE dc.n > 0 AND rc.n > 0)),
    {FRAMES_OF.format(n='depth', label='view')}, {FRAMES_OF.format(n='rgb', label='click')}
    SELECT subject, task_key, stress_label, sample_idx, CAST(target_us AS BIGINT) AS target_us, depth_frame, depth_source_us, rgb_frame, rgb_source_us FROM g JOIN depth USING (task_key, sample_idx) JOIN rgb USING (task_key, sample_idx)""",
)
def aligned(t):
    s = t.samples()

    def clock(label):
        return s.where(F.col("label") == label).select("subject", F.col("row_idx").alias("frame_idx"), F.col("us").alias("ts_us"))

    return aligned_task_frames(
        s.withColumn("time", F.col("us") / 1e6),
        {"depth": clock("view"), "rgb": clock("click")},
        "subject",
        "row_idx",
        "label",
        "time",
        CALM,
        STRESS,
        1 / 28800.0,
        1 / 7200.0,
        HOUR,
        3 * HOUR,
        TILE_ROWS,
        5 * 24 * HOUR,
    )


_RUN = ", ".join(RUN)


@query(
    "e2e_strategy_report",
    f"""WITH RECURSIVE {AUDIT_SQL}, m AS (SELECT {_RUN}, strategy, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM au WHERE split = 'test' GROUP BY {_RUN}, strategy)
    SELECT {_RUN}, a.strategy, {", ".join(f"round(a.{m} - b.{m}, 6) + 0.0 AS {m}_mean_delta" for m in METRICS)}
    FROM m a JOIN m b USING ({_RUN}) WHERE a.strategy <> 'current_saved_threshold' AND b.strategy = 'current_saved_threshold'""",
)
def strategy_report(t):
    _, _, deltas = audit_report(t.predictions(), RUN, digits=9)
    return deltas.select(*RUN, "strategy", *[(F.round(c, 6) + 0.0).alias(c) for c in deltas.columns if c.endswith("_delta")])


@query(
    "e2e_selected_frames",
    f"""WITH {DIMS_SQL}, st AS (SELECT d, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM dims GROUP BY d),
    z AS (SELECT window_id, frame_idx, d, abs((v - m) / s) AS a FROM dims JOIN st USING (d)), n AS (SELECT window_id, frame_idx, sqrt(sum(a * a)) AS l2 FROM z GROUP BY 1, 2),
    i AS (SELECT window_id, frame_idx, -sum((a / (l2 + 1e-8)) * ln(a / (l2 + 1e-8) + 1e-10)) AS info FROM z JOIN n USING (window_id, frame_idx) GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY info DESC, frame_idx DESC) AS k, count(*) OVER (PARTITION BY window_id) AS n FROM i)
    SELECT window_id, {SUMMED} FROM (SELECT window_id, d, avg(v) AS v FROM dims JOIN c USING (window_id, frame_idx) WHERE k <= 5 AND n >= 5 GROUP BY window_id, d) GROUP BY window_id""",
)
def selected(t):
    _, pooled, _ = selected_windows(t.frames(), ["window_id"], "frame_idx", "px", 5)
    return summed(pooled, "window_id")
