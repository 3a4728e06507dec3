"""Registered queries: units, grids, interval lookup, nearest joins, resampling."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.operators import align
from sensorframe.sources.tables import SAMPLES_SQL

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


@query(
    "p10_unit_normalisation",
    f"""WITH {SAMPLES_SQL}, s AS (SELECT subject, row_idx, CASE WHEN CAST(substr(subject, 2) AS BIGINT) % 2 = 0 THEN us / 1e3 ELSE us / 1e6 END AS ts FROM samples),
    m AS (SELECT subject, median(abs(ts)) AS med FROM s GROUP BY subject)
    SELECT subject, row_idx, CAST(round(CASE WHEN med > 1e11 THEN ts / 1000.0 ELSE ts END * 1e3) AS BIGINT) AS ts_ms,
           CASE WHEN med > 1e11 THEN 'milliseconds' ELSE 'seconds' END AS unit
    FROM s JOIN m USING (subject)""",
)
def p10(t):
    even = F.substring("subject", 2, 20).cast("long") % 2 == 0
    s = t.samples().select("subject", "row_idx", F.when(even, F.col("us") / 1e3).otherwise(F.col("us") / 1e6).alias("ts"))
    out = align.normalise_units(s, ["subject"], "ts", salt_on=["row_idx"])
    return out.select("subject", "row_idx", F.round(F.col("ts") * 1e3).cast("long").alias("ts_ms"), "unit")


@query(
    "w11_target_grid",
    f"""WITH s AS (SELECT event_id, user_id % 13 + 1 AS len FROM events),
    g AS (SELECT event_id, len, unnest(range(CAST(ceil(len * 0.7 - 1e-9) AS BIGINT))) AS sample_idx FROM s)
    SELECT event_id, sample_idx, round(event_id + sample_idx / 0.7, 6) AS target_ts FROM g""",
)
def w11(t):
    e = t.events.select("event_id", F.col("event_id").cast("double").alias("start"), (F.col("user_id") % 13 + 1).alias("len"))
    e = e.withColumn("end", F.col("start") + F.col("len"))
    out = align.target_grid(e, "start", "end", 0.7)
    return out.select("event_id", "sample_idx", F.round("target_ts", 6).alias("target_ts"))


@query(
    "j7_interval_ranges",
    f"""WITH {SAMPLES_SQL},
    iv AS (SELECT subject, row_idx AS interval_id, CASE WHEN row_idx % 13 <> 5 THEN us END AS s, CASE WHEN row_idx % 11 <> 3 THEN us + 2 * {DAY_US} END AS e FROM samples WHERE label = 'purchase'),
    fr AS (SELECT subject, row_idx AS f, us FROM samples WHERE label = 'view'),
    m AS (SELECT iv.subject, interval_id, any_value(s) AS s, any_value(e) AS e, count(f) AS n, min(f) AS f0, max(f) AS f1, min(us) AS t0, max(us) AS t1
          FROM iv LEFT JOIN fr ON iv.subject = fr.subject AND us BETWEEN s AND e GROUP BY iv.subject, interval_id)
    SELECT subject, interval_id, n > 0 AS has_overlap,
           CASE WHEN n = 0 THEN 'missing' WHEN t0 <= s + 6 * {HOUR_US} AND t1 >= e - 6 * {HOUR_US} THEN 'complete' ELSE 'partial' END AS coverage_status,
           f0 AS start_frame_index, f1 + 1 AS end_frame_index_exclusive, t0 AS start_frame_ts, t1 AS end_frame_ts,
           coalesce(t1 - t0, 0) AS coverage_duration, n AS num_frames FROM m""",
)
def j7(t):
    s = t.samples()
    intervals = s.where(F.col("label") == "purchase").select(
        "subject",
        F.col("row_idx").alias("interval_id"),
        F.when(F.col("row_idx") % 13 != 5, F.col("us")).alias("s"),
        F.when(F.col("row_idx") % 11 != 3, F.col("us") + 2 * DAY_US).alias("e"),
    )
    frames = s.where(F.col("label") == "view").select("subject", F.col("row_idx").alias("f"), "us")
    return align.interval_ranges(
        intervals, frames, ["subject"], ["interval_id"], "s", "e", "us", "f", 6 * HOUR_US, 5 * DAY_US
    )


NEAREST_SQL = """
    {name} AS (
      SELECT subject, row_idx, us, f, src_us, abs(us - src_us) AS gap_us FROM (
        SELECT a.subject, a.row_idx, a.us, b.row_idx AS f, b.us AS src_us,
               row_number() OVER (PARTITION BY a.subject, a.row_idx ORDER BY abs(a.us - b.us), b.us, b.row_idx) AS rk
        FROM samples a JOIN samples b ON a.subject = b.subject AND b.label = '{label}' WHERE a.label = 'purchase')
      WHERE rk = 1 AND abs(us - src_us) <= {tol})"""


def _nearest(t, label, tolerance):
    s = t.samples()
    targets = s.where(F.col("label") == "purchase").select("subject", "row_idx", "us")
    frames = s.where(F.col("label") == label).select("subject", F.col("row_idx").alias("f"), F.col("us").alias("src_us"))
    return align.nearest_asof(
        targets, frames, ["subject"], ["row_idx"], "us", "src_us", ["f"], 5 * DAY_US, tolerance
    ).select("subject", "row_idx", "us", "f", F.col("source_ts").alias("src_us"), F.col("gap").alias("gap_us"))


@query(
    "j8_nearest_asof",
    f"WITH {SAMPLES_SQL}, {NEAREST_SQL.format(name='n', label='view', tol=6 * HOUR_US)} SELECT * FROM n",
)
def j8(t):
    return _nearest(t, "view", 6 * HOUR_US)


@query(
    "j9_two_stream_intersect",
    f"""WITH {SAMPLES_SQL}, {NEAREST_SQL.format(name='a', label='view', tol=12 * HOUR_US)}, {NEAREST_SQL.format(name='b', label='click', tol=12 * HOUR_US)}
    SELECT subject, row_idx, a.f AS depth_frame, b.f AS rgb_frame, a.gap_us AS depth_gap_us, b.gap_us AS rgb_gap_us
    FROM a JOIN b USING (subject, row_idx)""",
)
def j9(t):
    depth = _nearest(t, "view", 12 * HOUR_US).select(
        "subject", "row_idx", F.col("f").alias("depth_frame"), F.col("gap_us").alias("depth_gap_us")
    )
    rgb = _nearest(t, "click", 12 * HOUR_US).select(
        "subject", "row_idx", F.col("f").alias("rgb_frame"), F.col("gap_us").alias("rgb_gap_us")
    )
    return align.intersect_streams(depth, rgb, ["subject", "row_idx"])


@query(
    "w10_resample_grid",
    f"""WITH {SAMPLES_SQL}, r AS (SELECT subject, (us - 1704067200000000) / 1e6 AS ts, acc0, acc1, label FROM samples),
    n AS (SELECT *, lead(ts) OVER w AS nts, lead(acc0) OVER w AS n0, lead(acc1) OVER w AS n1, min(ts) OVER (PARTITION BY subject) AS t0
          FROM r WINDOW w AS (PARTITION BY subject ORDER BY ts)),
    b AS (SELECT *, CAST(ceil((ts - t0) / 14400.0 - 1e-9) AS BIGINT) AS lo,
                 CAST(coalesce(ceil((nts - t0) / 14400.0 - 1e-9) - 1, floor((ts - t0) / 14400.0 + 1e-9)) AS BIGINT) AS hi FROM n),
    g AS (SELECT *, unnest(range(lo, hi + 1)) AS sample_idx FROM b WHERE hi >= lo),
    p AS (SELECT *, CASE WHEN nts IS NULL THEN 0.0 ELSE (t0 + sample_idx * 14400.0 - ts) / (nts - ts) END AS share FROM g)
    SELECT subject, sample_idx, round(t0 + sample_idx * 14400.0, 6) AS grid_ts, round(acc0 + (coalesce(n0, acc0) - acc0) * share, 8) + 0.0 AS acc0,
           round(acc1 + (coalesce(n1, acc1) - acc1) * share, 8) + 0.0 AS acc1, label FROM p""",
)
def w10(t):
    s = t.samples().select("subject", ((F.col("us") - 1704067200000000) / 1e6).alias("ts"), "acc0", "acc1", "label")
    out = align.resample(s, ["subject"], "ts", ["acc0", "acc1"], "label", 1 / 14400.0, 5 * 86400.0)
    return out.select(
        "subject",
        "sample_idx",
        F.round("grid_ts", 6).alias("grid_ts"),
        (F.round("acc0", 8) + 0.0).alias("acc0"),
        (F.round("acc1", 8) + 0.0).alias("acc1"),
        "label",
    )
