"""Registered queries: discovery, sinks, freshness, streaming forms."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.catalog.registry import query
from sensorframe.session import checkpoint_dir
from sensorframe.sources import io
from sensorframe.sources.tables import PREDICTIONS_SQL, SAMPLES_SQL
from sensorframe.streaming import streams as st


def scratch(t):
    """A new folder in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/tables-{uuid.uuid4().hex}"


def sample_tree(t):
    """Sensor rows as a CSV tree group/stem, the layout discovery reads."""
    root = scratch(t)
    s = t.samples().select(
        F.concat(F.lit("G"), (F.substring("subject", 2, 9).cast("int") % 3).cast("string")).alias("grp"),
        (F.substring("subject", 2, 9).cast("int") % 4).cast("string").alias("stem"),
        "row_idx",
        "us",
        "label",
    )
    s.repartition("grp", "stem").write.partitionBy("grp", "stem").option("header", True).csv(root)
    return root


CSV = T.StructType([T.StructField("row_idx", T.LongType()), T.StructField("us", T.LongType()), T.StructField("label", T.StringType())])


@query(
    "s2_recursive_discovery",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT 'G' || (CAST(substr(subject, 2) AS BIGINT) % 3) AS grp, CAST(CAST(substr(subject, 2) AS BIGINT) % 4 AS VARCHAR) AS stem, us FROM samples)
    SELECT grp, stem, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM f WHERE stem <> '3' GROUP BY grp, stem""",
)
def s2(t):
    rows = io.discover(t.spark, sample_tree(t), CSV, r"/grp=([^/]+)/stem=([^/]+)/[^/]+$", ["grp", "stem"], "*.csv", "csv", {"stem": ["3"]})
    return rows.groupBy("grp", "stem").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


PRED = T.StructType([T.StructField("label", T.LongType()), T.StructField("score", T.DoubleType())])


@query(
    "s3_run_tree",
    f"WITH {PREDICTIONS_SQL} SELECT run_name, encoder, feature, 'probe' AS model_family, count(*) AS n, round(sum(score), 4) AS total FROM predictions GROUP BY run_name, encoder, feature",
)
def s3(t):
    root = scratch(t)
    p = t.predictions()
    # One folder per combination: its name ends in the file name the layout fixes.
    combos = [(r, e, f) for r in ("run_O", "run_F") for e in ("enc0", "enc1") for f in ("feat0", "feat1")]
    for r, e, f in combos:
        rows = p.where((F.col("run_name") == r) & (F.col("encoder") == e) & (F.col("feature") == f)).select("label", "score")
        rows.write.option("header", True).csv(f"{root}/runs/{r}/{e}/{f}/probe/fold_predictions.csv")
    # A file at the wrong depth, which discovery must leave out.
    p.groupBy("label").agg(F.max("score").alias("score")).write.option("header", True).csv(f"{root}/runs/run_X/fold_predictions.csv")
    got = io.run_tree(t.spark, root, PRED)
    return got.groupBy(*io.RUN_KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


TASK_SQL = f"WITH {SAMPLES_SQL}, s AS (SELECT 'G' || (CAST(substr(subject, 2) AS BIGINT) % 3) AS grp, label AS task, row_idx, acc0 FROM samples)"


def task_rows(t):
    g = F.concat(F.lit("G"), (F.substring("subject", 2, 9).cast("int") % 3).cast("string"))
    return t.samples().select("row_idx", "acc0", g.alias("grp"), F.col("label").alias("task"))


@query("s6_idempotent_sink", f"{TASK_SQL} SELECT grp, task, count(*) AS n, round(sum(CASE WHEN task = 'view' THEN 1.0 ELSE acc0 END), 4) AS total FROM s GROUP BY grp, task")
def s6(t):
    """Stored complete keys are kept, an incomplete one is rewritten, new ones are added."""
    path = scratch(t)
    rows = task_rows(t)
    done = rows.where(F.col("task") == "view").withColumn("acc0", F.lit(1.0))
    broken = rows.where(F.col("task") == "click").withColumn("acc0", F.lit(None).cast("double"))
    io.write_partitioned(done.unionByName(broken), path, ["grp", "task"])
    io.write_missing(rows, path, ["grp", "task"], F.col("acc0").isNotNull())
    stored = t.spark.read.schema(rows.schema).parquet(path)
    return stored.groupBy("grp", "task").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acc0"), 4).alias("total"))


@query(
    "s7_freshness_check",
    f"{TASK_SQL} SELECT count(*) AS n, true AS has_present, false AS has_absent FROM s",
)
def s7(t):
    path = scratch(t)
    rows = task_rows(t)
    rows.write.parquet(path)
    source = [f"{t.folder}/events.parquet"]
    present = io.is_current(t.spark, path, source, "task", ["view", "click"])
    absent = io.is_current(t.spark, path, source, "task", ["view", "no_such_feature"])
    return t.spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(present).alias("has_present"), F.lit(absent).alias("has_absent")
    )


@query("s11_partitioned_sink", f"{TASK_SQL} SELECT grp, task, count(*) AS n FROM s WHERE grp = 'G1' GROUP BY grp, task")
def s11(t):
    path = scratch(t)
    rows = task_rows(t)
    io.write_partitioned(rows, path, ["grp", "task"])
    # Partition pruning: only folders of G1 are read.
    back = t.spark.read.schema(rows.schema).parquet(path).where(F.col("grp") == "G1")
    return back.groupBy("grp", "task").agg(F.count(F.lit(1)).alias("n"))


def live(t, kind=None):
    """The events table as a file stream."""
    schema = t.events.schema
    e = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    e = e.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_id").alias("row_idx"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("acc0"),
        F.col("event_type").alias("label"),
    )
    return e if kind is None else e.where(F.col("label") == kind)


@query(
    "g1_streaming_windows",
    f"""WITH {SAMPLES_SQL}, w AS (SELECT subject, acc0, (us // 21600000000 - k) * 21600000000 AS start_us FROM samples, range(2) r(k))
    SELECT subject, start_us, count(*) AS num_rows, round(avg(acc0), 8) AS mean_acc0 FROM w
    WHERE start_us + 43200000000 <= (SELECT max(us) // 1000 * 1000 FROM samples) - 3600000000 GROUP BY subject, start_us""",
)
def g1(t):
    aggs = {"num_rows": F.count(F.lit(1)), "mean_acc0": F.avg("acc0")}
    s = st.sliding_windows_stream(live(t), "ts", ["subject"], aggs, "12 hours", "6 hours", "1 hour")
    out = st.run_to_table(s)
    return out.select("subject", F.unix_micros("window_start").alias("start_us"), "num_rows", F.round("mean_acc0", 8).alias("mean_acc0"))


@query(
    "g2_streaming_carry_forward",
    f"""WITH {SAMPLES_SQL}, v AS (SELECT subject, row_idx, label, last_value(CASE WHEN label IN ('view', 'click') THEN row_idx END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY row_idx) AS f FROM samples),
    a AS (SELECT v.*, row_idx - f AS age FROM v)
    SELECT a.subject, a.row_idx, CASE WHEN a.label IN ('view', 'click') THEN 1 WHEN age <= 400 THEN 2 ELSE 0 END AS mask_source, CASE WHEN age <= 400 THEN age ELSE -1 END AS mask_age_frames,
           CASE WHEN age <= 400 THEN s.acc0 END AS carried FROM a LEFT JOIN samples s ON s.subject = a.subject AND s.row_idx = a.f""",
)
def g2(t):
    s = live(t).withColumn("ok", F.col("label").isin("view", "click"))
    out = st.run_to_table(st.carry_forward_stream(s, "subject", "row_idx", "ts", "ok", "acc0", 400))
    return out.withColumn("carried", F.when(~F.isnan("carried"), F.col("carried")))


@query(
    "g3_streaming_alignment",
    f"""WITH {SAMPLES_SQL} SELECT a.subject, a.row_idx AS depth_row, b.row_idx AS rgb_row, a.us - b.us AS gap_us FROM samples a JOIN samples b ON a.subject = b.subject
    AND a.label = 'view' AND b.label = 'click' AND abs(a.us - b.us) <= 7200000000""",
)
def g3(t):
    depth = live(t, "view").select("subject", F.col("row_idx").alias("depth_row"), F.col("ts").alias("depth_ts"))
    rgb = live(t, "click").select("subject", F.col("row_idx").alias("rgb_row"), F.col("ts").alias("rgb_ts"))
    out = st.run_to_table(st.align_streams(depth, rgb, ["subject"], "depth_ts", "rgb_ts", "2 hours"))
    return out.select("subject", "depth_row", "rgb_row", (F.unix_micros("depth_ts") - F.unix_micros("rgb_ts")).alias("gap_us"))
