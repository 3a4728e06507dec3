"""Streaming forms against batch forms on replayed input."""

import random
import uuid

from conftest import rows
from pyspark.sql import functions as F

from sensorframe.operators.frames import carry_forward
from sensorframe.operators.ordered import row_tile
from sensorframe.streaming import streams as st

START = 1_700_000_000  # the first watermark is the epoch itself, so rows dated then would count as late


def replay(spark, tmp_path, df, order, parts):
    """Write the rows as ``parts`` files in order and stream them one file per trigger."""
    path = str(tmp_path / uuid.uuid4().hex)
    data = df.orderBy(order).collect()
    size = -(-len(data) // parts)
    for i in range(parts):
        chunk = spark.createDataFrame(data[i * size : (i + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_carry_forward_over_micro_batches_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    data = [(rnd.choice(["hot", "hot", "a", "b"]), i, rnd.random() < 0.2, float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "s string, i long, ok boolean, v double").withColumn("ts", F.timestamp_seconds(F.col("i") + START))
    batch = carry_forward(df, ["s"], "i", F.col("ok"), ["v"], 7, row_tile("i", 16))
    live = st.run_to_table(st.carry_forward_stream(replay(spark, tmp_path, df, "i", 5), "s", "i", "ts", "ok", "v", 7))
    want = batch.select("s", "i", "mask_source", "mask_age_frames", F.col("carried_v").alias("carried"))
    have = live.withColumn("carried", F.when(~F.isnan("carried"), F.col("carried")))
    assert rows(have) == rows(want)


def test_late_rows_carry_nothing_back(spark, tmp_path):
    """A late row sees only earlier frames, and the stored frame never moves back."""
    path = str(tmp_path / "late")
    schema = "s string, i long, ok boolean, v double"
    for batch in ([("a", 10, True, 10.0)], [("a", 5, False, 5.0), ("a", 6, True, 6.0), ("a", 7, False, 0.0), ("a", 11, False, 0.0)], [("a", 12, False, 0.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = live.withColumn("ts", F.timestamp_seconds(F.col("i") + START))
    out = st.run_to_table(st.carry_forward_stream(live, "s", "i", "ts", "ok", "v", 7))
    have = {r["i"]: (r["mask_source"], r["mask_age_frames"], r["carried"]) for r in out.collect()}
    assert have[5][:2] == (0, -1) and have[7] == (2, 1, 6.0) and have[11] == (2, 1, 10.0) and have[12] == (2, 2, 10.0)


def test_late_rows_leave_closed_windows_alone(spark, tmp_path):
    """Spark moves the watermark between batches and applies it to late rows one batch after it closes windows."""
    path = str(tmp_path / "in")
    schema = "s string, t long"
    for batch in ([("a", 0), ("a", 10)], [("a", 500)], [("a", 510)], [("a", 5)], [("a", 1000)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = live.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    out = st.run_to_table(st.sliding_windows_stream(live, "ts", ["s"], {"n": F.count(F.lit(1))}, "30 seconds", "15 seconds", "1 minute"))
    first = out.where(F.col("window_start") == F.timestamp_seconds(F.lit(0)))
    assert [r["n"] for r in first.collect()] == [2]


def test_two_streams_join_inside_the_tolerance(spark, tmp_path):
    a = spark.createDataFrame([("s", i, i * 10) for i in range(20)], "s string, a long, t long")
    b = spark.createDataFrame([("s", i, i * 10 + 3) for i in range(20)], "s string, b long, t long")
    a = a.select("s", "a", F.timestamp_seconds(F.col("t") + START).alias("ta"))
    b = b.select("s", "b", F.timestamp_seconds(F.col("t") + START).alias("tb"))
    out = st.run_to_table(
        st.align_streams(replay(spark, tmp_path, a, "a", 3), replay(spark, tmp_path, b, "b", 3), ["s"], "ta", "tb", "4 seconds")
    )
    assert rows(out.select("a", "b")) == [(i, i) for i in range(20)]
