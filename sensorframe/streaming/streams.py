"""Structured Streaming forms of windows, carry-forward and two-stream alignment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorframe.session import checkpoint_dir


def sliding_windows_stream(
    stream: DataFrame, ts: str, keys: Sequence[str], aggs: dict[str, Column], window: str = "30 seconds", slide: str = "15 seconds", watermark: str = "1 minute"
) -> DataFrame:
    """Overlapping windows aligned to the epoch; rows later than the watermark are dropped.

    The batch form is anchored at segment starts, so its windows differ by a shift.
    """
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(*keys, F.window(ts, window, slide).alias("_w"))
        .agg(*[c.alias(n) for n, c in aggs.items()])
        .select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggs)
    )


def carry_forward_stream(stream: DataFrame, key: str, frame: str, ts: str, valid: str, value: str, max_age: int, idle_seconds: int = 3600) -> DataFrame:
    """Last valid value per key across micro-batches, while at most ``max_age`` frames old.

    State is one (frame, value) pair per key and expires after ``idle_seconds`` of event time.
    Rows of a key are put in frame order inside each micro-batch, so the trigger's
    input limit bounds what one task holds. A late row never takes a value from a later frame, and
    the state only moves forward.
    """
    key_type = stream.schema[key].dataType.simpleString()
    out = f"`{key}` {key_type}, `{frame}` bigint, mask_source int, mask_age_frames bigint, carried double"

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(frame, kind="stable")
        f = rows[frame].to_numpy("int64")
        ok = rows[valid].to_numpy(bool)
        v = rows[value].to_numpy("float64")
        seed_f, seed_v = state.get if state.exists else (None, None)
        # Position of the latest valid row at or before each row; -1 means the stored one.
        pos = np.maximum.accumulate(np.where(ok, np.arange(len(f)), -1))
        from_batch = pos >= 0
        stored = np.full(len(f), seed_f is not None) & (f >= (seed_f or 0))
        nearer = from_batch & ~(stored & (f[pos] < (seed_f or 0)))
        last_f = np.where(nearer, f[pos], seed_f if seed_f is not None else 0)
        last_v = np.where(nearer, v[pos], seed_v if seed_v is not None else np.nan)
        known = nearer | stored
        age = f - last_f
        usable = known & (age >= 0) & (age <= max_age)
        if from_batch.any() and (seed_f is None or f[pos[-1]] >= seed_f):
            state.update((int(f[pos[-1]]), float(v[pos[-1]])))
        if state.exists:
            latest = int(rows[ts].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_seconds * 1000)
        yield pd.DataFrame(
            {
                key: k[0],
                frame: f,
                "mask_source": np.where(ok, 1, np.where(usable, 2, 0)).astype("int32"),
                "mask_age_frames": np.where(usable, age, -1),
                "carried": np.where(usable, last_v, np.nan),
            }
        )

    state_schema = T.StructType([T.StructField("frame", T.LongType()), T.StructField("value", T.DoubleType())])
    return (
        stream.withWatermark(ts, "1 hour")
        .groupBy(key)
        .applyInPandasWithState(step, out, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    )


def align_streams(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, tolerance: str, watermark: str = "1 hour") -> DataFrame:
    """Inner join of two live streams whose times differ by at most the tolerance.

    Both watermarks and the time bound let Spark discard state it cannot need again.
    """
    l = left.withWatermark(left_ts, watermark).alias("l")
    r = right.withWatermark(right_ts, watermark).alias("r")
    bound = F.expr(f"INTERVAL {tolerance}")
    cond = (F.col(f"r.{right_ts}") >= F.col(f"l.{left_ts}") - bound) & (F.col(f"r.{right_ts}") <= F.col(f"l.{left_ts}") + bound)
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    cols = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, cond, "inner").select(*cols)


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input into a Parquet table and read it back.

    Output and progress live in the shared checkpoint folder, so a restarted query
    continues and no row passes through the driver.
    """
    spark: SparkSession = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{root}/out", checkpoint or f"{root}/progress"
    q = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
