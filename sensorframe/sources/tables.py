"""Test tables and the reference-shaped views the registered queries read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.session import configure


class Tables:
    """Parquet tables of one folder, and views of them in the library's data model."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def samples(self) -> DataFrame:
        """Labelled sensor rows: one subject per user, row order by event id."""
        e = self.__getattr__("events")
        return e.select(
            F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("subject"),
            F.col("event_id").alias("row_idx"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            F.col("value").alias("acc0"),
            F.get_json_object("props", "$.k").cast("double").alias("acc1"),
            (F.col("event_id") % 17).cast("double").alias("acc2"),
            F.col("event_type").alias("label"),
        )

    def clock(self, event_type: str) -> DataFrame:
        """Frame clock of one modality: one stream per user."""
        s = self.samples().where(F.col("label") == event_type)
        return s.select(F.col("subject").alias("session"), F.col("row_idx").alias("frame_idx"), F.col("us").alias("ts_us"))

    def frames(self) -> DataFrame:
        """Embedding rows as frames: ten frames to a window, seven subjects."""
        e = self.__getattr__("embeddings")
        w = F.floor(F.col("vec_id") / 10).cast("long")
        return e.select(
            w.alias("window_id"),
            (F.col("vec_id") % 10).cast("long").alias("frame_idx"),
            F.concat(F.lit("P"), (w % 7).cast("string")).alias("subject"),
            (F.floor(w / 7) % 2).cast("long").alias("y"),
            F.col("embedding").alias("px"),
        )

    def predictions(self) -> DataFrame:
        """Scored binary rows with run keys, five folds and three splits."""
        li = self.__getattr__("lineitem")
        split = F.when(F.col("l_orderkey") % 3 == 0, "train").when(F.col("l_orderkey") % 3 == 1, "val").otherwise("test")
        return li.select(
            F.concat(F.lit("run_"), F.col("l_linestatus")).alias("run_name"),
            F.concat(F.lit("enc"), (F.col("l_suppkey") % 2).cast("string")).alias("encoder"),
            F.concat(F.lit("feat"), (F.col("l_partkey") % 2).cast("string")).alias("feature"),
            (F.col("l_orderkey") % 5).alias("fold_id"),
            split.alias("split"),
            F.concat(F.lit("P"), (F.col("l_orderkey") % 97).cast("string")).alias("subject"),
            (F.col("l_returnflag") == "R").cast("long").alias("label"),
            ((F.col("l_discount") * 10 + F.col("l_tax") * 12) / 2 + 0.0).alias("score"),
            F.lit(0.5).alias("threshold"),
            ((F.col("l_discount") * 10 + F.col("l_tax") * 12) / 2 >= 0.5).cast("long").alias("prediction"),
        )


# The same views for the SQL twins, as WITH items.
SAMPLES_SQL = """samples AS (
  SELECT 'S' || user_id AS subject, event_id AS row_idx, epoch_us(ts) AS us, value AS acc0,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS acc1, CAST(event_id % 17 AS DOUBLE) AS acc2,
         event_type AS label
  FROM events)"""

FRAMES_SQL = """frames AS (
  SELECT vec_id // 10 AS window_id, vec_id % 10 AS frame_idx, 'P' || ((vec_id // 10) % 7) AS subject,
         ((vec_id // 10) // 7) % 2 AS y, embedding AS px
  FROM embeddings)"""

DIMS_SQL = FRAMES_SQL + """, dims AS (
  SELECT window_id, frame_idx, subject, y, generate_subscripts(px, 1) - 1 AS d, CAST(unnest(px) AS DOUBLE) AS v
  FROM frames)"""

PREDICTIONS_SQL = """predictions AS (
  SELECT 'run_' || l_linestatus AS run_name, 'enc' || (l_suppkey % 2) AS encoder, 'feat' || (l_partkey % 2) AS feature,
         l_orderkey % 5 AS fold_id,
         CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
         'P' || (l_orderkey % 97) AS subject,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         (l_discount * 10 + l_tax * 12) / 2 + 0.0 AS score, 0.5 AS threshold,
         CASE WHEN (l_discount * 10 + l_tax * 12) / 2 >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM lineitem)"""
