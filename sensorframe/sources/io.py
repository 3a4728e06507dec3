"""Discovery, catalogues, sinks and freshness over folders of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.scalars import hash_shard
from sensorframe.session import materialise


def projected(spark: SparkSession, path: str, columns: Sequence[str], schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read named columns only; the scan never sees the others."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).select(*columns)


def discover(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    pattern: str,
    keys: Sequence[str],
    glob: str = "*",
    fmt: str = "csv",
    skip: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Recursive read whose key columns come from each file's path.

    ``pattern`` has one group per key; files that do not match it are left out.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.format(fmt).load(root).withColumn("file_path", F.col("_metadata.file_path"))
    rows = rows.where(F.col("file_path").rlike(pattern))
    for i, k in enumerate(keys, start=1):
        rows = rows.withColumn(k, F.regexp_extract("file_path", pattern, i))
    for k, values in (skip or {}).items():
        rows = rows.where(~F.col(k).isin(*values))
    return rows


# Fixed value: layout of a run tree below its root.
RUN_TREE = r"/runs/([^/]+)/([^/]+)/([^/]+)/([^/]+)/fold_predictions[^/]*(?:/[^/]+)?$"
RUN_KEYS = ("run_name", "encoder", "feature", "model_family")


def run_tree(spark: SparkSession, root: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Prediction rows of every run with the four key columns of their path."""
    return discover(spark, root, schema, RUN_TREE, RUN_KEYS, fmt=fmt)


def store_catalogue(frames: DataFrame, metadata: DataFrame, keys: Sequence[str], value: str, window: str, frame: str) -> DataFrame:
    """Shape of each embedding store that has metadata."""
    shape = frames.groupBy(*keys).agg(
        F.countDistinct(window).alias("num_windows"),
        F.count(F.lit(1)).alias("num_frames"),
        F.max(F.size(value)).cast("long").alias("embedding_dim"),
        F.countDistinct(frame).alias("frames_per_window"),
    )
    return shape.join(metadata.select(*keys).distinct(), list(keys), "left_semi")


def dead_letters(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows that can be processed, and the others with the first reason that applies."""
    reason = F.lit(None).cast("string")
    for condition, text in reversed(rules):
        reason = F.when(condition, F.lit(text)).otherwise(reason)
    tagged = df.withColumn("skip_reason", reason)
    return tagged.where(F.col("skip_reason").isNull()).drop("skip_reason"), tagged.where(F.col("skip_reason").isNotNull())


def union_runs(runs: dict[str, DataFrame], name: str = "run_dir") -> DataFrame:
    """Concatenate tables of different runs; columns one of them lacks are null."""
    out = None
    for run, df in runs.items():
        tagged = df.withColumn(name, F.lit(run))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def shard(df: DataFrame, key: str, shards: int, wanted: int | None = None) -> DataFrame:
    """Add the stable shard of a key, or keep one shard."""
    if shards < 1 or (wanted is not None and not 0 <= wanted < shards):
        raise ValueError(f"shard {wanted} of {shards} is out of range")
    out = df.withColumn("shard", hash_shard(F.col(key), shards))
    return out if wanted is None else out.where(F.col("shard") == wanted)


def boundaries_long(df: DataFrame, ids: Sequence[str], tasks: Sequence[str], absent: float = -1.0) -> DataFrame:
    """``start_*``/``end_*`` columns to one row per task; the absent mark becomes null."""
    known = [
        F.struct(
            F.lit(t).alias("task"),
            F.when(F.col(f"start_{t}") != absent, F.col(f"start_{t}")).alias("start"),
            F.when(F.col(f"end_{t}") != absent, F.col(f"end_{t}")).alias("end"),
        )
        for t in tasks
    ]
    return df.select(*ids, F.inline(F.array(*known)))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet partitioned by key columns.

    Rows are gathered by these keys first, so a folder gets few files; a large key is split by AQE and never meets in one task.
    """
    df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def write_missing(df: DataFrame, path: str, by: Sequence[str], complete: Column, overwrite: bool = False) -> DataFrame:
    """Idempotent sink: write only keys not stored completely yet.

    A stored key is complete when every row satisfies ``complete``. Incomplete keys
    are rewritten whole; ``overwrite`` rewrites all. Returns the keys written.
    """
    spark = df.sparkSession
    todo = df
    if not overwrite and _exists(spark, path):
        done = spark.read.schema(df.schema).parquet(path).groupBy(*by).agg(F.bool_and(complete).alias("_ok")).where("_ok").select(*by)
        todo = df.join(done, list(by), "left_anti")
    written = materialise(todo.select(*by).distinct())
    write_partitioned(todo, path, by)
    return written


def is_current(spark: SparkSession, output: str, inputs: Sequence[str], column: str, wanted: Sequence[str]) -> bool:
    """True when the output exists, holds every wanted value, and is newer than its inputs."""
    if not _exists(spark, output):
        return False
    stamp = F.max(F.col("_metadata.file_modification_time"))
    table = spark.read.parquet(output)
    newest = table.agg(stamp.alias("t")).first()["t"]
    if newest is None:
        return False
    have = {r[0] for r in table.where(F.col(column).isin(*wanted)).select(column).distinct().collect()}
    if set(wanted) - have:
        return False
    fresh = [spark.read.parquet(p).agg(stamp.alias("t")).first()["t"] for p in inputs if _exists(spark, p)]
    return all(t is None or t <= newest for t in fresh)
