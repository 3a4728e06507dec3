"""Intermediate tables in the session's shared checkpoint folder, and how many tasks to deal to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.session import materialise, release

__all__ = ["if_small", "materialise", "release", "tasks_of"]

#: Rows of one to three numbers up to which a stored table is broadcast; beyond, joins shuffle.
SMALL_ROWS = 200_000


def tasks_of(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what the cluster deals large inputs to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def if_small(stored: DataFrame) -> DataFrame:
    """A stored narrow table, marked for broadcast if it has few rows. Counting it reads only file footers."""
    return F.broadcast(stored) if stored.count() <= SMALL_ROWS else stored
