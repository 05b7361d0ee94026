"""Running totals over a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


def range_parted(df: DataFrame, ws: Workspace, name: str, *keys: str) -> DataFrame:
    """Write ``df`` sorted by ``keys`` in range partitions, with their number in ``_part``.

    Ranges hold like numbers of rows, so the order's keys must be near unique together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return ws.save(parted.withColumn("_part", F.spark_partition_id()), name)


def before_part(parted: DataFrame, value: str) -> DataFrame:
    """(_part, _before): the sum of ``value`` in earlier partitions; a row for each partition."""
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))


def running_start(parted: DataFrame, value: str, *keys: str, out: str = "start") -> DataFrame:
    """Add the sum of ``value`` over all rows before this one in the order of ``keys``."""
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # the totals are a row for each partition: bounded by the number of partitions
    joined = parted.join(F.broadcast(before_part(parted, value)), "_part")
    return joined.withColumn(out, (F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_before")).cast("long")).drop("_before")


def ranked(df: DataFrame, ws: Workspace, name: str, *keys: str) -> DataFrame:
    """Write ``df`` in the order of ``keys`` and give it with ``rank``, its place from 0 in all of it.

    The place in a partition is written with the row, so partition sizes and places are of the
    same cut; rows that tie in all keys share a partition, in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    parted = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = ws.save(parted.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_place")).withColumn("_one", F.lit(1)), name)
    # the totals are a row for each partition: bounded by the number of partitions
    return placed.join(F.broadcast(before_part(placed, "_one")), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_one", "_before")
