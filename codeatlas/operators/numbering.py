"""Consecutive numbers within groups, without one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.session import cut_table


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``nth`` (from 1, by ``order`` within ``key``) and ``of``, the
    group's size. ``order`` must be total within a group.

    Rows are dealt into ranges of (key, order), so a group of any size spreads
    over tasks, and written once: numbers within a range are added to the counts
    of the ranges before it. The only window over a whole group holds one row for
    each range, so at most as many rows as there are shuffle partitions.
    """
    ranges = cut_table(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), name)
    whole = Window.partitionBy(key)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("of"))
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    return (ranges.withColumn("_nth", within).join(starts, [key, "_range"])
            .select(*rows.columns, (F.col("_nth") + F.col("_before")).alias("nth"), "of"))


def running(rows: DataFrame, key: str, order: list[Column], weight: str, name: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``weight`` over the rows of the same
    ``key`` that come earlier in ``order`` (total within a key), and ``whole``,
    the sum over the key. Ranges as in ``numbered``: no key is held by one task."""
    ranges = cut_table(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), name)
    whole = Window.partitionBy(key)
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(key, "_range").agg(F.sum(weight).alias("_n")).select(
        key, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("whole"))
    within = F.sum(weight).over(Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    return (ranges.withColumn("_at", within).join(starts, [key, "_range"])
            .select(*rows.columns, (F.col("_at") + F.col("_before")).alias("before"), "whole"))


def in_bins(rows: DataFrame, weight: Column, target: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``bin`` (int) and the number of bins: rows lighter than
    ``target`` share bins of less than twice that weight, a heavier row has one of
    its own. Weights are summed within the partitions in which the rows come; the
    window over all of them holds one row for each partition."""
    light = F.col("_weight") < target
    held = cut_table(rows.withColumn("_weight", weight.cast("long")).withColumn("_range", F.spark_partition_id())
                     .withColumn("_at", F.monotonically_increasing_id()), name)
    parts = held.groupBy("_range").agg(F.coalesce(F.sum(F.when(light, F.col("_weight"))), F.lit(0)).alias("_sum"), F.count(F.when(~light, 1)).alias("_heavy"))
    total, heavy = parts.agg(F.coalesce(F.sum("_sum"), F.lit(0)), F.coalesce(F.sum("_heavy"), F.lit(0))).first()
    shared = -(-total // target)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sums"), F.coalesce(F.sum("_heavy").over(earlier), F.lit(0)).alias("_heavies"))
    so_far = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(light, F.floor((F.col("_sums") + F.coalesce(F.sum(F.when(light, F.col("_weight"))).over(so_far), F.lit(0))) / target)).otherwise(
        shared + F.col("_heavies") + F.coalesce(F.count(F.when(~light, 1)).over(so_far), F.lit(0)))
    return held.join(starts, "_range").select(*rows.columns, place.cast("int").alias("bin")), max(1, shared + heavy)
