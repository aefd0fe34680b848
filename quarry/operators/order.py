"""Running sums and neighbours in a total order, without putting all rows into one task.

Rows are dealt to ranges of the order and written with their range's number, so everything that follows reads the same
ranges; within a range a window does the work, and one row a range chains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import written


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _part, the number of their range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def prefix_sums(rows: DataFrame, cost: str, order: list[Column]) -> DataFrame:
    """rows with total, the running sum of cost in a total order."""
    return _summed(ranged(rows, order), cost, order).drop("_part")


def _summed(cut: DataFrame, cost: str, order: list[Column]) -> DataFrame:
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_sum", F.sum(cost).over(within))
    parts = cut.groupBy("_part").agg(F.sum(cost).alias("_all"))
    before = parts.select("_part", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a range
    return summed.join(F.broadcast(before), "_part").withColumn("total", F.col("_sum") + F.col("_before")).drop("_sum", "_before")


def sums_within(rows: DataFrame, group: str, cost: str, order: list[Column]) -> DataFrame:
    """rows with total, the running sum of cost within a group, in a total order; a group may be of any size."""
    placed = prefix_sums(rows, cost, [F.col(group).asc(), *order])
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min(F.col("total") - F.col(cost)).alias("_base"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn("total", F.col("total") - F.col("_base")).drop("_group", "_base")


def runs(rows: DataFrame, flag: str, order: list[str]) -> DataFrame:
    """rows with run, which counts from 1 how often flag has changed in an ascending order."""
    keys = [F.col(c).asc() for c in order]
    cut = ranged(rows, keys)
    within = Window.partitionBy("_part").orderBy(*keys)
    marked = cut.withColumn("_lag", F.lag(F.struct(flag)).over(within))
    # the last flag of the range before: one row a range
    ends = cut.groupBy("_part").agg(F.max_by(F.struct(flag), F.struct(*order)).alias("_last"))
    ends = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))
    both = marked.join(F.broadcast(ends), "_part")
    turned = both.withColumn("_turn", F.when(F.coalesce("_lag", "_last").eqNullSafe(F.struct(flag)), 0).otherwise(1)).drop("_lag", "_last")
    return _summed(turned, "_turn", keys).withColumnRenamed("total", "run").drop("_part", "_turn")
