"""Heat of files: accrual by session, decay by sweep, promotion and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import prefix_sums

#: Heat from which a file is hot, the most promotions of a sweep, the largest read heat.
HOT, MOST, LARGEST = 8, 64, 65_535


def session_touches(reads: DataFrame, session: Column) -> DataFrame:
    """reads(ino, ...): at most one touch a file and session."""
    return reads.select("ino", session.alias("session")).distinct()


def accrue(touches: DataFrame, writes: DataFrame) -> DataFrame:
    """Read heat from touches(ino), saturating; write heat from writes(ino)."""
    r = touches.groupBy("ino").agg(F.count("*").alias("r"))
    w = writes.groupBy("ino").agg(F.count("*").alias("w"))
    return r.join(w, "ino", "full_outer").select("ino", F.least(F.coalesce("r", F.lit(0)), F.lit(LARGEST)).cast("long").alias("rheat"), F.least(F.coalesce("w", F.lit(0)), F.lit(255)).cast("long").alias("wheat"))


def decay(heat: DataFrame, sweeps: int) -> DataFrame:
    """Read heat halves, write heat falls by one, at each sweep."""
    return heat.select("ino", F.shiftright("rheat", sweeps).alias("rheat"), F.greatest(F.col("wheat") - sweeps, F.lit(0)).alias("wheat"))


def promote(heat: DataFrame) -> DataFrame:
    """The hottest files in order, within a budget of a tenth of all and MOST. The candidates are cut to MOST before
    they are numbered, so the numbering sees a bounded set."""
    budget = heat.agg(F.least(F.lit(MOST), F.expr("count(*) div 10")).alias("budget"))
    top = heat.where(F.col("rheat") >= HOT).orderBy(F.desc("rheat"), "ino").limit(MOST)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rheat"), "ino")).cast("long"))
    return ranked.join(F.broadcast(budget), F.col("rank") <= F.col("budget")).select("rank", "ino", "rheat")


def budgeted(rows: DataFrame, cost: str, order: list[Column], budget: Column) -> DataFrame:
    """The longest prefix in an order whose running cost is within a budget."""
    return prefix_sums(rows, cost, order).where(F.col("total") <= budget)


def tier_evict(copies: DataFrame, capacity: int, free_share: float = 0.2) -> DataFrame:
    """copies(block, rheat, len): the coldest first, until a share of the capacity is free again."""
    used = copies.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("_used"))
    need = F.greatest(F.col("_used") - F.lit(int(capacity * (1 - free_share))), F.lit(0))
    ordered = prefix_sums(copies, "len", [F.col("rheat").asc(), F.col("block").asc()])
    return ordered.join(F.broadcast(used.select(need.alias("_need"))), F.col("total") - F.col("len") < F.col("_need")).select("block", "rheat", "len", "total")
