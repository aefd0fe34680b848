"""Where content goes: batches, moves, size guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .heat import budgeted
from .order import runs, sums_within


def batches(members: DataFrame, cap: int) -> DataFrame:
    """members(family, size, ino) packed by family in order of (size, ino): each member's first and last batch. A batch
    closes exactly at its cap, so a member may be cut."""
    placed = sums_within(members.where("size > 0"), "family", "size", [F.col("size").asc(), F.col("ino").asc()])
    return placed.select("family", "ino", "size", F.expr(f"(total - size) div {cap}").alias("first_batch"), F.expr(f"(total - 1) div {cap}").alias("last_batch"))


def binary_batches(members: DataFrame, cap: int) -> DataFrame:
    """members(flag, size, ino) in order of (size, ino): a batch also closes where the flag changes, so that a batch is
    filtered as a whole or not at all."""
    islands = runs(members, "flag", ["size", "ino"]).withColumnRenamed("run", "island")
    placed = sums_within(islands, "island", "size", [F.col("size").asc(), F.col("ino").asc()])
    return placed.select("ino", "flag", "size", "island", F.expr(f"(total - size) div {cap}").alias("batch"))


def garbage(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Registered batches that no live entry names."""
    return registry.join(entries.select("batch").distinct(), "batch", "left_anti")


def migration(files: DataFrame, blocks: int) -> DataFrame:
    """files(ino, size): smallest first, while the blocks moved stay within a budget."""
    cost = files.select("ino", "size", F.ceil((F.col("size") + 8) / 4096).cast("long").alias("blocks"))
    return budgeted(cost, "blocks", [F.col("size").asc(), F.col("ino").asc()], F.lit(blocks))


def size_guard(members: DataFrame, gain_mille: int, fixed: int = 4096, each: int = 64) -> DataFrame:
    """members(container, size, packed) -> projected size of each container and whether taking it apart pays."""
    found = members.groupBy("container").agg(F.sum("size").alias("original"), F.sum(F.least("packed", "size")).alias("data"), F.count("*").alias("members"))
    projected = F.lit(fixed) + F.ceil(F.col("data") / 4096).cast("long") * 4096 + F.col("members") * each
    return found.select("container", "members", "original", projected.alias("projected"), F.when(projected * 1000 < F.col("original") * (1000 - gain_mille), "accept").otherwise("decline").alias("verdict"))


def admitted(candidates: DataFrame, free: int) -> DataFrame:
    """candidates(ino, worst) against free blocks: a file whose worst case in whole blocks does not fit is put off."""
    blocks = F.ceil(F.col("worst") / 4096).cast("long")
    return candidates.select("ino", "worst", F.when(blocks <= free, "go").otherwise("no-space").alias("verdict"))


def pending(marks: DataFrame, done: DataFrame, cap: int | None) -> DataFrame:
    """marks(ino, ts) that no later sweep done(ino, ts) has settled, once each; with a cap the oldest only."""
    last = done.groupBy("ino").agg(F.max("ts").alias("_done"))
    open_ = marks.groupBy("ino").agg(F.min("ts").alias("since"), F.max("ts").alias("_marked")).join(last, "ino", "left")
    left = open_.where("_done is null or _done < _marked").select("ino", "since")
    return left if cap is None else left.orderBy("since", "ino").limit(cap)
