"""Volume, zone and block statistics; runs of blocks (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def volume(entries: DataFrame) -> DataFrame:
    """entries(name, type, size) -> counts by type, logical bytes and the biggest file."""
    file = F.col("type") == "f"
    return entries.agg(
        F.count_if(file).alias("files"),
        F.count_if(F.col("type") == "d").alias("dirs"),
        F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("logical"),
        F.max(F.when(file, F.col("size"))).alias("biggest_size"),
        F.max(F.when(file, F.struct("size", "name")))["name"].alias("biggest"),
    )


def zones(extents: DataFrame) -> DataFrame:
    """Logical length by zone, and physical length with each block counted once over all files (in its least zone)."""
    logical = extents.groupBy("zone").agg(F.count("*").alias("entries"), F.sum("len").alias("logical"))
    claimed = extents.groupBy("block").agg(F.min(F.struct("zone", "len")).alias("c")).groupBy(F.col("c.zone").alias("zone")).agg(F.count("*").alias("blocks"), F.sum("c.len").alias("physical"))
    return logical.join(claimed, "zone", "left").select("zone", "entries", "logical", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("physical", F.lit(0)).alias("physical"))


def bucket(size: Column) -> Column:
    """The six size classes of the histogram."""
    edges = (4 << 10, 8 << 10, 64 << 10, 256 << 10, 1 << 20)
    out = F.when(size < edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(size < e, i)
    return out.otherwise(len(edges))


def histogram(pieces: DataFrame) -> DataFrame:
    """pieces(cls, size) -> by class and size bucket: number, logical, physical (whole 4 KiB blocks) and waste."""
    block = F.ceil((F.col("size") + 8) / 4096).cast("long") * 4096
    found = pieces.groupBy("cls", bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("logical"), F.sum(block).alias("physical"))
    return found.withColumn("waste", F.col("physical") - F.col("logical"))


def islands(blocks: DataFrame) -> DataFrame:
    """blocks(block) -> (start, length) of maximal runs of consecutive numbers.

    Runs are found within slices of the number line in parallel; only each slice's runs (not its blocks) are then put
    together, so no task sees all blocks."""
    width = 1 << 16
    own = Window.partitionBy("_slice").orderBy("block")
    rows = blocks.select("block").distinct().withColumn("_slice", F.floor(F.col("block") / width)).withColumn("_run", F.col("block") - F.row_number().over(own))
    runs = rows.groupBy("_slice", "_run").agg(F.min("block").alias("start"), F.count("*").alias("length"))
    # a run that fills up to its slice's edge goes on in the next slice: such chains are few, one row a slice
    ahead = Window.orderBy("start")
    edge = runs.where((F.col("start") == F.col("_slice") * width) | (F.col("start") + F.col("length") == (F.col("_slice") + 1) * width))
    inner = runs.join(edge.select("start"), "start", "left_anti").select("start", "length")
    opens = F.when(F.lag(F.col("start") + F.col("length")).over(ahead) == F.col("start"), 0).otherwise(1)
    chains = edge.withColumn("_opens", opens).withColumn("_chain", F.sum("_opens").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    return inner.unionByName(chains.groupBy("_chain").agg(F.min("start").alias("start"), F.sum("length").alias("length")).select("start", "length"))


def free_runs(blocks: DataFrame) -> DataFrame:
    """blocks(block, used) -> runs of blocks that are not used."""
    return islands(blocks.where(~F.col("used")))


def fragmentation(blocks: DataFrame) -> DataFrame:
    """Number of free runs and 1 - largest run / all free blocks."""
    runs = free_runs(blocks)
    total = F.coalesce(F.sum("length"), F.lit(0))
    score = F.when(total == 0, 0.0).otherwise(F.round(1 - F.max("length") / F.sum("length"), 6))
    return runs.agg(F.count("*").alias("runs"), total.alias("free"), F.coalesce(F.max("length"), F.lit(0)).alias("largest"), score.alias("score"))


def unclaimed_runs(blocks: DataFrame, claimed: DataFrame) -> DataFrame:
    """Runs of used blocks that no one claims."""
    return islands(blocks.where("used").join(claimed.select("block").distinct(), "block", "left_anti"))


def block_use(blocks: DataFrame, claimed: DataFrame) -> DataFrame:
    """Used, claimed and unclaimed blocks (never below 0)."""
    rows = blocks.select("block", F.col("used").cast("int").alias("_used"), F.lit(0).alias("_claim")).unionByName(claimed.select("block", F.lit(None).cast("int").alias("_used"), F.lit(1).alias("_claim")).distinct())
    found = rows.agg(F.count_if(F.col("_used") == 1).alias("used"), F.count_if(F.col("_used") == 0).alias("free"), F.coalesce(F.sum("_claim"), F.lit(0)).alias("claimed"))
    return found.select("used", "free", "claimed", F.greatest(F.col("used") - F.col("claimed"), F.lit(0)).alias("unclaimed"))


def usage_by(stamps: DataFrame, column: str) -> DataFrame:
    return stamps.groupBy(column).agg(F.count("*").alias("files"))


def inspector(extents: DataFrame, algos: DataFrame, ino: int) -> DataFrame:
    """Each extent of a file with its codec's name; the dimension has a row a codec."""
    return extents.where(F.col("ino") == ino).join(algos, "algo", "left").select("ino", "idx", "off", "len", "zone", F.coalesce("codec", F.lit("unknown")).alias("codec"), F.ceil((F.col("len") + 8) / 4096).cast("long").alias("blocks"))
