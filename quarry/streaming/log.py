"""The change log as a stream: micro-batches are appended as deltas to a folder, and a snapshot is their latest records.

Every micro-batch writes a directory of its own, named by its batch id, with the latest record of each key in it; a
batch that is run again after a failure replaces its own directory and nothing else, so it shows whole or not at all.
What was written before is not written again; compact() folds deltas into one when there are many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.overlay import latest


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(log: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends all that is there now as deltas below a folder, and returns. Nothing new gives no delta."""

    def append(batch: DataFrame, batch_id: int) -> None:
        latest(batch.select("k", "seq", "op", "v")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    query = log.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(k, seq, op, v): the latest record of each key over all deltas; none if nothing was ever ingested."""
    kinds = "k long, seq long, op string, v double"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kinds)
    return latest(spark.read.schema(kinds + ", batch int").parquet(folder))


def compact(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Writes the snapshot as one table of its own and reads it back; the deltas are the caller's to remove."""
    snapshot(spark, folder).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def counters(log: DataFrame) -> DataFrame:
    """Running totals of a streamed or batch log: records, deletes, keys touched at least once (approximately)."""
    return log.agg(F.count("*").alias("records"), F.count_if(F.col("op") == "D").alias("deletes"), F.approx_count_distinct("k").alias("keys"))


def touches(reads: DataFrame, watermark: str = "1 day") -> DataFrame:
    """reads(ino, ts): the first touch of each file and day; state older than the watermark is dropped."""
    day = F.date_trunc("day", "ts").alias("day")
    return reads.withWatermark("ts", watermark).select("ino", "ts", day).dropDuplicatesWithinWatermark(["ino", "day"])
