"""Sources and sinks: host trees, containers, key-ordered tables and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.codecs import members


def host_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder: ino (a hash of the path), path, size, mtime and body, which is read only if used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.xxhash64("path").alias("ino"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("body"))


def containers(spark: SparkSession, folder: str) -> DataFrame:
    """Members of all zip, tar and gzip files below a folder."""
    return members(host_tree(spark, folder).select("ino", "body"))


def write_ordered(rows: DataFrame, key: str, path: str) -> None:
    """Writes rows in key ranges, sorted, so that range and point reads skip files and row groups by their statistics."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def commit_snapshot(rows: DataFrame, root: str, version: int) -> None:
    """Writes a version of a snapshot; readers take the highest version whose write has been completed."""
    rows.write.mode("errorifexists").parquet(f"{root}/version={version}")


def current_version(spark: SparkSession, root: str) -> int | None:
    """The highest complete version below root, or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(conf)
    if not store.exists(folder):
        return None
    names = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("version=")]
    done = [int(p.getName()[8:]) for p in names if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a snapshot, the current one unless told."""
    version = current_version(spark, root) if version is None else version
    if version is None:
        raise ValueError(f"no snapshot below {root}")
    return spark.read.parquet(f"{root}/version={version}")
