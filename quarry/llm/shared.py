"""What the operators share: reading tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id wherever documents are ordered or joined: nulls come first.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def node_key() -> Column:
    """Tells rows apart by doc_id and text: several texts can stand under one doc_id, or under none."""
    return F.struct(id_key().alias("doc"), F.xxhash64(text_of()).alias("raw"))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: as a lambda's variable it can't be inlined into inner lambdas, where it
    would be worked out anew for every element."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, for this session: ten thousand rows of whole texts would need hundreds of MB
    outside the heap and as much in the Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where that is unset
    (tests in one process) a folder below the warehouse is used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_shared"
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one. It goes with the program that asked for it: a result may be read until then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _hadoop(spark, path)
    files.mkdirs(where)
    if not _made:
        atexit.register(drop_all)
    _made.append((spark, path))
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def arrow_path(spark: SparkSession, path: str) -> str:
    """The address of a folder as pyarrow wants it."""
    files, where = _hadoop(spark, path)
    full = files.makeQualified(where).toString()
    return full.replace("file:", "file://", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back. Survives lost
    executors, and a failed task writes its part anew."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes the files of tables made by written(), once nothing reads them any more."""
    for df in tables:
        _drop(df.sparkSession, df._quarry_path)
        _made.remove((df.sparkSession, df._quarry_path))


def _drop(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def drop_all() -> None:
    """Removes all that is left in the shared folder of this program's tables and files."""
    while _made:
        try:
            _drop(*_made.pop())
        except Exception:  # the session has ended: its folder is the cluster's to clear
            _made.clear()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
