"""The data model: content, its segments, the namespace, extents and the change log as DataFrames, and how the test
tables feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a segment (the grid is fixed, not content defined).
GRID = 256
ROOT = 1
#: Kinds of namespace entries; an entry's id is kind * STRIDE + key, so ids of different tables never meet.
STRIDE = 10**12
REGION, NATION, CUSTOMER, SUPPLIER, ORDER = 1, 2, 3, 4, 5
DIRECTORY, FILE = "d", "f"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry_id(kind: int, key: str) -> Column:
    return F.lit(kind * STRIDE) + F.col(key).cast("long")


def files(documents: DataFrame) -> DataFrame:
    """Documents as files: ino, name, directory and content."""
    return documents.select(F.col("doc_id").alias("ino"), F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("lang").alias("dir"), F.col("text").alias("content"))


def extents(lineitem: DataFrame) -> DataFrame:
    """Line items as recipe entries of one file an order: idx in a total order, lengths, running offsets."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    length = F.floor("l_quantity").cast("long")
    running = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lineitem.select(F.col("l_orderkey").alias("ino"), F.row_number().over(order).cast("long").alias("idx"), (running - length).alias("off"), length.alias("len"), F.col("l_returnflag").alias("algo"), F.col("l_linestatus").alias("zone"), F.col("l_partkey").alias("block"))


def change_log(events: DataFrame) -> DataFrame:
    """Events as change records: key, sequence, operation (P put, D delete) and value."""
    return events.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), F.col("value").alias("v"))


def base_rows(customer: DataFrame) -> DataFrame:
    """Customers as the base snapshot."""
    return customer.select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").alias("v"))


def dirents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The namespace: region / nation / customer or supplier / order. One row a name: parent, name, child, type, size."""

    def rows(name: str, parent: Column, prefix: str, key: str, kind: int, entry_type: str, size: Column) -> DataFrame:
        label = F.concat(F.lit(prefix), F.col(key).cast("string")) if prefix else F.col(key)
        return table(spark, sf_dir, name).select(parent.alias("parent"), label.alias("name"), entry_id(kind, _KEYS[name]).alias("child"), F.lit(entry_type).alias("type"), size.cast("long").alias("size"))

    none = F.lit(0)
    return (
        rows("region", F.lit(ROOT).cast("long"), "", "r_name", REGION, DIRECTORY, none)
        .unionByName(rows("nation", entry_id(REGION, "n_regionkey"), "", "n_name", NATION, DIRECTORY, none))
        .unionByName(rows("customer", entry_id(NATION, "c_nationkey"), "c", "c_custkey", CUSTOMER, DIRECTORY, none))
        .unionByName(rows("supplier", entry_id(NATION, "s_nationkey"), "s", "s_suppkey", SUPPLIER, FILE, F.greatest(F.floor("s_acctbal"), F.lit(0))))
        .unionByName(rows("orders", entry_id(CUSTOMER, "o_custkey"), "o", "o_orderkey", ORDER, FILE, F.floor("o_totalprice")))
    )


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
