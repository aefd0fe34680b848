"""Integrity audits. Each gives verdict rows; none changes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(inodes: DataFrame, names: DataFrame) -> DataFrame:
    """inodes(ino, nlink) against names(child): ok, missing-name (fewer names than links), stale-dirent (more), dead
    (names of an id without a row), orphan-row (a row without names)."""
    seen = names.groupBy(F.col("child").alias("ino")).agg(F.count("*").alias("names"))
    rows = inodes.join(seen, "ino", "full_outer")
    verdict = (
        F.when(F.col("nlink").isNull(), "dead")
        .when(F.col("names").isNull(), "orphan-row")
        .when(F.col("names") < F.col("nlink"), "missing-name")
        .when(F.col("names") > F.col("nlink"), "stale-dirent")
        .otherwise("ok")
    )
    return rows.select("ino", "nlink", F.coalesce("names", F.lit(0)).alias("names"), verdict.alias("verdict"))


def tiling(extents: DataFrame, sizes: DataFrame) -> DataFrame:
    """extents(ino, idx, off, len) against sizes(ino, size): one verdict a file, the first of SIZE (no extents but a
    size, or extents without a row), then BOUNDS or OVERLAP of the first faulty extent in order, then COVERAGE."""
    order = Window.partitionBy("ino").orderBy("idx")
    end = F.col("off") + F.col("len")
    rows = extents.join(sizes, "ino", "full_outer")
    checked = rows.withColumn("_before", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fault = F.when((F.col("off") < 0) | (F.col("len") < 0) | (end > F.col("size")), "BOUNDS").when(F.col("off") < F.col("_before"), "OVERLAP")
    found = checked.withColumn("_fault", fault).groupBy("ino").agg(
        F.max("size").alias("size"), F.coalesce(F.sum("len"), F.lit(0)).alias("covered"), F.min(F.when(F.col("_fault").isNotNull(), F.struct("idx", "_fault")))["_fault"].alias("_first"), F.count("idx").alias("extents")
    )
    size_wrong = F.col("size").isNull() | ((F.col("size") > 0) & (F.col("extents") == 0))
    verdict = F.when(size_wrong, "SIZE").when(F.col("_first").isNotNull(), F.col("_first")).when(F.col("covered") != F.col("size"), "COVERAGE").otherwise("ok")
    return found.select("ino", verdict.alias("verdict"))


def orphans(allocated: DataFrame, reachable: DataFrame, key: str) -> DataFrame:
    """Allocated rows that nothing reaches."""
    return allocated.join(reachable.select(key).distinct(), key, "left_anti")


def overlaps(left: DataFrame, right: DataFrame, cell: int) -> DataFrame:
    """Pairs of half-open ranges left(l, lo, hi) and right(r, lo, hi) that meet.

    Cells double in width from level to level. A range lies at the level whose cells are as wide as it is or wider, so
    in two cells at most, and stands in the cells of all levels above, too; two ranges meet at the level of the wider
    one. It is an equi-join, not all against all, whatever widths there are; a pair that shares two cells is taken in
    the first."""

    def level(df: DataFrame):
        return F.greatest(F.ceil(F.log2((F.col("hi") - F.col("lo")) / cell)), F.lit(0)).cast("int")

    widest = [df.where("hi > lo").agg(F.max(level(df)).alias("n")).first().n for df in (left, right)]
    top = max((n for n in widest if n is not None), default=0)

    def celled(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("hi > lo").select(name, F.col("lo").alias(f"_{name}lo"), F.col("hi").alias(f"_{name}hi"), level(df).alias(f"_{name}at"))
        rows = rows.withColumn("_level", F.explode(F.sequence(F.col(f"_{name}at"), F.lit(top))))
        width = F.call_function("shiftleft", F.lit(cell).cast("long"), F.col("_level"))
        return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"_{name}lo") / width), F.floor((F.col(f"_{name}hi") - 1) / width))))

    pairs = celled(left, "l").join(celled(right, "r"), ["_level", "_cell"]).where("_llo < _rhi and _rlo < _lhi")
    pairs = pairs.where(F.col("_level") == F.greatest("_lat", "_rat"))
    width = F.call_function("shiftleft", F.lit(cell).cast("long"), F.col("_level"))
    return pairs.where(F.col("_cell") == F.floor(F.greatest("_llo", "_rlo") / width)).select("l", "r", F.greatest("_llo", "_rlo").alias("lo"), F.least("_lhi", "_rhi").alias("hi"))


def double_owned(ranges: DataFrame, cell: int) -> DataFrame:
    """Ranges (owner, lo, hi) of different owners that overlap, each pair once."""
    named = ranges.withColumn("_key", F.struct("owner", "lo", "hi"))
    pairs = overlaps(named.select(F.col("_key").alias("l"), "lo", "hi"), named.select(F.col("_key").alias("r"), "lo", "hi"), cell)
    return pairs.where(F.col("l.owner") < F.col("r.owner")).select(F.col("l.owner").alias("a"), F.col("r.owner").alias("b"), "lo", "hi")


def excision(quarantine: DataFrame, live: DataFrame) -> DataFrame:
    """Ranges quarantine(q, lo, hi) with how many live keys (k) they hold: one that holds any is refused."""
    spans = quarantine.select("q", "lo", "hi")
    # keys are matched to ranges by cells as in overlaps(); a key is a range of length one
    found = overlaps(spans.withColumnRenamed("q", "l"), live.select(F.col("k").alias("r"), F.col("k").alias("lo"), (F.col("k") + 1).alias("hi")), 1024)
    held = found.groupBy(F.col("l").alias("q")).agg(F.count("*").alias("live_keys"))
    return spans.join(held, "q", "left").select("q", F.coalesce("live_keys", F.lit(0)).alias("live_keys"), F.when(F.col("live_keys") > 0, "refused").otherwise("excised").alias("verdict"))


def pages(keys: DataFrame) -> DataFrame:
    """keys(page, slot, key, lo, hi) of a tree's pages: order faults and keys out of their page's bounds."""
    order = Window.partitionBy("page").orderBy("slot")
    wrong = F.coalesce(F.lag("key").over(order) >= F.col("key"), F.lit(False))
    out = (F.col("key") < F.col("lo")) | (F.col("key") >= F.col("hi"))
    marked = keys.withColumns({"_wrong": wrong, "_out": out})
    return marked.groupBy("page").agg(F.count("*").alias("keys"), F.count_if("_wrong").alias("order_faults"), F.count_if("_out").alias("bound_faults"))


def damaged(**faults: DataFrame) -> DataFrame:
    """Union of fault lists (ino) with the kind of fault, one row a pair."""
    out = None
    for kind, rows in faults.items():
        part = rows.select("ino", F.lit(kind.replace("_", "-")).alias("kind")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def report(verdicts: dict[str, DataFrame], good: Column | None = None) -> DataFrame:
    """One row a check: how many rows it looked at and how many are faulty."""
    good = F.col("verdict") == "ok" if good is None else good
    out = None
    for name, rows in verdicts.items():
        part = rows.agg(F.lit(name).alias("check"), F.count("*").alias("rows"), F.count_if(~good).alias("faults"))
        out = part if out is None else out.unionByName(part)
    return out
