"""An ordered key-value store as a base snapshot and a change log: replay, overlay reads, compaction, time travel.

base has (k, v), the log (k, seq, op, v). Of a key's records the one with the highest seq counts; it wins over the
base, and a delete hides the key even where the base lacks it. The log is reduced to one row a key (partial
aggregation before the shuffle) before it meets the base, so a hot key costs no more than any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """One record a key, deletes included."""
    return log.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("r")).select("k", F.col("r.seq").alias("seq"), F.col("r.op").alias("op"), F.col("r.v").alias("v"))


def until(log: DataFrame, seq: int) -> DataFrame:
    """The log as it was before a sequence number."""
    return log.where(F.col("seq") < seq)


def valid_prefix(log: DataFrame, bad: Column, *segment: str) -> DataFrame:
    """Records before the first bad one of their segment (of the whole log without segment columns)."""
    cut = log.where(bad).groupBy(*segment).agg(F.min("seq").alias("_cut"))
    if segment:
        return log.join(cut, list(segment), "left").where("_cut is null or seq < _cut").drop("_cut")
    first = cut.first()._cut
    return log if first is None else log.where(F.col("seq") < first)


def fold(base: DataFrame, log: DataFrame) -> DataFrame:
    """The compacted snapshot and where each row comes from: base, delta or both (delta over a base row)."""
    delta = latest(log).select("k", F.col("op").alias("_op"), F.col("v").alias("_v"), F.lit(True).alias("_in"))
    rows = base.withColumn("_base", F.lit(True)).join(delta, "k", "full_outer").where("_op is null or _op <> 'D'")
    origin = F.when(F.col("_in").isNull(), "base").when(F.col("_base").isNull(), "delta").otherwise("both")
    return rows.select("k", F.when(F.col("_in").isNull(), F.col("v")).otherwise(F.col("_v")).alias("v"), origin.alias("origin"))


def live(base: DataFrame, log: DataFrame) -> DataFrame:
    """The overlay read: all live rows."""
    return fold(base, log).drop("origin")


def key_range(base: DataFrame, log: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Live rows with low <= k < high in key order; None is unbounded. Both sides are cut before they meet."""

    def within(df: DataFrame) -> DataFrame:
        df = df if low is None else df.where(F.col("k") >= low)
        return df if high is None else df.where(F.col("k") < high)

    return live(within(base), within(log)).orderBy("k")


def get(base: DataFrame, log: DataFrame, key: int) -> DataFrame:
    """The live row of one key, or none."""
    return key_range(base, log, key, key + 1)


def at(base: DataFrame, log: DataFrame, seq: int) -> DataFrame:
    """The live rows before a sequence number."""
    return live(base, until(log, seq))


def difference(base: DataFrame, log: DataFrame, early: int, late: int) -> DataFrame:
    """Keys added, removed or changed between two points of the log. Only keys touched in between can differ."""
    touched = log.where((F.col("seq") >= early) & (F.col("seq") < late)).select("k").distinct()
    base, log = base.join(touched, "k", "left_semi"), until(log, late).join(touched, "k", "left_semi")
    one = at(base, log, early).select("k", F.col("v").alias("before"), F.lit(True).alias("_a"))
    two = live(base, log).select("k", F.col("v").alias("after"), F.lit(True).alias("_b"))
    rows = one.join(two, "k", "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return rows.select("k", kind.alias("change"), "before", "after").where("change is not null")


def next_id(base: DataFrame, log: DataFrame) -> DataFrame:
    """The first id above all of base and log."""
    return base.select("k").unionByName(log.select("k")).agg((F.coalesce(F.max("k"), F.lit(0)) + 1).alias("next_id"))


def fold_due(log: DataFrame, now: Column, max_bytes: int = 64 << 20, max_records: int = 262_144, max_age: int = 3600) -> DataFrame:
    """Whether a log(k, seq, op, v, ts) should be folded: by bytes, by records or by the age of its oldest record."""
    size = F.sum(F.lit(20) + F.coalesce(F.octet_length(F.col("v").cast("string")), F.lit(0)))
    seen = log.agg(F.count("*").alias("records"), F.coalesce(size, F.lit(0)).alias("bytes"), F.min("ts").alias("oldest"))
    age = F.unix_timestamp(now) - F.unix_timestamp("oldest")
    return seen.select("records", "bytes", ((F.col("records") >= max_records) | (F.col("bytes") >= max_bytes) | F.coalesce(age >= max_age, F.lit(False))).alias("due"))
