"""Queries that decide: which files a pass takes, what may move, what is settled when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.model import ROOT, dirents, table
from quarry.operators import classify, namespace, placement
from quarry.plans.catalogue import _DIR, query
from quarry.streaming import sweep


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files with what a sweep asks of them."""
    i = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        i.cast("long").alias("ino"),
        F.when(i % 7 == 0, "d").otherwise("f").alias("type"),
        (i % 3).cast("int").alias("segments"),
        F.when(i % 5 > 1, F.element_at(F.array(F.lit("guard"), F.lit("generic"), F.lit("raw")), (i % 3 + 1).cast("int"))).alias("cls"),
        (i % 4).cast("int").alias("gen"),
        F.when(i % 11 == 0, F.concat(F.lit(classify.INTERNAL), i.cast("string"))).when(i % 13 == 0, "").otherwise(i.cast("string")).alias("name"),
    )


_FILES = "f as (select cast(o_orderkey as bigint) ino, case when o_orderkey % 7 = 0 then 'd' else 'f' end type, o_orderkey % 3 segments, case when o_orderkey % 5 > 1 then ['guard', 'generic', 'raw'][o_orderkey % 3 + 1] end cls, o_orderkey % 4 gen, case when o_orderkey % 11 = 0 then 'internal' when o_orderkey % 13 = 0 then '' else cast(o_orderkey as varchar) end name from orders)"


@query(f"with {_FILES} select ino from f where type = 'f' and segments > 0 and name not in ('internal', '') and (cls is null or gen < 2)")
def sweepable_files(spark, sf):
    return classify.sweepable(_files(spark, sf), 2).select("ino")


@query(f"with {_FILES} select ino, cls, cls = 'guard' or (cls = 'generic' and ino % 2 = 0) again from f where cls is not null")
def rebatch_admission(spark, sf):
    files = _files(spark, sf).where("cls is not null")
    return files.select("ino", "cls", classify.rebatchable(F.col("cls"), F.col("ino") % 2 == 0).alias("again"))


@query(f"with {_FILES}, g(lane, generation) as (values ('guard', 3), ('generic', 1)) select ino, cls lane, gen, generation from f join g on cls = lane where gen < generation")
def retry_lanes(spark, sf):
    files = _files(spark, sf).select("ino", F.col("cls").alias("lane"), "gen")
    now = spark.createDataFrame([("guard", 3), ("generic", 1)], "lane string, generation int")
    return classify.retried(files, now)


@query("select cast(s_suppkey as bigint) ino, s_nationkey < 5 anchored, s_nationkey % 3 = 0 internal from supplier")
def anchored_names(spark, sf):
    nation = F.col("s_nationkey")
    path = F.concat(F.when(nation < 5, "config/").otherwise("configs/"), F.col("s_name"))
    name = F.concat(F.when(nation % 3 == 0, F.lit(classify.INTERNAL)).otherwise(""), F.col("s_name"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("ino"), classify.anchored(path, ["config", "packs/"]).alias("anchored"), classify.internal(name).alias("internal"))


@query("select cast(p_partkey as bigint) ino, cast(floor(p_retailprice) * 100 as bigint) worst, case when ceil(floor(p_retailprice) * 100 / 4096) <= 25 then 'go' else 'no-space' end verdict from part")
def space_admission(spark, sf):
    worst = (F.floor("p_retailprice") * 100).cast("long")
    return placement.admitted(table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("ino"), worst.alias("worst")), 25)


@query("select distinct cast(l_orderkey as bigint) ino from lineitem where l_orderkey not in (select l_orderkey from lineitem where (l_linestatus = 'O' and l_linenumber % 3 = 0) or (l_returnflag = 'R' and l_linenumber = 1))")
def repackable_files(spark, sf):
    tied = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0), 1).otherwise(0)
    view = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), 24).otherwise(1)
    return classify.repackable(table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("ino"), tied.alias("zone"), view.alias("algo")))


@query(f"with {_DIR}, n as (select parent, name, child from dirent where type = 'f' union all select parent, name || '!jxl', child + 7 from dirent where type = 'f' and child % 9 = 4 union all select parent, name || '!note', child + 8 from dirent where type = 'f' and child % 9 = 5 union all select parent, 'gone' || child || '!jxl', child + 9 from dirent where type = 'f' and child % 9 = 6) select parent, name || '!jxl' name, child + 7 child, child owner from dirent where type = 'f' and child % 9 = 4")
def sibling_purge(spark, sf):
    """Internal siblings of files that are there; other names with a bang, and siblings of missing files, stay."""
    files = dirents(spark, sf).where("type = 'f'").select("parent", "name", "child")
    made = lambda rest, name, more: files.where(f"child % 9 = {rest}").select("parent", name.alias("name"), (F.col("child") + more).alias("child"))
    names = files.unionByName(made(4, F.concat("name", F.lit("!jxl")), 7)).unionByName(made(5, F.concat("name", F.lit("!note")), 8)).unionByName(made(6, F.concat(F.lit("gone"), "child", F.lit("!jxl")), 9))
    return namespace.siblings(names, ["jxl", "mp3"])


@query("with m as (select user_id ino, min(event_id) since, max(event_id) marked from events where event_type = 'view' group by 1), d as (select user_id ino, max(event_id) done from events where event_type = 'click' group by 1) select ino, since from m left join d using (ino) where done is null or done < marked")
def pending_files(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("ino"), F.col("event_id").alias("ts"), "event_type")
    return placement.pending(events.where("event_type = 'view'"), events.where("event_type = 'click'"), None)


@query("with m as (select user_id ino, min(event_id) since, max(event_id) marked from events where event_type = 'view' group by 1), d as (select user_id ino, max(event_id) done from events where event_type = 'click' group by 1), o as (select ino, since, row_number() over (order by since, ino) n from m left join d using (ino) where done is null or done < marked) select ino, since, (n - 1) // 3 + 1 pass from o")
def drain_passes(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("ino"), F.col("event_id").alias("ts"), "event_type")
    return sweep.drains(events.where("event_type = 'view'"), events.where("event_type = 'click'"), 3)


@query("select * from (values (1, ''), (2, 'manual'), (3, ''), (4, ''), (5, 'periodic'), (6, ''), (7, ''), (8, 'watermark'), (9, 'watermark'), (10, 'drain'), (11, 'watermark'), (12, 'watermark')) v(tick, pass)")
def sweep_loop(spark, sf):
    """Twelve ticks of the loop: quiet, a signal, the interval, the interval with open files, the fill at its mark, the
    same fill (the pass that is owed), pending files, more fill, and the pass that is owed for it."""
    one = sweep.Tick
    ticks = [one(), one(signal=True), one(), one(), one(), one(), one(), one(fill=95, open_handles=1), one(fill=95, pending=2, writing=True), one(fill=95, pending=2), one(fill=97, open_handles=1), one(fill=97)]
    state, out = sweep.State(), []
    for i, tick in enumerate(ticks, 1):
        out.append((i, sweep.due(state, tick, interval=3, watermark=90)))
    return spark.createDataFrame(out, "tick int, pass string")


@query("select cast(p_partkey as bigint) ino, p_brand flag, cast(p_size as bigint) size, cast(island as bigint) island, cast((total - p_size) // 120 as bigint) batch from (select *, sum(p_size) over (partition by island order by p_size, p_partkey) total from (select *, sum(turn) over (order by p_size, p_partkey) island from (select *, case when lag(p_brand) over (order by p_size, p_partkey) is not distinct from p_brand then 0 else 1 end turn from part)))")
def program_batches(spark, sf):
    members = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("ino"), F.col("p_brand").alias("flag"), F.col("p_size").cast("long").alias("size"))
    return placement.binary_batches(members, 120)


@query(f"with recursive {_DIR}, w as (select '/' || name path, child ino, type from dirent where parent = {ROOT} union all select w.path || '/' || d.name, d.child, d.type from w join dirent d on d.parent = w.ino where w.type = 'd') select path, ino from w")
def walk_receipt(spark, sf):
    """A walk that counts only if every name it met has its row."""
    names = dirents(spark, sf)
    return namespace.walk_strict(names, names.select(F.col("child").alias("ino")).distinct(), ROOT).select("path", "ino")
