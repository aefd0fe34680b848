"""The query catalogue: one entry for each query, with the SQL that checks it.

Queries read the test tables through quarry.model and apply the operators; each computed column has the same name on
both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import model
from quarry.model import GRID, ROOT, STRIDE, table
from quarry.operators import audit, classify, heat, mutate, namespace, overlay, placement, seal, segments, stats

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Production parameters of the queries below.
LOG_CUT, RANGE = 700, (100, 900)
MAP_LOW, MAP_HIGH = 20, 120
BATCH_CAP, SYMBOL, K = 65_536, 4_096, 8

# The parts that several checks share.
_SEG = f"seg as (select doc_id ino, cast(i as bigint) lba, substring(text, cast(i * {GRID} + 1 as bigint), {GRID}) chunk from documents, unnest(range(0, (length(text) - 1) // {GRID} + 1)) u(i) where length(text) > 0), h as (select *, cast(length(chunk) as bigint) len, sha256(chunk) hash from seg), c as (select *, first_value(ino) over w to_ino, first_value(lba) over w to_lba, count(*) over (partition by hash) copies from h window w as (partition by hash order by ino, lba))"
_LOG = "log as (select user_id k, event_id seq, case when event_type = 'error' then 'D' else 'P' end op, value v from events), base as (select cast(c_custkey as bigint) k, c_acctbal v from customer)"
_LATEST = "latest as (select k, arg_max(op, seq) op, max(seq) seq, arg_max(v, seq) v from {log} group by k)"
_LIVE = "coalesce(b.k, d.k) k, case when d.k is null then b.v else d.v end v from {base} b full join latest d on b.k = d.k where d.op is null or d.op <> 'D'"
_EXT = "ext as (select l_orderkey ino, cast(row_number() over w as bigint) idx, cast(sum(cast(floor(l_quantity) as bigint)) over (w rows unbounded preceding) as bigint) - cast(floor(l_quantity) as bigint) off, cast(floor(l_quantity) as bigint) len, l_returnflag algo, l_linestatus zone, l_partkey block from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax))"
_DIR = f"""dirent as (
  select cast({ROOT} as bigint) parent, r_name name, {1 * STRIDE} + cast(r_regionkey as bigint) child, 'd' type, 0::bigint size from region
  union all select {1 * STRIDE} + cast(n_regionkey as bigint), n_name, {2 * STRIDE} + cast(n_nationkey as bigint), 'd', 0 from nation
  union all select {2 * STRIDE} + cast(c_nationkey as bigint), 'c' || c_custkey, {3 * STRIDE} + cast(c_custkey as bigint), 'd', 0 from customer
  union all select {2 * STRIDE} + cast(s_nationkey as bigint), 's' || s_suppkey, {4 * STRIDE} + cast(s_suppkey as bigint), 'f', cast(greatest(floor(s_acctbal), 0) as bigint) from supplier
  union all select {3 * STRIDE} + cast(o_custkey as bigint), 'o' || o_orderkey, {5 * STRIDE} + cast(o_orderkey as bigint), 'f', cast(floor(o_totalprice) as bigint) from orders)"""
_WALK = _DIR + f""", w as (select '/' || name path, 1 depth, child ino, parent, type, size, [cast({ROOT} as bigint)] anc from dirent where parent = {ROOT}
  union all select w.path || '/' || d.name, w.depth + 1, d.child, d.parent, d.type, d.size, list_append(w.anc, d.parent) from w join dirent d on d.parent = w.ino where w.type = 'd')"""
_BLOCKS = "blk as (select cast(o_orderkey as bigint) block, bool_or(o_orderstatus = 'O') used from orders group by 1)"
_ISLANDS = "runs as (select min(block) start, count(*) length from (select block, block - row_number() over (order by block) g from ({which})) group by g)"
_HEAT = "t as (select distinct user_id ino, cast(ts as date) d from events), r as (select ino, count(*) r from t group by 1), wr as (select user_id ino, count(*) w from events where event_type = 'purchase' group by 1), heat as (select ino, cast(least(coalesce(r, 0), 65535) as bigint) rheat, cast(least(coalesce(w, 0), 255) as bigint) wheat from r full join wr using (ino))"
_TEXTCLASS = "(octet_length(encode(text)) > 0 and not contains(hex8, '00') and len(list_filter(hex8, lambda x: (x >= '20' and x <= '7E') or x in ('09', '0A', '0D'))) * 100 >= len(hex8) * 85)"
_HEADS = "d as (select doc_id, text, regexp_extract_all(substring(hex(encode(text)), 1, 16384), '..') hex8 from documents where text is not null)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments.cut(model.files(table(spark, sf, "documents")).select("ino", "content"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return model.change_log(table(spark, sf, "events"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return model.base_rows(table(spark, sf, "customer"))


def _extents(spark: SparkSession, sf: str) -> DataFrame:
    return model.extents(table(spark, sf, "lineitem"))


def _walk(spark: SparkSession, sf: str) -> DataFrame:
    return namespace.walk(model.dirents(spark, sf), ROOT, 5)


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderkey").cast("long").alias("block")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("used"))


def _heat(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumnRenamed("user_id", "ino")
    return heat.accrue(heat.session_touches(events, F.to_date("ts")), events.where("event_type = 'purchase'"))


# --- segments -----------------------------------------------------------------------------------------------------
@query(f"with {_SEG} select count(*) segments, cast(coalesce(sum(len), 0) as bigint) logical, cast(coalesce(sum(len) filter (where ino = to_ino and lba = to_lba), 0) as bigint) physical, count(*) filter (where ino <> to_ino) cross_merged, count(*) filter (where ino = to_ino and lba <> to_lba) intra_merged from c")
def dedupe_stats(spark, sf):
    return segments.dedupe_stats(_segments(spark, sf))


@query(f"with {_SEG} select ino, lba, to_ino, to_lba from c where ino <> to_ino or lba <> to_lba")
def dedupe_remap(spark, sf):
    return segments.remap(_segments(spark, sf))


@query(f"with {_SEG} select ino, count(*) merges, count(distinct to_ino) owners from c where ino <> to_ino or lba <> to_lba group by ino")
def dedupe_remap_by_file(spark, sf):
    return segments.remap_by_file(_segments(spark, sf))


@query(f"with {_SEG} select ino, cast(sum(len) as bigint) dup_chars from c where ino <> to_ino or lba <> to_lba group by ino order by dup_chars desc, ino limit 10")
def dedupe_top_files(spark, sf):
    return segments.top_files(_segments(spark, sf), 10)


@query(f"with {_SEG} select count(*) filter (where ino = to_ino and lba = to_lba) unique_chunks, cast(coalesce(sum(len) filter (where ino = to_ino and lba = to_lba), 0) as bigint) unique_chars, cast(coalesce(sum(len) filter (where ino <> to_ino or lba <> to_lba), 0) as bigint) dup_chars, round(sum(len) / sum(len) filter (where ino = to_ino and lba = to_lba), 6) ratio from c")
def unique_space(spark, sf):
    return segments.unique_space(_segments(spark, sf))


@query()
def unique_space_approx(spark, sf):
    return segments.unique_space_approx(_segments(spark, sf))


@query("select doc_id ino, cast(length(text) as bigint) chars, true ok from documents where length(text) > 0")
def reassemble_check(spark, sf):
    return segments.verified(model.files(table(spark, sf, "documents")).select("ino", "content"))


@query(f"with {_SEG} select distinct to_ino, to_lba, copies from c where copies > 1")
def refcounts(spark, sf):
    return segments.refcounts(_segments(spark, sf))


@query(f"with {_EXT} select ino, idx, greatest(off, {RANGE[0]}) from_off, least(off + len, {RANGE[1]}) - greatest(off, {RANGE[0]}) take, greatest(off, {RANGE[0]}) - off skip from ext where off < {RANGE[1]} and off + len > {RANGE[0]}")
def range_read(spark, sf):
    return segments.range_read(_extents(spark, sf), *RANGE)


@query("with p as (select distinct text blob from documents) select sha256(blob) addr, length(blob) chars from p where sha256(blob) not in (select sha256(text) from documents where doc_id % 3 = 0 and text is not null) and blob is not null")
def content_put(spark, sf):
    blobs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("blob"))
    there = blobs.where("doc_id % 3 = 0").select(F.sha2(F.col("blob").cast("binary"), 256).alias("addr"))
    return segments.put(there, blobs.select("blob")).select("addr", F.length("blob").cast("long").alias("chars"))


@query("select sha256(text) addr, max(length(text)) chars from documents where text is not null group by 1")
def content_get(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    store = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("addr"), F.col("text").alias("blob")).dropDuplicates(["addr"])
    return segments.load(store, store.select("addr")).select("addr", F.length("blob").cast("long").alias("chars"))


# --- overlay ------------------------------------------------------------------------------------------------------
@query(f"with {_LOG}, {_LATEST.format(log='log')} select {_LIVE.format(base='base')}")
def overlay_live(spark, sf):
    return overlay.live(_base(spark, sf), _log(spark, sf))


@query(f"with {_LOG}, {_LATEST.format(log='log')}, l as (select {_LIVE.format(base='base')}) select * from l where k >= {MAP_LOW} and k < {MAP_HIGH}")
def overlay_range(spark, sf):
    return overlay.key_range(_base(spark, sf), _log(spark, sf), MAP_LOW, MAP_HIGH)


@query(f"with {_LOG}, {_LATEST.format(log='log')} select coalesce(b.k, d.k) k, case when d.k is null then b.v else d.v end v, case when d.k is null then 'base' when b.k is null then 'delta' else 'both' end origin from base b full join latest d on b.k = d.k where d.op is null or d.op <> 'D'")
def fold_snapshot(spark, sf):
    return overlay.fold(_base(spark, sf), _log(spark, sf))


@query(f"with {_LOG}, p as (select * from log where seq < {LOG_CUT}), {_LATEST.format(log='p')} select {_LIVE.format(base='base')}")
def time_travel(spark, sf):
    return overlay.at(_base(spark, sf), _log(spark, sf), LOG_CUT)


@query(f"with {_LOG}, c as (select k, min(seq) cut from log where seq % 97 = 13 group by k) select log.k, seq, op from log left join c using (k) where cut is null or seq < cut")
def valid_prefix(spark, sf):
    return overlay.valid_prefix(_log(spark, sf), F.col("seq") % 97 == 13, "k").select("k", "seq", "op")


@query(f"with {_LOG}, {_LATEST.format(log='log')} select k, seq, op from latest")
def log_latest(spark, sf):
    return overlay.latest(_log(spark, sf)).select("k", "seq", "op")


@query(f"""with {_LOG}, l1 as (select k, arg_max(op, seq) op, arg_max(v, seq) v from log where seq < 300 group by k), l2 as (select k, arg_max(op, seq) op, arg_max(v, seq) v from log where seq < {LOG_CUT} group by k),
a as (select coalesce(b.k, d.k) k, case when d.k is null then b.v else d.v end v from base b full join l1 d on b.k = d.k where d.op is null or d.op <> 'D'),
z as (select coalesce(b.k, d.k) k, case when d.k is null then b.v else d.v end v from base b full join l2 d on b.k = d.k where d.op is null or d.op <> 'D')
select coalesce(a.k, z.k) k, case when a.k is null then 'added' when z.k is null then 'removed' else 'changed' end change, a.v before, z.v after from a full join z on a.k = z.k where a.k is null or z.k is null or a.v is distinct from z.v""")
def snapshot_diff(spark, sf):
    return overlay.difference(_base(spark, sf), _log(spark, sf), 300, LOG_CUT)


@query(f"with {_LOG} select max(k) + 1 next_id from (select k from log union all select k from base)")
def next_id(spark, sf):
    return overlay.next_id(_base(spark, sf), _log(spark, sf))


@query("select count(*) records, cast(sum(20 + length(cast(user_id as varchar))) as bigint) bytes, count(*) >= 262144 or sum(20 + length(cast(user_id as varchar))) >= 67108864 or date_diff('second', min(ts), timestamp '2030-01-01') >= 3600 due from events")
def fold_trigger(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("v"), "ts")
    return overlay.fold_due(log, F.lit("2030-01-01").cast("timestamp"))


# --- namespace ----------------------------------------------------------------------------------------------------
@query(f"with recursive {_WALK} select path, depth, ino, type, size from w")
def namespace_walk(spark, sf):
    return _walk(spark, sf).select("path", "depth", "ino", "type", "size")


@query(f"with {_DIR} select name, child ino, type, size from dirent where parent = {2 * STRIDE + 7} order by name, ino limit 50")
def dir_listing(spark, sf):
    return namespace.listing(model.dirents(spark, sf), 2 * STRIDE + 7, 50)


@query(f"with recursive {_WALK} select a ino, count(*) files, cast(sum(size) as bigint) bytes from w, unnest(anc) u(a) where type = 'f' group by a")
def dir_usage(spark, sf):
    return namespace.usage(_walk(spark, sf))


_PATHS = ("/", "/ASIA", "/ASIA/../EUROPE/.", "/./AFRICA//", "/nowhere/at/all", "/../..", "/AMERICA/x")


@query(f"with {_DIR}, p(path, name) as (values ('/', ''), ('/ASIA', 'ASIA'), ('/ASIA/../EUROPE/.', 'EUROPE'), ('/./AFRICA//', 'AFRICA'), ('/nowhere/at/all', '?'), ('/../..', ''), ('/AMERICA/x', '?')) select path, case when p.name = '' then {ROOT} else child end ino from p left join dirent d on d.parent = {ROOT} and d.name = p.name")
def path_lookup(spark, sf):
    return namespace.lookup(model.dirents(spark, sf), spark.createDataFrame([(p,) for p in _PATHS], "path string"), ROOT, 5)


@query(f"with recursive {_WALK} select ino, path from w where depth = 4")
def reverse_path(spark, sf):
    orders = table(spark, sf, "orders").select(model.entry_id(model.ORDER, "o_orderkey").alias("ino")).unionByName(table(spark, sf, "supplier").select(model.entry_id(model.SUPPLIER, "s_suppkey").alias("ino")))
    found = namespace.reverse(model.dirents(spark, sf), orders, ROOT, 5)
    return found.where("path is not null").where(F.size(F.split("path", "/")) == 5)


@query(f"with {_DIR}, n as (select * from dirent where type = 'd' or child % 10 = 3) select child ino, name from n where type = 'd' and child not in (select parent from n)")
def empty_dirs(spark, sf):
    return namespace.removable(model.dirents(spark, sf).where("type = 'd' or child % 10 = 3"))


# --- statistics ---------------------------------------------------------------------------------------------------
@query(f"with {_DIR} select count(*) filter (where type = 'f') files, count(*) filter (where type = 'd') dirs, cast(sum(size) filter (where type = 'f') as bigint) logical, max(size) filter (where type = 'f') biggest_size, (select name from dirent where type = 'f' order by size desc, name desc limit 1) biggest from dirent")
def volume_stats(spark, sf):
    return stats.volume(model.dirents(spark, sf))


@query(f"with {_EXT}, l as (select zone, count(*) entries, cast(sum(len) as bigint) logical from ext group by zone), c as (select block, min((zone, len)) c from ext group by block), p as (select c[1] zone, count(*) blocks, cast(sum(c[2]) as bigint) physical from c group by 1) select zone, entries, logical, coalesce(blocks, 0) blocks, coalesce(physical, 0) physical from l left join p using (zone)")
def zone_stats(spark, sf):
    return stats.zones(_extents(spark, sf))


@query("with p as (select case when doc_id % 2 = 0 then 'even' else 'odd' end cls, cast(octet_length(encode(text)) as bigint) size from documents where text is not null), q as (select *, cast(ceil((size + 8) / 4096) as bigint) * 4096 phys, case when size < 4096 then 0 when size < 8192 then 1 when size < 65536 then 2 when size < 262144 then 3 when size < 1048576 then 4 else 5 end bucket from p) select cls, bucket, count(*) n, cast(sum(size) as bigint) logical, cast(sum(phys) as bigint) physical, cast(sum(phys) - sum(size) as bigint) waste from q group by cls, bucket")
def segment_histogram(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return stats.histogram(docs.select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("cls"), F.octet_length("text").cast("long").alias("size")))


@query(f"with {_BLOCKS}, {_ISLANDS.format(which='select block from blk where not used')} select count(*) runs, cast(coalesce(sum(length), 0) as bigint) free, coalesce(max(length), 0) largest, round(1 - max(length) / sum(length), 6) score from runs")
def frag_score(spark, sf):
    return stats.fragmentation(_blocks(spark, sf))


@query(f"with {_BLOCKS}, {_ISLANDS.format(which='select block from blk where used and block % 11 <> 0')} select start, length from runs")
def unclaimed_runs(spark, sf):
    blocks = _blocks(spark, sf)
    return stats.unclaimed_runs(blocks, blocks.where("block % 11 = 0"))


@query(f"with {_BLOCKS}, u as (select count(*) filter (where used) used, count(*) filter (where not used) free, count(*) filter (where block % 11 = 0) claimed from blk) select used, free, claimed, greatest(used - claimed, 0) unclaimed from u")
def block_use(spark, sf):
    blocks = _blocks(spark, sf)
    return stats.block_use(blocks, blocks.where("block % 11 = 0"))


@query("select case when toxic = 1 then 'guard' when quality = 1 then 'generic' else 'raw' end cls, count(*) files from labels group by 1")
def algo_usage(spark, sf):
    stamp = F.when(F.col("toxic") == 1, "guard").when(F.col("quality") == 1, "generic").otherwise("raw")
    return stats.usage_by(table(spark, sf, "labels").select(stamp.alias("cls")), "cls")


@query(f"with {_EXT}, a(algo, codec) as (values ('A', 'zstd'), ('N', 'none')) select ino, idx, off, len, zone, coalesce(codec, 'unknown') codec, cast(ceil((len + 8) / 4096) as bigint) blocks from ext left join a using (algo) where ino = 3")
def storage_inspector(spark, sf):
    algos = spark.createDataFrame([("A", "zstd"), ("N", "none")], "algo string, codec string")
    return stats.inspector(_extents(spark, sf), algos, 3)


# --- audits -------------------------------------------------------------------------------------------------------
@query(f"""with {_DIR}, n as (select child ino, count(*) names from (select child from dirent where type = 'f' and child % 97 <> 5 union all select child from dirent where type = 'f' and child % 89 = 7 union all select 9000000000000 + o_orderkey from orders where o_orderkey % 101 = 3) group by 1),
i as (select child ino, 1 nlink from dirent where type = 'f') select coalesce(i.ino, n.ino) ino, nlink, coalesce(names, 0) names, case when nlink is null then 'dead' when names is null then 'orphan-row' when names < nlink then 'missing-name' when names > nlink then 'stale-dirent' else 'ok' end verdict from i full join n on i.ino = n.ino""")
def nlink_audit(spark, sf):
    files = model.dirents(spark, sf).where("type = 'f'").select("child")
    ghosts = table(spark, sf, "orders").where("o_orderkey % 101 = 3").select((F.lit(9 * STRIDE) + F.col("o_orderkey")).alias("child"))
    names = files.where("child % 97 <> 5").unionByName(files.where("child % 89 = 7")).unionByName(ghosts)
    return audit.links(files.select(F.col("child").alias("ino"), F.lit(1).alias("nlink")), names)


_PLANTED = f"""{_EXT}, faulty as (select ino, idx, case when ino % 13 = 1 and idx = 2 then off - 1 else off end off, case when ino % 17 = 2 and idx = 1 then len - 1 else len end len from ext where not (ino % 41 = 0)),
sz as (select ino, case when ino % 19 = 3 then sum(len) - 1 else sum(len) end size from ext group by ino),
j as (select coalesce(f.ino, sz.ino) ino, idx, off, len, size, max(off + len) over (partition by coalesce(f.ino, sz.ino) order by idx rows between unbounded preceding and 1 preceding) before from faulty f full join sz on f.ino = sz.ino),
k as (select ino, max(size) size, coalesce(sum(len), 0) covered, count(idx) n, arg_min(fault, idx) filter (where fault is not null) first from (select *, case when off < 0 or len < 0 or off + len > size then 'BOUNDS' when off < before then 'OVERLAP' end fault from j) group by ino),
verdicts as (select ino, case when size is null or (size > 0 and n = 0) then 'SIZE' when first is not null then first when covered <> size then 'COVERAGE' else 'ok' end verdict from k)"""


def _tiling(spark: SparkSession, sf: str) -> DataFrame:
    ext = _extents(spark, sf)
    off = F.when((F.col("ino") % 13 == 1) & (F.col("idx") == 2), F.col("off") - 1).otherwise(F.col("off"))
    size = F.when((F.col("ino") % 17 == 2) & (F.col("idx") == 1), F.col("len") - 1).otherwise(F.col("len"))
    faulty = ext.where("ino % 41 <> 0").select("ino", "idx", off.alias("off"), size.alias("len"))
    total = ext.groupBy("ino").agg(F.sum("len").alias("_s")).select("ino", F.when(F.col("ino") % 19 == 3, F.col("_s") - 1).otherwise(F.col("_s")).alias("size"))
    return audit.tiling(faulty, total)


@query(f"with {_PLANTED} select ino, verdict from verdicts")
def recipe_audit(spark, sf):
    return _tiling(spark, sf)


@query(f"with {_PLANTED}, n as (select o_custkey ino, count(*) names from orders where o_orderkey % 3 <> 1 group by 1), i as (select c_custkey ino, 1 + c_custkey % 4 nlink from customer) select 'tiling' \"check\", count(*) \"rows\", count(*) filter (where verdict <> 'ok') faults from verdicts union all select 'links', count(*), count(*) filter (where nlink is null or names is null or nlink <> names) from i full join n on i.ino = n.ino")
def fsck_report(spark, sf):
    names = table(spark, sf, "orders").where("o_orderkey % 3 <> 1").select(F.col("o_custkey").alias("child"))
    inodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("ino"), (1 + F.col("c_custkey") % 4).alias("nlink"))
    return audit.report({"tiling": _tiling(spark, sf), "links": audit.links(inodes, names)})


@query(f"with {_PLANTED} select distinct ino, 'tiling' kind from verdicts where verdict <> 'ok' union all select distinct cast(o_orderkey as bigint), 'no-content' from orders where o_orderkey not in (select ino from ext)")
def damaged_files(spark, sf):
    bare = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("ino")).join(_extents(spark, sf).select("ino").distinct(), "ino", "left_anti")
    return audit.damaged(tiling=_tiling(spark, sf).where("verdict <> 'ok'"), no_content=bare)


@query("select cast(p_partkey as bigint) block from part where p_partkey not in (select l_partkey from lineitem where l_orderkey % 3 = 0)")
def orphan_rows(spark, sf):
    used = table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_partkey").cast("long").alias("block"))
    return audit.orphans(table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("block")), used, "block")


@query("with q as (select n_nationkey q, n_nationkey * 50 lo, n_nationkey * 50 + 30 hi from nation), l as (select distinct cast(o_orderkey as bigint) k from orders where o_orderstatus = 'P') select q, count(k) live_keys, case when count(k) > 0 then 'refused' else 'excised' end verdict from q left join l on k >= lo and k < hi group by q")
def excise_safety(spark, sf):
    quarantine = table(spark, sf, "nation").select(F.col("n_nationkey").alias("q"), (F.col("n_nationkey") * 50).cast("long").alias("lo"), (F.col("n_nationkey") * 50 + 30).cast("long").alias("hi"))
    live = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("long").alias("k")).distinct()
    return audit.excision(quarantine, live)


@query("with r as (select c_custkey owner, cast(c_custkey as bigint) * 10 lo, cast(c_custkey as bigint) * 10 + 8 + c_custkey % 7 hi from customer) select a.owner a, b.owner b, greatest(a.lo, b.lo) lo, least(a.hi, b.hi) hi from r a join r b on a.owner < b.owner and a.lo < b.hi and b.lo < a.hi")
def double_owned(spark, sf):
    key = F.col("c_custkey").cast("long")
    ranges = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), (key * 10).alias("lo"), (key * 10 + 8 + key % 7).alias("hi"))
    return audit.double_owned(ranges, 64)


@query("with p as (select n_regionkey page, row_number() over (partition by n_regionkey order by n_name) slot, n_nationkey as key, 0 lo, 23 hi from nation), m as (select page, coalesce(lag(key) over (partition by page order by slot) >= key, false) w, key < lo or key >= hi o from p) select page, count(*) keys, count(*) filter (where w) order_faults, count(*) filter (where o) bound_faults from m group by page")
def tree_check(spark, sf):
    from pyspark.sql import Window

    slot = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    keys = table(spark, sf, "nation").select(F.col("n_regionkey").alias("page"), slot.alias("slot"), F.col("n_nationkey").alias("key"), F.lit(0).alias("lo"), F.lit(23).alias("hi"))
    return audit.pages(keys)


# --- heat and placement -------------------------------------------------------------------------------------------
@query("select count(*) touches, count(distinct user_id) inos from (select distinct user_id, cast(ts as date) d from events)")
def session_touch(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "ino")
    return heat.session_touches(events, F.to_date("ts")).agg(F.count("*").alias("touches"), F.count_distinct("ino").alias("inos"))


@query(f"with {_HEAT} select ino, rheat >> 2 rheat, greatest(wheat - 2, 0) wheat from heat")
def heat_decay(spark, sf):
    return heat.decay(_heat(spark, sf), 2)


@query(f"with {_HEAT}, b as (select least(64, count(*) // 10) budget from heat), o as (select row_number() over (order by rheat desc, ino) rank, ino, rheat from heat where rheat >= 8) select rank, ino, rheat from o, b where rank <= budget")
def heat_promote(spark, sf):
    return heat.promote(_heat(spark, sf))


@query("with c as (select cast(p_partkey as bigint) block, cast(p_size as bigint) rheat, cast(floor(p_retailprice) as bigint) len from part), n as (select greatest(sum(len) - 80000, 0) need from c), o as (select *, sum(len) over (order by rheat, block) total from c) select block, rheat, len, cast(total as bigint) total from o, n where total - len < need")
def tier_evict(spark, sf):
    copies = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("block"), F.col("p_size").cast("long").alias("rheat"), F.floor("p_retailprice").cast("long").alias("len"))
    return heat.tier_evict(copies, 100_000)


@query(f"with e as (select lang family, doc_id ino, cast(octet_length(encode(text)) as bigint) size from documents where length(text) > 0), r as (select *, cast(sum(size) over (partition by family order by size, ino) as bigint) e from e) select family, ino, size, (e - size) // {BATCH_CAP} first_batch, (e - 1) // {BATCH_CAP} last_batch from r")
def batch_pack(spark, sf):
    members = table(spark, sf, "documents").where("length(text) > 0").select(F.col("lang").alias("family"), F.col("doc_id").alias("ino"), F.octet_length("text").cast("long").alias("size"))
    return placement.batches(members, BATCH_CAP)


@query("select cast(s_suppkey as bigint) batch, s_name from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49 and l_suppkey % 7 <> 3)")
def batch_gc(spark, sf):
    live = table(spark, sf, "lineitem").where("l_quantity > 49 and l_suppkey % 7 <> 3").select(F.col("l_suppkey").cast("long").alias("batch"))
    return placement.garbage(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("batch"), "s_name"), live)


@query("with f as (select doc_id ino, cast(octet_length(encode(text)) as bigint) size from documents where text is not null), c as (select *, cast(ceil((size + 8) / 4096) as bigint) blocks from f), t as (select *, cast(sum(blocks) over (order by size, ino) as bigint) total from c) select ino, size, blocks, total from t where total <= 200")
def migrate_plan(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return placement.migration(docs.select(F.col("doc_id").alias("ino"), F.octet_length("text").cast("long").alias("size")), 200)


@query("with m as (select lang container, cast(octet_length(encode(text)) as bigint) size, cast(octet_length(encode(text)) * (40 + doc_id % 70) // 100 as bigint) packed from documents where text is not null), g as (select container, count(*) members, cast(sum(size) as bigint) original, cast(4096 + cast(ceil(sum(least(packed, size)) / 4096) as bigint) * 4096 + count(*) * 64 as bigint) projected from m group by 1) select *, case when projected * 1000 < original * 780 then 'accept' else 'decline' end verdict from g")
def size_guard(spark, sf):
    size = F.octet_length("text").cast("long")
    members = table(spark, sf, "documents").where("text is not null").select(F.col("lang").alias("container"), size.alias("size"), F.expr("cast(octet_length(text) * (40 + doc_id % 70) div 100 as bigint)").alias("packed"))
    return placement.size_guard(members, 220)


# --- classification -----------------------------------------------------------------------------------------------
#: What the extensions of the test names give: C, Python, JavaScript, Java, Rust, Go, data, prose, web, shell, nothing.
_NAMES = ("a.HPP", "b.py", "c.mjs", "d.java", "e.rs", "f.go", "g.csv", "x/h.TXT", "i.css", "j.bash", "k.htm", "l.md/m", "n.")


@query(f"with {_HEADS} select doc_id ino, {_TEXTCLASS} is_text, case when doc_id % 13 < 10 then doc_id % 13 + 1 when {_TEXTCLASS} then 11 else 0 end family from d")
def text_classify(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 13).cast("int"))
    return docs.select(F.col("doc_id").alias("ino"), classify.is_text(F.col("text")).alias("is_text"), classify.text_family(name, F.col("text")).alias("family"))


@query(f"with {_HEADS} select doc_id ino, case when octet_length(encode(text)) < 1024 then 'sub-block-batch' when doc_id % 10 = 0 then 'anchored' when doc_id % 7 >= 5 then 'write-hot' when doc_id % 11 = 0 then 'gz' when doc_id % 11 = 1 then 'container' when {_TEXTCLASS} then 'text-batch' when doc_id % 2 = 0 then 'program-batch' else 'generic' end lane from d")
def lane_dispatch(spark, sf):
    i = F.col("doc_id")
    codec = F.when(i % 11 == 0, "gz").when(i % 11 == 1, "zip")
    lane = classify.lane(F.octet_length("text"), i % 10 == 0, F.when(i % 7 >= 5, 2).otherwise(0), codec, classify.is_text(F.col("text")), i % 2 == 0, block=1024)
    return table(spark, sf, "documents").where("text is not null").select(i.alias("ino"), lane.alias("lane"))


_VERSIONS = ("1.2.10", "1.10.2", "1.2.9", "2.0.0", "beta", "1.2", "10.0.1", "alpha")


@query("select * from (values (1, '1.2.9'), (2, '1.2.10'), (3, '1.10.2'), (4, '2.0.0'), (5, '10.0.1'), (6, '1.2'), (7, 'alpha'), (8, 'beta')) v(place, version)")
def version_sort(spark, sf):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(v,) for v in _VERSIONS], "version string")
    return rows.select(F.row_number().over(Window.orderBy(classify.version_key(F.col("version")))).alias("place"), "version")


@query("select s_suppkey ino, case when s_nationkey = 3 then (s_suppkey % 512) & 128 <> 0 when s_nationkey in (1, 2) then (s_suppkey % 512) & 16 <> 0 else (s_suppkey % 512) & 2 <> 0 end may_write from supplier")
def permission_check(spark, sf):
    mode = (F.col("s_suppkey") % 512).cast("int")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ino"), F.when(F.col("s_nationkey") == 3, classify.permitted(mode, F.lit(3), F.lit(0), 3, [], "w")).otherwise(classify.permitted(mode, F.lit(-1), F.col("s_nationkey"), 3, [1, 2], "w")).alias("may_write"))


# --- sealing and checksums ----------------------------------------------------------------------------------------
@query(f"with f as (select 'n' || lpad(cast(doc_id as varchar), 12, '0') name, cast(octet_length(encode(text)) as bigint) size from documents where length(text) > 0), t as (select *, cast(sum(size) over (order by name) as bigint) t from f) select name, size, (t - size) // {SYMBOL} first_symbol, (t - 1) // {SYMBOL} last_symbol, (t - size) // {SYMBOL} // {K} first_group, (t - 1) // {SYMBOL} // {K} last_group from t")
def seal_groups(spark, sf):
    files = table(spark, sf, "documents").where("length(text) > 0").select(F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"), F.octet_length("text").cast("long").alias("size"))
    return seal.groups(files, SYMBOL, K)


@query("with s as (select o_orderkey // 8 grp, cast(floor(o_totalprice) as bigint) v from orders), a as (select grp, bit_xor(v) p from s group by 1), b as (select grp, bit_xor(case when grp % 37 = 5 then v + 1 else v end) q from s where grp % 53 <> 9 group by 1) select grp, case when q is null then 'missing' when p = q then 'ok' else 'damaged' end verdict from a left join b using (grp)")
def seal_scrub(spark, sf):
    symbols = table(spark, sf, "orders").select(F.expr("o_orderkey div 8").alias("grp"), F.floor("o_totalprice").cast("long").alias("value"))
    sealed = seal.parity(symbols)
    hurt = symbols.where("grp % 53 <> 9").withColumn("value", F.when(F.col("grp") % 37 == 5, F.col("value") + 1).otherwise(F.col("value")))
    return seal.scrub(hurt, sealed)


# --- mutations and maps -------------------------------------------------------------------------------------------
@query("select doc_id ino, sha256(left(t, 100) || 'REWRITTEN' || substring(t, 110)) content from (select doc_id, case when length(text) < 100 then rpad(text, 100, chr(0)) else text end t from documents where doc_id % 4 = 1 and text is not null)")
def write_session(spark, sf):
    content = model.files(table(spark, sf, "documents")).select("ino", "content")
    writes = content.where("ino % 4 = 1 and content is not null").select("ino", F.lit(1).alias("seq"), F.lit(100).alias("off"), F.lit("REWRITTEN").alias("data"))
    return mutate.written(content, writes).select("ino", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query(f"with {_DIR}, u as (select child, count(*) n from dirent where type = 'f' and child % 6 = 1 group by 1), i as (select child ino, 1 nlink from dirent where type = 'f') select ino, cast(greatest(nlink - coalesce(n, 0), 0) as bigint) nlink, nlink - coalesce(n, 0) <= 0 freed from i left join u on ino = child")
def unlink_counts(spark, sf):
    names = model.dirents(spark, sf).where("type = 'f'")
    gone = mutate.unlinked(names, names.where("child % 6 = 1").select("parent", "name"))
    return mutate.link_counts(names.select(F.col("child").alias("ino"), F.lit(1).alias("nlink")), gone)


@query(f"with {_EXT}, s as (select ino container, off + case when ino % 23 = 4 and idx = 2 then 1 else 0 end off, len from ext), z as (select ino container, sum(len) + case when ino % 29 = 6 then 1 else 0 end size from ext group by ino), c as (select *, coalesce(sum(len) over (partition by container order by off, len rows between unbounded preceding and 1 preceding), 0) want from s), f as (select container, bool_or(off <> want) gap, sum(len) total from c group by container) select container, case when gap then 'gap' when total <> size then 'size' else 'ok' end verdict from z join f using (container)")
def container_map_check(spark, sf):
    ext = _extents(spark, sf).withColumnRenamed("ino", "container")
    shifted = F.when((F.col("container") % 23 == 4) & (F.col("idx") == 2), F.col("off") + 1).otherwise(F.col("off"))
    size = ext.groupBy("container").agg(F.sum("len").alias("_s")).select("container", (F.col("_s") + F.when(F.col("container") % 29 == 6, 1).otherwise(0)).alias("size"))
    return mutate.map_faults(ext.select("container", shifted.alias("off"), "len"), size)


@query(f"with m as (select doc_id member, text body, doc_id // 5 container, length(text) len from documents where length(text) > 0), s as (select *, sum(len) over (partition by container order by member) - len off from m), p as (select container, member, substring(body, cast(greatest(off, {RANGE[0]}) - off + 1 as bigint), cast(least(off + len, {RANGE[1]}) - greatest(off, {RANGE[0]}) as bigint)) piece from s where off < {RANGE[1]} and off + len > {RANGE[0]}) select container, sha256(string_agg(piece, '' order by member)) content from p group by container")
def container_map_read(spark, sf):
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").alias("member"), F.col("text").alias("body"), F.expr("doc_id div 5").alias("container"), F.length("text").cast("long").alias("len"))
    end = F.sum("len").over(Window.partitionBy("container").orderBy("member").rowsBetween(Window.unboundedPreceding, 0))
    spans = docs.select("container", "member", "len", (end - F.col("len")).alias("off"), F.lit(0).alias("at"))
    return mutate.map_read(spans, docs.select("member", "body"), *RANGE).select("container", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query("select a.doc_id ino, sha256(substring(b.text, 11, 200)) content from documents a join documents b on b.doc_id = a.doc_id // 2 where a.doc_id % 2 = 0 and b.text is not null")
def window_entries(spark, sf):
    content = model.files(table(spark, sf, "documents")).select("ino", "content").where("content is not null")
    entries = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("ino"), F.expr("doc_id div 2").alias("src"), F.lit(10).alias("at"), F.lit(200).alias("len"))
    return mutate.windows(entries, content).select("ino", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


# --- the log as a stream ------------------------------------------------------------------------------------------
@query(f"with {_LOG}, {_LATEST.format(log='log')} select k, seq, op from latest")
def stream_ingest(spark, sf):
    import uuid

    from quarry.streaming import log

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    folder = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    _log(spark, sf).repartition(4).write.parquet(f"{folder}/in")
    schema = "k long, seq long, op string, v double"
    for _ in range(2):  # the second time nothing is new
        log.ingest(log.read_log(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/checkpoint")
    return log.snapshot(spark, f"{folder}/out").select("k", "seq", "op")


@query(f"with {_LOG} select count(*) records, count(*) filter (where op = 'D') deletes from log")
def hot_counters(spark, sf):
    from quarry.streaming import log

    return log.counters(_log(spark, sf)).select("records", "deletes")


def _more() -> None:
    """Modules that add their own queries here."""
    from quarry.plans import formats, policies  # noqa: F401


def queries() -> dict[str, Query]:
    _more()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(_SQL)
