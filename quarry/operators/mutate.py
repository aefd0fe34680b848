"""Mutations: change records for namespace operations, write sessions over content, reads through container maps.

Nothing is changed in place: namespace operations give rows for the change log (see overlay.fold), writes give new
content of the touched files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAME_PUT, NAME_DELETE = "P", "D"


def created(parent: int, names: DataFrame) -> DataFrame:
    """names(name, child) as log rows (parent, name, op, child) of new entries in a directory."""
    return names.select(F.lit(parent).cast("long").alias("parent"), "name", F.lit(NAME_PUT).alias("op"), "child")


def unlinked(dirents: DataFrame, doomed: DataFrame) -> DataFrame:
    """Log rows that drop the names in doomed(parent, name); names that are not there give none."""
    return dirents.join(doomed, ["parent", "name"], "left_semi").select("parent", "name", F.lit(NAME_DELETE).alias("op"), "child")


def renamed(dirents: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(parent, name, to_parent, to_name): a delete of the old name and a put of the new one, which replaces what
    stands there."""
    found = dirents.join(moves, ["parent", "name"])
    gone = found.select("parent", "name", F.lit(NAME_DELETE).alias("op"), "child")
    return gone.unionByName(found.select(F.col("to_parent").alias("parent"), F.col("to_name").alias("name"), F.lit(NAME_PUT).alias("op"), "child"))


def link_counts(inodes: DataFrame, changes: DataFrame) -> DataFrame:
    """inodes(ino, nlink) after name changes: (ino, nlink, freed), freed where the last name went."""
    step = changes.groupBy(F.col("child").alias("ino")).agg(F.sum(F.when(F.col("op") == NAME_PUT, 1).otherwise(-1)).alias("_step"))
    now = F.greatest(F.col("nlink") + F.coalesce("_step", F.lit(0)), F.lit(0))
    return inodes.join(step, "ino", "left").select("ino", now.cast("long").alias("nlink"), (now == 0).alias("freed"))


def written(content: DataFrame, writes: DataFrame) -> DataFrame:
    """content(ino, content) after a session of writes(ino, seq, off, data), in order of seq: a write beyond the end
    fills the gap with NULs. Only touched files come back. A session's own writes to one file are gathered, no more."""
    own = writes.groupBy("ino").agg(F.array_sort(F.collect_list(F.struct("seq", "off", "data"))).alias("_writes"))

    def put(text, w):
        long_enough = F.when(F.length(text) < w["off"], F.rpad(text, w["off"], "\0")).otherwise(text)
        return F.overlay(long_enough, w["data"], w["off"] + 1, F.length(w["data"]))

    return content.join(own, "ino").select("ino", F.aggregate("_writes", F.coalesce("content", F.lit("")), put).alias("content"))


def truncated(content: DataFrame, sizes: DataFrame) -> DataFrame:
    """content(ino, content) cut to, or filled with NULs up to, sizes(ino, size)."""
    return content.join(sizes, "ino").select("ino", F.rpad(F.coalesce("content", F.lit("")), F.col("size"), "\0").alias("content"))


def touched_segments(writes: DataFrame, grid: int) -> DataFrame:
    """The grid cells (ino, lba) that a session rewrites; the others are shared with the content before."""
    last = F.greatest(F.col("off") + F.length("data") - 1, F.col("off"))
    cells = F.explode(F.sequence(F.expr(f"cast(off div {grid} as bigint)"), (last / grid).cast("long")))
    return writes.where(F.length("data") > 0).select("ino", cells.alias("lba")).distinct()


def map_faults(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """spans(container, off, len) must tile sizes(container, size) exactly: (container, verdict), ok, gap (a span that
    does not start where the one before ended) or size."""
    order = Window.partitionBy("container").orderBy("off", "len").rowsBetween(Window.unboundedPreceding, -1)
    checked = spans.withColumn("_want", F.coalesce(F.sum("len").over(order), F.lit(0)))
    found = checked.groupBy("container").agg(F.bool_or(F.col("off") != F.col("_want")).alias("_gap"), F.sum("len").alias("_sum"))
    rows = sizes.join(found, "container", "left")
    return rows.select("container", F.when(F.col("_gap"), "gap").when(F.coalesce("_sum", F.lit(0)) != F.col("size"), "size").otherwise("ok").alias("verdict"))


def map_read(spans: DataFrame, members: DataFrame, start: int, stop: int) -> DataFrame:
    """Bytes [start, stop) of each container served from its members: spans(container, off, len, member, at) over
    members(member, body). A container's own spans within the range are gathered, no more."""
    hit = spans.where((F.col("off") < stop) & (F.col("off") + F.col("len") > start)).join(members, "member")
    low, high = F.greatest("off", F.lit(start)), F.least(F.col("off") + F.col("len"), F.lit(stop))
    piece = F.substring("body", (F.col("at") + low - F.col("off") + 1).cast("int"), (high - low).cast("int"))
    parts = hit.select("container", low.alias("from"), piece.alias("piece")).groupBy("container").agg(F.array_sort(F.collect_list(F.struct("from", "piece"))).alias("parts"))
    return parts.select("container", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("content"))


def windows(entries: DataFrame, content: DataFrame) -> DataFrame:
    """Entries that are views of another file's range: entries(ino, src, at, len) over content(ino, content)."""
    source = content.select(F.col("ino").alias("src"), F.col("content").alias("_whole"))
    return entries.join(source, "src").select("ino", F.substring("_whole", F.col("at") + 1, F.col("len")).alias("content"))
