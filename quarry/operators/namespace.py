"""The hierarchical namespace: rows (parent, name, child, type, size), walked level by level.

Each level is one join of the frontier with the names, so a directory of any size is spread over tasks, and the depth
of the tree, not its width, sets how many joins there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scratch import written


#: More levels than any path has components; a walk that goes deeper is in a loop.
DEEPEST = 2048


def walk(dirents: DataFrame, root: int, depth: int = DEEPEST) -> DataFrame:
    """All entries below a root: path, depth, ino, parent, type, size, ancestors (ids from the root down). The walk goes on
    until a level is empty; each level is written, so it is worked out once. A tree deeper than depth is refused."""
    level = dirents.where(F.col("parent") == root).select(F.concat(F.lit("/"), F.col("name")).alias("path"), F.lit(1).alias("depth"), F.col("child").alias("ino"), "parent", "type", "size", F.array(F.lit(root).cast("long")).alias("ancestors"))
    names = dirents.select(F.col("parent").alias("_parent"), F.col("name").alias("_name"), F.col("child").alias("_child"), F.col("type").alias("_type"), F.col("size").alias("_size"))
    out = level = written(level, "walk")
    done = 1
    while not level.where("type = 'd'").isEmpty():
        below = level.where("type = 'd'").join(names, F.col("ino") == F.col("_parent")).select(
            F.concat("path", F.lit("/"), "_name").alias("path"), (F.col("depth") + 1).alias("depth"), F.col("_child").alias("ino"), F.col("_parent").alias("parent"), F.col("_type").alias("type"), F.col("_size").alias("size"), F.array_append("ancestors", F.col("_parent")).alias("ancestors")
        )
        if done >= depth:
            if not below.isEmpty():
                raise ValueError(f"the tree is deeper than {depth} levels")
            break
        level, done = written(below, "walk"), done + 1
        out = out.unionByName(level)
    return out


def walk_strict(dirents: DataFrame, inodes: DataFrame, root: int, depth: int = DEEPEST) -> DataFrame:
    """The walk, which fails if a name has no row in inodes(ino)."""
    found = walk(dirents, root, depth).join(inodes.select(F.col("ino"), F.lit(True).alias("_there")), "ino", "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col("path")))).otherwise(F.col("path"))
    return found.withColumn("path", checked).drop("_there")


def listing(dirents: DataFrame, directory: int, limit: int) -> DataFrame:
    """One directory in name order, at most limit names."""
    return dirents.where(F.col("parent") == directory).select("name", F.col("child").alias("ino"), "type", "size").orderBy("name", "ino").limit(limit)


def usage(walked: DataFrame) -> DataFrame:
    """Files and bytes below each directory."""
    up = walked.where("type = 'f'").select(F.explode("ancestors").alias("ino"), "size")
    return up.groupBy("ino").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def normal_path(path: Column) -> Column:
    """Without empty and '.' components, '..' climbing one (never above the root)."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p != "..", F.array_append(done, p)).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def split_path(path: Column) -> Column:
    """(parent, leaf), slashes at either end and before the leaf passed over; null without a leaf."""
    bare = F.regexp_replace(path, "^/+|/+$", "")
    parent = F.regexp_replace(F.regexp_extract(bare, "^(.*)/[^/]*$", 1), "/+$", "")
    return F.when(bare != "", F.struct(parent.alias("parent"), F.regexp_extract(bare, "([^/]+)$", 1).alias("leaf")))


def lookup(dirents: DataFrame, paths: DataFrame, root: int, depth: int) -> DataFrame:
    """paths(path, ...) resolved component by component: path, ino (null where a component is missing), the rest."""
    parts = paths.withColumn("_parts", F.filter(F.split(normal_path(F.col("path")), "/"), lambda p: p != "")).withColumn("_ino", F.lit(root).cast("long"))
    names = dirents.select(F.col("parent").alias("_ino"), F.col("name").alias("_name"), F.col("child").alias("_child"))
    for i in range(depth):
        step = parts.withColumn("_name", F.get("_parts", F.lit(i))).join(names, ["_ino", "_name"], "left")
        parts = step.select(*paths.columns, "_parts", F.when(F.size("_parts") <= i, F.col("_ino")).otherwise(F.col("_child")).alias("_ino"))
    return parts.select("path", F.when(F.size("_parts") <= depth, F.col("_ino")).alias("ino"), *[c for c in paths.columns if c != "path"])


def resolve(dirents: DataFrame, links: DataFrame, paths: DataFrame, root: int, depth: int, hops: int = 3) -> DataFrame:
    """lookup() that follows links(ino, target) at the end of a path, up to a number of hops."""
    found = paths.select(F.col("path").alias("asked"), "path")
    targets = links.select("ino", F.col("target").alias("_target"))
    for _ in range(hops):
        found = lookup(dirents, found, root, depth).join(targets, "ino", "left").select("asked", F.coalesce("_target", "path").alias("path"))
    return lookup(dirents, found, root, depth).select(F.col("asked").alias("path"), "ino")


def reverse(dirents: DataFrame, inos: DataFrame, root: int, depth: int) -> DataFrame:
    """inos(ino) -> (ino, path): climbs parents by the least name of each; null where the root is not reached."""
    first = dirents.groupBy(F.col("child").alias("_child")).agg(F.min(F.struct("name", "parent")).alias("_up"))
    now = inos.select("ino", F.col("ino").alias("_at"), F.lit("").alias("path"))
    for _ in range(depth):
        now = now.join(first, F.col("_at") == F.col("_child"), "left").select("ino", F.when(F.col("_at") == root, F.col("_at")).otherwise(F.col("_up.parent")).alias("_at"), F.when(F.col("_at") == root, F.col("path")).otherwise(F.concat(F.lit("/"), F.col("_up.name"), F.col("path"))).alias("path"))
    return now.select("ino", F.when(F.col("_at") == root, F.col("path")).alias("path"))


def first_names(walked: DataFrame) -> DataFrame:
    """One name an id, the first in walk order (path order)."""
    return walked.groupBy("ino").agg(F.min("path").alias("path"))


def removable(dirents: DataFrame) -> DataFrame:
    """Directories without entries: what rmdir may remove."""
    return dirents.where("type = 'd'").join(dirents.select(F.col("parent").alias("child")).distinct(), "child", "left_anti").select(F.col("child").alias("ino"), "name")


def siblings(dirents: DataFrame, tags: list[str]) -> DataFrame:
    """Internal sibling rows name!tag whose container name stands in the same directory."""
    cut = dirents.withColumn("_of", F.regexp_extract("name", f"^(.+)!(?:{'|'.join(tags)})$", 1)).where("_of <> ''")
    owners = dirents.select(F.col("parent"), F.col("name").alias("_of"), F.col("child").alias("owner"))
    return cut.join(owners, ["parent", "_of"]).select("parent", "name", "child", "owner")


def recursive_sql(spark: SparkSession, dirents: DataFrame, root: int) -> DataFrame:
    """The walk as a recursive query, for trees of unknown depth; the session's recursion limits hold."""
    return spark.sql(
        "with recursive w(path, depth, ino) as (select '' , 0, cast({root} as long) union all select concat(w.path, '/', d.name), w.depth + 1, d.child from w join {d} d on d.parent = w.ino) select path, depth, ino from w where depth > 0",
        root=root,
        d=dirents,
    )
