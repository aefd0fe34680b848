"""Content cut on a fixed grid: deduplication, unique space, whole and ranged reads.

Segments are compared by their SHA-256. Groups are never gathered: the canonical copy of a hash is a minimum, found
with partial aggregation, and joined back (a join Spark can split where a hash is hot)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import GRID


def cut(content: DataFrame, grid: int = GRID) -> DataFrame:
    """content(ino, content) -> (ino, lba, chunk, len, hash), in one pass over each text."""
    pieces = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{grid}}}"), F.lit(0))
    rows = content.select("ino", F.posexplode(pieces).alias("lba", "chunk"))
    return rows.select("ino", F.col("lba").cast("long").alias("lba"), "chunk", F.length("chunk").cast("long").alias("len"), F.unhex(F.sha2(F.col("chunk").cast("binary"), 256)).alias("hash"))


def canonical(segments: DataFrame) -> DataFrame:
    """One row a hash: its first copy by (ino, lba), its length and how many copies there are."""
    found = segments.groupBy("hash").agg(F.min(F.struct("ino", "lba")).alias("first"), F.min("len").alias("len"), F.count("*").alias("copies"))
    return found.select("hash", F.col("first.ino").alias("to_ino"), F.col("first.lba").alias("to_lba"), "len", "copies")


def located(segments: DataFrame) -> DataFrame:
    """Each segment with its canonical copy."""
    return segments.select("ino", "lba", "len", "hash").join(canonical(segments).select("hash", "to_ino", "to_lba", "copies"), "hash")


def dedupe_stats(segments: DataFrame) -> DataFrame:
    """Two sums in a row, no join: copies of a hash within each file, then over the files; the canonical copy lies in the
    least file."""
    own = segments.groupBy("hash", "ino").agg(F.count("*").alias("n"), F.min("len").alias("len"))
    every = own.groupBy("hash").agg(F.min(F.struct("ino", "n"))["n"].alias("first"), F.sum("n").alias("copies"), F.min("len").alias("len"))
    return every.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("segments"),
        F.coalesce(F.sum(F.col("len") * F.col("copies")), F.lit(0)).alias("logical"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("physical"),
        F.coalesce(F.sum(F.col("copies") - F.col("first")), F.lit(0)).alias("cross_merged"),
        F.coalesce(F.sum(F.col("first") - 1), F.lit(0)).alias("intra_merged"),
    )


def remap(segments: DataFrame) -> DataFrame:
    """Losers and the copies that stand for them."""
    return located(segments).where("ino <> to_ino or lba <> to_lba").select("ino", "lba", "to_ino", "to_lba")


def remap_by_file(segments: DataFrame) -> DataFrame:
    """Merges of each file, so that it is rewritten once."""
    return remap(segments).groupBy("ino").agg(F.count("*").alias("merges"), F.count_distinct("to_ino").alias("owners"))


def top_files(segments: DataFrame, n: int) -> DataFrame:
    """Files with the most duplicate characters."""
    found = located(segments).where("ino <> to_ino or lba <> to_lba").groupBy("ino").agg(F.sum("len").alias("dup_chars"))
    return found.orderBy(F.desc("dup_chars"), "ino").limit(n)


def unique_space(segments: DataFrame) -> DataFrame:
    sizes = canonical(segments).agg(F.coalesce(F.sum("len"), F.lit(0)).alias("unique_chars"), F.coalesce(F.sum(F.col("len") * F.col("copies")), F.lit(0)).alias("logical_chars"), F.count("*").alias("unique_chunks"))
    return sizes.select("unique_chunks", "unique_chars", (F.col("logical_chars") - F.col("unique_chars")).alias("dup_chars"), F.round(F.col("logical_chars") / F.greatest("unique_chars", F.lit(1)), 6).alias("ratio"))


def unique_space_approx(segments: DataFrame, error: float = 0.02) -> DataFrame:
    """The same by a sketch of fixed size."""
    return segments.agg(F.approx_count_distinct("hash", error).alias("unique_chunks"), F.count("*").alias("chunks"))


def refcounts(segments: DataFrame) -> DataFrame:
    """References of shared canonical segments."""
    return canonical(segments).where("copies > 1").select("to_ino", "to_lba", "copies")


def reassembled(segments: DataFrame) -> DataFrame:
    """Files put together again from canonical copies: (ino, sha256, chars). A file's own chunks are gathered, no more."""
    chunks = segments.groupBy("hash").agg(F.min("chunk").alias("stored"))
    own = segments.select("ino", "lba", "hash").join(chunks, "hash").groupBy("ino").agg(F.array_sort(F.collect_list(F.struct("lba", "stored"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["stored"]), "")
    return own.select("ino", F.sha2(whole.cast("binary"), 256).alias("sha256"), F.length(whole).cast("long").alias("chars"))


def verified(content: DataFrame, grid: int = GRID) -> DataFrame:
    """Each file read back and compared: (ino, chars, ok)."""
    read = reassembled(cut(content, grid)).withColumnRenamed("ino", "_ino")
    rows = content.where(F.length("content") > 0).select("ino", F.sha2(F.col("content").cast("binary"), 256).alias("want"))
    return rows.join(read, F.col("ino") == F.col("_ino"), "left").select("ino", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce(F.col("want") == F.col("sha256"), F.lit(False)).alias("ok"))


def range_read(extents: DataFrame, start: int, stop: int) -> DataFrame:
    """Extents that overlap [start, stop), each clipped to it."""
    hit = extents.where((F.col("off") < stop) & (F.col("off") + F.col("len") > start))
    low, high = F.greatest("off", F.lit(start)), F.least(F.col("off") + F.col("len"), F.lit(stop))
    return hit.select("ino", "idx", low.alias("from_off"), (high - low).alias("take"), (low - F.col("off")).alias("skip"))


def put(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Content-addressed put: rows of new(blob) whose address is not there yet, once each."""
    addressed = new.select(F.sha2(F.col("blob").cast("binary"), 256).alias("addr"), "blob")
    return addressed.join(existing.select("addr"), "addr", "left_anti").dropDuplicates(["addr"])


def load(store: DataFrame, addresses: DataFrame) -> DataFrame:
    """Content-addressed get; a blob that does not hash to its address fails the read."""
    found = addresses.join(store, "addr")
    good = F.sha2(F.col("blob").cast("binary"), 256) == F.col("addr")
    return found.withColumn("blob", F.when(good, F.col("blob")).otherwise(F.raise_error(F.concat(F.lit("damaged "), F.col("addr")))))


def children(entries: DataFrame, recipes: DataFrame) -> DataFrame:
    """Entries whose child address points at another recipe's entries, replaced by those (one level)."""
    leaves = entries.where("child_addr is null").select("ino", "idx", "off", "len")
    inner = entries.where("child_addr is not null").select("ino", F.col("idx").alias("_outer"), F.col("child_addr").alias("addr")).join(recipes, "addr")
    return leaves.unionByName(inner.select("ino", (F.col("_outer") * 100_000 + F.col("idx")).alias("idx"), "off", "len"))


def slices(entries: DataFrame, batches: DataFrame) -> DataFrame:
    """Files as slices of shared batches: entries(ino, batch, at, len) of batches(batch, body)."""
    return entries.join(batches, "batch").select("ino", F.substring(F.col("body"), F.col("at") + 1, F.col("len")).alias("content"))
