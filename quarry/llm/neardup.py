"""Near-duplicate classes by ProbMinHash.

Each text is a set of five-word shingles. Every shingle runs a Poisson process whose rate is its weight: arrivals come
at exponential gaps, each hits one register, and a register keeps the shingle that arrives first. A shingle stops as
soon as its next arrival is later than every register's (early termination). Two texts agree in a register with the
probability Jaccard of their weighted sets. All weights are 1, however often a shingle stands in a text: then that is
the Jaccard of the sets, by which links are defined, and a passage repeated more often in one text loses no candidate.
Bands of registers propose pairs, and exact shingle sets decide: a link is a Jaccard of SIMILARITY or more.

Copies (same words in the same order) are first folded into their least row. In each band bucket every member is
verified against the least one, so a group of any size gives as many pairs as it has members. Then every bucket that
still holds members of different components is compared whole: each pair of its members that are not yet connected is
decided by their exact shingle sets, whatever other links they have. Large buckets are cut into blocks, and each pair
of blocks is a task's group. So every pair that shares a bucket is verified or connected already. Classes are
connected components, found by label passing with pointer jumping; links, labels and registers stay in tables.

With BANDS x ROWS = 32 x 4 registers a pair of similarity 0.8 shares no bucket with probability 5e-8.

Defined cases: null or empty texts, and texts without a word, are copies of each other; texts of one to four words
have one shingle, all their words; a null doc_id counts as the smallest; rows are known by doc_id and text, so of
several texts under one doc_id (or under none) each has the class of its own; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import bounded_batches, drop_written, id_back, node_key, text_of, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Members, and shingles of them, that a block of a bucket holds on average; pairs of blocks are compared at a time.
MEMBERS, BLOCK_SHINGLES = 2_000, 1_000_000
_ARRIVALS = 8192
#: Bits of the map that marks texts whose sets are wanted: 8 MB.
MARK_BITS = 1 << 26


def shingles(words: scan.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle of a block, in document order; repeats stay."""
    n = np.diff(words.first)
    grams = words.grams(SHINGLE)
    at = np.arange(len(grams))
    at = at[words.doc[at] == words.doc[at + SHINGLE - 1]] if len(at) else at
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if not len(short):
        return words.doc[at], grams[at]
    whole = scan.hash_spans(words.hash, words.first[short], words.first[short + 1], 99)
    doc, found = np.append(words.doc[at], short), np.append(grams[at], whole)
    order = np.argsort(doc, kind="stable")
    return doc[order], found[order]


def distinct(doc: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash)."""
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], found[new]


def registers(n_docs: int, doc: np.ndarray, found: np.ndarray, weight: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """The sketch of each document: for each register the low 32 bits of the shingle that arrives first there."""
    first = np.full(n_docs * k, np.inf)
    held = np.zeros(n_docs * k, np.uint32)
    time, alive, turn = np.zeros(len(doc)), np.arange(len(doc)), 0
    while len(alive):
        steps = max(1, min(64, _ARRIVALS // len(alive)))
        turns = (np.arange(turn, turn + steps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        random = scan.mix(found[alive][:, None] + turns, 11)
        gaps = -np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[alive][:, None]
        at = time[alive][:, None] + np.cumsum(gaps, 1)
        slot = (doc[alive] * k)[:, None] + (scan.mix(random, 12) % np.uint64(k)).astype(np.int64)
        time[alive] = at[:, -1]
        turn += steps
        at, slot, owner = at.ravel(), slot.ravel(), np.repeat(alive, steps)
        sooner = at < first[slot]
        at, slot, owner = at[sooner], slot[sooner], owner[sooner]
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        held[slot[won]] = found[owner[won]].astype(np.uint32)
        alive = alive[time[alive] < first.reshape(n_docs, k).max(1)[doc[alive]]]
    return held.reshape(n_docs, k)


def bands(sketch: np.ndarray) -> np.ndarray:
    """BANDS bucket keys a document."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        key = scan.mix(key ^ parts[:, :, r], r)
    return scan.mix(key + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F), 5)


NODE = "struct<doc:bigint,raw:bigint>"


def word_digests(data: np.ndarray, words: scan.Words, to: np.ndarray) -> list[bytes]:
    """Of each document 128 bits of its words in their order: equal words, and in all likelihood only they, have the
    same, whatever stands between them."""
    mapped = np.append(to[data], np.uint8(0))
    sizes = words.ends - words.starts + 1
    stops = np.cumsum(sizes)
    # each word with the byte behind it, which then is made 0
    joined = mapped[np.repeat(words.starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
    joined[stops - 1] = 0
    raw, edges = joined.tobytes(), np.append(0, stops)[words.first].tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edges, edges[1:], strict=False)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, (offsets, data) = batch.column("node"), scan.utf8(batch.column("text"))
        for i, j in scan.blocks(offsets):
            own = data[offsets[i] : offsets[j]]
            words = scan.Words(own, offsets[i : j + 1] - offsets[i], scan.PLAIN)
            doc, found = distinct(*shingles(words))
            held = registers(j - i, doc, found, np.ones(len(doc)))
            keys = bands(held).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([nodes.slice(i, j - i), pa.array(word_digests(own, words, scan.PLAIN), pa.binary()), lists], ["node", "copy", "bands"])


def _sets(marked):
    """The shingle sets of texts whose bit is marked."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value
        for batch in batches:
            place = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1))
            nodes, (offsets, data) = batch.column("node"), scan.utf8(batch.column("text"))
            for i, j in scan.blocks(offsets):
                words = scan.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], scan.PLAIN)
                doc, found = distinct(*shingles(words))
                edges = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([nodes.slice(i, j - i), lists], ["node", "shingles"])

    return sets


def cross_links(component: np.ndarray, block: np.ndarray, sizes: np.ndarray, found: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """Links that join components of a group, by exact overlaps of their members' sets (found, in member order). If
    across, only members of different blocks are compared. A pair that a link just found connects needs no other."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((owner, found))
    found, owner = found[order], owner[order]
    twin = np.append(False, (found[1:] == found[:-1]) & (owner[1:] == owner[:-1])) if n else np.zeros(0, bool)
    found, owner = found[~twin], owner[~twin]
    sizes = np.bincount(owner, minlength=n)
    start = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
    stop = np.append(start[1:], len(found))
    term = np.repeat(np.arange(len(start)), stop - start)
    by_owner = np.argsort(owner, kind="stable")
    terms, edges = term[by_owner], np.append(0, np.cumsum(sizes))
    component = np.unique(component, return_inverse=True)[1]
    # each pair of components has an end outside the largest one
    largest = np.bincount(component).argmax()
    out = []
    for i in np.flatnonzero(component != largest):
        own = terms[edges[i] : edges[i + 1]]
        length = stop[own] - start[own]
        at = np.repeat(start[own] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        both = np.bincount(owner[at], minlength=n)
        near = (both > 0) & (both >= SIMILARITY * (sizes + sizes[i] - both)) & (component != component[i])
        if across:
            near &= block != block[i]
        for j in np.flatnonzero(near):
            if component[j] != component[i]:
                out.append((int(i), int(j)))
                component[component == component[j]] = component[i]
    return out


def _cross(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    whole = lambda c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c)
    nodes, lists, component = whole("node"), whole("shingles"), whole("component")
    both = np.stack([component.field(0).to_numpy(), component.field(1).to_numpy()], 1)
    component = np.unique(both, axis=0, return_inverse=True)[1].ravel()
    across = table.column("one")[0].as_py() != table.column("two")[0].as_py()
    sizes = np.diff(lists.offsets.to_numpy())
    found = cross_links(component, table.column("block").to_numpy(), sizes, lists.flatten().to_numpy(), across)
    ends = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
    return pa.table({"a": nodes.take(ends[0]), "b": nodes.take(ends[1])})


def _place() -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(MARK_BITS))


def _shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, written. A bitmap of fixed size marks them, so that texts need not move; where
    it marks others, too, they have sets that no one asks for."""
    word = F.expr("cast(place div 64 as int)").alias("word")
    words = wanted.select(_place().alias("place")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(MARK_BITS >> 6, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    marked = texts.sparkSession.sparkContext.broadcast(bits)
    sets = texts.withColumn("place", _place()).mapInArrow(_sets(marked), f"node {NODE}, shingles array<long>")
    return written(sets.dropDuplicates(["node"]), "shingle-sets")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose shingle sets have a Jaccard of SIMILARITY or more."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _shingle_sets(texts, wanted)
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("all"))
    return joined.where(F.col("both") >= F.lit(SIMILARITY) * (F.col("all") - F.col("both"))).select("a", "b")


def _unconnected(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of one bucket that labels leaves in different components."""
    known = members.join(labels.select("node", "label"), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("component"))
    # near copies share many buckets with the same members: one of those is enough
    names = (F.bit_xor(F.xxhash64("node")).alias("name"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("other_name"), F.count("*").alias("members"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), *names).where("low <> high")
    mixed = mixed.groupBy("name", "other_name", "members").agg(F.min("bucket").alias("bucket")).select("bucket")
    asked = written(known.join(mixed, "bucket"), "mixed-buckets")
    sets = _shingle_sets(texts, asked.select("node").distinct())
    sized = asked.join(sets.select("node", F.size("shingles").alias("n")), "node")
    blocks = sized.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = asked.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member meets its own block and, with it, each of the others
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "component", "block")
    return dealt.join(sets, "node").groupBy("bucket", "one", "two").applyInArrow(_cross, f"a {NODE}, b {NODE}").distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, links): each row's node and the least node with the same words; verified pairs of least nodes, enough
    to connect all that belong together. A node is a doc_id and the hash of a text."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(node_key().alias("node"), text_of().alias("text"))
    sketches = written(texts.mapInArrow(_sketch, f"node {NODE}, copy binary, bands array<long>"), "sketches")
    # written, so that Spark can split the join below where one text has very many copies
    least = written(sketches.groupBy("copy").agg(F.min("node").alias("node")), "least-copies")
    copies = sketches.select("node", "copy").join(least.withColumnRenamed("node", "least"), "copy").select("node", "least")
    heads = sketches.join(least, ["copy", "node"], "left_semi").dropDuplicates(["node"])
    cells = heads.select("node", F.explode("bands").alias("bucket"))
    buckets = cells.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("members")).where("members > 1")
    members = written(cells.join(buckets, "bucket"), "buckets")
    pairs = members.where("node > lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    found = written(_verified(pairs, texts), "links")
    return copies, found.union(written(_unconnected(members, components(found), texts), "more-links"))


def components(found: DataFrame) -> DataFrame:
    """(node, label): each node that has a link, and the least node it is connected to."""
    edges = written(found.select(F.col("a").alias("u"), F.col("b").alias("v")).union(found.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    held = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        labels = held.select("node", "label")
        near = edges.join(labels, edges.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        passed = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(passed.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        drop_written(held)
        held = after
        if not after.where("old <> label").limit(1).count():
            drop_written(edges)
            return held.select("node", "label")


def decided(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (node, class, kept): class is the least node of the class, and kept marks it."""
    copies, found = links(docs)
    labels = components(found)
    out = copies.join(labels.withColumnRenamed("node", "least"), "least", "left").select("node", F.coalesce("label", "least").alias("class"))
    return out.withColumn("kept", F.col("node") == F.col("class"))


def classes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, class_id, kept): class_id is the least doc_id of the class; kept marks the one
    document of each class that stays."""
    return decided(docs).select(id_back("node.doc").alias("doc_id"), id_back("class.doc").alias("class_id"), "kept")


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """The definition read literally, for tests: doc_id -> class_id."""
    import re

    sets = {}
    for d, t in docs:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        sets[d] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else {()}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)) and (n := len(x & y)) >= SIMILARITY * (len(x) + len(y) - n):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: top(d) for d in ids}
