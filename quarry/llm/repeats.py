"""Substring dedup by prefix-partitioned suffix trees.

A suffix is the rest of a document from some word on. Suffixes that can lie below a deep internal node are dealt to
groups by a prefix, each group fits a task's memory, and its subtree is read off its sorted suffixes: neighbours' longest
common prefixes delimit the internal nodes, and where two leaves of a node at least WINDOW words deep also agree in the
words before them, all but the first lie in a repeat. Words are told apart by their bytes throughout.

Only suffixes at anchors are kept (a sparse suffix tree). A window's anchor is the least hash among its PREFIX-grams, so
equal windows have their anchor at the same place; an anchor stands for the run of windows that share it, and its
suffix carries the words that these windows span, on either side. A node of windows that begin s words before the
anchor is a node WINDOW - s deep of the suffixes, divided by the s words to the left.

1. Every anchor's PREFIX-gram is hashed and dealt to buckets; those met only once in the corpus begin no repeat.
2. The other anchors go, with their words, to the group their prefix names. How long the prefix is depends on how many
   suffixes have it: PREFIX words as a rule; where more than a group's share have the same, first leaves of each node
   are found within salted parts, and what is left goes by its whole WINDOW words.
Leaves of one node within a block of a map task are settled before the shuffle, so a passage that a third of all rows
hold leaves a task once a block, however often it stands there.

Defined cases: null or empty text has no words and none removed; a null doc_id counts as the smallest; of texts under one
doc_id (or none) the one with the lesser hash counts as earlier; rows with the same doc_id and text are one document
and get the same result; documents shorter than WINDOW words keep all; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import bounded_batches, id_back, id_key, text_of, written

WINDOW = 20
PREFIX = 6
#: PREFIX-grams in a window; an anchor lies at most SLIDE - 1 words behind a window's start.
SLIDE = WINDOW - PREFIX + 1

#: Text whose anchors a bucket of the first step holds, and suffixes that a group of the second step holds, on average.
BUCKET_BYTES = 32 << 20
GROUP_SUFFIXES = 50_000
_PLACE = np.uint64((1 << 30) - 1)


class Anchors:
    """The anchors of a block in text order: word, document, hash of the PREFIX-gram, and the windows that share it (start
    of the first, and how many)."""

    def __init__(self, words: scan.Words):
        n = len(words.hash)
        start = np.arange(max(0, n - WINDOW + 1))
        start = start[words.doc[start] == words.doc[start + WINDOW - 1]]
        grams = words.grams(PREFIX)
        # the place in the low bits makes the leftmost of equal grams the least
        least = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
        width = 1
        while 2 * width <= SLIDE and len(start):
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        rest = SLIDE - width
        if rest and len(start):
            least = np.minimum(least[: len(least) - rest], least[rest:])
        anchor = start + ((least[start] - start.astype(np.uint64)) & _PLACE).astype(np.int64)
        runs = scan.spans_to_runs(start, anchor, words.doc[start])
        self.first, self.count = start[runs], np.diff(np.append(runs, len(start)))
        self.at = anchor[runs]
        self.doc, self.key = words.doc[self.at], grams[self.at] if len(start) else np.zeros(0, np.uint64)
        #: The place among the anchors of its document.
        self.nth = np.arange(len(runs)) - np.searchsorted(self.doc, self.doc)


def tree(ids: np.ndarray, at: np.ndarray, back: np.ndarray, count: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are not the first of their kind, as (suffix, words before the anchor, whether the first one is another
    place and not the same place given twice). Suffix i begins at ids[at[i]]; its windows
    begin back[i], back[i] - 1 ... (count[i] of them) words before that. Suffixes come in the order of document and
    place, and row numbers that order, so equal rows are one place."""
    low = back - count + 1
    n = len(at)
    right = np.stack([np.where(k < WINDOW - low, ids[np.minimum(at + k, len(ids) - 1)], -1) for k in range(WINDOW)])
    left = np.stack([np.where(k <= back, ids[np.maximum(at - k, 0)], -1) for k in range(1, SLIDE)])

    def sorted_depths(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the sequences, and how far each agrees with the one before it."""
        order = np.lexsort(words[::-1])
        equal = words[:, order[1:]] == words[:, order[:-1]]
        return order, np.append(-1, np.logical_and.accumulate(equal, 0).sum(0))

    def nodes(order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(depth < least)
        return out

    by_right, by_left = sorted_depths(right), sorted_depths(left)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for s in range(SLIDE):
        own = np.flatnonzero((low <= s) & (s <= back))
        if len(own) < 2:
            continue
        node = nodes(*by_right, WINDOW - s)[own] * (n + 1) + nodes(*by_left, s)[own]
        order = np.argsort(node, kind="stable")
        node, own = node[order], own[order]
        lead = own[np.maximum.accumulate(np.where(np.append(True, node[1:] != node[:-1]), np.arange(len(own)), 0))]
        more = lead != own
        found.append((own[more], np.full(more.sum(), s), (row[lead] != row[own])[more]))
    which, step, later = (np.concatenate(x) for x in zip(*found, strict=True))
    return which, step, later


def word_ids(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers for the words of data, each followed by one blank: equal words, and only they, have the same."""
    edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int32)


def spread(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[start : start + size) of all spans, one behind the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one blank, and where each starts."""
    sizes = ends - starts + 1
    out = spread(np.append(data, np.uint8(32)), starts, sizes)
    stops = np.cumsum(sizes)
    out[stops - 1] = 32
    return out, stops - sizes


# --- step 1: anchors whose PREFIX-gram stands more than once


def _halves(x: np.ndarray) -> bytes:
    """Low and high halves apart: the high ones are mostly alike and pack to nothing."""
    halves = x.view(np.uint32).reshape(len(x), 2)
    return halves[:, 0].tobytes() + halves[:, 1].tobytes()


def _unhalved(data: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32, 2 * n, at).reshape(2, n).T.copy().view(np.int64).ravel()


#: bucket and packed (key, row, nth); or a row's repeated anchors.
_MET = "bucket long, row long, anchors binary"


def _meet(buckets: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, (offsets, data) = batch.column("row").to_numpy(), scan.utf8(batch.column("text"))
            for i, j in scan.blocks(offsets):
                a = Anchors(scan.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], scan.SPACED))
                if not len(a.at):
                    continue
                order = np.argsort(a.key, kind="stable")
                twin = np.append(False, a.key[order][1:] == a.key[order][:-1])
                lead = np.flatnonzero(~twin)
                many = np.diff(np.append(lead, len(order))) > 1
                # met again in the block: repeated for sure, and only the first one goes on
                local = np.sort(order[twin])
                out = [(int(r) % buckets, int(r), p) for r, p in _by_row(rows[i:j][a.doc[local]], a.nth[local])]
                lead = order[lead]
                bucket = (a.key[lead] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for x, y in zip(*scan.groups(bucket[order]), strict=True):
                    own = order[x:y]
                    k = lead[own]
                    packed = np.int64(len(k)).tobytes() + a.key[k].tobytes() + _halves(rows[i:j][a.doc[k]]) + a.nth[k].astype(np.uint32).tobytes() + many[own].tobytes()
                    out.append((int(bucket[own[0]]), None, packed))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "row", "anchors"])

    return meet


def _by_row(row: np.ndarray, nth: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed anchors of each row, each once."""
    order = np.lexsort((nth, row))
    row, nth = row[order], nth[order].astype(np.uint32)
    once = scan.groups(row, nth)[0]
    row, nth = row[once], nth[once]
    for a, b in zip(*scan.groups(row), strict=True):
        yield int(row[a]), nth[a:b].tobytes()


def _again(heavy: int, buckets: int):
    def again(table: pa.Table) -> pa.Table:
        """Of a bucket: the anchors that begin a repeat, packed for buckets of rows, and (key, times) of PREFIX-grams that
        more than heavy blocks have."""
        ready = table.filter(table.column("row").is_valid())
        nths = [np.frombuffer(p, np.uint32) for p in ready.column("anchors").to_pylist()]
        found = [(np.repeat(ready.column("row").to_numpy().astype(np.int64), [len(x) for x in nths]), np.concatenate(nths))] if nths else []
        key, times, parts = [], [], []
        for p in table.filter(table.column("row").is_null()).column("anchors").to_pylist():
            n = int.from_bytes(p[:8], "little")
            parts.append((np.frombuffer(p, np.uint64, n, 8), _unhalved(p, n, 8 + 8 * n), np.frombuffer(p, np.uint32, n, 8 + 16 * n), np.frombuffer(p, bool, n, 8 + 20 * n)))
        if parts:
            own, row, nth, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(own, kind="stable")
            own, row, nth, many = own[order], row[order], nth[order], many[order]
            lead, stop = scan.groups(own)
            size = stop - lead
            # one that was met again in its block is repeated, and its twins there are known already
            often = np.repeat((size > 1) | np.logical_or.reduceat(many, lead), size)
            found.append((row[often], nth[often]))
            hot = np.flatnonzero(size > heavy)
            key, times = own[lead[hot]].view(np.int64).tolist(), size[hot].tolist()
        to, anchors = [], []
        if found:
            row, nth = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = (scan.mix(row.view(np.uint64), 5) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            row, nth, bucket = row[order], nth[order].astype(np.uint32), bucket[order]
            for a, b in zip(*scan.groups(bucket), strict=True):
                to.append(int(bucket[a]))
                anchors.append(_halves(row[a:b]) + nth[a:b].tobytes())
        none = [None] * len(key)
        return pa.table({"bucket": pa.array(to + none, pa.int64()), "anchors": pa.array(anchors + none, pa.binary()), "key": pa.array([None] * len(to) + key, pa.int64()), "times": pa.array([None] * len(to) + times, pa.int64())})

    return again


def _gathered(table: pa.Table) -> pa.Table:
    """Of a bucket of rows: each row's repeated anchors."""
    parts = table.column("anchors").to_pylist()
    row = np.concatenate([_unhalved(p, len(p) // 12, 0) for p in parts])
    nth = np.concatenate([np.frombuffer(p, np.uint32, len(p) // 12, len(p) // 12 * 8) for p in parts])
    found = list(_by_row(row, nth))
    return pa.table({"row": pa.array([r for r, _ in found], pa.int64()), "anchors": pa.array([p for _, p in found], pa.binary())})


# --- step 2: the subtrees


class Plan:
    """Groups, and the prefixes that must be longer: those of more suffixes than a group has room for."""

    def __init__(self, groups: int, heavy: list[tuple[int, int]], share: int):
        self.groups = groups
        heavy = sorted((k % (1 << 64), -(-n // share)) for k, n in heavy)
        self.keys, self.salts = np.array([k for k, _ in heavy], np.uint64), np.array([s for _, s in heavy], np.int64)

    def deal(self, key: np.ndarray, salt: int) -> np.ndarray:
        """Each suffix's group; below zero if it is only a part of those with its prefix."""
        group = (scan.mix(key, 7) % np.uint64(self.groups)).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hot = self.keys[at] == key
            part = scan.mix(key ^ scan.mix(np.uint64(salt) % self.salts[at].astype(np.uint64), 8), 9)
            group = np.where(hot, -1 - (part % np.uint64(self.groups)).astype(np.int64), group)
        return group


#: group and packed suffixes; or, where row is set, a document's repeated windows.
_DEALT = "group long, row long, doc long, same long, payload binary"
_KINDS = pa.schema([("group", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("same", pa.int64()), ("payload", pa.binary())])


class Suffixes:
    """Suffixes of many documents with their words."""

    def __init__(self, row, doc, same, place, back, count, data, starts, at):
        #: row, doc, same: the document; place: the anchor's word in it; at: the anchor among the words of data.
        self.row, self.doc, self.same, self.place, self.back, self.count = row, doc, same, place, back, count
        self.data, self.starts, self.at = data, starts, at

    def settled(self) -> tuple[list[tuple], Suffixes]:
        """Marks of the windows that also start earlier here, and the suffixes with the rest of their windows."""
        order = np.lexsort((self.place, self.same, self.doc))
        doc, same, place = self.doc[order], self.same[order], self.place[order]
        numbered = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (same[1:] != same[:-1]) | (place[1:] != place[:-1])))
        ids = word_ids(self.data, self.starts)
        which, step, later = tree(ids, self.at[order], self.back[order], self.count[order], numbered)
        which = order[which]
        gone = np.zeros((len(self.at), SLIDE), bool)
        gone[which, step] = True
        which, step = which[later], step[later]
        own = np.arange(SLIDE)[None, :]
        rest = (own <= self.back[:, None]) & (own > (self.back - self.count)[:, None]) & ~gone
        # runs of windows that are left, from the largest step down
        turned = np.zeros((len(self.at), SLIDE + 2), np.int8)
        turned[:, 1:-1] = rest[:, ::-1]
        turn = np.diff(turned, axis=1)
        which_run, begin = np.nonzero(turn == 1)
        _, stop = np.nonzero(turn == -1)
        back = SLIDE - 1 - begin
        left = Suffixes(self.row[which_run], self.doc[which_run], self.same[which_run], self.place[which_run], back, stop - begin, self.data, self.starts, self.at[which_run])
        return list(_marks(self.row[which], self.doc[which], self.same[which], self.place[which] - step)), left

    def packed(self) -> bytes:
        import zstandard

        edges = np.append(self.starts, len(self.data))
        begin, words = self.at - self.back, self.count + WINDOW - 1
        start, size = edges[begin], edges[begin + words] - edges[begin]
        head = np.array([len(self.at), size.sum()], np.int64)
        body = (head, self.back.astype(np.uint8), self.count.astype(np.uint8), self.place.astype(np.uint32), _halves(self.row), _halves(self.doc), _halves(self.same), spread(self.data, start, size))
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x if isinstance(x, bytes) else x.tobytes() for x in body))

    @staticmethod
    def unpacked(payloads: list[bytes]) -> Suffixes:
        import zstandard

        parts, unzip = [], zstandard.ZstdDecompressor()
        for p in payloads:
            b = unzip.decompress(p)
            n, size = (int(x) for x in np.frombuffer(b, np.int64, 2))
            parts.append((_unhalved(b, n, 16 + 6 * n), _unhalved(b, n, 16 + 14 * n), _unhalved(b, n, 16 + 22 * n), np.frombuffer(b, np.uint32, n, 16 + 2 * n).astype(np.int64), np.frombuffer(b, np.uint8, n, 16).astype(np.int64), np.frombuffer(b, np.uint8, n, 16 + n).astype(np.int64), np.frombuffer(b, np.uint8, size, 16 + 30 * n)))
        row, doc, same, place, back, count, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.append(0, np.flatnonzero(data == 32)[:-1] + 1)
        words = count + WINDOW - 1
        return Suffixes(row, doc, same, place, back, count, data, starts, np.cumsum(words) - words + back)

    def taken(self, which: np.ndarray) -> Suffixes:
        return Suffixes(self.row[which], self.doc[which], self.same[which], self.place[which], self.back[which], self.count[which], self.data, self.starts, self.at[which])

    def windows(self) -> Suffixes:
        """Each window a suffix of its own, from its first word on."""
        which = np.repeat(np.arange(len(self.at)), self.count)
        step = self.back[which] - (np.arange(len(which)) - np.repeat(np.cumsum(self.count) - self.count, self.count))
        zeros = np.zeros(len(which), np.int64)
        return Suffixes(self.row[which], self.doc[which], self.same[which], self.place[which] - step, zeros, zeros + 1, self.data, self.starts, self.at[which] - step)

    def dealt(self, group: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(group, kind="stable")
        for a, b in zip(*scan.groups(group[order]), strict=True):
            yield int(group[order[a]]), None, None, None, self.taken(order[a:b]).packed()


def _marks(row: np.ndarray, doc: np.ndarray, same: np.ndarray, start: np.ndarray) -> Iterator[tuple]:
    """Repeated windows as runs of starts [a, b), packed for each document."""
    if not len(start):
        return
    order = np.lexsort((start, same, doc))
    row, doc, same, start = row[order], doc[order], same[order], start[order]
    once = scan.groups(doc, same, start)[0]
    row, doc, same, start = row[once], doc[once], same[once], start[once]
    runs = scan.spans_to_runs(start, doc, same)
    ends = np.append(runs[1:], len(start))
    spans = np.stack((start[runs], start[ends - 1] + 1), 1).astype(np.int32)
    d, t = doc[runs], same[runs]
    for a, b in zip(*scan.groups(d, t), strict=True):
        yield None, int(row[runs[a]]), int(d[a]), int(t[a]), spans[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _KINDS, strict=True)], schema=_KINDS)


def _deal(plan):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs, sames, anchors = (batch.column(c) for c in ("row", "doc", "same", "anchors"))
            rows, docs, sames = rows.to_numpy(), docs.to_numpy(), sames.to_numpy()
            offsets, data = scan.utf8(batch.column("text"))
            for i, j in scan.blocks(offsets):
                own = data[offsets[i] : offsets[j]]
                words = scan.Words(own, offsets[i : j + 1] - offsets[i], scan.SPACED)
                a = Anchors(words)
                lists = [np.frombuffer(x, np.uint32).astype(np.int64) for x in anchors.slice(i, j - i).to_pylist()]
                base = np.searchsorted(a.doc, np.arange(j - i + 1))
                use = np.concatenate([base[k] + x[x < base[k + 1] - base[k]] for k, x in enumerate(lists)])
                if not len(use):
                    continue
                doc, at = a.doc[use], a.at[use]
                plain, starts = _plain(own, words.starts, words.ends)
                mine = Suffixes(rows[i:j][doc], docs[i:j][doc], sames[i:j][doc], at - words.first[doc], at - a.first[use], a.count[use], plain, starts, at)
                out, left = mine.settled()
                out = [(r % plan.value.groups, r, *rest) for _, r, *rest in out]
                key = words.grams(PREFIX)[left.at]
                salt = int(scan.mix(rows[i : i + 1].view(np.uint64), 3)[0])
                out += left.dealt(plan.value.deal(key, salt))
                yield _batch(out)

    return deal


def _subtree(plan):
    def subtree(table: pa.Table) -> pa.Table:
        """Reads a group's tree. Of a part of the suffixes with one prefix, the windows that are first here go on, by all
        their words."""
        ready = table.filter(table.column("row").is_valid())
        rest = table.filter(table.column("row").is_null())
        if not len(rest):
            return ready
        part = Suffixes.unpacked(rest.column("payload").to_pylist())
        out, left = part.settled()
        if table.column("group")[0].as_py() < 0 and len(left.at):
            left = left.windows()
            words = scan.hash_bytes(left.data, left.starts, np.append(left.starts[1:], len(left.data)) - 1)
            key = scan.hash_spans(words, left.at, left.at + WINDOW, 31)
            out += left.dealt((scan.mix(key, 7) % np.uint64(plan.value.groups)).astype(np.int64))
        return pa.concat_tables([ready.cast(_KINDS), pa.Table.from_batches([_batch(out)])])

    return subtree


def _rows(docs: DataFrame, *more) -> DataFrame:
    """(row, doc, same, text, ...): row is a hash of doc_id and text by which tables meet; doc and same decide."""
    same = F.xxhash64(text_of())
    return docs.select(F.xxhash64(id_key(), same).alias("row"), id_key().alias("doc"), same.alias("same"), text_of().alias("text"), *more)


def repeated_windows(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """rows(row, doc, same, text, ...) -> (row, marks): for each row key the documents with repeats, (doc, same, spans),
    spans being packed int32 pairs [a, b) of window starts."""
    spark = rows.sparkSession
    bounded_batches(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = max(2, group_suffixes // 4)
    buckets = -(-size // bucket_bytes) or 1
    met = rows.select("row", "text").mapInArrow(_meet(buckets), _MET)
    found = written(met.groupBy("bucket").applyInArrow(_again(share, buckets), "bucket long, anchors binary, key long, times long"), "repeat-anchors")
    total = found.agg(F.sum(F.octet_length("anchors"))).first()[0] or 0
    # at most one key for every share of all anchors
    heavy = [(r.key, r.times) for r in found.where("key is not null").select("key", "times").collect()]
    plan = spark.sparkContext.broadcast(Plan(-(-total // (12 * group_suffixes)) or 1, heavy, share))
    anchors = found.where("bucket is not null").select("bucket", "anchors").groupBy("bucket").applyInArrow(_gathered, "row long, anchors binary")
    trees = rows.join(anchors, "row").mapInArrow(_deal(plan), _DEALT).groupBy("group").applyInArrow(_subtree(plan), _DEALT)
    if heavy:
        first = written(trees, "repeat-parts")
        trees = first.where("row is not null").unionByName(first.where("row is null").groupBy("group").applyInArrow(_subtree(plan), _DEALT))
    marks = trees.where("row is not null")
    return marks.groupBy("row").agg(F.collect_set(F.struct("doc", "same", "payload")).alias("marks"))


def _cut(spaced: bool):
    """Cuts the repeated words out. If spaced, what stays of every text is joined by single blanks; else only of texts
    that lose words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, n in enumerate(batch.schema.names) if n not in ("row", "doc", "same", "text", "marks")]
            docs, sames = batch.column("doc").to_pylist(), batch.column("same").to_pylist()
            words, removed, texts = [], [], []
            for doc, same, text, marks in zip(docs, sames, batch.column("text"), batch.column("marks").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                own = raw.split()
                words.append(len(own))
                mine = [m["payload"] for m in marks or () if m["doc"] == doc and m["same"] == same]
                if not mine:
                    removed.append(0)
                    texts.append(b" ".join(own) if spaced else raw)
                    continue
                spans = np.frombuffer(b"".join(mine), np.int32).reshape(-1, 2)
                turn = np.zeros(len(own) + 1, np.int32)
                np.add.at(turn, spans[:, 0], 1)
                np.add.at(turn, spans[:, 1] - 1 + WINDOW, -1)
                gone = np.cumsum(turn[:-1]) > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join([own[k] for k in np.flatnonzero(~gone)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], [*(batch.schema.names[i] for i in rest), "n_words", "n_removed", "kept_text"])

    return cut


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, kept_text): each word goes that a window covers whose
    words also start earlier (smaller doc_id, or same document and earlier start). kept_text joins what stays by
    single spaces."""
    rows = _rows(docs)
    marks = repeated_windows(rows, bucket_bytes, group_suffixes)
    cut = rows.join(marks, "row", "left").withColumn("doc_id", id_back("doc"))
    return cut.mapInArrow(_cut(True), "doc_id long, n_words long, n_removed long, kept_text string")


def passages(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, first_word, n_words, passage): the maximal passages of each distinct document that
    are made of windows that also start earlier."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, same, text, marks in zip(batch.column("doc").to_pylist(), batch.column("same").to_pylist(), batch.column("text"), batch.column("marks").to_pylist(), strict=True):
                own = text.as_buffer().to_pybytes().split()
                spans = [np.frombuffer(m["payload"], np.int32).reshape(-1, 2) for m in marks if m["doc"] == doc and m["same"] == same]
                start = np.unique(np.concatenate([np.arange(a, b) for x in spans for a, b in x] or [np.zeros(0, np.int64)]))
                runs = scan.spans_to_runs(start)
                for a, b in zip(runs, np.append(runs[1:], len(start)), strict=True):
                    one = own[start[a] : start[b - 1] + WINDOW]
                    out.append((doc, int(start[a]), len(one), b" ".join(one)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.string())], ["doc", "first_word", "n_words", "passage"])

    rows = _rows(docs)
    found = rows.join(repeated_windows(rows, bucket_bytes, group_suffixes), "row").dropDuplicates(["row", "doc", "same"])
    return found.mapInArrow(merged, "doc long, first_word long, n_words long, passage string").select(id_back("doc").alias("doc_id"), "first_word", "n_words", "passage")


def without_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """docs with the repeated words cut out of text (what stays joined by single spaces) and n_chars, where there is
    such a column, counted anew; rows that lose no word are unchanged, and so are all other columns."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    # the other columns travel in a struct, so that no name of theirs can clash
    rows = _rows(docs, F.struct(F.col("text").isNull().alias("_none"), *[F.col(f"`{f.name}`") for f in rest]).alias("rest"))
    marks = repeated_windows(rows, bucket_bytes, group_suffixes)
    kinds = ", ".join(["_none: boolean", *(f"`{f.name}`: {f.dataType.simpleString()}" for f in rest)])
    cut = rows.join(marks, "row", "left").mapInArrow(_cut(False), f"rest struct<{kinds}>, n_words long, n_removed long, kept_text string")
    out = cut.select(*[F.col("rest")[f.name].alias(f.name) for f in rest], F.when(~F.col("rest")["_none"], F.col("kept_text")).alias("text"), (F.col("n_removed") > 0).alias("_cut"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The definition read literally, for tests: (doc_id, n_words, n_removed, kept_sha256) of each row."""
    import xxhash

    def place(d: int | None, t: str | None) -> tuple[int, int]:
        """doc_id, nulls first, then the signed hash by which texts of one doc_id are ordered."""
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return (-(2**63) if d is None else d), h - (1 << 64) if h >> 63 else h

    split = {place(d, t): (t or "").encode().split() for d, t in docs}
    seen: dict[tuple, tuple] = {}
    for p in sorted(split):
        for s in range(len(split[p]) - window + 1):
            seen.setdefault(tuple(split[p][s : s + window]), (p, s))
    out = []
    for d, t in docs:
        p = place(d, t)
        words = split[p]
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s : s + window])] < (p, s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
