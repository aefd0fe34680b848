"""Token ids in sorted-string-table shards.

Documents are dealt to ranges of doc_id, encoded in order, and written as immutable shards. A shard holds:

* data blocks of about BLOCK_BYTES: entries (bytes shared with the key before, rest of the key, ids), every
  RESTART-th with its whole key, then the restart offsets and a crc32;
* a sparse index: the last key, offset and size of each block;
* a Bloom filter of the keys;
* a footer of fixed size: where index and filter lie, how many documents and ids, first and last key, width of an id.

A lookup asks the filter, searches the index for the one block that can hold the key, and searches its restarts.

Shards are files of their own in the shared folder, written where the ids are made. A manifest, a small Parquet table,
names those that count: (part, nth, path, first and last id, documents, ids, ids before it in its part). Spark commits
the manifest, so what a failed or repeated task leaves behind is never read. Files are read block by block through the
index; a lookup reads footer, filter and one block. The folder may lie in any file system that pyarrow opens by its
address (local, HDFS, S3, GCS).

Ids are those of the tokenizers library for the same vocabulary file; the merges are run by tiktoken, which is some
six times as fast (the tests hold both against each other). Strings of special tokens in a text become those tokens.

Defined cases: a null or empty text has the end id alone; a null doc_id counts as the smallest and comes back as
null; rows with the same doc_id are entries of their own, in the order of a hash of their texts, over as many tasks and
shards as they fill; an empty table gives no shards and no rows; other columns are passed over.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .lexicon import byte_letters
from .shared import arrow_path, bounded_batches, id_back, id_key, new_folder, shuffle_parts, text_of, written

END_ID = 2
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7

#: Fixed values of the vocabulary's format: how byte-level BPE cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MAGIC = b"QSSTABL1"
_FOOTER = struct.Struct("<QQQQQQqqI8s")


class Encoder:
    """Byte-level BPE from a tokenizers file."""

    def __init__(self, tokenizer_json: str):
        import tiktoken

        parts = json.loads(tokenizer_json)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in self.special}
        self._own = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.width = 2 if max([*ranks.values(), *self.special.values(), END_ID]) < 1 << 16 else 4

    def encode(self, text: str) -> list[int]:
        if not self._cut or not self._cut.search(text):
            return self._own.encode_ordinary(text)
        out: list[int] = []
        for part in self._cut.split(text):
            out += [self.special[part]] if part in self.special else self._own.encode_ordinary(part)
        return out


def _key(doc_id: int) -> bytes:
    """Eight bytes that sort as the ids do."""
    return struct.pack(">Q", doc_id + 2**63)


def _bloom_places(doc_ids: np.ndarray, bits: int) -> np.ndarray:
    x = doc_ids.astype(np.int64).view(np.uint64)
    a, b = scan.mix(x, 1), scan.mix(x, 2) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


class Writer:
    """Builds one shard from (doc_id, ids) in ascending doc_id."""

    def __init__(self, width: int):
        self.width, self.kind = width, np.dtype(f"<u{width}")
        self.out, self.index, self.keys, self.tokens = bytearray(_MAGIC), [], [], 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.entries, self.before = bytearray(), [], 0, b""

    def add(self, doc_id: int, ids: list[int]) -> None:
        key, shared = _key(doc_id), 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < 8 and key[shared] == self.before[shared]:
                shared += 1
        value = np.array(ids, self.kind).tobytes()
        self.block += struct.pack("<BI", shared, len(value)) + key[shared:] + value
        self.before, self.entries = key, self.entries + 1
        self.keys.append(doc_id)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.entries:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index.append((self.before, len(self.out), len(body) + 4))
            self.out += body + struct.pack("<I", zlib.crc32(body))
        self._open()

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._close()
        index_at = len(self.out)
        for last, at, size in self.index:
            self.out += last + struct.pack("<QI", at, size)
        bloom_at, bits = len(self.out), max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        bloom[_bloom_places(np.array(self.keys), bits).ravel().astype(np.int64)] = 1
        self.out += np.packbits(bloom, bitorder="little").tobytes()
        self.out += _FOOTER.pack(index_at, len(self.index), bloom_at, bits, len(self.keys), self.tokens, self.keys[0], self.keys[-1], self.width, _MAGIC)
        return bytes(self.out)


class Shard:
    """Reads a shard from a file that can seek, a block at a time."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        *numbers, magic = _FOOTER.unpack(self._read(max(0, size - _FOOTER.size), _FOOTER.size))
        if magic != _MAGIC or self._read(0, 8) != _MAGIC:
            raise ValueError("not a shard")
        self.index_at, self.n_blocks, self.bloom_at, self.bloom_bits, self.n_docs, self.n_tokens, self.first, self.last, width = numbers
        self.kind, self.width = np.dtype(f"<u{width}"), width
        self.index = self._read(self.index_at, 20 * self.n_blocks)
        self.bloom = b""

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("a shard ends too early")
        return data

    def _index(self, i: int) -> tuple[bytes, int, int]:
        return self.index[20 * i : 20 * i + 8], *struct.unpack_from("<QI", self.index, 20 * i + 8)

    def _block(self, i: int) -> tuple[memoryview, tuple[int, ...]]:
        _, at, size = self._index(i)
        whole = memoryview(self._read(at, size))
        body = whole[: size - 4]
        if zlib.crc32(body) != struct.unpack_from("<I", whole, size - 4)[0]:
            raise ValueError(f"block {i} is damaged")
        (n,) = struct.unpack_from("<I", body, len(body) - 4)
        return body[: len(body) - 4 - 4 * n], struct.unpack_from(f"<{n}I", body, len(body) - 4 - 4 * n)

    def _entries(self, body: memoryview, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(body):
            shared, size = struct.unpack_from("<BI", body, at)
            at += 5
            key = key[:shared] + bytes(body[at : at + 8 - shared])
            at += 8 - shared
            yield key, np.frombuffer(body, self.kind, size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(self.n_blocks):
            for key, ids in self._entries(self._block(i)[0], 0):
                yield struct.unpack(">Q", key)[0] - 2**63, ids

    def may_hold(self, doc_id: int) -> bool:
        self.bloom = self.bloom or self._read(self.bloom_at, self.bloom_bits // 8)
        places = _bloom_places(np.array([doc_id]), self.bloom_bits)[0].astype(np.int64)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in places.tolist())

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document (the first of that doc_id), or None."""
        if not self.first <= doc_id <= self.last or not self.may_hold(doc_id):
            return None
        key, lo, hi = _key(doc_id), 0, self.n_blocks - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self._index(mid)[0] < key:
                lo = mid + 1
            else:
                hi = mid
        body, restarts = self._block(lo)
        a, b = 0, len(restarts) - 1
        while a < b:  # the last restart whose key is less; the key may stand right behind it
            mid = (a + b + 1) // 2
            if bytes(body[restarts[mid] + 5 : restarts[mid] + 13]) < key:
                a = mid
            else:
                b = mid - 1
        for found, ids in self._entries(body, restarts[a]):
            if found == key:
                return ids
            if found > key:
                return None
        return None


_encoders: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


_MANIFEST = "part int, nth int, path string, first_id long, last_id long, n_docs long, n_tokens long, before long"


def _write(tokenizer, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, at = FileSystem.from_uri(folder)
        encoder = _encoder(tokenizer.value)
        part, attempt, nth, before = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0
        shard = Writer(encoder.width)

        def done() -> pa.RecordBatch:
            path = f"{at}/shard-{part:06d}-{nth:06d}-{attempt}.sst"
            with store.open_output_stream(path) as file:
                file.write(shard.finish())
            row = (part, nth, path, shard.keys[0], shard.keys[-1], len(shard.keys), shard.tokens, before)
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _MANIFEST.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
                shard.add(doc.as_py(), [*encoder.encode(text.as_py()), END_ID])
                if shard.size() >= SHARD_BYTES:
                    yield done()
                    nth, before = nth + 1, before + shard.tokens
                    shard = Writer(encoder.width)
        if shard.keys:
            yield done()

    return write


def write_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(doc_id, text) -> the manifest of the files written, parts and shards in ascending doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    folder = arrow_path(spark, new_folder(spark, "sstables"))
    # the place in the input comes last, so that equal rows are not bound to one task
    rows = docs.select(id_key().alias("doc"), F.xxhash64(text_of()).alias("hash"), F.monotonically_increasing_id().alias("place"), text_of().alias("text"))
    order = ("doc", "hash", "place")
    ranges = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select("doc", "text")
    return written(ranges.mapInArrow(_write(vocabulary, folder), _MANIFEST), "sstable-manifest").withColumn("folder", F.lit(folder))


def _open(folder: str, path: str) -> Shard:
    from pyarrow.fs import FileSystem

    return Shard(FileSystem.from_uri(folder)[0].open_input_file(path))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, path, base in zip(*(batch.column(c).to_pylist() for c in ("folder", "path", "base")), strict=True):
            at, out = base, []
            for doc, ids in _open(folder, path):
                out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc", "start", "n_tokens", "ids_crc32"])


def read_back(shards: DataFrame) -> DataFrame:
    """The contract's columns, from the files. A shard's first position is its place in its part, which the writer knows,
    behind all parts before; there is one sum for each part, so as many as there were tasks."""
    sums = sorted((r.part, r.n, r.shards) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("shards")).collect())
    bases, total = [], 0
    for part, n, _ in sums:
        bases.append((part, total))
        total += n
    spark = shards.sparkSession
    starts = spark.createDataFrame(bases, "part int, base long")
    rows = shards.join(F.broadcast(starts), "part").select("folder", "path", (F.col("base") + F.col("before")).alias("base"))
    found = rows.repartition(max(1, min(sum(n for *_, n in sums), 4 * shuffle_parts(spark))), "path").mapInArrow(_read, "doc long, start long, n_tokens long, ids_crc32 long")
    return found.select(id_back("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents (of several with one doc_id, those of the first): only files whose range can hold one are
    opened, and of these one block for each doc_id that the filter lets through."""
    can = F.exists(F.lit(doc_ids).cast("array<long>"), lambda x: x.between(F.col("first_id"), F.col("last_id")))
    out: dict[int, list[int]] = {}
    for row in shards.where(can).orderBy("part", "nth").select("folder", "path").toLocalIterator():
        shard = _open(row.folder, row.path)
        out |= {d: ids.tolist() for d in doc_ids if d not in out and (ids := shard.get(d)) is not None}
    return out


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns."""
    return read_back(write_shards(docs, tokenizer))
