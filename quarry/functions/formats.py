"""Byte formats: row keys, recipe blobs, headers of tar and gzip, the ends of JPEG streams, hash mixers.

Keys are plain column expressions. The rest runs over Arrow batches, one call a body."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarry.functions.codecs import crc32c_of

# --- row keys: big-endian, so that their bytes sort as the rows do -------------------------------------------------

#: The leading bytes of attribute and recipe keys.
XATTR_PREFIX, RECIPE_PREFIX = "03", "04"


def _big(x: Column, size: int) -> Column:
    """A number below 2^(8 size), or its two's complement, as hex digits."""
    return F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * size))


def inode_key(ino: Column) -> Column:
    return F.unhex(_big(ino, 8))


def _named(name: Column) -> Column:
    raw = name.cast("binary")
    return F.concat(_big(F.length(raw), 2), F.hex(raw))


def dirent_key(parent: Column, name: Column) -> Column:
    """Parent, length of the name, name."""
    return F.unhex(F.concat(_big(parent, 8), _named(name)))


def xattr_key(ino: Column, name: Column) -> Column:
    return F.unhex(F.concat(F.lit(XATTR_PREFIX), _big(ino, 8), _named(name)))


def recipe_key(address: Column) -> Column:
    """address: 32 bytes."""
    return F.unhex(F.concat(F.lit(RECIPE_PREFIX), F.hex(address)))


def key_parts(key: Column) -> Column:
    """(parent, name) of a dirent key; null for bytes that are none."""
    digits = F.hex(key)
    long_enough = F.length(key) >= 10
    size = F.conv(F.substring(digits, 17, 4), 16, 10).cast("int")
    # conv() gives unsigned numbers
    parent = F.conv(F.substring(digits, 1, 16), 16, -10).cast("long")
    return F.when(long_enough & (F.length(key) == size + 10), F.struct(parent.alias("parent"), F.substring(key, F.lit(11), size).cast("string").alias("name")))


# --- mixers ------------------------------------------------------------------------------------------------------

#: Shifts and factors of two 64-bit finalisers.
SPLITMIX = (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31)
MURMUR = (33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33)


def mixer(constants: tuple[int, int, int, int, int]) -> Callable[[Column], Column]:
    """A column function: the finaliser of a long, as a long of the same bits. Spark's product of longs does not wrap, so
    it runs over Arrow batches."""
    a, f, b, g, c = constants

    @F.pandas_udf(LongType())
    def mixed(x: pd.Series) -> pd.Series:
        there = x.notna()
        u = x[there].to_numpy(np.int64).view(np.uint64)
        u = (u ^ (u >> np.uint64(a))) * np.uint64(f)
        u = (u ^ (u >> np.uint64(b))) * np.uint64(g)
        out = pd.Series([None] * len(x), dtype="Int64", index=x.index)
        out[there] = (u ^ (u >> np.uint64(c))).view(np.int64)
        return out

    return mixed


# --- recipe blobs ------------------------------------------------------------------------------------------------

#: The largest file and the most entries, and the marks of the two kinds of trailing tables.
LARGEST_FILE, MOST_ENTRIES = 1 << 40, 1 << 24
WINDOWS, CHILDREN = b"WINW", b"CHLD"
_HEADS = {1: struct.Struct("<IIHHI"), 2: struct.Struct("<IQIII"), 3: struct.Struct("<IQIII")}
_ENTRY = struct.Struct("<QQIIQ")
_WIDE = struct.Struct("<QQQIIQ")
_WINDOW = struct.Struct("<QQIBBBBb3x")


@dataclass(frozen=True)
class Entry:
    """A piece of a file: where it lies in the file, its length, zone, codec number, slot, offset in a shared batch, and
    block address."""

    off: int
    length: int
    zone: int
    algo: int
    slot: int
    batch_off: int
    pba: int


@dataclass
class Recipe:
    """A file's entries with, at most, one trailing table: windows (source offset, length, transform, engine, level, memory
    level, strategy, window bits) or children's addresses."""

    size: int
    entries: list[Entry]
    windows: list[tuple] = field(default_factory=list)
    children: list[bytes] = field(default_factory=list)
    version: int = 1


def recipe_blob(recipe: Recipe, wide: bool = False) -> bytes:
    """The blob of a recipe: the smallest header that holds its numbers, or the wide form, whose entries have a CRC each."""
    n = len(recipe.entries)
    if recipe.size > LARGEST_FILE or n > MOST_ENTRIES or (recipe.windows and recipe.children):
        raise ValueError("a recipe out of bounds")
    version = 3 if wide else 1 if recipe.size < 1 << 32 and n < 1 << 16 else 2
    out = bytearray(_HEADS[version].pack(version, recipe.size, n, 0, 0))
    for e in recipe.entries:
        if wide:
            flags = e.zone | e.algo << 6 | e.slot << 16
            if e.zone >> 6 or e.algo >> 10 or e.slot >> 32:
                raise ValueError("an entry out of bounds")
            blank = _WIDE.pack(e.off, e.length, flags, e.batch_off, 0, e.pba)
            out += _WIDE.pack(e.off, e.length, flags, e.batch_off, crc32c_of(blank), e.pba)
        else:
            if e.zone >> 2 or e.algo >> 6 or e.slot >> 24:
                raise ValueError("an entry out of bounds")
            out += _ENTRY.pack(e.off, e.length, e.zone | e.algo << 2 | e.slot << 8, e.batch_off, e.pba)
    for mark, rows in ((WINDOWS, [_WINDOW.pack(*w) for w in recipe.windows]), (CHILDREN, recipe.children)):
        if rows:
            out += mark + struct.pack("<I", len(rows)) + b"".join(rows)
    return bytes(out)


def recipe_of(blob: bytes) -> Recipe:
    """The recipe of a blob; a blob that is cut, damaged, out of bounds or followed by anything else is refused."""
    version = int.from_bytes(blob[:4], "little")
    head = _HEADS.get(version)
    if head is None or len(blob) < head.size:
        raise ValueError("not a recipe")
    _, size, n, _, _ = head.unpack_from(blob)
    if size > LARGEST_FILE or n > MOST_ENTRIES:
        raise ValueError("a recipe out of bounds")
    at, kind = head.size, _WIDE if version == 3 else _ENTRY
    if at + n * kind.size > len(blob):
        raise ValueError("a recipe ends too early")
    entries = []
    for i in range(n):
        if version == 3:
            off, length, flags, batch_off, crc, pba = _WIDE.unpack_from(blob, at + 40 * i)
            if flags >> 48 or crc32c_of(_WIDE.pack(off, length, flags, batch_off, 0, pba)) != crc:
                raise ValueError(f"entry {i} is damaged")
            entries.append(Entry(off, length, flags & 63, flags >> 6 & 1023, flags >> 16, batch_off, pba))
        else:
            off, length, flags, batch_off, pba = _ENTRY.unpack_from(blob, at + 32 * i)
            entries.append(Entry(off, length, flags & 3, flags >> 2 & 63, flags >> 8, batch_off, pba))
    out, at = Recipe(size, entries, version=version), at + n * kind.size
    rest = blob[at:]
    if rest:
        mark, count = rest[:4], int.from_bytes(rest[4:8], "little")
        stride = {WINDOWS: _WINDOW.size, CHILDREN: 32}.get(mark)
        if stride is None or not 0 < count <= MOST_ENTRIES or len(rest) - 8 != count * stride:
            raise ValueError("a trailing table that does not fit")
        if mark == WINDOWS:
            out.windows = [_WINDOW.unpack_from(rest, 8 + i * stride) for i in range(count)]
        else:
            out.children = [rest[8 + 32 * i : 40 + 32 * i] for i in range(count)]
    return out


_FIELDS = ("off", "length", "zone", "algo", "slot", "batch_off", "pba")


def recipe_blobs(entries: DataFrame, wide: bool = False) -> DataFrame:
    """entries(ino, idx, off, length, zone, algo, slot, batch_off, pba) -> (ino, blob); a recipe is one row by its nature."""
    own = entries.groupBy("ino").agg(F.array_sort(F.collect_list(F.struct("idx", *_FIELDS))).alias("entries"), F.max(F.col("off") + F.col("length")).alias("size"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            blobs = [recipe_blob(Recipe(int(size), [Entry(*(int(e[f]) for f in _FIELDS)) for e in rows]), wide) for rows, size in zip(frame.entries, frame["size"], strict=True)]
            yield pd.DataFrame({"ino": frame.ino, "blob": blobs})

    return own.mapInPandas(pack, "ino long, blob binary")


def recipe_entries(blobs: DataFrame) -> DataFrame:
    """blobs(ino, blob) -> entries, in order of idx (from 1)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(ino, i, *(getattr(e, f) for f in _FIELDS)) for ino, blob in zip(frame.ino, frame.blob, strict=True) for i, e in enumerate(recipe_of(bytes(blob)).entries, 1)]
            yield pd.DataFrame(rows, columns=["ino", "idx", *_FIELDS])

    return blobs.mapInPandas(parse, "ino long, idx long, " + ", ".join(f"{f} long" for f in _FIELDS))


# --- headers -----------------------------------------------------------------------------------------------------


def tar_size(header: bytes) -> int:
    """The size in a tar header: octal digits, led by blanks or not, or a big binary number."""
    if header[124] & 0x80:
        return int.from_bytes(header[125:133], "little")
    return int(re.match(rb" *([0-7]*)", header[124:135])[1] or b"0", 8)


def tar_valid(header: bytes) -> bool:
    """Whether the checksum holds, its own field read as blanks or as zeros."""
    rest = sum(header) - sum(header[148:156])
    digits = re.match(rb"[ 0-7\x80-\xff]*", header[148:156])[0].replace(b" ", b"")
    want = sum((c & 7) << 3 * i for i, c in enumerate(reversed(digits)))
    return want - rest in (0, 8 * 32)


def tar_parts(tar: bytes) -> tuple[list[tuple[bytes, bytes, bytes]], bytes]:
    """(header, body, padding) of each record and what follows the last one: joined, they are the tar again."""
    at, out = 0, []
    while at + 512 <= len(tar):
        header = tar[at : at + 512]
        if not any(header) or not tar_valid(header):
            break
        size = tar_size(header)
        if size > len(tar) - at - 512:
            break
        end = at + 512 + size
        pad = -size % 512
        out.append((header, tar[at + 512 : end], tar[end : end + pad]))
        at = end + pad
    return out, tar[at:]


def tar_recipe(tar: bytes) -> tuple[bytes, list[bytes]]:
    """What a tar is besides its members' bodies (packed), and the bodies."""
    parts, rest = tar_parts(tar)
    pieces = [struct.pack("<IQI", len(parts), len(rest), zlib.crc32(tar))]
    for header, body, pad in parts:
        plain = not any(pad) and len(pad) == -len(body) % 512
        pieces.append(header + struct.pack("<QBH", len(body), plain, len(pad)) + (b"" if plain else pad))
    return zlib.compress(b"".join(pieces) + rest), [body for _, body, _ in parts]


def tar_rebuilt(recipe: bytes, bodies: list[bytes]) -> bytes:
    """The tar again, bit for bit; a member that does not fit its recipe is refused."""
    raw = zlib.decompress(recipe)
    n, rest, crc = struct.unpack_from("<IQI", raw)
    at, out = 16, []
    if n != len(bodies):
        raise ValueError("members are missing")
    for body in bodies:
        header = raw[at : at + 512]
        size, plain, pad = struct.unpack_from("<QBH", raw, at + 512)
        at += 523
        out += [header, body, bytes(pad) if plain else raw[at : at + pad]]
        at += 0 if plain else pad
        if size != len(body):
            raise ValueError("a member of another size")
    whole = b"".join(out) + raw[at : at + rest]
    if zlib.crc32(whole) != crc:
        raise ValueError("the rebuilt tar differs")
    return whole


def gzip_header(data: bytes) -> int | None:
    """The length of a gzip header, or None if it is none or does not fit with a byte of data and the trailer."""
    if len(data) < 18 or data[:2] != b"\x1f\x8b" or data[3] & 0xE0:
        return None
    flags, at = data[3], 10
    if flags & 4:
        if len(data) - at < 2:
            return None
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            end = data.find(b"\0", at)
            if end < 0:
                return None
            at = end + 1
    at += 2 if flags & 2 else 0
    return at if at + 9 <= len(data) else None


def gzip_recipe(data: bytes) -> tuple[bytes, bytes, dict] | None:
    """(header, content, parameters) of a one-member gzip that zlib can make again bit for bit, or None."""
    from quarry.functions.codecs import deflate_parameters

    head = gzip_header(data)
    if head is None:
        return None
    try:
        inflater = zlib.decompressobj(-15)
        raw = inflater.decompress(data[head:]) + inflater.flush()
    except zlib.error:
        return None
    stream = data[head : len(data) - len(inflater.unused_data)]
    if not inflater.eof or inflater.unused_data != struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF):
        return None
    found = deflate_parameters(raw, stream)
    return (data[:head], raw, found) if found else None


def gzip_rebuilt(header: bytes, raw: bytes, parameters: dict) -> bytes:
    from quarry.functions.codecs import deflate_again

    return header + deflate_again(raw, parameters) + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def flac_blocks(data: bytes) -> list[tuple[int, int, int]] | None:
    """(kind, offset, size) of a FLAC stream's metadata blocks, or None if it is none."""
    if data[:4] != b"fLaC":
        return None
    at, out, last = 4, [], False
    while not last:
        if at + 4 > len(data):
            return None
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append((kind, at + 4, size))
        at += 4 + size
    return out


def png_chunks(data: bytes) -> list[tuple[bytes, int, int, bool]] | None:
    """(type, offset, size, whether the CRC holds) of a PNG's chunks up to its end, or None if it has none."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, out = 8, []
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if at + 12 + size > len(data) or (not out and kind != b"IHDR"):
            return None
        crc = int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        out.append((kind, at + 8, size, zlib.crc32(data[at + 4 : at + 8 + size]) == crc))
        at += 12 + size
        if kind == b"IEND":
            return out
    return None


#: A marker with the fill before it, and the byte before the first marker that ends a coded run (stuffed bytes and restarts
#: are within it).
_MARK, _RUN_END = re.compile(rb"\xff+([^\x00\xff])"), re.compile(rb"\xff(?=[^\x00\xff\xd0-\xd7])")
#: Markers without a segment, of frames, of a scan and of the end.
_BARE, _FRAMES, _SCAN, _END = {0x01, 0xD8, *range(0xD0, 0xD8)}, {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}, 0xDA, 0xD9


def jpeg_end(data: bytes, start: int) -> int:
    """The place behind the end of the JPEG stream that starts at start, by its markers, so that a thumbnail inside a
    segment does not end it; 0 if it is cut, malformed or without a frame."""
    at, framed = start + 2, False
    while found := _MARK.match(data, at):
        mark, at = found[1][0], found.end()
        if mark == _END:
            return at if framed else 0
        if mark in _BARE:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            return 0
        framed |= mark in _FRAMES
        at += size
        if mark == _SCAN:
            run = _RUN_END.search(data, at)
            at = run.start() if run else len(data)
    return 0


#: Fixed value: the least size of a picture that is taken out of a program.
LEAST_CARVED = 16 << 10


def carved(body: bytes, least: int = LEAST_CARVED) -> list[tuple[int, int]]:
    """(offset, size) of whole JPEG streams inside a program."""
    out, at = [], body.find(b"\xff\xd8\xff")
    while at >= 0:
        end = jpeg_end(body, at)
        if end and end - at >= least:
            out.append((at, end - at))
            at = body.find(b"\xff\xd8\xff", end)
        else:
            at = body.find(b"\xff\xd8\xff", at + 3)
    return out


def spliced(rest: bytes, parts: list[tuple[int, bytes]]) -> bytes:
    """A program from what is left of it and the (offset, body) taken out, in order of their offsets."""
    out, at, done = [], 0, 0
    for off, body in parts:
        out += [rest[at : at + off - done], body]
        at += off - done
        done = off + len(body)
    return b"".join(out) + rest[at:]


def carves(programs: DataFrame, least: int = LEAST_CARVED) -> DataFrame:
    """programs(ino, body) -> (ino, idx, off, size, whole): the pictures in each, and whether the program is the same again
    once they are taken out and put back."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for ino, body in zip(frame.ino, frame.body, strict=True):
                body = bytes(body)
                found = carved(body, least)
                rest, at = b"", 0
                for off, size in found:
                    rest, at = rest + body[at:off], off + size
                whole = spliced(rest + body[at:], [(off, body[off : off + size]) for off, size in found]) == body
                rows += [(ino, i, off, size, whole) for i, (off, size) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["ino", "idx", "off", "size", "whole"])

    return programs.mapInPandas(scan, "ino long, idx long, off long, size long, whole boolean")


# --- extents -----------------------------------------------------------------------------------------------------

#: Bytes of a block, of a segment's own header, and the smallest metadata extent.
BLOCK, FRAME, META_EXTENT = 4096, 8, 64 << 10


def blocks_of(packed: Column) -> Column:
    """Blocks that a packed segment takes with its header."""
    return F.ceil((packed + FRAME) / BLOCK).cast("long")


def meta_extent(size_class: Column) -> Column:
    """Bytes of a metadata extent of a class 0 to 15; null for another."""
    return F.when(size_class.between(0, 15), F.call_function("shiftleft", F.lit(META_EXTENT).cast("long"), size_class.cast("int")))
