"""Scalar functions over bytes that Spark has no built-in for, as Arrow-batched UDFs, and the codec registry."""

from __future__ import annotations

import gzip
import io
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0x82F63B78), _TABLE >> 1).astype(np.uint32)
_LIST = _TABLE.tolist()


def crc32c_of(data: bytes, crc: int = 0) -> int:
    """The Castagnoli CRC of bytes."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = _LIST[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _crc32c_many(bodies: list[bytes]) -> np.ndarray:
    """CRCs of many bodies, one byte place of all at a time."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts = (np.append(0, np.cumsum(sizes)[:-1]))[order]
    sizes, crc = sizes[order], np.full(len(bodies), 0xFFFFFFFF, np.uint32)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -i, "left"))
        crc[:n] = _TABLE[(crc[:n] ^ data[starts[:n] + i]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty(len(bodies), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(LongType())
def crc32c(body: pd.Series) -> pd.Series:
    """CRC32C of strings or bytes; null stays null."""
    there = body.notna()
    out = pd.Series([None] * len(body), dtype="Int64", index=body.index)
    if there.any():
        out[there] = _crc32c_many([b.encode() if isinstance(b, str) else bytes(b) for b in body[there]])
    return out


def bcj_x86(data: bytes, encode: bool = True) -> bytes:
    """Branch targets of E8/E9 made absolute (encode) or relative again. Only targets whose top byte is 00 or FF and
    stay so are changed, which keeps it invertible; a changed operand is skipped."""
    out, i = bytearray(data), 0
    while i + 5 <= len(out):
        if out[i] in (0xE8, 0xE9) and out[i + 4] in (0x00, 0xFF):
            value = struct.unpack_from("<I", out, i + 1)[0] & 0x01FFFFFF
            value = (value + i + 5 if encode else value - i - 5) & 0x01FFFFFF
            struct.pack_into("<I", out, i + 1, value | (0xFE000000 if value & 0x01000000 else 0))
            i += 5
        else:
            i += 1
    return bytes(out)


#: The order in which deflate parameters are tried. It decides which are found where several give the same
#: stream: first the usual strategy at memory level 8, then 9 and 7, then 6 to 1; then the other strategies, each at
#: levels 1 to 9 and memory levels 7 to 9. A window of 12 bits is tried with the first three memory levels only.
DEFLATE_LEVELS = (6, 9, 1, 7, 5, 8, 4, 3, 2)
DEFLATE_MEMORY = (8, 9, 7, 6, 5, 4, 3, 2, 1)
DEFLATE_STRATEGIES = (zlib.Z_FILTERED, zlib.Z_HUFFMAN_ONLY, zlib.Z_RLE, zlib.Z_FIXED)
_SMALL_WINDOW = -12


def deflate_again(raw: bytes, parameters: dict) -> bytes:
    """The raw deflate stream of found parameters."""
    c = zlib.compressobj(parameters["level"], zlib.DEFLATED, parameters["window"], parameters["memory"], parameters["strategy"])
    return c.compress(raw) + c.flush()


def _deflate_grid(window: int) -> Iterator[tuple[int, int, int]]:
    """(level, memory level, strategy) in the order of trial."""
    usual = DEFLATE_MEMORY[:3] if window == _SMALL_WINDOW else DEFLATE_MEMORY
    yield from ((level, memory, zlib.Z_DEFAULT_STRATEGY) for memory in usual for level in DEFLATE_LEVELS)
    if window != _SMALL_WINDOW:
        yield from ((level, memory, strategy) for strategy in DEFLATE_STRATEGIES for level in range(1, 10) for memory in (7, 8, 9))


def deflate_parameters(raw: bytes, stream: bytes, window: int = 0) -> dict | None:
    """The zlib level, memory level, strategy and window that give back a raw deflate stream, or None. window: the known
    window bits, negative for a raw stream; 0 if unknown."""
    window = window or -15
    for level, memory, strategy in _deflate_grid(window):
        found = {"level": level, "memory": memory, "strategy": int(strategy), "window": window}
        if deflate_again(raw, found) == stream:
            return found
    return None


def reproduced(streams: DataFrame) -> DataFrame:
    """streams(ino, stream) of raw deflate -> (ino, size, level, memory, strategy): what gives each back bit for bit, nulls
    where nothing does."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for ino, stream in zip(frame.ino, frame.stream, strict=True):
                try:
                    raw = zlib.decompress(bytes(stream), -15)
                except zlib.error:
                    rows.append((ino, None, None, None, None))
                    continue
                found = deflate_parameters(raw, bytes(stream))
                rows.append((ino, len(raw), *((found["level"], found["memory"], found["strategy"]) if found else (None, None, None))))
            yield pd.DataFrame(rows, columns=["ino", "size", "level", "memory", "strategy"]).astype({c: "Int64" for c in ("size", "level", "memory", "strategy")})

    return streams.mapInPandas(search, "ino long, size long, level long, memory long, strategy long")


def _packed(body: bytes, chunk: int, pack: Callable[[bytes], bytes]) -> int:
    """Bytes in whole 4 KiB blocks if each chunk is packed alone."""
    sizes = (len(pack(c)) for c in (body[i : i + chunk] for i in range(0, len(body), chunk)))
    return sum(-(-(n + 8) // 4096) * 4096 for n in sizes)


class Registry:
    """Codecs by name: number, generation, sniffing rules, encode and decode."""

    def __init__(self):
        self._all: dict[str, dict] = {}
        self.packs_allowed = True

    def register(self, name: str, algo: int, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes], generation: int = 1, builtin: bool = False) -> None:
        if not builtin and not self.packs_allowed:
            raise ValueError("packs are switched off")
        if any(c["algo"] == algo and n != name for n, c in self._all.items()):
            raise ValueError(f"number {algo} is taken")
        self._all[name] = {"algo": algo, "encode": encode, "decode": decode, "generation": generation, "builtin": builtin}

    def generation(self) -> int:
        return max((c["generation"] for c in self._all.values()), default=0)

    def names(self) -> list[str]:
        return sorted(self._all)

    def table(self, spark: SparkSession) -> DataFrame:
        """The registry as a table: codec, algo, generation, builtin."""
        rows = [(n, c["algo"], c["generation"], c["builtin"]) for n, c in sorted(self._all.items())]
        return spark.createDataFrame(rows, "codec string, algo int, generation int, builtin boolean")

    def by_algo(self, algo: int) -> str | None:
        return next((n for n, c in self._all.items() if c["algo"] == algo), None)

    def size_udf(self, name: str, chunk: int):
        """A UDF: the footprint of a body packed by a codec in chunks."""
        encode = self._all[name]["encode"]

        @F.pandas_udf(LongType())
        def size(body: pd.Series) -> pd.Series:
            return body.map(lambda b: None if b is None else _packed(b.encode() if isinstance(b, str) else bytes(b), chunk, encode))

        return size

    def roundtrip_udf(self, name: str):
        """A UDF: whether decode gives back what was encoded."""
        encode, decode = self._all[name]["encode"], self._all[name]["decode"]

        @F.pandas_udf(BooleanType())
        def same(body: pd.Series) -> pd.Series:
            raw = body.map(lambda b: b.encode() if isinstance(b, str) else bytes(b or b""))
            return raw.map(lambda b: decode(encode(b)) == b)

        return same


#: Capabilities that a manifest can name.
CAPABILITIES = ("seek", "batched", "wholefile", "container", "external")
_NUMBERS = ("algo", "pack_version", "dec_mem", "generation", "decomp_gen")
_COMMANDS = ("encode", "decode", "estimate", "enumerate", "extract", "strip", "rebuild", "map", "batch")


def parse_hex(text: str) -> bytes:
    """Pairs of hex digits up to the first that is none, at most 16."""
    out = bytearray()
    for i in range(0, min(len(text), 32) - 1, 2):
        try:
            out.append(int(text[i : i + 2], 16))
        except ValueError:
            break
    return bytes(out)


def parse_caps(text: str) -> list[str]:
    """The known capabilities of a list divided by bars, commas or blanks."""
    words = text.replace("|", " ").replace(",", " ").split()
    return [c for c in CAPABILITIES if c in words]


def _number(text: str) -> int:
    """A leading decimal, hex (0x) or octal (0) number, 0 without one."""
    found = re.match(r"[+-]?(?:0[xX][0-9a-fA-F]+|[0-9]+)", text)
    if not found:
        return 0
    digits = found[0].lstrip("+-")
    value = int(digits, 16) if digits[:2].lower() == "0x" else int(digits, 8) if digits[0] == "0" and not set(digits) - set("01234567") else int(digits)
    return -value if found[0][0] == "-" else value


def parse_manifest(text: str) -> dict:
    """A pack's manifest of key = value lines: blank lines, lines that open with '#' or have no '=', and unknown keys are
    passed over. magics are (bytes, offset) pairs: an offset belongs to the magic before it, or to the first one if it
    comes first; at most eight count. commands are templates of arguments."""
    out: dict = {"name": "", "algo": -1, "pack_version": -1, "type": "codec", "caps": [], "commands": {}, "magics": [], "exts": []}
    ahead = 0
    for line in text.splitlines():
        key, eq, value = (part.strip(" \t\r") for part in line.partition("="))
        if not eq or not key or key.startswith("#"):
            continue
        if key in _COMMANDS:
            out["commands"][key] = value
        elif key in _NUMBERS:
            out[key] = _number(value)
        elif key in ("name", "os", "arch", "requires"):
            out[key] = value
        elif key == "type":
            out["type"] = value if value in ("container", "helper") else "codec"
        elif key == "caps":
            out["caps"] = parse_caps(value)
        elif key == "sniff.ext":
            out["exts"] = [e for e in value.split(",") if e]
        elif key in ("blob_ext", "raw_ext"):
            if re.fullmatch(r"\.[A-Za-z0-9]+", value):
                out[key] = value
        elif key == "sibling_tags":
            out["tags"] = [re.split("[#%]", t)[0] for t in value.replace(",", " ").split() if re.split("[#%]", t)[0]]
        elif key == "sniff.magic" and len(out["magics"]) < 8:
            rule = parse_hex(value)
            if rule:
                out["magics"].append((rule, ahead))
            ahead = 0
        elif key == "sniff.offset":
            if out["magics"]:
                out["magics"][-1] = (out["magics"][-1][0], _number(value))
            else:
                ahead = _number(value)
    return out


def _zlib6(b: bytes) -> bytes:
    return zlib.compress(b, 6)


def _same(b: bytes) -> bytes:
    return b


def registry() -> Registry:
    out = Registry()
    out.register("none", 0, _same, _same, builtin=True)
    out.register("zlib", 2, _zlib6, zlib.decompress, builtin=True)
    out.register("bcj-zlib", 3, lambda b: zlib.compress(bcj_x86(b), 6), lambda b: bcj_x86(zlib.decompress(b), False), builtin=True)
    try:
        import zstandard

        out.register("zstd", 1, lambda b: zstandard.ZstdCompressor(19).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b), builtin=True)
    except ImportError:
        pass
    return out


def members_of(body: bytes) -> Iterator[tuple[int, str, int, bytes]]:
    """(idx, name, size, body) of a zip, tar or gzip; nothing for anything else or a broken one."""
    try:
        if body[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            with zipfile.ZipFile(io.BytesIO(body)) as z:
                yield from ((i, m.filename, m.file_size, z.read(m)) for i, m in enumerate(z.infolist()) if not m.is_dir())
        elif body[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(body)) as t:
                yield from ((i, m.name, m.size, t.extractfile(m).read()) for i, m in enumerate(t.getmembers()) if m.isfile())
        elif body[:2] == b"\x1f\x8b":
            raw = gzip.decompress(body)
            yield 0, "data", len(raw), raw
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, RuntimeError):
        return


def entry_of(body: bytes, name: str) -> bytes | None:
    """One member of a container by its name, the first of that name; None without it."""
    return next((raw for _, found, _, raw in members_of(body) if found == name), None)


def entries(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """archives(ino, body) and wanted(ino, name) -> (ino, name, body): the named entries that are there."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, entry_of(bytes(b), n)) for i, b, n in zip(frame.ino, frame.body, frame.name, strict=True)]
            yield pd.DataFrame([r for r in rows if r[2] is not None], columns=["ino", "name", "body"])

    return archives.join(wanted, "ino").select("ino", "body", "name").mapInPandas(scan, "ino long, name string, body binary")


def members(containers: DataFrame) -> DataFrame:
    """containers(ino, body) -> (ino, idx, name, usize, body): the members of zip, tar and gzip files."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(ino, *m) for ino, body in zip(frame.ino, frame.body, strict=True) if body is not None for m in members_of(bytes(body))]
            yield pd.DataFrame(rows, columns=["ino", "idx", "name", "usize", "body"])

    return containers.mapInPandas(scan, "ino long, idx long, name string, usize long, body binary")
