"""Vectorised scanning of Arrow text: word spans and hashes over raw UTF-8, without a Python string a word.

A word's hash mixes its bytes eight at a time with its length, so words of up to seven bytes never share one, and longer
ones do only by chance (no fixed pattern of letters makes two words clash); where a clash would change a result,
same_bytes() settles it. Hashes of runs of words are polynomials over the word hashes, taken from one prefix sum; they
are for short runs. All hashes depend on content alone, never on position.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text is worked on in blocks of about so many bytes, which bounds memory whatever the batch holds.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 3  # odd, and one less than it has a single factor of two
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... mod 2^64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1 << 16, 1 << (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the numbers values[starts:ends) for each span."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(values, _table(_BASE, n)[:n], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    found = (sums[ends] - sums[starts]) * _table(_INVERSE, n + 1)[starts]
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed)


#: Longer words are hashed, or compared, one by one.
_LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers; zeros follow the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[starts:ends) for each span."""
    at, size = _eights(data), ends - starts
    short = size < 8
    # up to seven bytes and their number make one number: no two words share it
    found = np.where(short, size.astype(np.uint64) << np.uint64(56), mix(size.astype(np.uint64), 3))
    found = mix(found ^ (at[starts] & _MASKS[np.minimum(size, 8)]))
    for k in range(8, _LONG, 8):
        more = np.flatnonzero((size > k) & (size <= _LONG))
        if not len(more):
            break
        found[more] = mix(found[more] ^ (at[starts[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]), k)
    for i in np.flatnonzero(size > _LONG).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return found


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size) and data[b : b + size) are equal, for each pair of places."""
    at = _eights(data)
    same = ((at[a] ^ at[b]) & _MASKS[np.minimum(size, 8)]) == 0
    for k in range(8, _LONG, 8):
        more = np.flatnonzero((size > k) & (size <= _LONG))
        if not len(more):
            break
        same[more] &= ((at[a[more] + k] ^ at[b[more] + k]) & _MASKS[np.minimum(size[more] - k, 8)]) == 0
    for i in np.flatnonzero(size > _LONG).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return same


def classes(keep: bytes, lower: bool) -> np.ndarray:
    """A byte map: bytes of words to themselves (A-Z to a-z if lower), all others to 0."""
    to = np.zeros(256, np.uint8)
    for b in keep:
        to[b] = b + 32 if lower and 65 <= b <= 90 else b
    return to


#: Words of letters, digits and all that is beyond ASCII, in lower case.
PLAIN = classes(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), True)
#: Words divided by ASCII white space only, unchanged.
SPACED = classes(bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r"), False)
SPACED[0] = 1  # NUL belongs to words; no other byte maps to 1 but 1 itself, see words()


class Words:
    """The words of a block: first and past-last byte, document (place in the block) and hash of each."""

    __slots__ = ("starts", "ends", "doc", "hash", "n_docs", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, to: np.ndarray):
        mapped = to[data]
        inside = mapped != 0
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = inside
        edges = offsets[1:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[edges] = True
        begin = np.empty(len(data) + 1, bool)
        begin[:-1] = inside & (~before[:-1] | cut[:-1])
        stop = np.zeros(len(data) + 1, bool)
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:] | cut[1:-1]
        self.starts = np.flatnonzero(begin[:-1])
        self.ends = np.flatnonzero(stop)
        self.n_docs = len(offsets) - 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1 if len(self.starts) else np.zeros(0, np.int64)
        if len(self.starts):
            # NUL and 1 would be one letter if the mapped byte were hashed; where case is kept, the data are.
            self.hash = hash_bytes(data if to is SPACED else mapped, self.starts, self.ends)
        else:
            self.hash = np.zeros(0, np.uint64)
        #: For each document, its first word; one more entry at the end.
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hashes of words i..i+k-1 for each i up to len-k; those that cross documents mean nothing."""
        n = len(self.hash)
        at = np.arange(max(0, n - k + 1))
        return hash_spans(self.hash, at, at + k, seed + k)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _tidy() -> None:
    """Gives memory that is free back to the system: workers live on, and their stages follow each other."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes each; a longer document is a block of its own. Memory is tidied up behind
    the last one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    _tidy()


def spans_to_runs(member: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Starts of maximal runs in which member rises by one and each of same stays."""
    if not len(member):
        return np.zeros(0, np.int64)
    new = np.ones(len(member), bool)
    new[1:] = np.diff(member) != 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def groups(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs in which all of same stay."""
    n = len(same[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    lead = np.flatnonzero(new)
    return lead, np.append(lead[1:], n)
