"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The most frequent words of the corpus are compiled, in sorted order, into a minimal acyclic automaton: states with the
same right language are one state, so suffixes are shared, and each arc carries how many words lie before it, so the
sum along a path is the word's rank. Ranks index a table of ready token ids. The automaton and the table are one file in
the shared folder, which each Python worker memory-maps (where that folder is no mounted file system, its bytes are
copied into an anonymous map). A word outside the lexicon is merged exactly by the vocabulary's ranked merges.

Texts of ASCII and Latin letters are cut into words on raw bytes, and each distinct word of a block is looked up
once. Any other text is normalised and cut by the tokenizer's own normaliser and pre-tokenizer; its words then take
the same way. Strings of special tokens in a text are those tokens, as the library has it.

Defined cases: null or empty text has no ids and decodes to an empty text; a null doc_id stays null; repeated rows
each get their own result; other columns are passed over; an empty corpus gives an empty lexicon.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import arrow_path, bounded_batches, new_folder, text_of, written

#: Words in the lexicon: the bound of its file (some 2 MB).
LEXICON_WORDS = 50_000
#: Words merged outside the lexicon that a worker remembers before it starts afresh.
REMEMBERED = 150_000
_BLOCK = 2 * scan.BLOCK_BYTES

#: Texts of these characters alone are cut on bytes: printable ASCII, tab, line ends, Latin letters but the capital
#: dotted I, whose lower case is two characters.
_FAST = re.compile("[^\t\n\r -~À-ÖØ-öø-įı-ňŊ-ſ]")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_LETTERS = byte_letters()


class Merges:
    """A vocabulary's tokens and ranked merges."""

    def __init__(self, tokenizer_json: str):
        parts = json.loads(tokenizer_json)
        model = parts["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}

        pairs = [((self.ids[a] << 32) | self.ids[b], i, self.ids[a + b]) for (a, b), i in self.ranks.items()]
        keys, ranks, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(1, np.int64) - 1] * 3
        order = np.argsort(keys)
        self._keys, self._ranks, self._made = keys[order], ranks[order], made[order]
        self._letters = np.array([self.ids[c] for c in _LETTERS], np.int64)
        self._last = np.array([self.ids[c + self.suffix] for c in _LETTERS], np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Merges the letters of many words at once. At each turn a word's pair of least rank is merged, leftmost
        first where it overlaps itself; words without a ranked pair are done."""
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(words), np.uint8)
        part = self._letters[data]
        part[ends - 1] = self._last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        out: list[list[int]] = [[]] * len(words)
        while len(part):
            inner = word[1:] == word[:-1]
            key = np.where(inner, (part[:-1] << 32) | part[1:], -1)
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            rank = np.where(self._keys[at] == key, self._ranks[at], _NEVER)
            first = np.flatnonzero(np.append(True, ~inner))
            least = np.minimum.reduceat(np.append(rank, _NEVER), first)
            nth = np.cumsum(np.append(True, ~inner)) - 1
            done = least == _NEVER
            if done.any():
                for w, a, b in zip(word[first[done]].tolist(), first[done].tolist(), np.append(first[1:], len(part))[done].tolist(), strict=True):
                    out[w] = part[a:b].tolist()
            hit = np.flatnonzero((rank == least[nth[:-1]]) & (rank != _NEVER))
            if len(hit):
                runs = scan.spans_to_runs(hit)
                hit = hit[(np.arange(len(hit)) - np.repeat(runs, np.diff(np.append(runs, len(hit))))) % 2 == 0]
            keep = ~done[nth]
            part[hit] = self._made[at[hit]]
            keep[hit + 1] = False
            part, word = part[keep], word[keep]
        return out


_NEVER = np.iinfo(np.int64).max


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer of the words, with the ids of each by its rank, as bytes.

    Built from sorted words (Daciuk's incremental method): when the next word leaves a branch, the branch's states are
    replaced by equal registered ones. Layout: counts; for each state the first arc, a final flag; for each arc its
    byte, target and the words before it; then offsets and ids."""
    states: list[list] = [[False, {}]]  # final, arcs
    register: dict[tuple, int] = {}
    path: list[int] = [0]

    def close(depth: int, before: bytes) -> None:
        while len(path) > depth + 1:
            s = path.pop()
            key = (states[s][0], tuple(states[s][1].items()))
            same = register.setdefault(key, s)
            states[path[-1]][1][before[len(path) - 1]] = same

    before = b""
    order = sorted(words)
    for word in order:
        depth = 0
        while depth < min(len(before), len(word)) and before[depth] == word[depth]:
            depth += 1
        close(depth, before)
        for b in word[depth:]:
            states.append([False, {}])
            states[path[-1]][1][b] = len(states) - 1
            path.append(len(states) - 1)
        states[path[-1]][0] = True
        before = word
    close(0, before)
    seen: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack.pop()
        if s not in seen:
            seen[s] = len(seen)
            stack.extend(states[s][1].values())
    reach: dict[int, int] = {}

    def count(top: int) -> int:
        todo = [top]
        while todo:
            s = todo[-1]
            open_ = [t for t in states[s][1].values() if t not in reach]
            if open_:
                todo.extend(open_)
            else:
                reach[s] = states[s][0] + sum(reach[t] for t in states[s][1].values())
                todo.pop()
        return reach[top]

    count(0)
    first, final, label, target, skip = [0], [], [], [], []
    for s in seen:
        n = int(states[s][0])
        final.append(n)
        for b, t in sorted(states[s][1].items()):
            label.append(b)
            target.append(seen[t])
            skip.append(n)
            n += reach[t]
        first.append(len(label))
    ids = [words[w] for w in order]
    ends = np.cumsum([0, *map(len, ids)])
    arrays = (np.array(first, np.int32), np.array(final, np.int32), np.array(label, np.int32), np.array(target, np.int32), np.array(skip, np.int32), ends.astype(np.int32), np.array([i for x in ids for i in x], np.int32))
    return struct.pack("<7i", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, read in place from a mapped file, or from bytes."""

    def __init__(self, compiled: str | bytes):
        """compiled: the file's address, or what it holds."""
        from pyarrow.fs import FileSystem, LocalFileSystem

        if isinstance(compiled, str):
            store, path = FileSystem.from_uri(compiled)
            if isinstance(store, LocalFileSystem):
                with open(path, "rb") as file:
                    self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            else:
                with store.open_input_file(path) as file:
                    compiled = file.read()
        if isinstance(compiled, bytes):
            self._map = mmap.mmap(-1, len(compiled))
            self._map[:] = compiled
        at, views = 28, []
        for n in struct.unpack_from("<7i", self._map):
            views.append(memoryview(self._map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.final, self.label, self.target, self.skip, self.ends, self.ids = views

    def rank(self, word: bytes) -> int:
        """The word's place in sorted order, or -1."""
        state, rank = 0, 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for b in word:
            lo, hi = first[state], first[state + 1]
            while lo < hi:
                mid = (lo + hi) >> 1
                if label[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == first[state + 1] or label[lo] != b:
                return -1
            rank += skip[lo]
            state = target[lo]
        return rank if self.final[state] else -1

    def lookup(self, word: bytes) -> list[int] | None:
        r = self.rank(word)
        return None if r < 0 else self.ids[self.ends[r] : self.ends[r + 1]].tolist()


def cut_latin(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans of lower-cased texts of the fast alphabet: letters, single digits, other runs; an apostrophe alone
    takes the s, t, re, ve, m, ll or d that follows."""
    kind = np.full(256, 3, np.uint8)
    kind[[9, 10, 13, 32]] = 0
    kind[48:58] = 2
    kind[97:123] = 1
    kind[128:] = 1
    n = len(data)
    k = np.zeros(n + 4, np.uint8)
    k[:n] = kind[data]
    edge = np.zeros(n + 4, bool)
    edge[offsets] = True
    start = edge.copy()
    start[1:] |= k[1:] != k[:-1]
    start |= k == 2
    start[0] = True
    quote = np.flatnonzero((data == 39) & start[:n] & (k[1 : n + 1] == 1) & ~edge[1 : n + 1])
    if len(quote):
        d = np.zeros(n + 4, np.uint8)
        d[:n] = data
        a, b = d[quote + 1], d[quote + 2]
        b = np.where(edge[quote + 2], 0, b)
        one = np.isin(a, list(b"stmd"))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        take = np.where(one, 1, np.where(two, 2, 0))
        hit = take > 0
        start[quote[hit] + 1] = False
        after = quote[hit] + 1 + take[hit]
        start[after] |= (k[after] == 1) | edge[after]
    begins = np.flatnonzero(start[:n] & (k[:n] > 0))
    stops = np.append(np.flatnonzero(start[:n]), n)
    return begins, stops[np.searchsorted(stops, begins, "right")]


class Coder:
    """Encodes and decodes texts on a worker."""

    def __init__(self, compiled: str | bytes, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.merges, self.lexicon = Merges(tokenizer_json), Lexicon(compiled)
        self.own = Tokenizer.from_str(tokenizer_json)
        self.known: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None

    def words(self, words: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        """Of each word the ids as bytes, the decoded text and how many ids."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(dict.fromkeys(words))
        unseen = []
        for w in new:
            ids = self.lexicon.lookup(w)
            if ids is None:
                unseen.append(w)
            else:
                known[w] = self.packed(ids)
        if unseen:
            known.update(zip(unseen, map(self.packed, self.merges.encode(unseen)), strict=True))
        return [known[w] for w in words]

    def packed(self, ids: list[int]) -> tuple[bytes, bytes, int]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(self.merges.tokens[i] for i in ids).encode(), len(ids)

    def any_text(self, text: str) -> list[tuple[bytes, bytes, int]]:
        """A text's words by the tokenizer's own normaliser and pre-tokenizer."""
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.merges.special:
                out.append(self.packed([self.merges.special[part]]))
            elif part:
                cut = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(part))
                out += self.words([bytes(_LETTERS_BACK[c] for c in w) for w, _ in cut])
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, int]]:
        """For each text its ids as bytes, its decoded text and how many ids."""
        fast = [not _FAST.search(t) and not (self.special and self.special.search(t)) for t in texts]
        lower = [t.lower().encode() if ok else b"" for t, ok in zip(texts, fast, strict=True)]
        data = np.frombuffer(b"".join(lower), np.uint8)
        offsets = np.append(0, np.cumsum([len(x) for x in lower])).astype(np.int64)
        codes, pieces, place, edges = [], [], None, np.zeros(len(texts) + 1, np.int64)
        if len(data):
            begins, stops = cut_latin(data, offsets)
            found, first, place = np.unique(scan.hash_bytes(data, begins, stops), return_index=True, return_inverse=True)
            raw, size, lead = data.tobytes(), stops - begins, first[place]
            other = np.flatnonzero((size != size[lead]) | ~scan.same_bytes(data, begins, begins[lead], size))
            if len(other):  # words that share a hash with another word: each is a word of its own
                place[other] = len(first) + np.arange(len(other))
                first = np.append(first, other)
            pieces = self.words([raw[a:b] for a, b in zip(begins[first].tolist(), stops[first].tolist(), strict=True)])
            edges = np.searchsorted(begins, offsets)
            codes = place.tolist()
        for i, ok in enumerate(fast):
            own = [pieces[c] for c in codes[edges[i] : edges[i + 1]]] if ok else self.any_text(texts[i])
            yield b"".join([p[0] for p in own]), b" ".join([p[1] for p in own]), sum([p[2] for p in own])


_LETTERS_BACK = {c: b for b, c in enumerate(_LETTERS)}


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of the whole corpus, at most words of them. Counted by Spark's own functions with
    partial sums before the shuffle. A histogram of the counts gives the count from which all words fit; of the words
    in the step below it those least by a hash fill up the rest, so that ties never empty the lexicon."""
    cut = F.regexp_extract_all(F.lower(text_of()), F.lit(r"\p{L}+"), F.lit(0))
    counted = docs.select(F.explode_outer(cut).alias("word")).where("length(word) between 1 and 64").groupBy("word").count()
    counts = written(counted.where("count > 1"), "word-counts")
    # 64 steps an octave: some 2,500 rows at most
    step = F.floor(F.log2("count") * 64).cast("int")
    total, below = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if total + row.n > words:
            below = row.step
            break
        total += row.n
    above = counts.where(step > below) if below is not None else counts
    found = [r.word for r in above.select("word").collect()]  # at most words
    if below is not None and total < words:
        found += [r.word for r in counts.where(step == below).orderBy(F.desc("count"), F.xxhash64("word"), "word").limit(words - total).select("word").collect()]
    return sorted(w.encode() for w in found)


def build(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> tuple[str, str]:
    """The address of the corpus's compiled lexicon for a tokenizer file, and the file's text."""
    from pyarrow.fs import FileSystem

    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as file:
        tokenizer_json = file.read()
    merges = Merges(tokenizer_json)
    found = frequent_words(docs, words)
    address = arrow_path(spark, new_folder(spark, "lexicon")) + "/words"
    store, path = FileSystem.from_uri(address)
    with store.open_output_stream(path) as file:
        file.write(compile_lexicon(dict(zip(found, merges.encode(found), strict=True))))
    return address, tokenizer_json


_coders: dict[str, Coder] = {}


def _coder(compiled: str, tokenizer_json: str) -> Coder:
    key = hashlib.sha256((compiled + tokenizer_json).encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(compiled, tokenizer_json)
    return _coders[key]


def _encode(model, whole: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*model.value)
        for batch in batches:
            offsets, _ = scan.utf8(batch.column("text"))
            for i, j in scan.blocks(offsets, _BLOCK):
                ids, decoded, counts = [], [], []
                for a, b, n in coder.texts(batch.column("text").slice(i, j - i).to_pylist()):
                    ids.append(a if whole else hashlib.sha256(a).hexdigest())
                    decoded.append(b if whole else hashlib.sha256(b).hexdigest())
                    counts.append(n)
                kind = pa.binary() if whole else pa.string()
                text = pa.array(decoded, kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(counts, pa.int64()), pa.array(ids, kind), text.cast(pa.string()) if whole else text], ["doc_id", "n_tokens", "ids", "decoded"])

    return encode


def encoded(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(build(rows, tokenizer, words))
    return rows.mapInArrow(_encode(model, True), "doc_id long, n_tokens long, ids binary, decoded string")


def digest(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> DataFrame:
    """The contract's columns; ids and texts are hashed where they are made, so they need not leave the worker."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(build(rows, tokenizer, words))
    return rows.mapInArrow(_encode(model, False), "doc_id long, n_tokens long, ids string, decoded string").withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
