"""I-Match document fingerprints.

Document frequencies of all terms are counted over the whole corpus; terms whose inverse document frequency lies in a
chosen band form the lexicon. A text's distinct lexicon terms are sorted and hashed once for each of REPEATS x LEVELS
randomised sub-lexicons. In each repeat the sub-lexicons divide the lexicon at random, level l with a share of 2^-(l+1)
of it, so a text of any length has sub-lexicons from which it holds one or a few terms: those hashes survive a large
edit, those of the big ones only a small one, and the share of equal hashes is a graded likeness.

Terms stand for themselves by 64-bit hashes, by which they are also sorted. The texts' terms are joined to the lexicon
by key: it is broadcast if it has at most BROADCAST_TERMS terms, else joined by shuffle. All on Spark's own functions; no
Python runs on the executors.

Defined cases: null text is empty; a text with fewer than LEAST_TERMS lexicon terms is fingerprinted by all its terms;
a text without terms has an empty part everywhere and is like only another such text (1), no other (0); a null
doc_id sorts first; rows with one doc_id follow each other in the order of a hash of their texts; with a single document the
next document is itself; other columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import held, id_back, id_key, shuffle_parts, text_of, written

#: The band: terms in more than N^LOW_POWER and at most N^HIGH_POWER of N documents (idf / ln N from 0.1 to 0.9).
LOW_POWER, HIGH_POWER = 0.1, 0.9
#: Some 64 MB as a hashed relation.
BROADCAST_TERMS = 1_000_000
REPEATS, LEVELS = 6, 10
LEAST_TERMS = 4
#: Documents a range of doc_ids holds on average.
RANGE_DOCS = 20_000

_EMPTY = "----"
_SPLIT = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: letters, digits and all beyond ASCII, in lower case."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), _SPLIT), ""), lambda t: F.xxhash64(t)))


def lexicon(texts: DataFrame) -> DataFrame:
    """(term, known): the terms of texts(text) in the band, known being true; written."""
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = texts.count()
    low, high = n**LOW_POWER, n**HIGH_POWER
    return written(counts.where((F.col("df") > low) & (F.col("df") <= max(high, low + 1))).select("term", F.lit(True).alias("known")), "lexicon")


def fingerprint(found: Column) -> Column:
    """REPEATS x LEVELS four-digit hashes of a text, as an array, from its terms as (term, known)."""
    chosen = F.filter(found, lambda x: x["known"])
    kept = F.when(F.size(chosen) >= LEAST_TERMS, chosen).otherwise(found)
    one = lambda share: F.when(F.size(share) == 0, _EMPTY).otherwise(F.substring(F.lpad(F.hex(F.xxhash64(share)), 16, "0"), 1, 4))

    def levels(rest: Column, repeat: int, level: int = 0) -> Column:
        """Level l has the terms whose field has its lowest one at bit l; what is left goes on to the next level."""
        bit = 1 << (10 * repeat + level)
        own = F.array(one(F.filter(rest, lambda h: h.bitwiseAND(F.lit(bit)) != 0)))
        if level == LEVELS - 1:
            return own
        return F.concat(own, held(F.filter(rest, lambda h: h.bitwiseAND(F.lit(bit)) == 0), lambda left: levels(left, repeat, level + 1)))

    return held(F.array_sort(F.transform(kept, lambda x: x["term"])), lambda hashes: F.concat(*[levels(hashes, r) for r in range(REPEATS)]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among those that either text has."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.filter(both, lambda x: (x["a"] != _EMPTY) | (x["b"] != _EMPTY))
    equal = F.size(F.filter(either, lambda x: x["a"] == x["b"])).cast("double")
    return F.when(F.size(either) == 0, F.lit(1.0)).otherwise(equal / F.size(either))


class Ranges:
    """Ranges of about RANGE_DOCS rows in the order of doc_id, hash of the text, text. A range begins with a doc_id or,
    within a doc_id of very many rows, with a hash. Their number grows with the rows, one pair of numbers each."""

    def __init__(self, docs: DataFrame):
        found = docs.agg(F.count("*").alias("n"), F.min("doc").alias("least")).first()
        n = max(shuffle_parts(docs.sparkSession), math.ceil(found.n / RANGE_DOCS))
        self.least, many = found.least, found.n / n
        self.cuts, self.hot = [], []
        if not found.n or n < 2:
            return
        cuts = docs.agg(F.percentile_approx("doc", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("cuts")).first().cuts
        # a doc_id of more rows than a range has at least one cut, or is the least
        big = docs.where(F.col("doc").isin(sorted({*cuts, found.least})) if n <= 200 else F.lit(True)).groupBy("doc").count().where(F.col("count") > 2 * many)
        parts = {r.doc: math.ceil(r["count"] / many) for r in big.collect()}
        if parts:
            share = F.create_map(*[F.lit(x).cast("long") for d, k in parts.items() for x in (d, 2**64 // k // 2)])[F.col("doc")]
            # halves, so that no number exceeds a long
            part = F.floor((F.shiftright("hash", 1) + F.lit(2**62)) / share)
            firsts = docs.where(F.col("doc").isin(list(parts))).groupBy("doc", part.alias("part")).agg(F.min("hash").alias("hash"))
            self.hot = sorted((r.doc, r.hash) for r in firsts.collect())
        self.cuts = sorted({c for c in cuts if c > found.least and c not in parts})

    def dealt(self, docs: DataFrame) -> DataFrame:
        """docs with range and guest: each row in its range, and the first row of a range also behind the range before."""
        least_hot = [s for s in self.hot if s[0] == self.least]
        starts = sorted([*((c, -(2**63)) for c in self.cuts), *(s for s in self.hot if s not in least_hot[:1])])
        pair = F.struct(F.col("doc"), F.col("hash"))
        pairs = lambda xs: F.array(*[F.struct(F.lit(d).cast("long"), F.lit(h).cast("long")) for d, h in xs])
        own = F.lit(0)
        if starts:
            step = math.isqrt(len(starts)) + 1
            groups = [starts[i : i + step] for i in range(0, len(starts), step)]
            below = lambda xs: F.size(F.filter(xs, lambda c: c <= pair))
            group = below(pairs([g[0] for g in groups]))
            inner = F.get(F.array(*map(pairs, groups)), group - 1)
            own = F.when(group == 0, 0).otherwise((group - 1) * step + below(inner))
        place = lambda r, guest: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"))
        first = (F.col("doc") == F.lit(self.least)) & (F.col("hash") == F.lit(least_hot[0][1]) if least_hot else F.lit(True))
        copies = F.when(first, F.array(place(own, False), place(F.lit(len(starts)), True)))
        opens = F.col("doc").isin(self.cuts) if self.cuts else F.lit(False)
        if self.hot:
            opens = opens | pair.isin([F.struct(F.lit(d).cast("long"), F.lit(h).cast("long")) for d, h in self.hot])
        copies = copies.when(opens, F.array(place(own, False), place(own - 1, True)))
        return docs.withColumn("at", F.explode(copies.otherwise(F.array(place(own, False))))).select("at.range", "at.guest", *docs.columns)


def _order():
    return Window.partitionBy("range").orderBy("guest", "doc", "hash", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = docs.select(id_key().alias("doc"), text_of().alias("text"))
    known = lexicon(rows)
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    # a first row stands behind the range before it, too, so each row has its next one in its range
    pairs = Ranges(hashed).dealt(hashed).withColumn("nth", F.row_number().over(_order())).withColumn("next_text", F.lead("text").over(_order()))
    edited = pairs.select("range", "nth", "guest", "doc", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited"))
    facts = F.struct("doc", "guest", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    # each distinct term of the text and the edited text is a row, and the facts are one
    none = F.lit(None).cast("long")
    each = edited.select("range", "nth", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("of"), none.alias("term"), facts.alias("facts"))),
        *[_tagged(terms(F.col(c)), k) for k, c in ((1, "text"), (2, "edited"))],
    )).alias("x")).select("range", "nth", "x.*")
    found = each.join(known, "term", "left").withColumn("one", F.struct("term", F.coalesce("known", F.lit(False)).alias("known")))
    of = lambda k: fingerprint(F.collect_list(F.when(F.col("of") == k, F.col("one"))))
    both = found.groupBy("range", "nth").agg(F.max("facts").alias("facts"), of(1).alias("print"), of(2).alias("edited_print"))
    # the next print stands in the next row of the range
    nexts = both.withColumn("next_print", F.lead("print").over(Window.partitionBy("range").orderBy("nth"))).where("not facts.guest")
    return nexts.select(
        id_back("facts.doc").alias("doc_id"),
        "facts.n_chars",
        "facts.edited_sha256",
        F.array_join("print", "").alias("fingerprint"),
        F.array_join("edited_print", "").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def _tagged(found: Column, of: int) -> Column:
    return F.transform(found, lambda t: F.struct(F.lit(of).alias("of"), t.alias("term"), F.lit(None).cast(_FACTS).alias("facts")))


_FACTS = "struct<doc:bigint,guest:boolean,n_chars:bigint,edited_sha256:string>"


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The definition read literally, for tests: the contract's columns of each row, in order."""
    import hashlib
    import re
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted((((-(2**63) if d is None else d), t or "") for d, t in docs), key=lambda r: (r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    cut = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split("[^a-z0-9\x80-\U0010ffff]+", t.lower()) if w}
    df: dict[int, int] = {}
    for _, t in rows:
        for w in cut(t):
            df[w] = df.get(w, 0) + 1
    low, high = len(rows) ** LOW_POWER, len(rows) ** HIGH_POWER
    known = {w for w, k in df.items() if low < k <= max(high, low + 1)}

    def parts(t: str) -> list[str]:
        own = cut(t)
        kept = sorted(own & known if len(own & known) >= LEAST_TERMS else own)
        out = []
        for r in range(REPEATS):
            for k in range(LEVELS):
                share = [h for h in kept if (h >> (10 * r)) & ((2 << k) - 1) == 1 << k]
                seed = 42
                for h in share:
                    seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
                out.append(f"{seed:016X}"[:4] if share else _EMPTY)
        return out

    def like(a: list[str], b: list[str]) -> float:
        either = [x == y for x, y in zip(a, b, strict=True) if x != _EMPTY or y != _EMPTY]
        return sum(either) / len(either) if either else 1.0

    out = []
    for i, (d, t) in enumerate(rows):
        other, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        a, b, c = parts(t), parts(edited), parts(other)
        out.append((None if d == -(2**63) else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c)))
    return out
