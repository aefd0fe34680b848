"""Language of web pages by fusing evidence.

log P(l | page) = log prior(l | host) + text evidence + log P(declared | l) + log P(address part | l), up to a constant.

* Text: byte trigrams of the visible text under smoothed trigram models, one a language, learned from at most SAMPLE
  documents (the least by a hash of doc_id) and their lang; the mean log likelihood counts as TEXT_WEIGHT trigrams,
  so a long text does not drown the rest.
* Declared: the two letters of the html element's lang attribute; address: the two letters that may open the path.
  Their likelihoods come from counts over all pages. No page's language is taken as known: it counts for each language
  with the probability that its text alone gives it, so a page with little text says little.
* Host priors: such counts by grouped aggregation over all pages, smoothed from level to level: all pages, address
  suffix, site (last two labels of the host), host. A page's own count is taken out of its prior.

Counts are grouped with partial sums and joined back by key, one row a key; nothing but the trigram models (one for
each language of the sample) and the tables of two-letter codes (at most 676 rows) is sent to all.

Defined cases: null or empty html has no text and no declaration; null url has an empty host; a page without any
evidence gets the language most pages have; without labelled documents every page is "und"; rows with one page_id are
scored each by its own; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import bounded_batches, text_of, written

SAMPLE = 4_000
SLOT_BITS = 14
TEXT_WEIGHT = 30.0
#: Pages that a parent level counts for in a host's, site's or suffix's prior.
PARENT = 5.0
ALPHA = 0.5
UNKNOWN = "und"


def trigrams(words: scan.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of the byte trigrams of lower-cased words, each with a blank on either side."""
    mapped = scan.PLAIN[data].astype(np.uint64)
    n = len(mapped)
    if n < 3 or not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (mapped[:-2] << np.uint64(16)) | (mapped[1:-1] << np.uint64(8)) | mapped[2:]
    slot = (scan.mix(code, 21) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
    inside = mapped[1:-1] != 0
    doc = np.repeat(np.arange(words.n_docs), np.diff(np.searchsorted(np.arange(n), words.edges)))[:-2]
    return doc[inside], slot[inside]


class _Text(scan.Words):
    __slots__ = ("edges",)

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, scan.PLAIN)
        self.edges = offsets


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, sums = 1 << SLOT_BITS, {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        offsets, data = scan.utf8(batch.column("text"))
        for i, j in scan.blocks(offsets):
            own = data[offsets[i] : offsets[j]]
            doc, slot = trigrams(_Text(own, offsets[i : j + 1] - offsets[i]), own)
            for lang in set(langs[i:j]):
                at = np.array([x == lang for x in langs[i:j]])
                sums[lang] = sums.get(lang, 0) + np.bincount(slot[at[doc]], minlength=size)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())})


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Log probabilities of the trigram slots in each language."""
    good = docs.where("lang is not null and text is not null and doc_id is not null")
    picked = good.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # the sample is at most SAMPLE ids
    rows = good.join(F.broadcast(picked.distinct()), F.col("doc_id") == F.col("_id")).select(F.lower("lang").alias("lang"), "text").coalesce(16)
    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(_counts, "lang string, counts binary").collect():  # at most 16 rows a language
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    return {k: np.log((sums[k] + 0.1) / (sums[k].sum() + 0.1 * len(sums[k]))).astype(np.float32) for k in sorted(sums)}


def _likely(models):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.stack(list(models.value.values()), 1)
        for batch in batches:
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            offsets, data = scan.utf8(batch.column("text"))
            parts = [np.zeros((0, table.shape[1]))]
            for i, j in scan.blocks(offsets):
                own = data[offsets[i] : offsets[j]]
                doc, slot = trigrams(_Text(own, offsets[i : j + 1] - offsets[i]), own)
                n = np.bincount(doc, minlength=j - i)
                sums = np.stack([np.bincount(doc, table[slot, k], j - i) for k in range(table.shape[1])], 1)
                parts.append(sums / np.maximum(n, 1)[:, None] * np.minimum(n, TEXT_WEIGHT)[:, None])
            scores = np.concatenate(parts)
            edges = pa.array(np.arange(0, scores.size + 1, table.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.ListArray.from_arrays(edges, pa.array(scores.ravel()))], [*(batch.schema.names[i] for i in rest), "text_score"])

    return likely


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments, tags and entities."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"&#?[A-Za-z0-9]+;", " ")


def _argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def _softmax(name: str) -> Column:
    shares = F.transform(name, lambda x: F.exp(x - F.array_max(name)))
    return F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, lang, confidence, text_lang, declared)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    models = train(docs, sample)
    if not models:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(UNKNOWN).alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    langs = list(models)
    k = len(langs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    code = lambda x: F.when(x != "", F.lower(x))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        code(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})\b", 1)).alias("declared"),
        code(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)).alias("segment"),
        visible(text_of("html")).alias("text"),
    )
    kinds = "page_id long, host string, site string, suffix string, declared string, segment string, text_score array<double>"
    likely = rows.mapInArrow(_likely(spark.sparkContext.broadcast(models)), kinds)
    scored = written(likely.withColumn("by_text", _softmax("text_score")), "page-evidence")

    def counts(*keys: str) -> DataFrame:
        return scored.groupBy(*keys).agg(F.array(*[F.sum(F.col("by_text")[i]) for i in range(k)]).alias("counts"))

    total = [c or 0.0 for c in counts().first().counts]
    all_pages = F.array(*[F.lit((c + 1.0) / (sum(total) + k)) for c in total])
    out = scored.withColumn("prior", all_pages)
    for level in ("suffix", "site", "host"):
        found = counts(level).select(F.col(level).alias("_key"), F.col("counts").alias("_counts"))
        # sums of the same numbers in another order may differ in their last digits
        rest = F.zip_with("_counts", "by_text", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate("_rest", F.lit(0.0), lambda a, b: a + b)
        out = out.join(found, F.col(level) == F.col("_key")).withColumn("_rest", rest).withColumn("_size", size)
        out = out.withColumn("prior", F.zip_with("_rest", "prior", lambda n, p: (n + PARENT * p) / (F.col("_size") + PARENT))).drop("_key", "_counts", "_rest", "_size")
    sums = F.array(*[F.lit(float(c)) for c in total])
    for name in ("declared", "segment"):
        found = counts(name).where(F.col(name).isNotNull()).select(F.col(name).alias("_code"), F.col("counts").alias("_seen"))
        out = out.join(F.broadcast(found), F.col(name) == F.col("_code"), "left")  # at most 676 codes
        likely = F.zip_with("_seen", sums, lambda n, t: F.log((n + ALPHA) / (t + ALPHA * 676)))
        out = out.withColumn(f"_{name}", F.when(F.col("_code").isNotNull(), likely).otherwise(F.array_repeat(F.lit(0.0), k))).drop("_code", "_seen")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joint = add(add(F.transform("prior", lambda p: F.log(p)), F.col("text_score")), add(F.col("_declared"), F.col("_segment")))
    out = out.withColumn("joint", joint)
    mass = F.aggregate("joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("joint")))
    name = lambda i: F.get(F.array(*map(F.lit, langs)), i)
    return out.select("page_id", name(_argmax(F.col("joint"))).alias("lang"), (1 / mass).alias("confidence"), name(_argmax(F.col("text_score"))).alias("text_lang"), "declared")


def brute_force(pages: list[tuple], models: dict[str, np.ndarray]) -> list[tuple]:
    """The definition read literally, for tests: (page_id, lang, confidence, text_lang, declared) of (page_id, url, html)."""
    import math
    import re
    from collections import defaultdict

    langs = list(models)

    def softmax(x: list[float]) -> list[float]:
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    facts = []
    for page, url, html in pages:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html or "")
        text = re.sub(r"&#?[A-Za-z0-9]+;", " ", re.sub(r"(?s)<[^>]*>", " ", text)).encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in text)
        codes = [low[i] << 16 | low[i + 1] << 8 | low[i + 2] for i in range(len(low) - 2) if low[i + 1]]
        slots = [int(h) & ((1 << SLOT_BITS) - 1) for h in scan.mix(np.array(codes, np.uint64), 21)]
        n = len(slots)
        score = [sum(float(models[k][s]) for s in slots) / max(n, 1) * min(n, TEXT_WEIGHT) for k in langs]
        host = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "") or [""] * 2)[1].lower()
        site, suffix = ((re.search(p, host) or [""] * 2)[1] for p in (r"([^.]+\.[^.]+)$", r"([^.]+)$"))
        declared = (re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})\b", html or "") or [""] * 2)[1].lower() or None
        segment = (re.match(r"(?i)[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", url or "") or [""] * 2)[1].lower() or None
        facts.append((page, {"host": host, "site": site, "suffix": suffix, "declared": declared, "segment": segment}, score, softmax(score)))
    seen = {c: defaultdict(lambda: [0.0] * len(langs)) for c in ("host", "site", "suffix", "declared", "segment")}
    total = [0.0] * len(langs)
    for _, own, _, p in facts:
        total = [a + b for a, b in zip(total, p, strict=True)]
        for c, v in own.items():
            seen[c][v] = [a + b for a, b in zip(seen[c][v], p, strict=True)]
    out = []
    for page, own, score, p in facts:
        prior = [(c + 1) / (sum(total) + len(langs)) for c in total]
        for level in ("suffix", "site", "host"):
            rest = [max(a - b, 0.0) for a, b in zip(seen[level][own[level]], p, strict=True)]
            prior = [(n + PARENT * q) / (sum(rest) + PARENT) for n, q in zip(rest, prior, strict=True)]
        joint = [math.log(q) + s for q, s in zip(prior, score, strict=True)]
        for c in ("declared", "segment"):
            if own[c]:
                joint = [j + math.log((n + ALPHA) / (t + ALPHA * 676)) for j, n, t in zip(joint, seen[c][own[c]], total, strict=True)]
        best = softmax(joint)
        out.append((page, langs[joint.index(max(joint))], max(best), langs[score.index(max(score))], own["declared"]))
    return out
