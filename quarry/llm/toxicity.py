"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(b + sum of w_t + sum over pairs <v_t, v_u>) over the distinct terms of a text, so a pair of terms
(an insult and a group mention) has a weight of its own even where each alone is harmless. Terms are hashed to
2^SLOT_BITS slots; slots too rare in the sample to be learned from weigh nothing. Of the others those are fitted
whose own rows, or whose common rows with another slot, are toxic more or less often than chance has it; all pairs of
slots are looked at, so two terms that tell nothing alone are fitted if they do together.

The model is fitted on at most SAMPLE labelled rows, the least by a hash of doc_id, none of them held out
(crc32 of doc_id as text, mod 5, is 0); of several rows with one doc_id, on the least by a hash of the text. That bound is the only limit: every document is scored over its whole text,
and only the model (a few MB, whatever the input) goes to the executors.

Defined cases: null or empty text has no terms and gets the sigmoid of the bias; without both labels in the sample
every score is the sample's share of toxic rows (0 without rows); labels other than 0 and 1, and labels of a null
doc_id, are passed over; of several labels for a doc_id the largest counts; rows with the same doc_id are scored
each by its own text; null doc_id is not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import bounded_batches, text_of

SAMPLE = 16_000
SLOT_BITS = 18
FACTORS = 8
LEAST_ROWS = 5
#: The chance that any pair of slots without an interaction is taken for one with.
PAIR_ODDS = 0.05
EPOCHS = 40
_MASK = np.uint64((1 << SLOT_BITS) - 1)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out_by_hand(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def slots(words: scan.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) of a block, in document order."""
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((words.doc.astype(np.uint64) << np.uint64(SLOT_BITS)) | (words.hash & _MASK))
    return (both >> np.uint64(SLOT_BITS)).astype(np.int64), (both & _MASK).astype(np.int64)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = scan.utf8(batch.column("text"))
        for i, j in scan.blocks(offsets):
            doc, slot = slots(scan.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], scan.PLAIN))
            edges = np.searchsorted(doc, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["toxic", "slots"])


class Machine:
    """The fitted model: bias, a weight and a vector for each slot that is learned from."""

    def __init__(self, bias: float, known: np.ndarray, weight: np.ndarray, vectors: np.ndarray):
        self.bias, self.known, self.weight, self.vectors = bias, known, weight, vectors

    def margins(self, n_docs: int, doc: np.ndarray, slot: np.ndarray) -> np.ndarray:
        at = self.known[slot]
        doc, at = doc[at >= 0], at[at >= 0]
        out = self.bias + np.bincount(doc, self.weight[at], n_docs)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[at, f]
            out += (np.bincount(doc, v, n_docs) ** 2 - np.bincount(doc, v * v, n_docs)) / 2
        return out


def _surprise(toxic: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minus the log of a bound (Chernoff's) on the chance of so many toxic rows of n, or so few, if the share of toxic
    rows is anywhere from low to high."""
    share = toxic / n
    of = np.clip(share, low, high)
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(share > 0, share * np.log(share / of), 0)
        none = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - of)), 0)
    return n * (one + none)


def _rows_with(slot: np.ndarray) -> np.ndarray:
    """Rows of each slot, counted in parts: a count of all at once would need the slots once more, twice as wide."""
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for i in range(0, len(slot), 1 << 19):
        out += np.bincount(slot[i : i + (1 << 19)], minlength=1 << SLOT_BITS)
    return out


def paired(label: np.ndarray, doc: np.ndarray, slot: np.ndarray, often: np.ndarray) -> np.ndarray:
    """doc is in order. The slots of all pairs whose common rows are toxic more, or less, often than the base rate and the rates of both
    slots leave to chance, at PAIR_ODDS for all pairs together. Every pair of the slots in often counts: a pair is as
    surprising as its toxic common rows, or its others, allow, so slots with too few of either for any partner are left
    out without loss, and common rows of the others are counted by products of their incidence matrices."""
    is_toxic = label > 0
    rows_with, toxic_with = _rows_with(slot)[often], _rows_with(slot[is_toxic[doc]])[often]
    base, n = label.mean(), len(often)
    least = np.log(max(n, 2) ** 2 / 2 / PAIR_ODDS)
    most_bad, most_good = least / -np.log(base), least / -np.log(1 - base)
    can = (toxic_with >= most_bad) | (rows_with - toxic_with >= most_good)
    often, rate = often[can], (toxic_with / rows_with)[can]
    n = len(often)
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    place[often] = np.arange(n)
    at = place[slot]
    doc, at = doc[at >= 0], at[at >= 0]
    edges = np.searchsorted(doc, np.arange(0, len(label) + _ROWS, _ROWS))
    kept = np.zeros(n, bool)
    for t in range(0, n, _SLOTS):
        own = min(t + _SLOTS, n)
        # each pair once: with the slots from t on
        common, bad = np.zeros((own - t, n - t), np.float32), np.zeros((own - t, n - t), np.float32)
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            there = np.zeros((min(_ROWS, len(label) - k * _ROWS), n - t), np.float32)
            use = at[a:b] >= t
            there[doc[a:b][use] - k * _ROWS, at[a:b][use] - t] = 1
            toxic = there[is_toxic[k * _ROWS : k * _ROWS + len(there)]]
            common += there[:, : own - t].T @ there
            bad += toxic[:, : own - t].T @ toxic
        one, two = np.nonzero((common >= LEAST_ROWS) & ((bad >= most_bad) | (common - bad >= most_good)))
        after = two > one
        one, two = one[after], two[after]
        low = np.minimum(np.minimum(rate[one + t], rate[two + t]), base)
        high = np.maximum(np.maximum(rate[one + t], rate[two + t]), base)
        found = _surprise(bad[one, two].astype(np.float64), common[one, two].astype(np.float64), low, high) > least
        kept[one[found] + t] = True
        kept[two[found] + t] = True
    return often[kept]


#: Rows and slots of a block of an incidence matrix.
_ROWS, _SLOTS = 512, 256


def fit(rows: list[tuple[int, bytes]], seed: int = 7) -> Machine:
    """Batch gradient steps (Adam) on the logistic loss with decay; rows are (label, packed slots)."""
    size = 1 << SLOT_BITS
    label = np.array([r[0] for r in rows], np.float64)
    parts = [np.frombuffer(r[1], np.int32) for r in rows]
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        return Machine(float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0), np.full(size, -1), np.zeros(0), np.zeros((0, FACTORS)))
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    slot = np.concatenate(parts)
    # a slot is worth learning if its share of toxic rows, or that of a pair it is in, is not what chance makes of the base rate
    rows_with, toxic_with = _rows_with(slot), _rows_with(slot[(label > 0)[doc]])
    base = label.mean()
    odd = np.abs(toxic_with - base * rows_with) / np.sqrt(base * (1 - base) * np.maximum(rows_with, 1))
    often = np.flatnonzero(rows_with >= LEAST_ROWS)
    use = np.union1d(often[odd[often] > 4.5], paired(label, doc, slot, often))
    known = np.full(size, -1)
    known[use] = np.arange(len(use))
    at = known.astype(np.int32)[slot]
    doc, at = doc[at >= 0], at[at >= 0]
    del slot, parts
    random = np.random.Generator(np.random.PCG64(seed))
    bias, weight, vectors = np.log(base / (1 - base)), np.zeros(len(use)), random.normal(0, 0.05, (len(use), FACTORS))
    state = [np.zeros(1), np.zeros_like(weight), np.zeros_like(vectors)]
    power = [np.zeros(1), np.zeros_like(weight), np.zeros_like(vectors)]
    edges = np.searchsorted(doc, np.arange(len(label) + 1))
    step, batch = 0, 1024
    for _ in range(EPOCHS):
        order = random.permutation(len(label))
        for k in range(0, len(order), batch):
            rows_now = order[k : k + batch]
            length = edges[rows_now + 1] - edges[rows_now]
            take = np.repeat(edges[rows_now] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
            d, t = np.repeat(np.arange(len(rows_now)), length), at[take]
            v = vectors[t]
            sums = np.stack([np.bincount(d, v[:, f], len(rows_now)) for f in range(FACTORS)], 1)
            squares = np.bincount(d, (v * v).sum(1), len(rows_now))
            margin = bias + np.bincount(d, weight[t], len(rows_now)) + ((sums * sums).sum(1) - squares) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows_now]) / len(rows_now)
            pull = error[d][:, None] * (sums[d] - v)
            grads = [np.array([error.sum()]), np.bincount(t, error[d], len(use)) + 1e-5 * weight, np.stack([np.bincount(t, pull[:, f], len(use)) for f in range(FACTORS)], 1) + 1e-4 * vectors]
            step += 1
            values = [np.array([bias]), weight, vectors]
            for i, g in enumerate(grads):
                state[i] = 0.9 * state[i] + 0.1 * g
                power[i] = 0.999 * power[i] + 0.001 * g * g
                values[i] = values[i] - 0.03 * (state[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.999**step)) + 1e-8)
            bias, weight, vectors = float(values[0][0]), values[1], values[2]
    return Machine(bias, known, weight, vectors)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most sample labelled rows of labels(doc_id, toxic) that are not held out."""
    good = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null")
    picked = good.where(~held_out("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # the sample is at most SAMPLE rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("_id", "toxic").agg(F.min_by(text_of(), F.xxhash64(text_of())).alias("text")).select("toxic", "text")
    # at most sample rows
    return fit(sorted((r.toxic, bytes(r.slots)) for r in one.mapInArrow(_terms, "toxic int, slots binary").toLocalIterator()))


def _scorer(machine, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = machine.value
        for batch in batches:
            offsets, data = scan.utf8(batch.column("text"))
            scores = [np.zeros(0)]
            for i, j in scan.blocks(offsets):
                words = scan.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], scan.PLAIN)
                scores.append(1 / (1 + np.exp(-np.clip(model.margins(j - i, *slots(words)), -40, 40))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, name])

    return score


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with a column name, the score (replacing one of that name)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(machine), name), f"{fields}, `{name}` double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels)).drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
