"""Quality scores by co-training.

Two views of a document that share nothing: its text (byte trigrams, hashed, as square roots of relative frequencies)
and its page's metadata as the table has it (language, source, length class). Each view has a Bayes classifier,
normal distributions for the text and counts for the metadata, whose margins are calibrated on labelled rows kept apart.
In each round both classifiers score every unlabelled document, and those that one is sure of become training rows of
the other one's view, with the label it gives them. What a classifier is fitted on are sums over its rows, so a round
is one pass over all documents with partial sums added up by Spark. At the end the calibrated views are combined, and
the sum scores every document.

Labels are taken from at most SAMPLE labelled rows, the least by a hash of doc_id, none of them held out (and one row
for each doc_id, the least by a hash of its text). That is the only bound: all other documents are unlabelled and looked at
in each round, and all that are sure count. Pseudo-labelled rows of a label weigh together no more than its labelled rows.

Defined cases: null or empty text has an empty text view; null lang, source or n_chars is a value of its own; missing
metadata columns count as null; without both labels every score is the share of good rows in the sample (0.5 without
rows); labels other than 0 and 1 are passed over, of several for one doc_id the largest counts; rows with one doc_id are
scored each by its own; other columns are passed over.
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
from .toxicity import held_out

SAMPLE = 4_000
TEXT_SLOTS, NAME_SLOTS = 2048, 64
ROUNDS = 2
#: The calibrated probability from which a document is taken as labelled.
SURE = 0.95
_NAMES = 3 * NAME_SLOTS


def text_view(n_docs: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte trigrams."""
    out = np.zeros(n_docs * TEXT_SLOTS, np.float32)
    if len(data) > 2:
        x = data.astype(np.uint32)
        slot = ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(15)) % np.uint32(TEXT_SLOTS)
        doc = np.repeat(np.arange(n_docs), np.diff(offsets))
        inside = doc[2:] == doc[:-2]
        out = np.bincount(doc[2:][inside] * TEXT_SLOTS + slot[inside], minlength=n_docs * TEXT_SLOTS).astype(np.float32)
    out = out.reshape(n_docs, TEXT_SLOTS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def metadata_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    """For each document a slot for its language, its source and the octave of its length."""
    hashed = lambda v: zlib.crc32(repr(v).encode()) % NAME_SLOTS
    octave = lambda n: NAME_SLOTS - 1 if n is None else min(max(n, 0).bit_length(), NAME_SLOTS - 2)
    return np.array([(hashed(a), NAME_SLOTS + hashed(b), 2 * NAME_SLOTS + octave(n)) for a, b, n in zip(langs, sources, sizes, strict=True)], np.int64).reshape(-1, 3)


class Sums:
    """What both classifiers are fitted on: for each label the rows, sums and squares of the text view, and for each label
    the metadata slots' counts."""

    def __init__(self):
        self.text = np.zeros((2, 1 + 2 * TEXT_SLOTS))
        self.names = np.zeros((2, 1 + _NAMES))

    def add_text(self, x: np.ndarray, label: np.ndarray) -> None:
        for k in (0, 1):
            own = x[label == k]
            self.text[k, 0] += len(own)
            self.text[k, 1 : 1 + TEXT_SLOTS] += own.sum(0, dtype=np.float64)
            self.text[k, 1 + TEXT_SLOTS :] += np.einsum("ij,ij->j", own, own, dtype=np.float64)

    def add_names(self, slots: np.ndarray, label: np.ndarray) -> None:
        for k in (0, 1):
            own = slots[label == k]
            self.names[k, 0] += len(own)
            self.names[k, 1:] += np.bincount(own.ravel(), minlength=_NAMES)

    def with_pseudo(self, other: Sums) -> Sums:
        """These labelled rows and the others, weighed down to them."""
        out = Sums()
        for mine, more, to in ((self.text, other.text, out.text), (self.names, other.names, out.names)):
            weight = np.minimum(1, mine[:, :1] / np.maximum(more[:, :1], 1))
            to += mine + weight * more
        return out


class Views:
    """Both classifiers: margins of the text and of the metadata for label 1 against label 0."""

    def __init__(self, sums: Sums):
        n, total, squares = sums.text[:, :1], sums.text[:, 1 : 1 + TEXT_SLOTS], sums.text[:, 1 + TEXT_SLOTS :]
        mean = total / np.maximum(n, 1)
        spread = np.maximum(squares / np.maximum(n, 1) - mean**2, 0) + 1e-4
        # sum of (x - m)^2 / s for both labels is linear in x and x^2
        self.square = ((1 / spread[0] - 1 / spread[1]) / 2).astype(np.float32)
        self.line = (mean[1] / spread[1] - mean[0] / spread[0]).astype(np.float32)
        self.base = float(((mean[0] ** 2 / spread[0] + np.log(spread[0])) - (mean[1] ** 2 / spread[1] + np.log(spread[1]))).sum() / 2)
        counts = sums.names[:, 1:].reshape(2, 3, NAME_SLOTS) + 1
        self.slots = np.diff(np.log(counts / counts.sum(2, keepdims=True)), axis=0).ravel()

    def margins(self, text: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (text @ self.line + np.square(text) @ self.square + self.base).astype(np.float64) / 100, self.slots[names].sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt scaling: intercept and slopes by Newton's steps with a little decay."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
    return w


class Model:
    """Views and their calibration, each alone and both together; views is None if there was nothing to tell apart."""

    def __init__(self, views: Views | None, text: np.ndarray, names: np.ndarray, y: np.ndarray):
        self.views = views
        if views is None:
            self.share = float(y.mean()) if len(y) else 0.5
            return
        a, b = views.margins(text, names)
        self.alone = [_calibrated(x[:, None], y) for x in (a, b)]
        self.both = _calibrated(np.stack([a, b], 1), y)

    def scores(self, text: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of both views, of the text, of the metadata."""
        if self.views is None:
            same = np.full(len(text), self.share)
            return same, same, same
        a, b = self.views.margins(text, names)
        (c0, c1), (d0, d1), (e0, e1, e2) = *self.alone, self.both
        return _sigmoid(e0 + e1 * a + e2 * b), _sigmoid(c0 + c1 * a), _sigmoid(d0 + d1 * b)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, data = scan.utf8(batch.column("text"))
    langs, sources, sizes = (batch.column(c).to_pylist() for c in ("lang", "source", "size"))
    for i, j in scan.blocks(offsets):
        for a in range(i, j, 1024):  # short texts: the dense text view bounds the block, too
            b = min(a + 1024, j)
            yield a, b, text_view(b - a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), metadata_view(langs[a:b], sources[a:b], sizes[a:b])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, text, names in _views(batch):
            rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("quality").slice(a, b - a), rows(text.astype(np.float16)), rows(names)], ["id", "quality", "text_view", "names"])


def _exchanged(model):
    """(view, label, slot, value): sums over the unlabelled documents that the other view is sure of."""

    def exchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            free = batch.column("free").to_numpy(zero_copy_only=False)
            for a, b, text, names in _views(batch):
                _, by_text, by_names = model.value.scores(text, names)
                label = lambda p: np.where(free[a:b] & (p >= SURE), 1, np.where(free[a:b] & (p <= 1 - SURE), 0, -1))  # noqa: B023, E731
                sums.add_names(names, label(by_text))
                sums.add_text(text, label(by_names))
        for view, table in enumerate((sums.text, sums.names)):
            label, slot = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), view), pa.int32()), pa.array(label, pa.int32()), pa.array(slot, pa.int32()), pa.array(table[label, slot])], ["view", "label", "slot", "value"])

    return exchanged


def _rows(docs: DataFrame) -> DataFrame:
    name = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"), name("lang", "string").alias("lang"), name("source", "string").alias("source"), name("n_chars", "long").alias("size"))


_VIEWS = ("text", "lang", "source", "size")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    good = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and _id is not null")
    # at most SAMPLE pairs of numbers
    picked = good.where(~held_out("_id")).groupBy("_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = _rows(docs)
    one = rows.join(F.broadcast(picked), F.col("id") == F.col("_id")).groupBy("id", "quality").agg(F.min_by(F.struct(*_VIEWS), F.xxhash64(*_VIEWS)).alias("row")).select("id", "quality", "row.*")
    found = sorted(one.mapInArrow(_sampled, "id long, quality int, text_view binary, names binary").collect(), key=lambda r: r.id)
    text = np.frombuffer(b"".join(r.text_view for r in found), np.float16).astype(np.float32).reshape(-1, TEXT_SLOTS)
    names = np.frombuffer(b"".join(r.names for r in found), np.int64).reshape(-1, 3)
    y = np.array([r.quality for r in found], np.int64)
    apart = np.array([zlib.crc32(str(r.id).encode()) % 5 == 1 for r in found], bool)
    if len(set(y[~apart].tolist())) < 2:
        return Model(None, text, names, y)
    fit = apart if len(set(y[apart].tolist())) == 2 else ~apart
    known = Sums()
    known.add_text(text[~apart], y[~apart])
    known.add_names(names[~apart], y[~apart])
    model = Model(Views(known), text[fit], names[fit], y[fit])
    # all but the sample is unlabelled here, whatever labels there are
    free = rows.join(F.broadcast(picked.select("_id")), F.col("id") == F.col("_id"), "left").select(*_VIEWS, F.col("_id").isNull().alias("free"))
    for _ in range(rounds):
        parts = free.mapInArrow(_exchanged(spark.sparkContext.broadcast(model)), "view int, label int, slot int, value double")
        pseudo = Sums()
        for r in parts.groupBy("view", "label", "slot").agg(F.sum("value").alias("value")).collect():  # a row a slot
            (pseudo.text, pseudo.names)[r.view][r.label, r.slot] = r.value
        model = Model(Views(known.with_pseudo(pseudo)), text[fit], names[fit], y[fit])
    return model


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, names in _views(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *(pa.array(x.astype(np.float64)) for x in model.value.scores(text, names))], ["doc_id", "score", "text_score", "metadata_score"])

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """docs -> (doc_id, held_out, score, text_score, metadata_score, predicted): probabilities of good quality."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, rounds))
    found = _rows(docs).mapInArrow(_scorer(model), "doc_id long, score double, text_score double, metadata_score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", "text_score", "metadata_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
