"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, word bigrams and skip-grams (pairs with
one word between them), each hashed to one of ``DIMS`` coordinates.  Words are
lower-cased runs of letters and digits.  The learner keeps a rate for each
coordinate; the L1 penalty leaves few weights other than zero, which are sent
to the executors as two short arrays.  Scores are calibrated by Platt's method
on training rows that the weights were not fitted on.

Training takes at most ``max_rows`` labelled documents, those of the smallest
hash of doc_id; scoring covers every whole text.

Defined results: null or empty texts have no feature and get the calibrated
bias; a null doc_id is not held out; labels that are null, or whose doc_id is
null, are not used; a doc_id with several labels counts as toxic if one says
so; repeated documents get a row each; without both labels to learn from, each
score is the share of toxic labels (0.0 without labels).  Only doc_id, text and
the label are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _text as T
from lattica.llm._ftrl import FTRL, platt, sigmoid
from lattica.llm._io import fold, labelled, learned, table

DIMS = 1 << 20
MAX_ROWS = 12_000
THRESHOLD = 0.3
EPOCHS = 5
BLOCK = 512 << 10  # bytes of text at once, whose arrays take many times that
_KINDS = tuple(np.uint64(k) for k in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1))
_UPPER = np.arange(DIMS >> 16) << 16


def features(data, off):
    """(row, coordinate) of all n-grams and skip-grams, not distinct."""
    s, e, bounds = T.word_bounds(data, off, T.ALNUM_WORDS)
    h = T.span_hashes(data, s, e)
    row = T.row_of(bounds)
    out = [(row, T.mix(h ^ _KINDS[0]))]
    for gap, kind in ((1, _KINDS[1]), (2, _KINDS[2])):
        same = row[gap:] == row[:-gap]
        out.append((row[gap:][same], T.chain(h[:-gap][same] ^ kind, h[gap:][same])))
    rows = np.concatenate([r for r, _ in out])
    return rows, (np.concatenate([x for _, x in out]) & np.uint64(DIMS - 1)).astype(np.int64)


def packed(at) -> bytes:
    """Sorted distinct coordinates in two bytes each: how many there are for each value of the upper 16 bits, then the lower 16 bits."""
    return np.bincount(at >> 16, minlength=DIMS >> 16).astype("<u4").tobytes() + (at & 0xFFFF).astype("<u2").tobytes()


def unpacked(buffer) -> np.ndarray:
    return np.repeat(_UPPER, np.frombuffer(buffer, "<u4", len(_UPPER))) + np.frombuffer(buffer, "<u2", offset=4 * len(_UPPER))


def _vectors(batches):
    """Distinct coordinates of each text, packed."""
    for rows, data, off in T.text_blocks(batches, block_bytes=BLOCK):
        row, at = features(data, off)
        key = np.unique(row * DIMS + at)
        cut = np.searchsorted(key, np.arange(rows.num_rows + 1) * DIMS)
        key &= DIMS - 1
        vecs = [packed(key[cut[i] : cut[i + 1]]) for i in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(vecs, pa.binary())], names=["doc_id", "label", "at"])


class ToxicityModel:
    """Sparse weights, bias and calibration."""

    def __init__(self, at, weight, bias, a, b, constant=None):
        self.at, self.weight, self.bias, self.a, self.b, self.constant = at, weight, bias, a, b, constant

    def dense(self):
        w = np.zeros(DIMS, np.float32)
        w[self.at] = self.weight
        return w

    def scores(self, data, off, dense):
        n = len(off) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        row, at = features(data, off)
        has = dense[at] != 0
        key = np.unique(row[has] * DIMS + at[has])  # a coordinate counts once for each text
        raw = np.bincount(key // DIMS, dense[key % DIMS], n) + self.bias
        return sigmoid(self.a * raw + self.b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = EPOCHS, **params) -> ToxicityModel:
    """Learn from labelled rows (both frames as given; the caller leaves out what must not be learned from).

    One task holds the sample once: 6 bytes for each word of ``max_rows`` texts.
    """
    sample = labelled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, label, max_rows)
    settings = {"alpha": 1.0, "beta": 1.0, "l1": 3.0, "l2": 0.0} | params
    return learned(sample.mapInArrow(_vectors, "doc_id long, label int, at binary"), lambda rows: _learn(rows, epochs, settings))


def _learn(rows, epochs, settings) -> ToxicityModel:
    """The model of an Arrow table (doc_id, label, at), or of None."""
    y = np.asarray(rows.column("label").to_pylist() if rows else [], np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, 0.0, float(y.mean()) if len(y) else 0.0)
    ids = np.asarray(rows.column("doc_id").to_pylist(), np.uint64)
    order = np.argsort(T.mix(ids), kind="stable")  # the same order however rows were partitioned
    held = [x.as_buffer() for c in rows.column("at").chunks for x in c]  # where they lie, not copied
    vec = lambda i: unpacked(held[i])

    def weights(numbers):
        m = FTRL(DIMS, **settings)
        for _ in range(epochs):
            for i in numbers:
                m.update(vec(i), 1.0, int(y[i]))
        return m.weights()[0], float(m.bias()[0])

    # each half is scored by the weights of the other one, for the calibration
    raw = np.zeros(len(y))
    halves = (order[::2], order[1::2])
    for own, other in (halves, halves[::-1]):
        w, b = weights(own)
        raw[other] = [w[vec(i)].sum() + b for i in other]
    a, b = platt(raw, y)
    w, bias = weights(order)
    found = np.flatnonzero(w)
    return ToxicityModel(found, w[found].astype(np.float32), bias, max(a, 1e-6), b)


def score(docs: DataFrame, model: ToxicityModel, keep=("doc_id",), name: str = "score") -> DataFrame:
    """The columns of ``keep`` and the score, called ``name``, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIMS weights
    keep = list(keep)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches):
        m = shared.value
        dense = m.dense()
        for part, data, off in T.text_blocks(batches, block_bytes=BLOCK):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(m.scores(data, off, dense), pa.float64())], names=[*keep, name])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; fold 2 of 4 is not learned from."""
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(ids, labels.where(fold("doc_id", 4) != 2))
    out = score(ids.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
