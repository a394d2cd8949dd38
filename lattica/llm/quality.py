"""Quality by compression with dictionaries of good and of bad text.

Two Zstandard dictionaries are trained, one on labelled good and one on
labelled bad texts.  A text is compressed with each; the feature is the
difference of the two sizes over their sum, positive where the good dictionary
compresses better.  Platt's method turns it into a probability, on labelled
texts that neither dictionary was trained on.

Texts are compressed whole, cut into pieces of ``PIECE`` bytes whose sizes are
summed: within a longer stretch the compressor learns from the text itself and
the dictionaries stop to matter.  Pieces also bound the memory of very long
texts.

Training takes at most ``max_rows`` documents of each label, those of the
smallest hash of doc_id.

Defined results: null and empty texts have the difference 0; labels that are
null or of a null doc_id are not used; a doc_id with several labels counts as
good if one says so; a null doc_id is not held out; repeated documents get a
row each; without both labels to learn from, each score is the share of good
labels (0.5 without labels).  Only doc_id, text and the label are read, so
other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _text as T
from lattica.llm._ftrl import platt, sigmoid
from lattica.llm._io import fold, labelled, learned, table

MAX_ROWS = 2_000
DICT_BYTES = 112_640
PIECE = 512
LEVEL = 3
THRESHOLD = 0.5


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class QualityModel:
    """Both dictionaries and the calibration; ``constant`` where nothing could be learned."""

    def __init__(self, good: bytes, bad: bytes, a: float = 1.0, b: float = 0.0, constant: float | None = None):
        self.good, self.bad, self.a, self.b, self.constant = good, bad, a, b, constant

    def compressors(self):
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=_ready(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]

    def difference(self, text: bytes, compressors) -> float:
        """(size with the bad dictionary - size with the good one) / their sum"""
        good = bad = 0
        g, b = compressors
        for p in pieces(text):
            good += len(g.compress(p))
            bad += len(b.compress(p))
        return (bad - good) / (bad + good) if good + bad else 0.0

    def score(self, diffs: np.ndarray) -> np.ndarray:
        return np.full(len(diffs), self.constant) if self.constant is not None else sigmoid(self.a * diffs + self.b)


def _ready(raw: bytes):
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def _dictionary(texts: list[bytes]) -> bytes:
    """Trained on the pieces of all texts."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples: their text itself serves as a raw dictionary
        return b"".join(parts) or b"\n" * 8


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> QualityModel:
    """Learn from labelled rows (the caller leaves out what must not be learned from).

    One task holds the sample: at most ``max_rows`` texts of each label.
    """
    rows = labelled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, label, max_rows, per_class=True)
    # all rows count for the share of labels; the sample has as many of each as there are
    share = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return learned(rows.select("doc_id", "label", "text"), lambda rows: _learn(rows, share))


def _learn(rows, share) -> QualityModel:
    """The model of an Arrow table (doc_id, label, text), or of None."""
    rows = rows.to_pylist() if rows else []
    rows.sort(key=lambda r: int(T.mix(np.array([r["doc_id"]]).astype(np.uint64))[0]))
    texts = [[(r["text"] or "").encode() for r in rows if r["label"] == k] for k in (0, 1)]
    if not (texts[0] and texts[1]):
        return QualityModel(b"", b"", constant=0.5 if share is None else float(share))
    train, test = [t[: max(1, len(t) * 2 // 3)] for t in texts], [t[len(t) * 2 // 3 :] for t in texts]
    model = QualityModel(_dictionary(train[1]), _dictionary(train[0]))
    comp = model.compressors()
    diffs = np.array([model.difference(t, comp) for k in (0, 1) for t in test[k]])
    y = np.array([k for k in (0, 1) for _ in test[k]])
    a, b = platt(diffs, y)
    # the sample has its own share of labels; the intercept is moved to that of all labelled rows
    mine = min(max(y.mean(), 1e-6), 1 - 1e-6)
    share = min(max(share, 1e-6), 1 - 1e-6)
    model.a, model.b = max(a, 1e-6), b + float(np.log(share / (1 - share)) - np.log(mine / (1 - mine)))
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def run(batches):
        m = shared.value
        comp = m.compressors() if m.constant is None else None
        for rows, data, off in T.text_blocks(batches):
            raw = data.tobytes()
            diffs = np.array([m.difference(raw[off[i] : off[i + 1]], comp) if comp else 0.0 for i in range(rows.num_rows)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(m.score(diffs), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(fold("doc_id", 3) != 1)))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
