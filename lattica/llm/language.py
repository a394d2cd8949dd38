"""Language ID by sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are code points with A-Z lower-cased; every run of other than
letters, marks or digits counts as one space, by way of a class for each code
point.  N-grams of 1 to ``MAX_N`` characters are hashed to ``DIMS``
coordinates.  The value of a coordinate is its share of the text's n-grams
times the inverse document frequency, so a text's score is a mean over its
n-grams and can be summed in one pass over texts of any length.

Training is follow-the-regularised-leader with elastic-net penalties on at most
``max_rows`` texts of each language (smallest hash of doc_id; whole texts), so
that rare languages are learned, too; a fifth of them is kept from it to fit the
temperature of the softmax.  Languages of more texts count alike in the scores.
The document frequencies are those of all texts with a language.

Defined results: ``und`` with score 0.0 for a null text or one without any
letter, and for every text where nothing could be learned; rows whose lang or
doc_id is null are not learned from; a doc_id that is repeated is learned from
once, and gets a row for each of its rows.  Only doc_id, text and lang are
read, so other columns may have any name.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import _text as T
from lattica.llm._ftrl import FTRL
from lattica.llm._io import fold, learned, table

DIMS = 1 << 16
MAX_N = 3
MAX_ROWS = 3_000
EPOCHS = 3
_SCALE = 100.0  # of the values, to bring typical ones near 1
_SALT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _classes() -> np.ndarray:
    """By code point of the basic plane: the code point to hash, or a space."""
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if not ch.isalnum() and unicodedata.category(ch)[0] != "M":
            out[c] = 32
    out[65:91] += 32
    return out


_cache: dict = {}


def _grams(data, off):
    """For each n: (row, coordinate) of its n-grams, by position; n-grams don't cross rows."""
    if "classes" not in _cache:
        _cache["classes"] = _classes()
    text = data.tobytes()
    code = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = lead[off]
    code = np.where(code < 0x10000, _cache["classes"][np.minimum(code, 0xFFFF)], code)
    space = code == 32
    first = np.zeros(len(code) + 1, bool)
    first[bounds] = True
    keep = ~space
    keep[1:] |= ~space[:-1]  # a run of spaces counts as one
    keep |= first[:-1]
    kept = np.concatenate(([0], np.cumsum(keep)))
    code, bounds = code[keep], kept[bounds]
    row = T.row_of(bounds)
    h = np.zeros(len(code), np.uint32)
    for n in range(MAX_N):
        h = (h[: len(code) - n] * np.uint32(0x01000193) ^ code[n:]) * _SALT[0] if n else code * _SALT[0]
        h = h ^ (h >> np.uint32(15))
        at = ((h * _SALT[n]) >> np.uint32(16)).astype(np.int64)
        if n:
            same = row[n:] == row[: len(row) - n]
            yield row[n:][same], at[same]
        else:
            yield row, at


def _counts(batches):
    """Coordinates and counts of each text, as bytes of int32."""
    for rows, data, off in T.text_blocks(batches, block_bytes=1 << 20):
        key = np.concatenate([row * DIMS + at for row, at in _grams(data, off)])
        key, n = np.unique(key, return_counts=True)
        cut = np.searchsorted(key, np.arange(rows.num_rows + 1) * DIMS)
        low, n = (key & (DIMS - 1)).astype("<i4"), n.astype("<i4")
        r = range(rows.num_rows)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("lang"), pa.array([low[cut[i] : cut[i + 1]].tobytes() for i in r], pa.binary()), pa.array([n[cut[i] : cut[i + 1]].tobytes() for i in r], pa.binary())],
            names=["doc_id", "lang", "at", "n"],
        )


def _frequencies(batches):
    """(at, n): in how many texts each coordinate is, and at -1 the number of texts; DIMS + 1 rows a task at most."""
    total, texts = np.zeros(DIMS, np.int64), 0
    for rows, data, off in T.text_blocks(batches, block_bytes=1 << 20):
        key = np.unique(np.concatenate([row * DIMS + at for row, at in _grams(data, off)]))
        total += np.bincount(key & (DIMS - 1), minlength=DIMS)
        texts += rows.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], texts), pa.int64())], names=["at", "n"])


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of all texts of rows (doc_id, text), one for each doc_id: the texts with each coordinate, and their number."""
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.limit(1).count():
        once = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = rows.join(repeated, "doc_id", "left_anti").select("doc_id", "text").unionByName(once)
    got = rows.select("text").mapInArrow(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # DIMS + 1 rows at most
    out = np.zeros(DIMS + 1, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()  # -1 is the last place
    return out[:-1], int(out[-1])


def sampled_ids(rows: DataFrame, max_rows: int) -> DataFrame:
    """doc_id of the ``max_rows`` smallest hashes of each language of rows (doc_id, lang).

    Hashes far above that rank are left out first, by the number of texts of
    the language, so only a few times ``max_rows`` of them are ranked.
    """
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("hash", F.xxhash64("doc_id"))
    n = ids.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    share = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
    few = ids.join(F.broadcast(n), "lang").where(share * F.col("n") <= 2 * max_rows + 1000)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    return few.withColumn("place", place).where(F.col("place") <= max_rows).select("doc_id")


class LanguageModel:
    """table: (DIMS, classes), weights times inverse document frequency; temperature divides the sums."""

    def __init__(self, names, table, bias, temperature):
        self.names, self.table, self.bias, self.temperature = names, table, bias, temperature

    def predict(self, data, off):
        """Class index (-1: und) and probability of each text."""
        n, k = len(off) - 1, len(self.names)
        if not k:
            return np.full(n, -1), np.zeros(n)
        sums, total = np.zeros((n, k)), np.zeros(n)
        for row, at in _grams(data, off):
            total += np.bincount(row, minlength=n)
            for c in range(k):
                sums[:, c] += np.bincount(row, self.table[c][at], n)
        s = (_SCALE * sums / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        best = s.argmax(1)
        score = s[np.arange(n), best]
        # rows without an ASCII letter may hold another one
        ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
        seen = np.concatenate(([0], np.cumsum(ascii_letter)))
        for i in np.flatnonzero(seen[off[1:]] == seen[off[:-1]]):
            if not any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))):
                best[i], score[i] = -1, 0.0
        return best, score


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, alpha: float = 0.3, l1: float = 0.05, l2: float = 0.1) -> LanguageModel:
    """Learn from text and lang of ``docs`` (the caller leaves out what must not be learned from)."""
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    ids = sampled_ids(sample.select("doc_id", "lang"), max_rows)  # max_rows a language at most
    drawn = sample.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    df, texts = document_frequencies(sample.select("doc_id", "text"))
    idf = np.log((1 + texts) / (1 + df)) + 1
    settings = {"alpha": alpha, "l1": l1, "l2": l2}
    return learned(drawn.mapInArrow(_counts, "doc_id long, lang string, at binary, n binary"), lambda rows: _learn(rows, idf, epochs, settings))


def _learn(rows, idf, epochs, settings) -> LanguageModel:
    """The model of an Arrow table (doc_id, lang, at, n), or of None."""
    if rows is None:
        return LanguageModel([], np.zeros((0, DIMS), np.float32), np.zeros(0), 1.0)
    lang = rows.column("lang").to_pylist()
    names = sorted(set(lang))
    y = np.array([names.index(x) for x in lang])
    order = np.argsort(T.mix(np.asarray(rows.column("doc_id").to_pylist(), np.uint64)), kind="stable")
    at = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("at").combine_chunks()]
    tf = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("n").combine_chunks()]
    value = lambda i: _SCALE * tf[i] * idf[at[i]] / max(1, tf[i].sum())
    kept = order[4::5]
    m = FTRL(DIMS, max(2, len(names)), **settings)
    for _ in range(epochs):
        for i in np.setdiff1d(order, kept, assume_unique=True):
            if len(at[i]):
                m.update(at[i], value(i), int(y[i]))
    w, bias = m.weights()[: len(names)], m.bias()[: len(names)]
    held = np.array([(w[:, at[i]] * value(i)).sum(1) + bias for i in kept if len(at[i])]).reshape(-1, len(names))
    truth = np.array([y[i] for i in kept if len(at[i])], np.int64)
    return LanguageModel(names, (w * idf).astype(np.float32), bias, _temperature(held, truth))


def _temperature(scores, truth) -> float:
    """Of a grid of temperatures, the one of least log loss on rows kept from training."""
    if not len(truth) or scores.shape[1] < 2:
        return 1.0

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]).mean())

    return float(min(np.exp(np.linspace(-3, 3, 121)), key=loss))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights a language

    def run(batches):
        m = shared.value
        names = np.array([*m.names, "und"], object)
        for rows, data, off in T.text_blocks(batches, block_bytes=1 << 20):
            best, score = m.predict(data, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
