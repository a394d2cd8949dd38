"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (the pieces between line feeds).  Each
paragraph is hashed to a wide vector and a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane modulo a power of two: the order of
paragraphs does not matter, and adding or removing a paragraph adds or
subtracts its vector (:func:`combine`).

The vector has two parts:

* ``EQUAL_LANES`` lanes modulo 2**64 from BLAKE2b of the paragraph.  They decide
  equality.
* ``NEAR_LANES`` lanes modulo 2**16.  Each word trigram of the paragraph adds +1
  or -1 to one lane, so the squared length of the difference of two vectors
  estimates how many trigrams the texts do not share (the AMS second-moment
  sketch).  ``likeness`` is one minus that over the sum of the squared lengths.

Defined results: a null or empty text has no paragraph and the zero vector;
two zero vectors are alike (1.0); texts without any word are alike only if
equal.  Repeated rows are documents of their own.  Rows whose doc_id is null
come before all others in the order of documents; ties in doc_id are ordered by
the hash of their text.  Rows of one doc_id and one text are in one task, however
many there are.  An empty table gives an empty result.  Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _text as T
from lattica.llm._io import table

EQUAL_LANES = 4
NEAR_LANES = 128
PART_BYTES = 32 << 20  # of text that one task sorts and scans
HEX = EQUAL_LANES * 16 + NEAR_LANES * 4

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Equality lanes (uint64) and likeness lanes (int16) of each UTF-8 text."""
    n = len(texts)
    equal = np.zeros((n, EQUAL_LANES), np.uint64)
    near = np.zeros((n, NEAR_LANES), np.int16)
    if not n:
        return equal, near
    parts = [t.split(b"\n") if t else [] for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, n)
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * EQUAL_LANES).digest() for ps in parts for p in ps)
    full = np.flatnonzero(counts)
    if not len(full):
        return equal, near
    first = np.cumsum(counts) - counts
    lanes = np.frombuffer(digests, "<u8").reshape(-1, EQUAL_LANES)
    equal[full] = np.add.reduceat(lanes, first[full], axis=0)

    blob = b"\n".join(t for t in texts if t)
    data = np.frombuffer(blob, np.uint8)
    breaks = np.flatnonzero(data == 10)
    offsets = np.concatenate(([0], breaks, [len(data)]))
    starts, ends, bounds = T.word_bounds(data, offsets, T.SPACE_WORDS)
    if not len(starts):
        return equal, near
    h = T.span_hashes(data, starts, ends, lower=False)
    para = T.row_of(bounds)
    doc = np.repeat(np.arange(n), counts)[para]
    # trigrams inside a paragraph; a paragraph of one or two words is one feature
    last = para[2:] == para[:-2]
    gram = T.chain(T.chain(h[:-2][last], h[1:-1][last]), h[2:][last])
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < 3))
    head = h[bounds[short]]
    tail = h[bounds[short + 1] - 1]
    gram = np.concatenate((gram, T.chain(head, tail)))
    doc = np.concatenate((doc[:-2][last], doc[bounds[short]]))
    lane = (gram % np.uint64(NEAR_LANES)).astype(np.int64)
    sign = np.where(gram >> np.uint64(63), -1.0, 1.0)
    total = np.bincount(doc * NEAR_LANES + lane, sign, n * NEAR_LANES)
    near[:] = (total.astype(np.int64) & 0xFFFF).astype(np.uint16).view(np.int16).reshape(n, NEAR_LANES)
    return equal, near


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of the union (or, with sign -1, the difference) of two multisets."""
    (ea, na), (eb, nb) = decode(a), decode(b)
    with np.errstate(over="ignore"):
        return encode(ea + eb if sign > 0 else ea - eb, na + nb if sign > 0 else na - nb)


def encode(equal: np.ndarray, near: np.ndarray) -> str:
    return equal.astype(">u8").tobytes().hex() + near.astype(">i2").tobytes().hex()


def decode(s: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(s)
    return np.frombuffer(raw[: 8 * EQUAL_LANES], ">u8").astype(np.uint64), np.frombuffer(raw[8 * EQUAL_LANES :], ">i2").astype(np.int16)


def likeness(ea, na, eb, nb) -> np.ndarray:
    """Row by row, from 0 to 1; 1.0 exactly for equal fingerprints."""
    diff = (na - nb).astype(np.float64)  # wraps modulo 2**16, as the lanes do
    d = (diff * diff).sum(1)
    s = (na.astype(np.float64) ** 2).sum(1) + (nb.astype(np.float64) ** 2).sum(1)
    same = (ea == eb).all(1) & (na == nb).all(1)
    raw = np.clip(1 - d / np.maximum(s, 1), 0, 1)
    return np.where(same, 1.0, np.where(s > 0, np.minimum(raw, 1 - 1e-9), 0.0))


def _ordered(docs: DataFrame, partitions: int | None) -> tuple[DataFrame, int]:
    """Rows (part, head, doc_id, tie, text), each part in order of documents, and the number of parts.

    The parts follow each other in that order.  Each also gets, after its own
    rows, the first row of the next part (head = true), so that no row needs
    another part.  Their number comes from the bytes of text.  Splits are quantiles
    of doc_id; rows without one, and a doc_id that fills several parts, are dealt
    out by the hash of their text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    size, rows_, known = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1)), F.count("doc_id")).first()
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    blank = -(-n * (rows_ - known) // rows_) if rows_ else 0  # parts of rows without an id
    cuts = []
    if known and n - blank > 1:
        k = n - blank
        cuts = sorted(ids.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10_000, 4 * k))).first()[0])
    step = max(1, int(len(cuts) ** 0.5))

    def passed(test):
        """The number of split values that pass ``test``, which the first ones do: by coarse steps, then inside one."""
        if not cuts:
            return F.lit(0)
        coarse = F.size(F.filter(F.lit(cuts[::step]), test))
        base = F.greatest(coarse - 1, F.lit(0)) * step
        return base + F.size(F.filter(F.slice(F.lit(cuts), base + 1, F.lit(step)), test))

    def parted(df):
        low, high = passed(lambda c: c < F.col("doc_id")), passed(lambda c: c <= F.col("doc_id"))
        unit = (F.col("tie").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
        inside = F.least(F.floor(unit * (high - low)), F.greatest(high - low - 1, F.lit(0)))
        nulls = F.least(F.floor(unit * blank), F.lit(max(0, blank - 1)))
        return df.withColumn("part", F.when(F.col("doc_id").isNull(), nulls).otherwise(blank + low + inside).cast("int"))

    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    heads = parted(ids).groupBy("part").agg(F.min(key).alias("first"))
    first = sorted((r["part"], tuple(r["first"])) for r in heads.collect())  # one row per part
    full = [p for p, _ in first]
    rows = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")))
    if not full:
        return rows.select("part", F.lit(False).alias("head"), "doc_id", "tie", "text"), 1
    before = {p: full[i - 1] for i, p in enumerate(full)}  # the part of the last row is followed by the first
    starts = docs.sparkSession.createDataFrame([(p, k[1], k[2], before[p]) for p, k in first], "part int, first_id long, first_tie long, before int")
    rows = rows.join(F.broadcast(starts), "part")  # a row for each part
    is_head = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    own = F.struct(F.col("part").alias("p"), F.lit(False).alias("h"))
    extra = F.struct(F.col("before").alias("p"), F.lit(True).alias("h"))
    rows = rows.withColumn("at", F.explode(F.when(is_head, F.array(own, extra)).otherwise(F.array(own))))
    return rows.select(F.col("at.p").alias("part"), F.col("at.h").alias("head"), "doc_id", "tie", "text"), max(full) + 1


def _scan(batches):
    """Fingerprints of sorted rows; each waits for the text that follows it."""
    hold = None  # (part, doc_id, text) of the last row so far
    done = None  # the part whose head has been seen
    todo, size = [], 0
    for batch in batches:
        part = batch.column("part").to_pylist()
        head = batch.column("head").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        data, off = T.string_buffers(batch.column("text"))
        for i in range(batch.num_rows):
            text = data[off[i] : off[i + 1]].tobytes()
            if hold is not None and hold[0] == part[i]:
                todo.append((hold[1], hold[2], text))
                size += len(hold[2])
            if head[i]:
                hold, done = None, part[i]
            elif part[i] != done:
                hold = (part[i], ids[i], text)
            if size > T.BLOCK_BYTES:
                yield _rows(todo)
                todo, size = [], 0
    if todo:
        yield _rows(todo)


def _rows(todo):
    """todo: (doc_id, text, next text)"""
    chars, shas, edited = [], [], []
    for _, text, after in todo:
        t = text.decode("utf-8", "replace")
        k = len(t) // 2
        e = (t[: len(t) - k] + after.decode("utf-8", "replace")[:k]).encode()
        chars.append(len(t))
        shas.append(hashlib.sha256(e).hexdigest())
        edited.append(e)
    n = len(todo)
    follow = [after for i, (_, _, after) in enumerate(todo) if i + 1 == n or todo[i + 1][1] is not after]
    eq, near = fingerprints([t for _, t, _ in todo] + edited + follow)
    nxt, j = np.empty(n, np.int64), 2 * n
    for i, (_, _, after) in enumerate(todo):
        if i + 1 < n and todo[i + 1][1] is after:
            nxt[i] = i + 1
        else:
            nxt[i], j = j, j + 1
    a, b = slice(0, n), slice(n, 2 * n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in todo], pa.int64()),
            pa.array(chars, pa.int64()),
            pa.array(shas, pa.string()),
            pa.array([encode(eq[i], near[i]) for i in range(n)], pa.string()),
            pa.array([encode(eq[n + i], near[n + i]) for i in range(n)], pa.string()),
            pa.array(likeness(eq[a], near[a], eq[b], near[b]), pa.float64()),
            pa.array(likeness(eq[a], near[a], eq[nxt], near[nxt]), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text (see the module and SCHEMA).

    Texts are shuffled once, into ranges of doc_id, one a task, that are sorted within it.
    """
    rows, n = _ordered(docs, partitions)
    rows = rows.repartitionById(n, "part").sortWithinPartitions("part", "head", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return rows.select("part", "head", "doc_id", "text").mapInArrow(_scan, SCHEMA)


def fingerprint_column(texts) -> list[str]:
    """Fingerprints of an iterable of str or None."""
    eq, near = fingerprints([(t or "").encode() for t in texts])
    return [encode(e, v) for e, v in zip(eq, near, strict=True)]


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
