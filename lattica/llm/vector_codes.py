"""Vector compression to codes of one byte a part, with codebooks by Yinyang Lloyd.

Vectors become integers, floor(256 x), and are cut into equal consecutive parts.
Each part position has a codebook; Lloyd rounds assign every part to its nearest
entry and move entries to the floored mean of their parts.

The entries of a codebook are clustered into groups (about a tenth as many).  Each
part keeps the distance to its own entry and one lower bound a group: no entry of
the group but its own is nearer.  When entries move, a bound falls by the largest
move in its group, and only groups whose bound no longer lies above the distance
to the own entry are scanned.  Bounds are rounded down and compared with a margin;
what decides are distances in whole numbers, so ties go to the lower index exactly.

What a round keeps (codes and bounds) is a table in the shared folder, so a lost
executor costs the tasks that it ran.  Sums of entries come to the driver: as many
numbers as the codebooks have, whatever the number of vectors.  Nothing is
shuffled but those sums, and the final codes of vectors with rare labels.

Defined results: vectors that are null or hold null or non-finite components are
left out.  Vectors whose length is not that of most of the first ``entries`` ones,
or not a multiple of ``parts``, and ones with a component of 2**18 or more, keep
their row with null code and error and have no part in codebooks.  Rows without a
vec_id are encoded but are no first entries; of equal vec_ids the smaller vector
comes first.  With fewer vectors than ``entries`` codebooks are smaller.  The
label error of vectors with null labels is their sum.  Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _store
from lattica.llm._io import table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LIMIT = float(2**18)  # components below it keep distances and sums within 64 bits
ROWS = 4096  # vectors that are compared at once
FREQUENT = 10_000  # a label is frequent with at least one in so many rows, so there are at most so many frequent ones


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, as whole numbers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2**53:  # floats hold all sums exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def grouped(codebook: np.ndarray) -> np.ndarray:
    """The group of each entry: a tenth as many groups, by a few plain rounds over the entries themselves."""
    k = len(codebook)
    t = max(1, k // 10)
    centres = codebook[np.linspace(0, k - 1, t).astype(int)].astype(np.float64)
    for _ in range(5):
        at = ((codebook[:, None].astype(np.float64) - centres) ** 2).sum(2).argmin(1)
        for g in range(t):
            if (at == g).any():
                centres[g] = codebook[at == g].mean(0)
    return at


class Codebooks:
    """Entries (parts, entries, width) of whole numbers, their groups, and how far the last move took each group."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray | None = None, drift: np.ndarray | None = None):
        self.entries = entries
        self.groups = np.stack([grouped(c) for c in entries]) if groups is None else groups
        self.count = int(self.groups.max(initial=0)) + 1
        self.drift = np.zeros((len(entries), self.count)) if drift is None else drift

    def moved(self, sums: dict) -> Codebooks:
        """After a round: ``sums`` holds (count, sums of components) of the used entries (part, entry)."""
        new = self.entries.copy()
        for (p, e), (n, s) in sums.items():
            new[p, e] = s // n
        step = np.nextafter(np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12), np.inf)
        drift = np.stack([[step[p][self.groups[p] == g].max(initial=0) for g in range(self.count)] for p in range(len(new))])
        return Codebooks(new, self.groups, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def first_assignment(x: np.ndarray, p: int, books: Codebooks):
    """Nearest entries of rows of part p, their distances, and the bound of each group."""
    d = _distances(x, books.entries[p])
    code = d.argmin(1)  # the first of equal ones
    best = d[np.arange(len(x)), code]
    other = d.astype(np.float64)
    other[np.arange(len(x)), code] = np.inf
    lower = np.full((len(x), books.count), np.inf)
    for g in range(books.count):
        of = books.groups[p] == g
        if of.any():
            lower[:, g] = np.sqrt(other[:, of].min(1))
    return code, best, _down(lower)


def next_assignment(x: np.ndarray, p: int, books: Codebooks, code: np.ndarray, lower: np.ndarray):
    """The same after a move, from the last codes and bounds; also the number of distances that were taken."""
    rows = np.arange(len(x))
    entries, groups = books.entries[p], books.groups[p]
    own = ((x - entries[code]) ** 2).sum(1)
    lower = lower.astype(np.float64) - books.drift[p]
    scan = lower <= (np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-9)[:, None]
    best, at = own.copy(), code.copy()
    taken = len(x)
    nearest = np.full(lower.shape, -1)  # in scanned groups: the nearest entry, and the distances of the first two
    one, two = np.full(lower.shape, np.inf), np.full(lower.shape, np.inf)
    for g in range(books.count):
        of, r = np.flatnonzero(groups == g), np.flatnonzero(scan[:, g])
        if not len(of) or not len(r):
            continue
        d = _distances(x[r], entries[of])
        taken += d.size
        k = d.argmin(1)
        near, index = d[np.arange(len(r)), k], of[k]
        better = (near < best[r]) | ((near == best[r]) & (index < at[r]))
        best[r[better]], at[r[better]] = near[better], index[better]
        rest = d.astype(np.float64)
        rest[np.arange(len(r)), k] = np.inf
        nearest[r, g], one[r, g], two[r, g] = index, np.sqrt(near.astype(np.float64)), np.sqrt(rest.min(1))
    changed = at != code
    left = groups[code[changed]]  # the last own entry counts for the bound of its group again
    lower[rows[changed], left] = np.minimum(lower[rows[changed], left], np.sqrt(own[changed].astype(np.float64)))
    fresh = np.where(nearest == at[:, None], two, one)
    return at, best, _down(np.where(nearest >= 0, fresh, lower)), taken


def _whole(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """Vectors of a batch as whole numbers (rows, parts, width)."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(batch.num_rows, parts, -1)


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _assigned(df: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """``df`` with codes, bounds (unless ``last``) and error of each vector; codes and bounds of the round before are used if there."""
    known = "codes" in df.columns
    parts, groups = len(books.entries), books.count
    keep = [f for f in df.schema.fields if f.name in ("vec_id", "label") or f.name == "embedding" and not last]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["codes binary", "error long"] + ["lower binary"] * (not last)

    def run(batches):
        for batch in _slices(batches):
            n = batch.num_rows
            x = _whole(batch, parts)
            codes, lower, error = np.empty((n, parts), np.uint8), np.empty((n, parts, groups), np.float32), np.zeros(n, np.int64)
            if known:
                old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                bounds = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.float32).reshape(n, parts, groups)
            for p in range(parts):
                if known:
                    codes[:, p], d, lower[:, p], _ = next_assignment(x[:, p], p, books, old[:, p], bounds[:, p])
                else:
                    codes[:, p], d, lower[:, p] = first_assignment(x[:, p], p, books)
                error += d
            columns = [batch.column(f.name) for f in keep] + [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            if not last:
                columns.append(pa.array([b.tobytes() for b in lower], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in keep] + ["codes", "error"] + ["lower"] * (not last))

    return df.mapInArrow(run, ", ".join(fields))


def _sums(assigned: DataFrame, books: Codebooks) -> dict:
    """(part, entry): (count, sums of components), added up in each task first."""
    parts, entries, width = books.entries.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in _slices(batches):
            x = _whole(batch, parts)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p, :, 0], codes[:, p], 1)
                np.add.at(total[p, :, 1:], codes[:, p], x[:, p])
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    one = assigned.select("embedding", "codes").mapInArrow(run, "part long, entry long, sums array<long>")
    added = one.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width + 1)])
    return {(r["part"], r["entry"]): (r["s0"], np.array(r[3:], np.int64)) for r in added.collect()}  # parts x entries rows


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, codes, error) of each vector that is kept, and the codebooks (None without any vector to learn from)."""
    if not 0 < entries <= 256:
        raise ValueError("codes are bytes: at most 256 entries")
    x = vectors.select("vec_id", "embedding", "label")
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(F.col("embedding").isNotNull() & finite)
    small = ~F.exists("embedding", lambda c: F.abs(c) >= LIMIT)
    fits = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & small
    order = x.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "embedding")
    seeds = order.where(fits).limit(entries).collect()
    sizes = Counter(len(r["embedding"]) for r in seeds)
    size = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0
    if len(sizes) > 1:
        seeds = order.where(fits & (F.size("embedding") == size)).limit(entries).collect()
    fits = fits & (F.size("embedding") == size)
    rest = x.where(~fits).select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return rest, None
    whole = np.floor(np.array([r["embedding"] for r in seeds], np.float64) * SCALE).astype(np.int64)
    books = Codebooks(whole.reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy())
    now = x.where(fits)
    before = None
    for _ in range(rounds):
        now = _store.save(_assigned(now, books, last=False), "codes")
        books = books.moved(_sums(now, books))
        if before is not None:
            _store.discard(before)
        before = now
    return _assigned(now, books, last=True).unionByName(rest), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of errors over rows of an equal label (null labels together).

    Sums of frequent labels (at most FREQUENT of them, by definition) are broadcast; only rows of rare labels, none of which
    holds more than a small share, are shuffled to theirs.
    """
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    by = _store.save(by.withColumnRenamed("label", "of"), "label-errors")
    total = by.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= total
    same = F.col("label").eqNullSafe(F.col("of"))
    many, few = by.where(often).drop("n"), by.where(~often).drop("n")
    near = coded.join(F.broadcast(many.withColumn("hit", F.lit(True))), same, "left")
    done = near.where("hit").drop("of", "hit")
    return done.unionByName(near.where("hit is null").drop("of", "hit", "label_error").join(few.hint("shuffle_hash"), same).drop("of"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    out = label_errors(_store.save(coded, "coded"))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (SELECT vec_id, p, s, m % 64 AS k, m // 64 AS d FROM (
  SELECT x.vec_id, x.p, any_value(x.s) AS s, min(list_sum(list_transform(list_zip(x.s, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + c.k) AS m
  FROM x JOIN c{k} c USING (p) GROUP BY x.vec_id, x.p)),"""


def _moved(k: int) -> str:
    return f"""
c{k + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (
  SELECT p, k, list(m ORDER BY i) AS c FROM (SELECT p, k, i, CAST(floor(CAST(sum(s[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, len(s) + 1) r(i) GROUP BY p, k, i) GROUP BY p, k) n USING (p, k)),"""


OP11_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS s FROM e, range(16) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, s AS c FROM x WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
{_round(0)}{_moved(0)}{_round(1)}{_moved(1)}{_round(2)}
f AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c2) AS codebooks_sha256 FROM f JOIN e USING (vec_id)"""
