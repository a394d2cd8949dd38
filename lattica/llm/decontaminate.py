"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of letters and digits, lower-cased (A-Z).  The patterns are the
windows of 10 consecutive words of each benchmark item (an item of fewer words
is one pattern).  For the patterns of one length m the search keeps

* a shift table over blocks of two words: how far the search may jump when a
  block ends at this position, m - 1 for a block that is in no pattern;
* buckets of patterns by the hash of their last block, tried where the shift is
  zero, with the hash of the first block as a second filter;
* a direct comparison of the words themselves, which confirms an occurrence.

Jumps are taken for a whole block of texts at once: every (m-1)-th word is
probed, the shift table tells which ends in the next m-1 words remain possible,
and only those are looked at.

The patterns are sent to the executors in blocks of at most ``block_bytes`` of
item text; a larger benchmark is searched block by block, so no size of it has
to fit into memory at once (one item always stays whole).

Defined results: a null text has no words; an item that is null, or has no
words, matches nothing; an item whose item_id is null marks words as hit but is
not counted or listed as an item; repeated items count once; repeated documents
give a row each.  Empty tables: no document gives no row, no item gives no hits.
Only doc_id, text and item_id are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _text as T
from lattica.llm._io import table

WINDOW = 10
BLOCK_BYTES = 16 << 20
_MASK = np.uint64((1 << 18) - 1)

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WuManber:
    """Shift table and buckets for patterns of ``m`` words.

    patterns: {words joined by a space, as bytes: list of item ids}
    """

    def __init__(self, m: int, patterns: dict[bytes, list]):
        self.m, self.b = m, min(2, m)
        self.stride = m - self.b + 1
        self.words = list(patterns)
        self.items = list(patterns.values())
        blob = b"\n".join(self.words)
        data = np.frombuffer(blob, np.uint8)
        s, e, _ = T.word_bounds(data, np.array([0, len(data)]), T.ALNUM_WORDS)
        h = T.span_hashes(data, s, e).reshape(len(self.words), m)
        blocks = self.blocks(h)
        self.shift = np.full(int(_MASK) + 1, self.stride, np.int32)
        for j in range(blocks.shape[1]):  # a later block of a pattern has a smaller shift
            at = (blocks[:, j] & _MASK).astype(np.int64)
            self.shift[at] = np.minimum(self.shift[at], blocks.shape[1] - 1 - j)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix, self.order, self.prefix = blocks[order, -1], order, blocks[order, 0]

    def blocks(self, h):
        return T.chain(h[..., :-1], h[..., 1:]) if self.b == 2 else h

    def candidates(self, h, bounds):
        """(first word, pattern) where shift, bucket and prefix agree; ascending by word."""
        none = np.zeros(0, np.int64)
        if len(h) < self.m:
            return none, none
        block = self.blocks(h)  # block[i] ends at word i + b - 1
        probes = np.arange(self.stride - 1, len(block) + self.stride - 1, self.stride)
        # the last probe may lie past the end: then all ends before it stay possible
        sh = np.zeros(len(probes), np.int64)
        inside = probes < len(block)
        sh[inside] = self.shift[(block[probes[inside]] & _MASK).astype(np.int64)]
        # a block at probe p that can stand no further right than sh from the end leaves ends p+sh .. p+stride-1
        live = sh < self.stride
        p, sh = probes[live], sh[live]
        n = self.stride - sh
        ends = np.repeat(p + sh - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ends = ends[ends < len(block)]
        ends = ends[self.shift[(block[ends] & _MASK).astype(np.int64)] == 0]
        first = ends + self.b - self.m
        ok = first >= 0
        ends, first = ends[ok], first[ok]
        row = np.searchsorted(bounds, first, "right") - 1
        ok = first + self.m <= bounds[row + 1]
        ends, first = ends[ok], first[ok]
        lo, hi = np.searchsorted(self.suffix, block[ends], "left"), np.searchsorted(self.suffix, block[ends], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        first = np.repeat(first, n)
        ok = self.prefix[at] == block[first]
        return first[ok], self.order[at[ok]]

    def search(self, data, starts, ends, h, bounds):
        """Confirmed occurrences: (first word, pattern)."""
        first, pattern = self.candidates(h, bounds)
        keep = np.zeros(len(first), bool)
        for i in range(len(first)):
            f = int(first[i])
            found = b" ".join(T.LOWER_BYTES[data[starts[k] : ends[k]]].tobytes() for k in range(f, f + self.m))
            keep[i] = found == self.words[pattern[i]]
        return first[keep], pattern[keep]


def searchers(items, window: int = WINDOW) -> list[WuManber]:
    """items: iterable of (item_id, text)"""
    by: dict[int, dict[bytes, list]] = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        s, e, _ = T.word_bounds(data, np.array([0, len(data)]), T.ALNUM_WORDS)
        words = [T.LOWER_BYTES[data[a:b]].tobytes() for a, b in zip(s, e, strict=True)]
        m = min(window, len(words))
        if m:
            for i in range(len(words) - m + 1):
                own = by.setdefault(m, {}).setdefault(b" ".join(words[i : i + m]), [])
                if item not in own:
                    own.append(item)
    return [WuManber(m, p) for m, p in sorted(by.items())]


def _occurrences(data, off, found):
    """Word count bounds of the rows, and (first word, length, items) of all occurrences."""
    starts, ends, bounds = T.word_bounds(data, off, T.ALNUM_WORDS)
    h = T.span_hashes(data, starts, ends)
    out = []
    for w in found:
        first, pattern = w.search(data, starts, ends, h, bounds)
        out += [(int(f), w.m, w.items[p]) for f, p in zip(first, pattern, strict=True)]
    return bounds, out


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _scan(shared):
    def run(batches):
        found = shared.value
        for rows, data, off in T.text_blocks(batches):
            bounds, hits = _occurrences(data, off, found)
            n = rows.num_rows
            mark = np.zeros(bounds[-1] + 1, np.int64)
            items: dict[int, set] = {}
            if hits:
                first = np.array([x[0] for x in hits])
                np.add.at(mark, first, 1)
                np.add.at(mark, first + np.array([x[1] for x in hits]), -1)
                for r, (_, _, own) in zip(np.searchsorted(bounds, first, "right") - 1, hits, strict=True):
                    items.setdefault(int(r), set()).update(str(x) for x in own if x is not None)
            covered = np.concatenate(([0], np.cumsum(np.cumsum(mark)[:-1] > 0)))
            n_hit = covered[bounds[1:]] - covered[bounds[:-1]]
            none = _digest(())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(items.get(i, ())) for i in range(n)], pa.int64()),
                    pa.array([_digest(items[i]) if i in items else none for i in range(n)], pa.string()),
                    pa.array(n_hit > 0, pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _hits(shared):
    def run(batches):
        found = shared.value
        for rows, data, off in T.text_blocks(batches):
            bounds, hits = _occurrences(data, off, found)
            ids, ties = rows.column("doc_id").to_pylist(), rows.column("tie").to_pylist()
            out = []
            for f, m, own in hits:
                r = int(np.searchsorted(bounds, f, "right") - 1)
                out += [(ids[r], ties[r], f - int(bounds[r]), m, None if x is None else str(x)) for x in own]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    names=["doc_id", "tie", "first", "len", "item"],
                )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    while n > 1:  # blocks are dealt by hash: raise their number until the largest fits, or holds one item
        b = items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("b")).agg(F.sum(F.octet_length("text")).alias("s"), F.count("*").alias("n"))
        if not b.where((F.col("s") > block_bytes) & (F.col("n") > 1)).limit(1).count():
            break
        n *= 2
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)] if n > 1 else [items]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (see RESULT) for each document: its words, and those inside a benchmark window."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    send = lambda items: spark.sparkContext.broadcast(searchers(((r["item_id"], r["text"]) for r in items.collect()), window))  # noqa: E731  at most block_bytes
    if len(blocks) == 1:
        return rows.mapInArrow(_scan(send(blocks[0])), RESULT)
    return _in_blocks(rows, blocks, send)


def _in_blocks(rows, blocks, send):
    """One search for each block of items; words hit and items are joined over blocks."""
    from pyspark.sql import Window

    from lattica.llm._store import save

    keyed = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = None
    for items in blocks:
        hits = save(keyed.mapInArrow(_hits(send(items)), "doc_id long, tie long, first long, len long, item string").distinct(), "hits")
        found = hits if found is None else found.unionByName(hits)
    key = ["doc_id", "tie"]
    spans = found.groupBy(*key, "first").agg(F.max("len").alias("len"))
    w = Window.partitionBy(*key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("first") + F.col("len")).over(w), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("first") + F.col("len") - F.greatest("first", "reach"))
    n_hit = spans.withColumn("reach", reach).groupBy(*key).agg(F.sum(fresh).alias("n_hit"))
    ids = found.where("item is not null").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("ids"))
    base = keyed.mapInArrow(_count, "doc_id long, tie long, n_words long")
    n_hit = n_hit.select(F.col("doc_id").alias("hit_doc"), F.col("tie").alias("hit_tie"), "n_hit")
    ids = ids.select(F.col("doc_id").alias("item_doc"), F.col("tie").alias("item_tie"), "ids")
    out = base.join(n_hit, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("tie") == F.col("hit_tie")), "left")
    out = out.join(ids, F.col("doc_id").eqNullSafe(F.col("item_doc")) & (F.col("tie") == F.col("item_tie")), "left")
    got = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", got.alias("n_hit"), F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"), (got > 0).alias("contaminated"),
    )


def _count(batches):
    for rows, data, off in T.text_blocks(batches):
        _, _, bounds = T.word_bounds(data, off, T.ALNUM_WORDS)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), pa.array(np.diff(bounds), pa.int64())], names=["doc_id", "tie", "n_words"])


def _clean(shared):
    def run(batches):
        found = shared.value
        for rows, data, off in T.text_blocks(batches):
            bounds, hits = _occurrences(data, off, found)
            keep = np.ones(rows.num_rows, bool)
            if hits:
                keep[np.searchsorted(bounds, [f for f, _, _ in hits], "right") - 1] = False
            yield rows.filter(pa.array(keep))

    return run


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without any occurrence of a benchmark window."""
    from lattica.llm._store import save

    spark = docs.sparkSession
    blocks = _blocks(benchmark, block_bytes)
    for k, items in enumerate(blocks):
        shared = spark.sparkContext.broadcast(searchers(((r["item_id"], r["text"]) for r in items.collect()), window))  # at most block_bytes
        docs = docs.mapInArrow(_clean(shared), docs.schema)
        if k + 1 < len(blocks):  # one block of patterns in memory at a time
            docs = save(docs, "clean")
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m,
         list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM pat),
win AS (
  SELECT rid, i, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS p
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT rid, i, win.m, item_id FROM win JOIN pat ON win.p = pat.p AND win.m = pat.m),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hit) GROUP BY rid),
ids AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid)
"""
