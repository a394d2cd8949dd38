"""Periodic runs of words: stretches that repeat themselves at least three times.

A run is a stretch of consecutive words with smallest period q and a length of at
least ``max(MIN_WORDS, REPEATS * q)`` that no neighbouring word extends keeping q.

Blocks of b = 8, 16, 32 ... words that start at multiples of b are the keys of an
Aho-Corasick automaton, which reads the document.  A key is the sequence of the
numbers of the block's eight eighths (equal stretches have equal numbers, by
doubling from word numbers), so that keys stay short at every scale.  A run of
period q has, for the scale b with b <= q < 2 b (8 for smaller periods), a whole
aligned block that comes again q words later inside of the run: 2 b - 1 + q words
are enough for that, and a run has more.  So each occurrence of a block at a
distance that fits its scale (below 16 for blocks of 8, from b to 2 b - 1
otherwise) is extended in both directions, and what is long enough, once compared
word by word, is a run.

* Blocks none of whose occurrences can be at such a distance are left out of the
  automaton: their first eight words would have to come again there.
* An occurrence inside of a run with a period q of at most b is passed over: by
  the theorem of Fine and Wilf its distance is a multiple of q and leads to that
  same run.  So a document of one word repeated is found at the first scale.
* Extensions are measured for all occurrences at once with prefix hashes and a
  binary search; equal stretches always have equal hashes, so none is measured
  too short, and each found stretch is then compared itself.
* Automata hold blocks of at most ``KEY_WORDS`` words (or one block) and read only
  the part of the document that their blocks can reach.

Texts never leave their row: no shuffle.  Memory is a small multiple of the
largest text.

Defined results: a null text has no words, no runs and a null collapsed text; an
empty one an empty collapsed text.  Of words in several runs each run drops its
own.  Repeated rows are read each on its own; an empty table gives an empty
result.  Other columns are kept; one of the name of a new column is replaced.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lattica.llm import _text as T
from lattica.llm._io import table

MIN_WORDS = 24
REPEATS = 3
BASE = 8  # words of the smallest blocks
KEY_WORDS = 1 << 16

RUN = S.StructType([S.StructField(n, S.LongType(), False) for n in ("start", "length", "period")])

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def numbered(words: list) -> np.ndarray:
    """Each distinct word by a number of its own, in order of first occurrence."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


class _Prefix:
    """Hashes of stretches of ``ids`` in constant time."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        with np.errstate(over="ignore"):
            p = np.full(n + 1, _ODD, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            self.h = np.zeros(n + 1, np.uint64)
            np.cumsum(T.mix(ids.astype(np.uint64) + np.uint64(0x51ED270B)) * p[:n], out=self.h[1:])
            inv = np.full(n + 1, _INV, np.uint64)
            inv[0] = 1
            np.multiply.accumulate(inv, out=inv)
        self.inv, self.n = inv, n

    def same(self, i, j, length):
        with np.errstate(over="ignore"):
            return (self.h[i + length] - self.h[i]) * self.inv[i] == (self.h[j + length] - self.h[j]) * self.inv[j]

    def forward(self, i, j):
        """Words that agree from i and from j > i on, for arrays of places."""
        low, high = np.zeros(len(i), np.int64), self.n - j
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = self.same(i, j, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def backward(self, i, j):
        """Words that agree before i and before j > i."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = self.same(i - mid, j - mid, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _grams(ids: np.ndarray) -> np.ndarray:
    """The number of the group of equal stretches of BASE words that starts at each place, or -1 if there is no other."""
    m = len(ids) - BASE + 1
    h = T.mix(ids.astype(np.uint64))
    g = h[:m]
    for k in range(1, BASE):
        g = T.chain(g, h[k : k + m])
    order = np.argsort(g, kind="stable")
    s = g[order]
    fresh = np.concatenate(([True], s[1:] != s[:-1]))
    number = np.cumsum(fresh) - 1
    group = np.empty(m, np.int64)
    group[order] = np.where(np.bincount(number)[number] > 1, number, -1)
    return group


def _viable(group: np.ndarray, b: int, low: int, high: int, n: int) -> np.ndarray:
    """Aligned blocks whose first words come again from ``low`` to ``high`` words later."""
    at = np.arange(0, n - b - low + 1, b)
    at = at[group[at] >= 0]
    if not len(at):
        return at
    m = len(group) + high + 1
    keys = np.sort(group[group >= 0] * m + np.flatnonzero(group >= 0))
    want = group[at] * m + at
    return at[np.searchsorted(keys, want + high, "right") > np.searchsorted(keys, want + low, "left")]


def _doubled(names: np.ndarray, w: int) -> np.ndarray:
    """Numbers of stretches of 2 w words from those of w words: pairs of numbers are numbered anew."""
    left, right = names[: len(names) - w], names[w:]
    return np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1].reshape(-1)


def _occurrences(names: np.ndarray, blocks: np.ndarray, b: int, low: int, high: int):
    """Pairs (block, distance): each block comes again that many words later.

    A block is the sequence of the numbers of its eight eighths, so the document is read in as many phases as an eighth has words.
    """
    w = b // BASE
    n = len(names) + w - 1
    per = max(1, KEY_WORDS // b)
    for k in range(0, len(blocks), per):
        part = blocks[k : k + per]
        first, last = int(part[0]), min(n, int(part[-1]) + high + b)
        auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        same: dict = {}
        for a in part.tolist():
            key = tuple(names[a : a + b : w].tolist())
            at = same.setdefault(key, [])
            if not at:
                auto.add_word(key, a)
            at.append(a)
        auto.make_automaton()
        places, keys = [], []
        for phase in range(min(w, last - b - first + 1)):
            text = tuple(names[first + phase : last - w + 1 : w].tolist())
            for end, key in auto.iter(text):
                places.append(first + phase + (end - BASE + 1) * w)
                keys.append(key)
        places, keys = np.array(places, np.int64), np.array(keys, np.int64)
        order = np.lexsort((places, keys))
        places, keys = places[order], keys[order]
        for at in same.values():
            i, j = np.searchsorted(keys, at[0]), np.searchsorted(keys, at[0], "right")
            seen, a = places[i:j], np.array(at, np.int64)
            i, j = np.searchsorted(seen, a + low), np.searchsorted(seen, a + high, "right")
            count = j - i
            if count.sum():
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                a = np.repeat(a, count)
                yield a, seen[np.repeat(i, count) + step] - a


def runs(ids: np.ndarray, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the word numbers ``ids``, by start and period."""
    if min_words < 3 * BASE or repeats < 3:
        raise ValueError(f"runs have at least {3 * BASE} words and three repeats")
    n = len(ids)
    if n < min_words:
        return []
    group = _grams(ids)
    if (group < 0).all():
        return []
    found: dict = {}  # (start, end): period
    prefix = None
    names, w = ids, 1  # numbers of stretches of w words
    b = BASE
    while b * repeats <= n:
        low, high = (1, 2 * BASE - 1) if b == BASE else (b, 2 * b - 1)
        blocks = _viable(group, b, low, high, n)
        if len(blocks) and found:
            blocks = blocks[~_inside(found, b, blocks, blocks + high + b)]
        if len(blocks):
            while w < b // BASE:
                names, w = _doubled(names, w), 2 * w
            pairs = list(_occurrences(names, blocks, b, low, high))
            if pairs:
                prefix = prefix or _Prefix(ids)
                at, far = (np.concatenate(x) for x in zip(*pairs, strict=True))
                if b == BASE:  # periods up to 8 first: what they explain is passed over at larger distances
                    for d in range(1, BASE + 1):
                        _extend(ids, prefix, at[far == d], far[far == d], b, found, min_words, repeats)
                    at, far = at[far > BASE], far[far > BASE]
                _extend(ids, prefix, at, far, b, found, min_words, repeats)
        b *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _inside(found: dict, b: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each stretch lies inside of a known run with a period of at most b."""
    known = np.array(sorted((s, e) for (s, e), q in found.items() if q <= b), np.int64).reshape(-1, 2)
    reach = np.concatenate(([0], np.maximum.accumulate(known[:, 1]))) if len(known) else np.zeros(1, np.int64)
    return reach[np.searchsorted(known[:, 0], start, "right")] >= end


def _extend(ids, prefix, at, far, b, found, min_words, repeats):
    """Extend the occurrences of ``at`` at distances ``far`` and add the runs to ``found``."""
    if found and len(at):
        inside = _inside(found, b, at, at + far + b)
        at, far = at[~inside], far[~inside]
    if not len(at):
        return
    start = at - prefix.backward(at, at + far)
    end = at + far + prefix.forward(at, at + far)
    good = end - start >= np.maximum(min_words, repeats * far)
    if not good.any():
        return
    for d, s, e in np.unique(np.stack((far[good], start[good], end[good]), 1), axis=0).tolist():
        if (s, e) in found:  # periods ascend: d is a multiple of a smaller one
            continue
        if not np.array_equal(ids[s : e - d], ids[s + d : e]):  # hashes agreed by chance
            s, e = _stretch(ids, at[(far == d) & (start == s)][0], d)
            if e - s < max(min_words, repeats * d) or (s, e) in found:
                continue
        found[s, e] = d


def _stretch(ids, a, d):
    """Bounds of the stretch of period d around place a, word by word."""
    differ = np.flatnonzero(ids[:-d] != ids[d:])
    k = np.searchsorted(differ, a)
    return (int(differ[k - 1]) + 1 if k else 0), (int(differ[k]) if k < len(differ) else len(ids) - d) + d


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run drops: each run drops all after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with the columns ``runs`` (array of start, length and period, by start and period) and ``collapsed`` (the
    text without the words that runs drop, joined by one space)."""
    new = {"runs": S.ArrayType(RUN, False), "collapsed": S.StringType()}
    rest = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in new])
    schema = S.StructType([*rest.schema.fields, *[S.StructField(k, v) for k, v in new.items()]])

    def run(batches):
        for rows, data, off in T.text_blocks(batches, text):
            valid = rows.column(text).is_valid().to_pylist()
            counts, columns, left = [0], ([], [], []), []
            for i in range(rows.num_rows):
                words = data[off[i] : off[i + 1]].tobytes().split()  # at the bytes of ASCII white space
                got = runs(numbered(words), min_words, repeats) if len(words) >= min_words else []
                if got:
                    words = [w for w, k in zip(words, kept(len(words), got).tolist(), strict=True) if k]
                left.append(b" ".join(words) if valid[i] else None)
                counts.append(counts[-1] + len(got))
                for column, values in zip(columns, zip(*got, strict=True), strict=False):
                    column.extend(values)
            values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)
            collapsed = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, lists, collapsed], names=[*rows.schema.names, "runs", "collapsed"])

    return rest.mapInArrow(run, schema)


def strongest(runs_: Column) -> Column:
    """The run of the greatest length / period, compared in whole numbers; the first of equal ones, null without runs."""
    better = lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x)
    return F.aggregate(runs_, F.lit(None).cast(RUN), better)


def planted(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text) of the query: one in ten, told by crc32 of doc_id, repeats its words from some place on.

    With g = floor(crc32 / 10) and n > 0 words, each word i from a = g % n on becomes word a + (i - a) % p of the text, with
    p = 1 + floor((n - a) / (3 + g % 8)).  Documents without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    x = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", F.expr("h div 10").alias("g"), (F.coalesce(F.col("h") % 10, F.lit(1)) == 0).alias("hit"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    x = x.withColumn("w", F.when(F.col("hit"), words)).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    a = F.expr("cast(g % nullif(n, 0) as int)")
    p = F.expr("cast(1 + (n - cast(g % nullif(n, 0) as int)) div (3 + g % 8) as int)")
    x = x.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    changed = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')")
    return x.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", strongest(F.col("runs")))
    line = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )
