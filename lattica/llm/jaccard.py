"""N-gram Jaccard join by vertical partitioning.

The set of a text is its distinct word shingles (``SHINGLE`` words by default), as 64-bit
hashes; ascending hash is the global order of n-grams.  That order is cut into
fragments, a text's set falls into one part for each fragment, and the overlap
of two texts is the sum of the overlaps of their parts.  Texts of equal sets
are one node; only components of nodes are asked for.

1. Overlaps with anything.  Each fragment counts which n-grams are in more than
   one set; the counts of a set are summed over the fragments.  A set whose sum
   is below the threshold's share of its size can link to nothing.  A batch of
   texts sends an n-gram once at most, so frequent n-grams are no hot keys;
   fragments hold ``FRAGMENT`` n-grams each, however large the input.  Texts of
   equal sets in different batches count as different here, which only keeps more.
2. Pairs that can reach the threshold t.  Two sets of a and b n-grams with
   similarity t or more differ in at most k = (1-t)/(1+t) * (a+b) n-grams.  Sets
   are put into bands of size; for a band the order is cut into more than k
   fragments, so similar sets have at least one fragment in which they agree
   entirely and that is not empty (a set with too many empty fragments also
   registers those).  A set registers the hash of each of its fragments, in its
   own band and in the next one if its partners may lie there.
3. Pairs that need no comparison.  In a bucket of equal fragments all sets are
   compared with one of them, the leader, which is then done: first by parity
   sketches, a lower bound of the distance, then by n-grams.  Sets stay whose
   bucket has another component, and of whose n-grams enough are in sets of other
   components.  Of these, pairs of different components are compared, but for a
   set that is linked to the leader and one far from it (triangle inequality),
   and pairs that sketches rule out.  Sets far from the leader, if there are many
   of them (unrelated texts that share a frequent passage), are dealt out again by
   the fragments of another order, as similar sets agree in one there, too, until
   none are left.  Nothing is capped.

Overlaps of a pair are counted fragment by fragment (``PARTS`` of them) and
summed.  Components come from star contraction over the links.  The pairs
compared within a bucket grow with the square of the sets that are neither
linked to its leader nor far from it; their number is no other's.

Defined results: a null text, or one without words, has no n-gram and is linked
with nothing; a text of fewer words than a shingle has one n-gram, the whole
sequence.  Texts of equal sets are in one component, repeated rows too.  A null
doc_id never is the name of a component; a component without any doc_id has the
name null.  An empty table gives an empty result.  Only doc_id and text are
read, so other columns may have any name.  Equal hashes count as equal n-grams
(64 bits, so a wrong match of two given n-grams has odds of 2**-64); equal sets
are told by two such sums (128 bits).  ``docs`` is read more than once, so it
should be a table or a scan that gives the same rows again.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _text as T
from lattica.llm._io import table
from lattica.llm._store import discard, save

SHINGLE = 3
PERCENT = 90
PARTS = 16
SMALL = 512  # sets of a bucket far from its leader up to which they are compared with the others
STARS = 2  # leaders of a bucket before its rest is compared; the second one links most near copies of a large group that the first one is too far from
SKETCH = 16  # words of a parity sketch, a power of two; with more, the compiled comparison is too long for the JVM's own compiler
ROWS_A_FILE = 100_000  # of the tables of links, whose size is known before they are written
FAR = 0.6  # Jaccard distance to the leader from which a set counts as unrelated to it
BAND = 1.5
BROADCAST_IDS = 1_000_000  # wanted doc ids up to which they are sent to all executors (16 bytes each)
FRAGMENT = 2_000_000  # n-grams of a fragment of step 1
BATCH = 2_000_000  # n-grams of a batch of texts of step 1
BLOCK = 512 << 10  # bytes of text at once
SLICES = 16  # ranges of n-grams of a batch or a fragment that are sorted one by one, as sorting takes many times what is sorted
HOT = 4096  # a node of over 1 / HOT of all rows is joined by broadcast; there are fewer than HOT of them


def sets(data, off, n=SHINGLE):
    """For each row its sorted distinct hashes of shingles of ``n`` words."""
    s, e, bounds = T.word_bounds(data, off, T.SPACE_WORDS)
    h = T.span_hashes(data, s, e)
    rows = len(bounds) - 1
    gram = T.mix(h + np.uint64(n)) if len(h) else h
    for k in range(1, n):
        gram = T.chain(gram[: len(h) - k], h[k:])
    for i in range(rows):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= n:
            yield np.unique(gram[a : b - n + 1])
        elif b > a:
            g = T.mix(h[a : a + 1] + np.uint64(b - a))
            for k in range(a + 1, b):
                g = T.chain(g, h[k : k + 1])
            yield g
        else:
            yield h[:0]


class Bands:
    """Bands of set sizes and the number of fragments of each."""

    def __init__(self, percent: int):
        t = percent / 100
        self.t, self.edges = t, [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        self.edges = np.array(self.edges)
        top = 2 * (self.edges[1:] - 1)  # the largest |a| + |b| in a band
        self.k = np.floor(top * (100 - percent) / (100 + percent)).astype(np.int64)
        self.spare = self.k // 50 + 1  # empty fragments that a set may have
        self.m = self.k + 1 + self.spare

    def of(self, n: int):
        """The bands in which a set of n registers."""
        b = int(np.searchsorted(self.edges, n, "right")) - 1
        yield b
        if int(n / self.t) >= self.edges[b + 1]:  # t <= n / larger
            yield b + 1

    def signatures(self, u: np.ndarray, level: int) -> np.ndarray:
        """Hashes of the fragments of a sorted set, in the order of ``level``."""
        n = len(u)
        if not n:
            return u
        if level:
            u = np.sort(T.mix(u ^ np.uint64(0xA0761D6478BD642F * level % 2**64)))
        v = T.mix(u + np.uint64(0x8EBC6AF09C88C6E3))
        out = []
        for b in self.of(n):
            if not self.k[b]:
                continue  # only equal sets could link, and those are one node
            m, spare = int(self.m[b]), int(self.spare[b])
            frag = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            tag = np.uint64(b * 64 + level)
            out.append(T.chain(np.add.reduceat(v, first), frag[first] * np.uint64(4096) + tag))
            if m - len(first) > spare:
                gone = np.setdiff1d(np.arange(m, dtype=np.uint64), frag[first], assume_unique=True)
                out.append(T.chain(np.zeros(len(gone), np.uint64), gone * np.uint64(4096) + tag))
        return np.concatenate(out) if out else u[:0]


def _sums(u):
    """Two independent hashes of a sorted set, or (None, None) for an empty one."""
    if not len(u):
        return None, None
    return tuple(int(T.mix(u ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (0, 0x3C79AC492BA7B653))


def _node(u, clash):
    """The name of a set: its first hash, or the second one if different sets share the first."""
    a, b = _sums(u)
    return b if a in clash else a


def _lists(arrays):
    """A list<int64> column of uint64 arrays."""
    off = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if len(arrays) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _sketch(u):
    """Parity sketch: an n-gram flips one bit of SKETCH words."""
    bit = (u >> np.uint64(20)) & np.uint64(64 * SKETCH - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8").astype(np.uint64)


def _measured(shingle):
    """(doc_id, size, both hashes) of each text."""

    def run(batches):
        for rows, data, off in T.text_blocks(batches, block_bytes=BLOCK):
            got = list(sets(data, off, shingle))
            sums = [_sums(u) for u in got]
            columns = [rows.column("doc_id"), pa.array([len(u) for u in got], pa.int64()), *(pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "node", "other"])

    return run


# ---- step 1: n-grams that are in more than one set, fragment by fragment -----------------

_ASKS = "to int, batch long, who binary, gram binary, told binary, nodes binary, sizes binary, counts binary"
_names = [c.split()[0] for c in _ASKS.split(", ")]
_types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_types)], names=_names)


def _steps(x):
    """Sorted uint16 numbers as differences, which compress well; _back undoes it."""
    return np.diff(x, prepend=np.uint16(0)).astype("<u2").tobytes()


def _back(b):
    return np.cumsum(np.frombuffer(b, "<u2"), dtype=np.uint16)


def _asks(fragments, shingle, clash):
    """For each batch of texts a row for each fragment: n-grams of one set of the batch with the set's number (``who``
    asks whether another set has ``gram``), and n-grams of several sets (``told``).  One more row holds the batch's sets."""
    low = np.array([-(-f * 2**32 // fragments) << 32 for f in range(fragments)], np.uint64)

    def tables(nodes, sizes, gram, batch):
        own, place = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes), (gram >> np.uint64(60)).astype(np.uint8)
        counts = np.zeros(len(sizes), np.int64)
        part = lambda x: (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        for k in range(SLICES):
            at = np.flatnonzero(place == k)
            at = at[np.argsort(gram[at], kind="stable")]
            if not len(at):
                continue
            some, who = gram[at], own[at]
            start = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
            n = np.diff(np.append(start, len(some)))
            several = np.repeat(n > 1, n)
            counts += np.bincount(who[several], minlength=len(sizes))
            told, asked, who = some[start[n > 1]], some[~several], who[~several]
            first = int(np.searchsorted(low, some[0], "right")) - 1
            last = int(np.searchsorted(low, some[-1], "right"))
            cut, cut_told = (np.concatenate(([0], np.searchsorted(x, low[first + 1 : last]), [len(x)])) for x in (asked, told))
            out = []
            for i in range(last - first):
                w, what, tell = who[cut[i] : cut[i + 1]], asked[cut[i] : cut[i + 1]], told[cut_told[i] : cut_told[i + 1]]
                by = np.argsort(w, kind="stable")
                out.append((first + i, batch, _steps(w[by]), part(what[by]), part(tell), None, None, None))
            yield _table(out)
        yield _table([(batch % fragments, batch, None, None, None, *(np.array(x, "<i8").tobytes() for x in (nodes, sizes, counts)))])

    def run(batches):
        batch = TaskContext.get().partitionId() << 32
        nodes, sizes, size, gram = {}, [], 0, np.empty(BATCH, np.uint64)
        for _, data, off in T.text_blocks(batches, block_bytes=BLOCK):
            for u in sets(data, off, shingle):
                node = _node(u, clash)
                if not len(u) or node in nodes:  # a set counts once in a batch
                    continue
                if nodes and (size + len(u) > BATCH or len(nodes) == 1 << 16):
                    yield from tables(list(nodes), sizes, gram[:size], batch)
                    nodes, sizes, size, batch = {}, [], 0, batch + 1
                if len(u) > len(gram):
                    gram = np.empty(len(u), np.uint64)
                gram[size : size + len(u)] = u
                nodes[node] = None
                sizes.append(len(u))
                size += len(u)
        if nodes:
            yield from tables(list(nodes), sizes, gram[:size], batch)

    return run


def _runs(batches, column):
    """Lists of rows that are next to each other and agree in ``column``."""
    now, rows = None, []
    for b in batches:
        values = ([x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in b.columns)  # bytes stay where they lie
        for r in zip(*values, strict=True):
            if r[column] != now and rows:
                yield rows
                rows = []
            now = r[column]
            rows.append(r)
    if rows:
        yield rows


def _answers(batches):
    """For each batch and fragment the sets' numbers, once for each n-gram that another set has, too."""
    for rows in _runs(batches, 0):
        asks = [r for r in rows if r[2] is not None]
        if asks:
            gram = np.concatenate([np.frombuffer(r[3], "<u4") for r in asks])
            told = np.concatenate([np.frombuffer(r[4], "<u4") for r in asks])
            yes = np.empty(len(gram), bool)
            for k in range(SLICES):
                at = np.flatnonzero(gram >> 28 == k)
                at = at[np.argsort(gram[at], kind="stable")]
                if len(at):
                    by = gram[at]
                    start = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
                    n = np.diff(np.append(start, len(by)))
                    yes[at] = np.repeat((n > 1) | np.isin(by[start], told[told >> 28 == k]), n)
            out, at = [], 0
            for r in asks:
                who = _back(r[2])
                out.append((None, r[1], _steps(who[yes[at : at + len(who)]]), None, None, None, None, None))
                at += len(who)
            yield _table(out)
        if len(asks) < len(rows):
            yield _table([(*r[:5], *(x.to_pybytes() for x in r[5:])) for r in rows if r[2] is None])


def _enough(percent):
    """The sets of each batch whose summed counts reach the threshold's share of their size."""

    def run(batches):
        for rows in _runs(batches, 1):
            own = next(r for r in rows if r[5] is not None)
            node, size, total = (np.frombuffer(own[i], "<i8") for i in (5, 6, 7))
            for r in rows:
                if r[2] is not None:
                    total = total + np.bincount(_back(r[2]), minlength=len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[100 * total >= percent * size], pa.int64())], names=["node"])

    return run


# ---- steps 2 and 3 ------------------------------------------------------------------------

_SETS = "node long, size long, parts array<array<long>>, words array<long>, sigs array<long>"


def _kept(bands, shingle, clash):
    """Sets by fragment, with sketches and signatures."""
    cuts = (np.arange(1, PARTS, dtype=object) * (2**64 // PARTS)).astype(np.uint64)

    def run(batches):
        for _, data, off in T.text_blocks(batches, block_bytes=BLOCK):
            got = [u for u in sets(data, off, shingle) if len(u)]
            if not got:
                continue
            parts = _lists([g for u in got for g in np.split(u, np.searchsorted(u, cuts))])
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * PARTS), parts)
            names = pa.array([_node(u, clash) for u in got], pa.int64())
            columns = [names, pa.array([len(u) for u in got], pa.int64()), parts, _lists([_sketch(u) for u in got]), _lists([bands.signatures(u, 0) for u in got])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "parts", "words", "sigs"])

    return run


def _again(bands, level):
    """Signatures of sets in another order."""

    def run(batches):
        for b in batches:
            sigs = [bands.signatures(np.sort(parts.values.flatten().to_numpy().view(np.uint64)), level) for parts in b.column("parts")]
            yield pa.RecordBatch.from_arrays([b.column("node"), _lists(sigs)], names=["node", "sigs"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, percent: int, shingle: int):
        self.percent, self.shingle, self.bands = percent, shingle, Bands(percent)
        self.reach = 1 - percent / 100
        self.far = max(FAR, 2 * self.reach)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        rows = save(self.docs.mapInArrow(_measured(shingle), "doc_id long, n long, node long, other long"), "sets")
        self.clash = [r[0] for r in rows.where("node is not null").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a < b").select("node").collect()]  # none, or a few among 10**10 sets
        self.rows = rows.withColumn("node", F.when(F.col("node").isin(self.clash), F.col("other")).otherwise(F.col("node"))).drop("other") if self.clash else rows.drop("other")
        nodes = self.rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"))
        self.nodes = save(nodes, "nodes")  # a row for each distinct set
        self.count, self.distinct, self.grams, ids = self.nodes.agg(F.sum("copies"), F.count("*"), F.sum(F.col("copies") * F.col("n")), F.count("id")).first()
        self.comp = self.seen = self.sets = None

    def close(self):
        discard(self.rows, self.nodes, self.sets)

    def survivors(self) -> DataFrame:
        """Nodes of which enough n-grams are in other sets, too."""
        fragments = self.grams // FRAGMENT + 1
        asks = self.docs.mapInArrow(_asks(fragments, self.shingle, frozenset(self.clash)), _ASKS)
        answers = asks.repartitionById(fragments, "to").sortWithinPartitions("to").mapInArrow(_answers, _ASKS)  # a fragment a task
        return answers.repartition("batch").sortWithinPartitions("batch").mapInArrow(_enough(self.percent), "node long").distinct()

    def kept(self) -> DataFrame:
        """The sets of the survivors, from a text of each."""
        nodes = save(self.survivors(), "survivors")
        found = nodes.join(self.nodes, "node")
        ids = save(found.select(F.coalesce("id", F.lit(-(2**63))).alias("id")).distinct(), "ids")
        few = ids.count() <= BROADCAST_IDS
        docs = self.docs.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text")
        out = docs.mapInArrow(_kept(self.bands, self.shingle, frozenset(self.clash)), _SETS)
        if self.rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():  # a repeated id brings other texts along
            out = out.dropDuplicates(["node"]).join(nodes, "node", "left_semi")
        out = save(out, "kept")
        discard(nodes, ids)
        return out

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: overlaps of their parts are counted fragment by fragment and summed."""
        pairs = save(pairs, "cross")
        few = F.broadcast if pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else lambda t: t
        b = self.sets.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("parts").alias("pb"))
        a = self.sets.join(few(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi")  # only parts that a pair asks for are dealt out
        a = a.select(F.col("node").alias("a"), F.col("size").alias("na"), F.posexplode("parts").alias("part", "ga"))
        both = few(pairs).join(b, "b").select("a", "b", "nb", F.posexplode("pb").alias("part", "gb")).where(F.size("gb") > 0).join(a, ["a", "part"])
        partial = save(both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common")).where("common > 0"), "partial")
        total = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        out = save(total.where((100 + self.percent) * F.col("common") >= self.percent * (F.col("na") + F.col("nb"))).select("a", "b"), "links")
        discard(partial, pairs)
        return out

    def small(self, unlike, a, b):
        """Sets of a and b n-grams that differ in ``unlike`` may reach the threshold."""
        return (100 + self.percent) * unlike <= (100 - self.percent) * (a + b)

    def unlike(self):
        """A lower bound of the number of n-grams in which two rows a and b (sizes sa, sb; sketches wa, wb) differ."""
        flips = reduce(add, [F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(SKETCH)])  # compiled, without an object a word
        return F.greatest(flips.cast("long"), F.abs(F.col("sa") - F.col("sb")))

    def star(self, entries: DataFrame) -> DataFrame | None:
        """Compares the members of each bucket of several components with its leader, which is then done.

        Entries are (key, node) and, if known, own: the member with the fewest
        n-grams of its own leads, else the smallest.  Returns (key, node, near) of
        buckets that still have several components; near: 2 linked to the leader, 1
        perhaps within ``far`` of it, 0 surely not.
        """
        entries = self.labelled(entries)
        first = F.min(F.struct("own", "node"))["node"] if "own" in entries.columns else F.min("node")
        stats = entries.groupBy("key").agg(first.alias("leader"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key", "leader")
        members = save(entries.select("key", "node").join(stats, "key").where("node <> leader"), "members")
        side = lambda s: self.sets.select(F.col("node").alias(s), F.col("size").alias("s" + s), F.col("words").alias("w" + s))
        pairs = members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct().join(side("b"), "b").join(side("a"), "a")
        unlike = self.unlike()
        pairs = pairs.select("a", "b", (2 * unlike / (F.col("sa") + F.col("sb") + unlike) <= self.far).alias("close"), self.small(unlike, F.col("sa"), F.col("sb")).alias("maybe"))
        pairs = save(pairs, "pairs")
        if not pairs.limit(1).count():
            return None
        maybe = pairs.where("maybe").select("a", "b")
        cross = self.labelled(self.labelled(maybe, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
        if self.seen is not None:
            cross = cross.join(self.seen, ["a", "b"], "left_anti").join(self.seen.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        links = self.verify(cross)
        known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        self.seen = known if self.seen is None else self.seen.unionByName(known)
        self.add(links)
        near = pairs.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left")
        near = near.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.when(F.col("linked"), 2).when(F.col("close"), 1).otherwise(0).alias("near"))
        out = save(members.join(near, ["leader", "node"]).select("key", "node", "near"), "stars")
        discard(members)
        return out

    def active(self, stars: DataFrame) -> DataFrame:
        """Rows (key, node, comp, near) that may still find a link in their bucket; ``apart`` counts those far from its leader."""
        rows = self.labelled(stars)
        stats = rows.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.sum(F.when(F.col("near") == 1, 1).otherwise(0)).alias("some"), F.sum(F.when(F.col("near") == 0, 1).otherwise(0)).alias("apart"))
        stats = stats.where("c1 < c2 and (some > 0 or apart > 1)").select("key", "some", "apart")
        return rows.join(stats, "key").where("near < 2 or some > 0").select("key", "node", "comp", "near", "apart")

    def pruned(self, rows: DataFrame) -> DataFrame:
        """Adds ``own``, a set's n-grams that no set of another component in ``rows`` has, and drops rows that have too many.

        Sets that can still link share a bucket, so both are in ``rows``.
        """
        rows = save(rows, "active")
        nodes = rows.select("node", "comp").distinct()
        grams = self.sets.join(nodes, "node").select("node", "comp", F.explode(F.flatten("parts")).alias("gram"))
        shared = grams.groupBy("gram").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("gram")
        counts = grams.join(shared, "gram", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
        counts = self.sets.select("node", "size").join(save(counts, "shared"), "node").select("node", "size", (F.col("size") - F.col("n")).alias("own"))
        counts = counts.where(100 * (F.col("size") - F.col("own")) >= self.percent * F.col("size"))
        out = save(rows.join(counts, "node"), "pruned")
        discard(rows)
        return out

    def compared(self, rows: DataFrame) -> None:
        """Pairs of different components within a bucket, but those that sizes, own n-grams, sketches or the leader rule out."""
        rows = rows.where(f"near > 0 or apart <= {SMALL}").join(self.sets.select("node", "words"), "node")
        side = lambda c: rows.select("key", F.col("node").alias(c), *[F.col(n).alias(n[0] + c) for n in ("comp", "near", "size", "own", "words")])
        both = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.abs(F.col("na") - F.col("nb")) < 2))
        size = F.col("sa"), F.col("sb")
        both = both.where(self.small(F.col("oa") + F.col("ob"), *size) & self.small(self.unlike(), *size))
        pairs = both.select("a", "b").distinct().join(self.seen, ["a", "b"], "left_anti")
        pairs = save(pairs, "rest")
        if pairs.limit(1).count():
            self.seen = self.seen.unionByName(pairs)
            self.add(self.verify(pairs))

    def run(self) -> DataFrame | None:
        """(node, comp) of all nodes that are linked to another one, or None."""
        if self.distinct < 2:
            return None
        self.sets = self.kept()
        entries, level = self.sets.select(F.explode("sigs").alias("key"), "node"), 0
        while True:
            for _ in range(STARS):
                stars = self.star(entries)
                if stars is None:
                    return self.comp
                rows = self.pruned(self.active(stars))
                discard(stars)
                entries = rows.select("key", "node", "own")
            rows = save(self.active(rows.drop("comp", "apart", "size", "own")).join(rows.select("key", "node", "size", "own"), ["key", "node"]), "rest")
            if not rows.limit(1).count():
                return self.comp
            self.compared(rows)
            large = rows.where(f"near < 2 and apart > {SMALL}").select("key", "node")
            if not large.limit(1).count():
                return self.comp
            level += 1
            sigs = self.sets.join(large.select("node").distinct(), "node", "left_semi").select("node", "parts").mapInArrow(_again(self.bands, level), "node long, sigs array<long>")
            entries = save(large.join(sigs, "node").select("node", "key", F.explode("sigs").alias("sig")).select(F.xxhash64("key", "sig").alias("key"), "node"), "entries")

    def labelled(self, df: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
        if self.comp is None:
            return df.withColumn(name, F.col(node))
        comp = self.comp.select(F.col("node").alias(node), F.col("comp").alias(name))
        return df.join(comp, node, "left").withColumn(name, F.coalesce(name, node))

    def add(self, found: DataFrame) -> None:
        """Takes in links, which join components, so only a graph of components is contracted."""
        links = self.labelled(self.labelled(found, "a", "ca"), "b", "cb")
        new = components(links.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        if self.comp is None:
            self.comp = new
        elif new is not None:
            old = self.comp.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left")
            added = new.join(self.comp, "node", "left_anti")
            self.comp = save(old.select("node", F.coalesce("now", "comp").alias("comp")).unionByName(added), "components")


def components(links: DataFrame) -> DataFrame | None:
    """(node, comp): each node of the links (a, b), and the smallest node it reaches; None without links.

    Alternating large-star and small-star steps until all edges lead to roots;
    each is written, so a lost executor costs one step.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = save(links, "edges")
    n = edges.count()
    if not n:
        return None
    few, large = 1 + n // ROWS_A_FILE, True
    while True:
        ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"))).groupBy("u").agg(F.sum("up").alias("n"), F.min("up").alias("root"))
        if not ends.where("n > 1 or (n = 1 and root = 0)").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        if large:
            new = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = save(new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(few), "edges")
        discard(edges)
        edges, large = new, not large
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    out = save(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots).coalesce(few), "components")
    discard(edges)
    return out


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row, by shingles of ``shingle`` words and similarity of ``percent`` at least."""
    join = _Join(docs, percent, shingle)
    comp = join.run()
    names = join.nodes.select("node", "id", "copies")
    if comp is not None:
        linked = save(names.join(comp, "node"), "linked")
        least = linked.groupBy("comp").agg(F.min("id").alias("name"))
        names = linked.join(least, "comp").select("node", F.col("name").alias("id"), "copies").unionByName(names.join(comp, "node", "left_anti").where("copies > 1"))
    else:
        names = names.where("copies > 1")
    names = save(names.select("node", F.col("id").alias("component_id"), "copies", F.lit(True).alias("named")), "names")
    # most sets have one row and no link, so their row names itself; a set with very many rows is not joined by its key
    many = (join.count or 0) / HOT
    hot = F.broadcast(names.where(F.col("copies") > many).select("node", "component_id"))  # fewer than HOT rows
    rows = join.rows.select("doc_id", F.col("n").alias("n_shingles"), "node")
    one = rows.join(hot, "node")
    other = rows.join(hot, "node", "left_anti").join(names.where(F.col("copies") <= many).drop("copies"), "node", "left")
    own = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return one.select("doc_id", "n_shingles", "component_id").unionByName(other.select("doc_id", "n_shingles", own.alias("component_id")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, list_aggregate(w[i : i + least(3, len(w)) - 1], 'string_agg', ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
t AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT s.rid, s.g FROM s JOIN t USING (g)),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM c a JOIN c b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (
  SELECT a, b FROM o JOIN z za ON za.rid = a JOIN z zb ON zb.rid = b WHERE 100 * i >= 90 * (za.n + zb.n - i)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(o2.doc_id) AS component_id
FROM d JOIN r ON r.a = d.rid JOIN d o2 ON o2.rid = r.b LEFT JOIN z ON z.rid = d.rid
GROUP BY d.rid, d.doc_id
"""
