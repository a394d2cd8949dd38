"""Tree ensembles grown level by level from histograms that Spark sums.

Features are coded into bins of equal width between the smallest and the largest
training value, outcomes are whole numbers, and all draws are hashes, so a model
is the same for any order and partitioning of its rows.

A level is one pass over the coded table.  Each task routes its rows through the
trees so far and adds up weights and outcomes by (tree, node, feature, bin); Spark
sums those cells, chooses the splits, and the driver gets one row a node: its size
is bounded by the settings (trees, depth), never by the data.  More trees than
``CELLS`` cells allow are grown in turns.

Defined results: a null or NaN feature has a bin of its own below all others;
rows with a null outcome are left out of the fit; rows to predict may lie outside
of the training range (first or last bin).  A node is split only if that lowers
the squared error.  Without training rows predictions are null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lattica.store import kept

CELLS = 1 << 22  # cells of a task's histogram
LARGEST = 2**36  # outcomes below it are summed exactly in a batch
CODES = 1 << 16  # different rows of codes up to which a task works by code instead of by row
SUB = 4096  # rows of a batch


# ---- codes and draws


def ranges(df: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """The smallest and largest finite value of each feature; (0, 0) without any."""
    x = [F.col(f).cast("double") for f in features]
    fine = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) for c in x]
    r = df.agg(*[a(c).alias(f"{n}{i}") for i, c in enumerate(fine) for n, a in (("lo", F.min), ("hi", F.max))]).first()
    return [(r[f"lo{i}"] or 0.0, r[f"hi{i}"] or 0.0) for i in range(len(features))]


def codes(features: list[str], limits: list[tuple[float, float]], bins: int) -> Column:
    """An array of bins: 0 for null or NaN, else 1 to ``bins``."""
    out = []
    for f, (lo, hi) in zip(features, limits, strict=True):
        x = F.col(f).cast("double")
        at = F.floor((F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - lo) * bins / (hi - lo)) if hi > lo else F.lit(0)
        out.append(F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + F.least(F.lit(bins - 1), at)).cast("int"))
    return F.array(*out)


def poisson_limits() -> list[int]:
    """The distribution function of a Poisson variable of mean 1, in units of 2**-32, as far as it is below one."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(1, 40):
        total += p
        p /= k
        if int(total * 2**32) >= 2**32 - 1:
            break
        out.append(int(total * 2**32))
    return out


def poisson_weights(seed, row_id: str, members: int) -> Column:
    """How often each of ``members`` bootstrap samples holds a row: eight draws from each hash of (seed, block, id)."""
    limits = poisson_limits()
    out = []
    for m in range(members):
        digest = F.sha2(F.concat_ws(":", F.lit(f"{seed}:weights:{m // 8}"), F.col(row_id).cast("string")), 256)
        draw = F.conv(F.substring(digest, 8 * (m % 8) + 1, 8), 16, 10).cast("long")
        out.append(sum(((draw >= t).cast("int") for t in limits), F.lit(0)))
    return F.array(*out)


# ---- models


@dataclass
class Trees:
    """Trees of one model as heaps: the children of node i are 2 i and 2 i + 1; ``feature`` is -1 at leaves."""

    features: list[str]
    limits: list[tuple[float, float]]
    bins: int
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    total: np.ndarray
    weight: np.ndarray
    member: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    @classmethod
    def empty(cls, features, limits, bins, depth, trees, member=None):
        shape = (trees, 2 ** (depth + 1))
        return cls(features, limits, bins, depth, np.full(shape, -1), np.zeros(shape, int), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(trees, int) if member is None else member)

    def route(self, x: np.ndarray, t: int) -> np.ndarray:
        """The leaf of each coded row in tree t."""
        node = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[t, node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > self.cut[t, node]
            node = np.where(inner, 2 * node + right, node)
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        """The mean outcome of each row's leaf, a column a tree; NaN without training rows."""
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = self.total / self.weight
        return np.stack([mean[t, self.route(x, t)] for t in range(len(mean))], 1)


def _grid(width: int, bins: int) -> np.ndarray | None:
    """Every row of codes that ``width`` features can have; None if there are more than CODES."""
    size = bins + 1
    if size**width > CODES:
        return None
    return np.stack([np.arange(size**width) // size**i % size for i in range(width)], 1).reshape(-1, width)


class _Coded:
    """The coded rows of a task's batches, one batch after the other: what follows from codes alone is found for all codes at
    once, if there are few of them, else for the rows of the batch."""

    def __init__(self, width: int, bins: int):
        self.width, self.radix, self.grid, self.known = width, (bins + 1) ** np.arange(width), _grid(width, bins), {}

    def take(self, codes: pa.Array) -> None:
        x = _matrix(codes, self.width)
        if self.grid is None:
            self.x, self.known = x, {}
        else:
            self.at = x @ self.radix

    def of(self, name, find) -> np.ndarray:
        """``find(codes)`` of each row, a function of its codes; ``name`` tells it from others."""
        if name not in self.known:
            self.known[name] = find(self.x if self.grid is None else self.grid)
        return self.known[name] if self.grid is None else self.known[name][self.at]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pieces(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, SUB):
            yield batch.slice(i, SUB)


def _cells(table: DataFrame, model: Trees, level: int, chosen: list[int], target) -> DataFrame:
    """(tree, node, feature, bin, w, s) of the open nodes of a level, summed over all rows.

    ``target`` gives the weights and outcomes of tree t from the columns of a batch.
    """
    width, bins, first = len(model.features), model.bins + 1, 2**level
    shape = (len(chosen), first, width, bins)
    openings = model.feature[:, first // 2 : first] if level else None

    def add(w, s, k, t, x, node, weight, y):
        """Adds the rows of tree t that are in open nodes of the level."""
        live = (node >= first) & (weight > 0)
        if openings is not None:
            live &= openings[t][np.where(node >= first, node // 2 - first // 2, 0)] >= 0
        r = np.flatnonzero(live)
        base = (k * first + node[r] - first) * width
        for f in range(width):
            key = (base + f) * bins + x[r, f]
            np.add.at(w, key, weight[r])
            np.add.at(s, key, y[r])

    def run(batches):
        w, s = np.zeros(shape, np.int64).ravel(), np.zeros(shape, np.int64).ravel()
        rows = _Coded(width, model.bins)
        few = rows.grid is not None
        by_code = np.zeros((2, len(chosen), len(rows.grid)), np.int64) if few else None
        for batch in _pieces(batches):
            rows.take(batch.column("codes"))
            for k, t in enumerate(chosen):
                weight, y = target(batch, rows, t)
                weight = weight.astype(np.int64)
                if few:
                    np.add.at(by_code[0, k], rows.at, weight)
                    np.add.at(by_code[1, k], rows.at, weight * y)
                else:
                    add(w, s, k, t, rows.x, rows.of(t, lambda x, t=t: model.route(x, t)), weight, weight * y)
        for k, t in enumerate(chosen if few else ()):
            add(w, s, k, t, rows.grid, model.route(rows.grid, t), *by_code[:, k])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array(s[at])], names=["key", "w", "s"])

    cells = table.mapInArrow(run, "key long, w long, s long").groupBy("key").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    unit = width * bins
    tree = F.array(*[F.lit(int(t)) for t in chosen])[F.expr(f"cast(key div {unit * first} as int)")]
    return cells.select(
        tree.alias("tree"),
        (F.expr(f"key div {unit}") % first + first).alias("node"),
        (F.expr(f"key div {bins}") % width).alias("feature"),
        (F.col("key") % bins).alias("bin"),
        "w",
        "s",
    )


def _split_sums(cells: DataFrame, cut: Column | None, min_leaf: int) -> DataFrame:
    """The best split of each node (tree, node, w, s, feature, cut, wl, sl): the largest fall of the squared error, ties to the
    smaller feature and cut; null if none lowers it.  ``cut`` is the one bin tried for (tree, node, feature), of ``lo`` and ``hi``;
    without it all bins are tried."""
    of = Window.partitionBy("tree", "node", "feature")  # at most as many rows as there are bins
    x = cells.withColumns({"lo": F.min("bin").over(of), "hi": F.max("bin").over(of), "tw": F.sum("w").over(of), "ts": F.sum("s").over(of)})
    if cut is None:
        run = of.orderBy("bin")
        tried = x.withColumns({"cut": F.col("bin"), "wl": F.sum("w").over(run), "sl": F.sum("s").over(run)})
    else:
        x = x.withColumn("cut", cut)
        left = F.col("bin") <= F.col("cut")
        tried = x.groupBy("tree", "node", "feature", "cut", "tw", "ts").agg(F.sum(F.when(left, F.col("w")).otherwise(0)).alias("wl"), F.sum(F.when(left, F.col("s")).otherwise(0)).alias("sl"))
    square = lambda s, w: F.col(s).cast("double") * F.col(s) / F.nullif(F.col(w), F.lit(0))
    tried = tried.withColumns({"wr": F.col("tw") - F.col("wl"), "sr": F.col("ts") - F.col("sl")})
    fine = (F.col("wl") >= min_leaf) & (F.col("wr") >= min_leaf)
    gain = F.when(fine, square("sl", "wl") + square("sr", "wr") - square("ts", "tw"))
    best = F.min(F.when(gain > 0, F.struct((-gain).alias("g"), "feature", "cut", "wl", "sl")))
    return tried.groupBy("tree", "node").agg(F.first("tw").alias("w"), F.first("ts").alias("s"), best.alias("b")).select("tree", "node", "w", "s", "b.feature", "b.cut", "b.wl", "b.sl")


def _grow(table: DataFrame, model: Trees, trees: list[int], target, cut: Column | None, min_leaf: int) -> None:
    """Grow ``trees`` of ``model`` in place."""
    width, grid = len(model.features) * (model.bins + 1), _grid(len(model.features), model.bins)
    for level in range(model.depth):
        if level:
            still = [t for t in trees if (model.feature[t, 2 ** (level - 1) : 2**level] >= 0).any()]
        else:
            still = trees
        at_once = max(1, CELLS // max(width * 2**level, len(grid) if grid is not None else 0))
        for i in range(0, len(still), at_once):
            found = _split_sums(_cells(table, model, level, still[i : i + at_once], target), cut, min_leaf).collect()  # a row a node
            for r in found:
                t, n = r["tree"], r["node"]
                model.total[t, n], model.weight[t, n] = r["s"], r["w"]
                if r["feature"] is not None:
                    model.feature[t, n], model.cut[t, n] = r["feature"], r["cut"]
                    model.total[t, 2 * n], model.weight[t, 2 * n] = r["sl"], r["wl"]
                    model.total[t, 2 * n + 1], model.weight[t, 2 * n + 1] = r["s"] - r["sl"], r["w"] - r["wl"]


def _training(df: DataFrame, features, limits, bins, y, weights: Column | None, name: str) -> DataFrame:
    x = df.where(F.col(y).isNotNull()).select(codes(features, limits, bins).alias("codes"), F.col(y).cast("long").alias("y"), *([weights.alias("weights")] if weights is not None else []))
    return kept(x, name)


def extra_trees(df: DataFrame, features: list[str], y: str, row_id: str, seed=0, members: int = 8, trees: int = 16, depth: int = 6, bins: int = 64, min_leaf: int = 1) -> Trees:
    """Bootstrap extra trees: ``members`` samples of the rows, ``trees`` trees of random cuts on each.

    A sample holds each row a Poisson number of times, drawn from the hash of its id.  In each node every feature gets one cut,
    drawn between its smallest and largest bin there from the hash of (seed, tree, node, feature); the best of those is taken.
    """
    limits = ranges(df, features)
    table = _training(df, features, limits, bins, y, poisson_weights(seed, row_id, members), "extra-trees")
    model = Trees.empty(features, limits, bins, depth, members * trees, np.repeat(np.arange(members), trees))
    member = model.member

    def target(batch, rows, t):
        y_ = batch.column("y").to_numpy()
        if len(y_) and np.abs(y_).max() >= LARGEST:
            raise ValueError(f"outcomes must be below {LARGEST}")
        return _matrix(batch.column("weights"), members)[:, member[t]], y_

    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}:cut"), F.col("tree").cast("string"), F.col("node").cast("string"), F.col("feature").cast("string")), 256), 1, 12), 16, 10).cast("long")
    cut = F.col("lo") + F.shiftright(draw * (F.col("hi") - F.col("lo")), 48)
    _grow(table, model, list(range(members * trees)), target, cut, min_leaf)
    return model


def ensemble_predictions(df: DataFrame, model: Trees, point: str = "prediction", spread: str = "spread") -> DataFrame:
    """``df`` with the mean of the members' predictions (each the mean of its trees) and their population deviation."""
    members = int(model.member.max(initial=0)) + 1
    rest = df.select(*[df[f"`{c}`"] for c in df.columns if c not in (point, spread)])
    names = rest.columns
    coded = rest.withColumn("__codes", codes(model.features, model.limits, model.bins))
    schema = S.StructType([*rest.schema.fields, S.StructField(point, S.DoubleType()), S.StructField(spread, S.DoubleType())])

    def by_member(x):
        v = model.values(x) if len(x) else np.zeros((0, len(model.feature)))
        return np.stack([v[:, model.member == m].mean(1) for m in range(members)], 1)

    def run(batches):
        rows = _Coded(len(model.features), model.bins)
        for batch in _pieces(batches):
            rows.take(batch.column("__codes"))
            by = rows.of("members", by_member)
            columns = [batch.column(c) for c in names] + [pa.array(by.mean(1), from_pandas=True), pa.array(by.std(1), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, point, spread])

    return coded.mapInArrow(run, schema)


# ---- boosting for quantiles


@dataclass
class Boosted:
    """Boosted trees for several quantiles at once; tree r * len(quantiles) + q is round r of quantile q."""

    trees: Trees
    quantiles: list[float]
    start: np.ndarray
    leaf: np.ndarray  # what each node adds, in whole units
    rounds: int

    def predict(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Predictions in whole units, a column a quantile."""
        k = len(self.quantiles)
        out = np.tile(self.start, (len(x), 1))
        for t in range((self.rounds if upto is None else upto) * k):
            out[:, t % k] += self.leaf[t, self.trees.route(x, t)]
        return out


def quantile_rank(n: int, q: float) -> int:
    """The place (from 1) of the q-quantile among n ordered values."""
    return min(n, max(1, math.ceil(q * n)))


def _leaf_quantiles(table: DataFrame, value, coded: tuple[int, int], size: int, qs: np.ndarray, low: int, high: int, buckets: int = 1024) -> np.ndarray:
    """For each of ``size`` groups the value at its quantile's place, by counts in ever finer buckets.

    ``value`` gives (groups, values) of a batch and its coded rows, one pair of arrays for each model; ``coded`` are the numbers of
    features and bins.  Groups are numbered from 0 and
    qs[g] is the quantile of group g.  Each pass counts, in each group, the values in ``buckets`` parts of the range that is
    left, and the part where the place lies is the next range.  Passes: the logarithm of the range to the base ``buckets``.
    """
    lo, hi = np.full(size, low, np.int64), np.full(size, high, np.int64)
    place, known = np.zeros(size, np.int64), False
    while (hi > lo).any():
        step = np.maximum(1, -(-(hi - lo + 1) // buckets))
        a, b, st = lo.copy(), hi.copy(), step.copy()

        def run(batches, a=a, b=b, st=st):
            count, of_task = np.zeros(size * buckets, np.int64), _Coded(*coded)
            for batch in _pieces(batches):
                of_task.take(batch.column("codes"))
                for g, v in value(batch, of_task):
                    inside = (v >= a[g]) & (v <= b[g])
                    g, v = g[inside], v[inside]
                    count += np.bincount(g * buckets + (v - a[g]) // st[g], minlength=len(count))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["key", "n"])

        rows = table.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # groups x buckets at most
        count = np.zeros(size * buckets, np.int64)
        for r in rows:
            count[r["key"]] = r["n"]
        count = count.reshape(size, buckets)
        if not known:
            place, known = np.array([quantile_rank(int(n), q) if n else 0 for n, q in zip(count.sum(1), qs, strict=True)]), True
            empty = place == 0
            hi[empty] = lo[empty]
        cum = np.cumsum(count, 1)
        k = np.minimum((cum < place[:, None]).sum(1), buckets - 1)
        place = place - np.where(k > 0, cum[np.arange(size), np.maximum(k - 1, 0)], 0)
        wide = hi > lo
        lo = np.where(wide, a + k * step, lo)
        hi = np.where(wide, np.minimum(b, lo + step - 1), hi)
    return lo


def quantile_boosting(df: DataFrame, features: list[str], y: str, quantiles=(0.5, 0.05, 0.95), rounds: int = 20, depth: int = 3, rate: tuple[int, int] = (1, 10), bins: int = 64, min_leaf: int = 1) -> Boosted:
    """Gradient boosting of the pinball loss, one model a quantile, all grown in the same passes.

    Each starts at the quantile of the outcomes.  A tree of squared errors is fitted to the loss's gradient (its sign only: the
    quantile above the prediction, the quantile less one otherwise), and each leaf then moves its rows by ``rate`` (a fraction)
    times the quantile of their residuals, rounded down to whole units of the outcome.  Order statistics come from counts in
    buckets, so no leaf is ever gathered.
    """
    qs, k = list(quantiles), len(quantiles)
    limits = ranges(df, features)
    table = _training(df, features, limits, bins, y, None, "boosting")
    model = Boosted(Trees.empty(features, limits, bins, depth, rounds * k), qs, np.zeros(k, np.int64), np.zeros((rounds * k, 2 ** (depth + 1)), np.int64), 0)
    edge = table.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if edge["lo"] is None:
        return model
    if max(abs(edge["lo"]), abs(edge["hi"])) >= LARGEST:
        raise ValueError(f"outcomes must be below {LARGEST}")
    width = len(features)
    unit = 1000  # gradients in thousandths: whole numbers, so sums are exact
    up = [round(q * unit) for q in qs]

    def outcomes(batch, rows):
        y_ = batch.column("y").to_numpy()
        return [(np.full(len(y_), q), y_) for q in range(k)]

    model.start = _leaf_quantiles(table, outcomes, (width, bins), k, np.array(qs), edge["lo"], edge["hi"])
    heap = 2 ** (depth + 1)
    least, most = model.start.copy(), model.start.copy()  # what any row's prediction can be
    for r in range(rounds):
        now = [r * k + q for q in range(k)]

        def gradient(batch, rows, t, model=model, r=r):
            y_ = batch.column("y").to_numpy()
            above = y_ > rows.of("predicted", lambda x: model.predict(x, r))[:, t % k]
            return np.ones(len(y_), np.int64), np.where(above, up[t % k], up[t % k] - unit)

        _grow(table, model.trees, now, gradient, None, min_leaf)

        def residuals(batch, rows, model=model, r=r):
            rest = batch.column("y").to_numpy()[:, None] - rows.of("predicted", lambda x: model.predict(x, r))
            return [(q * heap + rows.of(q, lambda x, q=q: model.trees.route(x, r * k + q)), rest[:, q]) for q in range(k)]

        moves = _leaf_quantiles(table, residuals, (width, bins), k * heap, np.repeat(qs, heap), int(edge["lo"] - most.max()), int(edge["hi"] - least.min()))
        step = (moves.reshape(k, heap) * rate[0]) // rate[1]
        used = np.zeros((k, heap), bool)
        for q in range(k):
            inner = np.flatnonzero(model.trees.feature[r * k + q] >= 0)
            leaves = {1, *(2 * inner), *(2 * inner + 1)} - set(inner.tolist())
            used[q, sorted(leaves)] = True
        model.leaf[now] = np.where(used, step, 0)
        least += model.leaf[now].min(1)
        most += model.leaf[now].max(1)
        model.rounds = r + 1
    return model


def quantile_predictions(df: DataFrame, model: Boosted, point: str = "prediction", low: str = "low", high: str = "high") -> DataFrame:
    """``df`` with the first quantile as the point, and the least and greatest of all quantiles as raw bounds."""
    new = (point, low, high)
    rest = df.select(*[df[f"`{c}`"] for c in df.columns if c not in new])
    names, t = rest.columns, model.trees
    coded = rest.withColumn("__codes", codes(t.features, t.limits, t.bins))
    schema = S.StructType([*rest.schema.fields, *[S.StructField(c, S.LongType()) for c in new]])

    def run(batches):
        rows = _Coded(len(t.features), t.bins)
        for batch in _pieces(batches):
            rows.take(batch.column("__codes"))
            p = rows.of("predicted", model.predict)
            columns = [batch.column(c) for c in names] + [pa.array(p[:, 0]), pa.array(p.min(1)), pa.array(p.max(1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    out = coded.mapInArrow(run, schema)
    return out if model.rounds else out.withColumns({c: F.lit(None).cast("long") for c in new})


def pinball_loss(y: Column, bound: Column, q: float) -> Column:
    """The loss of a quantile: q times what the outcome lies above, 1 - q times what it lies below."""
    return F.when(y > bound, F.lit(q) * (y - bound)).otherwise(F.lit(1 - q) * (bound - y))
