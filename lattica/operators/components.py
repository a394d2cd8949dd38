"""components of wide sparse rows, as joins and sums over (row, bit, value) cells.

A table of cells has the columns ``id``, ``bit`` (of any type) and ``v``; zeros are left out and rows need not have a
cell.  Nothing of the size of rows times bits, or bits times bits, is ever made: a pass multiplies the cells by a table
of one row a bit (or a row) and sums by row (or by bit).  That table is broadcast if it has at most ``store.SMALL`` rows, and
else joined by its key, where adaptive execution splits frequent bits.  The driver sees numbers of components only.

Defined results: null bits and values are left out, equal cells of a row are added, a null outcome takes the row out of
the fit; more components than the data has are given back as zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.store import kept, sized

TINY = 1e-18


def cells_of(rows: DataFrame, row_id: str, bits: str) -> DataFrame:
    """Cells of value one of the distinct entries of an array column."""
    return rows.select(F.col(row_id).alias("id"), F.explode(F.array_distinct(bits)).alias("bit")).withColumn("v", F.lit(1.0)).where("bit is not null")


def _present(cells: DataFrame) -> DataFrame:
    fine = cells.where(F.col("id").isNotNull() & F.col("bit").isNotNull() & F.col("v").isNotNull())
    return fine.select("id", "bit", F.col("v").cast("double").alias("v"))


def _clean(cells: DataFrame) -> DataFrame:
    return _present(cells).groupBy("id", "bit").agg(F.sum("v").alias("v")).where("v <> 0")


def _patterns(cells: DataFrame) -> DataFrame:
    """Cells (id, n, bit, v) of the distinct rows, which are found once: n rows have the cells of one id (a new one)."""
    one = _clean(cells.select("id", "bit", "v").repartition("id"))  # by row, so that cells are moved once
    rows = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bit", "v"))).alias("row"))
    same = kept(rows.groupBy("row").agg(F.count("*").cast("double").alias("n")).withColumn("id", F.monotonically_increasing_id()), "patterns")
    return same.select("id", "n", F.explode("row").alias("cell")).select("id", "n", "cell.bit", "cell.v")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


# ---- partial least squares


@dataclass
class PLS:
    """Rotations (bit, mean, r1 .. rk) with what to take off each score, and the weight of each score in the prediction."""

    rotations: DataFrame
    offsets: list[float]
    weights: list[float]
    mean: float


def pls(cells: DataFrame, outcomes: DataFrame, components: int) -> PLS:
    """Partial least squares of one outcome, centred and unscaled; ``outcomes`` (id, y) are the training rows.

    Each weight vector is the cross moment of bits and outcome less what the loadings so far explain of it; bits stay joined to
    cells one by one.  Signs: the largest weight is positive (ties: the smallest bit).
    """
    y = outcomes.where(F.col("y").isNotNull()).select("id", F.col("y").cast("double").alias("y"))
    n, total = y.agg(F.count("*"), _sum(F.col("y"))).first()
    mean = total / n if n else 0.0
    y = kept(y.withColumn("y", F.col("y") - mean), "pls-outcomes")
    x = kept(_clean(cells).join(y, "id"), "pls-cells")
    size = F.lit(float(max(n, 1)))
    m = x.groupBy("bit").agg((F.sum("v") / size).alias("mean"), F.sum(F.col("v") * F.col("y")).alias("c"))
    m = kept(m, "pls-bits")
    offsets, weights, gains = [], [], []
    for k in range(1, components + 1):
        raw = F.col("c") - sum((F.col(f"p{j}") * g for j, g in enumerate(gains, 1)), F.lit(0.0))
        m = m.withColumn("raw", raw)
        r = m.agg(F.sum(F.col("raw") * F.col("raw")), F.min(F.struct((-F.round(F.abs("raw"), 9)).alias("a"), "bit", "raw"))["raw"]).first()
        norm = float(np.sqrt(r[0] or 0.0))
        scale = 0.0 if norm < TINY else (1.0 if r[1] >= 0 else -1.0) / norm
        m = m.withColumn(f"w{k}", F.col("raw") * scale).drop("raw")
        dots = m.agg(*[_sum(F.col(f"p{j}") * F.col(f"w{k}")) for j in range(1, k)], F.lit(0.0)).first()
        m = kept(m.withColumn(f"r{k}", F.col(f"w{k}") - sum((F.col(f"r{j}") * dots[j - 1] for j in range(1, k)), F.lit(0.0))), "pls-bits")
        offset = m.agg(_sum(F.col("mean") * F.col(f"r{k}"))).first()[0]
        some = x.join(sized(m.select("bit", f"r{k}")), "bit").groupBy("id").agg(F.sum(F.col("v") * F.col(f"r{k}")).alias("s"))
        scores = kept(y.join(some, "id", "left").select("id", "y", (F.coalesce("s", F.lit(0.0)) - offset).alias("t")), "pls-scores")
        tt, ty, st = scores.agg(_sum(F.col("t") * F.col("t")), _sum(F.col("t") * F.col("y")), _sum(F.col("t"))).first()
        load = x.select("id", "bit", "v").join(sized(scores.select("id", "t")), "id").groupBy("bit").agg(F.sum(F.col("v") * F.col("t")).alias("vt"))
        p = (F.coalesce("vt", F.lit(0.0)) - F.col("mean") * st) / (tt if tt > TINY else 1.0)
        m = kept(m.join(load, "bit", "left").withColumn(f"p{k}", p).drop("vt"), "pls-bits")
        offsets.append(offset)
        weights.append(ty / tt if tt > TINY else 0.0)
        gains.append(ty)
    return PLS(m.select("bit", "mean", *[f"r{k}" for k in range(1, components + 1)]), offsets, weights, mean)


def pls_scores(cells: DataFrame, rows: DataFrame, model: PLS) -> DataFrame:
    """(id, t1 .. tk, prediction) of each id of ``rows``; bits that training didn't have count as zero."""
    k = len(model.offsets)
    some = _present(cells).join(sized(model.rotations.drop("mean")), "bit").groupBy("id").agg(*[F.sum(F.col("v") * F.col(f"r{i}")).alias(f"t{i}") for i in range(1, k + 1)])
    out = rows.select("id").join(some, "id", "left")
    out = out.withColumns({f"t{i}": F.coalesce(f"t{i}", F.lit(0.0)) - model.offsets[i - 1] for i in range(1, k + 1)})
    return out.withColumn("prediction", sum((F.col(f"t{i}") * w for i, w in enumerate(model.weights, 1)), F.lit(model.mean)))


# ---- truncated singular value decomposition


@dataclass
class SVD:
    """Right singular vectors (bit, v1 .. vk), without centring, and their singular values."""

    vectors: DataFrame
    values: list[float]


def _gram(table: DataFrame, names: list[str], weight: Column | None = None) -> np.ndarray:
    n = len(names)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    weight = F.lit(1.0) if weight is None else weight
    r = table.agg(*[_sum(weight * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    g = np.zeros((n, n))
    for (i, j), v in zip(pairs, r, strict=True):
        g[i, j] = g[j, i] = v
    return g


def _times(table: DataFrame, key: str, old: list[str], matrix: np.ndarray, new: list[str]) -> DataFrame:
    cols = [sum((F.col(o) * float(matrix[i, j]) for i, o in enumerate(old)), F.lit(0.0)).alias(n) for j, n in enumerate(new)]
    return table.select(key, *cols)


def _whitening(g: np.ndarray) -> np.ndarray:
    """A matrix that makes columns with the products ``g`` orthonormal; directions of no length become zero."""
    values, vectors = np.linalg.eigh(g)
    fine = values > max(values.max(initial=0.0), 0.0) * 1e-13
    return vectors * np.where(fine, 1 / np.sqrt(np.where(fine, values, 1.0)), 0.0)


def svd(cells: DataFrame, components: int, oversample: int = 10, passes: int = 7, seed=0) -> SVD:
    """The leading singular vectors of the rows of ``cells`` (training rows only), by a randomised range finder.

    Equal rows are one row with a weight, so passes grow with the distinct rows.
    The start is a hashed matrix of one row a bit; each pass multiplies it by the rows and back (two joins, two sums) and
    makes its columns orthonormal from their products.  Signs: the largest entry of a vector is positive (ties: the smallest bit).
    """
    width = components + oversample
    names = [f"z{i}" for i in range(width)]
    x = kept(_patterns(cells), "svd-cells")
    unit = lambda i: F.xxhash64(F.lit(f"{seed}:{i}"), F.col("bit")).cast("double") / F.lit(2.0**63)
    z = kept(x.select("bit").distinct().select("bit", *[unit(i).alias(n) for i, n in enumerate(names)]), "svd-bits")
    for step in range(passes + 1):
        z = _times(z, "bit", names, _whitening(_gram(z, names)), names)
        z = kept(z, "svd-basis")
        y = x.join(sized(z), "bit").groupBy("id").agg(F.max("n").alias("n"), *[F.sum(F.col("v") * F.col(n)).alias(n) for n in names])
        if step < passes:
            y = kept(y, "svd-rows")
            z = kept(x.join(sized(y.drop("n")), "id").groupBy("bit").agg(*[F.sum(F.col("n") * F.col("v") * F.col(n)).alias(n) for n in names]), "svd-bits")
    values, vectors = np.linalg.eigh(_gram(y, names, F.col("n")))  # of the basis's images: squared singular values within it
    top = np.argsort(-values)[:components]
    values = np.sqrt(np.maximum(values[top], 0.0))
    new = [f"v{i}" for i in range(1, len(top) + 1)]
    v = kept(_times(z, "bit", names, vectors[:, top], new), "svd-vectors")
    first = v.agg(*[F.min(F.struct((-F.round(F.abs(n), 9)).alias("a"), "bit", F.col(n).alias("x")))["x"].alias(n) for n in new]).first()
    v = v.select("bit", *[(F.col(n) * (-1.0 if (first[n] or 0.0) < 0 else 1.0)).alias(n) for n in new])
    return SVD(v, values.tolist())


def svd_scores(cells: DataFrame, rows: DataFrame, model: SVD) -> DataFrame:
    """(id, s1 .. sk): each id of ``rows`` times the singular vectors."""
    k = len(model.values)
    some = _present(cells).join(sized(model.vectors), "bit").groupBy("id").agg(*[F.sum(F.col("v") * F.col(f"v{i}")).alias(f"s{i}") for i in range(1, k + 1)])
    return rows.select("id").join(some, "id", "left").select("id", *[F.coalesce(f"s{i}", F.lit(0.0)).alias(f"s{i}") for i in range(1, k + 1)])
