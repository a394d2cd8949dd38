"""M7: a similarity index on disk: cells around pivots, blocks that the triangle inequality rules out exactly.

Vectors are scaled to length one, where the cosine is 1 - d**2 / 2 of the distance d.
The pivots are a few vectors of the smallest hashes.  Each vector belongs to the cell of
its nearest pivot, and in a cell vectors lie in blocks by their distance to the pivot.
Of each block the range of distances to every pivot is kept.  A query knows its distance to a
pivot, so no vector of a block can be nearer than the gap between that and the block's range.  A search reads each query's most promising
block first and then only blocks that may still hold something as near.

The index is two Parquet tables below one path (rows by block, and one row a block with
the ranges of distances) and the pivots; later sessions read it back.  Queries and blocks
meet in the tasks of the blocks; what is sent to all tasks is the table of blocks, a row
of two numbers a pivot for each ``block`` vectors, checked to have at most ``MOST_BLOCKS`` rows.

Defined results: rows with a null id or vector are left out; a vector of length zero has similarity 0 to
all; similarities are rounded to 6 places, ties go to the smaller id; a query without any other row has
a null neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.order import positions
from lattica.store import kept, sized

PIVOTS, BLOCK = 32, 1024
MOST_BLOCKS = 1 << 17
SALTS = 8
SLACK = 4e-6  # rounding of similarities, and of distances in 32 bits


def _unit(vec: str):
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return length, F.transform(vec, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


@dataclass
class SimilarityIndex:
    rows: DataFrame  # block, id, vec
    blocks: DataFrame  # block, low, high (an entry a pivot), n
    pivots: DataFrame  # place, vec
    zeros: DataFrame  # id of the vectors of length zero


def build_index(vectors: DataFrame, path: str, pivots: int = PIVOTS, block: int = BLOCK) -> SimilarityIndex:
    """Write the index of ``vectors`` (id, vec) below ``path`` and open it."""
    length, unit = _unit("vec")
    v = vectors.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), unit.alias("vec"), (length > 0).alias("some"))
    v = kept(v, "index-vectors")
    chosen = v.where("some").orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").collect()
    p = np.array([r["vec"] for r in chosen])

    def cells(batches):
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, p.shape[1])
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1), 0.0))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell), pa.array(d[np.arange(len(x)), cell]), pa.array(d.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "vec", "cell", "d", "far"])

    some = v.where("some").select("id", "vec")
    if chosen:
        placed = positions(some.mapInArrow(cells, "id long, vec array<double>, cell long, d double, far array<float>"), ["d"], ["cell"], "_place", "_n")
    else:
        placed = some.select("id", "vec", F.lit(0).cast("long").alias("cell"), F.array().cast("array<float>").alias("far"), F.lit(0).alias("_place"))
    placed = placed.withColumn("block", F.concat_ws("-", F.col("cell").cast("string"), F.expr(f"_place div {block}").cast("string")))
    placed.select("block", "id", "vec", "far").repartitionByRange("block").sortWithinPartitions("block").write.parquet(f"{path}/rows")
    rows = vectors.sparkSession.read.parquet(f"{path}/rows")
    side = lambda f: F.array(*[f(F.col("far")[i]) for i in range(len(chosen))]).cast("array<float>")
    rows.groupBy("block").agg(side(F.min).alias("low"), side(F.max).alias("high"), F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/blocks")
    vectors.sparkSession.createDataFrame([(i, r["vec"]) for i, r in enumerate(chosen)], "place int, vec array<double>").write.parquet(f"{path}/pivots")
    v.where("not some").select("id").write.parquet(f"{path}/zeros")
    return open_index(vectors.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> SimilarityIndex:
    return SimilarityIndex(spark.read.parquet(f"{path}/rows").select("block", "id", "vec"), spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/pivots"), spark.read.parquet(f"{path}/zeros"))


def _visits(queries: DataFrame, index: SimilarityIndex, first: bool) -> DataFrame:
    """(query, qv, block) to compare: the block of the smallest bound, or all others that may hold a vector as near as ``best``."""
    table = index.blocks.orderBy("block").limit(MOST_BLOCKS + 1).toPandas()
    if len(table) > MOST_BLOCKS:
        raise ValueError(f"the index has over {MOST_BLOCKS} blocks: build it with larger ones")
    names = table["block"].to_numpy(object)
    pivots = np.array([r["vec"] for r in index.pivots.orderBy("place").collect()])
    low, high = (np.array(table[c].tolist(), np.float32) for c in ("low", "high"))

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                if not len(names):
                    continue
                q = np.array(part["qv"].tolist())
                d = np.sqrt(np.maximum(2 - 2 * (q @ pivots.T), 0.0)).astype(np.float32)
                gap = np.zeros((len(q), len(names)), np.float32)
                for k in range(d.shape[1]):  # the widest gap of any pivot
                    np.maximum(gap, np.maximum(d[:, k, None] - high[:, k], low[:, k] - d[:, k, None]), out=gap)
                nearest = gap.argmin(1)
                if first:
                    at = (np.arange(len(part)), nearest)
                else:
                    may = 1 - np.maximum(gap - SLACK, 0) ** 2 / 2 >= part["best"].to_numpy(float)[:, None] - SLACK
                    may[np.arange(len(part)), nearest] = False
                    at = np.nonzero(may)
                if len(at[0]):
                    yield pd.DataFrame({"query": part["query"].to_numpy()[at[0]], "qv": [q[k].tolist() for k in at[0]], "block": names[at[1]]})

    return queries.mapInPandas(run, "query long, qv array<double>, block string")


def _compared(visits: DataFrame, index: SimilarityIndex) -> DataFrame:
    """The best (query, id, sim) of each visit: blocks and their queries meet in one task, a batch of queries at a time."""

    def best(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "id": [], "sim": []}
        if len(q) and len(rows):
            rows = rows.sort_values("id")
            x, ids = np.array(rows["vec"].tolist()), rows["id"].to_numpy()
            for i in range(0, len(q), 512):
                part = q.iloc[i : i + 512]
                s = np.round(np.array(part["qv"].tolist()) @ x.T, 6)
                s[part["query"].to_numpy()[:, None] == ids] = -np.inf  # not itself
                k = s.argmax(1)
                top = s[np.arange(len(part)), k]
                fine = np.isfinite(top)
                out["query"] += part["query"].to_numpy()[fine].tolist()
                out["id"] += ids[k[fine]].tolist()
                out["sim"] += top[fine].tolist()
        return pd.DataFrame(out)

    # a block that many queries visit is several tasks; its rows go to those that have queries
    salted = visits.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(SALTS)))
    wanted = salted.select(F.col("block").alias("of"), F.col("salt").alias("share")).distinct()
    rows = index.rows.join(wanted, F.col("block") == F.col("of")).select("of", "share", "id", "vec")
    return salted.groupBy("block", "salt").cogroup(rows.groupBy("of", "share")).applyInPandas(best, "query long, id long, sim double")


def nearest(index: SimilarityIndex, queries: DataFrame) -> DataFrame:
    """(query, nearest, similarity, visited): the most similar other row of each query (id, vec), and the number of blocks that were read for it."""
    length, unit = _unit("vec")
    q = queries.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("query"), unit.alias("qv"), (length > 0).alias("some"))
    q = kept(q, "index-queries")
    some = q.where("some").select("query", "qv")
    top = F.min(F.struct((-F.col("sim")).alias("s"), "id"))
    one = kept(_compared(kept(_visits(some, index, True), "index-visits"), index).groupBy("query").agg(top.alias("b")), "index-first")
    bounded = some.join(one, "query", "left").select("query", "qv", F.coalesce(-F.col("b.s"), F.lit(-1.0)).alias("best"))
    more = kept(_visits(bounded, index, False), "index-visits")
    two = _compared(more, index).groupBy("query").agg(top.alias("b"))
    visited = more.groupBy("query").agg((F.count(F.lit(1)) + 1).alias("visited"))
    zero = index.zeros.orderBy("id").limit(2).collect()  # the smallest two: one may be the query itself
    found = one.unionByName(two)
    for r in zero:
        found = found.unionByName(q.where(F.col("query") != r["id"]).select("query", F.struct(F.lit(-0.0).alias("s"), F.lit(r["id"]).cast("long").alias("id")).alias("b")))
    # a query of length zero is as far from all: the smallest other id
    ids = index.rows.orderBy("id").select("id").limit(2).collect()
    for r in ids:
        found = found.unionByName(q.where(~F.col("some") & (F.col("query") != r["id"])).select("query", F.struct(F.lit(-0.0).alias("s"), F.lit(r["id"]).cast("long").alias("id")).alias("b")))
    best = found.groupBy("query").agg(F.min(F.struct((F.col("b.s") + 0.0).alias("s"), F.col("b.id").alias("id"))).alias("b"))
    out = q.select("query").join(best, "query", "left").join(sized(kept(visited, "index-visited")), "query", "left")
    return out.select("query", F.col("b.id").alias("nearest"), (-F.col("b.s") + 0.0).alias("similarity"), F.coalesce("visited", F.lit(1)).alias("visited"))
