"""Greedy rankings of a pool under several policies at once, without one task over a pool.

A pick is the row with the highest ``base - penalty * nearest``, where ``nearest`` is its
largest cosine to what was picked before (ties: the smaller key).  Scores only fall while
picks are made, so a pass over the pool settles many picks: the best ``block`` rows of each
group and policy, by their scores at that time, are enough for as long as their best
score stays ahead of the row that came next after them, which bounds all others.  Then
the similarities to the new picks are carried into the pool and the next pass begins.
A group's picks are made in one task that holds ``block`` rows, whatever its pool.

A penalty of zero is a plain top-k and takes one pass.  Defined results: rows with a null group, key,
base or vector are left out; a vector of length zero has cosine 0 to all; groups with fewer rows are ranked to
their end; scores are rounded to 9 places before they are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lattica.store import kept, sized

BLOCK = 256


def _units(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _updated(pool: DataFrame, picks: DataFrame, width: int) -> DataFrame:
    """The pool with ``nearest`` raised by new picks: their vectors (at most ``block`` a group and policy) are joined to it."""
    new = picks.groupBy("grp", "policy").agg(F.collect_list("vec").alias("_new"), F.collect_list("key").alias("_keys"))
    rows = pool.join(sized(kept(new, "ranking-new")), ["grp", "policy"], "left")
    rows = rows.where(F.col("_keys").isNull() | ~F.array_contains("_keys", F.col("key"))).drop("_keys")
    names = pool.columns

    def run(batches):
        for batch in batches:
            near = batch.column("nearest").to_numpy(zero_copy_only=False).copy()
            new = batch.column("_new")
            same: dict = {}
            for i, (g, p) in enumerate(zip(batch.column("grp").to_pylist(), batch.column("policy").to_pylist(), strict=True)):
                same.setdefault((g, p), []).append(i)
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in same.values():
                fresh = new[at[0]].as_py()
                if fresh:
                    near[at] = np.maximum(near[at], (x[at] @ np.array(fresh).T).max(1))
            yield pa.RecordBatch.from_arrays([pa.array(near) if c == "nearest" else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(run, pool.schema)


def greedy_rankings(df: DataFrame, group: str, key: str, vec: str, policies: dict[str, tuple[Column, float]], k: int, nearest: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(group, policy, place, key, score): the first ``k`` picks of every policy in every group.

    ``policies`` maps names to (base score, penalty of at least zero); ``nearest`` is the similarity to what a group had before (0 by default).
    """
    if any(p < 0 for _, p in policies.values()):
        raise ValueError("penalties must not be negative: scores have to fall")
    if block < 1 or k < 1:
        raise ValueError("block and k must be positive")
    each = F.array(*[F.struct(F.lit(n).alias("policy"), b.cast("double").alias("base"), F.lit(float(p)).alias("penalty")) for n, (b, p) in policies.items()])
    near = F.lit(0.0) if nearest is None else F.coalesce(nearest.cast("double"), F.lit(0.0))
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = F.transform(vec, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))
    rows = df.select(F.col(group).alias("grp"), F.col(key).alias("key"), unit.alias("vec"), near.alias("nearest"), F.explode(each).alias("e"))
    rows = rows.select("grp", "key", "vec", "nearest", "e.*").where("grp is not null and key is not null and vec is not null and base is not null")
    pool = kept(rows, "ranking-pool")
    first = pool.select(F.size("vec").alias("w")).first()
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    out = S.StructType([S.StructField("grp", kinds["grp"]), S.StructField("policy", S.StringType()), S.StructField("key", kinds["key"]), S.StructField("order", S.IntegerType()), S.StructField("score", S.DoubleType()), S.StructField("vec", S.ArrayType(S.DoubleType()))])
    done = None

    def best(frames):
        """The first block + 1 rows of each group and policy in one task, so that few are shuffled."""
        held = None
        for pdf in frames:
            pdf["score"] = np.round(pdf["base"] - pdf["penalty"] * pdf["nearest"], 9)
            held = pdf if held is None else pd.concat([held, pdf])
            held = held.sort_values(["score", "key"], ascending=[False, True]).groupby(["grp", "policy"], dropna=False, sort=False).head(block + 1)
        if held is not None:
            yield held

    def pick(pdf):
        pdf = pdf.sort_values(["score", "key"], ascending=[False, True]).reset_index(drop=True)
        rest = pdf.iloc[block] if len(pdf) > block else None  # no other row can be ahead of this one
        pdf = pdf.iloc[:block].sort_values("key").reset_index(drop=True)
        x, base, penalty = np.array(pdf["vec"].tolist()), pdf["base"].to_numpy(), float(pdf["penalty"].iloc[0])
        near, free, got = pdf["nearest"].to_numpy().copy(), np.ones(len(pdf), bool), []
        left = k - int(pdf["made"].iloc[0])
        while len(got) < min(left, len(pdf)):
            s = np.where(free, np.round(base - penalty * near, 9), -np.inf)
            i = int(s.argmax())
            if rest is not None and (-s[i], pdf["key"].iloc[i]) >= (-rest["score"], rest["key"]):
                break
            free[i] = False
            got.append((pdf["grp"].iloc[0], pdf["policy"].iloc[0], pdf["key"].iloc[i], int(pdf["made"].iloc[0]) + len(got) + 1, float(s[i]), x[i].tolist()))
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame(got, columns=out.names)

    while first is not None:
        top = pool.mapInPandas(best, S.StructType([*pool.schema.fields, S.StructField("score", S.DoubleType())]))
        w = Window.partitionBy("grp", "policy").orderBy(F.col("score").desc(), "key")
        top = top.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= block + 1).drop("_r")  # block + 1 rows a task at most
        made = done.groupBy("grp", "policy").agg(F.count(F.lit(1)).cast("int").alias("made")) if done is not None else None
        if made is None:
            top = top.withColumn("made", F.lit(0))
        else:
            m = made.select(F.col("grp").alias("_g"), F.col("policy").alias("_p"), "made")
            top = top.join(m, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("policy") == F.col("_p")), "left").drop("_g", "_p").withColumn("made", F.coalesce("made", F.lit(0))).where(F.col("made") < k)
        new = kept(top.groupBy("grp", "policy").applyInPandas(pick, out), "ranking-picks")
        done = new if done is None else done.unionByName(new)
        state = done.groupBy("grp", "policy").agg(F.count(F.lit(1)).alias("n"))
        full = state.where(F.col("n") >= k).select("grp", "policy")
        if not new.limit(1).count():
            break
        pool = kept(_updated(pool, new, first["w"]).join(sized(kept(full, "ranking-full")), ["grp", "policy"], "left_anti"), "ranking-pool")
        if not pool.limit(1).count():
            break
    if done is None:
        done = df.sparkSession.createDataFrame([], out)
    return done.select(F.col("grp").alias(group), "policy", F.col("order").alias("place"), F.col("key").alias(key), "score")
