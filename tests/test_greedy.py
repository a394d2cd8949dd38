import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import clusters as cu
from lattica.operators import ranking as rk


def sequential(n, links):
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    free, out = set(near), {}
    for k in sorted(near, key=lambda i: (-len(near[i]), i)):
        if k in free:
            for m in {k} | (near[k] & free):
                out[m] = k
            free -= {k} | near[k]
    return out


@pytest.mark.parametrize("kind", ["sparse", "dense", "star", "path", "none"])
def test_clusters_equal_the_sequential_rule(spark, kind):
    rnd, n = random.Random(3), 80
    links = {
        "sparse": [tuple(rnd.sample(range(n), 2)) for _ in range(90)],
        "dense": [tuple(rnd.sample(range(n), 2)) for _ in range(900)],
        "star": [(7, i) for i in range(n) if i != 7] + [(1, 2), (3, 4)],
        "path": [(i, i + 1) for i in range(12)],
        "none": [],
    }[kind]
    pairs = spark.createDataFrame([*links, *links[:3], (5, 5), (None, 3), (900, 4)], "a long, b long")
    ids = spark.createDataFrame([(i, "x") for i in range(n)] + [(3, "y"), (None, "z")], "id long, a string")
    got = {r["id"]: r["cluster"] for r in cu.greedy_clusters(pairs, ids).collect()}
    assert got == sequential(n, links)


def test_folds(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c")], "cluster long, g string")
    got = {r["cluster"]: r for r in cu.cluster_folds(df, "cluster", "g", min_test=3).collect()}
    assert (got[1]["n_test"], got[1]["n_train"], got[1]["test_groups"], got[1]["train_groups"], got[1]["supported"]) == (3, 2, 2, 2, True)
    assert got[2]["reasons"] == "n_test_below_minimum(observed=2,required=3)" and got[2]["train_groups"] == 2


@pytest.mark.parametrize("block", [4, 300])
def test_rankings_equal_one_pick_after_the_other(spark, block):
    r = np.random.default_rng(block)
    rows = [(int(i), "big" if i % 3 else "small", r.normal(size=6).round(1).tolist(), float(r.integers(0, 6)) / 5) for i in range(60)]
    rows += [(100 + i, "big", rows[1][2], 1.0) for i in range(6)] + [(200, "tiny", [0.0] * 6, 0.5)]
    df = spark.createDataFrame([*rows, (None, "big", [1.0] * 6, 9.0), (300, "big", None, 9.0), (301, None, [1.0] * 6, 1.0)], "key long, grp string, vec array<double>, policy double").repartition(5)
    policies = {"top": (F.col("policy"), 0.0), "diverse": (F.col("policy"), 0.5), "far": (0.25 * F.col("policy"), 1.0)}
    k = 15
    got = {}
    for x in rk.greedy_rankings(df, "grp", "key", "vec", policies, k, block=block).collect():
        got[x["grp"], x["policy"], x["place"]] = (x["key"], x["score"])
    want = {}
    for g in ("big", "small", "tiny"):
        own = sorted(x for x in rows if x[1] == g)
        v = np.array([x[2] for x in own])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        for name, (scale, penalty) in {"top": (1, 0), "diverse": (1, 0.5), "far": (0.25, 1)}.items():
            base, near, free = scale * np.array([x[3] for x in own]), np.zeros(len(own)), np.ones(len(own), bool)
            for place in range(1, min(k, len(own)) + 1):
                s = np.where(free, np.round(base - penalty * near, 9), -np.inf)
                i = int(s.argmax())
                free[i] = False
                want[g, name, place] = (own[i][0], s[i])
                near = np.maximum(near, v @ v[i])
    assert got == want
    assert rk.greedy_rankings(df.where("false"), "grp", "key", "vec", policies, 3).count() == 0
