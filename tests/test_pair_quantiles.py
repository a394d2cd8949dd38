"""Quantiles of pair similarity over all pairs, without a threshold."""

import numpy as np

from lattica import catalog
from lattica.operators import similarity as sm


def wanted(ids, x):
    x = np.array(x, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)[np.array(ids)[:, None] < np.array(ids)[None, :]]
    return [len(s), *np.percentile(s, [5, 25, 50, 75, 95])]


def test_query_counts_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = catalog.queries()["pair_quantiles"](spark, d).first()
    assert got["n"] == len(rows) * (len(rows) - 1) // 2 and got["q05"] < 0
    assert np.allclose(list(got), wanted([r[0] for r in rows], [r[1] for r in rows]), atol=2e-6)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(sm, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 150):
        x = rng.normal(size=(n, 6))
        if n > 100:
            x[:30] = x[0]  # many pairs of similarity 1
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
        got = list(sm.pair_quantiles(df).first())
        assert got == [0] + [None] * 5 if n == 1 else np.allclose(got, wanted(range(n), x), atol=2e-6)


def test_pairs_are_counted_once_if_the_guess_is_right(spark, monkeypatch):
    passes, whole = [], sm._over_blocks
    monkeypatch.setattr(sm, "_over_blocks", lambda *a: passes.append(1) or whole(*a))
    x = np.random.default_rng(4).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    assert np.allclose(list(sm.pair_quantiles(df).first()), wanted(range(3000), x), atol=2e-6) and len(passes) == 1
    monkeypatch.setattr(sm, "_guessed", lambda packs, at: np.zeros(sm.BINS, bool))  # a wrong guess costs a pass, not the result
    assert np.allclose(list(sm.pair_quantiles(df).first()), wanted(range(3000), x), atol=2e-6) and len(passes) == 3
