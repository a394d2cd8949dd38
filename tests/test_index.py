import numpy as np
import pytest

from lattica.operators import index as ix
from lattica.operators import order as od


@pytest.mark.parametrize("kind", ["clusters", "spread", "few"])
def test_nearest_equals_all_pairs(spark, tmp_path, kind):
    r = np.random.default_rng(4)
    if kind == "clusters":
        centres = r.normal(size=(12, 8))
        x = centres[r.integers(0, 12, 400)] + r.normal(size=(400, 8)) * 0.05
    else:
        x = r.normal(size=(400 if kind == "spread" else 3, 8))
    x = x.round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[0].tolist()), (1001, [0.0] * 8), (1002, [0.0] * 8)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 8), (5000, None)], "id long, vec array<float>").repartition(6)
    ix.build_index(df, f"{tmp_path}/index", pivots=10, block=16)
    index = ix.open_index(spark.newSession(), f"{tmp_path}/index")
    queries = df.where("id % 4 = 0 or id > 900")
    got = {q["query"]: q for q in ix.nearest(index, queries).collect()}
    v = np.array([np.float32(x[1]) for x in rows], float)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.where(length > 0, v / np.where(length > 0, length, 1), 0)
    ids = np.array([x[0] for x in rows])
    want = [q for q in ids.tolist() if q % 4 == 0 or q > 900]
    assert sorted(got) == sorted(want)
    for q in want:
        s = np.round(v @ v[ids == q][0], 6)
        s[ids == q] = -np.inf
        k = min(range(len(ids)), key=lambda i: (-s[i], ids[i]))
        assert (got[q]["nearest"], got[q]["similarity"]) == (ids[k], pytest.approx(s[k] + 0.0, abs=2e-6))
    blocks = index.blocks.count()
    if kind == "clusters":  # most blocks are never read
        assert np.mean([g["visited"] for g in got.values()]) < 0.4 * blocks
    sims = spark.createDataFrame([(float(g["similarity"]),) for g in got.values()], "s double")
    assert od.quantile_edges(sims, "s", [0.5]) == pytest.approx([np.median([g["similarity"] for g in got.values()])])


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vec array<float>")
    index = ix.build_index(none, f"{tmp_path}/index")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    assert [tuple(r) for r in ix.nearest(index, one).select("query", "nearest", "similarity").collect()] == [(1, None, None)]
    assert ix.nearest(index, none).count() == 0
