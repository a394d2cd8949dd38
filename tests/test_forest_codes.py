"""Trees work by code where codes are few: the same numbers as row by row, and no routing of rows."""

import numpy as np
import pyarrow as pa

from lattica.operators import forests as fo


def test_codes_are_routed_once(monkeypatch):
    x = np.random.default_rng(1).integers(0, 4, (500, 2)).astype(np.int32)
    column = pa.array(x.tolist(), pa.list_(pa.int32()))
    model = fo.Trees.empty(["a", "b"], [(0, 1)] * 2, 3, 2, 1)
    model.feature[0, 1:4], model.cut[0, 1:4] = [0, 1, 1], [1, 0, 2]
    seen = []

    def route(codes):
        seen.append(len(codes))
        return model.route(codes, 0)

    got = []
    for few in (fo.CODES, 0):
        monkeypatch.setattr(fo, "CODES", few)
        rows = fo._Coded(2, 3)
        for part in (column, column[:100]):
            rows.take(part)
            got.append(rows.of("leaf", route))
    assert seen == [16, 500, 100]
    assert (got[0] == model.route(x, 0)).all() and (got[0] == got[2]).all() and (got[1] == got[3]).all()


def test_models_by_code_and_by_row(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 9)), None if i % 13 == 0 else float(rng.integers(0, 5)), int(rng.integers(0, 1000)) + i % 7 * 100) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y long").repartition(3)
    found = []
    for few in (fo.CODES, 0):
        monkeypatch.setattr(fo, "CODES", few)
        et = fo.extra_trees(df, ["a", "b"], "y", "id", seed=1, members=2, trees=1, depth=2, bins=4)
        qb = fo.quantile_boosting(df, ["a", "b"], "y", (0.5, 0.9), rounds=2, depth=1, bins=4)
        found.append([et.feature.tolist(), et.cut.tolist(), et.total.tolist(), et.weight.tolist(), qb.leaf.tolist(), qb.trees.feature.tolist(), qb.start.tolist()])
    assert found[0] == found[1]
