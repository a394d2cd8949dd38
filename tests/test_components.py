import numpy as np
import pytest

from lattica.operators import components as co


def data(n, d, seed):
    r = np.random.default_rng(seed)
    x = (r.random((n, d)) < np.linspace(0.5, 0.05, d)).astype(float)
    x[3] = 0  # a row without bits
    y = x[:, 0] * 5 - x[:, 1] * 3 + x[:, 2] * x[:, 3] * 2 + r.normal(size=n)
    return x, y


def frames(spark, x, y, train):
    cells = spark.createDataFrame([(i, j, float(x[i, j]), "q") for i in range(x.shape[0]) for j in np.flatnonzero(x[i]).tolist()] + [(1, None, 1.0, "q")], "id long, bit int, v double, t string").repartition(5)
    out = spark.createDataFrame([(i, float(v) if i % 29 else None) for i, v in enumerate(y) if train[i]], "id long, y double")
    rows = spark.createDataFrame([(i,) for i in range(len(y))], "id long")
    return cells, out, rows


def test_pls_equals_brute_force(spark):
    x, y = data(120, 14, 0)
    train = np.arange(120) % 4 > 0
    cells, out, rows = frames(spark, x, y, train)
    model = co.pls(cells, out, 2)
    got = {r["id"]: r for r in co.pls_scores(cells, rows, model).collect()}
    fit = train & (np.arange(120) % 29 > 0)
    xm, ym = x[fit].mean(0), y[fit].mean()
    a, t_all, rest = x[fit] - xm, [], x - xm
    want = np.full(120, ym)
    for _ in range(2):
        w = a.T @ (y[fit] - ym)
        w /= np.linalg.norm(w)
        w *= np.sign(w[np.abs(w).argmax()])
        t, ta = a @ w, rest @ w
        p = a.T @ t / (t @ t)
        a, rest = a - np.outer(t, p), rest - np.outer(ta, p)
        want = want + ta * ((y[fit] - ym) @ t / (t @ t))
        t_all.append(ta)
    for i in range(120):
        assert [got[i][f"t{k}"] for k in (1, 2)] == pytest.approx([t[i] for t in t_all], abs=1e-8)
        assert got[i]["prediction"] == pytest.approx(want[i], abs=1e-8)


def test_svd_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(co, "sized", lambda t: t)  # the way beyond the bound of broadcasts
    x, y = data(90, 12, 1)
    train = np.arange(90) % 3 > 0
    cells, out, rows = frames(spark, x, y, train)
    ids = out.select("id")
    model = co.svd(cells.join(ids, "id", "left_semi"), 3, oversample=9, passes=2)
    _, s, vt = np.linalg.svd(x[train], full_matrices=False)
    vt = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])[:, None]
    assert model.values == pytest.approx(s[:3].tolist(), rel=1e-9)
    got = {r["id"]: r for r in co.svd_scores(cells, rows, model).collect()}
    for i in range(90):
        assert [got[i][f"s{k}"] for k in (1, 2, 3)] == pytest.approx((vt @ x[i]).tolist(), abs=1e-6)


def test_few_bits_and_no_rows(spark):
    cells, out, rows = frames(spark, np.array([[1.0], [1], [1], [0]]), np.zeros(4), np.ones(4, bool))
    assert [r["s1"] for r in co.svd_scores(cells, rows, co.svd(cells, 2, passes=2)).collect()] == pytest.approx([1.0, 1.0, 1.0, 0.0])
    assert {r["prediction"] for r in co.pls_scores(cells, rows, co.pls(cells, out, 2)).collect()} == {0.0}
    none = cells.where("false")
    assert {r["s1"] for r in co.svd_scores(none, rows, co.svd(none, 1, passes=1)).collect()} == {0.0}
    assert {r["prediction"] for r in co.pls_scores(none, rows, co.pls(none, out.where("false"), 1)).collect()} == {0.0}


def test_svd_passes_over_distinct_rows(spark, monkeypatch):
    """Equal rows are one row with a weight: what the passes hold doesn't grow with copies."""
    x, _ = data(40, 8, 2)
    held = {}
    write = co.kept
    monkeypatch.setattr(co, "kept", lambda df, name: held.setdefault(name, write(df, name)) if name == "svd-rows" else write(df, name))
    sizes = []
    for copies in (1, 5):
        many = np.vstack([x] * copies)
        cells = frames(spark, many, many[:, 0], np.zeros(len(many), bool))[0].where("bit is not null")
        halves = cells.select("id", "bit", (cells.v / 2).alias("v"))
        model = co.svd(halves.unionByName(halves), 3, oversample=5, passes=1)  # equal cells are added
        assert model.values == pytest.approx(np.linalg.svd(many, compute_uv=False)[:3].tolist(), rel=1e-9)
        sizes.append(held.pop("svd-rows").count())
    assert sizes[0] == sizes[1] == len(np.unique(x[x.any(1)], axis=0))
