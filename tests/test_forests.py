import hashlib
import math

import numpy as np
import pytest

from lattica.operators import forests as fo


def rows(n, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = float(r.normal()), int(r.integers(0, 5))
        out.append((i, None if i % 17 == 0 else a, b, None if i % 41 == 0 else int(100 * a + 30 * b + r.integers(0, 20)), "x"))
    return out


SCHEMA = "id long, a double, b int, y long, codes string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(data, limits, bins):
    out = []
    for _, a, b, _, _ in data:
        line = []
        for x, (lo, hi) in zip((a, b), limits, strict=True):
            if x is None:
                line.append(0)
            else:
                line.append(1 + min(bins - 1, math.floor((min(max(x, lo), hi) - lo) * bins / (hi - lo)) if hi > lo else 0))
        out.append(line)
    return np.array(out)


def limits_of(data):
    return [(min(v), max(v)) for v in ([d[k] for d in data if d[k] is not None] for k in (1, 2))]


def weight(seed, m, i):
    draw = int(sha(f"{seed}:weights:{m // 8}:{i}")[8 * (m % 8) : 8 * (m % 8) + 8], 16)
    p, total, k = math.exp(-1), math.exp(-1), 0
    while draw >= int(total * 2**32) and int(total * 2**32) < 2**32 - 1:
        k += 1
        p /= k
        total += p
    return k


def grow(x, w, y, depth, cut_of, node=1, min_leaf=1):
    """A tree as nested tuples: (feature, cut, left, right) or (sum, weight)."""
    s, n = int((w * y).sum()), int(w.sum())
    if depth and n:
        best = None
        for f in range(x.shape[1]):
            used = x[w > 0, f]
            lo, hi = int(used.min()), int(used.max())
            for cut in cut_of(node, f, lo, hi):
                left = x[:, f] <= cut
                wl, sl = int(w[left].sum()), int((w * y)[left].sum())
                wr, sr = n - wl, s - sl
                if min(wl, wr) >= min_leaf:
                    gain = float(sl) * sl / wl + float(sr) * sr / wr - float(s) * s / n
                    if gain > 0 and (best is None or (-gain, f, cut) < best):
                        best = (-gain, f, cut)
        if best:
            _, f, cut = best
            left = x[:, f] <= cut
            return (f, cut, *(grow(x[k], w[k], y[k], depth - 1, cut_of, 2 * node + j, min_leaf) for j, k in enumerate((left, ~left))))
    return (s, n)


def leaf(tree, row):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth", [1, 4])
def test_extra_trees_equal_brute_force(spark, depth):
    data = rows(400)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    model = fo.extra_trees(df, ["a", "b"], "y", "id", seed=3, members=3, trees=2, depth=depth, bins=16)
    got = {r["id"]: r for r in fo.ensemble_predictions(df, model).collect()}
    limits = limits_of(data)
    x = coded(data, limits, 16)
    train = [d for d in data if d[3] is not None]
    xt, y = coded(train, limits, 16), np.array([d[3] for d in train], np.int64)
    value = []
    for m in range(3):
        w = np.array([weight(3, m, d[0]) for d in train])
        each = []
        for t in (2 * m, 2 * m + 1):
            cut = lambda node, f, lo, hi, t=t: [lo + (int(sha(f"3:cut:{t}:{node}:{f}")[:12], 16) * (hi - lo) >> 48)]
            tree = grow(xt, w, y, depth, cut)
            each.append([s / n for s, n in (leaf(tree, r) for r in x)])
        value.append(np.mean(each, 0))
    for d, mean, std in zip(data, np.mean(value, 0), np.std(value, 0), strict=True):
        assert got[d[0]]["prediction"] == pytest.approx(mean, rel=1e-12)
        assert got[d[0]]["spread"] == pytest.approx(std, rel=1e-9, abs=1e-9)
        assert got[d[0]]["codes"] == "x"


def test_quantile_boosting_equals_brute_force(spark):
    data = rows(300, 1)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    qs, depth, rounds, bins = [0.5, 0.1, 0.9], 2, 4, 8
    model = fo.quantile_boosting(df, ["a", "b"], "y", qs, rounds, depth, (1, 3), bins)
    got = {r["id"]: r for r in fo.quantile_predictions(df, model).collect()}
    limits = limits_of(data)
    train = [d for d in data if d[3] is not None]
    x, xt, y = coded(data, limits, bins), coded(train, limits, bins), np.array([d[3] for d in train], np.int64)
    out = []
    for q in qs:
        at = lambda v, q=q: sorted(v)[fo.quantile_rank(len(v), q) - 1]
        here, all_ = np.full(len(y), at(y.tolist())), np.full(len(x), at(y.tolist()))
        for _ in range(rounds):
            g = np.where(y > here, round(q * 1000), round(q * 1000) - 1000)
            tree = grow(xt, np.ones(len(y), int), g, depth, lambda node, f, lo, hi: range(lo, hi))
            of = [leaf(tree, r) for r in xt]
            groups = {}
            for k, t in enumerate(of):
                groups.setdefault(id(t), []).append(int(y[k] - here[k]))
            move = {k: at(v) // 3 for k, v in groups.items()}
            here = here + np.array([move[id(t)] for t in of])
            all_ = all_ + np.array([move[id(leaf(tree, r))] for r in x])
        out.append(all_)
    out = np.array(out)
    for k, d in enumerate(data):
        r = got[d[0]]
        assert (r["prediction"], r["low"], r["high"]) == (out[0, k], out[:, k].min(), out[:, k].max())
    inside = [out[:, k].min() <= d[3] <= out[:, k].max() for k, d in enumerate(data) if d[3] is not None]
    assert 0.6 < np.mean(inside) <= 1


def test_empty_and_constant_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, None, 2, 5, "x"), (1, None, 2, 5, "x")], SCHEMA)
    for df in (none, one):
        trees = fo.extra_trees(df, ["a", "b"], "y", "id", members=2, trees=1, depth=2)
        boosted = fo.quantile_boosting(df, ["a", "b"], "y", rounds=2)
        a, b = fo.ensemble_predictions(one, trees).collect(), fo.quantile_predictions(one, boosted).collect()
        if df is none:
            assert [r["prediction"] for r in a + b] == [None] * 4
        else:
            assert {r["prediction"] for r in b} == {5} and {r["prediction"] for r in a} <= {5.0, None}
