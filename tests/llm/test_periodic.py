import random
import zlib

import numpy as np
import pytest

from lattica.llm import periodic as pe


def brute(ids):
    out, n = {}, len(ids)
    for q in range(1, n // 3 + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + q - s >= max(24, 3 * q):
                out.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def words(kind, n, rnd):
    k = rnd.choice([1, 2, 3, 5, 50])
    ids = [rnd.randrange(k) for _ in range(n)]
    if kind == "planted":
        for _ in range(2):
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 3))
            ids[a:] = [ids[a + i % p] for i in range(n - a)]
    if kind == "blocks":
        m = rnd.randrange(1, 40)
        ids = ([0] * m + [1]) * (n // (m + 1))
    if kind in ("fibonacci", "thue"):
        f, g = [0], [0, 1]
        while len(g) < n:
            f, g = g, g + (f if kind == "fibonacci" else [1 - x for x in g])
        ids = g[:n]
    return np.array(ids, np.int64)


@pytest.mark.parametrize("kind", ["plain", "planted", "blocks", "fibonacci", "thue"])
def test_equals_brute_force(kind):
    rnd = random.Random(kind)
    for _ in range(150):
        ids = words(kind, rnd.randrange(1, 400), rnd)
        assert pe.runs(ids) == brute(ids)


def test_hashes_that_agree_by_chance(monkeypatch):
    monkeypatch.setattr(pe._Prefix, "same", lambda self, i, j, n: (i + j + n) % 3 > 0)
    ids = np.array([0, 1, 2, 3] * 10 + list(range(10, 60)), np.int64)
    assert all(r in brute(ids) for r in pe.runs(ids))


def test_long_texts_of_few_words():
    assert pe.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    got = pe.runs(np.array(([0] * 20_000 + [1]) * 8, np.int64))
    assert (0, 8 * 20_001, 20_001) in got and len(got) == 9


def test_columns_and_edge_rows(spark):
    rows = [(1, "a b " * 30 + "end", 7, "x"), (2, None, 7, None), (3, "", 7, "y"), (3, "one two", 7, "y"), (4, "w\x0b" * 30, 7, "z"), (None, "  " * 24, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, Collapsed string")
    out = pe.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    a = got[1, rows[0][1]]
    assert [tuple(x) for x in a["runs"]] == [(0, 60, 2)] and a["collapsed"] == "a b end"
    assert got[2, None]["collapsed"] is None and got[2, None]["runs"] == [] and got[3, ""]["collapsed"] == ""
    assert got[4, rows[4][1]]["collapsed"] == "w" and got[None, rows[5][1]]["collapsed"] == " "
    assert pe.periodic_runs(docs.where("false")).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    import hashlib

    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 200)))) for i in range(120)] + [(None, "x " * 40), (500, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pe.op13_periodic(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hit = 0
    for i, text in docs:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
            hit += 1
        want = brute(pe.numbered(w))
        r = got[i]
        assert r["n_runs"] == len(want) and r["runs_sha256"] == sha("".join(f"{s},{k},{q}\n" for s, k, q in want))
        drop = {j for s, k, q in want for j in range(s + q, s + k)}
        assert r["collapsed_sha256"] == sha(" ".join(x for j, x in enumerate(w) if j not in drop))
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
    assert hit > 3
