import hashlib

import duckdb
import numpy as np
import pytest

from lattica.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, codes string"


def plain(x, parts, entries, rounds):
    """Codes, error and codebooks of integer rows in order, all distances taken."""
    books = x[:entries].reshape(min(entries, len(x)), parts, -1).transpose(1, 0, 2).copy()
    x = x.reshape(len(x), parts, -1)
    near = lambda: np.stack([((x[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for k in range(books.shape[1]):
                if (at[:, p] == k).any():
                    books[p, k] = x[at[:, p] == k, p].sum(0) // (at[:, p] == k).sum()
    at = near()
    return at, sum(((x[:, p] - books[p][at[:, p]]) ** 2).sum(1) for p in range(parts)), books


def rows(n, dims, seed, coarse):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) * (0.02 if coarse else 0.3)
    if coarse:
        x = np.round(x * 64) / 64  # many ties
    return [(int(i), [float(v) for v in x[i]], int(i % 3) if i % 7 else None, "x") for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "entries", "coarse"), [(300, 32, 64, False), (300, 16, 20, True), (9, 64, 64, False)])
def test_equals_plain_rounds(spark, n, dims, entries, coarse):
    data = rows(n, dims, n + dims, coarse)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    coded, books = vc.compress(df, 16, entries, 2)
    got = {r["vec_id"]: r for r in coded.collect()}
    x = np.floor(np.array([d[1] for d in data], np.float32).astype(float) * 256).astype(np.int64)
    at, error, want = plain(x, 16, entries, 2)
    assert np.array_equal(books.entries, want)
    for i in range(n):
        assert bytes(got[i]["codes"]) == bytes(at[i].tolist()) and got[i]["error"] == error[i]


def test_bounds_spare_distances():
    r = np.random.default_rng(0)
    centres = r.integers(-4000, 4000, (64, 8))
    x = centres[r.integers(0, 64, 5000)] + r.integers(-40, 40, (5000, 8))
    books = vc.Codebooks((centres + 5)[None])
    code, _, lower = vc.first_assignment(x, 0, books)
    sums = {(0, k): (int((code == k).sum()), x[code == k].sum(0)) for k in range(64) if (code == k).any()}
    moved = books.moved(sums)
    at, best, low, taken = vc.next_assignment(x, 0, moved, code, lower)
    d = vc._distances(x, moved.entries[0])
    assert np.array_equal(at, d.argmin(1)) and np.array_equal(best, d.min(1))
    assert taken < 0.2 * d.size
    for g in range(books.count):
        own = np.where((books.groups[0] == g) & (np.arange(64) != at[:, None]), np.sqrt(d), np.inf).min(1)
        assert (low[:, g] <= own).all()


def test_edge_rows_and_labels(spark, monkeypatch):
    data = rows(40, 16, 1, False) + [(100, None, 1, "x"), (101, [0.1, None] * 8, 1, "x"), (102, [float("nan")] * 16, 1, "x"), (103, [float("inf")] * 16, 1, "x")]
    odd = [(104, [0.5] * 8, 1, "x"), (105, [1e9] * 16, None, "x"), (None, [0.25] * 16, None, "x"), (3, data[3][1], 0, "x")]
    df = spark.createDataFrame(data + odd, SCHEMA)
    for frequent in (10_000, 1):  # all labels are frequent, or none
        monkeypatch.setattr(vc, "FREQUENT", frequent)
        out = vc.label_errors(vc.compress(df)[0]).collect()
        assert len(out) == 44
        sums = {}
        for r in out:
            sums[r["label"]] = sums.get(r["label"], 0) + (r["error"] or 0)
        assert all(r["label_error"] == sums[r["label"]] for r in out)
        assert {r["vec_id"] for r in out if r["codes"] is None} == {104, 105}
    none, books = vc.compress(df.where("false"))
    assert books is None and vc.label_errors(none).collect() == []


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame([d[:3] for d in rows(150, 32, 3, True)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(vc.OP11_SQL)
    cols = want.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[k] for k in cols)) for r in vc.op11_vector_codes(spark, str(tmp_path)).collect())
    assert hashlib.sha256(b"").hexdigest() not in str(want.fetchall()[:1])
