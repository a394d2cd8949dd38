import numpy as np

from lattica.llm import mixing

DOCS = "doc_id long, text string, rate string, domain int"


def test_rates_match_numpy(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    n = rng.integers(1, 500, 60)
    g = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "_code long, tokens long, p array<double>")
    for share in ((0.5, 0.3, 0.2), (0.96, 0.03, 0.01)):
        t = (n.sum() * np.array(share)).tolist()
        got = {r["_code"]: r["rate"] for r in mixing.fit_rates(g, t).collect()}
        r = np.array([got[i] for i in range(60)])
        assert (r >= 0).all()
        ref = np.ones(60)  # the plain iteration, long enough
        step = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
        for _ in range(200000):
            ref = np.maximum(0, ref - step * p @ ((ref * n) @ p - t))
        assert np.linalg.norm((r * n) @ p - t) <= np.linalg.norm((ref * n) @ p - t) + 1e-6 * n.sum()


def test_mixture(spark):
    docs = [(i, ("good plain words here now " if i % 3 else "BUY!! $$$ | now!! ") * (i % 7 + 1)) for i in range(300)]
    docs += [(900, None), (901, ""), (None, "no id"), (5, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixture(df, labels, {"q0t0": 0.5, "q1t0": 0.5}).collect()
    assert len(got) == len(docs) and all(r["rate"] >= 0 for r in got)
    total = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["rate"] * r["n_tokens"] for r in got) - total) < 1e-3 * total
    assert {r["domain"] for r in got if r["doc_id"] in (1, 2, 4)} == {"q1t0"} and {r["domain"] for r in got if r["doc_id"] in (3, 6)} == {"q0t0"}
    one = mixing.mixture(df, labels.limit(0)).collect()
    assert {r["domain"] for r in one} == {"all"} and len(one) == len(docs)
    assert mixing.mixture(df.limit(0), labels).collect() == []
