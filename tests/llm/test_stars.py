"""A large group of near copies: most of its members are joined by leaders, before members are compared with each other."""

import random

from lattica.llm import jaccard


def test_pairs_of_a_large_group(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 4)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared = []
    verify = jaccard._Join.verify
    monkeypatch.setattr(jaccard._Join, "verify", lambda self, pairs: compared.append(pairs.count()) or verify(self, pairs))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (tuple(x.split()) for x in texts)]
    name = list(range(400))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a in range(400):
        for b in range(a):
            n = len(grams[a] & grams[b])
            if 100 * n >= 90 * (len(grams[a]) + len(grams[b]) - n):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    assert got == {i: root(i) for i in range(400)}
    assert sum(compared) <= 4 * 400


def test_only_parts_of_asked_sets_are_dealt(spark, monkeypatch):
    """One pair among 200 sets: the parts that meet are those of its two sets, not of all."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i if k > 20 else 0}x{k}" for k in range(60 if i > 1 else 200))) for i in range(200)], "doc_id long, text string")
    join = jaccard._Join(docs, 90, 3)
    join.sets = jaccard.save(docs.select("text").mapInArrow(jaccard._kept(join.bands, 3, frozenset()), jaccard._SETS), "kept")
    a, b = (r["node"] for r in join.sets.orderBy("size").select("node").limit(2).collect())
    plans, real = {}, jaccard.save
    monkeypatch.setattr(jaccard, "save", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and real(df, name))
    assert join.verify(spark.createDataFrame([(a, b)], "a long, b long")).count() == 0
    dealt = plans["partial"].split("posexplode(parts")[1]
    assert "LeftSemi" in dealt
    links = join.verify(spark.createDataFrame([(a, a)], "a long, b long")).collect()
    assert [tuple(r) for r in links] == [(a, a)]
