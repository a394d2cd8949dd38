import random
import re

import pytest

from lattica.llm import jaccard

SCHEMA = "doc_id long, text string, node long, comp string"


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), (min(ids) if ids else None) if sets[i] else k))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    draw = lambda n: [rnd.choice(vocab) for _ in range(n)]
    frequent = draw(25)
    texts = ["", None, "one", "one two", "One  two", "\n\t "]
    for _ in range(6):  # groups of near copies, some of them across the threshold
        base = draw(rnd.choice([9, 12, 40, 90, 300]))
        for _ in range(9):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
        texts += [" ".join(base).upper(), " ".join(base)]
    for _ in range(40):  # unrelated texts around a frequent passage
        texts.append(" ".join(draw(rnd.randint(5, 12)) + frequent + draw(rnd.randint(3, 9))))
    texts += [" ".join(draw(rnd.randint(3, 30))) for _ in range(20)]
    rnd.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "a b c d"), (2000, "a b c d"), (2000, "a b c d")]


@pytest.mark.parametrize("small", [32, 2])
def test_matches_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "FAR", 0.6 if small > 2 else 0.3)
    rows = corpus(small)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], SCHEMA).repartition(3)
    got = jaccard.jaccard_components(df).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("stars", [1, 3])
def test_links_past_the_leader(spark, monkeypatch, stars):
    """Families in which most links are not to the leader: the last comparison, behind the sketches, or later leaders find them."""
    monkeypatch.setattr(jaccard, "STARS", stars)
    rnd = random.Random(11)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(120)]
        for c in range(8):  # each centre is far from the others, its copies are near it
            centre = list(base)
            for i in rnd.sample(range(120), 7):
                centre[i] = f"c{c}x{i}"
            for k in range(4):
                w = list(centre)
                if k:
                    w[rnd.randrange(120)] = f"k{k}c{c}"
                rows.append((len(rows), " ".join(w)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_similar_sets_share_a_signature():
    import numpy as np

    rng, bands = np.random.default_rng(1), jaccard.Bands(90)
    for n in (9, 10, 11, 19, 20, 57, 200, 1000, 5000):
        for _ in range(20):
            u = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            cut = int(len(u) * 0.1)  # the largest change of one side that stays at 0.9
            v = u[np.sort(rng.permutation(len(u))[cut:])]
            if 100 * len(v) >= 90 * len(u):
                for level in range(3):
                    assert set(bands.signatures(u, level).tolist()) & set(bands.signatures(v, level).tolist())


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["comp"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
