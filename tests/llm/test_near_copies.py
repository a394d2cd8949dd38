"""The near-copy stage against brute force at its own threshold: five words, 80 percent."""

import random

import corpus_pipeline as cp


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def kept(rows):
    """The smallest doc_id of each component, and all rows without words."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return {k for i, (k, _) in enumerate(rows) if not sets[i] or k == min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i])}


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in cp.drop_near_copies(spark, docs, "").collect())


def test_block_of_words_replaced(spark):
    """176/216 of the 5-word shingles are shared, but only 180/216 of the 3-word ones."""
    base = [f"w{i}" for i in range(200)]
    copy = base[:90] + [f"x{i}" for i in range(16)] + base[106:]
    assert stage(spark, [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(f"y{i}" for i in range(200)))]) == [1, 3]


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    draw = lambda n: [rnd.choice(vocab) for _ in range(n)]
    frequent = draw(25)
    texts = ["", None, "one", "one two three four", "One two  three four", "a b c d e"]
    for n in (9, 12, 40, 90, 200, 300):
        base = draw(n)
        for edits in range(10):  # similarities on both sides of the threshold
            at = rnd.randrange(n)
            texts.append(" ".join(base[:at] + draw(edits * n // 90) + base[at + edits * n // 90 :]))
    texts += [" ".join(draw(rnd.randint(3, 12)) + frequent + draw(rnd.randint(3, 9))) for _ in range(40)]
    texts += [" ".join(draw(rnd.randint(3, 30))) for _ in range(20)]
    rnd.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert stage(spark, rows) == sorted(kept(rows))
