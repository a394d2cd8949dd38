import hashlib
import random
import re

import pytest

from lattica.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string, words int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, s in items:
            v = words(s)
            m = min(10, len(v))
            wins = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    if item is not None:
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def data(seed):
    rnd = random.Random(seed)
    vocab = ["the", "Of", "a", "é", "x1", "Straße"] + [f"v{i}" for i in range(6)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 5, 9, 10, 11, 14, 40])))) for k in range(25)]
    items += [(3, items[4][1]), (None, "null id item"), (77, None), (78, ""), (79, "..!"), (4, items[4][1])]
    docs = []
    for i in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 2)):
            v = words(rnd.choice(items)[1])
            w[rnd.randint(0, len(w)) : 0] = v[rnd.randint(0, max(0, len(v) - 12)) :]
        docs.append((i, rnd.choice([" ", "  ", "-", ", "]).join(w)))
    return docs + [(None, "null id item here"), (500, None), (501, ""), (502, "q " * 30000)], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_matches_brute_force(spark, block_bytes):
    docs, items = data(block_bytes)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(d, b, block_bytes=block_bytes).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(brute(docs, items), key=key)
    assert sorted(map(tuple, got), key=key) == want
    clean = dc.uncontaminated(d, b, block_bytes=block_bytes)
    assert clean.columns == d.columns
    assert sorted((r["doc_id"] or -1) for r in clean.collect()) == sorted((w[0] or -1 if w[0] != 0 else -1) for w in want if not w[5])


def test_empty(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in dc.contamination(d, b).collect()] == [(1, 2, 0, 0)]
    assert dc.contamination(d.limit(0), b).collect() == []


def test_long_window_skips():
    w = dc.WuManber(10, {b" ".join(b"p%d" % i for i in range(10)): [1]})
    assert w.stride == 9 and (w.shift < 9).sum() == 9
