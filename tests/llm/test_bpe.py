import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import bpe

P = pytest.importorskip("public_tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
POOL = ["'s", "'LL", " ", "  ", "\n", "Σ", "ΑΣ", "ß", "İ", "é", "é", "<|endoftext|>", "<|startoftext|>", "<|end", "中", "​", "՘", "Ᲊ", "9", "!!", "\x00", "\x1c", "\x85", "\xa0", "😀", "ab" * 90, "the", "Hello", "ﬁ", "q" * 300, "xy" * 100]


def texts(n):
    rnd = random.Random(1)
    one = lambda: rnd.choice(POOL) if rnd.random() < 0.8 else chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x530), rnd.randrange(0x2000, 0x3100), rnd.randrange(0x10000, 0x1FFFF)]))
    return ["".join(one() for _ in range(rnd.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_equals_the_library(name, monkeypatch):
    import tokenizers

    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 14)  # words leave and come back
    lib, v = tokenizers.Tokenizer.from_file(P.path(name)), bpe.Vocabulary(open(P.path(name)).read())
    rows = texts(3000)
    want = [lib.encode(t, add_special_tokens=False).ids for t in rows]
    got = [np.frombuffer(v.encode(t), np.int32) for t in rows]
    assert [g.tolist() for g in got] == want
    off = np.concatenate(([0], np.cumsum([len(g) for g in got])))
    assert v.decode(pa.array(np.concatenate(got)), off).to_pylist() == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_scans_and_heap_make_the_same_merges():
    v, rnd = bpe.Vocabulary(open(P.path(FILES[0])).read()), random.Random(2)
    for _ in range(300):
        word = "".join(rnd.choice("aabcdeiinorstth") for _ in range(rnd.randint(1, 120))).encode()
        ids = [v.inner[b] for b in word]
        assert v._scan(list(ids)) == v._heap(list(ids))


def test_columns_nulls_and_long_texts(spark):
    rows = [(1, "Hello world", "a", 5), (None, None, None, 6), (3, "", "c", 7), (3, "", "c", 7), (4, "word " * 200_000, "d", 8), (5, "z" * 100_000, None, 9), (6, "\t\n ", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, IDS int")
    enc = bpe.encode(docs, P.path(FILES[0]))
    assert enc.columns == ["doc_id", "text", "decoded", "ids"]
    got = {(r["doc_id"], r["text"] and r["text"][:3]): r for r in bpe.decode(enc, P.path(FILES[0])).collect()}
    assert got[1, "Hel"]["decoded"] == "hello</w> world</w>"
    assert got[None, None]["ids"] == [] and got[None, None]["decoded"] == "" and got[6, "\t\n "]["ids"] == []
    assert len(got[4, "wor"]["ids"]) == 200_000
    assert bpe.encode(docs.where("false"), P.path(FILES[0])).collect() == []
    odd = spark.createDataFrame([([3306, 10**9, -1, None, 1002],), (None,), ([],)], "ids array<long>")
    assert [r["decoded"] for r in bpe.decode(odd, P.path(FILES[0])).collect()] == ["hello</w> world</w>", "", ""]
