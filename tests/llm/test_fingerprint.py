import hashlib
import random

import pytest

from lattica.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, lang string, part int, head string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "x") for i, t in rows], SCHEMA)


def brute(rows):
    """(doc_id, n_chars, sha of the edited text, text, edited text) in order."""
    import xxhash  # noqa: F401  (ties are not used here)

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, nxt))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_matches_brute_force(spark, partitions):
    rnd = random.Random(partitions)
    word = lambda: "".join(rnd.choice("abcé ß\n") for _ in range(rnd.randint(1, 9)))
    rows = [(i * 3, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(97)] + [(None, "no id"), (1000, None), (1001, ""), (1002, "w " * 60000)]
    got = {r["doc_id"]: r for r in fp.fingerprint_edits(frame(spark, rows).repartition(5), partitions).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    for i, n, sha, t, e, nxt in want:
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        a, b, c = fp.fingerprint_column([t, e, nxt])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a, b)
        assert (r["near_edited"] == 1.0) == (a == b) and (r["near_next"] == 1.0) == (a == c)


def test_repeated_rows_and_empty(spark):
    rows = [(7, "same text here")] * 5 + [(8, "other")] + [(7, "third text")]
    got = fp.fingerprint_edits(frame(spark, rows), 4).collect()
    assert len(got) == 7 and len({r["fingerprint"] for r in got}) == 3
    assert fp.fingerprint_edits(frame(spark, []), 4).collect() == []


def test_multiset_homomorphism():
    a, b, ab, ba = fp.fingerprint_column(["one two three\nfour", "five six seven eight", "one two three\nfour\nfive six seven eight", "five six seven eight\nfour\none two three"])
    assert ab == ba == fp.combine(a, b) and fp.combine(ab, b, -1) == a and a != b


def test_likeness_follows_shared_share():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    for share in (0.0, 0.5, 0.9):
        k = int(1000 * share)
        a = " ".join(words[:1000])
        b = " ".join(words[:k] + words[1000 : 2000 - k])
        (ea, na), (eb, nb) = (fp.fingerprints([x.encode()]) for x in (a, b))
        assert abs(fp.likeness(ea, na, eb, nb)[0] - share) < 0.2
