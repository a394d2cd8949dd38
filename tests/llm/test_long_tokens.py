"""Keys in tokens of any length are judged by their own characters."""

import pytest

from lattica.llm import secrets

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.mark.parametrize("lead", ["-" * 600, "_" * 1111, "/home/user/data/file/path/index/config" * 20 + "/"])
def test_key_at_the_end_of_a_long_token(spark, lead):
    rows = [(1, f'token = "{lead}{KEY}" end', "s"), (2, f'token = "{lead}0" end', "s"), (3, f'token = "{KEY}" end', "s")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), secrets.fit()).collect()
    assert {(r["doc_id"], r["start"], r["end"]): r["score"] >= 0.5 for r in got} == {
        (1, 9, 9 + len(lead) + 40): True,
        (2, 9, 10 + len(lead)): False,
        (3, 9, 49): True,
    }


def test_windows_cover_the_token():
    for n in (513, 600, 4097):
        token = "".join(chr(48 + i % 75) for i in range(n))
        parts = [w for part in secrets.windows(token) for w in part]
        seen = set()
        for w in parts:
            at = token.find(w)
            while at >= 0:
                seen.update(range(at, at + len(w)))
                at = token.find(w, at + 1)
        assert seen == set(range(n))
