"""Document frequencies over all texts, and a sample of each language."""

import random

import numpy as np

from lattica.llm import language

SYL = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["xoq", "zyb", "quu", "wex"]}


def corpus(n, rare):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        lang = "cc" if i in rare else rnd.choice(["aa", "bb"])
        rows.append((i, " ".join("".join(rnd.choice(SYL[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(25)), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_rare_language_is_learned(spark):
    rare = set(range(0, 1200, 100))  # 12 of 1,200 texts: about one in a sample of 100
    df = frame(spark, corpus(1200, rare))
    got = language.identify(df.where("lang = 'cc'"), language.fit(df, max_rows=100)).collect()
    assert len(got) == 12 and all(r["lang_pred"] == "cc" for r in got)


def test_sample_of_each_language(spark):
    df = frame(spark, corpus(1200, set(range(0, 1200, 100))))
    n = df.join(language.sampled_ids(df, 100), "doc_id").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in n} == {"aa": 100, "bb": 100, "cc": 12}


def test_document_frequencies_cover_all_texts(spark):
    rows = corpus(300, {5})
    df, n = language.document_frequencies(frame(spark, [*rows, *rows[:7]]))  # repeated ids count once
    want = np.zeros(language.DIMS, np.int64)
    for _, text, _ in rows:
        raw = text.encode()
        want[np.unique(np.concatenate([at for _, at in language._grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))]))] += 1
    assert n == 300 and (df == want).all()
