import random

import pytest

from lattica.llm import language, quality, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "clash", 7) for i, t, lang in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    syl = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ción", "ado", "los", "que"]}
    rows = []
    for i in range(900):
        lang = rnd.choice(list(syl))
        w = ["".join(rnd.choice(syl[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(8, 60))]
        toxic, good = rnd.random() < 0.3, rnd.random() < 0.6
        if toxic:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "Rotten", "filth"]))
        text = " ".join(w) if good else " ".join(x.upper() + rnd.choice(["$$$", "!!", "|"]) for x in w)
        rows.append((i, text, lang, int(good), int(toxic)))
    return rows


EDGE = [(5000, None, None), (5001, "", "aa"), (5002, "1234 !!", "bb"), (None, "kalo miru", "aa"), (5003, "kalo " * 40000, None), (0, "kalo", "aa")]


def labels(spark, corpus):
    extra = [(None, 1, 1), (5000, 1, 0), (7, None, None), (3, 1, 0), (3, 1, 0)]
    return spark.createDataFrame([(i, g, t) for i, _, _, g, t in corpus] + extra, "doc_id long, quality int, toxic int")


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def saved(spark, corpus, path):
    frame(spark, [(i, t, lang) for i, t, lang, _, _ in corpus] + EDGE).write.parquet(f"{path}/documents.parquet")
    labels(spark, corpus).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_fits_bring_no_rows_to_the_driver():
    import inspect

    for m in (quality, toxicity, language):
        source = inspect.getsource(m)
        assert source.count("\ndef fit(") == 1 and source.count("\ndef score(") <= 1
        assert "collect()" not in inspect.getsource(m.fit) and "toPandas" not in inspect.getsource(m.fit)


def test_quality_and_toxicity_and_language_held_out(spark, corpus, tmp_path):
    d = saved(spark, corpus, tmp_path)
    n = len(corpus) + len(EDGE)
    truth = {i: (lang, g, t) for i, _, lang, g, t in corpus if i}
    for op, at in ((quality.op5_quality, 1), (toxicity.op7_toxicity, 2)):
        got = op(spark, d).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
        held = [(r["score"], truth[r["doc_id"]][at]) for r in got if r["held_out"] and r["doc_id"] in truth]
        assert len(held) > 150 and auc(held) > 0.97, op
    got = language.op6_language(spark, d).collect()
    assert len(got) == n
    held = [r["lang_pred"] == truth[r["doc_id"]][0] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["lang_pred"] == by[5001]["lang_pred"] == by[5002]["lang_pred"] == "und" and by[5003]["lang_pred"] == "aa"


def test_nothing_to_learn_from(spark, tmp_path):
    frame(spark, EDGE[:4]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5001, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    assert len({r["score"] for r in quality.op5_quality(spark, d).collect()}) == 1
    assert {r["score"] for r in toxicity.op7_toxicity(spark, d).collect()} == {0.0}
    empty = frame(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []
    assert language.identify(frame(spark, EDGE), language.fit(empty)).where("lang_pred <> 'und'").collect() == []


def test_forest_on_unseen_findings():
    forest = secrets.fit()
    unseen = secrets.labelled_findings(seed=99, size=1000)
    import numpy as np

    p = forest.probability(np.array([secrets.describe(*r[:4]) for r in unseen]))
    right = [(x >= 0.5) == bool(r[4]) for x, r in zip(p, unseen, strict=True)]
    assert sum(right) / len(right) > 0.97


def test_secret_spans(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'é token = "{key}" end', None), (2, f"commit {key} fixes it", None), (3, None, None), (4, "", None), (5, "plain words only", None), (6, "a1" * 40000, None), (1, f"api_key={key}", None)]
    got = secrets.scan(frame(spark, rows), secrets.fit()).collect()
    real = sorted((r["doc_id"], r["start"], r["end"]) for r in got if r["score"] >= 0.5)
    assert (1, 11, 51) in real and (1, 8, 48) in real and not any(r[0] == 2 for r in real)
    assert secrets.scan(frame(spark, []), secrets.fit()).collect() == []
