import random

import corpus_pipeline as cp


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = [(i, text(rnd.randint(30, 90))) for i in range(300)]
    toxic = {i for i in range(0, 300, 5)}
    rows = [(i, t + " vile scum rotten filth" if i in toxic else t) for i, t in rows]
    item = text(30)
    planted = [(1000, rows[1][1]), (1001, rows[2][1] + " " + rows[3][1] + " " + " ".join(item.split()[5:20])), (1002, "mail joe@example.com " + text(40)), (1003, None), (1004, "")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows + planted]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "jaccard_join", "decontamination", "pii", "mixing"]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cols, ids = df.columns, []
    for name, stage in cp.STAGES:
        df = cp.save(stage(spark, df, str(tmp_path)), name)
        ids.append({r["doc_id"] for r in df.select("doc_id").collect()})
        if name == "pii":
            assert df.columns == cols
            assert df.where("doc_id = 1002").first()["text"].startswith("mail [EMAIL] ")
    everything = {d[0] for d in docs}
    assert not ids[0] & toxic and len(everything - ids[0]) <= len(toxic) + 3
    assert ids[0] - ids[1] == {1000} and ids[1] - ids[2] == {1001} and ids[2] == ids[3] == ids[4]
    assert all(r["rate"] >= 0 for r in df.collect())


def test_nothing_to_learn_rejects_nothing(spark, tmp_path):
    docs = [(1, "plain words here"), (2, None), (3, ""), (None, "more words"), (4, "!!! ..."), (5, "other plain words"), (6, "a few words")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for n, rows in enumerate(([(1, 1)], [(1, 1), (5, 1), (6, 0)], [(1, 1), (5, 1)])):
        spark.createDataFrame([(i, 1, t) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        kept = cp.drop_toxic(spark, df, f"{tmp_path}/{n}")
        assert kept.columns == df.columns
        assert {r["text"] for r in kept.collect()} >= {None, "", "!!! ..."}
    assert cp.drop_toxic(spark, df, f"{tmp_path}/0").count() == len(docs)
    assert cp.drop_toxic(spark, df.where("false"), f"{tmp_path}/0").count() == 0
