"""Golden values, invariants and edge cases of the record operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import cleaning as cl
from lattica.functions import identity as idn
from lattica.functions import parsing as ps
from lattica.operators import acquire as aq
from lattica.operators import audit as au
from lattica.operators import candidates as cd
from lattica.operators import features as ft
from lattica.operators import labels as lb
from lattica.operators import metrics as mt
from lattica.operators import protocol as pr
from lattica.operators import quality as ql
from lattica.operators import similarity as sm
from lattica.operators import splits as sp
from lattica.schema import RoleSchema
from lattica.sources import io


def test_clean_raw_csv(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("Reaction ID,Base SMILES,Reaction SMILES,Yield (%)\nr1,B,A>>P,81.5\nr2,,A>>P,not_a_number\nr3,B,A>>P,105\nr4,B,A>>P,\nr5,UNKNOWN,A>>P,45\nr6,B,A>>P,-1\nr7,B,A>>P,0\nr8,B,,7\n")
    raw = io.scan_csv(spark, str(p))
    out = cl.clean(raw, "yield", "reaction_smiles", ["base_smiles"], ["reaction_id", "yield"])
    assert out.columns[:2] == ["reaction_id", "yield"]
    assert [r["reaction_id"] for r in out.orderBy("reaction_id").collect()] == ["r1", "r5", "r7"]
    assert cl.normal_name(" Yield (%) ") == "yield"
    assert tuple(cl.filter_counts(cl.normalise_names(raw), F.col("yield"), F.col("reaction_smiles")).first()) == (8, 4, 1, 3)
    for bad, kind in ((tmp_path / "no.csv", "missing"), (tmp_path, "not_a_file")):
        with pytest.raises(io.ScanError) as e:
            io.scan_csv(spark, str(bad))
        assert e.value.kind == kind
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(io.ScanError):
        io.scan_csv(spark, str(tmp_path / "empty.csv"))


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    io.write_fresh(df, f"{tmp_path}/t")
    with pytest.raises(Exception):
        io.write_fresh(df, f"{tmp_path}/t")
    assert io.markdown_table(df.orderBy("k")) == "| k | v |\n|---|---|\n| 1 | a |\n| 2 |  |\n"
    io.write_text(spark, f"{tmp_path}/a.json", io.to_json_document({"b": 1, "a": [2]}))
    files = {"a": f"{tmp_path}/a.json"}
    m = io.build_manifest(spark, files)
    assert io.verify_manifest(spark, m, files) == [] and io.verify_manifest(spark, m | {"meta": {"x": 1}}, files) == ["manifest"]
    assert io.discover(spark, [f"{tmp_path}/zz", f"{tmp_path}/a.json"]) == f"{tmp_path}/a.json"
    with pytest.raises(ValueError):
        io.guard_invalid(df.withColumn("status", F.lit("Invalid")))
    bad = io.selective_violations(df.select("k", F.lit(None).cast("double").alias("y")), spark.createDataFrame([(1,), (9,)], "k long"), "k", "y")
    assert sorted(map(tuple, bad.collect())) == [(1, "not_finite"), (9, "missing")]


def test_parsing(spark):
    df = spark.createDataFrame([("a.b.c.d.e.f>>p",), ("a.b>>p",), ("a>b>c",), ("ab",), ("a>b",), (None,)], "x string")
    got = [(r["s"], r["l"]) for r in df.select(ps.parse_fixed(F.col("x"))["status"].alias("s"), ps.sections(F.col("x"))["left"].alias("l")).collect()]
    assert [g[0] for g in got] == ["ok", "unexpected_left_token_count", "malformed", "malformed", "malformed", "malformed"]
    assert [g[1] for g in got][1:5] == [["a", "b"], ["a"], ["ab"], []]
    r = spark.range(1).select(ps.recover(F.lit("UNKNOWN"), F.lit(None).cast("string"), F.lit("z")).alias("v"), ps.mismatch({"a": F.lit(True), "b": F.lit(False), "c": F.lit(True)}).alias("m")).first()
    assert tuple(r) == ("z", "a_and_c")


def test_identity(spark):
    df = spark.createDataFrame([(1, "x", 50), (2, "x", 50), (3, "x", 70), (4, None, 20), (5, None, 20)], "id long, k string, y long")
    got = {r["k"]: r for r in idn.replicate_stats(df, ["k"], "y", "id").collect()}
    assert (got["x"]["n_rows"], got["x"]["median"], got["x"]["n_unique"], got["x"]["ids"]) == (3, 50.0, 2, "1,2,3")
    assert abs(got["x"]["std_pop"] - np.std([50, 50, 70])) < 1e-12 and got[None]["std_pop"] == 0.0
    assert idn.duplicates(df, ["k", "y"]).count() == 4
    u = [r[0] for r in spark.range(2000).select(idn.uniform(1, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03
    a = idn.assignment_hash(df, ["id", "k"], ["y"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, idn.assignment_hash(df.repartition(3), ["id", "k"], ["y"]).collect()))


@pytest.mark.parametrize("n", [3, 10, 97])
def test_split_sizes_and_invariance(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r["split"]: r["count"] for r in sp.random_split(df, "k", 1, 0.6, 0.2).groupBy("split").count().collect()}
    assert got.get("train", 0) == int(n * 0.6) and got.get("valid", 0) == int(n * 0.2) and sum(got.values()) == n
    a = sorted(map(tuple, sp.random_split(df, "k", 1, 0.6, 0.2).collect()))
    assert a == sorted(map(tuple, sp.random_split(df.repartition(5), "k", 1, 0.6, 0.2).collect()))
    assert sp.sample_rows(df, "k", 1, 0.0001).count() == 1 and sp.sample_rows(df, "k", 1, 0).count() == 0
    g = sp.grouped_outer(df, "k", 3, {"a": 0.9, "b": 0.05, "c": 0.05}).groupBy("split").count().collect()
    assert len(g) == 3


def test_groups_never_cross(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 17).alias("g"))
    out = sp.heldout_groups(df, "g", "k", 2, 0.2, 0.1)
    test = out.where("split = 'test'").select("g").distinct()
    assert test.count() == 4 and out.where("split <> 'test'").join(test, "g", "left_semi").count() == 0
    sizes = df.groupBy("g").agg(F.count("*").alias("n")).withColumn("h", idn.hash_order(1, "g"))
    nested = sp.nested_prefixes(sizes, "g", "n", "h", [0.1, 0.5, 1.0])
    assert ql.not_nested(nested, "g", "fraction").count() == 0
    assert nested.where("fraction = 1.0").count() == 17


def test_metrics_golden(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 3.0, 3.0), (1, 4.0, 5.0), (2, 1.0, 2.0), (2, 2.0, 2.0), (2, 3.0, 2.0)], "g int, y double, p double")
    r = {x["g"]: x for x in mt.regression(df, ["g"], "y", "p").collect()}
    assert (r[1]["rmse"], r[1]["mae"]) == (0.5, 0.25) and abs(r[1]["r2"] - 0.8) < 1e-12 and abs(r[1]["pearson"] - 0.9827076298) < 1e-9 and r[2]["pearson"] is None
    s = {x["g"]: x["spearman"] for x in mt.spearman(df, ["g"], "y", "p").collect()}
    assert abs(s[1] - 1.0) < 1e-12 and s[2] is None
    t = spark.createDataFrame([(1, 50, 0.2, 0), (1, 90, 0.4, 1), (1, 80, 0.3, 2), (1, 10, 0.9, 3)], "g int, y long, p double, i int")
    one = lambda k, th: mt.topk(t, ["g"], "y", "p", "i", k, th).first()
    assert one(2, 70)["hit_rate"] == 0.5 and one(3, 70)["topk_mean"] == 60 and one(1, 70)["regret"] == 80 and one(2, 70)["regret"] == 0
    assert one(2, 70)["first_hit"] == 2 and one(2, 95)["first_hit"] is None and one(99, 70)["n"] == 4


def test_conformal_and_distribution(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 11)], "g int, s double")
    assert lb.conformal_quantile(df, ["g"], "s", 0.8).first()["quantile"] == 9.0
    assert lb.conformal_quantile(df, ["g"], "s", 0.99).first()["quantile"] == 10.0
    d = mt.random_distribution(df.unionByName(spark.createDataFrame([(2, 5.0), (3, float("nan"))], "g int, s double")), ["g"], "s").collect()
    assert {r["g"]: r["std"] for r in d}[2] == 0.0 and 3 not in {r["g"] for r in d}


def test_signed_rank(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] + [(2, 0.0)], "g int, d double")
    r = {x["g"]: x for x in mt.signed_rank(df, ["g"], "d").collect()}
    assert abs(r[1]["p_value"] - 0.001953125) < 1e-12 and r[1]["w_plus"] == 55 and r[2]["p_value"] is None


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x, e = rng.normal(size=(200, 3)), rng.normal(size=200)
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * e
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = lb.ridge(df, ["a", "b", "c"], "y", 2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)
    assert np.allclose(m["weights"], w) and abs(m["intercept"] - (y.mean() - x.mean(0) @ w)) < 1e-9


def test_audit_equals_sequential_loop(spark):
    rnd = random.Random(1)
    rows = [(i, f"k{rnd.randint(0, 6)}", rnd.choice([None, None, None, "bad"])) for i in range(200)]
    feature = {f"k{i}": f"f{i // 2}" for i in range(7)}
    df = spark.createDataFrame([(i, k, feature[k], r) for i, k, r in rows], "id long, k string, f string, reason string")
    got = {r["id"]: (r["reason"], r["is_duplicate"], r["is_feature_duplicate"]) for r in au.dedup(df, "k", "f", "id").collect()}
    keys, feats = set(), set()
    for i, k, r in rows:
        dup, fdup = k in keys, feature[k] in feats
        if r is None:
            r = "duplicate_synthetic" if dup else "feature_duplicate_synthetic" if fdup else None
            if r is None:
                keys.add(k)
                feats.add(feature[k])
        assert got[i] == (r, dup, fdup)
    with pytest.raises(ValueError):
        au.scope(df, "k", df.select("k"), df.select("k"), mode="observed_only")


def test_candidates(spark):
    schema = RoleSchema(("s",), ("c1", "c2"), "y", "id")
    rows = [(i, f"s{i % 3}", f"a{i % 2}", f"b{i % 5}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, s string, c1 string, c2 string, y long")
    assert cd.unmeasured_cells(df, schema).count() == 0
    assert cd.unmeasured_cells(df.where("id <> 7"), schema).count() == 1
    pairs = cd.donor_pairs(df, df, schema, ("s",), ("c1", "c2"), "all")
    want = sum(1 for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and a[2] != b[2] and a[3] != b[3])
    assert pairs.count() == want
    got = cd.recombine(df, df, schema, 4, 1)
    assert got.groupBy("id").count().where("count <> 4").count() == 0
    assert got.join(df, ["id", "c1", "c2"]).count() == 0
    r = cd.resample(df, "id", "duplicate", 45)
    assert r.count() == 75 and r.groupBy("id").count().agg(F.max("count")).first()[0] == 3


def test_similarity(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    got = {(r["query"], r["place"]): r["neighbour"] for r in sm.dense_topk(df, df, 3).collect()}
    for i in range(60):
        assert [got[i, k] for k in (1, 2, 3)] == sorted(range(60), key=lambda j: (-s[i, j], j))[:3]
    assert sm.dense_topk(df.limit(0), df, 3).count() == 0
    a = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [9])], "id long, bits array<int>")
    b = spark.createDataFrame([(10, [2, 3, 4]), (11, [1])], "id long, bits array<int>")
    assert sorted(map(tuple, sm.tanimoto_nearest(a, b).collect())) == [(1, 10, 0.5), (2, None, 0.0), (3, None, 0.0)]


def test_features(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, ""), (3, None)], "id long, s string")
    r = [x[0] for x in df.orderBy("id").select(ft.hash_bits_blake(64, 1)(F.col("s"))).collect()]
    assert r[0] == sorted(set(r[0])) and r[1] == [] and r[2] == []
    assert [x[0] for x in df.orderBy("id").select(F.size(ft.hash_bits(F.col("s")))).collect()][1:] == [0, 0]
    schema = RoleSchema(("a", "b"), ("c", "d", "e", "f"), "y", "id", ("p",))
    assert ft.layout(schema, 16)["width"] == 112 and ft.layout(schema, 16, "part", deltas=(("substrate", "product"),))["names"][-1] == "product-substrate"
    assert ft.layout(schema, 8, parts=("condition",))["width"] == 32 and ft.incompatible({"a": 1}, {"a": 2, "b": 1}) == ["a", "b"]
    with pytest.raises(ValueError):
        ft.layout(schema, 2, "nope")


def test_acquisition(spark):
    df = spark.createDataFrame([("c", i, float(i % 7), [float(i % 2), 1.0]) for i in range(40)], "c string, k long, y double, v array<double>")
    log = aq.campaign(df, "c", "k", "y", 1, 5, 3, 4).collect()
    assert len(log) == 17 and len({r["key"] for r in log}) == 17
    assert aq.greedy_diverse(df, "c", "k", "y", "v", 6, 0.5).count() == 6
    x = spark.range(1).select(aq.normal_cdf(F.lit(1.959964)).alias("p")).first()[0]
    assert abs(x - 0.975) < 1e-5
    with pytest.raises(ValueError):
        aq.register_strategy("ucb", lambda **_: None)
    with pytest.raises(ValueError):
        aq.campaign(df, "c", "k", "y", 1, 5, 3, 4, "nope")
    logs = {p: [(r["round"], r["key"]) for r in aq.campaign(df, "c", "k", "y", 1, 5, 3, 4, p, "y").collect()] for p in aq.POLICIES}
    assert all(len(set(x)) == 17 and x[:5] == logs["greedy"][:5] for x in logs.values()) and logs["thompson"] != logs["random"] != logs["greedy"]


def test_midrank_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("u", 5), ("u", 5), ("u", 9), ("w", 1)], "g string, v int")
    r = spark.createDataFrame([("u", 1), ("u", 5), ("u", 5), ("u", 7), ("u", None)], "g string, v int")
    got = sorted((x["v"], x["n_random"], x["percentile"], x["advantage"]) for x in mt.midrank_percentile(a, r, ["g"], "v").collect())
    assert got == [(5, 4, 50.0, 0.5), (5, 4, 50.0, 0.5), (9, 4, 100.0, 4.5)]


def test_bootstrap_groups_draw_their_own(spark):
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in (1, 2, 4, 8, 16)], "g string, v double")
    got = {r["g"]: (r["low"], r["high"], r["mean"]) for r in mt.bootstrap_ci(df, ["g"], "v", 200).collect()}
    assert got["a"][2] == got["b"][2] and got["a"] != got["b"]


def test_protocol(tmp_path):
    e = pr.freeze({"a": 1})
    assert pr.verify(e) == {"a": 1}
    with pytest.raises(ValueError):
        pr.verify(e | {"policy": {"a": 2}})
    reg = pr.Registry(str(tmp_path / "r"))
    reg.move("u", "reserved")
    with pytest.raises(ValueError):
        reg.move("u", "reserved")
    assert reg.stale(["u", "v"]) == ["u"]
    reg.move("u", "prediction_complete")
    reg.move("u", "metrics_complete")
    assert reg.state("u") == "metrics_complete"
    assert len(pr.grid({"multiplier": [1, 2, 3], "similarity": [0.8, 0.85]}, pr.multiplier_rule)) == 5
    with pytest.raises(pr.ConfigError):
        pr.check_config({"x": True}, {"x": (int, True, None)})
    assert pr.check_config({"x": 3}, {"x": (int, True, lambda v: v > 2)}) == {"x": 3}


def test_stream_equals_batch(spark, tmp_path):
    from lattica.streaming.windows import windowed_outcomes

    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2], i) for i in range(60)], "k long, t string, kind string, v long").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, windowed_outcomes(df, "t", "kind", "v").collect()))
    q = windowed_outcomes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "t", "kind", "v").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == want
