import threading
import uuid

import pytest
from pyspark.sql import functions as F

from lattica.functions import canonical as cn
from lattica.operators import bin_policy as bp
from lattica.operators import protocol as pr
from lattica.sources import pools, shared_files


def test_pool_is_written_once_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None), (2, None, None), (3, "b|c=1:x", 0.5)], "k long, t string, v double")
    path = pools.write_pool(df.repartition(3), str(tmp_path), "anonymous", {"seed": 1})
    assert pools.write_pool(df.coalesce(1), str(tmp_path), "anonymous", {"seed": 1}) == path
    assert pools.write_pool(df, str(tmp_path), "anonymous", {"seed": 2}) != path
    rows, manifest = pools.load_pool(spark, path, "anonymous")
    assert manifest["rows"] == 4 and sorted(map(str, rows.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(pools.PoolError, match="kind"):
        pools.load_pool(spark, path, "typed")
    df.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(pools.PoolError, match="digest"):
        pools.load_pool(spark, path)
    df.write.parquet(f"{tmp_path}/half/rows")
    with pytest.raises(pools.PoolError, match="no manifest"):
        pools.load_pool(spark, f"{tmp_path}/half")
    digest = lambda d: pools.table_digest(d).first()["digest"]
    assert digest(df) == digest(df.orderBy(F.desc("k"))) != digest(df.distinct())
    assert digest(spark.createDataFrame([("1", None)], "a string, b string")) != digest(spark.createDataFrame([(None, "1")], "a string, b string"))
    empty = pools.write_pool(df.where("false"), str(tmp_path), "anonymous", {})
    assert pools.load_pool(spark, empty)[1]["rows"] == 0
    with pytest.raises(TypeError):
        pools.table_digest(df.withColumn("x", F.array("k")))


def test_one_of_many_drivers_wins(spark, tmp_path):
    other = spark.newSession()
    for unit in ("unit", {"fold": 3, "seed": 1}):
        won, lost = [], []

        def claim(k, unit=unit, won=won, lost=lost):
            reg = pr.SharedRegistry(spark if k % 2 else other, str(tmp_path))
            try:
                reg.move(unit, "reserved", {"driver": k})
                won.append(k)
            except pr.ClaimError:
                lost.append(k)

        threads = [threading.Thread(target=claim, args=(k,)) for k in range(12)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and len(lost) == 11
        a, b = pr.SharedRegistry(spark, str(tmp_path)), pr.SharedRegistry(other, str(tmp_path))
        assert b.records(unit)[0]["payload"] == {"driver": won[0]}
        with pytest.raises(pr.ClaimError):
            b.move(unit, "metrics_complete")
        a.move(unit, "prediction_complete", {"hash": "x"})
        b.move(unit, "metrics_complete", {"rmse": 1.5})
        assert a.inspect(unit, 0) == "metrics_complete"
    assert not [n for n in shared_files.names(spark, str(tmp_path)) if n.endswith("draft")]


def test_stale_claims_end_for_good(spark, tmp_path):
    reg = pr.SharedRegistry(spark, f"{tmp_path}/r")
    assert reg.state("u") is None and reg.inspect("u", 1) is None
    reg.move("u", "reserved", now=100.0)
    assert reg.inspect("u", 60, now=120.0) == "reserved"
    assert reg.inspect("u", 60, now=160.0) == "failed_or_uncertain"
    for state in ("reserved", "prediction_complete"):
        with pytest.raises(pr.ClaimError):
            reg.move("u", state)
    path = reg._file("u", 0)
    shared_files.delete(spark, path)
    shared_files.create_once(spark, path, '{"unit": "u", "state": "reserved", "at": 1, "payload": {}, "hash": "0"}')
    with pytest.raises(pr.ClaimError, match="changed"):
        reg.state("u")


def test_plugin_sees_each_value_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def run(values):
        calls.add(len(values))
        if "boom" in values:
            raise RuntimeError("no")
        return [None if v.startswith("?") else v.strip().lower() for v in values]

    rows = [("A ", "b", 1)] * 50 + [("?x", None, 2), ("boom", "  ", 3), ("B", "A ", 4)]
    df = spark.createDataFrame(rows, "left string, right string, canonicaliser int").repartition(6)
    out = cn.canonicalise(df, ["left", "right"], cn.Plugin("toy", "2", run)).collect()
    assert len(out) == len(rows) and {r["canonicaliser"] for r in out} == {"toy@2"}
    by = {r["left"]: r for r in out}
    assert by["A "]["left_canonical"] == "a" and by["A "]["right_valid"] and by["A "]["left_error_type"] is None
    assert (by["?x"]["left_valid"], by["?x"]["left_error_type"], by["?x"]["right_error_type"]) == (False, "unparsable", "missing")
    assert by["boom"]["left_error_type"] == "plugin_error" and "no" in by["boom"]["left_error"] and by["boom"]["right_error_type"] == "missing"
    assert calls.value <= 5 * 4  # five distinct values; only the halves around the failing one come again
    assert cn.canonicalise(df.where("false"), ["left"], cn.Plugin("toy", "2", run)).count() == 0


def test_policy_rounds_equal_brute_force(spark):
    import hashlib

    pool = [(i, (i * 7) % 5, float((i * 7) % 5 == 3) + i % 3 / 10 if i % 11 else None) for i in range(200) if (i * 7) % 5 != 1]
    df = spark.createDataFrame([*pool, (900, None, 1.0), (901, 9, 1.0)], "k long, b int, r double").repartition(4)
    s = bp.PolicySettings(5, 3, 12, 6, 0.25, 0.4, 7)
    got = {(x["round"], x["bin"]): (x["probability"], x["elite_reward"]) for x in bp.bin_policy(df, "k", "b", "r", s).collect()}
    u = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[:12], 16) / 16.0**12
    policy = [0.2] * 5
    for r in range(3):
        scores, bins = [], []
        for b in range(12):
            own, reward = [], []
            for j in range(6):
                x, total, k = u(f"7:bin:{r}:{b}:{j}"), 0.0, 0
                for p in policy[:-1]:
                    total += p
                    k += x >= total
                own.append(k)
                rows = [v for v in pool if v[1] == k]
                if rows and (v := rows[int(u(f"7:row:{r}:{b}:{j}") * len(rows))][2]) is not None:
                    reward.append(v)
            bins.append(own)
            scores.append((-sum(reward) / len(reward) if reward else None, b))
        elite = sorted(x for x in scores if x[0] is not None)[:3]
        hits = [k for _, b in elite for k in bins[b]]
        policy = [0.4 * p + 0.6 * (1 + hits.count(k)) / (5 + len(hits)) for k, p in enumerate(policy)]
        for k in range(5):
            assert got[r + 1, k] == pytest.approx((policy[k], -sum(x[0] for x in elite) / 3))
    assert policy[3] > 0.3
    assert bp.policy_candidates(df, "k", "b", policy, 20, seed=1).where("k < 900").count() <= 20
    name = uuid.uuid4().hex
    assert bp.bin_policy(df.where(f"'{name}' = ''"), "k", "b", "r", s).where("round = 3").count() == 5
