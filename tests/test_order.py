import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import candidates as cd
from lattica.operators import labels as lb
from lattica.operators import metrics as mt
from lattica.operators import order as od
from lattica.operators import splits as sp


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    return [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1.0, 1.0, 2.5, float(i)]), rnd.randint(0, 9)) for i in range(500)]


SCHEMA = "id long, g string, v double, n_ long"


def test_positions_within_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = od.positions(df, [F.col("v").desc_nulls_last(), "id"], ["g"], "place", "n", {"ahead": "n_"}).collect()
    assert len(got) == 500 and got[0].asDict().keys() == {"id", "g", "v", "n_", "place", "n", "ahead"}
    for g in ("a", "b", None):
        want = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["id"] for r in mine] == [r[0] for r in want]
        assert [r["place"] for r in mine] == list(range(len(want))) and {r["n"] for r in mine} == {len(want)}
        assert [r["ahead"] for r in mine] == [sum(r[3] for r in want[:k]) for k in range(len(want))]


def test_positions_with_ties_and_equal_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 40 + [(0, "y")] * 3, "k long, t string")
    got = od.positions(df, ["k"]).collect()
    assert sorted(r["position"] for r in got) == list(range(43))
    assert sorted(r["position"] for r in got if r["k"] == 0) == [0, 1, 2]
    assert od.positions(df.where("false"), ["k"]).collect() == []


def test_order_statistics_and_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    v = [r[2] for r in rows if r[2] is not None]
    at = [0.0, 1 / 3, 0.5, 0.9, 1.0]
    assert od.quantile_edges(df, "v", at) == pytest.approx(np.quantile(v, at).tolist())
    assert od.quantile_edges(df.where("false"), "v", [0.5]) == [None]
    got = {r["g"]: (r["n"], r["id"]) for r in od.order_statistic(df, "id", F.col("n") - 1, ["g"]).collect()}
    assert got == {g: (sum(r[1] == g for r in rows), max(r[0] for r in rows if r[1] == g)) for g in ("a", "b", None)}


def test_no_task_sorts_the_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = df.withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    for out in (
        cd.traversal(df, ["v", "id"]),
        mt.strided(df, [F.col("id").desc()], 9),
        sp.nested_prefixes(sizes, "id", "n_", "h", [0.1, 1.0]),
        lb.strata(df, "v", [0.5]),
        mt.tertiles(df, "v"),
        lb.conformal_quantile(df, ["g"], "v", 0.9),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert out.count()
    assert [r["id"] for r in cd.traversal(df, [F.col("id").desc()]).orderBy("position").collect()] == list(range(499, -1, -1))
    assert sorted(r["id"] for r in mt.strided(df, ["id"], 3).collect()) == [0, 250, 499]
