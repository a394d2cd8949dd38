import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import cleaning as cl
from lattica.operators import metrics as mt
from lattica.operators import similarity as sm


def test_signed_rank_of_many_pairs(spark):
    r = np.random.default_rng(1)
    data = {"a": r.normal(0.2, 1, 30).round(1), "b": r.normal(0.2, 1, 200).round(1), "c": r.normal(size=51)}
    df = spark.createDataFrame([(g, float(x)) for g, v in data.items() for x in v], "g string, d double")
    got = {x["g"]: x for x in mt.signed_rank(df, ["g"], "d").collect()}
    for g, v in data.items():
        v = v[np.abs(v) > 1e-12]
        size = np.abs(v)
        rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        w, m = rank[v > 0].sum(), len(v)
        assert got[g]["w_plus"] == pytest.approx(w)
        ties = np.array([(rank == k).sum() for k in set(rank.tolist())])
        z = (w - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - (ties**3 - ties).sum() / 48)
        p = math.erfc(abs(z) / math.sqrt(2))
        assert got[g]["p_value"] == pytest.approx(p, rel=1e-9) if m > 50 else abs(got[g]["p_value"] - p) < 0.03


def test_dict_fields_with_apostrophes(spark):
    values = ["{'name': 'plain', 'n': 3}", '{\'name\': "it\'s"}', '{"name": "x"}', "{'name': 'it\\'s'}", "{'other': 1}", "broken", None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r[0] for r in df.select(cl.dict_field(F.col("c"), "name")).collect()] == ["plain", "it's", "x", "it's", None, None, None]


def test_nearly_equal_rows_are_no_exact_match(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1e-5], "b"), (3, [1.0, 0.0], "c"), (4, [5.0, 5.0], "d")], "id long, vec array<double>, label string")
    got = {r["id"]: r["nearest"] for r in sm.nearest_label(df.where("id = 1"), df, "label").collect()}
    assert got == {1: 2}
