"""Operators of transfer, saved splits and tests whose answers SQL doesn't give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import identity as idn
from lattica.operators import metrics as mt
from lattica.operators import similarity as sm
from lattica.operators import transfer as tr
from lattica.schema import RoleSchema
from lattica.sources import saved_splits

SCHEMA = RoleSchema(("s",), ("c1", "c2"), "y", "id")


def test_t_test_p_values(spark):
    """Against known quantiles of the t distribution: two-sided 5 % at 2.262157 with 9 and 12.7062 with 1 degrees of freedom."""
    assert abs(mt._beta_share(4.5, 0.5, 9 / (9 + 2.262157163**2)) - 0.05) < 1e-9
    assert abs(mt._beta_share(0.5, 0.5, 1 / (1 + 12.70620474**2)) - 0.05) < 1e-9
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0)] + [("b", 1.0), ("c", 2.0), ("c", 2.0)], "g string, d double")
    got = {r["g"]: r for r in mt.t_test(df, ["g"], "d").collect()}
    assert abs(got["a"]["t"] - 2 * np.sqrt(3)) < 1e-12 and abs(got["a"]["p_value"] - 0.07417990) < 1e-7
    assert got["b"]["p_value"] is None and got["c"]["p_value"] is None


def test_saved_split(spark, tmp_path):
    records = spark.createDataFrame([(i, f"g{i // 2}", 1.0) for i in range(8)], "id long, g string, y double")
    good = [(i, "train" if i < 4 else "valid" if i < 6 else "test", i < 2, i < 4) for i in range(8)]
    schema = "id long, split string, small boolean, large boolean"
    spark.createDataFrame(good, schema).write.parquet(f"{tmp_path}/good")
    assert saved_splits.load_saved_split(spark, f"{tmp_path}/good", records, "id", "g", levels=["small", "large"]).count() == 8
    bad = [(0, "train", True, False), (0, "train", True, True), (1, "test", False, False), (9, None, False, False)]
    got = {(r["check"], r["key"]) for r in saved_splits.violations(spark.createDataFrame(bad, schema), records, "id", "g", levels=["small", "large"]).collect()}
    want = {("unknown_split", "9"), ("repeated", "0"), ("unexpected", "9"), ("crossing", "g0"), ("not_nested", "0")} | {("missing", str(i)) for i in range(2, 8)}
    assert got == want
    spark.createDataFrame(bad, schema).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="crossing"):
        saved_splits.load_saved_split(spark, f"{tmp_path}/bad", records, "id", "g")


def test_either_context_takes_a_pair_once(spark):
    rows = [(i, f"s{i % 2}", f"a{i % 3}", f"b{i % 5}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, s string, c1 string, c2 string, y long")
    got = tr.either_context(df, df, SCHEMA, [("s",), ("c1",)], ("c2",))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[3] != b[3] and (a[1] == b[1] or a[2] == b[2])}
    pairs = [(r["s_id"], r["d_id"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    with pytest.raises(ValueError):
        tr.run_control("nope", df, df, SCHEMA)
    assert set(tr.role_modes(SCHEMA)) == {"c1", "c2", "all"}


def test_nearest_label_of_equal_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [0.0, 1.0], "b"), (3, [0.0, 3.0], "c")], "id long, vec array<double>, label string")
    got = {r["id"]: (r["nearest"], r["label"]) for r in sm.nearest_label(df, df, "label").collect()}
    assert got == {1: (3, "c"), 2: (3, "c"), 3: (1, "a")}
    same = df.where("id < 3")
    assert {r["id"]: r["nearest"] for r in sm.nearest_label(same, same, "label").collect()} == {1: 1, 2: 1}


def test_vector_hash(spark):
    import hashlib

    df = spark.createDataFrame([(1, [1.0, 2.5]), (2, [float("nan")]), (3, None)], "id long, v array<double>")
    got = {r["id"]: r["h"] for r in df.select("id", idn.vector_hash("v").alias("h")).collect()}
    assert got == {1: hashlib.sha256(b'{"dtype":"<f4","n":2}\0' + np.array([1.0, 2.5], "<f4").tobytes()).hexdigest(), 2: None, 3: None}
    d = hashlib.sha256(b"5:7").digest()
    assert spark.range(1).select(idn.derived_seed(5, F.lit(7)).cast("string").alias("s")).first()[0] == str(int.from_bytes(d[:8], "little"))
