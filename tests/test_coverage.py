"""Keys that one side has alone, by one aggregation."""

from lattica.operators import quality as ql


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_gaps_take_null_as_a_key(spark):
    df = lambda t: spark.createDataFrame([(k,) for k in t], "k long")
    got = ql.coverage_gaps(df([1, 2, 2, None]), df([2, 3, 3, None]), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "left_only"), (3, "right_only")] and "Join" not in plan(got)
    assert [tuple(r) for r in ql.coverage_gaps(df([None, 1]), df([1]), "k").collect()] == [(None, "left_only")]
