"""Quality assertions: each returns the rows that break the rule (Q1 to Q6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; a null is one key, as in EXCEPT.  One aggregation of both sides, without a join to sort for."""
    side = lambda df, n: df.select(key, F.lit(n).alias("_side"))
    both = side(a, 1).unionByName(side(b, 2)).groupBy(key).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    return both.where("_lo = _hi").select(key, F.when(F.col("_lo") == 1, "left_only").otherwise("right_only").alias("side"))


def overlapping_parts(df: DataFrame, key: str, part: str) -> DataFrame:
    """Keys in several parts; with a group as key: groups that cross splits."""
    return df.groupBy(key).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1")


def not_nested(df: DataFrame, key: str, level: str) -> DataFrame:
    """Keys that are in a level but miss from a higher one; levels are those of the table."""
    levels = df.select(level).distinct()
    ranks = df.select(key, level).distinct().groupBy(key).agg(F.min(level).alias("low"), F.count("*").alias("n"))
    above = levels.join(ranks.select("low").distinct(), F.col(level) >= F.col("low")).groupBy("low").agg(F.count("*").alias("expected"))
    return ranks.join(above, "low").where(F.col("n") < F.col("expected")).select(key, "low", "n", "expected")


def count_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.agg(F.count("*").alias("left_rows")), b.agg(F.count("*").alias("right_rows"))
    return x.crossJoin(y).where("left_rows <> right_rows")  # one row each


def assert_empty(violations: DataFrame, message: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise AssertionError(f"{message}: {[r.asDict() for r in found]}")
