"""Saved split assignments: a loader that checks them against the records they split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.io import scan_parquet

SPLITS = ("train", "valid", "test")


def violations(assignments: DataFrame, records: DataFrame, row_id: str, group: str, split: str = "split", levels: list[str] = ()) -> DataFrame:
    """(check, key) of every broken rule: ``unknown_split``, ``repeated``, ``missing``, ``unexpected``, ``crossing`` groups, ``not_nested`` flags.

    ``levels`` are boolean columns from the smallest training subset to the
    largest; a row in one must be in all later ones.  Nulls are never valid.
    """
    key = lambda c: F.col(c).cast("string").alias("key")
    part = lambda df, name, c: df.select(F.lit(name).alias("check"), key(c))
    out = part(assignments.where(~F.coalesce(F.col(split).isin(*SPLITS), F.lit(False))), "unknown_split", row_id)
    out = out.unionByName(part(assignments.groupBy(row_id).agg(F.count("*").alias("n")).where("n > 1"), "repeated", row_id))
    out = out.unionByName(part(records.select(row_id).join(assignments.select(row_id).distinct(), row_id, "left_anti"), "missing", row_id))
    out = out.unionByName(part(assignments.select(row_id).join(records.select(row_id).distinct(), row_id, "left_anti"), "unexpected", row_id))
    grouped = assignments.select(row_id, split).join(records.select(row_id, group), row_id)
    out = out.unionByName(part(grouped.groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b"), "crossing", group))
    for small, large in zip(levels, levels[1:], strict=False):
        out = out.unionByName(part(assignments.where(F.col(small) & ~F.col(large)), "not_nested", row_id))
    return out


def load_saved_split(spark: SparkSession, path: str, records: DataFrame, row_id: str, group: str, split: str = "split", levels: list[str] = ()) -> DataFrame:
    """The assignments of a path; raises if a rule is broken. Reads no outcomes: records are only asked for ids and groups."""
    got = scan_parquet(spark, path)
    bad = violations(got, records.select(row_id, group), row_id, group, split, levels).groupBy("check").agg(F.count("*").alias("n"), F.min("key").alias("key")).collect()  # a row a check
    if bad:
        raise ValueError("saved split: " + "; ".join(f"{r['check']}: {r['n']}, first {r['key']}" for r in sorted(bad, key=lambda r: r["check"])))
    return got
