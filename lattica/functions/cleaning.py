"""Normalisation, projection and filters of raw records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.schema import UNKNOWN


def normal_name(name: str) -> str:
    """Trimmed, lower-case, runs of other characters as one underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(c) for c in df.columns])


def first_present(df: DataFrame, aliases: list[str]) -> Column | None:
    """The first of the aliases that is a column."""
    return next((F.col(a) for a in aliases if a in df.columns), None)


def numeric(c: Column) -> Column:
    """Null where the text is no number."""
    return c.try_cast("double")


def in_range(c: Column, low=0, high=100) -> Column:
    """Inclusive; out of range is not clipped."""
    return c.between(low, high)


def known(c: Column) -> Column:
    """Neither null, blank nor UNKNOWN."""
    return F.coalesce((F.trim(c) != "") & (c != UNKNOWN), F.lit(False))


def fill_unknown(c: Column) -> Column:
    """N7."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNKNOWN))


def row_id(position: Column, start: int = 1, prefix: str = "rxn_") -> Column:
    """``prefix`` and six digits, from a 0-based position."""
    return F.format_string(f"{prefix}%06d", position + start)


def filter_counts(df: DataFrame, outcome: Column, required: Column) -> DataFrame:
    """Kept rows and separate counters; a missing value counts only among rows of valid outcome."""
    ok = F.coalesce(in_range(numeric(outcome)), F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~ok).alias("dropped_invalid_outcome"),
        F.count_if(ok & ~known(required)).alias("dropped_missing_required"),
        F.count_if(ok & known(required)).alias("kept"),
    )


def unknown_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_unknown, n_rows, warn) for each column; warn over one half."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(~known(F.col(c).cast("string"))).alias(f"u{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("n_unknown")) for i, c in enumerate(columns)])
    return counts.select(F.explode(pairs).alias("x"), "n").select("x.column_name", "x.n_unknown", F.col("n").alias("n_rows"), (F.col("x.n_unknown") * 2 > F.col("n")).alias("warn"))


def drop_all_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without those of the columns that are unknown in every row."""
    got = df.agg(*[F.bool_or(known(F.col(c).cast("string"))).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not got[c]])


def to_percent(df: DataFrame, outcome: str) -> DataFrame:
    """A table whose largest outcome is at most 1 holds fractions."""
    top = df.agg(F.max(outcome)).first()[0]
    return df.withColumn(outcome, F.col(outcome) * 100) if top is not None and top <= 1 else df


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The known columns first, in their order, then all others."""
    first = [n for n in names if n in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def tokens(c: Column, separator: str = "[.]") -> Column:
    """Trimmed parts, empty ones dropped."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def clean(df: DataFrame, outcome: str, required: str, optional: list[str], leading: list[str]) -> DataFrame:
    """Names, numbers, range, required text, UNKNOWN, column order."""
    out = normalise_names(df)
    out = out.withColumn(outcome, numeric(F.col(outcome))).where(in_range(F.col(outcome)) & known(F.col(required)))
    out = out.withColumns({c: fill_unknown(F.col(c)) for c in optional if c in out.columns})
    return project(drop_all_unknown(out, [c for c in optional if c in out.columns]), leading)


def dict_field(c: Column, field: str) -> Column:
    """A field of a record written as a dict literal ('single quotes'), as text; null where it can't be read."""
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.from_json(c, f"`{field}` STRING", options)[field]


def stage_counts(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, n_rows) left after each filter, in order, from one aggregation; stage 0 is the input."""
    ok, counts = F.lit(True), []
    for name, test in [("input", F.lit(True)), *stages]:
        ok = ok & F.coalesce(test, F.lit(False))
        counts.append((name, F.count_if(ok)))
    one = df.agg(*[c.alias(f"n{i}") for i, (_, c) in enumerate(counts)])
    items = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage"), F.col(f"n{i}").alias("n_rows")) for i, (n, _) in enumerate(counts)])
    return one.select(F.explode(items).alias("x")).select("x.*")
