"""Keys, hashes and duplicate audits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_VERSION = "lattica-key-1"


def key(*columns: str, version: str = KEY_VERSION) -> Column:
    """Canonical JSON of the columns in name order; null if one of them is null."""
    ordered = sorted(columns)
    whole = F.to_json(F.struct(F.lit(version).alias("_version"), *[F.col(c).cast("string").alias(c) for c in ordered]))
    present = F.lit(True)
    for c in ordered:
        present = present & F.col(c).isNotNull()
    return F.when(present, whole)


def hashed(c: Column) -> Column:
    return F.sha2(c, 256)


def source_row_id(file_hash: str, position: Column) -> Column:
    """I5."""
    return F.sha2(F.concat_ws(":", F.lit(file_hash), position.cast("string")), 256)


def hash_order(seed, *columns: str) -> Column:
    """The seeded shuffle order of rows; ties broken by the columns themselves, which the caller adds."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def uniform(seed, c: Column) -> Column:
    """A stable number in [0, 1) from twelve hex digits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), c.cast("string")), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def derived_seed(seed, c: Column) -> Column:
    """An integer seed for each key: the first eight bytes of the digest, little end first."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), c.cast("string")), 256)
    return F.conv(F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))]), 16, 10).cast("decimal(20,0)")


def vector_hash(vec: str):
    """I8: a column function for the SHA-256 of a header with the length, a NUL, and the values as little-endian float32; null if one isn't finite."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            a = np.asarray(x, "<f4")
            return hashlib.sha256(f'{{"dtype":"<f4","n":{len(a)}}}'.encode() + b"\0" + a.tobytes()).hexdigest() if np.isfinite(a).all() else None

        return v.map(one)

    return run(F.col(vec))


def canonicalise(df: DataFrame, columns: list[str], canonical: Callable[[Column], Column], valid: Callable[[Column], Column]) -> DataFrame:
    """<c>_canonical, <c>_valid, <c>_error for each column; no row is dropped.

    ``canonical`` and ``valid`` are column functions: a chemistry toolkit is not
    part of this library, so the caller brings the rule.
    """
    out = df
    for c in columns:
        missing = F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
        ok = ~missing & F.coalesce(valid(F.col(c)), F.lit(False))
        out = out.withColumns({f"{c}_canonical": F.when(ok, canonical(F.col(c))), f"{c}_valid": ok, f"{c}_error": F.when(missing, "missing_or_non_string").when(~ok, "invalid")})
    return out


def duplicates(df: DataFrame, signature: list[str]) -> DataFrame:
    """All members of groups of equal signature.

    Group sizes are counted with partial aggregation and joined back, so a
    signature that many rows share is not gathered in one window.
    """
    sizes = df.groupBy(*signature).agg(F.count("*").alias("n_members")).where("n_members > 1")
    same = F.lit(True)
    for c in signature:
        same = same & df[c].eqNullSafe(F.col(f"_s_{c}"))
    return df.join(sizes.select(*[F.col(c).alias(f"_s_{c}") for c in signature], "n_members"), same).drop(*[f"_s_{c}" for c in signature])


def _is_integral(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.ShortType))


def std_pop(df: DataFrame, c: str) -> Column:
    """Population deviation; from exact sums where the column is integral."""
    if not _is_integral(df, c):
        return F.stddev_pop(c)
    y = F.col(c).cast("decimal(19,0)")
    n = F.count(c).cast("decimal(19,0)")
    return F.sqrt((n * F.sum(y * y) - F.sum(y) * F.sum(y)).cast("double")) / F.count(c)


def std_samp(df: DataFrame, c: str, single: float | None = None) -> Column:
    """Sample deviation; ``single`` for groups of one row."""
    if not _is_integral(df, c):
        out = F.stddev_samp(c)
    else:
        y = F.col(c).cast("decimal(19,0)")
        n = F.count(c).cast("decimal(19,0)")
        out = F.sqrt(F.try_divide((n * F.sum(y * y) - F.sum(y) * F.sum(y)).cast("double"), (F.count(c) * (F.count(c) - 1)).cast("double")))
    return out if single is None else F.when(F.count(c) == 1, F.lit(single)).otherwise(out)


def replicate_stats(df: DataFrame, keys: list[str], outcome: str, row_id: str) -> DataFrame:
    """Statistics of each group of replicates; null keys form a group.

    The ids of a group are listed in order (an audit column: one id for each
    replicate of one cell).
    """
    y = F.col(outcome)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count(y).alias("n_outcomes"), (F.sum(y).cast("double") / F.count(y)).alias("mean"), F.percentile(y, 0.5).alias("median"),
        std_pop(df, outcome).alias("std_pop"), F.min(y).alias("min"), F.max(y).alias("max"), (F.max(y) - F.min(y)).alias("range"), F.count_distinct(y).alias("n_unique"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.col(row_id))), lambda x: x.cast("string")), ",").alias("ids"),
    )


def feature_collisions(df: DataFrame, feature: Column, identity: Column, row_id: str) -> DataFrame:
    """Feature values of several rows, and whether those rows are one identity."""
    rows = df.select(feature.alias("feature"), identity.alias("identity"), row_id)
    out = rows.groupBy("feature").agg(F.count("*").alias("n_rows"), F.count_distinct("identity").alias("n_identities"), F.min(row_id).alias("first_id")).where("n_rows > 1")
    return out.withColumn("kind", F.when(F.col("n_identities") == 1, "same_identity").otherwise("different_identity_same_feature"))


def role_value_counts(df: DataFrame, roles: list[str]) -> DataFrame:
    """Rows, nulls and distinct values of each role."""
    one = df.agg(*[x for i, r in enumerate(roles) for x in (F.count(r).alias(f"v{i}"), F.count_if(F.col(r).isNull()).alias(f"n{i}"), F.count_distinct(r).alias(f"d{i}"))])
    items = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"v{i}").alias("n_valid"), F.col(f"n{i}").alias("n_null"), F.col(f"d{i}").alias("n_distinct")) for i, r in enumerate(roles)])
    return one.select(F.explode(items).alias("x")).select("x.*")


def headline(df: DataFrame, cell: list[str], signature: list[str], outcome: str) -> DataFrame:
    """I16: rows, cells, replicated cells, conflicting cells, exact duplicates."""
    cells = df.groupBy(*cell).agg(F.count("*").alias("n"), F.count_distinct(outcome).alias("u"))
    a = cells.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_cells"), F.count_if(F.col("n") > 1).alias("n_replicated"), F.count_if(F.col("u") > 1).alias("n_conflicting"))
    b = df.groupBy(*signature).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("n_duplicate_rows"))
    return a.crossJoin(b)  # one row each


def invalid_values(df: DataFrame, roles: list[str], row_id: str) -> DataFrame:
    """(row, role, value) of values that are null or blank."""
    items = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("string").alias("value")) for r in roles])
    return df.select(row_id, F.explode(items).alias("x")).select(row_id, "x.role", "x.value").where(F.coalesce(F.trim("value") == "", F.lit(True)))


def guard_identity(df: DataFrame, stored: Column, live: Column) -> DataFrame:
    """Raises if a stored key differs from the recomputed one."""
    if df.where(~stored.eqNullSafe(live)).limit(1).count():
        raise ValueError("stored identity differs from the live one")
    return df


def measured_keys(df: DataFrame, stored: Column, live: Column) -> DataFrame:
    """I19."""
    return df.select(F.coalesce(stored, live).alias("key")).where("key is not null").distinct()


def assignment_hash(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One digest for each group of ``by``, independent of row order.

    XOR and sum of 60-bit row digests are aggregated (two numbers a group), then
    digested with the count; rows are never gathered.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 15), 16, 10).cast("long")
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return g.select(*by, F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("digest"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
