"""Fingerprints as sparse bits, one-hot columns and block layouts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.cleaning import fill_unknown
from lattica.schema import RoleSchema

def ngrams(c: Column, widths: list[int]) -> Column:
    """All character n-grams of the widths, and the whole string first."""
    parts = [F.when(F.length(c) >= w, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - w + 1, F.lit(1))), _piece(c, w))).otherwise(F.array().cast("array<string>")) for w in widths]
    return F.concat(F.array(c), *parts)


def _piece(c, w):
    return lambda i: F.substring(c, i, F.lit(w))


def hash_bits(c: Column, n_bits: int = 1024, radius: int = 1) -> Column:
    """F2 (SQL form): sorted distinct bits, by a prefix of SHA-256 of the n-grams of widths 1 to radius + 2; null: none."""
    grams = F.array_distinct(ngrams(c, list(range(1, radius + 3))))
    bits = F.transform(grams, lambda g: (F.conv(F.substring(F.sha2(g, 256), 1, 12), 16, 10).cast("long") % n_bits).cast("int"))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(bits)))


def hash_bits_blake(n_bits: int = 2048, radius: int = 2):
    """F2 (byte-exact form): BLAKE2b of 8 bytes, little-endian, modulo ``n_bits``; an Arrow-batched function."""

    @F.pandas_udf("array<int>")
    def bits(values: pd.Series) -> pd.Series:
        def one(s):
            if not s:
                return []
            top = max(1, min(len(s), radius + 2))
            grams = {s} | {s[i : i + w] for w in range(1, top + 1) for i in range(len(s) - w + 1)}
            return sorted({int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") % n_bits for g in grams})

        return values.map(one)

    return bits


def bit_counts(df: DataFrame, key: list[str], bits: list[str]) -> DataFrame:
    """F3 (sum): (key, bit, n) over several fingerprint columns."""
    return df.select(*key, F.explode(F.concat(*[F.col(b) for b in bits])).alias("bit")).groupBy(*key, "bit").agg(F.count("*").alias("n"))


def bit_union(bits: list[Column]) -> Column:
    """F3 (or)."""
    return F.array_sort(F.array_distinct(F.concat(*bits)))


def blocks(roles: dict[str, Column], n_bits: int) -> Column:
    """Role fingerprints side by side, bit + role index * n_bits."""
    return F.concat(*[F.transform(c, _offset(i * n_bits)) for i, c in enumerate(roles.values())])


def _offset(k):
    return lambda b: b + k


def delta(minus: Column, plus: Column) -> Column:
    """F4 (delta): signed map bit -> +1 / -1 of bits in one side only."""
    up, down = F.array_except(plus, minus), F.array_except(minus, plus)
    return F.map_from_arrays(F.concat(up, down), F.concat(F.transform(up, lambda _: F.lit(1)), F.transform(down, lambda _: F.lit(-1))))


def one_hot(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """columns ``col__category`` of 0/1, categories in order; null and blank are UNKNOWN."""
    filled = df.select(id_col, *[fill_unknown(F.col(c).cast("string")).alias(c) for c in columns])
    cats = {c: [r[0] for r in filled.select(c).distinct().orderBy(c).collect()] for c in columns}  # the width of the result
    return filled.select(id_col, *[(F.col(c) == v).cast("int").alias(f"{c}__{v}") for c in columns for v in cats[c]])


def layout(schema: RoleSchema, n_bits: int, by: str = "role", parts: tuple[str, ...] = ("substrate", "condition", "product"), deltas: tuple = ()) -> dict:
    """names, slices and width of the blocks of a feature layout.

    A block for each role, each of ``parts`` that the schema has, or one for ``all``
    of them, and one more for each pair of ``deltas``, a signed difference.
    """
    if by not in ("role", "part", "all") or not set(parts) <= {"substrate", "condition", "product"}:
        raise ValueError(f"unknown feature layout: {by} of {', '.join(parts)}")
    own = {p: getattr(schema, p) for p in parts if getattr(schema, p)}
    names = ["all"] if by == "all" else list(own) if by == "part" else [r for roles in own.values() for r in roles]
    names += [f"{plus}-{minus}" for minus, plus in deltas]
    return {"by": by, "n_bits": n_bits, "names": names, "width": len(names) * n_bits, "slices": [[i * n_bits, (i + 1) * n_bits] for i in range(len(names))]}


def incompatible(a: dict, b: dict) -> list[str]:
    """F8: names of the metadata in which two layouts differ."""
    return sorted(k for k in {*a, *b} if a.get(k) != b.get(k))


def diagnostics(df: DataFrame, bits: str) -> DataFrame:
    """rows, empty fingerprints, least, mean and most bits."""
    n = F.size(bits)
    return df.agg(F.count("*").alias("n_rows"), F.count_if(n == 0).alias("n_empty"), F.min(n).alias("min_bits"), (F.sum(n).cast("double") / F.count("*")).alias("mean_bits"), F.max(n).alias("max_bits"))


def block_domains(df: DataFrame, values: str, n_bits: int) -> DataFrame:
    """for (bit -> count) rows, whether each block is binary, counts or other."""
    x = df.select(F.explode(values).alias("bit", "v")).withColumn("block", F.floor(F.col("bit") / n_bits))
    out = x.groupBy("block").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return out.withColumn("domain", F.when((F.col("low") >= 0) & (F.col("high") <= 1), "binary").when(F.col("low") >= 0, "count").otherwise("signed"))


def f_scores(bits: DataFrame, row: str, outcome: DataFrame, y: str, k: int) -> DataFrame:
    """the k bits of largest univariate F score (integer outcomes: exact sums), ties by bit.

    For a 0/1 feature r**2 follows from the number and outcome sum of its rows,
    so the dense matrix is never built.
    """
    t = outcome.agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y).cast("decimal(19,0)") * F.col(y)).cast("double").alias("syy")).first()
    if not t["n"]:
        return bits.select("bit").limit(0).withColumn("score", F.lit(0.0))
    g = bits.join(outcome.select(row, y), row).groupBy("bit").agg(F.count("*").alias("m"), F.sum(y).alias("s"))
    n, sy, syy = float(t["n"]), float(t["sy"] or 0), float(t["syy"] or 0)
    cov = F.lit(n) * F.col("s") - F.col("m") * F.lit(sy)
    r2 = F.try_divide(cov * cov, F.col("m") * (F.lit(n) - F.col("m")) * F.lit(n * syy - sy * sy))
    score = F.try_divide(r2 * F.lit(n - 2), F.lit(1.0) - r2)
    return g.select("bit", score.alias("score")).orderBy(F.col("score").desc_nulls_last(), "bit").limit(k)
