"""Rejection audit of candidates: the first reason wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """A1: the name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def later_reason(df: DataFrame, rules: list[tuple[str, Column]], reason: str = "reason") -> DataFrame:
    """Fills null reasons only."""
    return df.withColumn(reason, F.coalesce(reason, first_reason(rules)))


def scope(df: DataFrame, key: str, observed: DataFrame, measured: DataFrame | None = None, quarantined: DataFrame | None = None, mode: str = "global") -> DataFrame:
    """A3: adds scope_reason; observed outranks measured, which outranks quarantine.

    In ``observed_only`` mode the global set must not be given.
    """
    if mode == "observed_only" and measured is not None:
        raise ValueError("observed_only must not see globally measured keys")
    out, rules = df, []
    for name, keys in (("observed_in_labeled_train", observed), ("already_measured", measured), ("quarantined_held_out_identity", quarantined)):
        if keys is not None:
            flag = f"_in_{name}"
            out = out.join(keys.select(F.col(keys.columns[0]).alias("_k")).distinct().withColumn(flag, F.lit(True)), F.col(key) == F.col("_k"), "left").drop("_k")
            rules.append((name, F.col(flag)))
    return out.withColumn("scope_reason", first_reason(rules)).drop(*[f"_in_{n}" for n, _ in rules])


def dedup(df: DataFrame, key: str, feature: str, candidate: str, reason: str = "reason") -> DataFrame:
    """A2: among rows without a reason, the first of each feature is accepted; later ones are duplicates of it.

    The sequential rule is equal to: winner = smallest candidate of the feature
    among eligible rows.  Winners come from an aggregation and are joined back.
    Flags say that an accepted row of the same key or feature comes before, also
    for rows that were rejected earlier.
    """
    eligible = df.where(F.col(reason).isNull())
    win = eligible.groupBy(feature).agg(F.min(F.struct(candidate, key)).alias("w"))
    f = win.select(F.col(feature).alias("_f"), F.col("w")[candidate].alias("_fc"), F.col("w")[key].alias("_fk"))
    k = f.groupBy("_fk").agg(F.min("_fc").alias("_kc")).withColumnRenamed("_fk", "_k")
    out = df.join(f, F.col(feature).eqNullSafe(F.col("_f")), "left").join(k, F.col(key) == F.col("_k"), "left")
    dup = F.when(F.col(reason).isNull() & (F.col(candidate) != F.col("_fc")), F.when(F.col(key) == F.col("_fk"), "duplicate_synthetic").otherwise("feature_duplicate_synthetic"))
    return out.withColumns({
        reason: F.coalesce(reason, dup),
        "is_duplicate": F.coalesce(F.col("_kc") < F.col(candidate), F.lit(False)),
        "is_feature_duplicate": F.coalesce(F.col("_fc") < F.col(candidate), F.lit(False)),
    }).drop("_f", "_fc", "_fk", "_k", "_kc")


def role_changes(roles: list[str], requested: list[str], left: str = "s_", right: str = "") -> dict[str, Column]:
    """A5: changed, unchanged (requested ones that did not) and unexpected roles, bit mask, and whether all or any requested changed."""
    diff = {r: ~F.col(left + r).eqNullSafe(F.col(right + r)) for r in roles}
    names = lambda tests: F.concat_ws(",", *[F.when(t, F.lit(r)) for r, t in tests.items()])
    asked = [diff[r] for r in requested]
    return {
        "changed_roles": names(diff),
        "unchanged_requested": names({r: ~diff[r] for r in requested}),
        "unexpected_roles": names({r: diff[r] for r in roles if r not in requested}),
        "role_mask": F.concat(*[F.when(diff[r], "1").otherwise("0") for r in roles]),
        "all_changed": reduce(lambda a, b: a & b, asked),
        "any_changed": reduce(lambda a, b: a | b, asked),
    }


def invariant_violations(df: DataFrame, invariants: dict[str, Column], candidate: str, reason: str = "reason") -> DataFrame:
    """Accepted rows that break an invariant."""
    checks = F.concat_ws(",", *[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in invariants.items()])
    return df.where(F.col(reason).isNull()).select(candidate, checks.alias("broken")).where("broken <> ''")


def accounting(df: DataFrame, by: list[str], key: str, reasons: list[str], reason: str = "reason", selected: Column | None = None) -> DataFrame:
    """Generated, accepted, unique, selected, a column for each reason, and all others."""
    r = F.col(reason)
    named = [F.count_if(r == x).alias(f"n_{x}") for x in reasons]
    return df.groupBy(*by).agg(
        F.count("*").alias("generated"), F.count_if(r.isNull()).alias("accepted"), F.count_distinct(F.when(r.isNull(), F.col(key))).alias("unique_accepted"),
        F.count_if(r.isNull() & (F.lit(True) if selected is None else selected)).alias("selected"), *named, F.count_if(r.isNotNull() & ~r.isin(*reasons)).alias("n_other"),
    )


def scope_comparison(df: DataFrame, by: list[str], scope_col: str, value: str, a: str, b: str) -> DataFrame:
    """Values of two scopes side by side and their ratio (null over zero)."""
    out = df.groupBy(*by).pivot(scope_col, [a, b]).agg(F.first(value))
    return out.withColumn("ratio", F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))


def outside_train(df: DataFrame, parent: str, train: DataFrame, id_col: str) -> DataFrame:
    """Rows whose parent is no training row."""
    return df.join(train.select(F.col(id_col).alias("_t")).distinct(), F.col(parent) == F.col("_t"), "left_anti")


def augmentation_audit(real: DataFrame, synthetic: DataFrame, held_out: DataFrame, key: str, y: str) -> DataFrame:
    """Row counts, leaked keys and label ranges in one row."""
    leak = synthetic.join(held_out.select(key).distinct(), key, "left_semi").count()
    r = real.agg(F.count("*").alias("n_real"), F.min(y).alias("real_min"), F.max(y).alias("real_max"))
    s = synthetic.agg(F.count("*").alias("n_synthetic"), F.min(y).alias("synthetic_min"), F.max(y).alias("synthetic_max"))
    return r.crossJoin(s).withColumn("n_leaked", F.lit(leak))  # one row each
