"""Deterministic splits and samples, by hash order instead of random numbers.

Exact sizes need the rank of each row in a hash order.  ``ranked`` finds it
without sorting the table in one task: rows are bucketed by the first hex digits
of the hash, ranked inside their bucket, and bucket sizes carried forward.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.identity import hash_order, uniform
from lattica.operators.order import positions


def ranked(df: DataFrame, seed, *keys: str, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank in the seeded hash order (ties by keys), and n, the number of rows, inside each group of ``within``."""
    within = within or []
    rows = df.withColumn("_h", hash_order(seed, *keys)).withColumn("_b", F.substring("_h", 1, 3))
    local = Window.partitionBy(*within, "_b").orderBy("_h", *keys)
    rows = rows.withColumn("_local", F.row_number().over(local))
    sizes = rows.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*within)
    sizes = sizes.withColumns({"_skip": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole)})
    on = F.col("_b") == F.col("_ob")
    for c in within:
        on = on & rows[c].eqNullSafe(F.col(f"_o{c}"))
    other = sizes.select(F.col("_b").alias("_ob"), *[F.col(c).alias(f"_o{c}") for c in within], "_skip", "n")
    out = rows.join(other, on)  # at most 4096 rows a group on this side
    return out.withColumn(name, F.col("_skip") + F.col("_local") - 1).drop("_h", "_b", "_local", "_skip", "_ob", *[f"_o{c}" for c in within])


def random_split(df: DataFrame, key: str, seed, train: float, valid: float) -> DataFrame:
    """K1: floor(n * train) rows train, floor(n * valid) valid, the rest test."""
    a, b = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(valid))
    return ranked(df, seed, key).withColumn("split", F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "valid").otherwise("test")).drop("rank", "n")


def low_data(df: DataFrame, key: str, seed: int, fraction: float) -> DataFrame:
    """K2, K3 on the rows of a training pool: marks max(1, floor(n * fraction)) of them, in the order of seed + 1."""
    take = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)))
    return ranked(df, seed + 1, key).withColumn("included", F.col("rank") < take).drop("rank", "n")


def sample_rows(df: DataFrame, key: str, seed, ratio: float) -> DataFrame:
    """max(1, floor(n * ratio)) rows; none for ratio 0."""
    if ratio == 0:
        return df.limit(0)
    return ranked(df, seed, key).where(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)))).drop("rank", "n")


def heldout_groups(df: DataFrame, group: str, key: str, seed, fraction: float, valid: float) -> DataFrame:
    """K4: max(1, ceil(groups * fraction)) groups test (null never), floor(rest * valid) rows valid."""
    groups = ranked(df.where(F.col(group).isNotNull()).select(group).distinct(), seed, group, name="_g")
    test = groups.where(F.col("_g") < F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction)))).select(group, F.lit(True).alias("_test"))
    marked = df.join(test, group, "left")
    rest = ranked(marked.where("_test is null"), seed, key).withColumn("split", F.when(F.col("rank") < F.floor(F.col("n") * F.lit(valid)), "valid").otherwise("train"))
    return rest.drop("rank", "n", "_test").unionByName(marked.where("_test").drop("_test").withColumn("split", F.lit("test")))


def logo_folds(df: DataFrame, group: str) -> DataFrame:
    """K5, K8: sizes of the leave-one-group-out folds, groups in text order; needs no copy of the rows."""
    sizes = df.groupBy(F.col(group).cast("string").alias("held_out")).agg(F.count("*").alias("n_test"))
    w = Window.orderBy("held_out")  # one row a group
    return sizes.select((F.row_number().over(w) - 1).alias("fold"), "held_out", "n_test", (F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")).alias("n_train"))


def logo_rows(df: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """K8: rows by folds (long form); ``groups`` is the small table of held-out groups of ``logo_folds``."""
    folds = F.lit([r["held_out"] for r in groups.orderBy("fold").select("held_out").collect()])  # one value a group
    rows = df.select("*", F.posexplode(folds).alias("fold", "held_out"))
    return rows.withColumn("role", F.when(F.col(group).cast("string") == F.col("held_out"), "test").otherwise("train"))


def nested_ood(df: DataFrame, group: str) -> DataFrame:
    """(outer, inner) pairs of held-out groups and the rows left to train on."""
    s = df.groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("c"))
    total = s.agg(F.sum("c")).first()[0] or 0
    a, b = s.select(F.col("g").alias("outer_group"), F.col("c").alias("n_outer")), s.select(F.col("g").alias("inner_group"), F.col("c").alias("n_inner"))
    return a.join(b, F.col("outer_group") != F.col("inner_group")).withColumn("n_train", F.lit(total) - F.col("n_outer") - F.col("n_inner"))


def grouped_outer(groups: DataFrame, group: str, seed, ratios: dict[str, float]) -> DataFrame:
    """K6 where every group counts once: whole groups, prefix counts nearest to the target, one for each split at least."""
    names = list(ratios)
    r = ranked(groups.select(group).distinct(), seed, group)
    label, used = F.lit(names[-1]), F.lit(0)
    cuts, share = [], 0.0
    for i, nm in enumerate(names[:-1]):
        share += ratios[nm]
        target = F.ceil(F.col("n") * F.lit(share) - F.lit(0.5))
        used = F.greatest(used + 1, F.least(F.col("n") - (len(names) - 1 - i), target))
        cuts.append((nm, used))
    for nm, cut in reversed(cuts):
        label = F.when(F.col("rank") < cut, nm).otherwise(label)
    return r.withColumn("split", label).select(group, "split", F.col("rank").alias("group_order"))


def grouped_outer_sized(sizes: DataFrame, group: str, size: str, seed, ratios: dict[str, float]) -> DataFrame:
    """K6 in general: groups by falling size go to the split with the largest relative deficit.

    The rule is serial by definition; it runs over the group table (one row a
    group) as one task.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf[size].sum()
        have = dict.fromkeys(ratios, 0.0)
        out = []
        for g, n in pdf.sort_values([size, "_h", group], ascending=[False, True, True])[[group, size]].itertuples(index=False):
            best = max(ratios, key=lambda s: ((ratios[s] * total - have[s]) / (ratios[s] * total or 1.0), -list(ratios).index(s)))
            have[best] += n
            out.append((g, best))
        return pd.DataFrame(out, columns=["g", "split"])

    rows = sizes.withColumn("_h", hash_order(seed, group)).select(F.col(group).cast("string").alias(group), size, "_h")
    return rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(assign, "g string, split string").withColumnRenamed("g", group)


def nested_prefixes(sizes: DataFrame, group: str, size: str, order: str, fractions: list[float]) -> DataFrame:
    """K7: a group is in the prefix of a fraction if the rows before it are fewer than max(1, ceil(n * f)); fractions are nested."""
    rows = positions(sizes.select(group, size, order), [order, group], name="_place", total="_groups", before={"before": size})
    rows = rows.withColumn("n", F.lit(sizes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]))
    rows = rows.withColumn("fraction", F.explode(F.lit([float(f) for f in fractions])))
    target = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("fraction")))
    return rows.where((F.col("fraction") == 1.0) | (F.col("before") < target)).select(group, "fraction", size)


def condition_support(df: DataFrame, keys: list[str], distinct: str, min_test: int, min_train: int, min_distinct: int) -> DataFrame:
    """For each held-out condition its support, and the reasons for leaving it out."""
    total = df.count()
    s = df.groupBy(*keys).agg(F.count("*").alias("n_test"), F.count_distinct(distinct).alias("n_distinct")).withColumn("n_train", F.lit(total) - F.col("n_test"))
    why = [
        F.when(F.col(c) < m, F.concat(F.lit(f"{c}_below_minimum(observed="), F.col(c).cast("string"), F.lit(f",required={m})")))
        for c, m in (("n_test", min_test), ("n_train", min_train), ("n_distinct", min_distinct))
    ]
    return s.withColumn("reasons", F.concat_ws("; ", *why)).withColumn("supported", F.col("reasons") == "")


def scaffold_assignment(df: DataFrame, rules: list[tuple[str, Column]], group: str) -> DataFrame:
    """The first exclusion rule that holds, else null; the group key comes from the caller's own function."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(rules):
        reason = F.when(F.coalesce(test, F.lit(False)), name).otherwise(reason)
    return df.withColumn("exclusion", reason).withColumn("scaffold", F.when(F.col("exclusion").isNull(), F.col(group)))


def bounded_test_components(components: DataFrame, seed, target: int, min_train: int) -> DataFrame:
    """Components (comp, n) in hash order go to test until the target is met; one that would starve train is passed over.

    Serial by definition, over the component table.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        total, test, out = int(pdf["n"].sum()), 0, []
        for c, n in pdf.sort_values(["_h", "comp"])[["comp", "n"]].itertuples(index=False):
            take = test < target and total - test - n >= min_train
            test += n if take else 0
            out.append((c, int(n), "test" if take else "train"))
        return pd.DataFrame(out, columns=["comp", "n", "split"])

    rows = components.select(F.col("comp").cast("long").alias("comp"), F.col("n").cast("long").alias("n")).withColumn("_h", hash_order(seed, "comp"))
    return rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(fill, "comp long, n long, split string")


def evaluation_roles(df: DataFrame, split: str, included: Column, outcome: str) -> DataFrame:
    """Labelled, hidden, valid, test; hidden and test rows lose their outcome."""
    role = F.when((F.col(split) == "train") & included, "labeled").when(F.col(split) == "train", "hidden").otherwise(F.col(split))
    out = df.withColumn("role", role)
    return out.withColumn(outcome, F.when(F.col("role").isin("labeled", "valid"), F.col(outcome)))


def panels(df: DataFrame, group: str, key: str, seed, min_rows: int, n: int) -> DataFrame:
    """Of groups with enough rows, the first ``n`` rows in hash order."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, group, key), key)
    big = df.groupBy(group).count().where(F.col("count") >= min_rows).select(group)
    return df.join(big, group, "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def calibration_part(df: DataFrame, key: str, seed, fraction: float) -> DataFrame:
    """Stable fit/calibration flag."""
    return df.withColumn("part", F.when(uniform(seed, F.col(key)) < fraction, "fit").otherwise("calibration"))


def campaign_pool(df: DataFrame, cell: list[str], row_id: str, seed, n_seed: int) -> DataFrame:
    """The first row of each cell; the first ``n_seed`` in hash order are the seed set."""
    w = Window.partitionBy(*cell).orderBy(row_id)
    pool = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return ranked(pool, seed, row_id).withColumn("is_seed", F.col("rank") < n_seed).drop("rank", "n")


def target_size(n: int, fraction: float) -> int:
    return max(1, math.ceil(n * fraction))


def inner_split(df: DataFrame, group: str, seed, fraction: float) -> DataFrame:
    """Whole groups to valid in hash order, max(1, ceil(groups * fraction)) of them and never all; the order of rows plays no part."""
    r = ranked(df.select(group).distinct(), seed, group)
    take = F.least(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction))), F.col("n") - 1)
    return df.join(r.select(group, F.when(F.col("rank") < take, "valid").otherwise("train").alias("inner")), group)
