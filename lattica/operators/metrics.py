"""Regression, ranking, interval and campaign metrics; all grouped, none collects rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.identity import std_samp
from lattica.operators.order import positions, quantile_edges

_BIG = "decimal(38,0)"


def _sum(c: Column, exact: bool) -> Column:
    return F.sum(c.cast(_BIG)).cast("double") if exact else F.sum(c)


def _dec(c: Column, exact: bool) -> Column:
    return c.cast("decimal(19,0)") if exact else c.cast("double")


def _integral(df: DataFrame, *cols: str) -> bool:
    return all(dict(df.dtypes)[c] in ("int", "bigint", "smallint") for c in cols)


def regression(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Rmse, mae, r2 and pearson; integral columns are summed exactly; null where undefined."""
    e = _integral(df, y, p)
    a, b = _dec(F.col(y), e), _dec(F.col(p), e)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum((a - b) * (a - b)).cast("double").alias("_sse"), F.sum(F.abs(a - b)).cast("double").alias("_sae"),
        F.sum(a).alias("_sa"), F.sum(b).alias("_sb"), F.sum(a * a).alias("_saa"), F.sum(b * b).alias("_sbb"), F.sum(a * b).alias("_sab"),
    )
    n = F.col("n").cast(_BIG) if e else F.col("n")
    num = lambda c: c.cast("double")
    wide = lambda c: F.col(c).cast("decimal(38,0)") if e else F.col(c)
    vaa, vbb, vab = num(n * wide("_saa") - wide("_sa") * wide("_sa")), num(n * wide("_sbb") - wide("_sb") * wide("_sb")), num(n * wide("_sab") - wide("_sa") * wide("_sb"))
    return g.select(
        *by, "n", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), (F.col("_sae") / F.col("n")).alias("mae"),
        (1 - F.try_divide(F.col("_sse") * F.col("n"), vaa)).alias("r2"), F.try_divide(vab, F.sqrt(vaa) * F.sqrt(vbb)).alias("pearson"),
    )


def average_rank(df: DataFrame, by: list[str], c: str, name: str) -> DataFrame:
    """Twice the average rank (an integer) of ``c`` within each group.

    Ranks come from counts of distinct values, not of rows: a value that many
    rows share is one row of the window.
    """
    v = df.groupBy(*by, c).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    v = v.select(*by, c, (2 * F.coalesce(F.sum("_n").over(w), F.lit(0)) + F.col("_n") + 1).alias(name))
    return df.join(v, [*by, c])


def spearman(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Pearson of average ranks."""
    r = average_rank(average_rank(df.select(*by, y, p), by, y, "_ry"), by, p, "_rp")
    return regression(r, by, "_ry", "_rp").select(*by, "n", F.col("pearson").alias("spearman"))


def ranked_by(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(p).desc(), tie)
    return df.withColumn("rn", F.row_number().over(w))


def topk(df: DataFrame, by: list[str], y: str, p: str, tie: str, k: int, threshold) -> DataFrame:
    """Hit rate and mean of the k best predicted (k capped), rank of the first hit, simple regret."""
    r = ranked_by(df, by, p, tie)
    top, hit = F.col("rn") <= k, F.col(y) >= threshold
    return r.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count_if(top & hit) / F.count_if(top)).alias("hit_rate"), (F.sum(F.when(top, F.col(y))).cast("double") / F.count_if(top)).alias("topk_mean"),
        F.min(F.when(hit, F.col("rn"))).alias("first_hit"), (F.max(y) - F.max(F.when(top, F.col(y)))).alias("regret"),
    )


def candidate_order(uncertainty: str, context: str, diversity: str, support: str, tie: list[str]) -> list[Column]:
    """Low uncertainty, then high context, diversity and support; nulls last; then the tie columns."""
    far = lambda c, s: F.coalesce(F.col(c), F.lit(s * float("inf")))
    return [far(uncertainty, 1).asc(), far(context, -1).desc(), far(diversity, -1).desc(), far(support, -1).desc(), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in tie]]


def best_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def mark_selected(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """G11."""
    return df.join(chosen.select(*keys).distinct().withColumn("selected", F.lit(True)), keys, "left").na.fill(False, ["selected"])


def summary(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Mean, median, sample deviation, count; null groups stay."""
    return df.groupBy(*by).agg((F.sum(v).cast("double") / F.count(v)).alias("mean"), F.percentile(v, 0.5).alias("median"), std_samp(df, v).alias("std"), F.count(v).alias("n"))


def paired_deltas(df: DataFrame, by: list[str], arm: str, control: str, v: str, higher_is_better: bool) -> DataFrame:
    """Each other arm against the control of its pair; pairs without a control stay, with null."""
    c = df.where(F.col(arm) == control).select(*by, F.col(v).alias("control_value"))
    out = df.where(F.col(arm) != control).join(c, by, "left").withColumn("delta", F.col(v) - F.col("control_value"))
    better = F.col("delta") > 0 if higher_is_better else F.col("delta") < 0
    return out.withColumn("improved", better)


def delta_summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    return deltas.groupBy(*by).agg(F.count("delta").alias("n_pairs"), (F.sum("delta").cast("double") / F.count("delta")).alias("mean_delta"), F.count_if("improved").alias("n_improved"))


def best_parent(a: DataFrame, b: DataFrame, by: list[str], v: str) -> DataFrame:
    """The smaller of two parents, ties to the first."""
    j = a.select(*by, F.col(v).alias("_a")).join(b.select(*by, F.col(v).alias("_b")), by)
    return j.select(*by, F.when(F.col("_a") <= F.col("_b"), "first").otherwise("second").alias("parent"), F.least("_a", "_b").alias(v))


def pivot(df: DataFrame, index: list[str], column: str, values: list, v: str) -> DataFrame:
    """A column for each of the stated values."""
    return df.groupBy(*index).pivot(column, values).agg(F.first(v))


def group_and_sample_weighted(df: DataFrame, by: list[str], weight: str, v: str) -> DataFrame:
    """G18."""
    return df.groupBy(*by).agg((F.sum(v).cast("double") / F.count(v)).alias("group_weighted"), (F.sum(F.col(v) * F.col(weight)).cast("double") / F.sum(weight)).alias("sample_weighted"), F.count("*").alias("n_groups"))


def intervals(df: DataFrame, by: list[str], y: str, low: str, high: str, nominal: float) -> DataFrame:
    """Coverage, mean and median width, calibration error."""
    width = F.col(high) - F.col(low)
    inside = F.count_if(F.col(y).between(F.col(low), F.col(high))) / F.count("*")
    return df.groupBy(*by).agg(F.count("*").alias("n"), inside.alias("coverage"), (F.sum(width).cast("double") / F.count("*")).alias("mean_width"), F.percentile(width, 0.5).alias("median_width"), F.abs(inside - nominal).alias("calibration_error"))


def selective_curve(df: DataFrame, by: list[str], score: str, y: str, p: str) -> DataFrame:
    """For each distinct cutoff, count, rmse, mae and mean over rows up to it; ties enter together.

    Rows are first summed for each distinct score, so the running window has one
    row a cutoff.
    """
    e = _integral(df, y, p)
    a, b = _dec(F.col(y), e), _dec(F.col(p), e)
    g = df.groupBy(*by, score).agg(F.count("*").alias("c"), F.sum((a - b) * (a - b)).alias("s2"), F.sum(F.abs(a - b)).alias("s1"), F.sum(a).alias("s0"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(w).cast("double")
    n = F.sum("c").over(w)
    return g.select(*by, F.col(score).alias("cutoff"), n.alias("n"), F.sqrt(run("s2") / n).alias("rmse"), (run("s1") / n).alias("mae"), (run("s0") / n).alias("mean"))


def tertiles(df: DataFrame, c: str) -> DataFrame:
    """Low, medium or high by the exact third and two-thirds quantiles."""
    a, b = (F.lit(e) for e in quantile_edges(df, c, [1 / 3, 2 / 3]))
    return df.withColumn("tertile", F.when(F.col(c).isNull(), None).when(F.col(c) <= a, "low").when(F.col(c) <= b, "medium").otherwise("high"))


def stratified_errors(df: DataFrame, dimensions: list[str], target: str, y: str, p: str) -> DataFrame:
    """(dimension, stratum) cohorts after one row for each target, with the number of duplicates."""
    items = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("stratum")) for d in dimensions])
    rows = df.select(target, y, p, F.explode(items).alias("x")).select("x.dimension", "x.stratum", target, y, p)
    one = rows.groupBy("dimension", "stratum", target).agg(F.min(F.struct(y, p)).alias("v"), F.count("*").alias("_c"))
    err = F.abs(F.col(f"v.{y}") - F.col(f"v.{p}"))
    return one.groupBy("dimension", "stratum").agg(F.count("*").alias("n_targets"), F.sum(F.col("_c") - 1).alias("n_duplicates"), (F.sum(err).cast("double") / F.count("*")).alias("mae"))


def oracle_diagnostic(pred: DataFrame, truth: DataFrame, key: str, p: str, y: str, threshold) -> DataFrame:
    """Replicates averaged, inner join; mae, rmse, bias, prevalence, precision, recall and enrichment of predicted hits."""
    t = truth.groupBy(key).agg((F.sum(y).cast("double") / F.count(y)).alias("y"))
    q = pred.groupBy(key).agg((F.sum(p).cast("double") / F.count(p)).alias("p"))
    j = t.join(q, key).select("y", "p")
    hit, said = F.col("y") >= threshold, F.col("p") >= threshold
    g = j.agg(F.count("*").alias("n"), F.sum(F.abs(F.col("p") - F.col("y"))).alias("_e"), F.sum(F.col("p") - F.col("y")).alias("_b"), F.sum((F.col("p") - F.col("y")) ** 2).alias("_q"), F.count_if(hit).alias("_h"), F.count_if(said).alias("_s"), F.count_if(hit & said).alias("_t"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    prevalence, precision = d(F.col("_h"), F.col("n")), d(F.col("_t"), F.col("_s"))
    return g.select("n", d(F.col("_e"), F.col("n")).alias("mae"), d(F.col("_b"), F.col("n")).alias("bias"), F.sqrt(d(F.col("_q"), F.col("n"))).alias("rmse"), prevalence.alias("prevalence"), precision.alias("precision"), d(F.col("_t"), F.col("_h")).alias("recall"), F.try_divide(precision, prevalence).alias("enrichment"))


def support_summary(df: DataFrame, by: list[str], metric: str, distance: str) -> DataFrame:
    """Distances under one metric; ``mixed`` if there are several."""
    m = F.when(F.count_distinct(metric) > 1, "mixed").otherwise(F.min(metric))
    return df.groupBy(*by).agg(m.alias("metric"), F.count("*").alias("n"), F.min(distance).alias("min_distance"), F.percentile(distance, 0.5).alias("median_distance"), F.max(distance).alias("max_distance"))


def trajectory(df: DataFrame, by: list[str], rnd: str, y: str, key: str, optimum: Column, threshold) -> DataFrame:
    """For each round cumulative best, regret, cumulative regret, hits and distinct keys.

    A key counts in the round of its first occurrence.  Rounds are aggregated
    first, so the windows have one row a round.
    """
    first = df.groupBy(*by, key).agg(F.min(rnd).alias(rnd)).groupBy(*by, rnd).agg(F.count("*").alias("_new"))
    g = df.groupBy(*by, rnd).agg(F.count("*").alias("n"), F.max(y).alias("_best"), F.sum(y).alias("_sum"), F.count_if(F.col(y) >= threshold).alias("_hits"))
    g = g.join(first, [*by, rnd], "left")
    w = Window.partitionBy(*by).orderBy(rnd).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("_best").over(w)
    g = g.withColumns({"cum_n": F.sum("n").over(w), "cum_best": best, "simple_regret": optimum - best, "cum_mean": F.sum("_sum").over(w).cast("double") / F.sum("n").over(w), "cum_hits": F.sum("_hits").over(w), "cum_keys": F.sum(F.coalesce("_new", F.lit(0))).over(w)})
    return g.withColumn("cum_regret", F.sum("simple_regret").over(w)).drop("_best", "_sum", "_hits", "_new")


def random_distribution(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Mean, sample deviation (0.0 for one), extremes and quantiles of finite values."""
    x = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) < float("inf")))
    q = [F.percentile(v, a).alias(n) for n, a in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))]
    return x.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(v).cast("double") / F.count("*")).alias("mean"), std_samp(df, v, 0.0).alias("std"), F.min(v).alias("min"), *q, F.max(v).alias("max"))


def midrank_percentile(df: DataFrame, random: DataFrame, by: list[str], v: str) -> DataFrame:
    """100 * (values below + half of those equal) / n against the random rows of the same unit; advantage over their mean, and z.

    Values of both tables are counted first, so the running window has one row a
    distinct value and no row meets all random rows of its unit.  Each row of
    ``df`` stays; one of a unit without random rows doesn't.
    """
    r = random.where(F.col(v).isNotNull()).groupBy(*by, F.col(v).alias("_v")).agg(F.count("*").alias("_n"))
    both = r.unionByName(df.select(*by, F.col(v).alias("_v"), F.lit(0).cast("long").alias("_n"))).groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = both.select(*by, F.col("_v").alias(v), (2 * F.coalesce(F.sum("_n").over(w), F.lit(0)) + F.col("_n")).alias("_x"))
    e = _integral(random, v)
    unit = random.where(F.col(v).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_random"), (_sum(F.col(v), e).cast("double") / F.count("*")).alias("_mean"), std_samp(random, v).alias("_std"))
    g = df.join(below, [*by, v]).join(unit, by)
    advantage = F.col(v) - F.col("_mean")
    return g.select(*df.columns, "n_random", (50 * F.col("_x") / F.col("n_random")).alias("percentile"), advantage.alias("advantage"), F.try_divide(advantage, F.col("_std")).alias("z"))


def bootstrap_ci(df: DataFrame, by: list[str], v: str, draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap of the mean of a group's values (one for each seed: a small group).

    Place j of draw k is the value at floor(u * n) in ascending order, with u from the hash of (seed, group, k, j).  Nulls are left out.
    """
    lo, hi = (1 - level) / 2, (1 + level) / 2
    x = df.where(F.col(v).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.col(v).cast("double"))).alias("_x"), F.count(v).alias("n"))
    x = x.withColumn("_name", F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]))
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def value(j):
        u = F.conv(F.substring(F.sha2(F.concat_ws(":", "_name", F.col("_k").cast("string"), j.cast("string")), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
        return F.get("_x", F.floor(u * F.col("n")).cast("int"))

    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    mean = add(F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), value)) / F.col("n")
    x = x.select(*by, "n", (add(F.col("_x")) / F.col("n")).alias("mean"), mean.alias("_m"))
    return x.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.percentile("_m", lo).alias("low"), F.percentile("_m", hi).alias("high"))


def verdict(low: Column, high: Column, n_improved: Column, n: Column, degenerate: Column | None = None) -> Column:
    """Overrides, then four exclusive cases."""
    out = F.when(low > 0, "improves").when(high < 0, "worsens").when(n_improved * 2 >= n, "leans_better").otherwise("leans_worse")
    return out if degenerate is None else F.when(degenerate, "degenerate_pool").otherwise(out)


EXACT_PAIRS = 50


def signed_rank(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """Wilcoxon W+ and its two-sided p-value; the t statistic and its pairs.

    Up to EXACT_PAIRS pairs that differ, all signs are counted (ties included); beyond, the p-value is that of the normal
    approximation with the variance corrected for ties, as the common library test switches, too.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[d].dropna().to_numpy(float)
        n_all = len(x)
        t = float(x.mean() / (x.std(ddof=1) / np.sqrt(n_all))) if n_all > 1 and x.std(ddof=1) > 0 else None
        x = x[np.abs(x) > 1e-12]
        w = p = None
        if len(x):
            r = pd.Series(np.abs(x)).rank().to_numpy() * 2
            w = float(r[x > 0].sum()) / 2
            if len(x) > EXACT_PAIRS:
                m, ties = len(x), np.unique(r, return_counts=True)[1]
                deviation = np.sqrt(m * (m + 1) * (2 * m + 1) / 24 - (ties**3 - ties).sum() / 48)
                p = math.erfc(abs(w - m * (m + 1) / 4) / deviation / math.sqrt(2))
            else:
                ways = np.zeros(int(r.sum()) + 1)
                ways[0] = 1
                for k in r.astype(int):
                    ways[k:] = ways[k:] + ways[: len(ways) - k].copy() if k else ways * 2
                c = int(round(2 * w))
                p = float(min(1.0, 2 * min(ways[: c + 1].sum(), ways[c:].sum()) / ways.sum()))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n_pairs": [n_all], "w_plus": [w], "p_value": [p], "t": [t]})

    schema = ", ".join([f"{c} {dict(df.dtypes)[c]}" for c in by] + ["n_pairs long, w_plus double, p_value double, t double"])
    return df.select(*by, d).groupBy(*by).applyInPandas(run, schema)


def sharing_counts(df: DataFrame, key: str, roles: list[str], row_id: str) -> DataFrame:
    """How many rows share the key, and each role."""
    out = df.select(row_id, key, *roles)
    for c in (key, *roles):
        n = df.groupBy(c).agg(F.count("*").alias(f"n_same_{c}"))
        out = out.join(n, c)
    return out.select(row_id, *[f"n_same_{c}" for c in (key, *roles)])


def strided(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``n`` rows evenly strided by rank, places rounded half to even."""
    r = positions(df, order, name="_r", total="_n")
    first = r.select("_n").first()
    total = first["_n"] if first else 0
    places = sorted({int(x) for x in np.round(np.linspace(0, total - 1, min(n, total)))}) if total else []
    return r.where(F.col("_r").isin(places) if places else F.lit(False)).drop("_r", "_n")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], v: str, tolerance: float = 1e-8) -> DataFrame:
    """Full outer join; status left_only, right_only, differs or equal."""
    x, y = a.select(*keys, F.col(v).alias("left_value"), F.lit(1).alias("_l")), b.select(*keys, F.col(v).alias("right_value"), F.lit(1).alias("_r"))
    j = x.join(y, keys, "full_outer")
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, "equal").otherwise("differs")
    return j.select(*keys, "left_value", "right_value", status.alias("status"))


def effects(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """Helped, hurt or neutral at 1e-9."""
    kind = F.when(F.col(delta) > 1e-9, "helped").when(F.col(delta) < -1e-9, "hurt").otherwise("neutral")
    return df.groupBy(*by, kind.alias("effect")).agg(F.count("*").alias("n"))


def three_way(df: DataFrame, by: list[str], arm: str, arms: tuple[str, str, str], v: str) -> DataFrame:
    """Values of three arms side by side and their deltas; only keys that have all three, one row each."""
    a, b, c = (df.where(F.col(arm) == x).select(*by, F.col(v).alias(f"v{i}")) for i, x in enumerate(arms))
    j = a.join(b, by).join(c, by)
    return j.select(*by, "v0", "v1", "v2", (F.col("v1") - F.col("v0")).alias("d10"), (F.col("v2") - F.col("v0")).alias("d20"), (F.col("v2") - F.col("v1")).alias("d21"))


def constrained_best(df: DataFrame, by: list[str], coverage: str, target: float, order: list[Column]) -> DataFrame:
    """Of rows that reach the target coverage the first by ``order``; of none do, the one of highest coverage, with feasible = false."""
    feasible = F.coalesce(F.col(coverage) >= target, F.lit(False))
    miss = F.when(feasible, F.lit(0.0)).otherwise(-F.coalesce(F.col(coverage), F.lit(-1.0)))
    return best_per_group(df.withColumn("feasible", feasible), by, [F.col("feasible").desc(), miss, *order])


def top_fraction_enrichment(df: DataFrame, by: list[str], p: str, y: str, tie: str, fraction: float, threshold) -> DataFrame:
    """Hits among the max(1, ceil(fraction * n)) best predicted over the share of hits, by group (null without hits)."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"), (F.count_if(F.col(y) >= threshold) / F.count("*")).alias("prevalence"))
    n = n.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction))))
    r = ranked_by(df, by, p, tie).join(n, by).where(F.col("rn") <= F.col("k"))
    out = r.groupBy(*by, "n", "k", "prevalence").agg((F.count_if(F.col(y) >= threshold) / F.count("*")).alias("precision"))
    return out.withColumn("enrichment", F.try_divide("precision", "prevalence"))


def final_summary(percentiles: DataFrame, by: list[str], unit: str, bar: float = 95.0) -> DataFrame:
    """Units, their mean percentile and how many are at the bar or above."""
    return percentiles.groupBy(*by).agg(F.count_distinct(unit).alias("n_units"), F.avg("percentile").alias("mean_percentile"), F.count_if(F.col("percentile") >= bar).alias("units_at_or_above_95th"))


def margin_wins(deltas: DataFrame, by: list[str], delta: str, margin: float) -> DataFrame:
    """Wins by at least the margin (lower is better), losses, and whether the arm is kept: more wins than half of the pairs and a mean below zero."""
    d = F.col(delta)
    out = deltas.groupBy(*by).agg(F.count(d).alias("n_pairs"), F.count_if(d <= -margin).alias("n_wins"), F.count_if(d >= margin).alias("n_losses"), (F.sum(d).cast("double") / F.count(d)).alias("mean_delta"))
    return out.withColumn("kept", (F.col("n_wins") * 2 > F.col("n_pairs")) & (F.col("mean_delta") < 0))


def top_excluding(df: DataFrame, chosen: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` that are not chosen yet."""
    return df.join(chosen.select(key), key, "left_anti").orderBy(*order).limit(n)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + k / c
            c = c if abs(c) > 1e-300 else 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_test(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """Paired t statistic and two-sided p-value of a group's deltas; null for fewer than two or without spread."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else _beta_share((k - 1) / 2, 0.5, (k - 1) / (k - 1 + x * x)) for x, k in zip(t, n, strict=True)], dtype="float64")

    out = df.groupBy(*by).agg(F.count(d).alias("n"), (F.sum(d).cast("double") / F.count(d)).alias("mean_delta"), std_samp(df, d).alias("_std"))
    out = out.withColumn("t", F.try_divide(F.col("mean_delta") * F.sqrt("n"), F.col("_std"))).drop("_std")
    return out.withColumn("p_value", p_value("t", "n"))
