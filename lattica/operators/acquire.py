"""Acquisition strategies and the campaign loop."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lattica.functions.identity import hash_order, std_samp, uniform
from lattica.operators.ranking import greedy_rankings
from lattica.store import kept


def erf(x: Column) -> Column:
    """Rational approximation of the error function (absolute error under 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / math.sqrt(2.0))) / 2


def ucb(mean: Column, half_width: Column, beta: float) -> Column:
    """Z3."""
    return mean + beta * half_width


def expected_improvement(mean: Column, half_width: Column, best: Column, xi: float = 0.0, coverage_z: float = 1.6448536269514722) -> Column:
    """Z4."""
    sigma = F.greatest(half_width / coverage_z, F.lit(1e-9))
    gap = mean - best - xi
    z = gap / sigma
    return gap * normal_cdf(z) + sigma * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def thompson(mean: Column, half_width: Column, seed, key: Column) -> Column:
    """A normal draw that depends on seed and key alone (Box-Muller on two stable uniforms)."""
    u, v = F.greatest(uniform(f"{seed}:u", key), F.lit(1e-12)), uniform(f"{seed}:v", key)
    return mean + half_width * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def top(df: DataFrame, score: Column, tie: str, k: int) -> DataFrame:
    """The k best by score, ties by key: a top-k, no full sort."""
    return df.withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), tie).limit(k)


def random_batch(df: DataFrame, key: str, seed, k: int) -> DataFrame:
    """Z1."""
    return df.orderBy(hash_order(seed, key), key).limit(k)


def greedy_diverse(df: DataFrame, campaign: str, key: str, mean: str, vec: str, k: int, weight: float) -> DataFrame:
    """One pick after the other by mean - weight * highest cosine to the picks so far, in every campaign."""
    got = greedy_rankings(df, campaign, key, vec, {"diverse": (F.col(mean), weight)}, k)
    return got.select(F.col(campaign).alias("campaign"), F.col(key).cast("long").alias("key"), "place", "score")


def campaign(df: DataFrame, campaign_col: str, key: str, y: str, seed: int, n_seed: int, rounds: int, batch: int, strategy: str = "greedy", feature: str | None = None, **settings) -> DataFrame:
    """Rounds of acquisition with an outcome gate: a model only sees outcomes acquired before.

    The model is the mean outcome of acquired rows of the same ``feature``
    (overall mean where there is none), its half width the sample deviation over
    the root of their number (of all acquired rows where there are fewer than two).
    ``random`` takes rows in hash order; ``greedy``, ``ucb`` (beta), ``expected_improvement``
    (xi) and ``thompson`` score them, ties in hash order; another name is an error.

    A round is one pass over the rows that are left, all campaigns at once: each task keeps its best ``batch`` rows of a campaign,
    and only those are compared, so a pool of any size is never in one task.  Rows with a null campaign, key or outcome are left
    out.  Output (campaign, round, key, outcome).
    """
    if strategy not in POLICIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(sorted(POLICIES))}")
    score = POLICIES[strategy]
    f = F.col(feature).cast("string") if feature else F.lit("")
    rows = df.select(F.col(campaign_col).alias("campaign"), F.col(key).cast("long").alias("key"), F.col(y).alias("y"), f.alias("f"), hash_order(seed, campaign_col, key).alias("h"), uniform(f"{seed}:draw", F.col(key)).alias("u"))
    rest = kept(rows.where("campaign is not null and key is not null and y is not null"), "campaign-pool")
    schema = S.StructType([*rest.schema.fields, S.StructField("guess", S.DoubleType())])

    def best(k, scored):
        def run(frames):
            held = None
            for pdf in frames:
                guess = score(pdf["mean"].to_numpy(float), pdf["half"].to_numpy(float), best=pdf["best"].to_numpy(float), draw=pdf["u"].to_numpy(float), **settings) if scored and len(pdf) else None
                pdf["guess"] = 0.0 if guess is None else np.round(np.asarray(guess, float), 9)
                pdf = pdf[schema.names]
                held = pdf if held is None else pd.concat([held, pdf])
                held = held.sort_values(["guess", "h", "key"], ascending=[False, True, True]).groupby("campaign", sort=False).head(k)
            if held is not None:
                yield held

        return run

    def first(df_, k, scored, number):
        top = df_.mapInPandas(best(k, scored), schema)
        w = Window.partitionBy("campaign").orderBy(F.col("guess").desc(), "h", "key")  # k rows a task at most
        top = top.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        return kept(top.select("campaign", F.lit(number).cast("int").alias("round") if isinstance(number, int) else number.alias("round"), "key", "y", "f"), "campaign-picks")

    if strategy == "random":  # the order never changes: one pass for all rounds
        number = F.when(F.col("_r") <= n_seed, 0).otherwise(F.expr(f"1 + (_r - {n_seed} - 1) div {batch}")).cast("int")
        return first(rest, n_seed + rounds * batch, False, number).select("campaign", "round", "key", F.col("y").cast("double").alias("outcome"))
    # joins to what was acquired, and to sums of it, are broadcasts while Spark's own bound on their size allows it
    largest = rest.groupBy("campaign").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    rounds = min(rounds, max(0, -(-(largest - n_seed) // batch)))
    done = first(rest, n_seed, False, 0)
    paths = [done.stored_path]
    for r in range(1, rounds + 1):
        own = done.groupBy("campaign", "f").agg(F.avg("y").alias("m"), std_samp(done, "y").alias("s"), F.count("y").alias("c"))
        all_ = done.groupBy("campaign").agg(F.avg("y").alias("am"), F.coalesce(std_samp(done, "y", 0.0), F.lit(0.0)).alias("as_"), F.max("y").cast("double").alias("best"))
        x = rest.join(done.select("campaign", "key"), ["campaign", "key"], "left_anti").join(own, ["campaign", "f"], "left").join(all_, "campaign")
        half = F.coalesce("s", "as_") / F.sqrt(F.coalesce("c", F.lit(1)).cast("double"))
        new = first(x.select(*rest.columns, F.coalesce("m", "am").alias("mean"), half.alias("half"), "best"), batch, True, r)
        paths.append(new.stored_path)
        done = df.sparkSession.read.schema(done.schema).parquet(*paths)
    return done.select("campaign", "round", "key", F.col("y").cast("double").alias("outcome"))


def _improvement(mean, half, best=0.0, xi=0.0, coverage_z=1.6448536269514722, **_):
    sigma = np.maximum(half / coverage_z, 1e-9)
    gap = mean - best - xi
    z = gap / sigma
    return gap * np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z]) + sigma * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _draw(mean, half, draw=None, **_):
    normal = NormalDist()
    return mean + half * np.array([normal.inv_cdf(min(max(u, 1e-12), 1 - 1e-12)) for u in draw])


#: The strategies of campaigns; a rule gets arrays (mean, half width), arrays best and draw, and the caller's settings.
POLICIES: dict[str, Callable] = {
    "random": lambda mean, half, **_: None,
    "greedy": lambda mean, half, **_: mean,
    "ucb": lambda mean, half, beta=1.0, **_: mean + beta * half,
    "expected_improvement": _improvement,
    "thompson": _draw,
}


def register_strategy(name: str, rule: Callable) -> None:
    """Adds a strategy for campaigns."""
    if name in POLICIES:
        raise ValueError(f"{name} is taken")
    POLICIES[name] = rule
