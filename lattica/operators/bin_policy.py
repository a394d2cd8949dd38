"""C14: a cross-entropy search for the bins to draw candidates from.

A policy is a probability for each bin.  A round draws batches of candidates from it,
scores each batch, and moves the policy towards the bins of the elite batches.  Draws
are hashes of (seed, round, batch, place), so a search can be repeated anywhere; the
pool is ranked once inside its bins, and a round joins its few draws to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.identity import uniform
from lattica.operators.order import positions
from lattica.store import kept, sized


@dataclass(frozen=True)
class PolicySettings:
    bins: int
    rounds: int
    batches: int
    size: int
    elite: float = 0.2
    smoothing: float = 0.5
    seed: int = 0


def _draws(spark, policy: list[float], s: PolicySettings, r: int) -> DataFrame:
    """(batch, bin, u) of a round: the bin by the cumulated policy, u to choose a row in it."""
    total, cuts = 0.0, []
    for p in policy[:-1]:
        total += p
        cuts.append(total)
    d = spark.range(s.batches * s.size).select(F.expr(f"id div {s.size}").alias("batch"), (F.col("id") % s.size).alias("place"))
    name = F.concat_ws(":", F.lit(str(r)), F.col("batch").cast("string"), F.col("place").cast("string"))
    u = uniform(f"{s.seed}:bin", name)
    return d.select("batch", sum(((u >= c).cast("int") for c in cuts), F.lit(0)).alias("bin"), uniform(f"{s.seed}:row", name).alias("u"))


def bin_policy(pool: DataFrame, key: str, bin_: str, reward: str, settings: PolicySettings) -> DataFrame:
    """(round, bin, probability, elite_reward): the policy before each round and after the last; round 0 is uniform.

    A batch's reward is the mean of ``reward`` over its draws (draws from empty bins, and null rewards, count for nothing); the
    best ``ceil(batches * elite)`` batches (ties: the smaller number) are elite.  The next policy is the old one times
    ``smoothing`` plus, for the rest, the share of each bin in the elite draws with one added to every bin.  ``elite_reward`` is the
    mean over the elite batches that led to a policy.
    """
    s, spark = settings, pool.sparkSession
    rows = pool.where(F.col(bin_).between(0, s.bins - 1)).select(F.col(key).alias("key"), F.col(bin_).cast("int").alias("bin"), F.col(reward).cast("double").alias("reward"))
    ranked = kept(positions(rows, ["key"], ["bin"], "place", "n"), "policy-pool")
    sizes = kept(ranked.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "policy-sizes")
    policy, out = [1.0 / s.bins] * s.bins, []
    out += [(0, b, p, None) for b, p in enumerate(policy)]
    take = max(1, -int(-s.batches * s.elite // 1))
    for r in range(s.rounds):
        draws = _draws(spark, policy, s, r).join(F.broadcast(sizes), "bin", "left").withColumn("at", F.floor(F.col("u") * F.col("n")))
        draws = kept(draws, "policy-draws")  # batches * size rows
        got = ranked.drop("n").join(sized(draws.select("batch", "bin", F.col("at").alias("place"))), ["bin", "place"])
        score = got.groupBy("batch").agg(F.avg("reward").alias("score"))
        best = score.where("score is not null").orderBy(F.col("score").desc(), "batch").limit(take)
        best = kept(best, "policy-elite")
        mean = best.agg(F.sum("score") / F.count(F.lit(1))).first()[0]
        hits = {x["bin"]: x["c"] for x in draws.join(F.broadcast(best.select("batch")), "batch", "left_semi").groupBy("bin").agg(F.count(F.lit(1)).alias("c")).collect()}
        total = s.bins + sum(hits.values())
        policy = [s.smoothing * p + (1 - s.smoothing) * (1 + hits.get(b, 0)) / total for b, p in enumerate(policy)]
        out += [(r + 1, b, p, mean) for b, p in enumerate(policy)]
    return spark.createDataFrame(out, "round int, bin int, probability double, elite_reward double")


def policy_candidates(pool: DataFrame, key: str, bin_: str, policy: list[float], budget: int, seed=0) -> DataFrame:
    """``budget`` draws (draw, key) from a policy, with replacement; draws from empty bins are missing."""
    s = PolicySettings(len(policy), 1, 1, budget, seed=seed)
    rows = pool.where(F.col(bin_).between(0, s.bins - 1)).select(F.col(key).alias("key"), F.col(bin_).cast("int").alias("bin"))
    ranked = positions(rows, ["key"], ["bin"], "place", "n")
    d = _draws(pool.sparkSession, policy, s, 0).withColumn("draw", F.row_number().over(Window.partitionBy("batch").orderBy("u", "bin")))  # a batch of ``budget`` rows
    sizes = ranked.groupBy("bin").agg(F.first("n").alias("n"))
    d = d.join(F.broadcast(sizes), "bin").withColumn("place", F.floor(F.col("u") * F.col("n")))
    return ranked.drop("n").join(sized(kept(d.select("draw", "bin", "place"), "policy-draws")), ["bin", "place"]).select("draw", F.col("key").alias(key))
