"""Greedy clusters of a neighbour graph in parallel rounds, and one holdout for each cluster.

The sequential rule goes through nodes by falling number of neighbours (ties: the
smaller id); a node that no cluster has taken yet leads a cluster and takes its free
neighbours.  Its leaders are the lexicographically first independent set, so they can
be found in rounds: a node leads as soon as no neighbour of higher priority is open,
and a neighbour of a leader is taken.  Each round is a few joins over the edges that
are left, both ends of which are open; what is left is written, so that a lost
executor costs tasks and not rounds.  Every round settles at least the first open node,
in graphs without long chains of falling priority far more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.store import kept, sized


def greedy_clusters(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cluster): the leader of each node of ``ids`` (id); ``pairs`` (a, b) may hold a link once or in both directions.

    Self-links, repeated links, repeated ids, null ids and links to nodes that ``ids`` doesn't have make no difference.
    """
    nodes = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()  # pairs are costly: they are asked for once
    links = links.join(nodes.withColumnRenamed("id", "u"), "u", "left_semi").join(nodes.withColumnRenamed("id", "v"), "v", "left_semi")
    links = kept(links.select("u", "v"), "cluster-links")
    degree = kept(links.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("d")), "cluster-degrees")
    prio = lambda end: degree.select(F.col("u").alias(end), F.struct((-F.col("d")).alias("d"), F.col("u").alias("id")).alias(f"p{end}"))
    known = links.join(prio("u"), "u").join(prio("v"), "v")
    # (u, v): v comes before u; so does the leader of u that comes first, if u is no leader
    first, last = F.least("pu", "pv"), F.greatest("pu", "pv")
    known = kept(known.select(last["id"].alias("u"), first["id"].alias("v"), first.alias("pv")), "cluster-edges")
    edges = known.select("u", "v")
    open_ = kept(degree.select("u"), "cluster-open")  # nodes without links lead clusters of their own
    leaders = []
    while open_.limit(1).count():
        edges = kept(edges, "cluster-left")
        lead = kept(open_.join(edges.select("u").distinct(), "u", "left_anti"), "cluster-leaders")
        leaders.append(lead)
        taken = edges.join(sized(lead.withColumnRenamed("u", "v")), "v", "left_semi").select("u").distinct()
        gone = kept(taken.unionByName(lead), "cluster-gone")
        open_ = kept(open_.join(sized(gone), "u", "left_anti"), "cluster-open")
        edges = edges.join(sized(gone), "u", "left_anti").join(sized(gone.withColumnRenamed("u", "v")), "v", "left_anti")
    if not leaders:
        return nodes.select("id", F.col("id").alias("cluster"))
    led = leaders[0]
    for x in leaders[1:]:
        led = led.unionByName(x)
    led = kept(led, "cluster-all-leaders")
    members = known.join(sized(led.withColumnRenamed("u", "v")), "v", "left_semi").groupBy("u").agg(F.min("pv").alias("first"))
    own = led.select("u", F.col("u").alias("own"))
    out = nodes.withColumnRenamed("id", "u").join(own, "u", "left").join(members.select("u", F.col("first.id").alias("other")), "u", "left")
    return out.select(F.col("u").alias("id"), F.coalesce("own", "other", "u").alias("cluster"))


def cluster_folds(df: DataFrame, cluster: str, group: str, min_test: int = 1, min_train: int = 1, min_test_groups: int = 1, min_train_groups: int = 2) -> DataFrame:
    """One holdout a cluster: its rows are tested, all others are trained on; sizes, numbers of distinct groups, and why a fold is left out."""
    groups = kept(df.groupBy(group).agg(F.min(cluster).alias("_a"), F.max(cluster).alias("_b")), "fold-groups")
    total, all_ = df.count(), groups.count()
    s = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_test"), F.count_distinct(group).alias("test_groups"))
    alone = groups.where("_a = _b").groupBy(F.col("_a").alias(cluster)).agg(F.count(F.lit(1)).alias("_alone"))  # groups that no other cluster has
    s = s.join(alone, cluster, "left").withColumns({"n_train": F.lit(total) - F.col("n_test"), "train_groups": F.lit(all_) - F.coalesce("_alone", F.lit(0))}).drop("_alone")

    def below(c: str, least: int) -> Column:
        return F.when(F.col(c) < least, F.concat(F.lit(f"{c}_below_minimum(observed="), F.col(c).cast("string"), F.lit(f",required={least})")))

    why = F.concat_ws("; ", below("n_test", min_test), below("n_train", min_train), below("test_groups", min_test_groups), below("train_groups", min_train_groups))
    return s.withColumn("reasons", why).withColumn("supported", F.col("reasons") == "")
