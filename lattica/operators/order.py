"""Places in any sort order, and order statistics, without sorting a table or a group in one task.

Rows are dealt to tasks by ranges of the whole sort key (group, order and a hash of
the row, so that equal keys can be split too), sorted there, and numbered; what a
task numbered is written, and the number of rows of each group in each task is
carried forward over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.store import kept, sized

_ROW = 2**33 - 1


def positions(df: DataFrame, order: list, within: list[str] | None = None, name: str = "position", total: str = "n", before: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row among those of its group, and the number of rows of the group.

    ``order`` holds columns or sort expressions.  Rows that are equal in it are ordered by a hash of the whole row; equal rows take
    places next to each other.  ``before`` maps the name of a new column to a numeric one that is summed over all earlier rows of
    the group.  Nulls in ``within`` are a group.
    """
    within, before = within or [], before or {}
    keys = [F.col(c).asc_nulls_first() for c in within] + [F.col(c) if isinstance(c, str) else c for c in order]
    keys.append(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = kept(rows.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit(_ROW))}).drop("_id"), "positions")
    local = Window.partitionBy("_part", *within).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({new: F.coalesce(F.sum(c).over(local), F.lit(0)) for new, c in before.items()})
    tally = rows.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(before.values())])
    sums = {"_skip": "_c", **{f"_b{i}": f"_s{i}" for i in range(len(before))}}
    if within:
        w = Window.partitionBy(*within)
        ahead = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each task
        tally = tally.withColumns({**{n: F.coalesce(F.sum(c).over(ahead), F.lit(0)) for n, c in sums.items()}, total: F.sum("_c").over(w)})
    else:  # one row for each task
        found = sorted(tally.collect(), key=lambda r: r["_part"])
        run, out = dict.fromkeys(sums, 0), []
        for r in found:
            out.append((r["_part"], r["_first"], *run.values()))
            run = {n: v + (r[c] or 0) for (n, v), c in zip(run.items(), sums.values(), strict=True)}
        kinds = {n: "long" if n == "_skip" else dict(tally.dtypes)[c] for n, c in sums.items()}
        out = [(*o[:2], *[v if v or k == "long" else None for v, k in zip(o[2:], kinds.values(), strict=True)]) for o in out]
        tally = df.sparkSession.createDataFrame(out, "_part long, _first long, " + ", ".join(f"{n} {k}" for n, k in kinds.items())).withColumn(total, F.lit(run["_skip"]).cast("long"))
    on = F.col("_part") == F.col("_p")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    side = tally.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w_{c}") for c in within], "_first", total, *sums)
    out = rows.join(sized(kept(side, "tallies")) if within else F.broadcast(side), on)
    new = {name: F.col("_row") - F.col("_first") + F.col("_skip")} | {b: F.col(b) + F.coalesce(F.col(f"_b{i}"), F.lit(0)) for i, b in enumerate(before)}
    return out.withColumns(new).select(*[f"`{c}`" for c in df.columns], name, total, *before)


def order_statistic(df: DataFrame, value: str, rank: Column, within: list[str] | None = None, total: str = "n") -> DataFrame:
    """(group, n, value) at the 0-based ``rank`` of each group, an expression that may use ``total``."""
    within = within or []
    return positions(df.select(*within, value), [value], within, "_place", total).where(F.col("_place") == rank).select(*within, total, value)


def quantile_edges(df: DataFrame, value: str, at: list[float]) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours; None without values."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    placed = positions(rows, ["v"])
    n = F.col("n").cast("double") - 1
    wanted = F.array_distinct(F.array(*[f(n * q).cast("long") for q in at for f in (F.floor, F.ceil)]))
    found = {r["position"]: r for r in placed.where(F.array_contains(wanted, F.col("position"))).collect()}  # two rows a quantile at most
    out = []
    for q in at:
        if not found:
            out.append(None)
            continue
        p = q * (next(iter(found.values()))["n"] - 1)
        a, b = math.floor(p), math.ceil(p)
        x, y = found[a]["v"], found[b]["v"]
        out.append(x if a == b or x == y else (b - p) * x + (p - a) * y)
    return out
