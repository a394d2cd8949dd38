"""Reading the test tables, and the typed experiment table made from them.

An order stands for a measured record: nation and market segment are the
substrate, priority and status the condition, the price is the outcome.  ``y``
and ``p`` (a made prediction) are integers, so sums are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.schema import RoleSchema
from lattica.sources.io import scan_parquet

SCHEMA = RoleSchema(substrate=("n_name", "c_mktsegment"), condition=("o_orderpriority", "o_orderstatus"), outcome="y", row_id="o_orderkey")
CELL = list(SCHEMA.cell)

#: The same table as SQL.
T = """t AS (
  SELECT o_orderkey, n_name, c_mktsegment, o_orderpriority, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS y,
         CAST(floor(o_totalprice) AS BIGINT) * 9 // 10 + o_orderkey % 7 * 1000 AS p, year(o_orderdate) AS yr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def typed_orders(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    y = F.floor("o_totalprice").cast("long")
    return j.select("o_orderkey", *SCHEMA.cell, y.alias("y"), (F.expr("cast(floor(o_totalprice) as bigint) * 9 div 10") + F.col("o_orderkey") % 7 * 1000).alias("p"), F.year("o_orderdate").alias("yr"))
