"""Queries: transfer, saved splits, guards, and further forms of metrics, similarity and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import cleaning as cl
from lattica.functions import identity as idn
from lattica.functions import parsing as ps
from lattica.operators import acquire as aq
from lattica.operators import audit as au
from lattica.operators import candidates as cd
from lattica.operators import labels as lb
from lattica.operators import metrics as mt
from lattica.operators import similarity as sm
from lattica.operators import splits as sp
from lattica.operators import transfer as tr
from lattica.plans.base import SCHEMA, T, read, typed_orders
from lattica.plans.relations import campaign_sql
from lattica.sources import io, saved_splits

Q: dict = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


_VAR = lambda a, b: f"CAST(CAST(count(*) AS HUGEINT) * sum(CAST({a} AS HUGEINT) * {b}) - CAST(sum({a}) AS HUGEINT) * sum({b}) AS DOUBLE)"
_SAME = "CAST(a.n_name = b.n_name AS INT) + CAST(a.c_mktsegment = b.c_mktsegment AS INT) + CAST(a.o_orderpriority = b.o_orderpriority AS INT) + CAST(a.o_orderstatus = b.o_orderstatus AS INT)"
_QUERIES = "o_orderkey % 20 = 0"  # a stated query set, searched against all rows


# ---- cleaning and parsing


@query("clean_records", """
SELECT coalesce(nullif(trim(CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_brand END), ''), 'UNKNOWN') AS p_brand, p_partkey, TRY_CAST(v AS DOUBLE) AS value, p_name FROM (
  SELECT *, CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE CAST(p_size * 3 AS VARCHAR) END AS v FROM part) WHERE TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 100 AND p_name <> ''""")
def _(s, d):
    p = read(s, d, "part")
    v = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise((F.col("p_size") * 3).cast("string"))
    raw = p.select(F.col("p_partkey").alias(" P PartKey "), v.alias("Value"), F.col("p_name").alias("P-Name"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_brand")).alias("P Brand"), F.lit("UNKNOWN").alias("Note"))
    return cl.clean(raw, "value", "p_name", ["p_brand", "note"], ["p_brand", "p_partkey", "value"])


@query("stage_counts", """
SELECT 0 AS place, 'input' AS stage, count(*) AS n_rows FROM orders UNION ALL SELECT 1, 'priced', count(*) FILTER (o_totalprice > 100000) FROM orders
UNION ALL SELECT 2, 'open', count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'O') FROM orders""")
def _(s, d):
    return cl.stage_counts(read(s, d, "orders"), [("priced", F.col("o_totalprice") > 100000), ("open", F.col("o_orderstatus") == "O")])


@query("dict_literal_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def _(s, d):
    literal = F.replace(F.col("props"), F.lit('"'), F.lit("'"))
    return read(s, d, "events").select("event_id", cl.dict_field(literal, "k").alias("k"))


@query("apply_parse", """
WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_brand FROM part),
r AS (SELECT p_partkey, w, p_brand, len(list_filter(w, lambda v: v <> '')) AS n FROM x)
SELECT p_partkey, CASE WHEN n = 3 THEN 'ok' ELSE 'unexpected_left_token_count' END AS parse_status, CASE WHEN n = 3 THEN '' ELSE 'expected 3 left tokens, found ' || n END AS parse_message,
  CASE WHEN n = 3 THEN array_to_string(w[1:2], '.') ELSE '' END AS substrate, CASE WHEN n = 3 THEN w[3] ELSE '' END AS condition, CASE WHEN n = 3 THEN p_brand ELSE '' END AS product,
  CASE WHEN n = 3 THEN array_to_string(w, '.') || '>>' || p_brand ELSE '' END AS assembled FROM r""")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(">>"), "p_brand").alias("r"))
    return ps.apply_parse(p, "r", 3).drop("r")


@query("recovered_fields", """
SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 THEN p_brand END, CASE WHEN p_size % 5 > 0 THEN p_type END, 'UNKNOWN') AS field,
  coalesce(nullif(concat_ws('_and_', CASE WHEN p_size % 3 = 0 THEN 'brand' END, CASE WHEN p_size % 5 = 0 THEN 'type' END), ''), 'ok') AS mismatch FROM part""")
def _(s, d):
    brand, kind = F.col("p_size") % 3 == 0, F.col("p_size") % 5 == 0
    found = ps.recover(F.when(brand, "UNKNOWN").otherwise(F.col("p_brand")), F.lit(" "), F.when(kind, None).otherwise(F.col("p_type")))
    return read(s, d, "part").select("p_partkey", found.alias("field"), ps.mismatch({"brand": brand, "type": kind}).alias("mismatch"))


@query("stress_table", "SELECT p_partkey, p_brand AS product_key, array_to_string(list_sort(string_split(p_name, ' ')), '.') AS reactant_key FROM part")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("l"), F.array("p_brand").alias("r"))
    return ps.stress_table(p, "l", "r").select("p_partkey", "product_key", "reactant_key")


# ---- identity


@query("canonical_values", """
SELECT p_partkey, CASE WHEN ok THEN lower(trim(v)) END AS v_canonical, ok AS v_valid, CASE WHEN blank THEN 'missing_or_non_string' WHEN NOT ok THEN 'invalid' END AS v_error FROM (
  SELECT p_partkey, v, coalesce(trim(v) = '', true) AS blank, coalesce(trim(v) <> '', false) AND v NOT LIKE '%5%' AS ok FROM (
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_brand END AS v FROM part))""")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_brand")).alias("v"))
    return idn.canonicalise(p, ["v"], lambda c: F.lower(F.trim(c)), lambda c: ~c.contains("5")).drop("v")


@query("source_row_ids", "SELECT o_orderkey, sha256('f00d:' || o_orderkey) AS id FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", idn.source_row_id("f00d", F.col("o_orderkey")).alias("id"))


@query("derived_seeds", """
WITH x AS (SELECT o_orderkey, sha256('5:' || o_orderkey) AS h FROM orders)
SELECT o_orderkey, CAST(CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) AS VARCHAR) AS seed FROM x""")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", idn.derived_seed(5, F.col("o_orderkey")).cast("string").alias("seed"))


@query("assignment_hash", f"""
WITH {T}, h AS (SELECT n_name, CAST('0x' || substr(sha256(o_orderkey || ':' || o_orderstatus), 1, 15) AS BIGINT) AS h FROM t)
SELECT n_name, sha256(count(*) || ':' || bit_xor(h) || ':' || sum(h)) AS digest FROM h GROUP BY 1""")
def _(s, d):
    return idn.assignment_hash(typed_orders(s, d), ["o_orderkey", "o_orderstatus"], ["n_name"])


@query("measured_keys", f"WITH {T} SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE n_name || '|' || c_mktsegment END AS key FROM t")
def _(s, d):
    return idn.measured_keys(typed_orders(s, d), F.when(F.col("o_orderkey") % 2 == 0, F.col("n_name")), F.concat_ws("|", "n_name", "c_mktsegment"))


@query("guarded_identity", f"WITH {T} SELECT n_name, count(*) AS n FROM t GROUP BY 1")
def _(s, d):
    t = typed_orders(s, d).withColumn("stored", F.sha2("n_name", 256))
    return idn.guard_identity(t, F.col("stored"), F.sha2("n_name", 256)).groupBy("n_name").agg(F.count("*").alias("n"))


@query("guarded_results", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return io.guard_invalid(read(s, d, "orders"), "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# ---- splits


_SAVED = """s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN 'other' WHEN hash_group < 0.6 THEN 'train' WHEN hash_group < 0.8 THEN 'valid' ELSE 'test' END AS split, o_orderkey % 4 = 0 AS small, o_orderkey % 2 = 0 OR o_orderkey % 37 = 0 AS large
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 43 = 0 THEN 0.9 ELSE CAST(CAST('0x' || substr(sha256('1:' || o_custkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 END AS hash_group FROM orders WHERE o_orderkey % 47 > 0))"""


@query("saved_split_violations", f"""
WITH {_SAVED}, v AS (
  SELECT 'unknown_split' AS "check", o_orderkey AS key FROM s WHERE split NOT IN ('train', 'valid', 'test') UNION ALL SELECT 'missing', o_orderkey FROM orders WHERE o_orderkey % 47 = 0
  UNION ALL SELECT 'crossing', o_custkey FROM s JOIN orders USING (o_orderkey) GROUP BY o_custkey HAVING min(split) <> max(split) UNION ALL SELECT 'not_nested', o_orderkey FROM s WHERE small AND NOT large)
SELECT "check", CAST(key AS VARCHAR) AS key FROM v""")
def _(s, d):
    o = read(s, d, "orders")
    k = F.col("o_orderkey")
    u = F.when(k % 43 == 0, 0.9).otherwise(idn.uniform(1, F.col("o_custkey")))
    saved = o.where(k % 47 > 0).select("o_orderkey", F.when(k % 41 == 0, "other").when(u < 0.6, "train").when(u < 0.8, "valid").otherwise("test").alias("split"), (k % 4 == 0).alias("small"), ((k % 2 == 0) | (k % 37 == 0)).alias("large"))
    return saved_splits.violations(saved, o, "o_orderkey", "o_custkey", levels=["small", "large"])


@query("inner_group_split", f"""
WITH {T}, g AS (SELECT n_name, row_number() OVER (ORDER BY sha256('8:' || n_name), n_name) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT n_name FROM t))
SELECT o_orderkey, CASE WHEN r < least(greatest(1, ceil(n * 0.2)), n - 1) THEN 'valid' ELSE 'train' END AS "inner" FROM t JOIN g USING (n_name)""")
def _(s, d):
    return sp.inner_split(typed_orders(s, d), "n_name", 8, 0.2).select("o_orderkey", "inner")


# ---- transfer


@query("donor_either_context", f"""
WITH {T}, p AS (SELECT a.o_orderkey, b.o_orderkey AS donor, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.y DESC, b.o_orderkey) AS k
  FROM t a JOIN t b ON a.{_QUERIES} AND a.o_orderkey <> b.o_orderkey AND (a.o_orderpriority <> b.o_orderpriority OR a.o_orderstatus <> b.o_orderstatus)
    AND ((a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment) OR (a.n_name = b.n_name AND a.o_orderpriority = b.o_orderpriority)))
SELECT o_orderkey, donor FROM p WHERE k = 1""")
def _(s, d):
    t = typed_orders(s, d)
    pairs = tr.either_context(t.where(_QUERIES), cd.leading(t, SCHEMA, 1, "high_outcome"), SCHEMA, [SCHEMA.substrate, ("n_name", "o_orderpriority")], SCHEMA.condition)
    return cd.pick_donors(pairs, SCHEMA, cd.by_strategy("high_outcome", SCHEMA)).select(F.col("s_o_orderkey").alias("o_orderkey"), F.col("d_o_orderkey").alias("donor"))


@query("transferred_candidates", f"""
WITH {T}, p AS (SELECT a.o_orderkey AS source, b.o_orderkey AS donor, a.n_name, a.c_mktsegment, b.o_orderpriority, a.o_orderstatus, a.y AS source_outcome, b.y AS donor_outcome, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.y DESC, b.o_orderkey) AS k
  FROM t a JOIN t b ON a.{_QUERIES} AND a.o_orderkey <> b.o_orderkey AND a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority <> b.o_orderpriority)
SELECT source, donor, n_name, c_mktsegment, o_orderpriority, o_orderstatus, source_outcome, donor_outcome FROM p WHERE k = 1""")
def _(s, d):
    t = typed_orders(s, d)
    roles = tr.role_modes(SCHEMA)["o_orderpriority"]
    fixed = tuple(r for r in SCHEMA.roles if r not in roles)
    return tr.transfer(tr.picks(t.where(_QUERIES), t, SCHEMA, fixed, roles, "any", "high_outcome"), SCHEMA, roles)


@query("donor_with_fallback", f"""
WITH {T}, p AS (SELECT a.o_orderkey, b.o_orderkey AS donor, CAST(a.o_orderpriority <> b.o_orderpriority AS INT) + CAST(a.o_orderstatus <> b.o_orderstatus AS INT) AS n, {_SAME} AS same, sha256('4:' || a.o_orderkey || ':' || b.o_orderkey) AS h
  FROM t a JOIN t b ON a.{_QUERIES} AND a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment AND a.o_orderkey <> b.o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY CAST(n = 2 AS INT) DESC, h, donor) AS k FROM p WHERE n > 0)
SELECT o_orderkey, donor, n AS n_changed, same FROM r WHERE k = 1""")
def _(s, d):
    t = typed_orders(s, d)
    out = tr.with_donor(t.where(_QUERIES), t, SCHEMA, SCHEMA.condition, "random", 4, "any")
    return out.select(F.col("s_o_orderkey").alias("o_orderkey"), F.col("d_o_orderkey").alias("donor"), "n_changed", "same")


@query("control_high_outcome_any", f"""
WITH {T}, p AS (SELECT a.o_orderkey, b.o_orderkey AS donor, CAST(row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.y DESC, b.o_orderkey) AS INT) AS place
  FROM t a JOIN t b ON a.{_QUERIES} AND a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment AND a.o_orderkey <> b.o_orderkey AND (a.o_orderpriority <> b.o_orderpriority OR a.o_orderstatus <> b.o_orderstatus))
SELECT * FROM p WHERE place <= 3""")
def _(s, d):
    t = typed_orders(s, d)
    return tr.run_control("high_outcome_any", t.where(_QUERIES), t, SCHEMA, n=3).select(F.col("s_o_orderkey").alias("o_orderkey"), F.col("d_o_orderkey").alias("donor"), "place")


@query("control_nearest_any", f"""
WITH {T}, p AS (SELECT a.o_orderkey, b.o_orderkey AS donor, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY {_SAME} DESC, b.o_orderkey) AS k
  FROM t a JOIN t b ON a.{_QUERIES} AND a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment AND a.o_orderkey <> b.o_orderkey AND (a.o_orderpriority <> b.o_orderpriority OR a.o_orderstatus <> b.o_orderstatus))
SELECT o_orderkey, donor FROM p WHERE k = 1""")
def _(s, d):
    t = typed_orders(s, d)
    return tr.run_control("nearest_any", t.where(_QUERIES), t, SCHEMA).select(F.col("s_o_orderkey").alias("o_orderkey"), F.col("d_o_orderkey").alias("donor"))


@query("nearest_above", f"""
WITH {T}, p AS (SELECT a.o_orderkey, b.o_orderkey AS donor, {_SAME} AS same, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY {_SAME} DESC, b.o_orderkey) AS k
  FROM t a JOIN t b ON a.{_QUERIES} AND a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment AND a.o_orderkey <> b.o_orderkey AND (a.o_orderpriority <> b.o_orderpriority OR a.o_orderstatus <> b.o_orderstatus))
SELECT o_orderkey, arg_min(donor, k) AS donor FROM p WHERE k <= 5 AND same >= 3 GROUP BY 1""")
def _(s, d):
    t = typed_orders(s, d)
    pairs = cd.donor_pairs(t.where(_QUERIES), cd.leading(t, SCHEMA, 5), SCHEMA, SCHEMA.substrate, SCHEMA.condition).withColumn("same", tr.same_roles(SCHEMA))
    return cd.nearest_above(pairs, SCHEMA, "same", 5, 3).withColumnRenamed("s_o_orderkey", "o_orderkey")


@query("capped_pool", f"""
WITH {T}, p AS (SELECT n_name AS source, o_orderkey, y, row_number() OVER (PARTITION BY n_name ORDER BY y DESC, o_orderkey) AS place FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY place, source, y DESC, o_orderkey) AS k FROM p WHERE place <= 4)
SELECT source, o_orderkey, CAST(place AS INT) AS place FROM r WHERE k <= 60""")
def _(s, d):
    t = typed_orders(s, d).select(F.col("n_name").alias("source"), "o_orderkey", "y")
    return cd.capped(t, "source", [F.col("y").desc(), F.col("o_orderkey")], 4, 60).select("source", "o_orderkey", "place")


@query("elite_candidates", f"WITH {T}, r AS (SELECT o_orderkey, p, row_number() OVER (ORDER BY p DESC, o_orderkey) AS k, count(*) OVER () AS n FROM t) SELECT o_orderkey, p FROM r WHERE k <= greatest(1, ceil(n * 0.03))")
def _(s, d):
    return cd.elite(typed_orders(s, d), "p", "o_orderkey", 0.03).select("o_orderkey", "p")


# ---- audit and labels


@query("threshold_reasons", f"""
WITH {T} SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'invalid' WHEN p < 50000 THEN 'below_similarity' WHEN p > 400000 THEN 'too_uncertain' END AS reason FROM t""")
def _(s, d):
    t = typed_orders(s, d).withColumn("reason", au.first_reason([("invalid", F.col("o_orderkey") % 13 == 0)]))
    return au.later_reason(t, [("below_similarity", F.col("p") < 50000), ("too_uncertain", F.col("p") > 400000)]).select("o_orderkey", "reason")


@query("parents_outside_train", f"WITH {T} SELECT o_orderkey FROM t WHERE o_orderkey % 50 NOT IN (SELECT o_orderkey % 50 FROM t WHERE o_orderstatus = 'P')")
def _(s, d):
    t = typed_orders(s, d).withColumn("parent", F.col("o_orderkey") % 50)
    return au.outside_train(t, "parent", t.where("o_orderstatus = 'P'"), "parent").select("o_orderkey")


@query("uncertainty_proxy", f"""
WITH {T} SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(p % 100 AS DOUBLE) END, CAST(abs(y - p) AS DOUBLE) / 2) / greatest(CAST(o_orderkey % 5 AS DOUBLE), 1.0) AS u FROM t""")
def _(s, d):
    std = F.when(F.col("o_orderkey") % 3 == 0, (F.col("p") % 100).cast("double"))
    return typed_orders(s, d).select("o_orderkey", lb.uncertainty_proxy(std, F.col("y"), F.col("p"), (F.col("o_orderkey") % 5).cast("double")).alias("u"))


@query("calibration_scores", f"""
WITH {T} SELECT o_orderkey, abs(y - p) AS additive, CAST(abs(y - p) AS DOUBLE) / greatest(CAST(o_orderkey % 9 AS DOUBLE), 1e-9) AS scaled, greatest(p - 1000 - y, y - p - 1000) AS quantile FROM t""")
def _(s, d):
    y, p = F.col("y"), F.col("p")
    score = lambda kind, **k: lb.calibration_score(kind, y, p, **k)
    spread = (F.col("o_orderkey") % 9).cast("double")
    return typed_orders(s, d).select("o_orderkey", score("additive_residual").alias("additive"), score("scaled_residual", spread=spread).alias("scaled"), score("additive_quantile", low=p - 1000, high=p + 1000).alias("quantile"))


# ---- metrics


@query("marked_selection", f"WITH {T} SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM t ORDER BY y DESC, o_orderkey LIMIT 40) AS selected FROM t")
def _(s, d):
    t = typed_orders(s, d).select("o_orderkey", "y")
    return mt.mark_selected(t, t.orderBy(F.col("y").desc(), "o_orderkey").limit(40), ["o_orderkey"]).select("o_orderkey", "selected")


@query("three_way_deltas", f"""
WITH {T}, m AS (SELECT n_name, max(y) FILTER (o_orderstatus = 'F') AS v0, max(y) FILTER (o_orderstatus = 'O') AS v1, max(y) FILTER (o_orderstatus = 'P') AS v2 FROM t GROUP BY 1)
SELECT *, v1 - v0 AS d10, v2 - v0 AS d20, v2 - v1 AS d21 FROM m WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL""")
def _(s, d):
    return mt.three_way(typed_orders(s, d).groupBy("n_name", "o_orderstatus").agg(F.max("y").alias("v")), ["n_name"], "o_orderstatus", ("F", "O", "P"), "v")


@query("constrained_policy", f"""
WITH {T}, g AS (SELECT c_mktsegment, n_name, CAST(count(*) FILTER (y < 300000) AS DOUBLE) / count(*) AS coverage, max(y) - min(y) AS width FROM t GROUP BY 1, 2),
r AS (SELECT *, coverage >= 0.9 AS feasible, row_number() OVER (PARTITION BY c_mktsegment ORDER BY coverage >= 0.9 DESC, CASE WHEN coverage >= 0.9 THEN 0 ELSE -coverage END, width, n_name) AS k FROM g)
SELECT c_mktsegment, n_name, coverage, width, feasible FROM r WHERE k = 1""")
def _(s, d):
    g = typed_orders(s, d).groupBy("c_mktsegment", "n_name").agg((F.count_if(F.col("y") < 300000) / F.count("*")).alias("coverage"), (F.max("y") - F.min("y")).alias("width"))
    return mt.constrained_best(g, ["c_mktsegment"], "coverage", 0.9, [F.col("width"), F.col("n_name")])


@query("top_fraction_enrichment", f"""
WITH {T}, n AS (SELECT n_name, count(*) AS n, CAST(count(*) FILTER (y >= 300000) AS DOUBLE) / count(*) AS prevalence, greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT)) AS k FROM t GROUP BY 1),
r AS (SELECT n_name, y, row_number() OVER (PARTITION BY n_name ORDER BY p DESC, o_orderkey) AS rn FROM t),
c AS (SELECT n_name, n, k, prevalence, CAST(count(*) FILTER (y >= 300000) AS DOUBLE) / count(*) AS "precision" FROM r JOIN n USING (n_name) WHERE rn <= k GROUP BY ALL)
SELECT *, "precision" / nullif(prevalence, 0) AS enrichment FROM c""")
def _(s, d):
    return mt.top_fraction_enrichment(typed_orders(s, d), ["n_name"], "p", "y", "o_orderkey", 0.1, 300000)


@query("interval_spearman", f"""
WITH {T}, x AS (SELECT n_name, abs(y - p) AS e, p % 1000 AS w FROM t),
r AS (SELECT n_name, 2 * rank() OVER (PARTITION BY n_name ORDER BY w) + count(*) OVER (PARTITION BY n_name, w) - 1 AS a, 2 * rank() OVER (PARTITION BY n_name ORDER BY e) + count(*) OVER (PARTITION BY n_name, e) - 1 AS b FROM x)
SELECT n_name, count(*) AS n, {_VAR('a', 'b')} / nullif(sqrt({_VAR('a', 'a')}) * sqrt({_VAR('b', 'b')}), 0) AS spearman FROM r GROUP BY 1""")
def _(s, d):
    t = typed_orders(s, d).select("n_name", F.abs(F.col("y") - F.col("p")).alias("e"), (F.col("p") % 1000).alias("w"))
    return mt.spearman(t, ["n_name"], "w", "e")


@query("final_round_summary", f"""
WITH {T}, a AS (SELECT n_name, o_orderstatus, CAST(max(y) // 2 AS BIGINT) AS v FROM t GROUP BY 1, 2),
m AS (SELECT n_name, o_orderstatus, 50 * (2 * count(*) FILTER (t.y < v) + count(*) FILTER (t.y = v)) / count(*) AS p FROM a JOIN (SELECT n_name, y FROM t) t USING (n_name) GROUP BY 1, 2)
SELECT o_orderstatus, count(DISTINCT n_name) AS n_units, round(avg(p), 6) AS mean_percentile, count(*) FILTER (p >= 95) AS units_at_or_above_95th FROM m GROUP BY 1""")
def _(s, d):
    t = typed_orders(s, d)
    a = t.groupBy("n_name", "o_orderstatus").agg(F.expr("max(y) div 2").alias("v"))
    p = mt.midrank_percentile(a, t.select("n_name", F.col("y").alias("v")), ["n_name"], "v")
    return mt.final_summary(p, ["o_orderstatus"], "n_name").withColumn("mean_percentile", F.round("mean_percentile", 6))


@query("margin_wins", f"""
WITH {T}, g AS (SELECT n_name, yr, max(p) - max(y) AS d FROM t GROUP BY 1, 2), w AS (SELECT n_name, count(d) AS n_pairs, count(*) FILTER (d <= -5000) AS n_wins, count(*) FILTER (d >= 5000) AS n_losses, CAST(sum(d) AS DOUBLE) / count(d) AS mean_delta FROM g GROUP BY 1)
SELECT *, n_wins * 2 > n_pairs AND mean_delta < 0 AS kept FROM w""")
def _(s, d):
    g = typed_orders(s, d).groupBy("n_name", "yr").agg((F.max("p") - F.max("y")).alias("d"))
    return mt.margin_wins(g, ["n_name"], "d", 5000)


@query("top_excluding", """
WITH c AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (FROM c) ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def _(s, d):
    c = read(s, d, "customer").select("c_custkey", "c_acctbal")
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    return mt.top_excluding(c, c.orderBy(*order).limit(10), "c_custkey", order, 10)


@query("data_efficiency", f"""
WITH {T}, m AS (SELECT 'all' AS arm, yr, max(y) AS v FROM t GROUP BY 2 UNION ALL SELECT 'open', yr, max(y) FROM t WHERE o_orderstatus = 'O' GROUP BY 2)
SELECT yr, max(v) FILTER (arm = 'all') AS "all", max(v) FILTER (arm = 'open') AS open FROM m GROUP BY 1""")
def _(s, d):
    t = typed_orders(s, d)
    best = lambda x, arm: x.groupBy("yr").agg(F.max("y").alias("v")).withColumn("arm", F.lit(arm))
    return mt.pivot(best(t, "all").unionByName(best(t.where("o_orderstatus = 'O'"), "open")), ["yr"], "arm", ["all", "open"], "v")


# the share of Student's distribution within the statistic, by its finite series in the angle, for odd and even degrees of freedom
@query("paired_t_test", f"""
WITH RECURSIVE {T}, g AS (SELECT n_name, max(p) - max(y) AS d FROM t GROUP BY n_name, yr),
a AS (SELECT n_name, count(*) AS n, CAST(sum(d) AS DOUBLE) / count(*) AS mean_delta, {_VAR('d', 'd')} / nullif(CAST(count(*) * (count(*) - 1) AS DOUBLE), 0) AS v FROM g GROUP BY 1),
b AS (SELECT n_name, n, mean_delta, CASE WHEN v > 0 THEN mean_delta * sqrt(n) / sqrt(v) END AS t, n - 1 AS f FROM a),
c AS (SELECT *, f / (f + t * t) AS c2, abs(t) / sqrt(f + t * t) AS si FROM b WHERE t IS NOT NULL),
s AS (SELECT n_name, 0 AS k, 1.0::DOUBLE AS term FROM c WHERE f > 1
  UNION ALL SELECT s.n_name, s.k + 1, term * c2 * CASE WHEN f % 2 = 1 THEN 2.0 * (s.k + 1) / (2 * s.k + 3) ELSE (2.0 * s.k + 1) / (2 * s.k + 2) END FROM s JOIN c USING (n_name) WHERE s.k + 1 <= (f - 2 - f % 2) // 2),
r AS (SELECT n_name, sum(term) AS s FROM s GROUP BY 1),
p AS (SELECT n_name, 1 - CASE WHEN f % 2 = 1 THEN 2 / pi() * (atan2(si, sqrt(c2)) + si * sqrt(c2) * coalesce(s, 0)) ELSE si * s END AS p_value FROM c LEFT JOIN r USING (n_name))
SELECT n_name, n, round(mean_delta, 6) AS mean_delta, round(t, 6) AS t, round(p_value, 9) AS p_value FROM b LEFT JOIN p USING (n_name)""")
def _(s, d):
    g = typed_orders(s, d).groupBy("n_name", "yr").agg((F.max("p") - F.max("y")).alias("d"))
    return mt.t_test(g, ["n_name"], "d").select("n_name", "n", *[F.round(c, k).alias(c) for c, k in (("mean_delta", 6), ("t", 6), ("p_value", 9))])


# ---- similarity and acquisition

_W = """w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS w FROM part), u AS (SELECT id, unnest(w) AS t, len(w) AS n FROM w)"""
_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v, label FROM embeddings)"
_SQ = "round(-(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v)), 6)"


@query("support_distance_tanimoto", f"""
WITH {_W}, p AS (SELECT a.id, count(*) / (a.n + b.n - count(*)) AS s FROM u a JOIN u b ON a.t = b.t WHERE a.id % 20 = 0 AND b.id % 20 <> 0 GROUP BY a.id, b.id, a.n, b.n)
SELECT w.id, 'tanimoto' AS metric, 1 - coalesce(max(s), 0.0) AS distance FROM w LEFT JOIN p USING (id) WHERE w.id % 20 = 0 GROUP BY 1""")
def _(s, d):
    x = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("bits"))
    return sm.support_distance(x.where("id % 20 = 0"), x.where("id % 20 <> 0"), "tanimoto")  # a split into test and train


@query("support_distance_euclidean", f"""
WITH {_E} SELECT a.id, 'euclidean' AS metric, round(sqrt(greatest(-max({_SQ}), 0)), 5) AS distance FROM e a JOIN e b ON b.label < 5 WHERE a.label >= 5 GROUP BY a.id""")
def _(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return sm.support_distance(e.where("label >= 5"), e.where("label < 5"), "euclidean").withColumn("distance", F.round("distance", 5))


@query("nearest_real_label", f"""
WITH {_E}, p AS (SELECT a.id, b.id AS nearest, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {_SQ} DESC, b.id) AS k FROM e a JOIN e b ON {_SQ} <> 0 WHERE a.id % 20 = 0)
SELECT id, nearest, label FROM p WHERE k = 1""")
def _(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return sm.nearest_label(e.where("id % 20 = 0"), e, "label")


@query("campaign_random", f"""
WITH {T}, r AS (SELECT n_name, o_orderkey, y, row_number() OVER (PARTITION BY n_name ORDER BY sha256('64:' || n_name || ':' || o_orderkey)) - 1 AS r FROM t)
SELECT n_name AS campaign, CAST(CASE WHEN r < 16 THEN 0 ELSE 1 + (r - 16) // 8 END AS INT) AS round, o_orderkey AS key, CAST(y AS DOUBLE) AS outcome FROM r WHERE r < 16 + 80""")
def _(s, d):
    return aq.campaign(typed_orders(s, d), "n_name", "o_orderkey", "y", 64, 16, 10, 8, "random")


@query("campaign_ucb", campaign_sql("mean + 2 * half"))
def _(s, d):
    return aq.campaign(typed_orders(s, d), "n_name", "o_orderkey", "y", 64, 16, 10, 8, "ucb", "o_orderpriority", beta=2.0)
