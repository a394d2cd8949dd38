"""Queries: cleaning, parsing, identity, splits, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import cleaning as cl
from lattica.functions import identity as idn
from lattica.functions import parsing as ps
from lattica.operators import features as ft
from lattica.operators import quality as ql
from lattica.operators import splits as sp
from lattica.plans.base import CELL, SCHEMA, T, read, typed_orders
from lattica.sources import io

Q: dict = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


@query("clean_filter_counts", """
WITH e AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'not_a_number' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS v,
                  CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS r FROM events),
f AS (SELECT coalesce(TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 100, false) AS ok, r NOT IN ('', 'UNKNOWN') AS known FROM e)
SELECT count(*) AS n_rows, count(*) FILTER (NOT ok) AS dropped_invalid_outcome, count(*) FILTER (ok AND NOT known) AS dropped_missing_required,
       count(*) FILTER (ok AND known) AS kept FROM f""")
def _(s, d):
    e = read(s, d, "events")
    v = F.when(F.col("event_id") % 11 == 0, "not_a_number").otherwise(F.floor("value").cast("long").cast("string"))
    r = F.when(F.col("event_id") % 5 == 0, "UNKNOWN").when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type"))
    return cl.filter_counts(e.select(v.alias("v"), r.alias("r")), F.col("v"), F.col("r"))


@query("unknown_fill_profile", """
WITH x AS (SELECT p_brand, CASE WHEN p_size % 3 > 0 THEN '' ELSE p_type END AS p_type FROM part)
SELECT 'p_brand' AS column_name, count(*) FILTER (trim(p_brand) IN ('', 'UNKNOWN')) AS n_unknown, count(*) AS n_rows, false AS warn FROM x
UNION ALL SELECT 'p_type', count(*) FILTER (trim(p_type) = ''), count(*), count(*) FILTER (trim(p_type) = '') * 2 > count(*) FROM x""")
def _(s, d):
    p = read(s, d, "part").withColumn("p_type", F.when(F.col("p_size") % 3 > 0, "").otherwise(F.col("p_type")))
    return cl.unknown_counts(p, ["p_brand", "p_type"])


@query("fill_unknown_groups", """
SELECT coalesce(nullif(trim(CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN ' ' ELSE p_brand END), ''), 'UNKNOWN') AS brand, count(*) AS n
FROM part GROUP BY 1""")
def _(s, d):
    c = F.when(F.col("p_size") % 4 == 0, None).when(F.col("p_size") % 4 == 1, " ").otherwise(F.col("p_brand"))
    return read(s, d, "part").groupBy(cl.fill_unknown(c).alias("brand")).agg(F.count("*").alias("n"))


@query("row_ids", "SELECT o_orderkey, printf('rxn_%06d', o_orderkey + 1) AS row_id FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", cl.row_id(F.col("o_orderkey")).alias("row_id"))


@query("fraction_scale", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS v FROM lineitem), m AS (SELECT max(v) AS m FROM x)
SELECT l_orderkey, l_linenumber, CAST(round(CASE WHEN m <= 1 THEN v * 100 ELSE v END) AS BIGINT) AS v FROM x, m""")
def _(s, d):
    x = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("v"))
    return cl.to_percent(x, "v").withColumn("v", F.round("v").cast("long"))


@query("token_parse", """
SELECT page_id, len(list_filter(string_split(url, '/'), lambda x: trim(x) <> '')) AS n_tokens,
       array_to_string(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '')[1:2], '|') AS first_two FROM pages""")
def _(s, d):
    t = cl.tokens(F.col("url"), "/")
    return read(s, d, "pages").select("page_id", F.size(t).alias("n_tokens"), F.array_join(F.slice(t, 1, 2), "|").alias("first_two"))


_RX = "CASE WHEN l_linenumber = 7 THEN 'x>y' WHEN l_linenumber = 6 THEN 'a.b.c>>d' ELSE l_returnflag || '.' || l_linestatus || '.' || l_partkey || '.' || l_suppkey || '.u.v>>' || l_orderkey END"


@query("parse_status", f"""
WITH x AS (SELECT {_RX} AS rx FROM lineitem)
SELECT CASE WHEN len(string_split(rx, '>>')) <> 2 THEN 'malformed' WHEN len(string_split(string_split(rx, '>>')[1], '.')) = 6 THEN 'ok' ELSE 'unexpected_left_token_count' END AS status, count(*) AS n
FROM x GROUP BY 1""")
def _(s, d):
    x = read(s, d, "lineitem").selectExpr(f"{_RX} AS rx")
    return x.groupBy(ps.parse_fixed(F.col("rx"))["status"].alias("status")).agg(F.count("*").alias("n"))


@query("substrate_condition", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, {_RX} AS rx FROM lineitem), y AS (SELECT *, string_split(string_split(rx, '>')[1], '.') AS w, len(string_split(rx, '>')) AS k FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 3 AND len(w) >= 3 THEN array_to_string(w[1:2], '.') END AS substrate,
       CASE WHEN k = 3 AND len(w) >= 3 THEN array_to_string(w[3:], '.') END AS condition FROM y""")
def _(s, d):
    x = read(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_RX} AS rx")
    x = x.withColumn("left", ps.sections(F.col("rx"))["left"]).withColumn("sc", ps.substrate_condition(F.col("left")))
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("sc").isNotNull(), F.array_join("sc.substrate", ".")).alias("substrate"), F.when(F.col("sc").isNotNull(), F.array_join("sc.condition", ".")).alias("condition"))


_RULES = [("metal", ["copper", "brass", "steel", "nickel", "tin"]), ("large", ["large", "economy"]), ("small", ["small", "medium"])]


@query("component_classify", """
SELECT CASE WHEN regexp_matches(lower(p_type), 'copper|brass|steel|nickel|tin') THEN 'metal' WHEN regexp_matches(lower(p_type), 'large|economy') THEN 'large'
            WHEN regexp_matches(lower(p_type), 'small|medium') THEN 'small' ELSE 'unclassified' END AS class, count(*) AS n FROM part GROUP BY 1""")
def _(s, d):
    return read(s, d, "part").groupBy(ps.classify(F.col("p_type"), _RULES).alias("class")).agg(F.count("*").alias("n"))


@query("role_repair", """
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['s:' || o_orderstatus, 'p:' || o_orderpriority] WHEN 1 THEN ['p:' || o_orderpriority, 's:' || o_orderstatus] ELSE ['s:1', 's:2'] END AS w FROM orders)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'repaired' ELSE 'ambiguous' END AS status,
       CASE o_orderkey % 3 WHEN 1 THEN w[2] ELSE w[1] END AS state, CASE o_orderkey % 3 WHEN 1 THEN w[1] ELSE w[2] END AS priority FROM x""")
def _(s, d):
    st, pr = F.concat(F.lit("s:"), "o_orderstatus"), F.concat(F.lit("p:"), "o_orderpriority")
    w = F.when(F.col("o_orderkey") % 3 == 0, F.array(st, pr)).when(F.col("o_orderkey") % 3 == 1, F.array(pr, st)).otherwise(F.array(F.lit("s:1"), F.lit("s:2")))
    x = read(s, d, "orders").select("o_orderkey", w.alias("w"))
    x = x.withColumn("r", ps.repair_roles(F.col("w"), [("state", ["s:"]), ("priority", ["p:"])], ["state", "priority"]))
    return x.select("o_orderkey", "r.status", "r.state", "r.priority")


@query("recovery_summary", f"""
WITH {T}
SELECT 'o_orderstatus' AS section, o_orderstatus AS field, count(*) AS value FROM t GROUP BY 2
UNION ALL SELECT 'distinct', 'n_name', count(DISTINCT n_name) FROM t UNION ALL SELECT 'distinct', 'c_mktsegment', count(DISTINCT c_mktsegment) FROM t
UNION ALL SELECT 'known', 'n_name', count(n_name) FROM t UNION ALL SELECT 'known', 'c_mktsegment', count(c_mktsegment) FROM t""")
def _(s, d):
    return ps.recovery_summary(typed_orders(s, d), ["o_orderstatus"], ["n_name", "c_mktsegment"])


@query("format_profile", """
SELECT count(*) AS n_rows, count(*) FILTER (contains(html, '>')) AS with_arrow, count(*) FILTER (len(string_split(html, '>')) = 3) AS two_arrows,
       count(*) FILTER (contains(html, '.')) AS with_dot, count(*) FILTER (regexp_matches(html, 'Cl|Br|I|F')) AS with_halogen, count(*) FILTER (contains(html, 'N')) AS with_n FROM pages""")
def _(s, d):
    return ps.format_profile(read(s, d, "pages"), "html")


@query("stress_keys", """
SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), '.') AS reactant_key, array_to_string(string_split(p_name, ' '), '.') AS product_key FROM part""")
def _(s, d):
    t = cl.tokens(F.col("p_name"), " ")
    product, reactant = ps.stress_keys(t, t)
    return read(s, d, "part").select("p_partkey", reactant.alias("reactant_key"), product.alias("product_key"))


@query("token_permutations", """
WITH x AS (SELECT p_partkey, c AS copy, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part, range(1, 3) r(c))
SELECT p_partkey, CAST(copy AS INT) AS copy, string_agg(w, ' ' ORDER BY sha256('5:' || p_partkey || ':' || copy || ':' || i)) AS tokens FROM x GROUP BY ALL""")
def _(s, d):
    x = read(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    return ps.permuted(x, "tokens", 2, 5, "p_partkey").withColumn("tokens", F.array_join("tokens", " "))


@query("replicate_stats", f"""
WITH {T}
SELECT n_name, c_mktsegment, o_orderpriority, o_orderstatus, count(*) AS n_rows, count(y) AS n_outcomes, CAST(sum(y) AS DOUBLE) / count(y) AS mean, quantile_cont(y, 0.5) AS median,
       sqrt(CAST(CAST(count(*) AS HUGEINT) * sum(CAST(y AS HUGEINT) * y) - CAST(sum(y) AS HUGEINT) * sum(y) AS DOUBLE)) / count(*) AS std_pop, min(y) AS min, max(y) AS max, max(y) - min(y) AS range,
       count(DISTINCT y) AS n_unique, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids
FROM t GROUP BY n_name, c_mktsegment, o_orderpriority, o_orderstatus""")
def _(s, d):
    return idn.replicate_stats(typed_orders(s, d), CELL, "y", "o_orderkey")


@query("exact_duplicates", "SELECT doc_id, n AS n_members FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def _(s, d):
    x = read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return idn.duplicates(x, ["h"]).select("doc_id", "n_members")


@query("cell_keys", f"""
WITH {T}
SELECT o_orderkey, sha256('{{"_version":"lattica-key-1","c_mktsegment":"' || c_mktsegment || '","n_name":"' || n_name || '"}}') AS substrate_hash,
       sha256('{{"_version":"lattica-key-1","o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}') AS condition_hash FROM t""")
def _(s, d):
    t = typed_orders(s, d)
    return t.select("o_orderkey", idn.hashed(idn.key(*SCHEMA.substrate)).alias("substrate_hash"), idn.hashed(idn.key(*SCHEMA.condition)).alias("condition_hash"))


@query("stable_uniform", "SELECT o_orderkey, CAST(CAST('0x' || substr(sha256('3:' || o_orderkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", idn.uniform(3, F.col("o_orderkey")).alias("u"))


@query("feature_collisions", """
WITH x AS (SELECT lower(text) AS feature, text, doc_id FROM documents)
SELECT sha256(feature) AS feature, count(*) AS n_rows, count(DISTINCT text) AS n_identities, min(doc_id) AS first_id,
       CASE WHEN count(DISTINCT text) = 1 THEN 'same_identity' ELSE 'different_identity_same_feature' END AS kind FROM x GROUP BY feature HAVING count(*) > 1""")
def _(s, d):
    return idn.feature_collisions(read(s, d, "documents"), F.sha2(F.lower("text"), 256), F.sha2("text", 256), "doc_id")


@query("role_value_counts", f"""
WITH {T} SELECT 'n_name' AS role, count(n_name) AS n_valid, count(*) - count(n_name) AS n_null, count(DISTINCT n_name) AS n_distinct FROM t
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM t""")
def _(s, d):
    return idn.role_value_counts(typed_orders(s, d), ["n_name", "o_orderpriority"])


@query("audit_headline", f"""
WITH {T}, c AS (SELECT count(*) AS n, count(DISTINCT y) AS u FROM t GROUP BY n_name, c_mktsegment, o_orderpriority, o_orderstatus),
g AS (SELECT count(*) AS n FROM t GROUP BY n_name, c_mktsegment, y)
SELECT (SELECT count(*) FROM t) AS n_rows, count(*) AS n_cells, count(*) FILTER (n > 1) AS n_replicated, count(*) FILTER (u > 1) AS n_conflicting,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM g WHERE n > 1) AS n_duplicate_rows FROM c""")
def _(s, d):
    return idn.headline(typed_orders(s, d), CELL, ["n_name", "c_mktsegment", "y"], "y")


@query("invalid_values", "SELECT p_partkey, 'p_name' AS role, CASE WHEN p_size % 9 = 0 THEN '' END AS value FROM part WHERE p_size % 9 < 2")
def _(s, d):
    x = read(s, d, "part").withColumn("p_name", F.when(F.col("p_size") % 9 == 0, "").when(F.col("p_size") % 9 == 1, None).otherwise(F.col("p_name")))
    return idn.invalid_values(x, ["p_name", "p_brand"], "p_partkey")


@query("selective_outcomes", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(s, d):
    allow = read(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return io.selective_outcomes(read(s, d, "orders"), allow, "o_orderkey", "o_totalprice")


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def _(s, d):
    return io.head(read(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey")


# ---- splits


@query("random_split", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('7:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r""")
def _(s, d):
    return sp.random_split(read(s, d, "orders").select("o_orderkey"), "o_orderkey", 7, 0.8, 0.1)


@query("low_data_split", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('8:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, r < greatest(1, floor(n * 0.05)) AS included FROM r""")
def _(s, d):
    return sp.low_data(read(s, d, "orders").select("o_orderkey"), "o_orderkey", 7, 0.05)


@query("row_sample", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('2:' || c_custkey), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey FROM r WHERE r < greatest(1, floor(n * 0.1))""")
def _(s, d):
    return sp.sample_rows(read(s, d, "customer").select("c_custkey"), "c_custkey", 2, 0.1)


@query("heldout_group_split", f"""
WITH {T}, g AS (SELECT n_name, row_number() OVER (ORDER BY sha256('4:' || n_name), n_name) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT n_name FROM t)),
x AS (SELECT n_name FROM g WHERE r < greatest(1, ceil(n * 0.2))),
v AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('4:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM t WHERE n_name NOT IN (FROM x))
SELECT o_orderkey, CASE WHEN r < floor(n * 0.1) THEN 'valid' ELSE 'train' END AS split FROM v
UNION ALL SELECT o_orderkey, 'test' FROM t WHERE n_name IN (FROM x)""")
def _(s, d):
    return sp.heldout_groups(typed_orders(s, d).select("o_orderkey", "n_name"), "n_name", "o_orderkey", 4, 0.2, 0.1).select("o_orderkey", "split")


@query("logo_folds", """
WITH g AS (SELECT c_mktsegment AS held_out, count(*) AS n_test FROM customer GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY held_out) - 1 AS INT) AS fold, held_out, n_test, CAST(sum(n_test) OVER () AS BIGINT) - n_test AS n_train FROM g""")
def _(s, d):
    return sp.logo_folds(read(s, d, "customer"), "c_mktsegment")


@query("logo_rows", """
WITH g AS (SELECT c_mktsegment AS held_out, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS fold FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT fold, held_out, CASE WHEN c_mktsegment = held_out THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM customer, g GROUP BY ALL""")
def _(s, d):
    c = read(s, d, "customer").select("c_custkey", "c_mktsegment")
    return sp.logo_rows(c, "c_mktsegment", sp.logo_folds(c, "c_mktsegment")).groupBy("fold", "held_out", "role").agg(F.count("*").alias("n"))


@query("nested_ood_counts", f"""
WITH {T}, g AS (SELECT n_name AS g, count(*) AS c FROM t GROUP BY 1)
SELECT a.g AS outer_group, a.c AS n_outer, b.g AS inner_group, b.c AS n_inner, (SELECT count(*) FROM t) - a.c - b.c AS n_train FROM g a JOIN g b ON a.g <> b.g""")
def _(s, d):
    return sp.nested_ood(typed_orders(s, d), "n_name")


@query("grouped_outer_split", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('9:' || c_custkey), c_custkey) - 1 AS group_order, count(*) OVER () AS n FROM customer),
k AS (SELECT *, greatest(1, least(n - 2, CAST(ceil(n * 0.7 - 0.5) AS BIGINT))) AS a FROM r),
l AS (SELECT *, greatest(a + 1, least(n - 1, CAST(ceil(n * 0.85 - 0.5) AS BIGINT))) AS b FROM k)
SELECT c_custkey, CASE WHEN group_order < a THEN 'train' WHEN group_order < b THEN 'valid' ELSE 'test' END AS split, group_order FROM l""")
def _(s, d):
    return sp.grouped_outer(read(s, d, "customer").select("c_custkey"), "c_custkey", 9, {"train": 0.7, "valid": 0.15, "test": 0.15})


@query("grouped_outer_sized", f"""
WITH RECURSIVE {T}, g AS (SELECT n_name, CAST(count(*) AS DOUBLE) AS size, row_number() OVER (ORDER BY count(*) DESC, sha256('3:' || n_name), n_name) AS k, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM t GROUP BY 1),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS n_name, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, CAST(NULL AS VARCHAR) AS split
  UNION ALL SELECT k, n_name, a + CASE WHEN s = 'train' THEN size ELSE 0 END, b + CASE WHEN s = 'valid' THEN size ELSE 0 END, c + CASE WHEN s = 'test' THEN size ELSE 0 END, s FROM (
    SELECT g.k, g.n_name, g.size, w.a, w.b, w.c,
      CASE WHEN (0.7::DOUBLE * total - w.a) / (0.7::DOUBLE * total) >= greatest((0.15::DOUBLE * total - w.b) / (0.15::DOUBLE * total), (0.15::DOUBLE * total - w.c) / (0.15::DOUBLE * total)) THEN 'train'
           WHEN (0.15::DOUBLE * total - w.b) / (0.15::DOUBLE * total) >= (0.15::DOUBLE * total - w.c) / (0.15::DOUBLE * total) THEN 'valid' ELSE 'test' END AS s
    FROM w JOIN g ON g.k = w.k + 1))
SELECT n_name, split FROM w WHERE k > 0""")
def _(s, d):
    g = typed_orders(s, d).groupBy("n_name").agg(F.count("*").alias("size"))
    return sp.grouped_outer_sized(g, "n_name", "size", 3, {"train": 0.7, "valid": 0.15, "test": 0.15})


@query("nested_prefixes", f"""
WITH {T}, g AS (SELECT c_mktsegment || ':' || n_name AS g, count(*) AS c, sha256('1:' || c_mktsegment || ':' || n_name) AS h FROM t GROUP BY 1, 3),
b AS (SELECT *, coalesce(sum(c) OVER (ORDER BY h, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS n FROM g),
f AS (SELECT unnest([0.01, 0.05, 0.1, 0.2, 1.0]::DOUBLE[]) AS fraction)
SELECT g, fraction, c AS size FROM b, f WHERE fraction = 1.0 OR before < greatest(1, ceil(n * fraction))""")
def _(s, d):
    g = typed_orders(s, d).groupBy(F.concat_ws(":", "c_mktsegment", "n_name").alias("g")).agg(F.count("*").alias("size")).withColumn("h", idn.hash_order(1, "g"))
    return sp.nested_prefixes(g, "g", "size", "h", [0.01, 0.05, 0.1, 0.2, 1.0])


@query("condition_ood_support", f"""
WITH {T}, g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n_test, count(DISTINCT n_name || c_mktsegment) AS n_distinct, (SELECT count(*) FROM t) - count(*) AS n_train FROM t GROUP BY 1, 2),
r AS (SELECT *, concat_ws('; ', CASE WHEN n_test < 400 THEN 'n_test_below_minimum(observed=' || n_test || ',required=400)' END,
      CASE WHEN n_train < 1000 THEN 'n_train_below_minimum(observed=' || n_train || ',required=1000)' END, CASE WHEN n_distinct < 125 THEN 'n_distinct_below_minimum(observed=' || n_distinct || ',required=125)' END) AS reasons FROM g)
SELECT *, reasons = '' AS supported FROM r""")
def _(s, d):
    t = typed_orders(s, d).withColumn("sub", F.concat("n_name", "c_mktsegment"))
    return sp.condition_support(t, list(SCHEMA.condition), "sub", 400, 1000, 125)


@query("hidden_panels", f"""
WITH {T}, x AS (SELECT *, count(*) OVER (PARTITION BY n_name) AS c, CAST(row_number() OVER (PARTITION BY n_name ORDER BY sha256('6:' || n_name || ':' || o_orderkey), o_orderkey) AS INT) AS place FROM t)
SELECT n_name, o_orderkey, place FROM x WHERE c >= 500 AND place <= 5""")
def _(s, d):
    return sp.panels(typed_orders(s, d).select("n_name", "o_orderkey"), "n_name", "o_orderkey", 6, 500, 5)


@query("calibration_part", """
SELECT CASE WHEN CAST(CAST('0x' || substr(sha256('12:' || o_orderkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 < 0.7 THEN 'fit' ELSE 'calibration' END AS part, count(*) AS n FROM orders GROUP BY 1""")
def _(s, d):
    return sp.calibration_part(read(s, d, "orders"), "o_orderkey", 12, 0.7).groupBy("part").agg(F.count("*").alias("n"))


@query("campaign_pool", f"""
WITH {T}, f AS (SELECT min(o_orderkey) AS o_orderkey FROM t GROUP BY n_name, c_mktsegment, o_orderpriority, o_orderstatus)
SELECT o_orderkey, row_number() OVER (ORDER BY sha256('5:' || o_orderkey), o_orderkey) <= 32 AS is_seed FROM f""")
def _(s, d):
    return sp.campaign_pool(typed_orders(s, d), CELL, "o_orderkey", 5, 32).select("o_orderkey", "is_seed")


@query("evaluation_roles", f"""
WITH {T}, r AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'labeled' ELSE 'hidden' END END AS role FROM t)
SELECT role, count(*) AS n, count(CASE WHEN role IN ('labeled', 'valid') THEN y END) AS n_outcomes FROM r GROUP BY role""")
def _(s, d):
    k = F.col("o_orderkey")
    t = typed_orders(s, d).withColumn("split", F.when(k % 4 == 0, "test").when(k % 4 == 1, "valid").otherwise("train"))
    return sp.evaluation_roles(t, "split", k % 3 == 0, "y").groupBy("role").agg(F.count("*").alias("n"), F.count("y").alias("n_outcomes"))


# ---- features


@query("hash_fingerprint", """
WITH g AS (SELECT p_partkey, p_name AS g FROM part UNION SELECT p_partkey, substr(p_name, i, w) FROM (SELECT p_partkey, p_name, w, unnest(range(1, length(p_name) - w + 2)) AS i FROM part, (SELECT unnest([1, 2, 3]) AS w)) WHERE length(p_name) >= w)
SELECT p_partkey, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS bits FROM (SELECT DISTINCT p_partkey, CAST('0x' || substr(sha256(g), 1, 12) AS BIGINT) % 1024 AS b FROM g) GROUP BY 1""")
def _(s, d):
    return read(s, d, "part").select("p_partkey", F.array_join(ft.hash_bits(F.col("p_name")).cast("array<string>"), ",").alias("bits"))


@query("fingerprint_sum", """
WITH w AS (SELECT p_brand, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part)
SELECT p_brand, CAST(CAST('0x' || substr(sha256(w), 1, 12) AS BIGINT) % 64 AS INT) AS bit, count(*) AS n FROM (SELECT p_brand, w FROM w) GROUP BY 1, 2""")
def _(s, d):
    bits = F.transform(F.array_distinct(F.split("p_name", " ")), lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 12), 16, 10).cast("long") % 64).cast("int"))
    return ft.bit_counts(read(s, d, "part").select("p_brand", bits.alias("bits")), ["p_brand"], ["bits"])


@query("role_blocks", """
SELECT o_orderkey, ascii(substr(o_orderstatus, 1, 1)) % 32 AS b0, 32 + ascii(substr(o_orderpriority, 1, 1)) % 32 AS b1 FROM orders""")
def _(s, d):
    one = lambda c: F.array(F.ascii(c) % 32)
    x = ft.blocks({"status": one("o_orderstatus"), "priority": one("o_orderpriority")}, 32)
    return read(s, d, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", F.col("x")[0].alias("b0"), F.col("x")[1].alias("b1"))


@query("one_hot", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus__F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus__O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus__P FROM orders""")
def _(s, d):
    return ft.one_hot(read(s, d, "orders"), "o_orderkey", ["o_orderstatus"])


@query("feature_diagnostics", """
WITH n AS (SELECT len(list_distinct(string_split(p_name, ' '))) AS n FROM part)
SELECT count(*) AS n_rows, count(*) FILTER (n = 0) AS n_empty, min(n) AS min_bits, CAST(sum(n) AS DOUBLE) / count(*) AS mean_bits, max(n) AS max_bits FROM n""")
def _(s, d):
    return ft.diagnostics(read(s, d, "part").select(F.array_distinct(F.split("p_name", " ")).alias("b")), "b")


@query("f_score_topk", """
WITH p AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS y, unnest(list_distinct(string_split(p_name, ' '))) AS bit FROM part),
o AS (SELECT DISTINCT p_partkey, y FROM p), t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(y * y) AS DOUBLE) AS syy FROM o),
g AS (SELECT bit, CAST(count(*) AS DOUBLE) AS m, CAST(sum(y) AS DOUBLE) AS s FROM p GROUP BY 1),
r AS (SELECT bit, n, (n * s - m * sy) * (n * s - m * sy) / nullif(m * (n - m) * (n * syy - sy * sy), 0) AS r2 FROM g, t)
SELECT bit, round(r2 * (n - 2) / nullif(1 - r2, 0), 8) AS score FROM r ORDER BY score DESC NULLS LAST, bit LIMIT 10""")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.floor("p_retailprice").cast("long").alias("y"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("bit"))
    return ft.f_scores(p.select("p_partkey", "bit"), "p_partkey", p.select("p_partkey", "y").distinct(), "y", 10).withColumn("score", F.round("score", 8))


# ---- quality: no row comes back


@query("quality_unique", "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return ql.not_unique(read(s, d, "orders"), ["o_orderkey"])


@query("quality_coverage", """
SELECT o_orderkey, 'left_only' AS side FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, 'right_only' FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""")
def _(s, d):
    return ql.coverage_gaps(read(s, d, "orders"), read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("quality_crossing_groups", f"WITH {T} SELECT n_name, count(DISTINCT o_orderstatus) AS n_parts FROM t GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(s, d):
    return ql.overlapping_parts(typed_orders(s, d), "n_name", "o_orderstatus")


@query("quality_nested", """
WITH x AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS level FROM lineitem), l AS (SELECT DISTINCT level FROM x), r AS (SELECT k, min(level) AS low, count(*) AS n FROM x GROUP BY 1)
SELECT k, low, n, (SELECT count(*) FROM l WHERE level >= low) AS expected FROM r WHERE n < (SELECT count(*) FROM l WHERE level >= low)""")
def _(s, d):
    x = read(s, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("level"))
    return ql.not_nested(x, "k", "level")


@query("quality_nested_prefixes", f"""
WITH {T}, g AS (SELECT c_mktsegment || ':' || n_name AS g, count(*) AS c, sha256('1:' || c_mktsegment || ':' || n_name) AS h FROM t GROUP BY 1, 3),
b AS (SELECT *, coalesce(sum(c) OVER (ORDER BY h, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS n FROM g),
f AS (SELECT unnest([0.01, 0.05, 0.1, 0.2, 1.0]::DOUBLE[]) AS fraction), x AS (SELECT g, fraction FROM b, f WHERE fraction = 1.0 OR before < greatest(1, ceil(n * fraction))),
r AS (SELECT g, min(fraction) AS low, count(*) AS n FROM x GROUP BY 1)
SELECT g, low, n, (SELECT count(*) FROM f WHERE fraction >= low) AS expected FROM r WHERE n < (SELECT count(*) FROM f WHERE fraction >= low)""")
def _(s, d):
    return ql.not_nested(Q["nested_prefixes"][0](s, d), "g", "fraction")
