"""Queries: similarity, candidates, audit, labels, metrics, acquisition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import acquire as aq
from lattica.operators import audit as au
from lattica.operators import candidates as cd
from lattica.operators import clusters as cu
from lattica.operators import labels as lb
from lattica.operators import metrics as mt
from lattica.operators import protocol as pr
from lattica.operators import ranking as rk
from lattica.operators import similarity as sm
from lattica.operators import splits as sp
from lattica.plans.base import SCHEMA, T, read, typed_orders
from lattica.streaming.windows import windowed_outcomes

Q: dict = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


# ---- similarity

_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v, label FROM embeddings)"
_COS = "round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6)"


def _vectors(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query("knn", f"""
WITH {_E}, p AS (SELECT a.id AS query, b.id AS neighbour, {_COS} AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0),
r AS (SELECT query, neighbour, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS INT) AS place FROM p)
SELECT * FROM r WHERE place <= 5""")
def _(s, d):
    e = _vectors(s, d)
    return sm.dense_topk(e.where("id % 20 = 0"), e, 5).select("query", "neighbour", "place")


@query("similarity_components", f"""
WITH RECURSIVE {_E}, g AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id WHERE {_COS} >= 0.6),
r AS (SELECT id AS a, id AS b FROM e UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT a AS id, min(b) AS comp FROM r GROUP BY a""")
def _(s, d):
    e = _vectors(s, d)
    return sm.components(sm.similar_pairs(e, 0.6), e)


# the sequential rule: node by node in order, with the list of those that have a cluster
_CLUSTERS = f"""{_E}, g AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id WHERE {_COS} >= 0.35),
nb AS (SELECT a, list(b) AS l FROM g GROUP BY a), o AS MATERIALIZED (SELECT id, l, row_number() OVER (ORDER BY coalesce(len(l), 0) DESC, id) AS k FROM e LEFT JOIN nb ON a = id),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS taken
  UNION ALL SELECT o.k, CASE WHEN NOT list_contains(taken, id) THEN id END, CASE WHEN list_contains(taken, id) THEN taken ELSE list_concat(taken, list_prepend(id, coalesce(l, []))) END FROM w JOIN o ON o.k = w.k + 1),
c AS (SELECT id, arg_min(leader, k) AS cluster FROM (SELECT leader AS id, leader, k FROM w WHERE leader IS NOT NULL UNION ALL SELECT g.b, leader, k FROM w JOIN g ON g.a = leader) GROUP BY id)"""


@query("cluster_holdouts", f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM c")
def _(s, d):
    e = _vectors(s, d)
    return cu.greedy_clusters(sm.similar_pairs(e, 0.35), e)


@query("cluster_folds", f"""
WITH RECURSIVE {_CLUSTERS}, r AS (SELECT cluster, label FROM c JOIN e USING (id)),
f AS (SELECT cluster, count(*) AS n_test, count(DISTINCT label) AS test_groups, (SELECT count(*) FROM r) - count(*) AS n_train, (SELECT count(DISTINCT label) FROM r x WHERE x.cluster <> r.cluster) AS train_groups FROM r GROUP BY cluster),
t AS (SELECT *, concat_ws('; ', CASE WHEN n_test < 2 THEN 'n_test_below_minimum(observed=' || n_test || ',required=2)' END, CASE WHEN n_train < 10 THEN 'n_train_below_minimum(observed=' || n_train || ',required=10)' END,
  CASE WHEN test_groups < 2 THEN 'test_groups_below_minimum(observed=' || test_groups || ',required=2)' END, CASE WHEN train_groups < 2 THEN 'train_groups_below_minimum(observed=' || train_groups || ',required=2)' END) AS reasons FROM f)
SELECT *, reasons = '' AS supported FROM t""")
def _(s, d):
    e = _vectors(s, d)
    c = cu.greedy_clusters(sm.similar_pairs(e, 0.35), e)
    return cu.cluster_folds(e.select("id", "label").join(c, "id"), "cluster", "label", 2, 10, 2, 2)


@query("bounded_test_split", f"""
WITH RECURSIVE {_E}, g AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id WHERE {_COS} >= 0.6),
r AS (SELECT id AS a, id AS b FROM e UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a), m AS (SELECT a AS id, min(b) AS comp FROM r GROUP BY a),
c AS (SELECT comp, count(*) AS n, row_number() OVER (ORDER BY sha256('4:' || comp), comp) AS k, sum(count(*)) OVER () AS total FROM m GROUP BY comp),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS comp, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS test, false AS take
  UNION ALL SELECT c.k, c.comp, c.n, CAST(w.test + CASE WHEN w.test < 100 AND c.total - w.test - c.n >= 100 THEN c.n ELSE 0 END AS BIGINT), w.test < 100 AND c.total - w.test - c.n >= 100 FROM w JOIN c ON c.k = w.k + 1)
SELECT comp, n, CASE WHEN take THEN 'test' ELSE 'train' END AS split FROM w WHERE k > 0""")
def _(s, d):
    c = Q["similarity_components"][0](s, d).groupBy("comp").agg(F.count("*").alias("n"))
    return sp.bounded_test_components(c, 4, 100, 100)


@query("support_distance", f"""
WITH {_E} SELECT a.id, 'cosine' AS metric, round(1 - max({_COS}), 6) AS distance FROM e a JOIN e b ON b.label < 5 WHERE a.label >= 5 GROUP BY a.id""")
def _(s, d):
    e = _vectors(s, d)
    return sm.support_distance(e.where("label >= 5"), e.where("label < 5")).withColumn("distance", F.round("distance", 6))


@query("diversity", f"""
WITH {_E}, m AS (SELECT a.id, max({_COS}) AS s FROM e a JOIN e b ON a.id <> b.id AND a.label = b.label GROUP BY a.id)
SELECT id, round(coalesce(1 - s, 1.0), 6) AS diversity FROM e LEFT JOIN m USING (id)""")
def _(s, d):
    return sm.diversity(_vectors(s, d), "label").withColumn("diversity", F.round("diversity", 6))


@query("tanimoto_nearest", """
WITH w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS w FROM part), u AS (SELECT id, unnest(w) AS t, len(w) AS n FROM w),
p AS (SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*)) AS s FROM u a JOIN u b ON a.t = b.t WHERE a.id % 20 = 0 AND b.id % 20 <> 0 GROUP BY a.id, b.id, a.n, b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p)
SELECT w.id, r.b AS nearest, coalesce(r.s, 0.0) AS similarity FROM w LEFT JOIN r ON r.a = w.id AND k = 1 WHERE w.id % 20 = 0""")
def _(s, d):
    x = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("bits"))
    return sm.tanimoto_nearest(x.where("id % 20 = 0"), x.where("id % 20 <> 0"))


@query("token_jaccard", """
WITH x AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM x""")
def _(s, d):
    return read(s, d, "part").select("p_partkey", sm.token_jaccard(F.split("p_name", " "), F.split(F.lower("p_type"), " ")).alias("similarity"))


@query("count_cosine", """
WITH n AS (SELECT p_brand AS id, unnest(string_split(p_name, ' ')) AS t FROM part), c AS (SELECT id, t, count(*) AS n FROM n GROUP BY 1, 2), q AS (SELECT id, sum(n * n) AS q FROM c GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(sum(a.n * b.n) / (sqrt(qa.q) * sqrt(qb.q)), 10) AS cosine FROM c a JOIN c b ON a.t = b.t JOIN q qa ON qa.id = a.id JOIN q qb ON qb.id = b.id GROUP BY a.id, b.id, qa.q, qb.q""")
def _(s, d):
    c = read(s, d, "part").select(F.col("p_brand").alias("id"), F.explode(F.split("p_name", " ")).alias("bit")).groupBy("id", "bit").agg(F.count("*").alias("n"))
    return sm.count_cosine(c, c)


@query("pair_quantiles", f"""
WITH {_E}, p AS (SELECT {_COS} AS s FROM e a JOIN e b ON a.id < b.id)
SELECT count(*) AS n, round(quantile_cont(s, 0.05), 8) AS q05, round(quantile_cont(s, 0.25), 8) AS q25, round(quantile_cont(s, 0.5), 8) AS q50, round(quantile_cont(s, 0.75), 8) AS q75, round(quantile_cont(s, 0.95), 8) AS q95 FROM p""")
def _(s, d):
    q = sm.pair_quantiles(_vectors(s, d))
    return q.select("n", *[F.round(c, 8).alias(c) for c in q.columns if c != "n"])


# ---- candidates


@query("best_donor_same_context", f"""
WITH {T}, p AS (SELECT a.o_orderkey, b.o_orderkey AS donor, b.y AS donor_value, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.y DESC, b.o_orderkey) AS k
  FROM t a JOIN t b ON a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment AND a.o_orderkey <> b.o_orderkey)
SELECT o_orderkey, donor, donor_value FROM p WHERE k = 1""")
def _(s, d):
    t = typed_orders(s, d)
    return cd.best_donors(t, t, SCHEMA, SCHEMA.substrate, "y")


@query("donor_all_change", f"""
WITH {T}, r AS (SELECT * FROM t WHERE o_orderkey % 20 = 0),
p AS (SELECT a.o_orderkey, b.o_orderkey AS donor, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY sha256('3:' || a.o_orderkey || ':' || b.o_orderkey), b.o_orderkey) AS k
  FROM r a JOIN t b ON a.n_name = b.n_name AND a.c_mktsegment = b.c_mktsegment AND a.o_orderkey <> b.o_orderkey AND a.o_orderpriority <> b.o_orderpriority AND a.o_orderstatus <> b.o_orderstatus)
SELECT o_orderkey, donor, CAST(k AS INT) AS place FROM p WHERE k <= 2""")
def _(s, d):
    t = typed_orders(s, d)
    picks = cd.random_donors(t.where("o_orderkey % 20 = 0"), t, SCHEMA, SCHEMA.substrate, SCHEMA.condition, "all", 3, 2)
    return picks.select(F.col("s_o_orderkey").alias("o_orderkey"), F.col("d_o_orderkey").alias("donor"), "place")


@query("recombine_conditions", f"""
WITH {T}, c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM t GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER (ORDER BY o_orderpriority, o_orderstatus) - n AS low, sum(n) OVER (ORDER BY o_orderpriority, o_orderstatus) AS high FROM c),
w AS (SELECT o_orderkey, n_name, c_mktsegment, o_orderpriority AS op, o_orderstatus AS os, unnest(range(1, 13)) AS k FROM t),
u AS (SELECT *, floor(CAST(CAST('0x' || substr(sha256('11:' || o_orderkey || ':' || k), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 * (SELECT count(*) FROM t)) AS pos FROM w),
x AS (SELECT o_orderkey, n_name, c_mktsegment, o_orderpriority, o_orderstatus, min(k) AS k FROM u JOIN b ON pos >= low AND pos < high WHERE o_orderpriority <> op OR o_orderstatus <> os GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS INT) AS place FROM x)
SELECT o_orderkey, n_name, c_mktsegment, o_orderpriority, o_orderstatus, place FROM r WHERE place <= 3""")
def _(s, d):
    t = typed_orders(s, d)
    return cd.recombine(t, t, SCHEMA, 3, 11)


@query("unmeasured_cells", f"""
WITH {T} SELECT n_name, c_mktsegment, o_orderpriority, o_orderstatus FROM (SELECT DISTINCT n_name, c_mktsegment FROM t), (SELECT DISTINCT o_orderpriority, o_orderstatus FROM t)
EXCEPT SELECT n_name, c_mktsegment, o_orderpriority, o_orderstatus FROM t""")
def _(s, d):
    return cd.unmeasured_cells(typed_orders(s, d), SCHEMA)


@query("hidden_probes", f"""
WITH {T}, h AS (SELECT * FROM t WHERE o_orderkey % 10 = 0), l AS (SELECT * FROM t WHERE o_orderkey % 10 > 0),
s AS (SELECT h.o_orderkey, min(l.o_orderkey) AS source FROM h JOIN l ON h.n_name = l.n_name AND h.c_mktsegment = l.c_mktsegment AND h.o_orderpriority <> l.o_orderpriority AND h.o_orderstatus <> l.o_orderstatus GROUP BY 1),
d AS (SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS donor FROM l GROUP BY 1, 2)
SELECT h.o_orderkey, source, donor, CASE WHEN source IS NULL THEN 'no_source' WHEN donor IS NULL THEN 'no_donor' END AS exclusion
FROM h LEFT JOIN s USING (o_orderkey) LEFT JOIN d ON h.o_orderpriority = d.o_orderpriority AND h.o_orderstatus = d.o_orderstatus""")
def _(s, d):
    t = typed_orders(s, d)
    return cd.hidden_probes(t.where("o_orderkey % 10 = 0"), t.where("o_orderkey % 10 > 0"), SCHEMA, SCHEMA.condition)


@query("reference_donors", f"""
WITH {T}, r AS (SELECT n_name, c_mktsegment, min(o_orderkey) AS reference FROM t GROUP BY 1, 2)
SELECT t.o_orderkey, r.reference, CAST(t.o_orderpriority <> x.o_orderpriority AS INT) + CAST(t.o_orderstatus <> x.o_orderstatus AS INT) AS n_changed
FROM t JOIN r USING (n_name, c_mktsegment) JOIN t x ON x.o_orderkey = r.reference""")
def _(s, d):
    return cd.reference_donors(typed_orders(s, d), SCHEMA)


@query("mixup_pairs", """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v, label, row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings)
SELECT a.vec_id, b.vec_id AS partner, CAST(0.25 * a.label + 0.75 * b.label AS DOUBLE) AS label, round(0.25 * a.v[1] + 0.75 * b.v[1], 6) AS first,
  round(0.25 * list_sum(list_transform(a.v, lambda x: x * x)) + 0.75 * list_inner_product(a.v, b.v), 6) AS along FROM r a JOIN r b ON b.r = (a.r + 1) % a.n""")
def _(s, d):
    e = read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("label"))
    m = cd.mixup(e, "vec_id", "v", "label", 2, 0.25).join(e.select("vec_id", F.col("v").alias("own")), "vec_id")
    return m.select("vec_id", "partner", "label", F.round(F.col("v")[0], 6).alias("first"), F.round(sm.inner("v", "own"), 6).alias("along"))


@query("latent_interpolation", f"""
WITH {_E}, p AS (SELECT a.id AS query, b.id AS neighbour, {_COS} AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place FROM p)
SELECT query, neighbour, round((a.v[1] + b.v[1]) / 2, 6) AS first, round((list_inner_product(a.v, a.v) + list_inner_product(a.v, b.v)) / 2, 6) AS along
FROM r JOIN e a ON a.id = query JOIN e b ON b.id = neighbour WHERE place <= 2""")
def _(s, d):
    e = _vectors(s, d).withColumn("vec", F.col("vec").cast("array<double>"))
    near = sm.dense_topk(e.where("id % 20 = 0"), e, 2).select("query", "neighbour")
    z = cd.interpolate(near, e, 0.5).join(e.select(F.col("id").alias("query"), F.col("vec").alias("own")), "query")
    return z.select("query", "neighbour", F.round(F.col("vec")[0], 6).alias("first"), F.round(sm.inner("vec", "own"), 6).alias("along"))


@query("stratified_oversampling", f"""
WITH {T}, r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('6:' || o_orderkey), o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM t),
k AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS s, count(*) OVER () AS k FROM (SELECT DISTINCT o_orderstatus FROM t)),
q AS (SELECT o_orderkey, r, n, (1000 - 1 - s) // k + 1 AS take FROM r JOIN k USING (o_orderstatus))
SELECT o_orderkey, 0 AS copy FROM t UNION ALL SELECT o_orderkey, unnest(range(1, (take - 1 - r) // n + 2)) FROM q WHERE r < take""")
def _(s, d):
    t = typed_orders(s, d).select("o_orderkey", "o_orderstatus")
    return cd.resample(t, "o_orderkey", "stratified", 1000, 6, "o_orderstatus").select("o_orderkey", "copy")


@query("strata_weights", f"""
WITH {T} SELECT n_name, count(*) AS n_stratum, 1 + 1000.0::DOUBLE / (SELECT count(DISTINCT n_name) FROM t) / count(*) AS weight FROM t GROUP BY 1""")
def _(s, d):
    return cd.strata_weights(typed_orders(s, d), "n_name", 1000)


# ---- audit

_AUDIT = f"""{T}, b AS (SELECT o_orderkey AS id, n_name || c_mktsegment || o_orderpriority AS k, n_name || c_mktsegment || (o_orderkey % 3) AS f,
  CASE WHEN o_orderkey % 13 = 0 THEN 'invalid' WHEN o_orderkey % 17 = 0 THEN 'source_identical' END AS reason FROM t),
w AS (SELECT f, min(id) AS wid, arg_min(k, id) AS wk FROM b WHERE reason IS NULL GROUP BY f), m AS (SELECT wk, min(wid) AS kid FROM w GROUP BY wk),
a AS (SELECT id, b.k, b.f, coalesce(reason, CASE WHEN id <> wid THEN CASE WHEN k = w.wk THEN 'duplicate_synthetic' ELSE 'feature_duplicate_synthetic' END END) AS reason,
  coalesce(kid < id, false) AS is_duplicate, coalesce(wid < id, false) AS is_feature_duplicate FROM b LEFT JOIN w ON b.f = w.f LEFT JOIN m ON b.k = m.wk)"""


def _audit(s, d):
    k = F.col("o_orderkey")
    b = typed_orders(s, d).select(k.alias("id"), F.concat("n_name", "c_mktsegment", "o_orderpriority").alias("k"), F.concat("n_name", "c_mktsegment", (k % 3).cast("string")).alias("f"))
    b = b.withColumn("reason", au.first_reason([("invalid", F.col("id") % 13 == 0), ("source_identical", F.col("id") % 17 == 0)]))
    return au.dedup(b, "k", "f", "id")


@query("candidate_audit", f"WITH {_AUDIT} SELECT id, reason, is_duplicate, is_feature_duplicate FROM a")
def _(s, d):
    return _audit(s, d).select("id", "reason", "is_duplicate", "is_feature_duplicate")


@query("pool_accounting", f"""
WITH {_AUDIT} SELECT id % 2 AS arm, count(*) AS generated, count(*) FILTER (reason IS NULL) AS accepted, count(DISTINCT CASE WHEN reason IS NULL THEN k END) AS unique_accepted,
  count(*) FILTER (reason IS NULL) AS selected, count(*) FILTER (reason = 'invalid') AS n_invalid, count(*) FILTER (reason = 'duplicate_synthetic') AS n_duplicate_synthetic,
  count(*) FILTER (reason NOT IN ('invalid', 'duplicate_synthetic')) AS n_other FROM a GROUP BY 1""")
def _(s, d):
    return au.accounting(_audit(s, d).withColumn("arm", F.col("id") % 2), ["arm"], "k", ["invalid", "duplicate_synthetic"])


@query("scope_audit", f"""
WITH {T}, x AS (SELECT o_orderkey, n_name || o_orderstatus || c_mktsegment AS k FROM t), o AS (SELECT DISTINCT k FROM x WHERE o_orderkey % 1000 = 1), m AS (SELECT DISTINCT k FROM x WHERE o_orderkey % 500 = 3)
SELECT o_orderkey, CASE WHEN k IN (FROM o) THEN 'observed_in_labeled_train' WHEN k IN (FROM m) THEN 'already_measured' END AS scope_reason FROM x""")
def _(s, d):
    x = typed_orders(s, d).select("o_orderkey", F.concat("n_name", "o_orderstatus", "c_mktsegment").alias("k"))
    return au.scope(x, "k", x.where("o_orderkey % 1000 = 1").select("k"), x.where("o_orderkey % 500 = 3").select("k")).select("o_orderkey", "scope_reason")


@query("scope_comparison", f"""
WITH {T} SELECT n_name, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS ratio FROM t GROUP BY 1""")
def _(s, d):
    t = typed_orders(s, d).groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"))
    return au.scope_comparison(t, ["n_name"], "o_orderstatus", "n", "F", "O")


@query("role_changes", f"""
WITH {T}, r AS (SELECT n_name, c_mktsegment, min(o_orderkey) AS k FROM t GROUP BY 1, 2),
j AS (SELECT t.*, x.o_orderpriority AS sp, x.o_orderstatus AS ss FROM t JOIN r USING (n_name, c_mktsegment) JOIN t x ON x.o_orderkey = r.k)
SELECT o_orderkey, concat_ws(',', CASE WHEN sp <> o_orderpriority THEN 'o_orderpriority' END, CASE WHEN ss <> o_orderstatus THEN 'o_orderstatus' END) AS changed_roles,
  CASE WHEN sp <> o_orderpriority THEN '' ELSE 'o_orderpriority' END AS unchanged_requested, CASE WHEN ss <> o_orderstatus THEN 'o_orderstatus' ELSE '' END AS unexpected_roles,
  CAST(CAST(sp <> o_orderpriority AS INT) AS VARCHAR) || CAST(ss <> o_orderstatus AS INT) AS role_mask FROM j""")
def _(s, d):
    t = typed_orders(s, d)
    r = t.groupBy("n_name", "c_mktsegment").agg(F.min(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus")).alias("x"))
    j = t.join(r, ["n_name", "c_mktsegment"]).withColumns({"s_o_orderpriority": F.col("x.o_orderpriority"), "s_o_orderstatus": F.col("x.o_orderstatus")})
    c = au.role_changes(["o_orderpriority", "o_orderstatus"], ["o_orderpriority"])
    return j.withColumns(c).select("o_orderkey", "changed_roles", "unchanged_requested", "unexpected_roles", "role_mask")


@query("invariant_violations", f"WITH {_AUDIT} SELECT id, 'small' AS broken FROM a WHERE reason IS NULL AND id % 100 = 7")
def _(s, d):
    return au.invariant_violations(_audit(s, d), {"small": F.col("id") % 100 != 7, "known": F.col("k").isNotNull()}, "id")


@query("augmentation_audit", f"""
WITH {T} SELECT count(*) FILTER (o_orderkey % 3 = 0) AS n_real, min(y) FILTER (o_orderkey % 3 = 0) AS real_min, max(y) FILTER (o_orderkey % 3 = 0) AS real_max,
  count(*) FILTER (o_orderkey % 3 = 1) AS n_synthetic, min(y) FILTER (o_orderkey % 3 = 1) AS synthetic_min, max(y) FILTER (o_orderkey % 3 = 1) AS synthetic_max, 0 AS n_leaked FROM t""")
def _(s, d):
    t = typed_orders(s, d)
    return au.augmentation_audit(t.where("o_orderkey % 3 = 0"), t.where("o_orderkey % 3 = 1"), t.where("o_orderkey % 3 = 2"), "o_orderkey", "y")


# ---- labels


@query("teacher_ensemble", """
WITH p AS (SELECT l_orderkey AS c, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem)
SELECT c, CAST(sum(p) AS DOUBLE) / count(p) AS mean, sqrt(CAST(CAST(count(*) AS HUGEINT) * sum(CAST(p AS HUGEINT) * p) - CAST(sum(p) AS HUGEINT) * sum(p) AS DOUBLE)) / count(*) AS std, min(p) AS min, max(p) AS max, max(p) - min(p) AS range FROM p GROUP BY c""")
def _(s, d):
    return lb.ensemble(read(s, d, "lineitem").select(F.col("l_orderkey").alias("c"), F.floor("l_extendedprice").cast("long").alias("p")), "c", "p")


@query("label_strategies", f"""
WITH {T} SELECT o_orderkey, CAST(greatest(0.0, least(300000.0, p)) AS DOUBLE) AS teacher, CAST(greatest(0.0, least(300000.0, (y + p) / 2)) AS DOUBLE) AS average FROM t""")
def _(s, d):
    a = lambda k: lb.label(k, F.col("p"), F.col("y"), F.col("p"), 0.0, 300000.0).cast("double")
    return typed_orders(s, d).select("o_orderkey", a("teacher").alias("teacher"), a("average").alias("average"))


@query("sample_weights", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1.0 ELSE greatest(0.2, least(0.9, coalesce(CASE WHEN l_linenumber < 5 THEN l_quantity / 50 END, 0.2))) END AS w FROM lineitem")
def _(s, d):
    n = F.col("l_linenumber")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", lb.sample_weight(n == 1, F.when(n < 5, F.col("l_quantity") / 50), 0.2, 0.9).alias("w"))


@query("outcome_strata", f"""
WITH {T}, e AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c FROM t)
SELECT CAST(y > a AS INT) + CAST(y > b AS INT) + CAST(y > c AS INT) AS stratum, count(*) AS n FROM t, e GROUP BY 1""")
def _(s, d):
    return lb.strata(typed_orders(s, d), "y", [0.25, 0.5, 0.75]).groupBy("stratum").agg(F.count("*").alias("n"))


@query("conformal_quantile", f"""
WITH {T}, r AS (SELECT n_name, abs(y - p) AS s, row_number() OVER (PARTITION BY n_name ORDER BY abs(y - p)) AS k, count(*) OVER (PARTITION BY n_name) AS n FROM t)
SELECT n_name, n, s AS quantile FROM r WHERE k = least(n, ceil((n + 1) * 0.9))""")
def _(s, d):
    return lb.conformal_quantile(typed_orders(s, d).withColumn("s", F.abs(F.col("y") - F.col("p"))), ["n_name"], "s", 0.9)


@query("ridge_fit_predict", """
WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS a, sum(l_discount) AS b, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab,
  sum(l_discount * l_discount) AS bb, sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS yb FROM lineitem),
c AS (SELECT *, aa - a * a / n + 1 AS p, ab - a * b / n AS q, bb - b * b / n + 1 AS r, ay - a * y / n AS u, yb - b * y / n AS v FROM m),
w AS (SELECT *, (r * u - q * v) / (p * r - q * q) AS wa, (p * v - q * u) / (p * r - q * q) AS wb FROM c)
SELECT l_orderkey, l_linenumber, round((y - wa * a - wb * b) / n + wa * l_quantity + wb * l_discount, 1) AS prediction FROM lineitem, w""")
def _(s, d):
    x = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    return lb.predict(x, lb.ridge(x, ["l_quantity", "l_discount"], "l_extendedprice", 1.0)).select("l_orderkey", "l_linenumber", F.round("prediction", 1).alias("prediction"))


@query("split_conformal_intervals", """
WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_extendedprice AS y FROM lineitem),
f AS (SELECT *, CAST(CAST('0x' || substr(sha256('1:' || id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 < 0.5 AS fit FROM x),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(q) AS a, sum(y) AS s, sum(q * q) AS aa, sum(q * y) AS ay FROM f WHERE fit),
w AS (SELECT n, a, s, (ay - a * s / n) / (aa - a * a / n + 1) AS w FROM m), p AS (SELECT id, fit, y, (s - w * a) / n + w * q AS prediction FROM f, w),
r AS (SELECT abs(y - prediction) AS e, row_number() OVER (ORDER BY abs(y - prediction)) AS k, count(*) OVER () AS n FROM p WHERE NOT fit),
h AS (SELECT e FROM r WHERE k = least(n, ceil((n + 1) * 0.9)))
SELECT id, round(prediction, 1) AS prediction, round(prediction - e, 1) AS low, round(prediction + e, 1) AS high FROM p, h""")
def _(s, d):
    x = sp.calibration_part(read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice"), "id", 1, 0.5)
    out = lb.split_conformal(x, "part", ["l_quantity"], "l_extendedprice", 1.0, 0.9)
    return out.select("id", *[F.round(c, 1).alias(c) for c in ("prediction", "low", "high")])


@query("low_rank_projection")
def _(s, d):
    return lb.low_rank(_vectors(s, d), "vec", 3).select("id", "projection")


# ---- metrics

_VAR = lambda a, b: f"CAST(CAST(count(*) AS HUGEINT) * sum(CAST({a} AS HUGEINT) * {b}) - CAST(sum({a}) AS HUGEINT) * sum({b}) AS DOUBLE)"


def _reg(y, p):
    return f"""count(*) AS n, sqrt(CAST(sum(CAST({y} - {p} AS HUGEINT) * ({y} - {p})) AS DOUBLE) / count(*)) AS rmse, CAST(sum(abs({y} - {p})) AS DOUBLE) / count(*) AS mae,
  1 - CAST(sum(CAST({y} - {p} AS HUGEINT) * ({y} - {p})) AS DOUBLE) * count(*) / nullif({_VAR(y, y)}, 0) AS r2, {_VAR(y, p)} / nullif(sqrt({_VAR(y, y)}) * sqrt({_VAR(p, p)}), 0) AS pearson"""


@query("regression_metrics", f"WITH {T} SELECT n_name, {_reg('y', 'p')} FROM t GROUP BY 1")
def _(s, d):
    return mt.regression(typed_orders(s, d), ["n_name"], "y", "p")


@query("spearman", f"""
WITH {T}, r AS (SELECT n_name, 2 * rank() OVER (PARTITION BY n_name ORDER BY y) + count(*) OVER (PARTITION BY n_name, y) - 1 AS a, 2 * rank() OVER (PARTITION BY n_name ORDER BY p) + count(*) OVER (PARTITION BY n_name, p) - 1 AS b FROM t)
SELECT n_name, count(*) AS n, {_VAR('a', 'b')} / nullif(sqrt({_VAR('a', 'a')}) * sqrt({_VAR('b', 'b')}), 0) AS spearman FROM r GROUP BY 1""")
def _(s, d):
    return mt.spearman(typed_orders(s, d), ["n_name"], "y", "p")


@query("topk_metrics", f"""
WITH {T}, r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY p DESC, o_orderkey) AS rn FROM t)
SELECT n_name, count(*) AS n, count(*) FILTER (rn <= 10 AND y >= 400000) / count(*) FILTER (rn <= 10) AS hit_rate, CAST(sum(y) FILTER (rn <= 10) AS DOUBLE) / count(*) FILTER (rn <= 10) AS topk_mean,
  CAST(min(rn) FILTER (y >= 400000) AS INT) AS first_hit, max(y) - max(y) FILTER (rn <= 10) AS regret FROM r GROUP BY 1""")
def _(s, d):
    return mt.topk(typed_orders(s, d), ["n_name"], "y", "p", "o_orderkey", 10, 400000)


@query("candidate_ranking", f"""
WITH {T} SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY n_name ORDER BY CASE WHEN o_orderkey % 5 > 0 THEN p % 10 END ASC NULLS LAST, y % 7 DESC, p % 11 DESC, y % 3 DESC, CAST(o_orderkey AS VARCHAR)) AS INT) AS place FROM t""")
def _(s, d):
    from pyspark.sql import Window

    t = typed_orders(s, d).withColumns({"u": F.when(F.col("o_orderkey") % 5 > 0, F.col("p") % 10), "c": F.col("y") % 7, "v": F.col("p") % 11, "w": F.col("y") % 3})
    order = mt.candidate_order("u", "c", "v", "w", ["o_orderkey"])
    return t.select("o_orderkey", F.row_number().over(Window.partitionBy("n_name").orderBy(*order)).alias("place"))


@query("policy_select", f"""
WITH {T}, m AS (SELECT c_mktsegment, n_name, CAST(sum(abs(y - p)) AS DOUBLE) / count(*) AS mae FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY mae, sha256(n_name), n_name) AS k FROM m)
SELECT c_mktsegment, n_name, mae FROM r WHERE k = 1""")
def _(s, d):
    m = mt.regression(typed_orders(s, d), ["c_mktsegment", "n_name"], "y", "p").withColumn("h", F.sha2("n_name", 256))
    return pr.search(m, ["c_mktsegment"], "mae", "h", "n_name").select("c_mktsegment", "n_name", "mae")


@query("metric_summary", f"""
WITH {T} SELECT n_name, CAST(sum(y) AS DOUBLE) / count(y) AS mean, quantile_cont(y, 0.5) AS median, sqrt({_VAR('y', 'y')} / nullif(CAST(count(*) * (count(*) - 1) AS DOUBLE), 0)) AS std, count(y) AS n FROM t GROUP BY 1""")
def _(s, d):
    return mt.summary(typed_orders(s, d), ["n_name"], "y")


@query("paired_deltas", f"""
WITH {T}, m AS (SELECT n_name, o_orderstatus, max(y) AS v FROM t GROUP BY 1, 2), c AS (SELECT n_name, v AS control_value FROM m WHERE o_orderstatus = 'F')
SELECT n_name, o_orderstatus, v, control_value, v - control_value AS delta, v - control_value > 0 AS improved FROM m LEFT JOIN c USING (n_name) WHERE o_orderstatus <> 'F'""")
def _(s, d):
    m = typed_orders(s, d).groupBy("n_name", "o_orderstatus").agg(F.max("y").alias("v"))
    return mt.paired_deltas(m, ["n_name"], "o_orderstatus", "F", "v", True)


@query("delta_summary", f"""
WITH {T}, m AS (SELECT n_name, o_orderstatus, max(y) AS v FROM t GROUP BY 1, 2), c AS (SELECT n_name, v AS cv FROM m WHERE o_orderstatus = 'F'), x AS (SELECT o_orderstatus, v - cv AS d FROM m LEFT JOIN c USING (n_name) WHERE o_orderstatus <> 'F')
SELECT o_orderstatus, count(d) AS n_pairs, CAST(sum(d) AS DOUBLE) / count(d) AS mean_delta, count(*) FILTER (d > 0) AS n_improved FROM x GROUP BY 1""")
def _(s, d):
    return mt.delta_summary(Q["paired_deltas"][0](s, d), ["o_orderstatus"])


@query("best_parent", f"""
WITH {T}, a AS (SELECT n_name, min(y) AS v FROM t GROUP BY 1), b AS (SELECT n_name, min(p) AS v FROM t GROUP BY 1)
SELECT n_name, CASE WHEN a.v <= b.v THEN 'first' ELSE 'second' END AS parent, least(a.v, b.v) AS v FROM a JOIN b USING (n_name)""")
def _(s, d):
    t = typed_orders(s, d)
    return mt.best_parent(t.groupBy("n_name").agg(F.min("y").alias("v")), t.groupBy("n_name").agg(F.min("p").alias("v")), ["n_name"], "v")


@query("pivot_summary", f"WITH {T} SELECT n_name, max(y) FILTER (o_orderstatus = 'F') AS F, max(y) FILTER (o_orderstatus = 'O') AS O, max(y) FILTER (o_orderstatus = 'P') AS P FROM t GROUP BY 1")
def _(s, d):
    m = typed_orders(s, d).groupBy("n_name", "o_orderstatus").agg(F.max("y").alias("v"))
    return mt.pivot(m, ["n_name"], "o_orderstatus", ["F", "O", "P"], "v")


@query("inner_ood_aggregate", f"""
WITH {T}, g AS (SELECT o_orderstatus, n_name, count(*) AS w, max(y) AS v FROM t GROUP BY 1, 2)
SELECT o_orderstatus, CAST(sum(v) AS DOUBLE) / count(v) AS group_weighted, CAST(sum(v * w) AS DOUBLE) / sum(w) AS sample_weighted, count(*) AS n_groups FROM g GROUP BY 1""")
def _(s, d):
    g = typed_orders(s, d).groupBy("o_orderstatus", "n_name").agg(F.count("*").alias("w"), F.max("y").alias("v"))
    return mt.group_and_sample_weighted(g, ["o_orderstatus"], "w", "v")


@query("interval_metrics", f"""
WITH {T} SELECT n_name, count(*) AS n, count(*) FILTER (y BETWEEN p - 20000 AND p + 20000 + o_orderkey % 9) / count(*) AS coverage, CAST(sum(40000 + o_orderkey % 9) AS DOUBLE) / count(*) AS mean_width,
  quantile_cont(40000 + o_orderkey % 9, 0.5) AS median_width, abs(count(*) FILTER (y BETWEEN p - 20000 AND p + 20000 + o_orderkey % 9) / count(*) - CAST(0.9 AS DOUBLE)) AS calibration_error FROM t GROUP BY 1""")
def _(s, d):
    t = typed_orders(s, d).withColumns({"low": F.col("p") - 20000, "high": F.col("p") + 20000 + F.col("o_orderkey") % 9})
    return mt.intervals(t, ["n_name"], "y", "low", "high", 0.9)


@query("selective_curve", f"""
WITH {T}, g AS (SELECT p // 1000 AS s, count(*) AS c, sum(CAST(y - p AS HUGEINT) * (y - p)) AS s2, sum(abs(y - p)) AS s1, sum(y) AS s0 FROM t GROUP BY 1),
w AS (SELECT s, CAST(sum(c) OVER (ORDER BY s) AS BIGINT) AS n, sum(s2) OVER (ORDER BY s) AS s2, sum(s1) OVER (ORDER BY s) AS s1, sum(s0) OVER (ORDER BY s) AS s0 FROM g)
SELECT s AS cutoff, n, sqrt(CAST(s2 AS DOUBLE) / n) AS rmse, CAST(s1 AS DOUBLE) / n AS mae, CAST(s0 AS DOUBLE) / n AS mean FROM w""")
def _(s, d):
    t = typed_orders(s, d).withColumn("s", F.expr("p div 1000"))
    return mt.selective_curve(t, [], "s", "y", "p")


@query("tertile_strata", f"""
WITH {T}, e AS (SELECT quantile_cont(y, 1/3) AS a, quantile_cont(y, 2/3) AS b FROM t)
SELECT CASE WHEN y <= a THEN 'low' WHEN y <= b THEN 'medium' ELSE 'high' END AS tertile, count(*) AS n FROM t, e GROUP BY 1""")
def _(s, d):
    return mt.tertiles(typed_orders(s, d), "y").groupBy("tertile").agg(F.count("*").alias("n"))


@query("stratified_errors", f"""
WITH {T}, x AS (SELECT n_name AS target, y, p, 'priority' AS dimension, o_orderpriority AS stratum FROM t UNION ALL SELECT n_name, y, p, 'status', o_orderstatus FROM t),
o AS (SELECT dimension, stratum, target, min(struct_pack(y := y, p := p)) AS v, count(*) AS c FROM x GROUP BY 1, 2, 3)
SELECT dimension, stratum, count(*) AS n_targets, CAST(sum(c - 1) AS BIGINT) AS n_duplicates, CAST(sum(abs(v.y - v.p)) AS DOUBLE) / count(*) AS mae FROM o GROUP BY 1, 2""")
def _(s, d):
    t = typed_orders(s, d).withColumnsRenamed({"o_orderpriority": "priority", "o_orderstatus": "status"})
    return mt.stratified_errors(t, ["priority", "status"], "n_name", "y", "p")


@query("oracle_diagnostic", f"""
WITH {T}, g AS (SELECT n_name, c_mktsegment, CAST(sum(y) AS DOUBLE) / count(y) AS y, CAST(sum(p) AS DOUBLE) / count(p) AS p FROM t GROUP BY 1, 2),
k AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(abs(p - y)) AS e, sum(p - y) AS b, sum((p - y) * (p - y)) AS q, CAST(count(*) FILTER (y >= 250000) AS DOUBLE) AS h, CAST(count(*) FILTER (p >= 250000) AS DOUBLE) AS s, CAST(count(*) FILTER (y >= 250000 AND p >= 250000) AS DOUBLE) AS t FROM g)
SELECT CAST(n AS BIGINT) AS n, round(e / n, 6) AS mae, round(b / n, 6) AS bias, round(sqrt(q / n), 6) AS rmse, h / n AS prevalence, t / nullif(s, 0) AS precision, t / nullif(h, 0) AS recall, t / nullif(s, 0) / nullif(h / n, 0) AS enrichment FROM k""")
def _(s, d):
    t = typed_orders(s, d).withColumn("cell", F.concat_ws("|", "n_name", "c_mktsegment"))
    out = mt.oracle_diagnostic(t, t, "cell", "p", "y", 250000)
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "bias", "rmse")})


@query("support_summary", f"""
WITH {T} SELECT n_name, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'mixed' ELSE min(o_orderstatus) END AS metric, count(*) AS n, min(y) AS min_distance, quantile_cont(y, 0.5) AS median_distance, max(y) AS max_distance FROM t GROUP BY 1""")
def _(s, d):
    return mt.support_summary(typed_orders(s, d), ["n_name"], "o_orderstatus", "y")


@query("campaign_trajectory", f"""
WITH {T}, f AS (SELECT n_name, yr, count(*) AS new FROM (SELECT n_name, c_mktsegment || o_orderpriority AS k, min(yr) AS yr FROM t GROUP BY 1, 2) GROUP BY 1, 2),
g AS (SELECT n_name, yr, count(*) AS n, max(y) AS b, sum(y) AS s, count(*) FILTER (y >= 400000) AS h FROM t GROUP BY 1, 2),
w AS (SELECT n_name, yr, n, sum(n) OVER x AS cum_n, max(b) OVER x AS cum_best, 600000 - max(b) OVER x AS simple_regret, CAST(sum(s) OVER x AS DOUBLE) / sum(n) OVER x AS cum_mean, sum(h) OVER x AS cum_hits, sum(coalesce(new, 0)) OVER x AS cum_keys
  FROM g LEFT JOIN f USING (n_name, yr) WINDOW x AS (PARTITION BY n_name ORDER BY yr))
SELECT *, sum(simple_regret) OVER (PARTITION BY n_name ORDER BY yr) AS cum_regret FROM w""")
def _(s, d):
    t = typed_orders(s, d).withColumn("k", F.concat("c_mktsegment", "o_orderpriority"))
    return mt.trajectory(t, ["n_name"], "yr", "y", "k", F.lit(600000).cast("long"), 400000)


@query("random_distribution", f"""
WITH {T} SELECT n_name, count(*) AS n, CAST(sum(y) AS DOUBLE) / count(*) AS mean, CASE WHEN count(*) = 1 THEN 0.0 ELSE sqrt({_VAR('y', 'y')} / nullif(CAST(count(*) * (count(*) - 1) AS DOUBLE), 0)) END AS std, min(y) AS min,
  quantile_cont(y, 0.05) AS p05, quantile_cont(y, 0.25) AS p25, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS p75, quantile_cont(y, 0.95) AS p95, max(y) AS max FROM t GROUP BY 1""")
def _(s, d):
    return mt.random_distribution(typed_orders(s, d), ["n_name"], "y")


@query("midrank_percentile", f"""
WITH {T}, a AS (SELECT n_name, o_orderstatus, CAST(max(y) // 2 AS BIGINT) AS v FROM t GROUP BY 1, 2), r AS (SELECT n_name, y AS r FROM t)
SELECT n_name, o_orderstatus, v, count(*) AS n_random, 50 * (2 * count(*) FILTER (r < v) + count(*) FILTER (r = v)) / count(*) AS percentile,
  v - CAST(sum(r) AS DOUBLE) / count(*) AS advantage, (v - CAST(sum(r) AS DOUBLE) / count(*)) / sqrt({_VAR('r', 'r')} / CAST(count(*) * (count(*) - 1) AS DOUBLE)) AS z
FROM a JOIN r USING (n_name) GROUP BY 1, 2, 3""")
def _(s, d):
    t = typed_orders(s, d)
    a = t.groupBy("n_name", "o_orderstatus").agg(F.expr("max(y) div 2").alias("v"))
    return mt.midrank_percentile(a, t.select("n_name", F.col("y").alias("v")), ["n_name"], "v")


@query("bootstrap_ci", f"""
WITH {T}, g AS (SELECT n_name, CAST(sum(p - y) AS DOUBLE) / count(*) AS x FROM t GROUP BY n_name, yr),
o AS (SELECT n_name, x, row_number() OVER (PARTITION BY n_name ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY n_name) AS n FROM g),
k AS (SELECT DISTINCT n_name, n FROM o),
d AS (SELECT n_name, k, CAST(floor(CAST(CAST('0x' || substr(sha256('1:' || n_name || ':' || k || ':' || j), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 * n) AS BIGINT) AS r FROM k, range(500) a(k), range(n) b(j)),
m AS (SELECT n_name, k, sum(x) / any_value(n) AS m FROM d JOIN o USING (n_name, r) GROUP BY 1, 2),
q AS (SELECT n_name, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT n_name, n, round(mean, 3) AS mean, round(low, 3) AS low, round(high, 3) AS high FROM (SELECT n_name, count(*) AS n, sum(x) / count(*) AS mean FROM g GROUP BY 1) JOIN q USING (n_name)""")
def _(s, d):
    g = typed_orders(s, d).groupBy("n_name", "yr").agg((F.sum(F.col("p") - F.col("y")) / F.count("*")).alias("delta"))
    return mt.bootstrap_ci(g, ["n_name"], "delta", 500, 1).select("n_name", "n", *[F.round(c, 3).alias(c) for c in ("mean", "low", "high")])


@query("verdict_table", f"""
WITH {T}, g AS (SELECT n_name, min(p - y) AS lo, max(p - y) AS hi, count(*) FILTER (p < y) AS k, count(*) AS n FROM t GROUP BY 1)
SELECT n_name, CASE WHEN n < 500 THEN 'degenerate_pool' WHEN lo > 0 THEN 'improves' WHEN hi < 0 THEN 'worsens' WHEN k * 2 >= n THEN 'leans_better' ELSE 'leans_worse' END AS verdict FROM g""")
def _(s, d):
    e = F.col("p") - F.col("y")
    g = typed_orders(s, d).groupBy("n_name").agg(F.min(e).alias("lo"), F.max(e).alias("hi"), F.count_if(e < 0).alias("k"), F.count("*").alias("n"))
    return g.select("n_name", mt.verdict(F.col("lo"), F.col("hi"), F.col("k"), F.col("n"), F.col("n") < 500).alias("verdict"))


@query("signed_rank", f"""
WITH RECURSIVE {T}, g AS (SELECT n_name, CAST(max(p) - max(y) AS DOUBLE) AS x FROM t GROUP BY n_name, yr),
a AS (SELECT n_name, count(*) AS n, CAST(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) AS DOUBLE) AS t FROM g GROUP BY 1),
r AS (SELECT n_name, x, 2 * rank() OVER (PARTITION BY n_name ORDER BY abs(x)) + count(*) OVER (PARTITION BY n_name, abs(x)) - 1 AS r, row_number() OVER (PARTITION BY n_name ORDER BY abs(x), x) AS k FROM g WHERE abs(x) > 1e-12),
w AS (SELECT n_name, CAST(coalesce(sum(r) FILTER (x > 0), 0) AS BIGINT) AS w, count(*) AS m FROM r GROUP BY 1),
s AS (SELECT n_name, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS v, CAST(1 AS DOUBLE) AS ways FROM w
  UNION ALL SELECT n_name, k, v, sum(ways) FROM (SELECT s.n_name, r.k, s.v + r.r * b AS v, s.ways FROM s JOIN r ON r.n_name = s.n_name AND r.k = s.k + 1, (SELECT unnest([0, 1]) AS b)) GROUP BY 1, 2, 3),
p AS (SELECT n_name, least(1.0, 2 * least(sum(ways) FILTER (v <= w), sum(ways) FILTER (v >= w)) / sum(ways)) AS p FROM s JOIN w USING (n_name) WHERE k = m GROUP BY 1)
SELECT a.n_name, a.n AS n_pairs, CAST(w.w AS DOUBLE) / 2 AS w_plus, round(p.p, 9) AS p_value, round(a.t, 6) AS t FROM a LEFT JOIN w USING (n_name) LEFT JOIN p USING (n_name)""")
def _(s, d):
    g = typed_orders(s, d).groupBy("n_name", "yr").agg((F.max("p") - F.max("y")).alias("delta"))
    return mt.signed_rank(g, ["n_name"], "delta").withColumns({"p_value": F.round("p_value", 9), "t": F.round("t", 6)})


@query("sharing_counts", f"""
WITH {T} SELECT o_orderkey, count(*) OVER (PARTITION BY n_name || c_mktsegment) AS n_same_cell, count(*) OVER (PARTITION BY o_orderpriority) AS n_same_o_orderpriority FROM t""")
def _(s, d):
    t = typed_orders(s, d).withColumn("cell", F.concat("n_name", "c_mktsegment"))
    return mt.sharing_counts(t, "cell", ["o_orderpriority"], "o_orderkey")


@query("strided_controls", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer), k AS (SELECT unnest(range(0, 16)) AS i)
SELECT DISTINCT c_custkey FROM r JOIN k ON r.r = round_even(i * (n - 1) / 15, 0)""")
def _(s, d):
    return mt.strided(read(s, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 16).select("c_custkey")


@query("reconcile_outer", """
WITH a AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), b AS (SELECT l_orderkey AS k, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1)
SELECT k, a.v AS left_value, b.v AS right_value, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN abs(a.v - b.v) <= 1e-8 THEN 'equal' ELSE 'differs' END AS status FROM a FULL JOIN b USING (k)""")
def _(s, d):
    a = read(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("v"))
    b = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("v"))
    return mt.reconcile(a, b, ["k"], "v")


@query("effect_counts", f"WITH {T} SELECT n_name, CASE WHEN p > y THEN 'helped' WHEN p < y THEN 'hurt' ELSE 'neutral' END AS effect, count(*) AS n FROM t GROUP BY 1, 2")
def _(s, d):
    return mt.effects(typed_orders(s, d).withColumn("delta", F.col("p") - F.col("y")), ["n_name"], "delta")


# ---- acquisition


@query("ucb_topk", f"WITH {T} SELECT o_orderkey, CAST(p + 2 * (o_orderkey % 100) AS DOUBLE) AS score FROM t ORDER BY 2 DESC, 1 LIMIT 50")
def _(s, d):
    t = typed_orders(s, d)
    return aq.top(t, aq.ucb(F.col("p"), F.col("o_orderkey") % 100, 2).cast("double"), "o_orderkey", 50).select("o_orderkey", "score")


@query("random_batch", "SELECT o_orderkey FROM orders ORDER BY sha256('9:' || o_orderkey), o_orderkey LIMIT 32")
def _(s, d):
    return aq.random_batch(read(s, d, "orders"), "o_orderkey", 9, 32).select("o_orderkey")


@query("expected_improvement", f"""
WITH {T}, x AS (SELECT o_orderkey, CAST(p AS DOUBLE) - 450000 AS gap, greatest((o_orderkey % 100 + 1000.0::DOUBLE) / 1.6448536269514722::DOUBLE, 1e-9) AS s FROM t),
z AS (SELECT *, gap / s AS z, gap / s / sqrt(2.0::DOUBLE) AS x FROM x), k AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS k FROM z),
e AS (SELECT *, sign(x) * (1 - k * (0.254829592::DOUBLE + k * (-0.284496736::DOUBLE + k * (1.421413741::DOUBLE + k * (-1.453152027::DOUBLE + k * 1.061405429::DOUBLE)))) * exp(-x * x)) AS erf FROM k)
SELECT o_orderkey, round(gap * (1 + erf) / 2 + s * exp(-z * z / 2) / sqrt(2 * pi()), 4) AS score FROM e ORDER BY score DESC, o_orderkey LIMIT 50""")
def _(s, d):
    t = typed_orders(s, d)
    return aq.top(t, F.round(aq.expected_improvement(F.col("p").cast("double"), F.col("o_orderkey") % 100 + 1000.0, F.lit(450000.0)), 4), "o_orderkey", 50).select("o_orderkey", "score")


@query("thompson_topk", f"""
WITH {T}, u AS (SELECT o_orderkey, p, greatest(CAST(CAST('0x' || substr(sha256('3:u:' || o_orderkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0, 1e-12) AS u,
  CAST(CAST('0x' || substr(sha256('3:v:' || o_orderkey), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS v FROM t)
SELECT o_orderkey, round(p + 5000 * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 4) AS score FROM u ORDER BY score DESC, o_orderkey LIMIT 50""")
def _(s, d):
    t = typed_orders(s, d)
    return aq.top(t, F.round(aq.thompson(F.col("p").cast("double"), F.lit(5000.0), 3, F.col("o_orderkey")), 4), "o_orderkey", 50).select("o_orderkey", "score")


def _picks(policies: str, k: int) -> str:
    """Step by step: a pick of each policy and label, and the pool without it with raised similarities."""
    steps = [f"s0 AS (SELECT policy, label, id, v, base, penalty, 0.0::DOUBLE AS near FROM (SELECT *, id % 97 / 97.0::DOUBLE AS mean, id % 13 / 13.0::DOUBLE AS half FROM e) x, {policies})"]
    for i in range(k):
        steps.append(f"p{i} AS MATERIALIZED (SELECT * FROM s{i} QUALIFY row_number() OVER (PARTITION BY policy, label ORDER BY round(base - penalty * near, 9) DESC, id) = 1)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT a.* REPLACE (greatest(a.near, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))) AS near) FROM s{i} a JOIN p{i} b ON a.policy = b.policy AND a.label = b.label AND a.id <> b.id)")
    all_ = " UNION ALL ".join(f"SELECT label, policy, CAST({i + 1} AS INT) AS place, id, round(base - penalty * near, 9) AS score FROM p{i}" for i in range(k))
    return f"WITH {_E}, {', '.join(steps)}, r AS ({all_})"


@query("greedy_rankings", _picks("(SELECT 'predicted' AS policy, mean AS base, 0.0::DOUBLE AS penalty UNION ALL SELECT 'confidence', mean + 2 * half, 0.0 UNION ALL SELECT 'diverse', mean, 0.7 UNION ALL SELECT 'support', 0.25 * mean, 1.0) q", 12) + " SELECT label, policy, place, id, round(score, 6) AS score FROM r")
def _(s, d):
    e = _vectors(s, d).withColumn("mean", F.col("id") % 97 / F.lit(97.0))
    half = F.col("id") % 13 / F.lit(13.0)
    policies = {"predicted": (F.col("mean"), 0.0), "confidence": (F.col("mean") + 2 * half, 0.0), "diverse": (F.col("mean"), 0.7), "support": (0.25 * F.col("mean"), 1.0)}
    return rk.greedy_rankings(e, "label", "id", "vec", policies, 12).withColumn("score", F.round("score", 6))


@query("diverse_batch", _picks("(SELECT 'diverse' AS policy, mean AS base, 0.5::DOUBLE AS penalty) q", 8) + " SELECT label AS campaign, id AS key, place, score FROM r")
def _(s, d):
    e = _vectors(s, d).withColumn("mean", (F.col("id") % 97).cast("double") / 97)
    return aq.greedy_diverse(e, "label", "id", "mean", "vec", 8, 0.5)


def campaign_sql(guess: str, rounds: int = 10, seeds: int = 16, batch: int = 8) -> str:
    """Round by round: a model of what was acquired, and the best rows of what is left."""
    ctes = [
        f"WITH {T}, x AS MATERIALIZED (SELECT n_name, o_orderkey, y, o_orderpriority AS f, sha256('64:' || n_name || ':' || o_orderkey) AS h FROM t)",
        f"a0 AS MATERIALIZED (SELECT *, 0 AS round FROM x QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY h, o_orderkey) <= {seeds})",
    ]
    std = "sqrt(CAST(count(y) * sum(CAST(y AS HUGEINT) * y) - CAST(sum(y) AS HUGEINT) * sum(y) AS DOUBLE) / nullif(CAST(count(y) * (count(y) - 1) AS DOUBLE), 0))"
    for r in range(rounds):
        ctes += [
            f"o{r} AS (SELECT n_name, f, avg(y) AS m, {std} AS s, count(*) AS c FROM a{r} GROUP BY 1, 2)",
            f"l{r} AS (SELECT n_name, avg(y) AS am, coalesce({std}, 0) AS als FROM a{r} GROUP BY 1)",
            f"g{r} AS (SELECT x.*, coalesce(m, am) AS mean, coalesce(s, als) / sqrt(coalesce(c, 1)) AS half FROM x LEFT JOIN o{r} USING (n_name, f) JOIN l{r} USING (n_name) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a{r}))",
            f"a{r + 1} AS MATERIALIZED (SELECT * FROM a{r} UNION ALL SELECT n_name, o_orderkey, y, f, h, {r + 1} FROM (SELECT * FROM g{r} QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY round({guess}, 9) DESC, h, o_orderkey) <= {batch}))",
        ]
    return ", ".join(ctes) + f" SELECT n_name AS campaign, CAST(round AS INT) AS round, o_orderkey AS key, CAST(y AS DOUBLE) AS outcome FROM a{rounds}"


@query("campaign", campaign_sql("mean"))
def _(s, d):
    t = typed_orders(s, d)
    return aq.campaign(t, "n_name", "o_orderkey", "y", 64, 16, 10, 8, "greedy", "o_orderpriority")


@query("windowed_outcomes", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, max(CAST(floor(value) AS BIGINT)) AS best FROM events GROUP BY 1, 2""")
def _(s, d):
    e = read(s, d, "events").select("ts", "event_type", F.floor("value").cast("long").alias("v"))
    return windowed_outcomes(e, "ts", "event_type", "v").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
