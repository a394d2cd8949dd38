"""Queries: uncertainty from tree ensembles and boosting, components of sparse and dense features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica import store
from lattica.functions import canonical as cn
from lattica.operators import bin_policy as bp
from lattica.operators import candidates as cd
from lattica.operators import components as co
from lattica.operators import forests as fo
from lattica.operators import index as ix
from lattica.operators import labels as lb
from lattica.operators import order as od
from lattica.operators import splits as sp
from lattica.plans.base import CELL, T, read, typed_orders
from lattica.sources import pools

Q: dict = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_X = """x AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS id, CAST(floor(l_extendedprice) AS BIGINT) AS y, l_quantity AS f0, l_discount AS f1, l_tax AS f2 FROM lineitem),
l AS (SELECT 0 AS f, min(f0) AS lo, max(f0) AS hi FROM x UNION ALL SELECT 1, min(f1), max(f1) FROM x UNION ALL SELECT 2, min(f2), max(f2) FROM x),
c AS MATERIALIZED (SELECT rid, id, y, f, CASE WHEN hi > lo THEN 1 + least(15, CAST(floor((v - lo) * 16 / (hi - lo)) AS BIGINT)) ELSE 1 END AS bin
  FROM (SELECT rid, id, y, 0 AS f, f0 AS v FROM x UNION ALL SELECT rid, id, y, 1, f1 FROM x UNION ALL SELECT rid, id, y, 2, f2 FROM x) JOIN l USING (f))"""
_LIMITS = " + ".join(f"CAST(draw >= {t} AS INT)" for t in fo.poisson_limits())
_GAIN = "CAST(sl AS DOUBLE) * sl / nullif(wl, 0) + CAST(ts - sl AS DOUBLE) * (ts - sl) / nullif(tw - wl, 0) - CAST(ts AS DOUBLE) * ts / tw"


def _items(s, d):
    x = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES, "l_extendedprice")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *_FEATURES, F.floor("l_extendedprice").cast("long").alias("y"))


@query("extra_trees_stump", f"""
WITH {_X}, w AS (SELECT rid, m, {_LIMITS} AS w FROM (SELECT rid, m, CAST('0x' || substr(sha256('3:weights:0:' || id), CAST(8 * m + 1 AS INT), 8) AS BIGINT) AS draw FROM x, range(4) r(m))),
h AS MATERIALIZED (SELECT m, f, bin, sum(w) AS w, sum(w * y) AS s FROM c JOIN w USING (rid) WHERE w > 0 GROUP BY 1, 2, 3),
k AS (SELECT m, f, min(bin) AS lo, max(bin) AS hi, sum(w) AS tw, sum(s) AS ts FROM h GROUP BY 1, 2),
t AS (SELECT m, f, tw, ts, lo + ((CAST('0x' || substr(sha256('3:cut:' || m || ':1:' || f), 1, 12) AS BIGINT) * (hi - lo)) >> 48) AS cut FROM k),
g AS (SELECT m, f, any_value(tw) AS tw, any_value(ts) AS ts, any_value(cut) AS cut, sum(CASE WHEN bin <= cut THEN w ELSE 0 END) AS wl, sum(CASE WHEN bin <= cut THEN s ELSE 0 END) AS sl FROM h JOIN t USING (m, f) GROUP BY m, f),
b AS (SELECT * FROM g WHERE {_GAIN} > 0 QUALIFY row_number() OVER (PARTITION BY m ORDER BY {_GAIN} DESC, f, cut) = 1),
p AS (SELECT rid, id, CASE WHEN bin <= cut THEN CAST(sl AS DOUBLE) / wl ELSE CAST(ts - sl AS DOUBLE) / (tw - wl) END AS v FROM c JOIN b USING (f))
SELECT id, round(avg(v), 4) AS prediction, round(stddev_pop(v), 4) AS spread FROM p GROUP BY rid, id""")
def _(s, d):
    x = _items(s, d)
    model = fo.extra_trees(x, _FEATURES, "y", "id", seed=3, members=4, trees=1, depth=1, bins=16)
    return fo.ensemble_predictions(x, model).select("id", F.round("prediction", 4).alias("prediction"), F.round("spread", 4).alias("spread"))


@query("extra_trees_intervals")
def _(s, d):
    x = sp.calibration_part(_items(s, d), "id", 1, 0.7)
    model = fo.extra_trees(x.where("part = 'fit'"), _FEATURES, "y", "id", seed=5, members=4, trees=3, depth=4, bins=32)
    p = fo.ensemble_predictions(x, model)
    out = lb.calibrated(p, "part", "y", "scaled_residual", 0.9)
    return out.select("id", *[F.round(c, 3).alias(c) for c in ("prediction", "spread", "low", "high")])


_QS = "q AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE, 500), (1, 0.05::DOUBLE, 50), (2, 0.95::DOUBLE, 950)) v(k, q, up))"


@query("quantile_boosting_stump", f"""
WITH {_X}, {_QS}, o AS (SELECT y, row_number() OVER (ORDER BY y) AS r, count(*) OVER () AS n FROM x),
s AS (SELECT k, q, up, y AS start FROM q JOIN o ON r = least(n, greatest(1, CAST(ceil(q * n) AS BIGINT)))),
h AS MATERIALIZED (SELECT k, f, bin, count(*) AS w, sum(CASE WHEN y > start THEN up ELSE up - 1000 END) AS s FROM c, s GROUP BY 1, 2, 3),
t AS (SELECT k, f, bin AS cut, sum(w) OVER a AS wl, sum(s) OVER a AS sl, sum(w) OVER (PARTITION BY k, f) AS tw, sum(s) OVER (PARTITION BY k, f) AS ts FROM h WINDOW a AS (PARTITION BY k, f ORDER BY bin)),
b AS (SELECT * FROM t WHERE wl < tw AND {_GAIN} > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY {_GAIN} DESC, f, cut) = 1),
p AS (SELECT rid, id, c.y, s.k, q, start, bin > cut AS side FROM c JOIN b USING (f) JOIN s USING (k)),
m AS (SELECT k, side, y - start AS move FROM (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY y) AS r, count(*) OVER (PARTITION BY k, side) AS n FROM p) WHERE r = least(n, greatest(1, CAST(ceil(q * n) AS BIGINT)))),
e AS (SELECT rid, id, k, start + CAST(floor(move / 2.0) AS BIGINT) AS v FROM p JOIN m USING (k, side))
SELECT id, max(v) FILTER (k = 0) AS prediction, min(v) AS low, max(v) AS high FROM e GROUP BY rid, id""")
def _(s, d):
    x = _items(s, d)
    return fo.quantile_predictions(x, fo.quantile_boosting(x, _FEATURES, "y", (0.5, 0.05, 0.95), 1, 1, (1, 2), 16)).select("id", "prediction", "low", "high")


@query("quantile_boosting_intervals")
def _(s, d):
    """Coverage, width and pinball loss of boosted intervals before and after calibration, on rows that are neither."""
    x = sp.calibration_part(_items(s, d), "id", 1, 0.6)
    model = fo.quantile_boosting(x.where("part = 'fit'"), _FEATURES, "y", (0.5, 0.05, 0.95), rounds=6, depth=2, rate=(1, 3), bins=32)
    p = fo.quantile_predictions(x, model)
    out = lb.calibrated(p.withColumnsRenamed({"low": "raw_low", "high": "raw_high"}), "part", "y", "additive_quantile", 0.9, low="raw_low", high="raw_high")
    inside = lambda a, b: F.avg(((F.col("y") >= F.col(a)) & (F.col("y") <= F.col(b))).cast("int"))
    loss = lambda b, q: F.sum(fo.pinball_loss(F.col("y"), F.col(b), q)) / F.count("y")
    return out.groupBy("part").agg(
        F.count("*").alias("n"),
        F.round(inside("raw_low", "raw_high"), 6).alias("raw_coverage"),
        F.round(inside("low", "high"), 6).alias("coverage"),
        F.round(F.avg(F.col("high") - F.col("low")), 3).alias("width"),
        *[F.round(loss(b, q), 3).alias(f"pinball_{b}") for b, q in (("prediction", 0.5), ("raw_low", 0.05), ("raw_high", 0.95))],
    )


def _tokens(s, d):
    t = typed_orders(s, d)
    bits = F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in ("n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus")])
    rows = t.select(F.col("o_orderkey").alias("id"), "y", bits.alias("bits"))
    return rows, co.cells_of(rows, "id", "bits")


@query("pls_scores", f"""
WITH {T}, x AS MATERIALIZED (SELECT o_orderkey AS id, CAST(y AS DOUBLE) - (SELECT sum(y) / count(*) FROM t WHERE o_orderkey % 5 > 0) AS y, o_orderkey % 5 > 0 AS fit,
  unnest(['n_name=' || n_name, 'c_mktsegment=' || c_mktsegment, 'o_orderpriority=' || o_orderpriority, 'o_orderstatus=' || o_orderstatus]) AS bit FROM t),
n AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS n FROM x WHERE fit),
m AS (SELECT bit, count(*) / (SELECT n FROM n) AS mean, sum(y) AS c FROM x WHERE fit GROUP BY bit),
w1 AS (SELECT *, c / (SELECT sqrt(sum(c * c)) * sign(arg_max(c, abs(c))) FROM m) AS w FROM m),
t1 AS (SELECT id, fit, any_value(y) AS y, sum(coalesce(w, 0)) - (SELECT sum(mean * w) FROM w1) AS t FROM x LEFT JOIN w1 USING (bit) GROUP BY id, fit),
s1 AS (SELECT sum(t * t) AS tt, sum(t * y) AS ty, sum(t) AS st FROM t1 WHERE fit),
p1 AS (SELECT bit, (sum(t) - any_value(mean) * any_value(st)) / any_value(tt) AS p FROM x JOIN t1 USING (id) JOIN m USING (bit), s1 WHERE x.fit GROUP BY bit),
m2 AS (SELECT bit, mean, w, p, c - p * ty AS raw FROM w1 JOIN p1 USING (bit), s1),
w2 AS (SELECT *, raw / (SELECT sqrt(sum(raw * raw)) * sign(arg_max(raw, abs(raw))) FROM m2) AS v FROM m2),
r2 AS (SELECT bit, mean, v - w * (SELECT sum(p * v) FROM w2) AS r FROM w2),
t2 AS (SELECT id, fit, any_value(y) AS y, sum(coalesce(r, 0)) - (SELECT sum(mean * r) FROM r2) AS t FROM x LEFT JOIN r2 USING (bit) GROUP BY id, fit),
s2 AS (SELECT sum(t * t) AS tt, sum(t * y) AS ty FROM t2 WHERE fit)
SELECT id, round(t1.t, 6) AS t1, round(t2.t, 6) AS t2, round((SELECT sum(y) / count(*) FROM t WHERE o_orderkey % 5 > 0) + t1.t * s1.ty / s1.tt + t2.t * s2.ty / s2.tt, 2) AS prediction FROM t1 JOIN t2 USING (id), s1, s2""")
def _(s, d):
    rows, cells = _tokens(s, d)
    model = co.pls(cells, rows.where("id % 5 > 0").select("id", "y"), 2)
    return co.pls_scores(cells, rows, model).select("id", F.round("t1", 6).alias("t1"), F.round("t2", 6).alias("t2"), F.round("prediction", 2).alias("prediction"))


@query("sparse_svd")
def _(s, d):
    """Scores of all rows on three singular vectors of the training rows' tokens."""
    rows, cells = _tokens(s, d)
    model = co.svd(cells.where("id % 5 > 0"), 3, oversample=8, passes=4)
    return co.svd_scores(cells, rows, model).select("id", *[F.round(f"s{i}", 5).alias(f"s{i}") for i in (1, 2, 3)])


@query("canonical_traversal", f"""
WITH {T} SELECT o_orderkey, row_number() OVER (ORDER BY n_name, c_mktsegment, o_orderpriority, o_orderstatus, o_orderkey) AS position FROM t""")
def _(s, d):
    return cd.traversal(typed_orders(s, d), [*CELL, "o_orderkey"]).select("o_orderkey", "position")


@query("group_order_statistics", f"""
WITH {T}, r AS (SELECT n_name, y, row_number() OVER (PARTITION BY n_name ORDER BY y DESC, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY n_name) AS n, coalesce(sum(y) OVER (PARTITION BY n_name ORDER BY y DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM t)
SELECT n_name, y, k, n, CAST(ahead AS BIGINT) AS ahead FROM r WHERE k % 10 = 0""")
def _(s, d):
    """Each tenth place of a nation's outcomes from the highest down, with the sum of those ahead."""
    t = typed_orders(s, d).select("n_name", "y", "o_orderkey")
    return od.positions(t, [F.col("y").desc(), "o_orderkey"], ["n_name"], "k", "n", {"ahead": "y"}).where("k % 10 = 0").drop("o_orderkey")


_POOL = [*CELL, "o_orderkey", "y"]
_TEXT = " || '|' || ".join(f"coalesce('{c}=' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '{c}=-')" for c in sorted(_POOL))
_LANES = ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS s{i}" for i in range(8))


def _with_gaps(s, d):
    return typed_orders(s, d).select(*[F.when(F.col("o_orderkey") % 11 > 0, F.col(c)).alias(c) for c in CELL], "o_orderkey", "y")


_GAPS = f"g AS (SELECT {', '.join(f'CASE WHEN o_orderkey % 11 > 0 THEN {c} END AS {c}' for c in CELL)}, o_orderkey, y FROM t)"


@query("pool_digest", f"""
WITH {T}, {_GAPS}, h AS (SELECT sha256({_TEXT}) AS h FROM g), a AS (SELECT count(*) AS rows, {_LANES} FROM h)
SELECT rows, sha256(rows || ',' || {" || ',' || ".join(f's{i}' for i in range(8))}) AS digest FROM a""")
def _(s, d):
    return pools.table_digest(_with_gaps(s, d))


@query("immutable_pool", f"WITH {T}, {_GAPS} SELECT * FROM g")
def _(s, d):
    """The rows of a pool that was written, named by its content, and checked on loading."""
    path = pools.write_pool(_with_gaps(s, d), f"{store.shared_dir(s)}/lattica/pools-{uuid.uuid4().hex}", "observed", {"gaps": 11})
    return pools.load_pool(s, path, "observed")[0]


def _sorted_words(values):
    return [None if "green" in v else " ".join(sorted(v.strip().lower().split(" "))) for v in values]


@query("canonical_plugin", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_name END AS p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part),
c AS (SELECT p_partkey, u.c AS c, u.v AS v FROM p, unnest([{'c': 'p_name', 'v': p_name}, {'c': 'p_brand', 'v': p_brand}]) x(u)),
e AS (SELECT *, CASE WHEN trim(coalesce(v, '')) = '' THEN 'missing' WHEN contains(v, 'green') THEN 'unparsable' END AS error_type FROM c)
SELECT p_partkey, c AS role, error_type, CASE WHEN error_type IS NULL THEN array_to_string(list_sort(string_split(lower(trim(v)), ' ')), ' ') END AS canonical, error_type IS NULL AS valid,
  (SELECT count(DISTINCT v) FROM c WHERE trim(coalesce(v, '')) <> '') AS plugin_calls FROM e""")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("p_brand"))
    plugin = cn.Plugin("sorted-words", "1", _sorted_words)
    calls = cn.dictionary(p, ["p_name", "p_brand"], plugin).count()  # one for each distinct value
    out = cn.canonicalise(p, ["p_name", "p_brand"], plugin)
    role = lambda c: F.struct(F.lit(c).alias("role"), F.col(f"{c}_error_type").alias("error_type"), F.col(f"{c}_canonical").alias("canonical"), F.col(f"{c}_valid").alias("valid"))
    return out.select("p_partkey", F.explode(F.array(role("p_name"), role("p_brand"))).alias("r")).select("p_partkey", "r.*", F.lit(calls).cast("long").alias("plugin_calls"))


def _policy_sql(rounds: int, batches: int, size: int, take: int) -> str:
    u = lambda what, r: f"CAST(CAST('0x' || substr(sha256('3:{what}:{r}:' || b || ':' || j), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
    ctes = [f"WITH {T}, a AS (SELECT CAST(least(4, y // 100000) AS INT) AS bin, y, o_orderkey FROM t)", "k AS MATERIALIZED (SELECT bin, y, row_number() OVER (PARTITION BY bin ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY bin) AS n FROM a)"]
    ctes += ["n AS (SELECT DISTINCT bin, n FROM k)", "p0 AS (SELECT CAST(b AS INT) AS bin, 0.2::DOUBLE AS p, CAST(NULL AS DOUBLE) AS e FROM range(5) r(b))"]
    for r in range(rounds):
        ctes += [
            f"u{r} AS (SELECT bin, sum(p) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c FROM p{r})",
            f"d{r} AS MATERIALIZED (SELECT b, j, CAST((SELECT count(*) FROM u{r} WHERE bin < 4 AND {u('bin', r)} >= c) AS INT) AS bin, {u('row', r)} AS v FROM range({batches}) x(b), range({size}) y(j))",
            f"s{r} AS (SELECT b, avg(CAST(y AS DOUBLE)) AS s FROM d{r} JOIN n USING (bin) JOIN k ON k.bin = d{r}.bin AND k.place = floor(v * n.n) GROUP BY b)",
            f"b{r} AS MATERIALIZED (SELECT * FROM s{r} ORDER BY s DESC, b LIMIT {take})",
            f"h{r} AS (SELECT bin, count(*) AS h FROM d{r} JOIN b{r} USING (b) GROUP BY bin)",
            f"p{r + 1} AS MATERIALIZED (SELECT bin, 0.5::DOUBLE * p + 0.5::DOUBLE * (1 + coalesce(h, 0)) / (5 + (SELECT sum(h) FROM h{r})) AS p, (SELECT sum(s) / count(*) FROM b{r}) AS e FROM p{r} LEFT JOIN h{r} USING (bin))",
        ]
    rows = " UNION ALL ".join(f"SELECT CAST({r} AS INT) AS round, bin, round(p, 9) AS probability, round(e, 3) AS elite_reward FROM p{r}" for r in range(rounds + 1))
    return ",\n".join(ctes) + "\n" + rows


@query("bin_policy", _policy_sql(3, 20, 10, 4))
def _(s, d):
    t = typed_orders(s, d).withColumn("bin", F.least(F.lit(4), F.floor(F.col("y") / 100000)))
    out = bp.bin_policy(t, "o_orderkey", "bin", "y", bp.PolicySettings(5, 3, 20, 10, 0.2, 0.5, 3))
    return out.select("round", "bin", F.round("probability", 9).alias("probability"), F.round("elite_reward", 3).alias("elite_reward"))


_NEAREST = """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.id AS query, b.id AS b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS s FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0),
n AS (SELECT query, b AS nearest, s AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, b) = 1)"""


def _index(s, d):
    """An index that is written, opened again and searched: every row whose id is divisible by 20, against all rows."""
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    path = f"{store.shared_dir(s)}/lattica/index-{uuid.uuid4().hex}"
    ix.build_index(v, path)
    return ix.nearest(ix.open_index(s, path), v.where("id % 20 = 0"))


@query("index_nearest", f"{_NEAREST} SELECT * FROM n")
def _(s, d):
    return _index(s, d).drop("visited")


_AT = (5, 25, 50, 75, 95)
_QUANTILES = ", ".join(f"q{k} AS (SELECT {k / 100}::DOUBLE AS q, round(quantile_cont(similarity, {k / 100}), 9) AS similarity FROM n)" for k in _AT)


@query("nearest_similarity_quantiles", f"{_NEAREST}, {_QUANTILES} " + " UNION ALL ".join(f"SELECT * FROM q{k}" for k in _AT))
def _(s, d):
    at = [k / 100 for k in _AT]
    edges = od.quantile_edges(_index(s, d), "similarity", at)
    return s.createDataFrame([(q, None if e is None else round(e, 9)) for q, e in zip(at, edges, strict=True)], "q double, similarity double")
