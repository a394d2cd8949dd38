"""Mixing sources to target weights with soft membership (DataFrame functions only).

1. A classifier learned from the labels table gives each document posterior
   probabilities over domains.  The domains are the distinct values of
   ``domain`` (here: the pair of labels) among labelled rows.  It is a naive
   Bayes model over features that are cut into a few bins: the length, shares of
   the marks that differ most between domains, and for each domain how many of
   its typical words occur.  A document is then described by one integer, its code.
2. Target totals of tokens are set for each domain.
3. Distributed projected-gradient least squares finds a rate r >= 0 for each
   document with sum over documents of r * tokens * P(domain | document) equal
   to the domain's target, as nearly as possible.  In the metric in which a step
   changes a document's rate by its posteriors alone, documents of one code keep
   one rate, so the iteration runs over (code, tokens) sums: exact, and bounded
   by the number of codes instead of that of documents.

Typical words and marks are learned from at most ``max_rows`` labelled documents
(smallest hash of doc_id); the bins' counts from all labelled documents; tokens,
totals and rates from all documents.

Defined results: a null or empty text has no token and gets the rate of its
code; without labels there is one domain, named ``all``; labels that are null or
of a null doc_id are not used; labels may have any values, but over MAX_DOMAINS
pairs of them are an error; of several labels of a doc_id the largest pair
counts; repeated documents count and are returned as often as they occur; a
domain with a target but no probability mass stays short of it.  Empty tables
give empty results.  Only doc_id, text and the labels are read, so other columns
may have any name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._io import labelled, table
from lattica.llm._store import discard, save

MAX_ROWS = 4_000
TYPICAL = 48
MARKS = 5
MAX_DOMAINS = 16
ITERATIONS = 60
RUNS = (1, 4, 16, 64, 256, 1024, 4096)  # plain steps that are tried at once
TOLERANCE = 1e-9
STALLED = 1e-8
TEMPERATURE = 0.5


def _tokens(text):
    return F.array_remove(F.split(F.translate(text, "\n\t\r\x0b\x0c", "     "), " "), "")


def _bin(value, cuts):
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value >= c, 1).otherwise(0)
    return out


def typical_words(rows: DataFrame, top: int = TYPICAL) -> dict[str, list[str]]:
    """For each domain (label) of the sample ``rows`` the words whose share of its texts most exceeds that of the others."""
    words = rows.select("label", F.explode(F.array_distinct(_tokens(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)))).alias("word"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row for each domain
    if len(n) < 2:
        return {k: [] for k in n}
    per = save(words.groupBy("word").pivot("label", sorted(n)).count().na.fill(0), "words")
    out = {}
    total = sum(n.values())
    for k, nk in n.items():
        own, others = F.col(f"`{k}`"), sum((F.col(f"`{j}`") for j in n if j != k), F.lit(0))
        gain = F.log((own + 0.5) / (nk + 1)) - F.log((others + 0.5) / (total - nk + 1))
        best = per.where((own >= 3) & (gain > math.log(4.0))).orderBy((gain * own).desc(), "word").limit(top).select("word").collect()
        out[k] = [r["word"] for r in best]
    discard(per)
    return out


def typical_marks(rows: DataFrame, top: int = MARKS) -> list[str]:
    """The ASCII marks (and line feeds) whose mean share of a text differs most between domains, by its spread over its mean."""
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()] + ["\n"]
    text = F.coalesce("text", F.lit(""))
    share = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / F.greatest(F.length(text), F.lit(1))
    rows = rows.groupBy("label").agg(*[F.avg(share(m)).alias(f"m{i}") for i, m in enumerate(marks)]).collect()  # a row for each domain
    if len(rows) < 2:
        return []
    means = np.array([[r[f"m{i}"] for i in range(len(marks))] for r in rows])
    spread = means.std(0) / (means.mean(0) + 1e-4)
    return [marks[i] for i in np.argsort(-spread, kind="stable")[:top]]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def coded(docs: DataFrame, words: dict, marks: list[str]) -> tuple[DataFrame, list[int]]:
    """Adds n_tokens and _code; also returns the number of bins of each feature (first: lowest digit of the code)."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_words", _tokens(F.translate(text, _UPPER, _LOWER))).withColumn("n_tokens", F.size("_words").cast("long"))
    length = F.greatest(F.length(text), F.lit(1))
    features = [(_bin(F.col("n_tokens"), (20, 100, 500, 2000)), 5)]
    for m in marks:
        features.append((_bin((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / length, (1e-9, 0.01)), 3))
    for k in sorted(words):
        if words[k]:
            found = F.size(F.array_intersect("_words", F.lit(words[k])))
            features.append((_bin(found, (1, 2, 4)), 4))
    code, size = F.lit(0).cast("long"), 1
    for f, bins in features:
        code = code + f * F.lit(size).cast("long")
        size *= bins
    return out.withColumn("_code", code).drop("_words"), [b for _, b in features]


def posteriors(codes: DataFrame, labelled_codes: DataFrame, bins: list[int], domains: list[int]) -> DataFrame:
    """Adds the array ``p`` of P(domain | code) to ``codes``, by Laplace-smoothed naive Bayes."""
    if len(domains) < 2:
        return codes.withColumn("p", F.array(F.lit(1.0)))
    size, digits = 1, []
    for b in bins:
        digits.append(F.floor(F.col("_code") / size) % b)
        size *= b
    rows = labelled_codes.select("domain_no", F.posexplode(F.array(*digits)).alias("feature", "bin"))
    counts = rows.groupBy("domain_no", "feature", "bin").count().collect()  # domains * sum of bins rows at most
    table_ = {(r["domain_no"], r["feature"], r["bin"]): r["count"] for r in counts}
    n = {d: sum(table_.get((d, 0, b), 0) for b in range(bins[0])) for d in domains}
    total = sum(n.values())
    scores = []
    for d in domains:
        s = F.lit(math.log((n[d] + 1) / (total + len(domains))))
        for f, b in enumerate(bins):
            logs = [float(math.log((table_.get((d, f, v), 0) + 1) / (n[d] + b))) for v in range(b)]
            s = s + F.element_at(F.lit(logs), (digits[f] + 1).cast("int"))
        scores.append(s)
    out = codes.withColumn("_s", F.array(*scores))
    out = out.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    out = out.withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return out.withColumn("p", F.transform("_e", lambda x: x / F.col("_t"))).drop("_s", "_e", "_t")


def fit_rates(groups: DataFrame, targets: list[float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``rate`` to groups (tokens, p): projected gradient on 1/2 * sum((totals - targets)**2).

    A plain step is r := max(0, r - p . (totals - targets) / m), m the largest
    present total, which bounds the curvature, so the error lessens for sure.
    While no rate reaches zero, j plain steps are one move, known from the
    curvature over the groups that are free to move; so runs of j = 1, 4, 16 ...
    steps, each projected once, are the trials of a line search.  One aggregation
    gives the totals after every trial, that curvature and the residual of the
    optimality conditions.  Ends when targets are met, no group wants to move, or
    a move lessens the error by less than STALLED of the targets' sum.
    """
    k = len(targets)
    mass = [f"sum(tokens * p[{i}])" for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = lambda free: [f"sum(if({free}, tokens * p[{i}] * p[{j}], 0D))" for i, j in pairs]
    got = groups.agg(*map(F.expr, [*mass, *second("true"), "sum(cast(tokens as double))"])).first()
    state, moves = groups.withColumn("rate", F.lit(1.0)), []
    if not got[-1]:
        return state
    got = np.array(got, float)
    present, target, largest, tokens = got[:k], np.array(targets, float), got[:k].max(), got[-1]
    error, curve = present - target, _square(got[k:-1] / largest, pairs, k)
    norm, scale = float(np.linalg.norm(error)), float(target.sum()) or 1.0
    for _ in range(iterations):
        if norm <= tolerance * scale:
            break
        trials = [[float(x) for x in _run(error / largest, curve, j)] for j in RUNS]
        # parameters stand in array literals, so the compiled plan is the same for each move
        now = _moved(state, moves, k).selectExpr("tokens", "p", "rate", f"rate > 0 or {_dot(_literal(trials[0]), k)} < 0 as free", f"posexplode({_literal(trials)}) as (trial, v)")
        now = now.selectExpr("trial", "tokens", "p", "rate", "free", f"greatest(0D, rate - ({_dot('v', k)})) as after")
        sums = [f"sum(tokens * p[{i}] * after)" for i in range(k)] + second("free") + ["sum(tokens * (rate - after) * (rate - after))"]
        got = np.array(sorted(now.groupBy("trial").agg(*map(F.expr, sums)).collect()), float)[:, 1:]  # a row for each trial
        if math.sqrt(got[0, -1] / tokens) <= tolerance:
            break
        errors = got[:, :k] - target
        best = int(np.argmin((errors**2).sum(1)))
        less = norm - float(np.linalg.norm(errors[best]))
        if less <= 0:
            break
        moves.append(trials[best])
        error, curve, norm = errors[best], _square(got[0, k:-1] / largest, pairs, k), norm - less
        if less <= STALLED * scale and norm > STALLED * scale:
            break  # targets that can't be met
        if len(moves) == 20:  # the state is written now and then, so that plans stay short
            state, moves = save(_moved(state, moves, k), "rates"), []
    return _moved(state, moves, k)


def _literal(x) -> str:
    return f"{x!r}D" if isinstance(x, float) else f"array({', '.join(map(_literal, x))})"


def _dot(v: str, k: int) -> str:
    return " + ".join(f"p[{i}] * {v}[{i}]" for i in range(k))


def _square(values, pairs, k):
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _moved(state: DataFrame, moves: list, k: int) -> DataFrame:
    """The rates after steps along ``moves``."""
    return state.withColumn("rate", F.expr(f"aggregate({_literal(moves)}, rate, (r, v) -> greatest(0D, r - ({_dot('v', k)})))")) if moves else state


def _run(gradient, curve, j: int):
    """The sum of j plain steps, if the gradient changes by ``curve`` with each of them."""
    value, vector = np.linalg.eigh(curve)
    times = np.where(value > 1e-12, (1 - (1 - np.clip(value, 0, 1)) ** j) / np.maximum(value, 1e-12), float(j))
    return vector @ (times * (vector.T @ gradient)) if j > 1 else gradient


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, label_cols=("quality", "toxic"), max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p_domain, rate of each row.

    weights: share of tokens wanted for each domain name such as ``q1t0``; by
    default proportional to the expected tokens to the power TEMPERATURE.
    budget: wanted tokens over all tokens there are.
    """
    a, b = label_cols
    known = labels.where(F.col("doc_id").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.struct(F.col(a).alias("x"), F.col(b).alias("y"))).alias("pair"))
    pairs = sorted(tuple(r) for r in known.select("pair.x", "pair.y").distinct().limit(MAX_DOMAINS + 1).collect())
    if len(pairs) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} pairs of labels")
    number = F.lit(0)
    for i, (x, y) in enumerate(pairs):
        number = F.when((F.col("pair.x") == F.lit(x)) & (F.col("pair.y") == F.lit(y)), i).otherwise(number)
    known = known.select("doc_id", number.alias("domain_no"))
    domains = list(range(len(pairs))) or [0]
    names = [f"{a[0]}{x}{b[0]}{y}" for x, y in pairs] if len(domains) > 1 else ["all"]
    docs = docs.select("doc_id", "text")
    if len(domains) > 1:
        sample = save(labelled(docs, known, "domain_no", max_rows), "sample")
        words, marks = typical_words(sample), typical_marks(sample)
        discard(sample)
    else:
        words, marks = {}, []
    rows, bins = coded(docs, words, marks)
    rows = save(rows.select("doc_id", "n_tokens", "_code"), "codes")
    groups = save(posteriors(rows.groupBy("_code").agg(F.sum("n_tokens").alias("tokens")), rows.join(known, "doc_id"), bins, domains), "groups")
    k = len(domains)
    now = groups.agg(*[F.coalesce(F.sum(F.col("tokens") * F.element_at("p", i + 1)), F.lit(0.0)) for i in range(k)]).first()
    want = [weights.get(n, 0.0) for n in names] if weights else [x**TEMPERATURE for x in now]
    targets = [sum(now) * budget * w / (sum(want) or 1.0) for w in want]
    rates = fit_rates(groups, targets)
    top = F.array_max("p")
    rates = rates.select("_code", F.element_at(F.lit(names), F.array_position("p", top).cast("int")).alias("domain"), top.alias("p_domain"), "rate")
    # a row for each code in use: 5 * 3**MARKS * 4**domains at most, some 10 MB with four domains
    return rows.join(F.broadcast(save(rates, "rates")), "_code").select("doc_id", "n_tokens", "domain", "p_domain", "rate")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
