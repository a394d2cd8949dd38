"""Teacher ensembles, label strategies, weights, strata, and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.identity import std_pop
from lattica.operators.order import order_statistic, quantile_edges


def ensemble(df: DataFrame, candidate: str, prediction: str) -> DataFrame:
    """L1."""
    p = F.col(prediction)
    return df.groupBy(candidate).agg((F.sum(p).cast("double") / F.count(p)).alias("mean"), std_pop(df, prediction).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"), (F.max(p) - F.min(p)).alias("range"))


def label(strategy: str, teacher: Column, source: Column, donor: Column, low=0.0, high=100.0) -> Column:
    """L2: teacher, source, donor or average of source and donor, clipped."""
    y = {"teacher": teacher, "uncertainty_filtered": teacher, "source": source, "donor": donor, "average": (source + donor) / 2}[strategy]
    return F.greatest(F.lit(low), F.least(F.lit(high), y))


def uncertainty_proxy(std: Column, source: Column, donor: Column, scale: Column) -> Column:
    """L3: teacher deviation, else half the difference, over max(scale, 1)."""
    return F.coalesce(std, F.abs(source - donor) / 2) / F.greatest(scale, F.lit(1.0))


def sample_weight(is_real: Column, similarity: Column, low: float, high: float, real: float = 1.0) -> Column:
    """L4: synthetic rows weigh their clipped similarity, null the least."""
    return F.when(is_real, F.lit(real)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(similarity, F.lit(low)))))


def strata(df: DataFrame, y: str, quantiles: list[float]) -> DataFrame:
    """The number of distinct quantile edges below or at... right-closed bins: edges smaller than y."""
    cuts = sorted({e for e in quantile_edges(df, y, quantiles) if e is not None})
    return df.withColumn("stratum", sum(((F.col(y) > c).cast("int") for c in cuts), F.lit(0)))


def calibration_score(kind: str, y: Column, pred: Column, spread: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    """L9."""
    if kind == "additive_residual":
        return F.abs(y - pred)
    if kind == "scaled_residual":
        return F.abs(y - pred) / F.greatest(spread, F.lit(1e-9))
    if kind == "additive_quantile":
        return F.greatest(low - y, y - high)
    raise ValueError(kind)


def conformal_quantile(df: DataFrame, by: list[str], score: str, coverage: float) -> DataFrame:
    """The order statistic of rank min(n, ceil((n + 1) * coverage)) in each group."""
    rank = F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(coverage))) - 1
    return order_statistic(df, score, rank, by).select(*by, "n", F.col(score).alias("quantile"))


def ridge(df: DataFrame, features: list[str], y: str, alpha: float) -> dict:
    """Min sum of squares + alpha * |w|**2, free intercept; from exact second moments in one aggregation, solved on the driver."""
    names = [*features, y]
    aggs = [F.count("*").alias("n")] + [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]
    aggs += [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    r = df.agg(*aggs).first()
    n, k = r["n"], len(features)
    if not n:
        return {"features": features, "weights": [0.0] * k, "intercept": 0.0}
    s = np.array([r[f"s{i}"] or 0.0 for i in range(k + 1)])
    p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    c = p - np.outer(s, s) / n
    w = np.linalg.solve(c[:k, :k] + alpha * np.eye(k) + 1e-12 * np.eye(k), c[:k, k])
    return {"features": features, "weights": w.tolist(), "intercept": float((s[k] - w @ s[:k]) / n)}


def predict(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    """L7."""
    out = F.lit(model["intercept"])
    for f, w in zip(model["features"], model["weights"], strict=True):
        out = out + F.lit(w) * F.col(f)
    return df.withColumn(name, out)


def forest(df: DataFrame, features: list[str], y: str, kind: str = "random_forest", seed: int = 0, **params):
    """MLlib trees (``random_forest`` or ``boosted``); returns the fitted pipeline. They stand in for other tree libraries and give other numbers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    model = {"random_forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model(featuresCol="_x", labelCol=y, predictionCol="prediction", seed=seed, **params)]).fit(df)


def split_conformal(df: DataFrame, part: str, features: list[str], y: str, alpha: float, coverage: float) -> DataFrame:
    """Ridge on ``fit`` rows, half width from ``calibration`` rows; intervals for all rows."""
    model = ridge(df.where(F.col(part) == "fit"), features, y, alpha)
    out = predict(df, model)
    cal = out.where(F.col(part) == "calibration").withColumn("_score", F.abs(F.col(y) - F.col("prediction"))).withColumn("_g", F.lit(1))
    q = conformal_quantile(cal, ["_g"], "_score", coverage).first()
    half = F.lit(None if q is None else float(q["quantile"])).cast("double")
    return out.withColumns({"low": F.col("prediction") - half, "high": F.col("prediction") + half})


def calibrated(df: DataFrame, part: str, y: str, kind: str, coverage: float, prediction: str = "prediction", spread: str = "spread", low: str | None = None, high: str | None = None) -> DataFrame:
    """``df`` with ``low`` and ``high`` from raw predictions: the scores (L9) of ``calibration`` rows give one order statistic (L10),
    by which intervals are widened: times the spread for scaled residuals, beyond the raw bounds for quantiles."""
    bounds = (F.col(low), F.col(high)) if low and high else (F.col(prediction), F.col(prediction))
    scores = df.where((F.col(part) == "calibration") & F.col(y).isNotNull() & F.col(prediction).isNotNull())
    score = calibration_score(kind, F.col(y), F.col(prediction), F.col(spread) if kind == "scaled_residual" else None, *bounds)
    q = conformal_quantile(scores.select(score.cast("double").alias("_score"), F.lit(1).alias("_g")), ["_g"], "_score", coverage).first()
    add = F.lit(None if q is None else float(q["quantile"])).cast("double")
    if kind == "scaled_residual":
        add = add * F.greatest(F.col(spread), F.lit(1e-9))
    return df.withColumns({"low": bounds[0] - add, "high": bounds[1] + add})


def low_rank(df: DataFrame, vec: str, k: int) -> DataFrame:
    """projections on the top ``k`` right singular vectors of the centred vectors.

    Second moments are summed batch by batch (width * width numbers), so the
    width of the vectors bounds what is collected.
    """

    def moments(frames):
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf[vec].tolist(), np.float64)
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()], "m": [(x.T @ x).ravel().tolist()]})

    parts = df.select(vec).mapInPandas(moments, "n long, s array<double>, m array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "m")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").toPandas()
    if not len(flat):
        return df.withColumn("projection", F.array().cast("array<double>"))
    n, v = flat["n"].iloc[0], flat["v"].to_numpy()
    d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
    mean = v[:d] / n
    cov = v[d:].reshape(d, d) / n - np.outer(mean, mean)
    _, vecs = np.linalg.eigh(cov)
    top = vecs[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(0), range(top.shape[1])])
    cols = [F.aggregate(F.zip_with(vec, F.lit(top[:, j].tolist()), lambda a, b: a.cast("double") * b), F.lit(float(-mean @ top[:, j])), lambda a, x: a + x) for j in range(top.shape[1])]
    return df.withColumn("projection", F.array(*cols))
