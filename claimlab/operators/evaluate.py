"""Inference on return series, forecasts and scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlab.functions.expressions import avg_rank, finite, ratio
from claimlab.functions.ordering import running_sum


def sharpe(series: DataFrame, value: str = "ret", per_year: int = 12, *by: str) -> DataFrame:
    """n, mean, annualised mean, volatility and Sharpe ratio; NULL where undefined."""
    v = finite(F.col(value).cast("double"))
    mean, sd = F.avg(v), F.stddev_samp(v)
    return series.groupBy(*by).agg(F.count(v).alias("n"), mean.alias("mean"), (mean * per_year).alias("ann"), (sd * math.sqrt(per_year)).alias("vol"),
                                   (ratio(mean, sd) * math.sqrt(per_year)).alias("sharpe"))


def oos_r2(frame: DataFrame, actual: str, forecast: str, benchmark: str | None = None, order: str = "date") -> DataFrame:
    """1 - SSE / SSE of the benchmark, which is the mean of all earlier actuals by default."""
    a, f = finite(actual), finite(forecast)
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    b = finite(benchmark) if benchmark else F.avg(a).over(earlier)
    rows = frame.select(a.alias("a"), f.alias("f"), b.alias("b")).dropna()
    sse = lambda x: F.sum((F.col("a") - F.col(x)) ** 2)
    return rows.agg(F.count("*").alias("n"), (1 - ratio(sse("f"), sse("b"))).alias("oos_r2"))


def auc(scored: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """Area under the ROC curve: ties count half.  One aggregation by distinct score, then
    a running sum of negatives over the distinct scores, in ranges of the score."""
    rows = scored.select(*by, F.col(label).alias("y"), finite(F.col(score).cast("double")).alias("s")).where("s is not null and y is not null")
    per = rows.groupBy(*by, "s").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("q"))
    if by:
        per = per.withColumn("below", F.sum("q").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q"))
    else:
        per = running_sum(per, "q", "s", "below")
    return per.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        ratio(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def hac_t(series: DataFrame, value: str, order: str = "date", lags: int = 3) -> DataFrame:
    """Mean and its t-statistic with Bartlett weights; NULL below five values."""
    rows = series.select(F.col(order).alias("o"), finite(value).alias("d")).where("d is not null")
    rows = rows.withColumn("u", F.col("d") - F.avg("d").over(Window.partitionBy()))
    w = Window.orderBy("o")
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"u{k}", F.lag("u", k).over(w))
    n = F.count("*")
    var = F.sum(F.col("u") * F.col("u")) / n
    for k in range(1, lags + 1):
        var = var + F.when(n > k, 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0)) / n).otherwise(0.0)
    out = rows.agg(n.alias("n"), F.avg("d").alias("mean"), var.alias("var"))
    return out.select("n", "mean", F.when((F.col("n") >= 5) & (F.col("var") > 0), F.col("mean") / F.sqrt(F.col("var") / F.col("n"))).alias("t"))


def clark_west(frame: DataFrame, actual: str, small: str, big: str, order: str = "date", lags: int = 3) -> DataFrame:
    """Nested forecasts: t above 1.645 favours the big model."""
    a, s, b = (F.col(c) for c in (actual, small, big))
    t = hac_t(frame.withColumn("d", (a - s) ** 2 - ((a - b) ** 2 - (s - b) ** 2)), "d", order, lags)
    return t.select(F.col("t").alias("cw_t"), F.coalesce(F.col("t") > 1.645, F.lit(False)).alias("reject_5pct"))


def diebold_mariano(frame: DataFrame, actual: str, first: str, second: str, order: str = "date", lags: int = 3) -> DataFrame:
    """Squared-error loss: a positive t favours the second forecast."""
    a, x, y = (F.col(c) for c in (actual, first, second))
    return hac_t(frame.withColumn("d", (a - x) ** 2 - (a - y) ** 2), "d", order, lags).select(F.col("t").alias("dm_t"))


def spanning(frame: DataFrame, y: str, xs: list[str], order: str = "date", lags: int = 3) -> DataFrame:
    """OLS of y on the benchmarks with HAC errors: one row per coefficient.

    Two passes of sums: the moments (k + 1 by k + 1 numbers reach the driver) give the
    coefficients, lagged cross products of the scores the covariance.
    """
    names = ["const", *xs]
    rows = frame.select(F.col(order).alias("__o"), F.lit(1.0).alias("const"), *[finite(x).alias(x) for x in xs], finite(y).alias("__y")).dropna().persist()
    k = len(names)
    sums = rows.agg(F.count("*").alias("n"), F.sum("__y").alias("sy"), F.sum(F.col("__y") ** 2).alias("syy"),
                    *[F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j],
                    *[F.sum(F.col(a) * F.col("__y")).alias(f"v{i}") for i, a in enumerate(names)]).first()
    n = sums["n"]
    if n < k + 1 + 3:
        raise ValueError("not enough observations for a spanning regression")
    xx = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.solve(xx, [sums[f"v{i}"] for i in range(k)])
    u = F.col("__y") - sum(float(b) * F.col(a) for a, b in zip(names, beta, strict=True))
    w = Window.orderBy("__o")
    scores = rows.select("__o", u.alias("__u"), *[(F.col(a) * u).alias(f"h{i}") for i, a in enumerate(names)])
    lagged = scores.select("*", *[F.lag(f"h{i}", q).over(w).alias(f"h{i}_{q}") for q in range(1, lags + 1) for i in range(k)])
    got = lagged.agg(F.sum(F.col("__u") ** 2).alias("sse"), *[F.coalesce(F.sum(F.col(f"h{i}") * F.col(f"h{j}_{q}" if q else f"h{j}")), F.lit(0.0)).alias(f"g{q}_{i}_{j}") for q in range(lags + 1) for i in range(k) for j in range(k)]).first()
    rows.unpersist()
    meat = np.array([[got[f"g0_{i}_{j}"] for j in range(k)] for i in range(k)])
    for q in range(1, lags + 1):
        g = np.array([[got[f"g{q}_{i}_{j}"] for j in range(k)] for i in range(k)])
        meat = meat + (1 - q / (lags + 1)) * (g + g.T)
    bread = np.linalg.inv(xx)
    se = np.sqrt(np.diag(bread @ meat @ bread))
    sst = sums["syy"] - sums["sy"] ** 2 / n
    r2 = 1 - got["sse"] / sst if sst else None
    z = 1.959963984540054
    return frame.sparkSession.createDataFrame(
        [(a, float(b), float(s), float(b / s) if s else None, float(b - z * s), float(b + z * s), r2, n) for a, b, s in zip(names, beta, se, strict=True)],
        "term string, coefficient double, se double, t double, lo double, hi double, r2 double, n long")


def spearman(frame: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation of average ranks, within each group; NULL without variance."""
    both = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__rx", avg_rank(x, *by)).withColumn("__ry", avg_rank(y, *by))
    return both.groupBy(*by).agg(F.count("*").alias("n"), safe_corr("__rx", "__ry").alias("spearman"))


def safe_corr(x: str, y: str):
    """Pearson correlation as an aggregate, NULL where a variance is zero."""
    return ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
