"""Predictor construction for valuation-ratio studies, and the simple rules they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlab.functions.expressions import ratio


def log_ratio(a: str, b: str) -> Column:
    """log a - log b, NULL where either is not positive."""
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(a) - F.log(b))


def raw_predictors(months: DataFrame, order: str = "month") -> DataFrame:
    """From price, dividends, earnings, book, rates and yields: log valuation ratios,
    spreads and next month's excess return as the target.

    Columns: price, d12, e12, bm, tbl, lty, baa, aaa, corpr, ltr, infl, svar, ntis, ret, rf.
    """
    w = Window.orderBy(order)
    return months.select(
        order, log_ratio("d12", "price").alias("dp"), F.when((F.col("d12") > 0) & (F.lag("price").over(w) > 0), F.log("d12") - F.log(F.lag("price").over(w))).alias("dy"),
        log_ratio("e12", "price").alias("ep"), log_ratio("d12", "e12").alias("de"), "bm", "ntis", "tbl", "lty", "ltr", "infl", "svar",
        (F.col("lty") - F.col("tbl")).alias("tms"), (F.col("baa") - F.col("aaa")).alias("dfy"), (F.col("corpr") - F.col("ltr")).alias("dfr"),
        (F.col("ret") - F.col("rf")).alias("mr"), F.lead(F.col("ret") - F.col("rf")).over(w).alias("target"))


def standardise_backward(rows: DataFrame, predictors: list[str], target: str, order: str = "month", least: int = 36, window: int = 12) -> DataFrame:
    """Predictors over their expanding deviation (from ``least`` values on), the target
    over the uncentred volatility of the ``window`` targets before it."""
    w = Window.orderBy(order)
    seen, recent = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-window, -1)
    scaled = [F.when(F.count(p).over(seen) >= least, ratio(F.col(p), F.stddev_samp(p).over(seen))).alias(p) for p in predictors]
    vol = F.when(F.count(target).over(recent) == window, F.sqrt(F.avg(F.col(target) * F.col(target)).over(recent)))
    return rows.select(order, *scaled, ratio(F.col(target), vol).alias(target), vol.alias("target_vol"))


def mechanical_momentum(rows: DataFrame, target: str, window: int, order: str = "pos") -> DataFrame:
    """Forecast that learns nothing: linearly declining weights on the last ``window``
    targets, over the volatility of their changes."""
    w = Window.orderBy(order).rowsBetween(-window, -1)
    total = window * (window + 1) / 2
    past = F.collect_list(target).over(w)
    rows = rows.withColumn("__past", past).withColumn("__step", F.col(target) - F.lag(target).over(Window.orderBy(order)))
    weighted = F.aggregate(F.transform("__past", lambda v, i: v * (i + 1) / total), F.lit(0.0), lambda a, v: a + v)
    out = rows.withColumn("forecast", F.when(F.size("__past") == window, ratio(weighted, F.stddev_samp("__step").over(w))))
    return out.drop("__past", "__step")


def column_correlations(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str], floor: float = 0.9999, floors: dict[str, float] | None = None) -> DataFrame:
    """(column, n, corr, ok): agreement of two builds of the same columns."""
    a, b = ours.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]), theirs.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    long = a.join(b, key).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("double").alias("x"), F.col(f"b_{c}").cast("double").alias("y"), F.lit((floors or {}).get(c, floor)).alias("floor")) for c in columns]))).dropna()
    found = long.groupBy("column", "floor").agg(F.count("*").alias("n"), ratio(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y"))).alias("corr"))
    return found.select("column", "n", "corr", (F.col("corr") >= F.col("floor")).alias("ok"))
