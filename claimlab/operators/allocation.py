"""Volatility-managed and real-time mean-variance allocation of monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlab.functions.expressions import ratio


def managed(months: DataFrame, calibrate_to: str, month: str = "month", ret: str = "ret", variance: str = "realised_var") -> DataFrame:
    """Returns over last month's realised variance, scaled to the unmanaged variance over
    the calibration block; turnover is the change of the weight, 0 at first."""
    w = Window.orderBy(month)
    raw = months.withColumn("rv", F.lag(variance).over(w)).where("rv > 0").withColumn("raw", F.col(ret) / F.col("rv"))
    block = raw.where(F.col(month) <= F.lit(calibrate_to).cast("date"))
    scale = block.agg(F.sqrt(ratio(F.var_samp(ret), F.var_samp("raw"))).alias("c"))  # one row
    out = raw.join(F.broadcast(scale)).withColumn("managed", F.col("raw") * F.col("c")).withColumn("weight", ratio(F.col("c") * F.col("raw"), F.col(ret)))
    return out.withColumn("turnover", F.coalesce(F.abs(F.col("weight") - F.lag("weight").over(w)), F.lit(0.0)))


def realtime(series: DataFrame, x: str, y: str, order: str = "date", gamma: float = 5.0, cap: float = 5.0, least: int = 120) -> DataFrame:
    """Weights of two assets from the moments of all earlier rows, gross exposure capped."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    m = series.select("*", F.count("*").over(w).alias("n"), F.avg(x).over(w).alias("mx"), F.avg(y).over(w).alias("my"),
                      F.var_samp(x).over(w).alias("vx"), F.var_samp(y).over(w).alias("vy"), F.covar_samp(x, y).over(w).alias("vxy")).where(F.col("n") >= least)
    det = F.nullif(F.col("vx") * F.col("vy") - F.col("vxy") ** 2, F.lit(0.0)) * gamma
    raw = m.withColumn("wx", (F.col("vy") * F.col("mx") - F.col("vxy") * F.col("my")) / det).withColumn("wy", (F.col("vx") * F.col("my") - F.col("vxy") * F.col("mx")) / det)
    shrink = F.least(F.lit(1.0), cap / F.nullif(F.abs("wx") + F.abs("wy"), F.lit(0.0)))
    return raw.select(order, x, y, (F.col("wx") * shrink).alias("wx"), (F.col("wy") * shrink).alias("wy")).withColumn("ret", F.col("wx") * F.col(x) + F.col("wy") * F.col(y))
