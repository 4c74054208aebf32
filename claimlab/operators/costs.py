"""Trading costs over return series and measured curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlab.functions.expressions import breakeven_bps, net_return, ratio


def turnover(before: DataFrame, now: DataFrame, key: str = "name", weight: str = "w") -> DataFrame:
    """Half the absolute change between two books; names in one book weigh 0 in the other."""
    a, b = before.select(key, F.col(weight).alias("a")), now.select(key, F.col(weight).alias("b"))
    zero = F.lit(0.0)
    return a.join(b, key, "full").agg((0.5 * F.sum(F.abs(F.coalesce("b", zero) - F.coalesce("a", zero)))).alias("turnover"))


def cost_sensitivity(gross: DataFrame, grid: tuple[float, ...] = (0, 5, 10, 20), sides: int = 2, per_year: int = 12, value: str = "ret", turn: str = "turnover") -> DataFrame:
    """Mean, annualised mean and Sharpe ratio of net returns for each cost."""
    if any(not math.isfinite(g) or g < 0 for g in grid):
        raise ValueError("costs must be finite and not negative")
    priced = gross.where(F.col(value).isNotNull()).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    net = net_return(value, turn, "cost_bps", sides)
    mean = F.avg(net)
    return priced.groupBy("cost_bps").agg(mean.alias("mean_per_period"), (mean * per_year).alias("mean_annualized"), (ratio(mean, F.stddev_samp(net)) * math.sqrt(per_year)).alias("sharpe"))


def breakeven_cost(gross: DataFrame, sides: int = 2, value: str = "ret", turn: str = "turnover") -> DataFrame:
    means = gross.agg(F.avg(value).alias("gross_mean"), F.avg(turn).alias("turn"))
    return means.withColumn("breakeven_bps", breakeven_bps("gross_mean", "turn", sides))


def breakeven_friction(curve: DataFrame, level: str, expectancy: str, *by: str) -> DataFrame:
    """First crossing of a measured curve from above zero, linearly interpolated."""
    w = Window.partitionBy(*by).orderBy(level)
    rows = curve.select(*by, F.col(level).alias("l0"), F.lead(level).over(w).alias("l1"), F.col(expectancy).alias("a"), F.lead(expectancy).over(w).alias("b"))
    crossing = F.when((F.col("a") > 0) & (F.col("b") <= 0), F.col("l0") + (F.col("l1") - F.col("l0")) * F.col("a") / (F.col("a") - F.col("b")))
    return rows.groupBy(*by).agg(F.min(crossing).alias("breakeven"))


def cost_anatomy(stats: DataFrame, bps: float, gross: str = "gross_mean", turn: str = "turn", sides: int = 2, per_year: int = 12) -> DataFrame:
    """Breakeven cost, net mean, share of the gross mean that costs consume, survival."""
    g = F.col(gross)
    net = net_return(gross, turn, F.lit(bps), sides)
    return stats.select("*", breakeven_bps(gross, turn, sides).alias("breakeven_bps"), net.alias("net_mean"), (net * per_year).alias("net_annualized"),
                        ((g - net) / F.nullif(F.abs(g), F.lit(0.0))).alias("cost_share_of_gross"), F.coalesce((net > 0) & (g > 0), F.lit(False)).alias("survives_costs"))
