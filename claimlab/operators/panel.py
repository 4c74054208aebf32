"""Panel operators: returns, signals, positions, portfolio accounting.

Panels are long - one row per (date, market) - and dense (see ``densify``), so a lag over
a market's rows is a lag over the panel's dates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from claimlab.functions.expressions import avg_rank, clip, ratio

#: Target volatility of a position, the floor under volatility, the largest position.
SIGMA_EACH, LEAST_VOL, MOST_POSITION = 0.15, 0.05, 4.0

def by_market() -> WindowSpec:
    return Window.partitionBy("market").orderBy("date")


def rolling(c: Column | str, n: int, how=F.avg) -> Column:
    """Aggregate of the last n rows, NULL unless all n values are there."""
    c = F.col(c) if isinstance(c, str) else c
    frame = by_market().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, how(c).over(frame))


def change(c: str, k: int = 1) -> Column:
    return ratio(F.col(c), F.lag(c, k).over(by_market())) - 1


def market_returns(panel: DataFrame, name: str = "ret", k: int = 1) -> DataFrame:
    return panel.withColumn(name, change("close", k))


def realised_vol(panel: DataFrame, window: int = 12, per_year: int = 12) -> DataFrame:
    """Annualised rolling deviation of returns."""
    return panel.withColumn("vol", rolling("ret", window, F.stddev_samp) * math.sqrt(per_year))


def sized(signal: Column) -> Column:
    """Inverse-volatility sizing, bounded; NULL without a signal or volatility."""
    vol = F.when(F.col("vol").isNotNull(), F.greatest(F.col("vol"), F.lit(LEAST_VOL)))
    return clip(signal * SIGMA_EACH / vol, -MOST_POSITION, MOST_POSITION)


def tsmom_positions(panel: DataFrame, lookback: int = 12) -> DataFrame:
    """Sign of the market's own trailing return, sized."""
    return panel.withColumn("trailing", change("close", lookback)).withColumn("position", sized(F.signum("trailing")))


def passive_positions(panel: DataFrame, lookback: int = 12) -> DataFrame:
    """Long wherever a trailing return is defined, flat elsewhere."""
    return panel.withColumn("trailing", change("close", lookback)).withColumn("position", sized(F.when(F.col("trailing").isNotNull(), 1.0).otherwise(0.0)))


def xsmom_positions(panel: DataFrame, lookback: int = 12) -> DataFrame:
    """Twice the demeaned percentile rank of trailing returns at each date."""
    by_date = Window.partitionBy("date")
    ranked = panel.withColumn("trailing", change("close", lookback)).withColumn("rank", avg_rank("trailing", "date"))
    ranked = ranked.withColumn("pct", F.col("rank") / F.nullif(F.count("trailing").over(by_date), F.lit(0)))
    return ranked.withColumn("position", sized(2.0 * (F.col("pct") - F.avg("pct").over(by_date))))


def holding_positions(positions: DataFrame, months: int) -> DataFrame:
    """Mean of the positions of the last ``months`` rows."""
    if months <= 0:
        raise ValueError("months must be positive")
    return positions.withColumn("position", rolling("position", months))


def random_sign_positions(positions: DataFrame, seed: int) -> DataFrame:
    """The same sizes under fair coins drawn from a digest of (seed, date, market)."""
    coin = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.date_format("date", "yyyy-MM-dd"), "market")), 1, 1)
    return positions.withColumn("position", F.abs("position") * F.when(coin < "8", 1.0).otherwise(-1.0))


def contributions(positions: DataFrame) -> DataFrame:
    """Position of the date before times the date's return, by market."""
    return positions.withColumn("contribution", F.lag("position").over(by_market()) * F.col("ret"))


def portfolio_returns(positions: DataFrame, name: str = "ret") -> DataFrame:
    """Mean contribution over the markets that have one, by date."""
    return contributions(positions).groupBy("date").agg(F.avg("contribution").alias(name)).where(F.col(name).isNotNull())


def panel_turnover(positions: DataFrame) -> DataFrame:
    moved = positions.withColumn("moved", F.abs(F.col("position") - F.lag("position").over(by_market())))
    return moved.groupBy("date").agg(F.avg("moved").alias("turnover")).where("turnover is not null")


def decompose(positions: DataFrame) -> DataFrame:
    """Returns of the mean position (tilt) and of the deviation from it (timing)."""
    mean = F.avg("position").over(Window.partitionBy("date"))
    tilt = portfolio_returns(positions.withColumn("position", F.when(F.col("position").isNotNull(), mean)), "tilt")
    timing = portfolio_returns(positions.withColumn("position", F.col("position") - mean), "timing")
    return tilt.join(timing, "date")


def most_correlated_pair(panel: DataFrame, least: int = 24) -> DataFrame:
    """Pair of markets with the largest absolute correlation over common dates."""
    rets = panel.where("ret is not null").select("date", "market", "ret")
    a, b = rets.toDF("date", "left", "x"), rets.toDF("date", "right", "y")
    sums = a.join(b, "date").where("left < right").groupBy("left", "right").agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    rho = ratio("cov", F.sqrt(F.col("vx") * F.col("vy")))
    return sums.where(F.col("n") >= least).withColumn("corr", rho).orderBy(F.abs("corr").desc_nulls_last(), "left", "right").limit(1).select("left", "right", "corr")


def integer_contracts(positions: DataFrame, capital: float, point_value: float = 1.0) -> DataFrame:
    """Whole contracts (halves to even) nearest to equal sleeves of the capital."""
    if not (capital > 0 and math.isfinite(capital)):
        raise ValueError("capital must be positive and finite")
    active = F.col("position").isNotNull() & F.col("close").isNotNull()
    n = F.nullif(F.sum(active.cast("int")).over(Window.partitionBy("date")), F.lit(0))
    wanted = F.col("position") * (F.lit(capital) / n) / (F.col("close") * point_value)
    return positions.withColumn("contracts", F.when(active, F.bround(wanted, 0)))


def contract_returns(contracts: DataFrame, capital: float, point_value: float = 1.0) -> DataFrame:
    pnl = F.lag("contracts").over(by_market()) * F.lag("close").over(by_market()) * F.col("ret") * point_value
    return contracts.withColumn("pnl", pnl).groupBy("date").agg((F.sum("pnl") / capital).alias("ret")).where("ret is not null")


def contract_turnover(contracts: DataFrame, capital: float, point_value: float = 1.0) -> DataFrame:
    """Closing the last month's contracts and opening this month's, over the capital."""
    before = F.coalesce(F.abs(F.lag("contracts").over(by_market())), F.lit(0.0))
    now = F.coalesce(F.abs("contracts"), F.lit(0.0))
    return contracts.withColumn("traded", (before + now) * F.col("close") * point_value).groupBy("date").agg((F.sum("traded") / capital).alias("turnover")).where("turnover is not null")
