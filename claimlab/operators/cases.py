"""Case studies over trade ledgers, strategy grids and daily series.

Each study is a composition of relational steps over whole tables; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlab.functions import expressions as X
from claimlab.operators import bootstrap as B
from claimlab.operators import evaluate as E
from claimlab.operators.robust import conclusion_stability


def event_count(trades: DataFrame, which: Column, keys: list[str], expected: int | None = None) -> DataFrame:
    """Distinct events behind the chosen trades, and whether they are as many as a
    recorded probe says."""
    events = trades.where(which).agg(F.count_distinct(F.struct(*keys)).alias("events"))
    return events.withColumn("verified", F.lit(None).cast("boolean") if expected is None else F.col("events") == expected)


def volatility_moves(trades: DataFrame, status: str, far_days: int, iv_in: str = "iv_in", iv_out: str = "iv_out", dte_out: str = "dte_out") -> DataFrame:
    """n, mean, median and share falling of the change in implied volatility, over all
    trades and over those closed far from expiry; by status, and ``any`` status."""
    change = F.col(iv_out) - F.col(iv_in)
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col(dte_out) >= far_days, "far")))
    rows = trades.select(F.col(status).alias("status"), change.alias("d"), F.explode(scopes).alias("scope")).where("d is not null")
    per = rows.groupingSets([["scope"], ["scope", "status"]], "scope", "status").agg(
        F.grouping("status").alias("whole"), F.count("*").alias("n"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"), F.avg((F.col("d") < 0).cast("double")).alias("share_falling"))
    return per.select("scope", F.when(F.col("whole") == 1, "any").otherwise(F.col("status")).alias("status"), "n", "mean", "median", "share_falling")


def coverage(trades: DataFrame, usable: Column, value: str) -> DataFrame:
    """How many rows a study leaves out, and what they earned."""
    ok = F.coalesce(usable, F.lit(False))
    v = F.col(value)
    return trades.agg(F.count("*").alias("total"), F.count_if(ok).alias("covered"), F.count_if(~ok).alias("excluded"), F.avg(F.when(ok, v)).alias("covered_mean"), F.avg(F.when(~ok, v)).alias("excluded_mean"))


def modelled_attribution(trades: DataFrame, rate: float, multiplier: float = 100.0) -> DataFrame:
    """Trades with a trustworthy volatility, their result split by the option model: adds
    total_pnl, delta_pnl, vega_pnl, theta_pnl, residual_pnl and modelled_entry.

    ``trades``: s_in, s_out, iv_in, iv_out, delta, dte_in, held_days, contracts, cost_in,
    dollar_pnl.  The strike is the one that has the delta at entry.  Two prices and the
    Greeks of a call are worked out on Arrow batches: as one expression they outgrow what
    the compiler takes.
    """
    c = F.col
    cdf, pdf = X.normal_arrays()
    parts = ("total", "delta", "vega", "theta", "residual")

    def split(s0: pd.Series, s1: pd.Series, v0: pd.Series, v1: pd.Series, k: pd.Series, t0: pd.Series, dt: pd.Series) -> pd.DataFrame:
        s0, s1, v0, v1, k, t0, dt = (x.to_numpy(float) for x in (s0, s1, v0, v1, k, t0, dt))

        def price(s, v, t):
            root = v * np.sqrt(t)
            d1 = (np.log(s / k) + (rate + v * v / 2) * t) / root
            alive = s * cdf(d1) - k * np.exp(-rate * t) * cdf(d1 - root)
            return np.where(t <= 0, np.maximum(s - k, 0.0), np.where(v <= 0, np.maximum(s - k * np.exp(-rate * t), 0.0), alive)), d1, d1 - root

        with np.errstate(all="ignore"):
            p0, d1, d2 = price(s0, v0, t0)
            p1, _, _ = price(s1, v1, np.maximum(t0 - dt, 0.0))
            theta = -s0 * pdf(d1) * v0 / (2 * np.sqrt(t0)) - rate * k * np.exp(-rate * t0) * cdf(d2)
            out = {"total": p1 - p0, "delta": cdf(d1) * (s1 - s0), "vega": s0 * pdf(d1) * np.sqrt(t0) * (v1 - v0), "theta": theta * dt}
            return pd.DataFrame({**out, "residual": out["total"] - out["delta"] - out["vega"] - out["theta"], "p0": p0})

    years = c("dte_in") / 365.0
    usable = c("iv_in").isNotNull() & c("iv_out").isNotNull() & c("s_out").isNotNull() & X.iv_is_trustworthy("iv_in", "dte_in", "delta")
    struck = trades.where(usable).withColumn("k", X.strike_from_delta(c("delta"), c("s_in"), years, rate, c("iv_in"))).where("k is not null")
    kind = T.StructType([T.StructField(p, T.DoubleType()) for p in (*parts, "p0")])
    told = struck.withColumn("a", F.pandas_udf(split, kind)("s_in", "s_out", "iv_in", "iv_out", "k", years, c("held_days") / 365.0))
    scale = c("contracts") * multiplier
    return told.select("*", *[(c(f"a.{p}") * scale).alias(f"{p}_pnl") for p in parts], c("a.p0").alias("modelled_entry")).drop("a", "k")


def attribution_validity(attributed: DataFrame) -> DataFrame:
    """How well the model's entry prices and results agree with those paid and made."""
    entry, paid = F.col("modelled_entry"), F.col("cost_in")
    return attributed.agg(F.count("*").alias("n"), E.safe_corr("modelled_entry", "cost_in").alias("entry_corr"), F.percentile(X.ratio(entry, paid), F.lit(0.5)).alias("entry_median_ratio"),
                          E.safe_corr("total_pnl", "dollar_pnl").alias("pnl_corr"), F.avg(F.col("total_pnl") - F.col("dollar_pnl")).alias("modelled_minus_actual"))


def perturbed(trades: DataFrame, members: DataFrame, keys: list[str], entity: str, base_label: str, value: str = "dollar_pnl") -> DataFrame:
    """Conclusions in every cell of a perturbed universe, and whether their signs are the
    base cell's.

    ``members`` has (label, keys...): a trade is in a cell if its keys are.  All cells go
    through one join; ``untested`` counts members whose entity has no trade at all.
    """
    members = members.select("label", *keys).distinct()
    tested = trades.select(entity).distinct().withColumn("traded", F.lit(1))
    sizes = members.join(tested, entity, "left").groupBy("label").agg(F.count("*").alias("members"), F.count_distinct(F.when(F.col("traded").isNull(), F.col(entity))).alias("untested"))
    v = F.col(value)
    per = trades.join(members, keys).groupBy("label").agg(F.count("*").alias("n_trades"), F.avg(v).alias("mean_pnl"), F.percentile(v, F.lit(0.5)).alias("median_pnl"), F.avg((v > 0).cast("double")).alias("win"))
    cells = sizes.join(per, "label", "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))
    return conclusion_stability(cells, ["mean_pnl", "median_pnl"], base_label)


def rank_inversion(rows: DataFrame, name: str, modelled: str, actual: str) -> DataFrame:
    """Whether the best by the model is another than the best in fact; ties by name."""
    named = lambda c: F.when(F.col(c).isNotNull(), F.col(name))
    key = lambda c, sign: F.when(F.col(c).isNotNull(), F.struct(sign * F.col(c), F.col(name)))
    best = rows.agg(F.min_by(named(modelled), key(modelled, -1)).alias("modelled_best"), F.min_by(named(actual), key(actual, -1)).alias("actual_best"), F.min_by(named(actual), key(actual, 1)).alias("actual_worst"))
    return best.withColumn("rank_inverted", F.coalesce(F.col("modelled_best") != F.col("actual_best"), F.lit(False)))


def gradient(grid: DataFrame, by: str, *metrics: str) -> DataFrame:
    """Mean of the metrics and number of cells at each level of a parameter."""
    return grid.groupBy(by).agg(F.count("*").alias("cells"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def same_shape(one: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Whether two tables have the same keys, and values of the same sign at each."""
    both = one.select(key, F.signum(value).alias("a")).join(other.select(key, F.signum(value).alias("b")), key, "full")
    return both.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))), F.lit(False)).alias("same_shape"))


def driver_at(driver: DataFrame, moment: DataFrame, time_col: str = "date", value: str = "value") -> DataFrame:
    """The driver's last value up to a moment (one row, ``at``) and its last value."""
    known = F.when(F.col(time_col) <= F.col("at"), F.col(time_col))
    return driver.crossJoin(F.broadcast(moment.agg(F.min("at").alias("at")))).agg(F.max_by(F.when(known.isNotNull(), F.col(value)), known).alias("at_alarm"), F.max_by(value, time_col).alias("latest"))


def cumulative_growth(series: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    """Adds ``growth``: the product of 1 + value up to the row, within each group; missing
    values leave it as it is."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("growth", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))


def month_end(daily: DataFrame, date: str, value: str, *by: str) -> DataFrame:
    """The last non-null value of each month, and the day it is of."""
    day = F.when(F.col(value).isNotNull(), F.col(date))
    return daily.groupBy(*by, F.last_day(date).alias("month")).agg(F.max(day).alias("day"), F.max_by(F.when(day.isNotNull(), F.col(value)), day).alias("value"))


def date_problems(rows: DataFrame, date: str, place: str, *by: str) -> DataFrame:
    """Null dates, dates before their predecessor, repeated dates; rows in ``place`` order."""
    w = Window.partitionBy(*by).orderBy(place)
    prior = rows.withColumn("__before", F.lag(date).over(w))
    return prior.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(date).isNull()).alias("missing"), F.count_if(F.col(date) < F.col("__before")).alias("unsorted"), F.count_if(F.col(date) == F.col("__before")).alias("repeated"))


def stats_bundle(series: DataFrame, value: str = "ret", order: str = "date", per_year: int = 12, n_boot: int = 2000, block: int = 6) -> DataFrame:
    """Sharpe statistics with the bootstrap intervals of the mean and the Sharpe ratio."""
    stats = E.sharpe(series, value, per_year)
    mean = B.mean_ci(series, value, order, n_boot, block).select(F.col("lo").alias("mean_lo"), F.col("hi").alias("mean_hi"))
    sharpe = B.sharpe_ci(series, value, order, n_boot, block, per_year=per_year).select(F.col("lo").alias("sharpe_lo"), F.col("hi").alias("sharpe_hi"))
    return stats.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(sharpe))  # one row each


def against_benchmarks(series: DataFrame, value: str, benchmarks: list[str], order: str = "date") -> DataFrame:
    """(benchmark, n, sharpe, own, corr): the strategy beside each of its benchmarks."""
    rows = series.select(order, value, F.explode(F.array(*[F.struct(F.lit(b).alias("benchmark"), F.col(b).alias("b")) for b in benchmarks])).alias("x")).select(order, value, "x.*").dropna()
    root = F.sqrt(F.lit(12.0))
    per = rows.groupBy("benchmark")
    return per.agg(F.count("*").alias("n"), (X.ratio(F.avg("b"), F.stddev_samp("b")) * root).alias("sharpe"), (X.ratio(F.avg(value), F.stddev_samp(value)) * root).alias("own"), E.safe_corr(value, "b").alias("corr"))


def momentum_protocol(series: DataFrame, turnover: DataFrame, randomised: DataFrame, sealed_from: str, bps: float, order: str = "date", value: str = "ret", benchmarks: tuple[str, ...] = ("passive", "xs"),
                      n_boot: int = 2000, block: int = 6) -> DataFrame:
    """The four registered criteria, worked out: one row.

    K1 fires if the interval of the alpha over the benchmarks holds zero, K2 if that of
    the sealed block's Sharpe ratio does, K3 if that of the mean net of costs (``bps`` per
    unit of position change) does, K4 if fewer than 95 percent of the sign-randomised
    draws (``randomised``: sharpe) lie below the strategy.
    """
    alpha = E.spanning(series, value, list(benchmarks), order).where("term = 'const'").select(F.col("coefficient").alias("alpha"), F.col("lo").alias("alpha_lo"), F.col("hi").alias("alpha_hi"))
    sealed = B.sharpe_ci(series.where(F.col(order) >= F.lit(sealed_from)), value, order, n_boot, block).select(F.col("lo").alias("sealed_lo"), F.col("hi").alias("sealed_hi"))
    net = series.join(turnover.select(order, "turnover"), order, "left").withColumn("net", F.col(value) - F.coalesce("turnover", F.lit(0.0)) * bps / 1e4)
    costs = B.mean_ci(net, "net", order, n_boot, block).select(F.col("lo").alias("net_lo"), F.col("hi").alias("net_hi"))
    own = E.sharpe(series, value).select(F.col("sharpe").alias("own"))
    signs = randomised.crossJoin(F.broadcast(own)).agg(F.avg((F.col("sharpe") < F.col("own")).cast("double")).alias("percentile"))
    one = alpha.crossJoin(F.broadcast(sealed)).crossJoin(F.broadcast(costs)).crossJoin(F.broadcast(signs))  # one row each
    holds = lambda x: (F.col(f"{x}_lo") <= 0) & (F.col(f"{x}_hi") >= 0)
    fired = F.array_compact(F.array(F.when(holds("alpha"), "K1"), F.when(holds("sealed"), "K2"), F.when(holds("net"), "K3"), F.when(F.col("percentile") < 0.95, "K4")))
    return one.withColumn("fired", F.concat_ws(",", fired))
