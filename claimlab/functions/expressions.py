"""Column expressions: NaN-free numbers, sizing, costs, normal distribution, options.

Missing numbers are NULL throughout; expressions that need a defined argument give NULL
where it is missing, also where Spark's own least/greatest would skip it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN becomes NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Bounded to [lo, hi]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def avg_rank(c: Column | str, *partition: str) -> Column:
    """Rank with ties averaged among the non-null values of a partition."""
    c = col(c)
    ordered = Window.partitionBy(*partition).orderBy(c.asc_nulls_last())
    ties = Window.partitionBy(*partition, c)
    return F.when(c.isNotNull(), F.rank().over(ordered) + (F.count("*").over(ties) - 1) / 2)


def floor_div(a: Column | str, b: Column | str) -> Column:
    """Float floor division of positive numbers, exact where floor(a / b) is not."""
    a, b = col(a), col(b)
    return F.round((a - a % b) / b)


def net_return(gross: Column | str, turn: Column | str, bps: Column | str, sides: int = 2) -> Column:
    return col(gross) - col(turn) * (col(bps) / 1e4) * sides


def breakeven_bps(gross_mean: Column | str, turn: Column | str, sides: int = 2) -> Column:
    """Cost at which the mean vanishes; infinite or NULL without turnover."""
    g, t = col(gross_mean), col(turn)
    return F.when(t > 0, g / F.nullif(t * sides, F.lit(0.0)) * 1e4).when(g > 0, F.lit(float("inf")))


def iv_scaled_spread(iv: Column | str, base: float = 0.05, ref: float = 0.30, slope: float = 1.0, most: float = 0.30) -> Column:
    iv = col(iv)
    scaled = F.lit(base) * (1.0 + slope * (iv / ref - 1.0))
    return F.when(iv > 0, F.least(F.greatest(scaled, F.lit(base * 0.5)), F.lit(most))).otherwise(F.lit(base))


def budget_units(price: Column | str, budget: float = 10_000.0, multiplier: int = 100) -> Column:
    """Whole units that a budget buys; none at a price that is not positive."""
    unit = col(price) * multiplier
    return F.when(unit > 0, floor_div(F.lit(budget), unit)).otherwise(0.0).cast("long")


def iv_is_trustworthy(iv: Column | str, dte: Column | str, delta: Column | str) -> Column:
    return F.coalesce((col(dte) >= 14) & col(delta).between(0.05, 0.90) & (col(iv) > 0.03) & (col(iv) < 2.0), F.lit(False))


# The rational approximation of the normal distribution after Hart and West (2005).
NORMAL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
NORMAL_SWITCH, NORMAL_TAIL = 7.07106781186547, 2.506628274631


def _horner(z: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {z} + {c!r})"
    return out


def norm_cdf_sql(x: str) -> str:
    """The normal distribution function as arithmetic that any SQL engine runs."""
    z, e = f"abs({x})", f"exp(-({x}) * ({x}) / 2e0)"
    tail = f"({z} + 1e0 / ({z} + 2e0 / ({z} + 3e0 / ({z} + 4e0 / ({z} + 0.65e0)))))"
    upper = f"CASE WHEN {z} > 37 THEN 0e0 WHEN {z} < {NORMAL_SWITCH!r} THEN {e} * {_horner(z, NORMAL_TOP)} / {_horner(z, NORMAL_BOTTOM)} ELSE {e} / {tail} / {NORMAL_TAIL!r} END"
    return f"(CASE WHEN {x} > 0 THEN 1e0 - ({upper}) ELSE ({upper}) END)"


def norm_cdf(x: Column) -> Column:
    """The same on a column, which is bound once."""
    z = F.abs(x)
    horner = lambda cs: __import__("functools").reduce(lambda acc, c: acc * z + F.lit(c), cs[1:], F.lit(cs[0]))
    e = F.exp(-x * x / 2)
    tail = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))
    upper = F.when(z > 37, 0.0).when(z < NORMAL_SWITCH, e * horner(NORMAL_TOP) / horner(NORMAL_BOTTOM)).otherwise(e / tail / NORMAL_TAIL)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def bs_price(s: Column, k: Column, t: Column, r: float, sigma: Column, call: bool = True) -> Column:
    """European option price; intrinsic value at expiry, discounted forward without volatility."""
    side = 1.0 if call else -1.0
    root = sigma * F.sqrt(t)
    d1 = (F.log(s / k) + (r + 0.5 * sigma * sigma) * t) / root
    d2 = d1 - root
    pv = k * F.exp(-r * t)
    full = side * s * norm_cdf(side * d1) - side * pv * norm_cdf(side * d2)
    return F.when(t <= 0, F.greatest(side * (s - k), F.lit(0.0))).when(sigma <= 0, F.greatest(side * (s - pv), F.lit(0.0))).otherwise(full)


def bs_greeks(s: Column, k: Column, t: Column, r: float, sigma: Column, call: bool = True) -> Column:
    """Struct of delta, gamma, vega (per 1.00 of volatility) and theta (per year)."""
    side = 1.0 if call else -1.0
    root = sigma * F.sqrt(t)
    d1 = (F.log(s / k) + (r + 0.5 * sigma * sigma) * t) / root
    d2 = d1 - root
    dead = (t <= 0) | (sigma <= 0)
    pdf = norm_pdf(d1)
    delta = norm_cdf(d1) - (0.0 if call else 1.0)
    theta = -s * pdf * sigma / (2 * F.sqrt(t)) - side * r * k * F.exp(-r * t) * norm_cdf(side * d2)
    return F.struct(
        F.when(dead, F.when(side * (s - k) > 0, side).otherwise(0.0)).otherwise(delta).alias("delta"),
        F.when(dead, 0.0).otherwise(pdf / (s * root)).alias("gamma"),
        F.when(dead, 0.0).otherwise(s * pdf * F.sqrt(t)).alias("vega"),
        F.when(dead, 0.0).otherwise(theta).alias("theta"))


def normal_arrays() -> tuple:
    """The distribution function and the density on arrays.  Made inside the functions
    that run on the executors, which so need no module of ours there."""
    top, bottom, switch, tail_scale = NORMAL_TOP, NORMAL_BOTTOM, NORMAL_SWITCH, NORMAL_TAIL

    def cdf(x):
        z = np.minimum(np.abs(x), 37.0)
        e = np.exp(-z * z / 2)
        far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / tail_scale
        upper = np.where(np.abs(x) > 37, 0.0, np.where(z < switch, e * np.polyval(top, z) / np.polyval(bottom, z), far))
        return np.where(x > 0, 1 - upper, upper)

    def pdf(x):
        return np.exp(-np.minimum(x * x, 1400.0) / 2) / 2.5066282746310002

    return cdf, pdf


def implied_vol(price: Column, s: Column, k: Column, t: Column, r: float, call: bool = True, steps: int = 60) -> Column:
    """Volatility in [1e-4, 5] that gives the price; NULL if there is none.

    Newton's method on whole Arrow batches, from the volatility at which the price bends,
    inside a bracket that each step narrows; a step that would leave the bracket halves
    it.  A price that misses the bracket's own prices by rounding alone is inside: deep in
    the money all low volatilities give one price.  Built-in functions could only say this as an interpreted loop, a row at a time.
    """
    side = 1.0 if call else -1.0
    cdf, pdf = normal_arrays()

    def solve(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        p, s, k, t = (x.to_numpy(float) for x in (price, s, k, t))
        with np.errstate(all="ignore"):
            pv, m, root = k * np.exp(-r * t), np.log(s / k) + r * t, np.sqrt(t)

            def off(v):
                width = v * root
                d1 = m / width + width / 2
                return side * s * cdf(side * d1) - side * pv * cdf(side * (d1 - width)) - p, s * root * pdf(d1)

            lo, hi = np.full(len(p), 1e-4), np.full(len(p), 5.0)
            rounding = 1e-14 * (s + pv)
            fits = (t > 0) & (p > 0) & (p >= np.maximum(side * (s - k), 0.0) - 1e-6) & (off(lo)[0] <= rounding) & (off(hi)[0] >= -rounding)
            v = np.clip(np.sqrt(2 * np.abs(m) / t), 0.01, 4.0)
            for _ in range(steps):
                miss, slope = off(v)
                lo, hi = np.where(miss < 0, v, lo), np.where(miss < 0, hi, v)
                step = v - miss / np.maximum(slope, 1e-300)
                new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
                done = np.nanmax(np.abs(new - v), initial=0.0) < 1e-15
                v = new
                if done:
                    break
        return pd.Series(np.where(fits, v, np.nan))

    return F.pandas_udf(solve, T.DoubleType())(price, s, k, t)


def norm_ppf(p: Column, steps: int = 5) -> Column:
    """Inverse of the normal distribution function, by Halley steps on Arrow batches from
    a power-law guess on the upper half; NULL outside (0, 1)."""
    cdf, pdf = normal_arrays()

    def solve(p: pd.Series) -> pd.Series:
        q = p.to_numpy(float)
        with np.errstate(all="ignore"):
            upper = np.maximum(q, 1 - q)
            z = 5.5556 * (1 - ((1 - upper) / upper) ** 0.1186)
            for _ in range(steps):
                u = (cdf(z) - upper) / pdf(z)
                z = z - u / (1 + z * u / 2)
            return pd.Series(np.where((q > 0) & (q < 1), np.where(q < 0.5, -z, z), np.nan))

    return F.pandas_udf(solve, T.DoubleType())(p)


def strike_from_delta(delta: Column, s: Column, t: Column, r: float, sigma: Column) -> Column:
    """Strike at which a call has the delta; NULL outside [s / 20, 5 s]."""
    strike = s * F.exp((r + 0.5 * sigma * sigma) * t - norm_ppf(delta) * sigma * F.sqrt(t))
    return F.when(strike.between(s / 20, s * 5), strike)


def pnl_attribution(s0: Column, s1: Column, iv0: Column, iv1: Column, k: Column, t0: Column, dt: Column, r: float, call: bool = True) -> Column:
    """Struct: an option's price change as delta, vega and theta terms and the rest."""
    t1 = F.greatest(t0 - dt, F.lit(0.0))
    p0, p1 = bs_price(s0, k, t0, r, iv0, call), bs_price(s1, k, t1, r, iv1, call)
    g = bs_greeks(s0, k, t0, r, iv0, call)
    parts = {"delta": g["delta"] * (s1 - s0), "vega": g["vega"] * (iv1 - iv0), "theta": g["theta"] * dt}
    total = p1 - p0
    rest = total - parts["delta"] - parts["vega"] - parts["theta"]
    return F.struct(total.alias("total"), *[v.alias(n) for n, v in parts.items()], rest.alias("residual"), p0.alias("p0"), p1.alias("p1"))


def cusum_hits(series: Column, k: float = 1.5, h: float = 5.0, baseline_n: int = 60) -> Column:
    """Places (from 0) at which a one-sided CUSUM below the baseline alarms.

    Baseline and its deviation (of the population, 0.02 if degenerate) come from the first
    ``baseline_n`` values; an alarm re-arms when a value is back in control.
    """
    first = F.filter(F.slice(series, 1, baseline_n), lambda v: v.isNotNull())
    n = F.nullif(F.size(first), F.lit(0)).cast("double")
    mean = F.aggregate(first, F.lit(0.0), lambda a, v: a + v) / n

    def body(base: Column) -> Column:
        m = base["m"]
        sd = F.sqrt(F.aggregate(first, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n)
        return F.struct(m.alias("m"), F.when(sd > 1e-6, sd).otherwise(0.02).alias("sd"))

    def run(base: Column) -> Column:
        slack, limit = k * base["sd"], h * base["sd"]
        start = F.struct(F.lit(0.0).alias("s"), F.lit(False).alias("on"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

        def step(a: Column, v: Column) -> Column:
            s = F.greatest(F.lit(0.0), a["s"] + (base["m"] - v - slack))
            fires = ~a["on"] & (s > limit)
            back = a["on"] & (v >= base["m"] - slack)
            moved = F.struct(
                F.when(fires | back, 0.0).otherwise(s).alias("s"), F.when(fires, True).when(back, False).otherwise(a["on"]).alias("on"), (a["at"] + 1).alias("at"),
                F.when(fires, F.concat(a["hits"], F.array(a["at"]))).otherwise(a["hits"]).alias("hits"))
            idle = F.struct(a["s"].alias("s"), a["on"].alias("on"), (a["at"] + 1).alias("at"), a["hits"].alias("hits"))
            return F.when(v.isNotNull() & base["m"].isNotNull(), moved).otherwise(idle)

        return F.aggregate(series, start, step, lambda a: a["hits"])

    based = F.transform(F.array(F.struct(mean.alias("m"))), body)
    return F.transform(based, run)[0]
