"""Dense linear algebra on Arrow batches: random features, ridge paths, kernels, generators.

Matrices a key owns - a window of T rows, one feature draw - fit a task by construction;
keys are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.session import ship


def rff_matrix(x: np.ndarray, p: int, gamma: float = 2.0, seed: int = 0) -> np.ndarray:
    """p random Fourier features, sines and cosines interleaved; p is even."""
    if p % 2:
        raise ValueError("the number of features must be even")
    omega = np.random.default_rng(seed).standard_normal((x.shape[1], p // 2)) * gamma
    angle = x @ omega
    out = np.empty((len(x), p))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle)
    return out


def rff(rows: DataFrame, vector: str, p: int, gamma: float = 2.0, seed: int = 0, key: str = "t") -> DataFrame:
    """(key, features array<double>): the weights are drawn anew, equal, in every task."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "features": list(rff_matrix(np.stack(batch[vector].to_numpy()).astype(float), p, gamma, seed))})

    return rows.select(key, vector).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, features array<double>")


def ridge_path(x: np.ndarray, y: np.ndarray, z_grid: list[float], scale_by_t: bool = True) -> np.ndarray:
    """Coefficients for all penalties from one singular value decomposition; without a
    penalty, singular values up to 1e-12 count as zero."""
    u, d, vt = np.linalg.svd(x, full_matrices=False)
    uy = u.T @ y
    out = []
    for z in z_grid:
        penalty = z * len(x) if scale_by_t else z
        gain = np.where(d > 1e-12, 1 / np.where(d > 1e-12, d, 1.0), 0.0) if z == 0 else d / (d * d + penalty)
        out.append(vt.T @ (gain * uy))
    return np.array(out)


def rolling_forecasts(rows: DataFrame, vector: str, target: str, window: int, z_grid: list[float], pos: str = "pos", chunk: int = 256) -> DataFrame:
    """(pos, z, forecast): at each row the forecast of its target from the ``window`` rows
    before.  Chunks of positions carry the window before them, so they are independent."""
    ship(rows.sparkSession)
    chunk = max(chunk, window)
    own, last = (F.col(pos) / chunk).cast("long"), ((F.col(pos) + window) / chunk).cast("long")
    dealt = rows.select(F.col(pos).alias("pos"), F.col(vector).alias("x"), F.col(target).alias("y")).withColumn("own", own).withColumn("chunk", F.explode(F.when(last > own, F.array(own, last)).otherwise(F.array(own))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        x, y, out = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(float), []
        for k in np.flatnonzero((part["own"] == part["chunk"]).to_numpy()):
            if k < window:
                continue
            for z, b in zip(z_grid, ridge_path(x[k - window : k], y[k - window : k], z_grid), strict=True):
                out.append((part["pos"].iat[k], z, float(x[k] @ b)))
        return pd.DataFrame(out, columns=["pos", "z", "forecast"])

    return dealt.groupBy("chunk").applyInPandas(run, "pos long, z double, forecast double")


def timing_strategy(forecasts: DataFrame, returns: DataFrame, key: str = "pos", forecast: str = "forecast", ret: str = "ret") -> DataFrame:
    return forecasts.join(returns.select(key, ret), key).withColumn("strategy", F.col(forecast) * F.col(ret))


def gaussian_kernel(x: np.ndarray, gamma: float) -> np.ndarray:
    """All pairs' kernel values, from the inner products of the rows."""
    inner = x @ x.T
    norm = np.diag(inner)
    apart = norm[:, None] + norm - 2 * inner
    return np.exp(-0.5 * gamma * gamma * np.maximum(apart, 0.0))


def least_squares(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The shortest solution; directions without weight in the matrix stay out of it."""
    values, vectors = np.linalg.eigh(matrix)
    kept = values > 1e-15 * len(matrix) * values[-1]
    return vectors[:, kept] @ ((right @ vectors[:, kept]) / values[kept])


def kernel_weights(rows: DataFrame, vector: str, window: int, gamma: float = 2.0, pos: str = "pos", chunk: int = 256) -> DataFrame:
    """(pos, weights array<double>): weights of the ``window`` earlier targets in the
    ridgeless Gaussian-kernel forecast; they depend on the predictors alone."""
    ship(rows.sparkSession)
    chunk = max(chunk, window)
    own, last = (F.col(pos) / chunk).cast("long"), ((F.col(pos) + window) / chunk).cast("long")
    dealt = rows.select(F.col(pos).alias("pos"), F.col(vector).alias("x")).withColumn("own", own).withColumn("chunk", F.explode(F.when(last > own, F.array(own, last)).otherwise(F.array(own))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable").reset_index(drop=True)
        kernel = gaussian_kernel(np.stack(part["x"].to_numpy()).astype(float), gamma)
        mine = part.index[(part["own"] == part["chunk"]) & (part.index >= window)]
        # A window's matrix is a block on the diagonal of the chunk's.
        weights = [least_squares(kernel[k - window : k, k - window : k], kernel[k - window : k, k]) for k in mine]
        # Without a row that has a window before it, pandas would take the weights for numbers.
        return pd.DataFrame({"pos": part.loc[mine, "pos"], "weights": pd.Series(weights, mine, object)})

    return dealt.groupBy("chunk").applyInPandas(run, "pos long, weights array<double>")


def apply_weights(weights: DataFrame, series: DataFrame, pos: str = "pos", value: str = "y") -> DataFrame:
    """(pos, forecast): weighted sums of the earlier targets, for any target series."""
    lagged = weights.select(F.col(pos).alias("at"), F.posexplode("weights").alias("k", "w"), F.size("weights").alias("n"))
    joined = lagged.withColumn(pos, F.col("at") - F.col("n") + F.col("k")).join(series.select(pos, value), pos)
    return joined.groupBy(F.col("at").alias(pos)).agg(F.sum(F.col("w") * F.col(value)).alias("forecast"))


def weight_profile(weights: DataFrame, pos: str = "pos") -> DataFrame:
    """(lag, weight): mean weight by lag, 0 the most recent - momentum if it falls off."""
    each = weights.select(F.posexplode(F.reverse("weights")).alias("lag", "weight"))
    return each.groupBy("lag").agg(F.avg("weight").alias("weight"))


def persistent(rng: np.random.Generator, n: int, k: int, rho: float) -> np.ndarray:
    """Autoregressive predictors of unit variance that start at zero."""
    shocks = rng.standard_normal((n, k)) * np.sqrt(1 - rho**2)
    out = np.zeros((n, k))
    for now in range(1, n):
        out[now] = shocks[now] + rho * out[now - 1]
    return out


#: Fixed value: monthly volatility of simulated returns.
NOISE = 0.04


def pure_noise(spark: SparkSession, n: int, k: int = 5, seed: int = 0, rho: float = 0.95) -> DataFrame:
    """(pos, x array<double>, y): persistent predictors of nothing."""
    rng = np.random.default_rng(seed)
    return _frame(spark, persistent(rng, n, k, rho), rng.standard_normal(n) * NOISE)


def planted_linear(spark: SparkSession, n: int, k: int = 3, snr: float = 0.35, seed: int = 0, rho: float = 0.9) -> DataFrame:
    """A linear signal of the given size relative to the noise."""
    rng = np.random.default_rng(seed)
    x = persistent(rng, n, k, rho)
    signal = x @ rng.standard_normal(k)
    return _frame(spark, x, signal / signal.std() * (snr * NOISE) + rng.standard_normal(n) * NOISE)


def planted_nonlinear(spark: SparkSession, n: int, seed: int = 0, rho: float = 0.9, snr: float = 0.6) -> DataFrame:
    """A signal in cos(2 x), which no linear model sees: a standardised even function of
    one predictor, added by the executors to the plain noise of the same draw."""
    rng = np.random.default_rng(seed)
    path = persistent(rng, n, 1, rho)
    plain = _frame(spark, path, rng.standard_normal(n) * NOISE).withColumn("even", 1 - 2 * F.sin(F.col("x")[0]) ** 2)
    moments = plain.agg(F.avg("even").alias("centre"), F.stddev_pop("even").alias("spread"))
    lifted = (F.col("even") - F.col("centre")) / F.col("spread") * (snr * NOISE)
    return plain.crossJoin(F.broadcast(moments)).select("pos", "x", (F.col("y") + lifted).alias("y"))  # one row of moments


def reversal_world(series: DataFrame, order: str, value: str, theta: tuple[float, float] = (-0.8, -0.4), scale: float = 1.0, seed: int = 0) -> DataFrame:
    """The series plus a moving average of order two that turns back.

    The shocks are a table by position, as many as rows and two; the average is a window
    over it.  Monthly series: their order is one window.
    """
    spark = series.sparkSession
    placed = series.withColumn("__at", F.row_number().over(Window.orderBy(order)) + 1)
    told = series.agg(F.count("*").alias("n"), F.stddev_pop(value).alias("sd")).first()
    shocks = spark.createDataFrame(pd.DataFrame({"__at": np.arange(told["n"] + 2), "u": np.random.default_rng(seed).standard_normal(told["n"] + 2)}))
    w = Window.orderBy("__at")
    turned = F.col("u") + sum(F.lit(c) * F.lag("u", k).over(w) for k, c in enumerate(theta, start=1))
    return placed.join(shocks.select("__at", turned.alias("__turned")), "__at").withColumn(value, F.col(value) + F.col("__turned") * F.lit((told["sd"] or 0.0) * scale)).select(*series.columns)


def momentum_world(spark: SparkSession, kind: str, markets: list[str], days: int, seed: int = 0, drift: float = 0.0011, tilt: float = 0.0006, noise: float = 0.012, stay: float = 377 / 378) -> DataFrame:
    """(day, market, ret): daily returns of a world whose source of profit is known.

    ``common`` and ``idio`` have a two-state drift, one for all markets or one each, that
    keeps its state with probability ``stay`` and sums to nothing; ``tilt`` has a constant
    drift, ``noise`` none.
    """
    if kind not in ("common", "idio", "tilt", "noise"):
        raise ValueError(f"no world {kind!r}")
    ship(spark)

    def states(rng: np.random.Generator) -> np.ndarray:
        turns = np.cumsum(rng.random(days) >= stay) + rng.integers(0, 2)
        path = drift * (1 - 2 * (turns % 2))
        return path - path.mean()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, market in zip(batch["k"], batch["market"], strict=True):
                own = np.random.default_rng([seed, int(k) + 1])
                base = states(np.random.default_rng([seed, 0])) if kind == "common" else states(own) if kind == "idio" else np.full(days, tilt if kind == "tilt" else 0.0)
                yield pd.DataFrame({"day": np.arange(days), "market": market, "ret": base + own.normal(0.0, noise, days)})

    named = spark.createDataFrame(list(enumerate(markets)), "k long, market string").repartition(len(markets), "k")
    return named.mapInPandas(run, "day long, market string, ret double")


def kernel_diagnostics(weights: DataFrame, rows: DataFrame, vector: str, window: int, pos: str = "pos") -> DataFrame:
    """One row: correlation of the mean weight by lag with recency (momentum if positive),
    and of the weights' size with the predictors' innovation volatility in the window
    (volatility timing if negative)."""
    profile = weight_profile(weights, pos)
    recency = profile.agg(F.corr("weight", -F.col("lag")).alias("recency_corr"))
    w = Window.orderBy(pos)
    steps = rows.select(F.col(pos).alias("pos"), F.zip_with(F.col(vector), F.lag(vector).over(w), lambda a, b: a - b).alias("step"))
    each = steps.select("pos", F.posexplode_outer("step").alias("k", "d"))
    inside = Window.partitionBy("k").orderBy("pos").rowsBetween(-(window - 1), -1)
    spread = each.withColumn("sd", F.stddev_pop("d").over(inside)).groupBy("pos").agg(F.avg("sd").alias("vol"))
    size = weights.select("pos", F.aggregate("weights", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("size"))
    timing = size.join(spread, "pos").agg(F.corr("size", "vol").alias("scale_vs_predvol"))
    return recency.crossJoin(F.broadcast(timing))  # one row each


def phase_diagram(rows: DataFrame, vector: str, windows: list[int], gamma: float = 2.0, pos: str = "pos", value: str = "y", per_year: int = 12) -> DataFrame:
    """(window, n, sharpe, recency_corr, scale_vs_predvol) for every window length."""
    out = None
    for window in windows:
        weights = kernel_weights(rows, vector, window, gamma, pos)
        traded = apply_weights(weights, rows, pos, value).join(rows.select(pos, value), pos).withColumn("ret", F.col("forecast") * F.col(value))
        stats = traded.agg(F.count("*").alias("n"), (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(float(per_year)))).alias("sharpe"))
        one = stats.crossJoin(F.broadcast(kernel_diagnostics(weights, rows, vector, window, pos))).withColumn("window", F.lit(window))
        out = one if out is None else out.unionByName(one)
    return out.select("window", "n", "sharpe", "recency_corr", "scale_vs_predvol")


def wild_bootstrap(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Predictors rebuilt from first-order autoregressions whose innovations get a sign
    drawn once per period."""
    before, after = x[:-1], x[1:]
    size = (before * before).sum(0)
    phi = np.where(size > 0, (before * after).sum(0) / np.where(size > 0, size, 1.0), 0.0)
    signed = (after - phi * before) * np.random.default_rng(seed).choice([-1.0, 1.0], size=len(x))[1:, None]
    out = np.empty_like(x)
    out[0] = x[0]
    for now, innovation in enumerate(signed, start=1):
        out[now] = phi * out[now - 1] + innovation
    return out


def _frame(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(y)), "x": [r.tolist() for r in x], "y": y}))
