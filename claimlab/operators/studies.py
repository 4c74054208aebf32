"""Whole questions: complexity sweeps, counterfactuals, kill criteria, fixed rules, tools."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.operators import evaluate as E
from claimlab.operators.features import ridge_path, rff_matrix
from claimlab.session import ship


def _forecast_path(x: np.ndarray, y: np.ndarray, window: int, sizes: list[int], z_grid: list[float], gamma: float, seed: int) -> list[tuple]:
    """(seed, p, z, pos, forecast): prefixes of one feature draw serve all sizes."""
    features, out = rff_matrix(x, max(sizes), gamma, seed), []
    for p in sizes:
        part = features[:, :p]
        for t in range(window, len(y)):
            for z, b in zip(z_grid, ridge_path(part[t - window : t], y[t - window : t], z_grid), strict=True):
                out.append((seed, p, float(z), t, float(part[t] @ b)))
    return out


def complexity_sweep(spark: SparkSession, x: np.ndarray, y: np.ndarray, window: int, sizes: list[int], z_grid: list[float], seeds: list[int], gamma: float = 2.0) -> DataFrame:
    """(seed, p, z, pos, forecast), a seed per task.  The panel is one monthly series."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for seed in batch["seed"]:
                yield pd.DataFrame(_forecast_path(x, y, window, sizes, z_grid, gamma, int(seed)), columns=["seed", "p", "z", "pos", "forecast"])

    return spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds), "seed").mapInPandas(run, "seed long, p long, z double, pos long, forecast double")


def sweep_statistics(forecasts: DataFrame, returns: DataFrame, per_year: int = 12) -> DataFrame:
    """Per (p, z): the seed-average forecast's timing Sharpe and R² against zero."""
    mean = forecasts.groupBy("p", "z", "pos").agg(F.avg("forecast").alias("forecast")).join(returns.select("pos", F.col("y").alias("actual")), "pos")
    stats = E.sharpe(mean.withColumn("ret", F.col("forecast") * F.col("actual")), "ret", per_year, "p", "z")
    r2 = mean.groupBy("p", "z").agg((1 - F.sum((F.col("actual") - F.col("forecast")) ** 2) / F.nullif(F.sum(F.col("actual") ** 2), F.lit(0.0))).alias("r2_zero"))
    return stats.select("p", "z", "n", "sharpe").join(r2, ["p", "z"])


def counterfactual_sharpes(spark: SparkSession, weights: DataFrame, worlds: DataFrame, per_year: int = 12) -> DataFrame:
    """One row over draws: mean and deviation (of the population) of the strategy's
    Sharpe, share below zero.  ``worlds`` has (draw, pos, y); the weights are reused."""
    lagged = weights.select(F.col("pos").alias("at"), F.posexplode("weights").alias("k", "w"), F.size("weights").alias("n")).withColumn("pos", F.col("at") - F.col("n") + F.col("k"))
    forecast = lagged.join(worlds, "pos").groupBy("draw", F.col("at").alias("pos")).agg(F.sum(F.col("w") * F.col("y")).alias("forecast"))
    traded = forecast.join(worlds, ["draw", "pos"]).withColumn("ret", F.col("forecast") * F.col("y"))
    per = E.sharpe(traded, "ret", per_year, "draw")
    return per.agg(F.count("*").alias("draws"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("sd"), F.avg((F.col("sharpe") < 0).cast("double")).alias("share_negative"))


# Thresholds of the mechanism's rule.
LEAST_CORRELATION, LEAST_SPAN, MOST_ALPHA_T, LEAST_RETENTION, LEAST_NEGATIVE = 0.90, 0.85, 1.96, 0.75, 0.80


def adjudicate(results: DataFrame, states: tuple[str, str] = ("bounded-finding", "bounded-inconclusive")) -> DataFrame:
    """Adds the five checks and the outcome to rows of small_sharpe, large_sharpe,
    rejects, forecast_corr, span_r2, alpha_t, destroyed_sharpe, base_sharpe, share_negative."""
    c = F.col
    retention = F.when(c("base_sharpe") > 0, c("destroyed_sharpe") / c("base_sharpe"))
    out = results.select(
        "*", (c("large_sharpe") > c("small_sharpe")).alias("headline_reproduced"), c("rejects").alias("forecast_test_passed"), retention.alias("retention"),
        ((c("forecast_corr") >= LEAST_CORRELATION) & (c("span_r2") >= LEAST_SPAN) & (F.abs("alpha_t") < MOST_ALPHA_T)).alias("kernel_equivalent"),
        F.coalesce(retention >= LEAST_RETENTION, F.lit(False)).alias("survives_destruction"), (c("share_negative") >= LEAST_NEGATIVE).alias("reversal_negative"))
    killed = c("kernel_equivalent") & c("survives_destruction")
    return out.withColumn("state", F.when(killed, states[0]).otherwise(states[1]))


def kill_criteria(facts: DataFrame) -> DataFrame:
    """Which of four registered criteria fire, from alpha_t, sealed_sharpe, breakeven_bps,
    realistic_bps and randomisation_percentile: no spanning alpha, a sealed block without
    a gain, costs beyond the breakeven, a strategy that random signs often match."""
    fired = F.array(F.when(~(F.col("alpha_t") > 1.96), "K1"), F.when(~(F.col("sealed_sharpe") > 0), "K2"), F.when(F.col("breakeven_bps") < F.col("realistic_bps"), "K3"), F.when(F.col("randomisation_percentile") < 0.95, "K4"))
    return facts.withColumn("fired", F.array_compact(fired))


@dataclass
class Tools:
    """Named functions with closed argument lists; calls are recorded for the number audit."""

    functions: dict[str, tuple[Callable[..., DataFrame], frozenset[str]]] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)

    def add(self, name: str, fn: Callable[..., DataFrame], arguments: set[str]) -> None:
        self.functions[name] = fn, frozenset(arguments)

    def run(self, name: str, **arguments) -> list[dict]:
        if name not in self.functions:
            raise KeyError(f"no tool {name!r}")
        fn, allowed = self.functions[name]
        if extra := set(arguments) - allowed:
            raise TypeError(f"{name} takes no {', '.join(sorted(extra))}")
        rows = [r.asDict(recursive=True) for r in fn(**arguments).limit(1_000).collect()]
        self.trace.append({"tool": name, "arguments": arguments, "result": rows})
        return rows

    def numbers(self) -> list[float]:
        """Every number the tools returned, booleans left out."""

        def walk(v):
            if isinstance(v, dict):
                v = list(v.values())
            if isinstance(v, list):
                return [n for x in v for n in walk(x)]
            return [float(v)] if isinstance(v, int | float) and not isinstance(v, bool) else []

        return walk([t["result"] for t in self.trace])
