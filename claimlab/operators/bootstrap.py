"""Resampling as relations: draws are rows, blocks are joins on positions.

Block starts come either from a digest of (seed, draw, block) - any engine repeats them -
or from numpy's default generator, whose table of starts is made on the driver
(``n_boot`` x blocks small integers).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.functions.expressions import ratio
from claimlab.operators.evaluate import auc


def digest_starts(spark: SparkSession, n: int, n_boot: int, block: int, seed: int) -> DataFrame:
    """(b, j, start): the first eight hex digits of a digest, modulo the starts there are."""
    blocks = math.ceil(n / block)
    draws = spark.range(n_boot * blocks).select((F.col("id") / blocks).cast("long").alias("b"), (F.col("id") % blocks).alias("j"))
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("b").cast("string"), F.col("j").cast("string")))
    return draws.withColumn("start", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n - block + 1)))


def numpy_starts(spark: SparkSession, n: int, n_boot: int, block: int, seed: int) -> DataFrame:
    """The same table in the order in which numpy's generator draws it."""
    blocks = math.ceil(n / block)
    drawn = np.random.default_rng(seed).integers(0, n - block + 1, size=(n_boot, blocks))
    table = pd.DataFrame({"b": np.repeat(np.arange(n_boot), blocks), "j": np.tile(np.arange(blocks), n_boot), "start": drawn.ravel()})
    return spark.createDataFrame(table, "b long, j long, start long")


def resample(series: DataFrame, values: list[str], order: str, n_boot: int, block: int, seed: int, generator: str = "digest") -> DataFrame | None:
    """(b, values...): every draw's n values; None if the series is shorter than two blocks."""
    if n_boot <= 0 or block <= 0:
        raise ValueError("n_boot and block must be positive")
    kept = series.select(order, *values).dropna()
    numbered = kept.withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1)
    n = kept.count()
    if n < 2 * block:
        return None
    starts = (numpy_starts if generator == "numpy" else digest_starts)(series.sparkSession, n, n_boot, block, seed)
    places = starts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("j") * block + F.col("o") < n)
    return places.select("b", (F.col("start") + F.col("o")).cast("int").alias("pos")).join(numbered, "pos").select("b", *values)


def interval(draws: DataFrame, stat: str, ci: float) -> DataFrame:
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    return draws.agg(F.count(stat).alias("draws"), F.percentile(stat, F.lit(lo)).alias("lo"), F.percentile(stat, F.lit(hi)).alias("hi"))


def undefined(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, None, None)], "draws long, lo double, hi double")


def mean_ci(series: DataFrame, value: str = "ret", order: str = "date", n_boot: int = 2000, block: int = 6, ci: float = 0.95, seed: int = 0, generator: str = "digest") -> DataFrame:
    drawn = resample(series, [value], order, n_boot, block, seed, generator)
    return undefined(series.sparkSession) if drawn is None else interval(drawn.groupBy("b").agg(F.avg(value).alias("stat")), "stat", ci)


def sharpe_ci(series: DataFrame, value: str = "ret", order: str = "date", n_boot: int = 2000, block: int = 6, ci: float = 0.95, seed: int = 0, per_year: int = 12, generator: str = "digest") -> DataFrame:
    drawn = resample(series, [value], order, n_boot, block, seed, generator)
    stat = ratio(F.avg(value), F.stddev_samp(value)) * math.sqrt(per_year)
    return undefined(series.sparkSession) if drawn is None else interval(drawn.groupBy("b").agg(stat.alias("stat")), "stat", ci)


def auc_ci(scored: DataFrame, label: str, score: str, order: str, n_boot: int = 200, block: int = 10, ci: float = 0.90, seed: int = 0, generator: str = "digest") -> DataFrame:
    """Draws with one class only are left out."""
    drawn = resample(scored, [label, score], order, n_boot, block, seed, generator)
    return undefined(scored.sparkSession) if drawn is None else interval(auc(drawn, label, score, "b").where("auc is not null"), "auc", ci)
