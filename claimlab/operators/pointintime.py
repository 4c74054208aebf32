"""Point-in-time universes and leak audits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlab.session import ship


def last_known(panel: DataFrame, asof: DataFrame, window: int, entity: str, disclosed: str, order: tuple[str, ...], value: str) -> DataFrame:
    """(as_of, entity, value): the last ``window`` known values at each as-of date - those
    disclosed by then, never by fiscal period.  ``asof`` (as_of) is a short list of dates.

    Where the order begins with the disclosure, a value is known from then until
    ``window`` later ones of its entity are: only those intervals meet the dates.
    """
    if asof.count() > 10_000:
        raise ValueError("too many as-of dates")
    if order[0] == disclosed:
        later = Window.partitionBy(entity).orderBy(*order)
        panel = panel.where(F.col(value).isNotNull()).withColumn("__until", F.lead(disclosed, window).over(later))
        within = (F.col(disclosed) <= F.col("as_of")) & (F.col("__until").isNull() | (F.col("as_of") < F.col("__until")))
        return panel.join(F.broadcast(asof), within).drop("__until")
    known = panel.where(F.col(value).isNotNull()).join(F.broadcast(asof), F.col(disclosed) <= F.col("as_of"))
    latest = Window.partitionBy("as_of", entity).orderBy(*[F.desc(o) for o in order])
    return known.withColumn("__k", F.row_number().over(latest)).where(F.col("__k") <= window).drop("__k")


def sustained_above(last: DataFrame, value: str, threshold: float, window: int, consistency: float, *by: str) -> DataFrame:
    share = F.avg((F.col(value) >= threshold).cast("double"))
    return last.groupBy(*by).agg(((F.count(value) >= window) & (share >= consistency)).alias("sustained"))


def stable_series(last: DataFrame, value: str, window: int, most_cv: float, *by: str) -> DataFrame:
    mean = F.avg(value)
    cv = F.stddev_pop(value) / F.nullif(mean, F.lit(0.0))
    return last.groupBy(*by).agg(F.coalesce((F.count(value) >= window) & (mean > 0) & (cv <= most_cv), F.lit(False)).alias("stable"))


def screen_universe(panel: DataFrame, asof: str, screen: Callable[[pd.DataFrame], bool], entity: str, disclosed: str, order: str) -> DataFrame:
    """Entities that pass a screen of the user's own, given their known rows in order."""
    ship(panel.sparkSession)
    kind = dict(panel.dtypes)[entity]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows[[entity]].head(1) if screen(rows) else rows[[entity]].head(0)

    return panel.where(F.col(disclosed) <= F.lit(asof).cast("timestamp")).groupBy(entity).applyInPandas(run, f"{entity} {kind}")


def audit(name: str, violations) -> F.Column:
    return F.sum(F.when(violations, 1).otherwise(0)).alias(name)


def audit_rows(rows: DataFrame, signal: str, acted: str, limit: str) -> DataFrame:
    """Counts of rows whose signal is not before the act, and of rows after a date;
    undated rows violate neither."""
    return rows.agg(audit("signal_after_act", F.col(signal) >= F.col(acted)), audit("future_rows", F.col(acted) > F.lit(limit).cast("timestamp")), F.count("*").alias("n"))


def audit_disclosure_lag(rows: DataFrame, period_end: str, disclosed: str, least_days: int) -> DataFrame:
    lag = F.floor((F.unix_micros(F.col(disclosed).cast("timestamp")) - F.unix_micros(F.col(period_end).cast("timestamp"))) / 86_400_000_000)
    return rows.agg(audit("too_early", lag < least_days), F.count("*").alias("n"))


def audit_membership(trades: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """How many trades are in no universe of their month."""
    return trades.join(members.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("violations"))
