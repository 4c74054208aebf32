"""Chronological splits, walk-forward folds and their audits."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_splits(rows: DataFrame, train_end: str, valid_end: str, holdout_start: str | None = None, time_col: str = "ts") -> DataFrame:
    """Label rows train, valid or holdout; rows between validation and holdout get NULL."""
    start = holdout_start or str((dt.datetime.fromisoformat(valid_end) + dt.timedelta(days=1)).isoformat(sep=" "))
    if not dt.datetime.fromisoformat(train_end) < dt.datetime.fromisoformat(valid_end) <= dt.datetime.fromisoformat(start):
        raise ValueError("need train_end < valid_end <= holdout_start")
    t, ts = F.col(time_col), lambda x: F.lit(x).cast("timestamp")
    return rows.withColumn("block", F.when(t <= ts(train_end), "train").when(t >= ts(start), "holdout").when(t <= ts(valid_end), "valid"))


def leakage(split: DataFrame, time_col: str = "ts") -> DataFrame:
    """One row: sizes, and whether the blocks are there and follow one another."""
    at = lambda b, f: f(F.when(F.col("block") == b, F.col(time_col)))
    n = lambda b: F.sum(F.when(F.col("block") == b, 1).otherwise(0))
    ok = (at("train", F.max) < at("valid", F.min)) & (at("valid", F.max) < at("holdout", F.min))
    return split.agg(n("train").alias("n_train"), n("valid").alias("n_valid"), n("holdout").alias("n_holdout"), F.coalesce(ok, F.lit(False)).alias("ordered"))


def walk_forward(n: int, n_folds: int = 5, min_train: int | None = None, expanding: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(fold, train from, train to, test from, test to), ends exclusive."""
    least = max(1, n // (n_folds + 1)) if min_train is None else min_train
    if n_folds < 1 or least >= n:
        raise ValueError("not enough rows for these folds")
    edges = [int(e) for e in np.linspace(least, n, n_folds + 1)]
    return [(k, 0 if expanding else max(0, a - least), a, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def folds(numbered: DataFrame, n: int, n_folds: int = 5, min_train: int | None = None, expanding: bool = True, pos: str = "pos") -> DataFrame:
    """Rows with (fold, role): each row once for every fold it is in."""
    plan = walk_forward(n, n_folds, min_train, expanding)
    inside = F.array(*[F.struct(F.lit(k).alias("fold"), F.when((F.col(pos) >= a) & (F.col(pos) < b), "train").when((F.col(pos) >= c) & (F.col(pos) < d), "test").alias("role")) for k, a, b, c, d in plan])
    return numbered.withColumn("__f", F.explode(F.filter(inside, lambda f: f["role"].isNotNull()))).select("*", "__f.*").drop("__f")
