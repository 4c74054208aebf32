"""Diagnosis playbooks over trades, claims and score streams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlab.functions.expressions import avg_rank
from claimlab.functions.ordering import with_position
from claimlab.operators.evaluate import auc, safe_corr
from claimlab.session import ship


def expression_vs_underlying(trades: DataFrame, budget: float, *by: str) -> DataFrame:
    """What the instrument earned against the same budget in the underlying."""
    t = trades.withColumn("stock", budget * (F.col("s_out") / F.col("s_in") - 1)).withColumn("pnl", F.col("dollar_pnl"))
    up = F.col("stock") > 0
    return t.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("stock").alias("stock_mean"), F.percentile("stock", F.lit(0.5)).alias("stock_median"), F.avg("pnl").alias("pnl_mean"),
        F.percentile("pnl", F.lit(0.5)).alias("pnl_median"), F.avg((F.col("pnl") > 0).cast("double")).alias("win"), (F.avg("pnl") - F.avg("stock")).alias("drag"),
        F.avg(F.when(up, (F.col("pnl") > 0).cast("double"))).alias("win_when_up"))


# The outcomes of a claim's two blocks.
SURVIVED = "survived out of sample"
CAUGHT = "false positive caught by the sealed holdout"
NOT_REPLICATED = "did not replicate out of sample"
UNCLAIMED = "no in-sample claim, yet positive out of sample — inspect the pipeline"
NO_CLAIM = "no claim in either block"


def false_positive(claims: DataFrame, t: float = 2.0) -> DataFrame:
    """Outcome of claims that have alpha and t in validation and in the sealed holdout."""
    in_valid, in_hold = F.col("valid_t") > t, F.col("hold_t") > t
    flip = F.signum("valid_alpha") != F.signum("hold_alpha")
    outcome = F.when(in_valid & in_hold, SURVIVED).when(in_valid & flip, CAUGHT).when(in_valid, NOT_REPLICATED).when(in_hold, UNCLAIMED).otherwise(NO_CLAIM)
    return claims.select("*", flip.alias("sign_flip"), (F.col("hold_alpha") - F.col("valid_alpha")).alias("alpha_decay"), outcome.alias("outcome"))


def attribution_split(rows: DataFrame, metric: str, driver: str, time_col: str, split_at: Column, least: int = 8, method: str = "spearman") -> DataFrame:
    """Correlation over all rows, before and after a date; ranks within each part."""
    both = rows.where(F.col(metric).isNotNull() & F.col(driver).isNotNull())
    part = F.array(F.lit("full"), F.when(F.col(time_col) < split_at, "before").otherwise("after"))
    parts = both.withColumn("part", F.explode(part))
    if method == "spearman":
        parts = parts.withColumn("__x", avg_rank(metric, "part")).withColumn("__y", avg_rank(driver, "part"))
    else:
        parts = parts.withColumn("__x", F.col(metric)).withColumn("__y", F.col(driver))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, safe_corr("__x", "__y")).alias("corr"))


def rolling_windows(stream: DataFrame, window: int = 150, least_class: int = 5, time_col: str = "ts", tie: str = "event_id", score: str = "score", label: str = "label", chunk: int = 2_000, n_boot: int = 0, block: int = 10, seed: int = 0) -> DataFrame:
    """AUC and calibration error of every window of ``window`` rows, by the window's last
    row: pos, ts, tie, auc, calib_err, auc_lo, auc_hi.

    The last two are the moving-block bootstrap's 90 % interval over ``n_boot`` draws,
    without draws NULL.
    Rows are numbered without a global window and dealt into chunks of positions; a chunk
    also gets the ``window - 1`` rows before it, so windows need no further exchange and
    no row is repeated per window.
    """
    if window <= 1 or least_class <= 0:
        raise ValueError("window must exceed one and least_class be positive")
    ship(stream.sparkSession)
    chunk = max(chunk, window)
    rows = stream.select(F.col(time_col).alias("ts"), F.col(tie).alias("tie"), F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).where("s is not null and not isnan(s) and y is not null and ts is not null")
    numbered = with_position(rows, "ts", "tie")
    own = (F.col("pos") / chunk).cast("long")
    last = ((F.col("pos") + window - 1) / chunk).cast("long")
    dealt = numbered.withColumn("own", own).withColumn("chunk", F.explode(F.when(last > own, F.array(own, last)).otherwise(F.array(own))))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos", kind="stable")
        s, y = batch["s"].to_numpy(), batch["y"].to_numpy()
        wanted = ((batch["own"] == batch["chunk"]) & (batch["pos"] >= window - 1)).to_numpy()
        held = SortedWindow()
        out = []
        for k, (score, label) in enumerate(zip(s.tolist(), y.tolist(), strict=True)):
            if k >= window:
                held.move(float(s[k - window]), int(y[k - window]), -1)
            held.move(score, label, 1)
            n_pos = len(held.sides[1])
            if not wanted[k] or min(n_pos, window - n_pos) < least_class:
                continue
            a, b = s[k - window + 1 : k + 1], y[k - window + 1 : k + 1]
            lo, hi = block_interval(a, b, n_boot, block, seed)
            out.append((batch["pos"].iat[k], batch["ts"].iat[k], batch["tie"].iat[k], held.halves / (2 * n_pos * (window - n_pos)), abs(a.mean() - b.mean()), lo, hi))
        return pd.DataFrame(out, columns=["pos", "ts", "tie", "auc", "calib_err", "auc_lo", "auc_hi"])

    return dealt.groupBy("chunk").applyInPandas(run, "pos long, ts timestamp, tie long, auc double, calib_err double, auc_lo double, auc_hi double")


class SortedWindow:
    """Both classes' scores in order, and twice the number of pairs that a positive wins,
    ties half: a score that comes or goes changes it by its rank in the other class."""

    def __init__(self) -> None:
        self.sides: tuple[list[float], list[float]] = ([], [])
        self.halves = 0

    def move(self, score: float, label: int, sign: int) -> None:
        mine, other = self.sides[label], self.sides[1 - label]
        below = bisect_left(other, score) + bisect_right(other, score)
        self.halves += sign * (below if label else 2 * len(other) - below)
        if sign > 0:
            insort(mine, score)
        else:
            del mine[bisect_left(mine, score)]


def rank_auc(s: np.ndarray, y: np.ndarray) -> float | None:
    """AUC of one sample, ties half; None with one class only."""
    p, q = s[y == 1], np.sort(s[y == 0])
    if not len(p) or not len(q):
        return None
    return float(np.searchsorted(q, p, "left").sum() + np.searchsorted(q, p, "right").sum()) / (2 * len(p) * len(q))


def block_interval(s: np.ndarray, y: np.ndarray, n_boot: int, block: int, seed: int) -> tuple[float | None, float | None]:
    """The 5th and 95th percentile of the AUC over draws of moving blocks."""
    n = len(s)
    if not n_boot or n < 2 * block:
        return None, None
    starts = np.random.default_rng(seed).integers(0, n - block + 1, size=(n_boot, -(-n // block)))
    places = (starts[:, :, None] + np.arange(block)).reshape(n_boot, -1)[:, :n]
    found = [v for at in places if (v := rank_auc(s[at], y[at])) is not None]
    return tuple(np.percentile(found, [5, 95]).tolist()) if found else (None, None)


def drift_alarms(windows: DataFrame, k: float = 1.5, h: float = 5.0, baseline_n: int = 60) -> DataFrame:
    """The windows with ``baseline`` and whether one ``alarms``: a one-sided CUSUM of the
    AUC below the mean of the first ``baseline_n`` windows, slack and limit in their
    deviations, re-armed once a window is back within the slack.

    A CUSUM with re-arming is sequential: one task reads (pos, auc) in order, holding a
    batch of rows at a time, whatever the stream's length.
    """
    ship(windows.sparkSession)
    first = windows.orderBy("pos").limit(baseline_n).agg(F.avg("auc").alias("baseline"), F.coalesce(F.stddev_pop("auc"), F.lit(0.0)).alias("sd"))
    first = first.withColumn("sd", F.when(F.col("sd") > 1e-6, F.col("sd")).otherwise(0.02))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, on = 0.0, False
        for batch in batches:
            hits = []
            for auc, baseline, sd in zip(batch["auc"], batch["baseline"], batch["sd"], strict=True):
                total = max(0.0, total + baseline - auc - k * sd)
                hit = not on and total > h * sd
                if hit or on and auc >= baseline - k * sd:
                    total, on = 0.0, hit
                hits.append(hit)
            yield pd.DataFrame({"pos": batch["pos"], "baseline": batch["baseline"], "alarms": hits})

    lean = windows.select("pos", "auc").crossJoin(F.broadcast(first))  # one row
    walked = lean.repartition(1).sortWithinPartitions("pos").mapInPandas(run, "pos long, baseline double, alarms boolean")
    return windows.join(walked, "pos")


def drift_monitor(stream: DataFrame, window: int = 150, least_class: int = 5, baseline_n: int = 60, k: float = 1.5, h: float = 5.0, n_boot: int = 0, time_col: str = "ts", tie: str = "event_id", score: str = "score", label: str = "label") -> DataFrame:
    """Window AUC to baseline to alarm: one row with n_obs, n_windows, overall_auc,
    baseline_auc, worst_auc, worst_at, n_alarms, first_alarm."""
    windows = drift_alarms(rolling_windows(stream, window, least_class, time_col, tie, score, label, n_boot=n_boot), k, h, baseline_n)
    seen = windows.agg(F.count("*").alias("n_windows"), F.max("baseline").alias("baseline_auc"), F.min("auc").alias("worst_auc"), F.min_by("tie", F.struct(F.round("auc", 9), "pos")).alias("worst_at"),
                       F.count_if("alarms").alias("n_alarms"), F.min_by(F.when(F.col("alarms"), F.col("tie")), F.when(F.col("alarms"), F.col("pos"))).alias("first_alarm"))
    overall = auc(stream.where(F.col(time_col).isNotNull()), label, score).select((F.col("n_pos") + F.col("n_neg")).alias("n_obs"), F.col("auc").alias("overall_auc"))
    return overall.crossJoin(F.broadcast(seen))  # one row each


def lead_days(alarms: DataFrame, event: str, time_col: str = "date") -> DataFrame:
    return alarms.agg(F.datediff(F.lit(event), F.min(time_col)).alias("first_lead_days"), F.datediff(F.lit(event), F.max(time_col)).alias("last_lead_days"))


def interpolate(points: DataFrame, at: DataFrame, time_col: str = "date", value: str = "value") -> DataFrame:
    """Linear in time between the neighbouring points, the nearest point's value beyond."""
    rows = points.select(time_col, F.col(value).alias("v"), F.lit(0).alias("wanted")).unionByName(at.select(time_col, F.lit(None).cast("double").alias("v"), F.lit(1).alias("wanted")))
    known = F.when(F.col("v").isNotNull(), F.struct(F.unix_date(F.col(time_col)).alias("t"), F.col("v").alias("v")))
    w = Window.orderBy(time_col, "wanted")
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("p", prev).withColumn("n", nxt).where("wanted = 1")
    t = F.unix_date(F.col(time_col))
    share = (t - F.col("p.t")) / F.nullif(F.col("n.t") - F.col("p.t"), F.lit(0))
    return rows.select(time_col, F.coalesce(F.col("p.v") + (F.col("n.v") - F.col("p.v")) * F.coalesce(share, F.lit(0.0)), F.col("p.v"), F.col("n.v")).alias(value))
