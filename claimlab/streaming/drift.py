"""Streaming extensions: windowed rates, rolling AUC, and the drift monitor with its alarms
as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimlab.operators.diagnose import rank_auc
from claimlab.session import ship


def windowed_rates(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows, mean score and positive rate per tumbling window; later rows are dropped."""
    return (stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
            .agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("rate"))
            .select(F.col("w.start").alias("start"), "n", "mean_score", "rate"))


def rolling_auc_stream(stream: DataFrame, key: str, window: int = 150, least_class: int = 5) -> DataFrame:
    """AUC of each key's last ``window`` rows as they arrive, in (ts, event_id) order
    within a micro-batch.  The state is the last window of scores and labels."""
    ship(stream.sparkSession)
    schema = f"{key} string, ts timestamp, event_id long, auc double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scores, labels = map(list, state.get) if state.exists else ([], [])
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for ts, event, s, y in zip(new["ts"], new["event_id"], new["score"], new["label"], strict=True):
            scores, labels = [*scores, float(s)][-window:], [*labels, int(y)][-window:]
            n = sum(labels)
            if len(scores) == window and min(n, window - n) >= least_class:
                a, b = np.array(scores), np.array(labels)
                q = np.sort(a[b == 0])
                wins = np.searchsorted(q, a[b == 1], "left").sum() + np.searchsorted(q, a[b == 1], "right").sum()
                out.append((k[0], ts, event, wins / (2 * n * (window - n))))
        state.update((scores, labels))
        yield pd.DataFrame(out, columns=[key, "ts", "event_id", "auc"])

    return stream.groupBy(key).applyInPandasWithState(run, schema, "scores array<double>, labels array<int>", "append", GroupStateTimeout.NoTimeout)


def drift_stream(stream: DataFrame, key: str, window: int = 150, least_class: int = 5, baseline_n: int = 60, k: float = 1.5, h: float = 5.0) -> DataFrame:
    """Each key's monitor as rows arrive: key, ts, event_id, auc, calib_err, baseline, alarm.

    The state is bounded: the last window of scores and labels, the first ``baseline_n``
    AUCs until the baseline stands, the CUSUM and whether it has fired.  Rows come out
    once the baseline stands; the windows of the baseline go through the CUSUM then, and
    come out with it.  Order within a micro-batch is (ts, event_id), as the batch
    operator's over one key.
    """
    ship(stream.sparkSession)
    schema = f"{key} string, ts timestamp, event_id long, auc double, calib_err double, baseline double, alarm boolean"
    kept = "scores array<double>, labels array<int>, waiting array<struct<ts: long, event: long, auc: double, calib: double>>, baseline double, sd double, total double, fired boolean"

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scores, labels, waiting, baseline, sd, total, fired = state.get if state.exists else ([], [], [], None, None, 0.0, False)
        scores, labels, waiting = list(scores), list(labels), [tuple(x) for x in waiting]
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for ts, event, s, y in zip(new["ts"], new["event_id"], new["score"], new["label"], strict=True):
            scores, labels = [*scores, float(s)][-window:], [*labels, int(y)][-window:]
            n = sum(labels)
            if len(scores) < window or min(n, window - n) < least_class:
                continue
            a, b = np.array(scores), np.array(labels)
            waiting.append((int(pd.Timestamp(ts).value), int(event), rank_auc(a, b), float(abs(a.mean() - b.mean()))))
            if baseline is None:
                if len(waiting) < baseline_n:
                    continue
                first = np.array([x[2] for x in waiting])
                baseline, sd = float(first.mean()), float(first.std())
                sd = sd if sd > 1e-6 else 0.02
            for at, e, auc, calib in waiting:
                total = max(0.0, total + baseline - auc - k * sd)
                hit = not fired and total > h * sd
                if hit or fired and auc >= baseline - k * sd:
                    total, fired = 0.0, hit
                out.append((name[0], pd.Timestamp(at), e, auc, calib, baseline, hit))
            waiting = []
        state.update((scores, labels, waiting, baseline, sd, total, fired))
        yield pd.DataFrame(out, columns=[key, "ts", "event_id", "auc", "calib_err", "baseline", "alarm"])

    return stream.groupBy(key).applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.NoTimeout)
