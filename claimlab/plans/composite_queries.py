"""Predictors, complexity studies and fixed rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from claimlab.operators import features as L
from claimlab.operators import predictors as X
from claimlab.operators import studies as S

from . import views as V
from .panel_queries import WITH
from .registry import query, r, rounded


def _expanding(c: str) -> str:
    return f"CASE WHEN count({c}) OVER e >= 24 THEN {c} / nullif(stddev_samp({c}) OVER e, 0) END"


@query(WITH + f""", s AS (SELECT date, {_expanding('passive')} AS passive, {_expanding('xs')} AS xs, ret, CASE WHEN count(ret) OVER p = 12 THEN sqrt(avg(ret * ret) OVER p) END AS v FROM series
WINDOW e AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT date, {r('passive', 'passive')}, {r('xs', 'xs')}, {r('ret / nullif(v, 0)', 'ret')}, {r('v', 'target_vol')} FROM s""", dates=("date",))
def backward_standardised(spark, sf):
    return rounded(X.standardise_backward(V.series(spark, sf), ["passive", "xs"], "ret", "date", least=24))


_WEIGHTED = " + ".join(f"lag(ret, {12 - i}) OVER w * {i + 1} / 78.0" for i in range(12))


@query(WITH + f""", m AS (SELECT date, ret, ret - lag(ret) OVER w AS step, {_WEIGHTED} AS weighted FROM series WINDOW w AS (ORDER BY date)),
v AS (SELECT date, weighted, stddev_samp(step) OVER p AS sd FROM m WINDOW p AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT date, {r('weighted / nullif(sd, 0)', 'forecast')} FROM v""", dates=("date",))
def mechanical_momentum(spark, sf):
    return rounded(X.mechanical_momentum(V.series(spark, sf), "ret", 12, "date").select("date", "forecast"))


@query(WITH + f"""SELECT "column", count(*) AS n, {r('covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0)', '"corr"')}, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) >= 0.5 AS ok
FROM (SELECT 'passive' AS "column", a.passive AS x, b.passive AS y FROM series a JOIN series b USING (date) UNION ALL SELECT 'xs', a.xs, b.ret FROM series a JOIN series b USING (date)) GROUP BY 1""")
def anchor_correlations(spark, sf):
    s = V.series(spark, sf)
    return rounded(X.column_correlations(s, s.withColumn("xs", F.col("ret")), "date", ["passive", "xs"], 0.5))


FACTS = "f AS (SELECT c_nationkey AS id, avg(c_acctbal) / 1e4 AS a, stddev_samp(c_acctbal) / 1e4 AS b, count(*) AS n FROM customer GROUP BY 1)"


def _facts(spark, sf):
    return V.read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg((F.avg("c_acctbal") / 1e4).alias("a"), (F.stddev_samp("c_acctbal") / 1e4).alias("b"), F.count("*").alias("n"))


@query(f"""WITH {FACTS} SELECT id, a + b > 0.7 AS headline_reproduced, n > 50 AS forecast_test_passed, {r('CASE WHEN b > 0 THEN 2 * a / b END', 'retention')}, a + 0.5 >= 0.9 AND b + 0.6 >= 0.85 AND abs(a * 3) < 1.96 AS kernel_equivalent,
coalesce(2 * a / CASE WHEN b > 0 THEN b END >= 0.75, false) AS survives_destruction, 2 * b >= 0.8 AS reversal_negative, CASE WHEN (a + 0.5 >= 0.9 AND b + 0.6 >= 0.85 AND abs(a * 3) < 1.96) AND coalesce(2 * a / CASE WHEN b > 0 THEN b END >= 0.75, false) THEN 'bounded-finding' ELSE 'bounded-inconclusive' END AS state FROM f""")
def fixed_adjudication(spark, sf):
    f = _facts(spark, sf).select("id", F.lit(0.7).alias("small_sharpe"), (F.col("a") + F.col("b")).alias("large_sharpe"), (F.col("n") > 50).alias("rejects"), (F.col("a") + 0.5).alias("forecast_corr"), (F.col("b") + 0.6).alias("span_r2"),
                                 (F.col("a") * 3).alias("alpha_t"), (2 * F.col("a")).alias("destroyed_sharpe"), F.col("b").alias("base_sharpe"), (2 * F.col("b")).alias("share_negative"))
    return rounded(S.adjudicate(f).select("id", "headline_reproduced", "forecast_test_passed", "retention", "kernel_equivalent", "survives_destruction", "reversal_negative", "state"))


@query(f"""WITH {FACTS} SELECT id, concat_ws(',', CASE WHEN NOT a * 5 > 1.96 THEN 'K1' END, CASE WHEN NOT a - 0.4 > 0 THEN 'K2' END, CASE WHEN b * 100 < 30 THEN 'K3' END, CASE WHEN 2 * a < 0.95 THEN 'K4' END) AS fired FROM f""")
def kill_criteria(spark, sf):
    f = _facts(spark, sf).select("id", (F.col("a") * 5).alias("alpha_t"), (F.col("a") - 0.4).alias("sealed_sharpe"), (F.col("b") * 100).alias("breakeven_bps"), F.lit(30.0).alias("realistic_bps"), (2 * F.col("a")).alias("randomisation_percentile"))
    return S.kill_criteria(f).select("id", F.concat_ws(",", "fired").alias("fired"))


def _matrix(spark, sf):
    """The whole monthly series: three predictors and the next month's return."""
    rows = V.series(spark, sf).orderBy("date").collect()
    v = np.array([[r["ret"], r["passive"], r["xs"]] for r in rows])
    return v[:-1], v[1:, 0]


@query()
def complexity_sweep(spark, sf):
    x, y = _matrix(spark, sf)
    forecasts = S.complexity_sweep(spark, x, y, 12, [2, 12, 120], [0.001, 1.0], [0, 1])
    returns = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "pos long, y double")
    return rounded(S.sweep_statistics(forecasts, returns))


@query()
def counterfactual_draws(spark, sf):
    x, y = _matrix(spark, sf)
    frame = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(x)], "pos long, x array<double>")
    weights = L.kernel_weights(frame, "x", 12)
    worlds = [(d, k, float(v)) for d in range(8) for k, v in enumerate(np.random.default_rng(d).permutation(y))]
    return rounded(S.counterfactual_sharpes(spark, weights, spark.createDataFrame(worlds, "draw long, pos long, y double")))
