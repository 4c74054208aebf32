"""Panel, portfolio and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlab.operators import costs as C
from claimlab.operators import evaluate as E
from claimlab.operators import panel as P

from . import views as V
from .registry import query, r, rounded

PANEL = """
raw AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, c_mktsegment AS market, sum(o_totalprice) AS close
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
grid AS (SELECT * FROM (SELECT DISTINCT date FROM raw) CROSS JOIN (SELECT DISTINCT market FROM raw)),
rets AS (SELECT date, market, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 12) OVER w - 1 AS t12
         FROM grid LEFT JOIN raw USING (date, market) WINDOW w AS (PARTITION BY market ORDER BY date)),
panel AS (SELECT *, CASE WHEN count(ret) OVER w = 12 THEN stddev_samp(ret) OVER w * sqrt(12) END AS vol
          FROM rets WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, CASE WHEN t12 IS NOT NULL THEN
             (rank() OVER (PARTITION BY date ORDER BY t12 NULLS LAST) + (count(*) OVER (PARTITION BY date, t12) - 1) / 2.0) / count(t12) OVER (PARTITION BY date) END AS pct FROM panel),
signals AS (SELECT *, sign(t12) AS s_ts, CASE WHEN t12 IS NOT NULL THEN 1.0 ELSE 0.0 END AS s_pa, 2.0 * (pct - avg(pct) OVER (PARTITION BY date)) AS s_xs FROM ranked),
positions AS (SELECT date, market, close, ret, vol, t12,
   CASE WHEN s_ts IS NOT NULL AND vol IS NOT NULL THEN least(greatest(s_ts * 0.15 / greatest(vol, 0.05), -4), 4) END AS ts,
   CASE WHEN vol IS NOT NULL THEN least(greatest(s_pa * 0.15 / greatest(vol, 0.05), -4), 4) END AS pa,
   CASE WHEN s_xs IS NOT NULL AND vol IS NOT NULL THEN least(greatest(s_xs * 0.15 / greatest(vol, 0.05), -4), 4) END AS xs FROM signals),
held AS (SELECT *, lag(ts) OVER w * ret AS c_ts, lag(pa) OVER w * ret AS c_pa, lag(xs) OVER w * ret AS c_xs, abs(ts - lag(ts) OVER w) AS moved
         FROM positions WINDOW w AS (PARTITION BY market ORDER BY date)),
port AS (SELECT date, avg(c_ts) AS ret, avg(c_pa) AS passive, avg(c_xs) AS xs, avg(moved) AS turnover FROM held GROUP BY date),
series AS (SELECT date, ret, passive, xs FROM port WHERE ret IS NOT NULL AND passive IS NOT NULL AND xs IS NOT NULL)
"""
WITH = "WITH " + PANEL


@query(WITH + f"SELECT date, market, {r('close', 'close', 2)}, {r('ret', 'ret')} FROM rets", dates=('date',))
def market_returns(spark, sf):
    p = P.market_returns(V.close_panel(spark, sf)).select("date", "market", F.round("close", 2).alias("close"), "ret")
    return rounded(p)


@query(WITH + f"SELECT date, market, {r('vol', 'vol')} FROM panel", dates=('date',))
def rolling_volatility(spark, sf):
    return rounded(V.panel(spark, sf).select("date", "market", "vol"))


@query(WITH + f"SELECT date, market, {r('ts', 'position')} FROM positions", dates=('date',))
def tsmom_positions(spark, sf):
    return rounded(P.tsmom_positions(V.panel(spark, sf)).select("date", "market", "position"))


@query(WITH + f"SELECT date, market, {r('pa', 'position')} FROM positions", dates=('date',))
def passive_positions(spark, sf):
    return rounded(P.passive_positions(V.panel(spark, sf)).select("date", "market", "position"))


@query(WITH + f"SELECT date, market, {r('xs', 'position')} FROM positions", dates=('date',))
def xsmom_positions(spark, sf):
    return rounded(P.xsmom_positions(V.panel(spark, sf)).select("date", "market", "position"))


@query(WITH + f"""SELECT date, market, {r('CASE WHEN count(ts) OVER w = 3 THEN avg(ts) OVER w END', 'position')} FROM positions
WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", dates=('date',))
def holding_period_positions(spark, sf):
    return rounded(P.holding_positions(P.tsmom_positions(V.panel(spark, sf)), 3).select("date", "market", "position"))


@query(WITH + f"""SELECT date, market, {r("abs(ts) * CASE WHEN substr(md5('7|' || strftime(date, '%Y-%m-%d') || '|' || market), 1, 1) < '8' THEN 1.0 ELSE -1.0 END", 'position')} FROM positions""", dates=('date',))
def random_sign_positions(spark, sf):
    return rounded(P.random_sign_positions(P.tsmom_positions(V.panel(spark, sf)), 7).select("date", "market", "position"))


@query(WITH + f"SELECT date, {r('ret', 'ret')} FROM port WHERE ret IS NOT NULL", dates=('date',))
def portfolio_returns(spark, sf):
    return rounded(P.portfolio_returns(P.tsmom_positions(V.panel(spark, sf))))


@query(WITH + f"SELECT date, market, {r('c_ts', 'contribution')} FROM held WHERE c_ts IS NOT NULL", dates=('date',))
def market_contributions(spark, sf):
    return rounded(P.contributions(P.tsmom_positions(V.panel(spark, sf))).where("contribution is not null").select("date", "market", "contribution"))


@query(WITH + f"SELECT date, {r('turnover', 'turnover')} FROM port WHERE turnover IS NOT NULL", dates=('date',))
def panel_turnover(spark, sf):
    return rounded(P.panel_turnover(P.tsmom_positions(V.panel(spark, sf))))


@query(WITH + f""", split AS (SELECT *, CASE WHEN ts IS NOT NULL THEN avg(ts) OVER (PARTITION BY date) END AS tilt FROM positions),
legs AS (SELECT date, lag(tilt) OVER w * ret AS a, lag(ts - tilt) OVER w * ret AS b FROM split WINDOW w AS (PARTITION BY market ORDER BY date))
SELECT date, {r('avg(a)', 'tilt')}, {r('avg(b)', 'timing')} FROM legs GROUP BY date HAVING avg(a) IS NOT NULL AND avg(b) IS NOT NULL""", dates=('date',))
def tilt_and_timing(spark, sf):
    return rounded(P.decompose(P.tsmom_positions(V.panel(spark, sf))))


@query(WITH + f""" SELECT a.market AS "left", b.market AS "right", {r('corr(a.ret, b.ret)', '"corr"')} FROM rets a JOIN rets b ON a.date = b.date AND a.market < b.market
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 24 ORDER BY abs(corr(a.ret, b.ret)) DESC, 1, 2 LIMIT 1""")
def most_correlated_pair(spark, sf):
    return rounded(P.most_correlated_pair(P.market_returns(V.close_panel(spark, sf))))


CAPITAL = 1e8
LOTS = """, sized AS (SELECT *, CASE WHEN ts IS NOT NULL AND close IS NOT NULL THEN round_even(ts * (1e8 / nullif(sum(CASE WHEN ts IS NOT NULL AND close IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY date), 0)) / (close * 0.1), 0) END AS contracts FROM positions),
lots AS (SELECT *, lag(contracts) OVER w * lag(close) OVER w * ret * 0.1 AS pnl, (coalesce(abs(lag(contracts) OVER w), 0) + coalesce(abs(contracts), 0)) * close * 0.1 AS traded FROM sized WINDOW w AS (PARTITION BY market ORDER BY date))
"""


def _contracts(spark, sf):
    return P.integer_contracts(P.tsmom_positions(V.panel(spark, sf)), CAPITAL, 0.1)


@query(WITH + LOTS + "SELECT date, market, contracts + 0.0 AS contracts FROM lots", dates=('date',))
def integer_contracts(spark, sf):
    return rounded(_contracts(spark, sf).select("date", "market", "contracts"))


@query(WITH + LOTS + f"SELECT date, {r('sum(pnl) / 1e8', 'ret')} FROM lots GROUP BY date HAVING sum(pnl) IS NOT NULL", dates=('date',))
def contract_returns(spark, sf):
    return rounded(P.contract_returns(_contracts(spark, sf), CAPITAL, 0.1))


@query(WITH + LOTS + f"SELECT date, {r('sum(traded) / 1e8', 'turnover')} FROM lots GROUP BY date HAVING sum(traded) IS NOT NULL", dates=('date',))
def contract_turnover(spark, sf):
    return rounded(P.contract_turnover(_contracts(spark, sf), CAPITAL, 0.1))


STATS = f"count(ret) AS n, {r('avg(ret)', 'mean')}, {r('avg(ret) * 12', 'ann')}, {r('stddev_samp(ret) * sqrt(12)', 'vol')}, {r('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)', 'sharpe')}"


@query(WITH + f"SELECT {STATS} FROM port WHERE ret IS NOT NULL")
def sharpe_stats(spark, sf):
    return rounded(E.sharpe(P.portfolio_returns(P.tsmom_positions(V.panel(spark, sf)))))


@query(WITH + f"SELECT market, {STATS} FROM rets GROUP BY market")
def sharpe_by_market(spark, sf):
    return rounded(E.sharpe(P.market_returns(V.close_panel(spark, sf)), "ret", 12, "market"))


@query(WITH + f"""SELECT {r('12 * (avg(ret) - 2.5 * var_samp(ret))', 'cer')} FROM port WHERE ret IS NOT NULL""")
def certainty_equivalent(spark, sf):
    rets = P.portfolio_returns(P.tsmom_positions(V.panel(spark, sf)))
    return rounded(rets.agg((12 * (F.avg("ret") - 2.5 * F.var_samp("ret"))).alias("cer")))


@query(WITH + f"""SELECT CAST(bps AS DOUBLE) AS cost_bps, {r('avg(ret - turnover * bps / 1e4 * 2)', 'mean_per_period')}, {r('avg(ret - turnover * bps / 1e4 * 2) * 12', 'mean_annualized')},
{r('avg(ret - turnover * bps / 1e4 * 2) / nullif(stddev_samp(ret - turnover * bps / 1e4 * 2), 0) * sqrt(12)', 'sharpe')}
FROM port CROSS JOIN (SELECT unnest([0, 5, 10, 20]) AS bps) WHERE ret IS NOT NULL AND turnover IS NOT NULL GROUP BY bps""")
def cost_sensitivity(spark, sf):
    return rounded(C.cost_sensitivity(_gross(spark, sf)))


def _gross(spark, sf):
    p = P.tsmom_positions(V.panel(spark, sf))
    return P.portfolio_returns(p).join(P.panel_turnover(p), "date")


@query(WITH + f"""SELECT {r('g', 'gross_mean')}, {r('t', 'turn')}, {r("CASE WHEN t > 0 THEN g / (t * 2) * 1e4 WHEN g > 0 THEN 'Infinity'::DOUBLE END", 'breakeven_bps')}, {r('g - t * 10 / 1e4 * 2', 'net_mean')},
{r('(g - t * 10 / 1e4 * 2) * 12', 'net_annualized')}, {r('(t * 10 / 1e4 * 2) / nullif(abs(g), 0)', 'cost_share_of_gross')}, coalesce(g - t * 10 / 1e4 * 2 > 0 AND g > 0, false) AS survives_costs
FROM (SELECT avg(ret) AS g, avg(turnover) AS t FROM port WHERE ret IS NOT NULL AND turnover IS NOT NULL)""")
def cost_anatomy(spark, sf):
    means = C.breakeven_cost(_gross(spark, sf)).drop("breakeven_bps")
    return rounded(C.cost_anatomy(means, 10.0))


BOOKS = "books AS (SELECT l_suppkey AS name, sum(CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN l_extendedprice END) AS a, sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN l_extendedprice END) AS b FROM lineitem GROUP BY 1), w AS (SELECT name, a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM books)"


@query(f"WITH {BOOKS} SELECT {r('0.5 * sum(abs(coalesce(b, 0) - coalesce(a, 0)))', 'turnover')} FROM w")
def turnover_books(spark, sf):
    lines = V.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("name"), "l_shipdate", "l_extendedprice")
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")

    def book(rows):
        sums = rows.groupBy("name").agg(F.sum("l_extendedprice").alias("v"))
        total = sums.agg(F.sum("v").alias("total"))
        return sums.join(F.broadcast(total)).select("name", (F.col("v") / F.col("total")).alias("w"))

    return rounded(C.turnover(book(lines.where(early)), book(lines.where(~early))))


CURVE = "curve AS (SELECT l_returnflag AS flag, l_discount AS level, avg(l_extendedprice / 1e4 - 2.5 - l_discount * 20) AS e FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {CURVE}, steps AS (SELECT flag, level AS l0, lead(level) OVER w AS l1, e AS a, lead(e) OVER w AS b FROM curve WINDOW w AS (PARTITION BY flag ORDER BY level))
SELECT flag, {r('min(CASE WHEN a > 0 AND b <= 0 THEN l0 + (l1 - l0) * a / (a - b) END)', 'breakeven')} FROM steps GROUP BY flag""")
def breakeven_friction(spark, sf):
    lines = V.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("level"), "l_extendedprice")
    curve = lines.groupBy("flag", "level").agg(F.avg(F.col("l_extendedprice") / 1e4 - 2.5 - F.col("level") * 20).alias("e"))
    return rounded(C.breakeven_friction(curve, "level", "e", "flag"))


@query(f"""WITH daily AS (SELECT CAST(date_trunc('day', l_shipdate) AS DATE) AS day, (avg(l_extendedprice) - 25000) / 1e6 AS ret FROM lineitem GROUP BY 1)
SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n, {r('exp(sum(ln(1 + ret))) - 1', 'ret')}, {r('sum(ret * ret)', 'realised_var', 8)} FROM daily GROUP BY 1""", dates=('month',))
def month_compound(spark, sf):
    return _months(spark, sf).select("month", "n", (F.round("ret", 6) + 0.0).alias("ret"), (F.round("realised_var", 8) + 0.0).alias("realised_var"))


def _months(spark, sf):
    daily = V.read(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(((F.avg("l_extendedprice") - 25000) / 1e6).alias("ret"))
    return daily.groupBy(F.trunc("day", "month").alias("month")).agg(F.count("*").alias("n"), (F.product(1 + F.col("ret")) - 1).alias("ret"), F.sum(F.col("ret") ** 2).alias("realised_var"))


MANAGED = """WITH daily AS (SELECT CAST(date_trunc('day', l_shipdate) AS DATE) AS day, (avg(l_extendedprice) - 25000) / 1e6 AS ret FROM lineitem GROUP BY 1),
months AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, exp(sum(ln(1 + ret))) - 1 AS ret, sum(ret * ret) AS rv FROM daily GROUP BY 1),
lagged AS (SELECT month, ret, lag(rv) OVER (ORDER BY month) AS rv FROM months),
raw AS (SELECT month, ret, ret / rv AS raw FROM lagged WHERE rv > 0),
scale AS (SELECT sqrt(var_samp(ret) / nullif(var_samp(raw), 0)) AS c FROM raw WHERE month <= DATE '1998-12-01'),
managed AS (SELECT month, ret, raw * c AS managed, c * raw / nullif(ret, 0) AS weight FROM raw CROSS JOIN scale)
"""


@query(MANAGED + f"SELECT month, {r('ret', 'ret')}, {r('managed', 'managed')}, {r('coalesce(abs(weight - lag(weight) OVER (ORDER BY month)), 0)', 'turnover')} FROM managed", dates=('month',))
def managed_returns(spark, sf):
    from claimlab.operators.allocation import managed

    return rounded(managed(_months(spark, sf), "1998-12-01").select("month", "ret", "managed", "turnover"))


@query(WITH + f""", moments AS (SELECT date, passive AS x, xs AS y, count(*) OVER w AS n, avg(passive) OVER w AS mx, avg(xs) OVER w AS my, var_samp(passive) OVER w AS vx, var_samp(xs) OVER w AS vy, covar_samp(passive, xs) OVER w AS vxy
  FROM series WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (SELECT date, x, y, (vy * mx - vxy * my) / (5 * nullif(vx * vy - vxy * vxy, 0)) AS wx, (vx * my - vxy * mx) / (5 * nullif(vx * vy - vxy * vxy, 0)) AS wy FROM moments WHERE n >= 24),
capped AS (SELECT date, x, y, wx * least(1, 5 / nullif(abs(wx) + abs(wy), 0)) AS wx, wy * least(1, 5 / nullif(abs(wx) + abs(wy), 0)) AS wy FROM wanted)
SELECT date, {r('wx', 'wx')}, {r('wy', 'wy')}, {r('wx * x + wy * y', 'ret')} FROM capped""", dates=('date',))
def realtime_allocation(spark, sf):
    from claimlab.operators.allocation import realtime

    return rounded(realtime(V.series(spark, sf), "passive", "xs", least=24).select("date", "wx", "wy", "ret"))
