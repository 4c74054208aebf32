"""Case studies: the drift monitor, option trades, robustness cells, the momentum protocol."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlab.functions.ordering import means_by_row_group
from claimlab.operators import bootstrap as B
from claimlab.operators import cases as K
from claimlab.operators import diagnose as D
from claimlab.operators import evaluate as E
from claimlab.operators import panel as P

from . import views as V
from .inference_queries import DRAWS, WINDOWS
from .panel_queries import WITH
from .registry import query, r, rounded
from .study_queries import GRID, TRADES, _call_sql, _grid, _ledger

MONITOR = WINDOWS + """, w AS (SELECT p0, event_id AS tie, (rs - p * (p + 1) / 2.0) / (p * q) AS auc, row_number() OVER (ORDER BY p0) AS i FROM win JOIN e ON pos = p0),
b AS (SELECT avg(auc) AS m, CASE WHEN coalesce(stddev_pop(auc), 0) > 1e-6 THEN stddev_pop(auc) ELSE 0.02 END AS sd FROM w WHERE i <= 60),
z AS (SELECT {'auc': NULL::DOUBLE, 'tie': NULL::BIGINT, 's': 0.0::DOUBLE, 'alarmed': false, 'n': 0::BIGINT, 'at': NULL::BIGINT, 'm': m, 'sd': sd} AS zero FROM b),
l AS (SELECT list({'auc': auc, 'tie': tie, 's': 0.0::DOUBLE, 'alarmed': false, 'n': 0::BIGINT, 'at': NULL::BIGINT, 'm': m, 'sd': sd} ORDER BY i) AS steps FROM w CROSS JOIN b),
v AS (SELECT list_reduce(list_prepend(zero, steps), lambda a, x: {'auc': x.auc, 'tie': x.tie,
  's': CASE WHEN (NOT a.alarmed AND greatest(0, a.s + a.m - x.auc - 1.5 * a.sd) > 5 * a.sd) OR (a.alarmed AND x.auc >= a.m - 1.5 * a.sd) THEN 0.0 ELSE greatest(0, a.s + a.m - x.auc - 1.5 * a.sd) END,
  'alarmed': CASE WHEN NOT a.alarmed THEN greatest(0, a.s + a.m - x.auc - 1.5 * a.sd) > 5 * a.sd ELSE NOT x.auc >= a.m - 1.5 * a.sd END,
  'n': a.n + CASE WHEN NOT a.alarmed AND greatest(0, a.s + a.m - x.auc - 1.5 * a.sd) > 5 * a.sd THEN 1 ELSE 0 END,
  'at': CASE WHEN a.at IS NULL AND NOT a.alarmed AND greatest(0, a.s + a.m - x.auc - 1.5 * a.sd) > 5 * a.sd THEN x.tie ELSE a.at END, 'm': a.m, 'sd': a.sd}) AS st FROM z CROSS JOIN l),
o AS (SELECT count(*) AS n, sum(y) AS p, count(*) - sum(y) AS q, sum(CASE WHEN y = 1 THEN rk END) AS rs FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM e))
"""


@query(MONITOR + f"""SELECT (SELECT n FROM o) AS n_obs, {r('(SELECT (rs - p * (p + 1) / 2.0) / (p * q) FROM o)', 'overall_auc')}, (SELECT count(*) FROM w) AS n_windows, {r('(SELECT m FROM b)', 'baseline_auc')},
{r('(SELECT min(auc) FROM w)', 'worst_auc')}, (SELECT tie FROM w ORDER BY round(auc, 9), p0 LIMIT 1) AS worst_at, st.n AS n_alarms, st.at AS first_alarm FROM v""")
def drift_monitor(spark, sf):
    return rounded(D.drift_monitor(V.stream(spark, sf)))


MOMENTS = """, rows3 AS (SELECT date, ret AS y, passive AS p, xs AS q FROM series),
mo AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(p) AS sp, sum(q) AS sq, sum(p * p) AS spp, sum(p * q) AS spq, sum(q * q) AS sqq, sum(y) AS sy, sum(p * y) AS spy, sum(q * y) AS sqy, sum(y * y) AS syy FROM rows3),
co AS (SELECT *, spp * sqq - spq * spq AS c00, sq * spq - sp * sqq AS c01, sp * spq - spp * sq AS c02, n * sqq - sq * sq AS c11, sp * sq - n * spq AS c12, n * spp - sp * sp AS c22 FROM mo),
de AS (SELECT *, n * c00 + sp * c01 + sq * c02 AS d FROM co),
be AS (SELECT *, (c00 * sy + c01 * spy + c02 * sqy) / d AS b0, (c01 * sy + c11 * spy + c12 * sqy) / d AS b1, (c02 * sy + c12 * spy + c22 * sqy) / d AS b2 FROM de),
un AS (SELECT date, y - b0 - b1 * p - b2 * q AS u, (y - b0 - b1 * p - b2 * q) * (c00 + c01 * p + c02 * q) / d AS g0, (y - b0 - b1 * p - b2 * q) * (c01 + c11 * p + c12 * q) / d AS g1, (y - b0 - b1 * p - b2 * q) * (c02 + c12 * p + c22 * q) / d AS g2 FROM rows3 CROSS JOIN be),
la AS (SELECT u, term, g, lag(g, 1) OVER w AS a1, lag(g, 2) OVER w AS a2, lag(g, 3) OVER w AS a3 FROM (SELECT date, u, unnest(['const', 'passive', 'xs']) AS term, unnest([g0, g1, g2]) AS g FROM un) WINDOW w AS (PARTITION BY term ORDER BY date)),
se AS (SELECT term, sqrt(sum(g * g) + 1.5 * sum(g * a1) + sum(g * a2) + 0.5 * sum(g * a3)) AS s, sum(u * u) AS sse FROM la GROUP BY term),
sp AS (SELECT term, CASE term WHEN 'const' THEN b0 WHEN 'passive' THEN b1 ELSE b2 END AS c, s, 1 - sse / (syy - sy * sy / n) AS r2, CAST(n AS BIGINT) AS n FROM se CROSS JOIN be)"""


@query(WITH + MOMENTS + f"SELECT term, {r('c', 'coefficient')}, {r('s', 'se')}, {r('c / s', 't', 4)}, {r('c - 1.959963984540054 * s', 'lo')}, {r('c + 1.959963984540054 * s', 'hi')}, {r('r2', 'r2')}, n FROM sp")
def spanning_two(spark, sf):
    out = E.spanning(V.series(spark, sf), "ret", ["passive", "xs"])
    return rounded(out.withColumn("t", F.round("t", 4)))


@query(f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS score, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS label FROM events GROUP BY 1),
numbered AS (SELECT score, label, row_number() OVER (ORDER BY hour) - 1 AS pos, count(*) OVER () AS n FROM h), size AS (SELECT max(n) AS n FROM numbered),
starts AS (SELECT b, j, n, CAST('0x' || substr(md5('0|' || b || '|' || j), 1, 8) AS BIGINT) % (n - 10 + 1) AS start FROM size, range(200) x(b), range(100000) y(j) WHERE j < ceil(n / 10.0)),
drawn AS (SELECT b, score, label FROM starts, range(10) z(o) JOIN numbered ON pos = start + o WHERE j * 10 + o < starts.n),
ranked AS (SELECT b, label, rank() OVER (PARTITION BY b ORDER BY score) + (count(*) OVER (PARTITION BY b, score) - 1) / 2.0 AS rk FROM drawn),
stat AS (SELECT b, sum(label) AS p, count(*) - sum(label) AS q, sum(CASE WHEN label = 1 THEN rk END) AS rs FROM ranked GROUP BY b),
aucs AS (SELECT (rs - p * (p + 1) / 2.0) / (p * q) AS stat FROM stat WHERE p > 0 AND q > 0)
SELECT count(stat) AS draws, {r('quantile_cont(stat, 0.05)', 'lo')}, {r('quantile_cont(stat, 0.95)', 'hi')} FROM aucs""")
def bootstrap_auc_ci(spark, sf):
    hourly = V.stream(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("score").alias("score"), F.max("label").alias("label"))
    return rounded(B.auc_ci(hourly, "label", "score", "hour"))


OPTIONS = f"""{TRADES}, x AS (SELECT g.*, l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS entry, 1e-1 + 1e-2 * p_size AS iv_in, CASE WHEN p_size % 5 > 0 THEN 5e-2 + 4 * l_discount END AS iv_out, 30 + p_size AS dte_in,
(p_size * 7 + l_suppkey) % 60 AS dte_out, 10 + p_size % 7 AS held_days, 10 AS contracts, s_in / 20 AS cost_in, 0.4 AS delta FROM g)"""


def _options(spark, sf):
    c = F.col
    return _ledger(spark, sf).select(
        "*", c("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("entry"), (0.1 + 0.01 * c("p_size")).alias("iv_in"), F.when(c("p_size") % 5 > 0, 0.05 + 4 * c("l_discount")).alias("iv_out"), (30 + c("p_size")).alias("dte_in"),
        ((c("p_size") * 7 + c("l_suppkey")) % 60).alias("dte_out"), (10 + c("p_size") % 7).alias("held_days"), F.lit(10).alias("contracts"), (c("s_in") / 20).alias("cost_in"), F.lit(0.4).alias("delta"))


@query(f"WITH {OPTIONS} SELECT count(DISTINCT (ticker, entry)) AS events, count(DISTINCT (ticker, entry)) = 100 AS verified FROM x WHERE l_returnflag = 'N'")
def option_clock(spark, sf):
    return K.event_count(_options(spark, sf), F.col("l_returnflag") == "N", ["ticker", "entry"], 100)


@query(f"""WITH {OPTIONS}, s AS (SELECT unnest(CASE WHEN dte_out >= 30 THEN ['all', 'far'] ELSE ['all'] END) AS scope, l_returnflag AS status, iv_out - iv_in AS d FROM x WHERE iv_out IS NOT NULL)
SELECT scope, CASE WHEN grouping(status) = 1 THEN 'any' ELSE status END AS status, count(*) AS n, {r('avg(d)', 'mean')}, {r('quantile_cont(d, 0.5)', 'median')}, {r('avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END)', 'share_falling')} FROM s GROUP BY GROUPING SETS ((scope), (scope, status))""")
def observed_mechanism(spark, sf):
    return rounded(K.volatility_moves(_options(spark, sf), "l_returnflag", 30))


@query(f"WITH {OPTIONS} SELECT count(*) AS total, count(iv_out) AS covered, count(*) - count(iv_out) AS excluded, {r('avg(CASE WHEN iv_out IS NOT NULL THEN pnl END)', 'covered_mean', 4)}, {r('avg(CASE WHEN iv_out IS NULL THEN pnl END)', 'excluded_mean', 4)} FROM x")
def excluded_coverage(spark, sf):
    return rounded(K.coverage(_options(spark, sf), F.col("iv_out").isNotNull(), "dollar_pnl"), 4)


@query(f"""WITH {OPTIONS}, y AS (SELECT *, dte_in / 365.0 AS t, s_in * exp((0.02 + 0.5 * iv_in * iv_in) * dte_in / 365.0 + 0.2533471031357997 * iv_in * sqrt(dte_in / 365.0)) AS k FROM x WHERE iv_out IS NOT NULL AND s_out IS NOT NULL),
z AS (SELECT *, t - held_days / 365.0 AS t1 FROM y WHERE k BETWEEN s_in / 20 AND s_in * 5), p AS (SELECT pnl, cost_in, {_call_sql('s_in', 't', 'iv_in')} AS p0, {_call_sql('s_out', 't1', 'iv_out')} AS p1 FROM z)
SELECT count(*) AS n, {r('covar_pop(p0, cost_in) / nullif(sqrt(var_pop(p0) * var_pop(cost_in)), 0)', 'entry_corr')}, {r('quantile_cont(p0 / cost_in, 0.5)', 'entry_median_ratio')},
{r('covar_pop((p1 - p0) * 1000, pnl) / nullif(sqrt(var_pop((p1 - p0) * 1000) * var_pop(pnl)), 0)', 'pnl_corr')}, {r('avg((p1 - p0) * 1000 - pnl)', 'modelled_minus_actual', 4)} FROM p""")
def modelled_attribution(spark, sf):
    out = K.attribution_validity(K.modelled_attribution(_options(spark, sf), 0.02))
    return rounded(out.withColumn("modelled_minus_actual", F.round("modelled_minus_actual", 4)))


CELLS = [(a, b) for a in (24, 25, 26) for b in (0.045, 0.05, 0.055)]
_CELL_SQL = ", ".join(f"{{'label': 'q>={a}/d<={b}', 'a': {a}, 'b': {b}}}" for a, b in CELLS)


@query(f"""WITH {TRADES}, u AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_suppkey AS ticker, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2), c AS (SELECT unnest([{_CELL_SQL}]) AS c),
m AS (SELECT c.label AS label, y, ticker FROM u JOIN c ON q >= c.a AND d <= c.b), tr AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_suppkey AS ticker, pnl FROM g),
si AS (SELECT label, count(*) AS members, count(DISTINCT CASE WHEN ticker NOT IN (SELECT ticker FROM tr) THEN ticker END) AS untested FROM m GROUP BY label),
pe AS (SELECT label, count(*) AS n_trades, avg(pnl) AS mean_pnl, quantile_cont(pnl, 0.5) AS median_pnl, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win FROM tr JOIN m USING (y, ticker) GROUP BY label),
al AS (SELECT si.label, members, untested, coalesce(n_trades, 0) AS n_trades, mean_pnl, median_pnl, win FROM si LEFT JOIN pe USING (label)), ba AS (SELECT mean_pnl AS bm, median_pnl AS bd FROM al WHERE label = 'q>=25/d<=0.05')
SELECT label, members, untested, n_trades, {r('mean_pnl', 'mean_pnl', 4)}, {r('median_pnl', 'median_pnl', 4)}, {r('win', 'win')}, coalesce(sign(mean_pnl) = sign(bm), false) AS mean_pnl_sign_agrees, coalesce(sign(median_pnl) = sign(bd), false) AS median_pnl_sign_agrees,
coalesce(sign(mean_pnl) = sign(bm), false) AND coalesce(sign(median_pnl) = sign(bd), false) AS all_agree FROM al CROSS JOIN ba""")
def universe_robustness(spark, sf):
    per = means_by_row_group(V.read(spark, sf, "lineitem"), {"y": F.year("l_shipdate"), "ticker": F.col("l_suppkey")}, q=F.col("l_quantity"), d=F.col("l_discount"))
    cells = F.array(*[F.struct(F.lit(f"q>={a}/d<={b}").alias("label"), F.lit(float(a)).alias("a"), F.lit(b).alias("b")) for a, b in CELLS])
    members = per.withColumn("c", F.explode(F.filter(cells, lambda c: (F.col("q") >= c["a"]) & (F.col("d") <= c["b"])))).select("c.label", "y", "ticker")
    trades = _ledger(spark, sf).select(F.year("l_shipdate").alias("y"), F.col("l_suppkey").alias("ticker"), "dollar_pnl")
    out = K.perturbed(trades, members, ["y", "ticker"], "ticker", "q>=25/d<=0.05")
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("mean_pnl", "median_pnl")}))


@query(f"""WITH {TRADES}, b AS (SELECT p_brand AS name, avg(stock) AS m, avg(pnl) AS a FROM g GROUP BY 1)
SELECT arg_min(name, (-m, name)) AS modelled_best, arg_min(name, (-a, name)) AS actual_best, arg_min(name, (a, name)) AS actual_worst, arg_min(name, (-m, name)) <> arg_min(name, (-a, name)) AS rank_inverted FROM b""")
def model_vs_reality(spark, sf):
    rows = _ledger(spark, sf).groupBy(F.col("p_brand").alias("name")).agg(F.avg(10_000 * (F.col("s_out") / F.col("s_in") - 1)).alias("m"), F.avg("dollar_pnl").alias("a"))
    return K.rank_inversion(rows, "name", "m", "a")


@query(f"WITH {GRID} SELECT width, count(*) AS cells, {r('avg(expectancy)', 'mean_expectancy')}, {r('avg(sharpe)', 'mean_sharpe')} FROM cells GROUP BY width")
def delta_gradient(spark, sf):
    return rounded(K.gradient(_grid(spark, sf), "width", "expectancy", "sharpe"))


_GAP = "SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'purchase' THEN value END) - avg(CASE WHEN event_type <> 'purchase' THEN value END) AS gap FROM events WHERE user_id % 2 = {k} GROUP BY 1"


@query(f"WITH a AS ({_GAP.format(k=0)}), b AS ({_GAP.format(k=1)}), j AS (SELECT sign(a.gap) = sign(b.gap) AS same FROM a FULL JOIN b ON a.day = b.day) SELECT count(*) AS n, coalesce(bool_and(coalesce(same, false)), false) AS same_shape FROM j")
def replication_shape(spark, sf):
    bought = F.col("event_type") == "purchase"
    gap = lambda k: V.read(spark, sf, "events").where(F.col("user_id") % 2 == k).groupBy(F.to_date("ts").alias("day")).agg((F.avg(F.when(bought, F.col("value"))) - F.avg(F.when(~bought, F.col("value")))).alias("gap"))
    return K.same_shape(gap(0), gap(1), "day", "gap")


@query(f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1), a AS (SELECT min(hour) AS alarm_hour FROM h WHERE v < (SELECT avg(value) * 0.5 FROM events))
SELECT {r('arg_max(CASE WHEN hour <= alarm_hour THEN v END, CASE WHEN hour <= alarm_hour THEN hour END)', 'at_alarm')}, {r('arg_max(v, hour)', 'latest')} FROM h CROSS JOIN a""")
def driver_at_alarm(spark, sf):
    s = V.stream(spark, sf)
    hourly = s.groupBy(F.date_trunc("hour", "ts").alias("date")).agg(F.avg("score").alias("value"))
    low = hourly.join(F.broadcast(s.agg((F.avg("score") * 0.5).alias("m")))).where("value < m").select(F.col("date").alias("at"))
    return rounded(K.driver_at(hourly, low))


@query(WITH + f"SELECT date, market, {r('product(1 + coalesce(ret, 0)) OVER (PARTITION BY market ORDER BY date)', 'growth')} FROM rets", dates=("date",))
def cumulative_growth(spark, sf):
    p = P.market_returns(V.close_panel(spark, sf))
    return rounded(K.cumulative_growth(p, "date", "ret", "market").select("date", "market", "growth"))


@query(f"""WITH d AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT p, last_day(day) AS month, max(day) AS day, {r('arg_max(v, day)', 'value', 4)} FROM d GROUP BY 1, 2""", dates=("month", "day"))
def month_end_last(spark, sf):
    daily = V.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(K.month_end(daily, "date", "v", "p"), 4)


@query("""WITH w AS (SELECT user_id, CAST(ts AS DATE) AS d, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (d IS NULL) AS missing, count(*) FILTER (d < b) AS unsorted, count(*) FILTER (d = b) AS repeated FROM w GROUP BY 1""")
def date_validation(spark, sf):
    rows = V.read(spark, sf, "events").select("user_id", F.to_date("ts").alias("d"), (-F.col("event_id")).alias("place"))
    return K.date_problems(rows, "d", "place", "user_id")


_MEAN = "(SELECT count(stat) AS draws, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM (SELECT avg(ret) AS stat FROM drawn GROUP BY b))"
_SHARPE = "(SELECT count(stat) AS draws, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM (SELECT avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS stat FROM drawn GROUP BY b))"


@query(WITH + DRAWS + f""" SELECT count(ret) AS n, {r('avg(ret)', 'mean')}, {r('avg(ret) * 12', 'ann')}, {r('stddev_samp(ret) * sqrt(12)', 'vol')}, {r('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)', 'sharpe')},
{r(f'(SELECT lo FROM {_MEAN})', 'mean_lo')}, {r(f'(SELECT hi FROM {_MEAN})', 'mean_hi')}, {r(f'(SELECT lo FROM {_SHARPE})', 'sharpe_lo')}, {r(f'(SELECT hi FROM {_SHARPE})', 'sharpe_hi')} FROM series""")
def stats_bundle(spark, sf):
    return rounded(K.stats_bundle(V.series(spark, sf)))


@query(WITH + f"""SELECT benchmark, count(*) AS n, {r('avg(b) / nullif(stddev_samp(b), 0) * sqrt(12)', 'sharpe')}, {r('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)', 'own')}, {r('covar_pop(ret, b) / nullif(sqrt(var_pop(ret) * var_pop(b)), 0)', '"corr"')}
FROM (SELECT ret, unnest(['passive', 'xs']) AS benchmark, unnest([passive, xs]) AS b FROM series) GROUP BY benchmark""")
def two_benchmarks(spark, sf):
    return rounded(K.against_benchmarks(V.series(spark, sf), "ret", ["passive", "xs"]))


def _drawn(name: str, source: str) -> str:
    """The 2,000 digest draws of a series (date, ret), in SQL."""
    return f""", n_{name} AS (SELECT ret, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM {source} WHERE ret IS NOT NULL), z_{name} AS (SELECT max(n) AS n FROM n_{name}),
s_{name} AS (SELECT b, j, n, CAST('0x' || substr(md5('0|' || b || '|' || j), 1, 8) AS BIGINT) % (n - 6 + 1) AS start FROM z_{name}, range(2000) x(b), range(1000) y(j) WHERE j < ceil(n / 6.0)),
d_{name} AS (SELECT b, ret FROM s_{name}, range(6) o(o) JOIN n_{name} ON pos = start + o WHERE j * 6 + o < s_{name}.n)"""


@query(WITH + MOMENTS + """, sealed AS (SELECT date, ret FROM series WHERE date >= DATE '1999-06-01'), net AS (SELECT series.date, series.ret - coalesce(turnover, 0) * 20 / 1e4 AS ret FROM series LEFT JOIN port USING (date))""" + _drawn("sealed", "sealed") + _drawn("net", "net") + f""",
ci AS (SELECT quantile_cont(stat, 0.025) AS sealed_lo, quantile_cont(stat, 0.975) AS sealed_hi FROM (SELECT avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS stat FROM d_sealed GROUP BY b)),
cn AS (SELECT quantile_cont(stat, 0.025) AS net_lo, quantile_cont(stat, 0.975) AS net_hi FROM (SELECT avg(ret) AS stat FROM d_net GROUP BY b)),
signs AS (SELECT seed, date, market, ret, abs(ts) * CASE WHEN substr(md5(seed || '|' || strftime(date, '%Y-%m-%d') || '|' || market), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS position FROM positions, range(200) t(seed)),
legs AS (SELECT seed, date, lag(position) OVER (PARTITION BY seed, market ORDER BY date) * ret AS c FROM signs),
months AS (SELECT seed, date, avg(c) AS ret FROM legs GROUP BY seed, date), sh AS (SELECT seed, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS s FROM months WHERE ret IS NOT NULL GROUP BY seed),
own AS (SELECT avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS s FROM series), pc AS (SELECT avg(CASE WHEN sh.s < own.s THEN 1.0 ELSE 0.0 END) AS percentile FROM sh CROSS JOIN own),
al AS (SELECT c AS alpha, c - 1.959963984540054 * s AS alpha_lo, c + 1.959963984540054 * s AS alpha_hi FROM sp WHERE term = 'const')
SELECT {', '.join(r(c, c) for c in ('alpha', 'alpha_lo', 'alpha_hi', 'sealed_lo', 'sealed_hi', 'net_lo', 'net_hi', 'percentile'))},
concat_ws(',', CASE WHEN alpha_lo <= 0 AND alpha_hi >= 0 THEN 'K1' END, CASE WHEN sealed_lo <= 0 AND sealed_hi >= 0 THEN 'K2' END, CASE WHEN net_lo <= 0 AND net_hi >= 0 THEN 'K3' END, CASE WHEN percentile < 0.95 THEN 'K4' END) AS fired FROM al CROSS JOIN ci CROSS JOIN cn CROSS JOIN pc""")
def momentum_protocol(spark, sf):
    positions = P.tsmom_positions(V.panel(spark, sf))
    drawn = positions.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(199))))
    coin = F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.date_format("date", "yyyy-MM-dd"), "market")), 1, 1)
    legs = drawn.withColumn("position", F.abs("position") * F.when(coin < "8", 1.0).otherwise(-1.0)).withColumn("c", F.lag("position").over(Window.partitionBy("seed", "market").orderBy("date")) * F.col("ret"))
    randomised = E.sharpe(legs.groupBy("seed", "date").agg(F.avg("c").alias("ret")).where("ret is not null"), "ret", 12, "seed").select("sharpe")
    return rounded(K.momentum_protocol(V.series(spark, sf), P.panel_turnover(positions), randomised, "1999-06-01", 20.0))


_HIT = lambda patterns: " OR ".join(f"regexp_matches(lower(line), '{p}')" for p in patterns)
CHECKLIST = [("licence", ["licensed under", "all rights"]), ("contact", [r"@\w+\.", r"\+\d"]), ("secret", ["token", "password"])]


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, i, {', '.join(f'({_HIT(p)}) AS h{k}' for k, (_, p) in enumerate(CHECKLIST))} FROM l),
a AS (SELECT doc_id, min(i) FILTER (h0) AS l0 FROM h GROUP BY 1), b AS (SELECT a.doc_id, l0, min(i) FILTER (h1 AND i IS DISTINCT FROM l0) AS l1 FROM a JOIN h USING (doc_id) GROUP BY 1, 2),
c AS (SELECT b.doc_id, l0, l1, min(i) FILTER (h2 AND i IS DISTINCT FROM l0 AND i IS DISTINCT FROM l1) AS l2 FROM b JOIN h USING (doc_id) GROUP BY 1, 2, 3)
SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN l{k} IS NOT NULL THEN '{n}' END" for k, (n, _) in enumerate(CHECKLIST))}) AS covered, concat_ws(',', {', '.join(f"CASE WHEN l{k} IS NULL THEN '{n}' END" for k, (n, _) in enumerate(CHECKLIST))}) AS missed FROM c""")
def checklist_score(spark, sf):
    from claimlab.operators.prose import score_checklist

    lines = V.read(spark, sf, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where("line is not null")
    scored = score_checklist(lines, CHECKLIST, "doc_id")
    missed = F.array_except(F.array(*[F.lit(n) for n, _ in CHECKLIST]), "covered")
    return scored.select("doc_id", F.concat_ws(",", "covered").alias("covered"), F.concat_ws(",", missed).alias("missed"))
