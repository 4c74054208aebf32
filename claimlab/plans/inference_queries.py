"""Inference, resampling and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlab.functions.expressions import cusum_hits
from claimlab.operators import bootstrap as B
from claimlab.operators import diagnose as D
from claimlab.operators import evaluate as E
from claimlab.operators import panel as P

from . import views as V
from .panel_queries import WITH
from .registry import query, r, rounded


@query(WITH + f""", f AS (SELECT ret AS a, passive AS f, avg(ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM series)
SELECT count(*) AS n, {r('1 - sum((a - f) * (a - f)) / nullif(sum((a - b) * (a - b)), 0)', 'oos_r2')} FROM f WHERE b IS NOT NULL""")
def oos_r2(spark, sf):
    return rounded(E.oos_r2(V.series(spark, sf), "ret", "passive"))


AUC = """per AS (SELECT {by} s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS q FROM scored GROUP BY {by} s),
below AS (SELECT *, coalesce(sum(q) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM per)"""


@query(f"""WITH scored AS (SELECT CAST(n_chars AS DOUBLE) AS s, quality AS y FROM labels JOIN documents USING (doc_id)), {AUC.format(by='', part='')}
SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, {r('sum(p * (b + q / 2.0)) / nullif(sum(p) * sum(q), 0)', 'auc')} FROM below""")
def auc(spark, sf):
    scored = V.read(spark, sf, "labels").join(V.read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(E.auc(scored, "quality", "n_chars"))


@query(f"""WITH scored AS (SELECT lang, floor(n_chars / 1000.0) AS s, quality AS y FROM labels JOIN documents USING (doc_id)), {AUC.format(by='lang,', part='PARTITION BY lang')}
SELECT lang, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, {r('sum(p * (b + q / 2.0)) / nullif(sum(p) * sum(q), 0)', 'auc')} FROM below GROUP BY lang""")
def auc_with_ties(spark, sf):
    scored = V.read(spark, sf, "labels").join(V.read(spark, sf, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 1000).alias("s")), "doc_id")
    return rounded(E.auc(scored, "quality", "s", "lang"))


HAC = """u AS (SELECT d - avg(d) OVER () AS u, d, date FROM d),
l AS (SELECT d, u, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM u WINDOW w AS (ORDER BY date)),
h AS (SELECT count(*) AS n, avg(d) AS mean, (sum(u * u) + 2 * 0.75 * sum(u * u1) + 2 * 0.5 * sum(u * u2) + 2 * 0.25 * sum(u * u3)) / count(*) AS var FROM l)"""


@query(WITH + f", d AS (SELECT date, ret AS d FROM series), {HAC} SELECT n, {r('mean', 'mean')}, {r('mean / sqrt(var / n)', 't')} FROM h")
def hac_t(spark, sf):
    return rounded(E.hac_t(V.series(spark, sf), "ret"))


@query(WITH + f", d AS (SELECT date, (ret - passive) * (ret - passive) - ((ret - xs) * (ret - xs) - (passive - xs) * (passive - xs)) AS d FROM series), {HAC} SELECT {r('mean / sqrt(var / n)', 'cw_t')}, mean / sqrt(var / n) > 1.645 AS reject_5pct FROM h")
def clark_west(spark, sf):
    return rounded(E.clark_west(V.series(spark, sf), "ret", "passive", "xs"))


@query(WITH + f", d AS (SELECT date, (ret - passive) * (ret - passive) - (ret - xs) * (ret - xs) AS d FROM series), {HAC} SELECT {r('mean / sqrt(var / n)', 'dm_t')} FROM h")
def diebold_mariano(spark, sf):
    return rounded(E.diebold_mariano(V.series(spark, sf), "ret", "passive", "xs"))


@query(WITH + f""", b AS (SELECT count(*) AS n, avg(passive) AS mx, covar_pop(ret, passive) / var_pop(passive) AS beta, avg(ret) - covar_pop(ret, passive) / var_pop(passive) * avg(passive) AS alpha, var_pop(passive) * count(*) AS sxx, sum(passive * passive) AS q, sum(passive) AS s, var_pop(ret) * count(*) AS sst FROM series),
u AS (SELECT date, ret - alpha - beta * passive AS u, (ret - alpha - beta * passive) * ((q - passive * s) / (n * q - s * s)) AS ga, (ret - alpha - beta * passive) * ((n * passive - s) / (n * q - s * s)) AS gb FROM series CROSS JOIN b),
l AS (SELECT *, lag(ga, 1) OVER w AS a1, lag(ga, 2) OVER w AS a2, lag(ga, 3) OVER w AS a3, lag(gb, 1) OVER w AS b1, lag(gb, 2) OVER w AS b2, lag(gb, 3) OVER w AS b3 FROM u WINDOW w AS (ORDER BY date)),
v AS (SELECT sqrt(sum(ga * ga) + 1.5 * sum(ga * a1) + sum(ga * a2) + 0.5 * sum(ga * a3)) AS sa, sqrt(sum(gb * gb) + 1.5 * sum(gb * b1) + sum(gb * b2) + 0.5 * sum(gb * b3)) AS sb, sum(u * u) AS sse FROM l)
SELECT t.term, {r('t.c', 'coefficient')}, {r('t.s', 'se')}, {r('t.c / t.s', 't', 4)}, {r('t.c - 1.959963984540054 * t.s', 'lo')}, {r('t.c + 1.959963984540054 * t.s', 'hi')}, {r('1 - sse / sst', 'r2')}, n
FROM b CROSS JOIN v CROSS JOIN LATERAL (SELECT 'const' AS term, alpha AS c, sa AS s UNION ALL SELECT 'passive', beta, sb) t""")
def spanning_one(spark, sf):
    out = E.spanning(V.series(spark, sf), "ret", ["passive"])
    return rounded(out.withColumn("t", F.round("t", 4)))


N_BOOT, BLOCK = 2_000, 6
DRAWS = """, numbered AS (SELECT ret, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM series),
size AS (SELECT max(n) AS n FROM numbered),
starts AS (SELECT b, j, n, CAST('0x' || substr(md5('0|' || b || '|' || j), 1, 8) AS BIGINT) % (n - 6 + 1) AS start FROM size, range(2000) x(b), range(1000) y(j) WHERE j < ceil(n / 6.0)),
drawn AS (SELECT b, ret FROM starts, range(6) z(o) JOIN numbered ON pos = start + o WHERE j * 6 + o < starts.n)"""


@query(WITH + DRAWS + f", stat AS (SELECT avg(ret) AS stat FROM drawn GROUP BY b) SELECT count(stat) AS draws, {r('quantile_cont(stat, 0.025)', 'lo')}, {r('quantile_cont(stat, 0.975)', 'hi')} FROM stat")
def bootstrap_mean_ci(spark, sf):
    return rounded(B.mean_ci(V.series(spark, sf), n_boot=N_BOOT, block=BLOCK))


@query(WITH + DRAWS + f", stat AS (SELECT avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS stat FROM drawn GROUP BY b) SELECT count(stat) AS draws, {r('quantile_cont(stat, 0.025)', 'lo')}, {r('quantile_cont(stat, 0.975)', 'hi')} FROM stat")
def bootstrap_sharpe_ci(spark, sf):
    return rounded(B.sharpe_ci(V.series(spark, sf), n_boot=N_BOOT, block=BLOCK))


@query()
def bootstrap_sharpe_ci_numpy(spark, sf):
    return rounded(B.sharpe_ci(V.series(spark, sf), n_boot=N_BOOT, block=BLOCK, generator="numpy"))


@query(WITH + f""", base AS (SELECT date, market, abs(ts) AS size, ret FROM positions),
drawn AS (SELECT seed, date, market, ret, size * CASE WHEN substr(md5(seed || '|' || strftime(date, '%Y-%m-%d') || '|' || market), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS position FROM base, range(200) t(seed)),
held2 AS (SELECT seed, date, lag(position) OVER (PARTITION BY seed, market ORDER BY date) * ret AS c FROM drawn),
series2 AS (SELECT seed, date, avg(c) AS ret FROM held2 GROUP BY seed, date),
sharpes AS (SELECT seed, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS s FROM series2 WHERE ret IS NOT NULL GROUP BY seed),
own AS (SELECT avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) AS s FROM port WHERE ret IS NOT NULL)
SELECT count(*) AS draws, {r('avg(CASE WHEN sharpes.s < own.s THEN 1.0 ELSE 0.0 END)', 'percentile')}, {r('quantile_cont(sharpes.s, 0.05)', 'p05')}, {r('quantile_cont(sharpes.s, 0.95)', 'p95')} FROM sharpes CROSS JOIN own""")
def sign_randomisation(spark, sf):
    base = P.tsmom_positions(V.panel(spark, sf))
    drawn = base.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(199))))
    coin = F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.date_format("date", "yyyy-MM-dd"), "market")), 1, 1)
    from pyspark.sql import Window

    w = Window.partitionBy("seed", "market").orderBy("date")
    signed = drawn.withColumn("position", F.abs("position") * F.when(coin < "8", 1.0).otherwise(-1.0)).withColumn("c", F.lag("position").over(w) * F.col("ret"))
    sharpes = E.sharpe(signed.groupBy("seed", "date").agg(F.avg("c").alias("ret")).where("ret is not null"), "ret", 12, "seed")
    own = E.sharpe(P.portfolio_returns(base)).select(F.col("sharpe").alias("own"))
    out = sharpes.join(F.broadcast(own)).agg(F.count("*").alias("draws"), F.avg((F.col("sharpe") < F.col("own")).cast("double")).alias("percentile"), F.percentile("sharpe", F.lit(0.05)).alias("p05"), F.percentile("sharpe", F.lit(0.95)).alias("p95"))
    return rounded(out)


WINDOWS = """WITH e AS (SELECT ts, event_id, value AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
pairs AS (SELECT e.pos AS p0, w.s, w.y FROM e JOIN e w ON w.pos BETWEEN e.pos - 149 AND e.pos WHERE e.pos >= 149),
ranked AS (SELECT p0, s, y, rank() OVER (PARTITION BY p0 ORDER BY s) + (count(*) OVER (PARTITION BY p0, s) - 1) / 2.0 AS rk FROM pairs),
win AS (SELECT p0, sum(y) AS p, 150 - sum(y) AS q, sum(CASE WHEN y = 1 THEN rk END) AS rs, abs(avg(s) - avg(y)) AS calib FROM ranked GROUP BY p0 HAVING least(sum(y), 150 - sum(y)) >= 5)
"""


@query(WINDOWS + f"SELECT e.event_id AS tie, {r('(rs - p * (p + 1) / 2.0) / (p * q)', 'auc')}, {r('calib', 'calib_err')} FROM win JOIN e ON pos = p0")
def rolling_auc(spark, sf):
    return rounded(D.rolling_windows(V.stream(spark, sf)).select("tie", "auc", "calib_err"))


HOURS = "h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1), n AS (SELECT v, row_number() OVER (ORDER BY hour) - 1 AS i FROM h), b AS (SELECT avg(v) AS m, CASE WHEN stddev_pop(v) > 1e-6 THEN stddev_pop(v) ELSE 0.02 END AS sd FROM n WHERE i < 60)"


@query(f"""WITH RECURSIVE {HOURS}, walk(i, s, on_alarm, hit) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), false, false UNION ALL
SELECT n.i, CASE WHEN (NOT on_alarm AND greatest(0, s + m - v - 0.5 * sd) > 1.5 * sd) OR (on_alarm AND v >= m - 0.5 * sd) THEN 0 ELSE greatest(0, s + m - v - 0.5 * sd) END,
CASE WHEN NOT on_alarm AND greatest(0, s + m - v - 0.5 * sd) > 1.5 * sd THEN true WHEN on_alarm AND v >= m - 0.5 * sd THEN false ELSE on_alarm END,
NOT on_alarm AND greatest(0, s + m - v - 0.5 * sd) > 1.5 * sd FROM walk JOIN n ON n.i = walk.i + 1 CROSS JOIN b)
SELECT CAST(i AS INTEGER) AS hit FROM walk WHERE hit""")
def cusum_alarms(spark, sf):
    hourly = V.stream(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("score").alias("v"))
    values = hourly.agg(F.transform(F.sort_array(F.collect_list(F.struct("hour", "v"))), lambda x: x["v"]).alias("series"))
    return values.select(F.explode(cusum_hits(F.col("series"), 0.5, 1.5, 60)).alias("hit"))


@query(f"""WITH scored AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'early' WHEN ts < TIMESTAMP '2024-01-21' THEN 'middle' ELSE 'late' END AS phase, value AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events),
{AUC.format(by='phase,', part='PARTITION BY phase')}, a AS (SELECT phase, sum(p * (b + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auc FROM below GROUP BY phase)
SELECT phase, count(*) AS n, {r('avg(CASE WHEN y = 1 THEN s END) - avg(CASE WHEN y = 0 THEN s END)', 'gap')}, {r('max(auc)', 'auc')} FROM scored JOIN a USING (phase) GROUP BY phase""")
def phase_table(spark, sf):
    ts = lambda x: F.lit(x).cast("timestamp")
    s = V.stream(spark, sf).withColumn("phase", F.when(F.col("ts") < ts("2024-01-11"), "early").when(F.col("ts") < ts("2024-01-21"), "middle").otherwise("late"))
    means = s.groupBy("phase").agg(F.count("*").alias("n"), (F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))).alias("gap"))
    return rounded(means.join(E.auc(s, "label", "score", "phase").select("phase", "auc"), "phase"))


@query(f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS m, CAST(count(*) AS DOUBLE) AS d FROM events GROUP BY 1),
p AS (SELECT unnest(['full', CASE WHEN hour < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END]) AS part, m, d FROM h),
k AS (SELECT part, rank() OVER (PARTITION BY part ORDER BY m) + (count(*) OVER (PARTITION BY part, m) - 1) / 2.0 AS x, rank() OVER (PARTITION BY part ORDER BY d) + (count(*) OVER (PARTITION BY part, d) - 1) / 2.0 AS y FROM p)
SELECT part, count(*) AS n, {r('CASE WHEN count(*) >= 8 THEN covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) END', '"corr"')} FROM k GROUP BY part""")
def attribution_split(spark, sf):
    hourly = V.stream(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("score").alias("m"), F.count("*").cast("double").alias("d"))
    return rounded(D.attribution_split(hourly, "m", "d", "hour", F.lit("2024-01-16").cast("timestamp")))


@query(f"""WITH pts AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / 1e5 AS v FROM orders GROUP BY 1), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
b AS (SELECT d.date, (SELECT max(date) FROM pts WHERE pts.date <= d.date) AS p, (SELECT min(date) FROM pts WHERE pts.date >= d.date) AS n FROM days d)
SELECT b.date, {r('coalesce(x.v + (y.v - x.v) * coalesce((b.date - p) / nullif(CAST(n - p AS DOUBLE), 0), 0), x.v, y.v)', 'value')} FROM b LEFT JOIN pts x ON x.date = p LEFT JOIN pts y ON y.date = n""", dates=('date',))
def time_interpolation(spark, sf):
    orders = V.read(spark, sf, "orders")
    points = orders.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg((F.avg("o_totalprice") / 1e5).alias("value"))
    return rounded(D.interpolate(points, orders.select(F.to_date("o_orderdate").alias("date")).distinct()))


@query("""WITH o AS (SELECT CAST(max(hour) AS DATE) AS last, CAST(min(hour) AS DATE) AS first FROM (SELECT date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1) WHERE v < (SELECT avg(value) FROM events))
SELECT CAST(DATE '2024-03-01' - first AS INTEGER) AS first_lead_days, CAST(DATE '2024-03-01' - last AS INTEGER) AS last_lead_days FROM o""")
def alarm_lead_days(spark, sf):
    s = V.stream(spark, sf)
    hourly = s.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("score").alias("v"))
    mean = s.agg(F.avg("score").alias("m"))
    low = hourly.join(F.broadcast(mean)).where("v < m").select(F.to_date("hour").alias("date"))
    return D.lead_days(low, "2024-03-01")
