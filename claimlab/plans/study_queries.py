"""Splits, point-in-time, options, robustness, diagnosis, linear algebra, prose and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlab.functions import expressions as X
from claimlab.functions.ordering import with_position
from claimlab.operators import diagnose as D
from claimlab.operators import features as L
from claimlab.operators import pointintime as T
from claimlab.operators import prose as W
from claimlab.operators import records as R
from claimlab.operators import robust as B
from claimlab.operators import splits as S

from . import views as V
from .registry import query, r, rounded

SPLIT = """split AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate <= TIMESTAMP '1998-12-31' THEN 'train' WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'holdout' WHEN o_orderdate <= TIMESTAMP '1999-12-31' THEN 'valid' END AS block FROM orders)"""


def _split(spark, sf):
    return S.time_splits(V.read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "1998-12-31", "1999-12-31", time_col="o_orderdate")


@query(f"WITH {SPLIT} SELECT block, count(*) AS n, min(o_orderkey) AS first_key FROM split GROUP BY block")
def time_splits(spark, sf):
    return _split(spark, sf).groupBy("block").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query(f"""WITH {SPLIT} SELECT count(*) FILTER (block = 'train') AS n_train, count(*) FILTER (block = 'valid') AS n_valid, count(*) FILTER (block = 'holdout') AS n_holdout,
coalesce(max(CASE WHEN block = 'train' THEN o_orderdate END) < min(CASE WHEN block = 'valid' THEN o_orderdate END) AND max(CASE WHEN block = 'valid' THEN o_orderdate END) < min(CASE WHEN block = 'holdout' THEN o_orderdate END), false) AS ordered FROM split""")
def leakage_check(spark, sf):
    return S.leakage(_split(spark, sf), "o_orderdate")


@query("""WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders)),
e AS (SELECT k, n, CAST(trunc(24 + (n - 24) * k / 4.0) AS BIGINT) AS lo, CAST(trunc(24 + (n - 24) * (k + 1) / 4.0) AS BIGINT) AS hi FROM range(4) x(k), (SELECT max(n) AS n FROM d))
SELECT CAST(k AS INTEGER) AS fold, CASE WHEN pos < lo THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS from_date, max(date) AS to_date FROM e JOIN d ON pos < hi GROUP BY 1, 2""", dates=('from_date', 'to_date'))
def walk_forward(spark, sf):
    dates = V.read(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("date")).distinct()
    numbered = dates.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    out = S.folds(numbered, dates.count(), 4, 24)
    return out.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("from_date"), F.max("date").alias("to_date"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def stream_positions(spark, sf):
    return with_position(V.read(spark, sf, "events").select("ts", "event_id"), "ts", "event_id").select("event_id", "pos")


LAST = """known AS (SELECT as_of, o_custkey AS entity, o_totalprice AS value, row_number() OVER (PARTITION BY as_of, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
FROM orders JOIN (SELECT unnest([TIMESTAMP '1998-06-30', TIMESTAMP '1999-06-30', TIMESTAMP '2000-06-30', TIMESTAMP '2001-06-30']) AS as_of) ON o_orderdate <= as_of), recent AS (SELECT * FROM known WHERE k <= 8)"""


def _last(spark, sf):
    dates = spark.range(4).select(F.to_timestamp(F.concat((F.col("id") + 1998).cast("string"), F.lit("-06-30"))).alias("as_of"))
    panel = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("disclosed"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return T.last_known(panel, dates, 8, "entity", "disclosed", ("disclosed", "o_orderkey"), "value")


@query(f"WITH {LAST} SELECT as_of, entity, count(value) >= 8 AND avg(CASE WHEN value >= 150000 THEN 1.0 ELSE 0.0 END) >= 0.6 AS sustained FROM recent GROUP BY 1, 2", dates=('as_of',))
def sustained_above(spark, sf):
    return T.sustained_above(_last(spark, sf), "value", 150_000.0, 8, 0.6, "as_of", "entity")


@query(f"WITH {LAST} SELECT as_of, entity, coalesce(count(value) >= 8 AND avg(value) > 0 AND stddev_pop(value) / nullif(avg(value), 0) <= 0.5, false) AS stable FROM recent GROUP BY 1, 2", dates=('as_of',))
def stable_series(spark, sf):
    return T.stable_series(_last(spark, sf), "value", 8, 0.5, "as_of", "entity")


@query(f"""WITH {LAST}, ok AS (SELECT as_of, entity FROM recent GROUP BY 1, 2 HAVING count(value) >= 8 AND avg(CASE WHEN value >= 150000 THEN 1.0 ELSE 0.0 END) >= 0.6 AND stddev_pop(value) / nullif(avg(value), 0) <= 0.5)
SELECT as_of, count(*) AS n, min(entity) AS first_entity, max(entity) AS last_entity FROM ok GROUP BY as_of""", dates=('as_of',))
def universe_asof(spark, sf):
    last = _last(spark, sf)
    both = T.sustained_above(last, "value", 150_000.0, 8, 0.6, "as_of", "entity").join(T.stable_series(last, "value", 8, 0.5, "as_of", "entity"), ["as_of", "entity"])
    return both.where("sustained and stable").groupBy("as_of").agg(F.count("*").alias("n"), F.min("entity").alias("first_entity"), F.max("entity").alias("last_entity"))


@query("SELECT o_custkey AS entity FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30' GROUP BY 1 HAVING count(*) >= 6 AND max(o_totalprice) < 400000")
def universe_by_screen(spark, sf):
    panel = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("disclosed"), F.col("o_totalprice").alias("value"))
    return T.screen_universe(panel, "1999-06-30", lambda rows: len(rows) >= 6 and rows["value"].max() < 400_000, "entity", "disclosed", "disclosed")


@query("""SELECT CAST(sum(CASE WHEN o_orderdate >= l_shipdate THEN 1 ELSE 0 END) AS BIGINT) AS signal_after_act, CAST(sum(CASE WHEN l_shipdate > TIMESTAMP '2001-06-30' THEN 1 ELSE 0 END) AS BIGINT) AS future_rows, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def audit_signal_timing(spark, sf):
    rows = V.read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return T.audit_rows(rows, "o_orderdate", "l_shipdate", "2001-06-30")


@query("""SELECT CAST(sum(CASE WHEN floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0) < 30 THEN 1 ELSE 0 END) AS BIGINT) AS too_early, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def audit_disclosure_lag(spark, sf):
    rows = V.read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return T.audit_disclosure_lag(rows, "o_orderdate", "l_shipdate", 30)


@query("""WITH t AS (SELECT l_suppkey AS s, date_trunc('month', l_shipdate) AS m FROM lineitem), u AS (SELECT DISTINCT l_suppkey AS s, date_trunc('month', l_shipdate) AS m FROM lineitem WHERE l_quantity >= 40)
SELECT count(*) AS violations FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.s = t.s AND u.m = t.m)""")
def audit_universe_membership(spark, sf):
    t = V.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.date_trunc("month", "l_shipdate").alias("m"), "l_quantity")
    return T.audit_membership(t, t.where("l_quantity >= 40"), ["s", "m"])


OPTION = "o AS (SELECT p_partkey AS id, p_retailprice AS s, p_retailprice * (0.8 + 0.01 * (p_partkey % 41)) AS k, (1 + p_size) / 52.0 AS t, 0.1 + 0.01 * (p_partkey % 50) AS v FROM part), d AS (SELECT *, (ln(s / k) + (0.02 + 0.5 * v * v) * t) / (v * sqrt(t)) AS d1 FROM o), e AS (SELECT *, d1 - v * sqrt(t) AS d2 FROM d)"
N1, N2 = X.norm_cdf_sql("d1"), X.norm_cdf_sql("d2")
CALL = f"(s * {N1} - k * exp(-0.02 * t) * {N2})"
M1, M2 = X.norm_cdf_sql("(-d1)"), X.norm_cdf_sql("(-d2)")


def _options(spark, sf):
    key = F.col("p_partkey")
    return V.read(spark, sf, "part").select(key.alias("id"), F.col("p_retailprice").alias("s"), (F.col("p_retailprice") * (0.8 + 0.01 * (key % 41))).alias("k"), ((1 + F.col("p_size")) / 52.0).alias("t"), (0.1 + 0.01 * (key % 50)).alias("v"))


@query(f"WITH {OPTION} SELECT id, {r(CALL, 'call_price')}, {r(f'(k * exp(-0.02 * t) * {M2} - s * {M1})', 'put_price')} FROM e")
def option_prices(spark, sf):
    s, k, t, v = map(F.col, "sktv")
    return rounded(_options(spark, sf).select("id", X.bs_price(s, k, t, 0.02, v).alias("call_price"), X.bs_price(s, k, t, 0.02, v, False).alias("put_price")))


PDF = "(exp(-d1 * d1 / 2) / 2.5066282746310002)"


@query(f"""WITH {OPTION} SELECT id, {r(N1, 'delta')}, {r(f'{PDF} / (s * v * sqrt(t))', 'gamma', 8)}, {r(f's * {PDF} * sqrt(t)', 'vega')}, {r(f'-s * {PDF} * v / (2 * sqrt(t)) - 0.02 * k * exp(-0.02 * t) * {N2}', 'theta')} FROM e""")
def option_greeks(spark, sf):
    s, k, t, v = map(F.col, "sktv")
    g = _options(spark, sf).withColumn("g", X.bs_greeks(s, k, t, 0.02, v))
    return g.select("id", *[(F.round(f"g.{c}", k) + 0.0).alias(c) for c, k in (("delta", 6), ("gamma", 8), ("vega", 6), ("theta", 6))])


NEAR = "t >= 0.25 AND abs(ln(s / k)) < 0.1"


@query(f"WITH {OPTION} SELECT id, {r(CALL, 'price', 3)}, {r(CALL, 'repriced', 3)}, {r(f'CASE WHEN {NEAR} THEN v END', 'iv', 4)} FROM e")
def implied_volatility(spark, sf):
    """All parts are inverted: the price at the volatility found is the price.  Deep in
    or out of the money many volatilities give one price, so the volatility itself is
    compared where there is one."""
    s, k, t, v = map(F.col, "sktv")
    priced = _options(spark, sf).withColumn("price", X.bs_price(s, k, t, 0.02, v))
    found = priced.withColumn("found", X.implied_vol(F.col("price"), s, k, t, 0.02))
    near = F.when((t >= 0.25) & (F.abs(F.log(s / k)) < 0.1), F.col("found"))
    return found.select("id", *[(F.round(x, places) + 0.0).alias(name) for name, x, places in (("price", F.col("price"), 3), ("repriced", X.bs_price(s, k, t, 0.02, F.col("found")), 3), ("iv", near, 4))])


@query()
def implied_volatility_all(spark, sf):
    """All parts with the volatility that was found, also where others give the price."""
    s, k, t, v = map(F.col, "sktv")
    priced = _options(spark, sf).withColumn("price", X.bs_price(s, k, t, 0.02, v))
    priced = priced.withColumn("iv", X.implied_vol(F.col("price"), s, k, t, 0.02))
    return rounded(priced.select("id", "price", "iv", X.bs_price(s, k, t, 0.02, F.col("iv")).alias("repriced")), 4)


@query(f"""WITH {OPTION}, k AS (SELECT id, s, s * exp((0.02 + 0.5 * v * v) * t + 0.2533471031357997 * v * sqrt(t)) AS strike FROM e) SELECT id, {r('CASE WHEN strike BETWEEN s / 20 AND s * 5 THEN strike END', 'strike', 4)} FROM k""")
def strike_from_delta(spark, sf):
    s, t, v = map(F.col, "stv")
    return rounded(_options(spark, sf).select("id", X.strike_from_delta(F.lit(0.4), s, t, 0.02, v).alias("strike")), 4)


@query(f"WITH {OPTION} SELECT id, 7 * (1 + id % 9) >= 14 AND {N1} BETWEEN 0.05 AND 0.90 AND v > 0.03 AND v < 2.0 AS trusted FROM e")
def iv_trust_filter(spark, sf):
    s, k, t, v = map(F.col, "sktv")
    g = _options(spark, sf).withColumn("delta", X.bs_greeks(s, k, t, 0.02, v)["delta"])
    return g.select("id", X.iv_is_trustworthy("v", 7 * (1 + F.col("id") % 9), "delta").alias("trusted"))


def _call_sql(s: str, t: str, v: str) -> str:
    """A call's price in SQL, its intrinsic value at expiry."""
    d1 = f"((ln({s} / k) + (0.02 + 0.5 * {v} * {v}) * {t}) / ({v} * sqrt({t})))"
    return f"CASE WHEN {t} <= 0 THEN greatest({s} - k, 0) ELSE {s} * {X.norm_cdf_sql(d1)} - k * exp(-0.02 * {t}) * {X.norm_cdf_sql(f'({d1} - {v} * sqrt({t}))')} END"


@query(f"""WITH {OPTION}, m AS (SELECT *, greatest(t - 0.1, 0) AS t1, s * 1.05 AS s1, v * 0.8 AS v1, {N1} * (s * 1.05 - s) AS delta, s * (exp(-d1 * d1 / 2) / 2.5066282746310002) * sqrt(t) * (v * 0.8 - v) AS vega, (-s * (exp(-d1 * d1 / 2) / 2.5066282746310002) * v / (2 * sqrt(t)) - 0.02 * k * exp(-0.02 * t) * {N2}) * 0.1 AS theta, {CALL} AS p0 FROM e),
p AS (SELECT *, {_call_sql('s1', 't1', 'v1')} AS p1 FROM m)
SELECT id, {r('p1 - p0', 'total')}, {r('delta', 'delta')}, {r('vega', 'vega')}, {r('theta', 'theta')}, {r('p1 - p0 - delta - vega - theta', 'residual')}, {r('p0', 'p0')}, {r('p1', 'p1')} FROM p""")
def option_pnl_attribution(spark, sf):
    s, k, t, v = map(F.col, "sktv")
    a = _options(spark, sf).withColumn("a", X.pnl_attribution(s, s * 1.05, v, v * 0.8, k, t, F.lit(0.1), 0.02))
    return rounded(a.select("id", "a.*"))


@query(f"SELECT p_partkey AS id, {r('least(greatest(0.05 * (1 + 1 * ((p_size / 50.0) / 0.30 - 1)), 0.025), 0.30)', 'spread')} FROM part")
def iv_scaled_spread(spark, sf):
    return rounded(V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.iv_scaled_spread(F.col("p_size") / 50.0).alias("spread")))


@query(f"""WITH u AS (SELECT p_partkey AS id, p_retailprice / 50 AS c, p_retailprice * 2 AS unit FROM part), n AS (SELECT *, CAST(round((10000.0 - 10000.0 % unit) / unit) AS BIGINT) AS n FROM u)
SELECT id, n, {r('n * unit', 'invested', 4)}, {r('CASE WHEN n > 0 THEN n * (c * 1.1 - c) * 100 ELSE 0 END', 'pnl', 4)}, {r('CASE WHEN n > 0 THEN n * (c * 1.1 - c) * 100 / (n * unit) END', 'ret', 4)} FROM n""")
def budget_positions(spark, sf):
    p = V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 50).alias("c")).withColumn("n", X.budget_units("c"))
    pnl = F.when(F.col("n") > 0, F.col("n") * (F.col("c") * 1.1 - F.col("c")) * 100).otherwise(0.0)
    invested = F.col("n") * F.col("c") * 100
    return rounded(p.select("id", "n", invested.alias("invested"), pnl.alias("pnl"), F.when(F.col("n") > 0, pnl / invested).alias("ret")), 4)


TRADES = "t AS (SELECT l_returnflag, p_brand, p_size, l_discount, p_retailprice AS s_in, l_extendedprice / nullif(l_quantity, 0) AS s_out, l_suppkey, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey), g AS (SELECT *, 10000 * (s_out / s_in - 1) AS stock, 10000 * (s_out / s_in - 1) * 0.5 - 200 * l_discount * 10 AS pnl FROM t)"


def _ledger(spark, sf):
    return V.trades(spark, sf).withColumn("dollar_pnl", 10000 * (F.col("s_out") / F.col("s_in") - 1) * 0.5 - 200 * F.col("l_discount") * 10)


@query(f"""WITH {TRADES} SELECT l_returnflag, count(*) AS n, {r('avg(stock)', 'stock_mean', 4)}, {r('quantile_cont(stock, 0.5)', 'stock_median', 4)}, {r('avg(pnl)', 'pnl_mean', 4)}, {r('quantile_cont(pnl, 0.5)', 'pnl_median', 4)},
{r('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)', 'win', 4)}, {r('avg(pnl) - avg(stock)', 'drag', 4)}, {r('avg(CASE WHEN stock > 0 THEN CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END END)', 'win_when_up', 4)} FROM g GROUP BY 1""")
def expression_vs_underlying(spark, sf):
    return rounded(D.expression_vs_underlying(_ledger(spark, sf), 10_000.0, "l_returnflag"), 4)


CLAIMS = "b AS (SELECT l_suppkey, l_shipdate >= TIMESTAMP '1999-01-01' AS hold, (l_extendedprice / 1e4 - 2.6) AS x FROM lineitem), c AS (SELECT l_suppkey AS id, avg(CASE WHEN NOT hold THEN x END) AS va, avg(CASE WHEN NOT hold THEN x END) / nullif(stddev_samp(CASE WHEN NOT hold THEN x END), 0) * sqrt(count(CASE WHEN NOT hold THEN x END)) AS vt, avg(CASE WHEN hold THEN x END) AS ha, avg(CASE WHEN hold THEN x END) / nullif(stddev_samp(CASE WHEN hold THEN x END), 0) * sqrt(count(CASE WHEN hold THEN x END)) AS ht FROM b GROUP BY 1)"


@query(f"""WITH {CLAIMS} SELECT id, sign(va) <> sign(ha) AS sign_flip, {r('ha - va', 'alpha_decay')}, CASE WHEN vt > 2 AND ht > 2 THEN '{D.SURVIVED}' WHEN vt > 2 AND sign(va) <> sign(ha) THEN '{D.CAUGHT}' WHEN vt > 2 THEN '{D.NOT_REPLICATED}' WHEN ht > 2 THEN '{D.UNCLAIMED}' ELSE '{D.NO_CLAIM}' END AS outcome FROM c""")
def false_positive_outcomes(spark, sf):
    x = V.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")).alias("hold"), (F.col("l_extendedprice") / 1e4 - 2.6).alias("x"))
    v, h = F.when(~F.col("hold"), F.col("x")), F.when(F.col("hold"), F.col("x"))
    t = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * F.sqrt(F.count(c))
    claims = x.groupBy("id").agg(F.avg(v).alias("valid_alpha"), t(v).alias("valid_t"), F.avg(h).alias("hold_alpha"), t(h).alias("hold_t"))
    return rounded(D.false_positive(claims).select("id", "sign_flip", "alpha_decay", "outcome"))


MEMBERS = "base AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity >= 49 AND l_discount <= 0.02), variant AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity >= 48 AND l_discount <= 0.01)"


def _members(spark, sf):
    lines = V.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity", "l_discount")
    return lines.where("l_quantity >= 49 and l_discount <= 0.02").select("k"), lines.where("l_quantity >= 48 and l_discount <= 0.01").select("k")


@query(f"""WITH {MEMBERS}, f AS (SELECT base.k AS b, variant.k AS v FROM base FULL JOIN variant ON base.k = variant.k)
SELECT count(b) AS n_base, count(v) AS n_variant, count(*) FILTER (b IS NULL) AS n_added, count(*) FILTER (v IS NULL) AS n_dropped, {r('coalesce(count(*) FILTER (b IS NOT NULL AND v IS NOT NULL) / nullif(CAST(count(*) AS DOUBLE), 0), 1)', 'jaccard')} FROM f""")
def membership_stability(spark, sf):
    return rounded(B.membership_stability(*_members(spark, sf), "k"))


@query(f"WITH {MEMBERS} SELECT k FROM variant WHERE k NOT IN (SELECT k FROM base)")
def untested_additions(spark, sf):
    base, variant = _members(spark, sf)
    return B.untested_additions(variant, base, "k")


@query(f"""WITH {TRADES}, c AS (SELECT CASE WHEN grouping(p_brand) = 1 THEN 'base' ELSE p_brand END AS label, avg(pnl) AS mean_pnl, quantile_cont(pnl, 0.5) AS median_pnl FROM g GROUP BY GROUPING SETS ((), (p_brand))), b AS (SELECT mean_pnl AS m, median_pnl AS d FROM c WHERE label = 'base')
SELECT label, {r('mean_pnl', 'mean_pnl', 4)}, {r('median_pnl', 'median_pnl', 4)}, sign(mean_pnl) = sign(m) AS mean_pnl_sign_agrees, sign(median_pnl) = sign(d) AS median_pnl_sign_agrees, sign(mean_pnl) = sign(m) AND sign(median_pnl) = sign(d) AS all_agree FROM c CROSS JOIN b""")
def conclusion_stability(spark, sf):
    per = B.label_statistics(_ledger(spark, sf), "p_brand", "dollar_pnl", "base").select("label", F.col("mean").alias("mean_pnl"), F.col("median").alias("median_pnl"))
    return rounded(B.conclusion_stability(per, ["mean_pnl", "median_pnl"], "base"), 4)


GRID = f"{TRADES}, cells AS (SELECT p_brand || '/' || p_size AS cell, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE 'vol' END AS gate, p_size % 5 AS width, count(*) AS n_trades, avg(pnl) AS expectancy, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win, avg(pnl) / nullif(stddev_samp(pnl), 0) AS sharpe FROM g GROUP BY p_brand, p_size)"


def _grid(spark, sf):
    pnl = F.col("dollar_pnl")
    return _ledger(spark, sf).groupBy("p_brand", "p_size").agg(F.count("*").alias("n_trades"), F.avg(pnl).alias("expectancy"), F.avg((pnl > 0).cast("double")).alias("win"), (F.avg(pnl) / F.nullif(F.stddev_samp(pnl), F.lit(0.0))).alias("sharpe")).select(
        F.concat_ws("/", "p_brand", "p_size").alias("cell"), F.when(F.col("p_size") % 3 == 0, "none").otherwise("vol").alias("gate"), (F.col("p_size") % 5).alias("width"), "n_trades", "expectancy", "win", "sharpe")


@query(f"WITH {GRID}, k AS (SELECT cell, n_trades, sharpe, row_number() OVER (ORDER BY sharpe DESC, cell) AS rank FROM cells WHERE gate = 'none' AND n_trades >= 10 AND expectancy > 0) SELECT cell, n_trades, {r('sharpe', 'sharpe')}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def registered_rule(spark, sf):
    return rounded(B.registered_rule(_grid(spark, sf), 10, "sharpe", 5).select("cell", "n_trades", "sharpe", "rank"))


@query(f"""WITH {GRID} SELECT {r('corr(win, expectancy)', 'pearson')}, CAST(sum(CASE WHEN win >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_high, {r('avg(CASE WHEN win >= 0.5 THEN CASE WHEN expectancy < 0 THEN 1.0 ELSE 0.0 END END)', 'share_losing')},
(SELECT cell FROM cells ORDER BY win DESC, expectancy DESC, cell DESC LIMIT 1) AS highest_win_cell FROM cells""")
def winrate_vs_profit(spark, sf):
    return rounded(B.winrate_vs_profit(_grid(spark, sf), 0.5))


@query(f"WITH {GRID} SELECT width, count(*) AS n, {r('avg(n_trades)', 'mean_trades')} FROM cells GROUP BY width HAVING avg(n_trades) >= 1")
def feasibility_by_width(spark, sf):
    return rounded(_grid(spark, sf).groupBy("width").agg(F.count("*").alias("n"), F.avg("n_trades").alias("mean_trades")).where("mean_trades >= 1"))


@query(f"WITH {GRID} SELECT gate, {', '.join(r(f'avg(CASE WHEN width = {k} THEN sharpe END)', f'w{k}') for k in range(5))} FROM cells GROUP BY gate")
def pivot_sharpe(spark, sf):
    return rounded(_grid(spark, sf).groupBy("gate").pivot("width", list(range(5))).agg(F.avg("sharpe")).toDF("gate", *[f"w{k}" for k in range(5)]))


@query(f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, {r('a * 0.1 + b', 'score')} FROM (SELECT unnest([1, 2, 3]) AS a) CROSS JOIN (SELECT unnest([10, 20]) AS b)")
def parameter_sweep(spark, sf):
    return rounded(B.sweep(spark, {"a": [1, 2, 3], "b": [10, 20]}, lambda a, b: {"score": a * 0.1 + b}, "a long, b long, score double"))


@query(f"""WITH {TRADES} SELECT count(*) AS n, CAST(sum(CASE WHEN abs(pnl - (10000 * (s_out / s_in - 1) * 0.5 - 2000 * l_discount)) > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM g""")
def accounting_audit(spark, sf):
    again = 10000 * (F.col("s_out") / F.col("s_in") - 1) * 0.5 - 2000 * F.col("l_discount")
    return _ledger(spark, sf).agg(F.count("*").alias("n"), F.sum(F.when(F.abs(F.col("dollar_pnl") - again) > 0.01, 1).otherwise(0)).alias("mismatches"))


@query(f"WITH {TRADES} SELECT p_brand, l_returnflag, count(*) AS n, {r('avg(pnl)', 'mean', 4)}, {r('quantile_cont(pnl, 0.5)', 'median', 4)}, {r('avg(CASE WHEN pnl < 0 THEN 1.0 ELSE 0.0 END)', 'share_negative', 4)} FROM g GROUP BY 1, 2")
def depth_by_strike(spark, sf):
    pnl = F.col("dollar_pnl")
    return rounded(_ledger(spark, sf).groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"), F.avg(pnl).alias("mean"), F.percentile(pnl, F.lit(0.5)).alias("median"), F.avg((pnl < 0).cast("double")).alias("share_negative")), 4)


def _vectors(spark, sf):
    return V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.slice("embedding", 1, F.size("embedding") - 1).cast("array<double>").alias("x"), F.element_at("embedding", -1).cast("double").alias("y"), "label")


@query()
def random_fourier_features(spark, sf):
    return L.rff(_vectors(spark, sf), "x", 16, key="pos").select("pos", F.transform("features", lambda v: F.round(v, 6)).alias("features"))


@query()
def rolling_ridge_forecasts(spark, sf):
    return rounded(L.rolling_forecasts(_vectors(spark, sf), "x", "y", 24, [0.0, 0.1, 1.0]))


@query()
def kernel_forecasts(spark, sf):
    v = _vectors(spark, sf)
    return rounded(L.apply_weights(L.kernel_weights(v, "x", 12), v))


NUMBERS = r"n AS (SELECT doc_id, generate_subscripts(m, 1) - 1 AS place, unnest(m) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '-?\d[\d,]*\.?\d*') AS m FROM documents))"


@query(f"WITH {NUMBERS}, c AS (SELECT *, replace(raw, ',', '') AS clean FROM n) SELECT doc_id, CAST(place AS INTEGER) AS place, raw, CAST(clean AS DOUBLE) AS value, CAST(CASE WHEN contains(clean, '.') THEN length(clean) - strpos(clean, '.') ELSE 0 END AS INTEGER) AS decimals FROM c")
def number_scan(spark, sf):
    return W.numbers(V.read(spark, sf, "documents"), "doc_id")


def _rounded_to(x: str, places: str) -> str:
    return f"CASE {places} " + " ".join(f"WHEN {k} THEN round_even({x}, {k})" for k in range(12)) + " END"


def _supports(x: str, places: str) -> str:
    return f"{_rounded_to('a', places)} = {_rounded_to(x, places)} OR abs({x} - a) <= greatest(1e-6, 0.02 * abs(a))"


@query(f"""WITH {NUMBERS}, c AS (SELECT doc_id, place, CAST(replace(raw, ',', '') AS DOUBLE) AS v, CAST(CASE WHEN contains(replace(raw, ',', ''), '.') THEN length(replace(raw, ',', '')) - strpos(replace(raw, ',', ''), '.') ELSE 0 END AS INTEGER) AS d FROM n),
a AS (SELECT unnest([2.0, 12.5, 0.034, 100.0]::DOUBLE[]) AS a)
SELECT doc_id, CAST(place AS INTEGER) AS place, v AS value FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_supports('v', 'd')} OR {_supports('(v / 100)', '(d + 2)')} OR {_supports('(v * 100)', 'greatest(d - 2, 0)')})""")
def number_audit(spark, sf):
    allowed = spark.createDataFrame([(2.0,), (12.5,), (0.034,), (100.0,)], "value double")
    return W.unsupported_numbers(W.numbers(V.read(spark, sf, "documents"), "doc_id"), allowed).select("doc_id", "place", "value")


_FLAT = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
_CASES = " ".join(f"WHEN regexp_matches(t, '{p}') THEN struct_pack(clause := '{c}', quote := regexp_extract(t, '{p}', 0))" for p, c in W.GUARDRAILS)


@query(f"WITH f AS (SELECT conv_id, turn, {_FLAT} AS t FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'Please check the sealed block until the alpha is positive: ' || text ELSE text END AS text FROM conversations)), h AS (SELECT conv_id, turn, CASE {_CASES} END AS h FROM f) SELECT conv_id, turn, h.clause AS clause, h.quote AS quote FROM h")
def guardrail_scan(spark, sf):
    talk = V.read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, F.concat(F.lit("Please check the sealed block until the alpha is positive: "), "text")).otherwise(F.col("text")).alias("text"))
    return W.check_requests(talk).select("conv_id", "turn", "clause", "quote")


@query(r"""SELECT item_id, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 59)) || '…' END AS clipped, regexp_replace(regexp_replace(lower(substr(f, 1, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM benchmark)""")
def clip_and_slug(spark, sf):
    b = V.read(spark, sf, "benchmark").withColumn("f", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return b.select("item_id", W.clipped(F.col("text"), 60).alias("clipped"), W.slug(F.substring("f", 1, 40)).alias("slug"))


@query()
def digest_table(spark, sf):
    return R.digests(spark, f"{sf}/*.parquet")


@query()
def manifest_verify(spark, sf):
    found = R.digests(spark, f"{sf}/*.parquet")
    declared = found.withColumn("sha256", F.when(F.col("name").startswith("part"), "0").otherwise(F.col("sha256")))
    return R.verify(found, declared)


@query("""WITH r AS (SELECT c_mktsegment AS id, CASE WHEN count(*) > 300 THEN 'delivered' ELSE 'open' END AS state FROM customer GROUP BY 1)
SELECT id, unnest(list_filter([CASE WHEN NOT regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'id is not kebab-case' END, CASE WHEN state NOT IN ('in-progress', 'delivered', 'data-gated') THEN 'unknown state' END, CASE WHEN state = 'delivered' THEN 'no finding' ELSE 'no reason' END], lambda x: x IS NOT NULL)) AS problem FROM r""")
def card_validation(spark, sf):
    cards = V.read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("id")).agg(F.when(F.count("*") > 300, "delivered").otherwise("open").alias("state"))
    return R.validate_cards(cards.select("id", "state", F.col("id").alias("title"), F.lit(None).cast("string").alias("finding"), F.lit(None).cast("string").alias("why_not_adjudicated")), ("in-progress", "delivered", "data-gated"), "delivered")
