"""Closed forms, planted effects, negative cases and independence of partitioning."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimlab.functions import expressions as X
from claimlab.functions.ordering import densify, with_position
from claimlab.operators import bootstrap as B
from claimlab.operators import costs as C
from claimlab.operators import diagnose as D
from claimlab.operators import evaluate as E
from claimlab.operators import features as L
from claimlab.operators import panel as P
from claimlab.operators import pointintime as T
from claimlab.operators import prose as W
from claimlab.operators import records as R
from claimlab.operators import robust as K
from claimlab.operators import splits as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def series(spark, values, parts=3):
    rows = [(k, float(v) if v is not None else None) for k, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "date long, ret double").repartition(parts)


def test_normal_distribution(spark):
    xs = [x / 4 for x in range(-160, 161)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.norm_cdf(F.col("x")).alias("p"), F.expr(X.norm_cdf_sql("x")).alias("q")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=2e-15) and r["p"] == r["q"]


def test_options(spark):
    s, k, t, v = (F.lit(x) for x in (100.0, 95.0, 0.5, 0.35))
    call, put = X.bs_price(s, k, t, 0.02, v), X.bs_price(s, k, t, 0.02, v, False)
    r = one(spark, (call - put).alias("gap"), X.implied_vol(call, s, k, t, 0.02).alias("iv"), X.implied_vol(F.lit(1.0), s, k, t, 0.02).alias("none"),
            X.bs_price(s, k, F.lit(0.0), 0.02, v).alias("expired"), X.pnl_attribution(s, s * 1.02, v, v, k, t, F.lit(0.02), 0.02).alias("a"), X.bs_greeks(s, k, t, 0.02, v)["vega"].alias("vega"))
    assert r["gap"] == pytest.approx(100 - 95 * math.exp(-0.01)) and r["iv"] == pytest.approx(0.35) and r["none"] is None and r["expired"] == 5.0
    a = r["a"]
    assert a["total"] == pytest.approx(a["delta"] + a["vega"] + a["theta"] + a["residual"]) and a["vega"] == 0 and abs(a["residual"]) < 0.2


def test_small_expressions(spark):
    r = one(spark, X.floor_div(F.lit(1.0), F.lit(0.1)).alias("fd"), X.budget_units(F.lit(5.0)).alias("n"), X.budget_units(F.lit(0.0)).alias("zero"), X.breakeven_bps(F.lit(0.01), F.lit(1.0)).alias("be"),
            X.breakeven_bps(F.lit(0.01), F.lit(0.0)).alias("inf"), X.breakeven_bps(F.lit(-0.01), F.lit(0.0)).alias("nan"), X.clip(F.lit(None).cast("double"), -1, 1).alias("clip"),
            X.iv_scaled_spread(F.lit(0.30)).alias("s1"), X.iv_scaled_spread(F.lit(0.60)).alias("s2"), X.iv_scaled_spread(F.lit(9.0)).alias("s3"), X.net_return(F.lit(0.01), F.lit(0.5), F.lit(10.0)).alias("net"))
    assert (r["fd"], r["n"], r["zero"], r["be"], r["inf"], r["nan"], r["clip"]) == (9.0, 20, 0, 50.0, math.inf, None, None)
    assert (r["s1"], r["s2"], r["s3"], r["net"]) == (pytest.approx(0.05), pytest.approx(0.10), 0.30, pytest.approx(0.009))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sharpe_hac_and_bootstrap_do_not_depend_on_partitions(spark, parts):
    values = np.random.default_rng(0).normal(0.01, 0.04, 60)
    s = series(spark, values, parts)
    stats = E.sharpe(s).first()
    assert stats["sharpe"] == pytest.approx(values.mean() / values.std(ddof=1) * math.sqrt(12))
    u = values - values.mean()
    var = u @ u / 60 + sum(2 * (1 - k / 4) * (u[k:] @ u[:-k]) / 60 for k in (1, 2, 3))
    assert E.hac_t(s, "ret").first()["t"] == pytest.approx(values.mean() / math.sqrt(var / 60))
    rng, draws = np.random.default_rng(5), []
    for _ in range(50):
        starts = rng.integers(0, 55, size=10)
        draws.append(np.concatenate([values[a : a + 6] for a in starts])[:60].mean())
    got = B.mean_ci(s, n_boot=50, block=6, seed=5, generator="numpy").first()
    assert [got["lo"], got["hi"]] == pytest.approx(list(np.percentile(draws, [2.5, 97.5])))
    assert B.sharpe_ci(series(spark, values[:11]), n_boot=5).first()["lo"] is None


def test_undefined_statistics(spark):
    assert E.sharpe(series(spark, [0.1])).first()["sharpe"] is None and E.sharpe(series(spark, [0.1, 0.1, 0.1])).first()["sharpe"] is None
    assert E.hac_t(series(spark, [1.0, 2.0]), "ret").first()["t"] is None
    with pytest.raises(ValueError):
        E.spanning(series(spark, [1.0, 2.0]).withColumn("x", F.col("ret")), "ret", ["x"])


def test_auc(spark):
    def of(pairs):
        return E.auc(spark.createDataFrame(pairs, "y int, s double"), "y", "s").first()["auc"]

    assert of([(0, 1.0), (1, 2.0)]) == 1 and of([(1, 1.0), (0, 2.0)]) == 0 and of([(1, 1.0), (0, 1.0)]) == 0.5 and of([(1, 1.0), (1, 2.0), (0, None)]) is None


def test_spanning_recovers_coefficients(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = 0.3 + 1.5 * a - 0.7 * b + rng.normal(0, 0.1, 300)
    got = {r["term"]: r for r in E.spanning(spark.createDataFrame(pd.DataFrame({"date": range(300), "y": y, "a": a, "b": b})), "y", ["a", "b"]).collect()}
    x = np.column_stack([np.ones(300), a, b])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert [got[t]["coefficient"] for t in ("const", "a", "b")] == pytest.approx(list(beta)) and got["a"]["t"] > 50 and got["const"]["r2"] > 0.99


def test_costs(spark):
    book = lambda rows: spark.createDataFrame(rows, "name string, w double")
    a, flip = book([("x", 1.0), ("y", -1.0)]), book([("x", -1.0), ("y", 1.0)])
    assert C.turnover(a, a).first()[0] == 0 and C.turnover(a, flip).first()[0] == 2.0 and C.turnover(book([]), book([("x", 1.0)])).first()[0] == 0.5
    curve = spark.createDataFrame([(0.0, 4.0), (0.1, 1.0), (0.2, -1.0), (0.3, 5.0), (0.4, -5.0)], "level double, e double")
    assert C.breakeven_friction(curve, "level", "e").first()["breakeven"] == pytest.approx(0.15)
    gross = series(spark, [0.01, 0.02, -0.01, 0.03]).withColumn("turnover", F.lit(0.5))
    means = [r["mean_per_period"] for r in C.cost_sensitivity(gross).orderBy("cost_bps").collect()]
    assert means == sorted(means, reverse=True)
    with pytest.raises(ValueError):
        C.cost_sensitivity(gross, (-1,))


def test_panel_on_a_grid_with_gaps(spark):
    closes = pd.DataFrame({"a": [1.0, 2.0, 4.0, 8.0], "b": [5.0, np.nan, 5.0, 10.0]})
    rows = [(d, m, float(closes[m][d])) for d in range(4) for m in "ab" if not np.isnan(closes[m][d])]
    p = P.market_returns(densify(spark.createDataFrame(rows, "date long, market string, close double")))
    got = {(r["date"], r["market"]): r["ret"] for r in p.collect()}
    assert got[1, "a"] == 1.0 and got[2, "b"] is None and got[3, "b"] == 1.0 and len(got) == 8
    flat = p.withColumn("position", F.lit(1.0))
    assert {r["date"]: r["ret"] for r in P.portfolio_returns(flat).collect()} == {1: 1.0, 2: 1.0, 3: 1.0}
    lots = P.integer_contracts(flat, 10.0).where("date = 0 and market = 'b'").first()["contracts"]
    assert lots == 1.0
    with pytest.raises(ValueError):
        P.integer_contracts(flat, 0.0)


def test_splits(spark):
    days = spark.sql("SELECT explode(sequence(timestamp'2000-01-01', timestamp'2014-12-01', interval 1 month)) AS ts")
    split = S.time_splits(days, "2006-12-31", "2009-12-31")
    sizes = S.leakage(split).first()
    assert (sizes["n_train"], sizes["n_valid"], sizes["n_holdout"], sizes["ordered"]) == (84, 36, 60, True)
    with pytest.raises(ValueError):
        S.time_splits(days, "2010-01-01", "2009-12-31")
    folds = S.walk_forward(120, 4, 60)
    assert [f[3:] for f in folds] == [(60, 75), (75, 90), (90, 105), (105, 120)] and all(f[2] == f[3] for f in folds)
    with pytest.raises(ValueError):
        S.walk_forward(10, 2, 10)


def test_point_in_time(spark):
    rows = [("EARLY", f"20{y:02d}-03-01", 0.2) for y in range(5, 14)] + [("LATE", f"20{y:02d}-03-01", 0.2) for y in range(9, 18)] + [("LOW", f"20{y:02d}-03-01", 0.01) for y in range(5, 14)]
    panel = spark.createDataFrame(rows, "entity string, disclosed string, value double").withColumn("disclosed", F.to_timestamp("disclosed"))
    asof = spark.sql("SELECT timestamp'2013-06-30' AS as_of")
    last = T.last_known(panel, asof, 8, "entity", "disclosed", ("disclosed",), "value")
    got = {r["entity"]: r["sustained"] for r in T.sustained_above(last, "value", 0.15, 8, 0.7, "entity").collect()}
    assert got == {"EARLY": True, "LATE": False, "LOW": False}
    assert {r[0] for r in T.screen_universe(panel, "2013-06-30", lambda d: len(d) > 8, "entity", "disclosed", "disclosed").collect()} == {"EARLY", "LOW"}


def test_robustness(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    got = K.membership_stability(ids("a", "b"), ids("b", "c"), "k").first()
    assert (got["n_added"], got["n_dropped"], got["jaccard"]) == (1, 1, pytest.approx(1 / 3))
    assert K.membership_stability(ids(), ids(), "k").first()["jaccard"] == 1.0
    results = spark.createDataFrame([("base", 1.0), ("x", 2.0), ("y", -1.0), ("z", None)], "label string, m double")
    assert {r["label"]: r["all_agree"] for r in K.conclusion_stability(results, ["m"], "base").collect()} == {"base": True, "x": True, "y": False, "z": False}
    with pytest.raises(Exception, match="expected one base row"):
        K.conclusion_stability(results, ["m"], "none").collect()
    assert K.sweep(spark, {"a": [1, 2, 3], "b": [1, 2]}, lambda a, b: {"c": a * b}, "a long, b long, c long").count() == 6


def test_false_positive(spark):
    claims = spark.createDataFrame([(0.0068, 2.41, -0.0029, -0.62), (0.01, 3.0, 0.01, 2.5), (0.01, 3.0, 0.001, 0.2), (0.0, 0.1, 0.01, 2.5), (0.0, 0.1, 0.0, 0.1)], "valid_alpha double, valid_t double, hold_alpha double, hold_t double")
    assert [r["outcome"] for r in D.false_positive(claims).collect()] == [D.CAUGHT, D.SURVIVED, D.NOT_REPLICATED, D.UNCLAIMED, D.NO_CLAIM]


def drifting(n=600, turn=300, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = rng.normal(size=n) + np.where(np.arange(n) < turn, 1.5 * y, 0)
    return [(k, f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00", float(a), int(b)) for k, (a, b) in enumerate(zip(s, y, strict=True))]


@pytest.mark.parametrize("chunk", [60, 2_000])
def test_rolling_windows(spark, chunk):
    data = drifting()
    frame = spark.createDataFrame(data, "event_id long, ts string, score double, label int").withColumn("ts", F.to_timestamp("ts")).repartition(5)
    got = {r["pos"]: r for r in D.rolling_windows(frame, window=60, chunk=chunk).collect()}
    s, y = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    assert len(got) > 500
    for k in (59, 100, 333, 599):
        a, b = s[k - 59 : k + 1], y[k - 59 : k + 1]
        want = np.mean([(p > q) + (p == q) / 2 for p in a[b == 1] for q in a[b == 0]])
        assert got[k]["auc"] == pytest.approx(want) and got[k]["calib_err"] == pytest.approx(abs(a.mean() - b.mean()))
    aucs = [got[k]["auc"] for k in sorted(got)]
    hits = spark.createDataFrame([(aucs,)], "series array<double>").select(X.cusum_hits(F.col("series")).alias("h")).first()["h"]
    assert hits and any(h > 200 for h in hits)


def test_cusum_against_a_loop(spark):
    v = list(np.random.default_rng(2).normal(0, 1, 300))
    base, sd = np.mean(v[:60]), np.std(v[:60])
    s, on, want = 0.0, False, []
    for i, x in enumerate(v):
        s = max(0.0, s + base - x - 0.5 * sd)
        if not on and s > 2 * sd:
            want.append(i)
            on, s = True, 0.0
        elif on and x >= base - 0.5 * sd:
            on, s = False, 0.0
    got = spark.createDataFrame([([float(x) for x in v],), ([None],), ([],)], "series array<double>").select(X.cusum_hits(F.col("series"), 0.5, 2.0).alias("h")).collect()
    assert got[0]["h"] == want and want and got[1]["h"] == [] and got[2]["h"] == []


def test_positions_are_global(spark):
    rows = [(k, f"2024-01-01 00:00:{k % 50:02d}") for k in range(400)]
    frame = spark.createDataFrame(rows, "event_id long, ts string").withColumn("ts", F.to_timestamp("ts")).repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r["event_id"]: r["pos"] for r in with_position(frame, "ts", "event_id", buckets=8).collect()} == {r[0]: k for k, r in enumerate(order)}


def test_linear_algebra(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=30)
    path = L.ridge_path(x, y, [0.0, 0.5])
    assert path[0] == pytest.approx(np.linalg.pinv(x) @ y) and path[1] == pytest.approx(np.linalg.solve(x.T @ x + 15 * np.eye(4), x.T @ y))
    wide = L.rff_matrix(x, 20_000, 0.7)
    gram = np.exp(-0.49 / 2 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(wide @ wide.T / 10_000 - gram).max() < 0.06
    with pytest.raises(ValueError):
        L.rff_matrix(x, 3)
    frame = spark.createDataFrame(pd.DataFrame({"pos": range(30), "x": x.tolist(), "y": y}))
    got = {(r["pos"], r["z"]): r["forecast"] for r in L.rolling_forecasts(frame, "x", "y", 10, [0.5], chunk=10).collect()}
    assert set(got) == {(k, 0.5) for k in range(10, 30)} and got[25, 0.5] == pytest.approx(x[25] @ L.ridge_path(x[15:25], y[15:25], [0.5])[0])
    weights = L.kernel_weights(frame, "x", 8, chunk=8)
    forecast = {r["pos"]: r["forecast"] for r in L.apply_weights(weights, frame).collect()}
    assert len(forecast) == 22 and weights.where("pos = 20").first()["weights"] @ y[12:20] == pytest.approx(forecast[20])


def test_kernel_weights_of_a_short_series(spark):
    """No row has a whole window before it: no weights, and no failure."""
    frame = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(8)], "pos long, x array<double>")
    assert L.kernel_weights(frame, "x", 8).count() == 0
    assert [r["pos"] for r in L.kernel_weights(frame, "x", 7, chunk=7).collect()] == [7]


def test_planted_worlds(spark):
    rows = L.planted_linear(spark, 400, seed=3).toPandas()
    x, y = np.stack(rows["x"]), rows["y"].to_numpy()
    assert np.corrcoef(x @ np.linalg.lstsq(x, y, rcond=None)[0], y)[0, 1] > 0.2
    hidden = L.planted_nonlinear(spark, 400, seed=3).toPandas()
    line = np.stack(hidden["x"])[:, 0]
    assert abs(np.corrcoef(line, hidden["y"])[0, 1]) < 0.15 < np.corrcoef(np.cos(2 * line), hidden["y"])[0, 1]
    again = L.wild_bootstrap(x, 1)
    assert again.shape == x.shape and (again[0] == x[0]).all()


def test_prose(spark):
    texts = spark.createDataFrame([(1, "Sharpe 0.43, 43% and 1,250 trades, -3."), (2, None)], "id long, text string")
    assert [(r["value"], r["decimals"]) for r in W.numbers(texts, "id").orderBy("place").collect()] == [(0.43, 2), (43.0, 0), (1250.0, 0), (-3.0, 0)]
    allowed = spark.createDataFrame([(0.4312,), (1250.0,)], "value double")
    assert [r["value"] for r in W.unsupported_numbers(W.numbers(texts, "id"), allowed).collect()] == [-3.0]
    asks = spark.createDataFrame([("please tune the window until it works",), ("tune the window",), ("peek at the  SEALED block",)], "text string")
    assert [r["clause"] for r in W.check_requests(asks).collect()] == ["parameters are fixed in advance", None, "a sealed block opens once"]
    lines = spark.createDataFrame([(1, 0, "costs and turnover"), (1, 1, "costs again")], "id long, line_no int, line string")
    assert W.score_checklist(lines, [("a", ["cost"]), ("b", ["turnover"]), ("c", ["COSTS"])], "id").first()["covered"] == ["a", "c"]


def test_ledger(spark, tmp_path):
    ledger = R.SealedHoldout(tmp_path / "ledger.json", "block")
    assert ledger.is_sealed() and ledger.unseal("final", {"a": 1})["kind"] == "first-unseal" and ledger.unseal("again", {"a": 1})["kind"] == "reproduction"
    with pytest.raises(R.HoldoutAlreadyUnsealed):
        ledger.unseal("again", {"a": 2})
    (tmp_path / "x.txt").write_text("one")
    found = R.digests(spark, f"file://{tmp_path}/*.txt")
    assert R.verify(found, found).count() == 0 and R.verify(found, found.withColumn("sha256", F.lit("0"))).first()["problem"] == "changed"
    with pytest.raises(ValueError):
        R.EvidenceReport("t", "c", "v", {"n": 1.0}).markdown()


def test_sources(spark, tmp_path):
    from claimlab.sources import readers

    (tmp_path / "panel.csv").write_text("# made\ndate,CL_close,CL_v60,GC_close\n2020-01-31,50,0.2,1500\n2020-02-29,45,,1600\n")
    long = readers.read_panel_csv(spark, f"file://{tmp_path}/panel.csv", "2020-02-01")
    assert sorted((r["market"], r["close"], r["v60"]) for r in long.collect()) == [("CL", 50.0, 0.2), ("GC", 1500.0, None)]
    (tmp_path / "r.csv").write_text("date,return,mkt\n" + "\n".join(f"2020-{m:02d}-01,0.01,0.02" for m in range(1, 13)))
    assert readers.read_returns_csv(spark, f"file://{tmp_path}/r.csv").count() == 12
    (tmp_path / "bad.csv").write_text("date,return\n2020-01-01,x\n")
    with pytest.raises(ValueError, match="bad_return: 1"):
        readers.read_returns_csv(spark, f"file://{tmp_path}/bad.csv")
    import base64
    import gzip
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", "head\n,Mkt\n20200102, 1.5\n20200103,-2\n\nfoot\n20990101,9\n")
    assert [(str(r["date"]), r["Mkt"]) for r in readers.read_zipped_table(spark, f"file://{tmp_path}/d.zip", ["Mkt"]).collect()] == [("2020-01-02", 0.015), ("2020-01-03", -0.02)]
    blob = spark.createDataFrame([(base64.b64encode(gzip.compress(b"hello")).decode(), hashlib.md5(b"hello").hexdigest())], "b string, m string")
    assert readers.decode_blob(blob, "b", "m").first()["text"] == "hello"


def test_streaming_equals_batch(spark, tmp_path):
    from claimlab.streaming import drift

    schema = "event_id long, ts timestamp, score double, label int, key string"
    rows = spark.createDataFrame(drifting(200, 100), "event_id long, ts string, score double, label int").withColumn("ts", F.to_timestamp("ts")).withColumn("key", F.lit("k"))
    rows.select("event_id", "ts", "score", "label", "key").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = drift.rolling_auc_stream(stream, "key", 60).writeStream.format("memory").queryName("aucs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination()
    batch = {r["tie"]: r["auc"] for r in D.rolling_windows(rows, window=60).collect()}
    assert {r["event_id"]: pytest.approx(r["auc"]) for r in spark.table("aucs").collect()} == batch
    w = drift.windowed_rates(stream, "1 day").writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    w.awaitTermination()
    assert spark.table("rates").count() > 0


def test_packages_and_tools(spark, tmp_path):
    from claimlab.operators import packages as A
    from claimlab.operators import studies as Y

    folder = A.save_package(tmp_path, {"claim": {"a": float("nan"), "b": 1}})
    assert A.verify_package(folder) == [] and A.list_packages(tmp_path) == [folder.name] and A.zip_package(folder).exists()
    (folder / "claim.json").write_text("{}")
    (folder / "more.json").write_text("{}")
    assert A.verify_package(folder) == ["undeclared more.json", "changed claim.json"] and A.verify_package(tmp_path / "none")
    tools = Y.Tools()
    tools.add("rows", lambda n: spark.range(n).select("id", F.lit(True).alias("flag")), {"n"})
    assert tools.run("rows", n=2) and tools.numbers() == [0.0, 1.0]
    with pytest.raises(KeyError):
        tools.run("none")
    with pytest.raises(TypeError):
        tools.run("rows", m=1)


def test_implied_volatility_of_all_parts(spark):
    from claimlab.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["implied_volatility_all"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/part.parquet").count()
    found = [r for r in rows if r["iv"] is not None]
    assert len(found) > 0.9 * len(rows) and all(abs(r["price"] - r["repriced"]) < 1e-3 for r in found)


def test_implied_volatility_at_the_edge_of_its_bracket(spark):
    """Deep in the money the price misses that of the least volatility by rounding."""
    deep = spark.range(400).select(F.lit(910.1).alias("s"), (910.1 * (0.8 + 0.0005 * F.col("id"))).alias("k"), F.lit(2 / 52).alias("t"), F.lit(0.11).alias("v"))
    part = spark.range(1).select(F.lit(910.1).alias("s"), (910.1 * (0.8 + 0.01 * F.lit(4))).alias("k"), ((1 + F.lit(1)) / 52.0).alias("t"), (0.1 + 0.01 * F.lit(1)).alias("v"))
    s, k, t, v = map(F.col, "sktv")
    priced = deep.union(part).withColumn("price", X.bs_price(s, k, t, 0.02, v))
    got = priced.withColumn("iv", X.implied_vol(F.col("price"), s, k, t, 0.02)).select("price", X.bs_price(s, k, t, 0.02, F.col("iv")).alias("again")).collect()
    assert all(r["again"] is not None and abs(r["price"] - r["again"]) < 1e-9 for r in got)


def test_means_in_file_order(spark, tmp_path):
    """Means of decimals are those of a plain loop over the rows, however files are cut."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from claimlab.functions.ordering import means_in_file_order

    rng, want = np.random.default_rng(3), {}
    for k in range(3):
        keys, v = rng.integers(0, 40, 4000), rng.integers(0, 11, 4000) / 100
        pq.write_table(pa.table({"k": keys, "v": v}), tmp_path / f"part-{k}.parquet", row_group_size=500)
        for key, x in zip(keys.tolist(), v.tolist(), strict=True):
            total, n = want.get(key, (0.0, 0))
            want[key] = (total + x, n + 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        table = spark.read.parquet(str(tmp_path))
        got = {r["key"]: r["v"] for r in means_in_file_order(table, {"key": F.col("k")}, v=F.col("v")).collect()}
        plain = {r["k"]: r["v"] for r in table.groupBy("k").agg(F.avg("v").alias("v")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: total / n for k, (total, n) in want.items()}
    assert plain != got  # what the query did before


def test_label_statistics(spark):
    """Exact medians of odd labels, without a map of all values."""
    rng = random.Random(2)
    data = [("even", float(x)) for x in (-5, -1, 0, 3)] + [("ties", 2.0)] * 9 + [("ties", None), ("none", None), ("one", -1e-300), (None, 7.0)]
    data += [("many", rng.gauss(0, 1) * 10 ** rng.randint(-9, 9)) for _ in range(3001)] + [("signs", s * 1e300) for s in (-1, 1, 1, -1)]
    rows = spark.createDataFrame(data, "k string, x double").repartition(5)
    out = K.label_statistics(rows, "k", "x", "all")
    got = {r["label"]: r for r in out.collect()}
    groups = {k: [x for g, x in data if g == k] for k, _ in data} | {"all": [x for _, x in data]}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        some = [x for x in xs if x is not None]
        assert got[k]["n_rows"] == len(xs)
        assert got[k]["median"] == (pytest.approx(float(np.median(some)), rel=1e-12) if some else None)
        assert got[k]["win"] == (pytest.approx(sum(x > 0 for x in some) / len(some)) if some else None)
    from claimlab.plans.catalog import QUERIES

    plan = QUERIES["conclusion_stability"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_means_by_row_group(spark, tmp_path):
    """Every row group is summed by itself, then these sums, however Spark cuts the files."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from claimlab.functions.ordering import means_by_row_group, means_in_file_order

    rng, want, folder = np.random.default_rng(3), {}, tmp_path / "a b%41"
    folder.mkdir()
    for k, size in enumerate((500, 70_000, 140_000)):
        keys, v = rng.integers(0, 40, 140_000), rng.integers(0, 11, 140_000) / 100
        values = [None if x == 0.1 else x for x in v.tolist()]
        pq.write_table(pa.table({"k": keys, "v": pa.array(values, pa.float64())}), folder / f"part-{k}.parquet", row_group_size=size)
        for first in range(0, len(keys), size):
            part = {}
            for key, x in zip(keys[first : first + size].tolist(), values[first : first + size], strict=True):
                total, n = part.get(key, (0.0, 0))
                part[key] = (total, n) if x is None else (total + x, n + 1)
            for key, (total, n) in part.items():
                so_far = want.get(key, (0.0, 0))
                want[key] = (so_far[0] + total, so_far[1] + n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "80000")
    try:
        table = spark.read.parquet(str(folder))
        got = {r["key"]: r["v"] for r in means_by_row_group(table, {"key": F.col("k")}, v=F.col("v")).collect()}
        plain = {r["key"]: r["v"] for r in means_in_file_order(table, {"key": F.col("k")}, v=F.col("v")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: total / n for k, (total, n) in want.items()}
    assert plain != got  # what the query did before
    none = spark.read.schema("k long, v double").parquet(str(folder)).where("k < 0")
    assert means_by_row_group(none, {"key": F.col("k")}, v=F.col("v")).count() == 0
