import datetime as dt
import io
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel import panel as panels
from crosspanel.functions import windows as win
from crosspanel.operators import attribution, betas, events, metrics, overlay, pit, portfolio, regress, risk_model, signals
from crosspanel.panel import last_of_each, require_columns, require_unique
from crosspanel.plans import designs, gate
from crosspanel.sources import archive, capabilities, readers, store

DAY = dt.date(2020, 1, 1)


def panel(spark, values, first=DAY, step=1):
    """(date, asset, ret) from a matrix; NaN is NULL."""
    rows = [(first + dt.timedelta(i * step), f"A{j}", None if np.isnan(v) else float(v)) for i, row in enumerate(values) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "date date, asset string, ret double")


def wide(df, value, key="asset"):
    return df.toPandas().pivot(index="date", columns=key, values=value).sort_index().astype(float)


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(1)
    rows = panel(spark, rng.normal(size=(6, 8))).withColumn("n", F.substring("asset", 2, 2).cast("int"))
    rows = rows.withColumns({"sector": F.concat(F.lit("S"), F.col("n") % 2), "industry": F.concat(F.lit("I"), F.col("n") % 4), "w": F.col("n") + 1.0})
    found = risk_model.decompose(rows, "w").join(rows.select("date", "asset", "industry", "w"), ["date", "asset"]).toPandas()
    assert np.allclose(found.fitted + found.residual, found.ret) and np.allclose(found.market + found.sector_effect + found.industry_effect, found.fitted)
    assert np.allclose(found.assign(x=found.w * found.residual).groupby(["date", "industry"]).x.sum(), 0, atol=1e-12)
    assert risk_model.factor_returns(rows, "w").where("factor = 'MARKET'").count() == 6
    with pytest.raises(ValueError, match="more than one sector"):
        risk_model.check_nesting(spark.createDataFrame([("x", "i"), ("y", "i")], "sector string, industry string"))


def test_momentum_needs_every_date(spark):
    values = np.arange(12.0).reshape(6, 2)
    values[2, 1] = np.nan
    got = wide(signals.momentum(panel(spark, values), "ret", 3), "signal")
    want = pd.DataFrame(values).rolling(3).sum().to_numpy()
    assert np.allclose(got.to_numpy(), want, equal_nan=True)
    assert np.allclose(wide(signals.reversal(panel(spark, values), "ret", 3), "signal").to_numpy(), -want, equal_nan=True)
    with pytest.raises(ValueError):
        signals.momentum(panel(spark, values), "ret", 0)


def test_twelve_one_skips_the_last_month(spark):
    months = [dt.date(2020 + m // 12, m % 12 + 1, 28) for m in range(13)]
    rows = spark.createDataFrame([(d, "A", r, float(i + 1)) for i, (d, r) in enumerate(zip(months, [0.01] * 12 + [5.0]))], "date date, asset string, ret double, residual double")
    last = months[-1]
    assert signals.raw_12_1(rows).where(F.col("date") == last).first().signal == pytest.approx(1.01**11 - 1)
    x = np.arange(2, 13)
    assert signals.standardized_12_1(rows).where(F.col("date") == last).first().signal == pytest.approx(x.sum() / x.std(ddof=1))


def test_lagged_betas_do_not_see_their_date(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=30)
    rows = panel(spark, np.column_stack([2 * m, m + rng.normal(size=30)])).join(spark.createDataFrame([(DAY + dt.timedelta(i), float(v)) for i, v in enumerate(m)], "date date, market double"), "date")
    day = DAY + dt.timedelta(20)
    shocked = rows.withColumns({c: F.when(F.col("date") >= F.lit(day), 99.0 * F.rand(1)).otherwise(F.col(c)) for c in ("ret", "market")})
    a, b = (wide(betas.lagged_betas(x, 10, 5), "beta") for x in (rows, shocked))
    assert np.allclose(a.iloc[:21], b.iloc[:21], equal_nan=True) and a["A0"].dropna().round(9).eq(1.5).all() and a["A0"].isna().sum() == 5
    full = rows.select("date", "asset", F.col("ret").alias("y"), F.col("market").alias("x"))
    got = wide(betas.rolling_beta(full, 10, 5), "beta")
    frame = pd.DataFrame({"y": rows.where("asset = 'A1'").orderBy("date").toPandas().ret, "x": m})
    want = frame.y.rolling(10, min_periods=5).cov(frame.x) / frame.x.rolling(10, min_periods=5).var()
    assert np.allclose(got["A1"], want, equal_nan=True)


def test_weights_and_neutralization(spark):
    rng = np.random.default_rng(3)
    rows = panel(spark, rng.normal(size=(4, 20))).withColumnRenamed("ret", "signal")
    weights = portfolio.global_weights(rows, 0.2)
    sums = weights.groupBy("date").agg(F.sum("weight").alias("s"), F.sum(F.abs("weight")).alias("g"), F.count_if(F.col("weight") > 0).alias("n")).collect()
    assert all(abs(r.s) < 1e-12 and abs(r.g - 1) < 1e-12 and r.n == 4 for r in sums)
    beta = rows.withColumn("beta", F.abs(F.hash("asset")) % 100 / 50.0).select("date", "asset", "beta")
    neutral = portfolio.beta_neutral(weights.join(beta, ["date", "asset"])).join(beta, ["date", "asset"])
    for r in neutral.groupBy("date").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("beta")).alias("b"), F.sum(F.abs("weight")).alias("g")).collect():
        assert abs(r.s) < 1e-10 and abs(r.b) < 1e-10 and abs(r.g - 1) < 1e-10
    flat = portfolio.beta_neutral(weights.withColumn("beta", F.lit(1.0)))
    assert flat.agg(F.max(F.abs("weight"))).first()[0] == 0
    ties = spark.createDataFrame([(DAY, a, "S", 1.0) for a in "dcba"], "date date, asset string, sector string, signal double")
    assert {r.asset: r.weight for r in portfolio.sector_neutral_weights(ties, 0.25).collect()} == {"a": -0.5, "b": 0.0, "c": 0.0, "d": 0.5}
    with pytest.raises(ValueError):
        portfolio.global_weights(rows, 0.5)


def test_path_and_performance(spark):
    weights = panel(spark, [[0.5, -0.5], [0.25, -0.25], [0, 0], [1, 0]]).withColumnRenamed("ret", "weight")
    returns = panel(spark, [[0.1, 0.1], [0.2, np.nan], [0.1, -0.2], [0.3, 0.3]])
    got = portfolio.path(weights, returns, 10).orderBy("date").toPandas()
    assert got.gross.tolist() == pytest.approx([0, 0.1, 0.025 + 0.05, 0]) and got.turnover.tolist() == pytest.approx([0, 1, 0.5, 0.5])
    assert got.net.tolist() == pytest.approx((got.gross - got.turnover / 1000).tolist())
    x = spark.createDataFrame([(DAY + dt.timedelta(i), r) for i, r in enumerate([-0.1, 0.2, -0.05, None])], "date date, net double")
    p = metrics.performance(x).first()
    r = np.array([-0.1, 0.2, -0.05])
    assert p.n == 3 and p.multiple == pytest.approx(np.prod(1 + r)) and p.max_drawdown == pytest.approx(-0.05) and p.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(252))


def test_rank_correlation(spark):
    rng = np.random.default_rng(4)
    s, r = rng.integers(0, 5, (3, 12)).astype(float), rng.normal(size=(3, 12))
    s[0, 3] = np.nan
    got = metrics.information_coefficient(panel(spark, s).withColumnRenamed("ret", "signal"), panel(spark, r)).orderBy("date").collect()
    want = [pd.Series(s[i]).rank().corr(pd.Series(r[i + 1]).where(~np.isnan(s[i])).rank()) for i in range(2)]
    assert [g.ic for g in got[:2]] == pytest.approx(want) and got[2].ic is None and got[0].n == 11


def test_wls_is_orthogonal_and_reports_small_dates(spark):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(6, 3)), rng.normal(size=6), rng.random(6) + 0.1
    found = regress.solve_wls(y, x, w)
    assert found.orthogonality < 1e-12 and np.allclose(found.fitted + found.residuals, y)
    with pytest.raises(ValueError):
        regress.solve_wls(y, x, w * 0)
    rows = [(DAY + dt.timedelta(d), f"A{i}", float(rng.normal()), float(rng.normal()), f"S{i % 3}", 1.0 + i, float(rng.normal())) for d in range(2) for i in range(20 - 15 * d)]
    df = spark.createDataFrame(rows, "date date, asset string, ret double, beta double, sector string, weight double, size double")
    got = regress.cross_sections(df, ["size"], least=10).toPandas()
    assert set(got[got.date == DAY + dt.timedelta(1)].status) == {"INSUFFICIENT_CROSS_SECTION"}
    first = got[got.date == DAY]
    assert first[first.kind == "date"].extra.iloc[0] < 1e-10 and (first.kind == "asset").sum() == 20 and "SECTOR::S2" in set(first.name)


def test_moment_regression_equals_least_squares(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    df = spark.createDataFrame([("k", *map(float, (b, *a))) for a, b in zip(x, y)] + [("k", 1.0, None, 2.0), ("few", 1.0, 2.0, 3.0)], "key string, y double, a double, b double")
    got = {r.key: r for r in regress.moment_regression(df, "y", ["a", "b"], "key").collect()}
    design = np.column_stack([np.ones(40), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [got["k"].alpha, *got["k"].betas] == pytest.approx(want.tolist()) and got["k"].n == 40 and got["few"].alpha is None
    assert got["k"].r2 == pytest.approx(1 - ((y - design @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    one = df.where("key = 'k'").agg(*regress.simple_regression("y", "a")).first()
    assert one.n == 40


def test_residual_momentum_equals_windows_of_least_squares(spark):
    rng = np.random.default_rng(7)
    f, r = rng.normal(size=(45, 3)) * 0.05, rng.normal(size=(45, 2)) * 0.1
    r[10, 1] = np.nan
    df = panel(spark, r, step=31).join(spark.createDataFrame([(DAY + dt.timedelta(31 * i), *map(float, v)) for i, v in enumerate(f)], "date date, a double, b double, c double"), "date")
    got = wide(regress.residual_momentum(df, ["a", "b", "c"]), "score")
    for j in range(2):
        for t in range(45):
            y, x = r[max(0, t - 36) : t, j], np.column_stack([np.ones(len(f)), f])[max(0, t - 36) : t]
            ok = ~np.isnan(y)
            date = DAY + dt.timedelta(31 * t)
            value = got[f"A{j}"].get(date, np.nan) if f"A{j}" in got else np.nan
            if ok.sum() < 24 or t < 12 or np.isnan(r[t - 12 : t - 1, j]).any():
                assert np.isnan(value)
                continue
            e = np.full(len(y), np.nan)
            e[ok] = y[ok] - x[ok] @ np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
            assert value == pytest.approx(np.nansum(e[-12:-1]) / e[ok].std(ddof=1), rel=1e-6)
    with pytest.raises(ValueError):
        regress.residual_momentum(df, ["a"])


HOURS = events.StudyConfig(factor_window=30, least_factor_rows=20, least_alts=2, least_quote_volume=0.0, horizons=(1, 4), anchors=("BTC", "ETH"))


def hourly(spark, n=120, pump=None, seed=8):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("BTC", "ETH", "X", "Y", "Z"):
        close = 100 * np.exp(np.cumsum(rng.normal(size=n) * 0.01))
        if s == "X" and pump:
            close[pump:] *= 2
        rows += [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), s, float(c * 0.999), float(c), 10.0) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "timestamp timestamp, symbol string, open double, close double, quote_volume double")


def test_factor_residuals_equal_numpy_and_look_back_only(spark):
    returns = events.log_returns(events.hourly_grid(hourly(spark))).withColumn("ret", F.when((F.col("symbol") == "Y") & (F.hour("timestamp") == 7), None).otherwise(F.col("ret")))
    factors = events.factor_rows(returns, HOURS)
    got = events.factor_residuals(returns, factors, HOURS).toPandas().pivot(index="timestamp", columns="symbol", values="residual").astype(float)
    r = returns.toPandas().pivot(index="timestamp", columns="symbol", values="ret").astype(float)
    f = factors.toPandas().set_index("timestamp").sort_index().astype(float)
    x = np.column_stack([np.ones(len(f)), f[["btc", "eth", "alt"]]])
    for s in r:
        for t in range(len(r)):
            wx, wy = x[max(0, t - 30) : t], r[s].to_numpy()[max(0, t - 30) : t]
            value = got[s].iloc[t]
            if len(wx) < 20 or np.isnan(wx).any(1).sum() > len(wx) - 20:
                assert np.isnan(value)
                continue
            full = ~np.isnan(wx).any(1)
            if np.isnan(wy[full]).any() or np.isnan(r[s].iloc[t]) or np.isnan(x[t]).any():
                assert np.isnan(value)
                continue
            m = np.array([[np.nansum(wx[:, i] * wx[:, j]) for j in range(4)] for i in range(4)]) + np.diag([0, 1e-8, 1e-8, 1e-8])
            b = np.linalg.inv(m) @ np.nansum(wx * wy[:, None], 0)
            assert value == pytest.approx(r[s].iloc[t] - x[t] @ b, abs=1e-9)


def test_an_own_pump_is_an_event_and_cools_down(spark):
    quiet, pumped = (events.events(events.features(hourly(spark, pump=p), HOURS), HOURS).collect() for p in (None, 80))
    assert not quiet and {(r.signal, r.symbol) for r in pumped} == {("raw_pump", "X"), ("residual_pump", "X")}
    assert all(r.signal_timestamp == dt.datetime(2024, 1, 4, 8) for r in pumped if r.signal == "raw_pump")
    times = spark.createDataFrame([([3600 * h for h in (50, 1, 5, 24, 26, 49)],)], "t array<bigint>")
    assert [x // 3600 for x in times.select(events.cooled(F.col("t"), 24).alias("t")).first().t] == [1, 26, 50]
    assert events.event_summary(events.events(events.features(hourly(spark, pump=80), HOURS), HOURS), HOURS).count() == 4
    with pytest.raises(ValueError, match="positive"):
        events.valid_panel(hourly(spark).withColumn("open", F.lit(0.0)))


def test_gate_arithmetic_and_bootstrap(spark):
    need = gate.power_requirement(0.917716)
    assert need["required_months"] == 200 and need["appraisal_ratio"] == pytest.approx(0.755216, abs=1e-6) and need["alpha"] == 0.025
    with pytest.raises(ValueError):
        gate.power_requirement(1.0)
    rng = np.random.default_rng(9)
    a = rng.normal(size=40)
    b = a + rng.normal(size=40)
    df = spark.createDataFrame([(DAY + dt.timedelta(31 * i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "date date, raw double, residual double")
    got, draw, found = gate.bootstrap_interval(df, 50, 6, 17291).first(), np.random.default_rng(17291), []
    for _ in range(50):
        idx = ((draw.integers(0, 40, size=7)[:, None] + np.arange(6)) % 40).ravel()[:40]
        found.append(np.corrcoef(a[idx], b[idx])[0, 1])
    assert [got.low, got.high] == pytest.approx(np.quantile(found, [0.025, 0.975]).tolist()) and got.share_known == 1


def trades(spark, n=80):
    rng = random.Random(10)
    rows, cash, held, prices = [], 10_000.0, dict.fromkeys(attribution.SLEEVES, 0.0), {t: 100.0 for t in attribution.SLEEVES}
    for i in range(n):
        date = DAY + dt.timedelta(i)
        prices = {t: p * math.exp(rng.gauss(0, 0.02)) for t, p in prices.items()}
        target = {"VTI": 20.0, "TLT": 10.0 if i > 40 else 0.0, "GLD": 5.0, "SVXY": 4.0 if i % 20 < 10 else 0.0, "VIXY": 3.0 if i % 20 >= 15 else 0.0}
        for t in attribution.SLEEVES:
            fee = 0.01 * abs(target[t] - held[t])
            cash -= (target[t] - held[t]) * prices[t] + fee
            rows.append((t, date, prices[t], target[t], target[t] * prices[t], 0.0, 0.0, fee, 0.0, 0.0, 0.0))
        held = target
        rows.append(("Cash", date, 1.0, cash, cash, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    return spark.createDataFrame(rows, "ticker string, date date, close double, shares double, exposure double, sharetrades double, tradevalue double, commission double, interest double, short_borrow_cost double, margin_call double")


def test_accounts_reconcile_and_faults_are_told(spark):
    table = trades(spark)
    daily = attribution.check_accounts(table, attribution.accounts(table))
    assert daily.count() == 80
    for changed, text in (
        (table.unionByName(table.limit(1)), "more than one row"), (table.withColumn("shares", F.when(F.col("ticker") == "VIXY", 1.0).otherwise(F.col("shares"))), "both held"),
        (table.withColumn("exposure", -F.abs("exposure")), "NAV"), (table.withColumn("commission", F.col("commission") + 1), "reconcile"),
    ):
        with pytest.raises(ValueError, match=text):
            attribution.check_accounts(changed, attribution.accounts(changed))
    with pytest.raises(ValueError, match="lacks"):
        attribution.accounts(table.drop("interest"))


def test_risk_shares_equal_numpy(spark):
    daily = attribution.accounts(trades(spark)).persist()
    d = daily.orderBy("date").toPandas()
    got = {(r.date, r.asset): r for r in attribution.rolling_risk(daily, 60, 30).collect()}
    w = np.column_stack([d.w_VTI, d.w_TLT, d.w_GLD, d.w_SVXY + d.w_VIXY]).astype(float)
    r = d[[f"r_{t}" for t in attribution.ACTIVE]].to_numpy(float)
    seen = 0
    for t in range(len(d)):
        on = np.abs(w[t]) > 1e-12
        part = r[max(0, t - 59) : t + 1][:, on]
        part = part[~np.isnan(part).any(1)]
        if not on.any() or len(part) < 30:
            assert not any(k[0] == d.date[t] for k in got)
            continue
        vol, shares = attribution.risk_contributions(w[t][on], np.atleast_2d(np.cov(part.T)))
        for a, s in zip(np.array(attribution.ACTIVE)[on], shares):
            seen += 1
            assert got[d.date[t], a].contribution == pytest.approx(s) and got[d.date[t], a].volatility == pytest.approx(vol)
    assert seen == len(got) > 50
    vol, shares = attribution.risk_contributions(np.array([0.5, 0.5]), np.array([[0.04, 0.01], [0.01, 0.09]]))
    assert shares.sum() == pytest.approx(1)
    assert attribution.unique_risk(daily).count() == 24


def test_overlay_looks_at_the_day_before(spark):
    daily = attribution.accounts(trades(spark))
    rules = [("original", "none", None, 1.0), ("joint", "joint", None, 0.0)]
    base = overlay.streams(daily, rules).where("strategy = 'original'").join(daily.select("date", "ret"), "date").where("ret IS NOT NULL").toPandas()
    assert np.allclose(base.net, base.ret)
    day = DAY + dt.timedelta(45)
    shocked = daily.withColumns({f"r_{t}": F.when(F.col("date") == F.lit(day), -0.5).otherwise(F.col(f"r_{t}")) for t in ("VTI", "TLT", "GLD")})
    a, b = (overlay.streams(x, rules).where("strategy = 'joint'").orderBy("date").toPandas() for x in (daily, shocked))
    assert (a.trigger[:46] == b.trigger[:46]).all() and b.trigger[46] and len(overlay.SCENARIOS) == 11
    with pytest.raises(ValueError):
        overlay.streams(daily, [("x", "none", None, 2.0)])


def test_point_in_time_panel(spark):
    rows = [(f"T{i}", DAY + dt.timedelta(d), 10.0 + d, 1, 100.0 * (i + 1), 2.0 if i else None) for d in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, is_universe int, market_cap double, price_to_book double")
    panel, daily = pit.build_panel(df, df, floor=0.7)
    assert panel.agg(F.min("date")).first()[0] == DAY + dt.timedelta(1) and panel.where("ticker = 'T0' AND book_price IS NULL").count() == 4
    assert daily.where(F.col("date") == DAY).first().market_cap_coverage == 0 and pit.build_panel(df, df, floor=0.9)[0].count() == 0
    assert pit.coverage_summary(daily).first().min_price_to_book_coverage == 0
    gaps = spark.createDataFrame([("T", DAY, "1"), ("T", DAY + dt.timedelta(1), None), ("T", DAY + dt.timedelta(2), "3")], "ticker string, date date, close string").withColumn("is_universe", F.lit(1))
    assert [r.total_return for r in pit.normalized_bars(gaps).orderBy("date").collect()] == [None, 0.0, 2.0]


def test_monthly_signals_notice_holes(spark):
    rows = [(dt.date(2020 + m // 12, m % 12 + 1, d), s, 0.01 * d, 0.001 * (d + m)) for s in ("full", "hole") for m in range(15) for d in (5, 6, 7) if not (s == "hole" and m == 5)]
    df = spark.createDataFrame(rows, "date date, symbol string, ret double, residual double")
    got = signals.monthly_signals(df, 5, 1).collect()
    assert {r.month.month + 12 * (r.month.year - 2020) - 1 for r in got if r.symbol == "full"} == set(range(6, 15))
    assert 6 not in {r.month.month - 1 for r in got if r.symbol == "hole" and r.month.year == 2020}


def test_sources(spark, tmp_path):
    text = "open_time,open,high,low,close,volume,a,b,c,d,e,f\n" + "".join(f"{1704067200000 + 3600000 * i},1,2,0.5,{i + 1},9,0,7,1,1,1,0\n" for i in range(3))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("k.csv", text)
    (tmp_path / "BTCUSDT-1h-2024-01.zip").write_bytes(buffer.getvalue())
    utc = dt.UTC
    got = archive.read_archives(spark, str(tmp_path), dt.datetime(2024, 1, 1, tzinfo=utc), dt.datetime(2024, 1, 1, 2, tzinfo=utc)).orderBy("timestamp").collect()
    assert [r.close for r in got] == [1.0, 2.0] and got[0].symbol == "BTCUSDT" and got[0].quote_volume == 7
    assert archive.missing_symbols(spark, spark.createDataFrame(got), ["ZZ", "BTCUSDT"]) == ["ZZ"]
    again = io.BytesIO()
    with zipfile.ZipFile(again, "w") as z:  # a later file in microseconds, with a time repeated: the later line wins
        z.writestr("k.csv", "".join(f"{1704067200000000 + 3600000000 * i},1,2,0.5,{v},9,0,7,1,1,1,0\n" for i, v in ((0, 5), (0, 6), (1, "bad"))))
    (tmp_path / "BTCUSDT-1h-2024-02.zip").write_bytes(again.getvalue())
    (tmp_path / "ETHUSDT-1h-2024-01.zip").write_bytes(buffer.getvalue())
    whole = archive.read_archives(spark, str(tmp_path), dt.datetime(2024, 1, 1, tzinfo=utc), dt.datetime(2024, 1, 2, tzinfo=utc), ["btcusdt"]).orderBy("timestamp").collect()
    recent, absent = archive.read_recent(spark, str(tmp_path), 31, ["btcusdt", "zusdt"], dt.datetime(2024, 2, 5))
    assert absent == ["ZUSDT"] and recent.count() == len(whole)
    assert [r.close for r in whole] == [6.0, 2.0, 3.0] and {r.symbol for r in whole} == {"BTCUSDT"}
    with pytest.raises(ValueError, match="zip"):
        archive.lines_of(b"no", "x")
    assert archive.completed_month_end(dt.datetime(2024, 3, 9, 5, tzinfo=utc)) == dt.datetime(2024, 3, 1, tzinfo=utc)
    with pytest.raises(ValueError):
        archive.starter_contracts(1)
    assert len(archive.starter_contracts()) == 50 and archive.month_starts(dt.datetime(2023, 11, 5, tzinfo=utc), dt.datetime(2024, 2, 1, tzinfo=utc))[-1].month == 1
    assert archive.archive_address("abc", "1h", 2024, 3).endswith("/ABC/1h/ABC-1h-2024-03.zip")
    assert readers.symbols_in("sol, btcusdt # x\nada sol") == ["BTCUSDT", "ETHUSDT", "SOL", "ADA"]
    live = spark.createDataFrame([(s, "PERPETUAL", "USDT", "TRADING") for s in ("AUSDT", "BUSDT", "CUSDT")], "symbol string, contractType string, quoteAsset string, status string")
    volume = spark.createDataFrame([("AUSDT", "5"), ("BUSDT", "5"), ("CUSDT", "40"), ("DUSDT", "99")], "symbol string, quoteVolume string")
    assert archive.discovered_contracts(live, volume, 4) == ["BTCUSDT", "ETHUSDT", "CUSDT", "BUSDT"]
    assert list(capabilities.LARGE_THOUSAND.unmet(False)) == ["stable_asset_ids", "terminal_delisting_economics", "pit_major_exchange_status"] and capabilities.LARGE_THOUSAND.raw_dollar_turnover
    assert len(capabilities.LARGE_THOUSAND.blockers()) == 4 and list(capabilities.LISTED_AND_DELISTED.unmet()) == ["terminal_delisting_economics", "pit_sector_industry"]
    own = capabilities.SourceCapabilities.from_json('{"name": "x", "stable_asset_ids": true, "notes": ["n"]}')
    assert own.notes == ("n",) and "stable_asset_ids" not in own.unmet()
    with pytest.raises(ValueError, match="unknown capabilities"):
        capabilities.SourceCapabilities.from_json('{"name": "x", "other": 1}')
    with pytest.raises(ValueError, match="unknown kind"):
        readers.read_frame(spark, "x.xyz")
    (tmp_path / "u.csv").write_text("Symbol,Security,GICS Sector,GICS Sub-Industry\nBRK.B,Berkshire,Fin,Ins\n")
    assert readers.read_universe(spark, str(tmp_path / "u.csv")).first().yahoo_ticker == "BRK-B"
    cells = lambda tag, *texts: "<tr>" + "".join(f"<{tag}>{t}</{tag}>" for t in texts) + "</tr>"
    body = cells("th", "No", *readers.UNIVERSE) + cells("td", 1, "<a href='#'>BRK.B</a>", "Berkshire &amp; Co", " Fin\n", "Ins") + cells("td", "short")
    (tmp_path / "u.html").write_text(f"<table>{cells('th', 'other')}</table><p>text</p><table>\n{body}</table>")
    assert [tuple(r) for r in readers.read_universe(spark, str(tmp_path / "u.html")).collect()] == [("BRK.B", "BRK-B", "Berkshire & Co", "Fin", "Ins")]
    with pytest.raises(ValueError, match="no table"):
        readers.page_table("<table></table><p>", ["Symbol"])


def test_designs(spark):
    design = designs.ResearchDesign()
    assert (design.incremental_alpha_hurdle, design.target_vol, design.registered_trials, design.characteristic_coverage_floor) == (0.03, 0.10, 2, 0.90) and design.to_dict()["case_c_incremental_risk_budget"] == 0.25
    assert "index" not in " ".join(designs.UniverseConfig().validate().__dataclass_fields__)
    for wrong in (designs.ResearchDesign(registered_trials=3), designs.ResearchDesign(desired_power=1.0), designs.UniverseConfig(adv_min_periods=64), designs.UniverseConfig(top_n_by_dollar_volume=1), designs.UniverseConfig(price_floor=0.0)):
        with pytest.raises(ValueError, match="out of range"):
            wrong.validate()
    bars = spark.createDataFrame([(DAY + dt.timedelta(days=i), "a", 10.0, 100.0, 0.0) for i in range(4)], "date date, asset_id string, close_unadjusted double, volume_unadjusted double, total_return double")
    history = bars.select("date", "asset_id", F.lit(True).alias("is_common_stock"), F.lit(True).alias("is_major_exchange"))
    rules = designs.UniverseConfig(adv_window_days=2, adv_min_periods=2, min_dollar_volume=1000.0, min_history_days=2)
    assert [r.eligible for r in rules.universe(bars, history).orderBy("date").collect()] == [False, False, True, True]


def test_wide_and_latest(spark):
    rows = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", None), (DAY + dt.timedelta(days=1), "a", 2.0), (None, "a", 9.0)], "date date, asset string, value double")
    assert [tuple(r) for r in panels.wide(rows.where("date IS NOT NULL"), ["a", "b"], "value").orderBy("date").collect()] == [(DAY, 1.0, None), (DAY + dt.timedelta(days=1), 2.0, None)]
    assert panels.long(panels.wide(rows, ["a", "b"], "value"), "value").count() == 6
    assert [r.value for r in panels.latest(rows).collect()] == [2.0] and panels.latest(rows.where("date IS NULL")).isEmpty()


def test_store(spark, tmp_path):
    bars = spark.createDataFrame([(DAY, "a", "A", 1.0, 2.0, 0.1), (DAY, "b", "B", 1.0, 2.0, None)], "date date, asset_id string, symbol string, close_unadjusted double, volume_unadjusted double, total_return double")
    history = bars.select("date", "asset_id", "symbol", F.lit(True).alias("is_common_stock"), F.lit(None).cast("boolean").alias("is_major_exchange"))
    made = store.CanonicalStore(spark, str(tmp_path / "s"))
    manifest = made.write(bars, history, "test")
    assert made.read_manifest() == manifest and made.read_bars().count() == 2
    assert store.content_hash(bars.orderBy(F.desc("asset_id"))) == manifest["tables"]["bars"]["sha256"] != store.content_hash(bars.limit(1))
    with pytest.raises(ValueError, match="more than one row"):
        made.write(bars.unionByName(bars), history)
    with pytest.raises(ValueError, match="unblind"):
        store.build_manifest(bars.withColumnRenamed("symbol", "ticker"), {"s": bars.withColumn("sharpe_x", F.lit(1))})
    store.write_report(spark, str(tmp_path / "r"), "Title", {"a": 1}, {"t": bars})
    assert "| A |" in (tmp_path / "r" / "REPORT.md").read_text()


def test_panel_helpers(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in last_of_each(df, ["k"], "seq").collect()} == {(1, "b"), (2, None)}
    with pytest.raises(ValueError, match="lacks columns: x"):
        require_columns(df, ["k", "x"])
    with pytest.raises(ValueError):
        require_unique(df, ["k"])
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in odd.select(win.known(F.col("x"))).collect()] == [1.0, None, None, None]
    assert odd.limit(0).agg(win.nearest_quantile(F.col("x"), 0.5)).first()[0] is None
