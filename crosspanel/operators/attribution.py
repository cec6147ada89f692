"""Accounting of a trades table and its attribution: P&L by sleeve, regimes, betas, correlations, risk shares.

The strategy is one series of dates, so its windows lie in one partition; the table it comes from is summed by date first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosspanel.functions.windows import correlation, ratio
from crosspanel.operators.regress import moment_regression, simple_regression
from crosspanel.panel import require_columns, require_unique

SLEEVES = ("VTI", "TLT", "GLD", "SVXY", "VIXY")
ACTIVE = ("VTI", "TLT", "GLD", "VOL")
TRADE_COLUMNS = ("ticker", "date", "close", "shares", "exposure", "sharetrades", "tradevalue", "commission", "interest", "short_borrow_cost", "margin_call")
STATES = ("SVXY", "VIXY", "NONE")
YEAR = 252.0


def _time(*keys: str):
    return Window.partitionBy(F.lit(1), *keys).orderBy("date")


def accounts(trades: DataFrame) -> DataFrame:
    """One row a date: nav, fees, ret, state, held_state, gross_exposure, VOL and, for each sleeve x, w_x, r_x, pnl_x."""
    require_columns(trades, TRADE_COLUMNS, "trades")
    rows = trades.withColumn("close", F.when(F.col("close") > 0, F.col("close")))
    cell = lambda t, c: F.max(F.when(F.col("ticker") == t, F.col(c)))
    fees = -F.sum(F.coalesce("commission", F.lit(0.0))) + F.sum(F.coalesce("interest", F.lit(0.0))) - F.sum(F.coalesce("short_borrow_cost", F.lit(0.0)))
    known = F.col("ticker").isin("Cash", *SLEEVES)
    wide = rows.groupBy("date").agg(
        F.sum(F.when(known, F.coalesce("exposure", F.lit(0.0)))).alias("nav"), fees.alias("fees"),
        *(cell(t, "close").alias(f"p_{t}") for t in SLEEVES), *(F.coalesce(cell(t, c), F.lit(0.0)).alias(f"{n}_{t}") for t in SLEEVES for c, n in (("shares", "s"), ("exposure", "e"))),
    )
    w = _time()
    before = lambda c: F.lag(c).over(w)
    held = {t: F.abs(F.col(f"s_{t}")) > 1e-12 for t in ("SVXY", "VIXY")}
    state = F.when(held["SVXY"] & held["VIXY"], F.lit("BOTH")).when(held["SVXY"], F.lit("SVXY")).when(held["VIXY"], F.lit("VIXY")).otherwise(F.lit("NONE"))
    made = wide.withColumns(
        {"ret": ratio(F.col("nav"), before("nav")) - 1, "prior_nav": before("nav"), "state": state, "gross_exposure": reduce(Column.__add__, (F.abs(f"e_{t}") for t in SLEEVES)) / F.col("nav")}
        | {f"w_{t}": F.col(f"e_{t}") / F.col("nav") for t in SLEEVES}
        | {f"r_{t}": ratio(F.col(f"p_{t}"), before(f"p_{t}")) - 1 for t in SLEEVES}
        | {f"pnl_{t}": F.coalesce(before(f"s_{t}") * (F.col(f"p_{t}") - before(f"p_{t}")), F.lit(0.0)) for t in SLEEVES}
    ).withColumn("held_state", F.coalesce(before("state"), F.lit("NONE")))
    total = reduce(Column.__add__, (F.col(f"pnl_{t}") for t in SLEEVES)) + F.col("fees")
    vol = F.when(F.col("held_state") == "SVXY", F.col("r_SVXY")).when(F.col("held_state") == "VIXY", F.col("r_VIXY"))
    names = ["date", "nav", "prior_nav", "fees", "ret", "state", "held_state", "gross_exposure"]
    return made.select(*names, vol.alias("r_VOL"), total.alias("total_pnl"), *(f"{n}_{t}" for n in ("w", "r", "pnl") for t in SLEEVES))


def check_accounts(trades: DataFrame, daily: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """The daily frame itself; ValueError for repeated keys, a NAV of 0 or less, both volatility sleeves held, or P&L that does not reconcile."""
    require_unique(trades, ["date", "ticker"], "trades")
    worst = daily.agg(F.min("nav").alias("nav"), F.max((F.col("state") == "BOTH").cast("int")).alias("both"), F.max(F.abs(F.col("nav") - F.col("prior_nav") - F.col("total_pnl"))).alias("error")).first()
    if worst["nav"] is not None and worst["nav"] <= 0:
        raise ValueError("NAV must be positive")
    if worst["both"]:
        raise ValueError("SVXY and VIXY are both held")
    if worst["error"] is not None and worst["error"] > tolerance:
        raise ValueError(f"accounting does not reconcile: largest error {worst['error']:.6f}")
    return daily


def contributions(daily: DataFrame) -> DataFrame:
    """(date, sleeve, contribution) with FEES and TOTAL."""
    parts = [F.struct(F.lit(t).alias("sleeve"), (F.col(f"pnl_{t}") / F.col("prior_nav")).alias("contribution")) for t in SLEEVES]
    parts += [F.struct(F.lit(n).alias("sleeve"), (F.col(c) / F.col("prior_nav")).alias("contribution")) for n, c in (("FEES", "fees"), ("TOTAL", "total_pnl"))]
    return daily.select("date", F.explode(F.array(*parts)).alias("c")).select("date", "c.*")


def dollar_attribution(daily: DataFrame) -> DataFrame:
    """(sleeve, dollar_pnl)."""
    sums = daily.agg(*(F.sum(f"pnl_{t}").alias(t) for t in SLEEVES), F.sum("fees").alias("FEES"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(t).alias("sleeve"), F.col(t).alias("dollar_pnl")) for t in (*SLEEVES, "FEES")))).alias("x")).select("x.*")


def with_regimes(rows: DataFrame, benchmark: str, base: Column | None = None, up: bool = True) -> DataFrame:
    """A copy of each row for each regime of the benchmark that it is in. Quantiles are linear, over the rows where ``base`` is known."""
    x = F.col(benchmark)
    value = x if base is None else F.when(base.isNotNull(), x)
    cuts = rows.agg(*(F.percentile(value, F.lit(q)).alias(f"_q{n}") for n, q in (("20", 0.2), ("10", 0.1), ("05", 0.05))))
    tests = {"ALL": F.lit(True), "VTI_UP": x > 0, "VTI_DOWN": x < 0} | {f"VTI_WORST_{n}": x <= F.col(f"_q{n}") for n in ("20", "10", "05")}
    names = [F.when(t, F.lit(n)) for n, t in tests.items() if up or n != "VTI_UP"]
    return rows.crossJoin(F.broadcast(cuts)).withColumn("regime", F.explode(F.array_compact(F.array(*names)))).drop("_q20", "_q10", "_q05")  # one row of cuts


def conditional_betas(daily: DataFrame) -> DataFrame:
    """(asset, regime, n, beta, r2, unique_variance) of each active sleeve against VTI."""
    long = with_regimes(daily.select("date", "r_VTI", "r_TLT", "r_GLD", "r_VOL"), "r_VTI").select(
        "regime", F.col("r_VTI").alias("x"), F.explode(F.array(*(F.struct(F.lit(t).alias("asset"), F.col(f"r_{t}").alias("y")) for t in ACTIVE[1:]))).alias("s")
    )
    found = long.select("regime", "x", "s.*").groupBy("asset", "regime").agg(*simple_regression("y", "x"))
    return found.select("asset", "regime", "n", "beta", "r2", (1 - F.col("r2")).alias("unique_variance"))


def unique_risk(daily: DataFrame) -> DataFrame:
    """(asset, regime, n, r2, unique_variance) of each active sleeve against all others."""
    rows = with_regimes(daily.select("date", *(f"r_{t}" for t in ACTIVE)), "r_VTI")
    parts = []
    for t in ACTIVE:
        others = [f"r_{o}" for o in ACTIVE if o != t]
        parts.append(moment_regression(rows, f"r_{t}", others, "regime").select(F.lit(t).alias("asset"), "regime", "n", "r2", (1 - F.col("r2")).alias("unique_variance")))
    return reduce(DataFrame.unionByName, parts)


def strategy_stress(daily: DataFrame) -> DataFrame:
    """(regime, n, beta, r2) of the strategy against VTI over rows where both are known."""
    rows = daily.select(F.col("ret").alias("y"), F.col("r_VTI").alias("x")).where("y IS NOT NULL AND x IS NOT NULL")
    return with_regimes(rows, "x", up=False).groupBy("regime").agg(*simple_regression("y", "x")).select("regime", "n", "beta", "r2")


def state_stats(daily: DataFrame) -> DataFrame:
    """(state, days, mean, volatility, sharpe, beta, r2) by the volatility sleeve held."""
    rows = daily.select(F.col("held_state").alias("state"), F.col("ret").alias("y"), F.col("r_VTI").alias("x")).where("y IS NOT NULL AND x IS NOT NULL")
    mean, vol = F.avg("y") * YEAR, F.stddev_samp("y") * F.sqrt(F.lit(YEAR))
    _, _, beta, r2 = simple_regression("y", "x")
    return rows.groupBy("state").agg(F.count("*").alias("days"), mean.alias("mean"), vol.alias("volatility"), ratio(mean, F.when(vol > 0, vol)).alias("sharpe"), beta, r2)


def state_stress(daily: DataFrame) -> DataFrame:
    """(state, regime, n, beta, r2, vol_beta, vol_r2, mean): always a row for each of the 15 pairs."""
    spark = daily.sparkSession
    regimes = ("ALL", "VTI_DOWN", "VTI_WORST_20", "VTI_WORST_10", "VTI_WORST_05")
    grid = spark.createDataFrame([(s, r) for s in STATES for r in regimes], "state string, regime string")
    rows = with_regimes(daily.select(F.col("held_state").alias("state"), F.col("ret").alias("y"), F.col("r_VTI").alias("x"), F.col("r_VOL").alias("v")), "x", up=False)
    n, _, beta, r2 = simple_regression("y", "x")
    _, _, vol_beta, vol_r2 = simple_regression("v", "x")
    found = rows.groupBy("state", "regime").agg(n, beta, r2, vol_beta.alias("vol_beta"), vol_r2.alias("vol_r2"), F.avg("y").alias("mean"))
    return grid.join(found, ["state", "regime"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def correlations(daily: DataFrame) -> DataFrame:
    """(regime, asset_a, asset_b, correlation) of the six pairs of active sleeves."""
    pairs = [(a, b) for i, a in enumerate(ACTIVE) for b in ACTIVE[i + 1 :]]
    rows = with_regimes(daily.select(*(f"r_{t}" for t in ACTIVE)), "r_VTI", up=False)
    long = rows.select("regime", F.explode(F.array(*(F.struct(F.lit(a).alias("asset_a"), F.lit(b).alias("asset_b"), F.col(f"r_{a}").alias("a"), F.col(f"r_{b}").alias("b")) for a, b in pairs))).alias("p"))
    return long.select("regime", "p.*").groupBy("regime", "asset_a", "asset_b").agg(correlation(F.col("a"), F.col("b")).alias("correlation"))


def worst_days(daily: DataFrame, n: int = 15) -> DataFrame:
    parts = [(F.col(f"pnl_{t}") / F.col("prior_nav")).alias(t) for t in SLEEVES]
    return daily.where("ret IS NOT NULL").select("date", "ret", F.col("r_VTI").alias("vti_return"), *parts, (F.col("fees") / F.col("prior_nav")).alias("FEES"), "held_state", "gross_exposure").orderBy("ret", "date").limit(n)


def risk_contributions(weights: np.ndarray, covariance: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Annual volatility and each asset's share of variance; None for an unknown or non-positive variance."""
    marginal = covariance @ weights
    variance = float(weights @ marginal)
    return (float(np.sqrt(variance * YEAR)), weights * marginal / variance) if np.isfinite(variance) and variance > 0 else None


def rolling_risk(daily: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """(date, n, volatility, asset, contribution): of active sleeves with weight, over complete rows of these in the last ``window``.

    Each date meets its own window by row number; pair sums replace matrices, so the copies are pairs of numbers.
    """
    weight = {t: F.col(f"w_{t}") for t in ACTIVE[:3]} | {"VOL": F.col("w_SVXY") + F.col("w_VIXY")}
    rows = daily.select("date", F.row_number().over(_time()).alias("rn"), *(weight[t].alias(f"w_{t}") for t in ACTIVE), *(F.col(f"r_{t}") for t in ACTIVE))
    now = rows.select("date", F.col("rn").alias("now"), *(f"w_{t}" for t in ACTIVE))
    past = rows.select("rn", *(f"r_{t}" for t in ACTIVE)).withColumn("now", F.explode(F.sequence(F.col("rn"), F.col("rn") + window - 1)))  # each row serves this many dates
    both = now.join(past, "now")
    on = {t: F.abs(f"w_{t}") > 1e-12 for t in ACTIVE}
    complete = both.where(reduce(Column.__and__, ((~on[t]) | F.col(f"r_{t}").isNotNull() for t in ACTIVE)) & reduce(Column.__or__, on.values()))
    pairs = [(a, b) for a in ACTIVE for b in ACTIVE]
    long = complete.select("date", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.when(on[a] & on[b], F.col(f"w_{a}") * F.col(f"w_{b}")).alias("ww"), F.col(f"r_{a}").alias("x"), F.col(f"r_{b}").alias("y"), F.lit(b).alias("b")) for a, b in pairs))).alias("p"))
    cov = long.select("date", "p.*").where("ww IS NOT NULL").groupBy("date", "a", "b").agg(F.count("*").alias("n"), (F.first("ww") * F.covar_samp("x", "y")).alias("part")).where(F.col("n") >= least)
    shares = cov.groupBy("date", F.col("a").alias("asset")).agg(F.max("n").alias("n"), F.sum("part").alias("part")).withColumn("variance", F.sum("part").over(Window.partitionBy("date")))
    return shares.where("variance > 0").select("date", "n", F.sqrt(F.col("variance") * YEAR).alias("volatility"), "asset", (F.col("part") / F.col("variance")).alias("contribution"))


def latest_risk(daily: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """The rows of ``rolling_risk`` on its last date."""
    found = rolling_risk(daily, window, least)
    last = Window.partitionBy(F.lit(1)).orderBy(F.col("date").desc())  # the strategy's own series
    return found.withColumn("_rank", F.rank().over(last)).where("_rank = 1").drop("_rank")
