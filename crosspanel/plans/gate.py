"""The blind gate: how far raw and residual momentum move together, and how long a test would take. No performance is reported."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import correlation
from crosspanel.operators import betas, portfolio, signals


@dataclass(frozen=True)
class GateConfig:
    beta_window: int = 252
    least_beta: int = 126
    shrinkage: float = 0.5
    prior: float = 1.0
    formation: int = 11
    skip: int = 1
    quantile: float = 0.2
    cost_bps: float = 5.0
    target_vol: float = 0.10
    vol_months: int = 12
    vol_cap: float = 3.0
    samples: int = 2000
    block: int = 6
    seed: int = 17291
    alpha: float = 0.05
    tests: int = 2
    power: float = 0.8
    hurdle: float = 0.03
    clean_years: float | None = None

    def validate(self) -> GateConfig:
        if not (0 < self.quantile < 0.5 and 0 <= self.shrinkage <= 1 and 2 <= self.least_beta <= self.beta_window and self.formation > 0 and self.skip >= 0 and self.samples > 0 and self.block > 0):
            raise ValueError("a gate parameter is out of range")
        return self


def power_requirement(rho: float, config: GateConfig = GateConfig()) -> dict[str, float]:
    """Years that a spanning alpha of the hurdle needs to show, given the correlation."""
    if not abs(rho) < 1:
        raise ValueError("the correlation must lie within -1 and 1")
    normal = NormalDist()
    ratio = config.hurdle / (config.target_vol * math.sqrt(1 - rho * rho))
    share = config.alpha / config.tests
    years = ((normal.inv_cdf(1 - share / 2) + normal.inv_cdf(config.power)) / ratio) ** 2
    return {"appraisal_ratio": ratio, "required_years": years, "required_months": math.ceil(12 * years), "alpha": share}


def bootstrap_interval(paired: DataFrame, samples: int, block: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """(low, high, share_known) of the correlation of (date, raw, residual) under circular blocks.

    The series has a row for each month; it and the block starts are on the driver, places and correlations follow in Spark.
    """
    months = sorted((r["date"], r["raw"], r["residual"]) for r in paired.select("date", "raw", "residual").collect())
    numbered = paired.sparkSession.createDataFrame([(i, *m[1:]) for i, m in enumerate(months)], "idx int, raw double, residual double")
    n = len(months)
    if n < max(12, 2 * block):
        raise ValueError("too few months for the bootstrap")
    generator, blocks = np.random.default_rng(seed), -(-n // block)
    drawn = [(s, k, int(start)) for s in range(samples) for k, start in enumerate(generator.integers(0, n, size=blocks))]
    starts = paired.sparkSession.createDataFrame(drawn, "sample int, block int, start int")
    places = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("block") * block + F.col("step") < n)
    rows = places.withColumn("idx", (F.col("start") + F.col("step")) % n).join(numbered, "idx")
    each = rows.groupBy("sample").agg(correlation(F.col("raw"), F.col("residual")).alias("r"))
    return each.agg(F.percentile("r", F.lit(alpha / 2)).alias("low"), F.percentile("r", F.lit(1 - alpha / 2)).alias("high"), (F.count("r") / samples).alias("share_known"))


def sleeves(returns: DataFrame, market: DataFrame, config: GateConfig) -> DataFrame:
    """(date, raw, residual, and of each turnover, longs, shorts): monthly net returns of both momentum sleeves, neutral to beta and scaled to one volatility."""
    config.validate()
    from crosspanel.panel import dense

    daily = dense(returns, "ret").join(market.select("date", "market"), "date", "left")
    beta = betas.lagged_betas(daily, config.beta_window, config.least_beta, config.shrinkage, config.prior)
    residual = betas.adjusted_residuals(daily, beta)
    monthly = dense(signals.monthly_compound(returns), "ret")
    month_beta = signals.monthly_last(beta, "beta")
    both = {
        "raw": signals.raw_12_1(monthly, "ret", config.formation, config.skip),
        "residual": signals.standardized_12_1(signals.monthly_sum(residual, "residual"), "residual", config.formation, config.skip),
    }
    out = None
    for name, signal in both.items():
        weights = portfolio.global_weights(signal, config.quantile).join(month_beta, ["date", "asset"], "left")
        neutral = portfolio.beta_neutral(weights)
        base = portfolio.path(neutral, monthly, config.cost_bps)
        scaled = portfolio.scaled(neutral, portfolio.vol_scalars(base, config.target_vol, config.vol_months, config.vol_cap))
        names = scaled.groupBy("date").agg(F.count_if(F.col("weight") > 0).alias(f"{name}_longs"), F.count_if(F.col("weight") < 0).alias(f"{name}_shorts"))
        net = portfolio.path(scaled, monthly, config.cost_bps).select("date", F.col("net").alias(name), F.col("turnover").alias(f"{name}_turnover")).join(names, "date")
        out = net if out is None else out.join(net, "date")
    return out.where(F.abs("raw") + F.abs("residual") > 0)


def run_gate(returns: DataFrame, market: DataFrame, config: GateConfig = GateConfig()) -> dict[str, object]:
    """The blind summary: correlation, interval, the bound used for power, months, status, turnover, names held and known, and the parameters."""
    paired = sleeves(returns, market, config).persist()
    held = []
    for name in ("raw", "residual"):
        held += [F.avg(f"{name}_turnover").alias(f"{name}_mean_turnover"), (12 * F.avg(f"{name}_turnover")).alias(f"{name}_annual_turnover")]
        held += [F.median(f"{name}_{side}").alias(f"{name}_median_{side}") for side in ("longs", "shorts")]
    try:
        about = paired.agg(F.count("*").alias("n"), correlation(F.col("raw"), F.col("residual")).alias("rho"), F.min("date").alias("first"), F.max("date").alias("last"), *held).first().asDict()
        interval = bootstrap_interval(paired, config.samples, config.block, config.seed).first()
    finally:
        paired.unpersist()
    names = returns.where("ret IS NOT NULL").agg(F.count_distinct("asset")).first()[0]
    if interval["share_known"] < 0.9:
        raise ValueError("the bootstrap correlations are mostly undefined")
    low, high = interval["low"], interval["high"]
    bound = 0.0 if low <= 0 <= high else min((low, high), key=abs)
    need = power_requirement(max(-0.999999, min(0.999999, bound)), config)
    years = config.clean_years
    status = "MEASUREMENT_ONLY" if years is None else "GREENLIGHT" if years >= need["required_years"] else "UNRESOLVABLE"
    return {"months": about["n"], "first": str(about["first"]), "last": str(about["last"]), "rho": about["rho"], "rho_low": low, "rho_high": high, "rho_for_power": bound, "status": status, **need, **{k: v for k, v in about.items() if "turnover" in k or "median" in k}, "names": names, "config": asdict(config)}
