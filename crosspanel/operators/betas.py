"""Rolling market betas, each from rows before the date that uses it unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import frame, paired_beta, ratio


def shrunk(raw, shrinkage: float, prior: float = 1.0):
    return F.lit(shrinkage) * F.lit(prior) + (1 - F.lit(shrinkage)) * raw


def lagged_betas(rows: DataFrame, window: int = 252, least: int = 126, shrinkage: float = 0.5, prior: float = 1.0) -> DataFrame:
    """(date, asset, raw_beta, beta) from (date, asset, ret, market): the ``window`` rows before each, where at least ``least`` have both.

    Give a dense grid for windows of dates, observed rows for windows of observations.
    """
    raw = paired_beta(F.col("ret"), F.col("market"), frame(-window, -1, "asset"), least)
    return rows.select("date", "asset", raw.alias("raw_beta")).withColumn("beta", shrunk(F.col("raw_beta"), shrinkage, prior))


def adjusted_residuals(rows: DataFrame, betas: DataFrame) -> DataFrame:
    """(date, asset, residual): return minus beta times market."""
    return rows.join(betas, ["date", "asset"]).select("date", "asset", (F.col("ret") - F.col("beta") * F.col("market")).alias("residual"))


def rolling_beta(rows: DataFrame, window: int = 60, least: int | None = None) -> DataFrame:
    """(date, asset, beta) over the last rows, the date's own among them: covariance of pairs over the variance of all x."""
    least = max(20, window // 2) if least is None else least
    w = frame(1 - window, 0, "asset")
    both = F.col("y").isNotNull() & F.col("x").isNotNull()
    covariance = F.when(F.count(F.when(both, 1)).over(w) >= least, F.covar_samp(F.when(both, F.col("y")), F.when(both, F.col("x"))).over(w))
    variance = F.when(F.count("x").over(w) >= least, F.var_samp("x").over(w))
    return rows.select("date", "asset", ratio(covariance, F.nullif(variance, F.lit(0.0))).alias("beta"))
