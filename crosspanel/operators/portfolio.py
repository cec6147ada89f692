"""Long/short weights, neutralization, volatility targets, backtests. Equal signals go by asset, ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosspanel.functions.windows import across, full_deviation, ratio, series


def _both_ends(signals: DataFrame, keys: tuple[str, ...], k: Column) -> DataFrame:
    """+1/k for the k highest and -1/k for the k lowest known signals of each key; NULL elsewhere."""
    known = F.col("signal").isNotNull()
    n = F.count("signal").over(across(*keys))
    low = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("signal").asc_nulls_last(), "asset"))
    side = F.when(F.col("_low") > F.col("_n") - F.col("_k"), 1.0 / F.col("_k")).when(F.col("_low") <= F.col("_k"), -1.0 / F.col("_k"))
    return signals.withColumns({"_n": n, "_low": low}).withColumn("_k", k).withColumn("_side", F.when(known & (F.col("_k") >= 1), side))


def global_weights(signals: DataFrame, quantile: float = 0.2, gross: float = 1.0) -> DataFrame:
    """(date, asset, weight): half of the gross on each end of each date; 0 for all others."""
    if not 0 < quantile < 0.5:
        raise ValueError("quantile must lie between 0 and 0.5")
    k = F.least(F.floor(F.col("_n") * F.lit(float(quantile))), F.floor(F.col("_n") / 2))
    return _both_ends(signals, ("date",), k).select("date", "asset", F.coalesce(F.col("_side") * gross / 2, F.lit(0.0)).alias("weight"))


def sector_neutral_weights(signals: DataFrame, quantile: float = 0.2, least: int = 1, gross: float = 1.0) -> DataFrame:
    """(date, asset, weight) from (date, asset, sector, signal): equal ends in each sector, scaled to the gross of the date."""
    if not 0 < quantile < 0.5:
        raise ValueError("quantile must lie between 0 and 0.5")
    k = F.least(F.greatest(F.lit(least), F.floor(F.col("_n") * F.lit(float(quantile)))), F.floor(F.col("_n") / 2))
    sides = _both_ends(signals.where("sector IS NOT NULL"), ("date", "sector"), k)
    total = F.sum(F.abs("_side")).over(across("date"))
    found = sides.select("date", "asset", (F.col("_side") * gross / total).alias("_w"))
    return signals.select("date", "asset").join(found, ["date", "asset"], "left").select("date", "asset", F.coalesce("_w", F.lit(0.0)).alias("weight"))


def beta_neutral(weights: DataFrame, gross: float = 1.0) -> DataFrame:
    """(date, asset, weight) from (date, asset, weight, beta): the nearest weights with sums of w and w*beta 0, scaled to the gross.

    Dates with fewer than 3 active betas, or none that vary, are all 0. Closed form in five sums of each date.
    """
    active = F.when((F.col("weight") != 0) & F.col("beta").isNotNull(), 1.0)
    w, b, over = F.col("weight"), F.col("beta"), across("date")
    sums = {"_n": active, "_b": active * b, "_bb": active * b * b, "_w": active * w, "_wb": active * w * b}
    rows = weights.withColumns({k: F.sum(v).over(over) for k, v in sums.items()}).withColumn("_d", F.col("_n") * F.col("_bb") - F.col("_b") * F.col("_b"))
    a0 = ratio(F.col("_bb") * F.col("_w") - F.col("_b") * F.col("_wb"), F.col("_d"))
    a1 = ratio(F.col("_n") * F.col("_wb") - F.col("_b") * F.col("_w"), F.col("_d"))
    spread = F.sqrt(F.greatest(F.col("_d"), F.lit(0.0))) / F.col("_n")
    moved = F.when((F.col("_n") >= 3) & (spread >= 1e-10), active * (w - a0 - a1 * b))
    scaled = rows.withColumn("_moved", moved).withColumn("_gross", F.sum(F.abs("_moved")).over(over))
    return scaled.select("date", "asset", F.coalesce(F.when(F.col("_gross") > 1e-12, F.col("_moved") * gross / F.col("_gross")), F.lit(0.0)).alias("weight"))


def path(weights: DataFrame, returns: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """(date, gross, turnover, cost, net): weights of one date earn the returns of the next; the first date has no turnover.

    Returns that are missing while a position is held count 0.
    """
    rows = weights.join(returns.select("date", "asset", "ret"), ["date", "asset"], "left")
    held = F.coalesce(F.lag("weight").over(series("asset")), F.lit(0.0))
    moved = F.abs(F.col("_held") - F.lag("_held").over(series("asset")))
    daily = rows.withColumn("_held", held).withColumn("_moved", moved).groupBy("date").agg(
        F.sum(F.col("_held") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.coalesce(F.sum("_moved"), F.lit(0.0)).alias("turnover")
    )
    cost = F.col("turnover") * F.lit(cost_bps / 10_000)
    return daily.select("date", "gross", "turnover", cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def vol_scalars(net: DataFrame, target: float = 0.10, months: int = 12, cap: float = 3.0, periods: float = 12.0) -> DataFrame:
    """(date, scalar): target over the trailing annual deviation, within 0 and the cap; 0 where that is not known or 0.

    The series of one strategy has one row for each month, so that it lies in one partition is no matter of scale.
    """
    vol = full_deviation(F.col("net"), 1 - months, 0, "_all") * F.sqrt(F.lit(periods))
    rows = net.withColumn("_all", F.lit(1)).withColumn("_vol", vol)
    return rows.select("date", F.coalesce(F.least(F.greatest(ratio(F.lit(target), F.nullif(F.col("_vol"), F.lit(0.0))), F.lit(0.0)), F.lit(cap)), F.lit(0.0)).alias("scalar"))


def scaled(weights: DataFrame, scalars: DataFrame) -> DataFrame:
    return weights.join(scalars, "date").select("date", "asset", (F.col("weight") * F.col("scalar")).alias("weight"))
