"""Performance and information coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosspanel.functions.windows import average_rank, correlation, ratio

YEAR = 252.0


def performance(returns: DataFrame, *keys: str, value: str = "net", periods: float = YEAR) -> DataFrame:
    """For each key: n, cagr, volatility, sharpe, max_drawdown, multiple of a return series (date, value).

    Years are counted returns over ``periods``. The equity's own peaks are the base of drawdowns: a first loss is none.
    """
    rows = returns.where(F.col(value).isNotNull()).withColumn("_all", F.lit(1))
    so_far = Window.partitionBy("_all", *keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_equity", F.product(1 + F.col(value)).over(so_far)).withColumn("_peak", F.max("_equity").over(so_far))
    final, n = F.max_by("_equity", "date"), F.count("*")
    spread = F.stddev_samp(value)
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.when(final > 0, F.pow(final, periods / n) - 1).alias("cagr"), (spread * F.sqrt(F.lit(periods))).alias("volatility"),
        (ratio(F.avg(value), F.nullif(spread, F.lit(0.0))) * F.sqrt(F.lit(periods))).alias("sharpe"), F.min(ratio(F.col("_equity"), F.col("_peak")) - 1).alias("max_drawdown"), final.alias("multiple"),
    )


def information_coefficient(signals: DataFrame, returns: DataFrame, least: int = 10) -> DataFrame:
    """(date, n, ic): rank correlation of signals with the next date's returns; NULL under ``least`` pairs."""
    dates = signals.select("date").distinct().withColumn("_all", F.lit(1))
    following = dates.select("date", F.lead("date").over(Window.partitionBy("_all").orderBy("date")).alias("_next"))
    rows = signals.join(following, "date").join(returns.select(F.col("date").alias("_next"), "asset", F.col("ret").alias("_future")), ["_next", "asset"], "left")
    both = F.col("signal").isNotNull() & F.col("_future").isNotNull()
    paired = rows.withColumns({"_a": F.when(both, F.col("signal")), "_b": F.when(both, F.col("_future"))})
    ranked = paired.withColumns({"_ra": average_rank(F.col("_a"), "date"), "_rb": average_rank(F.col("_b"), "date")})
    n = F.count("_a")
    return ranked.groupBy("date").agg(n.alias("n"), F.when(n >= least, correlation(F.col("_ra"), F.col("_rb"))).alias("ic"))


def coefficient_summary(ic: DataFrame) -> DataFrame:
    spread: Column = F.stddev_samp("ic")
    return ic.agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), spread.alias("ic_std"), (ratio(F.avg("ic"), F.nullif(spread, F.lit(0.0))) * F.sqrt(F.lit(YEAR))).alias("ic_ir"))
