"""Momentum and reversal signals, monthly aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import frame, full_deviation, full_growth, full_sum, ratio, series, with_count
from crosspanel.panel import dense, require_columns


def _positive(lookback: int) -> None:
    if lookback < 1:
        raise ValueError("lookback must be at least 1")


def momenta(panel: DataFrame, lookback: int, **names: str) -> DataFrame:
    """(date, asset, names): for each name the sum of its column's last values, all on one dense grid, NULL where one is missing."""
    _positive(lookback)
    sums = {name: full_sum(F.col(value), 1 - lookback, 0, "asset") for name, value in names.items()}
    return dense(panel, *dict.fromkeys(names.values())).select("date", "asset", *(c.alias(name) for name, c in sums.items()))


def momentum(panel: DataFrame, value: str, lookback: int = 20, name: str = "signal") -> DataFrame:
    """(date, asset, signal): sum of the last values on the dense grid, NULL where one is missing."""
    return momenta(panel, lookback, **{name: value})


def reversal(panel: DataFrame, value: str, lookback: int = 5, name: str = "signal") -> DataFrame:
    """The negated momentum."""
    return momentum(panel, value, lookback, name).withColumn(name, -F.col(name))


def monthly_compound(panel: DataFrame, value: str = "ret") -> DataFrame:
    """(date, asset, value) by calendar month end: compounded returns, NULL for a month without any."""
    return panel.groupBy(F.last_day("date").alias("date"), "asset").agg((F.product(1 + F.col(value)) - 1).alias(value))


def monthly_sum(panel: DataFrame, value: str) -> DataFrame:
    return panel.groupBy(F.last_day("date").alias("date"), "asset").agg(F.sum(value).alias(value))


def monthly_last(panel: DataFrame, value: str) -> DataFrame:
    """The last known value of each month."""
    return panel.groupBy(F.last_day("date").alias("date"), "asset").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias(value))


def raw_12_1(monthly: DataFrame, value: str = "ret", formation: int = 11, skip: int = 1) -> DataFrame:
    """(date, asset, signal): growth over the formation months before the skipped ones; all must be known."""
    return dense(monthly, value).withColumn("signal", full_growth(F.col(value), 1 - formation - skip, -skip, "asset")).select("date", "asset", "signal")


def standardized_12_1(monthly: DataFrame, value: str = "residual", formation: int = 11, skip: int = 1) -> DataFrame:
    """(date, asset, signal): sum over sample deviation of the same months; NULL for deviation 0."""
    first, last = 1 - formation - skip, -skip
    total, spread = full_sum(F.col(value), first, last, "asset"), full_deviation(F.col(value), first, last, "asset")
    return dense(monthly, value).withColumns({"_t": total, "_s": spread}).select("date", "asset", F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).alias("signal"))


def monthly_signals(rows: DataFrame, formation: int = 11, skip: int = 1, least_days: int = 1, strict: bool = False) -> DataFrame:
    """(month, symbol, raw, residual, n_obs) from daily (date, symbol, ret, residual).

    Frames count months that a symbol has; the formation months must be consecutive. A hole between them and the
    signal month lengthens the skip, unless ``strict``. The residual signal is the sum over the pooled deviation.
    """
    require_columns(rows, ["date", "symbol", "ret", "residual"], "returns")
    e = F.col("residual")
    months = rows.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(
        F.sum(F.log1p("ret")).alias("g"), F.sum(e).alias("e1"), F.sum(e * e).alias("e2"), F.count("*").alias("n")
    )
    window = frame(-(formation + skip), -(skip + 1), "symbol", order="month")
    ordinal = F.year("month") * 12 + F.month("month")
    w = series("symbol", order="month")
    sums = {f"s_{c}": with_count(F.sum(c), F.col(c), window, formation) for c in ("g", "e1", "e2", "n")}
    spans = {"newest": F.lag(ordinal, skip + 1).over(w), "oldest": F.lag(ordinal, skip + formation).over(w), "own": ordinal}
    held = months.withColumns(sums | spans).where(F.col("newest") - F.col("oldest") == formation - 1)
    if strict:
        held = held.where(F.col("own") - F.col("newest") == skip + 1)
    variance = (F.col("s_e2") - F.col("s_e1") * F.col("s_e1") / F.col("s_n")) / F.nullif(F.col("s_n") - 1, F.lit(0))
    return (
        held.where(F.col("s_n") >= least_days)
        .withColumn("variance", variance)
        .where("variance > 0")
        .select("month", "symbol", F.expm1("s_g").alias("raw"), ratio(F.col("s_e1"), F.sqrt("variance")).alias("residual"), F.col("s_n").cast("bigint").alias("n_obs"))
    )
