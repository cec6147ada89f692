"""Hourly event study: rolling factor residuals, threshold events with a cooldown, forward returns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import frame, full_sum, series
from crosspanel.operators.regress import stacked
from crosspanel.panel import last_of_each, require_columns


@dataclass(frozen=True)
class StudyConfig:
    factor_window: int = 336
    least_factor_rows: int = 168
    lookback: int = 24
    raw_threshold: float = 0.50
    residual_threshold: float = 0.30
    least_quote_volume: float = 5_000_000.0
    cooldown_hours: int = 24
    horizons: tuple[int, ...] = (1, 4, 12, 24, 72)
    cost_bps: float = 20.0
    ridge: float = 1e-8
    least_alts: int = 5
    anchors: tuple[str, str] = ("BTCUSDT", "ETHUSDT")


def valid_panel(rows: DataFrame, sequence: str | None = None) -> DataFrame:
    """(timestamp, symbol, open, close, quote_volume): typed, upper-case, the last of equal keys; ValueError for a price of 0 or less."""
    require_columns(rows, ["timestamp", "symbol", "open", "close", "quote_volume"], "panel")
    numbers = {c: F.expr(f"nanvl(try_cast({c} AS DOUBLE), NULL)") for c in ("open", "close", "quote_volume")}
    out = rows.withColumns({"timestamp": F.to_timestamp("timestamp"), "symbol": F.upper("symbol")} | numbers)
    if sequence:
        out = last_of_each(out.select("timestamp", "symbol", "open", "close", "quote_volume", sequence), ["timestamp", "symbol"], sequence)
    out = out.select("timestamp", "symbol", "open", "close", "quote_volume")
    if out.where("open <= 0 OR close <= 0").limit(1).count():
        raise ValueError("prices must be positive")
    return out


def hourly_grid(panel: DataFrame) -> DataFrame:
    grid = panel.select("timestamp").distinct().crossJoin(panel.select("symbol").distinct())
    return grid.join(panel, ["timestamp", "symbol"], "left")


def log_returns(grid: DataFrame) -> DataFrame:
    w = series("symbol", order="timestamp")
    return grid.withColumn("ret", F.ln("close") - F.ln(F.lag("close").over(w)))


def factor_rows(returns: DataFrame, config: StudyConfig) -> DataFrame:
    """(timestamp, btc, eth, alt): the anchors' returns and the median of the others, NULL under ``least_alts`` of them."""
    first, second = config.anchors
    alt = F.when(~F.col("symbol").isin(first, second), F.col("ret"))
    pick = lambda s: F.max(F.when(F.col("symbol") == s, F.col("ret")))
    return returns.groupBy("timestamp").agg(pick(first).alias("btc"), pick(second).alias("eth"), F.when(F.count(alt) >= config.least_alts, F.median(alt)).alias("alt"))


def inverses(x: np.ndarray) -> np.ndarray:
    """Of a block of matrices; a singular one has its pseudo-inverse."""
    try:
        return np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(x) if len(x) == 1 else np.concatenate([inverses(half) for half in np.array_split(x, 2)])


def factor_residuals(returns: DataFrame, factors: DataFrame, config: StudyConfig) -> DataFrame:
    """(timestamp, symbol, residual): against a ridge fit on the rows of the window before.

    Each moment is its own sum over the window with its own count; the ones' moment counts every row. The factors' side is
    summed once for each hour and inverted over Arrow batches; symbols join it. A symbol needs its return on every row of the
    window that has all factors.
    """
    window, least = config.factor_window, config.least_factor_rows
    names = ["_one", "btc", "eth", "alt"]
    all_known = F.expr("btc IS NOT NULL AND eth IS NOT NULL AND alt IS NOT NULL")
    # The factor series has one row an hour: one partition of it is small whatever the number of symbols.
    w = frame(-window, -1, "_all", order="timestamp")

    def guarded(value: Column, over) -> Column:
        return F.when(F.count(value).over(over) >= least, F.sum(value).over(over))

    base = factors.withColumns({"_one": F.lit(1.0), "_all": F.lit(1)})
    moments = base.select(
        "timestamp", "btc", "eth", "alt", F.array(*(guarded(F.col(a) * F.col(b), w) for a in names for b in names)).alias("m"), F.count(F.when(all_known, 1)).over(w).alias("factor_rows"),
    )

    @F.pandas_udf("array<double>")
    def inverse(m: pd.Series) -> pd.Series:
        x = stacked(m, 4, 4)
        complete = np.isfinite(x).all((1, 2))
        solved = iter(inverses(x[complete] + np.diag([0.0] + [config.ridge] * 3)))
        return pd.Series([next(solved).ravel().tolist() if c else None for c in complete])

    hours = moments.withColumn("inv", inverse("m"))
    rows = returns.select("timestamp", "symbol", "ret").join(factors, "timestamp").withColumn("_one", F.lit(1.0))
    own = frame(-window, -1, "symbol", order="timestamp")
    sided = rows.select(
        "timestamp", "symbol", "ret", *(guarded(F.col(a) * F.col("ret"), own).alias(f"_x{i}") for i, a in enumerate(names)), F.count(F.when(all_known & F.col("ret").isNotNull(), 1)).over(own).alias("joint"),
    )
    joined = sided.join(hours, "timestamp")
    x = [F.lit(1.0), F.col("btc"), F.col("eth"), F.col("alt")]
    fitted = sum((x[i] * sum((F.get("inv", F.lit(4 * i + j)) * F.col(f"_x{j}") for j in range(4)), F.lit(0.0)) for i in range(4)), F.lit(0.0))
    return joined.select("timestamp", "symbol", F.when((F.col("joint") >= F.col("factor_rows")) & (F.col("joint") >= least), F.col("ret") - fitted).alias("residual"))


def features(panel: DataFrame, config: StudyConfig) -> DataFrame:
    """(timestamp, symbol, open, close, ret, residual, raw_move, residual_move, quote_volume_sum)."""
    returns = log_returns(hourly_grid(panel))
    residuals = factor_residuals(returns, factor_rows(returns, config), config)
    rows = returns.join(residuals, ["timestamp", "symbol"], "left")
    w, n = series("symbol", order="timestamp"), config.lookback
    past = lambda c: full_sum(F.col(c), 1 - n, 0, "symbol", order="timestamp")
    return rows.select(
        "timestamp", "symbol", "open", "close", "ret", "residual", (F.try_divide("close", F.lag("close", n).over(w)) - 1).alias("raw_move"),
        F.expm1(past("residual")).alias("residual_move"), past("quote_volume").alias("quote_volume_sum"),
    )


def cooled(times: Column, hours: int) -> Column:
    """Of ascending seconds those that are first or at least ``hours`` after the last one kept."""
    gap = hours * 3600
    keep = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(t))).otherwise(kept)
    return F.aggregate(F.array_sort(times), F.expr("CAST(array() AS array<bigint>)"), keep)


def events(features: DataFrame, config: StudyConfig) -> DataFrame:
    """(signal, symbol, signal_timestamp, entry_open, asset_fwd_*h, short_net_*h): entry at the next open, exit at later closes.

    A cooldown runs from each kept event, even one that is dropped later for want of an entry price.
    """
    w = series("symbol", order="timestamp")
    ahead = features.select("*", F.lead("open").over(w).alias("entry_open"), *(F.lead("close", h).over(w).alias(f"_exit{h}") for h in config.horizons)).where(~F.col("symbol").isin(*config.anchors))
    liquid = F.col("quote_volume_sum") >= config.least_quote_volume
    rules = {"raw_pump": F.col("raw_move") >= config.raw_threshold, "residual_pump": F.col("residual_move") >= config.residual_threshold}
    signals = F.array_compact(F.array(*(F.when(liquid & hit, F.lit(name)) for name, hit in rules.items())))
    hits = ahead.withColumn("signal", F.explode(signals))
    # A symbol's events are bounded by its hours over the cooldown's rules, not by the panel.
    times = cooled(F.collect_list(F.unix_timestamp("timestamp")), config.cooldown_hours)
    kept = hits.groupBy("symbol", "signal").agg(times.alias("_ts")).select("symbol", "signal", F.explode("_ts").alias("_t"))
    found = hits.withColumn("_t", F.unix_timestamp("timestamp")).join(kept, ["symbol", "signal", "_t"]).where("entry_open > 0 AND NOT isnan(entry_open)")
    cost, out = config.cost_bps / 10_000, []
    for h in config.horizons:
        move = F.try_divide(f"_exit{h}", "entry_open") - 1
        out += [move.alias(f"asset_fwd_{h}h"), (-move - F.lit(cost)).alias(f"short_net_{h}h")]
    return found.select("signal", "symbol", F.col("timestamp").alias("signal_timestamp"), "entry_open", *out)


def event_summary(found: DataFrame, config: StudyConfig) -> DataFrame:
    """(signal, horizon, n, mean, median, hit_rate) of the short side."""
    pairs = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"short_net_{h}h").alias("s")) for h in config.horizons)))
    return found.select("signal", pairs.alias("p")).select("signal", "p.*").groupBy("signal", "horizon").agg(
        F.count("s").alias("n"), F.avg("s").alias("mean"), F.median("s").alias("median"), F.avg((F.col("s") > 0).cast("double")).alias("hit_rate")
    )
