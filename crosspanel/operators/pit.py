"""Point-in-time panels: normalized sources, lagged characteristics, coverage gates, mechanical universes.

Windows here go over the rows that a ticker has, not over a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosspanel.functions.windows import frame, nearest_quantile, ratio, series, with_count
from crosspanel.panel import require_columns

CHARACTERISTICS = ("market_cap", "price_to_book", "price_to_earnings", "price_to_sales", "enterprise_value")


def as_date(df: DataFrame, name: str = "date") -> DataFrame:
    return df.withColumn(name, F.to_date(name) if dict(df.dtypes)[name] in ("string", "timestamp", "timestamp_ntz") else F.col(name))


def normalized_bars(bars: DataFrame, prefix: str = "R1000::") -> DataFrame:
    """Typed bars with asset_id and total_return against the last known close of the ticker."""
    require_columns(bars, ["ticker", "date", "close", "is_universe"], "bars")
    doubles = [c for c in ("open", "high", "low", "close", "unadjusted_close", "volume") if c in bars.columns]
    rows = as_date(bars).withColumns({c: F.col(c).cast("double") for c in doubles} | {"is_universe": F.col("is_universe").cast("tinyint"), "asset_id": F.concat(F.lit(prefix), "ticker")})
    before = F.last("close", ignorenulls=True).over(series("ticker").rowsBetween(Window.unboundedPreceding, -1))
    last = F.coalesce(F.col("close"), before)
    return rows.withColumn("total_return", ratio(last, F.nullif(before, F.lit(0.0))) - 1)


def normalized_fundamentals(rows: DataFrame, prefix: str = "R1000::") -> DataFrame:
    require_columns(rows, ["ticker", "date", "market_cap", "price_to_book", "is_universe"], "fundamentals")
    casts = {c: F.col(c).cast("double") for c in CHARACTERISTICS if c in rows.columns}
    return as_date(rows).withColumns(casts | {"is_universe": F.col("is_universe").cast("tinyint"), "asset_id": F.concat(F.lit(prefix), "ticker")})


def lagged_characteristics(rows: DataFrame) -> DataFrame:
    """(ticker, date, lag_*): each characteristic of the ticker's row before."""
    return rows.select("ticker", "date", *(F.lag(c).over(series("ticker")).alias(f"lag_{c}") for c in CHARACTERISTICS if c in rows.columns))


def coverage(bars: DataFrame, lagged: DataFrame) -> DataFrame:
    """(date, n_active, n_market_cap, n_price_to_book, market_cap_coverage, price_to_book_coverage) of active members."""
    active = bars.where("is_universe = 1").select("ticker", "date").join(lagged, ["ticker", "date"], "left")
    n = F.count("*")
    return active.groupBy("date").agg(
        n.alias("n_active"), F.count("lag_market_cap").alias("n_market_cap"), F.count("lag_price_to_book").alias("n_price_to_book"),
        (F.count("lag_market_cap") / n).alias("market_cap_coverage"), (F.count("lag_price_to_book") / n).alias("price_to_book_coverage"),
    )


def coverage_summary(daily: DataFrame) -> DataFrame:
    """One row: least, median and fifth percentile (nearest place) of both ratios."""
    out = []
    for c in ("market_cap_coverage", "price_to_book_coverage"):
        out += [F.min(c).alias(f"min_{c}"), F.median(c).alias(f"median_{c}"), nearest_quantile(F.col(c), 0.05).alias(f"p05_{c}")]
    return daily.agg(*out)


def build_panel(bars: DataFrame, fundamentals: DataFrame, floor: float = 0.90, prefix: str = "R1000::") -> tuple[DataFrame, DataFrame]:
    """(panel, coverage): members on dates where both coverages reach the floor, with lagged market cap and book price. Asset ids are tickers with the prefix."""
    b, f = normalized_bars(bars, prefix), normalized_fundamentals(fundamentals, prefix)
    start = b.agg(F.min("date").alias("d")).crossJoin(f.agg(F.min("date").alias("e"))).select(F.greatest("d", "e").alias("start"))  # one row
    b, f = (x.join(F.broadcast(start), x["date"] >= start["start"]).drop("start") for x in (b, f))
    lagged = lagged_characteristics(f)
    daily = coverage(b, lagged)
    good = daily.where((F.col("market_cap_coverage") >= floor) & (F.col("price_to_book_coverage") >= floor)).select("date")
    rows = b.where("is_universe = 1").join(good, "date", "left_semi").join(lagged, ["ticker", "date"], "left")
    book = F.when(F.col("lag_price_to_book") > 0, 1 / F.col("lag_price_to_book"))
    panel = rows.where("lag_market_cap > 0").select("date", "asset_id", "ticker", F.col("total_return").alias("asset_returns"), F.col("lag_market_cap").alias("market_cap"), book.alias("book_price"))
    return panel, daily


def mechanical_universe(bars: DataFrame, history: DataFrame, least_price: float = 5.0, window: int = 63, least_days: int = 42, least_history: int = 252, least_adv: float = 0.0, top_n: int | None = 3000) -> DataFrame:
    """(date, asset_id, lag_price, lag_adv, lag_history, eligible, liquidity_rank) from rows before each date.

    A missing flag is false. Ranks go by average dollar volume, then asset_id; all are NULL without ``top_n``.
    """
    require_columns(bars, ["date", "asset_id", "close_unadjusted", "volume_unadjusted", "total_return"], "bars")
    dollars = F.col("close_unadjusted") * F.col("volume_unadjusted")
    before = series("asset_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(series("asset_id")) == 1
    rows = bars.withColumn("_d", dollars).select(
        "date", "asset_id", F.lag("close_unadjusted").over(series("asset_id")).alias("lag_price"), with_count(F.avg("_d"), F.col("_d"), frame(-window, -1, "asset_id"), least_days).alias("lag_adv"),
        F.when(~first, F.count("total_return").over(before)).alias("lag_history"),
    )
    rows = rows.join(history.select("date", "asset_id", "is_common_stock", "is_major_exchange"), ["date", "asset_id"], "left")
    checks = F.col("is_common_stock") & F.col("is_major_exchange") & (F.col("lag_price") >= least_price) & (F.col("lag_adv") >= least_adv) & (F.col("lag_history") >= least_history)
    rows = rows.withColumn("eligible", F.coalesce(checks, F.lit(False)))
    if top_n is None:
        return rows.select("date", "asset_id", "lag_price", "lag_adv", "lag_history", "eligible", F.lit(None).cast("int").alias("liquidity_rank"))
    order = Window.partitionBy("date", "eligible").orderBy(F.col("lag_adv").desc(), "asset_id")
    rank = F.when(F.col("eligible"), F.row_number().over(order))
    ranked = rows.withColumn("liquidity_rank", rank)
    return ranked.select("date", "asset_id", "lag_price", "lag_adv", "lag_history", (F.col("eligible") & (F.col("liquidity_rank") <= top_n)).alias("eligible"), "liquidity_rank")
