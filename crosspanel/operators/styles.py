"""Size and value exposures, and the cross-sectional market + styles model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import across, nearest_quantile, ratio, winsorized


def winsor_zscore(rows: DataFrame, name: str, share: float, quantile: str = "nearest") -> DataFrame:
    """The column pulled to its quantiles of each date, less the mean, over the sample deviation."""
    if quantile == "nearest":
        bounds = rows.groupBy("date").agg(nearest_quantile(F.col(name), share).alias("_low"), nearest_quantile(F.col(name), 1 - share).alias("_high"))
        rows = rows.join(bounds, "date").withColumn(name, F.when(F.col(name).isNotNull(), F.least(F.greatest(F.col(name), F.col("_low")), F.col("_high")))).drop("_low", "_high")
    else:
        rows = rows.withColumn(name, winsorized(F.col(name), share, "date"))
    over = across("date")
    return rows.withColumn(name, ratio(F.col(name) - F.avg(name).over(over), F.nullif(F.stddev_samp(name).over(over), F.lit(0.0))))


def style_inputs(panel: DataFrame, share: float = 0.05, least: int = 100, quantile: str = "nearest") -> DataFrame:
    """(date, ticker, ret, market_cap, size, value, sector_all) of dates with enough rows; unknown value counts 0."""
    rows = panel.where(~F.isnan("asset_returns") & (F.abs("asset_returns") < float("inf")) & (F.col("market_cap") > 0) & (F.col("market_cap") < float("inf")))
    rows = rows.select("date", "ticker", F.col("asset_returns").alias("ret"), "market_cap", (-F.ln("market_cap")).alias("size"), F.when(F.col("book_price") > 0, F.ln("book_price")).alias("value"))
    rows = winsor_zscore(winsor_zscore(rows, "size", share, quantile), "value", share, quantile)
    kept = rows.withColumn("value", F.coalesce("value", F.lit(0.0))).where("size IS NOT NULL").withColumn("_n", F.count("*").over(across("date")))
    return kept.where(F.col("_n") >= least).withColumn("sector_all", F.lit(1)).drop("_n")


def _styles(inputs: DataFrame, share: float, power: float) -> DataFrame:
    over = across("date")
    total = lambda c: F.sum(c).over(over)
    v, s, x = F.pow("market_cap", F.lit(power)), F.col("size"), F.col("value")
    rows = inputs.withColumn("_y", winsorized(F.col("ret"), share, "date")).withColumn("_v", v)
    rows = rows.withColumn("market", ratio(total(F.col("_v") * F.col("_y")), total(F.col("_v")))).withColumn("_e", F.col("_y") - F.col("market"))
    w = F.col("_v")
    sums = {"_ss": w * s * s, "_sx": w * s * x, "_xx": w * x * x, "_sy": w * s * F.col("_e"), "_xy": w * x * F.col("_e")}
    return rows.withColumns({k: total(c) for k, c in sums.items()})


def _coefficients() -> tuple[Column, Column]:
    """The two-by-two solution; a single style where the determinant is 0."""
    d = F.col("_ss") * F.col("_xx") - F.col("_sx") * F.col("_sx")
    clear = F.abs(d) > 1e-12 * F.abs(F.col("_ss") * F.col("_xx"))
    size = F.when(clear, ratio(F.col("_xx") * F.col("_sy") - F.col("_sx") * F.col("_xy"), d)).otherwise(F.coalesce(ratio(F.col("_sy"), F.nullif(F.col("_ss"), F.lit(0.0))), F.lit(0.0)))
    value = F.when(clear, ratio(F.col("_ss") * F.col("_xy") - F.col("_sx") * F.col("_sy"), d)).otherwise(F.lit(0.0))
    return size, value


def style_residuals(inputs: DataFrame, share: float = 0.01, power: float = 0.5) -> DataFrame:
    """(date, ticker, residual): winsorized return less market and styles, weights market_cap ** power."""
    size, value = _coefficients()
    return _styles(inputs, share, power).select("date", "ticker", (F.col("_e") - F.col("size") * size - F.col("value") * value).alias("residual"))


def style_factors(inputs: DataFrame, share: float = 0.01, power: float = 0.5) -> DataFrame:
    """(date, market, all_sector, size, value): the constrained sector factor is 0 with one sector."""
    size, value = _coefficients()
    rows = _styles(inputs, share, power).select("date", "market", size.alias("size"), value.alias("value"))
    return rows.groupBy("date").agg(F.first("market").alias("market"), F.lit(0.0).alias("all_sector"), F.first("size").alias("size"), F.first("value").alias("value"))


def legacy_factors(inputs: DataFrame) -> DataFrame:
    """The factors as older notebooks asked for them: a tenth of each tail is pulled in."""
    return style_factors(inputs, share=0.10)
