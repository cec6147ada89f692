"""Hierarchical return decomposition: market, sector, industry and residual, by weighted means of each date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import across, ratio
from crosspanel.panel import require_columns


def weighted_mean(value: Column, weight: Column) -> Column:
    """Of known values with a positive weight; NULL where there are none."""
    counts = value.isNotNull() & (weight > 0)
    return ratio(F.sum(F.when(counts, weight * value)), F.sum(F.when(counts, weight)))


def check_nesting(classes: DataFrame) -> DataFrame:
    """The frame itself; ValueError where an industry lies in two sectors."""
    bad = classes.where("sector IS NOT NULL AND industry IS NOT NULL").groupBy("industry").agg(F.count_distinct("sector").alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"industries in more than one sector: {[r['industry'] for r in bad]}")
    return classes


def usable(panel: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows with a return, a class and a positive weight; the weight is 1 where none is named."""
    require_columns(panel, ["date", "asset", "ret", "sector", "industry", *([weight] if weight else [])], "panel")
    w = F.col(weight) if weight else F.lit(1.0)
    return panel.where("ret IS NOT NULL AND sector IS NOT NULL AND industry IS NOT NULL").withColumn("weight", w.cast("double")).where("weight > 0")


def _means(rows: DataFrame) -> DataFrame:
    wr, w = F.col("weight") * F.col("ret"), F.col("weight")
    keys = {"_m": ("date",), "_s": ("date", "sector"), "_i": ("date", "industry")}
    return rows.withColumns({name: ratio(F.sum(wr).over(across(*k)), F.sum(w).over(across(*k))) for name, k in keys.items()})


def decompose(panel: DataFrame, weight: str | None = None) -> DataFrame:
    """(date, asset, ret, market, sector_effect, industry_effect, fitted, residual)."""
    rows = _means(usable(panel, weight))
    fitted = F.col("_m") + (F.col("_s") - F.col("_m")) + (F.col("_i") - F.col("_s"))
    return rows.select(
        "date", "asset", "ret", F.col("_m").alias("market"), (F.col("_s") - F.col("_m")).alias("sector_effect"), (F.col("_i") - F.col("_s")).alias("industry_effect"),
        fitted.alias("fitted"), (F.col("ret") - fitted).alias("residual"),
    )


def factor_returns(panel: DataFrame, weight: str | None = None) -> DataFrame:
    """(date, factor, value): MARKET, SECTOR::x and INDUSTRY::x. One pass to industries; the rest sums those up."""
    rows = usable(panel, weight)
    industries = rows.groupBy("date", "sector", "industry").agg(F.sum(F.col("weight") * F.col("ret")).alias("wr"), F.sum("weight").alias("w"))
    sectors = industries.groupBy("date", "sector").agg(F.sum("wr").alias("swr"), F.sum("w").alias("sw"))
    markets = sectors.groupBy("date").agg((F.sum("swr") / F.sum("sw")).alias("market"))
    by_sector = sectors.join(markets, "date")
    by_industry = industries.join(sectors, ["date", "sector"])
    return (
        markets.select("date", F.lit("MARKET").alias("factor"), F.col("market").alias("value"))
        .unionByName(by_sector.select("date", F.concat(F.lit("SECTOR::"), "sector").alias("factor"), (F.col("swr") / F.col("sw") - F.col("market")).alias("value")))
        .unionByName(by_industry.select("date", F.concat(F.lit("INDUSTRY::"), "industry").alias("factor"), (F.col("wr") / F.col("w") - F.col("swr") / F.col("sw")).alias("value")))
    )


def explained(panel: DataFrame, weight: str | None = None) -> DataFrame:
    """(date, r2): weighted share explained; NULL under 2 rows or without variation."""
    rows = _means(usable(panel, weight))
    sse, sst = (F.sum(F.col("weight") * F.pow(F.col("ret") - F.col(c), 2)) for c in ("_i", "_m"))
    return rows.groupBy("date").agg(F.when((F.count("*") >= 2) & (sst > 0), 1 - ratio(sse, sst)).alias("r2"))


def diagnostics(panel: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: mean and median r2, mean absolute and standard deviation of residuals over all cells."""
    fit = decompose(panel, weight).agg(F.avg(F.abs("residual")).alias("mean_abs_residual"), F.stddev_samp("residual").alias("residual_std"))
    return explained(panel, weight).agg(F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2")).crossJoin(fit)
