"""Overlays on the SVXY sleeve: scenarios as rows of one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosspanel.operators.attribution import SLEEVES
from crosspanel.operators.betas import rolling_beta
from crosspanel.operators.metrics import performance

#: The published grid of (name, rule, threshold, scale).
SCENARIOS = (
    ("original", "none", None, 1.0), ("beta>1.00 x0.75", "beta", 1.0, 0.75), ("beta>1.00 x0.50", "beta", 1.0, 0.5), ("beta>1.25 x0.75", "beta", 1.25, 0.75), ("beta>1.25 x0.50", "beta", 1.25, 0.5),
    ("beta>1.50 x0.75", "beta", 1.5, 0.75), ("beta>1.50 x0.50", "beta", 1.5, 0.5), ("beta>1.50 x0.00", "beta", 1.5, 0.0), ("joint-down x0.75", "joint", None, 0.75), ("joint-down x0.50", "joint", None, 0.5), ("joint-down x0.00", "joint", None, 0.0),
)


def streams(daily: DataFrame, scenarios=SCENARIOS, beta_window: int = 60, cost_bps: float = 0.0, least: int | None = None) -> DataFrame:
    """(strategy, date, net, trigger, turnover): the rules look at the day before only; fees of the original stay."""
    for name, _, _, scale in scenarios:
        if not 0 <= scale <= 1:
            raise ValueError(f"the scale of {name} must lie between 0 and 1")
    table = daily.sparkSession.createDataFrame(list(scenarios), "strategy string, rule string, threshold double, scale double")
    series = daily.select("date", F.lit("strategy").alias("asset"), F.col("ret").alias("y"), F.col("r_VTI").alias("x"))
    betas = rolling_beta(series, beta_window, least).select("date", "beta")
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    down = reduce(Column.__and__, (F.col(f"r_{t}") < 0 for t in ("VTI", "TLT", "GLD")))
    days = daily.join(betas, "date").withColumns({"_beta": F.lag("beta").over(w), "_down": F.coalesce(F.lag(down).over(w), F.lit(False))})
    rows = days.crossJoin(F.broadcast(table))  # the scenario table is fixed
    active = F.abs("w_SVXY") > 1e-12
    trigger = F.when(F.col("rule") == "beta", active & F.coalesce(F.col("_beta") > F.col("threshold"), F.lit(False))).when(F.col("rule") == "joint", active & F.col("_down")).otherwise(F.lit(False))
    s = Window.partitionBy("strategy").orderBy("date")
    rows = rows.withColumn("trigger", trigger).withColumn("t_SVXY", F.when(F.col("trigger"), F.col("w_SVXY") * F.col("scale")).otherwise(F.col("w_SVXY")))
    target = {t: F.col("t_SVXY" if t == "SVXY" else f"w_{t}") for t in SLEEVES}
    rows = rows.withColumns({f"_c{t}": F.lag(target[t]).over(s) * F.col(f"r_{t}") for t in SLEEVES} | {"_adj": F.col("t_SVXY") - F.col("w_SVXY")})
    earned = F.when(F.coalesce(*(F.col(f"_c{t}") for t in SLEEVES)).isNotNull(), reduce(Column.__add__, (F.coalesce(f"_c{t}", F.lit(0.0)) for t in SLEEVES)))
    turnover = F.coalesce(F.abs(F.col("_adj") - F.lag("_adj").over(s)), F.abs("_adj"))
    rows = rows.withColumn("turnover", turnover)
    net = earned + F.col("fees") / F.col("prior_nav") - F.col("turnover") * F.lit(cost_bps / 10_000)
    return rows.select("strategy", "date", net.alias("net"), "trigger", "turnover")


def compared(found: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Performance, trigger days and turnover of each strategy, sliced after all derivations."""
    rows = found
    for bound, keep in ((start, lambda b: F.col("date") >= b), (end, lambda b: F.col("date") <= b)):
        if bound:
            rows = rows.where(keep(F.lit(bound).cast("date")))
    extra = rows.groupBy("strategy").agg(F.sum(F.col("trigger").cast("bigint")).alias("trigger_days"), F.avg("turnover").alias("mean_turnover"), F.sum("turnover").alias("total_turnover"))
    return performance(rows, "strategy").join(extra, "strategy")
