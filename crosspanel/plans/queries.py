"""Queries of the operators on derived panels, with SQL for the same results. Doubles are rounded at the end only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.operators import attribution, betas, events, metrics, overlay, pit, portfolio, regress, risk_model, signals, styles
from crosspanel.panel import aligned, dense, latest, outer_aligned, wide
from crosspanel.plans import fixtures, gate
from crosspanel.sources.readers import returns_of
from crosspanel.sources.store import audit, ever_missing, universe_sizes, years_of_history

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 8
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = DIGITS):
    """Registers a function as a query; its doubles are rounded, as ``sql`` does with ``@(x)``."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def final(ctes: str, table: str, *columns: str, digits: int = DIGITS) -> str:
    """WITH ... SELECT columns; a column named ``x!`` is a double to be rounded."""
    listed = [f"ROUND({c[:-1]}, {digits}) + 0 AS {c[:-1]}" if c.endswith("!") else c for c in columns]
    return f"WITH {ctes} SELECT {', '.join(listed)} FROM {table}"


# Weekly panel ---------------------------------------------------------------------------------------------------------------------

PX = f"px AS ({fixtures.bare(fixtures.PX_WEEK)})"
RET = f"""{PX}, grid AS (SELECT d.date, a.ticker AS asset, a.sector, a.industry FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (SELECT DISTINCT ticker, sector, industry FROM px) a),
r AS (SELECT g.date, g.asset, g.sector, g.industry, p.market_cap, p.close / LAG(p.close) OVER (PARTITION BY g.asset ORDER BY g.date) - 1 AS ret
  FROM grid g LEFT JOIN px p ON p.date = g.date AND p.ticker = g.asset)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, sf_dir, fixtures.PX_WEEK)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, asset, ret, sector, industry, market_cap) on the grid."""
    px = prices(spark, sf_dir)
    classes = px.select(F.col("ticker").alias("asset"), "sector", "industry").distinct()
    return returns_of(px, keep=["market_cap"]).join(F.broadcast(risk_model.check_nesting(classes)), "asset").select("date", "asset", "ret", "sector", "industry", "market_cap")  # 25 brands


MODEL = f"""{RET}, u AS (SELECT * FROM r WHERE ret IS NOT NULL),
m AS (SELECT *, AVG(ret) OVER (PARTITION BY date) AS m, AVG(ret) OVER (PARTITION BY date, sector) AS s, AVG(ret) OVER (PARTITION BY date, industry) AS i FROM u),
res AS (SELECT date, asset, sector, ret, m AS market, s - m AS sector_effect, i - s AS industry_effect, i AS fitted, ret - i AS residual FROM m)"""


@query(final(MODEL, "res", "date", "asset", "ret!", "market!", "sector_effect!", "industry_effect!", "fitted!", "residual!"))
def risk_model_residuals(spark, sf_dir):
    return risk_model.decompose(weekly(spark, sf_dir))


@query(final(f"""{RET}, u AS (SELECT * FROM r WHERE ret IS NOT NULL AND market_cap > 0),
i AS (SELECT date, sector, industry, SUM(market_cap * ret) / SUM(market_cap) AS v FROM u GROUP BY 1, 2, 3),
s AS (SELECT date, sector, SUM(market_cap * ret) / SUM(market_cap) AS v FROM u GROUP BY 1, 2),
m AS (SELECT date, SUM(market_cap * ret) / SUM(market_cap) AS v FROM u GROUP BY 1),
f AS (SELECT date, 'MARKET' AS factor, v AS value FROM m UNION ALL SELECT s.date, 'SECTOR::' || s.sector, s.v - m.v FROM s JOIN m USING (date)
  UNION ALL SELECT i.date, 'INDUSTRY::' || i.industry, i.v - s.v FROM i JOIN s ON i.date = s.date AND i.sector = s.sector)""", "f", "date", "factor", "value!"))
def risk_model_factors_weighted(spark, sf_dir):
    return risk_model.factor_returns(weekly(spark, sf_dir), "market_cap")


R2 = f"""{MODEL}, q AS (SELECT date, CASE WHEN COUNT(*) >= 2 AND SUM(power(ret - market, 2)) > 0 THEN 1 - SUM(power(residual, 2)) / SUM(power(ret - market, 2)) END AS r2 FROM res GROUP BY 1)"""


@query(final(R2, "q", "date", "r2!"))
def risk_model_r2(spark, sf_dir):
    return risk_model.explained(weekly(spark, sf_dir))


@query(final(f"{R2}, d AS (SELECT AVG(ABS(residual)) AS mean_abs_residual, STDDEV_SAMP(residual) AS residual_std FROM res), e AS (SELECT AVG(r2) AS mean_r2, MEDIAN(r2) AS median_r2 FROM q)", "d CROSS JOIN e", "mean_r2!", "median_r2!", "mean_abs_residual!", "residual_std!"))
def risk_model_diagnostics(spark, sf_dir):
    return risk_model.diagnostics(weekly(spark, sf_dir))


SIG = f"""{MODEL}, rg AS (SELECT g.date, g.asset, g.sector, res.residual, r.ret FROM grid g LEFT JOIN res ON g.date = res.date AND g.asset = res.asset LEFT JOIN r ON g.date = r.date AND g.asset = r.asset WHERE g.date IN (SELECT date FROM res)),
sig AS (SELECT date, asset, sector, CASE WHEN COUNT(residual) OVER w = 4 THEN ROUND(SUM(residual) OVER w, 10) + 0 END AS signal, CASE WHEN COUNT(ret) OVER w = 4 THEN SUM(ret) OVER w END AS raw
  FROM rg WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def residual_signal(spark, sf_dir):
    """Rounded, so that signals which differ in their last bits only are ties in either engine."""
    signal = signals.momentum(risk_model.decompose(weekly(spark, sf_dir)), "residual", 4)
    return signal.withColumn("signal", F.round("signal", 10) + F.lit(0.0))


@query(final(f"{SIG}, o AS (SELECT date, asset, signal AS momentum, -signal AS reversal, raw FROM sig)", "o", "date", "asset", "momentum!", "reversal!", "raw!", digits=10), digits=10)
def momentum_signals(spark, sf_dir):
    found = signals.momenta(risk_model.decompose(weekly(spark, sf_dir)), 4, momentum="residual", raw="ret")
    momentum = F.round("momentum", 10) + F.lit(0.0)
    return found.select("date", "asset", momentum.alias("momentum"), (-momentum).alias("reversal"), "raw")


SECTOR_W = f"""{SIG}, k AS (SELECT *, COUNT(signal) OVER (PARTITION BY date, sector) AS n, ROW_NUMBER() OVER (PARTITION BY date, sector ORDER BY signal ASC NULLS LAST, asset) AS lo FROM sig),
l AS (SELECT *, LEAST(GREATEST(1, FLOOR(n * CAST(0.2 AS DOUBLE))), FLOOR(n / 2.0)) AS k FROM k),
e AS (SELECT *, CASE WHEN signal IS NOT NULL AND k >= 1 THEN CASE WHEN lo > n - k THEN 1.0 / k WHEN lo <= k THEN -1.0 / k END END AS side FROM l),
w AS (SELECT date, asset, COALESCE(side / SUM(ABS(side)) OVER (PARTITION BY date), CAST(0 AS DOUBLE)) AS weight FROM e)"""


@query(final(SECTOR_W, "w", "date", "asset", "weight!"))
def sector_neutral_weights(spark, sf_dir):
    classes = weekly(spark, sf_dir).select("asset", "sector").distinct()
    return portfolio.sector_neutral_weights(residual_signal(spark, sf_dir).join(classes, "asset"))


GLOBAL_W = f"""{SIG}, k AS (SELECT *, COUNT(signal) OVER (PARTITION BY date) AS n, ROW_NUMBER() OVER (PARTITION BY date ORDER BY signal ASC NULLS LAST, asset) AS lo FROM sig),
l AS (SELECT *, LEAST(FLOOR(n * CAST(0.2 AS DOUBLE)), FLOOR(n / 2.0)) AS k FROM k),
w AS (SELECT date, asset, COALESCE(CASE WHEN signal IS NOT NULL AND k >= 1 THEN CASE WHEN lo > n - k THEN 0.5 / k WHEN lo <= k THEN -0.5 / k END END, CAST(0 AS DOUBLE)) AS weight FROM l)"""


@query(final(GLOBAL_W, "w", "date", "asset", "weight!"))
def global_weights(spark, sf_dir):
    return portfolio.global_weights(residual_signal(spark, sf_dir))


PATH = """, h AS (SELECT w.date, w.asset, COALESCE(LAG(w.weight) OVER (PARTITION BY w.asset ORDER BY w.date), CAST(0 AS DOUBLE)) AS held, r.ret FROM w LEFT JOIN r ON w.date = r.date AND w.asset = r.asset),
c AS (SELECT *, ABS(held - LAG(held) OVER (PARTITION BY asset ORDER BY date)) AS moved FROM h),
p AS (SELECT date, SUM(held * COALESCE(ret, CAST(0 AS DOUBLE))) AS gross, COALESCE(SUM(moved), CAST(0 AS DOUBLE)) AS turnover FROM c GROUP BY 1),
bt AS (SELECT date, gross, turnover, turnover * CAST(0.0005 AS DOUBLE) AS cost, gross - turnover * CAST(0.0005 AS DOUBLE) AS net FROM p)"""


def backtested(spark, sf_dir):
    return portfolio.path(portfolio.global_weights(residual_signal(spark, sf_dir)), weekly(spark, sf_dir), 5.0)


@query(final(GLOBAL_W + PATH, "bt", "date", "gross!", "turnover!", "cost!", "net!"))
def backtest(spark, sf_dir):
    return backtested(spark, sf_dir)


PERFORMANCE = """, eq AS (SELECT *, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM bt WHERE net IS NOT NULL),
pk AS (SELECT *, MAX(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
pf AS (SELECT COUNT(*) AS n, CASE WHEN MAX_BY(e, date) > 0 THEN power(MAX_BY(e, date), 252.0 / COUNT(*)) - 1 END AS cagr, STDDEV_SAMP(net) * sqrt(252.0) AS volatility,
  AVG(net) / NULLIF(STDDEV_SAMP(net), 0) * sqrt(252.0) AS sharpe, MIN(e / peak - 1) AS max_drawdown, MAX_BY(e, date) AS multiple FROM pk)"""


@query(final(GLOBAL_W + PATH + PERFORMANCE, "pf", "n", "cagr!", "volatility!", "sharpe!", "max_drawdown!", "multiple!", digits=6), digits=6)
def performance_summary(spark, sf_dir):
    return metrics.performance(backtested(spark, sf_dir))


IC = f"""{SIG}, dn AS (SELECT date, LEAD(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM sig)),
pr AS (SELECT s.date, CASE WHEN r.ret IS NOT NULL THEN s.signal END AS a, CASE WHEN s.signal IS NOT NULL THEN r.ret END AS b
  FROM sig s JOIN dn ON s.date = dn.date LEFT JOIN r ON r.date = dn.nxt AND r.asset = s.asset),
rk AS (SELECT date, a, RANK() OVER (PARTITION BY date ORDER BY a NULLS LAST) + (COUNT(*) OVER (PARTITION BY date, a) - 1) / 2.0 AS ra, RANK() OVER (PARTITION BY date ORDER BY b NULLS LAST) + (COUNT(*) OVER (PARTITION BY date, b) - 1) / 2.0 AS rb FROM pr),
ic AS (SELECT date, COUNT(a) AS n, CASE WHEN COUNT(a) >= 10 THEN COVAR_SAMP(ra, rb) FILTER (a IS NOT NULL) / NULLIF(STDDEV_SAMP(ra) FILTER (a IS NOT NULL) * STDDEV_SAMP(rb) FILTER (a IS NOT NULL), 0) END AS ic FROM rk GROUP BY 1)"""


@query(final(IC, "ic", "date", "n", "ic!"))
def information_coefficient(spark, sf_dir):
    return metrics.information_coefficient(residual_signal(spark, sf_dir), weekly(spark, sf_dir))


@query(final(f"{IC}, o AS (SELECT COUNT(ic) AS n, AVG(ic) AS mean_ic, STDDEV_SAMP(ic) AS ic_std, AVG(ic) / NULLIF(STDDEV_SAMP(ic), 0) * sqrt(252.0) AS ic_ir FROM ic)", "o", "n", "mean_ic!", "ic_std!", "ic_ir!"))
def ic_summary(spark, sf_dir):
    return metrics.coefficient_summary(metrics.information_coefficient(residual_signal(spark, sf_dir), weekly(spark, sf_dir)))


# Betas and the gate ---------------------------------------------------------------------------------------------------------------

BETA = f"""{RET}, mk AS (SELECT date, AVG(ret) AS market FROM r GROUP BY 1), rm AS (SELECT r.*, mk.market FROM r JOIN mk USING (date)),
pb AS (SELECT date, asset, ret, market, CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN market END AS x FROM rm),
b0 AS (SELECT date, asset, ret, market, CASE WHEN COUNT(x) OVER w >= 26 AND VAR_SAMP(x) OVER w > 0 THEN COVAR_SAMP(y, x) OVER w / VAR_SAMP(x) OVER w END AS raw_beta
  FROM pb WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
bb AS (SELECT *, 0.5 + 0.5 * raw_beta AS beta FROM b0)"""


def with_market(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    return panel.join(panel.groupBy("date").agg(F.avg("ret").alias("market")), "date")


def weekly_betas(spark, sf_dir):
    return betas.lagged_betas(with_market(spark, sf_dir), 52, 26)


@query(final(BETA, "bb", "date", "asset", "raw_beta!", "beta!"))
def lagged_betas(spark, sf_dir):
    return weekly_betas(spark, sf_dir)


@query(final(f"{BETA}, o AS (SELECT date, asset, ret - beta * market AS residual FROM bb)", "o", "date", "asset", "residual!"))
def beta_residuals(spark, sf_dir):
    return betas.adjusted_residuals(with_market(spark, sf_dir), weekly_betas(spark, sf_dir))


MONTHLY = f"""{BETA}, mr AS (SELECT last_day(date) AS date, asset, CASE WHEN COUNT(ret) > 0 THEN product(1 + ret) - 1 END AS ret, SUM(ret - beta * market) AS residual,
  MAX_BY(beta, date) FILTER (beta IS NOT NULL) AS beta FROM bb GROUP BY 1, 2),
ms AS (SELECT *, CASE WHEN COUNT(ret) OVER w = 11 THEN product(1 + ret) OVER w - 1 END AS raw, CASE WHEN COUNT(residual) OVER w = 11 AND STDDEV_SAMP(residual) OVER w > 0 THEN SUM(residual) OVER w / STDDEV_SAMP(residual) OVER w END AS std
  FROM mr WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING))"""


@query(final(MONTHLY, "mr", "date", "asset", "ret!", "residual!", "beta!"))
def monthly_panel(spark, sf_dir):
    panel, beta = weekly(spark, sf_dir), weekly_betas(spark, sf_dir)
    residual = signals.monthly_sum(betas.adjusted_residuals(with_market(spark, sf_dir), beta), "residual")
    return signals.monthly_compound(panel).join(residual, ["date", "asset"]).join(signals.monthly_last(beta, "beta"), ["date", "asset"])


@query(final(f"{MONTHLY}, o AS (SELECT date, asset, raw, std AS residual FROM ms)", "o", "date", "asset", "raw!", "residual!", digits=6), digits=6)
def signals_12_1(spark, sf_dir):
    monthly = monthly_panel(spark, sf_dir)
    raw = signals.raw_12_1(monthly).withColumnRenamed("signal", "raw")
    return raw.join(signals.standardized_12_1(monthly).withColumnRenamed("signal", "residual"), ["date", "asset"])


NEUTRAL = f"""{MONTHLY}, k AS (SELECT *, COUNT(raw) OVER (PARTITION BY date) AS n, ROW_NUMBER() OVER (PARTITION BY date ORDER BY raw ASC NULLS LAST, asset) AS lo FROM ms),
l AS (SELECT *, LEAST(FLOOR(n * CAST(0.2 AS DOUBLE)), FLOOR(n / 2.0)) AS k FROM k),
g AS (SELECT date, asset, beta, COALESCE(CASE WHEN raw IS NOT NULL AND k >= 1 THEN CASE WHEN lo > n - k THEN 0.5 / k WHEN lo <= k THEN -0.5 / k END END, CAST(0 AS DOUBLE)) AS weight FROM l),
a AS (SELECT date, AVG(beta) AS mb, AVG(weight) AS mw, COUNT(*) AS n, SUM(weight * beta) AS swb, SUM(beta * beta) AS sbb FROM g WHERE weight <> 0 AND beta IS NOT NULL GROUP BY 1),
v AS (SELECT g.date, g.asset, CASE WHEN g.weight <> 0 AND g.beta IS NOT NULL AND a.n >= 3 AND a.sbb - a.n * a.mb * a.mb > 1e-18 THEN g.weight - a.mw - (a.swb - a.n * a.mw * a.mb) / (a.sbb - a.n * a.mb * a.mb) * (g.beta - a.mb) END AS x FROM g LEFT JOIN a USING (date)),
w AS (SELECT date, asset, COALESCE(x / NULLIF(SUM(ABS(x)) OVER (PARTITION BY date), 0), CAST(0 AS DOUBLE)) AS weight FROM v)"""


def neutral_weights(spark, sf_dir):
    monthly = monthly_panel(spark, sf_dir)
    weights = portfolio.global_weights(signals.raw_12_1(monthly))
    return portfolio.beta_neutral(weights.join(monthly.select("date", "asset", "beta"), ["date", "asset"])), monthly


@query(final(NEUTRAL, "w", "date", "asset", "weight!", digits=6), digits=6)
def beta_neutral_weights(spark, sf_dir):
    return neutral_weights(spark, sf_dir)[0]


@query(final(NEUTRAL + PATH.replace("LEFT JOIN r ", "LEFT JOIN mr r ") + """, vt AS (SELECT date, CASE WHEN COUNT(net) OVER w = 12 THEN STDDEV_SAMP(net) OVER w * sqrt(12.0) END AS vol FROM bt WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
o AS (SELECT date, CASE WHEN vol > 0 THEN LEAST(0.1 / vol, 3.0) ELSE CAST(0 AS DOUBLE) END AS scalar FROM vt)""", "o", "date", "scalar!", digits=5), digits=5)
def vol_scalars(spark, sf_dir):
    weights, monthly = neutral_weights(spark, sf_dir)
    return portfolio.vol_scalars(portfolio.path(weights, monthly, 5.0))


@query()
def gate_interval(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    config = gate.GateConfig(beta_window=52, least_beta=26)
    paired = gate.sleeves(panel, panel.groupBy("date").agg(F.avg("ret").alias("market")), config)
    return gate.bootstrap_interval(paired, config.samples, config.block, config.seed)


# Point-in-time --------------------------------------------------------------------------------------------------------------------

LAGS = f"""{PX}, lg AS (SELECT date, ticker, LAG(market_cap) OVER (PARTITION BY ticker ORDER BY date) AS mc, LAG(price_to_book) OVER (PARTITION BY ticker ORDER BY date) AS pb,
  close / LAG(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, close, volume, is_universe FROM px),
cv AS (SELECT date, COUNT(*) AS n_active, COUNT(mc) AS n_market_cap, COUNT(pb) AS n_price_to_book, COUNT(mc) / CAST(COUNT(*) AS DOUBLE) AS market_cap_coverage, COUNT(pb) / CAST(COUNT(*) AS DOUBLE) AS price_to_book_coverage
  FROM lg WHERE is_universe = 1 GROUP BY 1),
pn AS (SELECT date, 'R1000::' || ticker AS asset_id, ticker, ret AS asset_returns, mc AS market_cap, CASE WHEN pb > 0 THEN 1 / pb END AS book_price
  FROM lg JOIN cv USING (date) WHERE is_universe = 1 AND mc > 0 AND market_cap_coverage >= 0.9 AND price_to_book_coverage >= 0.9)"""


@query(final(LAGS, "cv", "date", "n_active", "n_market_cap", "n_price_to_book", "market_cap_coverage!", "price_to_book_coverage!"))
def pit_coverage(spark, sf_dir):
    px = prices(spark, sf_dir)
    return pit.build_panel(px, px)[1]


def at_place(column: str, share: float) -> str:
    return f"list_sort(LIST({column}) FILTER ({column} IS NOT NULL))[CAST(floor({share} * (COUNT({column}) - 1) + 0.5) AS INT) + 1]"


RATIOS = ("market_cap_coverage", "price_to_book_coverage")


@query(final(f"""{LAGS}, su AS (SELECT {", ".join(f"MIN({c}) AS min_{c}, MEDIAN({c}) AS median_{c}, {at_place(c, 0.05)} AS p05_{c}" for c in RATIOS)} FROM cv)""", "su", *(f"{k}_{c}!" for c in RATIOS for k in ("min", "median", "p05"))))
def pit_coverage_summary(spark, sf_dir):
    px = prices(spark, sf_dir)
    return pit.coverage_summary(pit.build_panel(px, px)[1])


@query(final(f"""{RET}, {LAGS.removeprefix(PX + ", ")}, dd AS (SELECT date FROM r INTERSECT SELECT date FROM pn), aa AS (SELECT asset FROM r INTERSECT SELECT ticker FROM pn),
al AS (SELECT dd.date, aa.asset, r.ret, pn.market_cap FROM dd CROSS JOIN aa LEFT JOIN r ON r.date = dd.date AND r.asset = aa.asset LEFT JOIN pn ON pn.date = dd.date AND pn.ticker = aa.asset)""", "al", "date", "asset", "ret!", "market_cap!", digits=6), digits=6)
def aligned_panels(spark, sf_dir):
    """Returns and point-in-time market caps on the dates and assets that both have."""
    right = pit_panel(spark, sf_dir).select("date", F.col("ticker").alias("asset"), "market_cap")
    return aligned(weekly(spark, sf_dir).select("date", "asset", "ret"), right)


@query(f"{final(LAGS, 'pn', 'date', 'asset_id', 'ticker', 'asset_returns!', 'market_cap!', 'book_price!', digits=6)}", digits=6)
def pit_panel(spark, sf_dir):
    px = prices(spark, sf_dir)
    return pit.build_panel(px, px)[0]


STYLE = f"""{LAGS}, s0 AS (SELECT date, ticker, asset_returns AS ret, market_cap, -ln(market_cap) AS s, CASE WHEN book_price > 0 THEN ln(book_price) END AS v FROM pn WHERE asset_returns IS NOT NULL),
s1 AS (SELECT *, QUANTILE_CONT(s, 0.05) OVER (PARTITION BY date) AS s5, QUANTILE_CONT(s, 0.95) OVER (PARTITION BY date) AS s95, QUANTILE_CONT(v, 0.05) OVER (PARTITION BY date) AS v5, QUANTILE_CONT(v, 0.95) OVER (PARTITION BY date) AS v95,
  COUNT(s) OVER (PARTITION BY date) AS ns, COUNT(v) OVER (PARTITION BY date) AS nv FROM s0),
s2 AS (SELECT date, ticker, ret, market_cap, CASE WHEN ns < 3 THEN s ELSE GREATEST(LEAST(s, s95), s5) END AS s, CASE WHEN v IS NULL OR nv < 3 THEN v ELSE GREATEST(LEAST(v, v95), v5) END AS v FROM s1),
s3 AS (SELECT date, ticker, ret, market_cap, (s - AVG(s) OVER (PARTITION BY date)) / NULLIF(STDDEV_SAMP(s) OVER (PARTITION BY date), 0) AS size,
  COALESCE((v - AVG(v) OVER (PARTITION BY date)) / NULLIF(STDDEV_SAMP(v) OVER (PARTITION BY date), 0), CAST(0 AS DOUBLE)) AS value FROM s2),
st AS (SELECT *, COUNT(*) OVER (PARTITION BY date) AS n FROM s3 WHERE size IS NOT NULL)"""


def styled(spark, sf_dir):
    px = prices(spark, sf_dir)
    return styles.style_inputs(pit.build_panel(px, px)[0], least=10, quantile="linear")


@query(final(STYLE, "st WHERE n >= 10", "date", "ticker", "ret!", "size!", "value!", digits=6), digits=6)
def style_inputs(spark, sf_dir):
    return styled(spark, sf_dir).select("date", "ticker", "ret", "size", "value")


FIT = f"""{STYLE}, f0 AS (SELECT *, QUANTILE_CONT(ret, 0.01) OVER (PARTITION BY date) AS lo, QUANTILE_CONT(ret, 0.99) OVER (PARTITION BY date) AS hi, sqrt(market_cap) AS w FROM st WHERE n >= 10),
f1 AS (SELECT *, GREATEST(LEAST(ret, hi), lo) AS y FROM f0), f2 AS (SELECT *, SUM(w * y) OVER (PARTITION BY date) / SUM(w) OVER (PARTITION BY date) AS market FROM f1),
f3 AS (SELECT date, ANY_VALUE(market) AS market, SUM(w*size*size) AS ss, SUM(w*size*value) AS sx, SUM(w*value*value) AS xx, SUM(w*size*(y-market)) AS sy, SUM(w*value*(y-market)) AS xy FROM f2 GROUP BY 1),
fc AS (SELECT date, market, CAST(0 AS DOUBLE) AS all_sector, CASE WHEN ABS(ss*xx-sx*sx) > 1e-12*ABS(ss*xx) THEN (xx*sy-sx*xy)/(ss*xx-sx*sx) ELSE COALESCE(sy/NULLIF(ss,0), CAST(0 AS DOUBLE)) END AS size,
  CASE WHEN ABS(ss*xx-sx*sx) > 1e-12*ABS(ss*xx) THEN (ss*xy-sx*sy)/(ss*xx-sx*sx) ELSE CAST(0 AS DOUBLE) END AS value FROM f3)"""


@query(final(FIT, "fc", "date", "market!", "all_sector!", "size!", "value!", digits=6), digits=6)
def style_factors(spark, sf_dir):
    return styles.style_factors(styled(spark, sf_dir))


@query(final(FIT.replace("ret, 0.01)", "ret, 0.10)").replace("ret, 0.99)", "ret, 0.90)"), "fc", "date", "market!", "all_sector!", "size!", "value!", digits=6), digits=6)
def legacy_style_factors(spark, sf_dir):
    return styles.legacy_factors(styled(spark, sf_dir))


RESID = f"{FIT}, rs AS (SELECT f2.date, f2.ticker, f2.ret, f2.y - f2.market - f2.size * fc.size - f2.value * fc.value AS residual FROM f2 JOIN fc USING (date))"


@query(final(RESID, "rs", "date", "ticker", "residual!", digits=6), digits=6)
def style_residuals(spark, sf_dir):
    return styles.style_residuals(styled(spark, sf_dir))


@query(final(f"""{RESID}, mm AS (SELECT ticker AS symbol, CAST(date_trunc('month', date) AS DATE) AS month, SUM(ln(1 + ret)) AS g, SUM(residual) AS e1, SUM(residual * residual) AS e2, COUNT(*) AS n FROM rs GROUP BY 1, 2),
mo AS (SELECT *, year(month) * 12 + month(month) AS o FROM mm),
mw AS (SELECT *, COUNT(g) OVER w AS c, SUM(g) OVER w AS sg, SUM(e1) OVER w AS s1, SUM(e2) OVER w AS s2, SUM(n) OVER w AS sn, LAG(o, 2) OVER (PARTITION BY symbol ORDER BY month) AS nw, LAG(o, 6) OVER (PARTITION BY symbol ORDER BY month) AS od
  FROM mo WINDOW w AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING)),
o AS (SELECT month, symbol, exp(sg) - 1 AS raw, s1 / sqrt((s2 - s1 * s1 / sn) / (sn - 1)) AS residual, CAST(sn AS BIGINT) AS n_obs FROM mw WHERE c = 5 AND nw - od = 4 AND sn > 1 AND (s2 - s1 * s1 / sn) / (sn - 1) > 0)""",
    "o", "month", "symbol", "raw!", "residual!", "n_obs", digits=5), digits=5)
def monthly_signals_6_1(spark, sf_dir):
    inputs = styled(spark, sf_dir)
    rows = styles.style_residuals(inputs).join(inputs.select("date", "ticker", "ret"), ["date", "ticker"]).withColumnRenamed("ticker", "symbol")
    return signals.monthly_signals(rows, formation=5, skip=1)


@query(final(f"""{LAGS}, b AS (SELECT date, ticker AS asset_id, LAG(close) OVER t AS lag_price, CASE WHEN COUNT(close * volume) OVER w >= 8 THEN AVG(close * volume) OVER w END AS lag_adv,
  CASE WHEN ROW_NUMBER() OVER t > 1 THEN COUNT(ret) OVER h END AS lag_history, is_universe FROM lg
  WINDOW t AS (PARTITION BY ticker ORDER BY date), w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, COALESCE(is_universe = 1 AND lag_price >= 5 AND lag_adv >= 0 AND lag_history >= 26, FALSE) AS ok FROM b),
rk AS (SELECT *, CASE WHEN ok THEN ROW_NUMBER() OVER (PARTITION BY date, ok ORDER BY lag_adv DESC, asset_id) END AS rank FROM e),
o AS (SELECT date, asset_id, ROUND(lag_price + 1e-9, 7) AS lag_price, ROUND(lag_adv, 7) AS lag_adv, lag_history, ok AND rank <= 15 AS eligible, CAST(rank AS INT) AS liquidity_rank FROM rk)""",
    "o", "date", "asset_id", "lag_price!", "lag_adv!", "lag_history", "eligible", "liquidity_rank"))
def mechanical_universe(spark, sf_dir):
    rows = pit.normalized_bars(prices(spark, sf_dir), prefix="")
    bars = rows.select("date", "asset_id", F.col("close").alias("close_unadjusted"), F.col("volume").alias("volume_unadjusted"), "total_return")
    history = rows.select("date", "asset_id", (F.col("is_universe") == 1).alias("is_common_stock"), F.lit(True).alias("is_major_exchange"))
    return pit.mechanical_universe(bars, history, window=13, least_days=8, least_history=26, top_n=15).withColumns({"eligible": F.coalesce("eligible", F.lit(False)), "lag_price": F.round(F.col("lag_price") + 1e-9, 7), "lag_adv": F.round("lag_adv", 7)})  # quotients may end in an exact half


@query(final(f"""{PX}, n AS (SELECT date, COUNT(*) AS n FROM px WHERE is_universe = 1 GROUP BY 1), o AS (SELECT CAST(year(date) AS INT) AS year, MIN(n) AS least, MEDIAN(n) AS median, MAX(n) AS most FROM n GROUP BY 1)""", "o", "year", "least", "median!", "most"))
def audit_universe_sizes(spark, sf_dir):
    return universe_sizes(prices(spark, sf_dir))


@query(final(f"""{PX}, a AS (SELECT COUNT(*) AS rows, COUNT(DISTINCT ticker) AS keys, MIN(date) AS first, MAX(date) AS last FROM px),
o AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS nulls FROM px" for c in ("date", "ticker", "market_cap", "price_to_book"))})""", "o CROSS JOIN a", "column_name", "nulls", "rows", "keys", "first", "last"))
def audit_nulls(spark, sf_dir):
    return audit(prices(spark, sf_dir).select("date", "ticker", "market_cap", "price_to_book")).withColumnRenamed("column", "column_name")


@query(final(f"{PX}, dy AS (SELECT date, COUNT(*) AS n FROM px WHERE is_universe = 1 GROUP BY 1), ms AS (SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS month, MIN(n) AS least, MEDIAN(n) AS median, MAX(n) AS most FROM dy GROUP BY 1)", "ms", "month", "least", "median!", "most"))
def audit_sizes_by_month(spark, sf_dir):
    return universe_sizes(prices(spark, sf_dir), by="month")


@query(final(f"{PX}, yh AS (SELECT MIN(date) AS first, MAX(date) AS last, date_diff('day', MIN(date), MAX(date)) / 365.2425::DOUBLE AS years FROM px)", "yh", "first", "last", "years!"))
def audit_history(spark, sf_dir):
    return years_of_history(prices(spark, sf_dir))


@query(final(f"{PX}, la AS (SELECT * FROM px WHERE date = (SELECT MAX(date) FROM px))", "la", "date", "ticker", "close!", "market_cap!", digits=6), digits=6)
def latest_prices(spark, sf_dir):
    return latest(prices(spark, sf_dir)).select("date", "ticker", "close", "market_cap")


#: All brands, as names of columns.
BRANDS = {f"Brand#{i}{j}": f"brand_{i}{j}" for i in range(1, 6) for j in range(1, 6)}


@query(final(f"""{RET}, wd AS (SELECT date, {", ".join(f"MAX(ret) FILTER (asset = '{b}') AS {c}" for b, c in BRANDS.items())} FROM r GROUP BY 1)""", "wd", "date", *(f"{c}!" for c in BRANDS.values())))
def wide_returns(spark, sf_dir):
    return wide(weekly(spark, sf_dir), BRANDS, "ret").withColumnsRenamed(BRANDS)


MISSING = " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(DISTINCT CASE WHEN {c} IS NULL THEN ticker END) AS ever_missing, COUNT(DISTINCT ticker) AS keys FROM px" for c in ("market_cap", "price_to_book"))


@query(final(f"{PX}, em AS ({MISSING})", "em", "column_name", "ever_missing", "keys"))
def audit_ever_missing(spark, sf_dir):
    return ever_missing(prices(spark, sf_dir).select("ticker", "market_cap", "price_to_book")).withColumnRenamed("column", "column_name")


@query()
def cross_section_wls(spark, sf_dir):
    rows = weekly(spark, sf_dir).join(weekly_betas(spark, sf_dir).select("date", "asset", "beta"), ["date", "asset"]).withColumn("weight", F.sqrt("market_cap"))
    return regress.cross_sections(rows, least=10, share=0.02)


def three_betas(s: Callable[[int, int], str], c: Callable[[int], str]) -> list[str]:
    """The coefficients of three normal equations by Cramer's rule, from SQL for their moments."""
    rows, right = [[s(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)], [c(i) for i in (1, 2, 3)]

    def det(m: list[list[str]]) -> str:
        (p, q, r), (u, v, w), (x, y, z) = m
        return f"({p} * ({v} * {z} - {w} * {y}) - {q} * ({u} * {z} - {w} * {x}) + {r} * ({u} * {y} - {v} * {x}))"

    swapped = [[[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    return [f"{det(m)} / {det(rows)}" for m in swapped]


FS = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
LONG = f"""{RET}, mo AS (SELECT last_day(date) AS date, asset, CASE WHEN COUNT(ret) > 0 THEN product(1 + ret) - 1 END AS ret FROM r GROUP BY 1, 2),
fa AS (SELECT date, AVG(ret) AS f1, MAX(ret) - MIN(ret) AS f2, MEDIAN(ret) AS f3 FROM mo GROUP BY 1), jo AS (SELECT mo.*, f1, f2, f3, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY date) AS rn FROM mo JOIN fa USING (date)),
ma AS (SELECT a.date, a.asset, COUNT(*) AS n, COUNT(*) FILTER (b.rn BETWEEN a.rn - 12 AND a.rn - 2) AS k, SUM(b.ret) FILTER (b.rn BETWEEN a.rn - 12 AND a.rn - 2) AS ky, AVG(b.ret) AS my, VAR_POP(b.ret) AS cyy,
  {", ".join(f"AVG(b.f{i}) AS m{i}, COVAR_POP(b.f{i}, b.ret) AS c{i}, SUM(b.f{i}) FILTER (b.rn BETWEEN a.rn - 12 AND a.rn - 2) AS k{i}" for i in (1, 2, 3))}, {", ".join(f"COVAR_POP(b.f{i}, b.f{j}) AS s{i}{j}" for i, j in FS)}
  FROM jo a JOIN jo b ON a.asset = b.asset AND b.rn BETWEEN a.rn - 36 AND a.rn - 1 WHERE b.ret IS NOT NULL AND b.f1 IS NOT NULL AND b.f2 IS NOT NULL AND b.f3 IS NOT NULL GROUP BY 1, 2),
bt AS (SELECT *, {", ".join(f"{b} AS b{i}" for i, b in enumerate(three_betas(lambda i, j: f"s{min(i, j)}{max(i, j)}", lambda i: f"c{i}"), 1))} FROM ma WHERE n >= 24 AND k >= 11),
sc AS (SELECT date, asset, ky - k * (my - b1 * m1 - b2 * m2 - b3 * m3) - b1 * k1 - b2 * k2 - b3 * k3 AS total, n * (cyy - b1 * c1 - b2 * c2 - b3 * c3) / (n - 1) AS variance FROM bt),
o AS (SELECT date, asset, total / sqrt(variance) AS score FROM sc WHERE variance > 0)"""


@query(final(LONG, "o", "date", "asset", "score!", digits=5), digits=5)
def residual_momentum_36m(spark, sf_dir):
    monthly = dense(signals.monthly_compound(weekly(spark, sf_dir)), "ret")
    factors = monthly.groupBy("date").agg(F.avg("ret").alias("f1"), (F.max("ret") - F.min("ret")).alias("f2"), F.median("ret").alias("f3"))
    return regress.residual_momentum(monthly.join(factors, "date"), ["f1", "f2", "f3"], window=36, least=24, formation=11)


# Hourly panel ---------------------------------------------------------------------------------------------------------------------

HOURLY = events.StudyConfig(factor_window=72, least_factor_rows=48, lookback=24, raw_threshold=0.5, residual_threshold=0.3, least_quote_volume=300.0, least_alts=3, anchors=("CLICK", "PURCHASE"))
HP = f"""ph AS ({fixtures.bare(fixtures.PX_HOUR)}), up AS (SELECT timestamp, upper(symbol) AS symbol, open, close, quote_volume FROM ph),
hg AS (SELECT a.timestamp, b.symbol, u.open, u.close, u.quote_volume FROM (SELECT DISTINCT timestamp FROM up) a CROSS JOIN (SELECT DISTINCT symbol FROM up) b LEFT JOIN up u ON u.timestamp = a.timestamp AND u.symbol = b.symbol),
lr AS (SELECT *, ln(close) - ln(LAG(close) OVER (PARTITION BY symbol ORDER BY timestamp)) AS ret FROM hg)"""


@query(final(HP, "up", "timestamp", "symbol", "open!", "close!", "quote_volume!"))
def valid_hours(spark, sf_dir):
    return hourly(spark, sf_dir)


def hourly(spark, sf_dir):
    return events.valid_panel(fixtures.frame(spark, sf_dir, fixtures.PX_HOUR))


HF = f"""{HP}, o AS (SELECT timestamp, MAX(ret) FILTER (symbol = 'CLICK') AS btc, MAX(ret) FILTER (symbol = 'PURCHASE') AS eth,
  CASE WHEN COUNT(ret) FILTER (symbol NOT IN ('CLICK', 'PURCHASE')) >= 3 THEN MEDIAN(ret) FILTER (symbol NOT IN ('CLICK', 'PURCHASE')) END AS alt FROM lr GROUP BY 1)"""


@query(final(HF, "o", "timestamp", "btc!", "eth!", "alt!"))
def hourly_factors(spark, sf_dir):
    return events.factor_rows(events.log_returns(events.hourly_grid(hourly(spark, sf_dir))), HOURLY)


def enough(value: str, window: str) -> str:
    return f"CASE WHEN COUNT({value}) OVER {window} >= 48 THEN SUM({value}) OVER {window} END"


X3 = {1: "btc", 2: "eth", 3: "alt"}
X_KNOWN = " AND ".join(f"{x} IS NOT NULL" for x in X3.values())
FEATURES = f"""{HF}, fm AS (SELECT *, {enough("1", "w")} AS n, {", ".join(f"{enough(x, 'w')} AS s{i}" for i, x in X3.items())}, {", ".join(f"{enough(f'{X3[i]} * {X3[j]}', 'w')} AS q{i}{j}" for i, j in FS)},
  COUNT(CASE WHEN {X_KNOWN} THEN 1 END) OVER w AS factor_rows FROM o WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)),
sy AS (SELECT lr.*, {enough("ret", "w")} AS y0, {", ".join(f"{enough(f'{x} * ret', 'w')} AS y{i}" for i, x in X3.items())}, COUNT(CASE WHEN {X_KNOWN} AND ret IS NOT NULL THEN 1 END) OVER w AS joint
  FROM lr JOIN o USING (timestamp) WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)),
sm AS (SELECT sy.*, fm.* EXCLUDE (timestamp), {", ".join(f"q{i}{j} {'+ 1e-8 ' if i == j else ''}- s{i} * s{j} / n AS e{i}{j}" for i, j in FS)}, {", ".join(f"y{i} - s{i} * y0 / n AS d{i}" for i in X3)} FROM sy JOIN fm USING (timestamp)),
sb AS (SELECT *, {", ".join(f"{b} AS b{i}" for i, b in enumerate(three_betas(lambda i, j: f"e{min(i, j)}{max(i, j)}", lambda i: f"d{i}"), 1))} FROM sm),
sr AS (SELECT *, CASE WHEN joint >= factor_rows AND joint >= 48 THEN ret - (y0 - b1 * s1 - b2 * s2 - b3 * s3) / n - b1 * btc - b2 * eth - b3 * alt END AS residual FROM sb),
hf AS (SELECT timestamp, symbol, open, close, ret, residual, close / LAG(close, 24) OVER t - 1 AS raw_move, CASE WHEN COUNT(residual) OVER w = 24 THEN exp(SUM(residual) OVER w) - 1 END AS residual_move,
  CASE WHEN COUNT(quote_volume) OVER w = 24 THEN SUM(quote_volume) OVER w END AS quote_volume_sum
  FROM sr WINDOW t AS (PARTITION BY symbol ORDER BY timestamp), w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query(final(FEATURES, "hf", "timestamp", "symbol", *(f"{c}!" for c in ("open", "close", "ret", "residual", "raw_move", "residual_move", "quote_volume_sum")), digits=6), digits=6)
def hourly_features(spark, sf_dir):
    return events.features(hourly(spark, sf_dir), HOURLY)


EVENTS = f"""RECURSIVE {HP}, ft AS (SELECT *, close / LAG(close, 24) OVER t - 1 AS raw_move, CASE WHEN COUNT(quote_volume) OVER w = 24 THEN SUM(quote_volume) OVER w END AS qv, LEAD(open) OVER t AS entry_open,
  LEAD(close, 1) OVER t AS x1, LEAD(close, 4) OVER t AS x4, LEAD(close, 24) OVER t AS x24, epoch(timestamp)::BIGINT AS sec FROM lr WINDOW t AS (PARTITION BY symbol ORDER BY timestamp), w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
ht AS (SELECT * FROM ft WHERE symbol NOT IN ('CLICK', 'PURCHASE') AND qv >= 300 AND raw_move >= 0.5),
kp AS (SELECT symbol, MIN(sec) AS sec FROM ht GROUP BY 1 UNION ALL SELECT k.symbol, (SELECT MIN(h.sec) FROM ht h WHERE h.symbol = k.symbol AND h.sec >= k.sec + 86400) FROM kp k WHERE k.sec IS NOT NULL),
ev AS (SELECT 'raw_pump' AS signal, h.symbol, h.timestamp AS signal_timestamp, h.entry_open, h.x1 / h.entry_open - 1 AS asset_fwd_1h, 1 - h.x1 / h.entry_open - 0.002 AS short_net_1h, h.x4 / h.entry_open - 1 AS asset_fwd_4h, 1 - h.x4 / h.entry_open - 0.002 AS short_net_4h,
  h.x24 / h.entry_open - 1 AS asset_fwd_24h, 1 - h.x24 / h.entry_open - 0.002 AS short_net_24h FROM ht h JOIN kp k ON h.symbol = k.symbol AND h.sec = k.sec WHERE h.entry_open > 0)"""
RAW_ONLY = events.StudyConfig(**{**HOURLY.__dict__, "horizons": (1, 4, 24)})


def raw_events(spark, sf_dir):
    return events.events(events.features(hourly(spark, sf_dir), RAW_ONLY), RAW_ONLY).where("signal = 'raw_pump'")


@query(final(EVENTS, "ev", "signal", "symbol", "signal_timestamp", "entry_open!", *(f"{n}_{h}h!" for h in (1, 4, 24) for n in ("asset_fwd", "short_net")), digits=6), digits=6)
def raw_pump_events(spark, sf_dir):
    return raw_events(spark, sf_dir)


@query(final(EVENTS + """, ul AS (SELECT signal, 1 AS horizon, short_net_1h AS s FROM ev UNION ALL SELECT signal, 4, short_net_4h FROM ev UNION ALL SELECT signal, 24, short_net_24h FROM ev),
o AS (SELECT signal, CAST(horizon AS INT) AS horizon, COUNT(s) AS n, AVG(s) AS mean, MEDIAN(s) AS median, AVG(CASE WHEN s > 0 THEN 1.0 WHEN s <= 0 THEN 0.0 END) AS hit_rate FROM ul GROUP BY 1, 2)""", "o", "signal", "horizon", "n", "mean!", "median!", "hit_rate!", digits=6), digits=6)
def raw_pump_summary(spark, sf_dir):
    return events.event_summary(raw_events(spark, sf_dir), RAW_ONLY)


def all_events(spark, sf_dir):
    return events.events(events.features(hourly(spark, sf_dir), HOURLY), HOURLY)


H5 = HOURLY.horizons
BOTH = f"""RECURSIVE {FEATURES}, ah AS (SELECT *, epoch(timestamp)::BIGINT AS sec, LEAD(open) OVER t AS entry_open, {", ".join(f"LEAD(close, {h}) OVER t AS x{h}" for h in H5)} FROM hf WINDOW t AS (PARTITION BY symbol ORDER BY timestamp)),
li AS (SELECT * FROM ah WHERE symbol NOT IN ('CLICK', 'PURCHASE') AND quote_volume_sum >= 300),
ht AS MATERIALIZED (SELECT 'raw_pump' AS signal, * FROM li WHERE raw_move >= 0.5 UNION ALL SELECT 'residual_pump', * FROM li WHERE residual_move >= 0.3),
kp AS (SELECT signal, symbol, MIN(sec) AS sec FROM ht GROUP BY 1, 2 UNION ALL SELECT k.signal, k.symbol, (SELECT MIN(h.sec) FROM ht h WHERE h.signal = k.signal AND h.symbol = k.symbol AND h.sec >= k.sec + 86400) FROM kp k WHERE k.sec IS NOT NULL),
ev AS (SELECT h.signal, h.symbol, h.timestamp AS signal_timestamp, h.entry_open, {", ".join(f"h.x{h} / h.entry_open - 1 AS asset_fwd_{h}h, 1 - h.x{h} / h.entry_open - 0.002 AS short_net_{h}h" for h in H5)}
  FROM ht h JOIN kp k ON h.signal = k.signal AND h.symbol = k.symbol AND h.sec = k.sec WHERE h.entry_open > 0)"""


@query(final(BOTH, "ev", "signal", "symbol", "signal_timestamp", "entry_open!", *(f"{n}_{h}h!" for h in H5 for n in ("asset_fwd", "short_net")), digits=6), digits=6)
def pump_events(spark, sf_dir):
    """Both signals at all five horizons."""
    return all_events(spark, sf_dir)


@query(final(f"""{BOTH}, ul AS ({" UNION ALL ".join(f"SELECT signal, {h} AS horizon, short_net_{h}h AS s FROM ev" for h in H5)}),
su AS (SELECT signal, CAST(horizon AS INT) AS horizon, COUNT(s) AS n, AVG(s) AS mean, MEDIAN(s) AS median, AVG(CASE WHEN s > 0 THEN 1.0 WHEN s <= 0 THEN 0.0 END) AS hit_rate FROM ul GROUP BY 1, 2)""", "su", "signal", "horizon", "n", "mean!", "median!", "hit_rate!", digits=6), digits=6)
def pump_summary(spark, sf_dir):
    return events.event_summary(all_events(spark, sf_dir), HOURLY)


# Portfolio accounts ---------------------------------------------------------------------------------------------------------------

S5 = attribution.SLEEVES
ACC = f"""tr AS ({fixtures.bare(fixtures.TRADES)}),
wd AS (SELECT date, SUM(exposure) AS nav, -SUM(commission) + SUM(interest) - SUM(short_borrow_cost) AS fees, {", ".join(f"MAX(CASE WHEN ticker = '{t}' AND close > 0 THEN close END) AS p_{t}, MAX(CASE WHEN ticker = '{t}' THEN shares END) AS s_{t}, MAX(CASE WHEN ticker = '{t}' THEN exposure END) AS e_{t}" for t in S5)} FROM tr GROUP BY 1),
a0 AS (SELECT *, LAG(nav) OVER o AS prior_nav, nav / LAG(nav) OVER o - 1 AS ret, CASE WHEN ABS(s_SVXY) > 1e-12 THEN 'SVXY' WHEN ABS(s_VIXY) > 1e-12 THEN 'VIXY' ELSE 'NONE' END AS state,
  ({" + ".join(f"ABS(e_{t})" for t in S5)}) / nav AS gross_exposure, {", ".join(f"e_{t} / nav AS w_{t}, p_{t} / LAG(p_{t}) OVER o - 1 AS r_{t}, COALESCE(LAG(s_{t}) OVER o * (p_{t} - LAG(p_{t}) OVER o), CAST(0 AS DOUBLE)) AS pnl_{t}" for t in S5)}
  FROM wd WINDOW o AS (ORDER BY date)),
a1 AS (SELECT *, COALESCE(LAG(state) OVER (ORDER BY date), 'NONE') AS held_state FROM a0),
ac AS (SELECT *, CASE held_state WHEN 'SVXY' THEN r_SVXY WHEN 'VIXY' THEN r_VIXY END AS r_VOL, {" + ".join(f"pnl_{t}" for t in S5)} + fees AS total_pnl FROM a1)"""


def daily(spark, sf_dir):
    return attribution.accounts(fixtures.frame(spark, sf_dir, fixtures.TRADES))


@query(final(f"""{RET}, mk AS (SELECT date, AVG(ret) AS market FROM r GROUP BY 1), {ACC}, oj AS (SELECT date, market, ret FROM mk FULL JOIN ac USING (date))""", "oj", "date", "market!", "ret!"))
def outer_aligned_returns(spark, sf_dir):
    """The market's and the strategy's returns on the dates that either has."""
    return outer_aligned(weekly(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("market")), daily(spark, sf_dir).select("date", "ret"))


@query(final(ACC, "ac", "date", "nav!", "prior_nav!", "fees!", "ret!", "state", "held_state", "gross_exposure!", "r_VOL!", "total_pnl!", *(f"{n}_{t}!" for n in ("w", "r", "pnl") for t in S5)))
def trade_accounts(spark, sf_dir):
    return daily(spark, sf_dir)


@query(final(f"""{ACC}, o AS ({" UNION ALL ".join(f"SELECT '{t}' AS sleeve, SUM({c}) AS dollar_pnl FROM ac" for t, c in [*((t, f"pnl_{t}") for t in S5), ("FEES", "fees")])})""", "o", "sleeve", "dollar_pnl!", digits=7), digits=7)
def dollar_attribution(spark, sf_dir):
    return attribution.dollar_attribution(daily(spark, sf_dir))


@query(final(f"""{ACC}, o AS ({" UNION ALL ".join(f"SELECT date, '{t}' AS sleeve, {c} / prior_nav AS contribution FROM ac" for t, c in [*((t, f"pnl_{t}") for t in S5), ("FEES", "fees"), ("TOTAL", "total_pnl")])})""", "o", "date", "sleeve", "contribution!"))
def return_contributions(spark, sf_dir):
    return attribution.contributions(daily(spark, sf_dir))


def regimes(source: str, x: str, columns: str, up: bool = True) -> str:
    tests = [("ALL", "TRUE")] + [("VTI_UP", f"{x} > 0")] * up + [("VTI_DOWN", f"{x} < 0")] + [(f"VTI_WORST_{n}", f"{x} <= q{n}") for n in ("20", "10", "05")]
    return f"""qs AS (SELECT QUANTILE_CONT({x}, 0.2) AS q20, QUANTILE_CONT({x}, 0.1) AS q10, QUANTILE_CONT({x}, 0.05) AS q05 FROM {source}),
rg AS ({" UNION ALL ".join(f"SELECT '{n}' AS regime, {columns} FROM {source} CROSS JOIN qs WHERE {t}" for n, t in tests)})"""


def regression(y: str, x: str, prefix: str = "") -> str:
    n = f"COUNT(*) FILTER ({y} IS NOT NULL AND {x} IS NOT NULL)"
    return f"CASE WHEN {n} >= 5 THEN COALESCE(REGR_SLOPE({y}, {x}), 0) END AS {prefix}beta, CASE WHEN {n} >= 5 AND REGR_SYY({y}, {x}) > 0 THEN REGR_SXY({y}, {x}) * REGR_SXY({y}, {x}) / NULLIF(REGR_SXX({y}, {x}), 0) / REGR_SYY({y}, {x}) END AS {prefix}r2"


@query(final(f"""{ACC}, {regimes("ac", "r_VTI", "r_VTI, r_TLT, r_GLD, r_VOL")}, lo AS ({" UNION ALL ".join(f"SELECT regime, '{t}' AS asset, r_VTI AS x, r_{t} AS y FROM rg" for t in ("TLT", "GLD", "VOL"))}),
g AS (SELECT asset, regime, COUNT(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, {regression("y", "x")} FROM lo GROUP BY 1, 2), o AS (SELECT *, 1 - r2 AS unique_variance FROM g)""", "o", "asset", "regime", "n", "beta!", "r2!", "unique_variance!", digits=6), digits=6)
def conditional_betas(spark, sf_dir):
    return attribution.conditional_betas(daily(spark, sf_dir))


@query(final(f"""{ACC}, sv AS (SELECT ret AS y, r_VTI AS x FROM ac WHERE ret IS NOT NULL AND r_VTI IS NOT NULL), {regimes("sv", "x", "x, y", False)}, o AS (SELECT regime, COUNT(*) AS n, {regression("y", "x")} FROM rg GROUP BY 1)""", "o", "regime", "n", "beta!", "r2!", digits=6), digits=6)
def strategy_stress(spark, sf_dir):
    return attribution.strategy_stress(daily(spark, sf_dir))


@query(final(f"""{ACC}, o AS (SELECT held_state AS state, COUNT(*) AS days, AVG(ret) * 252 AS mean, STDDEV_SAMP(ret) * sqrt(252.0) AS volatility, AVG(ret) * 252 / NULLIF(STDDEV_SAMP(ret) * sqrt(252.0), 0) AS sharpe, {regression("ret", "r_VTI")}
  FROM ac WHERE ret IS NOT NULL AND r_VTI IS NOT NULL GROUP BY 1)""", "o", "state", "days", "mean!", "volatility!", "sharpe!", "beta!", "r2!", digits=6), digits=6)
def state_stats(spark, sf_dir):
    return attribution.state_stats(daily(spark, sf_dir))


@query(final(f"""{ACC}, {regimes("ac", "r_VTI", "held_state AS state, ret AS y, r_VTI AS x, r_VOL AS v", False)}, gd AS (SELECT * FROM (VALUES ('SVXY'), ('VIXY'), ('NONE')) s(state) CROSS JOIN (VALUES ('ALL'), ('VTI_DOWN'), ('VTI_WORST_20'), ('VTI_WORST_10'), ('VTI_WORST_05')) r(regime)),
g AS (SELECT state, regime, COUNT(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, {regression("y", "x")}, {regression("v", "x", "vol_")}, AVG(y) AS mean FROM rg GROUP BY 1, 2),
o AS (SELECT gd.state, gd.regime, COALESCE(n, 0) AS n, beta, r2, vol_beta, vol_r2, mean FROM gd LEFT JOIN g ON gd.state = g.state AND gd.regime = g.regime)""", "o", "state", "regime", "n", "beta!", "r2!", "vol_beta!", "vol_r2!", "mean!", digits=6), digits=6)
def state_stress(spark, sf_dir):
    return attribution.state_stress(daily(spark, sf_dir))


PAIRS = [(a, b) for i, a in enumerate(attribution.ACTIVE) for b in attribution.ACTIVE[i + 1 :]]


@query(final(f"""{ACC}, {regimes("ac", "r_VTI", "r_VTI, r_TLT, r_GLD, r_VOL", False)}, o AS ({" UNION ALL ".join(f"SELECT regime, '{a}' AS asset_a, '{b}' AS asset_b, COVAR_SAMP(r_{a}, r_{b}) / NULLIF(STDDEV_SAMP(CASE WHEN r_{b} IS NOT NULL THEN r_{a} END) * STDDEV_SAMP(CASE WHEN r_{a} IS NOT NULL THEN r_{b} END), 0) AS correlation FROM rg GROUP BY 1" for a, b in PAIRS)})""", "o", "regime", "asset_a", "asset_b", "correlation!", digits=6), digits=6)
def correlations_by_regime(spark, sf_dir):
    return attribution.correlations(daily(spark, sf_dir))


@query(final(f"""{ACC}, o AS (SELECT date, ret, r_VTI AS vti_return, {", ".join(f"pnl_{t} / prior_nav AS {t}" for t in S5)}, fees / prior_nav AS FEES, held_state, gross_exposure FROM ac WHERE ret IS NOT NULL ORDER BY ret, date LIMIT 15)""", "o", "date", "ret!", "vti_return!", *(f"{t}!" for t in (*S5, "FEES")), "held_state", "gross_exposure!"))
def worst_days(spark, sf_dir):
    return attribution.worst_days(daily(spark, sf_dir))


def explained_by_three(y: str, x: list[str]) -> str:
    """R2 of y on three columns in closed form, from covariances of complete rows."""
    c = lambda i, j: f"COVAR_POP({i}, {j})"
    (s11, s12, s13), (_, s22, s23), (_, _, s33) = ([c(i, j) for j in x] for i in x)
    c1, c2, c3 = (c(y, i) for i in x)
    det = f"({s11} * ({s22} * {s33} - {s23} * {s23}) - {s12} * ({s12} * {s33} - {s23} * {s13}) + {s13} * ({s12} * {s23} - {s22} * {s13}))"
    square = f"{c1} * {c1} * ({s22} * {s33} - {s23} * {s23}) + {c2} * {c2} * ({s11} * {s33} - {s13} * {s13}) + {c3} * {c3} * ({s11} * {s22} - {s12} * {s12})"
    mixed = f"{c1} * {c2} * ({s13} * {s23} - {s12} * {s33}) + {c1} * {c3} * ({s12} * {s23} - {s13} * {s22}) + {c2} * {c3} * ({s12} * {s13} - {s11} * {s23})"
    return f"CASE WHEN COUNT(*) >= 5 AND VAR_POP({y}) > 0 THEN ({square} + 2 * ({mixed})) / {det} / VAR_POP({y}) END"


A4 = [f"r_{t}" for t in attribution.ACTIVE]


@query(final(f"""{ACC}, {regimes("ac", "r_VTI", ", ".join(A4))}, fu AS (SELECT * FROM rg WHERE {" AND ".join(f"{c} IS NOT NULL" for c in A4)}),
g AS ({" UNION ALL ".join(f"SELECT '{t}' AS asset, regime, COUNT(*) AS n, {explained_by_three(f'r_{t}', [c for c in A4 if c != f'r_{t}'])} AS r2 FROM fu GROUP BY regime" for t in attribution.ACTIVE)}), o AS (SELECT *, 1 - r2 AS unique_variance FROM g)""", "o", "asset", "regime", "n", "r2!", "unique_variance!", digits=5), digits=5)
def unique_risk(spark, sf_dir):
    return attribution.unique_risk(daily(spark, sf_dir))


ON = {t: f"ABS(w_{t}) > 1e-12" for t in attribution.ACTIVE}
RISK = f"""{ACC}, d AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS rn, w_VTI, w_TLT, w_GLD, w_SVXY + w_VIXY AS w_VOL, {", ".join(A4)} FROM ac),
bo AS (SELECT n.date, {", ".join(f"n.w_{t}" for t in attribution.ACTIVE)}, {", ".join(f"p.{c}" for c in A4)} FROM d n JOIN d p ON p.rn BETWEEN n.rn - 59 AND n.rn),
co AS (SELECT * FROM bo WHERE {" AND ".join(f"(NOT ({ON[t]}) OR r_{t} IS NOT NULL)" for t in attribution.ACTIVE)} AND ({" OR ".join(ON.values())})),
pr AS ({" UNION ALL ".join(f"SELECT date, '{a}' AS asset, COUNT(*) AS n, ANY_VALUE(w_{a} * w_{b}) * COVAR_SAMP(r_{a}, r_{b}) AS part FROM co WHERE {ON[a]} AND {ON[b]} GROUP BY date" for a in attribution.ACTIVE for b in attribution.ACTIVE)}),
sh AS (SELECT date, asset, MAX(n) AS n, SUM(part) AS part FROM pr WHERE n >= 30 GROUP BY 1, 2), va AS (SELECT *, SUM(part) OVER (PARTITION BY date) AS v FROM sh),
rr AS (SELECT date, n, SQRT(v * 252) AS volatility, asset, part / v AS contribution FROM va WHERE v > 0)"""


@query(final(RISK, "rr", "date", "n", "volatility!", "asset", "contribution!", digits=6), digits=6)
def rolling_risk(spark, sf_dir):
    return attribution.rolling_risk(daily(spark, sf_dir))


@query(final(f"{RISK}, la AS (SELECT * FROM rr WHERE date = (SELECT MAX(date) FROM rr))", "la", "date", "n", "volatility!", "asset", "contribution!", digits=6), digits=6)
def latest_risk(spark, sf_dir):
    return attribution.latest_risk(daily(spark, sf_dir))


TB = f"""{ACC}, tb AS (SELECT *, CASE WHEN COUNT(*) FILTER (ret IS NOT NULL AND r_VTI IS NOT NULL) OVER w >= 13 AND COUNT(r_VTI) OVER w >= 13 THEN COVAR_SAMP(ret, r_VTI) OVER w / NULLIF(VAR_SAMP(r_VTI) OVER w, 0) END AS beta
  FROM ac WINDOW w AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))"""


@query(final(TB, "tb", "date", "beta!", digits=6), digits=6)
def strategy_rolling_beta(spark, sf_dir):
    rows = daily(spark, sf_dir).select("date", F.lit("strategy").alias("asset"), F.col("ret").alias("y"), F.col("r_VTI").alias("x"))
    return betas.rolling_beta(rows, 26, 13).select("date", "beta")


#: The published grid, and two rules low enough for these tables' betas to trigger.
RULES = [*overlay.SCENARIOS, ("beta>0.20 x0.50", "beta", 0.2, 0.5), ("beta>0.30 x0.00", "beta", 0.3, 0.0)]
OV = f"""{TB}, tl AS (SELECT *, LAG(beta) OVER (ORDER BY date) AS pb, COALESCE(LAG(r_VTI < 0 AND r_TLT < 0 AND r_GLD < 0) OVER (ORDER BY date), FALSE) AS jd FROM tb),
sc AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{r}', CAST({'NULL' if t is None else t} AS DOUBLE), CAST({s} AS DOUBLE))" for n, r, t, s in RULES)}) v(strategy, rule, threshold, scale)),
x0 AS (SELECT tl.*, sc.*, CASE WHEN ABS(w_SVXY) > 1e-12 THEN CASE rule WHEN 'beta' THEN COALESCE(pb > threshold, FALSE) WHEN 'joint' THEN jd ELSE FALSE END ELSE FALSE END AS trigger FROM tl CROSS JOIN sc),
x1 AS (SELECT *, CASE WHEN trigger THEN w_SVXY * scale ELSE w_SVXY END AS t_SVXY FROM x0),
x2 AS (SELECT *, t_SVXY - w_SVXY AS adj, {", ".join(f"LAG({'t' if t == 'SVXY' else 'w'}_{t}) OVER s * r_{t} AS c_{t}" for t in S5)} FROM x1 WINDOW s AS (PARTITION BY strategy ORDER BY date)),
x3 AS (SELECT *, COALESCE(ABS(adj - LAG(adj) OVER (PARTITION BY strategy ORDER BY date)), ABS(adj)) AS turnover, CASE WHEN COALESCE({", ".join(f"c_{t}" for t in S5)}) IS NOT NULL THEN {" + ".join(f"COALESCE(c_{t}, 0)" for t in S5)} END AS earned FROM x2),
ov AS (SELECT strategy, date, earned + fees / prior_nav - turnover * 0.0005 AS net, trigger, turnover FROM x3)"""


def overlays(spark, sf_dir):
    return overlay.streams(daily(spark, sf_dir), RULES, 26, 5.0, least=13)


@query(final(OV, "ov", "strategy", "date", "net!", "trigger", "turnover!"))
def overlay_streams(spark, sf_dir):
    return overlays(spark, sf_dir)


@query(final(OV + """, eq AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM ov WHERE net IS NOT NULL), pk AS (SELECT *, MAX(e) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
pf AS (SELECT strategy, COUNT(*) AS n, CASE WHEN MAX_BY(e, date) > 0 THEN power(MAX_BY(e, date), 252.0 / COUNT(*)) - 1 END AS cagr, STDDEV_SAMP(net) * sqrt(252.0) AS volatility, AVG(net) / NULLIF(STDDEV_SAMP(net), 0) * sqrt(252.0) AS sharpe, MIN(e / peak - 1) AS max_drawdown, MAX_BY(e, date) AS multiple FROM pk GROUP BY 1),
ex AS (SELECT strategy, CAST(SUM(CAST(trigger AS INT)) AS BIGINT) AS trigger_days, AVG(turnover) AS mean_turnover, SUM(turnover) AS total_turnover FROM ov GROUP BY 1)""",
    "pf JOIN ex USING (strategy)", "strategy", "n", "cagr!", "volatility!", "sharpe!", "max_drawdown!", "multiple!", "trigger_days", "mean_turnover!", "total_turnover!", digits=6), digits=6)
def overlay_comparison(spark, sf_dir):
    return overlay.compared(overlays(spark, sf_dir))
