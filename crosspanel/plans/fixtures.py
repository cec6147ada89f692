"""Panels derived from the test tables by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "part", "orders", "events")

PX_WEEK = """
SELECT CAST(date_trunc('week', l.l_shipdate) AS DATE) AS date, p.p_brand AS ticker,
  'S' || CAST(CAST(substr(p.p_brand, 7) AS INT) % 5 AS VARCHAR(4)) AS sector,
  'I' || CAST(CAST(substr(p.p_brand, 7) AS INT) % 10 AS VARCHAR(4)) AS industry,
  SUM(l.l_extendedprice) / SUM(l.l_quantity) AS close, SUM(l.l_quantity) AS volume, SUM(l.l_extendedprice) AS market_cap,
  AVG(l.l_discount) / NULLIF(AVG(l.l_tax), CAST(0 AS DOUBLE)) AS price_to_book,
  CASE WHEN SUM(l.l_quantity) >= 50 THEN 1 ELSE 0 END AS is_universe
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2, 3, 4
"""

PX_HOUR = """
WITH g AS (
  SELECT s.symbol, h.ts FROM (SELECT DISTINCT event_type AS symbol FROM {events}) s
  CROSS JOIN (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM {events}) h),
b AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, event_id) AS o, max_by(value, event_id) AS c, SUM(value) AS qv
  FROM {events} WHERE value > 0 GROUP BY 1, 2),
j AS (
  SELECT g.symbol, g.ts, b.o, b.c, b.qv, COUNT(b.c) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS grp
  FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.ts = b.ts),
f AS (SELECT symbol, ts, o, qv, MAX(c) OVER (PARTITION BY symbol, grp) AS cf FROM j),
h AS (SELECT symbol, ts, o, qv, cf, LAG(cf) OVER (PARTITION BY symbol ORDER BY ts) AS cp FROM f)
SELECT ts AS timestamp, symbol, COALESCE(o, cp) AS open, cf AS close, COALESCE(qv, CAST(0 AS DOUBLE)) AS quote_volume
FROM h WHERE cf IS NOT NULL
"""

TRADES = """
WITH d AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM {orders}),
t AS (SELECT * FROM (VALUES ('1-URGENT','VTI'),('2-HIGH','TLT'),('3-MEDIUM','GLD'),('4-NOT SPECIFIED','SVXY'),('5-LOW','VIXY')) AS v(prio, ticker)),
b AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS prio, AVG(o_totalprice) / 1000 AS px FROM {orders} GROUP BY 1, 2),
j AS (
  SELECT d.date, t.ticker, b.px, COUNT(b.px) OVER (PARTITION BY t.ticker ORDER BY d.date) AS grp
  FROM d CROSS JOIN t LEFT JOIN b ON b.date = d.date AND b.prio = t.prio),
f AS (SELECT date, ticker, COALESCE(MAX(px) OVER (PARTITION BY ticker, grp), CAST(0 AS DOUBLE)) AS close FROM j),
s AS (
  SELECT date, ticker, close,
    CASE WHEN close = 0 THEN CAST(0 AS DOUBLE) WHEN ticker = 'VTI' THEN CAST(10 AS DOUBLE) WHEN ticker = 'TLT' THEN CAST(6 AS DOUBLE)
         WHEN ticker = 'GLD' THEN CAST(4 AS DOUBLE) WHEN ticker = 'SVXY' AND month(date) % 3 = 0 THEN CAST(3 AS DOUBLE)
         WHEN ticker = 'VIXY' AND month(date) % 3 = 1 THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS shares FROM f),
x AS (
  SELECT date, ticker, close, shares, shares * close AS exposure,
    CASE WHEN LAG(close) OVER w > 0 THEN LAG(shares) OVER w * (close - LAG(close) OVER w) ELSE CAST(0 AS DOUBLE) END AS pnl,
    ABS(shares - COALESCE(LAG(shares) OVER w, CAST(0 AS DOUBLE))) AS tr
  FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)),
n AS (
  SELECT date, SUM(exposure) AS risky,
    SUM(SUM(pnl - CAST(0.01 AS DOUBLE) * tr)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM x GROUP BY date),
u AS (
  SELECT date, ticker, close, shares, exposure, CAST(0.01 AS DOUBLE) * tr AS commission FROM x
  UNION ALL
  SELECT date, 'Cash', CAST(1 AS DOUBLE), 20000 + cum - risky, 20000 + cum - risky, CAST(0 AS DOUBLE) FROM n)
SELECT *, CAST(0 AS DOUBLE) AS interest, CAST(0 AS DOUBLE) AS short_borrow_cost, CAST(0 AS DOUBLE) AS margin_call, CAST(0 AS DOUBLE) AS sharetrades, CAST(0 AS DOUBLE) AS tradevalue FROM u
"""


def bare(sql: str) -> str:
    """The SQL over tables of these names."""
    return sql.format(**{t: t for t in TABLES})


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over a folder's Parquet files."""
    return spark.sql(sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))
