"""Files to frames: classified universes, prices, panels, trades."""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.windows import ratio, series
from crosspanel.operators.attribution import TRADE_COLUMNS
from crosspanel.panel import dense, require_columns


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending: Parquet, CSV (gzip too), or Arrow IPC, which is read on the driver."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz", ".gz")):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if low.endswith((".feather", ".arrow", ".ipc")):
        import pyarrow.feather as feather

        return spark.createDataFrame(feather.read_table(path, memory_map=True))
    raise ValueError(f"unknown kind of file: {path}")


UNIVERSE = {"Symbol": "ticker", "Security": "company", "GICS Sector": "sector", "GICS Sub-Industry": "industry"}


class _Tables(HTMLParser):
    """The texts of a page's tables by table, row and cell; a table within a cell counts as its own."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self._open: list[list[list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._open.append([])
            self.tables.append(self._open[-1])
        elif self._open and tag == "tr":
            self._open[-1].append([])
        elif self._open and tag in ("td", "th") and self._open[-1]:
            self._open[-1][-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1] and self._open[-1][-1]:
            self._open[-1][-1][-1] += data


def page_table(page: str, names: Iterable[str]) -> list[dict[str, str]]:
    """The rows of the first table of a page whose first row has these names; ValueError where none has. Rows that are short go."""
    parser, names = _Tables(), list(names)
    parser.feed(page)
    for table in parser.tables:
        head, *rows = [[" ".join(cell.split()) for cell in row] for row in table if row] or [[]]
        if set(names) <= set(head):
            return [{n: row[head.index(n)] for n in names} for row in rows if len(row) >= len(head)]
    raise ValueError(f"no table of the page has the columns {', '.join(names)}")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, yahoo_ticker, company, sector, industry) from a constituents CSV, in the source's or this form, or from a saved page (.html, .htm).

    A page is one document of a few thousand rows; the driver reads its table.
    """
    if path.lower().endswith((".html", ".htm")):
        page = spark.read.text(path, wholetext=True).first()
        found = page_table(page[0] if page else "", UNIVERSE)
        rows = spark.createDataFrame([tuple(r.values()) for r in found], ", ".join(f"`{n}` string" for n in UNIVERSE))
    else:
        rows = spark.read.option("header", True).csv(path)
    if {"ticker", "sector", "industry"} <= set(rows.columns):
        return rows
    require_columns(rows, UNIVERSE, "universe")
    named = rows.select(*(F.col(f"`{a}`").alias(b) for a, b in UNIVERSE.items()))
    return named.select("ticker", F.translate("ticker", ".", "-").alias("yahoo_ticker"), "company", "sector", "industry")


def returns_of(prices: DataFrame, universe: DataFrame | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """(date, asset, ret, kept columns) on the dense grid from (date, ticker, close): changes from the date before, no filling.

    Of rows with one date and ticker the one with the greatest close (then kept columns) stays. With a universe, vendor tickers become its own and other names go.
    """
    keep = list(keep)
    rows = prices.groupBy("date", "ticker").agg(F.max(F.struct("close", *keep)).alias("_row")).select("date", "ticker", "_row.*")
    if universe is not None:
        rows = rows.join(universe.select(F.col("yahoo_ticker").alias("ticker"), F.col("ticker").alias("asset")), "ticker").drop("ticker")
    else:
        rows = rows.withColumnRenamed("ticker", "asset")
    before = F.lag("close").over(series("asset"))
    return dense(rows, "close", *keep).withColumn("ret", ratio(F.col("close"), F.nullif(before, F.lit(0.0))) - 1).select("date", "asset", "ret", *keep)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    rows = require_columns(spark.read.option("header", True).csv(path), TRADE_COLUMNS, "trades")
    return rows.select("ticker", F.to_date("date").alias("date"), *(F.col(c).cast("double").alias(c) for c in TRADE_COLUMNS[2:]))


def symbols_in(text: str, anchors: Iterable[str] = ("BTCUSDT", "ETHUSDT")) -> list[str]:
    """Symbols of a list file: # comments go, commas and spaces part, upper-case, each once in order, the anchors first."""
    found = [s.upper() for line in text.splitlines() for s in re.split(r"[,\s]+", line.split("#", 1)[0]) if s]
    return list(dict.fromkeys([*anchors, *found]))
