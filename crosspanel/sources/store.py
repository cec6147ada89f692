"""Canonical store, content hashes, manifests, reports."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.panel import require_columns, require_unique

BARS = ("date", "asset_id", "symbol", "close_unadjusted", "volume_unadjusted", "total_return")
HISTORY = ("date", "asset_id", "symbol", "is_common_stock", "is_major_exchange")
#: Words that a blinded output's columns and keys must not hold.
BLINDED = ("alpha_return", "sharpe", "cagr", "information_coefficient", "drawdown", "pnl")


def content_hash(df: DataFrame) -> str:
    """A digest of the rows whatever their order and files: two sums of row hashes and the count, as text."""
    names = sorted(df.columns)
    row = [F.xxhash64(F.lit(salt), *(F.coalesce(F.col(n).cast("string"), F.lit("\0")) for n in names)).cast("decimal(38,0)") for salt in (0, 1)]
    found = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(r), F.lit(0)).alias(f"h{i}") for i, r in enumerate(row))).select(F.sha2(F.concat_ws(":", F.lit(",".join(names)), "n", "h0", "h1"), 256).alias("h"))
    return found.first()["h"]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through Spark's own file systems, so that any path Spark can write will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, content: Mapping) -> None:
    _write_text(spark, path, json.dumps(content, indent=2, sort_keys=True, default=str))


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


@dataclass(frozen=True)
class CanonicalStore:
    spark: SparkSession
    path: str

    def write(self, bars: DataFrame, history: DataFrame, source: str = "") -> dict:
        """Both tables as zstd Parquet ordered by date and asset, and a manifest of content hashes; ValueError for repeated keys."""
        manifest = {"source": source, "as_of": datetime.now(UTC).isoformat(), "tables": {}}
        for name, df, columns in (("bars", bars, BARS), ("security_history", history, HISTORY)):
            rows = require_unique(require_columns(df, columns, name), ["date", "asset_id"], name)
            rows.repartitionByRange("date", "asset_id").sortWithinPartitions("date", "asset_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}.parquet")
            back = self.spark.read.parquet(f"{self.path}/{name}.parquet")
            manifest["tables"][name] = {"rows": back.count(), "sha256": content_hash(back)}
        write_json(self.spark, f"{self.path}/manifest.json", manifest)
        return manifest

    def read_bars(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bars.parquet")

    def read_security_history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/security_history.parquet")

    def read_manifest(self) -> dict:
        return read_json(self.spark, f"{self.path}/manifest.json")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet (zstd) or gzipped CSV with a header."""
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        raise ValueError(f"unknown kind of table: {kind}")


def write_report(spark: SparkSession, path: str, title: str, config: Mapping, tables: Mapping[str, DataFrame], rows: int = 200) -> None:
    """Each table as gzipped CSV, and a page that shows the parameters and each table's first rows."""
    parts = [f"# {title}", "", *(f"- {k}: {v}" for k, v in config.items())]
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", "csv")
        shown = df.limit(rows).collect()
        parts += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in shown)]
    _write_text(spark, f"{path}/REPORT.md", "\n".join(parts) + "\n")


def build_manifest(panel: DataFrame, signals: Mapping[str, DataFrame], status: str = "BUILT") -> dict:
    """Rows, tickers, dates and hashes of a build; ValueError where a signal table has a column that blinding forbids."""
    for name, df in signals.items():
        if bad := [c for c in df.columns if any(word in c.lower() for word in BLINDED)]:
            raise ValueError(f"{name} would unblind: {bad}")
    about = panel.agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first"), F.max("date").alias("last")).first().asDict()
    covered = {n: df.agg(F.count("*").alias("rows"), F.count_distinct("month").alias("months"), F.count_distinct("symbol").alias("tickers")).first().asDict() for n, df in signals.items()}
    return {"status": status, "panel": about | {"sha256": content_hash(panel)}, "signals": covered}


def audit(df: DataFrame, key: str = "ticker") -> DataFrame:
    """(column, nulls) and the table's rows, keys and dates, as one row for each column."""
    head = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.min("date").alias("first"), F.max("date").alias("last"), *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns))
    return head.select("rows", "keys", "first", "last", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls")) for c in df.columns))).alias("c")).select("c.*", "rows", "keys", "first", "last")


def universe_sizes(df: DataFrame, by: str = "year") -> DataFrame:
    """(year or month, least, median, most) members a date; a month goes by its first day."""
    if by not in ("year", "month"):
        raise ValueError(f"unknown span: {by}")
    daily = df.where("is_universe = 1").groupBy("date").agg(F.count("*").alias("n"))
    span = F.year("date") if by == "year" else F.trunc("date", "MM")
    return daily.groupBy(span.alias(by)).agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))


def ever_missing(df: DataFrame, key: str = "ticker") -> DataFrame:
    """(column, ever_missing, keys): how many keys lack each column's value in some row, and how many there are."""
    others = [c for c in df.columns if c != key]
    per = df.groupBy(key).agg(*(F.max(F.col(c).isNull()).alias(c) for c in others)).where(F.col(key).isNotNull())
    head = per.agg(F.count("*").alias("keys"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in others))
    return head.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("ever_missing")) for c in others))).alias("c"), "keys").select("c.*", "keys")


def years_of_history(df: DataFrame) -> DataFrame:
    """(first, last, years) of a table with dates; a year has 365.2425 days."""
    return df.agg(F.min("date").alias("first"), F.max("date").alias("last")).withColumn("years", F.datediff("last", "first") / 365.2425)
