"""Long panels: checks, dense grids, missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import known


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    """The frame itself; ValueError naming the columns it lacks. Other columns pass."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str = "input") -> DataFrame:
    """The frame itself; ValueError where two rows share a key. Runs a query that stops at the first."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{what} has more than one row for a {', '.join(keys)}")
    return df


def scrubbed(df: DataFrame, *names: str) -> DataFrame:
    """NaN and infinities become NULL in these columns."""
    return df.withColumns({n: known(F.col(n)) for n in names})


def dense(df: DataFrame, *values: str, date: str = "date", asset: str = "asset") -> DataFrame:
    """A row for each date and asset: windows that count rows then count dates.

    One shuffle by asset, which windows by asset then share: an asset's rows get those dates of the calendar that they lack. The calendar is one
    row that comes from the same shuffle, so the input is computed once. Rows without a date or an asset take no part.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(date).isNotNull() & F.col(asset).isNotNull())
    held = rows.groupBy(asset).agg(F.collect_list(F.struct(date, *values)).alias("_held"))
    calendar = held.select(F.explode(F.transform("_held", lambda x: x[date])).alias("_d")).agg(F.collect_set("_d").alias("_dates"))
    lacking = F.transform(F.array_except("_dates", F.transform("_held", lambda x: x[date])), lambda d: F.struct(d.alias(date), *(F.lit(None).cast(kinds[v]).alias(v) for v in values)))
    whole = held.crossJoin(F.broadcast(calendar))  # one row
    return whole.select(asset, F.inline(F.concat("_held", lacking))).select(date, asset, *values)


def aligned(left: DataFrame, right: DataFrame, date: str = "date", asset: str = "asset") -> DataFrame:
    """Both panels on the dates and assets that both have, as a grid with the columns of each."""
    both = [left.select(k).distinct().join(right.select(k).distinct(), k, "left_semi") for k in (date, asset)]
    return both[0].crossJoin(both[1]).join(left, [date, asset], "left").join(right, [date, asset], "left")


def last_of_each(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with equal keys the one that came last by an explicit sequence column."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(sequence)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in columns))


def latest(df: DataFrame, date: str = "date") -> DataFrame:
    """The rows of the greatest date; none where every date is NULL."""
    last = df.agg(F.max(date).alias("_last"))
    return df.join(F.broadcast(last), F.col(date) == F.col("_last")).drop("_last")  # one row


def wide(df: DataFrame, columns: Iterable[str], value: str, date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, a column for each name given), for export: the greatest value of a date and asset, NULL where there is none."""
    return df.groupBy(date).pivot(asset, list(columns)).agg(F.max(value))


def long(df: DataFrame, value: str, date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, asset, value) from a wide panel; NULLs stay as rows."""
    return df.unpivot(date, [c for c in df.columns if c != date], asset, value)


def outer_aligned(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Two series side by side on the dates that either has; a column of a date that its side lacks is NULL."""
    return left.join(right, date, "full")
