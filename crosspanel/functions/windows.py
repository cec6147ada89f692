"""Window frames with guards on how many values they hold, and statistics over them. Missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def series(*keys: str, order: str = "date") -> WindowSpec:
    """The rows of a key in the order of time."""
    return Window.partitionBy(*keys).orderBy(order)


def frame(first: int, last: int, *keys: str, order: str = "date") -> WindowSpec:
    return series(*keys, order=order).rowsBetween(first, last)


def across(*keys: str) -> WindowSpec:
    """All rows of a key, for cross-sections."""
    return Window.partitionBy(*keys)


def known(value: Column) -> Column:
    """NULL in the place of NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def with_count(statistic: Column, value: Column, window: WindowSpec, least: int) -> Column:
    """A statistic over a frame, NULL where the frame has fewer than ``least`` values."""
    return F.when(F.count(value).over(window) >= least, statistic.over(window))


def full_sum(value: Column, first: int, last: int, *keys: str, order: str = "date") -> Column:
    return with_count(F.sum(value), value, frame(first, last, *keys, order=order), last - first + 1)


def full_growth(value: Column, first: int, last: int, *keys: str, order: str = "date") -> Column:
    """Compounded returns over a frame without gaps."""
    return with_count(F.product(1 + value), value, frame(first, last, *keys, order=order), last - first + 1) - 1


def full_deviation(value: Column, first: int, last: int, *keys: str, order: str = "date") -> Column:
    return with_count(F.stddev_samp(value), value, frame(first, last, *keys, order=order), last - first + 1)


def paired_beta(y: Column, x: Column, window: WindowSpec, least: int) -> Column:
    """Covariance over variance of the rows where both are known."""
    both = y.isNotNull() & x.isNotNull()
    py, px = F.when(both, y), F.when(both, x)
    variance = F.var_samp(px).over(window)
    return F.when((F.count(px).over(window) >= least) & (variance > 0), ratio(F.covar_samp(py, px).over(window), variance))


def average_rank(value: Column, *keys: str) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs; NULL for NULL."""
    ordered = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    return F.when(value.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0))


def nearest_quantile(value: Column, share: float) -> Column:
    """An aggregate: the known value at the place nearest to the share, halves rounded up."""
    ordered = F.array_sort(F.collect_list(value))
    return F.get(ordered, F.floor(F.lit(share) * (F.size(ordered) - 1) + F.lit(0.5)).cast("int"))


def linear_quantile(value: Column, share: float) -> Column:
    return F.percentile(value, F.lit(share))


def winsorized(value: Column, share: float, *keys: str) -> Column:
    """Values pulled to the linear quantiles ``share`` and 1 - ``share`` of their cross-section; nothing for share 0 or under 3 values."""
    if share <= 0:
        return value
    over = across(*keys)
    low, high = (linear_quantile(value, q).over(over) for q in (share, 1 - share))
    return F.when(F.count(value).over(over) < 3, value).when(value.isNotNull(), F.greatest(F.least(value, high), low))


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are known; NULL where a side is constant (corr would raise)."""
    both = a.isNotNull() & b.isNotNull()
    pa, pb = F.when(both, a), F.when(both, b)
    return ratio(F.covar_samp(pa, pb), F.nullif(F.stddev_samp(pa) * F.stddev_samp(pb), F.lit(0.0)))
