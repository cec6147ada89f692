"""Weighted least squares of dates or rows: moments in Spark or one date at a time, small systems solved over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.windows import frame, ratio


@dataclass(frozen=True)
class Solution:
    coefficients: np.ndarray
    fitted: np.ndarray
    residuals: np.ndarray
    r2: float
    orthogonality: float


def solve_wls(y: np.ndarray, x: np.ndarray, weights: np.ndarray) -> Solution:
    """Least squares of rows scaled by root weights, of least norm; orthogonality is the largest |X'We| over the weight."""
    if not (np.isfinite(weights).all() and (weights > 0).all()):
        raise ValueError("weights must be finite and positive")
    root = np.sqrt(weights)
    beta = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
    fitted = x @ beta
    error = y - fitted
    spread = (weights * (y - np.average(y, weights=weights)) ** 2).sum()
    r2 = 1 - (weights * error**2).sum() / spread if spread > 0 else np.nan
    return Solution(beta, fitted, error, r2, float(np.abs(x.T @ (weights * error)).max() / max(weights.sum(), 1.0)))


def winsorize(y: np.ndarray, share: float) -> np.ndarray:
    finite = y[np.isfinite(y)]
    return y if share <= 0 or len(finite) < 3 else np.clip(y, *np.quantile(finite, [share, 1 - share]))


FIT = "date date, kind string, name string, value double, extra double, status string, n bigint"


def cross_sections(rows: DataFrame, styles: Sequence[str] = (), least: int = 30, share: float = 0.0, use_sectors: bool = True) -> DataFrame:
    """Long results of one regression a date on beta, sector dummies (or ALL) and styles, without an intercept.

    Rows (date, asset, ret, beta, sector, weight, styles). Kinds: ``factor`` (value), ``asset`` (value: residual against the
    winsorized return, extra: fitted) and ``date`` (value: r2, extra: orthogonality, status, n). A date under ``least`` valid rows
    has its ``date`` row alone. A date's cross-section is one task's work; dates are many.
    """

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        numbers = part[["ret", "beta", "weight", *styles]].to_numpy(float)
        part = part[np.isfinite(numbers).all(1) & (part["weight"].to_numpy(float) > 0) & part["sector"].notna().to_numpy()].sort_values("asset")
        n = len(part)
        if n < least:
            return pd.DataFrame([(key[0], "date", None, None, None, "INSUFFICIENT_CROSS_SECTION", n)], columns=names)
        sectors = sorted(part["sector"].unique()) if use_sectors else ["ALL"]
        dummies = (part["sector"].to_numpy()[:, None] == np.array(sectors, object)).astype(float) if use_sectors else np.ones((n, 1))
        x = np.column_stack([part["beta"].to_numpy(float), dummies, part[list(styles)].to_numpy(float)])
        found = solve_wls(winsorize(part["ret"].to_numpy(float), share), x, part["weight"].to_numpy(float))
        factors = pd.DataFrame({"kind": "factor", "name": ["BETA", *(f"SECTOR::{s}" for s in sectors), *styles], "value": found.coefficients})
        assets = pd.DataFrame({"kind": "asset", "name": part["asset"].to_numpy(), "value": found.residuals, "extra": found.fitted})
        date = pd.DataFrame({"kind": ["date"], "value": [found.r2], "extra": [found.orthogonality], "status": ["OK"], "n": [n]})
        return pd.concat([factors, assets, date], ignore_index=True).assign(date=key[0]).reindex(columns=names).astype({"n": "Int64"})

    names = [f.split()[0] for f in FIT.split(", ")]
    return rows.select("date", "asset", "ret", "beta", "sector", "weight", *styles).groupBy("date").applyInPandas(fit, FIT)


def simple_regression(y: str, x: str, *keys: str, least: int = 5) -> list[Column]:
    """Aggregates n, alpha, beta, r2 of y on x over rows with both; all but n NULL under ``least`` rows, r2 NULL for a constant y."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    py, px = F.when(both, F.col(y)), F.when(both, F.col(x))
    n, sxy, sxx, syy = F.count(py), F.covar_pop(py, px), F.var_pop(px), F.var_pop(py)
    beta = F.coalesce(ratio(sxy, F.nullif(sxx, F.lit(0.0))), F.lit(0.0))
    enough = n >= least
    return [n.alias("n"), F.when(enough, F.avg(py) - beta * F.avg(px)).alias("alpha"), F.when(enough, beta).alias("beta"), F.when(enough & (syy > 0), beta * sxy / syy).alias("r2")]


def stacked(arrays: pd.Series, *shape: int) -> np.ndarray:
    """A batch's arrays as one block of numbers, NaN for NULL."""
    empty = [np.nan] * math.prod(shape)
    return np.array([empty if a is None else a for a in arrays], dtype=float).reshape(-1, *shape)


def moment_regression(rows: DataFrame, y: str, xs: Sequence[str], *keys: str) -> DataFrame:
    """(keys, n, alpha, betas, r2): OLS with intercept on complete rows from moments; NULL under max(5, k + 2) rows.

    Columns are centred on their mean of the key first, so that sums of squares keep their digits.
    """
    k, names = len(xs), [y, *xs]
    full = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in names)).withColumn("_all", F.lit(1))
    means = full.groupBy("_all", *keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)))
    centred = full.join(means, ["_all", *keys]).select("_all", *keys, *((F.col(c) - F.col(f"_m{i}")).alias(f"_c{i}") for i, c in enumerate(names)))
    crossed = centred.groupBy("_all", *keys).agg(F.array(*(F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")) for i in range(k + 1) for j in range(k + 1))).alias("m"))
    centre = means.select("_all", *keys, "n", F.array(*(F.col(f"_m{i}") for i in range(k + 1))).alias("centre"))

    @F.pandas_udf("alpha double, betas array<double>, r2 double")
    def solve(m: pd.Series, centre: pd.Series, n: pd.Series) -> pd.DataFrame:
        moments, means, count = stacked(m, k + 1, k + 1), stacked(centre, k + 1), n.to_numpy()
        # Under the least count nothing is solved: such moments may hold anything.
        enough = count >= max(5, k + 2)
        moments[~enough] = 0
        beta = (np.linalg.pinv(moments[:, 1:, 1:], hermitian=True) @ moments[:, 1:, :1])[..., 0]
        explained, total = (beta * moments[:, 1:, 0]).sum(1), moments[:, 0, 0]
        r2 = np.divide(explained, total, out=np.full(len(n), np.nan), where=total > 0)
        alpha = means[:, 0] - (beta * means[:, 1:]).sum(1)
        return pd.DataFrame({"alpha": np.where(enough, alpha, np.nan), "betas": [b.tolist() if e else None for b, e in zip(beta, enough)], "r2": r2})

    solved = crossed.join(centre, ["_all", *keys]).withColumn("_s", solve("m", "centre", "n"))
    return solved.select(*keys, "n", "_s.alpha", "_s.betas", "_s.r2")


def residual_momentum(rows: DataFrame, factors: Sequence[str], window: int = 36, least: int = 24, formation: int = 11, skip: int = 1) -> DataFrame:
    """(date, asset, score) from a dense monthly grid (date, asset, ret, three factors).

    OLS with intercept over the ``window`` months before; the score is the sum of residuals of the formation months (all must be
    there) over their sample deviation in the whole window. All from moment sums over two frames: no window is copied.
    """
    if len(factors) != 3:
        raise ValueError("three factors are needed")
    valid = F.col("ret").isNotNull() & F.expr(" AND ".join(f"{f} IS NOT NULL" for f in factors))
    names = ["_one", *factors, "ret"]
    base = rows.withColumn("_one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    whole, recent = frame(-window, -1, "asset"), frame(-formation - skip, -1 - skip, "asset")
    product = lambda a, b: F.when(valid, F.col(a) * F.col(b))
    sums = F.array(*(F.sum(product(a, b)).over(whole) for a, b in pairs))
    formed = F.array(*(F.sum(product("_one", b)).over(recent) for b in names))
    held = base.select("date", "asset", sums.alias("m"), formed.alias("f"), F.count(product("_one", "_one")).over(recent).alias("k"))

    places = np.array([[pairs.index((min(a, b, key=names.index), max(a, b, key=names.index))) for b in names] for a in names])

    @F.pandas_udf("double")
    def score(m: pd.Series, f: pd.Series, k: pd.Series) -> pd.Series:
        sums, recent_sums = stacked(m, len(pairs)), stacked(f, len(names))
        usable = (np.nan_to_num(sums[:, 0]) >= least) & (k.to_numpy() >= formation)
        full, recent_sums, out = sums[usable][:, places], recent_sums[usable], np.full(len(m), np.nan)
        x, xy = full[:, :4, :4], full[:, :4, 4]
        beta = (np.linalg.pinv(x, hermitian=True, rcond=1e-14) @ xy[..., None])[..., 0]
        sse = full[:, 4, 4] - 2 * (beta * xy).sum(1) + np.einsum("ni,nij,nj->n", beta, x, beta)
        deviation = np.sqrt(np.maximum(sse, 0) / (full[:, 0, 0] - 1))
        total = recent_sums[:, 4] - (beta * recent_sums[:, :4]).sum(1)
        out[usable] = np.divide(total, deviation, out=np.full(len(total), np.nan), where=deviation > 0)
        return pd.Series(out)

    return held.select("date", "asset", score("m", "f", "k").alias("score")).where("score IS NOT NULL")
