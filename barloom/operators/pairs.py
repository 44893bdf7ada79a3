"""Pair statistics over a universe: covariance, hedge ratio, cointegration, spread signals.

All pairs of a universe are needed, but never as rows of a join: symbols are
hashed into blocks, each pair of blocks becomes one task that holds two blocks of
calendar-sized series, and pairs are formed inside it with NumPy. A series is one
row of arrays, and is shuffled once per block instead of once per partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.alignment import fill_on_calendar
from barloom.functions.numeric import finite, py_round, ratio
from barloom.functions.series import pct_change, rolling_std, series, sma

# --- fixed values -----------------------------------------------------------
MIN_COMMON_DATES = 120
MIN_SPREAD_ROWS = 60
MAX_PVALUE = 0.05
Z_ENTRY, Z_EXIT = 2.0, 0.5
PAIR_ALLOCATION = 0.05
# response surface of the Engle-Granger test, two series with constant
# (MacKinnon 1994, 2010): polynomial below and above tau_star, bounds of tau
TAU_STAR, TAU_MIN, TAU_MAX = -2.62, -18.86, 0.92
TAU_SMALL = (2.92, 1.5012, 0.039796)
TAU_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)
# ----------------------------------------------------------------------------
BLOCK_SYMBOLS = 16


def complete_dates(bars: DataFrame) -> DataFrame:
    """Dates on which every symbol of the universe has a value."""
    n = bars.agg(F.count_distinct("symbol").alias("n")).scalar()
    return bars.where(F.col("close").isNotNull()).groupBy("date").agg(F.count("*").alias("k")).where(F.col("k") == n).select("date")


def aligned_returns(bars: DataFrame) -> DataFrame:
    """(symbol, date, ret): one-row returns on the union calendar, gaps held, complete dates only."""
    filled = fill_on_calendar(bars.select("symbol", "date", "close"), bars, "symbol", "close")
    ret = filled.withColumn("ret", pct_change("close", 1)).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")
    keep = complete_dates(ret.withColumnRenamed("ret", "close"))
    return ret.join(keep, "date", "left_semi")


def block_count(universe: DataFrame, block: int = BLOCK_SYMBOLS) -> int:
    """Number of symbol blocks; one count over the distinct symbols."""
    return max(1, -(-universe.select("symbol").distinct().count() // block))


def _by_block_pair(values: DataFrame, value: str, blocks: int) -> DataFrame:
    """(symbol, days, xs, blk, lo, hi): a series is packed into one row before it is copied to its block pairs."""
    b = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(b, j).alias("lo"), F.greatest(b, j).alias("hi")))
    point = F.struct(F.unix_date("date").alias("day"), F.col(value).cast("double").alias("x"))
    packed = values.where(F.col(value).isNotNull()).groupBy("symbol").agg(F.array_sort(F.collect_list(point)).alias("s"))  # calendar-sized
    return packed.select("symbol", F.col("s.day").alias("days"), F.col("s.x").alias("xs"), b.alias("blk"), F.explode(pairs).alias("bp")).select(
        "symbol", "days", "xs", "blk", "bp.lo", "bp.hi"
    )


def _pairs_in(pdf: pd.DataFrame) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """Every pair this block pair is responsible for, on the dates both have."""
    both = {int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])}
    series_ = sorted(zip(pdf["symbol"], pdf["blk"], map(np.asarray, pdf["days"]), map(np.asarray, pdf["xs"])), key=lambda r: r[0])
    for i, (s, home, days, x) in enumerate(series_):
        for t, other, days2, y in series_[i + 1 :]:
            if {home, other} == both:
                _, at, at2 = np.intersect1d(days, days2, assume_unique=True, return_indices=True)
                yield s, t, x[at], y[at2]


def pair_moments(values: DataFrame, value: str, blocks: int) -> DataFrame:
    """(symbol1, symbol2, n, cov, corr, slope) for every pair with two common dates.

    ``slope`` is the least-squares slope of symbol1 on symbol2 with intercept.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s, t, x, y in _pairs_in(pdf):
            n = len(x)
            if n < 2:
                continue
            dx, dy = x - x.mean(), y - y.mean()
            sxy, sxx, syy = float(dx @ dy), float(dx @ dx), float(dy @ dy)
            corr = sxy / np.sqrt(sxx * syy) if sxx > 0 and syy > 0 else None
            out.append((s, t, n, sxy / (n - 1), corr, sxy / syy if syy > 0 else None))
        return pd.DataFrame(out, columns=["symbol1", "symbol2", "n", "cov", "corr", "slope"])

    schema = "symbol1 string, symbol2 string, n long, cov double, corr double, slope double"
    return _by_block_pair(values, value, blocks).groupBy("lo", "hi").applyInPandas(run, schema)


def _least_squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, residual sum of squares, inverse of X'X)."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    return beta, float(resid @ resid), np.linalg.pinv(x.T @ x)


def unit_root_stat(resid: np.ndarray) -> float:
    """Augmented Dickey-Fuller t-statistic without constant, lag length by AIC."""
    n = len(resid)
    step = np.diff(resid)
    longest = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 1)

    def design(lags: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(step) - lags
        cols = [resid[lags : lags + rows]] + [step[lags - k : lags - k + rows] for k in range(1, lags + 1)]
        return step[lags:], np.column_stack(cols)

    y, x = design(longest)
    m = len(y)
    scores = []
    for k in range(1, longest + 2):
        _, ssr, _ = _least_squares(y, x[:, :k])
        scores.append((m * np.log(ssr / m) + 2 * k, k - 1))
    y, x = design(min(scores)[1])
    beta, ssr, inv = _least_squares(y, x)
    return float(beta[0] / np.sqrt(ssr / (len(y) - x.shape[1]) * inv[0, 0]))


def normal_cdf(z: float) -> float:
    from math import erf, sqrt

    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


def engle_granger(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(statistic, p-value) of the residual cointegration test of x on y with constant."""
    design = np.column_stack([y, np.ones(len(y))])
    beta, ssr, _ = _least_squares(x, design)
    spread = float(((x - x.mean()) ** 2).sum())
    if ssr <= 100 * np.sqrt(np.finfo(float).eps) * spread:
        return float("-inf"), 0.0
    tau = unit_root_stat(x - design @ beta)
    if tau > TAU_MAX:
        return tau, 1.0
    if tau < TAU_MIN:
        return tau, 0.0
    poly = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    return tau, normal_cdf(sum(c * tau**i for i, c in enumerate(poly)))


def cointegrated_pairs(bars: DataFrame, blocks: int, min_dates: int = MIN_COMMON_DATES, max_pvalue: float = MAX_PVALUE) -> DataFrame:
    """(symbol1, symbol2, pvalue, hedge_ratio) of the pairs that pass, by p-value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s, t, x, y in _pairs_in(pdf):
            if len(x) < min_dates:
                continue
            _, p = engle_granger(x, y)
            if p < max_pvalue:
                dy = y - y.mean()
                out.append((s, t, p, float((x - x.mean()) @ dy / (dy @ dy))))
        return pd.DataFrame(out, columns=["symbol1", "symbol2", "pvalue", "hedge_ratio"])

    found = (
        _by_block_pair(bars.where(F.col("close").isNotNull()), "close", blocks)
        .groupBy("lo", "hi")
        .applyInPandas(run, "symbol1 string, symbol2 string, pvalue double, hedge_ratio double")
    )
    return found.select("symbol1", "symbol2", py_round("pvalue", 4).alias("pvalue"), py_round("hedge_ratio", 4).alias("hedge_ratio")).orderBy(
        "pvalue", "symbol1", "symbol2"
    )


def pair_spreads(pairs: DataFrame, bars: DataFrame) -> DataFrame:
    """(pair, date, spread): both legs on their common dates."""
    left = bars.select(F.col("symbol").alias("symbol1"), "date", F.col("close").alias("c1"))
    right = bars.select(F.col("symbol").alias("symbol2"), "date", F.col("close").alias("c2"))
    return (
        pairs.join(left, "symbol1")
        .join(right, ["symbol2", "date"])
        .select(*pairs.columns, "date", (F.col("c1") - F.col("hedge_ratio") * F.col("c2")).alias("spread"))
    )


def pair_signals(pairs: DataFrame, bars: DataFrame) -> DataFrame:
    """Latest spread z-score per pair and the trade it implies; ``bars`` is the lookback window."""
    keyed = pair_spreads(pairs, bars).withColumn("pair", F.struct("symbol1", "symbol2"))
    z = ratio(F.col("spread") - sma("spread", MIN_SPREAD_ROWS, key="pair"), rolling_std("spread", MIN_SPREAD_ROWS, key="pair"))
    scored = keyed.select(*pairs.columns, "date", z.alias("z"), F.count("*").over(Window.partitionBy("pair")).alias("n"))
    last = (
        scored.where(F.col("n") >= MIN_SPREAD_ROWS)
        .groupBy("symbol1", "symbol2", "pvalue")
        .agg(F.max_by("z", "date").alias("z"))
        .where(finite("z").isNotNull())
    )
    zc = F.col("z")
    signal = F.when(zc > Z_ENTRY, "enter_short_spread").when(zc < -Z_ENTRY, "enter_long_spread").when(F.abs(zc) < Z_EXIT, "exit").otherwise("hold")

    def leg(short: str, long: str) -> Column:
        return F.when(zc > Z_ENTRY, F.col(short)).when(zc < -Z_ENTRY, F.col(long))

    return last.select(
        "symbol1", "symbol2", py_round("z", 3).alias("zscore"), signal.alias("signal"),
        leg("symbol2", "symbol1").alias("long_symbol"), leg("symbol1", "symbol2").alias("short_symbol"), "pvalue",
    )


def pair_weight_deltas(signals: DataFrame, allocation: float = PAIR_ALLOCATION) -> DataFrame:
    """(symbol, weight): a fixed allocation per long-spread signal, summed per symbol."""
    longs = signals.where((F.col("signal") == "enter_long_spread") & F.col("long_symbol").isNotNull())
    return longs.groupBy(F.col("long_symbol").alias("symbol")).agg((F.count("*") * F.lit(allocation)).alias("weight"))


def trailing_relative_return(bars: DataFrame, rows: int = 20) -> DataFrame:
    """(symbol, date, ret): return over the last ``rows`` rows."""
    return bars.select("symbol", "date", pct_change("close", rows, series()).alias("ret"))
