"""Hierarchical risk parity for many rebalance dates at once.

Spark assembles the lookback window of every (run date, symbol) and groups by run
date; only the clustering of one bounded universe (the screen keeps at most 80
names) runs inside a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.alignment import asof_backward

# --- fixed values -----------------------------------------------------------
LOOKBACK_ROWS = 252
MIN_FILLED_SHARE = 0.8
MIN_RETURNS = 30
# ----------------------------------------------------------------------------

# one run date is clustered in one task; the screen keeps at most 80 names
MAX_NAMES = 1_000


def lookback_windows(bars: DataFrame, runs: DataFrame, rows: int = LOOKBACK_ROWS) -> DataFrame:
    """(run_date, symbol, date, close) of the last ``rows`` calendar rows before each run.

    Each run date expands to its own calendar ordinals (runs x rows, small) and
    picks the bars by an equi-join on date.
    """
    cal = bars.select("date").distinct().withColumn("_k", F.row_number().over(Window.orderBy("date")))
    one = F.lit(1).alias("_one")
    last = asof_backward(
        runs.select(one, "run_date").distinct(), cal.select(one, "date", F.col("_k").alias("_hi")), ["_hi"], by="_one", probe_time="run_date"
    ).where(F.col("_hi").isNotNull())
    wanted = last.select("run_date", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_hi") - (rows - 1)), F.col("_hi"))).alias("_k"))
    return wanted.join(cal, "_k").join(bars.where(F.col("close").isNotNull()), "date").select("run_date", "symbol", "date", "close")


def ward_order(dist: np.ndarray) -> list[int]:
    """Leaf order of the Ward dendrogram of a distance matrix, nearest clusters merged first.

    Lance-Williams updates; ties go to the lowest indices. Within a merge the
    cluster with the lower id comes first.
    """
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    cluster = np.arange(n)
    leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
    alive = np.ones(n, dtype=bool)
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        a, b = sorted((int(cluster[i]), int(cluster[j])))
        leaves[n + step] = leaves[a] + leaves[b]
        others = np.flatnonzero(alive)
        others = others[(others != i) & (others != j)]
        si, sj, so = size[i], size[j], size[others]
        new = np.sqrt(((si + so) * d[i, others] ** 2 + (sj + so) * d[j, others] ** 2 - so * d[i, j] ** 2) / (si + sj + so))
        d[i, others] = d[others, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i], cluster[i], alive[j] = si + sj, n + step, False
    return leaves[2 * n - 2]


def bisect_weights(cov: np.ndarray) -> np.ndarray:
    """Split the ordered assets in halves repeatedly, weighting by inverse cluster variance."""
    w = np.ones(len(cov))

    def variance(ix: np.ndarray) -> float:
        block = cov[np.ix_(ix, ix)]
        inv = 1.0 / np.diag(block)
        inv /= inv.sum()
        return float(inv @ block @ inv)

    stack = [np.arange(len(cov))]
    while stack:
        ix = stack.pop()
        if len(ix) < 2:
            continue
        left, right = ix[: len(ix) // 2], ix[len(ix) // 2 :]
        vl, vr = variance(left), variance(right)
        share = 1.0 - vl / (vl + vr)
        w[left] *= share
        w[right] *= 1.0 - share
        stack += [left, right]
    return w / w.sum()


def risk_parity(returns: np.ndarray) -> np.ndarray:
    """Weights of the columns of a (rows, assets) return matrix."""
    cov = np.atleast_2d(np.cov(returns, rowvar=False))
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = cov / np.outer(sd, sd)
    corr = np.clip(np.nan_to_num(corr, nan=0.0, posinf=0.0, neginf=0.0), -1, 1)
    np.fill_diagonal(corr, 1.0)
    order = ward_order(np.sqrt(0.5 * (1.0 - corr)))
    out = np.empty(len(order))
    out[order] = bisect_weights(cov[np.ix_(order, order)])
    return out


def hrp_weights(windows: DataFrame, lookback: int = LOOKBACK_ROWS, names: DataFrame | None = None) -> DataFrame:
    """(run_date, symbol, weight) from (run_date, symbol, date, close) lookback windows.

    ``names`` (run_date, symbol) is the universe; one of its names without closes
    counts like one with too few. Names present on fewer than 80 % of the lookback
    rows get 0. With fewer than two usable names or 30 common returns the weights
    of all names are equal. One run date is one task: a universe above MAX_NAMES
    is refused.
    """
    floor = int(lookback * MIN_FILLED_SHARE)
    if names is not None:
        empty = names.select("run_date", "symbol", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("close"))
        windows = windows.select("run_date", "symbol", "date", "close").unionByName(empty)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(pdf["symbol"].unique())
        if len(members) > MAX_NAMES:
            raise ValueError(f"{len(members)} names on one run date; screen them to {MAX_NAMES} or fewer first")
        known = pdf[pdf["close"].notna()]
        wide = known.pivot(index="date", columns="symbol", values="close").sort_index()
        weights = pd.Series(1.0 / len(members), index=members)
        usable = [s for s in wide.columns if wide[s].notna().sum() >= floor]
        if len(usable) >= 2:
            held = wide[usable].ffill()
            ret = (held / held.shift(1) - 1).dropna().to_numpy()
            if len(ret) >= MIN_RETURNS and (w := risk_parity(ret)) is not None and np.isfinite(w).all():
                weights[:] = 0.0
                weights[usable] = w
        return pd.DataFrame({"run_date": pdf["run_date"].iloc[0], "symbol": members, "weight": weights.to_numpy()})

    return windows.groupBy("run_date").applyInPandas(run, "run_date date, symbol string, weight double")
