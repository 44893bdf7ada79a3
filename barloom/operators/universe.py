"""Universe screen: trend, liquidity and 12-1 month momentum."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import ratio

# --- fixed values -----------------------------------------------------------
MIN_AVG_DOLLAR_VOLUME = 50e6
TOP_SHARE = 0.50
MIN_NAMES, MAX_NAMES = 20, 80
TREND_ROWS, LIQUIDITY_ROWS, SKIP_ROWS, YEAR_ROWS = 200, 63, 21, 252
SCREEN_MONTHS = 14
# ----------------------------------------------------------------------------


def recent(bars: DataFrame, asof: str, months: int = SCREEN_MONTHS) -> DataFrame:
    """Bars of the last ``months`` months up to ``asof``; a name that stopped trading before has none.

    The bounds are plain literals on the date column, so a scan below can prune by them.
    """
    end = datetime.date.fromisoformat(asof)
    year, month = divmod(end.year * 12 + end.month - 1 - months, 12)
    start = datetime.date(year, month + 1, min(end.day, calendar.monthrange(year, month + 1)[1]))
    return bars.where((F.col("date") > F.lit(start)) & (F.col("date") <= F.lit(end)))


def screen_stats(bars: DataFrame, asof: str | None = None, months: int = SCREEN_MONTHS) -> DataFrame:
    """(symbol, last, sma200, avg_dollar_volume, momentum) from each symbol's last 252 bars within the months before ``asof``.

    The reverse row number is filtered right away, which Spark turns into a
    group limit ahead of the shuffle.
    """
    if asof is not None:
        bars = recent(bars, asof, months)
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = bars.where(F.col("close").isNotNull()).withColumn("back", F.row_number().over(back)).where(F.col("back") <= YEAR_ROWS)
    traded = F.count("volume").over(back.rowsBetween(Window.unboundedPreceding, 0))

    def at(n: int) -> Column:
        return F.max(F.when(F.col("back") == n, F.col("close")))

    return (
        rows.withColumn("_traded", traded)
        .groupBy("symbol")
        .agg(
            F.count("*").alias("n_rows"),
            at(1).alias("last"),
            F.avg(F.when(F.col("back") <= TREND_ROWS, F.col("close"))).alias("sma200"),
            F.avg(F.when(F.col("volume").isNotNull() & (F.col("_traded") <= LIQUIDITY_ROWS), F.col("volume") * F.col("close"))).alias("avg_dollar_volume"),
            (ratio(at(SKIP_ROWS), at(YEAR_ROWS)) - 1).alias("momentum"),
        )
    )


def candidates(bars: DataFrame, min_dollar_volume: float = MIN_AVG_DOLLAR_VOLUME, asof: str | None = None, months: int = SCREEN_MONTHS) -> DataFrame:
    """Symbols in an up-trend with a full year and enough turnover (unknown volume passes)."""
    return screen_stats(bars, asof, months).where(
        (F.col("n_rows") >= YEAR_ROWS)
        & (F.col("last") >= F.col("sma200"))
        & (F.col("avg_dollar_volume").isNull() | (F.col("avg_dollar_volume") >= min_dollar_volume))
    )


def screen_universe(
    bars: DataFrame, min_dollar_volume: float = MIN_AVG_DOLLAR_VOLUME, fallback: DataFrame | None = None, asof: str | None = None, months: int = SCREEN_MONTHS
) -> DataFrame:
    """(rank, symbol, momentum): best half by momentum, between 20 and 80 names.

    With ``asof`` only the bars of the months before it count. At most ``MAX_NAMES``
    rows survive the distributed top-n, only those are
    numbered. ``fallback`` (symbol, ordinal) is used when nothing qualifies.
    """
    passed = candidates(bars, min_dollar_volume, asof, months)
    n = passed.agg(F.count("*").alias("n")).scalar()
    keep = F.greatest(F.lit(MIN_NAMES), F.least(F.lit(MAX_NAMES), F.floor(n * TOP_SHARE)))
    top = passed.orderBy(F.desc("momentum"), "symbol").limit(MAX_NAMES)
    rank = F.row_number().over(Window.orderBy(F.desc("momentum"), "symbol")).cast("long")
    chosen = top.select(rank.alias("rank"), "symbol", "momentum").where(F.col("rank") <= keep)
    if fallback is None:
        return chosen
    rest = fallback.where(n == 0).select(F.col("ordinal").cast("long").alias("rank"), "symbol", F.lit(None).cast("double").alias("momentum"))
    return chosen.unionByName(rest)
