"""Static dimensions and parameters of the research process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
WATCHLIST = [
    "AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "META", "TSLA", "JPM", "V", "UNH", "JNJ", "XOM", "PG", "HD", "NFLX",
]
SECTORS = {
    "AAPL": "Technology",
    "MSFT": "Technology",
    "NVDA": "Technology",
    "GOOGL": "Technology",
    "META": "Technology",
    "AMZN": "Consumer Discretionary",
    "TSLA": "Consumer Discretionary",
    "HD": "Consumer Discretionary",
    "NFLX": "Communication Services",
    "JPM": "Financials",
    "V": "Financials",
    "UNH": "Healthcare",
    "JNJ": "Healthcare",
    "XOM": "Energy",
    "PG": "Consumer Staples",
}
SECTOR_INDEX = {
    "AAPL": "XLK",
    "MSFT": "XLK",
    "NVDA": "XLK",
    "GOOGL": "XLK",
    "META": "XLK",
    "NFLX": "XLK",
    "AMZN": "XLY",
    "TSLA": "XLY",
    "HD": "XLY",
    "JPM": "XLF",
    "V": "XLF",
    "UNH": "XLV",
    "JNJ": "XLV",
    "XOM": "XLE",
    "PG": "XLP",
}
MARKET_INDEX = "SPY"
MAX_SINGLE_POSITION = 0.15
MAX_SECTOR_WEIGHT = 0.35
MAX_STOCKS_HELD = 10
STYLES = {
    # style: (position scale, stop-loss multiplier, take-profit multiplier)
    "aggressive": (1.0, 2.5, 3.0),
    "balanced": (0.75, 2.0, 2.5),
    "conservative": (0.5, 1.5, 2.0),
}
DEFAULT_STYLE = "balanced"
# ----------------------------------------------------------------------------


def watchlist(spark: SparkSession) -> DataFrame:
    """(ordinal, symbol, sector, sector_index) of the static watchlist."""
    rows = [(i + 1, s, SECTORS[s], SECTOR_INDEX[s]) for i, s in enumerate(WATCHLIST)]
    return spark.createDataFrame(rows, "ordinal int, symbol string, sector string, sector_index string")


def styles(spark: SparkSession) -> DataFrame:
    """(style, position_scale, sl_mult, tp_mult)."""
    rows = [(s, *v) for s, v in STYLES.items()]
    return spark.createDataFrame(rows, "style string, position_scale double, sl_mult double, tp_mult double")


def merged_universe(*lists: DataFrame) -> DataFrame:
    """Order-preserving union of symbol lists ``(pos, symbol)``: first position wins.

    The symbol lists themselves are tables the caller supplies.
    """
    stacked = None
    for i, part in enumerate(lists):
        tagged = part.select(F.struct(F.lit(i).alias("list"), F.col("pos").cast("long").alias("pos")).alias("rank"), "symbol")
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked.groupBy("symbol").agg(F.min("rank").alias("rank")).select("symbol", "rank.list", "rank.pos")
