"""Options flow: put/call ratio, volatility skew, call activity and their composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, py_round
from barloom.functions.ranking import with_median

# --- fixed values -----------------------------------------------------------
MIN_OPEN_INTEREST = 10
MAX_CALL_ACTIVITY = 5.0
BULLISH_COMPOSITE = 0.2
# ----------------------------------------------------------------------------


def is_liquid() -> Column:
    return F.coalesce(F.col("open_interest") > MIN_OPEN_INTEREST, F.lit(False))


def liquid(options: DataFrame) -> DataFrame:
    return options.where(is_liquid())


def iv_counts(options: DataFrame, n: int = 2) -> DataFrame:
    """Liquid contracts of the ``n`` nearest expiries as (symbol, snapshot_date, side, iv, contracts, vol, oi).

    Contracts collapse on the map side before expiries are ranked, so the table is
    read once and a hot symbol sorts its distinct (expiry, side, iv) only. A zero
    volatility counts as missing.
    """
    keys = ["symbol", "snapshot_date", "expiry", "side", "iv"]
    liquid_ = is_liquid()
    counts = options.select("*", F.nullif(F.col("iv"), F.lit(0.0)).alias("_iv")).drop("iv").withColumnRenamed("_iv", "iv").groupBy(*keys).agg(
        F.count_if(liquid_).alias("contracts"),
        F.sum(F.when(liquid_, F.coalesce("volume", F.lit(0.0)))).alias("vol"),
        F.sum(F.when(liquid_, F.col("open_interest"))).alias("oi"),
    )
    order = Window.partitionBy("symbol", "snapshot_date").orderBy("expiry")
    return counts.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= n).drop("_rank", "expiry")


def median_iv(options: DataFrame) -> DataFrame:
    """(symbol, snapshot_date, side, iv): median volatility of all contracts, zeros left out."""
    keys = ["symbol", "snapshot_date", "side"]
    counts = options.groupBy(*keys, F.nullif(F.col("iv"), F.lit(0.0)).alias("_iv")).agg(F.count("*").alias("_n"))
    return with_median(counts, keys, "_iv", "_n", "iv").groupBy(*keys).agg(F.first("iv").alias("iv"))


def options_signal(options: DataFrame, decimals: bool = True) -> DataFrame:
    """One row per (symbol, snapshot); neutral when calls or puts have no liquid contract."""
    near = with_median(iv_counts(options), ["symbol", "snapshot_date", "side"], "iv", "contracts")

    def on(side: str, c: str) -> Column:
        return F.when(F.col("side") == side, F.col(c))

    g = near.groupBy("symbol", "snapshot_date").agg(
        F.coalesce(F.sum(on("C", "contracts")), F.lit(0)).alias("n_call"),
        F.coalesce(F.sum(on("P", "contracts")), F.lit(0)).alias("n_put"),
        F.coalesce(F.sum(on("C", "vol")), F.lit(0.0)).alias("call_vol"),
        F.coalesce(F.sum(on("P", "vol")), F.lit(0.0)).alias("put_vol"),
        F.sum(on("C", "oi")).alias("call_oi"),
        F.max(on("C", "median")).alias("call_iv"),
        F.max(on("P", "median")).alias("put_iv"),
    )
    pc = F.coalesce(F.try_divide(F.col("put_vol"), F.col("call_vol")), F.lit(1.0))
    skew = F.coalesce(F.col("put_iv") - F.col("call_iv"), F.lit(0.0))
    activity = F.least(F.coalesce(F.try_divide(F.col("call_vol"), F.col("call_oi")), F.lit(1.0)), F.lit(MAX_CALL_ACTIVITY))
    neutral = (F.col("n_call") == 0) | (F.col("n_put") == 0)
    s = g.select(
        "symbol",
        "snapshot_date",
        F.when(neutral, 1.0).otherwise(pc).alias("pc"),
        F.when(neutral, 0.0).otherwise(skew).alias("sk"),
        F.when(neutral, 1.0).otherwise(activity).alias("act"),
    )
    score = (
        clip((F.lit(1.0) - F.col("pc")) / 0.6, -1, 1) * 0.4
        + clip(-F.col("sk") / 0.10, -1, 1) * 0.4
        + clip((F.col("act") - 1.0) / 1.5, -1, 1) * 0.2
    )
    r = py_round if decimals else (lambda x, _: x)
    return s.select(
        "symbol",
        "snapshot_date",
        r(F.col("pc"), 3).alias("put_call_ratio"),
        r(F.col("sk"), 4).alias("iv_skew"),
        r(F.col("act"), 3).alias("unusual_call_vol"),
        r(score, 3).alias("options_composite"),
    )


def bullish_flow(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("options_composite") > BULLISH_COMPOSITE)
