"""Insider transactions: buying score and its alignment to the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import py_round, to_double
from barloom.functions.text import is_buy, is_sell

# --- fixed values -----------------------------------------------------------
LOOKBACK_DAYS = 90
MIN_PURCHASE = 10_000.0
FULL_BREADTH = 5.0
# ----------------------------------------------------------------------------


def since(tx: DataFrame, asof: str, days: int) -> DataFrame:
    """Transactions of the last ``days`` days; the future of ``asof`` is excluded. Without dates all of them."""
    if "tx_date" not in tx.columns:
        return tx
    end = F.lit(asof).cast("date")
    return tx.where((F.col("tx_date") >= F.date_sub(end, days)) & (F.col("tx_date") <= end))


def sides(tx: DataFrame) -> list[Column]:
    """``buy`` and ``sell`` flags; small purchases do not count where values are known at all."""
    buy, sell = (is_buy(F.col("text")), is_sell(F.col("text"))) if "text" in tx.columns else (F.lit(False), F.lit(False))
    if "value" in tx.columns:
        buy = buy & F.coalesce(F.abs(to_double("value")) >= MIN_PURCHASE, F.lit(False))
    return [buy.alias("buy"), sell.alias("sell")]


def buyers(tx: DataFrame, buy: Column) -> Column:
    """Distinct insiders among the rows where ``buy`` holds; without names every transaction is one."""
    return F.count_distinct(F.when(buy, F.col("insider"))) if "insider" in tx.columns else F.count_if(buy)


def _scores(n_buy: str, n_sell: str) -> tuple[Column, Column]:
    """(purchase ratio, score) from counts and ``n_insiders``."""
    share = F.coalesce(F.try_divide(F.col(n_buy).cast("double"), F.col(n_buy) + F.col(n_sell)), F.lit(0.0))
    return share, share * share * 0.6 + F.least(F.col("n_insiders") / FULL_BREADTH, F.lit(1.0)) * 0.4


def insider_signal(tx: DataFrame, asof: str, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """(symbol, purchase_ratio, n_insiders, insider_score) for symbols with recent rows.

    Small purchases are ignored, sales are not; no countable row gives zeros.
    """
    rows = since(tx, asof, lookback).select("*", *sides(tx))
    g = rows.groupBy("symbol").agg(
        F.count_if("buy").alias("n_buy"), F.count_if("sell").alias("n_sell"), buyers(tx, F.col("buy")).alias("n_insiders")
    )
    share, score = _scores("n_buy", "n_sell")
    return g.select(
        "symbol", py_round(share, 3).alias("purchase_ratio"), "n_insiders", py_round(score, 3).alias("insider_score")
    )


def point_in_time_score(panel: DataFrame, tx: DataFrame, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Score as it was known on each panel date (the snapshot form looks ahead); needs dates.

    A transaction comes into force on its day and leaves ``lookback`` days later;
    an insider counts from a purchase until the last one before a longer pause
    leaves. Those steps are summed per symbol and day, and a running sum beside
    the panel rows gives the counts: two rows per transaction, none per panel row.
    """
    facts = tx.select("*", *sides(tx)).where("buy or sell")
    entered, left = F.col("tx_date"), F.date_add("tx_date", lookback + 1)

    def steps(rows: DataFrame, day: Column, buy: Column, sell: Column, insider: Column) -> DataFrame:
        return rows.select("symbol", day.alias("date"), buy.cast("long").alias("db"), sell.cast("long").alias("ds"), insider.cast("long").alias("di"))

    none, b, s = F.lit(0), F.col("buy").cast("long"), F.col("sell").cast("long")
    parts = [steps(facts, entered, b, s, none), steps(facts, left, -b, -s, none)]
    if "insider" in tx.columns:
        days = facts.where("buy and insider is not null").select("symbol", "insider", "tx_date").distinct()
        own = Window.partitionBy("symbol", "insider").orderBy("tx_date")
        runs = days.select("*", F.lag("tx_date").over(own).alias("_before"), F.lead("tx_date").over(own).alias("_after"))
        starts = runs.where(F.col("_before").isNull() | (F.date_add("_before", lookback) < F.col("tx_date")))
        ends = runs.where(F.col("_after").isNull() | (F.date_add("tx_date", lookback) < F.col("_after")))
        parts += [steps(starts, entered, none, none, F.lit(1)), steps(ends, left, none, none, F.lit(-1))]
    else:
        parts += [steps(facts.where("buy"), entered, none, none, F.lit(1)), steps(facts.where("buy"), left, none, none, F.lit(-1))]
    moves = parts[0]
    for p in parts[1:]:
        moves = moves.unionByName(p)
    sums = ["db", "ds", "di"]
    moves = moves.groupBy("symbol", "date").agg(*[F.sum(c).alias(c) for c in sums])
    row = F.struct(*[F.col(f"`{c}`") for c in panel.columns])
    probes = panel.select("symbol", "date", *[F.lit(0).cast("long").alias(c) for c in sums], row.alias("_row"))
    kind = probes.schema["_row"].dataType
    both = probes.unionByName(moves.withColumn("_row", F.lit(None).cast(kind)))
    upto = Window.partitionBy("symbol").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    names = {"db": "n_buy", "ds": "n_sell", "di": "n_insiders"}
    counted = both.select("_row", *[F.sum(c).over(upto).alias(n) for c, n in names.items()]).where("_row is not null")
    return counted.select("_row.*", py_round(_scores("n_buy", "n_sell")[1], 3).alias("insider_score"))
