"""Portfolio algebra: constraints, overlays, snapshots and rebalance orders.

Every operator works on many portfolios at once; ``by`` names the columns that
identify one. A portfolio is a bounded set of names, the number of portfolios is
what grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, py_round, ratio
from barloom.sources.dims import MAX_SECTOR_WEIGHT, MAX_SINGLE_POSITION, MAX_STOCKS_HELD

# --- fixed values -----------------------------------------------------------
NEGLIGIBLE_WEIGHT = 0.005
MIN_TURNOVER = 0.005
SELL_HAIRCUT = 0.995
# ----------------------------------------------------------------------------
EXACT = "decimal(20,4)"  # weights carry four digits: sums are exact in any order


def with_sector(weights: DataFrame, dims: DataFrame, default: str = "Other") -> DataFrame:
    """Left lookup of the sector; Spark broadcasts ``dims`` when its known size allows."""
    return weights.join(dims.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def _total(by: Sequence[str], *extra: str) -> Column:
    return F.sum(F.col("weight").cast(EXACT)).over(Window.partitionBy(*by, *extra)).cast("double")


def apply_constraints(raw: DataFrame, allowed: DataFrame, by: Sequence[str] = ("run_date",)) -> DataFrame:
    """Proposed weights (text or number) -> weights within all limits, plus the cash left.

    The order of the steps matters and is kept: allowed names, numeric cast, cap
    per name, drop negligible, four digits, scale over-weight sectors by their
    total before scaling, scale the sum to one, keep the ten largest.
    """
    number = F.col("weight").try_cast("double")
    capped = clip(F.when(~F.isnan(number), number), 0.0, MAX_SINGLE_POSITION)
    w = (
        raw.join(allowed.select("symbol"), "symbol", "left_semi")
        .withColumn("weight", capped)
        .where(F.col("weight") > NEGLIGIBLE_WEIGHT)
        .withColumn("weight", py_round("weight", 4))
    )
    w = with_sector(w, allowed).withColumn("_t", _total(by, "sector"))
    over = F.col("_t") > MAX_SECTOR_WEIGHT
    w = w.withColumn("weight", F.when(over, py_round(F.col("weight") * (F.lit(MAX_SECTOR_WEIGHT) / F.col("_t")), 4)).otherwise(F.col("weight")))
    w = w.withColumn("_t", _total(by))
    w = w.withColumn("weight", F.when(F.col("_t") > 1.0, py_round(F.col("weight") * (F.lit(1.0) / F.col("_t")), 4)).otherwise(F.col("weight")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "symbol"))
    held = w.withColumn("rank", rank).where(F.col("rank") <= MAX_STOCKS_HELD)
    return held.select(*by, "rank", "symbol", "sector", "weight", py_round(F.lit(1.0) - _total(by), 4).alias("cash_reserve"))


def merge_weights(
    base: DataFrame,
    fallback: DataFrame | None = None,
    pairs: DataFrame | None = None,
    events: DataFrame | None = None,
    multiplier: DataFrame | None = None,
    by: Sequence[str] = ("run_date",),
) -> DataFrame:
    """Base weights (``fallback`` for portfolios without any) + pair deltas + events, x macro.

    An overlay renormalises a portfolio that it touches and takes above one; pairs
    come first. All inputs are stacked and placed by portfolio once, every sum is
    taken on that placement. Overlays come after the caps and may exceed them, as designed; run
    :func:`barloom.operators.logs.compliance` on the result to see where.
    """
    keys = [*by, "symbol"]
    inputs = {"base": base, "fallback": fallback, "pairs": pairs, "events": events}
    none = F.lit(None).cast("double")
    stacked = [df.select(*keys, F.col("weight").cast("double").alias("weight"), F.lit(kind).alias("_kind"), none.alias("_m")) for kind, df in inputs.items() if df is not None]
    if multiplier is not None:
        stacked.append(multiplier.select(*by, F.lit(None).cast("string").alias("symbol"), none.alias("weight"), F.lit("macro").alias("_kind"), F.col("equity_mult").cast("double").alias("_m")))
    placed = reduce(DataFrame.unionByName, stacked).repartition(*by)

    def part(kind: str, of: Column) -> Column:
        return of(F.when(F.col("_kind") == kind, F.col("weight")))

    rows = placed.groupBy(*keys).agg(
        *[part(k, F.sum).alias(f"_{k}") for k in inputs], *[part(k, F.count).alias(f"_n_{k}") for k in inputs],
        F.count_if(F.col("_kind") != "macro").alias("_rows"), F.max("_m").alias("_m"),
    )
    w = Window.partitionBy(*by)
    zero = F.lit(0.0)
    rows = rows.withColumns({"_own": F.max("_n_base").over(w) > 0, "_mult": F.coalesce(F.max("_m").over(w), F.lit(1.0)), "_p": F.max("_n_pairs").over(w) > 0, "_e": F.max("_n_events").over(w) > 0})
    start = F.when(F.col("_own"), F.col("_base")).otherwise(F.col("_fallback"))

    def added(before: Column, overlay: str, touched: str, df: DataFrame) -> DataFrame:
        held = df.withColumn("weight", F.when(before.isNull() & F.col(overlay).isNull(), none).otherwise(F.coalesce(before, zero) + F.coalesce(overlay, zero)))
        total = F.sum("weight").over(w)
        return held.withColumn("_t", total).withColumn("weight", F.when(F.col(touched) & (F.col("_t") > 1.0), F.col("weight") / F.col("_t")).otherwise(F.col("weight")))

    out = added(F.col("weight"), "_events", "_e", added(start, "_pairs", "_p", rows))
    scaled = F.when(F.col("_mult") < 1.0, F.col("weight") * F.col("_mult")).otherwise(F.col("weight"))
    return out.where((F.col("_rows") > 0) & F.col("weight").isNotNull()).select(*keys, scaled.alias("weight"))


def snapshot_positions(
    weights: DataFrame, prices: DataFrame, equity: float | DataFrame, run_date: str, previous: DataFrame | None = None, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(positions, account) to be checked on the next run.

    Non-positive weights and names without a price are dropped; the first
    starting equity is kept so that drawdown is measured from it. With ``by``,
    ``equity`` is a table (*by, equity) and ``previous`` one of (*by, starting_equity):
    all accounts are written in one go, those without positions too.
    """
    price, day, keys = F.col("close"), F.lit(run_date).cast("date"), list(by)
    if isinstance(equity, DataFrame):
        accounts = equity.select(*keys, F.col("equity").cast("double").alias("equity"))
    else:
        accounts = weights.sparkSession.range(1).select(F.lit(float(equity)).alias("equity"))
    held = weights.where(F.col("weight") > 0).join(prices.select("symbol", "close"), "symbol")
    held = held.join(accounts, keys) if keys else held.withColumn("equity", F.lit(float(equity)))
    positions = held.select(
        *keys, "symbol", price.alias("entry_price"), py_round(ratio(F.col("equity") * F.col("weight"), price), 2).alias("shares"), day.alias("entry_date"),
    )
    if previous is None:
        accounts = accounts.withColumn("_kept", F.lit(None).cast("double"))
    elif keys:
        accounts = accounts.join(previous.groupBy(*keys).agg(F.min("starting_equity").cast("double").alias("_kept")), keys, "left")
    else:
        accounts = accounts.withColumn("_kept", previous.agg(F.first("starting_equity", ignorenulls=True).alias("s")).scalar().cast("double"))
    return positions, accounts.select(*keys, "equity", day.alias("last_update"), F.coalesce("_kept", "equity").alias("starting_equity"))


def rebalance_orders(targets: DataFrame, holdings: DataFrame, equity: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """(side, symbol, notional, seq): sells, cut by half a percent, ahead of buys.

    ``equity`` holds (*by, equity). Orders up to half a percent of equity are skipped.
    """
    keys = [*by, "symbol"]
    both = (
        targets.select(*keys, "weight")
        .join(holdings.select(*keys, "value"), keys, "full_outer")
        .join(equity.select(*by, "equity"), list(by))
        .withColumns({"target": F.coalesce("weight", F.lit(0.0)) * F.col("equity"), "value": F.coalesce("value", F.lit(0.0))})
    )
    amount = F.when(F.col("target") < F.col("value"), (F.col("value") - F.col("target")) * SELL_HAIRCUT).when(
        F.col("target") > F.col("value"), F.col("target") - F.col("value")
    )
    orders = both.withColumns({"amount": amount, "side": F.when(F.col("target") < F.col("value"), "SELL").otherwise("BUY")}).where(
        F.col("amount") > F.col("equity") * MIN_TURNOVER
    )
    seq = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("side"), "symbol"))
    return orders.select(*by, "side", "symbol", py_round("amount", 2).alias("notional"), seq.alias("seq"))


def current_holdings(positions: DataFrame, account: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, symbol, weight, cash_pct) from entry prices; weights to four, cash to one digit."""
    value = F.col("entry_price") * F.col("shares")
    if by:
        sums = positions.groupBy(*by).agg(F.sum(value).alias("_invested"))
        held = positions.join(account.select(*by, F.col("equity").alias("_equity")), list(by)).join(sums, list(by))
        equity, invested = F.col("_equity"), F.col("_invested")
    else:
        held, equity = positions, account.agg(F.first("equity").alias("e")).scalar()
        invested = positions.agg(F.sum(value).alias("v")).scalar()
    cash = F.greatest(F.lit(0.0), py_round((equity - invested) / equity * 100, 1))
    return held.select(*by, "symbol", py_round(value / equity, 4).alias("weight"), cash.alias("cash_pct"))


def mark_positions(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """Positions with the latest close, falling back to the entry price."""
    return positions.join(latest.select("symbol", F.col("close").alias("_px")), "symbol", "left").select(
        *[c for c in positions.columns if c != "current_price"], F.coalesce("_px", "entry_price").alias("current_price")
    )


def final_report(weights: DataFrame, technical: DataFrame, sentiment: DataFrame, health: DataFrame) -> DataFrame:
    """Weights with direction, sentiment and health, defaults where an input is missing."""
    return (
        weights.join(technical.select("symbol", "direction"), "symbol", "left")
        .join(sentiment.select("symbol", "sentiment_score"), "symbol", "left")
        .join(health.select("symbol", "health_score"), "symbol", "left")
        .select(
            *weights.columns,
            F.coalesce("direction", F.lit("?")).alias("direction"),
            F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment_score"),
            F.coalesce(F.col("health_score").cast("int"), F.lit(50)).alias("health_score"),
        )
        .orderBy(F.desc("weight"), "symbol")
    )


def top_weights(weights: DataFrame, n: int, by: Sequence[str] = ("run_date",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "symbol"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= n)
