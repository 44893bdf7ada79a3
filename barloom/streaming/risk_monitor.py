"""Position checks on a stream of prices, with equity that follows the prices."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.risk import MAX_DRAWDOWN_PCT, check_positions

EVENT = "account string, symbol string, ts timestamp, current_price double, equity double, prices map<string,double>"


def account_values(positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, starting_equity, opening): equity with every position at its entry price, per account of ``accounts`` (account, cash, starting_equity)."""
    value = positions.groupBy("account").agg(F.sum(F.col("entry_price") * F.col("shares")).alias("_held"))
    return accounts.join(value, "account", "left").select("account", "starting_equity", (F.col("cash") + F.coalesce("_held", F.lit(0.0))).alias("opening"))


def account_ticks(ticks: DataFrame, positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ticks (symbol, ts, close) of the symbols that an account holds, with what the account needs to follow them."""
    held = positions.select("account", "symbol", "entry_price", "shares").join(account_values(positions, accounts), "account")
    return ticks.where("symbol is not null and ts is not null and close is not null").select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close")).join(held, "symbol")


def equity_batch(ticks: DataFrame, positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """The events of :func:`equity_stream` from a whole table of ticks: running sums per account up to the first breach.

    A symbol has one tick at a time; an account's ticks are followed in the order
    of (ts, symbol).
    """
    own = Window.partitionBy("account", "symbol").orderBy("ts")
    path = Window.partitionBy("account").orderBy("ts", "symbol")
    upto = path.rowsBetween(Window.unboundedPreceding, 0)
    moved = F.col("shares") * (F.col("close") - F.coalesce(F.lag("close").over(own), F.col("entry_price")))
    rows = account_ticks(ticks, positions, accounts).withColumn("moved", moved).withColumn("equity", F.col("opening") + F.sum("moved").over(upto))
    breach = F.coalesce((F.col("starting_equity") > 0) & ((F.col("equity") - F.col("starting_equity")) / F.col("starting_equity") * 100 <= -MAX_DRAWDOWN_PCT), F.lit(False))
    rows = rows.withColumn("breach", breach).withColumn("before", F.coalesce(F.max(F.col("breach").cast("int")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where("before = 0")
    last = rows.where("breach").select("account", F.col("ts").alias("_ts"), F.col("symbol").alias("_symbol"), "equity")
    newest = rows.groupBy("account", "symbol").agg(F.max_by("close", "ts").alias("close"))  # up to the breach
    prices = newest.groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("prices"))  # a row per held symbol
    alarms = last.join(prices, "account").select("account", F.lit(None).cast("string").alias("symbol"), F.col("_ts").alias("ts"), F.lit(None).cast("double").alias("current_price"), "equity", "prices")
    calm = rows.where("not breach").select("account", "symbol", "ts", F.col("close").alias("current_price"), "equity", F.lit(None).cast("map<string,double>").alias("prices"))
    return calm.unionByName(alarms)


def equity_stream(ticks: DataFrame, positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, symbol, ts, current_price, equity, prices): every tick with the account's equity after it, until the breaker trips.

    The state of an account is its equity, the last price of each symbol it holds
    and whether it has tripped. The tick that takes the drawdown to the limit
    gives one row without symbol, with the prices known; after it the account is silent for good. A tick
    that comes after a newer one of its symbol is too late to count; one that is only late for the
    account moves its equity when it comes.
    """

    def followed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "symbol"], kind="stable")  # one account in one micro-batch
        if now is None:
            now = {"equity": float(rows["opening"].iloc[0]), "moved": 0.0, "prices": {}, "tripped": False}
        out: list[tuple] = []
        for symbol, ts, close, entry, shares, opening, start in zip(*(rows[c] for c in ("symbol", "ts", "close", "entry_price", "shares", "opening", "starting_equity"))):
            if now["tripped"]:
                break
            at, price = now["prices"].get(symbol, (None, entry))
            if at is not None and ts.value < at:
                continue
            now["moved"] += shares * (close - price)
            now["equity"] = opening + now["moved"]
            now["prices"][symbol] = (ts.value, close)
            if start > 0 and (now["equity"] - start) / start * 100 <= -MAX_DRAWDOWN_PCT:
                now["tripped"] = True
                out.append((key[0], None, ts, None, now["equity"], {s: p for s, (_, p) in now["prices"].items()}))
            else:
                out.append((key[0], symbol, ts, close, now["equity"], None))
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=["account", "symbol", "ts", "current_price", "equity", "prices"])

    rows = account_ticks(ticks, positions, accounts)
    return rows.groupBy("account").applyInPandasWithState(followed, EVENT, "state string", "append", GroupStateTimeout.NoTimeout)


def account_actions(events: DataFrame, positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, symbol, ts, equity, action, reason, pnl_pct, threshold_pct) of the events of accounts; an alarm sells every position at its last price.

    ``positions`` hold (account, symbol, entry_price, shares, sl_pct, tp_pct). Works on a stream and on a table.
    """
    held = positions.select("account", F.col("symbol").alias("held"), "entry_price", "shares", "sl_pct", "tp_pct")
    rows = events.join(held, "account").where(F.col("symbol").isNull() | (F.col("symbol") == F.col("held")))
    rows = rows.join(accounts.select("account", "starting_equity"), "account")
    price = F.coalesce("current_price", F.try_element_at("prices", F.col("held")), "entry_price")
    rows = rows.withColumn("current_price", price).drop("symbol").withColumn("symbol", F.struct("account", F.col("held").alias("symbol"), "ts", "equity"))
    checked = check_positions(rows, F.col("equity"), F.col("starting_equity"))
    return checked.select("symbol.*", "action", "reason", "pnl_pct", "threshold_pct")


def risk_stream(ticks: DataFrame, positions: DataFrame, equity: float, starting_equity: float) -> DataFrame:
    """Stream-static join of (symbol, ts, close) ticks with positions that carry sl_pct and tp_pct, at an equity that stays as it is.

    Stateless: every tick of a held symbol yields its action. Positions are read
    again for each micro-batch, so a rewritten snapshot takes effect at once.
    """
    priced = ticks.join(positions.drop("current_price"), "symbol").withColumn("current_price", F.col("close"))
    checked = priced.withColumn("symbol", F.struct("symbol", "ts"))
    return check_positions(checked, equity, starting_equity).select("symbol.*", "action", "reason", "pnl_pct", "threshold_pct")


def forced_exits(actions: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Forced exits per window and symbol, worst loss first seen in the window."""
    out = actions.where(F.col("action").startswith("FORCE_SELL")).withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        out.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "symbol")
        .agg(F.min_by("action", "ts").alias("action"), F.min("pnl_pct").alias("worst_pnl"), F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "symbol", "action", "worst_pnl", "n")
    )
