"""Position risk: volatility-scaled thresholds, forced exits, overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import fixed_text, py_round, ratio
from barloom.sources.dims import DEFAULT_STYLE, STYLES
from barloom.sources.readers import trailing_bars

# --- fixed values -----------------------------------------------------------
MAX_DRAWDOWN_PCT = 5.0
MAX_SINGLE_LOSS_PCT = 8.0
MIN_POSITION_VALUE = 50.0
DEFAULT_DAILY_VOL, MIN_DAILY_VOL = 0.02, 0.005
VOL_RETURNS = 10
LOOKBACK_DAYS = 30
# ----------------------------------------------------------------------------


def style_params(choices: DataFrame, styles: DataFrame) -> DataFrame:
    """Resolve a ``style`` column (any case, unknown or missing -> balanced) to its parameters."""
    known = F.lower("style").isin(*STYLES)
    style = F.when(known, F.lower("style")).otherwise(DEFAULT_STYLE)
    return choices.withColumn("style", style).join(styles, "style", "left")


def daily_vol(bars: DataFrame, asof: str, days: int = LOOKBACK_DAYS) -> DataFrame:
    """(symbol, sigma): std of the last 10 log returns; 2 % with fewer than 11 bars, 0.5 % floor."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = (
        trailing_bars(bars, asof, days)
        .select("symbol", F.row_number().over(w).alias("back"), F.ln(ratio(F.col("close"), F.lead("close", 1).over(w))).alias("lr"))
        .where(F.col("back") <= VOL_RETURNS + 1)
    )
    g = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.stddev_samp(F.when(F.col("back") <= VOL_RETURNS, F.col("lr"))).alias("sd"))
    return g.select(
        "symbol", F.when(F.col("n") >= VOL_RETURNS + 1, F.greatest(F.col("sd"), F.lit(MIN_DAILY_VOL))).otherwise(DEFAULT_DAILY_VOL).alias("sigma")
    )


def risk_thresholds(symbols: DataFrame, vol: DataFrame, styles: DataFrame) -> DataFrame:
    """(symbol, style, sl_pct, tp_pct) for (symbol, style) rows."""
    sigma = F.coalesce("sigma", F.lit(DEFAULT_DAILY_VOL))
    return (
        style_params(symbols, styles)
        .join(vol, "symbol", "left")
        .select("symbol", "style", py_round(F.col("sl_mult") * sigma * 100, 2).alias("sl_pct"), py_round(F.col("tp_mult") * sigma * 100, 2).alias("tp_pct"))
    )


def check_positions(positions: DataFrame, equity: float | Column, starting_equity: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """(*by, symbol, action, reason, pnl_pct, threshold_pct) from positions with sl_pct and tp_pct.

    A portfolio drawdown of 5 % forces everything out; otherwise each position
    worth at least 50 is tested against the hard loss limit, its stop and its target.
    ``equity`` and ``starting_equity`` are numbers for one account, or columns of
    ``positions``, so that one call checks any number of accounts (``by``).
    """
    now, start = (F.lit(float(x)) if isinstance(x, int | float) else x for x in (equity, starting_equity))
    p = positions.withColumn("_drawdown", F.when(start > 0, (now - start) / start * 100))
    circuit = F.coalesce(F.col("_drawdown") <= -MAX_DRAWDOWN_PCT, F.lit(False))
    entry = F.col("entry_price")
    pnl = F.when(entry <= 0, 0.0).otherwise(ratio(F.col("current_price") - entry, entry) * 100)
    p = p.withColumn("pnl_pct", pnl).where(circuit | (F.col("current_price") * F.col("shares") >= MIN_POSITION_VALUE))
    hard = F.col("pnl_pct") <= -MAX_SINGLE_LOSS_PCT
    stop = F.col("pnl_pct") <= -F.col("sl_pct")
    target = F.col("pnl_pct") >= F.col("tp_pct")
    t = {"pnl": fixed_text("pnl_pct", 1), "spnl": fixed_text("pnl_pct", 1, sign=True), "sl": fixed_text("sl_pct", 1), "tp": fixed_text("tp_pct", 1)}
    reason = (
        F.when(circuit, F.concat(F.lit("CIRCUIT BREAKER: Portfolio down "), fixed_text("_drawdown", 1), F.lit(f"% exceeds {MAX_DRAWDOWN_PCT}% daily limit. LIQUIDATING ALL.")))
        .when(hard, F.concat(F.lit("HARD LIMIT: Position down "), t["pnl"], F.lit(f"% exceeds max loss {MAX_SINGLE_LOSS_PCT}%")))
        .when(stop, F.concat(F.lit("STOP-LOSS: PnL "), t["spnl"], F.lit("% breached dynamic SL threshold -"), t["sl"], F.lit("%")))
        .when(target, F.concat(F.lit("TAKE-PROFIT: PnL "), t["spnl"], F.lit("% exceeded TP threshold +"), t["tp"], F.lit("%")))
        .otherwise(F.concat(F.lit("Within bounds: PnL "), t["spnl"], F.lit("% | SL=-"), t["sl"], F.lit("% | TP=+"), t["tp"], F.lit("%")))
    )
    return p.select(
        *by,
        "symbol",
        F.when(circuit, "FORCE_SELL_CIRCUIT").when(hard | stop, "FORCE_SELL_SL").when(target, "FORCE_SELL_TP").otherwise("HOLD").alias("action"),
        reason.alias("reason"),
        "pnl_pct",
        F.when(circuit, MAX_DRAWDOWN_PCT).when(hard, MAX_SINGLE_LOSS_PCT).when(stop, F.col("sl_pct")).when(target, F.col("tp_pct")).otherwise(0.0).alias("threshold_pct"),
    )


def check_accounts(positions: DataFrame, accounts: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """:func:`check_positions` for every account: ``accounts`` holds (*by, equity, starting_equity)."""
    held = positions.join(accounts.select(*by, "equity", "starting_equity"), list(by))
    return check_positions(held, F.col("equity"), F.col("starting_equity"), by)


def override_weights(weights: DataFrame, actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weights without the forced exits and without empty positions."""
    keys = [*by, "symbol"]
    out = actions.where(F.col("action").startswith("FORCE_SELL")).select(*keys)
    return weights.where(F.col("weight") > 0).join(out, keys, "left_anti")


EMPTY_RISK = "  No positions to monitor."


def risk_summary(actions: DataFrame) -> DataFrame:
    """(part, symbol, line): the text of a risk check, forced sales first; a header counts each part.

    Lines stay rows, in the order of (part, symbol); a header has no symbol. An
    empty check is one line that says so.
    """
    part = F.when(F.col("action").startswith("FORCE_SELL"), 1).when(F.col("action") == "HOLD", 2)
    told = actions.withColumn("part", part).where("part is not null")
    lines = told.select(
        "part",
        "symbol",
        F.when(F.col("part") == 1, F.concat(F.lit("    ["), "action", F.lit("] "), "symbol", F.lit(": "), "reason"))
        .otherwise(F.concat(F.lit("    "), "symbol", F.lit(": "), "reason"))
        .alias("line"),
    )
    n = F.col("n")
    heads = told.groupBy("part").agg(F.count("*").alias("n")).select(
        "part",
        F.lit(None).cast("string").alias("symbol"),
        F.when(F.col("part") == 1, F.concat(F.lit("  [!] "), n, F.lit(" RISK OVERRIDE(S):"))).otherwise(F.concat(F.lit("  [OK] "), n, F.lit(" position(s) within risk bounds"))).alias("line"),
    )
    none = told.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("symbol"), F.lit(EMPTY_RISK).alias("line"))
    return lines.unionByName(heads).unionByName(none)
