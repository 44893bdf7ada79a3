"""Macro regime: fear gauge, yield curve and credit stress mapped to an equity multiplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import fixed_text, py_round, ratio
from barloom.functions.series import series

# --- fixed values -----------------------------------------------------------
VIX_CAUTION, VIX_RISK_OFF = 20.0, 28.0
CURVE_CAUTION, CURVE_RISK_OFF = 0.0, -0.5
CREDIT_CAUTION, CREDIT_RISK_OFF = -0.02, -0.04
EQUITY_MULT = {"risk_on": 1.0, "neutral": 0.7, "risk_off": 0.4}
DEFAULTS = {"VIX": 20.0, "TNX": 4.0, "IRX": 4.5}
CREDIT_ROWS = 20
LOOKBACK_MONTHS = 3
RISK_OFF_NAMES = 10
# ----------------------------------------------------------------------------


def regime_columns(df: DataFrame) -> DataFrame:
    """Add scores, regime, equity_mult and signal labels; needs vix, yield_spread, credit_spread."""

    def score(off: Column, caution: Column) -> Column:
        return F.when(off, 2).when(caution, 1).otherwise(0)

    vix, curve, credit = F.col("vix"), F.col("yield_spread"), F.col("credit_spread")
    scored = df.withColumns(
        {
            "_v": score(vix > VIX_RISK_OFF, vix > VIX_CAUTION),
            "_y": score(curve < CURVE_RISK_OFF, curve < CURVE_CAUTION),
            "_c": score(credit < CREDIT_RISK_OFF, credit < CREDIT_CAUTION),
        }
    )
    worst = F.greatest("_v", "_y", "_c")
    cautions = sum(F.when(F.col(c) >= 1, 1).otherwise(0) for c in ("_v", "_y", "_c"))
    regime = F.when(worst >= 2, "risk_off").when(cautions >= 2, "neutral").otherwise("risk_on")
    mult = F.create_map(*[x for k, v in EQUITY_MULT.items() for x in (F.lit(k), F.lit(v))])

    def label(name: str, s: str, text: Column) -> Column:
        level = F.element_at(F.array(F.lit("ok"), F.lit("caution"), F.lit("risk_off")), F.col(s) + 1)
        return F.concat(F.lit(f"{name}_"), level, F.lit("("), text, F.lit(")"))

    return (
        scored.withColumn("regime", regime)
        .withColumn("equity_mult", F.element_at(mult, F.col("regime")))
        .withColumn(
            "signals",
            F.array(label("vix", "_v", fixed_text("vix", 1)), label("yield", "_y", fixed_text("yield_spread", 2)), label("credit", "_c", fixed_text("credit_spread", 3))),
        )
        .drop("_v", "_y", "_c")
    )


def macro_regime(macro: DataFrame, asof: str) -> DataFrame:
    """Regime on ``asof`` from the last three months of (symbol, date, close).

    A missing series takes its default; without any row the regime is neutral.
    """
    end = F.lit(asof).cast("date")
    recent = macro.where(F.col("close").isNotNull() & (F.col("date") <= end) & (F.col("date") > F.add_months(end, -LOOKBACK_MONTHS)))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    rows = recent.withColumn("back", back).where(F.col("back") <= CREDIT_ROWS + 1)

    def at(symbol: str, b: int) -> Column:
        return F.max(F.when((F.col("symbol") == symbol) & (F.col("back") == b), F.col("close")))

    def trailing(symbol: str) -> Column:
        return ratio(at(symbol, 1), at(symbol, CREDIT_ROWS + 1)) - 1

    day = rows.agg(
        F.coalesce(at("VIX", 1), F.lit(DEFAULTS["VIX"])).alias("vix"),
        (F.coalesce(at("TNX", 1), F.lit(DEFAULTS["TNX"])) - F.coalesce(at("IRX", 1), F.lit(DEFAULTS["IRX"]))).alias("yield_spread"),
        F.coalesce(trailing("HYG") - trailing("LQD"), F.lit(0.0)).alias("credit_spread"),
        F.count("*").alias("_n"),
    )
    none = F.col("_n") == 0
    return (
        regime_columns(day)
        .withColumns(
            {
                "vix": py_round("vix", 2),
                "yield_spread": F.when(none, 0.0).otherwise(py_round("yield_spread", 4)),
                "credit_spread": py_round("credit_spread", 4),
                "regime": F.when(none, "neutral").otherwise(F.col("regime")),
                "equity_mult": F.when(none, EQUITY_MULT["neutral"]).otherwise(F.col("equity_mult")),
                "signals": F.when(none, F.array(F.lit("default_neutral"))).otherwise(F.col("signals")),
            }
        )
        .drop("_n")
    )


def macro_history(macro: DataFrame) -> DataFrame:
    """Regime on every date, each input at its latest known value.

    The pivoted table is calendar-sized, so filling it in date order is cheap.
    """
    long = macro.where(F.col("close").isNotNull()).withColumn(
        "ret20", ratio(F.col("close"), F.lag("close", CREDIT_ROWS).over(series())) - 1
    )

    def pick(symbol: str, c: str) -> Column:
        return F.max(F.when(F.col("symbol") == symbol, F.col(c)))

    wide = long.groupBy("date").agg(
        pick("VIX", "close").alias("v"), pick("TNX", "close").alias("t"), pick("IRX", "close").alias("i"),
        pick("HYG", "ret20").alias("h"), pick("LQD", "ret20").alias("l"),
    )
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.last(c, ignorenulls=True).over(w) for c in "vtihl"}
    day = wide.select(
        "date",
        F.coalesce(known["v"], F.lit(DEFAULTS["VIX"])).alias("vix"),
        (F.coalesce(known["t"], F.lit(DEFAULTS["TNX"])) - F.coalesce(known["i"], F.lit(DEFAULTS["IRX"]))).alias("yield_spread"),
        F.coalesce(known["h"] - known["l"], F.lit(0.0)).alias("credit_spread"),
    )
    return regime_columns(day)


def trim_in_risk_off(universe: DataFrame, regime: DataFrame, n: int = RISK_OFF_NAMES) -> DataFrame:
    """First ``n`` ranked names when the regime is risk-off, else all."""
    off = regime.select(F.col("regime") == "risk_off").scalar()
    return universe.where(~F.coalesce(off, F.lit(False)) | (F.col("rank") <= n))
