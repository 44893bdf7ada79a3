"""Multi-factor health score from price history and fundamentals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, finite, fixed_text, mean_present, pct_text, py_round, ratio, sigmoid100
from barloom.sources.readers import trailing_bars

# --- fixed values -----------------------------------------------------------
MIN_ROWS = 60
YEAR_ROWS = 252
MONTH_ROWS = 21
WEIGHTS = {"momentum": 0.30, "quality": 0.35, "value": 0.20, "vol": 0.15}
# ----------------------------------------------------------------------------


def price_factors(bars: DataFrame, asof: str, days: int = 366) -> DataFrame:
    """(symbol, n_rows, mom_12_1, ann_vol) over the trailing year.

    Volatility needs 252 returns, hence 253 bars; with fewer it is missing.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = (
        trailing_bars(bars, asof, days)
        .select("symbol", "close", F.row_number().over(w).alias("back"), (ratio(F.col("close"), F.lead("close", 1).over(w)) - 1).alias("ret"))
        .where(F.col("back") <= YEAR_ROWS + 1)
    )

    def at(n: int) -> Column:
        return F.max(F.when(F.col("back") == n, F.col("close")))

    g = rows.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        at(1).alias("c1"),
        at(MONTH_ROWS + 1).alias("c22"),
        F.max_by("close", "back").alias("c_first"),
        F.stddev_samp(F.when(F.col("back") <= YEAR_ROWS, F.col("ret"))).alias("sd"),
    )
    mom = (ratio("c1", "c_first") - 1) - (ratio("c1", "c22") - 1)
    return g.select(
        "symbol",
        "n_rows",
        F.coalesce(finite(mom), F.lit(0.0)).alias("mom_12_1"),
        F.when(F.col("n_rows") > YEAR_ROWS, F.col("sd") * F.sqrt(F.lit(float(YEAR_ROWS)))).alias("ann_vol"),
    )


def factor_score(prices: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Integer sub-scores, composite health and the strength / risk texts per symbol."""
    f = fundamentals.join(prices, "symbol", "left")
    pe, pb = finite("pe"), finite("pb")

    def optional(ok: Column, x: Column, center: float, scale: float) -> Column:
        return F.when(ok, sigmoid100(x, center, scale))

    scored = f.withColumns(
        {
            "m": sigmoid100("mom_12_1", 0.05, 0.25),
            "lv": sigmoid100(-F.col("ann_vol"), -0.30, 0.15),
            "q": F.coalesce(
                mean_present(
                    optional(finite("roe").isNotNull(), F.col("roe"), 0.12, 0.15),
                    optional(finite("profit_margin").isNotNull(), F.col("profit_margin"), 0.10, 0.12),
                    optional(finite("revenue_growth").isNotNull(), F.col("revenue_growth"), 0.05, 0.10),
                ),
                F.lit(50.0),
            ),
            "v": F.coalesce(
                mean_present(
                    optional((pe > 0) & (pe < 500), -F.col("pe"), -20.0, 15.0),
                    optional(pb > 0, -F.col("pb"), -3.0, 3.0),
                ),
                F.lit(50.0),
            ),
        }
    )
    health = clip(
        F.col("m") * WEIGHTS["momentum"] + F.col("q") * WEIGHTS["quality"] + F.col("v") * WEIGHTS["value"] + F.col("lv") * WEIGHTS["vol"], 0, 100
    )
    strength = (
        F.when(F.col("mom_12_1") > 0.20, F.concat(F.lit("strong 12-1m momentum (+"), pct_text("mom_12_1", 0), F.lit(")")))
        .when(F.col("q") > 65, "high-quality fundamentals (ROE/margins)")
        .when(F.col("v") > 65, "attractive valuation")
        .otherwise("")
    )
    risk = (
        F.when(F.col("ann_vol") > 0.45, F.concat(F.lit("high volatility ("), pct_text("ann_vol", 0), F.lit(" annualised)")))
        .when(pe > 45, F.concat(F.lit("elevated P/E ("), fixed_text("pe", 1), F.lit("x)")))
        .when(F.col("mom_12_1") < -0.10, F.concat(F.lit("negative price momentum ("), pct_text("mom_12_1", 0), F.lit(")")))
        .otherwise("")
    )
    short = F.coalesce(F.col("n_rows") < MIN_ROWS, F.lit(True))

    def score(c: Column) -> Column:
        return F.when(short, 50).otherwise(py_round(c, 0).cast("int"))

    return scored.select(
        "symbol",
        score(health).alias("health_score"),
        score(F.col("m")).alias("momentum_score"),
        score(F.col("q")).alias("quality_score"),
        score(F.col("v")).alias("value_score"),
        score(F.col("lv")).alias("vol_score"),
        F.when(short, "").otherwise(strength).alias("key_strength"),
        F.when(short, "insufficient price history").otherwise(risk).alias("key_risk"),
    )


def fundamental_select(scores: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Factor score where it says something, else the fallback answer clamped to 0..100.

    ``fallback`` is (symbol, health_score, key_strength, key_risk) from another
    source; without a row the health is 50.
    """
    informative = (F.col("health_score") != 50) | (F.coalesce("key_strength", F.lit("")) != "")
    if fallback is None:
        joined = scores.withColumns({"fb_health": F.lit(50), "fb_strength": F.lit(""), "fb_risk": F.lit("")})
    else:
        raw = F.col("health_score").cast("string").try_cast("double")
        other = fallback.select(
            "symbol",
            F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(finite(raw).cast("int"), F.lit(50)))).alias("fb_health"),
            F.col("key_strength").alias("fb_strength"),
            F.col("key_risk").alias("fb_risk"),
        )
        joined = scores.join(other, "symbol", "left")
    return joined.select(
        "symbol",
        F.when(informative, F.col("health_score")).otherwise(F.coalesce("fb_health", F.lit(50))).alias("health_score"),
        F.when(informative, F.col("key_strength")).otherwise(F.coalesce("fb_strength", F.lit(""))).alias("key_strength"),
        F.when(informative, F.col("key_risk")).otherwise(F.coalesce("fb_risk", F.lit(""))).alias("key_risk"),
        F.when(informative, "factors").otherwise("fallback").alias("origin"),
    )
