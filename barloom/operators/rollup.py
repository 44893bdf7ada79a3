"""Market rollup over reconstructed logs: averages, breadth, regime and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import ratio
from barloom.operators.logs import LOG_KEYS

# --- fixed values -----------------------------------------------------------
SENTIMENT_TONE, BREADTH_TONE = 0.15, 0.2
DIRECTION_SCORE = 0.35
POSITIVE_STRIP, NEGATIVE_STRIP = 0.35, -0.15
RANKED_ROWS, RANKED_SECTORS = 6, 5
UP, DOWN = ("up", "bullish"), ("down", "bearish")
# ----------------------------------------------------------------------------


def with_scores(analyses: DataFrame, both_vocabularies: bool = False) -> DataFrame:
    """Typed sentiment, direction sign and health of each analysed stock.

    Directions are written as up/down or, by the model, as bullish/bearish. Only
    the former count unless ``both_vocabularies``.
    """
    direction = F.get_json_object("technical", "$.direction")
    ups, downs = (UP, DOWN) if both_vocabularies else (UP[:1], DOWN[:1])
    sign = F.when(direction.isin(*ups), 1).when(direction.isin(*downs), -1).otherwise(0)
    return analyses.select(
        "*",
        F.coalesce(F.get_json_object("sentiment", "$.sentiment_score").try_cast("double"), F.lit(0.0)).alias("sent"),
        F.coalesce(F.get_json_object("fundamentals", "$.health_score").try_cast("double"), F.lit(50.0)).alias("health"),
        sign.alias("dir"),
    )


def market_rollup(scores: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """Mean sentiment and health, breadth and the regime word, over complete stocks."""
    ok = F.col("complete")

    def over(c: Column) -> Column:
        return F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0))

    g = scores.groupBy(*by).agg(
        over(F.col("sent")).alias("average_sentiment"),
        over(F.col("health")).alias("average_health"),
        F.count_if(ok & (F.col("dir") == 1)).alias("up_count"),
        F.count_if(ok & (F.col("dir") == -1)).alias("down_count"),
        F.count_if(ok).alias("n_complete"),
    )
    g = g.withColumn("breadth", F.coalesce(ratio((F.col("up_count") - F.col("down_count")).cast("double"), F.col("n_complete")), F.lit(0.0)))
    s, b = F.col("average_sentiment"), F.col("breadth")
    regime = (
        F.when((s < -SENTIMENT_TONE) | (b < -BREADTH_TONE), "DEFENSIVE")
        .when((s > SENTIMENT_TONE) | (b > BREADTH_TONE), "RISK-ON")
        .otherwise("BALANCED")
    )
    return g.withColumn("regime", regime)


def strip(scores: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """Score and tone of every stock."""
    score = F.col("sent") + F.col("dir") * DIRECTION_SCORE + (F.col("health") - 50) / 100
    tone = F.when(F.col("score") < NEGATIVE_STRIP, "negative").when(F.col("score") > POSITIVE_STRIP, "positive").otherwise("neutral")
    return scores.select(*by, "symbol", score.alias("score")).withColumn("tone", tone)


def fallback_ranking(scores: DataFrame, by: Sequence[str] = LOG_KEYS, n: int = RANKED_ROWS) -> DataFrame:
    """Best complete stocks by the score that stands in for weights."""
    weight = F.greatest(F.lit(0.02), F.col("sent") * 0.08 + F.col("dir") * 0.04 + F.col("health") / 100 * 0.05)
    ranked = scores.where("complete").select(*by, "symbol", weight.alias("weight"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "symbol"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= n)


def top_sectors(sectors: DataFrame, by: Sequence[str] = LOG_KEYS, n: int = RANKED_SECTORS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "sector"))
    return sectors.withColumn("rank", rank).where(F.col("rank") <= n)


def completion(status: DataFrame) -> DataFrame:
    """Share of stocks completed and number of failures per log."""
    return status.withColumn("quality_score", F.col("stocks_complete") / F.col("stocks_total"))
