"""News: first-seen headlines and confidence-weighted sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, py_round, ratio

# --- fixed values -----------------------------------------------------------
SCANNED_ARTICLES = 15
KEPT_HEADLINES = 8
SUMMARY_CHARS = 200
THEME_CHARS = 100
# ----------------------------------------------------------------------------


def dedup_news(news: DataFrame) -> DataFrame:
    """First-seen distinct headlines among the first 15 articles, at most 8 per symbol.

    The first filter is a per-symbol row limit, applied before the shuffle, so a
    symbol with a third of all articles still ships 15 rows per input partition.
    """
    by_seq = Window.partitionBy("symbol").orderBy("seq")
    first = news.withColumn("_n", F.row_number().over(by_seq)).where(F.col("_n") <= SCANNED_ARTICLES)
    named = first.where(F.coalesce("headline", F.lit("")) != "")
    seen = F.row_number().over(Window.partitionBy("symbol", "headline").orderBy("seq"))
    unique = named.withColumn("_seen", seen).where(F.col("_seen") == 1)
    rank = F.row_number().over(by_seq)
    return unique.withColumn("rank", rank).where(F.col("rank") <= KEPT_HEADLINES).select(
        "symbol", "rank", "seq", "headline", F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_CHARS).alias("summary"), F.coalesce("source", F.lit("")).alias("source")
    )


def score_headlines(news: DataFrame, scorer: Callable[[Column], Column]) -> DataFrame:
    """(symbol, seq, headline, label, score) with the caller's classifier.

    ``scorer`` maps the headline column to a ``struct<label string, score double>``,
    typically a pandas UDF that holds the model per executor.
    """
    s = news.withColumn("_s", scorer(F.col("headline")))
    return s.select("symbol", "seq", "headline", F.col("_s.label").alias("label"), F.col("_s.score").alias("score")).where(F.col("score").isNotNull())


def aggregate_sentiment(scored: DataFrame) -> DataFrame:
    """(symbol, sentiment_score, confidence, key_theme) of the first 8 scored headlines.

    ``scored`` holds (symbol, seq, headline, label, score): the classifier itself
    is the caller's, for instance a pandas UDF over the headline column.
    """
    first = scored.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("seq"))).where(F.col("_n") <= KEPT_HEADLINES)
    sign = F.when(F.lower("label") == "positive", 1.0).when(F.lower("label") == "negative", -1.0).otherwise(0.0)
    g = first.groupBy("symbol").agg(
        F.sum(sign * F.col("score") * F.col("score")).alias("num"),
        F.sum("score").alias("den"),
        F.avg("score").alias("conf"),
        F.max_by("headline", F.struct(F.col("score"), -F.col("seq"))).alias("theme"),
    )
    return g.select(
        "symbol",
        py_round(clip(ratio("num", "den"), -1, 1), 3).alias("sentiment_score"),
        py_round("conf", 3).alias("confidence"),
        F.substring("theme", 1, THEME_CHARS).alias("key_theme"),
    )
