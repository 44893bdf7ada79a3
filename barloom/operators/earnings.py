"""Earnings drift: point-in-time surprise and its decaying signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.alignment import Facts, asof_many
from barloom.functions.numeric import py_round

# --- fixed values -----------------------------------------------------------
BEAT_THRESHOLD = 0.05
DRIFT_DAYS = 60
FULL_SURPRISE = 0.15
# ----------------------------------------------------------------------------


def _drift(surprise: Column, days: Column) -> tuple[Column, Column]:
    active = (surprise >= BEAT_THRESHOLD) & (days >= 0) & (days <= DRIFT_DAYS)
    strength = F.greatest(F.lit(0.0), F.lit(1.0) - days / float(DRIFT_DAYS)) * F.least(F.lit(1.0), surprise / FULL_SURPRISE)
    return F.when(active, strength).otherwise(0.0), F.when(active, days).otherwise(-1)


def earnings_facts(earnings: DataFrame) -> Facts:
    return Facts(earnings.withColumn("_known", F.lit(True)), ["report_date", "surprise", "_known"], "report_date")


def pead_columns(panel: DataFrame, earnings: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add earnings_surprise_pct, pead_signal, days_since_beat as known on each date.

    No report yet gives 0 / 0 / -1; a report whose surprise is undefined keeps a
    NULL surprise here (the panel default turns it into 0).
    """
    return score_pead(asof_many(panel, [earnings_facts(earnings)], tasks=tasks), F.col("date"), list(panel.columns))


def live_pead(earnings: DataFrame, asof: str) -> DataFrame:
    """Latest report per symbol scored on ``asof``."""
    last = earnings.groupBy("symbol").agg(F.max_by(F.struct("report_date", "surprise"), "report_date").alias("r"))
    hit = last.select("symbol", "r.*", F.lit(True).alias("_known"))
    return score_pead(hit, F.lit(asof).cast("date"), ["symbol", "report_date"])


def score_pead(hit: DataFrame, at: Column, keep: list[str]) -> DataFrame:
    days = F.datediff(at, F.col("report_date"))
    signal, since = _drift(F.col("surprise"), days)
    known = F.coalesce("_known", F.lit(False))
    return hit.select(
        *keep,
        F.when(known, py_round("surprise", 4)).otherwise(0.0).alias("earnings_surprise_pct"),
        F.when(known, py_round(signal, 4)).otherwise(0.0).alias("pead_signal"),
        F.when(known, since).otherwise(-1).alias("days_since_beat"),
        days.alias("days_since_report"),
    )
