"""Event triggers that allocate capital by rule: earnings beats and insider clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import pct_text, py_round, to_double
from barloom.functions.text import is_buy
from barloom.operators.insider import buyers, since

# --- fixed values -----------------------------------------------------------
BEAT = 0.15
BEAT_MAX_DAYS = 30
BEAT_MIN_DAYS = 2
BEAT_ALLOCATION = 0.08
MAX_BEATS = 5
CLUSTER_BUYERS = 2
CLUSTER_DAYS = 45
CLUSTER_ALLOCATION = 0.05
MAX_EVENT_WEIGHT = 0.35
# ----------------------------------------------------------------------------


def pead_trigger(earnings: DataFrame, asof: str) -> DataFrame:
    """Newest qualifying beat per symbol: 2 to 30 days old, surprise of at least 15 %."""
    days = F.datediff(F.lit(asof).cast("date"), F.col("report_date"))
    hits = earnings.withColumn("days", days).where(
        F.col("days").between(BEAT_MIN_DAYS, BEAT_MAX_DAYS) & (F.col("estimate") != 0) & (F.col("surprise") >= BEAT)
    )
    newest = hits.groupBy("symbol").agg(F.max_by(F.struct("surprise", "days"), F.col("report_date")).alias("r"))
    return newest.select(
        "symbol",
        py_round("r.surprise", 4).alias("surprise_pct"),
        F.col("r.days").alias("days_since_earnings"),
        F.lit(BEAT_ALLOCATION).alias("allocation"),
        F.concat(
            F.lit("EPS beat "), pct_text("r.surprise", 1), F.format_string(" (%dd ago) — PEAD drift expected", F.col("r.days"))
        ).alias("reason"),
    )


def insider_cluster(tx: DataFrame, asof: str) -> DataFrame:
    """Symbols bought by at least two distinct insiders within 45 days; without names each purchase counts, without dates none."""
    if "tx_date" not in tx.columns or "text" not in tx.columns:
        tx = tx.where("false")
    bought = is_buy(F.col("text")) if "text" in tx.columns else F.lit(False)
    value = F.abs(to_double("value")) if "value" in tx.columns else F.lit(0.0)
    g = since(tx, asof, CLUSTER_DAYS).where(bought).groupBy("symbol").agg(
        buyers(tx, F.lit(True)).alias("n_insiders"),
        F.coalesce(F.sum(value.cast("decimal(20,4)")), F.lit(0)).cast("double").alias("total"),
    )
    return g.where(F.col("n_insiders") >= CLUSTER_BUYERS).select(
        "symbol",
        "n_insiders",
        py_round("total", 0).alias("total_value"),
        F.lit(CLUSTER_ALLOCATION).alias("allocation"),
        F.format_string("%d insiders bought ($%,.0f total) — cluster signal", F.col("n_insiders"), py_round("total", 0)).alias("reason"),
    )


def best_beats(triggers: DataFrame, n: int = MAX_BEATS) -> DataFrame:
    """Largest surprises; a distributed top-n."""
    return triggers.orderBy(F.desc("surprise_pct"), "symbol").limit(n)


def event_signals(pead: DataFrame, clusters: DataFrame, max_weight: float = MAX_EVENT_WEIGHT) -> DataFrame:
    """(symbol, events, reasons, total_allocation); allocations scaled to ``max_weight`` in total."""
    cols = [F.col("allocation"), F.col("reason")]
    stacked = best_beats(pead).select("symbol", F.lit("PEAD").alias("kind"), *cols).unionByName(
        clusters.select("symbol", F.lit("INSIDER_CLUSTER").alias("kind"), *cols)
    )
    # at most one row per kind and symbol, so the list has at most two entries
    merged = stacked.groupBy("symbol").agg(
        F.sum(F.col("allocation").cast("decimal(10,4)")).alias("alloc"),
        F.array_sort(F.collect_list(F.struct((F.col("kind") != "PEAD").alias("second"), "kind", "allocation", "reason"))).alias("events"),
    )
    total = merged.agg(F.sum("alloc").cast("double").alias("t")).scalar()
    alloc = F.col("alloc").cast("double")
    scaled = F.when(total > max_weight, py_round(alloc * (F.lit(max_weight) / total), 4)).otherwise(alloc)
    return merged.select(
        "symbol",
        F.transform("events", lambda e: e["kind"]).alias("events"),
        F.transform("events", lambda e: e["reason"]).alias("reasons"),
        scaled.alias("total_allocation"),
    )


EMPTY_EVENTS = "  No event-driven signals today."


def summarise_events(signals: DataFrame) -> DataFrame:
    """(symbol, line): a header that counts the symbols (no symbol of its own), then a line per symbol; one line says if there are none."""
    lines = signals.select(
        "symbol",
        F.concat(F.lit("    "), F.col("symbol"), F.lit(": "), pct_text("total_allocation", 1), F.lit(" — "), F.array_join("reasons", " | ")).alias("line"),
    )
    n = F.col("n")
    head = signals.agg(F.count("*").alias("n")).select(
        F.lit(None).cast("string").alias("symbol"),
        F.when(n == 0, F.lit(EMPTY_EVENTS)).otherwise(F.concat(F.lit("  Event-driven signals ("), n, F.lit(" stocks):"))).alias("line"),
    )
    return lines.unionByName(head)
