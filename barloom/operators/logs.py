"""Run-log analytics: block reconstruction, run status, compliance.

A log is identified by ``by`` (for instance desk and run date); ``seq`` orders its
entries. Nothing here gathers a whole log: blocks only need its first 45
per-stock entries, everything else is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import pct_text, py_round
from barloom.sources.dims import MAX_SECTOR_WEIGHT, MAX_SINGLE_POSITION, WATCHLIST

# --- fixed values -----------------------------------------------------------
PER_STOCK = ["News-Sentiment", "Technical-Forecaster", "Fundamentals"]
PORTFOLIO = ["Risk-Style", "Portfolio-Decision", "Risk-Management"]
ERRORS = ["Pipeline-Error"]
SLOTS = 3
# ----------------------------------------------------------------------------
LOG_KEYS = ("desk", "run_date")


def of_kind(log: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return log.where(F.col("agent").isin(*kinds))


def reconstruct_blocks(log: DataFrame, by: Sequence[str] = LOG_KEYS, names: int = len(WATCHLIST)) -> DataFrame:
    """Per-stock entries with the ordinal of the stock block they belong to.

    A news entry starts a block, a block holds at most three entries: inside each
    run that starts with news, blocks are consecutive triples. Every block takes
    at least one and at most three entries, so the first ``3 * names`` entries
    contain every block that can be attributed; that bound is applied as a row
    limit before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy("seq")
    rows = of_kind(log, PER_STOCK).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SLOTS * names)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_run", F.sum(F.when(F.col("agent") == PER_STOCK[0], 1).otherwise(0)).over(upto))
    inside = F.row_number().over(Window.partitionBy(*by, "_run").orderBy("seq")) - 1
    parts = runs.withColumn("_part", F.floor(inside / SLOTS))
    first = F.when(inside % SLOTS == 0, 1).otherwise(0)
    marked = parts.withColumn("_first", first)
    blocks = marked.withColumn("block", F.sum("_first").over(upto).cast("int"))
    return blocks.where(F.col("block") <= names).drop("_n", "_run", "_part", "_first")


def block_analyses(blocks: DataFrame, dims: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """One row per (log, stock): last entry of each agent in the block, stock by position."""

    def last(agent: str) -> Column:
        return F.max_by(F.when(F.col("agent") == agent, F.col("data")), F.when(F.col("agent") == agent, F.col("seq")))

    g = blocks.groupBy(*by, "block").agg(
        last("News-Sentiment").alias("sentiment"), last("Technical-Forecaster").alias("technical"), last("Fundamentals").alias("fundamentals")
    )
    named = g.join(dims.select(F.col("ordinal").alias("block"), "symbol"), "block")
    complete = F.col("sentiment").isNotNull() & F.col("technical").isNotNull() & F.col("fundamentals").isNotNull()
    return named.select(*by, "block", "symbol", "sentiment", "technical", "fundamentals", complete.alias("complete"))


def keyed_analyses(log: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """Variant that trusts the ticker written into the entry instead of its position."""
    rows = of_kind(log, PER_STOCK).withColumn("symbol", F.get_json_object("data", "$.ticker")).where(F.col("symbol").isNotNull())

    def last(agent: str) -> Column:
        return F.max_by(F.when(F.col("agent") == agent, F.col("data")), F.when(F.col("agent") == agent, F.col("seq")))

    return rows.groupBy(*by, "symbol").agg(
        last("News-Sentiment").alias("sentiment"), last("Technical-Forecaster").alias("technical"), last("Fundamentals").alias("fundamentals")
    )


def first_of(agent: str) -> Column:
    """First entry of an agent in the log wins."""
    on = F.col("agent") == agent
    return F.min_by(F.when(on, F.col("data")), F.when(on, F.col("seq")))


def run_status(log: DataFrame, blocks: DataFrame, dims: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """Phase flags, counts and portfolio-level answers per log."""
    entries = log.groupBy(*by).agg(
        F.count("*").alias("total_entries"),
        F.max_by("ts", "seq").alias("last_updated"),
        (F.count_if(F.col("agent").isin(*PER_STOCK)) > 0).alias("phase1_complete"),
        first_of("Risk-Style").alias("style_data"),
        first_of("Portfolio-Decision").alias("portfolio_data"),
        first_of("Risk-Management").alias("risk_data"),
        F.count_if(F.col("agent").isin(*ERRORS) & F.get_json_object("data", "$.ticker").isNotNull()).alias("error_count"),
    )
    stocks = block_analyses(blocks, dims, by).groupBy(*by).agg(F.count("*").alias("stocks_analyzed"), F.count_if("complete").alias("stocks_complete"))
    return status_columns(entries.join(stocks, list(by), "left"), by)


def status_columns(parts: DataFrame, by: Sequence[str] = LOG_KEYS, *more: str) -> DataFrame:
    """Status rows from counts and first answers per log; ``more`` columns are passed on."""
    zero = F.lit(0).cast("long")
    return parts.select(
        *by,
        "phase1_complete",
        F.col("portfolio_data").isNotNull().alias("phase2_complete"),
        F.col("risk_data").isNotNull().alias("phase3_complete"),
        "last_updated",
        "total_entries",
        F.coalesce("stocks_analyzed", zero).alias("stocks_analyzed"),
        F.coalesce("stocks_complete", zero).alias("stocks_complete"),
        F.lit(len(WATCHLIST)).alias("stocks_total"),
        "error_count",
        F.get_json_object("style_data", "$.style").alias("trading_style"),
        F.get_json_object("style_data", "$.confidence").try_cast("double").alias("style_confidence"),
        F.coalesce(F.get_json_object("portfolio_data", "$.cash_reserve").try_cast("double"), F.lit(1.0)).alias("cash_reserve"),
        F.get_json_object("portfolio_data", "$.rationale").alias("rationale"),
        F.get_json_object("portfolio_data", "$.weights").alias("weights_json"),
        F.get_json_object("risk_data", "$.actions").alias("risk_actions_json"),
        *more,
    )


def status_or_zero(requested: DataFrame, status: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """Status of the requested logs; a log without entries yields the zero state."""
    zeros = {
        "phase1_complete": False, "phase2_complete": False, "phase3_complete": False, "total_entries": 0, "stocks_analyzed": 0,
        "stocks_complete": 0, "stocks_total": len(WATCHLIST), "error_count": 0, "cash_reserve": 1.0,
    }
    return requested.select(*by).join(status, list(by), "left").na.fill(zeros)


def error_symbols(log: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """(by, seq, symbol) of the failed analyses, one row each so that no log is gathered."""
    named = of_kind(log, ERRORS).withColumn("symbol", F.get_json_object("data", "$.ticker"))
    return named.where(F.col("symbol").isNotNull()).select(*by, "seq", "symbol")


def logged_weights(status: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """(by, symbol, weight) of the first portfolio decision of each log."""
    m = F.from_json("weights_json", "map<string,double>")
    return status.where(F.col("weights_json").isNotNull()).select(*by, F.explode(m).alias("symbol", "weight"))


def sector_weights(weights: DataFrame, dims: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    known = weights.join(dims.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return known.groupBy(*by, "sector").agg(py_round(F.sum("weight"), 4).alias("weight"))


def violations(weights: DataFrame, dims: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """(by, kind, name, weight, message) for every breached single-name or sector cap."""

    def rows(df: DataFrame, name: str, cap: float, kind: str, label: str) -> DataFrame:
        text = F.concat(F.col(name), F.lit(": "), pct_text("weight", 1), F.lit(f" > {cap:.0%} {label} cap"))
        return df.where(F.col("weight") > cap).select(*by, F.lit(kind).alias("kind"), F.col(name).alias("name"), "weight", text.alias("message"))

    single = rows(weights, "symbol", MAX_SINGLE_POSITION, "single", "single-name")
    return single.unionByName(rows(sector_weights(weights, dims, by), "sector", MAX_SECTOR_WEIGHT, "sector", "sector"))


def compliance(weights: DataFrame, dims: DataFrame, by: Sequence[str] = LOG_KEYS) -> DataFrame:
    """Gross exposure, largest name, number of violations and the three check flags."""
    base = weights.groupBy(*by).agg(py_round(F.sum("weight"), 4).alias("gross_exposure"), F.max("weight").alias("top_weight"))
    broken = violations(weights, dims, by).groupBy(*by).agg(F.count("*").alias("n_violations"), F.count_if(F.col("kind") == "sector").alias("_s"))
    return base.join(broken, list(by), "left").select(
        *by,
        "gross_exposure",
        "top_weight",
        F.coalesce("n_violations", F.lit(0).cast("long")).alias("n_violations"),
        (F.col("top_weight") <= MAX_SINGLE_POSITION).alias("single_ok"),
        (F.coalesce("_s", F.lit(0)) == 0).alias("sector_ok"),
        (F.col("gross_exposure") <= 1).alias("gross_ok"),
    )
