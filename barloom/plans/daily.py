"""The research day with its end, and the status request, as Spark plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import events, factors, hrp, logs, macro, memory, news, options, pairs, portfolio, risk, rollup, universe
from barloom.operators import technical as tech
from barloom.session import cut_lineage, keep
from barloom.sources import readers, sinks
from barloom.sources.snapshots import SnapshotStore


@dataclass(frozen=True)
class Inputs:
    """Tables of one day; ``proposals`` (symbol, weight) come from the caller's decision step."""

    bars: DataFrame
    macro: DataFrame
    earnings: DataFrame
    insider_tx: DataFrame
    options: DataFrame
    scored_news: DataFrame
    fundamentals: DataFrame
    proposals: DataFrame
    dims: DataFrame
    styles: DataFrame
    directions: DataFrame  # (symbol, direction, confidence) of the model or another forecaster
    positions: DataFrame | None = None
    equity: float = 100_000.0
    starting_equity: float = 100_000.0
    style: str = "balanced"
    min_dollar_volume: float = universe.MIN_AVG_DOLLAR_VOLUME
    snapshot_days: int = 60
    lookback_days: int = 366
    events_asof: str | None = None
    rationale: str = ""


@dataclass(frozen=True)
class Day:
    """Results of one day; all lazy."""

    regime: DataFrame
    universe: DataFrame
    technical: DataFrame
    sentiment: DataFrame
    health: DataFrame
    events: DataFrame
    options: DataFrame
    pairs: DataFrame
    base: DataFrame
    weights: DataFrame
    actions: DataFrame | None
    report: DataFrame


@dataclass(frozen=True)
class EndOfDay:
    """What a day leaves behind; all lazy."""

    thresholds: DataFrame  # (symbol, style, sl_pct, tp_pct) of the positions, or of the largest proposed ones on a first run
    positions: DataFrame
    account: DataFrame
    decision: DataFrame
    orders: DataFrame


PROPOSED = 5  # names whose thresholds a first run shows


def daily_run(day: Inputs, asof: str) -> Day:
    """Regime and screen, per-symbol signals, portfolio construction, risk overrides, report.

    Only the screened universe (at most 80 names) goes past the first step, so
    everything after it is small; the screen itself is the distributed part. A
    missing signal is a default after a left join, not a failure.
    """
    run = F.lit(asof).cast("date").alias("run_date")
    events_asof = day.events_asof or asof
    regime = keep(macro.macro_regime(day.macro, asof))
    chosen = keep(macro.trim_in_risk_off(universe.screen_universe(readers.read_bars(day.bars, until=asof), day.min_dollar_volume, asof=asof), regime))
    names = chosen.select("symbol")
    bars = keep(readers.trailing_bars(day.bars.join(names, "symbol", "left_semi"), asof, day.lookback_days))

    call = tech.technical_snapshot(bars, asof, day.snapshot_days).join(day.directions, "symbol", "left")
    technical = names.join(tech.hybrid_gate(call), "symbol", "left").na.fill({"direction": "sideways", "confidence": 0.0, "gate": "NO_DATA"})
    sentiment = names.join(news.aggregate_sentiment(day.scored_news), "symbol", "left").na.fill(
        {"sentiment_score": 0.0, "confidence": 0.0, "key_theme": "No news available"}
    )
    scores = factors.factor_score(factors.price_factors(bars, asof, day.lookback_days), day.fundamentals.join(names, "symbol", "left_semi"))
    health = names.join(factors.fundamental_select(scores), "symbol", "left").na.fill({"health_score": 50, "key_strength": "", "key_risk": ""})

    triggered = events.event_signals(
        events.pead_trigger(day.earnings.join(names, "symbol", "left_semi"), asof),
        events.insider_cluster(day.insider_tx.join(names, "symbol", "left_semi"), events_asof),
    )
    flow = options.options_signal(day.options.join(names, "symbol", "left_semi"))
    blocks = pairs.block_count(names)
    found = keep(pairs.cointegrated_pairs(bars, blocks))
    signals = pairs.pair_signals(found, readers.trailing_bars(bars, asof, day.lookback_days // 2))
    base = hrp.hrp_weights(hrp.lookback_windows(bars, bars.select(run).limit(1)), names=names.select(run, "symbol"))

    capped = portfolio.apply_constraints(day.proposals.select(run, "symbol", "weight"), day.dims.join(names, "symbol", "left_semi"))
    weights = portfolio.merge_weights(
        capped,
        fallback=base,
        pairs=pairs.pair_weight_deltas(signals).select(run, "symbol", "weight"),
        events=triggered.select(run, "symbol", F.col("total_allocation").alias("weight")),
        multiplier=regime.select(run, "equity_mult"),
    )
    actions = None
    if day.positions is not None:
        held = marked(day, asof)
        actions = risk.check_positions(held.join(limits(day, held, asof), "symbol"), day.equity, day.starting_equity)
        weights = risk.override_weights(weights, actions)
    report = portfolio.final_report(weights, technical, sentiment, health)
    return Day(regime, chosen, technical, sentiment, health, triggered, flow, signals, base, weights, actions, report)


def marked(day: Inputs, asof: str) -> DataFrame:
    """The positions at their last close up to ``asof``."""
    return portfolio.mark_positions(day.positions, tech.latest_per_symbol(readers.read_bars(day.bars, day.positions, until=asof)))


def limits(day: Inputs, names: DataFrame, asof: str) -> DataFrame:
    """(symbol, style, sl_pct, tp_pct) of ``names`` under the day's style."""
    vol = risk.daily_vol(day.bars.join(names.select("symbol"), "symbol", "left_semi"), asof, day.snapshot_days)
    return risk.risk_thresholds(names.select("symbol", F.lit(day.style).alias("style")), vol, day.styles)


def end_of_day(day: Inputs, done: Day, asof: str) -> EndOfDay:
    """Thresholds, the snapshot to be checked tomorrow, the decision to be remembered, and the orders that lead to the weights.

    Orders compare the weights with the marked positions; without positions all
    are buys. The starting equity is carried on. A day without weights leaves no
    position and no decision, and sells what is held.
    """
    run = F.lit(asof).cast("date").alias("run_date")
    weights = cut_lineage(done.weights.select("symbol", "weight"))  # at most the names of the universe
    prices = tech.latest_per_symbol(readers.read_bars(day.bars, weights, until=asof))
    spark = weights.sparkSession
    before = spark.range(1).select(F.lit(float(day.starting_equity)).alias("starting_equity"))
    positions, account = portfolio.snapshot_positions(weights, prices, day.equity, asof, before)
    held = cut_lineage(marked(day, asof)) if day.positions is not None else None
    names = held if held is not None else weights.where("weight > 0").orderBy(F.desc("weight"), "symbol").limit(PROPOSED)
    facts = weights.where("weight > 0").limit(1).select(run, F.lit(day.style).alias("style"), F.lit(day.rationale).alias("rationale"), F.lit(None).cast("double").alias("pnl_pct"))
    one = F.lit("account").alias("portfolio")
    value = spark.createDataFrame([], "symbol string, value double") if held is None else held.select("symbol", (F.col("current_price") * F.col("shares")).alias("value"))
    equity = spark.range(1).select(one, F.lit(float(day.equity)).alias("equity"))
    orders = portfolio.rebalance_orders(weights.select(one, "symbol", "weight"), value.select(one, "symbol", "value"), equity).drop("portfolio")
    return EndOfDay(limits(day, names, asof), positions, account, memory.decision_documents(weights.select(run, "symbol", "weight"), facts), orders)


def save_day(end: EndOfDay, folder: str, asof: str) -> None:
    """Write the snapshot of the day, and its decision over an earlier one of the same day."""
    sinks.write_portfolio_state(end.positions, end.account.withColumn("last_update", F.col("last_update").cast("string")), f"{folder}/portfolio", asof)
    SnapshotStore(end.decision.sparkSession, f"{folder}/decisions", ["id"]).upsert(end.decision)


def status_request(log: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(status, analyses, compliance, rollup) of every log."""
    blocks = logs.reconstruct_blocks(log)
    status = logs.run_status(log, blocks, dims)
    analyses = logs.block_analyses(blocks, dims)
    checks = logs.compliance(logs.logged_weights(status), dims)
    return status, analyses, checks, rollup.market_rollup(rollup.with_scores(analyses))


