"""Technical indicators, the training feature panel and the latest-bar snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.alignment import Facts, asof_many, fill_on_calendar
from barloom.functions.numeric import py_round, ratio
from barloom.functions.series import (
    dealt,
    forward_return,
    log_return,
    pct_change,
    prefix_mean,
    rolling_std,
    running_sum,
    series,
    sma,
    span_alpha,
    with_ewm,
    with_row_index,
)
from barloom.operators.earnings import earnings_facts, score_pead
from barloom.session import SMALL_SIDE_ROWS, cut_lineage
from barloom.sources.readers import trailing_bars

# --- fixed values -----------------------------------------------------------
FORWARD_ROWS = 5
MIN_FEATURE_ROWS = 210
MIN_SNAPSHOT_ROWS = 21
RSI_ALPHA = 1.0 / 14
TRADING_DAYS = 252
DEFAULT_VIX = 20.0
BASE_FEATURES = [
    "rsi", "macd_hist", "bb_pos", "atr_pct", "volume_ratio",
    "ret_5d", "ret_21d", "ret_63d", "momentum_12_1",
    "price_vs_sma20", "price_vs_sma50", "price_vs_sma200",
    "sector_ret_5d", "spy_ret_5d", "vix",
]
SIDE_FEATURES = {
    "earnings_surprise_pct": 0.0, "pead_signal": 0.0,
    "gtrends_spike_ratio": 1.0, "gtrends_spike_flag": 0.0,
    "insider_score": 0.0,
}
# ----------------------------------------------------------------------------
FEATURES = BASE_FEATURES + list(SIDE_FEATURES)


def with_history(df: DataFrame, rows: int, key: str = "symbol") -> DataFrame:
    """Keep series with at least ``rows`` rows, without a second shuffle of the series."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_have", n).where(F.col("_have") >= rows).drop("_have")


def with_volume_ratio(bars: DataFrame) -> DataFrame:
    """Volume over its 20-row mean, taken on volume's own non-missing rows.

    A series without any volume gets a constant 1. Also counts the closes of the
    series (``_have``), as both counts share a window.
    """
    w = Window.partitionBy("symbol", "_hasv").orderBy("date").rowsBetween(-19, 0)
    whole = Window.partitionBy("symbol")
    return (
        bars.withColumn("_hasv", F.col("volume").isNotNull())
        .select("*", F.avg("volume").over(w).alias("_vm"), F.count("volume").over(w).alias("_vn"))
        .select("*", F.count("volume").over(whole).alias("_volumes"), F.count("close").over(whole).alias("_have"))
        .withColumn("volume_ratio", F.when(F.col("_volumes") == 0, 1.0).when(F.col("_vn") >= 20, ratio("volume", "_vm")))
        .drop("_hasv", "_vm", "_vn", "_volumes")
    )


def with_rsi_inputs(df: DataFrame, seed_zero: bool, *extra: Column) -> DataFrame:
    """Gain and loss legs of the close-to-close change, plus ``extra`` same-window columns.

    ``seed_zero`` starts both legs at 0 on the first row (indicator form);
    otherwise the first change seeds them (feature form).
    """
    first = F.lit(0.0) if seed_zero else F.lit(None).cast("double")
    diff = F.col("close") - F.col("_prev")

    def leg(d: Column) -> Column:
        return F.when(F.col("_prev").isNull(), first).otherwise(F.greatest(d, F.lit(0.0)))

    return df.select("*", F.lag("close", 1).over(series()).alias("_prev"), *extra).select(
        "*", diff.alias("_diff"), leg(diff).alias("_gain"), leg(-diff).alias("_loss")
    )


def rsi(gain: str = "avg_gain", loss: str = "avg_loss", zero_loss: float | None = None) -> Column:
    """RSI from averaged legs; a zero loss leg gives NULL or ``zero_loss``."""
    value = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio(gain, loss))
    if zero_loss is None:
        return value
    return F.when((F.col(loss) == 0) & (F.col(gain) > 0), F.lit(zero_loss)).otherwise(value)


def index_panel(indices: DataFrame) -> DataFrame:
    """(index, date, idx_ret_5d, idx_fwd_5d) of the market and every sector.

    Gaps are forward-filled on the union calendar before taking returns.
    """
    w = series("index")
    return fill_on_calendar(indices.select("index", "date", "close"), indices, "index", "close").select(
        "index",
        "date",
        pct_change("close", 5, w).alias("idx_ret_5d"),
        forward_return("close", FORWARD_ROWS, w).alias("idx_fwd_5d"),
    )


def index_calendar(indices: DataFrame, vix: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One row per index and day with all a panel row takes from indices, and the list of indices.

    The calendar (bench, date, sector_ret_5d, spy_ret_5d, _spy_fwd, vix) is written
    once, so that a panel reads one small table for it, whatever it was made from. It is hinted for a
    broadcast only if its counted rows are within the bound.
    """
    kept = cut_lineage(indices.select("index", "date", "close"))
    days = Window.partitionBy("date")
    is_market = F.col("index") == "MKT"
    calendar = index_panel(kept).select(
        F.col("index").alias("bench"),
        "date",
        F.col("idx_ret_5d").alias("sector_ret_5d"),
        F.max(F.when(is_market, F.col("idx_ret_5d"))).over(days).alias("spy_ret_5d"),
        F.max(F.when(is_market, F.col("idx_fwd_5d"))).over(days).alias("_spy_fwd"),
    )
    if vix is None:
        calendar = calendar.withColumn("vix", F.lit(DEFAULT_VIX))
    else:
        calendar = calendar.join(vix.select("date", F.col("close").alias("vix")), "date")
    calendar = cut_lineage(calendar)
    if calendar.count() <= SMALL_SIDE_ROWS:
        calendar = F.broadcast(calendar)
    return calendar, kept.select(F.col("index").alias("_bench")).distinct()


SMA_ROWS = (20, 50, 200)
RETURN_ROWS = (5, 21, 63, 252)


def with_price_features(df: DataFrame) -> DataFrame:
    """Band position, returns, momentum and distance to the moving averages.

    Every window value is a column of its own before it is used (repeated window
    expressions would be computed repeatedly). Needs ``running_sum("close")`` and
    the ``_diff`` column.
    """
    w = series()
    raw = df.select(
        "*",
        *[prefix_mean(n).alias(f"_sma{n}") for n in SMA_ROWS],
        *[F.lag("close", n).over(w).alias(f"_lag{n}") for n in RETURN_ROWS],
        F.lead("close", FORWARD_ROWS).over(w).alias("_ahead"),
        rolling_std("close", 20).alias("_std20"),
        sma(F.abs("_diff"), 14).alias("_atr"),
    )
    c = F.col("close")
    ret = {n: ratio(c, f"_lag{n}") - 1 for n in RETURN_ROWS}
    return raw.select(
        *[x for x in df.columns if x not in ("_cs", "_cn", "_prev")],
        ((c - (F.col("_sma20") - 2 * F.col("_std20"))) / (4 * F.col("_std20") + 1e-9)).alias("bb_pos"),
        ratio("_atr", c).alias("atr_pct"),
        ret[5].alias("ret_5d"),
        ret[21].alias("ret_21d"),
        ret[63].alias("ret_63d"),
        (ret[252] - ret[21]).alias("momentum_12_1"),
        *[ratio(c - F.col(f"_sma{n}"), f"_sma{n}").alias(f"price_vs_sma{n}") for n in SMA_ROWS],
        (ratio("_ahead", c) - 1).alias("fwd_ret"),
    )


def technical_features(bars: DataFrame, dims: DataFrame, indices: DataFrame, vix: DataFrame | None, tasks: int | None = None) -> DataFrame:
    """Complete-case panel of the 15 base features plus forward returns and label.

    ``indices`` is (index, date, close) of every sector and of the market ``MKT``,
    which also stands in for a sector without an index.

    The bars are placed by symbol once; every window, including the chained
    exponential means, reuses that placement. Market, sector and VIX series are
    calendar-sized: they become one table that is joined once. ``tasks`` is how many
    tasks the bars are dealt to, for large tables (:func:`series_tasks`).
    """
    placed = with_volume_ratio(dealt(bars, tasks) if tasks else bars.repartition("symbol")).where(F.col("close").isNotNull() & (F.col("_have") >= MIN_FEATURE_ROWS))
    legs = with_rsi_inputs(placed, False, *running_sum("close"), (F.row_number().over(series()) - 1).alias("_rn"))
    windows = with_price_features(legs).drop("volume", "_have", "_diff")
    means = with_ewm(
        windows,
        {
            "_ema12": ("close", span_alpha(12)),
            "_ema26": ("close", span_alpha(26)),
            "avg_gain": ("_gain", RSI_ALPHA),
            "avg_loss": ("_loss", RSI_ALPHA),
        },
    ).withColumn("_macd", F.col("_ema12") - F.col("_ema26"))
    signal = with_ewm(means, {"_sig": ("_macd", span_alpha(9))})
    panel = signal.select(
        "symbol",
        "date",
        rsi().alias("rsi"),
        (F.col("_macd") - F.col("_sig")).alias("macd_hist"),
        *BASE_FEATURES[2:12],
        "fwd_ret",
    )
    complete = panel.where(" and ".join(f"{c} is not null" for c in BASE_FEATURES[:12]))
    return _attach_indices(complete, dims, indices, vix)


def _attach_indices(panel: DataFrame, dims: DataFrame, indices: DataFrame, vix: DataFrame | None) -> DataFrame:
    calendar, known = index_calendar(indices, vix)
    bench = dims.select("symbol", "sector").join(known, F.col("sector") == F.col("_bench"), "left").select("symbol", "_bench")
    # a day without sector, market or VIX value makes no complete row
    complete = calendar.where(" and ".join(f"{c} is not null" for c in BASE_FEATURES[12:]))
    out = panel.join(bench, "symbol", "left").withColumn("bench", F.coalesce("_bench", F.lit("MKT"))).join(complete, ["bench", "date"])
    rel = F.col("fwd_ret") - F.col("_spy_fwd")
    return (
        out.withColumn("rel_fwd_ret", rel)
        .withColumn("label", F.when(F.col("rel_fwd_ret") > 0, 1).otherwise(0))
        .select("symbol", "date", *BASE_FEATURES, "fwd_ret", "rel_fwd_ret", "label")
    )


def build_features(base: DataFrame, earnings: DataFrame | None, trends: DataFrame | None, insider: DataFrame | None, tasks: int | None = None) -> DataFrame:
    """Base panel plus earnings drift, search interest and insider score, with defaults."""
    facts = [f for f in (earnings_facts(earnings) if earnings is not None else None, trend_facts(trends) if trends is not None else None) if f]
    out = asof_many(base, facts, tasks=tasks) if facts else base
    if earnings is not None:
        other = [c for c in out.columns if c not in ("report_date", "surprise", "_known")]
        out = score_pead(out, F.col("date"), other).drop("days_since_beat", "days_since_report")
    if insider is not None:
        out = out.join(insider.select("symbol", "insider_score"), "symbol", "left")
    for name, default in SIDE_FEATURES.items():
        c = F.col(name) if name in out.columns else F.lit(None).cast("double")
        out = out.withColumn(name, F.coalesce(c, F.lit(default)))
    return out.select("symbol", "date", *FEATURES, "fwd_ret", "rel_fwd_ret", "label")


def weekly_trends(interest: DataFrame) -> DataFrame:
    """Interest over its 13-week mean (at least 4 weeks), flag above 1.5."""
    mean13 = sma("interest", 13, min_periods=4, order="week")
    spike = F.coalesce(ratio("interest", mean13), F.lit(1.0))
    return interest.withColumn("gtrends_spike_ratio", spike).select(
        "symbol",
        "week",
        F.col("interest").alias("gtrends_interest"),
        "gtrends_spike_ratio",
        F.when(F.col("gtrends_spike_ratio") > 1.5, 1.0).otherwise(0.0).alias("gtrends_spike_flag"),
    )


def trend_facts(trends: DataFrame, back_fill: bool = True) -> Facts:
    cols = ["gtrends_interest", "gtrends_spike_ratio", "gtrends_spike_flag"]
    return Facts(trends, cols, "week", back_fill=back_fill, not_before_first_probe=True)


def attach_trends(panel: DataFrame, trends: DataFrame, back_fill: bool = True, tasks: int | None = None) -> DataFrame:
    """Weekly values held until the next week; the first in-range week also fills backwards.

    ``back_fill=False`` is the point-in-time variant.
    """
    hit = asof_many(panel, [trend_facts(trends, back_fill)], tasks=tasks)
    defaults = {"gtrends_interest": 1.0, "gtrends_spike_ratio": 1.0, "gtrends_spike_flag": 0.0}
    return hit.na.fill(defaults)


def latest_per_symbol(panel: DataFrame, order: str = "date") -> DataFrame:
    """Last row of every series; a partial aggregate, not a window over the history."""
    cols = [F.col(c) for c in panel.columns if c not in ("symbol", order)]
    return panel.groupBy("symbol").agg(F.max_by(F.struct(F.col(order), *cols), F.col(order)).alias("r")).select("symbol", "r.*")


def technical_snapshot(bars: DataFrame, asof: str, days: int = 60, decimals: bool = True) -> DataFrame:
    """Indicators on the latest bar of the trailing window, rounded as published."""
    recent = trailing_bars(bars, asof, days).repartition("symbol")
    legs = with_rsi_inputs(with_history(recent, MIN_SNAPSHOT_ROWS), seed_zero=True)
    lr = legs.withColumn("_lr", log_return("close"))
    w20 = series().rowsBetween(-19, 0)
    cols = lr.select(
        "*",
        sma("close", 20).alias("_sma20"),
        F.max("close").over(w20).alias("_high"),
        F.min("close").over(w20).alias("_low"),
        F.stddev_samp("_lr").over(series().rowsBetween(-9, 0)).alias("_hv10"),
        F.stddev_samp("_lr").over(w20).alias("_sd20"),
    )
    means = with_ewm(with_row_index(cols), {"avg_gain": ("_gain", RSI_ALPHA), "avg_loss": ("_loss", RSI_ALPHA)})
    last = latest_per_symbol(means)
    c = F.col("close")
    r = py_round if decimals else (lambda x, _: x)
    return last.select(
        "symbol",
        "date",
        r(c, 2).alias("price"),
        r(rsi(zero_loss=100.0), 1).alias("rsi_14"),
        r(ratio(c - F.col("_sma20"), "_sma20") * 100, 2).alias("sma20_dist_pct"),
        r(ratio(c - F.col("_high"), "_high") * 100, 2).alias("dist_to_20d_high_pct"),
        r(ratio(c - F.col("_low"), "_low") * 100, 2).alias("dist_to_20d_low_pct"),
        r(F.col("_hv10") * F.sqrt(F.lit(float(TRADING_DAYS))) * 100, 1).alias("hv_10_annualized"),
        r(F.col("_sd20") * 100, 2).alias("atr_20_pct"),
        r(F.greatest(F.lit(1.0), F.col("_sd20") * 100 * 0.5), 2).alias("breakout_threshold"),
        (c >= F.col("_high")).alias("new_20d_high"),
        (c <= F.col("_low")).alias("new_20d_low"),
    )


def hybrid_gate(df: DataFrame) -> DataFrame:
    """Force an overbought name without a breakout sideways; needs direction and confidence."""
    blocked = (
        (F.coalesce("rsi_14", F.lit(50.0)) > 70)
        & (F.abs(F.coalesce("dist_to_20d_high_pct", F.lit(0.0))) > F.coalesce("breakout_threshold", F.lit(1.0)))
        & ~F.coalesce("new_20d_high", F.lit(False))
    )
    return (
        df.withColumn("_blocked", blocked)
        .withColumn("direction", F.when(F.col("_blocked"), "sideways").otherwise(F.coalesce("direction", F.lit("sideways"))))
        .withColumn("confidence", F.when(F.col("_blocked"), 0.3).otherwise(F.coalesce("confidence", F.lit(0.5))))
        .withColumn("gate", F.when(F.col("_blocked"), "HARD_INTERCEPT: RSI overbought, no valid breakout").otherwise("SOFT_PASS"))
        .drop("_blocked")
    )


def direction_from_prob(prob: Column) -> tuple[Column, Column]:
    """(direction, confidence) of an up-probability."""
    direction = F.when(prob >= 0.55, "bullish").when(prob <= 0.45, "bearish").otherwise("sideways")
    return direction, F.abs(prob - 0.5) * 2
