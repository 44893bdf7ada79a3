"""Signals: events, options, insiders, macro, universe, factors, news."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import dealt
from barloom.operators import events, factors, insider, live, macro, news, options, universe
from barloom.operators import technical as tech
from barloom.plans.cte import SW, clip, cte, pyround, sigmoid
from barloom.plans.registry import query
from barloom.plans.windows import base_panel
from barloom.session import shared_folder
from barloom.sources import readers
from barloom.sources.dims import watchlist
from barloom.sources.snapshots import SnapshotStore
from barloom.sources.tables import BARS_ASOF, EVENTS_ASOF, Tables

SCREEN_SINCE = "2000-09-04"  # 14 months before BARS_ASOF, on the raw column
TURNOVER = 45_000.0  # the screen's dollar-volume floor at the scale of supplier bars
YEAR_DAYS = 1400  # calendar days that hold about 300 bars of a supplier
LIVE_CUTS, LIVE_REACH = ("2001-10-15", "2001-10-25"), "2001-09-01"  # days up to which states are advanced, and from when indices are read for that

# -- insider -------------------------------------------------------------------

cte(
    "insider_score",
    f"""SELECT symbol, {pyround('share', 3)} AS purchase_ratio, n_insiders, {pyround('score', 3)} AS insider_score FROM (
        SELECT *, share*share*0.6::DOUBLE + least(n_insiders/5.0::DOUBLE, 1.0::DOUBLE)*0.4::DOUBLE AS score FROM (
        SELECT symbol, coalesce(CAST(nb AS DOUBLE)/nullif(nb+ns, 0), 0.0) AS share, n_insiders FROM (
        SELECT symbol, count(*) FILTER (is_buy AND value >= 10000) AS nb, count(*) FILTER (is_sell) AS ns,
               count(DISTINCT CASE WHEN is_buy AND value >= 10000 THEN insider END) AS n_insiders
        FROM insider_tx WHERE tx_date BETWEEN DATE '{EVENTS_ASOF}' - 90 AND DATE '{EVENTS_ASOF}' GROUP BY 1)))""",
    "insider_tx",
)


@query(
    "p07_recency",
    f"SELECT symbol, count(*) FILTER (tx_date >= DATE '{EVENTS_ASOF}' - 90) AS n90, count(*) FILTER (tx_date >= DATE '{EVENTS_ASOF}' - 45) AS n45, count(*) FILTER (tx_date >= DATE '{EVENTS_ASOF}' - 30) AS n30 FROM insider_tx WHERE tx_date <= DATE '{EVENTS_ASOF}' AND tx_date >= DATE '{EVENTS_ASOF}' - 90 GROUP BY 1",
    "insider_tx",
)
def _(t: Tables) -> DataFrame:
    recent = insider.since(readers.read_insider_tx(t.insider_tx()), EVENTS_ASOF, 90)
    end = F.lit(EVENTS_ASOF).cast("date")
    return recent.groupBy("symbol").agg(*[F.count_if(F.col("tx_date") >= F.date_sub(end, d)).alias(f"n{d}") for d in (90, 45, 30)])


@query(
    "p09_min_value",
    "SELECT symbol, tx_date, insider, value FROM insider_tx WHERE is_buy AND value >= 10000",
    "insider_tx",
    "value:2",
)
def _(t: Tables) -> DataFrame:
    from barloom.functions.numeric import to_double
    from barloom.functions.text import is_buy

    tx = readers.read_insider_tx(t.insider_tx()).withColumn("value", F.abs(to_double("value")))
    return tx.where(is_buy(F.col("text")) & (F.col("value") >= insider.MIN_PURCHASE)).select("symbol", "tx_date", "insider", "value")


@query("d06_insider_signal", "SELECT * FROM insider_score", "insider_score", "purchase_ratio insider_score")
def _(t: Tables) -> DataFrame:
    return insider.insider_signal(readers.read_insider_tx(t.insider_tx()), EVENTS_ASOF)


@query(
    "d06_insider_without_columns",
    f"""SELECT symbol, {pyround('share', 3)} AS purchase_ratio, n_insiders, {pyround('score', 3)} AS insider_score FROM (
        SELECT *, share*share*0.6::DOUBLE + least(n_insiders/5.0::DOUBLE, 1.0::DOUBLE)*0.4::DOUBLE AS score FROM (
        SELECT symbol, coalesce(CAST(count(*) FILTER (is_buy) AS DOUBLE)/nullif(count(*) FILTER (is_buy) + count(*) FILTER (is_sell), 0), 0.0) AS share,
               count(*) FILTER (is_buy) AS n_insiders FROM insider_tx GROUP BY 1))""",
    "insider_tx",
    "purchase_ratio insider_score",
)
def _(t: Tables) -> DataFrame:
    bare = t.insider_tx().drop("Value", "Insider", "Start Date")
    return insider.insider_signal(readers.read_insider_tx(bare), EVENTS_ASOF)


@query(
    "d21_cluster_without_names",
    f"""SELECT symbol, n_insiders, 0.0::DOUBLE AS total_value FROM (SELECT symbol, count(*) AS n_insiders FROM insider_tx
        WHERE is_buy AND tx_date BETWEEN DATE '{EVENTS_ASOF}' - 45 AND DATE '{EVENTS_ASOF}' GROUP BY 1) WHERE n_insiders >= 2""",
    "insider_tx",
    "total_value",
)
def _(t: Tables) -> DataFrame:
    from barloom.operators import events

    bare = readers.read_insider_tx(t.insider_tx().drop("Value", "Insider"))
    return events.insider_cluster(bare, EVENTS_ASOF).select("symbol", "n_insiders", "total_value")


cte("pit_facts", "SELECT symbol, tx_date, insider, is_buy AND coalesce(value >= 10000, false) AS buy, is_sell AS sell FROM insider_tx", "insider_tx")
cte("pit_probe", "SELECT DISTINCT 'S' || user_id AS symbol, CAST(ts AS DATE) AS date FROM events")
cte(
    "pit_counts",
    """SELECT p.symbol, p.date, count(*) FILTER (buy) AS nb, count(*) FILTER (sell) AS ns, count(DISTINCT CASE WHEN buy THEN insider END) AS ni
       FROM pit_probe p LEFT JOIN pit_facts f ON f.symbol=p.symbol AND f.tx_date BETWEEN p.date - 90 AND p.date GROUP BY 1, 2""",
    "pit_facts",
    "pit_probe",
)


@query(
    "d06_insider_point_in_time",
    f"""SELECT symbol, date, {pyround('score', 3)} AS insider_score FROM (SELECT symbol, date, share*share*0.6::DOUBLE + least(ni/5.0::DOUBLE, 1.0::DOUBLE)*0.4::DOUBLE AS score
        FROM (SELECT *, coalesce(CAST(nb AS DOUBLE)/nullif(nb+ns,0),0.0) AS share FROM pit_counts))""",
    "pit_counts",
    "insider_score",
)
def _(t: Tables) -> DataFrame:
    probe = t.raw("events").select(F.concat(F.lit("S"), F.col("user_id")).alias("symbol"), F.col("ts").cast("date").alias("date")).distinct()
    return insider.point_in_time_score(probe, readers.read_insider_tx(t.insider_tx()))


# -- full panel ------------------------------------------------------------------

cte("panel_keys", "SELECT symbol, date FROM features", "features")


def _full_sql() -> str:
    from barloom.plans.windows import pead_sql, trends_sql

    cte("panel_pead", pead_sql("panel_keys"), "panel_keys", "earnings")
    cte("panel_trend", trends_sql("panel_keys"), "panel_keys", "trends")
    return f"""SELECT f.symbol, f.date, {', '.join('f.' + c for c in tech.BASE_FEATURES)}, e.earnings_surprise_pct, e.pead_signal,
      g.gtrends_spike_ratio, g.gtrends_spike_flag, coalesce(i.insider_score, 0.0) AS insider_score, f.fwd_ret, f.rel_fwd_ret, f.label
      FROM features f JOIN panel_pead e ON e.symbol=f.symbol AND e.date=f.date JOIN panel_trend g ON g.symbol=f.symbol AND g.date=f.date
      LEFT JOIN insider_score i ON i.symbol=f.symbol"""


cte("full_features", _full_sql(), "features", "panel_pead", "panel_trend", "insider_score")
_FULL = " ".join(f"{c}:{4 if c == 'macd_hist' else 6}" for c in [*tech.FEATURES, "fwd_ret", "rel_fwd_ret"])


def full_panel(t: Tables) -> DataFrame:
    return tech.build_features(
        base_panel(t),
        readers.read_earnings(t.earnings()),
        tech.weekly_trends(dealt(t.interest(), t.series_tasks)),
        insider.insider_signal(readers.read_insider_tx(t.insider_tx()), EVENTS_ASOF),
        t.series_tasks,
    )


@query("d02_build_features", "SELECT * FROM full_features", "full_features", _FULL)
def _(t: Tables) -> DataFrame:
    return full_panel(t)


@query(
    "d03_live_features",
    "SELECT * EXCLUDE (back) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM full_features) WHERE back = 1",
    "full_features",
    _FULL,
)
def _(t: Tables) -> DataFrame:
    return tech.latest_per_symbol(full_panel(t))


cte(
    "live_side",
    f"""SELECT symbol, coalesce({pyround('surprise', 4)}, 0.0) AS earnings_surprise_pct, {pyround('sig', 4)} AS pead_signal FROM (
        SELECT symbol, ls AS surprise, CASE WHEN ls >= 0.05 AND days BETWEEN 0 AND 60 THEN greatest(0.0::DOUBLE, 1.0-days/60.0::DOUBLE)*least(1.0::DOUBLE, ls/0.15::DOUBLE) ELSE 0.0 END AS sig
        FROM (SELECT symbol, lr, ls, DATE '{BARS_ASOF}' - lr AS days FROM earn_last))""",
    "earn_last",
)
cte("live_trend", f"SELECT symbol, {pyround('r', 3)} AS gtrends_spike_ratio, f AS gtrends_spike_flag FROM (SELECT symbol, arg_max(gtrends_spike_ratio, week) AS r, arg_max(gtrends_spike_flag, week) AS f FROM trends GROUP BY 1)", "trends")


@query(
    "d03_live_state",
    f"""SELECT f.symbol, f.date, {', '.join('f.' + c for c in tech.BASE_FEATURES)}, coalesce(e.earnings_surprise_pct, 0.0) AS earnings_surprise_pct, coalesce(e.pead_signal, 0.0) AS pead_signal,
        coalesce(g.gtrends_spike_ratio, 1.0) AS gtrends_spike_ratio, coalesce(g.gtrends_spike_flag, 0.0) AS gtrends_spike_flag, coalesce(i.insider_score, 0.0) AS insider_score
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM features) f LEFT JOIN live_side e USING (symbol) LEFT JOIN live_trend g USING (symbol)
        LEFT JOIN insider_score i USING (symbol) WHERE back = 1""",
    "features live_side live_trend insider_score",
    " ".join(f"{c}:{4 if c == 'macd_hist' else 6}" for c in tech.FEATURES),
)
def _(t: Tables) -> DataFrame:
    """The state of the history up to a day, advanced by two stretches of new days that alone are read."""
    store = SnapshotStore(t.spark, shared_folder(t.spark), ["symbol"])
    days = [None, *LIVE_CUTS, BARS_ASOF]
    for after, upto in zip(days, days[1:]):
        bars = t.bars(since=after).where(F.col("date") <= F.lit(upto).cast("date"))
        indices, vix = t.indices(since=after and LIVE_REACH), t.vix(since=after and LIVE_REACH)
        store.upsert(live.advance(store.read() if after else None, bars, t.dims(), indices, vix, None if after else t.series_tasks))
    return live.live_features(
        store.read(), readers.read_earnings(t.earnings()), tech.weekly_trends(t.interest()),
        insider.insider_signal(readers.read_insider_tx(t.insider_tx()), EVENTS_ASOF), BARS_ASOF,
    )


@query(
    "j13_snapshot_to_all_dates",
    "SELECT b.symbol, b.date, coalesce(i.insider_score, 0.0) AS insider_score FROM bars b LEFT JOIN insider_score i USING (symbol)",
    "bars insider_score",
    "insider_score",
)
def _(t: Tables) -> DataFrame:
    snap = insider.insider_signal(readers.read_insider_tx(t.insider_tx()), EVENTS_ASOF).select("symbol", "insider_score")
    return t.bars().select("symbol", "date").join(snap, "symbol", "left").na.fill({"insider_score": 0.0})


# -- options ------------------------------------------------------------------

cte(
    "options_signal",
    f"""SELECT symbol, snapshot_date, {pyround('pc', 3)} AS put_call_ratio, {pyround('sk', 4)} AS iv_skew, {pyround('act', 3)} AS unusual_call_vol, {pyround('score', 3)} AS options_composite FROM (
        SELECT *, {clip('(1.0-pc)/0.6::DOUBLE', -1, 1)}*0.4::DOUBLE + {clip('-sk/0.1::DOUBLE', -1, 1)}*0.4::DOUBLE + {clip('(act-1.0)/1.5::DOUBLE', -1, 1)}*0.2::DOUBLE AS score FROM (
        SELECT symbol, snapshot_date, CASE WHEN nc=0 OR np=0 THEN 1.0::DOUBLE ELSE coalesce(pv/nullif(cv,0), 1.0) END AS pc,
               CASE WHEN nc=0 OR np=0 THEN 0.0::DOUBLE ELSE coalesce(piv-civ, 0.0) END AS sk,
               CASE WHEN nc=0 OR np=0 THEN 1.0::DOUBLE ELSE least(coalesce(cv/nullif(coi,0), 1.0), 5.0::DOUBLE) END AS act FROM (
        SELECT symbol, snapshot_date, count(*) FILTER (open_interest > 10 AND side='C') AS nc, count(*) FILTER (open_interest > 10 AND side='P') AS np,
               coalesce(sum(volume) FILTER (open_interest > 10 AND side='C'), 0.0) AS cv, coalesce(sum(volume) FILTER (open_interest > 10 AND side='P'), 0.0) AS pv,
               sum(open_interest) FILTER (open_interest > 10 AND side='C') AS coi,
               median(nullif(iv,0)) FILTER (open_interest > 10 AND side='C') AS civ, median(nullif(iv,0)) FILTER (open_interest > 10 AND side='P') AS piv
        FROM near_options GROUP BY 1, 2)))""",
    "near_options",
)


@query("d07_options_signal", "SELECT * FROM options_signal", "options_signal", "put_call_ratio iv_skew unusual_call_vol options_composite")
def _(t: Tables) -> DataFrame:
    return options.options_signal(t.options())


@query(
    "t06_bullish_flow",
    "SELECT symbol, snapshot_date, options_composite FROM options_signal WHERE options_composite > 0.2",
    "options_signal",
    "options_composite",
)
def _(t: Tables) -> DataFrame:
    return options.bullish_flow(options.options_signal(t.options())).select("symbol", "snapshot_date", "options_composite")


@query(
    "a02_conditional_sums",
    "SELECT symbol, snapshot_date, coalesce(sum(volume) FILTER (side='C'), 0.0) AS call_vol, coalesce(sum(volume) FILTER (side='P'), 0.0) AS put_vol, sum(open_interest) FILTER (side='C') AS call_oi FROM options GROUP BY 1, 2",
    "options",
)
def _(t: Tables) -> DataFrame:
    def on(s, c):
        return F.sum(F.when(F.col("side") == s, F.coalesce(c, F.lit(0.0))))

    return t.options().groupBy("symbol", "snapshot_date").agg(
        F.coalesce(on("C", "volume"), F.lit(0.0)).alias("call_vol"), F.coalesce(on("P", "volume"), F.lit(0.0)).alias("put_vol"), on("C", "open_interest").alias("call_oi")
    )


@query(
    "a03_median_iv",
    "SELECT symbol, snapshot_date, side, median(nullif(iv, 0)) AS iv FROM options GROUP BY 1, 2, 3",
    "options",
    "iv",
)
def _(t: Tables) -> DataFrame:
    return options.median_iv(t.options())


@query(
    "a04_distinct_buyers",
    "SELECT symbol, count(DISTINCT insider) AS n_insiders, count(DISTINCT tx_date) AS n_days FROM insider_tx WHERE is_buy GROUP BY 1",
    "insider_tx",
)
def _(t: Tables) -> DataFrame:
    from barloom.functions.text import is_buy

    tx = readers.read_insider_tx(t.insider_tx()).where(is_buy(F.col("text")))
    return tx.groupBy("symbol").agg(F.count_distinct("insider").alias("n_insiders"), F.count_distinct("tx_date").alias("n_days"))


@query(
    "a05_buy_ratio",
    "SELECT symbol, count(*) FILTER (is_buy) AS n_buy, count(*) FILTER (is_sell) AS n_sell, CAST(count(*) FILTER (is_buy) AS DOUBLE)/nullif(count(*) FILTER (is_buy)+count(*) FILTER (is_sell), 0) AS buy_ratio FROM insider_tx GROUP BY 1",
    "insider_tx",
    "buy_ratio",
)
def _(t: Tables) -> DataFrame:
    from barloom.functions.numeric import ratio
    from barloom.functions.text import is_buy, is_sell

    tx = readers.read_insider_tx(t.insider_tx())
    g = tx.groupBy("symbol").agg(F.count_if(is_buy(F.col("text"))).alias("n_buy"), F.count_if(is_sell(F.col("text"))).alias("n_sell"))
    return g.withColumn("buy_ratio", ratio(F.col("n_buy").cast("double"), F.col("n_buy") + F.col("n_sell")))


# -- macro --------------------------------------------------------------------


def _ladder(src: str) -> str:
    return f"""SELECT *, CASE WHEN greatest(v,y,c) >= 2 THEN 'risk_off' WHEN least(v,1)+least(y,1)+least(c,1) >= 2 THEN 'neutral' ELSE 'risk_on' END AS regime,
      CASE WHEN greatest(v,y,c) >= 2 THEN 0.4 WHEN least(v,1)+least(y,1)+least(c,1) >= 2 THEN 0.7 ELSE 1.0 END::DOUBLE AS equity_mult FROM (
      SELECT *, CASE WHEN vix > 28 THEN 2 WHEN vix > 20 THEN 1 ELSE 0 END AS v, CASE WHEN yield_spread < -0.5::DOUBLE THEN 2 WHEN yield_spread < 0 THEN 1 ELSE 0 END AS y,
             CASE WHEN credit_spread < -0.04::DOUBLE THEN 2 WHEN credit_spread < -0.02::DOUBLE THEN 1 ELSE 0 END AS c FROM ({src}))"""


cte(
    "macro_long",
    """SELECT 'VIX' AS symbol, date, vix AS close FROM macro_day WHERE vix IS NOT NULL UNION ALL SELECT 'TNX', date, tnx FROM macro_day UNION ALL SELECT 'IRX', date, irx FROM macro_day
       UNION ALL SELECT 'HYG', date, hyg FROM macro_day WHERE hyg IS NOT NULL UNION ALL SELECT 'LQD', date, lqd FROM macro_day WHERE lqd IS NOT NULL""",
    "macro_day",
)
cte(
    "macro_filled",
    f"""SELECT date, coalesce(last_value(v IGNORE NULLS) OVER w, 20.0) AS vix, coalesce(last_value(t IGNORE NULLS) OVER w, 4.0)-coalesce(last_value(i IGNORE NULLS) OVER w, 4.5) AS yield_spread,
        coalesce(last_value(h IGNORE NULLS) OVER w - last_value(l IGNORE NULLS) OVER w, 0.0) AS credit_spread FROM (
        SELECT date, max(close) FILTER (symbol='VIX') AS v, max(close) FILTER (symbol='TNX') AS t, max(close) FILTER (symbol='IRX') AS i, max(r) FILTER (symbol='HYG') AS h, max(r) FILTER (symbol='LQD') AS l
        FROM (SELECT *, close/lag(close,20) OVER {SW} - 1 AS r FROM macro_long) GROUP BY 1) WINDOW w AS (ORDER BY date)""",
    "macro_long",
)
cte("macro_history", _ladder("SELECT * FROM macro_filled"), "macro_filled")


@query(
    "d08_macro_history",
    "SELECT date, vix, yield_spread, credit_spread, regime, equity_mult FROM macro_history",
    "macro_history",
    "vix yield_spread credit_spread",
)
def _(t: Tables) -> DataFrame:
    return macro.macro_history(t.macro()).drop("signals")


_MACRO_NOW = f"""SELECT coalesce(max(close) FILTER (symbol='VIX' AND back=1), 20.0) AS vix, coalesce(max(close) FILTER (symbol='TNX' AND back=1), 4.0) - coalesce(max(close) FILTER (symbol='IRX' AND back=1), 4.5) AS yield_spread,
  coalesce((max(close) FILTER (symbol='HYG' AND back=1)/max(close) FILTER (symbol='HYG' AND back=21) - 1) - (max(close) FILTER (symbol='LQD' AND back=1)/max(close) FILTER (symbol='LQD' AND back=21) - 1), 0.0) AS credit_spread
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM macro_long WHERE date <= DATE '{BARS_ASOF}' AND date > DATE '{BARS_ASOF}' - INTERVAL 3 MONTH)"""


@query(
    "d08_macro_regime",
    f"""SELECT {pyround('vix', 2)} AS vix, {pyround('yield_spread', 4)} AS yield_spread, {pyround('credit_spread', 4)} AS credit_spread, regime, equity_mult,
        'vix_' || ['ok','caution','risk_off'][v+1] || '(' || printf('%.1f', vix) || ')|yield_' || ['ok','caution','risk_off'][y+1] || '(' || printf('%.2f', yield_spread) || ')|credit_' || ['ok','caution','risk_off'][c+1] || '(' || printf('%.3f', credit_spread) || ')' AS signals
        FROM ({_ladder(_MACRO_NOW)})""",
    "macro_long",
    "vix yield_spread credit_spread",
)
def _(t: Tables) -> DataFrame:
    return macro.macro_regime(t.macro(), BARS_ASOF).withColumn("signals", F.array_join("signals", "|"))


@query("a01_last_value", "SELECT symbol, arg_max(close, date) AS close, max(date) AS date FROM macro_long GROUP BY 1", "macro_long")
def _(t: Tables) -> DataFrame:
    return t.macro().groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


@query(
    "w23_trailing_return",
    f"SELECT symbol, date, close/lag(close,20) OVER {SW} - 1 AS ret FROM macro_long WHERE symbol IN ('HYG','LQD')",
    "macro_long",
    "ret",
)
def _(t: Tables) -> DataFrame:
    from barloom.operators.pairs import trailing_relative_return

    return trailing_relative_return(t.macro().where("symbol in ('HYG','LQD')"))


# -- universe ---------------------------------------------------------------------

cte(
    "screen_stats",
    """SELECT symbol, count(*) AS n_rows, max(close) FILTER (back=1) AS last, avg(close) FILTER (back<=200) AS sma200, avg(close*volume) FILTER (back<=63) AS avg_dollar_volume,
       max(close) FILTER (back=21)/max(close) FILTER (back=252) - 1 AS momentum FROM (
       SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM screen_bars WHERE date > DATE '{start}' AND date <= DATE '{asof}') WHERE back <= 252 GROUP BY 1""".format(start="2000-09-04", asof=BARS_ASOF),
    "screen_bars",
)
cte("screen_bars", "SELECT * FROM baskets UNION ALL SELECT * FROM bars", "baskets", "bars")
cte("candidates", f"SELECT * FROM screen_stats WHERE n_rows >= 252 AND last >= sma200 AND avg_dollar_volume >= {TURNOVER}", "screen_stats")
cte(
    "screened",
    """SELECT rank, symbol, momentum FROM (SELECT *, row_number() OVER (ORDER BY momentum DESC, symbol) AS rank, count(*) OVER () AS n FROM candidates)
       WHERE rank <= greatest(20, least(80, CAST(floor(n*0.5) AS BIGINT)))""",
    "candidates",
)


@query(
    "a18_w14_screen_stats",
    "SELECT * FROM screen_stats",
    "screen_stats",
    "sma200:4 avg_dollar_volume:2 momentum",
)
def _(t: Tables) -> DataFrame:
    return universe.screen_stats(t.screen_bars(SCREEN_SINCE), BARS_ASOF)


@query(
    "d09_t01_screen_universe",
    "SELECT * FROM screened UNION ALL SELECT ordinal, symbol, NULL FROM watchlist WHERE (SELECT count(*) FROM candidates) = 0",
    "screened candidates watchlist",
    "momentum",
)
def _(t: Tables) -> DataFrame:
    return universe.screen_universe(t.screen_bars(SCREEN_SINCE), TURNOVER, fallback=watchlist(t.spark), asof=BARS_ASOF)


@query(
    "t05_risk_off_trim",
    f"SELECT rank, symbol FROM screened WHERE rank <= 10 OR (SELECT regime FROM ({_ladder(_MACRO_NOW)})) <> 'risk_off'",
    "screened macro_long",
)
def _(t: Tables) -> DataFrame:
    names = universe.screen_universe(t.screen_bars(SCREEN_SINCE), TURNOVER, asof=BARS_ASOF)
    return macro.trim_in_risk_off(names, macro.macro_regime(t.macro(), BARS_ASOF)).select("rank", "symbol")


@query(
    "u03_u04_merged_universe",
    """SELECT symbol, min(list*1000000000 + pos) // 1000000000 AS list, min(list*1000000000 + pos) % 1000000000 AS pos FROM (
       SELECT 0 AS list, CAST(s_suppkey AS BIGINT) AS pos, 'S' || s_suppkey AS symbol FROM supplier UNION ALL SELECT 1, p_partkey, 'S' || (p_partkey % 500) FROM part) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    from barloom.sources.dims import merged_universe

    a = t.raw("supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))
    b = t.raw("part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("S"), F.col("p_partkey") % 500).alias("symbol"))
    return merged_universe(a, b).select("symbol", F.col("list").cast("long").alias("list"), "pos")


# -- factors ------------------------------------------------------------------

cte(
    "price_factors",
    f"""SELECT symbol, n AS n_rows, coalesce((c1/cf-1)-(c1/c22-1), 0.0) AS mom_12_1, CASE WHEN n > 252 THEN sd*sqrt(252.0::DOUBLE) END AS ann_vol FROM (
        SELECT symbol, count(*) AS n, max(close) FILTER (back=1) AS c1, max(close) FILTER (back=22) AS c22, arg_max(close, back) AS cf, stddev_samp(ret) FILTER (back<=252) AS sd FROM (
        SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, close/lag(close) OVER {SW} - 1 AS ret FROM bars
        WHERE date > DATE '{BARS_ASOF}' - {YEAR_DAYS} AND date <= DATE '{BARS_ASOF}') WHERE back <= 253 GROUP BY 1)""",
    "bars",
)
_Q = [sigmoid("roe", 0.12, 0.15), sigmoid("profit_margin", 0.10, 0.12), sigmoid("revenue_growth", 0.05, 0.10)]
_QUAL = "coalesce(list_avg(list_filter([CASE WHEN roe IS NOT NULL THEN {0} END, CASE WHEN profit_margin IS NOT NULL THEN {1} END, CASE WHEN revenue_growth IS NOT NULL THEN {2} END], lambda x: x IS NOT NULL)), 50.0)".format(*_Q)
_VAL = "coalesce(list_avg(list_filter([CASE WHEN pe > 0 AND pe < 500 THEN {0} END, CASE WHEN pb > 0 THEN {1} END], lambda x: x IS NOT NULL)), 50.0)".format(
    sigmoid("(-pe)", -20, 15), sigmoid("(-pb)", -3, 3)
)
cte(
    "factors",
    f"""SELECT symbol, CASE WHEN short THEN 50 ELSE CAST({pyround('h', 0)} AS INTEGER) END AS health_score, CASE WHEN short THEN 50 ELSE CAST({pyround('m', 0)} AS INTEGER) END AS momentum_score,
        CASE WHEN short THEN 50 ELSE CAST({pyround('q', 0)} AS INTEGER) END AS quality_score, CASE WHEN short THEN 50 ELSE CAST({pyround('v', 0)} AS INTEGER) END AS value_score,
        CASE WHEN short THEN 50 ELSE CAST({pyround('lv', 0)} AS INTEGER) END AS vol_score,
        CASE WHEN short THEN '' WHEN mom_12_1 > 0.2::DOUBLE THEN 'strong 12-1m momentum (+' || printf('%.0f', mom_12_1*100) || '%)' WHEN q > 65 THEN 'high-quality fundamentals (ROE/margins)' WHEN v > 65 THEN 'attractive valuation' ELSE '' END AS key_strength,
        CASE WHEN short THEN 'insufficient price history' WHEN ann_vol > 0.45::DOUBLE THEN 'high volatility (' || printf('%.0f', ann_vol*100) || '% annualised)' WHEN pe > 45 THEN 'elevated P/E (' || printf('%.1f', pe) || 'x)'
             WHEN mom_12_1 < -0.1::DOUBLE THEN 'negative price momentum (' || printf('%.0f', mom_12_1*100) || '%)' ELSE '' END AS key_risk FROM (
        SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, m*0.3::DOUBLE + q*0.35::DOUBLE + v*0.2::DOUBLE + lv*0.15::DOUBLE)) AS h FROM (
        SELECT f.*, n_rows, mom_12_1, ann_vol, coalesce(n_rows < 60, true) AS short, {sigmoid('mom_12_1', 0.05, 0.25)} AS m, {sigmoid('(-ann_vol)', -0.3, 0.15)} AS lv, {_QUAL} AS q, {_VAL} AS v
        FROM fundamentals f LEFT JOIN price_factors p USING (symbol)))""",
    "fundamentals",
    "price_factors",
)


@query("w15_w20_price_factors", "SELECT * FROM price_factors", "price_factors", "mom_12_1 ann_vol")
def _(t: Tables) -> DataFrame:
    return factors.price_factors(t.bars(), BARS_ASOF, YEAR_DAYS)


def _factors(t: Tables) -> DataFrame:
    return factors.factor_score(factors.price_factors(t.bars(), BARS_ASOF, YEAR_DAYS), t.fundamentals())


@query("d10_factor_score", "SELECT * FROM factors", "factors")
def _(t: Tables) -> DataFrame:
    return _factors(t)


@query(
    "d11_fundamental_select",
    """SELECT symbol, CASE WHEN ok THEN health_score ELSE 50 END AS health_score, CASE WHEN ok THEN key_strength ELSE '' END AS key_strength, CASE WHEN ok THEN key_risk ELSE '' END AS key_risk,
       CASE WHEN ok THEN 'factors' ELSE 'fallback' END AS origin FROM (SELECT *, health_score <> 50 OR key_strength <> '' AS ok FROM factors)""",
    "factors",
)
def _(t: Tables) -> DataFrame:
    return factors.fundamental_select(_factors(t))


# -- news -----------------------------------------------------------------------

cte(
    "deduped",
    """SELECT symbol, CAST(rank AS INTEGER) AS rank, seq, headline, substr(coalesce(summary,''), 1, 200) AS summary, source FROM (
       SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS rank FROM (
       SELECT *, row_number() OVER (PARTITION BY symbol, headline ORDER BY seq) AS seen FROM (
       SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM news) WHERE n <= 15 AND coalesce(headline,'') <> '') WHERE seen = 1) WHERE rank <= 8""",
    "news",
)


@query("d15_u06_dedup_news", "SELECT * FROM deduped", "deduped")
def _(t: Tables) -> DataFrame:
    return news.dedup_news(t.news())


@query(
    "d16_a13_aggregate_sentiment",
    f"""SELECT symbol, {pyround('s', 3)} AS sentiment_score, {pyround('c', 3)} AS confidence, substr(theme, 1, 100) AS key_theme FROM (
        SELECT symbol, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sum(sgn*score*score)/sum(score))) AS s, avg(score) AS c, first(headline ORDER BY score DESC, seq) AS theme FROM (
        SELECT *, CASE label WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sgn, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM scored_news) WHERE n <= 8 GROUP BY 1)""",
    "scored_news",
    "sentiment_score confidence",
)
def _(t: Tables) -> DataFrame:
    return news.aggregate_sentiment(t.scored_news())


# -- events -----------------------------------------------------------------------

_BEAT_ASOF = "2000-06-15"
cte(
    "pead_trigger",
    f"""SELECT symbol, {pyround('surprise', 4)} AS surprise_pct, CAST(days AS INTEGER) AS days_since_earnings, 0.08::DOUBLE AS allocation,
        'EPS beat ' || printf('%.1f', surprise*100) || '% (' || days || 'd ago) — PEAD drift expected' AS reason FROM (
        SELECT *, DATE '{_BEAT_ASOF}' - report_date AS days, row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) AS n FROM earnings
        WHERE DATE '{_BEAT_ASOF}' - report_date BETWEEN 2 AND 30 AND estimate <> 0 AND surprise >= 0.15::DOUBLE) WHERE n = 1""",
    "earnings",
)
cte(
    "clusters",
    f"""SELECT symbol, n_insiders, round(total, 0) AS total_value, 0.05::DOUBLE AS allocation,
        n_insiders || ' insiders bought ($' || format('{{:,}}', CAST(round(total,0) AS BIGINT)) || ' total) — cluster signal' AS reason FROM (
        SELECT symbol, count(DISTINCT insider) AS n_insiders, CAST(coalesce(sum(CAST(value AS DECIMAL(20,4))),0) AS DOUBLE) AS total FROM insider_tx
        WHERE is_buy AND tx_date BETWEEN DATE '{EVENTS_ASOF}' - 45 AND DATE '{EVENTS_ASOF}' GROUP BY 1) WHERE n_insiders >= 2""",
    "insider_tx",
)
cte("top_pead", "SELECT * FROM pead_trigger ORDER BY surprise_pct DESC, symbol LIMIT 5", "pead_trigger")
cte(
    "event_signals",
    f"""SELECT symbol, events, reasons, CASE WHEN t > 0.35::DOUBLE THEN {pyround('scaled', 4)} ELSE a END AS total_allocation FROM (
        SELECT *, a*(0.35::DOUBLE/t) AS scaled FROM (SELECT *, CAST(sum(CAST(a AS DECIMAL(10,4))) OVER () AS DOUBLE) AS t FROM (
        SELECT symbol, string_agg(kind, '|' ORDER BY o) AS events, string_agg(reason, '|' ORDER BY o) AS reasons, CAST(sum(CAST(allocation AS DECIMAL(10,4))) AS DOUBLE) AS a FROM (
        SELECT symbol, 0 AS o, 'PEAD' AS kind, allocation, reason FROM top_pead UNION ALL SELECT symbol, 1, 'INSIDER_CLUSTER', allocation, reason FROM clusters) GROUP BY 1)))""",
    "top_pead",
    "clusters",
)


def _triggers(t: Tables) -> DataFrame:
    return events.pead_trigger(readers.read_earnings(t.earnings()), _BEAT_ASOF)


def _clusters(t: Tables) -> DataFrame:
    return events.insider_cluster(readers.read_insider_tx(t.insider_tx()), EVENTS_ASOF)


@query("d20_t10_pead_trigger", "SELECT * FROM pead_trigger", "pead_trigger", "surprise_pct")
def _(t: Tables) -> DataFrame:
    return _triggers(t)


@query("d21_insider_cluster", "SELECT * FROM clusters", "clusters")
def _(t: Tables) -> DataFrame:
    return _clusters(t)


@query("t02_best_beats", "SELECT * FROM top_pead", "top_pead", "surprise_pct")
def _(t: Tables) -> DataFrame:
    return events.best_beats(_triggers(t))


@query("d22_j09_event_signals", "SELECT * FROM event_signals", "event_signals", "total_allocation")
def _(t: Tables) -> DataFrame:
    out = events.event_signals(_triggers(t), _clusters(t))
    return out.withColumns({"events": F.array_join("events", "|"), "reasons": F.array_join("reasons", "|")})


@query(
    "d22_event_summary",
    """SELECT symbol, '    ' || symbol || ': ' || printf('%.1f', total_allocation*100) || '% — ' || replace(reasons, '|', ' | ') AS line FROM event_signals
       UNION ALL SELECT NULL, '  Event-driven signals (' || count(*) || ' stocks):' FROM event_signals""",
    "event_signals",
)
def _(t: Tables) -> DataFrame:
    return events.summarise_events(events.event_signals(_triggers(t), _clusters(t)))
