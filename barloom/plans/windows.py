"""Sources, filters, window functions and the feature panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import series as S
from barloom.functions.numeric import finite, ratio, to_double
from barloom.operators import technical as tech
from barloom.plans.cte import SW, cte, pyround, roll
from barloom.plans.registry import query
from barloom.sources import readers
from barloom.sources.tables import BARS_ASOF, Tables

SNAPSHOT_DAYS = 150  # calendar days that hold about 30 bars of a supplier

# -- sources ------------------------------------------------------------------


@query(
    "s01_read_bars",
    "SELECT symbol, date, close, volume FROM bars JOIN dims USING (symbol) WHERE date >= DATE '1999-01-01' AND sector IN ('ASIA','EUROPE')",
    "bars dims",
)
def _(t: Tables) -> DataFrame:
    return readers.read_bars(t.bars(since="1999-01-01"), t.dims().where("sector in ('ASIA','EUROPE')"))


@query(
    "s01_bars_from_wide",
    "SELECT sector AS symbol, date, close FROM sector_bars",
    "sector_bars",
)
def _(t: Tables) -> DataFrame:
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = t.sector_bars().groupBy("date").pivot("sector", names).agg(F.first("close"))
    return readers.bars_from_wide(wide)


@query(
    "s02_trailing_bars",
    f"SELECT symbol, date, close, volume FROM bars WHERE date > DATE '{BARS_ASOF}' - {SNAPSHOT_DAYS} AND date <= DATE '{BARS_ASOF}'",
    "bars",
)
def _(t: Tables) -> DataFrame:
    return readers.trailing_bars(t.bars(), BARS_ASOF, SNAPSHOT_DAYS)


@query("s03_read_earnings", "SELECT symbol, report_date, actual, estimate, surprise FROM earnings", "earnings", "surprise")
def _(t: Tables) -> DataFrame:
    return readers.read_earnings(t.earnings())


@query("s04_read_insider_tx", "SELECT symbol, tx_date, text, insider, value FROM insider_raw", "insider_raw")
def _(t: Tables) -> DataFrame:
    return readers.read_insider_tx(t.insider_tx())


@query(
    "s05_nearest_expiries",
    "SELECT symbol, snapshot_date, expiry, side, open_interest, volume, iv FROM near_options",
    "near_options",
    "iv",
)
def _(t: Tables) -> DataFrame:
    return readers.nearest_expiries(t.options()).drop("expiry_rank")


@query("s06_read_interest", "SELECT symbol, week, interest FROM interest", "interest")
def _(t: Tables) -> DataFrame:
    return t.interest()


@query(
    "s07_recent_news",
    "SELECT symbol, published, seq, headline, summary, source FROM news WHERE published BETWEEN DATE '2024-01-31' - 3 AND DATE '2024-01-31'",
    "news",
)
def _(t: Tables) -> DataFrame:
    return readers.recent_news(t.news(), "2024-01-31", 3)


@query(
    "s08_read_fundamentals",
    """SELECT symbol, CAST(NULL AS DOUBLE) AS pe_ratio, CAST(NULL AS DOUBLE) AS forward_pe, CAST(NULL AS DOUBLE) AS eps_ttm, revenue_growth, profit_margin,
       CAST(NULL AS DOUBLE) AS debt_to_equity, CAST(NULL AS DOUBLE) AS free_cash_flow, CAST(NULL AS DOUBLE) AS market_cap, 'Unknown' AS sector,
       CAST(NULL AS DOUBLE) AS "52w_high", CAST(NULL AS DOUBLE) AS "52w_low", CAST(NULL AS DOUBLE) AS current_price FROM fundamentals""",
    "fundamentals",
    "revenue_growth profit_margin",
)
def _(t: Tables) -> DataFrame:
    return readers.read_fundamentals(t.fundamentals())


@query(
    "s08_read_quotes",
    """SELECT 'S' || p_partkey AS symbol, CASE WHEN p_size % 7 <> 0 THEN p_retailprice/40.0::DOUBLE END AS pe_ratio, p_retailprice/44.0::DOUBLE AS forward_pe,
       CASE WHEN p_size % 9 <> 0 THEN CAST(p_partkey % 50 - 5 AS DOUBLE)/10.0::DOUBLE END AS eps_ttm, CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey % 41 - 10 AS DOUBLE)/100.0::DOUBLE END AS revenue_growth,
       CAST(p_size-15 AS DOUBLE)/150.0::DOUBLE AS profit_margin, CASE WHEN p_size % 13 <> 0 THEN CAST(p_size AS DOUBLE)/10.0::DOUBLE END AS debt_to_equity,
       p_retailprice*1000.0::DOUBLE - p_partkey*10.0::DOUBLE AS free_cash_flow, p_retailprice*1e6::DOUBLE AS market_cap, CASE WHEN p_size % 4 <> 0 THEN p_brand ELSE 'Unknown' END AS sector,
       p_retailprice*1.25::DOUBLE AS "52w_high", p_retailprice*0.75::DOUBLE AS "52w_low", CASE WHEN p_size % 17 <> 0 THEN p_retailprice END AS current_price FROM part""",
    "",
    "pe_ratio forward_pe eps_ttm revenue_growth profit_margin debt_to_equity free_cash_flow:4 market_cap:2",
)
def _(t: Tables) -> DataFrame:
    return readers.read_fundamentals(t.quotes())


@query("s11_list_log_dates", "SELECT DISTINCT run_date FROM agent_log ORDER BY run_date DESC", "agent_log")
def _(t: Tables) -> DataFrame:
    return readers.list_log_dates(t.agent_log())


@query("s15_symbol_dims", "SELECT symbol, sector, nation FROM dims", "dims")
def _(t: Tables) -> DataFrame:
    return t.dims()


# -- filters ------------------------------------------------------------------


@query(
    "p02_min_history",
    "SELECT symbol, count(*) AS n_rows FROM bars WHERE close IS NOT NULL GROUP BY symbol HAVING count(*) >= 530",
    "bars",
)
def _(t: Tables) -> DataFrame:
    return tech.with_history(t.series().where("close is not null"), 530).groupBy("symbol").agg(F.count("*").alias("n_rows"))


@query(
    "p05_common_dates",
    "SELECT date FROM baskets GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM baskets)",
    "baskets",
)
def _(t: Tables) -> DataFrame:
    from barloom.operators.pairs import complete_dates

    return complete_dates(t.baskets())


@query(
    "p06_liquid_contracts",
    "SELECT symbol, snapshot_date, side, count(*) AS n FROM near_options WHERE open_interest > 10 GROUP BY 1, 2, 3",
    "near_options",
)
def _(t: Tables) -> DataFrame:
    from barloom.operators.options import liquid

    return liquid(readers.nearest_expiries(t.options())).groupBy("symbol", "snapshot_date", "side").agg(F.count("*").alias("n"))


@query(
    "p08_buy_sell_text",
    """SELECT symbol, CAST(count(*) FILTER (is_buy) AS BIGINT) AS n_buy, CAST(count(*) FILTER (is_sell) AS BIGINT) AS n_sell, count(*) AS n
       FROM insider_tx GROUP BY symbol""",
    "insider_tx",
)
def _(t: Tables) -> DataFrame:
    from barloom.functions.text import is_buy, is_sell

    tx = readers.read_insider_tx(t.insider_tx())
    return tx.groupBy("symbol").agg(
        F.count_if(is_buy(F.col("text"))).alias("n_buy"), F.count_if(is_sell(F.col("text"))).alias("n_sell"), F.count("*").alias("n")
    )


@query(
    "p13_guarded_ratio",
    "SELECT symbol, snapshot_date, sum(CASE WHEN side='P' THEN volume END)/nullif(sum(CASE WHEN side='C' THEN volume END), 0) AS put_call FROM near_options GROUP BY 1, 2",
    "near_options",
    "put_call",
)
def _(t: Tables) -> DataFrame:
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")))
    return readers.nearest_expiries(t.options()).groupBy("symbol", "snapshot_date").agg(ratio(side("P"), side("C")).alias("put_call"))


@query(
    "p14_sanitise",
    """SELECT symbol, date, CASE WHEN abs(x) < 'Infinity'::DOUBLE THEN x END AS x FROM (
       SELECT symbol, date, CASE WHEN volume % 7 = 0 THEN 'NaN'::DOUBLE WHEN volume % 11 = 0 THEN 'Infinity'::DOUBLE ELSE close END AS x FROM bars)""",
    "bars",
)
def _(t: Tables) -> DataFrame:
    from barloom.sources.sinks import sanitise

    x = F.when(F.col("volume") % 7 == 0, float("nan")).when(F.col("volume") % 11 == 0, float("inf")).otherwise(F.col("close"))
    return sanitise(t.bars().select("symbol", "date", x.alias("x")))


@query(
    "f01_lenient_cast",
    """SELECT run_date, symbol, CASE WHEN abs(TRY_CAST(weight AS DOUBLE)) < 'Infinity'::DOUBLE THEN TRY_CAST(weight AS DOUBLE) END AS weight FROM weights_raw""",
    "weights_raw",
    "weight",
)
def _(t: Tables) -> DataFrame:
    return t.weights_raw().withColumn("weight", to_double("weight"))


@query(
    "f02_half_even_rounding",
    f"""SELECT l_orderkey, l_linenumber, {pyround('x', 3)} AS r3, {pyround('x', 2)} AS r2, {pyround('x', 1)} AS r1 FROM (
        SELECT l_orderkey, l_linenumber, l_discount * l_quantity / 8 AS x FROM lineitem)""",
)
def _(t: Tables) -> DataFrame:
    from barloom.functions.numeric import py_round

    x = F.col("l_discount") * F.col("l_quantity") / 8
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", *[(py_round(x, d) + 0.0).alias(f"r{d}") for d in (3, 2, 1)])


# -- window functions ------------------------------------------------------------


@query(
    "w01_pct_change",
    "SELECT symbol, date, " + ", ".join(f"close/lag(close,{n}) OVER {SW} - 1 AS ret_{n}" for n in (1, 5, 21, 63, 252)) + " FROM bars",
    "bars",
    "ret_1 ret_5 ret_21 ret_63 ret_252",
)
def _(t: Tables) -> DataFrame:
    return t.series().select("symbol", "date", *[S.pct_change("close", n).alias(f"ret_{n}") for n in (1, 5, 21, 63, 252)])


@query("w02_forward_return", f"SELECT symbol, date, lead(close,5) OVER {SW}/close - 1 AS fwd_ret FROM bars", "bars", "fwd_ret")
def _(t: Tables) -> DataFrame:
    return t.series().select("symbol", "date", S.forward_return("close", 5).alias("fwd_ret"))


@query(
    "w04_sma",
    "SELECT symbol, date, " + ", ".join(f"{roll('avg', 'close', n)} AS sma{n}" for n in (20, 50, 200)) + " FROM bars",
    "bars",
    "sma20:4 sma50:4 sma200:4",
)
def _(t: Tables) -> DataFrame:
    base = t.series().select("*", *S.running_sum("close"))
    return base.select("symbol", "date", *[S.prefix_mean(n).alias(f"sma{n}") for n in (20, 50, 200)])


@query(
    "w05_rolling_std",
    "SELECT symbol, date, " + ", ".join(f"{roll('stddev_samp', 'close', n)} AS std{n}" for n in (20, 60)) + " FROM bars",
    "bars",
    "std20:4 std60:4",
)
def _(t: Tables) -> DataFrame:
    return t.series().select("symbol", "date", *[S.rolling_std("close", n).alias(f"std{n}") for n in (20, 60)])


def _ewm_sql(src: str, x: str, alpha: str, out: str) -> str:
    """Exponential mean of non-leading-null column x over ``src`` (symbol, date, i from 0)."""
    b = f"(1.0::DOUBLE-{alpha})"
    first = f"count({x}) OVER (PARTITION BY symbol ORDER BY date)"
    return (
        f"sum({x}*w_{out}*pow({b},-i)) OVER (PARTITION BY symbol ORDER BY date)*pow({b},i) AS {out}",
        f"CASE WHEN {first} = 1 THEN 1.0::DOUBLE ELSE {alpha} END AS w_{out}",
    )


def _ewm_ctes() -> None:
    a12, a26, a9, a14 = "(2.0::DOUBLE/13)", "(2.0::DOUBLE/27)", "(0.2::DOUBLE)", "(1.0::DOUBLE/14)"
    cte("idx", f"SELECT *, row_number() OVER {SW} - 1 AS i, close - lag(close) OVER {SW} AS d FROM bars", "bars")
    cte("legs", "SELECT *, greatest(d, 0.0::DOUBLE) AS gain0, greatest(-d, 0.0::DOUBLE) AS loss0 FROM idx", "idx")
    cte("legs_n", "SELECT * REPLACE (CASE WHEN d IS NULL THEN NULL ELSE gain0 END AS gain0, CASE WHEN d IS NULL THEN NULL ELSE loss0 END AS loss0) FROM legs", "legs")
    specs = [("close", a12, "ema12"), ("close", a26, "ema26"), ("gain0", a14, "ag"), ("loss0", a14, "al")]
    parts = [_ewm_sql("legs_n", *s) for s in specs]
    cte("ewm_w", "SELECT *, " + ", ".join(p[1] for p in parts) + " FROM legs_n", "legs_n")
    cte("ewm", "SELECT *, " + ", ".join(p[0] for p in parts) + " FROM ewm_w", "ewm_w")
    cte("macd_w", "SELECT *, ema12-ema26 AS macd, CASE WHEN i=0 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS w_sig FROM ewm", "ewm")
    sig = _ewm_sql("macd_w", "macd", a9, "sig")[0]
    cte("macd", f"SELECT *, {sig} FROM macd_w", "macd_w")


_ewm_ctes()


@query("w06_ewm", "SELECT symbol, date, ema12, ema26, ag AS avg_gain, al AS avg_loss FROM ewm", "ewm", "ema12:4 ema26:4 avg_gain:4 avg_loss:4")
def _(t: Tables) -> DataFrame:
    legs = tech.with_rsi_inputs(t.series(), seed_zero=False)
    specs = {
        "ema12": ("close", S.span_alpha(12)),
        "ema26": ("close", S.span_alpha(26)),
        "avg_gain": ("_gain", tech.RSI_ALPHA),
        "avg_loss": ("_loss", tech.RSI_ALPHA),
    }
    return S.with_ewm(S.with_row_index(legs), specs).select("symbol", "date", *specs)


@query("w07_macd", "SELECT symbol, date, macd, macd - sig AS macd_hist FROM macd", "macd", "macd:4 macd_hist:4")
def _(t: Tables) -> DataFrame:
    e = S.with_ewm(S.with_row_index(t.series()), {"e12": ("close", S.span_alpha(12)), "e26": ("close", S.span_alpha(26))})
    m = S.with_ewm(e.withColumn("macd", F.col("e12") - F.col("e26")), {"sig": ("macd", S.span_alpha(9))})
    return m.select("symbol", "date", "macd", (F.col("macd") - F.col("sig")).alias("macd_hist"))


@query("w08_rsi_feature", "SELECT symbol, date, 100 - 100/(1 + ag/nullif(al, 0)) AS rsi FROM ewm", "ewm", "rsi:6")
def _(t: Tables) -> DataFrame:
    legs = S.with_row_index(tech.with_rsi_inputs(t.series(), seed_zero=False))
    means = S.with_ewm(legs, {"avg_gain": ("_gain", tech.RSI_ALPHA), "avg_loss": ("_loss", tech.RSI_ALPHA)})
    return means.select("symbol", "date", tech.rsi().alias("rsi"))


_RSI0 = """
SELECT symbol, date, i, sum(g*CASE WHEN i=0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE/14 END*pow(13.0::DOUBLE/14,-i)) OVER w * pow(13.0::DOUBLE/14,i) AS ag,
       sum(l*CASE WHEN i=0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE/14 END*pow(13.0::DOUBLE/14,-i)) OVER w * pow(13.0::DOUBLE/14,i) AS al
FROM (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0::DOUBLE END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0::DOUBLE END AS l FROM {src})
WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


@query(
    "w09_rsi_indicator",
    f"""SELECT symbol, date, CASE WHEN i >= 13 THEN CASE WHEN al = 0 AND ag > 0 THEN 100.0 ELSE 100 - 100/(1 + ag/nullif(al,0)) END END AS rsi_14
        FROM ({_RSI0.format(src='idx')})""",
    "idx",
    "rsi_14:6",
)
def _(t: Tables) -> DataFrame:
    legs = S.with_row_index(tech.with_rsi_inputs(t.series(), seed_zero=True))
    means = S.with_ewm(legs, {"avg_gain": ("_gain", tech.RSI_ALPHA), "avg_loss": ("_loss", tech.RSI_ALPHA)})
    return means.select("symbol", "date", F.when(F.col("_rn") >= 13, tech.rsi(zero_loss=100.0)).alias("rsi_14"))


cte(
    "price_windows",
    f"""SELECT symbol, date, close, volume, fwd_ret, (close-(sma20-2*std20))/(4*std20+1e-9) AS bb_pos, atr14/close AS atr_pct, volume/v20 AS volume_ratio,
        ret_5d, ret_21d, ret_63d, ret_252-ret_21d AS momentum_12_1, (close-sma20)/sma20 AS price_vs_sma20, (close-sma50)/sma50 AS price_vs_sma50,
        (close-sma200)/sma200 AS price_vs_sma200, n FROM (
        SELECT *, {roll('avg', 'close', 20)} AS sma20, {roll('avg', 'close', 50)} AS sma50, {roll('avg', 'close', 200)} AS sma200,
               {roll('stddev_samp', 'close', 20)} AS std20, {roll('avg', 'volume', 20)} AS v20, {roll('avg', 'abs(d)', 14)} AS atr14,
               close/lag(close,5) OVER {SW}-1 AS ret_5d, close/lag(close,21) OVER {SW}-1 AS ret_21d, close/lag(close,63) OVER {SW}-1 AS ret_63d,
               close/lag(close,252) OVER {SW}-1 AS ret_252, lead(close,5) OVER {SW}/close-1 AS fwd_ret, count(*) OVER (PARTITION BY symbol) AS n FROM idx)""",
    "idx",
)


@query(
    "w10_w16_price_windows",
    "SELECT symbol, date, bb_pos, momentum_12_1, price_vs_sma20, price_vs_sma50, price_vs_sma200 FROM price_windows",
    "price_windows",
    "bb_pos momentum_12_1 price_vs_sma20 price_vs_sma50 price_vs_sma200",
)
def _(t: Tables) -> DataFrame:
    legs = tech.with_rsi_inputs(t.series(), False, *S.running_sum("close"))
    cols = ["symbol", "date", "bb_pos", "momentum_12_1", "price_vs_sma20", "price_vs_sma50", "price_vs_sma200"]
    return tech.with_price_features(legs).select(*cols)


@query("w11_atr_pct", "SELECT symbol, date, atr_pct FROM price_windows", "price_windows", "atr_pct")
def _(t: Tables) -> DataFrame:
    d = t.series().withColumn("d", F.col("close") - F.lag("close").over(S.series()))
    return d.select("symbol", "date", ratio(S.sma(F.abs("d"), 14), "close").alias("atr_pct"))


@query("w12_volume_ratio", "SELECT symbol, date, volume_ratio FROM price_windows", "price_windows", "volume_ratio")
def _(t: Tables) -> DataFrame:
    return tech.with_volume_ratio(t.series()).select("symbol", "date", "volume_ratio")


_VOL = f"""SELECT symbol, date, lr, stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS hv10,
 stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS sd20 FROM (SELECT *, ln(close/lag(close) OVER {SW}) AS lr FROM bars)"""


@query(
    "w17_w18_log_return_vol",
    f"SELECT symbol, date, lr AS log_ret, hv10*sqrt(252)*100 AS hv_10_annualized, sd20*100 AS atr_20_pct FROM ({_VOL})",
    "bars",
    "log_ret hv_10_annualized:6 atr_20_pct:6",
)
def _(t: Tables) -> DataFrame:
    lr = t.series().withColumn("log_ret", S.log_return("close"))
    sd = lambda n: F.stddev_samp("log_ret").over(S.trailing(n))
    return lr.select("symbol", "date", "log_ret", (sd(10) * F.sqrt(F.lit(252.0)) * 100).alias("hv_10_annualized"), (sd(20) * 100).alias("atr_20_pct"))


@query(
    "w19_rolling_extremes",
    f"""SELECT symbol, date, (close-hi)/hi*100 AS dist_high, (close-lo)/lo*100 AS dist_low, close >= hi AS new_high, close <= lo AS new_low FROM (
        SELECT *, {roll('max', 'close', 20)} AS hi, {roll('min', 'close', 20)} AS lo FROM bars)""",
    "bars",
    "dist_high dist_low",
)
def _(t: Tables) -> DataFrame:
    x = t.series().select("*", S.rolling(F.max, "close", 20).alias("hi"), S.rolling(F.min, "close", 20).alias("lo"))
    c = F.col("close")
    return x.select(
        "symbol",
        "date",
        (ratio(c - F.col("hi"), "hi") * 100).alias("dist_high"),
        (ratio(c - F.col("lo"), "lo") * 100).alias("dist_low"),
        (c >= F.col("hi")).alias("new_high"),
        (c <= F.col("lo")).alias("new_low"),
    )


@query(
    "w21_weekly_spike",
    "SELECT symbol, week, gtrends_interest, gtrends_spike_ratio, gtrends_spike_flag FROM trends",
    "trends",
    "gtrends_spike_ratio",
)
def _(t: Tables) -> DataFrame:
    return tech.weekly_trends(t.interest())


cte(
    "cal",
    "SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM flows)",
    "flows",
)
cte(
    "idx_raw",
    "SELECT sector AS index, date, close FROM sector_bars UNION ALL SELECT 'MKT', date, close FROM market",
    "sector_bars",
    "market",
)
cte(
    "index_panel",
    """SELECT index, date, close/lag(close,5) OVER w - 1 AS idx_ret_5d, lead(close,5) OVER w/close - 1 AS idx_fwd_5d FROM (
       SELECT g.index, g.date, g.k, last_value(r.close IGNORE NULLS) OVER (PARTITION BY g.index ORDER BY g.k) AS close FROM (
         SELECT s.index, c.date, c.k FROM (SELECT index, min(date) AS lo FROM idx_raw GROUP BY 1) s JOIN cal c ON c.date >= s.lo) g
       LEFT JOIN idx_raw r ON r.index = g.index AND r.date = g.date)
       WINDOW w AS (PARTITION BY index ORDER BY k)""",
    "idx_raw",
    "cal",
)


@query("j02_index_panel", "SELECT index, date, idx_ret_5d, idx_fwd_5d FROM index_panel", "index_panel", "idx_ret_5d idx_fwd_5d")
def _(t: Tables) -> DataFrame:
    return tech.index_panel(t.indices())


@query(
    "j03_sector_default",
    "SELECT w.run_date, w.symbol, coalesce(s.sector, 'Other') AS sector FROM weights_raw w LEFT JOIN watchlist s USING (symbol)",
    "weights_raw watchlist",
)
def _(t: Tables) -> DataFrame:
    from barloom.operators.portfolio import with_sector
    from barloom.sources.dims import watchlist

    return with_sector(t.weights_raw(), watchlist(t.spark)).select("run_date", "symbol", "sector")


# -- feature panel ------------------------------------------------------------

cte(
    "features",
    """SELECT * FROM (SELECT p.symbol, p.date, 100 - 100/(1 + m.ag/nullif(m.al,0)) AS rsi, m.macd - m.sig AS macd_hist, bb_pos, atr_pct, volume_ratio,
       ret_5d, ret_21d, ret_63d, momentum_12_1, price_vs_sma20, price_vs_sma50, price_vs_sma200, s.idx_ret_5d AS sector_ret_5d,
       k.idx_ret_5d AS spy_ret_5d, v.close AS vix, p.fwd_ret, p.fwd_ret - k.idx_fwd_5d AS rel_fwd_ret,
       CASE WHEN p.fwd_ret - k.idx_fwd_5d > 0 THEN 1 ELSE 0 END AS label
       FROM price_windows p JOIN macd m ON p.symbol=m.symbol AND p.date=m.date JOIN dims d ON d.symbol=p.symbol
       LEFT JOIN index_panel s ON s.index=d.sector AND s.date=p.date LEFT JOIN index_panel k ON k.index='MKT' AND k.date=p.date
       LEFT JOIN vix v ON v.date=p.date WHERE p.n >= 210)
       WHERE rsi IS NOT NULL AND macd_hist IS NOT NULL AND bb_pos IS NOT NULL AND atr_pct IS NOT NULL AND volume_ratio IS NOT NULL AND ret_63d IS NOT NULL
         AND momentum_12_1 IS NOT NULL AND price_vs_sma200 IS NOT NULL AND sector_ret_5d IS NOT NULL AND spy_ret_5d IS NOT NULL AND vix IS NOT NULL""",
    "price_windows",
    "macd",
    "dims",
    "index_panel",
    "vix",
)
_BASE = " ".join(f"{c}:{4 if c == 'macd_hist' else 6}" for c in [*tech.BASE_FEATURES, "fwd_ret", "rel_fwd_ret"])


def base_panel(t: Tables) -> DataFrame:
    return tech.technical_features(t.bars(), t.dims(), t.indices(), t.vix(), t.series_tasks)


@query("d01_technical_features", f"SELECT symbol, date, {', '.join(tech.BASE_FEATURES)}, fwd_ret, rel_fwd_ret, label FROM features", "features", _BASE)
def _(t: Tables) -> DataFrame:
    return base_panel(t)


@query(
    "w03_relative_label",
    "SELECT symbol, date, fwd_ret, rel_fwd_ret, label FROM features",
    "features",
    "fwd_ret rel_fwd_ret",
)
def _(t: Tables) -> DataFrame:
    return base_panel(t).select("symbol", "date", "fwd_ret", "rel_fwd_ret", "label")


def pead_sql(probe: str) -> str:
    """Drift columns for CTE ``probe`` (symbol, date)."""
    return f"""SELECT f.symbol, f.date, CASE WHEN report_date IS NULL THEN 0.0 ELSE {pyround('surprise', 4)} END AS earnings_surprise_pct,
      CASE WHEN report_date IS NULL THEN 0.0 ELSE {pyround('sig', 4)} END AS pead_signal, CAST(CASE WHEN active THEN days ELSE -1 END AS INTEGER) AS days_since_beat FROM (
      SELECT *, CASE WHEN active THEN greatest(0.0::DOUBLE, 1.0-days/60.0::DOUBLE)*least(1.0::DOUBLE, surprise/0.15::DOUBLE) ELSE 0.0 END AS sig FROM (
      SELECT *, coalesce(surprise >= 0.05 AND days BETWEEN 0 AND 60, false) AS active FROM (
      SELECT p.symbol, p.date, e.report_date, e.surprise, p.date - e.report_date AS days FROM {probe} p
      ASOF LEFT JOIN earnings e ON p.symbol = e.symbol AND p.date >= e.report_date))) f"""


cte("pead", pead_sql("bars"), "bars", "earnings")


@query(
    "j04_d04_pead_features",
    "SELECT symbol, date, earnings_surprise_pct, pead_signal, days_since_beat FROM pead",
    "pead",
    "earnings_surprise_pct pead_signal",
)
def _(t: Tables) -> DataFrame:
    from barloom.operators.earnings import pead_columns

    out = pead_columns(t.bars().select("symbol", "date"), readers.read_earnings(t.earnings()), t.series_tasks)
    return out.select("symbol", "date", "earnings_surprise_pct", "pead_signal", "days_since_beat")


cte("earn_last", "SELECT symbol, max(report_date) AS lr, arg_max(surprise, report_date) AS ls FROM earnings GROUP BY 1", "earnings")


@query(
    "d04_live_pead",
    f"""SELECT symbol, report_date, {pyround('surprise', 4)} AS earnings_surprise_pct, {pyround('sig', 4)} AS pead_signal,
        CAST(CASE WHEN active THEN days ELSE -1 END AS INTEGER) AS days_since_beat FROM (
        SELECT *, CASE WHEN active THEN greatest(0.0::DOUBLE, 1.0-days/60.0::DOUBLE)*least(1.0::DOUBLE, surprise/0.15::DOUBLE) ELSE 0.0 END AS sig FROM (
        SELECT symbol, lr AS report_date, ls AS surprise, DATE '{BARS_ASOF}' - lr AS days, coalesce(ls >= 0.05 AND DATE '{BARS_ASOF}' - lr BETWEEN 0 AND 60, false) AS active FROM earn_last))""",
    "earn_last",
    "earnings_surprise_pct pead_signal",
)
def _(t: Tables) -> DataFrame:
    from barloom.operators.earnings import live_pead

    return live_pead(readers.read_earnings(t.earnings()), BARS_ASOF).drop("days_since_report")


def trends_sql(probe: str) -> str:
    return f"""SELECT p.symbol, p.date, coalesce(a.gtrends_interest, b.gtrends_interest, 1.0) AS gtrends_interest,
      coalesce(a.gtrends_spike_ratio, b.gtrends_spike_ratio, 1.0) AS gtrends_spike_ratio, coalesce(a.gtrends_spike_flag, b.gtrends_spike_flag, 0.0) AS gtrends_spike_flag
      FROM {probe} p ASOF LEFT JOIN (SELECT t.* FROM trends t JOIN (SELECT symbol, min(date) AS lo FROM {probe} GROUP BY 1) q ON t.symbol=q.symbol AND t.week >= q.lo) a
        ON a.symbol = p.symbol AND a.week <= p.date
      LEFT JOIN (SELECT t.symbol, arg_min(t.gtrends_interest, week) AS gtrends_interest, arg_min(t.gtrends_spike_ratio, week) AS gtrends_spike_ratio, arg_min(t.gtrends_spike_flag, week) AS gtrends_spike_flag
        FROM trends t JOIN (SELECT symbol, min(date) AS lo FROM {probe} GROUP BY 1) q ON t.symbol=q.symbol AND t.week >= q.lo GROUP BY 1) b ON b.symbol = p.symbol"""


cte("trend_daily", trends_sql("bars"), "bars", "trends")


@query(
    "j05_d05_trend_features",
    "SELECT symbol, date, gtrends_interest, gtrends_spike_ratio, gtrends_spike_flag FROM trend_daily",
    "trend_daily",
    "gtrends_spike_ratio",
)
def _(t: Tables) -> DataFrame:
    return tech.attach_trends(t.bars().select("symbol", "date"), tech.weekly_trends(S.dealt(t.interest(), t.series_tasks)), tasks=t.series_tasks)


@query(
    "d05_live_trends",
    f"SELECT symbol, {pyround('r', 3)} AS gtrends_spike_ratio, f AS gtrends_spike_flag FROM (SELECT symbol, arg_max(gtrends_spike_ratio, week) AS r, arg_max(gtrends_spike_flag, week) AS f FROM trends GROUP BY 1)",
    "trends",
    "gtrends_spike_ratio",
)
def _(t: Tables) -> DataFrame:
    from barloom.functions.numeric import py_round

    last = tech.latest_per_symbol(tech.weekly_trends(t.interest()), order="week")
    return last.select("symbol", py_round("gtrends_spike_ratio", 3).alias("gtrends_spike_ratio"), "gtrends_spike_flag")


_SNAP = f"""
SELECT symbol, date, {pyround('close', 2)} AS price, {pyround('rsi', 1)} AS rsi_14, {pyround('smad', 2)} AS sma20_dist_pct, {pyround('dh', 2)} AS dist_to_20d_high_pct,
 {pyround('dl', 2)} AS dist_to_20d_low_pct, {pyround('hv', 1)} AS hv_10_annualized, {pyround('atr', 2)} AS atr_20_pct, {pyround('thr', 2)} AS breakout_threshold, nh AS new_20d_high, nl AS new_20d_low
FROM (SELECT *, (close-sma)/sma*100 AS smad, (close-hi)/hi*100 AS dh, (close-lo)/lo*100 AS dl, sd10*sqrt(252.0::DOUBLE)*100 AS hv, sd20*100 AS atr,
  greatest(1.0::DOUBLE, sd20*100*0.5) AS thr, close >= hi AS nh, close <= lo AS nl, CASE WHEN al=0 AND ag>0 THEN 100.0 ELSE 100-100/(1+ag/nullif(al,0)) END AS rsi,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM (
  SELECT r.symbol, r.date, r.close, r.n, e.ag, e.al, avg(r.close) OVER w AS sma, max(r.close) OVER w AS hi, min(r.close) OVER w AS lo,
    stddev_samp(r.lr) OVER (PARTITION BY r.symbol ORDER BY r.date ROWS 9 PRECEDING) AS sd10, stddev_samp(r.lr) OVER w AS sd20
  FROM snap_rows r JOIN ({_RSI0.format(src='snap_rows')}) e ON e.symbol=r.symbol AND e.date=r.date
  WINDOW w AS (PARTITION BY r.symbol ORDER BY r.date ROWS 19 PRECEDING)))
WHERE back = 1 AND n >= 21"""
cte(
    "snap_rows",
    f"""SELECT symbol, date, close, row_number() OVER {SW} - 1 AS i, close - lag(close) OVER {SW} AS d, ln(close/lag(close) OVER {SW}) AS lr, count(*) OVER (PARTITION BY symbol) AS n
        FROM bars WHERE date > DATE '{BARS_ASOF}' - {SNAPSHOT_DAYS} AND date <= DATE '{BARS_ASOF}'""",
    "bars",
)
cte("snapshot", _SNAP, "snap_rows")
_SNAP_D = "price rsi_14 sma20_dist_pct dist_to_20d_high_pct dist_to_20d_low_pct hv_10_annualized atr_20_pct breakout_threshold"


def snapshot(t: Tables) -> DataFrame:
    return tech.technical_snapshot(t.bars(since="2001-06-01"), BARS_ASOF, SNAPSHOT_DAYS)


@query("d12_technical_snapshot", "SELECT * FROM snapshot", "snapshot", _SNAP_D)
def _(t: Tables) -> DataFrame:
    return snapshot(t)


@query(
    "d13_hybrid_gate",
    """SELECT symbol, rsi_14, CASE WHEN blocked THEN 'sideways' ELSE 'bullish' END AS direction, CASE WHEN blocked THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence,
       CASE WHEN blocked THEN 'HARD_INTERCEPT: RSI overbought, no valid breakout' ELSE 'SOFT_PASS' END AS gate FROM (
       SELECT *, coalesce(rsi_14, 50) > 70 AND abs(dist_to_20d_high_pct) > breakout_threshold AND NOT new_20d_high AS blocked FROM snapshot)""",
    "snapshot",
    "rsi_14",
)
def _(t: Tables) -> DataFrame:
    call = snapshot(t).withColumn("direction", F.lit("bullish")).withColumn("confidence", F.lit(0.8))
    return tech.hybrid_gate(call).select("symbol", "rsi_14", "direction", "confidence", "gate")


@query(
    "d14_direction_from_prob",
    "SELECT date, symbol, CASE WHEN proba >= 0.55 THEN 'bullish' WHEN proba <= 0.45 THEN 'bearish' ELSE 'sideways' END AS direction, abs(proba-0.5)*2 AS confidence FROM scored_panel",
    "scored_panel",
    "confidence",
)
def _(t: Tables) -> DataFrame:
    direction, confidence = tech.direction_from_prob(F.col("proba"))
    return t.scored_panel().select("date", "symbol", direction.alias("direction"), confidence.alias("confidence"))


@query("t07_latest_row", "SELECT symbol, max(date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY symbol", "bars")
def _(t: Tables) -> DataFrame:
    return tech.latest_per_symbol(t.bars())
