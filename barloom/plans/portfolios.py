"""Portfolio algebra, risk, pairs and risk parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import hrp, pairs, portfolio, risk
from barloom.operators import technical as tech
from barloom.plans.cte import cte, pyround
from barloom.plans.registry import query
from barloom.session import keep, shared_folder
from barloom.sources import readers, sinks
from barloom.sources.dims import styles, watchlist
from barloom.sources.tables import BARS_ASOF, Tables

VOL_DAYS = 120  # calendar days that hold about 25 bars of a supplier

# -- constraints ------------------------------------------------------------------

cte(
    "capped",
    f"""SELECT run_date, symbol, sector, {pyround('w', 4)} AS w FROM (
        SELECT r.run_date, r.symbol, d.sector, greatest(0.0::DOUBLE, least(0.15::DOUBLE, CASE WHEN NOT isnan(TRY_CAST(weight AS DOUBLE)) THEN TRY_CAST(weight AS DOUBLE) END)) AS w,
               TRY_CAST(weight AS DOUBLE) AS raw FROM weights_raw r JOIN watchlist d USING (symbol)) WHERE raw IS NOT NULL AND NOT isnan(raw) AND w > 0.005::DOUBLE""",
    "weights_raw",
    "watchlist",
)
cte(
    "sector_scaled",
    f"""SELECT run_date, symbol, sector, CASE WHEN t > 0.35::DOUBLE THEN {pyround('s', 4)} ELSE w END AS w FROM (
        SELECT *, w*(0.35::DOUBLE/t) AS s FROM (SELECT *, CAST(sum(CAST(w AS DECIMAL(20,4))) OVER (PARTITION BY run_date, sector) AS DOUBLE) AS t FROM capped))""",
    "capped",
)
cte(
    "total_scaled",
    f"""SELECT run_date, symbol, sector, CASE WHEN t > 1.0 THEN {pyround('s', 4)} ELSE w END AS w FROM (
        SELECT *, w*(1.0::DOUBLE/t) AS s FROM (SELECT *, CAST(sum(CAST(w AS DECIMAL(20,4))) OVER (PARTITION BY run_date) AS DOUBLE) AS t FROM sector_scaled))""",
    "sector_scaled",
)
cte(
    "constrained",
    f"""SELECT run_date, rank, symbol, sector, weight, {pyround('c', 4)} AS cash_reserve FROM (
        SELECT *, 1.0::DOUBLE - CAST(sum(CAST(weight AS DECIMAL(20,4))) OVER (PARTITION BY run_date) AS DOUBLE) AS c FROM (
        SELECT run_date, CAST(row_number() OVER (PARTITION BY run_date ORDER BY w DESC, symbol) AS INTEGER) AS rank, symbol, sector, w AS weight FROM total_scaled) WHERE rank <= 10)""",
    "total_scaled",
)


def constrained(t: Tables) -> DataFrame:
    return portfolio.apply_constraints(t.weights_raw(), watchlist(t.spark))


@query("d34_t03_apply_constraints", "SELECT * FROM constrained", "constrained", "weight cash_reserve")
def _(t: Tables) -> DataFrame:
    return constrained(t)


@query(
    "p10_p11_allowed_names",
    "SELECT run_date, symbol, TRY_CAST(weight AS DOUBLE) AS weight FROM weights_raw JOIN watchlist USING (symbol) WHERE TRY_CAST(weight AS DOUBLE) > 0.005 AND NOT isnan(TRY_CAST(weight AS DOUBLE))",
    "weights_raw watchlist",
    "weight",
)
def _(t: Tables) -> DataFrame:
    from barloom.functions.numeric import to_double

    allowed = t.weights_raw().join(watchlist(t.spark).select("symbol"), "symbol", "left_semi")
    return allowed.select("run_date", "symbol", to_double("weight").alias("weight")).where(F.col("weight") > portfolio.NEGLIGIBLE_WEIGHT)


@query(
    "a07_sector_sums",
    "SELECT run_date, sector, CAST(sum(CAST(weight AS DECIMAL(20,4))) AS DOUBLE) AS weight FROM constrained GROUP BY 1, 2",
    "constrained",
    "weight",
)
def _(t: Tables) -> DataFrame:
    return constrained(t).groupBy("run_date", "sector").agg(F.sum(F.col("weight").cast("decimal(20,4)")).cast("double").alias("weight"))


# overlays: daily pair and event deltas and a macro multiplier, from the event stream
cte("deltas", "SELECT CAST(ts AS DATE) AS run_date, 'P' || (user_id % 3) AS symbol, CAST(count(*) % 7 AS DOUBLE)*0.05::DOUBLE AS weight FROM events WHERE event_type='click' GROUP BY 1, 2")
cte("event_w", "SELECT CAST(ts AS DATE) AS run_date, CASE WHEN user_id % 2 = 0 THEN 'AAPL' ELSE 'E' || (user_id % 4) END AS symbol, CAST(count(*) % 5 AS DOUBLE)*0.04::DOUBLE AS weight FROM events WHERE event_type='signup' GROUP BY 1, 2")
cte("mult", "SELECT CAST(ts AS DATE) AS run_date, CASE WHEN count(*) % 3 = 0 THEN 0.4 WHEN count(*) % 3 = 1 THEN 0.7 ELSE 1.0 END::DOUBLE AS equity_mult FROM events GROUP BY 1")
cte("base_w", "SELECT run_date, symbol, weight FROM constrained WHERE day(run_date) % 5 <> 0", "constrained")
cte("hrp_w", "SELECT run_date, symbol, 1.0::DOUBLE/count(*) OVER (PARTITION BY run_date) AS weight FROM capped", "capped")
cte("start_w", "SELECT * FROM base_w UNION ALL SELECT h.* FROM hrp_w h WHERE run_date NOT IN (SELECT run_date FROM base_w)", "base_w", "hrp_w")


def _overlay_sql(src: str, add: str) -> str:
    return f"""SELECT run_date, symbol, CASE WHEN touched AND t > 1.0 THEN weight/t ELSE weight END AS weight FROM (
      SELECT run_date, symbol, weight, sum(weight) OVER (PARTITION BY run_date) AS t, bool_or(o) OVER (PARTITION BY run_date) AS touched FROM (
      SELECT run_date, symbol, sum(weight) AS weight, bool_or(o) AS o FROM (SELECT run_date, symbol, weight, false AS o FROM {src} UNION ALL SELECT run_date, symbol, weight, true FROM {add}) GROUP BY 1, 2))"""


cte("with_pairs", _overlay_sql("start_w", "deltas"), "start_w", "deltas")
cte("with_events", _overlay_sql("with_pairs", "event_w"), "with_pairs", "event_w")
cte(
    "merged",
    "SELECT run_date, symbol, CASE WHEN m < 1.0 THEN weight*m ELSE weight END AS weight FROM (SELECT w.*, coalesce(equity_mult, 1.0) AS m FROM with_events w LEFT JOIN mult USING (run_date))",
    "with_events",
    "mult",
)


def merged(t: Tables) -> DataFrame:
    ev = t.raw("events").withColumn("run_date", F.col("ts").cast("date"))
    u = F.col("user_id")

    def delta(kind: str, symbol, mod: int, unit: float) -> DataFrame:
        g = ev.where(F.col("event_type") == kind).groupBy("run_date", symbol.alias("symbol")).agg(F.count("*").alias("n"))
        return g.select("run_date", "symbol", ((F.col("n") % mod).cast("double") * unit).alias("weight"))

    n = F.count("*") % 3
    mult = ev.groupBy("run_date").agg(F.when(n == 0, 0.4).when(n == 1, 0.7).otherwise(1.0).alias("equity_mult"))
    held = constrained(t)
    names = F.count("*").over(Window.partitionBy("run_date"))
    usable = t.weights_raw().join(watchlist(t.spark), "symbol", "left_semi").withColumn("w", F.col("weight").try_cast("double"))
    equal = usable.where(~F.isnan("w") & (F.col("w") > 0.005)).select("run_date", "symbol", (F.lit(1.0) / names).alias("weight"))
    return portfolio.merge_weights(
        held.where(F.day("run_date") % 5 != 0),
        fallback=equal,
        pairs=delta("click", F.concat(F.lit("P"), u % 3), 7, 0.05),
        events=delta("signup", F.when(u % 2 == 0, "AAPL").otherwise(F.concat(F.lit("E"), u % 4)), 5, 0.04),
        multiplier=mult,
    )


@query("d35_j10_merge_weights", "SELECT * FROM merged", "merged", "weight")
def _(t: Tables) -> DataFrame:
    return merged(t)


@query(
    "t08_top_weights",
    "SELECT run_date, symbol, weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_date ORDER BY weight DESC, symbol) AS INTEGER) AS rank FROM (SELECT run_date, symbol, round(weight, 6) AS weight FROM merged)) WHERE rank <= 5",
    "merged",
    "weight:6",
)
def _(t: Tables) -> DataFrame:
    return portfolio.top_weights(merged(t).withColumn("weight", F.round("weight", 6)), 5)


# -- orders and snapshots -------------------------------------------------------------

cte("equity", "SELECT portfolio, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)*1.1::DOUBLE AS equity FROM holdings GROUP BY 1", "holdings")


@query(
    "d29_j11_rebalance_orders",
    f"""SELECT portfolio, side, symbol, {pyround('amount', 2)} AS notional, CAST(row_number() OVER (PARTITION BY portfolio ORDER BY side DESC, symbol) AS INTEGER) AS seq FROM (
        SELECT *, CASE WHEN target < value THEN (value-target)*0.995::DOUBLE WHEN target > value THEN target-value END AS amount, CASE WHEN target < value THEN 'SELL' ELSE 'BUY' END AS side FROM (
        SELECT portfolio, symbol, coalesce(weight, 0.0)*equity AS target, coalesce(value, 0.0) AS value, equity FROM targets FULL JOIN holdings USING (portfolio, symbol) JOIN equity USING (portfolio)))
        WHERE amount > equity*0.005::DOUBLE""",
    "targets holdings equity",
    "notional:2",
)
def _(t: Tables) -> DataFrame:
    held = t.holdings()
    equity = held.groupBy("portfolio").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") * 1.1).alias("equity"))
    return portfolio.rebalance_orders(t.targets(), held, equity)


@query(
    "d28_snapshot_positions",
    f"""SELECT symbol, close AS entry_price, {pyround('sh', 2)} AS shares, DATE '{BARS_ASOF}' AS entry_date FROM (
        SELECT symbol, close, 100000.0::DOUBLE*w/close AS sh FROM (SELECT symbol, arg_max(close, date) AS close, CAST(arg_max(volume, date) % 9 AS DOUBLE)/100 AS w FROM bars GROUP BY 1) WHERE w > 0)""",
    "bars",
    "shares",
)
def _(t: Tables) -> DataFrame:
    latest = tech.latest_per_symbol(t.bars())
    w = latest.select("symbol", ((F.col("volume") % 9) / 100).alias("weight"))
    return portfolio.snapshot_positions(w, latest, 100_000.0, BARS_ASOF)[0]


@query(
    "d40_a19_current_holdings",
    f"""SELECT symbol, {pyround('w', 4)} AS weight, greatest(0.0::DOUBLE, {pyround('c', 1)}) AS cash_pct FROM (
        SELECT symbol, entry_price*shares/5e6::DOUBLE AS w, (5e6::DOUBLE - sum(entry_price*shares) OVER ())/5e6::DOUBLE*100 AS c FROM positions)""",
    "positions",
    "weight cash_pct",
)
def _(t: Tables) -> DataFrame:
    account = t.spark.range(1).select(F.lit(5e6).alias("equity"))
    return portfolio.current_holdings(t.positions(), account)


@query(
    "s12_explode_state",
    "SELECT symbol, entry_price, shares, CAST(entry_date AS VARCHAR) AS entry_date FROM positions",
    "positions",
)
def _(t: Tables) -> DataFrame:
    body = F.struct("entry_price", "shares", F.col("entry_date").cast("string").alias("entry_date"))
    state = t.positions().groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.col("symbol"), body))).alias("positions"))
    full = state.select("positions", F.lit(None).cast("double").alias("equity"), F.lit(None).cast("double").alias("starting_equity"), F.lit(None).cast("string").alias("last_update"))
    return readers.explode_state(full)[0]


@query(
    "j12_mark_positions",
    "SELECT symbol, entry_price, shares, entry_date, coalesce(px, entry_price) AS current_price FROM positions LEFT JOIN (SELECT symbol, arg_max(close, date) AS px FROM bars WHERE date > DATE '2001-10-20' GROUP BY 1) USING (symbol)",
    "positions bars",
)
def _(t: Tables) -> DataFrame:
    latest = tech.latest_per_symbol(t.bars(since="2001-10-21"))
    return portfolio.mark_positions(t.positions(), latest)


# -- risk ---------------------------------------------------------------------------

cte(
    "vol10",
    f"""SELECT symbol, CASE WHEN n >= 11 THEN greatest(sd, 0.005::DOUBLE) ELSE 0.02::DOUBLE END AS sigma FROM (
        SELECT symbol, count(*) AS n, stddev_samp(lr) FILTER (back <= 10) AS sd FROM (
        SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr FROM bars
        WHERE date > DATE '{BARS_ASOF}' - {VOL_DAYS} AND date <= DATE '{BARS_ASOF}') WHERE back <= 11 GROUP BY 1)""",
    "bars",
)
cte(
    "chosen",
    "SELECT symbol, CASE WHEN lower(s) IN ('aggressive','balanced','conservative') THEN lower(s) ELSE 'balanced' END AS style FROM (SELECT 'S' || s_suppkey AS symbol, ['Aggressive','balanced','CONSERVATIVE','wild'][s_suppkey % 4 + 1] AS s FROM supplier)",
)
cte(
    "thresholds",
    f"""SELECT symbol, style, {pyround('a', 2)} AS sl_pct, {pyround('b', 2)} AS tp_pct FROM (
        SELECT symbol, style, sl_mult*coalesce(sigma, 0.02)*100 AS a, tp_mult*coalesce(sigma, 0.02)*100 AS b FROM chosen JOIN styles USING (style) LEFT JOIN vol10 USING (symbol))""",
    "chosen",
    "styles",
    "vol10",
)
cte(
    "risk_pos",
    "SELECT symbol, entry_price, current_price, shares, sl_pct, tp_pct, CASE WHEN entry_price <= 0 THEN 0.0 ELSE (current_price-entry_price)/entry_price*100 END AS pnl_pct FROM positions JOIN thresholds USING (symbol)",
    "positions",
    "thresholds",
)
_PNL, _SPNL, _SL, _TP = "printf('%.1f', pnl_pct)", "printf('%+.1f', pnl_pct)", "printf('%.1f', sl_pct)", "printf('%.1f', tp_pct)"
cte(
    "actions",
    f"""SELECT symbol, CASE WHEN pnl_pct <= -8 OR pnl_pct <= -sl_pct THEN 'FORCE_SELL_SL' WHEN pnl_pct >= tp_pct THEN 'FORCE_SELL_TP' ELSE 'HOLD' END AS action,
        CASE WHEN pnl_pct <= -8 THEN 'HARD LIMIT: Position down ' || {_PNL} || '% exceeds max loss 8.0%'
             WHEN pnl_pct <= -sl_pct THEN 'STOP-LOSS: PnL ' || {_SPNL} || '% breached dynamic SL threshold -' || {_SL} || '%'
             WHEN pnl_pct >= tp_pct THEN 'TAKE-PROFIT: PnL ' || {_SPNL} || '% exceeded TP threshold +' || {_TP} || '%'
             ELSE 'Within bounds: PnL ' || {_SPNL} || '% | SL=-' || {_SL} || '% | TP=+' || {_TP} || '%' END AS reason, pnl_pct,
        CASE WHEN pnl_pct <= -8 THEN 8.0 WHEN pnl_pct <= -sl_pct THEN sl_pct WHEN pnl_pct >= tp_pct THEN tp_pct ELSE 0.0 END AS threshold_pct
        FROM risk_pos WHERE current_price*shares >= 50""",
    "risk_pos",
)


def thresholds(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(s) for s in ("Aggressive", "balanced", "CONSERVATIVE", "wild")])
    chosen = t.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.get(words, (F.col("s_suppkey") % 4).cast("int")).alias("style"))
    return risk.risk_thresholds(chosen, risk.daily_vol(t.bars(since="2001-07-01"), BARS_ASOF, VOL_DAYS), styles(t.spark))


def actions(t: Tables, equity: float = 100_000.0) -> DataFrame:
    return risk.check_positions(t.positions().join(thresholds(t), "symbol"), equity, 100_000.0)


@query("d36_risk_thresholds", "SELECT * FROM thresholds", "thresholds", "sl_pct tp_pct")
def _(t: Tables) -> DataFrame:
    return thresholds(t)


@query(
    "d42_style_params",
    "SELECT symbol, style, position_scale, sl_mult, tp_mult FROM chosen JOIN styles USING (style)",
    "chosen styles",
)
def _(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(s) for s in ("Aggressive", "balanced", "CONSERVATIVE", "wild")])
    chosen = t.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.get(words, (F.col("s_suppkey") % 4).cast("int")).alias("style"))
    return risk.style_params(chosen, styles(t.spark)).select("symbol", "style", "position_scale", "sl_mult", "tp_mult")


@query("d37_check_positions", "SELECT * FROM actions", "actions", "pnl_pct threshold_pct")
def _(t: Tables) -> DataFrame:
    return actions(t)


@query(
    "d37_circuit_breaker",
    "SELECT symbol, 'FORCE_SELL_CIRCUIT' AS action, 'CIRCUIT BREAKER: Portfolio down -6.0% exceeds 5.0% daily limit. LIQUIDATING ALL.' AS reason, pnl_pct, 5.0::DOUBLE AS threshold_pct FROM risk_pos",
    "risk_pos",
    "pnl_pct",
)
def _(t: Tables) -> DataFrame:
    return actions(t, 94_000.0)


@query(
    "d38_j08_override_weights",
    "SELECT symbol, weight FROM (SELECT 'S' || s_suppkey AS symbol, CAST(s_suppkey % 7 AS DOUBLE)/100 AS weight FROM supplier) w WHERE weight > 0 AND symbol NOT IN (SELECT symbol FROM actions WHERE action LIKE 'FORCE_SELL%')",
    "actions",
    "weight",
)
def _(t: Tables) -> DataFrame:
    w = t.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), ((F.col("s_suppkey") % 7) / 100.0).alias("weight"))
    return risk.override_weights(w, actions(t))


@query(
    "d39_risk_summary",
    """SELECT CASE WHEN action LIKE 'FORCE_SELL%' THEN 1 ELSE 2 END AS part, symbol, CASE WHEN action LIKE 'FORCE_SELL%' THEN '    [' || action || '] ' || symbol || ': ' || reason
              ELSE '    ' || symbol || ': ' || reason END AS line FROM actions
       UNION ALL SELECT 1, NULL, '  [!] ' || count(*) || ' RISK OVERRIDE(S):' FROM actions WHERE action LIKE 'FORCE_SELL%' HAVING count(*) > 0
       UNION ALL SELECT 2, NULL, '  [OK] ' || count(*) || ' position(s) within risk bounds' FROM actions WHERE action = 'HOLD' HAVING count(*) > 0""",
    "actions",
)
def _(t: Tables) -> DataFrame:
    return risk.risk_summary(actions(t))


# -- several accounts ---------------------------------------------------------------

cte(
    "account_positions",
    "SELECT nation AS account, p.* FROM positions p JOIN dims USING (symbol)",
    "positions",
    "dims",
)
cte(
    "accounts",
    """SELECT nation AS account, equity, CASE WHEN length(nation) = 8 THEN equity/0.9::DOUBLE ELSE equity*0.97::DOUBLE END AS starting_equity FROM (
        SELECT nation, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) + 90000.0::DOUBLE AS equity FROM dims JOIN supplier ON symbol = 'S' || s_suppkey GROUP BY 1)""",
    "dims",
)
_DOWN = "(equity-starting_equity)/starting_equity*100"
cte(
    "account_risk",
    f"""SELECT a.account, r.*, CASE WHEN starting_equity > 0 THEN {_DOWN} END AS drawdown FROM risk_pos r JOIN dims USING (symbol) JOIN accounts a ON a.account = nation""",
    "risk_pos",
    "dims",
    "accounts",
)
cte(
    "account_actions",
    f"""SELECT account, symbol, CASE WHEN drawdown <= -5 THEN 'FORCE_SELL_CIRCUIT' WHEN pnl_pct <= -8 OR pnl_pct <= -sl_pct THEN 'FORCE_SELL_SL' WHEN pnl_pct >= tp_pct THEN 'FORCE_SELL_TP' ELSE 'HOLD' END AS action,
        CASE WHEN drawdown <= -5 THEN 'CIRCUIT BREAKER: Portfolio down ' || printf('%.1f', drawdown) || '% exceeds 5.0% daily limit. LIQUIDATING ALL.'
             WHEN pnl_pct <= -8 THEN 'HARD LIMIT: Position down ' || {_PNL} || '% exceeds max loss 8.0%'
             WHEN pnl_pct <= -sl_pct THEN 'STOP-LOSS: PnL ' || {_SPNL} || '% breached dynamic SL threshold -' || {_SL} || '%'
             WHEN pnl_pct >= tp_pct THEN 'TAKE-PROFIT: PnL ' || {_SPNL} || '% exceeded TP threshold +' || {_TP} || '%'
             ELSE 'Within bounds: PnL ' || {_SPNL} || '% | SL=-' || {_SL} || '% | TP=+' || {_TP} || '%' END AS reason, pnl_pct,
        CASE WHEN drawdown <= -5 THEN 5.0 WHEN pnl_pct <= -8 THEN 8.0 WHEN pnl_pct <= -sl_pct THEN sl_pct WHEN pnl_pct >= tp_pct THEN tp_pct ELSE 0.0 END AS threshold_pct
        FROM account_risk WHERE coalesce(drawdown <= -5, false) OR current_price*shares >= 50""",
    "account_risk",
)
cte(
    "account_weights",
    "SELECT nation AS account, symbol, CAST(s_suppkey % 9 AS DOUBLE)/100 AS weight FROM dims JOIN supplier ON symbol = 'S' || s_suppkey",
    "dims",
)


def account_positions(t: Tables) -> DataFrame:
    return t.positions().join(t.dims().select("symbol", F.col("nation").alias("account")), "symbol")


def accounts(t: Tables) -> DataFrame:
    """An account per nation: its suppliers' balances on top of a base; those with the shortest names are down by a tenth."""
    money = t.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.col("s_acctbal").cast("decimal(18,2)").alias("balance"))
    equity = t.dims().join(money, "symbol").groupBy(F.col("nation").alias("account")).agg((F.sum("balance").cast("double") + 90_000.0).alias("equity"))
    return equity.withColumn("starting_equity", F.when(F.length("account") == 8, F.col("equity") / 0.9).otherwise(F.col("equity") * 0.97))


def account_actions(t: Tables) -> DataFrame:
    return risk.check_accounts(account_positions(t).join(thresholds(t), "symbol"), accounts(t))


def account_weights(t: Tables) -> DataFrame:
    key = t.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), ((F.col("s_suppkey") % 9) / 100).alias("weight"))
    return key.join(t.dims().select("symbol", F.col("nation").alias("account")), "symbol")


@query("d37_check_accounts", "SELECT * FROM account_actions", "account_actions", "pnl_pct threshold_pct")
def _(t: Tables) -> DataFrame:
    return account_actions(t)


@query(
    "d38_override_account_weights",
    "SELECT account, symbol, weight FROM account_weights w WHERE weight > 0 AND NOT EXISTS (SELECT 1 FROM account_actions a WHERE a.account = w.account AND a.symbol = w.symbol AND action LIKE 'FORCE_SELL%')",
    "account_weights account_actions",
    "weight",
)
def _(t: Tables) -> DataFrame:
    return risk.override_weights(account_weights(t), account_actions(t), ["account"]).select("account", "symbol", "weight")


@query(
    "d28_snapshot_accounts",
    f"""SELECT account, symbol, close AS entry_price, {pyround('sh', 2)} AS shares, DATE '{BARS_ASOF}' AS entry_date, equity, coalesce(kept, equity) AS starting_equity FROM (
        SELECT account, symbol, close, equity*weight/close AS sh, equity, CASE WHEN account < 'NATION_2' THEN starting_equity END AS kept
        FROM account_weights JOIN (SELECT symbol, arg_max(close, date) AS close FROM bars GROUP BY 1) USING (symbol) JOIN accounts USING (account) WHERE weight > 0)""",
    "account_weights accounts bars",
    "shares equity:4 starting_equity:4",
)
def _(t: Tables) -> DataFrame:
    """Accounts below NATION_2 were there before and keep their starting equity."""
    money = accounts(t)
    rows, state = portfolio.snapshot_positions(account_weights(t), tech.latest_per_symbol(t.bars()), money, BARS_ASOF, money.where("account < 'NATION_2'"), ["account"])
    return rows.join(state.select("account", "equity", "starting_equity"), "account")


@query(
    "s13_portfolio_state",
    f"""SELECT symbol, close AS entry_price, {pyround('sh', 2)} AS shares, 100000.0::DOUBLE AS equity, 120000.0::DOUBLE AS starting_equity FROM (
        SELECT symbol, close, 100000.0::DOUBLE*w/close AS sh FROM (SELECT symbol, arg_max(close, date) AS close, CAST(arg_max(volume, date) % 9 AS DOUBLE)/100 AS w FROM bars GROUP BY 1) WHERE w > 0)""",
    "bars",
    "shares",
)
def _(t: Tables) -> DataFrame:
    """A day's snapshot written twice (the second replaces the first) and read again."""
    folder, latest = shared_folder(t.spark), tech.latest_per_symbol(t.bars())
    before = t.spark.range(1).select(F.lit(120_000.0).alias("starting_equity"))
    for scale in (50, 100):
        weights = latest.select("symbol", ((F.col("volume") % 9) / scale).alias("weight"))
        sinks.write_portfolio_state(*portfolio.snapshot_positions(weights, latest, 100_000.0, BARS_ASOF, before), folder, BARS_ASOF)
    rows, account = sinks.read_portfolio_snapshot(t.spark, folder, BARS_ASOF)
    return rows.select("symbol", "entry_price", "shares").crossJoin(F.broadcast(account.select("equity", "starting_equity")))  # one account


@query(
    "d40_account_holdings",
    f"""SELECT account, symbol, {pyround('w', 4)} AS weight, greatest(0.0::DOUBLE, {pyround('c', 1)}) AS cash_pct FROM (
        SELECT account, symbol, entry_price*shares/(equity*100) AS w, (equity*100 - sum(entry_price*shares) OVER (PARTITION BY account))/(equity*100)*100 AS c FROM account_positions JOIN accounts USING (account))""",
    "account_positions accounts",
    "weight cash_pct",
)
def _(t: Tables) -> DataFrame:
    return portfolio.current_holdings(account_positions(t), accounts(t).withColumn("equity", F.col("equity") * 100), ["account"])


# -- pairs -------------------------------------------------------------------------

cte(
    "pair_rows",
    "SELECT a.symbol AS symbol1, b.symbol AS symbol2, a.date, a.close AS c1, b.close AS c2 FROM baskets a JOIN baskets b ON a.date = b.date AND a.symbol < b.symbol",
    "baskets",
)


@query(
    "j06_a15_hedge_ratios",
    "SELECT symbol1, symbol2, count(*) AS n, covar_samp(c1, c2) AS cov, covar_samp(c1, c2)/(stddev_samp(c1)*stddev_samp(c2)) AS corr, regr_slope(c1, c2) AS slope FROM pair_rows GROUP BY 1, 2",
    "pair_rows",
    "cov:2 corr slope",
)
def _(t: Tables) -> DataFrame:
    bars = keep(t.baskets())
    return pairs.pair_moments(bars, "close", pairs.block_count(bars, 4))


cte("bcal", "SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM baskets)", "baskets")
cte(
    "held",
    """SELECT g.symbol, g.date, g.k, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.k) AS close FROM (
       SELECT s.symbol, c.date, c.k FROM (SELECT symbol, min(date) AS lo FROM baskets GROUP BY 1) s JOIN bcal c ON c.date >= s.lo) g LEFT JOIN baskets b ON b.symbol=g.symbol AND b.date=g.date""",
    "baskets",
    "bcal",
)
cte("brets", "SELECT symbol, date, ret FROM (SELECT symbol, date, close/lag(close) OVER (PARTITION BY symbol ORDER BY k) - 1 AS ret FROM held) WHERE ret IS NOT NULL", "held")
cte("crets", "SELECT * FROM brets WHERE date IN (SELECT date FROM brets GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM brets))", "brets")


@query("p05_aligned_returns", "SELECT * FROM crets", "crets", "ret")
def _(t: Tables) -> DataFrame:
    return pairs.aligned_returns(keep(t.baskets()))


@query(
    "a06_covariance_matrix",
    """SELECT a.symbol AS symbol1, b.symbol AS symbol2, count(*) AS n, covar_samp(a.ret, b.ret) AS cov, covar_samp(a.ret, b.ret)/(stddev_samp(a.ret)*stddev_samp(b.ret)) AS corr
       FROM crets a JOIN crets b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2""",
    "crets",
    "cov corr",
)
def _(t: Tables) -> DataFrame:
    bars = keep(t.baskets())
    return pairs.pair_moments(pairs.aligned_returns(bars), "ret", pairs.block_count(bars, 4)).drop("slope")


@query("d17_t04_cointegrated_pairs")
def _(t: Tables) -> DataFrame:
    bars = keep(t.baskets())
    return pairs.cointegrated_pairs(bars, pairs.block_count(bars, 4))


cte("fixed_pairs", "SELECT symbol1, symbol2, round(regr_slope(c1, c2), 4) AS hedge_ratio, 0.01::DOUBLE AS pvalue FROM pair_rows GROUP BY 1, 2", "pair_rows")
cte(
    "spreads",
    """SELECT p.symbol1, p.symbol2, p.pvalue, r.date, r.c1 - p.hedge_ratio*r.c2 AS spread FROM fixed_pairs p JOIN pair_rows r USING (symbol1, symbol2) WHERE r.date > DATE '2001-05-04'""",
    "fixed_pairs",
    "pair_rows",
)
def _signals_sql(src: str) -> str:
    return f"""SELECT symbol1, symbol2, {pyround('z', 3)} AS zscore, CASE WHEN z > 2 THEN 'enter_short_spread' WHEN z < -2 THEN 'enter_long_spread' WHEN abs(z) < 0.5 THEN 'exit' ELSE 'hold' END AS signal,
        CASE WHEN z > 2 THEN symbol2 WHEN z < -2 THEN symbol1 END AS long_symbol, CASE WHEN z > 2 THEN symbol1 WHEN z < -2 THEN symbol2 END AS short_symbol, pvalue FROM (
        SELECT *, (spread - avg(spread) OVER w)/stddev_samp(spread) OVER w AS z, count(*) OVER (PARTITION BY symbol1, symbol2) AS n,
               row_number() OVER (PARTITION BY symbol1, symbol2 ORDER BY date DESC) AS back FROM {src} WINDOW w AS (PARTITION BY symbol1, symbol2 ORDER BY date ROWS 59 PRECEDING))
        WHERE back = 1 AND n >= 60"""


cte("pair_signals", _signals_sql("spreads"), "spreads")

def fixed_pairs(t: Tables) -> DataFrame:
    bars = keep(t.baskets())
    m = pairs.pair_moments(bars, "close", pairs.block_count(bars, 4))
    return m.select("symbol1", "symbol2", F.round("slope", 4).alias("hedge_ratio"), F.lit(0.01).alias("pvalue"))


def recent_baskets(t: Tables) -> DataFrame:
    return t.baskets().where(F.col("date") > F.lit("2001-05-04").cast("date"))


@query("j07_w22_pair_spreads", "SELECT symbol1, symbol2, date, spread FROM spreads", "spreads")
def _(t: Tables) -> DataFrame:
    return pairs.pair_spreads(fixed_pairs(t), recent_baskets(t)).select("symbol1", "symbol2", "date", "spread")


@query("d18_pair_signals", "SELECT * FROM pair_signals", "pair_signals", "zscore")
def _(t: Tables) -> DataFrame:
    return pairs.pair_signals(fixed_pairs(t), recent_baskets(t))


@query(
    "d19_pair_weight_deltas",
    "SELECT long_symbol AS symbol, count(*)*0.05::DOUBLE AS weight FROM pair_signals WHERE signal = 'enter_long_spread' GROUP BY 1",
    "pair_signals",
    "weight",
)
def _(t: Tables) -> DataFrame:
    return pairs.pair_weight_deltas(pairs.pair_signals(fixed_pairs(t), recent_baskets(t)))


@query("d23_hrp_weights")
def _(t: Tables) -> DataFrame:
    bars = keep(t.baskets())
    month_ends = bars.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("run_date"))
    return hrp.hrp_weights(hrp.lookback_windows(bars, month_ends))


@query(
    "d23_lookback_windows",
    """SELECT r.run_date, b.symbol, b.date, b.close FROM (SELECT max(date) AS run_date FROM baskets GROUP BY date_trunc('month', date)) r
       JOIN bcal k ON k.date = r.run_date JOIN bcal c ON c.k BETWEEN k.k - 251 AND k.k JOIN baskets b ON b.date = c.date""",
    "baskets bcal",
)
def _(t: Tables) -> DataFrame:
    bars = keep(t.baskets())
    month_ends = bars.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("run_date"))
    return hrp.lookback_windows(bars, month_ends)
