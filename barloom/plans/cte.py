"""SQL twins of the derived inputs, as named CTEs for the DuckDB comparison."""

from __future__ import annotations

from barloom.sources.dims import SECTORS, STYLES, WATCHLIST

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql.strip(), deps)


def with_ctes(body: str, names: str) -> str:
    """Prefix ``body`` with the named CTEs and everything they need, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names.split():
        visit(n)
    if not order:
        return body
    defs = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order)
    return f"WITH {defs}\n{body.strip()}"


def pyround(x: str, digits: int) -> str:
    """Half-even rounding on the exact binary value of column ``x``."""
    p = f"{10.0**digits:.1f}::DOUBLE"
    y = f"({x}*{p})"
    hi = f"(({x}*134217729.0::DOUBLE) - (({x}*134217729.0::DOUBLE) - {x}))"
    err = f"(({hi}*{p} - {y}) + ({x}-{hi})*{p})"
    fr = f"({y} - floor({y}))"
    return (
        f"(CASE WHEN abs({x}) >= {2.0**53 / 10**digits!r} THEN {x} ELSE (floor({y}) + CASE WHEN {fr} > 0.5 OR ({fr} = 0.5 AND ({err} > 0 OR ({err} = 0 AND (floor({y})::BIGINT % 2) <> 0)))"
        f" THEN 1.0 ELSE 0.0 END) / {p} + 0.0 END)"
    )


def clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE greatest({low}::DOUBLE, least({x}, {high}::DOUBLE)) END)"


def sigmoid(x: str, center: float, scale: float) -> str:
    return f"coalesce(100.0 / (1.0 + exp(-(({x} - ({center}::DOUBLE)) / {scale}::DOUBLE))), 50.0)"


def str_list(names) -> str:
    return "[" + ",".join(f"'{n}'" for n in names) + "]"


SW = "(PARTITION BY symbol ORDER BY date)"


def roll(agg: str, x: str, n: int, min_periods: int | None = None, order: str = "date") -> str:
    """Gated trailing aggregate."""
    w = f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= {min_periods or n} THEN {agg}({x}) OVER {w} END"


# -- prices -----------------------------------------------------------------
cte(
    "flows",
    """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date,
       sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2""",
)
cte("bars", "SELECT 'S' || l_suppkey AS symbol, date, CAST(amount AS DOUBLE)/qty AS close, qty AS volume FROM flows", "flows")
cte(
    "places",
    """SELECT s_suppkey, r_name AS sector, n_name AS nation FROM supplier
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte("dims", "SELECT 'S' || s_suppkey AS symbol, sector, nation FROM places", "places")
cte("market", "SELECT date, CAST(sum(amount) AS DOUBLE)/sum(qty) AS close, sum(qty) AS volume FROM flows GROUP BY date", "flows")
cte(
    "sector_bars",
    """SELECT sector, date, CAST(sum(amount) AS DOUBLE)/sum(qty) AS close, sum(qty) AS volume
       FROM flows JOIN places ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "flows",
    "places",
)
cte(
    "baskets",
    """SELECT sector || '-' || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)/sum(l_quantity) AS close, sum(l_quantity) AS volume
       FROM lineitem JOIN places ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "places",
)
cte(
    "vix",
    """SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_discount AS DECIMAL(9,4))) AS DOUBLE)/count(*)*400 AS close
       FROM lineitem WHERE l_linestatus='O' AND l_returnflag='R' GROUP BY 1""",
)
cte(
    "macro_day",
    """SELECT CAST(l_shipdate AS DATE) AS date,
       CAST(sum(CAST(l_discount AS DECIMAL(9,4))) FILTER (l_linestatus='O' AND l_returnflag='R') AS DOUBLE)
         / nullif(count(*) FILTER (l_linestatus='O' AND l_returnflag='R'), 0) * 400 AS vix,
       CAST(sum(CAST(l_tax AS DECIMAL(9,4))) AS DOUBLE)/count(*)*100 AS tnx,
       CAST(sum(CAST(l_discount AS DECIMAL(9,4))) AS DOUBLE)/count(*)*80 AS irx,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag='A') AS DOUBLE)/sum(l_quantity) FILTER (l_returnflag='A') AS hyg,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag='N') AS DOUBLE)/sum(l_quantity) FILTER (l_returnflag='N') AS lqd
       FROM lineitem GROUP BY 1""",
)
cte(
    "earnings",
    """SELECT *, CASE WHEN estimate <> 0 THEN (actual-estimate)/abs(estimate) END AS surprise FROM (
       SELECT 'S' || l_suppkey AS symbol, report_date, actual, lag(actual) OVER (PARTITION BY l_suppkey ORDER BY month) AS estimate FROM (
         SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, CAST(max(l_shipdate) AS DATE) AS report_date,
                CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS actual FROM lineitem GROUP BY 1, 2))
       WHERE estimate IS NOT NULL""",
)
cte(
    "insider_raw",
    """SELECT 'S' || user_id AS symbol, CAST(ts AS DATE) - CAST(event_id % 120 AS INTEGER) AS tx_date,
       CASE event_type WHEN 'purchase' THEN 'Purchase' WHEN 'signup' THEN 'Stock Acquisition' WHEN 'view' THEN 'Sale' WHEN 'click' THEN 'Disposal' END AS text,
       'I' || (event_id % 40) AS insider,
       CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE CAST(CAST(value AS DECIMAL(18,2))*100 AS VARCHAR) END AS value FROM events""",
)
cte(
    "insider_tx",
    """SELECT symbol, tx_date, insider, coalesce(regexp_matches(lower(text), 'purchase|buy|acquisition'), false) AS is_buy,
       coalesce(regexp_matches(lower(text), 'sale|sell|disposal'), false) AS is_sell, abs(TRY_CAST(value AS DOUBLE)) AS value FROM insider_raw""",
    "insider_raw",
)
cte(
    "options",
    """SELECT 'S' || l_suppkey AS symbol, CAST(date_trunc('year', l_shipdate) AS DATE) AS snapshot_date,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS expiry, CASE WHEN l_linestatus='O' THEN 'C' ELSE 'P' END AS side,
       l_quantity AS open_interest, CASE WHEN l_linenumber <> 5 THEN CAST(l_linenumber*3 AS DOUBLE) END AS volume,
       CAST(CAST(l_discount AS DECIMAL(9,4))*5 AS DOUBLE) AS iv FROM lineitem""",
)
cte(
    "near_options",
    """SELECT * EXCLUDE (er) FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol, snapshot_date ORDER BY expiry) AS er FROM options) WHERE er <= 2""",
    "options",
)
cte(
    "interest",
    """SELECT 'S' || l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(count(*) AS DOUBLE) AS interest
       FROM lineitem GROUP BY 1, 2""",
)
cte(
    "trends",
    f"""SELECT symbol, week, interest AS gtrends_interest, ratio AS gtrends_spike_ratio,
        CASE WHEN ratio > 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gtrends_spike_flag FROM (
        SELECT *, coalesce(interest / nullif(m, 0), 1.0) AS ratio FROM (
        SELECT *, {roll('avg', 'interest', 13, 4, 'week')} AS m FROM interest))""",
    "interest",
)
cte(
    "news",
    """SELECT lang || '-' || source AS symbol, DATE '2024-01-31' - CAST(doc_id % 30 AS INTEGER) AS published, doc_id AS seq,
       split_part(text, chr(10), 1) AS headline, text AS summary, source FROM documents""",
)
cte(
    "scored_news",
    """SELECT lang || '-' || source AS symbol, d.doc_id AS seq, split_part(text, chr(10), 1) AS headline,
       CASE WHEN quality=1 AND toxic=0 THEN 'positive' WHEN quality=0 AND toxic=1 THEN 'negative' ELSE 'neutral' END AS label,
       0.5::DOUBLE + CAST(n_chars % 50 AS DOUBLE)/100.0::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
cte(
    "fundamentals",
    """SELECT 'S' || p_partkey AS symbol, CASE WHEN p_size % 11 <> 0 THEN CAST(p_size-10 AS DOUBLE)/100.0::DOUBLE END AS roe,
       CAST(p_size-15 AS DOUBLE)/150.0::DOUBLE AS profit_margin,
       CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey % 41 - 10 AS DOUBLE)/100.0::DOUBLE END AS revenue_growth,
       CASE WHEN p_size % 7 <> 0 THEN p_retailprice/40.0::DOUBLE END AS pe, CAST(p_size AS DOUBLE)/5.0::DOUBLE AS pb FROM part""",
)
cte(
    "scored_panel",
    f"""SELECT date, symbol, proba, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS pred, CASE WHEN fwd_ret > 0 THEN 1 ELSE 0 END AS label, fwd_ret FROM (
        SELECT date, symbol, (volume % 97)/97.0::DOUBLE AS proba, lead(close, 5) OVER {SW} / close - 1 AS fwd_ret FROM bars)""",
    "bars",
)
cte(
    "weights_raw",
    f"""SELECT run_date, symbol, CASE WHEN n % 17 = 0 THEN 'nan' WHEN n % 19 = 0 THEN 'abc'
        ELSE CAST(CAST(CAST(v AS DOUBLE)*3/CAST(sum(v) OVER (PARTITION BY run_date) AS DOUBLE) AS DECIMAL(10,6)) AS VARCHAR) END AS weight FROM (
        SELECT CAST(ts AS DATE) AS run_date, CASE WHEN user_id % 20 < 15 THEN {str_list(WATCHLIST)}[user_id % 20 + 1] ELSE 'UNK' || (user_id % 20) END AS symbol,
               sum(CAST(value AS DECIMAL(18,2))) AS v, count(*) AS n FROM events GROUP BY 1, 2)""",
)
cte(
    "watchlist",
    "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{s}', '{SECTORS[s]}')" for i, s in enumerate(WATCHLIST)) + ") AS v(ordinal, symbol, sector)",
)
cte(
    "styles",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for s, (a, b, c) in STYLES.items())
    + ") AS v(style, position_scale, sl_mult, tp_mult)",
)
cte(
    "positions",
    """SELECT symbol, arg_min(close, date) AS entry_price, arg_max(close, date) AS current_price, arg_max(volume, date) AS shares,
       min(date) AS entry_date FROM bars GROUP BY 1""",
    "bars",
)
cte(
    "holdings",
    """SELECT c_mktsegment AS portfolio, 'N' || c_nationkey AS symbol, CAST(sum(abs(CAST(c_acctbal AS DECIMAL(18,2)))) AS DOUBLE) AS value
       FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2""",
)
cte(
    "targets",
    """SELECT portfolio, symbol, CAST(v AS DOUBLE)/CAST(sum(v) OVER (PARTITION BY portfolio) AS DOUBLE) AS weight FROM (
       SELECT c_mktsegment AS portfolio, 'N' || c_nationkey AS symbol, sum(abs(CAST(c_acctbal AS DECIMAL(18,2)))) AS v
       FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1, 2)""",
)
cte(
    "agent_log",
    f"""SELECT 'D' || user_id AS desk, CAST(date_trunc('week', ts) AS DATE) AS run_date, event_id AS seq,
        CASE WHEN event_type='view' THEN 'News-Sentiment' WHEN event_type='click' THEN 'Technical-Forecaster' WHEN event_type='purchase' THEN 'Fundamentals'
             WHEN event_type='signup' AND event_id % 3 = 0 THEN 'Risk-Style' WHEN event_type='signup' AND event_id % 3 = 1 THEN 'Portfolio-Decision'
             WHEN event_type='signup' THEN 'Risk-Management' ELSE 'Pipeline-Error' END AS agent,
        CASE WHEN event_type IN ('view','click','purchase','error') THEN {str_list(WATCHLIST)}[event_id % 15 + 1] END AS ticker,
        CASE WHEN event_type='view' THEN CAST(event_id % 201 - 100 AS DOUBLE)/100.0::DOUBLE END AS sentiment_score,
        CASE WHEN event_type='click' THEN ['up','down','sideways'][event_id % 3 + 1] END AS direction,
        CASE WHEN event_type='purchase' THEN CAST(event_id % 101 AS INTEGER) END AS health_score,
        CASE WHEN event_type='signup' AND event_id % 3 = 1 THEN {str_list(WATCHLIST)}[event_id % 15 + 1] END AS w_symbol,
        CAST(event_id % 30 AS DOUBLE)/100.0::DOUBLE AS w1, CAST(event_id % 7 AS DOUBLE)/100.0::DOUBLE AS w2,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events""",
)
