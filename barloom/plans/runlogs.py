"""Run-log analytics, answers, rollups and the final report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import answers, logs, portfolio, rollup
from barloom.plans.cte import cte, pyround
from barloom.plans.portfolios import merged
from barloom.plans.registry import query
from barloom.session import shared_folder
from barloom.sources import readers, sinks
from barloom.sources.dims import watchlist
from barloom.sources.snapshots import SnapshotStore
from barloom.sources.tables import Tables

_STOCK = "agent IN ('News-Sentiment','Technical-Forecaster','Fundamentals')"
_BY = "desk, run_date"

cte(
    "blocks",
    f"""SELECT *, CAST(sum(CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {_BY} ORDER BY seq) AS INTEGER) AS block FROM (
        SELECT *, row_number() OVER (PARTITION BY {_BY}, g ORDER BY seq) - 1 AS pos FROM (
        SELECT *, sum(CASE WHEN agent='News-Sentiment' THEN 1 ELSE 0 END) OVER (PARTITION BY {_BY} ORDER BY seq) AS g FROM agent_log WHERE {_STOCK}))""",
    "agent_log",
)
cte("blocks15", "SELECT * FROM blocks WHERE block <= 15", "blocks")
cte(
    "analyses",
    f"""SELECT {_BY}, block, w.symbol, sent, dir, health, has_s, has_t, has_f, has_s AND has_t AND has_f AS complete FROM (
        SELECT {_BY}, block, arg_max(sentiment_score, seq) FILTER (agent='News-Sentiment') AS sent, arg_max(direction, seq) FILTER (agent='Technical-Forecaster') AS dir,
               arg_max(health_score, seq) FILTER (agent='Fundamentals') AS health, bool_or(agent='News-Sentiment') AS has_s, bool_or(agent='Technical-Forecaster') AS has_t, bool_or(agent='Fundamentals') AS has_f
        FROM blocks15 GROUP BY ALL) b JOIN watchlist w ON w.ordinal = b.block""",
    "blocks15",
    "watchlist",
)


def blocks(t: Tables) -> DataFrame:
    return logs.reconstruct_blocks(t.agent_log())


def analyses(t: Tables) -> DataFrame:
    return logs.block_analyses(blocks(t), watchlist(t.spark))


def status(t: Tables) -> DataFrame:
    return logs.run_status(t.agent_log(), blocks(t), watchlist(t.spark))


@query("p15_agent_kinds", f"SELECT {_BY}, count(*) FILTER ({_STOCK}) AS per_stock, count(*) FILTER (agent IN ('Risk-Style','Portfolio-Decision','Risk-Management')) AS portfolio, count(*) FILTER (agent='Pipeline-Error') AS errors FROM agent_log GROUP BY ALL", "agent_log")
def _(t: Tables) -> DataFrame:
    kind = lambda names: F.count_if(F.col("agent").isin(*names))
    return t.agent_log().groupBy("desk", "run_date").agg(kind(logs.PER_STOCK).alias("per_stock"), kind(logs.PORTFOLIO).alias("portfolio"), kind(logs.ERRORS).alias("errors"))


@query("w26_log_blocks", f"SELECT {_BY}, seq, agent, block FROM blocks15", "blocks15")
def _(t: Tables) -> DataFrame:
    return blocks(t).select("desk", "run_date", "seq", "agent", "block")


@query(
    "d30_reconstruct_log",
    f"SELECT {_BY}, block, symbol, sent AS sentiment_score, dir AS direction, CAST(health AS DOUBLE) AS health_score, complete FROM analyses",
    "analyses",
)
def _(t: Tables) -> DataFrame:
    a = analyses(t)
    return a.select(
        "desk", "run_date", "block", "symbol",
        F.get_json_object("sentiment", "$.sentiment_score").try_cast("double").alias("sentiment_score"),
        F.get_json_object("technical", "$.direction").alias("direction"),
        F.get_json_object("fundamentals", "$.health_score").try_cast("double").alias("health_score"),
        "complete",
    )


@query(
    "d30_keyed_analyses",
    f"""SELECT {_BY}, ticker AS symbol, arg_max(sentiment_score, seq) FILTER (agent='News-Sentiment') AS sentiment_score, arg_max(direction, seq) FILTER (agent='Technical-Forecaster') AS direction,
        CAST(arg_max(health_score, seq) FILTER (agent='Fundamentals') AS DOUBLE) AS health_score FROM agent_log WHERE {_STOCK} GROUP BY ALL""",
    "agent_log",
)
def _(t: Tables) -> DataFrame:
    return logs.keyed_analyses(t.agent_log()).select(
        "desk", "run_date", "symbol",
        F.get_json_object("sentiment", "$.sentiment_score").try_cast("double").alias("sentiment_score"),
        F.get_json_object("technical", "$.direction").alias("direction"),
        F.get_json_object("fundamentals", "$.health_score").try_cast("double").alias("health_score"),
    )


cte(
    "status",
    f"""SELECT l.*, coalesce(stocks_analyzed, 0) AS stocks_analyzed, coalesce(stocks_complete, 0) AS stocks_complete FROM (
        SELECT {_BY}, bool_or({_STOCK}) AS phase1_complete, bool_or(agent='Portfolio-Decision') AS phase2_complete, bool_or(agent='Risk-Management') AS phase3_complete,
               arg_max(ts, seq) AS last_updated, count(*) AS total_entries, count(*) FILTER (agent='Pipeline-Error' AND ticker IS NOT NULL) AS error_count,
               CASE WHEN bool_or(agent='Risk-Style') THEN 'aggressive' END AS trading_style FROM agent_log GROUP BY ALL) l
        LEFT JOIN (SELECT {_BY}, count(*) AS stocks_analyzed, count(*) FILTER (complete) AS stocks_complete FROM analyses GROUP BY ALL) a USING (desk, run_date)""",
    "agent_log",
    "analyses",
)
_STATUS = ["desk", "run_date", "phase1_complete", "phase2_complete", "phase3_complete", "last_updated", "total_entries", "stocks_analyzed", "stocks_complete", "error_count", "trading_style"]


@query("d31_a16_a17_run_status", f"SELECT {', '.join(_STATUS)}, 15 AS stocks_total, 1.0::DOUBLE AS cash_reserve FROM status", "status")
def _(t: Tables) -> DataFrame:
    return status(t).select(*_STATUS, "stocks_total", "cash_reserve")


@query(
    "d31_status_or_zero",
    f"""SELECT {_BY}, coalesce(phase1_complete, false) AS phase1_complete, coalesce(total_entries, 0) AS total_entries, coalesce(stocks_complete, 0) AS stocks_complete FROM (
        SELECT d.desk, r.run_date FROM (SELECT DISTINCT desk FROM agent_log) d, (SELECT DATE '2024-01-29' AS run_date) r) q LEFT JOIN status s USING (desk, run_date)""",
    "status agent_log",
)
def _(t: Tables) -> DataFrame:
    asked = t.agent_log().select("desk").distinct().withColumn("run_date", F.lit("2024-01-29").cast("date"))
    return logs.status_or_zero(asked, status(t)).select("desk", "run_date", "phase1_complete", "total_entries", "stocks_complete")


@query("a17_error_symbols", f"SELECT {_BY}, seq, ticker AS symbol FROM agent_log WHERE agent='Pipeline-Error' AND ticker IS NOT NULL", "agent_log")
def _(t: Tables) -> DataFrame:
    return logs.error_symbols(t.agent_log())


cte(
    "first_decision",
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY seq) AS n FROM agent_log WHERE agent='Portfolio-Decision') WHERE n = 1",
    "agent_log",
)
cte("logged", f"SELECT {_BY}, w_symbol AS symbol, w1 AS weight FROM first_decision UNION ALL SELECT {_BY}, 'XYZ', w2 FROM first_decision", "first_decision")
cte(
    "logged_sectors",
    f"SELECT {_BY}, sector, {pyround('s', 4)} AS weight FROM (SELECT {_BY}, coalesce(sector,'Unknown') AS sector, sum(weight) AS s FROM logged LEFT JOIN watchlist USING (symbol) GROUP BY ALL)",
    "logged",
    "watchlist",
)
cte(
    "broken",
    f"""SELECT {_BY}, 'single' AS kind, symbol AS name, weight, symbol || ': ' || printf('%.1f', weight*100) || '% > 15% single-name cap' AS message FROM logged WHERE weight > 0.15::DOUBLE
        UNION ALL SELECT {_BY}, 'sector', sector, weight, sector || ': ' || printf('%.1f', weight*100) || '% > 35% sector cap' FROM logged_sectors WHERE weight > 0.35::DOUBLE""",
    "logged",
    "logged_sectors",
)


def logged(t: Tables) -> DataFrame:
    return logs.logged_weights(status(t))


@query("a16_logged_weights", "SELECT * FROM logged", "logged")
def _(t: Tables) -> DataFrame:
    return logged(t)


@query("d32_sector_weights", "SELECT * FROM logged_sectors", "logged_sectors", "weight")
def _(t: Tables) -> DataFrame:
    return logs.sector_weights(logged(t), watchlist(t.spark))


@query("d32_violations", "SELECT * FROM broken", "broken", "weight")
def _(t: Tables) -> DataFrame:
    return logs.violations(logged(t), watchlist(t.spark))


@query(
    "d32_compliance",
    f"""SELECT {_BY}, {pyround('g', 4)} AS gross_exposure, top_weight, coalesce(n_violations, 0) AS n_violations, top_weight <= 0.15::DOUBLE AS single_ok, coalesce(ns, 0) = 0 AS sector_ok, {pyround('g', 4)} <= 1 AS gross_ok FROM (
        SELECT {_BY}, sum(weight) AS g, max(weight) AS top_weight FROM logged GROUP BY ALL) LEFT JOIN (SELECT {_BY}, count(*) AS n_violations, count(*) FILTER (kind='sector') AS ns FROM broken GROUP BY ALL) USING (desk, run_date)""",
    "logged broken",
    "gross_exposure",
)
def _(t: Tables) -> DataFrame:
    return logs.compliance(logged(t), watchlist(t.spark))


@query(
    "d32_compliance_final_weights",
    f"""SELECT run_date, kind, name, message FROM (
        SELECT run_date, 'single' AS kind, symbol AS name, symbol || ': ' || printf('%.1f', weight*100) || '% > 15% single-name cap' AS message FROM (SELECT run_date, symbol, round(weight, 6) AS weight FROM merged) WHERE weight > 0.15::DOUBLE
        UNION ALL SELECT run_date, 'sector', sector, sector || ': ' || printf('%.1f', w*100) || '% > 35% sector cap' FROM (SELECT run_date, sector, {pyround('s', 4)} AS w FROM (
           SELECT run_date, coalesce(sector,'Unknown') AS sector, sum(round(weight, 6)) AS s FROM merged LEFT JOIN watchlist USING (symbol) GROUP BY ALL)) WHERE w > 0.35::DOUBLE)""",
    "merged watchlist",
)
def _(t: Tables) -> DataFrame:
    final = merged(t).withColumn("weight", F.round("weight", 6))
    return logs.violations(final, watchlist(t.spark), ["run_date"]).drop("weight")


# -- written and read again ----------------------------------------------------------------


@query("s10_append_agent_log", f"SELECT {_BY}, seq, agent, ticker, sentiment_score FROM agent_log", "agent_log")
def _(t: Tables) -> DataFrame:
    """The log appended in two goes, a score that is no number in the second, and read back from its files."""
    folder = shared_folder(t.spark)
    log = t.agent_log().withColumn("score", F.when(F.col("seq") % 2 == 1, F.lit(float("nan"))).otherwise(0.5))
    for part in range(2):
        sinks.append_agent_log(log.where(F.col("seq") % 2 == part), folder)
    back = t.spark.read.schema("desk string, run_date date, seq long, agent string, data string, ts string, score double").json(folder)
    kept = back.where((F.col("seq") % 2 == 0) == F.col("score").isNotNull())  # what is no number comes back as NULL
    return kept.select(
        "desk", "run_date", "seq", "agent", F.get_json_object("data", "$.ticker").alias("ticker"),
        F.get_json_object("data", "$.sentiment_score").try_cast("double").alias("sentiment_score"),
    )


@query("s09_read_agent_log", f"SELECT run_date, agent, count(*) AS n, max(seq) AS last FROM agent_log WHERE desk = 'D1' GROUP BY ALL", "agent_log")
def _(t: Tables) -> DataFrame:
    """One desk's log as a whole-file array per day, read back beside a file that is no JSON."""
    folder = shared_folder(t.spark)
    entry = F.struct("seq", "agent", F.to_json(F.struct("seq")).alias("data"), F.col("ts").alias("timestamp"))
    day = t.agent_log().where("desk = 'D1'").groupBy("run_date").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("value"))  # by the format, a desk's day is one file
    broken = t.spark.range(1).select(F.lit("1999-01-01").cast("date").alias("run_date"), F.lit("[{not json").alias("value"))
    day.unionByName(broken).repartition("run_date").write.partitionBy("run_date").text(folder)
    log = readers.read_agent_log(t.spark, folder)
    return log.groupBy("run_date", "agent").agg(F.count("*").alias("n"), F.max(F.get_json_object("data", "$.seq").cast("long")).alias("last"))


@query(
    "u07_snapshot_store",
    f"SELECT {_BY}, count(*) AS total_entries, max(seq) AS last_seq FROM agent_log GROUP BY ALL HAVING NOT (max(seq) % 5 = 0)",
    "agent_log",
)
def _(t: Tables) -> DataFrame:
    """Logs upserted in six commits as they grow; those whose last entry is the fifth, tenth, ... are deleted in the end."""
    store = SnapshotStore(t.spark, shared_folder(t.spark), ["desk", "run_date"])
    log = t.agent_log()
    for k in range(6):
        seen = log.where(F.pmod(F.xxhash64("seq"), F.lit(6)) <= k)
        rows = seen.groupBy("desk", "run_date").agg(F.count("*").alias("total_entries"), F.max("seq").alias("last_seq"))
        store.upsert(rows.withColumn("_deleted", F.lit(k == 5) & (F.col("last_seq") % 5 == 0)), batch=k)
    return store.read()


# -- rollup -----------------------------------------------------------------------------

cte(
    "scores",
    "SELECT desk, run_date, symbol, complete, coalesce(sent, 0.0) AS sent, CAST(coalesce(health, 50) AS DOUBLE) AS health, CASE dir WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END AS dir FROM analyses",
    "analyses",
)
cte(
    "rolled",
    f"""SELECT *, CASE WHEN average_sentiment < -0.15 OR breadth < -0.2 THEN 'DEFENSIVE' WHEN average_sentiment > 0.15 OR breadth > 0.2 THEN 'RISK-ON' ELSE 'BALANCED' END AS regime FROM (
        SELECT *, coalesce(CAST(up_count - down_count AS DOUBLE)/nullif(n_complete, 0), 0.0) AS breadth FROM (
        SELECT {_BY}, coalesce(avg(sent) FILTER (complete), 0.0) AS average_sentiment, coalesce(avg(health) FILTER (complete), 0.0) AS average_health,
               count(*) FILTER (complete AND dir = 1) AS up_count, count(*) FILTER (complete AND dir = -1) AS down_count, count(*) FILTER (complete) AS n_complete FROM scores GROUP BY ALL))""",
    "scores",
)


def scores(t: Tables) -> DataFrame:
    return rollup.with_scores(analyses(t))


@query("d33_a20_market_rollup", "SELECT * FROM rolled", "rolled", "average_sentiment average_health breadth")
def _(t: Tables) -> DataFrame:
    return rollup.market_rollup(scores(t))


@query(
    "d33_strip",
    f"SELECT *, CASE WHEN score < -0.15::DOUBLE THEN 'negative' WHEN score > 0.35::DOUBLE THEN 'positive' ELSE 'neutral' END AS tone FROM (SELECT {_BY}, symbol, sent + dir*0.35::DOUBLE + (health-50)/100 AS score FROM scores)",
    "scores",
    "score",
)
def _(t: Tables) -> DataFrame:
    return rollup.strip(scores(t))


@query(
    "t09_fallback_ranking",
    f"""SELECT {_BY}, symbol, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY weight DESC, symbol) AS rank FROM (
        SELECT {_BY}, symbol, greatest(0.02::DOUBLE, sent*0.08::DOUBLE + dir*0.04::DOUBLE + health/100*0.05::DOUBLE) AS weight FROM scores WHERE complete)) WHERE rank <= 6""",
    "scores",
    "weight",
)
def _(t: Tables) -> DataFrame:
    return rollup.fallback_ranking(scores(t))


@query(
    "t09_top_sectors",
    f"SELECT {_BY}, sector, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY weight DESC, sector) AS rank FROM logged_sectors) WHERE rank <= 5",
    "logged_sectors",
    "weight",
)
def _(t: Tables) -> DataFrame:
    return rollup.top_sectors(logs.sector_weights(logged(t), watchlist(t.spark)))


@query("d33_completion", f"SELECT {_BY}, CAST(stocks_complete AS DOUBLE)/15 AS quality_score, error_count FROM status", "status", "quality_score")
def _(t: Tables) -> DataFrame:
    return rollup.completion(status(t)).select("desk", "run_date", "quality_score", "error_count")


@query(
    "j15_final_report",
    """SELECT w.run_date, w.symbol, w.weight, coalesce(t.dir, '?') AS direction, coalesce(t.sent, 0.0) AS sentiment_score, coalesce(t.health, 50) AS health_score FROM (SELECT run_date, symbol, weight FROM merged) w
       LEFT JOIN (SELECT ticker AS symbol, arg_max(sentiment_score, seq) FILTER (sentiment_score IS NOT NULL) AS sent, arg_max(direction, seq) FILTER (direction IS NOT NULL) AS dir, arg_max(health_score, seq) FILTER (health_score IS NOT NULL) AS health
         FROM agent_log WHERE ticker IS NOT NULL GROUP BY 1) t USING (symbol)""",
    "merged agent_log",
    "weight",
)
def _(t: Tables) -> DataFrame:
    e = t.agent_log().select(F.get_json_object("data", "$.ticker").alias("symbol"), "seq", "data").where("symbol is not null")

    def latest(field: str, kind: str) -> DataFrame:
        v = F.get_json_object("data", f"$.{field}").try_cast(kind)
        return e.withColumn(field, v).where(F.col(field).isNotNull()).groupBy("symbol").agg(F.max_by(field, "seq").alias(field))

    return portfolio.final_report(merged(t), latest("direction", "string"), latest("sentiment_score", "double"), latest("health_score", "int"))


# -- answers ------------------------------------------------------------------------------


@query(
    "d43_parse_agent_response",
    """SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN (conv_id % 21 - 10)/10.0::DOUBLE ELSE 0.0 END AS sentiment_score, CASE WHEN turn % 4 < 3 THEN (conv_id % 11)/10.0::DOUBLE ELSE 0.5 END AS confidence, CASE WHEN turn % 4 < 3 THEN text ELSE '' END AS key_theme FROM conversations""",
    "",
    "sentiment_score confidence",
)
def _(t: Tables) -> DataFrame:
    return answers.parse_agent_response(t.responses(), "News-Sentiment")


@query(
    "d43_parse_fundamentals",
    """SELECT conv_id, turn, CAST(CASE WHEN turn % 4 < 3 THEN CASE WHEN conv_id % 140 = 0 THEN 50 ELSE least(100, conv_id % 140) END ELSE 50 END AS INTEGER) AS health_score, '' AS key_strength, '' AS key_risk FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    return answers.parse_agent_response(t.responses(), "Fundamentals")


_TOLD = "turn % 4 < 3"


@query(
    "d43_parse_technical",
    f"""SELECT conv_id, turn, CASE WHEN {_TOLD} THEN ['up','down','sideways'][conv_id % 3 + 1] ELSE 'sideways' END AS direction,
       CASE WHEN {_TOLD} THEN (conv_id % 11)/10.0::DOUBLE ELSE 0.5 END AS confidence, CASE WHEN {_TOLD} THEN coalesce(role, '') ELSE '' END AS reasoning FROM conversations""",
    "",
    "confidence",
)
def _(t: Tables) -> DataFrame:
    return answers.parse_agent_response(t.responses(), "Technical-Forecaster")


@query(
    "d43_parse_risk_style",
    f"""SELECT conv_id, turn, CASE WHEN {_TOLD} THEN ['aggressive','conservative','balanced'][conv_id % 3 + 1] ELSE 'balanced' END AS style,
       CASE WHEN {_TOLD} THEN (conv_id % 11)/10.0::DOUBLE ELSE 0.5 END AS confidence, CASE WHEN {_TOLD} THEN coalesce(role, '') ELSE '' END AS reasoning FROM conversations""",
    "",
    "confidence",
)
def _(t: Tables) -> DataFrame:
    return answers.parse_agent_response(t.responses(), "Risk-Style")


@query(
    "d43_parse_decision",
    f"""SELECT conv_id, turn, CASE WHEN {_TOLD} THEN coalesce(role, '') ELSE '' END AS rationale, CASE WHEN {_TOLD} THEN (conv_id % 7)/10.0::DOUBLE END AS aapl, CASE WHEN {_TOLD} THEN 2 END AS n
       FROM conversations""",
    "",
    "aapl",
)
def _(t: Tables) -> DataFrame:
    parsed = answers.parse_agent_response(t.responses(), "Portfolio-Decision")
    return parsed.select("conv_id", "turn", "rationale", F.col("weights")["AAPL"].try_cast("double").alias("aapl"), F.when(F.col("weights").isNotNull(), F.size("weights")).alias("n"))
