"""Readers, sinks, model persistence, the daily plan and the streaming jobs."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import modeling
from barloom.operators import technical as tech
from barloom.plans import daily
from barloom.plans.signals import full_panel
from barloom.session import cut_lineage
from barloom.sources import readers, sinks
from barloom.sources.dims import styles
from barloom.sources.snapshots import SnapshotStore
from barloom.sources.tables import BARS_ASOF, EVENTS_ASOF, Tables
from barloom.streaming import log_status, risk_monitor


def test_agent_log_files(spark, tmp_path):
    day = [{"agent": "News-Sentiment", "data": {"ticker": "A", "x": {"y": 1}}, "reasoning": "r", "timestamp": f"t{i}"} for i in range(3)]
    (tmp_path / "2024-05-06.json").write_text(json.dumps(day, indent=2))
    (tmp_path / "2024-05-07.json").write_text("[{broken")
    log = readers.read_agent_log(spark, str(tmp_path))
    rows = log.orderBy("seq").collect()
    assert [r["ts"] for r in rows] == ["t0", "t1", "t2"] and str(rows[0]["run_date"]) == "2024-05-06"
    assert json.loads(rows[0]["data"]) == {"ticker": "A", "x": {"y": 1}}
    assert [str(r[0]) for r in readers.list_log_dates(log).collect()] == ["2024-05-06"]


def test_append_log_and_sanitise(spark, tmp_path):
    rows = [("2024-05-06", "A", float("nan"), [1.0, float("inf")], {"w": float("-inf")})]
    df = spark.createDataFrame(rows, "run_date string, agent string, score double, v array<double>, m map<string,double>")
    for _ in range(2):
        sinks.append_agent_log(df, str(tmp_path / "log"))
    nested = spark.createDataFrame([(1, ((float("nan"), [(float("inf"), 2.0)]), [float("-inf"), None]))], "i int, s struct<a:struct<x:double,l:array<struct<p:double,q:double>>>,v:array<double>>")
    assert sinks.sanitise(nested).first().asDict(True) == {"i": 1, "s": {"a": {"x": None, "l": [{"p": None, "q": 2.0}]}, "v": [None, None]}}
    back = spark.read.schema("run_date string, agent string, score double, v array<double>, m map<string,double>").json(str(tmp_path / "log"))
    r = back.first()
    assert back.count() == 2 and r["score"] is None and list(r["v"]) == [1.0, None] and r["m"] == {"w": None}


def test_portfolio_state(spark, tmp_path):
    state = {"positions": {"A": {"entry_price": 10.0, "shares": 2.0, "entry_date": "2024-01-01"}}, "equity": 5.0}
    (tmp_path / "state.json").write_text(json.dumps(state, indent=1))
    pos, account = readers.read_portfolio_state(spark, str(tmp_path / "state.json"))
    assert [tuple(r) for r in pos.collect()] == [("A", 10.0, 2.0, "2024-01-01")]
    assert (account.first()["equity"], account.first()["starting_equity"]) == (5.0, 100_000.0)
    for _ in range(2):
        sinks.write_portfolio_state(pos, account, str(tmp_path / "snap"), "2024-01-02")
    again, money = sinks.read_portfolio_snapshot(spark, str(tmp_path / "snap"), "2024-01-02")
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in pos.collect()]
    assert tuple(money.first()) == tuple(account.first())


def test_fuzzy_columns(spark):
    raw = spark.createDataFrame([("A", "2024-01-01", "Buy", "Bob", "$5")], "symbol string, `Start Date` string, Transaction string, `Insider Name` string, Value string")
    r = readers.read_insider_tx(raw).first()
    assert (str(r["tx_date"]), r["text"], r["insider"], r["value"]) == ("2024-01-01", "Buy", "Bob", "$5")
    e = spark.createDataFrame([("A", "2024-01-01", "1.2", "1.0"), ("A", "2024-02-01", "n/a", "1.0"), ("A", "2024-03-01", "1", "0")], "symbol string, report_date string, epsActual string, epsEstimate string")
    assert [r["surprise"] for r in readers.read_earnings(e).orderBy("report_date").collect()] == [pytest.approx(0.2), None]


def test_filters_reach_the_scan(spark, sf_dir):
    plan = Tables(spark, sf_dir).bars(since="2001-06-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_only_one_placement_of_the_bars(spark, sf_dir):
    """All windows of the panel share the exchange by symbol."""
    t = Tables(spark, sf_dir)
    plan = tech.technical_features(t.bars(), t.dims(), t.indices(), t.vix())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(symbol") - plan.count("InMemory") <= 3


def test_the_panel_reads_its_calendar_once(spark, sf_dir):
    """Bars and the three dimension tables are the only scans, what comes from indices is one written table."""
    t = Tables(spark, sf_dir)
    plan = tech.technical_features(t.bars(), t.dims(), t.indices(), t.vix())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and plan.count("Exchange hashpartitioning") <= 5 and plan.count("BroadcastExchange") <= 4


def test_row_limits_run_ahead_of_the_shuffle(spark, sf_dir):
    """A hot symbol or log ships a bounded number of rows per input partition."""
    from barloom.operators import logs, news, universe

    t = Tables(spark, sf_dir)
    for df in (logs.reconstruct_blocks(t.agent_log()), news.dedup_news(t.news()), universe.screen_stats(t.bars())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_model_round_trip(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.01")
    panel = full_panel(t)
    cfg = modeling.Boosting(rounds=2, depth=2)
    model, scored, quality = modeling.train_eval(panel, cfg)
    n = panel.count()
    assert scored.count() == n - int(n * 0.8)
    q = quality.first()
    assert 0 <= q["auc"] <= 1 and -1 <= q["ic"] <= 1 and q["usable"] == (q["auc"] >= 0.5 and q["ic"] >= 0)
    sinks.save_model(model, quality, str(tmp_path / "m"))
    again = sinks.load_model(str(tmp_path / "m"))
    assert sinks.is_usable(spark, str(tmp_path / "m")) == q["usable"]
    live = tech.latest_per_symbol(panel)
    a = {r["symbol"]: r["prob_up"] for r in modeling.predict(model, live, True).collect()}
    b = {r["symbol"]: r["prob_up"] for r in modeling.predict(again, live, True).collect()}
    assert a == b and len(a) == 100
    assert {r["direction"] for r in modeling.predict(None, live, False).collect()} == {"sideways"}
    imp = modeling.importances(model).collect()
    assert len(imp) == 20 and sum(r["importance"] for r in imp) == pytest.approx(1, abs=1e-6)
    spark.catalog.clearCache()


def test_daily_run(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.01")
    dense = t.baskets().select("symbol", F.split("symbol", "-")[0].alias("sector"), F.lit(None).cast("string").alias("nation")).distinct()
    symbols = [f"S{i}" for i in range(100)] + [r["symbol"] for r in dense.collect()]
    day = daily.Inputs(
        bars=t.screen_bars(),
        macro=t.macro(),
        earnings=readers.read_earnings(t.earnings()),
        insider_tx=readers.read_insider_tx(t.insider_tx()),
        options=t.options(),
        scored_news=t.scored_news(),
        fundamentals=t.fundamentals(),
        proposals=spark.createDataFrame([(s, "0.2") for s in symbols], "symbol string, weight string"),
        dims=t.dims().unionByName(dense),
        styles=styles(spark),
        directions=spark.createDataFrame([(s, "bullish", 0.8) for s in symbols], "symbol string, direction string, confidence double"),
        positions=t.positions(),
        min_dollar_volume=45_000.0,
        snapshot_days=150,
        lookback_days=1400,
        events_asof=EVENTS_ASOF,
    )
    out = daily.daily_run(day, BARS_ASOF)
    report = out.report.toPandas()
    names = {r["symbol"] for r in out.universe.collect()}
    forced = {r["symbol"] for r in out.actions.where("action like 'FORCE%'").collect()}
    assert 0 < len(report) and set(report["symbol"]) <= names and not set(report["symbol"]) & forced
    assert report["weight"].sum() <= 1.0 + 1e-9 and set(report["direction"]) <= {"bullish", "sideways"}

    out = dataclasses.replace(out, weights=cut_lineage(out.weights))
    end = daily.end_of_day(day, out, BARS_ASOF)
    for _ in range(2):
        daily.save_day(end, str(tmp_path / "day"), BARS_ASOF)
    kept, account = sinks.read_portfolio_snapshot(spark, str(tmp_path / "day/portfolio"), BARS_ASOF)
    weight = dict(zip(report["symbol"], report["weight"]))
    held = {r["symbol"]: r for r in kept.collect()}
    assert set(held) == {s for s, w in weight.items() if w > 0}
    assert all(held[s]["shares"] == pytest.approx(100_000 * weight[s] / held[s]["entry_price"], abs=0.01) for s in held)
    assert (account.first()["equity"], account.first()["starting_equity"]) == (100_000.0, 100_000.0)
    decided = SnapshotStore(spark, str(tmp_path / "day/decisions"), ["id"]).read().collect()
    assert [r["id"] for r in decided] == [BARS_ASOF] and json.loads(decided[0]["weights_json"]) == pytest.approx({s: w for s, w in weight.items()})
    orders = {r["symbol"]: r for r in end.orders.collect()}
    assert forced <= {s for s, r in orders.items() if r["side"] == "SELL"} | {r["symbol"] for r in t.positions().where("shares * current_price < 600").collect()}
    assert {r["symbol"] for r in end.thresholds.collect()} == {r["symbol"] for r in t.positions().collect()}

    first = dataclasses.replace(day, positions=None)
    end = daily.end_of_day(first, out, BARS_ASOF)
    assert {r["side"] for r in end.orders.collect()} == {"BUY"}
    spark.catalog.clearCache()


def test_status_stream(spark, sf_dir, tmp_path):
    log = Tables(spark, sf_dir).agent_log()
    log.repartition(4).write.json(str(tmp_path / "in"))
    stream = log_status.status_stream(log_status.read_entries(spark, str(tmp_path / "in"), files_per_batch=2))
    q = (
        stream.writeStream.outputMode("update")
        .foreachBatch(log_status.upsert_to(str(tmp_path / "out")))
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(240)
    got = log_status.latest_status(spark, str(tmp_path / "out"))
    assert got.agg(F.sum("total_entries")).first()[0] == log.count()


def test_risk_stream(spark, tmp_path):
    ticks = spark.createDataFrame([("A", "2024-01-01 10:00:00", 90.0), ("A", "2024-01-01 10:01:00", 100.0), ("B", "2024-01-01 10:00:00", 130.0), ("C", "2024-01-01 10:00:00", 1.0)], "symbol string, ts string, close double")
    ticks.write.json(str(tmp_path / "ticks"))
    pos = spark.createDataFrame([("A", 100.0, 100.0, 10.0, 3.0, 5.0), ("B", 100.0, 100.0, 10.0, 3.0, 5.0)], "symbol string, entry_price double, current_price double, shares double, sl_pct double, tp_pct double")
    src = spark.readStream.schema("symbol string, ts string, close double").json(str(tmp_path / "ticks"))
    q = risk_monitor.risk_stream(src, pos, 1e5, 1e5).writeStream.format("memory").queryName("risk").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["symbol"], r["ts"][-8:]): r["action"] for r in spark.table("risk").collect()}
    assert got == {("A", "10:00:00"): "FORCE_SELL_SL", ("A", "10:01:00"): "HOLD", ("B", "10:00:00"): "FORCE_SELL_TP"}
    exits = risk_monitor.forced_exits(spark.table("risk"))
    assert exits.count() == 2
