"""Streams against their batch forms, and the snapshot store under crashes."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import logs
from barloom.sources.dims import WATCHLIST, watchlist
from barloom.sources.snapshots import SnapshotStore
from barloom.sources.tables import Tables
from barloom.streaming import log_status

KEYS = log_status.KEYS


def run(stream, out, checkpoint):
    q = stream.writeStream.outputMode("update").foreachBatch(log_status.upsert_to(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def rows(df):
    cols = sorted(df.columns)
    return sorted((str(tuple(r)) for r in df.select(*cols).collect()))


def batch_form(spark, log):
    blocks = logs.reconstruct_blocks(log)
    return logs.run_status(log, blocks, watchlist(spark)), logs.block_analyses(blocks, watchlist(spark))


@pytest.mark.parametrize("seed", [1, 2])
def test_status_stream_equals_the_batch_form_on_any_split(spark, sf_dir, tmp_path, seed):
    """Entries come in any order: some files hold the end of a log, later ones its beginning."""
    log = Tables(spark, sf_dir).agent_log().where("desk in ('D1', 'D2', 'D3', 'D4', 'D5')").cache()
    parts = 5
    at = F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(parts))
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    seen = None
    for k in range(parts):
        arrived = log.where(at == k)
        arrived.coalesce(2).write.mode("append").json(source)
        seen = arrived if seen is None else seen.unionByName(arrived)
        run(log_status.status_stream(log_status.read_entries(spark, source, files_per_batch=1 + seed)), out, str(tmp_path / "ck"))
        if k in (0, 2, parts - 1):
            status, blocks = batch_form(spark, seen)
            got = log_status.latest_status(spark, out)
            assert rows(got.drop("blocks")) == rows(status)
            assert rows(log_status.live_blocks(got)) == rows(blocks)
    store = SnapshotStore(spark, out, KEYS)
    assert len(store.manifest().parts) < parts + 1


def test_block_machine_equals_the_windows(spark):
    rng = random.Random(4)
    entries = [("d", k, i, rng.choice([*logs.PER_STOCK, "Risk-Style"]), f'{{"n": {i}}}') for k in range(12) for i in rng.sample(range(500), rng.choice([1, 4, 40, 120]))]
    log = spark.createDataFrame(entries, "desk string, run_date int, seq long, agent string, data string")
    want = {(r["run_date"], r["seq"]): r["block"] for r in logs.reconstruct_blocks(log).collect()}
    got = {}
    for k in range(12):
        own = sorted((e for e in entries if e[1] == k and e[3] in logs.PER_STOCK), key=lambda e: e[2])
        got |= {(k, e[2]): n for e, n in zip(own[: 3 * len(WATCHLIST)], log_status.blocks_of([e[3] for e in own])) if n <= len(WATCHLIST)}
    assert got == want


def test_progress_merges_in_any_order():
    rng = random.Random(2)
    entries = [(i, rng.choice([*logs.PER_STOCK, *logs.PORTFOLIO, "Pipeline-Error", None]), f"d{i}", f"t{i}", i % 5 == 0) for i in range(200)]
    whole = log_status.Progress()
    for e in entries:
        whole.add(*e)
    for _ in range(10):
        rng.shuffle(entries)
        parts = [log_status.Progress() for _ in range(4)]
        for e in entries:
            rng.choice(parts).add(*e)
        now = log_status.Progress()
        for p in parts:
            now.merge(log_status.Progress(told=p.told()))
        assert now.told() == whole.told() and now.blocks(WATCHLIST) == whole.blocks(WATCHLIST)
    assert len(whole.slots) == 3 * len(WATCHLIST)


def test_entries_without_a_place_are_left_out(spark, tmp_path):
    spark.createDataFrame([("d", None, None, "Fundamentals", "{}", None), ("d", None, 3, None, None, None), ("d", None, 4, "Risk-Style", '{"style": "bold"}', "t4")], log_status.ENTRY_SCHEMA).write.json(str(tmp_path / "in"))
    run(log_status.status_stream(log_status.read_entries(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    r = log_status.latest_status(spark, str(tmp_path / "out")).first()
    assert (r["run_date"], r["total_entries"], r["trading_style"], r["last_updated"], r["phase1_complete"], r["blocks"]) == (None, 2, "bold", "t4", False, [])


# -- snapshots ------------------------------------------------------------------------


def frame(spark, pairs):
    return spark.createDataFrame([(k, v, k % 3 == 0 and v == "gone") for k, v in pairs], "id long, v string, _deleted boolean")


def live(store):
    return {r["id"]: r["v"] for r in store.read().collect()}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    store, want = SnapshotStore(spark, str(tmp_path / "s"), ["id"], fanout=3), {}
    for n in range(20):
        pairs = {rng.randrange(30): rng.choice(["a", "b", "gone"]) + ("" if rng.random() < 0.5 else str(n)) for _ in range(rng.randint(1, 8))}
        version = store.upsert(frame(spark, pairs.items()), batch=n)
        for k, v in pairs.items():
            want[k] = v
            if k % 3 == 0 and v == "gone":
                del want[k]
        if n % 4 == 3:
            assert live(store) == want
        assert store.upsert(frame(spark, [(999, "again")]), batch=n) == version == n + 1
    assert live(store) == want
    # parts: at most fanout - 1 a level; nothing else lies in the folder but what the version before lists
    parts = store.manifest().parts
    assert all(sum(p.level == k for p in parts) < 3 for k in range(9)) and max(p.level for p in parts) == 2
    listed = {p.path.split("/")[1] for v in store.versions() for p in store.manifest(v).parts}
    assert {p.name for p in (tmp_path / "s" / "parts").iterdir()} == listed and len(store.versions()) == 2


def test_rows_read_follow_the_live_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), ["id"], fanout=3)
    for n in range(27):
        store.upsert(frame(spark, [(k, f"v{n}") for k in range(50)]))
    held = sum(spark.read.parquet(f"{tmp_path}/s/{p.path}").count() for p in store.manifest().parts)
    assert live(store) == {k: "v26" for k in range(50)} and held == 50  # 27 commits, one part


def test_a_crash_before_the_switch_shows_the_old_state(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "s"), ["id"], fanout=2)
    store.upsert(frame(spark, [(1, "old"), (2, "old")]), 0)

    def crash(_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_switch", crash)
        with pytest.raises(OSError):
            store.upsert(frame(spark, [(1, "new")]), 1)
    assert live(store) == {1: "old", 2: "old"} and store.manifest().batch == 0
    store.upsert(frame(spark, [(1, "new")]), 1)
    assert live(store) == {1: "new", 2: "old"}
    assert {p.name for p in (tmp_path / "s" / "parts").iterdir()} == {p.path.split("/")[1] for v in store.versions() for p in store.manifest(v).parts}


def test_two_writers_cannot_both_switch(spark, tmp_path):
    one, two = (SnapshotStore(spark, str(tmp_path / "s"), ["id"]) for _ in range(2))
    one.upsert(frame(spark, [(1, "a")]))
    stale = two.manifest()
    one.upsert(frame(spark, [(1, "b")]))
    with pytest.raises(RuntimeError):
        two._switch(type(stale)(stale.version + 1, -1, stale.parts, stale.schema))
    assert live(two) == {1: "b"}


def test_an_empty_store_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        SnapshotStore(spark, str(tmp_path / "s"), ["id"]).read()


# -- accounts -------------------------------------------------------------------------

TICK = "symbol string, ts timestamp, close double"
HELD = "account string, symbol string, entry_price double, shares double, sl_pct double, tp_pct double"


def market(spark, steps=40):
    """Two accounts: the first loses 5 % in mid-stream, the second never does."""
    rng = random.Random(6)
    ticks, price = [], {"A": 100.0, "B": 50.0, "C": 10.0}
    for k in range(steps):
        for s in price:
            price[s] *= 1 + rng.uniform(-0.02, 0.02) - (0.012 if s == "A" and k > 10 else 0)
            if rng.random() < 0.8:
                ticks.append((s, f"2024-01-02 10:{k // 60:02d}:{k % 60:02d}", round(price[s], 3)))
    rows = spark.createDataFrame(ticks, "symbol string, ts string, close double").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    positions = spark.createDataFrame([("one", "A", 100.0, 60.0, 3.0, 5.0), ("one", "B", 50.0, 40.0, 3.0, 5.0), ("one", "D", 5.0, 100.0, 3.0, 5.0), ("two", "C", 10.0, 10.0, 2.0, 4.0), ("two", "B", 50.0, 2.0, 3.0, 5.0)], HELD)
    accounts = spark.createDataFrame([("one", 1500.0, 10_000.0), ("two", 800.0, 1000.0), ("none", 10.0, 10.0)], "account string, cash double, starting_equity double")
    return rows, positions, accounts


def told(df):
    return sorted((r["account"], str(r["ts"]), r["symbol"], r["action"], r["reason"], round(r["equity"], 6), round(r["pnl_pct"], 6)) for r in df.collect())


def test_breaker_trips_in_mid_stream_once(spark, tmp_path):
    from barloom.streaming import risk_monitor as m

    ticks, positions, accounts = market(spark)
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = m.account_actions(m.equity_stream(spark.readStream.schema(TICK).json(source), positions, accounts), positions, accounts)
    name, got, seen = "accounts", [], None
    for k in range(4):
        arrived = ticks.where(F.floor(F.second("ts") / 10) == k)
        arrived.repartition(3).write.mode("append").json(source)
        seen = arrived if seen is None else seen.unionByName(arrived)

        def collect(batch, _):
            got.extend(told(batch))

        q = stream.writeStream.queryName(f"{name}{k}").outputMode("append").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        assert sorted(got) == told(m.account_actions(m.equity_batch(seen, positions, accounts), positions, accounts))
    circuit = [r for r in got if r[3] == "FORCE_SELL_CIRCUIT"]
    assert sorted((r[0], r[2]) for r in circuit) == [("one", "A"), ("one", "B"), ("one", "D")] and len({r[1] for r in circuit}) == 1
    assert max(r[1] for r in got if r[0] == "one") == circuit[0][1] < max(r[1] for r in got if r[0] == "two")
    assert all(r[4].startswith("CIRCUIT BREAKER: Portfolio down -") for r in circuit)


def test_late_ticks(spark, tmp_path):
    from barloom.streaming import risk_monitor as m

    positions = spark.createDataFrame([("one", "A", 100.0, 10.0, 3.0, 5.0)], HELD)
    accounts = spark.createDataFrame([("one", 0.0, 1000.0)], "account string, cash double, starting_equity double")
    source, got = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    stream = m.equity_stream(spark.readStream.schema(TICK).json(source), positions, accounts)
    for rows in ([("A", "2024-01-02T10:00:05Z", 99.0)], [("A", "2024-01-02T10:00:01Z", 10.0)], [("A", "2024-01-02T10:00:06Z", 98.0), (None, "2024-01-02T10:00:06Z", 1.0), ("A", "2024-01-02T10:00:07Z", None)]):
        spark.createDataFrame(rows, "symbol string, ts string, close double").write.mode("append").json(source)
        q = stream.writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend((r["equity"], r["symbol"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(200)
    assert got == [(990.0, "A"), (980.0, "A")]
