"""Carried state against the full panel, on any split of the days."""

import datetime
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.operators import live
from barloom.operators import technical as tech
from barloom.sources.snapshots import SnapshotStore
from barloom.sources.tables import Tables


def last_rows(df):
    return {r["symbol"]: r for r in df.collect()}


def same(got, want):
    assert set(got) == set(want) and len(want) > 3
    for s in want:
        assert got[s]["date"] == want[s]["date"]
        for c in tech.BASE_FEATURES:
            assert got[s][c] == pytest.approx(want[s][c], rel=1e-9, abs=1e-9), (s, c)


@pytest.fixture(scope="module")
def market(spark):
    """Dense baskets with gaps in closes, volumes and the fear gauge, and one symbol without any volume."""
    t = Tables(spark, "/root/testdata/sf0.01")
    bars = t.baskets()
    h = F.pmod(F.xxhash64("symbol", "date"), F.lit(50))
    none = F.lit(None).cast("double")
    bars = bars.select(
        "symbol", "date", F.when(h != 7, F.col("close")).alias("close"),
        F.when((h != 9) & ~F.col("symbol").startswith("ASIA"), F.col("volume")).otherwise(none).alias("volume"),
    ).cache()
    dims = bars.select("symbol", F.split("symbol", "-")[0].alias("sector")).distinct()
    indices, vix = t.indices().cache(), t.vix().where(F.dayofmonth("date") < 27).cache()
    return bars, dims, indices, vix


@pytest.mark.parametrize("cuts", [["2001-10-20"], ["1999-01-04", "2001-10-01", "2001-10-02", "2001-10-03", "2001-10-29"]])
def test_any_split_gives_the_full_panels_last_rows(spark, market, tmp_path, cuts):
    bars, dims, indices, vix = market
    store, since = SnapshotStore(spark, str(tmp_path / "s"), ["symbol"]), "1900-01-01"
    for until in [*cuts, "2100-01-01"]:
        new = bars.where(F.col("date").between(since, until))
        before = store.read() if store.versions() else None
        reach = F.date_sub(F.lit(since).cast("date"), 30)
        store.upsert(live.advance(before, new, dims, indices.where(F.col("date") >= reach), vix.where(F.col("date") >= reach)))
        since = (datetime.date.fromisoformat(until) + datetime.timedelta(1)).isoformat()
    panel = tech.technical_features(bars, dims, indices, vix)
    want = last_rows(tech.latest_per_symbol(panel))
    same(last_rows(live.live_base(store.read())), want)
    # a day that is fed again changes nothing
    again = live.advance(store.read(), bars.where("date >= '2001-10-25'"), dims, indices, vix)
    assert again.count() == 0
    state = store.read().toPandas()
    assert state["closes"].map(len).max() <= live.CLOSES and state["volumes"].map(len).max() <= live.VOLUMES


def test_first_volume_ends_the_constant_ratio():
    days = pd.DataFrame({"date": [datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(300)]})
    days["close"] = [100 + (i * 37 % 11) for i in range(300)]
    days[["sector_ret_5d", "spy_ret_5d", "vix"]] = 0.1, 0.2, 20.0
    days["volume"] = float("nan")
    state = live._advanced(None, days.iloc[:299])
    assert state["row"][4] == 1.0 and state["row_date"] == days["date"][298]
    days.loc[299, "volume"] = 5.0
    assert live._advanced(state, days.iloc[299:].reset_index(drop=True))["row"] is None
    short = live._advanced(None, days.iloc[:200])
    assert short["row"] is None and short["n_closes"] == 200


def test_side_features_and_defaults(spark, market):
    bars, dims, indices, vix = market
    state = live.advance(None, bars, dims, indices, vix)
    some = state.orderBy("symbol").first()["symbol"]
    reports = spark.createDataFrame([(some, datetime.date(2001, 10, 20), 0.2), (some, datetime.date(2002, 1, 1), 0.9)], "symbol string, report_date date, surprise double")
    trends = spark.createDataFrame([(some, datetime.date(2001, 10, 22), 2.0, 1.6, 1.0)], "symbol string, week date, gtrends_interest double, gtrends_spike_ratio double, gtrends_spike_flag double")
    got = last_rows(live.live_features(state, reports, trends, None, "2001-11-04"))
    assert got[some]["earnings_surprise_pct"] == 0.2 and 0 < got[some]["pead_signal"] <= 1 and got[some]["gtrends_spike_flag"] == 1.0
    other = next(s for s in got if s != some)
    assert [got[other][c] for c in tech.SIDE_FEATURES] == list(tech.SIDE_FEATURES.values())
    bare = live.live_features(state, None, None, None, "2001-11-04")
    assert bare.columns == ["symbol", "date", *tech.FEATURES] and bare.count() == len(got)


def plain(series, alpha):
    mean, out = None, []
    for x in series:
        mean = x if mean is None else alpha * x + (1 - alpha) * mean
        out.append(mean)
    return out


def test_series_are_stepped_side_by_side_and_batches_may_end_anywhere(monkeypatch):
    """Series of any length, without closes, without new bars or without an old state, in batches of 50 rows: as each one alone."""
    rng = np.random.default_rng(3)
    names = sorted(f"S{i}" for i in range(12))
    lengths = dict(zip(names, [300, 1, 2, 280, 0, 400, 60, 254, 253, 3, 310, 255]))
    first = datetime.date(2000, 1, 1)
    whole = {}
    for s, n in lengths.items():
        day = pd.DataFrame({"date": [first + datetime.timedelta(i) for i in range(n)], "close": 50 + rng.random(n), "volume": rng.integers(1, 9, n).astype(float)})
        day.loc[day.index % 17 == 5, "close"] = np.nan
        day.loc[day.index % 13 == 4, "volume"] = np.nan
        day[live.OUTER] = rng.random((n, 3))
        day.loc[day.index > n - 4, "vix"] = np.nan
        whole[s] = day
    whole["S1"]["close"] = np.nan

    def fed(parts, states):
        tables = []
        for s in names:
            if s in states:
                old = dict(states[s]) | {c: states[s][c] and (states[s][c] - datetime.date(1970, 1, 1)).days for c in ("seen", "row_date")}
                tables.append(pd.DataFrame({"symbol": [s], "_old": [json.dumps(old)]}))
            tables.append(parts[s].assign(symbol=s, _old=None))
        kinds = {"symbol": pa.string(), "date": pa.date32(), "close": pa.float64(), "volume": pa.float64(), **dict.fromkeys(live.OUTER, pa.float64()), "_old": pa.string()}
        rows = pd.concat(tables)
        table = pa.table({c: pa.array([None if pd.isna(v) else v for v in rows[c]], t) for c, t in kinds.items()})
        out = [r for b in live._advanced_batches(table.to_batches(max_chunksize=37)) for r in b.to_pylist()]
        assert len(out) == len({r["symbol"] for r in out})
        return states | {r["symbol"]: r for r in out}

    monkeypatch.setattr(live, "ROWS", 50)
    states = fed({s: d.iloc[:-20] for s, d in whole.items()}, {})
    states = fed({s: d.iloc[-25:] for s, d in whole.items()}, states)  # five days of it are fed again
    assert set(states) == {s for s, n in lengths.items() if n}
    for s, got in states.items():
        close = whole[s]["close"].dropna().tolist()
        move = np.diff(close)
        assert got["n_closes"] == len(close) and got["closes"] == close[-live.CLOSES :]
        assert got["volumes"] == whole[s]["volume"].dropna().tolist()[-live.VOLUMES :] and got["seen"] == whole[s]["date"].iloc[-1]
        legs = {"ema12": (close, 2 / 13), "ema26": (close, 2 / 27), "gain": (move.clip(0), 1 / 14), "loss": ((-move).clip(0), 1 / 14)}
        for c, (series, alpha) in legs.items():
            assert got[c] == (pytest.approx(plain(series, alpha)[-1], rel=1e-12) if len(series) else None), (s, c)
        alone = live._advanced(None, whole[s])
        assert got["row_date"] == alone["row_date"] and (got["row"] == pytest.approx(alone["row"], rel=1e-12) if alone["row"] else got["row"] is None), s
        if got["row"]:
            assert got["row_date"] <= whole[s]["date"].iloc[-4] and got["row"][0] == pytest.approx(100 - 100 / (1 + gain_over_loss(whole[s], got["row_date"])), rel=1e-9)
    assert sum(got["row"] is not None for got in states.values()) >= 4


def gain_over_loss(days, until):
    move = np.diff(days[days["date"] <= until]["close"].dropna())
    return plain(move.clip(0), 1 / 14)[-1] / plain((-move).clip(0), 1 / 14)[-1]


def test_a_symbol_is_no_python_call_of_its_own(spark, market):
    """A day of a symbol took 20 to 30 ms, as a group of its own with two pandas frames; its rows come in batches of many symbols now."""
    bars, dims, indices, vix = market
    first = live.advance(None, bars.where("date < '2001-10-01'"), dims, indices, vix, 20)
    assert first.rdd.getNumPartitions() == 20
    state = spark.createDataFrame(first.collect(), live.STATE)
    for step in (first, live.advance(state, bars.where("date >= '2001-09-20'"), dims, indices, vix)):
        plan = step._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "GroupsIn" not in plan
    both = live.advance(state, bars.where("date >= '2001-09-20'"), dims, indices, vix)
    same(last_rows(live.live_base(both)), last_rows(live.live_base(live.advance(None, bars, dims, indices, vix))))
