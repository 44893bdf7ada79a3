"""Golden cases and properties of the operators."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.operators import evaluation as ev
from barloom.operators import events, hrp, insider, logs, macro, memory, news, pairs, portfolio, risk, universe
from barloom.operators import technical as tech
from barloom.sources import readers
from barloom.sources.dims import SECTORS, WATCHLIST, styles, watchlist

QUIET = settings(max_examples=6, deadline=None, phases=(Phase.explicit, Phase.generate), suppress_health_check=[HealthCheck.function_scoped_fixture])


# -- risk ----------------------------------------------------------------------

POSITIONS = [("AAPL", 150.0, 140.0, 10.0, 3.0, 5.0), ("NVDA", 100.0, 120.0, 5.0, 5.0, 10.0), ("JPM", 100.0, 101.0, 10.0, 2.0, 4.0)]
POSITION = "symbol string, entry_price double, current_price double, shares double, sl_pct double, tp_pct double"


def check(spark, rows, equity=50_000.0):
    return {r["symbol"]: r for r in risk.check_positions(spark.createDataFrame(rows, POSITION), equity, 50_000.0).collect()}


def test_position_actions(spark):
    got = check(spark, POSITIONS)
    assert {k: v["action"] for k, v in got.items()} == {"AAPL": "FORCE_SELL_SL", "NVDA": "FORCE_SELL_TP", "JPM": "HOLD"}
    assert got["AAPL"]["pnl_pct"] == pytest.approx(-6.6667, abs=1e-4) and got["AAPL"]["threshold_pct"] == 3.0
    assert got["JPM"]["reason"] == "Within bounds: PnL +1.0% | SL=-2.0% | TP=+4.0%"


def test_circuit_breaker_hits_every_position(spark):
    tiny = POSITIONS + [("V", 10.0, 10.0, 1.0, 2.0, 2.0)]
    assert set(v["action"] for v in check(spark, tiny, 47_500.0).values()) == {"FORCE_SELL_CIRCUIT"}
    assert len(check(spark, tiny, 47_500.0)) == 4


def test_small_positions_are_skipped_and_hard_limit_applies(spark):
    got = check(spark, [("A", 10.0, 10.0, 4.9, 2.0, 2.0), ("B", 100.0, 92.0, 10.0, 50.0, 50.0)])
    assert list(got) == ["B"] and got["B"]["reason"].startswith("HARD LIMIT") and got["B"]["threshold_pct"] == 8.0


def test_override_and_summary(spark):
    actions = risk.check_positions(spark.createDataFrame(POSITIONS, POSITION), 50_000.0, 50_000.0)
    w = spark.createDataFrame([("AAPL", 0.1), ("JPM", 0.2), ("V", 0.0)], "symbol string, weight double")
    assert [r["symbol"] for r in risk.override_weights(w, actions).collect()] == ["JPM"]
    text = [r["line"] for r in risk.risk_summary(actions).orderBy("part", F.col("symbol").asc_nulls_first()).collect()]
    assert text[0] == "  [!] 2 RISK OVERRIDE(S):" and text[1].startswith("    [FORCE_SELL_SL] AAPL: ") and text[2].startswith("    [FORCE_SELL_TP] NVDA: ")
    assert text[3] == "  [OK] 1 position(s) within risk bounds" and text[4].startswith("    JPM: Within bounds")
    assert [r["line"] for r in risk.risk_summary(actions.where("false")).collect()] == ["  No positions to monitor."]


def test_volatility_floor_and_default(spark):
    dates = pd.bdate_range("2024-01-01", periods=15)
    rows = [("FLAT", d.date(), 100.0) for d in dates] + [("NEW", d.date(), 100.0 + i) for i, d in enumerate(dates[-5:])]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    vol = risk.daily_vol(bars, "2024-01-20")
    asked = spark.createDataFrame([("FLAT", "balanced"), ("NEW", "AGGRESSIVE"), ("NONE", "odd")], "symbol string, style string")
    got = {r["symbol"]: (r["style"], r["sl_pct"], r["tp_pct"]) for r in risk.risk_thresholds(asked, vol, styles(spark)).collect()}
    assert got == {"FLAT": ("balanced", 1.0, 1.25), "NEW": ("aggressive", 5.0, 6.0), "NONE": ("balanced", 4.0, 5.0)}


# -- portfolio -------------------------------------------------------------------


def test_rebalance_golden(spark):
    t = spark.createDataFrame([("p", "AAPL", 0.35), ("p", "NVDA", 0.15), ("p", "MSFT", 0.0)], "portfolio string, symbol string, weight double")
    h = spark.createDataFrame([("p", "RELIANCE", 50_000.0)], "portfolio string, symbol string, value double")
    e = spark.createDataFrame([("p", 1_000_000.0)], "portfolio string, equity double")
    got = [(r["seq"], r["side"], r["symbol"], r["notional"]) for r in portfolio.rebalance_orders(t, h, e).orderBy("seq").collect()]
    assert got == [(1, "SELL", "RELIANCE", 49_750.0), (2, "BUY", "AAPL", 350_000.0), (3, "BUY", "NVDA", 150_000.0)]


def constrain_by_hand(weights):
    """Plain restatement of the constraint steps for one portfolio."""
    w = {}
    for s, text in weights.items():
        try:
            x = float(text)
        except ValueError:
            continue
        if s in SECTORS and not np.isnan(x) and min(max(x, 0.0), 0.15) > 0.005:
            w[s] = round(min(max(x, 0.0), 0.15), 4)
    totals = {k: sum(v for s, v in w.items() if SECTORS[s] == k) for k in set(SECTORS.values())}
    w = {s: round(v * (0.35 / totals[SECTORS[s]]), 4) if round(totals[SECTORS[s]], 6) > 0.35 else v for s, v in w.items()}
    total = sum(w.values())
    if round(total, 6) > 1:
        w = {s: round(v * (1 / total), 4) for s, v in w.items()}
    return dict(sorted(w.items(), key=lambda kv: (-kv[1], kv[0]))[:10])


NAME = st.sampled_from(WATCHLIST + ["FAKE", "HALU"])
WEIGHT = st.one_of(st.floats(-0.2, 0.6).map(lambda x: f"{x:.6f}"), st.sampled_from(["nan", "abc", "inf", "", "0.15"]))


@QUIET
@given(st.lists(st.dictionaries(NAME, WEIGHT, min_size=1, max_size=15), min_size=5, max_size=10))
def test_constraints_hold_and_match_hand_computation(spark, books):
    rows = [(i, s, w) for i, book in enumerate(books) for s, w in book.items()]
    raw = spark.createDataFrame(rows, "run_date int, symbol string, weight string")
    out = portfolio.apply_constraints(raw, watchlist(spark)).toPandas()
    for i, book in enumerate(books):
        part = out[out["run_date"] == i]
        got, want = dict(zip(part["symbol"], part["weight"])), constrain_by_hand(book)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1.01e-4 for s in got)
        # every weight is rounded to four digits after scaling, so a sum can be off by 5e-5 per name
        assert (part["weight"] <= 0.15).all() and part["weight"].sum() <= 1 + 10 * 5e-5 + 1e-9 and len(part) <= 10
        assert (part.groupby("sector")["weight"].sum() <= 0.3503).all()
        if len(part):
            assert part["cash_reserve"].iloc[0] == pytest.approx(1 - part["weight"].sum(), abs=1e-4)


def test_merge_never_exceeds_one_after_overlays(spark):
    base = spark.createDataFrame([(1, "A", 0.7), (1, "B", 0.3), (2, "A", 0.2)], "run_date int, symbol string, weight double")
    fallback = spark.createDataFrame([(3, "C", 1.0), (2, "C", 1.0)], "run_date int, symbol string, weight double")
    deltas = spark.createDataFrame([(1, "B", 0.25)], "run_date int, symbol string, weight double")
    mult = spark.createDataFrame([(2, 0.7), (3, 1.0)], "run_date int, equity_mult double")
    got = {(r["run_date"], r["symbol"]): r["weight"] for r in portfolio.merge_weights(base, fallback, deltas, None, mult).collect()}
    assert got[(1, "A")] == pytest.approx(0.56) and got[(1, "B")] == pytest.approx(0.44)
    assert got[(2, "A")] == pytest.approx(0.14) and (2, "C") not in got and got[(3, "C")] == 1.0


def test_snapshot_keeps_first_starting_equity(spark):
    w = spark.createDataFrame([("A", 0.5), ("B", 0.0), ("C", 0.1)], "symbol string, weight double")
    px = spark.createDataFrame([("A", 30.0)], "symbol string, close double")
    prev = spark.createDataFrame([(90_000.0,)], "starting_equity double")
    pos, account = portfolio.snapshot_positions(w, px, 100_000.0, "2024-01-02", prev)
    assert [(r["symbol"], r["shares"]) for r in pos.collect()] == [("A", 1666.67)]
    assert account.first()["starting_equity"] == 90_000.0
    assert portfolio.snapshot_positions(w, px, 100_000.0, "2024-01-02")[1].first()["starting_equity"] == 100_000.0


# -- macro, universe -----------------------------------------------------------------


def test_macro_ladder(spark):
    cases = {
        (15.0, 1.0, 0.0): "risk_on", (22.0, 1.0, 0.0): "risk_on", (22.0, -0.1, 0.0): "neutral", (29.0, 1.0, 0.0): "risk_off",
        (20.0, 0.0, -0.02): "risk_on", (28.0, -0.5, -0.02): "neutral", (15.0, -0.5, -0.04): "neutral", (15.0, -0.51, 0.0): "risk_off",
    }
    df = spark.createDataFrame(list(cases), "vix double, yield_spread double, credit_spread double")
    got = {(r["vix"], r["yield_spread"], r["credit_spread"]): (r["regime"], r["equity_mult"]) for r in macro.regime_columns(df).collect()}
    mult = {"risk_on": 1.0, "neutral": 0.7, "risk_off": 0.4}
    assert got == {k: (v, mult[v]) for k, v in cases.items()}


def test_macro_defaults_without_series(spark):
    empty = spark.createDataFrame([], "symbol string, date date, close double")
    r = macro.macro_regime(empty, "2024-01-01").first()
    assert (r["regime"], r["equity_mult"], r["vix"], r["yield_spread"], list(r["signals"])) == ("neutral", 0.7, 20.0, 0.0, ["default_neutral"])
    one = spark.createDataFrame([("VIX", "2023-12-30", 15.0)], "symbol string, date string, close double")
    r = macro.macro_regime(one, "2024-01-01").first()
    assert (r["regime"], r["vix"], r["yield_spread"]) == ("risk_on", 15.0, -0.5)


def test_screen_falls_back_to_given_list(spark):
    bars = spark.createDataFrame([("A", "2024-01-01", 1.0, 1.0)], "symbol string, date string, close double, volume double")
    out = universe.screen_universe(bars, fallback=watchlist(spark)).orderBy("rank").collect()
    assert [r["symbol"] for r in out] == WATCHLIST


def test_unknown_volume_passes_the_liquidity_filter(spark):
    dates = pd.bdate_range("2022-01-03", periods=260)
    rows = [("UP", d.date(), 100.0 + i, None) for i, d in enumerate(dates)] + [("THIN", d.date(), 100.0 + i, 1.0) for i, d in enumerate(dates)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double, volume double")
    assert [r["symbol"] for r in universe.candidates(bars).collect()] == ["UP"]


# -- technical ------------------------------------------------------------------------


def test_rsi_forms_on_a_rising_series(spark):
    dates = pd.bdate_range("2024-01-01", periods=30)
    bars = spark.createDataFrame([("UP", d.date(), 100.0 + i, 10.0) for i, d in enumerate(dates)], "symbol string, date date, close double, volume double")
    snap = tech.technical_snapshot(bars, "2024-02-15").first()
    assert snap["rsi_14"] == 100.0 and snap["new_20d_high"] and not snap["new_20d_low"] and snap["dist_to_20d_high_pct"] == 0.0
    assert tech.technical_snapshot(bars, "2024-01-20").count() == 0


def test_feature_panel_against_pandas(spark):
    rng = np.random.default_rng(11)
    dates = pd.bdate_range("2020-01-01", periods=320)
    frames = [pd.DataFrame({"symbol": s, "date": dates, "close": 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 320))), "volume": rng.integers(1, 9, 320) * 1.0}) for s in ("A", "B")]
    frames.append(frames[0].iloc[:200].assign(symbol="SHORT"))
    pdf = pd.concat(frames)
    idx = pd.DataFrame({"index": "MKT", "date": dates, "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 320)))})
    day = lambda f: spark.createDataFrame(f.assign(date=f["date"].dt.date))
    dims = spark.createDataFrame([("A", "Tech"), ("B", "Tech")], "symbol string, sector string")
    got = tech.technical_features(day(pdf), dims, day(idx), None).toPandas()
    assert set(got["symbol"]) == {"A", "B"} and len(got) == 2 * (320 - 252) and (got["vix"] == 20).all()

    f = frames[1].set_index("date")
    c, v = f["close"], f["volume"]
    mkt = idx.set_index("date")["close"]
    d = c.diff()
    gain, loss = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    m20, s20 = c.rolling(20).mean(), c.rolling(20).std()
    rel = c.pct_change(5).shift(-5) - mkt.pct_change(5).shift(-5)
    want = pd.DataFrame(
        {
            "rsi": 100 - 100 / (1 + gain / loss), "macd_hist": macd - macd.ewm(span=9, adjust=False).mean(), "bb_pos": (c - (m20 - 2 * s20)) / (4 * s20 + 1e-9),
            "atr_pct": d.abs().rolling(14).mean() / c, "volume_ratio": v / v.rolling(20).mean(), "ret_63d": c.pct_change(63),
            "momentum_12_1": c.pct_change(252) - c.pct_change(21), "price_vs_sma200": c / c.rolling(200).mean() - 1, "sector_ret_5d": mkt.pct_change(5), "rel_fwd_ret": rel,
        }
    ).dropna(subset=["momentum_12_1"])
    mine = got[got["symbol"] == "B"].sort_values("date").set_index(pd.DatetimeIndex(got[got["symbol"] == "B"].sort_values("date")["date"]))
    for col in want:
        assert np.allclose(mine[col], want[col], rtol=1e-9, equal_nan=True), col
    assert (mine["label"] == (want["rel_fwd_ret"] > 0).astype(int).to_numpy()).all()
    assert (mine["label"].tail(5) == 0).all() and mine["fwd_ret"].tail(5).isna().all()


# -- pairs and risk parity ----------------------------------------------------------------


def test_pair_blocks_cover_every_pair_once(spark):
    rng = np.random.default_rng(2)
    names = [f"S{i}" for i in range(13)]
    dates = pd.bdate_range("2024-01-01", periods=40)
    wide = pd.DataFrame(rng.normal(0, 1, (40, 13)), index=dates, columns=names)
    wide.iloc[::3, 4] = np.nan
    long = wide.stack().rename("x").reset_index().set_axis(["date", "symbol", "x"], axis=1).dropna()
    df = spark.createDataFrame(long.assign(date=long["date"].dt.date))
    for blocks in (1, 2, 5):
        got = pairs.pair_moments(df, "x", blocks).toPandas()
        assert sorted(zip(got["symbol1"], got["symbol2"])) == sorted(tuple(sorted(p)) for p in itertools.combinations(names, 2))
        for r in got.itertuples():
            both = wide[[r.symbol1, r.symbol2]].dropna()
            assert r.n == len(both) and r.cov == pytest.approx(both.cov().iloc[0, 1], abs=1e-12)
            assert r.slope == pytest.approx(np.polyfit(both[r.symbol2], both[r.symbol1], 1)[0], abs=1e-10)


def test_cointegration_separates_related_from_unrelated():
    rng = np.random.default_rng(9)
    hits = misses = 0
    for _ in range(40):
        base = np.cumsum(rng.normal(0, 1, 250)) + 100
        other = np.cumsum(rng.normal(0, 1, 250)) + 100
        hits += pairs.engle_granger(2 * base + rng.normal(0, 1, 250), base)[1] < 0.05
        misses += pairs.engle_granger(other, base)[1] < 0.05
    assert hits == 40 and misses <= 8


def test_pvalue_at_published_critical_values():
    for tau, p in ((-3.8964, 0.01), (-3.3361, 0.05), (-3.0445, 0.10)):
        assert pairs.normal_cdf(sum(c * tau**i for i, c in enumerate(pairs.TAU_SMALL))) == pytest.approx(p, rel=0.05)


def ward_by_definition(points):
    """Merge the two clusters whose union adds least to the within-cluster sum of squares."""
    n, clusters, next_id = len(points), {i: [i] for i in range(len(points))}, len(points)
    while len(clusters) > 1:
        best = min(
            itertools.combinations(sorted(clusters), 2),
            key=lambda ab: len(clusters[ab[0]]) * len(clusters[ab[1]]) / (len(clusters[ab[0]]) + len(clusters[ab[1]]))
            * ((points[clusters[ab[0]]].mean(0) - points[clusters[ab[1]]].mean(0)) ** 2).sum(),
        )
        clusters[next_id] = clusters.pop(best[0]) + clusters.pop(best[1])
        next_id += 1
    return next(iter(clusters.values()))


def test_ward_order_on_euclidean_points():
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 15):
        pts = rng.normal(0, 1, (n, 4))
        dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
        assert hrp.ward_order(dist) == ward_by_definition(pts)


def test_two_asset_risk_parity_is_inverse_variance():
    rng = np.random.default_rng(6)
    r = rng.normal(0, [0.01, 0.03], (300, 2))
    var = np.var(r, axis=0, ddof=1)
    assert hrp.risk_parity(r) == pytest.approx((1 / var) / (1 / var).sum())


def test_hrp_weights_per_run(spark):
    rng = np.random.default_rng(8)
    dates = pd.bdate_range("2022-01-03", periods=300)
    rows = [(s, d.date(), float(p)) for k, s in enumerate("ABCD") for d, p in zip(dates, 50 * np.exp(np.cumsum(rng.normal(0, 0.01 * (k + 1), 300))))]
    rows += [("NEW", d.date(), 10.0 + i % 3) for i, d in enumerate(dates[-50:])]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    runs = spark.createDataFrame([(dates[-1].date(),), (dates[20].date(),)], "run_date date")
    out = hrp.hrp_weights(hrp.lookback_windows(bars, runs)).toPandas()
    late = out[out["run_date"] == dates[-1].date()].set_index("symbol")["weight"]
    assert late["NEW"] == 0 and late.sum() == pytest.approx(1) and (late >= 0).all() and late["A"] > late["D"]
    early = out[out["run_date"] == dates[20].date()]["weight"]
    assert early.to_list() == [0.25] * 4


# -- logs ------------------------------------------------------------------------------

N_, T_, F_ = logs.PER_STOCK


def log_of(spark, agents):
    rows = [("d", "2024-01-01", i, a, '{"ticker":"X"}', f"t{i:03d}") for i, a in enumerate(agents)]
    return spark.createDataFrame(rows, "desk string, run_date string, seq long, agent string, data string, ts string")


def test_log_blocks_golden(spark):
    agents = [N_, T_, F_] * 5 + [N_, T_] + [N_, T_, F_] * 9
    log = log_of(spark, agents)
    blocks = logs.reconstruct_blocks(log)
    a = {r["block"]: r for r in logs.block_analyses(blocks, watchlist(spark)).collect()}
    assert len(agents) == 44 and len(a) == 15 and sum(r["complete"] for r in a.values()) == 14
    assert not a[6]["complete"] and a[7]["symbol"] == WATCHLIST[6]
    s = logs.run_status(log, blocks, watchlist(spark)).first()
    assert (s["phase1_complete"], s["phase2_complete"], s["phase3_complete"]) == (True, False, False)
    assert (s["stocks_analyzed"], s["stocks_complete"], s["total_entries"], s["last_updated"], s["cash_reserve"]) == (15, 14, 44, "t043", 1.0)


def consume(agents, names=15):
    """Direct statement of the block rule: news at a later slot, or three entries, ends a block."""
    out, i = [], 0
    for block in range(1, names + 1):
        taken = 0
        while i < len(agents) and taken < 3 and not (agents[i] == N_ and taken > 0):
            out.append(block)
            i, taken = i + 1, taken + 1
    return out


@QUIET
@given(st.lists(st.lists(st.sampled_from([N_, T_, F_]), min_size=0, max_size=60), min_size=8, max_size=15))
def test_log_blocks_match_direct_rule(spark, many):
    rows = [(str(k), "2024-01-01", i, a, "{}", "") for k, agents in enumerate(many) for i, a in enumerate(agents)]
    log = spark.createDataFrame(rows, "desk string, run_date string, seq long, agent string, data string, ts string")
    got = logs.reconstruct_blocks(log).orderBy("desk", "seq").toPandas()
    for k, agents in enumerate(many):
        assert got.loc[got["desk"] == str(k), "block"].to_list() == consume(agents)


def test_zero_state(spark):
    status = logs.run_status(log_of(spark, [N_]), logs.reconstruct_blocks(log_of(spark, [N_])), watchlist(spark))
    asked = spark.createDataFrame([("d", "2024-01-01"), ("d", "2024-01-02")], "desk string, run_date string")
    got = {r["run_date"]: r for r in logs.status_or_zero(asked, status).collect()}
    assert got["2024-01-01"]["phase1_complete"] and not got["2024-01-02"]["phase1_complete"] and got["2024-01-02"]["stocks_total"] == 15


# -- news, events, memory, evaluation ---------------------------------------------------------


def test_sentiment_theme_belongs_to_most_confident_headline(spark):
    rows = [("A", 1, "first", "positive", 0.6), ("A", 2, "second", "negative", 0.9), ("A", 3, "third", "neutral", 0.9)]
    r = news.aggregate_sentiment(spark.createDataFrame(rows, "symbol string, seq long, headline string, label string, score double")).first()
    assert (r["key_theme"], r["sentiment_score"], r["confidence"]) == ("second", round((0.36 - 0.81) / 2.4, 3), 0.8)


def test_callers_classifier(spark):
    @F.pandas_udf("label string, score double")
    def scorer(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"label": np.where(text.str.contains("up"), "positive", "neutral"), "score": np.where(text == "", np.nan, 0.8)})

    rows = spark.createDataFrame([("A", 1, "up"), ("A", 2, "flat"), ("A", 3, "")], "symbol string, seq long, headline string")
    scored = news.score_headlines(rows.where("headline <> ''"), scorer)
    r = news.aggregate_sentiment(scored).first()
    assert (r["sentiment_score"], r["confidence"], r["key_theme"]) == (0.4, 0.8, "up")


def test_fundamental_fallback_is_clamped(spark):
    from barloom.operators import factors

    flat = [("A", 50, ""), ("B", 50, "cheap"), ("C", 61, ""), ("D", 50, "")]
    scores = spark.createDataFrame(flat, "symbol string, health_score int, key_strength string").withColumn("key_risk", F.lit(""))
    other = spark.createDataFrame([("A", "172.5", "s", "r"), ("D", "junk", "s", "r")], "symbol string, health_score string, key_strength string, key_risk string")
    got = {r["symbol"]: (r["health_score"], r["origin"]) for r in factors.fundamental_select(scores, other).collect()}
    assert got == {"A": (100, "fallback"), "B": (50, "factors"), "C": (61, "factors"), "D": (50, "fallback")}


def test_news_scan_is_limited_before_dedup(spark):
    rows = [("A", i, "same" if i < 14 else f"h{i}", "x" * 300, None) for i in range(30)]
    out = news.dedup_news(spark.createDataFrame(rows, "symbol string, seq long, headline string, summary string, source string")).collect()
    assert [r["headline"] for r in out] == ["same", "h14"] and len(out[0]["summary"]) == 200


def test_event_allocations_are_scaled_in_total(spark):
    beats = spark.createDataFrame([(f"S{i}", 0.2 + i / 10, 5, 0.08, "beat") for i in range(7)], "symbol string, surprise_pct double, days_since_earnings int, allocation double, reason string")
    cl = spark.createDataFrame([("S6", 3, 1e5, 0.05, "cluster"), ("Z", 2, 1e4, 0.05, "cluster")], "symbol string, n_insiders long, total_value double, allocation double, reason string")
    out = {r["symbol"]: r for r in events.event_signals(beats, cl).collect()}
    assert set(out) == {"S2", "S3", "S4", "S5", "S6", "Z"} and list(out["S6"]["events"]) == ["PEAD", "INSIDER_CLUSTER"]
    assert sum(r["total_allocation"] for r in out.values()) == pytest.approx(0.35, abs=3e-4)


def test_metrics_against_direct_formulas(spark):
    rng = np.random.default_rng(1)
    n = 500
    pdf = pd.DataFrame({"date": rng.integers(0, 40, n), "symbol": [f"s{i}" for i in range(n)], "proba": rng.integers(0, 50, n) / 50, "fwd_ret": rng.normal(0, 1, n)})
    pdf["label"] = (pdf["fwd_ret"] + pdf["proba"] > 0.4).astype(int)
    pdf["pred"] = (pdf["proba"] > 0.5).astype(int)
    df = spark.createDataFrame(pdf)
    p, q = pdf[pdf["label"] == 1]["proba"].to_numpy(), pdf[pdf["label"] == 0]["proba"].to_numpy()
    auc = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    assert ev.roc_auc(df).first()["auc"] == pytest.approx(auc)
    ic = np.corrcoef(pdf["proba"].rank(), pdf["fwd_ret"].rank())[0, 1]
    assert ev.rank_ic(df).first()["ic"] == pytest.approx(ic)
    top = pdf.sort_values(["proba", "symbol"], ascending=[False, True]).groupby("date").head(5).groupby("date")["label"].agg(["mean", "size"])
    assert ev.precision_at_top(df).first()["p_at_k"] == pytest.approx(top[top["size"] >= 2]["mean"].mean())
    one = df.withColumn("label", F.lit(1)).withColumn("split", F.lit("x"))
    r = ev.split_metrics(one, spark.createDataFrame([("s", 7)], "split string, n_train long")).first()
    assert (r["auc"], r["ic"], r["n_test"]) == (0.5, 0.0, n)


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, version int, doc string")
    new = spark.createDataFrame([("a", 2, "z")], "id string, version int, doc string")
    assert {(r["id"], r["doc"]) for r in memory.upsert(old, new).collect()} == {("a", "z"), ("b", "y")}


def test_lsh_finds_the_exact_neighbour(spark, sf_dir):
    from barloom.sources.tables import Tables
    from pyspark.ml.linalg import Vectors

    store = Tables(spark, sf_dir).decisions()
    vec = np.array(store.where("id = 3").first()["embedding"])
    near = memory.similar_decisions_lsh(store, Vectors.dense(vec / np.linalg.norm(vec)), k=1, width=2.0).first()
    assert near["id"] == 3 and near["distance"] == pytest.approx(0, abs=1e-6)
    exact = memory.similar_decisions(store, store.where("id = 3"), 5)
    assert exact.first()["id"] == 3 and exact.count() == min(5, store.count())


def test_screen_forgets_dead_names(spark):
    live = [("LIVE", d.date(), 100.0 + i * 0.1, 1e9) for i, d in enumerate(pd.bdate_range("2000-06-01", periods=300))]
    dead = [("DEAD", d.date(), 100.0 + i, 1e9) for i, d in enumerate(pd.bdate_range("1996-01-01", periods=300))]
    bars = spark.createDataFrame(live + dead, "symbol string, date date, close double, volume double")
    asof = str(live[-1][1])
    assert [r["symbol"] for r in universe.screen_universe(bars, asof=asof).collect()] == ["LIVE"]
    assert {r["symbol"] for r in universe.screen_universe(bars).collect()} == {"LIVE", "DEAD"}


def test_insider_without_optional_columns(spark):
    raw = spark.createDataFrame([("A", "Purchase", "2024-01-20", "x", "5"), ("A", "Purchase", "2024-01-21", "x", "5"), ("A", "Sale", "2024-01-22", "y", "5")], "symbol string, transaction string, `start date` string, insider string, value string")
    score = lambda df: insider.insider_signal(readers.read_insider_tx(df), "2024-01-31").first()
    assert score(raw)["purchase_ratio"] == 0.0  # two purchases below the least value
    assert (score(raw.drop("value"))["purchase_ratio"], score(raw.drop("value"))["n_insiders"]) == (0.667, 1)
    assert score(raw.drop("value", "insider"))["n_insiders"] == 2
    assert score(raw.drop("value", "start date"))["purchase_ratio"] == 0.667
    cluster = lambda df: events.insider_cluster(readers.read_insider_tx(df), "2024-01-31").count()
    assert (cluster(raw), cluster(raw.drop("insider")), cluster(raw.drop("insider", "start date"))) == (0, 1, 0)


def test_point_in_time_score_matches_counting(spark):
    rng = np.random.default_rng(8)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(int(x)) for x in rng.integers(0, 300, 250)]
    rows = [(f"S{i % 3}", d, rng.choice(["Purchase", "Sale", "Gift"]), f"I{rng.integers(0, 6)}", rng.choice(["20000", "5"])) for i, d in enumerate(days)]
    tx = spark.createDataFrame(rows, "symbol string, tx_date date, text string, insider string, value string")
    panel = spark.createDataFrame([(f"S{k}", datetime.date(2024, 1, 1) + datetime.timedelta(n), n) for k in range(4) for n in range(0, 420, 3)], "symbol string, date date, extra int")
    got = insider.point_in_time_score(panel, tx).collect()
    assert len(got) == panel.count()
    for r in got:
        seen = [x for x in rows if x[0] == r["symbol"] and datetime.timedelta(0) <= r["date"] - x[1] <= datetime.timedelta(90)]
        buys = [x for x in seen if x[2] == "Purchase" and x[4] == "20000"]
        sells = [x for x in seen if x[2] == "Sale"]
        share = len(buys) / (len(buys) + len(sells)) if buys or sells else 0.0
        assert r["insider_score"] == round(share * share * 0.6 + min(len({x[3] for x in buys}) / 5, 1) * 0.4, 3)


def test_hrp_counts_names_without_closes(spark):
    days = pd.bdate_range("2020-01-01", periods=260)
    rng = np.random.default_rng(4)
    rows = [(s, d.date(), float(p)) for s in ("A", "B", "C") for d, p in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 260))))]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    run = days[-1].date()
    windows = hrp.lookback_windows(bars, spark.createDataFrame([(run,)], "run_date date"))
    names = spark.createDataFrame([(run, s) for s in ("A", "B", "C", "GONE")], "run_date date, symbol string")
    got = {r["symbol"]: r["weight"] for r in hrp.hrp_weights(windows, names=names).collect()}
    assert got["GONE"] == 0.0 and sum(got.values()) == pytest.approx(1) and min(got[s] for s in "ABC") > 0
    few = {r["symbol"]: r["weight"] for r in hrp.hrp_weights(windows.where("symbol = 'A'"), names=names).collect()}
    assert few == dict.fromkeys(["A", "B", "C", "GONE"], 0.25)
