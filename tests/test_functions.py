"""Numeric helpers and series functions against Python and pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import numeric as N
from barloom.functions import ranking
from barloom.functions import series as S
from barloom.functions.alignment import Facts, asof_backward, asof_many, fill_on_calendar
from barloom.functions.ranking import average_rank, positional_split, with_median
from barloom.functions.text import is_buy, is_sell, json_body

QUIET = settings(max_examples=8, deadline=None, phases=(Phase.explicit, Phase.generate), suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, name="x"):
    return spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], f"i long, {name} double")


@QUIET
@given(st.lists(st.one_of(st.floats(-1e9, 1e9), st.integers(-(10**6), 10**6).map(lambda k: k / 2000), st.decimals(-100, 100, places=5).map(float)), min_size=200, max_size=400))
def test_py_round_is_correct_rounding(spark, values):
    df = column(spark, values).select("i", "x", *[N.py_round("x", d).alias(f"r{d}") for d in range(5)])
    for r in df.collect():
        for d in range(5):
            assert r[f"r{d}"] == round(r["x"], d), (r["x"], d)


def test_rounding_of_known_ties(spark):
    got = [r[0] for r in column(spark, [0.285, 2.675, 0.0625, 1.0625, 0.5, 1.5]).select(N.py_round("x", 2)).collect()]
    assert got == [round(x, 2) for x in [0.285, 2.675, 0.0625, 1.0625, 0.5, 1.5]]


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(N.finite("x")).collect()] == [None, None, None, 2.0]
    assert [r[0] for r in df.select(N.clip(N.finite("x"), 0, 1)).collect()] == [None, None, None, 1.0]
    assert [r[0] for r in df.select(N.sigmoid100("x", 2.0, 1.0)).collect()] == [50.0, 50.0, 50.0, 50.0]
    assert spark.range(1).select(N.ratio(F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_text_masks(spark):
    df = spark.createDataFrame([("Purchase at price",), ("Sale and BUYback",), (None,), ("Gift",)], "t string")
    rows = df.select(is_buy(F.col("t")), is_sell(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (True, True), (False, False), (False, False)]


def test_json_body(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        'ok\n```json\n{"a": {"b": 2}}\n```\nbye': '{"a": {"b": 2}}',
        '```\n{"a": 3}\n```': '{"a": 3}',
        'so {"a": {"b": 4}} there': '{"a": {"b": 4}}',
        "nothing here": None,
        "{broken": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", json_body(F.col("raw"))).collect()} == cases


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))


@pytest.fixture(scope="module")
def walks(spark):
    frames = [pd.DataFrame({"symbol": s, "date": pd.bdate_range("2000-01-03", periods=n).date, "close": walk(n, i)}) for i, (s, n) in enumerate([("A", 30), ("B", 999), ("C", 1001), ("D", 4300)])]
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("block", [None, 7, 100])
@pytest.mark.parametrize("alpha", [2 / 13, 0.01, 1 / 14, 0.9, 1.0])
def test_ewm_matches_recursion_over_block_restarts(walks, alpha, block):
    pdf, df = walks
    got = S.with_ewm(S.with_row_index(df), {"e": ("close", alpha)}, block=block).select("symbol", "date", "e").toPandas()
    want = pdf.assign(e=pdf.groupby("symbol")["close"].transform(lambda s: s.ewm(alpha=alpha, adjust=False).mean()))
    both = want.merge(got, on=["symbol", "date"])
    assert len(both) == len(pdf)
    assert np.allclose(both["e_x"], both["e_y"], rtol=1e-12)


def test_ewm_with_leading_null_seeds_on_first_value(walks):
    pdf, df = walks
    diff = df.withColumn("d", F.abs(F.col("close") - F.lag("close").over(S.series())))
    got = S.with_ewm(S.with_row_index(diff), {"e": ("d", 1 / 14)}).select("symbol", "date", "e").toPandas()
    want = pdf.assign(e=pdf.groupby("symbol")["close"].transform(lambda s: s.diff().abs().ewm(alpha=1 / 14, adjust=False).mean()))
    both = want.merge(got, on=["symbol", "date"]).sort_values(["symbol", "date"])
    assert both["e_y"].isna().sum() == 4
    assert np.allclose(both["e_x"], both["e_y"], rtol=1e-12, equal_nan=True)


def test_ewm_of_mixed_alphas_keeps_old_weight(walks):
    pdf, df = walks
    got = S.with_ewm(S.with_row_index(df), {"slow": ("close", 0.002), "fast": ("close", 0.95)}).select("symbol", "date", "slow", "fast").toPandas()
    both = pdf.merge(got, on=["symbol", "date"])
    for name, alpha in (("slow", 0.002), ("fast", 0.95)):
        want = pdf.groupby("symbol")["close"].transform(lambda s: s.ewm(alpha=alpha, adjust=False).mean())
        assert np.allclose(both[name], want, rtol=1e-11)


def test_ewm_starting_after_a_whole_block_of_nulls(walks):
    pdf, df = walks
    late = df.withColumn("x", F.when(F.col("date") >= F.lit("2001-01-01").cast("date"), F.col("close")))
    got = S.with_ewm(S.with_row_index(late), {"e": ("x", 0.1)}, block=20).select("symbol", "date", "e").toPandas()
    want = pdf.assign(x=pdf["close"].where(pd.to_datetime(pdf["date"]) >= "2001-01-01"))
    want["e"] = want.groupby("symbol")["x"].transform(lambda s: s.ewm(alpha=0.1, adjust=False).mean())
    both = want.merge(got, on=["symbol", "date"])
    assert np.allclose(both["e_x"], both["e_y"], rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("alpha", [0.0, -0.1, 1.5])
def test_ewm_refuses_what_is_no_mean(walks, alpha):
    with pytest.raises(ValueError):
        S.with_ewm(S.with_row_index(walks[1]), {"e": ("close", alpha)})


@pytest.mark.parametrize("n", [20, 200])
def test_prefix_mean(walks, n):
    pdf, df = walks
    got = df.select("*", *S.running_sum("close")).select("symbol", "date", S.prefix_mean(n).alias("m")).toPandas()
    want = pdf.assign(m=pdf.groupby("symbol")["close"].transform(lambda s: s.rolling(n).mean()))
    both = want.merge(got, on=["symbol", "date"])
    assert np.allclose(both["m_x"], both["m_y"], rtol=1e-10, equal_nan=True)


def test_asof_matches_pandas(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=200)
    probes = pd.DataFrame([(s, d) for s in "AB" for d in rng.choice(days, 60, replace=False)], columns=["symbol", "date"])
    facts = pd.DataFrame([(s, d, float(i)) for s in "AB" for i, d in enumerate(rng.choice(days, 25, replace=False))], columns=["symbol", "at", "v"])
    want = pd.merge_asof(probes.sort_values("date"), facts.sort_values("at"), left_on="date", right_on="at", by="symbol")
    sp, sfx = spark.createDataFrame(probes.assign(date=probes["date"].dt.date)), spark.createDataFrame(facts.assign(at=facts["at"].dt.date))
    got = {(r["symbol"], r["date"]): r["v"] for r in asof_backward(sp, sfx, ["v"], fact_time="at").collect()}
    for r in want.itertuples():
        v = got[(r.symbol, r.date.date())]
        assert v == r.v or (v is None and np.isnan(r.v))
    filled = asof_backward(sp, sfx, ["v"], fact_time="at", back_fill=True)
    assert filled.where("v is null").count() == 0


def test_later_fact_of_the_same_day_wins(spark):
    p = spark.createDataFrame([("A", "2020-01-05")], "symbol string, date string")
    f = spark.createDataFrame([("A", "2020-01-05", 2, 20.0), ("A", "2020-01-05", 1, 10.0)], "symbol string, date string, n int, v double")
    assert asof_backward(p, f, ["v"], fact_seq=F.col("n")).first()["v"] == 20.0


def test_fill_on_calendar(spark):
    rows = [("X", "2020-01-01", 1.0), ("X", "2020-01-03", 3.0), ("Y", "2020-01-02", 5.0)]
    df = spark.createDataFrame(rows, "k string, date string, v double").withColumn("date", F.col("date").cast("date"))
    got = {(r["k"], str(r["date"])): r["v"] for r in fill_on_calendar(df, df, "k", "v").collect()}
    assert got == {("X", "2020-01-01"): 1.0, ("X", "2020-01-02"): 1.0, ("X", "2020-01-03"): 3.0, ("Y", "2020-01-02"): 5.0, ("Y", "2020-01-03"): 5.0}


def test_average_rank_with_a_dominant_tie(spark):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(3000) < 0.35, 7.0, rng.integers(0, 200, 3000) / 4.0)
    got = {r["x"]: r["rank"] for r in average_rank(column(spark, values), "x").collect()}
    want = pd.Series(values).rank()
    assert all(got[v] == r for v, r in zip(values, want))


@pytest.mark.parametrize("n", [1, 7, 50, 333])
def test_positional_split_is_exact(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"date": rng.integers(0, 6, n), "symbol": [f"s{i:04d}" for i in rng.permutation(n)]})
    got = positional_split(spark.createDataFrame(pdf)).toPandas()
    order = pdf.sort_values(["date", "symbol"]).reset_index(drop=True)
    train = set(order["symbol"][: int(np.floor(n * 0.8))])
    assert set(got.loc[got["is_train"], "symbol"]) == train and len(got) == n


def test_median_from_counts(spark):
    rng = np.random.default_rng(6)
    rows = [(f"k{i % 5}", float(v) if v < 9 else None, int(n)) for i, (v, n) in enumerate(zip(rng.integers(0, 10, 200), rng.integers(0, 6, 200)))] + [("none", None, 3), ("zero", 1.0, 0)]
    counts = spark.createDataFrame(rows, "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = {r["k"]: r["median"] for r in with_median(counts, ["k"], "v", "n").collect()}
    for k in got:
        values = [v for a, v, n in rows if a == k and v is not None for _ in range(n)]
        assert got[k] == (np.median(values) if values else None)


def test_rounding_of_large_values(spark):
    values = [1e12 + 0.125, 1234567890123.4567, 9007199254740993.0, -7.5e14 - 0.5, 1e300, 2.0**53, 4503599627370495.5]
    for d in range(5):
        got = [r[0] for r in column(spark, values).orderBy("i").select(N.py_round("x", d)).collect()]
        assert got == [round(x, d) for x in values]


def test_ranges_of_a_value_take_few_comparisons(spark):
    """Many cut points, values on, between and beyond them, both zeros, NaN and null; steps of cut points are skipped."""
    edges = [float(x) for x in range(-60, 61, 3)]
    values = [*edges, *[e + 0.5 for e in edges], -0.0, float("nan"), float("inf"), -100.0, None]
    for cuts in ([], edges[:1], edges[:5], edges):
        df = ranking.slots(spark.createDataFrame([(v,) for v in values], "v double"), "v", (cuts, cuts[:2]))
        for r in df.collect():
            v = r["v"]
            if v is not None:
                assert r["_slot"] // 2 == (len(cuts) if v != v else sum(c < v for c in cuts))
                assert r["_slot"] % 2 == (v in cuts[:2])
    assert "slice" in df._jdf.queryExecution().toString()


def test_large_series_are_dealt_to_tasks_by_rows(spark):
    assert S.series_tasks(600_000) is None and S.series_tasks(6_000_000) == 60 and S.series_tasks(36_000_000) == 360
    rows = [(f"S{s}", datetime.date(2020, 1, 1) + datetime.timedelta(days=d), float(s + d)) for s in range(30) for d in range(4)]
    probes = spark.createDataFrame(rows, "symbol string, date date, close double")
    facts = Facts(probes.where("close % 3 = 0").select("symbol", "date", F.col("close").alias("x")), ["x"])
    plain, dealt = asof_many(probes, [facts]), asof_many(probes, [facts], tasks=40)
    assert dealt.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert S.dealt(probes, 40).rdd.getNumPartitions() == 40
