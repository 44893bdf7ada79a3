"""Live features from carried state: a new day costs one day, not a history.

The state of a symbol is one row: the ends of its exponential means, the tails of
closes and volumes that the longest window needs, counts, and its last complete
feature row. It is advanced by the bars after its last one and kept by symbol in a
:class:`~barloom.sources.snapshots.SnapshotStore`.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import py_round
from barloom.functions.series import dealt, span_alpha
from barloom.operators import earnings as pead
from barloom.operators.technical import BASE_FEATURES, FEATURES, MIN_FEATURE_ROWS, RETURN_ROWS, RSI_ALPHA, SIDE_FEATURES, SMA_ROWS, index_calendar, latest_per_symbol

CLOSES = max(*RETURN_ROWS, *SMA_ROWS) + 1  # the close itself and as many before it as any window reaches back
VOLUMES = 20
_MEANS = ("ema12", "ema26", "signal", "gain", "loss")
STATE = (
    "symbol string, seen date, closes array<double>, volumes array<double>, n_closes long, n_volumes long, "
    + ", ".join(f"{m} double" for m in _MEANS)
    + ", row_date date, row array<double>"
)
_ARROW = {"string": pa.string(), "date": pa.date32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in STATE.split(", "))])
OUTER = BASE_FEATURES[12:]
ROWS = 32_768  # bars and states that a task holds at a time, besides the rest of one series
NO_DAY = np.iinfo(np.int32).max  # a missing date comes last


def _means(x: np.ndarray, begin: np.ndarray, count: np.ndarray, old: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential means of many series, stepped side by side: series k is the ``count[k]`` values of ``x`` from ``begin[k]`` on.

    A mean goes on from ``old[k]``; where that is NaN it starts at its first value.
    """
    out = np.full(len(x), np.nan)
    order = np.argsort(-count, kind="stable")
    at, left, mean = begin[order], count[order], old[order]
    steps = np.arange(left[0] if len(left) else 0)
    for i, n in enumerate(np.searchsorted(-left, -steps).tolist()):  # the series that are longer than i come first
        here = at[:n] + i
        value = x[here]
        after = alpha * value + (1 - alpha) * mean[:n]
        mean[:n] = after if i else np.where(np.isnan(mean[:n]), value, after)
        out[here] = mean[:n]
    return out


def _over(a: float, b: float) -> float | None:
    return a / b if b else None


def price_row(closes: np.ndarray, means: Sequence[float | None], volume: float | None, volumes: Sequence[float], any_volume: bool) -> list[float] | None:
    """The first twelve base features at the last of ``closes``; None if one is missing.

    ``volumes`` are the last ones up to this bar, ``means`` the exponential means at it.
    """
    ema12, ema26, signal, gain, loss = means
    c, n = float(closes[-1]), len(closes)
    if n < CLOSES or gain is None or not loss:
        return None
    recent = closes[-20:]
    sma = {k: float(closes[-k:].mean()) for k in SMA_ROWS}
    std = float(recent.std(ddof=1))
    lag = {k: float(closes[-1 - k]) for k in RETURN_ROWS}
    if any_volume and (volume is None or len(volumes) < VOLUMES):
        return None
    ratio = _over(volume, float(np.mean(volumes))) if any_volume else 1.0
    ret = {k: _over(c, x) for k, x in lag.items()}
    atr = _over(float(np.abs(np.diff(closes[-15:])).mean()), c)
    side = [_over(c - m, m) for m in sma.values()]
    if None in (ratio, atr, *ret.values(), *side):
        return None
    ret = {k: x - 1 for k, x in ret.items()}
    strength = 100.0 - 100.0 / (1.0 + gain / loss)
    band = (c - (sma[20] - 2 * std)) / (4 * std + 1e-9)
    return [strength, (ema12 - ema26) - signal, band, atr, ratio, ret[5], ret[21], ret[63], ret[252] - ret[21], *side]


def _advanced(state: dict | None, bars: pd.DataFrame) -> dict:
    """The state after ``bars`` (date, close, volume, sector_ret_5d, spy_ret_5d, vix), ordered by date and all newer than it."""
    values = bars[["close", "volume", *OUTER]].to_numpy(float)
    return _all_advanced([state], np.array([len(bars)]), bars["date"].tolist(), values[:, 0], values[:, 1], values[:, 2:])[0]


def _all_advanced(states: Sequence[dict | None], rows: np.ndarray, dates: Sequence, close: np.ndarray, volume: np.ndarray, outer: np.ndarray) -> list[dict]:
    """The states of many series after their new bars, which lie one series after the other: ``rows[k]`` of series k, at least one, by date.

    Means are stepped bar by bar, for all series at once; features are only computed
    backwards from the end of a series, until a row is complete.
    """
    fresh = {"closes": [], "volumes": [], "n_closes": 0, "n_volumes": 0, "row_date": None, "row": None, **dict.fromkeys(_MEANS)}
    olds = [state or fresh for state in states]
    ends = np.cumsum(rows)
    lane = np.repeat(np.arange(len(olds)), rows)
    at, sold = np.flatnonzero(~np.isnan(close)), np.flatnonzero(~np.isnan(volume))
    x, own, kept_volumes = close[at], lane[at], volume[sold]
    n, m = np.bincount(own, minlength=len(olds)), np.bincount(lane[sold], minlength=len(olds))
    begin, begin_volume = np.cumsum(n) - n, np.cumsum(m) - m
    old = {c: np.array([np.nan if o[c] is None else o[c] for o in olds], float) for c in _MEANS}
    last = np.array([o["closes"][-1] if len(o["closes"]) else np.nan for o in olds], float)
    move = np.diff(x, prepend=np.nan)
    move[begin[n > 0]] = x[begin[n > 0]] - last[n > 0]
    first = ((n > 0) & np.isnan(last)).astype(int)  # the first close of all makes no move
    ema12, ema26 = _means(x, begin, n, old["ema12"], span_alpha(12)), _means(x, begin, n, old["ema26"], span_alpha(26))
    gain, loss = (_means(np.maximum(leg, 0.0), begin + first, n - first, old[c], RSI_ALPHA) for c, leg in (("gain", move), ("loss", -move)))
    means = np.column_stack([ema12, ema26, _means(ema12 - ema26, begin, n, old["signal"], span_alpha(9)), gain, loss])

    # what a complete row needs at least, for all bars with a close
    any_volume = np.array([o["n_volumes"] for o in olds]) + m > 0
    n_closes = np.arange(len(x)) - begin[own] + 1 + np.array([len(o["closes"]) for o in olds])[own]
    n_volumes = np.searchsorted(sold, at, side="right") - begin_volume[own] + np.array([len(o["volumes"]) for o in olds])[own]
    enough = (n_closes >= CLOSES) & (loss != 0) & ~np.isnan(outer[at]).any(axis=1)
    enough &= ~any_volume[own] | (~np.isnan(volume[at]) & (n_volumes >= VOLUMES))

    out = []
    for k, o in enumerate(olds):
        now, lo, hi = dict(o), begin[k], begin[k] + n[k]
        closes = np.concatenate([o["closes"], x[lo:hi]])
        volumes = np.concatenate([o["volumes"], kept_volumes[begin_volume[k] : begin_volume[k] + m[k]]])
        if any_volume[k] and not o["n_volumes"]:
            now["row_date"] = now["row"] = None  # it was complete only because the series had no volume at all
        for j in (lo + np.flatnonzero(enough[lo:hi])[::-1]).tolist():
            c, v = n_closes[j], n_volumes[j]
            sale = None if np.isnan(volume[at[j]]) else float(volume[at[j]])
            row = price_row(closes[max(0, c - CLOSES) : c], means[j].tolist(), sale, volumes[max(0, v - VOLUMES) : v], bool(any_volume[k]))
            if row is not None:
                now["row_date"], now["row"] = dates[at[j]], [*row, *outer[at[j]].tolist()]
                break
        if n[k]:
            now |= dict(zip(_MEANS, means[hi - 1].tolist()))
        now |= {"n_closes": o["n_closes"] + int(n[k]), "n_volumes": o["n_volumes"] + int(m[k])}
        out.append(now | {"seen": dates[ends[k] - 1], "closes": closes[-CLOSES:], "volumes": volumes[-VOLUMES:]})
    return out


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a series begins in rows by symbol."""
    symbols = rows["symbol"]
    return np.flatnonzero(np.concatenate([[True], pc.not_equal(symbols.slice(1), symbols.slice(0, len(symbols) - 1)).to_numpy()]))


def _states_after(rows: pa.Table) -> pa.RecordBatch:
    """States of whole series: of each its old state, if any, and then its bars by date. A series without newer bars has none."""
    starts = _starts(rows)
    lane = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rows)))
    names = rows["symbol"].take(pa.array(starts)).to_pylist()
    day = rows["date"].cast(pa.int32()).fill_null(NO_DAY).to_numpy()
    is_old = rows["_old"].is_valid().to_numpy()
    states, seen = [None] * len(names), np.full(len(names), np.iinfo(np.int64).min)
    for k, told in zip(lane[is_old].tolist(), rows["_old"].filter(pa.array(is_old)).to_pylist()):
        state = json.loads(told)
        state |= {c: np.array(state[c], float) for c in ("closes", "volumes")}
        state |= {c: None if state[c] is None else float(state[c]) for c in _MEANS}
        state["row"] = state["row"] and [float(x) for x in state["row"]]  # what is not finite comes as text
        states[k], seen[k] = state, NO_DAY if state["seen"] is None else state["seen"]
    new = ~is_old & (day > seen[lane])
    count = np.bincount(lane[new], minlength=len(names))
    have = np.flatnonzero(count).tolist()
    close, volume, *outer = (rows[c].cast(pa.float64()).fill_null(np.nan).to_numpy()[new] for c in ("close", "volume", *OUTER))
    dates = [None if d == NO_DAY else d for d in day[new].tolist()]
    after = _all_advanced([states[k] for k in have], count[have], dates, close, volume, np.column_stack(outer))
    for k, state in zip(have, after):
        state["symbol"] = names[k]
        state.update({c: None for c in _MEANS if state[c] is not None and np.isnan(state[c])})
    return pa.RecordBatch.from_pylist(after, _SCHEMA)


def _advanced_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States from rows by symbol, in which the old state of a series comes before its bars; a batch may end within a series."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(_starts(rows)[-1])
            if last:
                yield _states_after(rows.slice(0, last))
            held, n = rows.slice(last).to_batches(), len(rows) - last
    if n:
        yield _states_after(pa.Table.from_batches(held))


def advance(state: DataFrame | None, bars: DataFrame, dims: DataFrame, indices: DataFrame, vix: DataFrame | None, tasks: int | None = None) -> DataFrame:
    """States of the symbols that have bars after their last one; without ``state`` they start with their first bar.

    ``bars`` need to hold the new days only; what is not newer than the state is
    left out, so a day that is fed again changes nothing. ``indices`` (index, date,
    close) need the new days and enough before them for a five-row return. Bars and
    states are dealt to ``tasks`` by symbol, for large tables (:func:`series_tasks`),
    and a task takes them up in order, a bounded number of rows at a time.
    """
    calendar, known = index_calendar(indices, vix)
    bench = dims.select("symbol", "sector").join(known, F.col("sector") == F.col("_bench"), "left").select("symbol", F.coalesce("_bench", F.lit("MKT")).alias("bench"))
    days = bars.join(bench, "symbol").join(calendar, ["bench", "date"], "left").select("symbol", "date", "close", "volume", *OUTER)
    rows = days.withColumn("_old", F.lit(None).cast("string"))
    if state is not None:
        # as text, which costs a bar nothing: an Arrow list takes some 25 microseconds of every row, also where it is null
        fields = [F.unix_date(c).alias(c) if kind == pa.date32() else F.col(c) for c, kind in zip(_SCHEMA.names, _SCHEMA.types)]
        told = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        rows = rows.unionByName(state.select("symbol", told.alias("_old")), allowMissingColumns=True)
    placed = dealt(rows, tasks) if tasks else rows.repartition("symbol")
    ordered = placed.sortWithinPartitions("symbol", F.col("_old").isNull(), F.asc_nulls_last("date"))
    return ordered.mapInArrow(_advanced_batches, STATE)


def live_base(state: DataFrame) -> DataFrame:
    """(symbol, date, *BASE_FEATURES) of the last complete row of every symbol with enough history."""
    ready = state.where((F.col("n_closes") >= MIN_FEATURE_ROWS) & F.col("row").isNotNull())
    return ready.select("symbol", F.col("row_date").alias("date"), *[F.get("row", F.lit(i)).alias(c) for i, c in enumerate(BASE_FEATURES)])


def live_features(state: DataFrame, reports: DataFrame | None, trends: DataFrame | None, insider: DataFrame | None, asof: str) -> DataFrame:
    """(symbol, date, *FEATURES): the carried row with the latest report, search interest and insider score as of ``asof``, defaults where there is none.

    The last report counts from ``asof``, not from the row's date, as for a forecast that is made today.
    """
    out, day = live_base(state), F.lit(asof).cast("date")
    if reports is not None:
        hit = pead.live_pead(reports.where(F.col("report_date") <= day), asof)
        out = out.join(hit.select("symbol", "earnings_surprise_pct", "pead_signal"), "symbol", "left")
    if trends is not None:
        last = latest_per_symbol(trends.where(F.col("week") <= day), order="week")
        out = out.join(last.select("symbol", py_round("gtrends_spike_ratio", 3).alias("gtrends_spike_ratio"), "gtrends_spike_flag"), "symbol", "left")
    if insider is not None:
        out = out.join(insider.select("symbol", "insider_score"), "symbol", "left")
    for name, default in SIDE_FEATURES.items():
        out = out.withColumn(name, F.coalesce(F.col(name) if name in out.columns else F.lit(None).cast("double"), F.lit(default)))
    return out.select("symbol", "date", *FEATURES)
