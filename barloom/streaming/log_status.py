"""Live run status from a folder of appended log entries: a keyed state per log, equal to the batch form however entries arrive.

The state of a log is bounded: counters, the first answer of each portfolio
agent, and those of its per-stock entries that come first and decide the blocks. Two states
merge into one, so entries are reduced where they are read and only one small
row per log and task is shuffled, and a late entry changes the state as if it had come in time.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.logs import ERRORS, PER_STOCK, PORTFOLIO, SLOTS, status_columns
from barloom.sources.dims import WATCHLIST
from barloom.sources.snapshots import SnapshotStore

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("desk", T.StringType()),
        T.StructField("run_date", T.DateType()),
        T.StructField("seq", T.LongType()),
        T.StructField("agent", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("ts", T.StringType()),
    ]
)
KEYS = ["desk", "run_date"]
BLOCK = "array<struct<block:int,symbol:string,sentiment:string,technical:string,fundamentals:string,complete:boolean>>"
_PARTS = "total_entries long, last_updated string, phase1_complete boolean, style_data string, portfolio_data string, risk_data string, error_count long, stocks_analyzed long, stocks_complete long, blocks " + BLOCK


def read_entries(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming source over line-delimited JSON files, as written by the log sink."""
    return spark.readStream.schema(ENTRY_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def blocks_of(agents: Sequence[str]) -> list[int]:
    """Number of the block of each per-stock entry, in order: news opens one, so does what follows a full one."""
    out: list[int] = []
    number = slot = 0
    for agent in agents:
        if not number or agent == PER_STOCK[0] or slot == SLOTS:
            number, slot = number + 1, 0
        slot += 1
        out.append(number)
    return out


class Progress:
    """What is known of one log; ``slots`` are its first per-stock entries as (seq, agent, data)."""

    def __init__(self, names: int = len(WATCHLIST), told: str | None = None):
        self.names, self.total, self.errors, self.phase1 = names, 0, 0, False
        self.last: list | None = None
        self.first: dict[str, list] = {}
        self.slots: list[list] = []
        if told:
            self.total, self.errors, self.phase1, self.last, self.first, self.slots = json.loads(told)

    def told(self) -> str:
        return json.dumps([self.total, self.errors, self.phase1, self.last, self.first, self.slots], sort_keys=True)

    def add(self, seq: int, agent: str | None, data: str | None, ts: str | None, error: bool) -> None:
        self.total += 1
        self.errors += error
        self._later([seq, ts])
        if agent in PER_STOCK:
            self.phase1 = True
            self._slot([seq, agent, data])
        elif agent in PORTFOLIO:
            self._earlier(agent, [seq, data])

    def merge(self, other: Progress) -> None:
        self.total += other.total
        self.errors += other.errors
        self.phase1 |= other.phase1
        if other.last:
            self._later(other.last)
        for agent, entry in other.first.items():
            self._earlier(agent, entry)
        for entry in other.slots:
            self._slot(entry)

    def _later(self, entry: list) -> None:
        if self.last is None or entry[0] > self.last[0]:
            self.last = entry

    def _earlier(self, agent: str, entry: list) -> None:
        if agent not in self.first or entry[0] < self.first[agent][0]:
            self.first[agent] = entry

    def _slot(self, entry: list) -> None:
        """Every block has an entry at least and SLOTS at most, so the first SLOTS * names entries hold all blocks that have a stock."""
        most = SLOTS * self.names
        if len(self.slots) < most or entry[0] < self.slots[-1][0]:
            insort(self.slots, entry, key=lambda e: e[0])
            del self.slots[most:]

    def blocks(self, symbols: Sequence[str]) -> list[dict]:
        """Each block with its stock, by position, and the last answer of each agent in it."""
        kind = dict(zip(PER_STOCK, ("sentiment", "technical", "fundamentals")))
        out: dict[int, dict] = {}
        for number, (_, agent, data) in zip(blocks_of([a for _, a, _ in self.slots]), self.slots):
            if number <= len(symbols):
                block = out.setdefault(number, {"block": number, "symbol": symbols[number - 1], **dict.fromkeys(kind.values())})
                block[kind[agent]] = data
        for block in out.values():
            block["complete"] = all(block[k] is not None for k in kind.values())
        return list(out.values())


def progress_stream(entries: DataFrame, symbols: Sequence[str] = tuple(WATCHLIST)) -> DataFrame:
    """(desk, run_date, ...counts and answers, blocks): the state of every log that got entries, in update mode.

    An entry without ``seq`` has no place in its log and is left out. ``symbols``
    name the blocks by position.
    """
    symbols, names = list(symbols), len(symbols)
    numbered = entries.where("seq is not null").select(
        *KEYS, "seq", "agent", "data", F.col("ts").cast("string").alias("ts"),
        (F.col("agent").isin(*ERRORS) & F.get_json_object("data", "$.ticker").isNotNull()).alias("error"),
    )

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[tuple, Progress] = {}
            text = b.astype(object).where(b.notna(), None)
            for desk, day, seq, agent, data, ts, error in zip(*(text[c] for c in (*KEYS, "seq", "agent", "data", "ts", "error"))):
                found.setdefault((desk, day), Progress(names)).add(int(seq), agent, data, ts, bool(error))
            yield pd.DataFrame([(*k, p.told()) for k, p in found.items()], columns=[*KEYS, "part"])

    def advanced(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Progress(names, state.get[0] if state.exists else None)
        for b in parts:
            for part in b["part"]:
                now.merge(Progress(names, part))
        state.update((now.told(),))
        blocks = now.blocks(symbols)
        answer = [now.first.get(a, [None, None])[1] for a in PORTFOLIO]
        yield pd.DataFrame({
            "desk": [key[0]], "run_date": [key[1]], "total_entries": [now.total], "last_updated": [now.last[1]], "phase1_complete": [now.phase1],
            "style_data": [answer[0]], "portfolio_data": [answer[1]], "risk_data": [answer[2]], "error_count": [now.errors],
            "stocks_analyzed": [len(blocks)], "stocks_complete": [sum(b["complete"] for b in blocks)], "blocks": [blocks],
        })

    parts = numbered.mapInPandas(reduced, "desk string, run_date date, part string")
    return parts.groupBy(*KEYS).applyInPandasWithState(advanced, f"desk string, run_date date, {_PARTS}", "state string", "update", GroupStateTimeout.NoTimeout)


def status_stream(entries: DataFrame, symbols: Sequence[str] = tuple(WATCHLIST)) -> DataFrame:
    """Status rows as ``logs.run_status`` has them, with the blocks of the log, updated as entries arrive in whatever order."""
    return status_columns(progress_stream(entries, symbols), KEYS, "blocks")


def upsert_to(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer into a snapshot store; a replayed micro-batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        SnapshotStore(batch.sparkSession, path, KEYS).upsert(batch, batch_id)

    return write


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    """Newest status of every log; what it reads follows the number of logs, not of micro-batches."""
    return SnapshotStore(spark, path, KEYS).read()


def live_blocks(status: DataFrame) -> DataFrame:
    """One row per (log, stock) of status rows, as ``logs.block_analyses`` has them."""
    return status.select(*KEYS, F.explode("blocks").alias("b")).select(*KEYS, "b.*")
