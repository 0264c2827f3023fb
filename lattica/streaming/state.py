"""Long tasks as keyed state with timers: polls of a task until it ends, uploads until they are whole.

Both are streams (`transformWithStateInPandas`) over rows in any order. A row waits in its key's map
state until the watermark has passed it; then a timer takes the waiting rows in order of time through
the rules, which are plain functions that the batch forms use, too. So a stream gives the
rows of the batch form, however its input was cut or shuffled, as long as nothing comes later than
the watermark allows. State is cleared when a task has ended or an upload is whole, and a timer clears
what never ends.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lattica import schemas as S
from lattica.session import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POLL = "task string, ts timestamp, seq long, status string, stage string"
OUTCOME = "task string, seq long, outcome string, polls long, stage string"
CHUNK = "upload_id string, ts timestamp, index int, total int, data string"
WHOLE = "upload_id string, chunks int, content string"
_IDLE = "idle"


PATIENCE = S.POLLS * S.POLL_SECONDS  # seconds after which a task that isn't asked for any more is forgotten


@dataclass
class Run:
    """A run of polls: what was heard last, how often was asked, how often in a row in vain, and when last."""

    stage: str | None = None
    polls: int = 0
    errors: int = 0
    last: int = 0

    def heard(self, status: str | None, stage: str | None) -> str | None:
        """Takes one poll in; how the run ends with it, if it does. A null status is a failed poll."""
        self.polls += 1
        if status is None:
            self.errors += 1
            if self.errors >= S.POLL_ERRORS:
                return "lost"
        else:
            self.errors, self.stage = 0, stage
            if status.lower() in ("completed", "failed"):
                return status.lower()
        return "timed out" if self.polls >= S.POLLS else None

    def over(self, at: int, patience: int) -> bool:
        """Whether the run is forgotten at a time (microseconds)."""
        return self.polls > 0 and at >= self.last + patience * 1_000_000


def advanced(run: Run, task: str, polls: Iterable[tuple], patience: int) -> Iterator[tuple]:
    """The outcomes (task, seq, outcome, polls, stage) of polls (microseconds, seq, status, stage) in order.

    run is left as it stands after them."""
    for at, seq, status, stage in polls:
        if run.over(at, patience):
            run.__init__()
        end = run.heard(status, stage)
        run.last = at
        if end:
            yield task, seq, end, run.polls, run.stage
            run.__init__()


def poll_outcomes(polls: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """task, seq, outcome (completed, failed, lost, timed out), polls, stage of every run that ended: the batch form.

    polls: task, ts, seq, status (null: the poll failed), stage. After an end, or patience seconds without
    a poll, the task's next poll begins a new run. Polls go through in order, a batch in memory at a time."""
    ship(polls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, Run()
        for f in frames:
            out: list[tuple] = []
            for task, rows in f.groupby("task", sort=False):
                if task != at:
                    at, state = task, Run()
                out += advanced(state, task, zip(rows["at"], rows["seq"], rows["status"], rows["stage"], strict=True), patience)
            yield pd.DataFrame(out, columns=["task", "seq", "outcome", "polls", "stage"])

    plain = polls.select(F.col("task").cast("string").alias("task"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "status", "stage").where("task is not null")
    return plain.repartition("task").sortWithinPartitions("task", "at", "seq").mapInPandas(run, OUTCOME)


def _micros(value) -> int:
    return int(pd.Timestamp(value).value // 1000)


def _none(ddl: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in ddl.split(", ")])


class _Polls(StatefulProcessor):
    """Waiting polls by time and number, and the run that those before the watermark have made."""

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, seq long", "status string, stage string")
        self.run = handle.getValueState("run", "stage string, polls long, errors long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            for ts, seq, status, stage in zip(f["ts"], f["seq"], f["status"], f["stage"], strict=True):
                at = _micros(ts)
                self.waiting.updateValue((at, int(seq)), (status, stage))
                self.handle.registerTimer(-(-at // 1000))
        yield _none(OUTCOME)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        run = Run(*self.run.get()) if self.run.exists() else Run()
        ready = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= now)
        out = list(advanced(run, key[0], ((*k, *v) for k, v in ready), self.patience))
        for k, _ in ready:
            self.waiting.removeKey(k)
        if run.polls and not run.over(now, self.patience):
            self.run.update((run.stage, run.polls, run.errors, run.last))
            self.handle.registerTimer(run.last // 1000 + self.patience * 1000 + 1)
        elif self.run.exists():
            self.run.clear()
        yield pd.DataFrame(out, columns=["task", "seq", "outcome", "polls", "stage"]) if out else _none(OUTCOME)

    def close(self) -> None:
        pass


def poll_outcomes_stream(polls: DataFrame, late: str = "10 minutes", patience: int = PATIENCE) -> DataFrame:
    """`poll_outcomes` over a stream: a run's outcome appears when the watermark has passed its last poll."""
    ship(polls.sparkSession)
    plain = polls.select(F.col("task").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "status", "stage").where("task is not null")
    return plain.withWatermark("ts", late).groupBy("task").transformWithStateInPandas(_Polls(patience), OUTCOME, "Append", "eventTime")


def progress(polls: DataFrame, asked: DataFrame) -> DataFrame:
    """task, stage: where each asked task stands, `idle` if nothing is known of it or it has ended.

    polls: task, ts, seq, status, stage; asked: task."""
    last = polls.where("status is not null").groupBy(F.col("task").cast("string").alias("task")).agg(F.max_by(F.struct("status", "stage"), F.struct("ts", "seq")).alias("p"))
    running = last.where(~F.lower("p.status").isin("completed", "failed")).select("task", F.col("p.stage").alias("stage"))
    return asked.select(F.col("task").cast("string").alias("task")).join(running, "task", "left").select("task", F.coalesce("stage", F.lit(_IDLE)).alias("stage"))


class _Chunks(StatefulProcessor):
    """The chunks of an upload by index; the last one of an index counts."""

    def __init__(self, patience: dt.timedelta) -> None:
        self.patience = int(patience.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "index int", "ts long, data string")
        self.size = handle.getValueState("size", "total int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, last = self.size.get() if self.size.exists() else (0, 0)
        for f in rows:
            for ts, index, n, data in zip(f["ts"], f["index"], f["total"], f["data"], strict=True):
                at, slot = _micros(ts), (int(index),)
                known = self.chunks.getValue(slot) if self.chunks.containsKey(slot) else None
                if known is None or known[0] <= at:
                    self.chunks.updateValue(slot, (at, data))
                total, last = max(total, int(n)), max(last, at)
        held = sorted((k[0], v[1]) for k, v in self.chunks.iterator() if k[0] < total)
        if len(held) == total:
            self.chunks.clear()
            self.size.clear()
            yield pd.DataFrame({"upload_id": [key[0]], "chunks": [total], "content": ["".join(d for _, d in held)]})
            return
        self.size.update((total, last))
        self.handle.registerTimer(last // 1000 + self.patience)
        yield _none(WHOLE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.size.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.size.get()[1] // 1000 + self.patience:
            self.chunks.clear()
            self.size.clear()
        yield _none(WHOLE)

    def close(self) -> None:
        pass


def assembled_stream(chunks: DataFrame, late: str = "10 minutes", patience: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """upload_id, chunks, content of each upload when the last of its chunks arrives.

    chunks: upload_id, ts, index, total, data. Chunks are told apart by index, so one that is sent again
    replaces the first and isn't counted twice; uploads that rest for `patience` are forgotten."""
    ship(chunks.sparkSession)
    plain = chunks.select(F.col("upload_id").cast("string").alias("upload_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("index").cast("int").alias("index"), F.col("total").cast("int").alias("total"), "data").where("upload_id is not null")
    return plain.withWatermark("ts", late).groupBy("upload_id").transformWithStateInPandas(_Chunks(patience), WHOLE, "Append", "eventTime")
