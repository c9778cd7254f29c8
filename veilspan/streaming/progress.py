"""Watching logs: the latest progress of each, and an alarm when one falls silent, kept as keyed state with timers.

The state of a log is one row, whatever its length. It needs the RocksDB state store, see ``PROVIDER``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "at long, percent int, step long, of long, done boolean, bad boolean, seen long"
_OUT = "log string, at long, percent int, step long, of long, state string, seen timestamp"


class _Watch(StatefulProcessor):
    """``at`` is the number of the latest line with progress, ``seen`` the time of the newest line in milliseconds."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.latest = handle, handle.getValueState("latest", _STATE)

    def _row(self, key, state: tuple, name: str | None = None) -> pd.DataFrame:
        at, percent, step, of, done, bad, seen = state
        name = name or ("done" if done else "error" if bad else "running")
        row = {"log": key[0], "at": at, "percent": percent, "step": step, "of": of, "state": name, "seen": pd.Timestamp(seen, unit="ms")}
        return pd.DataFrame([row]).astype({"at": "Int64", "percent": "Int32", "step": "Int64", "of": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, percent, step, of, done, bad, seen = self.latest.get() if self.latest.exists() else (None, None, None, None, False, False, 0)
        for frame in rows:
            done, bad, seen = done or bool(frame["done"].any()), bad or bool(frame["bad"].any()), max(seen, int(frame["ms"].max()))
            told = frame[frame["percent"].notna()]
            if len(told):
                last = told.loc[told["line_no"].idxmax()]
                if at is None or last["line_no"] > at:
                    at, percent, step, of = int(last["line_no"]), int(last["percent"]), int(last["step"]), int(last["of"])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not done:
            self.handle.registerTimer(seen + self.silence)
        self.latest.update((at, percent, step, of, done, bad, seen))
        yield self._row(key, (at, percent, step, of, done, bad, seen))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists():
            yield self._row(key, self.latest.get(), "stalled")

    def close(self) -> None:
        pass


def watched(lines: DataFrame, log: str = "log", line: str = "value", order: str = "line_no", time: str = "time", silence: int = 600, late: str = "1 minute") -> DataFrame:
    """(log, at, percent, step, of, state, seen) of a stream of log lines: a row for each log that a batch has lines of, and one when a log falls silent.

    ``state`` is done, error or running as in ``evaluate.progress``, over all lines so far, or stalled once event time is ``silence`` seconds past a log's newest line;
    a log that is done never stalls. Lines may come in any order; those later than ``late`` behind the newest still count. Output mode is update.
    """
    part = lambda k: F.regexp_extract(line, r"(\d+)%\|[^|]*\|\s*(\d+)/(\d+)", k)
    known = F.length(part(1)) > 0
    rows = lines.withWatermark(time, late).select(
        F.col(log).cast("string").alias("log"), F.col(order).cast("long").alias("line_no"), F.col(time).alias("time"), F.unix_millis(time).alias("ms"),
        F.when(known, part(1).cast("int")).alias("percent"), F.when(known, part(2).cast("long")).alias("step"), F.when(known, part(3).cast("long")).alias("of"),
        F.coalesce(F.lower(line).rlike("training completed|训练完成|finished"), F.lit(False)).alias("done"), F.coalesce(F.lower(line).rlike(r"\berror\b|traceback|out of memory"), F.lit(False)).alias("bad"),
    )
    return rows.groupBy("log").transformWithStateInPandas(_Watch(silence * 1000), _OUT, "Update", "EventTime")
