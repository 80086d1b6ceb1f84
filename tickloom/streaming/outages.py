"""Downtime as a stream: windows that starts of the service and silence open.

Events are (symbol, ts, start): a start of the service opens a window that the symbol's
first quote at or after it closes; a window that is opened again before any quote counts
from the later start. With `silence`, a quote that comes more than so many ms after the
one before closes a window that began when the silence was full, and a timer in event
time says so as soon as the watermark is past it, without waiting for that quote.

Events wait until the watermark is past them and are taken in order of event time, so
their order of arrival within the watermark's delay does not matter. Every output row
counts what still waits as well: the last one of a symbol is its whole result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUTAGES = "symbol string, events long, windows long, downtime_ms long, silences long, silent_ms long, down_since timestamp"
_NONE = -(1 << 62)
LOT = 1 << 16  # events of a record of the state


def _events(packed: np.ndarray) -> Iterator[tuple[int, int]]:
    """(us, kind) of events kept as 2 us + kind, a lot at a time."""
    for i in range(0, len(packed), LOT):
        x = packed[i : i + LOT]
        yield from zip((x >> 1).tolist(), (x & 1).tolist())


def _pass(state: tuple, events: Iterable[tuple[int, int]], silence: int | None) -> tuple:
    """The state after events (us, kind) in order, starts (0) before quotes (1)."""
    seen, opened, last, windows, down, silences, silent = state
    for us, kind in events:
        seen += 1
        if kind == 0:
            opened = us
            continue
        if opened != _NONE:
            windows, down, opened = windows + 1, down + (us - opened) // 1000, _NONE
        if silence is not None and last != _NONE and us - last > silence * 1000:
            silences, silent = silences + 1, silent + (us - last) // 1000 - silence
        last = max(last, us)
    return seen, opened, last, windows, down, silences, silent


class _Watch(StatefulProcessor):
    def __init__(self, silence: int | None):
        self.silence = silence

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "seen long, opened long, last long, windows long, down long, silences long, silent long")
        self.waiting = handle.getListState("packed", "events binary")

    def _settle(self, fresh: list[np.ndarray], watermark_ms: int) -> tuple:
        """Take what the watermark has passed; the state with the rest counted too."""
        state = tuple(self.done.get()) if self.done.exists() else (0, _NONE, _NONE, 0, 0, 0, 0)
        held = [np.frombuffer(x[0], np.int64) for x in self.waiting.get()] if self.waiting.exists() else []
        every = np.sort(np.concatenate([np.zeros(0, np.int64), *held, *fresh]))
        n = int(np.searchsorted(every >> 1, watermark_ms * 1000, "right"))
        past, rest = every[:n], every[n:]
        if n:
            state = _pass(state, _events(past), self.silence)
            self.done.update(state)
        self.waiting.put([(rest[i : i + LOT].tobytes(),) for i in range(0, len(rest), LOT)]) if len(rest) else self.waiting.clear()
        return _pass(state, _events(rest), self.silence)

    def _row(self, key, state: tuple, since: int | None) -> pd.DataFrame:
        seen, opened, _, windows, down, silences, silent = state
        since = opened if opened != _NONE else since
        at = pd.Series([pd.NaT if since is None else pd.Timestamp(since, unit="us")], dtype="datetime64[us]")
        return pd.DataFrame({"symbol": [key[0]], "events": [seen], "windows": [windows], "downtime_ms": [down], "silences": [silences], "silent_ms": [silent], "down_since": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = []
        for t in rows:
            ts = t["ts"].dt.tz_localize(None) if t["ts"].dt.tz is not None else t["ts"]
            got.append(ts.astype("datetime64[us]").astype("int64").to_numpy() * 2 + ~t["start"].to_numpy(bool))
        mark = timerValues.getCurrentWatermarkInMs()
        state = self._settle(got, mark)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state[2] != _NONE and self.silence is not None:
            self.handle.registerTimer(max(state[2] // 1000 + self.silence, mark + 1))
        yield self._row(key, state, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._settle([], timerValues.getCurrentWatermarkInMs())
        yield self._row(key, state, state[2] + self.silence * 1000)

    def close(self) -> None:
        pass


def watch_outages(events: DataFrame, late: str = "1 hour", silence_ms: int | None = None) -> DataFrame:
    """Per symbol and batch the windows closed so far, their time, and since when it is
    down, if it is. events (symbol, ts, start) as a stream; start it in stateful()."""
    t = events.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "start").withWatermark("ts", late)
    return t.groupBy("symbol").transformWithStateInPandas(_Watch(silence_ms), OUTAGES, "Update", "EventTime")


def last_rows(rows: DataFrame) -> DataFrame:
    """The latest output row of each symbol."""
    rest = [c.split()[0] for c in OUTAGES.split(", ")][1:]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("events", F.col("down_since").isNotNull())).alias("_r")).select("symbol", "_r.*")
