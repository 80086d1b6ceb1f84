"""A polled feed as a stream: source, gap flags, poll cycle and its bounded retries.

A feed adds one file of JSON lines (symbol, ts, bid, ask and volumes) to a folder every
time it polls; names rise. The source's offset is the last name read, so a query that is
stopped and started again takes up where its checkpoint ends, and every row comes once.
New files are dealt to tasks by bytes. Paths may be of any store that Arrow opens.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

POLL = "poll string, place long, symbol string, ts timestamp, bid double, ask double, bid_volume double, ask_volume double"
_FILE = pa.schema([("symbol", pa.string()), ("ts", pa.string()), *((c, pa.float64()) for c in ("bid", "ask", "bid_volume", "ask_volume"))])


class Polls(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class PolledQuotes(DataSource):
    """spark.readStream.format("polled_quotes"). Options: path; pack, the bytes of a
    task (8 MB); archive, a folder outside path that takes files whose rows are
    committed, so that listings stay short (none: they stay)."""

    @classmethod
    def name(cls) -> str:
        return "polled_quotes"

    def schema(self) -> str:
        return POLL

    def streamReader(self, schema):  # noqa: N802  Spark's name
        return _PollReader(self.options)


class _PollReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.archive, self.pack = options["path"], options.get("archive"), int(options.get("pack", 8 << 20))

    def _listed(self) -> list[tuple[str, int]]:
        """(name below the folder, bytes) of the files there, by name."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda name: any(part[:1] in "._" for part in name.split("/"))  # noqa: E731  files half written
        names = ((f.path[len(root) :].strip("/"), f.size) for f in found if f.is_file)
        return sorted((n, size) for n, size in names if not hidden(n))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"upto": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        names = self._listed()
        return {"upto": max(names[-1][0] if names else "", getattr(self, "upto", ""))}

    def partitions(self, start: dict, end: dict) -> list[Polls]:
        out, size = [], 0
        for name, n in self._listed():
            if start["upto"] < name <= end["upto"]:
                if not out or size + n > self.pack:
                    out.append(Polls([]))
                    size = 0
                out[-1].names.append(name)
                size += n
        return out

    def read(self, partition: Polls) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            with store.open_input_stream(f"{root}/{name}") as f:
                raw = f.read()
            if not raw.strip():
                continue
            t = pj.read_json(pa.py_buffer(raw), parse_options=pj.ParseOptions(explicit_schema=_FILE, unexpected_field_behavior="ignore"))
            stamps = pd.to_datetime(t.column("ts").to_pandas(), utc=True, format="ISO8601")
            cols = [pa.array([name] * len(t)), pa.array(range(len(t)), pa.int64()), t.column("symbol").combine_chunks(), pa.array(stamps, pa.timestamp("us", tz="UTC")), *(t.column(c).combine_chunks() for c in _FILE.names[2:])]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in POLL.split(", ")])

    def commit(self, end: dict) -> None:
        self.upto = end["upto"]
        if not self.archive:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        away, to = fs.FileSystem.from_uri(self.archive)
        for name, _ in self._listed():
            if name <= end["upto"]:
                away.create_dir(f"{to}/{name}".rsplit("/", 1)[0])
                store.move(f"{root}/{name}", f"{to}/{name}")


def read_polls(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PolledQuotes)
    return spark.readStream.format("polled_quotes").option("path", path).options(**options).load()


@contextlib.contextmanager
def stateful(spark: SparkSession, partitions: int = 8):
    """Settings that a query with processors takes over when it starts: state in RocksDB,
    in so many parts. The session's own come back afterwards."""
    want = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(partitions)}
    old = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---------------------------------------------------------------- gap flags

FLAGGED = POLL + ", sequence_gap boolean"
LOT = 1 << 16  # rows of an output batch
_NUMBERS = ("bid", "ask", "bid_volume", "ask_volume")


class _HighWater(StatefulProcessor):
    """The latest instant of a symbol, kept from batch to batch."""

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Numbers alone wait for each other, and go out in lots.
        names, parts, kind = {}, [], None
        for t in rows:
            kind = t["ts"].dtype
            us = t["ts"].astype("datetime64[us, UTC]" if t["ts"].dt.tz is not None else "datetime64[us]").astype("int64").to_numpy()
            code = np.fromiter((names.setdefault(x, len(names)) for x in t["poll"]), np.int32, len(t))
            parts.append((code, t["place"].to_numpy(np.int64), us, *(t[c].to_numpy(np.float64) for c in _NUMBERS)))
        if not parts:
            return
        code, place, us, *numbers = (np.concatenate(x) for x in zip(*parts))
        del parts
        polls = np.array(list(names), object)
        rank = np.empty(len(polls), np.int32)
        rank[sorted(range(len(polls)), key=lambda i: polls[i])] = np.arange(len(polls), dtype=np.int32)
        order = np.lexsort((place, rank[code]))
        mark = self.mark.get()[0] if self.mark.exists() else np.iinfo(np.int64).min
        high = np.maximum(np.maximum.accumulate(us[order]), mark)
        gap = us[order] < np.append(mark, high[:-1])
        self.mark.update((int(high[-1]),))
        for i in range(0, len(order), LOT):
            at = order[i : i + LOT]
            ts = pd.Series(us[at].view("datetime64[us]"))
            ts = ts if getattr(kind, "tz", None) is None else ts.dt.tz_localize("UTC").dt.tz_convert(kind.tz)
            yield pd.DataFrame({"poll": polls[code[at]], "place": place[at], "symbol": key[0], "ts": ts, **{c: x[at] for c, x in zip(_NUMBERS, numbers)}, "sequence_gap": gap[i : i + LOT]})

    def close(self) -> None:
        pass


def flag_gaps(polls: DataFrame) -> DataFrame:
    """polls with sequence_gap: an instant before one that its symbol has shown already, in
    order of polls. A batch's rows of one symbol are one group. Start it in stateful()."""
    return polls.groupBy("symbol").transformWithStateInPandas(_HighWater(), FLAGGED, "Append", "None")


# ---------------------------------------------------------------- poll cycle


def fresh(flagged: DataFrame, points: DataFrame | None) -> DataFrame:
    """Rows later than their symbol's resume point (symbol, last_ts), one row a symbol of
    what was stored before the stream's own checkpoint began. Gap flags stay right, as
    they are set before."""
    if points is None:
        return flagged
    last = F.broadcast(points.select("symbol", F.col("last_ts").cast("timestamp").alias("_last")))
    return flagged.join(last, "symbol", "left").where("_last IS NULL OR ts > _last").drop("_last")


def poll_cycle(spark: SparkSession, path: str, stored: str, checkpoint: str, points: DataFrame | None = None, partitions: int = 8, **options) -> int:
    """Everything the feed has added is flagged and stored once, by symbol and month; the
    rows stored. The file sink's log and the checkpoint make a repeated cycle harmless."""
    with stateful(spark, partitions):
        t = fresh(flag_gaps(read_polls(spark, path, **options)), points).withColumn("month", F.date_format("ts", "yyyy-MM"))
        q = t.writeStream.format("json").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").partitionBy("symbol", "month").option("path", stored).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sum(p["numInputRows"] for p in q.recentProgress)


def run(cycle: Callable[[], int], cycles: int | None, symbols: list[str], backoff: float = 1.0, longest: float = 60.0, pause: float = 0.0, sleep: Callable = time.sleep, now: Callable = lambda: datetime.now(timezone.utc)) -> tuple[int, list[tuple[str, datetime]]]:
    """Run cycles (None: without end), every attempt counted. A failed one opens a window
    of downtime for each symbol and waits, twice as long each time up to `longest`; a good
    one starts over at `backoff`. Rows in all, and the windows (symbol, since) for
    downtime."""
    rows, downs, wait, done = 0, [], backoff, 0
    while cycles is None or done < cycles:
        done += 1
        try:
            rows += cycle()
        except Exception:  # noqa: BLE001  whatever the feed or the store raises
            downs += [(s, now()) for s in symbols]
            sleep(wait)
            wait = min(2 * wait, longest)
            continue
        wait = backoff
        if pause:
            sleep(pause)
    return rows, downs


def stored_polls(spark: SparkSession, stored: str) -> DataFrame:
    """What poll cycles have stored."""
    return spark.read.schema(FLAGGED + ", month string").json(stored)
