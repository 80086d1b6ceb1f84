"""Binary tick and candle files: LZMA of fixed big-endian records.

Files are read as bytes by Spark (any store) and decoded a batch at a time with
numpy. Fixed values: tick records hold milliseconds in the hour, ask and bid
points and two volumes; candle records hold seconds in the day, open, close, low
and high points and a volume. Point scales are 100000, and 1000 for yen and gold.
"""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
CANDLE = np.dtype([("s", ">u4"), ("open", ">u4"), ("close", ">u4"), ("low", ">u4"), ("high", ">u4"), ("volume", ">f4")])
SCALES = {"EURUSD": 100_000, "GBPUSD": 100_000, "AUDUSD": 100_000, "USDCHF": 100_000, "USDCAD": 100_000, "NZDUSD": 100_000, "USDJPY": 1_000, "XAUUSD": 1_000}


def point_scale(symbol: str) -> int:
    if symbol not in SCALES:
        raise KeyError(f"no point scale for {symbol}")
    return SCALES[symbol]


def records(payload: bytes, kind: np.dtype) -> np.ndarray:
    """Decoded records; nothing for an empty payload, an error for a broken one."""
    if not payload:
        return np.zeros(0, kind)
    try:
        raw = lzma.decompress(payload)
    except lzma.LZMAError as e:
        raise ValueError(f"not an LZMA payload: {e}") from e
    if len(raw) % kind.itemsize:
        raise ValueError(f"{len(raw)} bytes are no whole number of {kind.itemsize}-byte records")
    return np.frombuffer(raw, kind)


def ticks(payload: bytes, hour: datetime, scale: int) -> pd.DataFrame:
    r = records(payload, TICK)
    ts = np.datetime64(hour, "us") + r["ms"].astype("i8") * np.timedelta64(1000, "us")
    return pd.DataFrame({"ts": ts, "bid": r["bid"] / scale, "ask": r["ask"] / scale, "bid_volume": r["bid_volume"].astype(float), "ask_volume": r["ask_volume"].astype(float), "sequence_gap": False})


def candles(payload: bytes, day: date, scale: int) -> pd.DataFrame:
    r = records(payload, CANDLE)
    ts = np.datetime64(day, "us") + r["s"].astype("i8") * np.timedelta64(1_000_000, "us")
    t = pd.DataFrame({"ts": ts, "open": r["open"] / scale, "high": r["high"] / scale, "low": r["low"] / scale, "close": r["close"] / scale})
    check_candles(t)
    return t


def check_candles(t: pd.DataFrame) -> None:
    if len(t) and (not t["ts"].is_monotonic_increasing or t["ts"].duplicated().any()):
        raise ValueError("candle times do not rise")
    if (t["high"] < t[["open", "close", "low"]].max(axis=1)).any() or (t["low"] > t[["open", "close", "high"]].min(axis=1)).any():
        raise ValueError("a candle's range does not hold its open and close")
    if len(t) and not 0.001 < t["high"].max() < 100_000:
        raise ValueError("prices out of scale")


def hour_path(symbol: str, hour: datetime) -> str:
    """Relative place of an hour's file; months count from 0."""
    return f"{symbol}/{hour.year:04d}/{hour.month - 1:02d}/{hour.day:02d}/{hour.hour:02d}h_ticks.bi5"


def hour_path_column(symbol: str = "symbol", hour: str = "hour"):
    """hour_path as a Column."""
    return F.format_string("%s/%04d/%02d/%02d/%02dh_ticks.bi5", symbol, F.year(hour), F.month(hour) - 1, F.dayofmonth(hour), F.hour(hour))


def day_path_column(symbol: str = "symbol", day: str = "day", side: str = "BID"):
    """day_path as a Column."""
    return F.format_string(f"%s/%04d/%02d/%02d/{day_path('', date(2000, 1, 1), side).rsplit('/', 1)[1]}", symbol, F.year(day), F.month(day) - 1, F.dayofmonth(day))


def day_path(symbol: str, day: date, side: str = "BID") -> str:
    if side not in ("BID", "ASK"):
        raise ValueError("side is BID or ASK")
    return f"{symbol}/{day.year:04d}/{day.month - 1:02d}/{day.day:02d}/{side}_candles_min_1.bi5"


def hours(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """Whole hours of [start, end)."""
    a = start.replace(minute=0, second=0, microsecond=0)
    n = max(0, -(-int((end - a).total_seconds()) // 3600))
    return spark.range(n).select((F.lit(a).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour"))


def days(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.range(max(0, (end - start).days)).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))


_TICK_NAME = r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$"
_DAY_NAME = r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(?:BID|ASK)_candles_min_1\.bi5$"


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.regexp_extract("path", pattern, i)
    return f.where(F.col("path").rlike(pattern)).select("content", "length", part(1).alias("symbol"), part(2).cast("int").alias("y"), (part(3).cast("int") + 1).alias("m"), part(4).cast("int").alias("d"), *([part(5).cast("int").alias("h")] if "ticks" in pattern else []))


DECODED = "symbol string, slot timestamp_ntz, error string, ts timestamp_ntz, seq long"


def _decode(files: DataFrame, one, values: list[str]) -> DataFrame:
    """Rows of every file, or one row with its error: a bad file hides no other."""
    scales = dict(SCALES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["symbol", "slot", "error", "ts", "seq", *values]
        for b in batches:
            for r in b.itertuples():
                at = datetime(r.y, r.m, r.d, getattr(r, "h", 0))
                try:
                    if r.symbol not in scales:
                        raise KeyError(f"no point scale for {r.symbol}")
                    t = one(r.content, at, scales[r.symbol]).assign(error=None)
                    t["seq"] = np.arange(len(t))
                except (KeyError, ValueError) as e:
                    t = pd.DataFrame({"error": [str(e)], "ts": [pd.NaT], "seq": [0], **{c: [float("nan")] for c in values}})
                yield t.assign(symbol=r.symbol, slot=at)[cols]

    return files.mapInPandas(run, DECODED + "".join(f", {c} double" for c in values))


def decode_ticks(files: DataFrame) -> DataFrame:
    """Ticks of (content, symbol, y, m, d, h) rows, with the error of bad files."""
    return _decode(files, ticks, ["bid", "ask", "bid_volume", "ask_volume"])


def decode_candles(files: DataFrame) -> DataFrame:
    """Candles of (content, symbol, y, m, d) rows, with the error of bad files."""
    return _decode(files, lambda content, at, scale: candles(content, at.date(), scale), ["open", "high", "low", "close"])


def encode_ticks(rows: DataFrame) -> DataFrame:
    """(content, symbol, y, m, d, h) of ticks: a file an hour of a symbol, prices
    rounded to the symbol's points, instants to the millisecond."""
    scales = dict(SCALES)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        raw = np.zeros(len(pdf), TICK)
        raw["ms"] = (pdf["ts"] - key[1]) // pd.Timedelta(milliseconds=1)
        for c in ("ask", "bid"):
            raw[c] = np.floor(pdf[c] * scales[key[0]] + 0.5)
            raw[f"{c}_volume"] = pdf[f"{c}_volume"]
        at = key[1]
        return pd.DataFrame({"content": [lzma.compress(raw.tobytes())], "symbol": [key[0]], "y": [at.year], "m": [at.month], "d": [at.day], "h": [at.hour]})

    hour = F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")
    return rows.select("symbol", hour, "ts", "seq", "bid", "ask", "bid_volume", "ask_volume").groupBy("symbol", "hour").applyInPandas(run, "content binary, symbol string, y int, m int, d int, h int")


def _sound(decoded: DataFrame) -> DataFrame:
    """decoded without errors; the first one met fails the job."""
    ok = F.when(F.col("error").isNull(), F.col("symbol")).otherwise(F.raise_error(F.concat_ws(" ", "symbol", F.col("slot").cast("string"), "error")).cast("string"))
    return decoded.withColumn("symbol", ok)


def read_ticks(spark: SparkSession, root: str) -> DataFrame:
    """All ticks below a folder, exact repeats of (ts, bid, ask) once (the last)."""
    from tickloom.operators.dedupe import keep_last

    t = _sound(decode_ticks(_files(spark, root, _TICK_NAME))).withColumn("sequence_gap", F.lit(False))
    return keep_last(t.select("ts", "bid", "ask", "bid_volume", "ask_volume", "sequence_gap", "symbol", "seq"), ["symbol", "ts", "bid", "ask"])


def read_candles(spark: SparkSession, root: str) -> DataFrame:
    """All candles below a folder; a file without bytes is a closed day and read as
    none. A repeated ts keeps the last."""
    from tickloom.operators.dedupe import keep_last

    t = _sound(decode_candles(_files(spark, root, _DAY_NAME).where("length > 0")))
    return keep_last(t.select("ts", "open", "high", "low", "close", "symbol", "seq"), ["symbol", "ts"])


def read_range(spark: SparkSession, root: str, symbols: list[str], start: datetime, end: datetime, cache: str, candles_: bool = False) -> DataFrame:
    """Ticks (or candles) of [start, end) from hour (or day) files below root, through
    a cache of decoded slots.

    Slots the cache holds are not decoded again; an empty file is a slot without
    rows. Files that cannot be decoded are all named in one error, and nothing of
    this call is cached then. Exact repeats keep the last, rows sort by (symbol, ts).
    """
    from tickloom.operators.dedupe import keep_last

    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    name = _DAY_NAME if candles_ else _TICK_NAME
    first = start.replace(minute=0, second=0, microsecond=0)
    first = first.replace(hour=0) if candles_ else first
    slot = F.make_timestamp_ntz(F.col("y"), F.col("m"), F.col("d"), F.lit(0) if candles_ else F.col("h"), F.lit(0), F.lit(0))
    wanted = _files(spark, root, name).withColumn("slot", slot).where(F.col("symbol").isin(symbols) & (F.col("slot") >= lit(first)) & (F.col("slot") < lit(end)))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/rows")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        held = spark.read.parquet(f"{cache}/rows").where("ts IS NULL").select("symbol", "slot").distinct()
        wanted = wanted.join(held, ["symbol", "slot"], "left_anti")
    decoded = (decode_candles if candles_ else decode_ticks)(wanted.where("length > 0")).persist()
    try:
        bad = decoded.where("error IS NOT NULL").select(F.concat_ws(" ", "symbol", F.col("slot").cast("string"), "error").alias("e")).orderBy("e").collect()
        if bad:
            raise FetchFailed("; ".join(r["e"] for r in bad))
        # A slot's rows and the row without ts that says it is held are one append.
        marks = wanted.select("symbol", "slot")
        decoded.drop("error").unionByName(marks, allowMissingColumns=True).repartition("symbol", "slot").write.mode("append").parquet(f"{cache}/rows")
    finally:
        decoded.unpersist()
    t = spark.read.parquet(f"{cache}/rows").where(F.col("symbol").isin(symbols) & (F.col("ts") >= lit(start)) & (F.col("ts") < lit(end)))
    keys = ["symbol", "ts"] if candles_ else ["symbol", "ts", "bid", "ask"]
    return keep_last(t, keys).drop("slot").orderBy("symbol", "ts", "seq")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all files below a folder, empty ones too: Spark's file
    sources leave those out, so the names come from the file system itself, as they
    do when Spark plans a scan."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, files = [], target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(found, "path string, length long")


def cache_inventory(spark: SparkSession, root: str, start: date, end: date) -> DataFrame:
    """(symbol, day) of days in [start, end) that the folder lacks, for the symbols
    it has. An empty file stands for a closed day."""
    part = lambda i: F.regexp_extract("path", _DAY_NAME, i)
    f = listing(spark, root).where(F.col("path").rlike(_DAY_NAME)).select(part(1).alias("symbol"), F.make_date(part(2).cast("int"), part(3).cast("int") + 1, part(4).cast("int")).alias("day")).distinct()
    return f.select("symbol").distinct().join(days(spark, start, end)).join(f, ["symbol", "day"], "left_anti")


# ------------------------------------------------------------ range source


class FetchFailed(RuntimeError):
    pass


def fetch(get, path: str, attempts: int = 5, backoff: float = 5.0, sleep=None) -> bytes:
    """get(path) with retries after min(backoff * 2^n, 120) seconds; a path that
    does not exist is empty."""
    import time

    for n in range(attempts):
        try:
            return get(path)
        except FileNotFoundError:
            return b""
        except OSError as e:
            if n == attempts - 1:
                raise FetchFailed(f"{path}: {e}") from e
            (sleep or time.sleep)(min(backoff * 2**n, 120.0))
    raise FetchFailed(path)


class Hour(InputPartition):
    def __init__(self, hour: datetime):
        self.hour = hour


class TickRange(DataSource):
    """spark.read.format("tick_range") with options symbol, start, end and root (a
    folder of hour files that every executor mounts): one partition an hour; any failure
    fails the read. read_range goes through Spark's own file systems and a cache."""

    @classmethod
    def name(cls) -> str:
        return "tick_range"

    def schema(self) -> str:
        return "ts timestamp_ntz, bid double, ask double, bid_volume double, ask_volume double, sequence_gap boolean, symbol string"

    def reader(self, schema):
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.symbol, self.root = options["symbol"], options["root"]
        self.start, self.end = (datetime.fromisoformat(options[k]) for k in ("start", "end"))

    def partitions(self):
        h = self.start.replace(minute=0, second=0, microsecond=0)
        out = []
        while h < self.end:
            out.append(Hour(h))
            h += timedelta(hours=1)
        return out

    def read(self, partition):
        def get(path):
            with open(f"{self.root}/{path}", "rb") as f:
                return f.read()

        t = ticks(fetch(get, hour_path(self.symbol, partition.hour)), partition.hour, point_scale(self.symbol))
        t = t[(t["ts"] >= self.start) & (t["ts"] < self.end)].assign(symbol=self.symbol)
        yield pa.RecordBatch.from_pandas(t.astype({"ts": "datetime64[us]"}), preserve_index=False)
