"""Stored hour and day files as a source that reads only what a query asks for.

Filters on symbol and ts are pushed into the source: they name the folders that are
listed, a symbol's months, and the files of those that are read. Files are dealt to tasks
by bytes, some megabytes each, in order of time. Whatever is pushed is also checked by
Spark on the rows. A file that cannot be decoded fails the read with the names of all bad
files of its task, or, with option errors=keep, is one row that holds its error.

Paths may be of any store that Arrow opens. Listings of a whole tree are made by tasks, a
symbol's month each.
"""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tickloom.sources import binary

KINDS = {
    "ticks": (binary._TICK_NAME, ("bid", "ask", "bid_volume", "ask_volume"), timedelta(hours=1)),
    "candles": (binary._DAY_NAME, ("open", "high", "low", "close"), timedelta(days=1)),
}
PACK = 8 << 20


class Files(InputPartition):
    def __init__(self, items: list[tuple[str, str, datetime]]):
        self.items = items  # (path, symbol, slot)


class QuoteFiles(DataSource):
    """spark.read.format("quote_files"). Options: path; kind, ticks or candles; pack, the
    bytes of a task; errors, fail or keep."""

    @classmethod
    def name(cls) -> str:
        return "quote_files"

    def schema(self) -> str:
        return "symbol string, ts timestamp_ntz, seq long, " + ", ".join(f"{c} double" for c in KINDS[self.options.get("kind", "ticks")][1]) + ", slot timestamp_ntz, error string"

    def reader(self, schema):
        return FileReader(self.options)


class FileReader(DataSourceReader):
    def __init__(self, options):
        self.kind = options.get("kind", "ticks")
        self.path, self.pack, self.keep = options["path"], int(options.get("pack", PACK)), options.get("errors", "fail") == "keep"
        self.symbols: set[str] | None = None
        self.first, self.last = datetime.min, datetime.max

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("symbol",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = named if self.symbols is None else self.symbols & named
            # An error row has no ts, so a bound on ts takes it away like any other.
            elif column == ("ts",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.first = max(self.first, f.value)
            if column == ("ts",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.last = min(self.last, f.value)
            yield f  # Spark checks the rows as well

    def _months(self, store, root: str) -> list[str]:
        """Folders of the symbols and months that the filters leave."""
        step = lambda path: [f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory]
        out = []
        for symbol in step(root) if self.symbols is None else sorted(self.symbols):
            for year in step(f"{root}/{symbol}"):
                for month in step(f"{root}/{symbol}/{year}"):
                    if not (year + month).isdigit() or not 0 <= int(month) <= 11:
                        continue
                    start = datetime(int(year), int(month) + 1, 1)
                    if start <= self.last and start + timedelta(days=31) > self.first:
                        out.append(f"{root}/{symbol}/{year}/{month}")
        return out

    def wanted(self) -> list[tuple[str, str, datetime, int]]:
        """(path, symbol, slot, bytes) of the files whose slot may hold such rows."""
        store, root = fs.FileSystem.from_uri(self.path)
        name, _, span = KINDS[self.kind]
        out = []
        for folder in self._months(store, root):
            for f in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                m = re.search(name, f.path) if f.is_file else None
                if not m:
                    continue
                symbol, *at = m.groups()
                slot = datetime(int(at[0]), int(at[1]) + 1, *map(int, at[2:]))
                # An empty file is a closed slot.
                if f.size and slot <= self.last and (self.first < span + datetime.min or slot > self.first - span):
                    out.append((f.path, symbol, slot, f.size))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def partitions(self):
        out, size = [], 0
        for path, symbol, slot, n in self.wanted():
            if not out or size + n > self.pack:
                out.append(Files([]))
                size = 0
            out[-1].items.append((path, symbol, slot))
            size += n
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        values, bad = KINDS[self.kind][1], []
        for path, symbol, slot in partition.items if partition else ():
            with store.open_input_stream(path) as f:
                content = f.read()
            try:
                scale = binary.point_scale(symbol)
                t = binary.ticks(content, slot, scale) if self.kind == "ticks" else binary.candles(content, slot.date(), scale)
            except (KeyError, ValueError) as e:
                bad.append(f"{path}: {e}")
                if self.keep:
                    yield _batch(symbol, slot, pd.DataFrame({"ts": [pd.NaT], **{c: [None] for c in values}}), values, str(e))
                continue
            yield _batch(symbol, slot, t, values, None)
        if bad and not self.keep:
            raise binary.FetchFailed("; ".join(bad))


def _batch(symbol: str, slot: datetime, t: pd.DataFrame, values: tuple[str, ...], error: str | None) -> pa.RecordBatch:
    n = len(t)
    cols = [pa.array([symbol] * n, pa.string()), pa.array(t["ts"], pa.timestamp("us")), pa.array(np.arange(n), pa.int64()), *(pa.array(t[c].astype("float64")) for c in values), pa.array([slot] * n, pa.timestamp("us")), pa.array([error] * n, pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["symbol", "ts", "seq", *values, "slot", "error"])


def read(spark: SparkSession, path: str, kind: str = "ticks", **options) -> DataFrame:
    """Rows of the files below path; filters on symbol and ts choose files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(QuoteFiles)
    return spark.read.format("quote_files").option("path", path).option("kind", kind).options(**options).load()


def scan_range(spark: SparkSession, path: str, symbols: list[str], start: datetime, end: datetime, kind: str = "ticks", **options) -> DataFrame:
    """Rows of [start, end), exact repeats once, the last kept: of (symbol, ts, bid, ask),
    or of (symbol, ts) for candles. No cache and no global sort: what a query keeps of
    it, it writes or orders itself."""
    from tickloom.operators.dedupe import keep_last

    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    t = read(spark, path, kind, **options).where(F.col("symbol").isin(symbols) & (F.col("ts") >= lit(start)) & (F.col("ts") < lit(end)))
    keys = ["symbol", "ts"] + (["bid", "ask"] if kind == "ticks" else [])
    return keep_last(t.drop("error", "slot"), keys)


# ---------------------------------------------------------------- writing and listing


def encode_candles(rows: DataFrame, side: str = "BID") -> DataFrame:
    """(path, content) of minute candles (symbol, ts, open, high, low, close, volume): a
    file a day of a symbol, prices rounded to its points."""
    scales = dict(binary.SCALES)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        raw = np.zeros(len(pdf), binary.CANDLE)
        raw["s"] = (pdf["ts"] - pd.Timestamp(key[1])) // pd.Timedelta(seconds=1)
        for c in ("open", "high", "low", "close"):
            raw[c] = np.floor(pdf[c] * scales[key[0]] + 0.5)
        raw["volume"] = pdf["volume"]
        return pd.DataFrame({"path": [binary.day_path(key[0], key[1], side)], "content": [lzma.compress(raw.tobytes())]})

    t = rows.select("symbol", F.to_date("ts").alias("day"), "ts", "open", "high", "low", "close", "volume")
    return t.groupBy("symbol", "day").applyInPandas(run, "path string, content binary")


def store(files: DataFrame, root: str) -> int:
    """Write (path, content) rows below root, from the tasks that hold them; the number
    of files. A repeated task writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, top = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                target = f"{top}/{path}"
                out.create_dir(target.rsplit("/", 1)[0])
                with out.open_output_stream(target) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all files below root, empty ones too. The driver names the
    folders two steps down, tasks list what they hold."""
    top, path = fs.FileSystem.from_uri(root)
    below = lambda p: [f.path for f in top.get_file_info(fs.FileSelector(p, allow_not_found=True)) if f.type == fs.FileType.Directory]
    folders = [(q,) for p in below(path) for q in below(p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, _ = fs.FileSystem.from_uri(root)
        for b in batches:
            for folder in b.column("folder").to_pylist():
                found = [f for f in store_.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in found], pa.string()), pa.array([f.size for f in found], pa.int64())], ["path", "length"])

    dealt = spark.createDataFrame(folders, "folder string").repartition(max(1, min(len(folders), 1000)))
    return dealt.mapInArrow(run, "path string, length long")


def inventory(spark: SparkSession, root: str, start: date, end: date) -> DataFrame:
    """Per symbol of the folder: days of [start, end) that have a candle file, closed ones
    among them (empty files), and the list of days that have none."""
    part = lambda i: F.regexp_extract("path", binary._DAY_NAME, i)
    day = F.make_date(part(2).cast("int"), part(3).cast("int") + 1, part(4).cast("int"))
    have = listing(spark, root).where(F.col("path").rlike(binary._DAY_NAME)).select(part(1).alias("symbol"), day.alias("day"), "length").groupBy("symbol", "day").agg(F.max("length").alias("length"))
    have = have.where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
    t = have.select("symbol").distinct().join(binary.days(spark, start, end)).join(have, ["symbol", "day"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("length").isNull(), F.date_format("day", "yyyy-MM-dd"))))
    return t.groupBy("symbol").agg(F.count("length").alias("days"), F.count_if(F.col("length") == 0).alias("closed"), F.concat_ws(",", missing).alias("missing"))
