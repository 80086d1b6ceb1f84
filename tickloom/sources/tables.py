"""Schemas, scans and sinks of quote data.

Ticks lie partitioned by symbol and month, bars by symbol; Parquet statistics
and partition pruning do what file-name tests did. A Spark write's part files
are not reproducible, so a manifest carries an order-insensitive content hash
beside the files' own digests.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.sessions import month_key
from tickloom.operators import validate
from tickloom.operators.bars import resample

TICK = "ts timestamp_ntz, bid double, ask double, bid_volume double, ask_volume double, sequence_gap boolean, seq long, symbol string"
CANDLE = "ts timestamp_ntz, open double, high double, low double, close double, symbol string"
CAPTURE = "ts string, bid double, ask double, bid_volume double, ask_volume double, sequence_gap boolean"


def write_ticks(ticks: DataFrame, root: str) -> None:
    """Every row under its own month; only the months written are replaced. A month's
    days are tasks and files of their own, so a busy symbol is no single task."""
    t = ticks.withColumn("month", month_key(F.col("ts")))
    t.repartition("symbol", "month", F.to_date("ts")).sortWithinPartitions("ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol", "month").parquet(root)


def read_ticks(spark: SparkSession, root: str, symbol: str | None = None, month: str | None = None) -> DataFrame:
    t = spark.read.parquet(root)
    if symbol is not None:
        t = t.where(F.col("symbol") == symbol)
    return t if month is None else t.where(F.col("month") == month)


def read_capture(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Captured JSON lines of one symbol, or of a folder with a folder a symbol; missing
    volumes are 0, a missing gap flag false."""
    t = spark.read.schema(CAPTURE + (", symbol string" if symbol is None else "")).json(path)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return t.select(F.to_timestamp("ts").cast("timestamp_ntz").alias("ts"), "bid", "ask", zero("bid_volume"), zero("ask_volume"), F.coalesce("sequence_gap", F.lit(False)).alias("sequence_gap"), (F.col("symbol") if symbol is None else F.lit(symbol)).alias("symbol"))


def read_candles(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """Candles of days in [start, end) from day=... partitions."""
    return spark.read.parquet(root).where((F.col("day") >= start) & (F.col("day") < end))


def content_hash(df: DataFrame) -> str:
    """The same for the same rows in any order and layout."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h'] or 0}"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and SHA-256 of every file below path, but hidden ones (names that begin
    with a dot or an underscore). The driver names what lies in path itself; tasks list
    the folders and read the files."""
    store, root = fs.FileSystem.from_uri(path)
    top = [(f.path, f.type == fs.FileType.Directory) for f in store.get_file_info(fs.FileSelector(root)) if f.base_name[:1] not in "._"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = fs.FileSystem.from_uri(path)

        def files(folder: str) -> Iterator[str]:
            for f in own.get_file_info(fs.FileSelector(folder)):
                if f.base_name[:1] not in "._":
                    if f.type == fs.FileType.Directory:
                        yield from files(f.path)
                    else:
                        yield f.path

        def digest(name: str) -> tuple[str, int, str]:
            sha, n = hashlib.sha256(), 0
            with own.open_input_stream(name) as f:
                while piece := f.read(1 << 20):
                    sha.update(piece)
                    n += len(piece)
            return name.rsplit("/", 1)[1], n, sha.hexdigest()

        for b in batches:
            for name, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist()):
                every = map(digest, files(name) if folder else [name])
                while rows := list(itertools.islice(every, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["file", "length", "sha256"])

    dealt = spark.createDataFrame(top, "path string, folder boolean").repartition(max(1, min(len(top), 1000)))
    return dealt.mapInArrow(run, "file string, length long, sha256 string")


def manifest(cleaned: DataFrame, source: str, timeframe: str, report: list[dict], commit: str | None = None) -> dict:
    """Rows, range, content hash, validation report and commit of a cleaned table."""
    r = cleaned.agg(F.count(F.lit(1)).alias("n"), F.min("ts_open").alias("a"), F.max("ts_open").alias("b")).first()
    return {"source": source, "timeframe": timeframe, "row_count": r["n"], "date_from": str(r["a"]), "date_to": str(r["b"]), "content_hash": content_hash(cleaned), "validation": report, "commit": commit}


def promote(ticks: DataFrame, raw_dir: str, bar_dir: str, timeframe: str, threshold_ms: int, outages: list | None = None, source: str = "ticks") -> tuple[dict | None, list[dict]]:
    """Validate, then write ticks, bars and a manifest; a rejected batch writes
    nothing and gives no manifest."""
    report = [r.asDict() for r in validate.check_ticks(ticks).collect()]
    if any(r["n"] for r in report if r["action"] == "reject"):
        return None, report
    write_ticks(ticks, raw_dir)
    resample(ticks, timeframe, threshold_ms, outages).write.mode("overwrite").option("compression", "zstd").partitionBy("symbol").parquet(bar_dir)
    return manifest(ticks.sparkSession.read.parquet(bar_dir), source, timeframe, report), report


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """A small record through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(record, sort_keys=True, default=str).encode()))
    out.close()


def save_artefact(frame: DataFrame, path: str, fitted_from: datetime, fitted_to: datetime, available_from: datetime, policy: str = "frozen") -> None:
    """A fitted table whose rows carry when they may be read."""
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    frame.withColumns({"calibrated_from": stamp(fitted_from), "calibrated_to": stamp(fitted_to), "available_from": stamp(available_from), "policy": F.lit(policy)}).write.mode("overwrite").parquet(path)


def load_artefact(spark: SparkSession, path: str, at: datetime) -> DataFrame:
    """Refuses a table that may not be read yet, or has no stamp."""
    t = spark.read.parquet(path)
    if "available_from" not in t.columns:
        raise PermissionError("an artefact without availability stamp is refused")
    late = t.where(F.col("available_from").isNull() | (F.col("available_from") > F.lit(at).cast("timestamp_ntz"))).limit(1).count()
    if late:
        raise PermissionError("the artefact is not available yet")
    return t


def gate_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a saved gate record."""
    cell = "array<struct<symbol:string,session:string,timeframe:string,entry_spread_pips:double,stop_exit_spread_pips:double,c:double,cost_level:string>>"
    t = spark.read.schema(f"cells {cell}").option("multiLine", "true").json(path).select(F.inline("cells"))
    return t.withColumnsRenamed({"entry_spread_pips": "entry_pips", "stop_exit_spread_pips": "exit_pips"})


def newest_file(spark: SparkSession, folder: str, prefix: str) -> str | None:
    f = spark.read.format("binaryFile").option("pathGlobFilter", prefix + "*").load(folder).select("path", "modificationTime")
    row = f.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return row["path"] if row else None
