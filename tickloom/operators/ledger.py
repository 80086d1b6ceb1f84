"""The hash-chained trial ledger: one writer on the driver, checks in Spark."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import stats
from tickloom.session import scratch

GENESIS = "0" * 64
FIELDS = ("candidate", "params", "strategy", "symbol", "timeframe", "selection_criterion", "fill_mode", "feature_version", "sr_periodic", "n_observations", "recorded_at")
SCHEMA = "candidate string, params string, strategy string, symbol string, timeframe string, selection_criterion string, fill_mode string, feature_version string, sr_periodic double, n_observations long, recorded_at string, prev_hash string, record_hash string, sr_text string, pos long"


def record_hash(record: dict, prev: str) -> str:
    """SHA-256 of the record's canonical text (sorted keys, no spaces, ASCII) with
    the hash before it. The ratio is hashed as the text that is stored, as float
    texts differ between engines."""
    body = {k: record[k] for k in FIELDS if k != "sr_periodic"} | {"sr_text": record["sr_text"], "prev_hash": prev}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def faults(record: dict) -> list[str]:
    out = [f"{k} is blank" for k in ("candidate", "strategy", "symbol", "selection_criterion", "fill_mode") if not str(record.get(k) or "").strip()]
    if not isinstance(record.get("sr_periodic"), float) or not math.isfinite(record["sr_periodic"]):
        out.append("sr_periodic is not finite")
    if not isinstance(record.get("n_observations"), int) or record["n_observations"] < 2:
        out.append("fewer than two observations")
    return out


class Ledger:
    """Append-only JSON lines; the tail is remembered, not read again."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        lines = self.path.read_text().splitlines() if self.path.exists() else []
        self.tail = json.loads(lines[-1])["record_hash"] if lines else GENESIS
        self.size = len(lines)

    def append(self, record: dict) -> str:
        if bad := faults(record):
            raise ValueError("; ".join(bad))
        full = {k: record.get(k) for k in FIELDS} | {"sr_text": repr(record["sr_periodic"]), "prev_hash": self.tail}
        full["record_hash"] = record_hash(full, self.tail)
        full["pos"] = self.size
        with self.path.open("a") as f:
            f.write(json.dumps(full) + "\n")
        self.tail, self.size = full["record_hash"], self.size + 1
        return self.tail


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def canonical(columns: tuple[str, ...] = FIELDS):
    """The hashed text as a Column: a struct of the fields in alphabetical order."""
    names = sorted([c for c in columns if c != "sr_periodic"] + ["sr_text", "prev_hash"])
    return F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})


def invalid(records: DataFrame) -> DataFrame:
    """Records that break a rule, with the list of their faults: the checks of
    faults() as columns."""
    blank = [F.when(F.coalesce(F.trim(F.col(k)), F.lit("")) == "", F.lit(f"{k} is blank")) for k in ("candidate", "strategy", "symbol", "selection_criterion", "fill_mode")]
    x, n = F.col("sr_periodic"), F.col("n_observations")
    rest = [F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit("sr_periodic is not finite")), F.when(n.isNull() | (n < 2), F.lit("fewer than two observations"))]
    return records.withColumn("faults", F.array_compact(F.array(*blank, *rest))).where(F.size("faults") > 0)


def with_hash_before(records: DataFrame, name: str, span: int = 4096) -> DataFrame:
    """records with the record_hash before each, GENESIS for the first. One ledger
    is one chain: the lag is taken inside ranges of `span` positions, and only the
    last hash of each range passes through a window without a partition."""
    key = F.floor(F.col("pos") / span)
    ends = records.groupBy(key.alias("_range")).agg(F.max_by("record_hash", "pos").alias("_end"))
    ends = ends.select(F.col("_range").alias("_at"), F.lag("_end", 1, GENESIS).over(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_end"))
    t = records.withColumn("_range", key)
    w = Window.partitionBy("_range").orderBy("pos")
    t = t.withColumn("_lag", F.lag("record_hash").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    t = t.join(ends, F.col("_range").eqNullSafe(F.col("_at")))
    return t.withColumn(name, F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_lag"))).drop("_range", "_at", "_end", "_lag", "_first")


def chained(records: DataFrame, span: int = 1 << 19) -> DataFrame:
    """records (pos, body) with prev_hash and record_hash, each hash over the body and
    the hash before it. A chain has one writer, so records are dealt into ranges of pos of
    some `span` rows, and a range is hashed once the one before it is: a task holds one
    range, and one hash passes from each to the next. Written to the shared folder."""
    spark = records.sparkSession
    t = records.select(F.col("pos").cast("long").alias("pos"), "body")
    ranges = max(1, -(-t.count() // span))
    dealt, done, last = scratch(spark, "chain_ranges"), scratch(spark, "chain"), GENESIS
    t.repartitionByRange(ranges, "pos").withColumn("_range", F.spark_partition_id()).write.option("compression", "zstd").partitionBy("_range").parquet(dealt)
    t = spark.read.schema("pos long, body string, _range int").parquet(dealt)
    for k in range(ranges):
        own = t.where(F.col("_range") == k).select("pos", "body").repartition(1).sortWithinPartitions("pos").mapInArrow(_hashed(last), CHAINED)
        own.write.option("compression", "zstd").parquet(f"{done}/_range={k}")
        last = spark.read.schema(CHAINED).parquet(f"{done}/_range={k}").agg(F.max_by("record_hash", "nth")).first()[0] or last
    return spark.read.schema(CHAINED).parquet(done).select("pos", "body", "prev_hash", "record_hash")


CHAINED = "pos long, body string, prev_hash string, record_hash string, nth long"


def _hashed(last: str):
    def write(batches):
        prev, n = last, 0
        for batch in batches:
            before, own = [], []
            for body in batch.column("body").to_pylist():
                before.append(prev)
                prev = hashlib.sha256(f"{body}|{prev}".encode()).hexdigest()
                own.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string()), pa.array(range(n, n + len(own)), pa.int64())], [c.split()[0] for c in CHAINED.split(", ")])
            n += len(own)

    return write


def broken_links(records: DataFrame, text: Column | None = None) -> DataFrame:
    """Records whose prev_hash is not the hash before them, or whose own hash does
    not follow from their fields: from the canonical text, or from `text`."""
    t = with_hash_before(records, "_want")
    t = t.withColumn("link_ok", F.col("prev_hash") == F.col("_want")).withColumn("hash_ok", F.sha2(canonical() if text is None else text, 256) == F.col("record_hash"))
    return t.where(~F.col("link_ok") | ~F.col("hash_ok")).drop("_want")


def comparable(records: DataFrame, criterion: str, fill_mode: str, version: str | None = None) -> DataFrame:
    t = records.where((F.col("selection_criterion") == criterion) & (F.col("fill_mode") == fill_mode))
    return t if version is None else t.where(F.col("feature_version") == version)


def dispersion(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sample deviation of comparable ratios, where there are two or more."""
    return records.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("trials"), F.stddev_samp("sr_periodic").alias("s")).where("trials >= 2")


def hurdle(records: DataFrame, criterion: str, fill_mode: str, version: str | None = None) -> float:
    row = dispersion(comparable(records, criterion, fill_mode, version)).first()
    if row is None:
        raise ValueError("fewer than two comparable trials")
    return stats.hurdle_empirical(row["s"], row["trials"])
