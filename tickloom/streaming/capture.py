"""Captured quotes as streams: resampling, resume without repeats, monitoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.sessions import capture_bucket
from tickloom.operators.slices import block, day, highest_before, previous

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_quotes(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of raw rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_bars(quotes: DataFrame, timeframe: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Two-sided bars that close when the watermark passes them. ts is an instant
    (cast from the zone-less type)."""
    at = F.struct("ts", "seq")
    t = quotes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", timeframe), "symbol")
    sides = [f(x).alias(f"{x}_{n}") for x in ("bid", "ask") for n, f in (("open", lambda c: F.min_by(c, at)), ("high", F.max), ("low", F.min), ("close", lambda c: F.max_by(c, at)))]
    return t.agg(*sides, F.sum("bid_volume").alias("volume"), F.count(F.lit(1)).alias("tick_count")).select("symbol", F.col("window.start").alias("ts_open"), F.col("window.end").alias("available_at"), *[f"{x}_{n}" for x in ("bid", "ask") for n in ("open", "high", "low", "close")], "volume", "tick_count")


def without_repeats(quotes: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Replayed rows drop within the watermark, so a resumed feed stores each once."""
    return quotes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


MONITOR = "symbol string, ticks long, gaps long, max_gap_ms long, last_ts timestamp"
_STATE = "ticks long, gaps long, max_gap_ms long, last_us long"


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ticks, gaps, widest, last = state.get if state.exists else (0, 0, 0, -1)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for us in (rows["ts"].astype("int64") // (1000 if rows["ts"].dt.unit == "ns" else 1)).tolist():
        ticks += 1
        if last >= 0 and us < last:
            gaps += 1  # out of order: kept, counted, the high-water mark stays
        elif last >= 0:
            widest = max(widest, (us - last) // 1000)
        last = max(last, us)
    state.update((ticks, gaps, widest, last))
    yield pd.DataFrame({"symbol": [key[0]], "ticks": [ticks], "gaps": [gaps], "max_gap_ms": [widest], "last_ts": [pd.Timestamp(last, unit="us")]})


def monitor(quotes: DataFrame) -> DataFrame:
    """Per symbol: ticks, out-of-order ticks, widest gap and the high-water mark, in
    update mode. A watermark would drop the late ticks that are to be counted, so
    the mark is state."""
    t = quotes.select("symbol", "seq", F.col("ts").cast("timestamp").alias("ts"))
    return t.groupBy("symbol").applyInPandasWithState(_watch, MONITOR, _STATE, "update", GroupStateTimeout.NoTimeout)


def monitor_batch(quotes: DataFrame, span: int = 1 << 20) -> DataFrame:
    """The same figures from stored quotes, in order of seq, `span` of it a slice."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = highest_before(quotes.withColumn("_us", us), "_mark", "_us", ["symbol"], ["seq"], block("seq", span))
    late = F.col("_us") < F.col("_mark")
    gap = F.when(~late, F.floor((F.col("_us") - F.col("_mark")) / 1000)).cast("long")
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.count_if(late).alias("gaps"), F.coalesce(F.max(gap), F.lit(0)).alias("max_gap_ms"), F.max("ts").alias("last_ts"))


def sequence_flags(quotes: DataFrame, span: int = 1 << 20) -> DataFrame:
    """quotes, in order of seq, with sequence_gap: an instant before one already seen.
    Such rows are kept."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = highest_before(quotes.withColumn("_us", us), "_mark", "_us", ["symbol"], ["seq"], block("seq", span))
    return t.withColumn("sequence_gap", F.coalesce(F.col("_us") < F.col("_mark"), F.lit(False))).drop("_us", "_mark")


def downtime(quotes: DataFrame, starts: DataFrame) -> DataFrame:
    """symbol and downtime_ms: each start (symbol, since) of the service opens a window
    that the symbol's first quote at or after it closes. A quote stamped earlier than
    the window closes nothing and books no negative time; a window that a later start
    opens again before any quote counts from the later one."""
    from tickloom.operators.asof import asof_forward

    first = asof_forward(starts, quotes.select("symbol", F.col("ts").alias("_qts")), "since", "_qts", columns=["_qts"])
    last = first.where("_qts IS NOT NULL").groupBy("symbol", "_qts").agg(F.max("since").alias("since"))
    ms = F.floor((F.unix_micros(F.col("_qts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 1000)
    return last.groupBy("symbol").agg(F.sum(ms).cast("long").alias("downtime_ms"), F.count(F.lit(1)).alias("windows"))


def gaps_over_threshold(quotes: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Per symbol and capture bucket: quotes whose gap to the one before exceeds the
    bucket's own threshold in ms, and the widest gap; buckets without one are left out."""
    t = previous(quotes, "_before", F.col("ts"), ["symbol"], ["ts", "seq"], day("ts")).withColumn("bucket", capture_bucket(F.col("ts")))
    gap = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / 1000).cast("long")
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    t = t.withColumn("_gap", gap).withColumn("_limit", F.try_element_at(limit, F.coalesce("bucket", F.lit("")))).where("_limit IS NOT NULL AND _gap IS NOT NULL")
    return t.groupBy("symbol", "bucket").agg(F.count_if(F.col("_gap") > F.col("_limit")).alias("breaks"), F.max("_gap").alias("widest_ms"))


def resume_points(stored: DataFrame) -> DataFrame:
    return stored.groupBy("symbol").agg(F.max("ts").alias("last_ts"))


def stale(last: DataFrame, symbols: DataFrame, now, threshold_ms: int) -> DataFrame:
    """symbols with stale: never seen, or older than the threshold."""
    t = symbols.join(last, "symbol", "left")
    age = (F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1000
    return t.select("symbol", (F.col("last_ts").isNull() | (age > threshold_ms)).alias("stale"))


def coverage(stored: DataFrame) -> DataFrame:
    """Rows, first and last instant by symbol and month."""
    return stored.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def append_json(quotes: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Stored capture by symbol and month; the checkpoint is the resume point and
    the single-writer guard, the trigger the flush interval."""
    t = quotes.withColumn("month", F.date_format("ts", "yyyy-MM"))
    w = t.writeStream.format("json").partitionBy("symbol", "month").option("path", folder).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()
