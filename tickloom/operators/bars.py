"""Ticks to two-sided bars, and bars to longer bars."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.sessions import timeframe_seconds
from tickloom.operators.slices import day, previous


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned interval that holds ts."""
    step = seconds * 1_000_000
    us = micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step))).cast("timestamp_ntz")


def overlaps(start: Column, end: Column, outages: list[tuple[datetime, datetime]]) -> Column:
    """Whether [start, end) meets any interval of a register of stated outages."""
    hits = [(start < F.lit(b).cast("timestamp_ntz")) & (end > F.lit(a).cast("timestamp_ntz")) for a, b in outages]
    return reduce(lambda x, y: x | y, hits, F.lit(False))


def outage_overlap(bars: DataFrame, register: DataFrame) -> DataFrame:
    """bars with known_outage from a register table (symbol, start, end) of any length:
    an outage that meets [ts_open, available_at), of the symbol or, where its symbol is
    null, of all. Both sides are written out for the days they touch, an equi-join."""
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b)))
    o = register.select(F.col("symbol").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b")).withColumn("_day", days("_a", "_b"))
    t = bars.drop("known_outage").withColumn("_d", days("ts_open", "available_at"))
    on = (F.col("_d") == F.col("_day")) & (F.col("ts_open") < F.col("_b")) & (F.col("available_at") > F.col("_a")) & F.coalesce(F.col("_s") == F.col("symbol"), F.lit(True))
    hit = t.join(o, on, "left_semi").select("symbol", "ts_open").distinct().withColumn("known_outage", F.lit(True))
    return bars.drop("known_outage").join(hit, ["symbol", "ts_open"], "left").withColumn("known_outage", F.coalesce("known_outage", F.lit(False)))


def resample(ticks: DataFrame, timeframe: str, threshold_ms: int, outages: list | None = None) -> DataFrame:
    """Two-sided bars with coverage flags; empty bars are not made.

    The quote gap before a tick is booked in the tick's own bar. The lag is taken
    within a symbol's days, only each day's last instant passes between them; the
    aggregate combines on the map side.
    """
    seconds = timeframe_seconds(timeframe)
    gap = F.coalesce(micros(F.col("ts")) - F.col("_before"), F.lit(0))
    t = previous(ticks, "_before", micros(F.col("ts")), ["symbol"], ["ts", "seq"], day("ts")).withColumn("_gap", F.floor(gap / 1000).cast("long")).withColumn("ts_open", bucket_start(F.col("ts"), seconds))
    at = F.struct("ts", "seq")
    sides = [f(x).alias(f"{x}_{n}") for x in ("bid", "ask") for n, f in (("open", lambda c: F.min_by(c, at)), ("high", F.max), ("low", F.min), ("close", lambda c: F.max_by(c, at)))]
    out = t.groupBy("symbol", "ts_open").agg(*sides, F.sum("bid_volume").alias("volume"), F.count(F.lit(1)).alias("tick_count"), F.max("_gap").alias("max_quote_gap_ms"))
    out = out.withColumn("available_at", F.col("ts_open") + F.make_dt_interval(secs=F.lit(seconds)))
    out = out.withColumn("coverage_ok", F.col("max_quote_gap_ms") <= threshold_ms)
    out = out.withColumn("known_outage", overlaps(F.col("ts_open"), F.col("available_at"), outages or []))
    return out.withColumn("tick_derived", F.lit(True))


def usable(bars: DataFrame) -> DataFrame:
    return bars.where("coverage_ok AND NOT known_outage")


def aggregate_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """(symbol, ts, open, high, low, close) bars to n-minute bars, epoch-aligned."""
    t = bars.withColumn("_b", bucket_start(F.col("ts"), minutes * 60))
    out = t.groupBy("symbol", "_b").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    return out.withColumnRenamed("_b", "ts")


def last_close(bars: DataFrame, seconds: int) -> DataFrame:
    """Companion frame of a longer timeframe: its close, and when it is known."""
    t = bars.withColumn("_b", bucket_start(F.col("ts_open"), seconds))
    out = t.groupBy("symbol", "_b").agg(F.max_by("bid_close", "ts_open").alias("higher_close"))
    return out.select("symbol", F.col("_b").alias("ts_open"), "higher_close", (F.col("_b") + F.make_dt_interval(secs=F.lit(seconds))).alias("available_at"))
