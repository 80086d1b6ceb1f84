"""Deterministic bars and ticks for fixtures, made by Spark from a counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(key, seed: int):
    """Uniform in [-1, 1) from a hash of the key."""
    return F.xxhash64(F.lit(seed), key) / F.lit(float(1 << 63))


def ticks(spark: SparkSession, n: int, symbol: str = "EURUSD", start: str = "2024-01-02 00:00:00", seed: int = 11, mid: float = 1.1, drift: float = 2e-6, step: float = 1.2e-4) -> DataFrame:
    """One quote a second with drift."""
    i = F.col("id")
    m = F.round(F.lit(mid) + drift * i + step * noise(i, seed), 5)
    ts = F.expr(f"timestampadd(SECOND, id, timestamp_ntz'{start}')")
    return spark.range(n).select(i.alias("seq"), ts.alias("ts"), F.lit(symbol).alias("symbol"), (m - 1e-4).alias("bid"), (m + 1e-4).alias("ask"), F.lit(1.0).alias("bid_volume"), F.lit(1.0).alias("ask_volume"), F.lit(False).alias("sequence_gap"))


def bars(spark: SparkSession, n: int = 300, symbol: str = "EURUSD", start: str = "2024-01-01 00:00:00", seed: int = 7) -> DataFrame:
    """Minute bars with the columns of resample()."""
    i = F.col("id")
    c = F.lit(1.1) + 1e-3 * F.sin(i / 9.0) + 2e-4 * noise(i, seed)
    o = F.lit(1.1) + 1e-3 * F.sin((i - 1) / 9.0) + 2e-4 * noise(i - 1, seed)
    pad = 1e-4 * (1 + F.abs(noise(i, seed + 1)))
    half = 5e-5 * (1 + F.pmod(i, F.lit(5)))
    side = lambda name, d: [(o + d).alias(f"{name}_open"), (F.greatest(o, c) + pad + d).alias(f"{name}_high"), (F.least(o, c) - pad + d).alias(f"{name}_low"), (c + d).alias(f"{name}_close")]
    at = lambda k: F.expr(f"timestampadd(MINUTE, id + {k}, timestamp_ntz'{start}')")
    flags = [F.lit(True).alias("coverage_ok"), F.lit(False).alias("known_outage"), F.lit(True).alias("tick_derived")]
    return spark.range(n).select(F.lit(symbol).alias("symbol"), at(0).alias("ts_open"), at(1).alias("available_at"), *side("bid", F.lit(0.0)), *side("ask", half), F.lit(10.0).alias("volume"), F.lit(60).cast("long").alias("tick_count"), F.lit(1000).cast("long").alias("max_quote_gap_ms"), *flags)
