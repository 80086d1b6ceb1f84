"""Whole jobs: the cost gate over stored quotes, and one strategy end to end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import bars, costs, features, signals, ticks
from tickloom.sources import tables


def cost_gate(quotes: DataFrame, out: str, timeframes: list[str], pip: float, commission_pips: float, bound: float, limit: float = 0.25, **settings) -> DataFrame:
    """The cost cube of quotes, written as a gate record to `out`, and each symbol's
    verdict. A record holds one row a symbol, session, timeframe and multiple."""
    cube = costs.cost_cube(quotes, timeframes, pip, commission_pips, bound, **settings).persist()
    try:
        names = {"entry_pips": "entry_spread_pips", "exit_pips": "stop_exit_spread_pips"}
        cells = [r.asDict() for r in cube.withColumnsRenamed(names).orderBy("symbol", "session", "timeframe").collect()]
        tables.write_json(quotes.sparkSession, {"cells": cells}, out)
        verdict = costs.gate_verdict(cube, limit)
        return quotes.sparkSession.createDataFrame(verdict.collect(), verdict.schema)
    finally:
        cube.unpersist()


def vertical_slice(quotes: DataFrame, timeframe: str, threshold_ms: int, pip: float, stop_pips: float, target_pips: float, trend: int = 200, latency: timedelta = timedelta(0), horizon: timedelta = timedelta(days=1)) -> DataFrame:
    """One strategy from quotes to trades: bars, features, signals on closed bars, the
    first quote after the latency as fill, the first touch of stop or target as exit.
    A row a signal that fills, its exit null where no level is met in time."""
    b = bars.resample(quotes, timeframe, threshold_ms)
    f = features.trend_regime(features.returns_and_atr(b), trend)
    s = signals.toy_pullback(f, stop_pips, target_pips, pip)
    orders = s.select(F.concat_ws("@", "symbol", F.col("available_at").cast("string")).alias("id"), "symbol", F.col("available_at").alias("ts"), "side", "stop", "target")
    fills = ticks.market_fills(orders, quotes, latency).where("fill_price IS NOT NULL")
    exits = ticks.first_touch(fills.select("id", "symbol", "side", F.col("arrival").alias("ts"), "stop", "target", "fill_price"), quotes, horizon)
    return exits.withColumn("pnl_pips", (F.col("exit_price") - F.col("fill_price")) / F.lit(pip))
