"""Validation rules: each gives rows or one count, none repairs anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.slices import block, over, previous


def check_ticks(ticks: DataFrame) -> DataFrame:
    """One row a rule: rule, action, n. Empty, crossed and non-positive quotes
    reject."""
    c = ticks.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ask") < F.col("bid")).alias("crossed"), F.count_if((F.col("ask") <= 0) | (F.col("bid") <= 0)).alias("non_positive"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit("reject").alias("action"), v.cast("long").alias("n")) for n, v in (("empty", F.when(F.col("rows") == 0, 1).otherwise(0)), ("crossed", F.col("crossed")), ("non_positive", F.col("non_positive")))])
    return c.select(F.inline(rules))


def incoherent(bars: DataFrame) -> DataFrame:
    """Bars where a side's low or high does not bound its open and close."""
    bad = None
    for s in ("bid", "ask"):
        x = (F.col(f"{s}_low") > F.least(f"{s}_open", f"{s}_close")) | (F.col(f"{s}_high") < F.greatest(f"{s}_open", f"{s}_close"))
        bad = x if bad is None else bad | x
    return bars.where(bad)


def duplicated(bars: DataFrame, keys: list[str]) -> DataFrame:
    """All members of every group of rows with the same keys."""
    groups = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return bars.join(groups, keys)


def weekend(bars: DataFrame, ts: str = "ts_open") -> DataFrame:
    return bars.where(F.weekday(ts) >= 5)


def spikes(bars: DataFrame, times: float = 15.0, rows: int = 100, ts: str = "ts_open") -> DataFrame:
    """Bars whose |close / open - 1| exceeds `times` the deviation of the bar
    returns before it (at most `rows`, at least two)."""

    def make(t, w):
        back = w.rowsBetween(-rows, -1)
        return t.withColumn("sigma", F.when(F.count("ret").over(back) >= 2, F.stddev_samp("ret").over(back)))

    t = over(bars.withColumn("ret", F.col("bid_close") / F.col("bid_open") - 1), make, rows, ts)
    return t.where(F.abs("ret") > times * F.col("sigma"))


def session_shares(bars: DataFrame, ts: str = "ts_open") -> DataFrame:
    """Share of volume by whole-hour session: asia, london, overlap hours apart."""
    h = F.hour(ts)
    name = F.when(h < 7, "asia").when(h < 12, "london").when(h < 16, "new_york").otherwise("other")
    total = bars.agg(F.sum("volume").alias("_all"))
    t = bars.groupBy(name.alias("session")).agg(F.sum("volume").alias("volume"))
    return t.join(F.broadcast(total)).select("session", "volume", (F.col("volume") / F.col("_all")).alias("share"), (F.col("volume") / F.col("_all") > 0.2).alias("peak"))


def missing_peaks(shares: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected sessions that are no volume peak."""
    return expected.join(shares.where("peak"), "session", "left_anti")


def too_precise(bars: DataFrame, column: str, digits: int) -> DataFrame:
    """Rows whose value has more than `digits` decimals."""
    return bars.where(F.col(column) != F.round(column, digits))


def candle_faults(candles: DataFrame, low: float = 0.001, high: float = 100_000.0, span: float = 1 << 16) -> DataFrame:
    """Candles out of order, with a range that does not bound open and close, or
    with a price outside (low, high). span: how much of seq is one slice."""
    t = previous(candles, "_prev", F.col("ts"), ["symbol"], ["seq"], block("seq", span))
    fault = F.when(F.col("ts") <= F.col("_prev"), "order").when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), "range").when((F.col("high") <= low) | (F.col("high") >= high), "scale")
    return t.withColumn("fault", fault).where("fault IS NOT NULL").drop("_prev")


def check_bars(bars: DataFrame, ts: str = "ts_open", digits: int | None = None) -> DataFrame:
    """rule, action and n of all bar rules."""
    n = lambda df, rule, action: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(action).alias("action"), "n")
    out = n(duplicated(bars, ["symbol", ts]), "duplicates", "reject")
    out = out.unionByName(n(incoherent(bars), "ohlc", "reject")).unionByName(n(weekend(bars, ts), "weekend", "quarantine")).unionByName(n(spikes(bars, ts=ts), "spike", "flag"))
    return out if digits is None else out.unionByName(n(too_precise(bars, "bid_close", digits), "precision", "flag"))


def drift(documented: DataFrame, observed: DataFrame, fields: list[str], key: str = "symbol") -> DataFrame:
    """Fields whose documented and observed values differ by more than 1e-12."""
    long = lambda df, name: df.unpivot([key], fields, "field", name)
    return long(documented, "documented").join(long(observed, "observed"), [key, "field"]).where(F.abs(F.col("documented") - F.col("observed")) > 1e-12)
