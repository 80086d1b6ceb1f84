"""Causal features over trailing rows of one symbol, keyed by available_at.

A window that is not full gives null. Histories are cut into stretches that carry
the rows their frames look back on (see slices.over), so a symbol is many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.slices import day, numbered, over, smoothed


def full(fn, x: Column, n: int, w) -> Column:
    """fn over the last n rows; null unless all n are there and not null."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= n, fn(x).over(frame))


def change(x: Column, n: int, w) -> Column:
    return x / F.lag(x, n).over(w) - 1


def returns_and_atr(bars: DataFrame, n: int = 1, atr: int = 14) -> DataFrame:
    """ret_1 and atr (mean of the larger of range and distance from the last close)."""
    c = F.col("bid_close")

    def make(t, w):
        t = t.withColumn("ret_1", change(c, n, w)).withColumn("_tr", F.greatest(F.col("bid_high") - F.col("bid_low"), F.abs(c - F.lag(c).over(w))))
        return t.withColumn("atr", full(F.avg, F.col("_tr"), atr, w)).drop("_tr")

    return over(bars, make, max(n, atr), "available_at")


def spread_regime(bars: DataFrame, n: int = 60, elevated: float = 1.5) -> DataFrame:
    """spread_median over n rows, its ratio, and normal or elevated."""

    def make(t, w):
        frame = w.rowsBetween(-(n - 1), 0)
        return t.withColumn("spread_median", F.when(F.count("spread").over(frame) >= n, F.percentile("spread", F.lit(0.5)).over(frame)))

    t = over(bars.withColumn("spread", F.col("ask_close") - F.col("bid_close")), make, n - 1, "available_at")
    t = t.withColumn("spread_ratio", F.col("spread") / F.nullif(F.col("spread_median"), F.lit(0.0)))
    return t.withColumn("spread_regime", F.when(F.col("spread_ratio").isNull(), None).when(F.col("spread_ratio") > elevated, "elevated").otherwise("normal"))


def trend_regime(bars: DataFrame, n: int = 200, bound: float = 0.5) -> DataFrame:
    c = F.col("bid_close")
    t = over(bars, lambda t, w: t.withColumn("trend_strength", (c - full(F.avg, c, n, w)) / F.nullif(full(F.stddev_samp, c, n, w), F.lit(0.0))), n - 1, "available_at")
    s = F.col("trend_strength")
    return t.withColumn("trend_state", F.when(s.isNull(), None).when(s > bound, "up").when(s < -bound, "down").otherwise("none"))


def vol_quintile(with_atr: DataFrame, mean: int = 20, lookback: int = 252, interpolation: str = "nearest") -> DataFrame:
    """vol_regime_quintile: mean ATR against its own trailing 20/40/60/80 % quantiles,
    thresholds inclusive.

    No quantile is formed. The value stands in its own window, so whether it exceeds a
    quantile follows from how many values of the window are smaller: more than the
    quantile's place among them, whose fraction, if there is one, never matters (between
    two neighbours in order the value is either the lower one or not below the upper).
    """
    places = [_place(p, lookback, interpolation) for p in (0.2, 0.4, 0.6, 0.8)]

    def make(t, w):
        frame = w.rowsBetween(-(lookback - 1), 0)
        t = t.withColumn("_mean", full(F.avg, F.col("atr"), mean, w)).withColumn("_window", F.collect_list("_mean").over(frame))
        smaller = F.size(F.filter("_window", lambda x: x < F.col("_mean")))
        quintile = F.lit(1)
        for place in places:
            quintile = quintile + F.when(smaller > place, 1).otherwise(0)
        return t.withColumn("vol_regime_quintile", F.when(F.col("_mean").isNotNull() & (F.size("_window") >= lookback), quintile).cast("long")).drop("_mean", "_window")

    return over(with_atr, make, mean + lookback, "available_at")


def _place(q: float, n: int, interpolation: str) -> int:
    """The place, from 0, of a quantile among n sorted values; the lower one of two."""
    exact = q * (n - 1)
    if interpolation == "higher":
        return math.ceil(exact)
    if interpolation == "nearest":
        return round(exact)  # halves to even
    if interpolation in ("linear", "lower", "midpoint"):
        return math.floor(exact)
    raise ValueError(f"no interpolation {interpolation}")


def channels(bars: DataFrame, windows: tuple[int, ...] = (24, 48, 60, 96, 240, 336), ts: str = "ts") -> DataFrame:
    """hh_n and ll_n, current row included."""
    return over(bars, lambda t, w: _channels(t, windows, w), max(windows), ts)


def _channels(bars: DataFrame, windows: tuple[int, ...], w) -> DataFrame:
    for n in windows:
        bars = bars.withColumn(f"hh_{n}", full(F.max, F.col("high"), n, w)).withColumn(f"ll_{n}", full(F.min, F.col("low"), n, w))
    return bars


def averages(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 100, 200), ts: str = "ts") -> DataFrame:
    return over(bars, lambda t, w: _averages(t, windows, w), max(windows), ts)


def _averages(bars: DataFrame, windows: tuple[int, ...], w) -> DataFrame:
    for n in windows:
        bars = bars.withColumn(f"sma_{n}", full(F.avg, F.col("close"), n, w))
    return bars


def true_range(w) -> Column:
    """Three-term true range; the first row's is its range."""
    last = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def z_score(x: Column, n: int, w) -> Column:
    """(x - mean) / population deviation over n rows; 0 where that is nil."""
    sd = full(F.stddev_pop, x, n, w)
    return F.when(sd <= 1e-12, 0.0).otherwise((x - full(F.avg, x, n, w)) / sd)


def wilder_rsi(bars: DataFrame, n: int = 14, ts: str = "ts") -> DataFrame:
    """rsi with Wilder's recursive mean, seeded by the mean of the first n changes; 100
    where nothing was lost, null before row n."""
    move = lambda w: F.col("close") - F.lag("close").over(w)
    means = {"_gain": lambda w: F.greatest(move(w), F.lit(0.0)), "_loss": lambda w: F.greatest(-move(w), F.lit(0.0))}
    t = smoothed(bars, means, n, ts)
    gain, loss = F.col("_gain"), F.col("_loss")
    return t.withColumn("rsi", F.when(gain.isNull(), None).when(loss <= 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))).drop("_gain", "_loss")


def day_levels(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """day_open, and high and low of the previous trading day (null on the first)."""
    day = F.to_date(ts)
    daily = bars.groupBy("symbol", day.alias("_day")).agg(F.min_by("open", ts).alias("day_open"), F.max("high").alias("_h"), F.min("low").alias("_l"))
    w = Window.partitionBy("symbol").orderBy("_day")
    daily = daily.select("symbol", "_day", "day_open", F.lag("_h").over(w).alias("prev_day_high"), F.lag("_l").over(w).alias("prev_day_low"))
    return bars.withColumn("_day", day).join(daily, ["symbol", "_day"]).drop("_day")


def lab_bundle(bars: DataFrame, rsi: bool = True) -> DataFrame:
    """All features the bar strategies read, on (symbol, ts, open, high, low, close);
    rsi, the only recursive one, may be left out."""
    lines, means = (24, 48, 60, 96, 240, 336), (20, 50, 100, 200)

    def make(t, w):
        t = _channels(_averages(t, means, w), lines, w)
        t = t.withColumn("_tr", true_range(w)).withColumn("atr", full(F.avg, F.col("_tr"), 14, w)).drop("_tr")
        t = t.withColumn("ret1", F.coalesce(change(F.col("close"), 1, w), F.lit(0.0))).withColumn("ret5", F.coalesce(change(F.col("close"), 5, w), F.lit(0.0)))
        return t.withColumn("vol_z", z_score(F.col("ret1"), 120, w)).withColumn("range_z", z_score(F.col("high") - F.col("low"), 120, w))

    t = day_levels(over(bars, make, max(lines), "ts"))
    return wilder_rsi(t) if rsi else t


def centred_mean(bars: DataFrame, n: int = 2, ts: str = "available_at") -> DataFrame:
    """A feature that looks ahead, for negative controls."""
    return over(bars, lambda t, w: t.withColumn("centred", F.avg("bid_close").over(w.rowsBetween(-n, n))), n, ts, after=n)


def full_rank(bars: DataFrame) -> DataFrame:
    """Average rank over the whole series, which also looks ahead."""
    w = Window.partitionBy("symbol").orderBy("bid_close")
    same = Window.partitionBy("symbol", "bid_close")
    return bars.withColumn("full_rank", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def composite(bars: DataFrame, atr: int = 14, spread: int = 60, trend: int = 200, mean: int = 20, lookback: int = 252) -> DataFrame:
    """All features of the bar pipeline on one frame: returns, ATR, spread and trend
    regime, volatility quintile."""
    return vol_quintile(trend_regime(spread_regime(returns_and_atr(bars, 1, atr), spread), trend), mean, lookback)


def join_on_open(bars: DataFrame, higher: DataFrame, column: str = "higher_close") -> DataFrame:
    """A negative control: the longer bar's close joined on its opening time, when it
    does not exist yet."""
    return bars.join(higher.select("symbol", "ts_open", column), ["symbol", "ts_open"], "left")


def truncation_difference(pipeline, inputs: DataFrame, cutoff, columns: list[str], warmup: int = 0) -> int:
    """Rows at or before the cutoff that change when later input is removed: 0 for
    an honest pipeline."""
    key = ["symbol", "available_at"]
    cut = F.lit(cutoff).cast("timestamp_ntz")
    place = lambda df: numbered(df, ["symbol"], [F.col("available_at")], day("available_at")).where(F.col("_pos") >= warmup)
    pick = lambda df: (place(df) if warmup else df).where(F.col("available_at") <= cut)
    whole, part = pick(pipeline(inputs)), pick(pipeline(inputs.where(F.col("available_at") <= cut)))
    a = whole.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    b = part.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        number = dict(whole.dtypes)[c] in ("double", "float")
        same = x.eqNullSafe(y) | (F.abs(x - y) <= 1e-12) if number else x.eqNullSafe(y)
        bad = bad | ~F.coalesce(same, F.lit(False))
    return a.join(b, key, "full_outer").where(bad).count()
