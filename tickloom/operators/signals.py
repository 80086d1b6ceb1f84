"""Entry signals. The families without memory are columns over the feature
bundle; those with memory are small machines fed one bar at a time.

Fixed values: the least stop is 5 pips; grids are products of the stated lists.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.slices import over

LEAST_STOP_PIPS = 5.0

GRIDS: dict[str, dict[str, list]] = {
    "trend_pullback": {"slow": [100, 200], "rr": [1.5, 2.0, 3.0], "atr_x": [1.5, 2.5], "rsi_min": [48.0], "rsi_max": [52.0], "min_atr_pips": [1.0]},
    "opening_range_break": {"orb_hours": [1, 2], "rr": [1.5, 2.0, 3.0], "atr_x": [1.0, 1.5, 2.0]},
    "london_momentum": {"impulse_atr": [0.75, 1.0, 1.5], "rr": [1.5, 2.0, 3.0], "atr_x": [1.0, 1.5], "hour_end": [10, 11]},
    "mean_revert": {"range_z": [1.5, 2.0, 2.5], "dist_atr": [0.5, 1.0], "stop_atr": [1.0, 1.5]},
    "donchian_breakout": {"channel": [48, 96, 240, 336], "rr": [2.0, 3.0, 4.0], "atr_x": [1.5, 2.0, 2.5]},
    "trailing_momentum": {"impulse_atr": [0.75, 1.0, 1.5], "rr": [1.5, 2.0, 3.0], "atr_x": [1.0, 1.5], "hour_end": [10]},
}


def grid(name: str) -> list[dict]:
    """All parameter sets of a family, in the order of its lists."""
    axes = GRIDS[name]
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def _entry(long_: Column, short: Column, long_stop: Column, short_stop: Column, pip: float, rr: float | None, target: Column | None = None) -> list[Column]:
    """side, stop and target columns; the stop is at least LEAST_STOP_PIPS away."""
    close, least = F.col("close"), F.lit(LEAST_STOP_PIPS * pip)
    dl, ds = F.greatest(close - long_stop, least), F.greatest(short_stop - close, least)
    side = F.when(long_, "long").when(short, "short")
    stop = F.when(long_, close - dl).when(short, close + ds)
    goal = F.when(long_ | short, target) if target is not None else F.when(long_, close + rr * dl).when(short, close - rr * ds)
    return [side.alias("side"), stop.alias("stop"), goal.alias("target")]


def _known(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def _trend_pullback(p: dict, pip: float, lag) -> list[Column]:
    slow = f"sma_{p['slow']}"
    ready = _known("sma_20", slow, "atr", "rsi") & (F.col("atr") > 0) & (F.col("atr") / pip >= p["min_atr_pips"]) & lag("sma_20").isNotNull()
    last, base = lag("close"), lag(slow)
    up = ready & (F.col(slow) < F.col("sma_20")) & (last < base) & (F.col("close") > F.col("sma_20")) & (F.col("rsi") > p["rsi_min"])
    down = ready & (F.col(slow) > F.col("sma_20")) & (last > base) & (F.col("close") < F.col("sma_20")) & (F.col("rsi") < p["rsi_max"])
    far = p["atr_x"] * F.col("atr")
    return _entry(up, down, F.least("ll_24", F.col("close") - far), F.greatest("hh_24", F.col("close") + far), pip, p["rr"])


def _mean_revert(p: dict, pip: float, lag) -> list[Column]:
    ready = _known("sma_20", "range_z", "atr", "prev_day_high", "prev_day_low") & (F.col("atr") > 0) & (F.col("range_z") >= p["range_z"]) & F.col("close").between(F.col("prev_day_low"), F.col("prev_day_high"))
    reach = p["dist_atr"] * F.col("atr")
    buy = ready & (F.col("close") < F.col("sma_20")) & (F.col("low") <= F.col("sma_20") - reach)
    sell = ready & (F.col("close") > F.col("sma_20")) & (F.col("high") >= F.col("sma_20") + reach)
    pad = p["stop_atr"] * F.col("atr")
    return _entry(buy, sell, F.col("low") - pad, F.col("high") + pad, pip, None, F.col("sma_20"))


def _donchian_breakout(p: dict, pip: float, lag) -> list[Column]:
    top, floor_ = lag(f"hh_{p['channel']}"), lag(f"ll_{p['channel']}")
    ready = F.col("atr").isNotNull() & (F.col("atr") > 0) & top.isNotNull() & floor_.isNotNull()
    far = p["atr_x"] * F.col("atr")
    return _entry(ready & (F.col("close") > top), ready & (F.col("close") < floor_), F.col("close") - far, F.col("close") + far, pip, p["rr"])


# side, stop and target of a set as columns; lag(name) is that column a bar before.
STATELESS = {"trend_pullback": _trend_pullback, "mean_revert": _mean_revert, "donchian_breakout": _donchian_breakout}


def entries(family: str, bundle: DataFrame, p: dict, pip: float) -> DataFrame:
    """bundle with side, stop and target of one parameter set of a family without
    memory; the lag of one bar is taken by stretches."""
    return over(bundle, lambda t, w: t.select("*", *STATELESS[family](p, pip, lambda c: F.lag(c).over(w))), 1, "ts")


def grid_entries(family: str, bundle: DataFrame, sets: list[dict], pip: float, name: str) -> DataFrame:
    """bundle with `name`, an array of (side, stop, target) of every set: one window
    for all lags, one projection for all sets."""
    seen: dict[str, None] = {}
    for p in sets:
        STATELESS[family](p, pip, lambda c: (seen.setdefault(c), F.col(c))[1])
    if seen:
        bundle = over(bundle, lambda t, w: t.withColumns({f"_lag_{c}": F.lag(c).over(w) for c in seen}), 1, "ts")
    one = [F.struct(*STATELESS[family](p, pip, lambda c: F.col(f"_lag_{c}"))) for p in sets]
    return bundle.withColumn(name, F.array(*one)).drop(*[f"_lag_{c}" for c in seen])


def channel_volume(bars: DataFrame, k: float = 0.5, channel: int = 60, volume_rows: int = 20, factor: float = 1.2, hours: tuple[int, int] = (7, 11)) -> DataFrame:
    """The live variant: a close beyond the channel before it by k ATR on a volume
    above its average, within the session hours, the first of each day only."""

    def make(t, w):
        back = w.rowsBetween(-channel, -1)
        full = F.count(F.lit(1)).over(back) >= channel
        busy = F.col("volume") >= factor * F.avg("volume").over(w.rowsBetween(-volume_rows, -1))
        pad = k * F.col("atr")
        t = t.withColumn("side", F.when(full & (F.col("close") > F.max("high").over(back) + pad), "long").when(full & (F.col("close") < F.min("low").over(back) - pad), "short"))
        return t.withColumn("_ok", F.col("side").isNotNull() & busy & (F.hour("ts") >= hours[0]) & (F.hour("ts") < hours[1]))

    t = over(bars, make, max(channel, volume_rows), "ts").where("_ok")
    first = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    return t.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_ok")


def toy_pullback(features: DataFrame, stop_pips: float, target_pips: float, pip: float) -> DataFrame:
    """Buy where the trend is up and the last return negative."""
    on = (F.col("trend_state") == "up") & (F.col("ret_1") < 0)
    c = F.col("ask_close")
    return features.where(on).withColumn("side", F.lit("buy")).withColumn("stop", c - stop_pips * pip).withColumn("target", c + target_pips * pip)


# ------------------------------------------------------- machines with memory


class Ready:
    """Signals computed beforehand, by bar."""

    def __init__(self, side, stop, target):
        self.rows = list(zip(side, stop, target))

    def see(self, i, ts, bar):
        side, stop, target = self.rows[i]
        return (side, stop, target) if side in ("long", "short") else None


def _floored(side: str, close: float, stop: float, rr: float, pip: float):
    way = 1 if side == "long" else -1
    d = max(way * (close - stop), LEAST_STOP_PIPS * pip)
    return side, close - way * d, close + way * rr * d


class OpeningRange:
    """The range from 13:00 for some hours; until 20:00 a close beyond it enters.
    It asks again after every exit: the day has no one-shot flag."""

    def __init__(self, p: dict, pip: float):
        self.p, self.pip, self.day, self.top, self.low = p, pip, None, 0.0, 0.0

    def see(self, i, ts, bar):
        atr, end = bar["atr"], 13 + int(self.p["orb_hours"])
        if not atr > 0 or not 13 <= ts.hour < 22:
            return None
        if self.day != ts.date():
            if (ts.hour, ts.minute) == (13, 0):
                self.day, self.top, self.low = ts.date(), bar["high"], bar["low"]
            return None
        if ts.hour < end:
            self.top, self.low = max(self.top, bar["high"]), min(self.low, bar["low"])
        elif ts.hour < 20 and self.top > self.low:
            c, far = bar["close"], self.p["atr_x"] * atr
            if c > self.top:
                return _floored("long", c, c - far, self.p["rr"], self.pip)
            if c < self.low:
                return _floored("short", c, c + far, self.p["rr"], self.pip)
        return None


class Impulse:
    """From 07:00 to the end hour: a bar with a range of some ATR sets a side and an
    extreme; a later close beyond the extreme enters, once an impulse."""

    def __init__(self, p: dict, pip: float, hour_end: int):
        self.p, self.pip, self.end, self.armed = p, pip, p.get("hour_end", hour_end), None

    def see(self, i, ts, bar):
        atr = bar["atr"]
        if not atr > 0:
            return None
        if not 7 <= ts.hour < self.end:
            if ts.hour >= self.end:
                self.armed = None
            return None
        if self.armed and self.armed[0] != ts.date():
            self.armed = None
        if self.armed is None:
            if bar["high"] - bar["low"] >= self.p["impulse_atr"] * atr:
                up = bar["close"] > bar["open"]
                self.armed = (ts.date(), "long" if up else "short", bar["high"] if up else bar["low"])
            return None
        _, side, extreme = self.armed
        c, far = bar["close"], self.p["atr_x"] * atr
        if side == "long" and c > extreme:
            stop = _lesser(bar["ll_60"], c - far)
        elif side == "short" and c < extreme:
            stop = -_lesser(-bar["hh_60"], -(c + far))
        else:
            return None
        self.armed = None
        return _floored(side, c, stop, self.p["rr"], self.pip)


def _lesser(a: float, b: float) -> float:
    return b if a != a or b < a else a


MACHINES = {"opening_range_break": OpeningRange, "london_momentum": lambda p, pip: Impulse(p, pip, 11), "trailing_momentum": lambda p, pip: Impulse(p, pip, 10)}
