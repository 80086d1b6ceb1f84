"""Tick-exact fills and exits: closed forms as joins, and the full replay.

Without resting state a fill is the first quote that meets a condition after an
instant: an as-of join for market orders, a first touch for levels. The replay
(one position at a time, in decimals) is sequential inside a group.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import ROUND_FLOOR, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import levels
from tickloom.operators.asof import asof_backward, asof_forward


def market_fills(orders: DataFrame, ticks: DataFrame, latency: timedelta, slip: float = 0.0) -> DataFrame:
    """orders (symbol, side, ts) with arrival, fill_price and latency_move: the
    first quote at or after ts + latency; buys pay the ask plus slip."""
    quote = ticks.select("symbol", F.col("ts").alias("qts"), "bid", "ask")
    a = asof_forward(orders.withColumn("arrival", F.col("ts") + F.lit(latency)), quote, "arrival", "qts", columns=["bid", "ask"])
    b = asof_forward(a.withColumnsRenamed({"bid": "_b1", "ask": "_a1"}), quote, "ts", "qts", columns=["bid", "ask"])
    buy = F.col("side") == "buy"
    got, ref = F.when(buy, F.col("_a1")).otherwise(F.col("_b1")), F.when(buy, F.col("ask")).otherwise(F.col("bid"))
    return b.select(*orders.columns, "arrival", (got + F.when(buy, slip).otherwise(-slip)).alias("fill_price"), (got - ref).alias("latency_move"))


def first_touch(positions: DataFrame, ticks: DataFrame, horizon: timedelta) -> DataFrame:
    """positions (id, symbol, side, ts, stop, target) with exit_ts, exit_price and
    exit_reason: the first quote within the horizon at which the closing side (bid
    for buys, ask for sells) reaches a level. A stop fills at that quote, a target
    at its level, and a quote that meets both stops. Found by levels.long_touch, whose
    rows do not multiply with the horizon or with the quotes of an hour."""
    return levels.long_touch(positions, ticks, F.lit(horizon))


# ---------------------------------------------------------------- replay


@dataclass
class Order:
    side: str  # buy or sell
    stop: Decimal
    target: Decimal | None
    volume: Decimal
    kind: str = "market"  # market, limit or stop
    level: Decimal | None = None
    good_till: datetime | None = None


@dataclass
class Venue:
    contract: Decimal = Decimal("100000")
    pip: Decimal = Decimal("0.0001")
    step: Decimal = Decimal("0.01")
    least: Decimal = Decimal("0.01")
    fee_per_lot: Decimal = Decimal("7")
    latency: timedelta = timedelta(0)
    slip_pips: Callable | None = None
    stop_slip_pips: Callable | None = None
    closes_at: datetime | None = None
    no_entry: timedelta = timedelta(minutes=5)


@dataclass
class Outcome:
    trades: list[dict] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)
    ambiguous: int = 0
    weekend_exits: int = 0


def has_saturday(a: datetime, b: datetime) -> bool:
    return any((a.date() + timedelta(days=k)).weekday() == 5 for k in range(min((b.date() - a.date()).days, 6) + 1))


class _Ahead:
    """Quotes in order of time, read on only as far as an arrival asks for."""

    def __init__(self, quotes: Iterable[tuple[datetime, Decimal, Decimal]]):
        self.rest, self.held, self.stamps, self.at = iter(quotes), [], [], -1

    def _more(self) -> bool:
        q = next(self.rest, None)
        if q is None:
            return False
        self.held.append(q)
        self.stamps.append(q[0])
        return True

    def step(self) -> tuple[datetime, Decimal, Decimal] | None:
        """The next quote; those before it go, many at once."""
        self.at += 1
        if self.at >= 4096:
            del self.held[: self.at], self.stamps[: self.at]
            self.at = 0
        return self.held[self.at] if self.at < len(self.held) or self._more() else None

    def arrival(self, ts: datetime) -> tuple[datetime, Decimal, Decimal] | None:
        """The first quote from the present one on that is not before ts."""
        while self.stamps[-1] < ts and self._more():
            pass
        j = bisect.bisect_left(self.stamps, ts, self.at)
        return self.held[j] if j < len(self.held) else None


def events(quotes: Iterable[tuple[datetime, Decimal, Decimal]], decide: Callable, venue: Venue) -> Iterator[tuple[dict | None, str | None, bool, bool]]:
    """Replay quotes (ts, bid, ask): a trade, or the reason of a refusal, as each comes
    about, and of a trade whether its quote met both levels and whether a weekend lay
    before it. On every quote: resting orders first, then the open position's levels,
    then decide(now, bid, ask), then the new order. A position opened with latency is
    tested from its arrival on."""
    resting: list[Order] = []
    held: dict | None = None
    before: datetime | None = None
    ahead = _Ahead(quotes)

    def adverse(sampler, order, now, price, buy):
        extra = (sampler(order, now) if sampler else Decimal(0)) * venue.pip
        return price + extra if buy else price - extra

    def enter(order: Order, price: Decimal, at: datetime):
        return {"order": order, "entry": price, "at": at, "risk": abs(price - order.stop) * order.volume * venue.contract}

    def meets(order: Order, bid: Decimal, ask: Decimal) -> bool:
        if order.level is None:
            return False
        if order.side == "buy":
            return ask <= order.level if order.kind == "limit" else ask >= order.level
        return bid >= order.level if order.kind == "limit" else bid <= order.level

    while (quote := ahead.step()) is not None:
        now, bid, ask = quote
        keep = []
        for order in resting:
            if order.good_till is not None and now > order.good_till:
                yield None, "expired", False, False
                continue
            got = ahead.arrival(now + venue.latency)
            if got is None or not meets(order, got[1], got[2]):
                keep.append(order)
            elif held is not None:
                yield None, "position open", False, False
            else:
                buy = order.side == "buy"
                price = order.level if order.kind == "limit" else adverse(venue.slip_pips, order, now, got[2] if buy else got[1], buy)
                held = enter(order, price, now + venue.latency)
        resting = keep
        if held is not None and now >= held["at"]:
            order, buy = held["order"], held["order"].side == "buy"
            x = bid if buy else ask
            stop = x <= order.stop if buy else x >= order.stop
            goal = order.target is not None and (x >= order.target if buy else x <= order.target)
            if stop or goal:
                price = adverse(venue.stop_slip_pips, order, now, x, not buy) if stop else order.target
                gross = (price - held["entry"] if buy else held["entry"] - price) * order.volume * venue.contract
                net = gross - order.volume * venue.fee_per_lot
                trade = {"side": order.side, "volume": order.volume, "entry_price": held["entry"], "entry_ts": held["at"], "exit_price": price, "exit_ts": now, "exit_reason": "closed_sl" if stop else "closed_tp", "pnl": net, "r_multiple": net / held["risk"] if held["risk"] > 0 else None}
                yield trade, None, stop and goal, before is not None and has_saturday(before, now)
                held = None
        order = decide(now, bid, ask)
        if order is not None and held is None:
            lots = (order.volume / venue.step).to_integral_value(ROUND_FLOOR) * venue.step
            if venue.closes_at and now >= venue.closes_at - venue.no_entry:
                yield None, "near session close", False, False
            elif lots < venue.least:
                yield None, "below least volume", False, False
            else:
                order.volume = lots
                if order.kind != "market":
                    resting.append(order)
                elif (got := ahead.arrival(now + venue.latency)) is not None:
                    buy = order.side == "buy"
                    price = adverse(venue.slip_pips, order, now, got[2] if buy else got[1], buy)
                    held = enter(order, price, now + venue.latency)
        before = now


def replay(quotes: Iterable[tuple[datetime, Decimal, Decimal]], decide: Callable, venue: Venue) -> Outcome:
    """What events() gives, collected."""
    out = Outcome()
    for trade, reason, both, weekend in events(quotes, decide, venue):
        if trade is None:
            out.refused.append(reason)
        else:
            out.trades.append(trade)
            out.ambiguous += both
            out.weekend_exits += weekend
    return out


COUNTERS = "symbol string, trades long, expired long, position_open long, near_close long, below_least long, ambiguous long, weekend_exits long"


def _signalled(batches: Iterator[pd.DataFrame], venue: Venue) -> Iterator[tuple[str, Iterator]]:
    """Each symbol of a stream in order of (symbol, ts, seq), with the events of its quotes
    under the orders that stand on them: decisions are asked for once a quote, in order,
    so quotes of one instant keep their own."""
    rows = (row for pdf in batches for row in zip(pdf["symbol"], (t.to_pydatetime() for t in pdf["ts"]), pdf["bid"], pdf["ask"], pdf["side"], pdf["stop"], pdf["target"], pdf["volume"]))

    def one(own: Iterator) -> Iterator:
        wanted = deque()

        def quotes():
            for _, ts, bid, ask, *order in own:
                wanted.append(order)
                yield ts, bid, ask

        def decide(now, bid, ask):
            side, stop, target, volume = wanted.popleft()
            return Order(side, stop, target, volume) if side in ("buy", "sell") else None

        return events(quotes(), decide, venue)

    for symbol, own in itertools.groupby(rows, lambda row: row[0]):
        yield symbol, one(own)


def _in_order(ticks_with_signals: DataFrame) -> DataFrame:
    """A symbol's quotes in order in one task, for a reader that passes them by."""
    t = ticks_with_signals.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "bid", "ask", "side", "stop", "target", "volume")
    return t.repartition("symbol").sortWithinPartitions("symbol", F.asc_nulls_last("ts"), F.asc_nulls_last("seq"))


def replay_counters(ticks_with_signals: DataFrame, venue: Venue) -> DataFrame:
    """Per symbol: trades, refusals by reason, exits on a quote that met both levels,
    and exits across a weekend."""
    cols = [x.split()[0] for x in COUNTERS.split(", ")]
    reasons = ("expired", "position open", "near session close", "below least volume")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for symbol, got in _signalled(batches, venue):
            n = Counter()
            for trade, reason, both, weekend in got:
                n.update({"trades": 1, "both": both, "weekend": weekend} if trade else {reason: 1})
            yield pd.DataFrame([(symbol, *(n[x] for x in ("trades", *reasons, "both", "weekend")))], columns=cols)

    return _in_order(ticks_with_signals).mapInPandas(run, COUNTERS)


def with_features(ticks: DataFrame, features: DataFrame, columns: list[str], tolerance: timedelta) -> DataFrame:
    """ticks with the features visible at each quote: those of the last row whose
    available_at is not after it, null beyond the tolerance."""
    return asof_backward(ticks, features.select("symbol", "available_at", *columns), "ts", "available_at", tolerance, ["symbol"], columns)


TICK_TRADES = "symbol string, n long, side string, volume decimal(18,8), entry_price decimal(18,8), entry_ts timestamp_ntz, exit_price decimal(18,8), exit_ts timestamp_ntz, exit_reason string, pnl decimal(38,10), r_multiple decimal(38,10)"
LOT = 4096  # trades of one output batch


def replay_table(ticks_with_signals: DataFrame, venue: Venue) -> DataFrame:
    """Replay every symbol. Rows: symbol, ts, seq, bid, ask and, where a signal
    stands, side, stop, target and volume; prices as decimals."""

    cols = [x.split()[0] for x in TICK_TRADES.split(", ")]
    q = lambda d: d if d is None else d.quantize(Decimal("1e-10"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for symbol, got in _signalled(batches, venue):
            trades = enumerate(trade for trade, *_ in got if trade is not None)
            while rows := [{"symbol": symbol, "n": k, **t, "pnl": q(t["pnl"]), "r_multiple": q(t["r_multiple"])} for k, t in itertools.islice(trades, LOT)]:
                yield pd.DataFrame(rows, columns=cols)

    return _in_order(ticks_with_signals).mapInPandas(run, TICK_TRADES)
