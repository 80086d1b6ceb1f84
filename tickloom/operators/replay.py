"""Bar replay: one position at a time over parameter grids.

Sizing depends on the balance, so a run is sequential inside (symbol, parameter
set) and parallel across them: bars meet chunks of the grid by a small exploded
key, never one copy a parameter set in one group.
"""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import signals

MAX_COST_RATIO, VOLUME_STEP = 0.25, 0.01


@dataclass
class Account:
    """Instrument, costs and limits of a run."""

    pip: float = 0.0001
    contract: float = 100_000.0
    quote: str = "USD"
    spreads: dict[str, float] = field(default_factory=dict)
    balance: float = 10_000.0
    risk: float = 0.01
    daily_loss: float = 0.05
    commission_per_lot: float = 6.0
    max_bars: int = 480
    friday_hour: int = 21
    trail: dict | None = None

    def pip_usd(self, price: float) -> float:
        per_pip = self.contract * self.pip
        if self.quote == "USD":
            return per_pip
        if self.quote == "JPY":
            return per_pip / price
        raise ValueError(f"no conversion for quote currency {self.quote}")


def session_of_hour(hour: int) -> str:
    return ("rollover" if hour >= 22 or hour < 1 else "asia" if hour < 7 else "london" if hour < 12 else "overlap" if hour < 13 else "new_york" if hour < 17 else "asia")


class Book:
    """Balance, drawdown, lock and the closed trades of one run."""

    def __init__(self, acc: Account):
        self.acc, self.balance, self.peak, self.drawdown = acc, acc.balance, acc.balance, 0.0
        self.day: date | None = None
        self.day_pnl = 0.0
        self.locked_to: date | None = None
        self.trades: list[dict] = []
        self.vetoes = self.rejected = self.lockouts = 0

    def roll(self, today: date) -> bool:
        """Start a day where one begins; whether the day is locked."""
        if today != self.day:
            self.day, self.day_pnl = today, 0.0
        return self.locked_to is not None and today <= self.locked_to

    def mark(self) -> None:
        self.peak = max(self.peak, self.balance)
        self.drawdown = max(self.drawdown, 100 * (self.peak - self.balance) / self.peak)

    def open(self, way: int, price: float, stop: float, target: float | None, intended: float, spread: float, ts, i: int):
        """A position of fixed risk; "veto" for a poor stop, "reject" below a step."""
        acc, dist = self.acc, abs(price - stop)
        if dist <= 0 or intended <= 0 or spread * acc.pip / intended > MAX_COST_RATIO or intended / acc.pip < signals.LEAST_STOP_PIPS:
            self.vetoes += 1
            return "veto"
        per_pip = acc.pip_usd(price)
        raw = self.balance * acc.risk / (dist / acc.pip * per_pip)
        if raw < VOLUME_STEP:
            self.rejected += 1
            return "reject"
        lots = int(raw / VOLUME_STEP) * VOLUME_STEP
        return {"way": way, "entry": price, "stop": stop, "target": target, "ts": ts, "i": i, "lots": lots, "per_pip": per_pip, "fee": lots * acc.commission_per_lot, "risk": lots * (dist / acc.pip) * per_pip, "dist": dist, "best": price, "trailed": False}

    def close(self, pos: dict, price: float, ts, why: str, held: int) -> None:
        net = pos["way"] * (price - pos["entry"]) / self.acc.pip * pos["per_pip"] * pos["lots"] - pos["fee"]
        self.balance += net
        self.day_pnl += net
        self.trades.append({"side": "long" if pos["way"] > 0 else "short", "entry_ts": pos["ts"], "exit_ts": ts, "entry_price": pos["entry"], "exit_price": price, "stop_price": pos["stop"], "volume": pos["lots"], "pnl": net, "commission": pos["fee"], "r": net / pos["risk"] if pos["risk"] > 0 else 0.0, "exit_reason": why, "bars_held": held})


def trail(pos: dict, rule: dict) -> None:
    """After a run-up of act_r risks the stop follows the best price of earlier bars
    at sl_r risks, the target tp_r beyond it; neither ever moves back."""
    way, d = pos["way"], pos["dist"]
    if way * (pos["best"] - pos["entry"]) < rule["act_r"] * d:
        return
    stop = pos["best"] - way * rule["sl_r"] * d
    if way * (stop - pos["stop"]) > 0:
        pos["stop"], pos["trailed"] = stop, True
    goal = pos["best"] + way * rule["tp_r"] * d
    if pos["target"] is None or way * (goal - pos["target"]) > 0:
        pos["target"] = goal


def exit_of(pos: dict, high: float, low: float, close: float, ask_gap: float, held: int, late: bool, acc: Account):
    """(price, reason) where the position ends on this bar. Longs close at the bid,
    shorts at the ask; a bar that holds both levels stops."""
    if pos["way"] > 0:
        stopped = low <= pos["stop"]
        hit = pos["target"] is not None and high >= pos["target"]
    else:
        stopped = high + ask_gap >= pos["stop"]
        hit = pos["target"] is not None and low + ask_gap <= pos["target"]
    prefix = "trail_" if pos["trailed"] else ""
    if stopped:
        return pos["stop"], prefix + "sl"
    if hit:
        return pos["target"], prefix + "tp"
    if held >= acc.max_bars:
        return close, "timeout"
    return (close, "friday_close") if late else None


def run(bars: dict, machine, acc: Account, first: int = 0, last: int | None = None) -> Book:
    """Replay bars [first, last): a pending entry fills at the open, then the
    position trails and exits, then a free book looks for the next signal."""
    book, pos, waiting = Book(acc), None, None
    ts, o, h, l, c = (bars[k] for k in ("ts", "open", "high", "low", "close"))  # noqa: E741
    names = [k for k in bars if k != "ts"]
    last = len(ts) if last is None else last
    spread = [acc.spreads[session_of_hour(t.hour)] for t in ts]
    i = first
    for i in range(first + 1, last):
        now = ts[i]
        locked = book.roll(now.date())
        late = now.weekday() == 4 and now.hour >= acc.friday_hour
        if waiting is not None and pos is None and not locked:
            side, stop, target, ref, cost = waiting
            waiting = None
            way = 1 if side == "long" else -1
            got = book.open(way, o[i] + (cost * acc.pip if way > 0 else 0.0), stop, target, abs(ref - stop), cost, now, i)
            if got == "reject":
                continue
            pos = got if got != "veto" else None
        if pos is not None:
            if acc.trail:
                trail(pos, acc.trail)
            end = exit_of(pos, h[i], l[i], c[i], spread[i] * acc.pip, i - pos["i"], late, acc)
            if end:
                book.close(pos, end[0], now, end[1], i - pos["i"])
                pos = None
                if book.day_pnl <= -acc.daily_loss * book.balance:
                    book.locked_to = now.date() + timedelta(days=1)
                    book.lockouts += 1
            else:
                pos["best"] = max(pos["best"], h[i]) if pos["way"] > 0 else min(pos["best"], l[i])
        if pos is None and waiting is None and not locked and not late:
            signal = machine.see(i, now, {k: bars[k][i] for k in names})
            if signal:
                waiting = (*signal, c[i], spread[i])
        book.mark()
    if pos is not None:
        book.close(pos, c[last - 1] + (0.0 if pos["way"] > 0 else spread[last - 1] * acc.pip), ts[last - 1], "end_of_data", i - pos["i"])
    return book


TRADES = "symbol string, strategy string, params string, side string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, stop_price double, volume double, pnl double, commission double, r double, exit_reason string, bars_held long, n long"
COLUMNS = [x.split()[0] for x in TRADES.split(", ")]


def grid_replay(bundle: DataFrame, strategy: str, params: list[dict], acc: Account, chunk: int = 4, split=None, part: str = "all", trails: list[dict] | None = None) -> DataFrame:
    """Trades of every parameter set over the feature bundle of each symbol.

    part "train" replays bars before split, "valid" those from it on, with the
    features of the whole history either way. Signals of the families without
    memory are columns made by Spark beforehand. With trails, every set runs once
    with each, and `params` is the set and the trail.
    """
    sets = [json.dumps(p, sort_keys=True) for p in params]
    runs = [("", acc)] if trails is None else [(f"|{t}", replace(acc, trail=t)) for t in trails]
    stateless = strategy in signals.STATELESS
    if stateless:
        # One pass over the bundle for all sets: a struct a set, then a row each.
        bar = ["symbol", "ts", "open", "high", "low", "close"]
        rows = signals.grid_entries(strategy, bundle, params, acc.pip, "_sets").select(*bar, F.posexplode("_sets").alias("_at", "_s"))
        rows = rows.select(*bar, F.element_at(F.array(*[F.lit(x) for x in sets]), F.col("_at") + 1).alias("params"), "_s.*")
        keys = ["symbol", "params"]
    else:
        chunks = F.array(*[F.lit(k) for k in sorted({i // chunk for i in range(len(sets))})])
        rows = bundle.select("symbol", "ts", "open", "high", "low", "close", "atr", "hh_60", "ll_60").withColumn("chunk", F.explode(chunks))
        keys = ["symbol", "chunk"]

    def replay_group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        stamps = [t.to_pydatetime() for t in pdf["ts"]]
        bars = {k: pdf[k].to_numpy(float).tolist() for k in pdf.columns if k not in ("symbol", "ts", "side", "params", "chunk")} | {"ts": stamps}
        first, last = 0, len(stamps)
        if split is not None:
            at = int(np.searchsorted(pdf["ts"].to_numpy(), np.datetime64(split)))
            first, last = (0, at) if part == "train" else (at, len(stamps))
        out = []
        if stateless:
            ready = signals.Ready(pdf["side"].tolist(), bars["stop"], bars["target"])
            todo = [(key[1], ready)]
        else:
            todo = [(s, signals.MACHINES[strategy](json.loads(s), acc.pip)) for i, s in enumerate(sets) if i // chunk == key[1]]
        for name, machine in todo:
            for mark, a in runs:
                book = run(bars, deepcopy(machine), a, first, last)
                out += [{"symbol": key[0], "strategy": strategy, "params": name + mark, **t, "n": k} for k, t in enumerate(book.trades)]
        return pd.DataFrame(out, columns=COLUMNS)

    return rows.groupBy(*keys).applyInPandas(replay_group, TRADES)
