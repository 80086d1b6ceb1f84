"""Hand-worked cases of the quote-data operators."""

import json
import lzma
import struct
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import sessions, stats, units
from tickloom.operators import asof, bars, costs, dedupe, features, ledger, portfolio, replay, research, rules, signals, ticks, validate
from tickloom.sources import binary, dimensions, synthetic, tables

T0 = datetime(2024, 1, 2)
QUOTE = "seq long, symbol string, ts timestamp_ntz, bid double, ask double, bid_volume double"


def rows(df):
    return [tuple(r) for r in df.collect()]


def quote_rows(stamps, bid=1.1, half=1e-4, symbol="EURUSD"):
    return [(i, symbol, t, bid + i * 1e-5, bid + i * 1e-5 + 2 * half, 1.0) for i, t in enumerate(stamps)]


def test_resample_gap_lands_in_the_following_bar(spark):
    stamps = [T0 + timedelta(seconds=i) for i in range(60)] + [T0 + timedelta(seconds=150 + i) for i in range(90)]
    q = spark.createDataFrame(quote_rows(stamps), QUOTE)
    got = {r["ts_open"].minute: r for r in bars.resample(q, "1m", 5_000).collect()}
    assert sorted(got) == [0, 2, 3] and got[0]["coverage_ok"] and not got[2]["coverage_ok"]
    assert got[2]["max_quote_gap_ms"] == 91_000 and got[0]["tick_count"] == 60
    assert got[0]["bid_open"] == pytest.approx(1.1) and got[0]["bid_close"] == pytest.approx(1.1 + 59e-5)
    out = bars.resample(q, "1m", 5_000, [(T0 + timedelta(seconds=30), T0 + timedelta(seconds=31))])
    assert {r["ts_open"].minute for r in out.where("known_outage").collect()} == {0}
    assert bars.usable(out).count() == 1
    with pytest.raises(ValueError):
        bars.resample(q, "0m", 1)


def test_synthetic_slice_has_ninety_bars(spark):
    assert bars.resample(synthetic.ticks(spark, 5400), "1m", 60_000).count() == 90


def test_tick_rules(spark):
    q = spark.createDataFrame([(0, "A", T0, 1.0, 0.9, 1.0), (1, "A", T0, -1.0, 1.0, 1.0), (2, "A", T0, 1.0, 1.1, 1.0)], QUOTE)
    assert dict((r[0], r[2]) for r in rows(validate.check_ticks(q))) == {"empty": 0, "crossed": 1, "non_positive": 1}
    assert dict((r[0], r[2]) for r in rows(validate.check_ticks(q.where("seq > 9"))))["empty"] == 1


def test_duplicates_count_every_member(spark):
    b = synthetic.bars(spark, 5)
    assert validate.duplicated(b.unionByName(b.limit(1)), ["symbol", "ts_open"]).count() == 2


def test_asof_ties_staleness_and_direction(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    left = spark.createDataFrame([(1, "A", at(0)), (2, "A", at(10)), (3, "A", at(200)), (4, "B", at(10))], "id long, symbol string, ts timestamp_ntz")
    right = spark.createDataFrame([("A", at(0), 7), ("A", at(5), 8), ("A", at(11), 9)], "symbol string, at timestamp_ntz, v int")
    back = dict(rows(asof.asof_backward(left, right, "ts", "at", timedelta(hours=1)).select("id", "v")))
    assert back == {1: 7, 2: 8, 3: None, 4: None}
    strict = dict(rows(asof.asof_backward(left, right, "ts", "at", None, strict=True, unlimited=True).select("id", "v")))
    assert strict == {1: None, 2: 8, 3: 9, 4: None}
    assert dict(rows(asof.asof_forward(left, right, "ts", "at").select("id", "v"))) == {1: 7, 2: 9, 3: None, 4: None}
    with pytest.raises(ValueError):
        asof.asof_backward(left, right, "ts", "at", None)
    with pytest.raises(ValueError):
        asof.asof_backward(left, right, "ts", "at", timedelta(0))


@pytest.mark.parametrize(
    "utc, want",
    [
        ((2024, 1, 10, 13, 0), "overlap"), ((2024, 1, 10, 12, 59), "london"), ((2024, 3, 11, 12, 0), "overlap"), ((2024, 1, 10, 0, 0), "asia"), ((2024, 1, 10, 22, 55), "rollover"),
        ((2024, 7, 10, 21, 55), "rollover"), ((2024, 7, 10, 7, 0), "london"), ((2024, 1, 10, 21, 59), "new_york"), ((2024, 1, 10, 22, 10), None), ((2024, 10, 28, 12, 30), "overlap"), ((2024, 11, 4, 12, 30), "london"),
    ],
)
def test_sessions_follow_daylight_saving(spark, utc, want):
    d = spark.createDataFrame([(datetime(*utc),)], "ts timestamp_ntz")
    assert d.select(sessions.session_bucket(F.col("ts"))).first()[0] == want


def test_utc_hour_sessions(spark):
    got = [r[0] for r in spark.createDataFrame([(h,) for h in (3, 9, 12, 15, 23, 0)], "h int").select(sessions.hour_session(F.col("h"))).collect()]
    assert got == ["asia", "london", "overlap", "new_york", "rollover", "rollover"]
    assert [replay.session_of_hour(h) for h in (3, 9, 12, 15, 23, 0)] == got


def test_reset_anchor_around_clock_changes(spark):
    d = spark.createDataFrame([(datetime(2024, 3, 31, 0, 30),), (datetime(2024, 3, 31, 12),), (datetime(2024, 10, 27, 12),), (datetime(2024, 1, 5, 22, 59),)], "ts timestamp_ntz")
    got = [r[0] for r in d.select(sessions.reset_anchor(F.col("ts"), "Europe/Prague")).collect()]
    assert got == [datetime(2024, 3, 30, 23), datetime(2024, 3, 30, 23), datetime(2024, 10, 26, 22), datetime(2024, 1, 4, 23)]


def test_visits_not_rows(spark):
    stamps = [datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 4), datetime(2024, 1, 2, 8), datetime(2024, 1, 2, 13), datetime(2024, 1, 2, 13, 5)]
    got = {r["bucket"]: r["visits"] for r in dedupe.episode_visits(spark.createDataFrame(quote_rows(stamps), QUOTE)).collect()}
    assert got == {"asia": 1, "london": 1, "overlap": 1}


def test_features_are_honest_and_controls_leak(spark):
    b = synthetic.bars(spark, 300).cache()
    honest = lambda x: features.spread_regime(features.trend_regime(features.returns_and_atr(x), 50), 30)
    for minute in (60, 121, 180, 253, 299):
        cut = datetime(2024, 1, 1) + timedelta(minutes=minute)
        assert features.truncation_difference(honest, b, cut, ["ret_1", "atr", "trend_strength", "spread_median", "spread_regime"]) == 0
        if minute < 299:
            assert features.truncation_difference(features.centred_mean, b, cut, ["centred"]) > 0
            assert features.truncation_difference(features.full_rank, b, cut, ["full_rank"]) > 0


def test_rsi_by_its_recursion(spark):
    b = synthetic.bars(spark, 60).select("symbol", F.col("ts_open").alias("ts"), F.col("bid_close").alias("close"))
    c = [r["close"] for r in b.orderBy("ts").collect()]
    up = [max(y - x, 0) for x, y in zip(c, c[1:])]
    dn = [max(x - y, 0) for x, y in zip(c, c[1:])]
    g, l, want = sum(up[:14]) / 14, sum(dn[:14]) / 14, {}  # noqa: E741
    for i in range(14, 60):
        if i > 14:
            g, l = (g * 13 + up[i - 1]) / 14, (l * 13 + dn[i - 1]) / 14  # noqa: E741
        want[i] = 100 - 100 / (1 + g / l)
    got = [r["rsi"] for r in features.wilder_rsi(b).orderBy("ts").collect()]
    assert got[:14] == [None] * 14 and all(got[i] == pytest.approx(w) for i, w in want.items())


def test_fallback_levels(spark):
    key = ("A", "london", "normal", False)
    e = spark.createDataFrame([(*key, 0, i, float(i)) for i in range(8)] + [(*key, 1, 10 + i, 20.0 + i) for i in range(3)], "symbol string, session string, volatility string, news boolean, weekday int, seq long, pips double")
    cells = spark.createDataFrame([(*key, 0), (*key, 1), ("A", "asia", "normal", False, 1), ("B", "asia", "normal", False, 1)], "symbol string, session string, volatility string, news boolean, weekday int")
    got = {(r["symbol"], r["session"], r["weekday"]): (r["value"], r["episodes"], r["level"]) for r in costs.lookup(cells, e, 0.95, 99.0).collect()}
    assert got[("A", "london", 0)] == (7.0, 8, "symbol+session+volatility+news+weekday")
    assert got[("A", "london", 1)] == (22.0, 11, "symbol+session+volatility")
    assert got[("A", "asia", 1)] == (22.0, 11, "symbol") and got[("B", "asia", 1)] == (99.0, 0, "global_bound")


def test_money(spark):
    d = spark.createDataFrame([(Decimal("0.129"), Decimal("0.01"))], "v decimal(18,8), s decimal(18,8)")
    r = d.select(units.round_volume_down(F.col("v"), F.col("s")), units.round_up(F.col("v"), F.col("s")), units.tradable_volume(F.col("v"), F.col("s"), F.lit(Decimal("0.2"))), units.half_even(F.lit(Decimal("2.5")), 0)).first()
    assert [None if x is None else float(x) for x in r] == [0.12, 0.13, None, 2.0]
    with pytest.raises(TypeError):
        units.require_no_floats(spark.createDataFrame([(1.0,)], "p double").schema, ["p"])
    with pytest.raises(Exception, match="no conversion"):
        spark.createDataFrame([("GBP",)], "q string").select(units.pip_value_usd(F.lit(1e5), F.lit(1e-4), F.lit(1.0), F.col("q"))).collect()


# ---------------------------------------------------------------- fills


def d(x):
    return Decimal(str(x))


def one_trade(quotes, order, venue=None, at=0):
    stamps = [T0 + timedelta(seconds=s) for s, _, _ in quotes]
    given = {stamps[at]: order}
    return ticks.replay([(t, d(b), d(a)) for t, (_, b, a) in zip(stamps, quotes)], lambda now, b, a: given.pop(now, None), venue or ticks.Venue())


def test_long_target_and_stop_by_hand():
    order = lambda: ticks.Order("buy", d("1.09900"), d("1.10200"), d("0.10"))
    win = one_trade([(0, "1.09990", "1.10000"), (1, "1.10200", "1.10210")], order()).trades[0]
    assert win["pnl"] == d("19.30") and win["r_multiple"] == d("1.93") and win["exit_reason"] == "closed_tp"
    loss = one_trade([(0, "1.09990", "1.10000"), (1, "1.09900", "1.09910")], order()).trades[0]
    assert loss["pnl"] == d("-10.70") and loss["r_multiple"] == d("-1.07") and loss["exit_reason"] == "closed_sl"


def test_short_stops_on_the_ask_alone():
    out = one_trade([(0, "1.1000", "1.1001"), (1, "1.1000", "1.1012")], ticks.Order("sell", d("1.1010"), d("1.0980"), d("0.10")))
    assert out.trades[0]["exit_price"] == d("1.1012")


def test_latency_expiry_rounding_and_refusals():
    v = ticks.Venue(latency=timedelta(seconds=2))
    out = one_trade([(0, 1, 1.1), (1, 0.5, 1.2), (2, 1.2, 1.3), (3, 0.5, 1.4)], ticks.Order("buy", d(0.6), None, d("0.125")), v)
    assert out.trades[0]["entry_price"] == d(1.3) and out.trades[0]["volume"] == d("0.12") and out.trades[0]["exit_ts"] == T0 + timedelta(seconds=3)
    late = ticks.Order("buy", d(0.5), None, d(1), "limit", d(0.9), T0 + timedelta(seconds=1))
    assert one_trade([(0, 1, 1.1), (2, 0.8, 0.85)], late).refused == ["expired"]
    rest = ticks.Order("buy", d(0.5), d(2), d(1), "limit", d(0.9))
    assert one_trade([(0, 1, 1.1), (2, 0.8, 0.85), (3, 2.1, 2.2)], rest).trades[0]["entry_price"] == d(0.9)
    assert one_trade([(0, 1, 1.1)], ticks.Order("buy", d(0.5), None, d("0.001"))).refused == ["below least volume"]
    closing = ticks.Venue(closes_at=T0 + timedelta(minutes=3))
    assert one_trade([(0, 1, 1.1)], ticks.Order("buy", d(0.5), None, d(1)), closing).refused == ["near session close"]


def test_first_touch_equals_replay(spark):
    r = np.random.default_rng(2)
    q = [(i, "A", T0 + timedelta(seconds=i), float(m), float(m) + 0.02, 1.0) for i, m in enumerate(np.round(10 + np.cumsum(r.normal(0, 0.05, 400)), 2))]
    df = spark.createDataFrame(q, QUOTE)
    p = spark.createDataFrame([(i, "A", "buy" if i % 2 else "sell", q[i][2], q[i][3] - 0.305 if i % 2 else q[i][4] + 0.305, q[i][3] + 0.405 if i % 2 else q[i][4] - 0.405) for i in range(0, 300, 7)], "id long, symbol string, side string, ts timestamp_ntz, stop double, target double")
    for row in ticks.first_touch(p, df, timedelta(hours=1)).collect():
        quotes = [(x[2], d(round(x[3], 2)), d(round(x[4], 2))) for x in q[row["id"] :]]
        given = [ticks.Order(row["side"], d(round(row["stop"], 3)), d(round(row["target"], 3)), d(1))]
        want = ticks.replay(quotes, lambda *_: given.pop() if given else None, ticks.Venue(least=d(0.01))).trades
        assert (want[0]["exit_ts"], want[0]["exit_reason"]) == (row["exit_ts"], row["exit_reason"]) if want else row["exit_ts"] is None


# ---------------------------------------------------------------- bar replay


class Once:
    def __init__(self, at, side, stop, target):
        self.at, self.signal = at, (side, stop, target)

    def see(self, i, ts, bar):
        return self.signal if i == self.at else None


def lab(prices, start=datetime(2024, 1, 3, 8), minutes=1):
    """Bars from (open, high, low, close)."""
    o, h, l, c = (list(x) for x in zip(*prices))  # noqa: E741
    return {"ts": [start + timedelta(minutes=minutes * i) for i in range(len(o))], "open": o, "high": h, "low": l, "close": c}


def account(spread=0.2, **kw):
    return replay.Account(spreads={s: spread for s in sessions.SESSIONS}, **kw)


FLAT = (1.1, 1.1002, 1.0998, 1.1)


def test_stop_out_costs_one_risk():
    b = lab([FLAT, FLAT, FLAT, (1.1, 1.1, 1.09, 1.0905), FLAT])
    out = replay.run(b, Once(1, "long", 1.098, 1.11), account(commission_per_lot=0.0))
    t = out.trades[0]
    assert t["exit_reason"] == "sl" and t["r"] == pytest.approx(-1, abs=0.02) and -104 <= t["pnl"] <= -97


def test_wide_spread_is_vetoed_and_levels_resolve_to_the_stop():
    b = lab([FLAT, FLAT, (1.1, 1.2, 1.0, 1.1), FLAT])
    assert replay.run(b, Once(1, "long", 1.098, 1.11), account(6.0)).vetoes == 1
    assert replay.run(b, Once(1, "long", 1.098, 1.11), account()).trades[0]["exit_reason"] == "sl"


def test_short_stop_sees_the_spread():
    b = lab([FLAT, FLAT, FLAT, (1.1, 1.10195, 1.0998, 1.1), FLAT])
    assert replay.run(b, Once(1, "short", 1.102, 1.09), account(1.0)).trades[0]["exit_reason"] == "sl"
    assert replay.run(b, Once(1, "short", 1.1021, 1.09), account(1.0)).trades[0]["exit_reason"] == "end_of_data"


def test_trailing_stop_ratchets_from_earlier_bars():
    up = [(1.1 + k * 1e-3, 1.1 + k * 1e-3 + 1e-3, 1.1 + k * 1e-3 - 1e-4, 1.1 + (k + 1) * 1e-3) for k in range(6)]
    b = lab([FLAT, FLAT, *up, (1.106, 1.106, 1.09, 1.1), FLAT])
    t = replay.run(b, Once(1, "long", 1.098, 1.2), account(trail={"act_r": 1.0, "sl_r": 1.0, "tp_r": 10.0})).trades[0]
    risk = 1.1 + 0.2e-4 - 1.098
    assert t["exit_reason"] == "trail_sl" and t["exit_price"] == pytest.approx(1.106 - risk)


def test_lockout_friday_and_timeout():
    falls = [FLAT, FLAT, (1.1, 1.1, 1.05, 1.06), *[FLAT] * 5]

    class Always:
        def see(self, i, ts, bar):
            return ("long", 1.098, 1.2)

    out = replay.run(lab(falls, minutes=30), Always(), account(risk=0.06, commission_per_lot=0.0))
    assert out.lockouts == 1 and len(out.trades) == 1
    friday = replay.run(lab([FLAT] * 5, datetime(2024, 1, 5, 20, 58)), Once(1, "long", 1.05, 1.2), account())
    assert friday.trades[0]["exit_reason"] == "friday_close"
    assert replay.run(lab([FLAT] * 6), Once(1, "long", 1.05, 1.2), account(max_bars=2)).trades[0]["exit_reason"] == "timeout"


def test_grids_and_machines():
    assert [len(signals.grid(n)) for n in signals.GRIDS] == [12, 18, 36, 12, 36, 18]
    m = signals.Impulse({"impulse_atr": 1.0, "rr": 2.0, "atr_x": 1.0, "hour_end": 11}, 0.0001, 11)
    bar = lambda o, h, l, c: {"open": o, "high": h, "low": l, "close": c, "atr": 0.001, "ll_60": 1.09, "hh_60": 1.12}  # noqa: E731,E741
    at = lambda h, mi: datetime(2024, 1, 3, h, mi)
    assert m.see(0, at(6, 59), bar(1.1, 1.2, 1.1, 1.2)) is None and m.armed is None
    assert m.see(1, at(7, 0), bar(1.1, 1.102, 1.1, 1.101)) is None
    assert m.see(2, at(7, 1), bar(1.101, 1.103, 1.101, 1.1025)) == ("long", pytest.approx(1.09), pytest.approx(1.1025 + 2 * 0.0125))
    assert m.armed is None


def test_grid_replay_parallel_equals_single(spark):
    b = synthetic.bars(spark, 900)
    c = b.select("symbol", F.col("ts_open").alias("ts"), *[F.col(f"bid_{n}").alias(n) for n in ("open", "high", "low", "close")])
    both = c.unionByName(c.withColumn("symbol", F.lit("GBPUSD")))
    bundle = features.lab_bundle(both).cache()
    acc = account()
    params = signals.grid("london_momentum")[:6]
    few = replay.grid_replay(bundle, "london_momentum", params, acc, chunk=1).toPandas()
    many = replay.grid_replay(bundle, "london_momentum", params, acc, chunk=6).toPandas()
    key = ["symbol", "params", "n"]
    assert few.sort_values(key).reset_index(drop=True).equals(many.sort_values(key).reset_index(drop=True))


# ---------------------------------------------------------------- rules, stats


def test_intraday_breach_that_recovers(spark):
    path = [("a", i, datetime(2024, 1, 10, 10 + i), e, Decimal(100000)) for i, e in enumerate([Decimal(100000), Decimal(94999), Decimal(100500)])]
    df = spark.createDataFrame(path, "account string, seq long, ts timestamp_ntz, equity decimal(18,2), balance decimal(18,2)")
    got = rules.phase_breaches(df, 100_000, 5_000, 10_000, 10_000).collect()
    assert [(r["rule"], r["seq"], float(r["level"])) for r in got] == [("maximum_daily_loss", 1, 95000.0)]
    at = df.withColumn("equity", F.when(F.col("seq") == 1, Decimal(95000)).otherwise(F.col("equity")).cast("decimal(18,2)"))
    assert rules.phase_breaches(at, 100_000, 5_000).count() == 0 and rules.phase_breaches(at, 100_000, 5_000, at_floor=True).count() == 1


def test_greedy_reservation_is_no_prefix_sum(spark):
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([60, 50, 30, 20, 10])], "account string, seq long, max_loss double")
    got = [r["accepted"] for r in rules.reserve_greedily(df, F.lit(100.0)).orderBy("seq").collect()]
    assert got == [True, False, True, False, True]


def test_expected_maximum():
    want = {2: 1 / np.sqrt(np.pi), 3: 0.8463, 5: 1.1630, 10: 1.5388, 30: 2.0428, 100: 2.5076, 500: 3.0366}
    assert all(stats.expected_maximum(n) == pytest.approx(v, abs=2e-3) for n, v in want.items())
    assert stats.hurdle_modelled(0.6, 0.8, 500) == pytest.approx(0.815, abs=1e-3)
    assert stats.deflated_decision(1.0, 0.1, 0.2, "iid")[1] and not stats.deflated_decision(0.2, 0.1, 0.2, "iid")[1]
    for bad in (lambda: stats.expected_maximum(0), lambda: stats.hurdle_empirical(0, 5), lambda: stats.sharpe_error(1, 0.1), lambda: stats.deflated_decision(1, 1, 1, "")):
        with pytest.raises(ValueError):
            bad()


def test_autocorrelation_error_by_hand(spark):
    r = np.random.default_rng(3).normal(0.1, 1, 150)
    got = stats.autocorrelation_error(spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(r)], "c int, i int, r double"), ["c"], ["i"]).first()
    z = r - r.mean()
    s = sum((z[k:] * z[:-k]).sum() for k in range(1, stats.default_lags(150) + 1)) / (z * z).sum()
    assert got["autocorr_sum"] == pytest.approx(s) and got["se"] == pytest.approx(np.sqrt((1 + 2 * s) / 150))


def test_ledger_finds_edits_deletions_and_reorders(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    book = ledger.Ledger(path)
    base = {"candidate": "c", "params": "{}", "strategy": "s", "symbol": "EURUSD", "timeframe": "1h", "selection_criterion": "pf", "fill_mode": "m", "feature_version": "1", "n_observations": 50, "recorded_at": "t"}
    for i in range(5):
        book.append(base | {"candidate": f"c{i}", "sr_periodic": 0.1 * i})
    with pytest.raises(ValueError):
        book.append(base | {"sr_periodic": float("nan")})
    read = lambda: ledger.read(spark, str(path))
    assert ledger.broken_links(read()).count() == 0
    assert ledger.hurdle(read(), "pf", "m") == pytest.approx(np.std([0, 0.1, 0.2, 0.3, 0.4], ddof=1) * stats.expected_maximum(5))
    lines = path.read_text().splitlines()
    for bad in ([lines[0], lines[2], lines[3], lines[4]], [lines[0], lines[1].replace('"c1"', '"cX"'), *lines[2:]]):
        path.write_text("\n".join(bad) + "\n")
        assert ledger.broken_links(read()).count() > 0
    again = ledger.Ledger(path)
    assert again.tail == json.loads(lines[-1])["record_hash"]


def test_portfolio_windows(spark):
    t = spark.createDataFrame([("b", datetime(2024, 1, 1) + timedelta(days=10 * i), i, 10.0 * (-1) ** i, 0.5 * (-1) ** i) for i in range(30)], "book string, exit_ts timestamp_ntz, seq long, pnl double, r double")
    m = portfolio.trade_metrics(t, ["book"]).first()
    assert (m["trades"], m["win_rate"], m["profit_factor"], m["max_dd_pct"]) == (30, 0.5, 1.0, 0.1)
    got = portfolio.rolling_returns(t, "book", datetime(2024, 1, 1), datetime(2024, 10, 1), 0.01)
    want, day = {}, datetime(2024, 1, 1)
    data = [(r["exit_ts"], r["r"]) for r in t.collect()]
    while day + timedelta(days=90) <= datetime(2024, 10, 1):
        x = np.prod([1 + r * 0.01 for ts, r in data if day <= ts < day + timedelta(days=90)])
        want[day], day = 100 * (x - 1), day + timedelta(days=15)
    assert {r["window_start"]: pytest.approx(r["ret"]) for r in got.collect()} == want


# ---------------------------------------------------------------- sources


def test_binary_files(spark, tmp_path):
    hour = datetime(2024, 1, 2, 5)
    path = tmp_path / binary.hour_path("EURUSD", hour)
    path.parent.mkdir(parents=True)
    raw = b"".join(struct.pack(">IIIff", 1000 * i, 110020 + i, 110000 + i, 1.5, 2.5) for i in range(5))
    path.write_bytes(lzma.compress(raw + raw[-20:], format=lzma.FORMAT_ALONE))
    got = binary.read_ticks(spark, str(tmp_path)).orderBy("ts").collect()
    assert len(got) == 5 and got[0]["bid"] == 1.1 and got[0]["ask"] == pytest.approx(1.1002) and got[1]["ts"] == hour + timedelta(seconds=1)
    spark.dataSource.register(binary.TickRange)
    ranged = spark.read.format("tick_range").options(symbol="EURUSD", root=str(tmp_path), start="2024-01-02T05:00:01", end="2024-01-02T07:00:00").load()
    assert ranged.count() == 5
    day = tmp_path / binary.day_path("EURUSD", date(2024, 1, 2))
    day.write_bytes(lzma.compress(b"".join(struct.pack(">IIIIIf", 60 * i, 117250, 117260, 117240, 117270, 1.0) for i in range(1440)), format=lzma.FORMAT_ALONE))
    closed = tmp_path / binary.day_path("EURUSD", date(2024, 1, 6))
    closed.parent.mkdir(parents=True)
    closed.write_bytes(b"")
    c = binary.read_candles(spark, str(tmp_path))
    assert c.count() == 1440 and c.first()["close"] == 1.1726
    missing = {r["day"] for r in binary.cache_inventory(spark, str(tmp_path), date(2024, 1, 1), date(2024, 1, 8)).collect()}
    assert missing == {date(2024, 1, x) for x in (1, 3, 4, 5, 7)}


def test_broken_payloads_are_errors():
    with pytest.raises(ValueError):
        binary.records(b"nonsense", binary.TICK)
    with pytest.raises(ValueError):
        binary.records(lzma.compress(b"1234567", format=lzma.FORMAT_ALONE), binary.TICK)
    assert len(binary.records(b"", binary.CANDLE)) == 0
    with pytest.raises(KeyError):
        binary.point_scale("XXX")
    calls = []

    def flaky(path):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("reset")
        return b"x"

    waits = []
    assert binary.fetch(flaky, "p", sleep=waits.append) == b"x" and waits == [5.0, 10.0]
    assert binary.fetch(lambda p: (_ for _ in ()).throw(FileNotFoundError()), "p") == b""


def test_promotion_writes_all_or_nothing(spark, tmp_path):
    q = synthetic.ticks(spark, 600)
    record, report = tables.promote(q, str(tmp_path / "raw"), str(tmp_path / "bars"), "1m", 60_000)
    assert record["row_count"] == 10 and tables.read_ticks(spark, str(tmp_path / "raw"), "EURUSD", "2024-01").count() == 600
    assert record["content_hash"] == tables.content_hash(spark.read.parquet(str(tmp_path / "bars")).repartition(3))
    bad, report = tables.promote(q.withColumn("ask", F.col("bid") - 1), str(tmp_path / "r2"), str(tmp_path / "b2"), "1m", 60_000)
    assert bad is None and not (tmp_path / "r2").exists()
    tables.write_json(spark, record, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["row_count"] == 10


def test_artefacts_wait_for_their_time(spark, tmp_path):
    p = str(tmp_path / "a")
    tables.save_artefact(spark.range(3), p, T0, T0, T0 + timedelta(days=1))
    with pytest.raises(PermissionError):
        tables.load_artefact(spark, p, T0)
    assert tables.load_artefact(spark, p, T0 + timedelta(days=1)).count() == 3


def test_dimensions_fail_closed(spark):
    spec = {"symbol": "EURUSD", "point_size": "0.00001", "pip_size": "0.0001", "contract_size": "100000", "tick_size": "0.00001", "tick_value": "1", "volume_min": "0.01", "volume_step": "0.01", "volume_max": "50", "quote_currency": "USD"}
    assert dimensions.instruments(spark, [spec]).first()["pip_size"] == Decimal("0.0001")
    with pytest.raises(TypeError):
        dimensions.instruments(spark, [spec | {"pip_size": 0.0001}])
    fee = {"symbol": "EURUSD", "commission": "6", "swap_long": "-1", "swap_short": "0", "evidence": "statement"}
    with pytest.raises(ValueError):
        dimensions.fee_schedules(spark, [fee])
    assert dimensions.fee_schedules(spark, [fee], True).count() == 1
    with pytest.raises(PermissionError):
        dimensions.verified_rules({"profit_target": {"status": "unknown"}}, ["profit_target"])


# ---------------------------------------------------------------- research


def test_registry_covers_the_library_and_finds_leaks(spark):
    r = research.library()
    assert r.gaps(["ret_1", "atr", "vol_regime_quintile", "new"]) == ["new"]
    b = synthetic.bars(spark, 330).cache()
    some = research.Registry({n: r.items[n] for n in ("ret_1", "atr", "vol_regime_quintile", "trend_state")})
    some.add(research.Feature("centred", features.centred_mean, 0))
    assert some.leaks(b, [datetime(2024, 1, 1, 5, 1)]) == ["centred"]
    with pytest.raises(ValueError):
        some.add(research.Feature("atr", features.returns_and_atr, 14))


def test_event_order_and_trails(spark):
    e = spark.createDataFrame([("rule_reset",), ("swap_posting",), ("quote",)], "k string")
    at = lambda first: [r[0] for r in e.select(research.event_priority(F.col("k"), first)).collect()]
    assert at(True) == [2, 3, 4] and at(False) == [3, 2, 4] and len(research.trails()) == 27
    with pytest.raises(Exception, match="unknown event kind"):
        spark.createDataFrame([("x",)], "k string").select(research.event_priority(F.col("k"))).collect()


def test_null_batches_rarely_pass_and_an_edge_does(spark):
    null = research.deflated(research.null_batches(spark, 60, periods=400), 40, 400)
    assert null.where("passes").count() <= 9
    edge = research.deflated(research.null_batches(spark, 20, periods=1000, edge=0.19), 40, 1000)
    assert edge.where("passes AND best_at = edge_at").count() >= 10


def test_sliced_windows_equal_whole_ones(spark, monkeypatch):
    """Every helper of slices against a window by symbol alone, over stretches of 7
    rows, days without rows and ties."""
    import numpy as np
    from pyspark.sql import Window

    from tickloom.operators import slices

    monkeypatch.setattr(slices, "ROWS", 7)
    r = np.random.default_rng(3)
    rows = [(s, i, datetime(2024, 1, 1) + timedelta(hours=int(h)), float(r.integers(-5, 6)), None if r.random() < 0.4 else int(r.integers(100))) for s, n in (("a", 200), ("b", 13), ("c", 1), (None, 30)) for i, h in enumerate(np.sort(r.integers(0, 24 * 40, n)))]
    df = spark.createDataFrame(rows, "symbol string, seq long, ts timestamp_ntz, x double, v int")
    order = Window.partitionBy("symbol").orderBy("ts", "seq")
    upto, past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    want = {(t["symbol"], t["seq"]): t for t in df.select(
        "symbol", "seq", "ts", (F.row_number().over(order) - 1).alias("pos"), F.lag("v").over(order).alias("lag"), F.max("x").over(past).alias("top"), F.sum("x").over(upto).alias("sum"), F.last("v", ignorenulls=True).over(upto).alias("last"),
        F.sum("x").over(order.rowsBetween(-9, 4)).alias("frame"), F.first("v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("next"),
    ).withColumn("high", F.max("sum").over(upto)).collect()}
    by, keys, day = ["symbol"], ["ts", "seq"], slices.day("ts")
    got = {
        "pos": slices.numbered(df, by, [F.col("ts"), F.col("seq")], day).select("symbol", "seq", F.col("_pos").alias("y")),
        "lag": slices.previous(df, "y", F.col("v"), by, keys, day),
        "top": slices.highest_before(df, "y", "x", by, keys, day),
        "sum": slices.running(df, F.col("x"), by, keys, day, "y", "z"),
        "high": slices.running(df, F.col("x"), by, keys, day, "z", "y"),
        "last": slices.latest(df, "y", "v", by, [F.col("ts"), F.col("seq")], day),
        "next": slices.latest(df, "y", "v", by, [F.col("ts").desc(), F.col("seq").desc()], day, forward=True),
        "frame": slices.over(df, lambda t, w: t.withColumn("y", F.sum("x").over(w.rowsBetween(-9, 4))), 9, "ts", after=4, order=("seq",)),
    }
    for name, t in got.items():
        assert {(r["symbol"], r["seq"]): r["y"] for r in t.collect()} == {k: r[name] for k, r in want.items()}, name


def test_features_over_short_stretches_equal_long_ones(spark, monkeypatch):
    from tickloom.operators import slices
    from tickloom.plans import views

    bars = views.bars(spark, "/root/testdata/sf0.001", "1h").cache()
    candles = views.candles(spark, "/root/testdata/sf0.001", "1h").cache()
    make = {"atr": lambda: features.returns_and_atr(bars, atr=5), "trend": lambda: features.trend_regime(bars, 20), "spread": lambda: features.spread_regime(bars, 20), "rsi": lambda: features.wilder_rsi(candles, 5), "quintile": lambda: features.vol_quintile(features.returns_and_atr(bars, atr=5).select("symbol", "available_at", F.round("atr", 3).alias("atr")), 1, 21)}
    rows = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) and v == v else v for v in r]) for r in df.collect())
    long = {k: rows(f()) for k, f in make.items()}
    monkeypatch.setattr(slices, "ROWS", 16)
    for k, f in make.items():
        assert rows(f()) == long[k], k


def test_range_reads_through_a_cache(spark, tmp_path):
    """Slots once decoded are not read again, all bad files are named, nothing of a
    failed call is kept, and repeats keep the last."""
    import lzma

    import numpy as np

    root, cache = tmp_path / "files", str(tmp_path / "cache")

    def put(hour, rows, raw=None):
        path = root / binary.hour_path("EURUSD", hour)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(lzma.compress(np.array(rows, binary.TICK).tobytes()) if raw is None else raw)
        return path

    hours = [datetime(2024, 1, 2, h) for h in range(4)]
    a = put(hours[0], [(0, 110_001, 110_000, 1, 1), (1000, 110_003, 110_002, 1, 1), (1000, 110_003, 110_002, 2, 9)])
    put(hours[1], [], b"")
    put(hours[2], [(5, 110_005, 110_004, 1, 1)])
    read = lambda n: binary.read_range(spark, str(root), ["EURUSD"], hours[0], datetime(2024, 1, 2, n), cache)
    assert [(r["ts"].hour, r["bid"], r["bid_volume"]) for r in read(2).collect()] == [(0, 1.1, 1.0), (0, 1.10002, 9.0)]
    a.write_bytes(b"broken since")  # held by the cache
    bad = [put(hours[2], [], b"junk"), put(hours[3], [], b"more junk")]
    with pytest.raises(binary.FetchFailed) as e:
        read(4)
    assert str(e.value).count("EURUSD") == 2 and read(2).count() == 2
    for p, h in zip(bad, hours[2:]):
        put(h, [(5, 110_005, 110_004, 1, 1)])
    assert read(4).count() == 4


def test_day_files_through_the_cache(spark, tmp_path):
    import lzma
    from datetime import date

    import numpy as np

    path = tmp_path / "f" / binary.day_path("USDJPY", date(2024, 1, 3))
    path.parent.mkdir(parents=True)
    path.write_bytes(lzma.compress(np.array([(0, 150_000, 150_010, 149_990, 150_020, 1), (60, 150_010, 150_000, 149_995, 150_015, 1)], binary.CANDLE).tobytes()))
    got = binary.read_range(spark, str(tmp_path / "f"), ["USDJPY"], datetime(2024, 1, 3, 0, 0, 30), datetime(2024, 1, 4), str(tmp_path / "c"), candles_=True).collect()
    assert [(r["open"], r["high"], r["low"], r["close"]) for r in got] == [(150.01, 150.015, 149.995, 150.0)]


def test_replay_of_two_quotes_in_one_instant(spark):
    """Orders stand on quotes, not on instants: one on the second of two quotes at one
    time fills there, one on the first there."""
    t0 = datetime(2024, 1, 2, 9)
    for on, entry in ((0, 101.0), (1, 106.0)):
        rows = [("A", t0, 0, 100.0, 101.0), ("A", t0, 1, 105.0, 106.0), ("A", t0 + timedelta(minutes=1), 2, 90.0, 91.0)]
        d = lambda x: Decimal(str(x))
        q = [(s, ts, n, d(b), d(a), "buy" if n == on else None, d(95), d(500), d("0.10")) for s, ts, n, b, a in rows]
        df = spark.createDataFrame(q, "symbol string, ts timestamp_ntz, seq long, bid decimal(18,8), ask decimal(18,8), side string, stop decimal(18,8), target decimal(18,8), volume decimal(18,8)")
        got = ticks.replay_table(df, ticks.Venue(contract=Decimal(100))).collect()
        assert [float(r["entry_price"]) for r in got] == [entry] and got[0]["exit_reason"] == "closed_sl"


def test_replay_reads_no_further_than_an_arrival():
    """A replay is a stream: when a trade comes about, only the quotes within the latency
    have been read, and those passed are gone."""
    read = []

    def quotes():
        for k in range(60_000):
            read.append(k)
            yield datetime(2024, 1, 1) + timedelta(seconds=k), Decimal(100 + k % 4), Decimal(101 + k % 4)

    venue = ticks.Venue(contract=Decimal(100), latency=timedelta(seconds=5))
    got = ticks.events(quotes(), lambda now, b, a: ticks.Order("buy", Decimal(50), Decimal(103), Decimal(1)), venue)
    assert next(got)[0]["exit_reason"] == "closed_tp" and len(read) < 30
    ahead = ticks._Ahead(quotes())
    held = max(len(ahead.held) for q in iter(ahead.step, None) if ahead.arrival(q[0] + venue.latency) or True)
    assert len(read) > 60_000 and held < 5000


def test_replay_by_symbol_is_a_sorted_stream(spark):
    """Symbols in one task, rows in no order, empty ones among them, as one symbol at a time."""
    rows = [(s, datetime(2024, 1, 1) + timedelta(minutes=k), k, Decimal(100 + (k * 7) % 13), Decimal(101 + (k * 7) % 13), "buy" if k % 3 == 0 else None, Decimal(99) if k % 3 == 0 else None, Decimal(108) if k % 3 == 0 else None, Decimal("0.1") if k % 6 else Decimal("0.001")) for s, n in (("a", 200), ("b", 1), ("c", 77)) for k in range(n)]
    df = spark.createDataFrame(rows[::-1], "symbol string, ts timestamp_ntz, seq long, bid decimal(18,8), ask decimal(18,8), side string, stop decimal(18,8), target decimal(18,8), volume decimal(18,8)").coalesce(1)
    venue = ticks.Venue(contract=Decimal(100))
    got = ticks.replay_table(df, venue)
    assert "FlatMapGroupsInPandas" not in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    want = {}
    for s in "abc":
        mine = iter([r for r in rows if r[0] == s])
        want[s] = ticks.replay([(r[1], r[3], r[4]) for r in rows if r[0] == s], lambda now, b, a: ticks.Order(*r[5:]) if (r := next(mine))[5] else None, venue)
    assert sorted((r["symbol"], r["n"], r["entry_ts"], r["exit_ts"], r["exit_price"]) for r in got.collect()) == sorted((s, k, t["entry_ts"], t["exit_ts"], t["exit_price"]) for s, o in want.items() for k, t in enumerate(o.trades))
    counts = {r["symbol"]: (r["trades"], r["below_least"]) for r in ticks.replay_counters(df, venue).collect()}
    assert counts == {s: (len(o.trades), o.refused.count("below least volume")) for s, o in want.items()} and counts["a"][0] > 3 and counts["a"][1] > 3


def test_chain_over_ranges(spark):
    """A chain of many ranges, each a task of its own, is the chain of one writer."""
    import hashlib

    rows = [(k * 3 - 500, f"body {k}") for k in range(700)]
    df = spark.createDataFrame(rows[::-1], "pos long, body string").repartition(5)
    want, last = [], ledger.GENESIS
    for pos, body in rows:
        want.append((pos, body, last, last := hashlib.sha256(f"{body}|{last}".encode()).hexdigest()))
    for span in (50, 10_000):
        got = ledger.chained(df, span)
        assert len({f.split("_range=")[1].split("/")[0] for f in got.inputFiles()}) == (14 if span == 50 else 1)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert ledger.chained(df.where("pos > 9999")).collect() == []


def test_quantiles_and_draws_are_places_in_counts(spark, monkeypatch):
    """Every level's quantiles and draws equal those of sorted lists, without the episodes
    being ranked row by row."""
    import hashlib
    import math

    monkeypatch.setattr(costs, "ranked", None)
    r = np.random.default_rng(6)
    rows = [("a" if k % 3 else "b", ("x", "y", "z")[k % 7 % 3], "normal", False, int(r.integers(0, 7)), k, float(r.choice([r.random() * 3, 1.0, 1.0 + 1e-12, 2.5]))) for k in range(900)]
    keys = "symbol string, session string, volatility string, news boolean, weekday int"
    e = spark.createDataFrame(rows, keys + ", seq long, pips double")
    cells = spark.createDataFrame([(s, x, v, n, d) for s in "abc" for x in "xw" for v in ("normal", "high") for n in (False, True) for d in (0, 6, 9)], keys)

    def pool(c):
        for i, (of, name) in enumerate(zip((5, 3, 2, 1), ["+".join(k) for k in costs.LEVELS])):
            got = sorted(x[6] for x in rows if x[:of] == c[:of])
            if len(got) >= 8:
                return got, name
        return None, "global_bound"

    for q in (0.95, 0.5, 0.001, 1.0):
        for x in costs.lookup(cells, e, q, 77.0).collect():
            got, name = pool(tuple(x)[:5])
            assert (x["value"], x["episodes"], x["level"]) == ((got[max(math.ceil(q * len(got)), 1) - 1], len(got), name) if got else (77.0, 0, name))
    drawn = costs.draw(cells, e, 3, 4).collect()
    assert len(drawn) == 4 * sum(pool(tuple(c))[0] is not None for c in cells.collect())
    for x in drawn:
        got, name = pool(tuple(x)[:5])
        text = "|".join(["3", x["symbol"], x["session"], x["volatility"], str(x["news"]).lower(), str(x["weekday"]), str(x["draw"])])
        assert (x["pips"], x["level"], x["episodes"]) == (got[int(hashlib.md5(text.encode()).hexdigest()[:12], 16) % len(got)], name, len(got))
