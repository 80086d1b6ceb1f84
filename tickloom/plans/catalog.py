"""Registered queries: each applies one operator to the driver tables.

Floating results are rounded to six decimals where a query returns them.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tickloom.functions import sessions, stats, units
from tickloom.operators import asof, bars, costs, dedupe, features, ledger, portfolio, replay, research, rules, signals, slices, ticks, validate
from tickloom.plans import views
from tickloom.session import shared_folder, staged
from tickloom.sources import binary
from tickloom.streaming import capture

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


PRICES = [f"{s}_{n}" for s in ("bid", "ask") for n in ("open", "high", "low", "close")]

# ------------------------------------------------------------ bars, checks


@query
def bars_resample(spark, sf):
    b = views.bars(spark, sf)
    return r6(b.select("symbol", "ts_open", "available_at", *PRICES, "volume", "tick_count", "max_quote_gap_ms", "coverage_ok", "known_outage", "tick_derived"), *PRICES)


@query
def bars_usable(spark, sf):
    return bars.usable(views.bars(spark, sf)).select("symbol", "ts_open", "tick_count")


@query
def candle_agg(spark, sf):
    return r6(bars.aggregate_bars(views.candles(spark, sf), 480), "open", "high", "low", "close")


@query
def higher_timeframe_close(spark, sf):
    return r6(bars.last_close(views.bars(spark, sf), 86_400), "higher_close")


def _spoiled(q):
    """Quotes with crossed and non-positive ones at stated places."""
    return q.withColumn("ask", F.when(F.col("seq") % 97 == 0, F.col("bid") - 0.5).otherwise(F.col("ask"))).withColumn("bid", F.when(F.col("seq") % 101 == 0, -F.col("bid")).otherwise(F.col("bid")))


@query
def tick_validation(spark, sf):
    return validate.check_ticks(_spoiled(views.quotes(spark, sf)))


def _bent(b):
    return b.withColumn("bid_high", F.when(F.hour("ts_open") == 8, F.col("bid_high") - 5).otherwise(F.col("bid_high")))


@query
def bar_ohlc_violations(spark, sf):
    return r6(validate.incoherent(_bent(views.bars(spark, sf))).select("symbol", "ts_open", "bid_high"), "bid_high")


@query
def bar_duplicates(spark, sf):
    b = views.bars(spark, sf).select("symbol", F.date_trunc("DAY", "ts_open").cast("timestamp_ntz").alias("ts_open"), "tick_count")
    return validate.duplicated(b, ["symbol", "ts_open"]).select("symbol", "ts_open", "tick_count", "copies")


@query
def weekend_quarantine(spark, sf):
    return validate.weekend(views.bars(spark, sf)).select("symbol", "ts_open", "tick_count")


@query
def spike_flags(spark, sf):
    return r6(validate.spikes(views.bars(spark, sf), 2.0, 30).select("symbol", "ts_open", "ret", "sigma"), "ret", "sigma")


@query
def session_volume_peaks(spark, sf):
    return r6(validate.session_shares(views.bars(spark, sf, "1h")), "share")


@query
def missing_session_peaks(spark, sf):
    want = spark.createDataFrame([("asia",), ("london",), ("new_york",), ("sydney",)], "session string")
    return validate.missing_peaks(validate.session_shares(views.bars(spark, sf, "1h")), want)


@query
def price_precision(spark, sf):
    return r6(validate.too_precise(views.quotes(spark, sf), "ask", 1).select("seq", "symbol", "ask"), "ask")


@query
def bar_validation_report(spark, sf):
    return validate.check_bars(_bent(views.bars(spark, sf)))


@query
def candle_faults(spark, sf):
    c = views.candles(spark, sf, "4h").withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))
    c = c.withColumn("high", F.when(F.hour("ts") == 12, F.col("low") - 1).when(F.hour("ts") == 20, F.lit(200_000.0)).otherwise(F.col("high")))
    return validate.candle_faults(c).select("symbol", "ts", "fault")


@query
def capability_drift(spark, sf):
    p = views.table(spark, sf, "part")
    doc = p.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    seen = p.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("double").alias("size"), F.when(F.col("p_partkey") % 11 == 0, F.col("p_retailprice") + 0.5).otherwise(F.col("p_retailprice")).alias("price"))
    return r6(validate.drift(doc, seen, ["size", "price"], "p_partkey"), "documented", "observed")


# ------------------------------------------------------------ sessions


def _dst(spark, sf):
    """Event times, and the same shifted to days around clock changes."""
    e = views.quotes(spark, sf).select("seq", "ts")
    shifted = e.select((F.col("seq") + 1_000_000_000).alias("seq"), (F.col("ts") + F.expr("interval 70 days")).alias("ts"))
    later = e.select((F.col("seq") + 2_000_000_000).alias("seq"), (F.col("ts") + F.expr("interval 290 days")).alias("ts"))
    return e.unionByName(shifted).unionByName(later)


@query
def session_bucket_dst(spark, sf):
    return _dst(spark, sf).select("seq", sessions.known_session(F.col("ts")).alias("session"))


@query
def session_bucket_utc(spark, sf):
    return views.quotes(spark, sf).groupBy(sessions.hour_session(F.hour("ts")).alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query
def capture_bucket(spark, sf):
    return views.quotes(spark, sf).groupBy(sessions.capture_bucket(F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def reset_anchors(spark, sf):
    return _dst(spark, sf).select("seq", sessions.reset_anchor(F.col("ts"), "Europe/Prague", "17:30").alias("anchor"))


@query
def weekend_spans(spark, sf):
    t = slices.previous(views.quotes(spark, sf), "prev", F.col("ts"), ["symbol"], ["ts", "seq"], slices.day("ts")).where("prev IS NOT NULL")
    return t.where(sessions.spans_saturday(F.col("prev"), F.col("ts"))).select("seq", "symbol")


@query
def swap_nights(spark, sf):
    d = views.quotes(spark, sf).select(F.to_date("ts").alias("night")).distinct()
    return d.select(F.date_format("night", "yyyy-MM-dd").alias("night"), sessions.swap_multiplier(F.col("night"), (2,), ("2024-01-10",)).alias("nights"))


@query
def episode_visits(spark, sf):
    return dedupe.episode_visits(views.quotes(spark, sf))


@query
def episode_report(spark, sf):
    want = spark.createDataFrame([("asia", 60), ("london", 1000), ("overlap", 20), ("rollover", 5), ("sydney", 1)], "bucket string, minimum long")
    return dedupe.episode_report(dedupe.episode_visits(views.quotes(spark, sf)), want)


# ------------------------------------------------------------ sets


@query
def quotes_dedupe_last(spark, sf):
    q = views.quotes(spark, sf).select("seq", "symbol", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("bid") / 10).alias("level"))
    return dedupe.keep_last(q, ["symbol", "ts", "level"])


@query
def missing_hours(spark, sf):
    return dedupe.missing_slots(views.quotes(spark, sf), "ts", "HOUR")


@query
def resume_fresh(spark, sf):
    q = views.quotes(spark, sf)
    return dedupe.fresh_after(q, q.where("seq % 3 = 0 AND ts < timestamp_ntz'2024-01-20 00:00:00'")).select("seq", "symbol")


@query
def book_best(spark, sf):
    t = portfolio.trade_metrics(views.trades(spark, sf).withColumn("params", F.col("supplier") % 20), ["book", "params"])
    return dedupe.keep_best(t, ["book"], [F.desc("profit_factor"), F.desc("net"), F.col("params").asc()]).select("book", "params", "profit_factor", "net")


@query
def book_streams(spark, sf):
    """Books that share a trade stream: every one is entered twice."""
    t = views.trades(spark, sf).select("supplier", F.col("exit_ts").alias("entry_ts"), F.col("gross").alias("exit_price"))
    # The second entry's number lies beyond every supplier's.
    twice = t.select(F.col("supplier").alias("book"), "entry_ts", "exit_price").unionByName(t.select((F.col("supplier") + 10**15).alias("book"), "entry_ts", "exit_price"))
    return dedupe.fingerprint(twice).groupBy("stream").agg(F.min("book").alias("book"), F.count(F.lit(1)).alias("copies")).select("book", "copies")


# ------------------------------------------------------------ joins


def _orders(spark, sf):
    """Decision instants: every quote's time, a minute on."""
    q = views.quotes(spark, sf)
    return q.select(F.col("seq").alias("id"), "symbol", (F.col("ts") + F.expr("interval 1 minute")).alias("ts"), F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"))


@query
def asof_backward_tol(spark, sf):
    right = views.quotes(spark, sf).select("symbol", F.col("ts").alias("qts"), "bid")
    return r6(asof.asof_backward(_orders(spark, sf), right, "ts", "qts", timedelta(hours=2), columns=["bid"]).select("id", "bid"), "bid")


@query
def asof_forward_first_quote(spark, sf):
    right = views.quotes(spark, sf).select("symbol", F.col("ts").alias("qts"), "ask")
    return r6(asof.asof_forward(_orders(spark, sf), right, "ts", "qts", columns=["ask"]).select("id", "ask"), "ask")


@query
def asof_higher_timeframe(spark, sf):
    b = views.bars(spark, sf)
    high = bars.last_close(b, 86_400).select("symbol", F.col("available_at").alias("known_at"), "higher_close")
    return r6(asof.asof_backward(b, high, "available_at", "known_at", timedelta(hours=26), columns=["higher_close"]).select("symbol", "ts_open", "higher_close"), "higher_close")


@query
def equity_before_day(spark, sf):
    """Each account's equity strictly before the first of each month."""
    path = views.account_path(spark, sf)
    months = path.select("account", F.add_months(F.date_trunc("MONTH", "ts"), 1).cast("timestamp_ntz").alias("day")).distinct()
    return asof.asof_backward(months, path.withColumnRenamed("ts", "at"), "day", "at", None, ["account"], ["equity"], strict=True, unlimited=True, span=366).withColumn("equity", F.col("equity").cast("double"))


@query
def outage_overlap(spark, sf):
    return views.bars(spark, sf).where("known_outage").select("symbol", "ts_open")


def _news(spark):
    rows = []
    for k in range(12):
        at = datetime(2024, 1, 2 + 2 * k, 8 + k % 5, 30)
        rows.append((f"n{k}", at, [["click", "view"], ["purchase"], ["error", "signup", "click"]][k % 3], at - timedelta(days=1) if k % 4 else at + timedelta(minutes=20)))
    return spark.createDataFrame(rows, "event_id string, scheduled_time timestamp_ntz, affected_instruments array<string>, available_at timestamp_ntz")


@query
def news_window(spark, sf):
    q = views.quotes(spark, sf).select("seq", "symbol", "ts")
    return asof.news_restricted(q, _news(spark), "ts", timedelta(hours=3), timedelta(hours=2)).where("restricted").select("seq", "symbol")


@query
def artefact_guard(spark, sf):
    versions = spark.createDataFrame([("click", datetime(2024, 1, 5), 1), ("click", datetime(2024, 1, 15), 2), ("view", datetime(2024, 1, 10), 1)], "symbol string, available_from timestamp_ntz, version int")
    got = asof.guard_available(views.quotes(spark, sf).select("seq", "symbol", "ts"), versions, "ts", ["symbol"], ["version"])
    return got.select("seq", "version", "refused")


# ------------------------------------------------------------ features


@query
def ret_atr(spark, sf):
    return r6(features.returns_and_atr(views.bars(spark, sf)).select("symbol", "available_at", "ret_1", "atr"), "ret_1", "atr")


@query
def spread_regime(spark, sf):
    return r6(features.spread_regime(views.bars(spark, sf), 20).select("symbol", "available_at", "spread_median", "spread_ratio", "spread_regime"), "spread_median", "spread_ratio")


@query
def vol_quintile(spark, sf):
    t = features.returns_and_atr(views.bars(spark, sf), atr=5).select("symbol", "available_at", "atr")
    return features.vol_quintile(t, 4, 22).select("symbol", "available_at", "vol_regime_quintile")


@query
def trend_regime(spark, sf):
    return r6(features.trend_regime(views.bars(spark, sf), 20).select("symbol", "available_at", "trend_strength", "trend_state"), "trend_strength")


@query
def rolling_hh_ll(spark, sf):
    return r6(features.channels(views.candles(spark, sf, "4h"), (6, 24)).select("symbol", "ts", "hh_6", "ll_6", "hh_24", "ll_24"), "hh_6", "ll_6", "hh_24", "ll_24")


@query
def moving_averages(spark, sf):
    return r6(features.averages(views.candles(spark, sf, "4h"), (5, 20)).select("symbol", "ts", "sma_5", "sma_20"), "sma_5", "sma_20")


@query
def true_range(spark, sf):
    t = slices.over(views.candles(spark, sf, "4h"), lambda t, w: t.withColumn("tr", features.true_range(w)), 1, "ts")
    return r6(t.select("symbol", "ts", "tr"), "tr")


@query
def rsi_wilder(spark, sf):
    return r6(features.wilder_rsi(views.candles(spark, sf, "4h"), 14).select("symbol", "ts", "rsi"), "rsi")


@query
def zscore_pop(spark, sf):
    t = slices.over(views.candles(spark, sf, "4h"), lambda t, w: t.withColumn("z", features.z_score(F.col("high") - F.col("low"), 20, w)), 20, "ts")
    return r6(t.select("symbol", "ts", "z"), "z")


@query
def prev_day_levels(spark, sf):
    return r6(features.day_levels(views.candles(spark, sf, "4h")).select("symbol", "ts", "day_open", "prev_day_high", "prev_day_low"), "day_open", "prev_day_high", "prev_day_low")


@query
def warm_returns(spark, sf):
    make = lambda t, w: t.withColumns({f"ret{n}": F.coalesce(features.change(F.col("close"), n, w), F.lit(0.0)) for n in (1, 5)})
    t = slices.over(views.candles(spark, sf, "4h"), make, 5, "ts")
    return r6(t.select("symbol", "ts", "ret1", "ret5"), "ret1", "ret5")


@query
def centred_leak(spark, sf):
    return r6(features.centred_mean(views.bars(spark, sf)).select("symbol", "available_at", "centred"), "centred")


@query
def full_rank_leak(spark, sf):
    return features.full_rank(views.bars(spark, sf)).select("symbol", "available_at", "full_rank")


@query
def truncation_test(spark, sf):
    """Differences an honest and two leaking pipelines show at two cutoffs."""
    b = views.bars(spark, sf).cache()
    honest = lambda x: features.trend_regime(features.returns_and_atr(x), 20)
    rows = []
    for at in (datetime(2024, 1, 10, 12), datetime(2024, 1, 20)):
        rows.append(("honest", str(at), features.truncation_difference(honest, b, at, ["ret_1", "atr", "trend_strength", "trend_state"]) > 0))
        rows.append(("centred", str(at), features.truncation_difference(features.centred_mean, b, at, ["centred"]) > 0))
        rows.append(("full_rank", str(at), features.truncation_difference(features.full_rank, b, at, ["full_rank"]) > 0))
    b.unpersist()
    return spark.createDataFrame(rows, "pipeline string, cutoff string, leaks boolean")


# ------------------------------------------------------------ costs

GAP = 6 * 3_600_000


@query
def fresh_spreads(spark, sf):
    return r6(costs.fresh_spreads(views.quotes(spark, sf), views.PIP, GAP).select("seq", "symbol", "pips"), "pips")


@query
def spread_nearest_rank(spark, sf):
    e = costs.entry_episodes(views.quotes(spark, sf), views.PIP, GAP)
    return r6(e.groupBy("symbol", "session").agg(costs.nearest_rank("pips", 0.95).alias("q95"), costs.nearest_rank("pips", 0.5).alias("q50"), F.count(F.lit(1)).alias("episodes")), "q95", "q50")


@query
def stress_top_quartile(spark, sf):
    e = costs.stressed_quarter(costs.entry_episodes(views.quotes(spark, sf), views.PIP, GAP))
    return r6(e.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n"), F.min("pips").alias("least"), F.sum("seq").alias("seqs")), "least")


@query
def spread_fallback(spark, sf):
    e = costs.entry_episodes(views.quotes(spark, sf), views.PIP, GAP)
    cells = spark.createDataFrame([(s, x, "normal", False, d) for s in ("click", "view", "nothing") for x in sessions.SESSIONS for d in (0, 5)], "symbol string, session string, volatility string, news boolean, weekday int")
    return r6(costs.lookup(cells, e, 0.95, 40.0), "value")


@query
def spread_draws(spark, sf):
    e = staged(costs.entry_episodes(views.quotes(spark, sf), views.PIP, GAP), "episodes")
    return r6(costs.draw(e.select(*costs.LEVELS[0]).distinct(), e, 7, 2), "pips")


@query
def median_true_range(spark, sf):
    return r6(costs.median_true_range(views.quotes(spark, sf), "4h", views.PIP, 100, GAP), "median_tr")


def _cube(spark, sf):
    return costs.cost_cube(views.quotes(spark, sf), ["4h", "1d"], views.PIP, 0.6, 50.0, 100, 0.95, GAP, 24 * 3_600_000)


@query
def cost_cube(spark, sf):
    return r6(_cube(spark, sf), "stop_pips", "entry_pips", "exit_pips", "commission_pips", "round_trip_pips", "c")


@query
def gate_verdict(spark, sf):
    return r6(costs.gate_verdict(_cube(spark, sf), 0.004), "best_c")


@query
def session_worst_spreads(spark, sf):
    return r6(costs.session_worst(_cube(spark, sf).where("session <> 'rollover'")), "entry_pips", "exit_pips")


@query
def sensitivity_surface(spark, sf):
    t = views.trades(spark, sf).select("book", (F.col("gross") * 0.08).alias("gross"), (F.col("cost") * (1 + F.col("supplier") % 2)).alias("cost"))
    return r6(costs.sensitivity(t), "expectancy")


# ------------------------------------------------------------ signals, fills


def _bundle(spark, sf, rsi=True):
    return features.lab_bundle(views.candles(spark, sf, "1h"), rsi)


def _signal(df):
    return r6(df.where("side IS NOT NULL").select("symbol", "ts", "side", "stop", "target"), "stop", "target")


@query
def signal_donchian(spark, sf):
    return _signal(signals.entries("donchian_breakout", _bundle(spark, sf, False), {"channel": 48, "atr_x": 1.5, "rr": 2.0}, views.PIP))


@query
def signal_mean_revert(spark, sf):
    return _signal(signals.entries("mean_revert", _bundle(spark, sf, False), {"range_z": 1.0, "dist_atr": 0.5, "stop_atr": 1.0}, views.PIP))


@query
def signal_trend_pullback(spark, sf):
    return _signal(signals.entries("trend_pullback", _bundle(spark, sf), {"slow": 50, "rr": 2.0, "atr_x": 1.5, "rsi_min": 48.0, "rsi_max": 52.0, "min_atr_pips": 1.0}, views.PIP))


@query
def signal_channel_volume(spark, sf):
    t = slices.over(views.candles(spark, sf, "1h"), lambda t, w: t.withColumn("atr", features.full(F.avg, F.col("high") - F.col("low"), 14, w)), 14, "ts")
    return signals.channel_volume(t, 0.0, 20, 20, 0.8, (6, 20)).select("symbol", "ts", "side")


@query
def signal_toy(spark, sf):
    t = features.trend_regime(features.returns_and_atr(views.bars(spark, sf)), 20)
    return r6(signals.toy_pullback(t, 10, 20, views.PIP).select("symbol", "available_at", "side", "stop", "target"), "stop", "target")


@query
def market_fills(spark, sf):
    return r6(ticks.market_fills(_orders(spark, sf), views.quotes(spark, sf), timedelta(minutes=30), 0.02).select("id", "fill_price", "latency_move"), "fill_price", "latency_move")


@query
def first_touch_exit(spark, sf):
    q = views.quotes(spark, sf)
    p = q.select(F.col("seq").alias("id"), "symbol", "ts", F.when(F.col("seq") % 8 == 0, "buy").otherwise("sell").alias("side"), F.when(F.col("seq") % 8 == 0, F.col("ask") - 8).otherwise(F.col("bid") + 8).alias("stop"), F.when(F.col("seq") % 8 == 0, F.col("ask") + 15).otherwise(F.col("bid") - 15).alias("target"))
    return r6(ticks.first_touch(p, q, timedelta(days=1)).select("id", "exit_ts", "exit_price", "exit_reason", "ambiguous"), "exit_price")


# ------------------------------------------------------------ risk, rules


@query
def risk_sizing(spark, sf):
    c = views.table(spark, sf, "customer")
    d = lambda x: F.round(x, 2).cast("decimal(18,2)")
    lit = lambda x: F.lit(x).cast("decimal(18,4)")
    o = c.select(
        "c_custkey", (F.col("c_custkey") % 17 != 0).alias("readable"), (F.col("c_custkey") % 13 == 0).alias("foreign_positions"), d(F.abs("c_acctbal") * 10).alias("equity"), d(F.abs("c_acctbal") * 5).alias("margin_available"),
        d(F.col("c_custkey") % 50).alias("daily_loss"), d(F.col("c_custkey") % 90).alias("open_risk"), d(F.col("c_custkey") % 30).alias("reserved_loss"), d(F.col("c_custkey") % 70).alias("reserved_margin"),
        (lit("0.0010") + (F.col("c_custkey") % 20).cast("decimal(18,0)") * lit("0.0002")).cast("decimal(18,4)").alias("stop_distance"), lit("0.0015").alias("gap_95"), d(F.abs("c_acctbal") * 0.5).alias("daily_limit"),
        lit("100000").alias("value_per_unit"), lit("0.01").alias("volume_step"), lit("0.01").alias("volume_min"), lit("0.50").alias("volume_max"),
    )
    return r6(rules.size_positions(o).select("c_custkey", "reason", F.col("volume").cast("double").alias("volume"), F.col("risk_amount").cast("double").alias("risk_amount"), F.col("effective_stop").cast("double").alias("effective_stop")), "volume", "risk_amount", "effective_stop")


@query
def reservation_greedy(spark, sf):
    li = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.floor(F.col("l_quantity")).cast("double").alias("max_loss"))
    got = rules.reserve_greedily(li, F.lit(400.0))
    return got.select("account", "seq", "max_loss", "accepted")


@query
def reservations_live(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 3).alias("key"), F.when(F.col("o_orderstatus") == "F", "release").otherwise("reserve").alias("kind"), F.col("o_totalprice").alias("max_loss"), (F.col("o_totalprice") / 4).alias("margin"), F.col("o_orderkey").alias("seq"))
    return r6(rules.live_reservations(o), "max_loss", "margin")


@query
def phase_breaches(spark, sf):
    got = rules.phase_breaches(views.account_path(spark, sf), 100_000, 40, 60_000, 90_000, ratchet=True)
    return got.select("account", "seq", "rule", F.col("equity").cast("double").alias("equity"), F.col("level").cast("double").alias("level"))


@query
def illegal_transitions(spark, sf):
    names = F.array(*[F.lit(s) for s in ("queued", "submitted", "filled", "open", "closed_tp", "rejected")])
    o = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.element_at(names, (F.col("l_suppkey") % 6 + 1).cast("int")).alias("status"))
    o = o.groupBy("order_id", "seq").agg(F.min("status").alias("status"))
    return rules.illegal_transitions(o)


# ------------------------------------------------------------ portfolio


@query
def drawdown_curve(spark, sf):
    t = portfolio.equity_curve(views.trades(spark, sf), ["book"])
    return r6(t.select("book", "seq", "balance", "peak", "dd_pct"), "balance", "peak", "dd_pct")


@query
def compounded_curve(spark, sf):
    t = portfolio.compounded_curve(views.trades(spark, sf), ["book"], F.lit(0.001))
    return t.select("book", "seq", F.round("equity", 4).alias("equity"), F.round("dd_pct", 4).alias("dd_pct"))


@query
def trade_metrics(spark, sf):
    return portfolio.trade_metrics(views.trades(spark, sf), ["book"])


@query
def merged_equity(spark, sf):
    return portfolio.merged_equity(views.trades(spark, sf), datetime(1997, 1, 1), datetime(1999, 1, 1), ["book"])


@query
def monthly_pnl(spark, sf):
    return r6(portfolio.monthly(views.trades(spark, sf), ["book"]), "pnl")


@query
def month_summary(spark, sf):
    return r6(portfolio.month_summary(portfolio.monthly(views.trades(spark, sf), ["book"]), ["book"]), "worst")


@query
def rolling_90d(spark, sf):
    t = portfolio.rolling_returns(views.trades(spark, sf), "book", datetime(1996, 1, 1), datetime(2000, 1, 1), 0.001)
    return r6(t.select("book", "window_start", "ret"), "ret")


@query
def rolling_90d_best_median(spark, sf):
    t = portfolio.rolling_returns(views.trades(spark, sf), "book", datetime(1996, 1, 1), datetime(2000, 1, 1), 0.001)
    return r6(portfolio.best_and_median(t, "book"), "best", "median")


@query
def topk_configs(spark, sf):
    t = views.trades(spark, sf).withColumn("params", F.col("supplier") % 20).groupBy("book", "params").agg(F.round(portfolio.profit_factor(F.col("pnl")), 6).alias("pf"), F.round(F.sum("pnl"), 6).alias("net"))
    return portfolio.top_configs(t, ["book"], 3)


@query
def acceptance_gate(spark, sf):
    t = portfolio.trade_metrics(views.trades(spark, sf).withColumn("params", F.col("supplier") % 20), ["book", "params"])
    return portfolio.accept(t.withColumnRenamed("profit_factor", "pf"), 1.2, 5.0, 15).select("book", "params", "pf", "max_dd_pct", "trades")


@query
def portfolio_frontier(spark, sf):
    t = views.trades(spark, sf)
    dd = portfolio.equity_curve(t, ["book"]).groupBy("book").agg(F.max("dd_pct").alias("val_dd"))
    got = portfolio.frontier(t, dd, [0.1, 0.2, 0.4, 0.8], 0.005, 8.0)
    return got.select("scale", F.round("max_dd_pct", 3).alias("max_dd_pct"), F.round(F.log10("end_equity"), 6).alias("log10_end"), "inside", "chosen")


# ------------------------------------------------------------ statistics


def _trials(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("selection_criterion"), F.col("o_orderstatus").alias("fill_mode"), F.when(F.col("o_orderkey") % 2 == 0, "v1").otherwise("v2").alias("feature_version"), (F.col("o_totalprice") / 100_000).alias("sr_periodic"))


@query
def ledger_dispersion(spark, sf):
    t = ledger.dispersion(_trials(spark, sf), ["selection_criterion", "fill_mode"])
    return r6(t, "s")


@query
def ledger_comparable(spark, sf):
    return ledger.comparable(_trials(spark, sf), "5-LOW", "F", "v1").agg(F.count(F.lit(1)).alias("trials"))


def _returns(spark, sf):
    return views.trades(spark, sf).select(F.col("supplier").alias("candidate"), "exit_ts", "seq", "r")


@query
def sharpe_se(spark, sf):
    return r6(stats.sharpe_table(_returns(spark, sf), ["candidate"]), "sr", "skew", "kurt", "se")


@query
def hac_autocorr(spark, sf):
    return r6(stats.autocorrelation_error(_returns(spark, sf), ["candidate"], ["exit_ts", "seq"]), "autocorr_sum", "se")


@query
def deflated_sharpe(spark, sf):
    """Ratios against the hurdle of all candidates' dispersion: one row of totals
    goes to the driver, the decision is a projection."""
    t = stats.sharpe_table(_returns(spark, sf), ["candidate"])
    n = t.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("sr").alias("s")).first()
    hurdle = stats.hurdle_empirical(n["s"], n["n"]) if n["n"] > 1 and n["s"] else 0.0
    sr, h, se = F.col("sr"), F.lit(hurdle), F.col("se")
    p, passes = stats.decision(sr, h, se, "iid, skew and kurtosis")
    return r6(t.select("candidate", ((sr - h) / se).alias("z"), p.alias("probability"), passes.alias("passes")), "z", "probability")


@query
def chain_verify(spark, sf):
    """A chain over all orders in which every 500th record is rewritten, text and hash,
    and every 800th edited without: what the check of links and own hashes finds."""
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority").alias("body"))
    return _broken(o, F.col("pos") % 500 == 0, F.col("pos") % 800 == 0)


def _broken(o, rewritten, edited):
    """The broken records of a chain over (pos, body) after some bodies were
    rewritten with their hash, and others edited without. A record's hash covers its
    body and the hash before it."""
    t = ledger.chained(o)
    t = t.withColumn("body", F.when(rewritten | edited, "x").otherwise(F.col("body")))
    t = t.withColumn("record_hash", F.when(rewritten, F.sha2(F.concat_ws("|", "body", "prev_hash"), 256)).otherwise(F.col("record_hash")))
    return ledger.broken_links(t, F.concat_ws("|", "body", "prev_hash")).select("pos", "prev_hash", "link_ok", "hash_ok")


# ------------------------------------------------------------ streams


@query
def stream_monitor(spark, sf):
    return capture.monitor_batch(views.quotes(spark, sf)).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query
def stale_quotes(spark, sf):
    q = views.quotes(spark, sf)
    names = q.select("symbol").distinct().unionByName(spark.createDataFrame([("never",)], "symbol string"))
    return capture.stale(capture.resume_points(q), names, datetime(2024, 1, 31), 5 * 3_600_000)


@query
def capture_coverage(spark, sf):
    return capture.coverage(views.quotes(spark, sf))


@query
def stream_resample(spark, sf):
    """The bars as a stream makes them, run to its end."""
    raw = capture.read_quotes(spark, f"{sf}/events.parquet" if _is_dir(spark, f"{sf}/events.parquet") else _folder_of(spark, f"{sf}/events.parquet"))
    return _finish(spark, capture.stream_bars(views.as_quotes(raw)), "append", "bars")


def _is_dir(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _folder_of(spark, path):
    """A stream reads folders: a pattern that matches the one file."""
    head, tail = path.rsplit("/", 1)
    return f"{head}/{tail[:-1]}[{tail[-1]}]"


def _finish(spark, stream, mode, name):
    import uuid

    where = f"{shared_folder(spark)}/tickloom/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


# ------------------------------------------------------------ replays

SPREADS = {s: 2.0 for s in sessions.SESSIONS}


def _account():
    return replay.Account(pip=views.PIP, contract=100.0, spreads=SPREADS, commission_per_lot=0.1)


@query
def lab_replay_donchian(spark, sf):
    return r6(replay.grid_replay(_bundle(spark, sf, False), "donchian_breakout", signals.grid("donchian_breakout"), _account()).drop("n"), "entry_price", "exit_price", "stop_price", "volume", "pnl", "commission", "r")


@query
def lab_replay_momentum(spark, sf):
    got = replay.grid_replay(_bundle(spark, sf, False), "london_momentum", signals.grid("london_momentum"), _account())
    return r6(got.drop("n"), "entry_price", "exit_price", "stop_price", "volume", "pnl", "commission", "r")


@query
def lab_replay_opening_range(spark, sf):
    got = replay.grid_replay(_bundle(spark, sf, False), "opening_range_break", signals.grid("opening_range_break"), _account())
    return r6(got.drop("n"), "entry_price", "exit_price", "stop_price", "volume", "pnl", "commission", "r")


@query
def lab_replay_trailing(spark, sf):
    acc = _account()
    acc.trail = {"act_r": 0.5, "sl_r": 0.5, "tp_r": 1.0}
    got = replay.grid_replay(_bundle(spark, sf, False), "trailing_momentum", signals.grid("trailing_momentum"), acc)
    return r6(got.drop("n"), "entry_price", "exit_price", "stop_price", "volume", "pnl", "commission", "r")


SPLIT = datetime(2024, 1, 20)


def _best_validated(bundle, sets, trades, later, k, pf, dd):
    """The k best of sets (strategy, params) of each symbol and family on the earlier
    part, with what they make on the later part and whether that passes. A set
    without trades counts as one that makes nothing. The winners (k a symbol and
    family) come to the driver, and later replays only sets among them."""
    by = ["symbol", "strategy"]
    every = bundle.select("symbol").distinct().crossJoin(bundle.sparkSession.createDataFrame(sets, "strategy string, params string"))
    scored = trades.groupBy(*by, "params").agg(F.round(portfolio.profit_factor(F.col("pnl")), 6).alias("pf"), F.round(F.sum("pnl"), 6).alias("net"), F.count(F.lit(1)).alias("trades"))
    scored = every.join(scored, [*by, "params"], "left").na.fill(0, ["trades"]).na.fill(0.0, ["pf", "net"])
    top = portfolio.top_configs(scored, by, k).select(*by, "params", "rank", F.col("pf").alias("train_pf"), F.col("net").alias("train_net"), F.col("trades").alias("train_trades"))
    top = bundle.sparkSession.createDataFrame(top.collect(), top.schema)
    valid = later({(r["strategy"], r["params"]) for r in top.collect()})
    test = portfolio.trade_metrics(valid.withColumnRenamed("n", "seq"), [*by, "params"])
    out = top.join(test, [*by, "params"], "left").na.fill(0, ["trades"]).na.fill(0.0, ["win_rate", "profit_factor", "net", "return_pct", "max_dd_pct", "total_r"])
    return out.withColumn("accepted", (F.col("profit_factor") >= pf) & (F.col("max_dd_pct") < dd) & (F.col("trades") >= 15))


@query
def grid_optimiser(spark, sf):
    """Every family's whole grid: train on the first two thirds, keep the three best
    of each symbol and family, replay those on the rest, and gate."""
    bundle = staged(_bundle(spark, sf), "bundle")
    sets = [(name, json.dumps(p, sort_keys=True)) for name in signals.GRIDS for p in signals.grid(name)]

    def part(name, wanted):
        out = None
        for family in signals.GRIDS:
            grid = [p for p in signals.grid(family) if (family, json.dumps(p, sort_keys=True)) in wanted]
            if grid:
                one = replay.grid_replay(bundle, family, grid, _account(), split=SPLIT, part=name)
                out = one if out is None else out.unionByName(one)
        return out

    return _best_validated(bundle, sets, part("train", set(sets)), lambda best: part("valid", best), 3, 2, 5)


@query
def tick_replay(spark, sf):
    q = views.quotes(spark, sf)
    d = lambda c: F.round(c, 4).cast("decimal(18,8)")
    on = F.col("seq") % 6 == 0
    buy = F.col("seq") % 12 == 0
    t = q.select("symbol", "ts", "seq", d(F.col("bid")).alias("bid"), d(F.col("ask")).alias("ask"), F.when(on, F.when(buy, "buy").otherwise("sell")).alias("side"), d(F.when(buy, F.col("bid") - 20).otherwise(F.col("ask") + 20)).alias("stop"), d(F.when(buy, F.col("ask") + 30).otherwise(F.col("bid") - 30)).alias("target"), F.lit("0.10").cast("decimal(18,8)").alias("volume"))
    got = ticks.replay_table(t, ticks.Venue(contract=Decimal(100), fee_per_lot=Decimal(7)))
    return r6(got.withColumns({c: F.col(c).cast("double") for c in ("volume", "entry_price", "exit_price", "pnl", "r_multiple")}), "pnl", "r_multiple")


# ------------------------------------------------------------ sources


@query
def hour_sequence(spark, sf):
    """Whole hours from the first to the last quote."""
    r = views.quotes(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return binary.hours(spark, r["a"], r["b"])


@query
def file_paths(spark, sf):
    d = views.quotes(spark, sf).select("symbol", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    return d.select("symbol", "hour", binary.hour_path_column().alias("path"))


@query
def money_rounding(spark, sf):
    """Volumes down to their step, costs up to theirs, halves to even."""
    li = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    step = F.lit("0.30").cast("decimal(18,2)")
    t = li.select("l_orderkey", "l_linenumber", units.round_volume_down(F.col("q"), step).cast("double").alias("down"), units.round_up(F.col("p"), step).cast("double").alias("up"), units.half_even(F.col("p") / 10, 1).cast("double").alias("even"))
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.sum("down").alias("down"), F.sum("up").alias("up"), F.sum("even").alias("even"))


@query
def month_partitions(spark, sf):
    t = views.trades(spark, sf)
    return t.groupBy(sessions.month_key(F.col("exit_ts")).alias("month")).agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------ research


@query
def event_order(spark, sf):
    """Events of one instant in order of execution, on a venue that posts swaps
    before it resets."""
    q = views.quotes(spark, sf)
    kinds = F.array(*[F.lit(k) for k in research.EVENT_KINDS])
    t = q.select("seq", F.element_at(kinds, (F.col("seq") % 9 + 1).cast("int")).alias("kind"))
    return t.select("seq", "kind", research.event_priority(F.col("kind"), reset_before_swap=False).alias("priority"))


@query
def artefact_expanding(spark, sf):
    q = views.quotes(spark, sf).select("seq", "symbol", "ts", "bid")
    t = research.expanding_fit(q, "ts", "bid", datetime(2024, 1, 20))
    return t.select("seq", F.round(F.col("fitted") * F.col("observations"), 2).alias("total"), "observations")


@query
def best_risk(spark, sf):
    """Each book at five risks: drawdown and median window, the best that fits."""
    levels = (0.0005, 0.001, 0.002, 0.004, 0.008)
    t = views.trades(spark, sf).select("book", "exit_ts", "seq", "r")
    by = ["book", "risk"]
    risk = F.create_map(*[x for i, k in enumerate(levels) for x in (F.lit(f"a{i}"), F.lit(k))])
    dd = portfolio.compounded_ends(t, ["book"], {f"a{i}": F.lit(k) for i, k in enumerate(levels)}).select("book", risk[F.col("name")].alias("risk"), "max_dd_pct")
    t = t.withColumn("risk", F.explode(F.array(*[F.lit(k) for k in levels])))
    med = portfolio.best_and_median(portfolio.rolling_returns(t, by, datetime(1996, 1, 1), datetime(2000, 1, 1), F.col("risk")), by)
    return r6(research.best_fitting(dd.join(med.select(*by, "median"), by), "book", 8.0), "max_dd_pct", "median")


@query
def account_allowed(spark, sf):
    """Customers that match a register entry in every identity field."""
    c = views.table(spark, sf, "customer")
    ident = c.select("c_custkey", F.sha2("c_name", 256).alias("login_hash"), F.col("c_mktsegment").alias("server"), F.lit("demo").alias("account_type"), F.when(F.col("c_nationkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.lit("phase1").alias("phase"))
    register = ident.where("c_custkey % 5 = 0").withColumn("currency", F.lit("USD")).drop("c_custkey")
    return rules.allowed(ident, register).select("c_custkey", "login_hash")


@query
def null_false_positives(spark, sf):
    """How often 200 batches of 40 candidates without an edge pass all the same."""
    t = research.deflated(research.null_batches(spark, 200), 40, 1000)
    return t.agg(F.count(F.lit(1)).alias("batches"), F.count_if("passes").alias("passed"), F.round(F.avg("best"), 6).alias("mean_best"))


@query
def trailing_sweep(spark, sf):
    """All entries with all trailing brackets: the six best by symbol on the first
    two thirds, replayed on the rest, and gated."""
    bundle = staged(_bundle(spark, sf, False), "bundle")

    def part(name, grid, trails):
        return replay.grid_replay(bundle, "trailing_momentum", grid, _account(), chunk=1, split=SPLIT, part=name, trails=trails)

    def later(best):
        names = {params for _, params in best}
        grid = [p for p in signals.grid("trailing_momentum") if any(n.startswith(json.dumps(p, sort_keys=True) + "|") for n in names)]
        return part("valid", grid, [t for t in research.trails() if any(n.endswith(f"|{t}") for n in names)])

    sets = [("trailing_momentum", f"{json.dumps(p, sort_keys=True)}|{t}") for p in signals.grid("trailing_momentum") for t in research.trails()]
    return _best_validated(bundle, sets, part("train", signals.grid("trailing_momentum"), research.trails()), later, 6, 1.6, 8)
