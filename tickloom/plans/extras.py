"""Further registered queries, each beside its DuckDB text."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tickloom import jobs
from tickloom.functions import sessions, stats, units
from tickloom.operators import asof, bars, costs, features, ledger, portfolio, rules, ticks
from tickloom.plans import views
from tickloom.plans.catalog import GAP, _bundle, _cube, _finish, _is_dir, _folder_of, _returns, query, r6
from tickloom.plans.oracle import C1H, CAPTURE, CUBE, EPI, ORACLES, PF, Q, QB, QL, SH, TR, TREND, WA, WT, atr, curve, roll, text
from tickloom.session import shared_folder
from tickloom.sources import binary, dimensions, tables
from tickloom.streaming import capture


def _place(spark, name):
    """A fresh folder in the shared one."""
    return f"{shared_folder(spark)}/tickloom/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------ units, dimensions

SPECS = [
    {"symbol": s, "point_size": "0.001", "pip_size": "0.01", "contract_size": c, "tick_size": "0.001", "tick_value": "1", "volume_min": "0.05", "volume_step": "0.01", "volume_max": "50", "quote_currency": q}
    for s, c, q in (("click", "100", "USD"), ("view", "1000", "JPY"), ("purchase", "100", "USD"), ("error", "10", "JPY"), ("signup", "100", "USD"))
]


@query
def unit_conversions(spark, sf):
    """Line items as orders of instruments: prices, pips, volumes, pip values, profit,
    commission and buckets in decimals."""
    li = views.table(spark, sf, "lineitem")
    names = F.array(*[F.lit(s["symbol"]) for s in SPECS])
    o = li.select("l_orderkey", "l_linenumber", F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("symbol"), F.round("l_quantity", 2).cast("decimal(18,8)").alias("pips"), F.round("l_extendedprice", 2).cast("decimal(18,8)").alias("price"), F.round(F.col("l_discount") * 2, 2).cast("decimal(18,8)").alias("lots"), (F.col("l_orderkey") % 2 == 0).alias("_buy"))
    t = o.join(F.broadcast(dimensions.instruments(spark, SPECS)), "symbol")
    side = F.when(F.col("_buy"), "buy").otherwise("sell")
    got = t.select(
        "l_orderkey", "l_linenumber", units.pips_to_price(F.col("pips"), F.col("pip_size")).alias("distance"), units.price_to_pips(F.col("price"), F.col("pip_size")).alias("in_pips"), units.tradable_volume(F.col("lots"), F.col("volume_step"), F.col("volume_min")).alias("tradable"),
        units.pip_value_usd(F.col("contract_size").cast("double"), F.col("pip_size").cast("double"), F.col("price").cast("double"), F.col("quote_currency")).alias("pip_value"), units.pnl(side, F.col("lots"), F.col("price"), F.col("price") + F.col("pips"), F.col("contract_size")).alias("pnl"),
        units.round_trip_commission(F.col("lots"), units.exact("7")).alias("fee"), units.volatility_bucket(F.col("pips") / 20).alias("volatility"), units.rule_amount(F.when(F.col("_buy"), "percent_initial_capital").otherwise("absolute"), F.col("pips"), F.col("price")).alias("amount"),
    )
    keys = ("distance", "in_pips", "tradable", "pip_value", "pnl", "fee", "amount")
    return r6(got.withColumns({c: F.col(c).cast("double") for c in keys}), *keys)


text("unit_conversions", "s AS (SELECT * FROM (VALUES ('click', 100, 'USD', 0), ('view', 1000, 'JPY', 1), ('purchase', 100, 'USD', 2), ('error', 10, 'JPY', 3), ('signup', 100, 'USD', 4)) v(symbol, contract, quote, k)), o AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS k, round(l_quantity, 2) AS pips, round(l_extendedprice, 2) AS price, CAST(round(l_discount * 2, 2) AS DECIMAL(18, 2)) AS lots, l_orderkey % 2 = 0 AS buy FROM lineitem)",
    "SELECT l_orderkey, l_linenumber, round(pips * 0.01, 6) AS distance, round(price / 0.01, 6) AS in_pips, CASE WHEN lots >= 0.05 THEN CAST(lots AS DOUBLE) END AS tradable, round(CASE WHEN quote = 'USD' THEN contract * 0.01::DOUBLE ELSE contract * 0.01::DOUBLE / price END, 6) AS pip_value, round(CASE WHEN buy THEN pips ELSE -pips END * CAST(lots AS DOUBLE) * contract, 6) AS pnl, round(CAST(lots AS DOUBLE) * 7, 6) AS fee, CASE WHEN pips / 20 < 0.5 THEN 'low' WHEN pips / 20 > 1.5 THEN 'high' ELSE 'normal' END AS volatility, round(CASE WHEN buy THEN price * pips / 100 ELSE pips END, 6) AS amount FROM o JOIN s USING (k)")


@query
def commission_pips(spark, sf):
    """Commission a lot in pips; symbols quoted in the stream's "view" are converted
    by its last bid."""
    q = views.quotes(spark, sf)
    rate = q.withColumn("symbol", F.when(F.col("symbol") == "view", "USDJPY").otherwise(F.col("symbol")))
    specs = spark.createDataFrame([(s["symbol"], float(s["pip_size"]), float(s["contract_size"]), s["quote_currency"], 6.0) for s in SPECS], "symbol string, pip_size double, contract_size double, quote_currency string, commission double")
    return r6(costs.commission_in_pips(specs, rate).select("symbol", "pip_value", "commission_pips"), "pip_value", "commission_pips")


text("commission_pips", Q + ", l AS (SELECT last(bid ORDER BY ts, seq) AS rate FROM quotes WHERE symbol = 'view'), s(symbol, contract, quote) AS (VALUES ('click', 100, 'USD'), ('view', 1000, 'JPY'), ('purchase', 100, 'USD'), ('error', 10, 'JPY'), ('signup', 100, 'USD')), v AS (SELECT symbol, CASE WHEN quote = 'USD' THEN 0.01::DOUBLE * contract ELSE 0.01::DOUBLE * contract / rate END AS pv FROM s, l)", "SELECT symbol, round(pv, 6) AS pip_value, round(6 / pv, 6) AS commission_pips FROM v")


# ------------------------------------------------------------ files


@query
def day_paths(spark, sf):
    d = views.quotes(spark, sf).select("symbol").distinct().crossJoin(F.broadcast(binary.days(spark, date(2024, 1, 30), date(2024, 3, 2))))
    return d.select("symbol", "day", binary.day_path_column().alias("path"))


text("day_paths", "", "SELECT symbol, CAST(d AS DATE) AS day, printf('%s/%04d/%02d/%02d/BID_candles_min_1.bi5', symbol, year(d), month(d) - 1, day(d)) AS path FROM (SELECT DISTINCT event_type AS symbol FROM events), range(DATE '2024-01-30', DATE '2024-03-02', INTERVAL '1 day') t(d)")


SYMBOLS = {"click": "EURUSD", "view": "USDJPY", "purchase": "XAUUSD", "error": "GBPUSD", "signup": "AUDUSD"}


@query
def binary_ticks(spark, sf):
    """Quotes packed into hour files and decoded again."""
    names = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    q = views.quotes(spark, sf).withColumn("symbol", names[F.col("symbol")])
    got = binary.decode_ticks(binary.encode_ticks(q)).where("error IS NULL")
    return r6(got.groupBy("symbol", "slot").agg(F.count(F.lit(1)).alias("ticks"), F.min("ts").alias("first_ts"), F.sum("bid").alias("bids"), F.sum("ask").alias("asks"), F.sum("bid_volume").alias("volume")), "bids", "asks", "volume")


_SCALED = "CASE event_type WHEN 'view' THEN 1000 WHEN 'purchase' THEN 1000 ELSE 100000 END"
text("binary_ticks", Q + f", s AS (SELECT event_type, event_id, {_SCALED} AS k FROM events)", "SELECT CASE symbol " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYMBOLS.items()) + " END AS symbol, date_trunc('hour', ts) AS slot, count(*) AS ticks, min(date_trunc('millisecond', ts)) AS first_ts, round(sum(floor(bid * k + 0.5) / k), 6) AS bids, round(sum(floor(ask * k + 0.5) / k), 6) AS asks, sum(bid_volume) AS volume FROM quotes JOIN s ON event_id = seq GROUP BY 1, 2")


@query
def tick_partitions(spark, sf):
    """Quotes written by symbol and month and read back, one symbol whole and a month of
    another."""
    path = _place(spark, "ticks")
    tables.write_ticks(views.quotes(spark, sf), path)
    got = tables.read_ticks(spark, path, "click").unionByName(tables.read_ticks(spark, path, "view", "2024-01"))
    return r6(got.groupBy("symbol", sessions.month_key(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("ticks"), F.sum("bid").alias("bids")), "bids")


text("tick_partitions", Q, "SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS ticks, round(sum(bid), 6) AS bids FROM quotes WHERE symbol = 'click' OR (symbol = 'view' AND strftime(ts, '%Y-%m') = '2024-01') GROUP BY 1, 2")


@query
def capture_files(spark, sf):
    """Quotes captured as JSON lines by a stream and scanned again, instants as text
    with Z, the gap flag filled where a line has none."""
    path = _place(spark, "capture")
    raw = capture.read_quotes(spark, f"{sf}/events.parquet" if _is_dir(spark, f"{sf}/events.parquet") else _folder_of(spark, f"{sf}/events.parquet"))
    q = views.as_quotes(raw).select("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "bid", "ask", "bid_volume", "ask_volume")
    q.writeStream.format("json").partitionBy("symbol").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    got = tables.read_capture(spark, path)
    return r6(got.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("ask").alias("asks"), F.count_if("sequence_gap").alias("gaps")), "asks")


text("capture_files", Q, "SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(ask), 6) AS asks, CAST(0 AS BIGINT) AS gaps FROM quotes GROUP BY 1")


@query
def gate_record(spark, sf):
    """The cost cube saved as a record, found as the newest file, and its sessions'
    worst spreads."""
    folder = _place(spark, "gate")
    cells = [{"symbol": r["symbol"], "session": r["session"], "timeframe": r["timeframe"], "entry_spread_pips": r["entry_pips"], "stop_exit_spread_pips": r["exit_pips"], "c": r["c"], "cost_level": r["cost_level"]} for r in _cube(spark, sf).collect()]
    tables.write_json(spark, {"cells": cells[:1]}, f"{folder}/gate_0.json")
    tables.write_json(spark, {"cells": cells}, f"{folder}/gate_1.json")
    return r6(costs.session_worst(tables.gate_cells(spark, tables.newest_file(spark, folder, "gate_"))), "entry_pips", "exit_pips")


text("gate_record", CUBE, "SELECT symbol, session, round(max(entry_pips), 6) AS entry_pips, round(max(exit_pips), 6) AS exit_pips FROM cube GROUP BY 1, 2")


@query
def artefact_files(spark, sf):
    """A fitted table saved with its stamps and loaded when it may be read."""
    path = _place(spark, "artefact")
    fitted = views.quotes(spark, sf).groupBy("symbol").agg(F.round(F.avg("bid"), 6).alias("level"))
    tables.save_artefact(fitted, path, datetime(2024, 1, 1), datetime(2024, 1, 20), datetime(2024, 1, 21))
    return tables.load_artefact(spark, path, datetime(2024, 1, 22)).select("symbol", "level", "available_from", "policy")


text("artefact_files", Q, "SELECT symbol, round(avg(bid), 6) AS level, TIMESTAMP '2024-01-21 00:00:00' AS available_from, 'frozen' AS policy FROM quotes GROUP BY 1")


# ------------------------------------------------------------ checks and joins


@query
def ledger_faults(spark, sf):
    o = views.table(spark, sf, "orders")
    r = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.col("o_clerk") if "o_clerk" in o.columns else F.lit("x")).alias("candidate"), F.when(F.col("o_orderkey") % 11 != 0, "s").alias("strategy"), F.lit("click").alias("symbol"), F.col("o_orderpriority").alias("selection_criterion"), F.col("o_orderstatus").alias("fill_mode"), F.when(F.col("o_orderkey") % 13 == 0, float("nan")).otherwise(F.col("o_totalprice") / 100_000).alias("sr_periodic"), (F.col("o_custkey") % 30).alias("n_observations"))
    return ledger.invalid(r).select("o_orderkey", F.array_join("faults", "; ").alias("faults"))


text("ledger_faults", "f AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'candidate is blank' END, CASE WHEN o_orderkey % 11 = 0 THEN 'strategy is blank' END, CASE WHEN o_orderkey % 13 = 0 THEN 'sr_periodic is not finite' END, CASE WHEN o_custkey % 30 < 2 THEN 'fewer than two observations' END], lambda x: x IS NOT NULL) AS x FROM orders)", "SELECT o_orderkey, array_to_string(x, '; ') AS faults FROM f WHERE len(x) > 0")


@query
def outage_register(spark, sf):
    """Bars that meet an outage of a register: one of all symbols, one a purchase day."""
    q = views.quotes(spark, sf)
    own = q.where("symbol = 'purchase'").groupBy(F.to_date("ts").alias("d")).agg(F.min("ts").alias("start")).select(F.lit("purchase").alias("symbol"), "start", (F.col("start") + F.expr("interval 90 minutes")).alias("end"))
    every = spark.createDataFrame([(None, a, b) for a, b in views.OUTAGES], "symbol string, start timestamp_ntz, end timestamp_ntz")
    return bars.outage_overlap(views.bars(spark, sf), own.unionByName(every)).where("known_outage").select("symbol", "ts_open")


text("outage_register", QB + ", o AS (SELECT 'purchase' AS s, min(ts) AS a, min(ts) + INTERVAL '90 minutes' AS b FROM quotes WHERE symbol = 'purchase' GROUP BY CAST(ts AS DATE) UNION ALL VALUES (NULL, TIMESTAMP '2024-01-05 06:00:00', TIMESTAMP '2024-01-05 11:00:00'), (NULL, TIMESTAMP '2024-01-17 00:00:00', TIMESTAMP '2024-01-17 09:30:00'))", "SELECT symbol, ts_open FROM bars WHERE EXISTS (SELECT 1 FROM o WHERE (s IS NULL OR s = symbol) AND ts_open < b AND available_at > a)")


@query
def leak_on_open(spark, sf):
    b = views.bars(spark, sf)
    return r6(features.join_on_open(b, bars.last_close(b, 86_400)).select("symbol", "available_at", "higher_close"), "higher_close")


text("leak_on_open", QB + ", high AS (SELECT symbol, date_trunc('day', ts_open) AS d, last(bid_close ORDER BY ts_open) AS higher_close FROM bars GROUP BY 1, 2)", "SELECT b.symbol, b.available_at, round(h.higher_close, 6) AS higher_close FROM bars b LEFT JOIN high h ON h.symbol = b.symbol AND h.d = b.ts_open")


@query
def calendar_honest(spark, sf):
    """The event published last before each bar is known, within a day."""
    at = datetime(2024, 1, 2, 8, 30)
    events = dimensions.calendar(spark, [{"event_id": f"n{k}", "scheduled_time": at + timedelta(days=2 * k), "affected_currencies": ["USD"], "affected_instruments": ["click"], "restriction_status": "x", "source": "s", "available_at": at + timedelta(days=2 * k, hours=-20 if k % 3 else 1)} for k in range(14)])
    return asof.calendar_known(views.bars(spark, sf), events, "available_at").select("symbol", "available_at", "scheduled_time")


text("calendar_honest", QB + ", e AS (SELECT TIMESTAMP '2024-01-02 08:30:00' + to_days(CAST(2 * k AS INTEGER)) AS scheduled_time, TIMESTAMP '2024-01-02 08:30:00' + to_days(CAST(2 * k AS INTEGER)) + to_hours(CASE WHEN k % 3 <> 0 THEN -20 ELSE 1 END) AS known FROM range(14) t(k))", "SELECT symbol, available_at, CASE WHEN available_at - known <= INTERVAL '1 day' THEN scheduled_time END AS scheduled_time FROM bars ASOF LEFT JOIN e ON bars.available_at >= e.known")


@query
def session_regime_join(spark, sf):
    """The regime column joined back on available_at."""
    b = views.bars(spark, sf)
    regime = b.select("symbol", "available_at", sessions.known_session(F.col("available_at")).alias("session_regime"))
    return b.join(regime, ["symbol", "available_at"], "left").groupBy("symbol", "session_regime").agg(F.count(F.lit(1)).alias("bars"), F.sum("tick_count").alias("ticks"))


def _known_session(ts):
    from tickloom.plans.oracle import bucket

    return f"coalesce({bucket(ts)}, 'unknown')"


text("session_regime_join", QB, f"SELECT symbol, {_known_session('available_at')} AS session_regime, count(*) AS bars, CAST(sum(tick_count) AS BIGINT) AS ticks FROM bars GROUP BY 1, 2")


@query
def feature_composite(spark, sf):
    """All features of the bar pipeline on one frame."""
    t = features.composite(views.bars(spark, sf), 14, 20, 20, 4, 22)
    return r6(t.select("symbol", "available_at", "ret_1", "atr", "spread_median", "spread_ratio", "trend_strength", "trend_state", "vol_regime_quintile"), "ret_1", "atr", "spread_median", "spread_ratio", "trend_strength")


# Of 22 sorted values the nearest to rank 21 p, from 0, at 20, 40, 60 and 80 %.
RANKS = ", ".join(f"list_sort(list(m) OVER ({WA} ROWS BETWEEN 21 PRECEDING AND CURRENT ROW))[{k}] AS q{p}" for p, k in ((2, 5), (4, 9), (6, 14), (8, 18)))
text("feature_composite", QB + "," + atr(14) + f""", c0 AS (SELECT *, ask_close - bid_close AS spread, {roll('avg', 'atr', 4, WA)} AS m FROM a),
c1 AS (SELECT *, {roll('median', 'spread', 20, WA)} AS md, (bid_close - {roll('avg', 'bid_close', 20, WA)}) / nullif({roll('stddev_samp', 'bid_close', 20, WA)}, 0) AS st, count(m) OVER ({WA} ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS n, {RANKS} FROM c0)""",
    "SELECT symbol, available_at, round(ret_1, 6) AS ret_1, round(atr, 6) AS atr, round(md, 6) AS spread_median, round(spread / nullif(md, 0), 6) AS spread_ratio, round(st, 6) AS trend_strength, CASE WHEN st IS NULL THEN NULL WHEN st > 0.5 THEN 'up' WHEN st < -0.5 THEN 'down' ELSE 'none' END AS trend_state, CASE WHEN n < 22 OR m IS NULL THEN NULL ELSE 1 + CAST(m > q2 AS BIGINT) + CAST(m > q4 AS BIGINT) + CAST(m > q6 AS BIGINT) + CAST(m > q8 AS BIGINT) END AS vol_regime_quintile FROM c1")


# ------------------------------------------------------------ streams


@query
def sequence_gaps(spark, sf):
    q = views.quotes(spark, sf).drop("sequence_gap").withColumn("ts", F.when(F.col("seq") % 17 == 0, F.col("ts") - F.expr("interval 9 hours")).otherwise(F.col("ts")))
    return capture.sequence_flags(q).where("sequence_gap").select("seq", "symbol")


text("sequence_gaps", Q + ", d AS (SELECT * REPLACE (CASE WHEN seq % 17 = 0 THEN ts - INTERVAL '9 hours' ELSE ts END AS ts) FROM quotes), m AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM d)", "SELECT seq, symbol FROM m WHERE ts < mark")


@query
def capture_downtime(spark, sf):
    """Three starts of the service a symbol, the last two before one quote."""
    names = views.quotes(spark, sf).select("symbol").distinct()
    starts = names.select("symbol", F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in (datetime(2024, 1, 3, 4, 5, 6), datetime(2024, 1, 9), datetime(2024, 1, 9, 0, 0, 1))])).alias("since"))
    return capture.downtime(views.quotes(spark, sf), starts)


text("capture_downtime", Q + ", s AS (SELECT DISTINCT symbol, since FROM quotes, (VALUES (TIMESTAMP '2024-01-03 04:05:06'), (TIMESTAMP '2024-01-09 00:00:00'), (TIMESTAMP '2024-01-09 00:00:01')) v(since)), f AS (SELECT s.symbol, since, (SELECT min(ts) FROM quotes q WHERE q.symbol = s.symbol AND q.ts >= since) AS ts FROM s), l AS (SELECT symbol, ts, max(since) AS since FROM f WHERE ts IS NOT NULL GROUP BY 1, 2)", "SELECT symbol, CAST(sum((epoch_us(ts) - epoch_us(since)) // 1000) AS BIGINT) AS downtime_ms, count(*) AS windows FROM l GROUP BY 1")

LIMITS = {"asia": 3 * 3_600_000, "london": 3_600_000, "overlap": 1_800_000, "rollover": 600_000}


@query
def continuity_breaks(spark, sf):
    """Gaps over the threshold of the session they end in."""
    return capture.gaps_over_threshold(views.quotes(spark, sf), LIMITS)


text("continuity_breaks", QL + f", g AS (SELECT symbol, {CAPTURE} AS bucket, (epoch_us(ts) - epoch_us(prev)) // 1000 AS gap FROM lagged WHERE prev IS NOT NULL)", f"SELECT symbol, g.bucket, count(*) FILTER (WHERE gap > lim) AS breaks, max(gap) AS widest_ms FROM g JOIN (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in LIMITS.items())}) l(bucket, lim) ON l.bucket = g.bucket GROUP BY 1, 2")


# ------------------------------------------------------------ costs


@query
def spread_draw_levels(spark, sf):
    """Draws from the first fallback level with enough episodes, with provenance."""
    e = costs.entry_episodes(views.quotes(spark, sf), views.PIP, GAP)
    more = spark.createDataFrame([("click", "asia", "normal", False, 0, 10**12 + k, 0.25 + k) for k in range(9)], "symbol string, session string, volatility string, news boolean, weekday int, seq long, pips double")
    e = costs.add_episodes(e, more)
    cells = spark.createDataFrame([(s, x, v, False, d) for s in ("click", "view", "nothing") for x in sessions.SESSIONS for v in ("normal", "high") for d in (0, 5)], "symbol string, session string, volatility string, news boolean, weekday int")
    return r6(costs.draw(cells, e, 7, 3), "pips")


_LEVELS = (("symbol, session, weekday", "e.symbol = c.symbol AND e.session = c.session AND e.weekday = c.weekday AND c.volatility = 'normal'", "symbol+session+volatility+news+weekday"), ("symbol, session", "e.symbol = c.symbol AND e.session = c.session AND c.volatility = 'normal'", "symbol+session+volatility"), ("symbol, session", "e.symbol = c.symbol AND e.session = c.session", "symbol+session"), ("symbol", "e.symbol = c.symbol", "symbol"))
text("spread_draw_levels", QL + "," + EPI.replace("e AS (", "e0 AS (") + ", e AS (SELECT * FROM e0 UNION ALL SELECT 'click', 'asia', 0, 1000000000000 + k, 0.25 + k FROM range(9) t(k)), c AS (SELECT s AS symbol, x AS session, v AS volatility, false AS news, CAST(d AS INTEGER) AS weekday, CAST(n AS INTEGER) AS draw FROM (VALUES ('click'), ('view'), ('nothing')) a(s), (VALUES ('asia'), ('london'), ('new_york'), ('overlap'), ('rollover')) b(x), (VALUES ('normal'), ('high')) h(v), (VALUES (0), (5)) w(d), (VALUES (1), (2), (3)) y(n)), m AS (" + " UNION ALL ".join(f"SELECT c.*, {i} AS lv, '{n}' AS level, list_sort(list(e.pips)) AS l FROM c JOIN e ON {on} GROUP BY ALL HAVING count(*) >= 8" for i, (_, on, n) in enumerate(_LEVELS)) + "), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, session, volatility, weekday, draw ORDER BY lv) = 1)",
    "SELECT symbol, session, volatility, news, weekday, draw, round(l[CAST(('0x' || substr(md5(concat_ws('|', '7', symbol, session, volatility, 'false', weekday, draw)), 1, 12))::BIGINT % len(l) AS INTEGER) + 1], 6) AS pips, level, CAST(len(l) AS BIGINT) AS episodes FROM b")


_own = ORACLES["spread_draw_levels"]
_a, _b = _own.index(", c AS (SELECT s AS symbol"), _own.index(", m AS (")
_c = ", c AS (SELECT d.*, 'normal' AS volatility, false AS news, CAST(n AS INTEGER) AS draw FROM (SELECT DISTINCT symbol, session, weekday FROM e) d, (VALUES (1), (2)) y(n))"
_u = " UNION ALL SELECT 'click', 'asia', 0, 1000000000000 + k, 0.25 + k FROM range(9) t(k)"
ORACLES["spread_draws"] = (_own[:_a] + _c + _own[_b:]).replace(_u, "").replace("SELECT symbol, session, volatility, news, weekday, draw,", "SELECT symbol, session, volatility, news, CAST(weekday AS INTEGER) AS weekday, draw,")


# ------------------------------------------------------------ portfolio


@query
def window_growth(spark, sf):
    """Compounded growth over rolling windows, each book at 0.1 % a trade."""
    t = portfolio.window_growth(views.trades(spark, sf), ["book"], F.lit(0.001), datetime(1992, 1, 1), datetime(1999, 1, 1))
    return t.select("book", "window_start", F.round("growth", 4).alias("growth"))


text("window_growth", TR + ", c AS (SELECT book, exit_ts, seq, 10000 * exp(sum(ln(1 + r * 0.001)) OVER (PARTITION BY book ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS eq FROM trades), x AS (SELECT book, exit_ts, last(eq ORDER BY seq) AS eq FROM c GROUP BY 1, 2), s AS (SELECT DISTINCT book, TIMESTAMP '1992-01-01' + to_days(CAST(15 * k AS INTEGER)) AS a FROM trades, range(0, 300) t(k) WHERE TIMESTAMP '1992-01-01' + to_days(CAST(15 * k AS INTEGER)) + INTERVAL '90 days' <= TIMESTAMP '1999-01-01'), p AS (SELECT s.book, a, a + INTERVAL '90 days' AS b, coalesce(x.eq, 10000) AS e0 FROM s ASOF LEFT JOIN x ON x.book = s.book AND s.a > x.exit_ts), q AS (SELECT p.*, coalesce(x.eq, 10000) AS e1 FROM p ASOF LEFT JOIN x ON x.book = p.book AND p.b > x.exit_ts)", "SELECT book, a AS window_start, round(100 * (e1 / e0 - 1), 4) AS growth FROM q")


@query
def fixed_risk_90d(spark, sf):
    """Best and median 90-day return at a fixed 1 % a trade, by supplier."""
    t = views.trades(spark, sf).withColumn("book", F.concat("book", F.lit("/"), (F.col("supplier") % 50).cast("string"))).where("exit_ts >= timestamp_ntz'1996-01-01 00:00:00'")
    return r6(portfolio.best_and_median(portfolio.rolling_returns(t, "book", datetime(1996, 1, 1), datetime(1998, 1, 1), 0.01), "book"), "best", "median")


text("fixed_risk_90d", TR + ", t AS (SELECT book || '/' || (supplier % 50) AS book, exit_ts, r FROM trades WHERE exit_ts >= TIMESTAMP '1996-01-01'), s AS (SELECT DISTINCT book, TIMESTAMP '1996-01-01' + to_days(CAST(15 * k AS INTEGER)) AS a FROM t, range(0, 100) u(k) WHERE TIMESTAMP '1996-01-01' + to_days(CAST(15 * k AS INTEGER)) + INTERVAL '90 days' <= TIMESTAMP '1998-01-01'), w AS (SELECT s.book, a, coalesce(100 * (product(1 + r * 0.01) - 1), 0.0) AS ret FROM s LEFT JOIN t ON t.book = s.book AND exit_ts >= a AND exit_ts < a + INTERVAL '90 days' GROUP BY 1, 2)", "SELECT book, count(*) AS windows, round(max(ret), 6) AS best, round(list_sort(list(ret))[count(*) // 2 + 1], 6) AS median FROM w GROUP BY 1")

RISKS = (0.0002, 0.0005, 0.001, 0.002)


@query
def portfolio_check(spark, sf):
    """Every book's training, later and whole period at four risks, and the largest
    that fits the drawdown budget."""
    return portfolio.check_risks(views.trades(spark, sf).select("book", "exit_ts", "seq", "r"), ["book"], list(RISKS), datetime(1996, 1, 1), datetime(1996, 1, 1), 3.0, 1.0)


text("portfolio_check", TR + f", x AS (SELECT book, exit_ts, seq, part, risk, r * risk * 10000.0::DOUBLE AS pnl FROM trades, (VALUES ('train'), ('validate'), ('full')) p(part), (VALUES {', '.join(f'({v}::DOUBLE)' for v in RISKS)}) k(risk) WHERE part = 'full' OR (part = 'train') = (exit_ts < TIMESTAMP '1996-01-01'))," + curve("book, part, risk", "x") + f", m AS (SELECT book, part, risk, count(*) AS trades, round({PF}, 2) AS pf, round(greatest(0.0, max(dd_pct)), 2) AS max_dd_pct, round(sum(pnl), 2) AS net FROM curve GROUP BY 1, 2, 3), b AS (SELECT book, max(risk) AS best FROM m WHERE part = 'full' AND max_dd_pct < 3 GROUP BY 1), v AS (SELECT book, risk, pf AS vpf FROM m WHERE part = 'validate')", "SELECT m.book, part, m.risk, trades, pf, max_dd_pct, net, coalesce(m.risk = best, false) AS chosen, coalesce(m.risk = best AND vpf >= 1, false) AS passed FROM m LEFT JOIN b USING (book) LEFT JOIN v ON v.book = m.book AND v.risk = m.risk")


@query
def trades_with_specs(spark, sf):
    """Trades beside their instrument and their session's worst spreads."""
    worst = costs.session_worst(_cube(spark, sf).where("session <> 'rollover'"))
    t = views.trades(spark, sf).select("seq", F.element_at(F.array(*[F.lit(s["symbol"]) for s in SPECS]), (F.col("supplier") % 5 + 1).cast("int")).alias("symbol"), F.when(F.col("supplier") % 2 == 0, "london").otherwise("asia").alias("session"))
    got = portfolio.with_specs(t, dimensions.instruments(spark, SPECS).select("symbol", "contract_size"), worst)
    return r6(got.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("trades"), F.sum(F.col("contract_size").cast("double")).alias("contracts"), F.max("entry_pips").alias("entry_pips")), "contracts", "entry_pips")


text("trades_with_specs", CUBE + ", b AS (SELECT symbol, session, max(entry_pips) AS e FROM cube WHERE session <> 'rollover' GROUP BY 1, 2), s(symbol, contract, k) AS (VALUES ('click', 100, 0), ('view', 1000, 1), ('purchase', 100, 2), ('error', 10, 3), ('signup', 100, 4)), t AS (SELECT s.symbol, contract, CASE WHEN l_suppkey % 2 = 0 THEN 'london' ELSE 'asia' END AS session FROM lineitem JOIN s ON s.k = l_suppkey % 5)", "SELECT t.symbol, t.session, count(*) AS trades, CAST(sum(contract) AS DOUBLE) AS contracts, round(max(e), 6) AS entry_pips FROM t LEFT JOIN b ON b.symbol = t.symbol AND b.session = t.session GROUP BY 1, 2")


@query
def realised_today(spark, sf):
    return r6(portfolio.realised_today(views.trades(spark, sf), ["book"]).select("book", "seq", "realised"), "realised")


text("realised_today", TR, "SELECT book, seq, round(sum(pnl) OVER (PARTITION BY book, CAST(exit_ts AS DATE) ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING), 6) AS realised FROM trades")


@query
def lots_overshoot(spark, sf):
    """Lots of a risk budget; the least lot where it overshoots by 30 % at most."""
    c = views.table(spark, sf, "customer")
    lots = rules.lots_with_overshoot(F.col("c_acctbal") / 100, 5 + F.col("c_custkey") % 40, F.lit(10.0), F.lit(0.01), F.lit(0.1), F.lit(1.5))
    return r6(c.select("c_custkey", lots.alias("lots")), "lots")


text("lots_overshoot", "", "SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN NULL WHEN least(floor(c_acctbal / 100 / ((5 + c_custkey % 40) * 10.0::DOUBLE) / 0.01::DOUBLE) * 0.01::DOUBLE, 1.5) >= 0.1 THEN least(floor(c_acctbal / 100 / ((5 + c_custkey % 40) * 10.0::DOUBLE) / 0.01::DOUBLE) * 0.01::DOUBLE, 1.5) WHEN 0.1::DOUBLE * ((5 + c_custkey % 40) * 10.0::DOUBLE) <= 1.3::DOUBLE * (c_acctbal / 100) THEN 0.1 END, 6) AS lots FROM customer")


@query
def ambiguity_share(spark, sf):
    """Positions whose exit quote meets both levels: stop and target nearly meet."""
    q = views.quotes(spark, sf)
    p = q.select(F.col("seq").alias("id"), "symbol", "ts", F.lit("buy").alias("side"), (F.col("bid") + 5).alias("stop"), (F.col("bid") + 4).alias("target"))
    return r6(portfolio.ambiguity_share(ticks.first_touch(p, q, timedelta(hours=12)).where("exit_ts IS NOT NULL")), "share_pct")


text("ambiguity_share", Q + ", t AS (SELECT p.seq AS id, q.ts, q.seq, q.bid <= p.bid + 5 AS s, q.bid >= p.bid + 4 AS g FROM quotes p JOIN quotes q ON q.symbol = p.symbol AND q.ts > p.ts AND q.ts <= p.ts + INTERVAL '12 hours'), o AS (SELECT * FROM t WHERE s OR g QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, seq) = 1)", "SELECT count(*) AS trades, round(100 * count(*) FILTER (WHERE s AND g) / greatest(count(*), 1), 6) AS share_pct FROM o")


@query
def books_selected(spark, sf):
    """Books by parameter set, every tenth entered a second time under another name."""
    t = views.trades(spark, sf).withColumn("params", F.col("supplier") % 40).select("book", "params", "exit_ts", "seq", "pnl", "r")
    twice = t.unionByName(t.where("params % 10 = 0").withColumn("params", F.col("params") + 1000))
    return portfolio.select_books(twice, ["book", "params"], 0.9, 50.0).select("book", "params", "trades", "profit_factor", "val_dd")


text("books_selected", TR + ", t0 AS (SELECT book, supplier % 40 AS params, exit_ts, seq, pnl, r FROM trades), t AS (SELECT * FROM t0 UNION ALL SELECT book, params + 1000, exit_ts, seq, pnl, r FROM t0 WHERE params % 10 = 0)," + curve("book, params", "t") + f", m AS (SELECT book, params, count(*) AS trades, round({PF}, 3) AS profit_factor, round(sum(pnl), 2) AS net, round(greatest(0.0, max(dd_pct)), 2) AS dd, list_sort(list({{'a': exit_ts, 'p': round(r, 6)}})) AS stream FROM curve GROUP BY 1, 2)", "SELECT book, params, trades, profit_factor, greatest(dd, 0.5) AS val_dd FROM m WHERE profit_factor >= 0.9 AND dd < 50 AND trades >= 15 QUALIFY row_number() OVER (PARTITION BY stream ORDER BY profit_factor DESC, book || '|' || params) = 1")


@query
def vertical_slice(spark, sf):
    """Quotes to trades of the toy strategy, summed by symbol."""
    t = jobs.vertical_slice(views.quotes(spark, sf), "4h", views.THRESHOLD_MS, views.PIP, 1000, 1500, 20, timedelta(minutes=1), timedelta(hours=30))
    return r6(t.groupBy("symbol").agg(F.count(F.lit(1)).alias("signals"), F.count("exit_ts").alias("exits"), F.count_if(F.col("exit_reason") == "closed_tp").alias("targets"), F.sum("pnl_pips").alias("pips")), "pips")


text("vertical_slice", QB + "," + TREND + f", x AS (SELECT *, bid_close / lag(bid_close) OVER ({WA}) - 1 AS ret FROM tr), s AS (SELECT symbol, available_at AS ts, ask_close - 10.0 AS stop, ask_close + 15.0 AS target FROM x WHERE st > 0.5 AND ret < 0), f AS (SELECT s.*, s.ts + INTERVAL '1 minute' AS arrival, q.ask AS fill FROM (SELECT *, ts + INTERVAL '1 minute' AS arr FROM s) s ASOF JOIN quotes q ON q.symbol = s.symbol AND s.arr <= q.ts), h AS (SELECT f.*, q.ts AS xts, q.seq, q.bid, q.bid <= f.stop AS sl FROM f JOIN quotes q ON q.symbol = f.symbol AND q.ts > f.arrival AND q.ts <= f.arrival + INTERVAL '30 hours' AND (q.bid <= f.stop OR q.bid >= f.target)), e AS (SELECT symbol, ts, xts, CASE WHEN sl THEN bid ELSE target END AS px, sl FROM h QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY xts, seq) = 1)", "SELECT f.symbol, count(*) AS signals, count(xts) AS exits, count(*) FILTER (WHERE NOT sl) AS targets, round(sum((px - fill) / 0.01::DOUBLE), 6) AS pips FROM f LEFT JOIN e ON e.symbol = f.symbol AND e.ts = f.ts GROUP BY 1")


@query
def cost_gate_job(spark, sf):
    """The gate as a job: a record on disk, read again, and the verdict."""
    out = f"{_place(spark, 'gate')}/gate_1.json"
    verdict = jobs.cost_gate(views.quotes(spark, sf), out, ["4h", "1d"], views.PIP, 0.6, 50.0, 0.004, window=100, q=0.95, max_gap_ms=GAP, threshold_ms=24 * 3_600_000)
    cells = tables.gate_cells(spark, out).groupBy("symbol").agg(F.count(F.lit(1)).alias("stored"))
    return r6(verdict.join(cells, "symbol"), "best_c")


text("cost_gate_job", CUBE + ", g AS (SELECT symbol, count(*) AS cells, count(*) FILTER (WHERE cost_level <> 'global_bound' AND c < 0.004) AS passing, count(*) FILTER (WHERE cost_level = 'global_bound') AS bound_cells FROM cube GROUP BY 1), b AS (SELECT symbol, c, session, timeframe FROM cube QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c, session, timeframe) = 1)", "SELECT g.symbol, cells, passing, bound_cells, round(c, 6) AS best_c, session AS best_session, timeframe AS best_timeframe, passing > 0 AND bound_cells = 0 AS accepted, cells AS stored FROM g JOIN b USING (symbol)")


# ------------------------------------------------------------ statistics


@query
def hurdles(spark, sf):
    """Expected maxima, the empirical hurdle over the ledger and the modelled one."""
    o = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("selection_criterion"), F.col("o_orderstatus").alias("fill_mode"), F.lit("v").alias("feature_version"), (F.col("o_totalprice") / 100_000).alias("sr_periodic"))
    own = ledger.hurdle(o, "5-LOW", "F")
    rows = [(n, stats.expected_maximum(n), stats.hurdle_modelled(0.6, 0.8, n), own if n == 1 else None) for n in (1, 2, 10, 100, 500)]
    return r6(spark.createDataFrame(rows, "trials long, expected_max double, modelled double, empirical double"), "expected_max", "modelled", "empirical")


# The cdf by the trapezoid rule with its end correction, then Simpson's rule.
MAXIMA = "g AS (SELECT i, -9 + i * 0.001::DOUBLE AS x, exp(-0.5 * power(-9 + i * 0.001::DOUBLE, 2)) / sqrt(2 * pi()) AS f FROM range(18001) t(i)), c AS (SELECT *, sum(CASE WHEN i = 0 THEN 0 ELSE (f + pf) / 2 * 0.001::DOUBLE END) OVER (ORDER BY i) - power(0.001::DOUBLE, 2) / 12 * (-x * f - 9 * exp(-40.5) / sqrt(2 * pi())) AS p FROM (SELECT *, lag(f) OVER (ORDER BY i) AS pf FROM g)), e AS (SELECT n, sum(CASE WHEN i IN (0, 18000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * n * x * f * power(p, n - 1)) * 0.001::DOUBLE / 3 AS m FROM c, {n} GROUP BY n)"
text("hurdles", MAXIMA.format(n="(VALUES (1), (2), (10), (100), (500)) v(n)") + ", k AS (SELECT count(*) AS n, stddev_samp(o_totalprice / 100000) AS s FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'), " + MAXIMA.format(n="(SELECT n FROM k) v").replace("g AS (", "g2 AS (").replace("FROM g)", "FROM g2)").replace(", c AS (", ", c2 AS (").replace("FROM c, ", "FROM c2, ").replace(", e AS (", ", e2 AS ("),
    "SELECT CAST(e.n AS BIGINT) AS trials, round(CASE WHEN e.n = 1 THEN 0 ELSE e.m END, 6) + 0 AS expected_max, round(CASE WHEN e.n = 1 THEN 0 ELSE 0.6 * sqrt(0.2::DOUBLE) * e.m END, 6) + 0 AS modelled, CASE WHEN e.n = 1 THEN round(k.s * e2.m, 6) END AS empirical FROM e, k, e2")

# The distribution function by the series of the incomplete gamma function.
PHI = "(1 + sign({z}) * exp(-power(least(abs({z}), 8.4), 2) / 2) * list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(greatest(least(abs({z}), 8.4), 1e-300) / sqrt(2)) - lgamma(n + 1.5::DOUBLE))))) / 2"
text(
    "deflated_sharpe",
    SH + ", k2 AS (SELECT count(*) AS n, stddev_samp(sr) AS s FROM z), " + MAXIMA.format(n="(SELECT n FROM k2) v") + ", y AS (SELECT candidate, (sr - k2.s * e.m) / CASE WHEN isnan(se) THEN NULL ELSE se END AS z FROM z, k2, e)",
    f"SELECT candidate, round(z, 6) AS z, round({PHI.format(z='z')}, 6) AS probability, z >= 1.6448536269514722 AS passes FROM y",
)


# ------------------------------------------------------------ replays


def _orders_on_quotes(q, wants, buy, volume):
    d = lambda c: F.round(c, 4).cast("decimal(18,8)")
    return q.select("symbol", "ts", "seq", d(F.col("bid")).alias("bid"), d(F.col("ask")).alias("ask"), F.when(wants, F.when(buy, "buy").otherwise("sell")).alias("side"), d(F.when(buy, F.col("bid") - 20).otherwise(F.col("ask") + 20)).alias("stop"), d(F.when(buy, F.col("ask") + 30).otherwise(F.col("bid") - 30)).alias("target"), volume.cast("decimal(18,8)").alias("volume"))


@query
def tick_replay_counters(spark, sf):
    """Refusals and counters of a replay in which some orders are too small."""
    t = _orders_on_quotes(views.quotes(spark, sf), F.col("seq") % 6 == 0, F.col("seq") % 12 == 0, F.when(F.col("seq") % 30 == 0, F.lit("0.004")).otherwise(F.lit("0.10")))
    return ticks.replay_counters(t, ticks.Venue(contract=Decimal(100), fee_per_lot=Decimal(7)))


def _tick_sql(quotes, wants, small, tail):
    return f"""WITH RECURSIVE {quotes},
q AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS i, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev, CAST(round(bid, 4) AS DECIMAL(18, 8)) AS bid, CAST(round(ask, 4) AS DECIMAL(18, 8)) AS ask, seq % 12 = 0 AS buy, {wants} AS wants, {small} AS small,
  CAST(round(CASE WHEN seq % 12 = 0 THEN bid - 20 ELSE ask + 20 END, 4) AS DECIMAL(18, 8)) AS stop, CAST(round(CASE WHEN seq % 12 = 0 THEN ask + 30 ELSE bid - 30 END, 4) AS DECIMAL(18, 8)) AS target FROM quotes),
st AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, NULL::BOOLEAN AS buy, NULL::DECIMAL(18, 8) AS stop, NULL::DECIMAL(18, 8) AS target, NULL::DECIMAL(18, 8) AS entry, false AS closed, false AS refused, false AS gap, NULL::DOUBLE AS net FROM q WHERE i = 0
  UNION ALL
  SELECT symbol, i, CASE WHEN asks AND NOT small THEN q_buy WHEN NOT out THEN buy END, CASE WHEN asks AND NOT small THEN q_stop WHEN NOT out THEN stop END, CASE WHEN asks AND NOT small THEN q_target WHEN NOT out THEN target END, CASE WHEN asks AND NOT small THEN CASE WHEN q_buy THEN ask ELSE bid END WHEN NOT out THEN entry END,
    out, asks AND small, out AND prev IS NOT NULL AND ((isodow(prev) <= 6 AND date_diff('day', prev, ts) >= 6 - isodow(prev)) OR date_diff('day', prev, ts) >= 13 - isodow(prev)),
    CASE WHEN out THEN CAST(CASE WHEN buy THEN CASE WHEN bid <= stop THEN bid ELSE target END - entry ELSE entry - CASE WHEN ask >= stop THEN ask ELSE target END END AS DOUBLE) * 10 - 0.7 END
  FROM (SELECT *, wants AND (buy IS NULL OR out) AS asks FROM (
    SELECT s.* EXCLUDE (i), q.i, q.ts, q.prev, q.bid, q.ask, q.buy AS q_buy, q.wants, q.small, q.stop AS q_stop, q.target AS q_target, coalesce(CASE WHEN s.buy THEN q.bid <= s.stop OR q.bid >= s.target ELSE q.ask >= s.stop OR q.ask <= s.target END, false) AS out
    FROM st s JOIN q ON q.symbol = s.symbol AND q.i = s.i + 1)))
{tail}"""


ORACLES["tick_replay_counters"] = _tick_sql(Q, "seq % 6 = 0", "seq % 30 = 0", "SELECT symbol, count(*) FILTER (WHERE closed) AS trades, CAST(0 AS BIGINT) AS expired, CAST(0 AS BIGINT) AS position_open, CAST(0 AS BIGINT) AS near_close, count(*) FILTER (WHERE refused) AS below_least, CAST(0 AS BIGINT) AS ambiguous, count(*) FILTER (WHERE gap) AS weekend_exits FROM st GROUP BY 1")


@query
def tick_replay_features(spark, sf):
    """A replay whose decisions read the trend visible at each quote: orders stand only
    where it is up."""
    f = features.trend_regime(views.bars(spark, sf), 20).select("symbol", "available_at", "trend_state")
    q = ticks.with_features(views.quotes(spark, sf), f, ["trend_state"], timedelta(hours=12))
    wants = (F.col("seq") % 3 == 0) & F.coalesce(F.col("trend_state") == "up", F.lit(False))
    got = ticks.replay_table(_orders_on_quotes(q, wants, F.col("seq") % 12 == 0, F.lit("0.10")), ticks.Venue(contract=Decimal(100), fee_per_lot=Decimal(7)))
    return got.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum(F.col("pnl").cast("double")), 4).alias("pnl"))


ORACLES["tick_replay_features"] = _tick_sql(QB.replace("quotes AS (", "quotes0 AS (", 1).replace("FROM quotes)", "FROM quotes0)") + "," + TREND + ", quotes AS (SELECT q.*, CASE WHEN q.ts - tr.available_at <= INTERVAL '12 hours' THEN st > 0.5 END AS up FROM quotes0 q ASOF LEFT JOIN tr ON tr.symbol = q.symbol AND q.ts >= tr.available_at)", "seq % 3 = 0 AND coalesce(up, false)", "false", "SELECT symbol, count(*) AS trades, round(sum(net), 4) AS pnl FROM st WHERE closed GROUP BY 1")
