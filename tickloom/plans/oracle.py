"""DuckDB texts of the registered queries, one for each that SQL can express.

A text is a list of views from PRELUDE, then its own statement.
"""

from __future__ import annotations

T4H = "INTERVAL '4 hours'"

PRELUDE = {
    "quotes": """quotes AS (SELECT event_id AS seq, ts, event_type AS symbol, value AS bid, value + CAST(0.01 AS DOUBLE) * (1 + event_id % 7) AS ask,
  CAST(1 + user_id % 10 AS DOUBLE) AS bid_volume FROM events)""",
    "lagged": """lagged AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev FROM quotes)""",
    "bars": "",
    "trades": """trades AS (SELECT l_returnflag || l_linestatus AS book, l_shipdate AS exit_ts, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_suppkey AS supplier,
  round((l_discount - l_tax) * 10 * l_quantity / 100, 6) AS pnl, round((l_discount - l_tax) * 10, 6) AS r, l_extendedprice AS gross, l_extendedprice * l_tax AS cost FROM lineitem)""",
    "path": """path AS (SELECT o_custkey AS account, o_orderkey AS seq, o_orderdate AS ts,
  (10000000 + sum(CAST(round(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * 10) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) / 100.0 AS equity FROM orders)""",
}


def _bars(step: str, name: str = "bars", threshold: int = 21_600_000) -> str:
    return f"""{name} AS (SELECT symbol, time_bucket({step}, ts) AS ts_open, time_bucket({step}, ts) + {step} AS available_at,
  first(bid ORDER BY ts, seq) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, last(bid ORDER BY ts, seq) AS bid_close,
  first(ask ORDER BY ts, seq) AS ask_open, max(ask) AS ask_high, min(ask) AS ask_low, last(ask ORDER BY ts, seq) AS ask_close,
  sum(bid_volume) AS volume, count(*) AS tick_count, max(coalesce((epoch_us(ts) - epoch_us(prev)) // 1000, 0)) AS max_quote_gap_ms,
  max(coalesce((epoch_us(ts) - epoch_us(prev)) // 1000, 0)) <= {threshold} AS coverage_ok
  FROM lagged GROUP BY ALL)"""


def _candles(step: str, name: str = "candles") -> str:
    return _bars(step, f"{name}_b") + f""", {name} AS (SELECT symbol, ts_open AS ts, (bid_open + ask_open) / 2 AS open,
  greatest((bid_high + ask_high) / 2, (bid_open + ask_open) / 2, (bid_close + ask_close) / 2) AS high,
  least((bid_low + ask_low) / 2, (bid_open + ask_open) / 2, (bid_close + ask_close) / 2) AS low, (bid_close + ask_close) / 2 AS close, volume FROM {name}_b)"""


BARS, C4H, C1H = _bars(T4H), _candles(T4H), _candles("INTERVAL '1 hour'")
Q = PRELUDE["quotes"]
QL = Q + ",\n" + PRELUDE["lagged"]
QB = QL + ",\n" + BARS
OUT = "((ts_open < TIMESTAMP '2024-01-05 11:00:00' AND available_at > TIMESTAMP '2024-01-05 06:00:00') OR (ts_open < TIMESTAMP '2024-01-17 09:30:00' AND available_at > TIMESTAMP '2024-01-17 00:00:00'))"
P = ", ".join(f"round({s}_{n}, 6) AS {s}_{n}" for s in ("bid", "ask") for n in ("open", "high", "low", "close"))
GAP = 21_600_000

ORACLES: dict[str, str] = {}


def text(name: str, views: str, body: str) -> None:
    ORACLES[name] = (f"WITH {views}\n" if views else "") + body


def local(zone: str, ts: str = "ts") -> str:
    return f"timezone('{zone}', timezone('UTC', {ts}))"


def sod(x: str) -> str:
    return f"(hour({x}) * 3600 + minute({x}) * 60 + second({x}))"


def bucket(ts: str = "ts") -> str:
    v, lo, ny, tk = (sod(local(z, ts)) for z in ("Europe/Prague", "Europe/London", "America/New_York", "Asia/Tokyo"))
    lon, new, tok = f"({lo} >= 28800 AND {lo} < 59400)", f"({ny} >= 28800 AND {ny} < 61200)", f"({tk} >= 32400 AND {tk} < 54000)"
    return f"CASE WHEN {v} >= 86100 OR {v} < 300 THEN 'rollover' WHEN {lon} AND {new} THEN 'overlap' WHEN {lon} THEN 'london' WHEN {new} THEN 'new_york' WHEN {tok} THEN 'asia' END"


CAPTURE = f"CASE WHEN {sod('ts')} >= 86100 OR {sod('ts')} < 300 THEN 'rollover' WHEN {sod('ts')} >= 43200 AND {sod('ts')} < 59400 THEN 'overlap' WHEN {sod('ts')} < 25200 THEN 'asia' WHEN {sod('ts')} < 43200 THEN 'london' END"

text("bars_resample", QB, f"SELECT symbol, ts_open, available_at, {P}, volume, tick_count, max_quote_gap_ms, coverage_ok, {OUT} AS known_outage, true AS tick_derived FROM bars")
text("stream_resample", QB, f"SELECT symbol, ts_open, available_at, {P.replace('round(', '').replace(', 6)', '')}, volume, tick_count FROM bars WHERE available_at <= (SELECT max(ts) - INTERVAL '1 hour' FROM quotes)")
text("bars_usable", QB, f"SELECT symbol, ts_open, tick_count FROM bars WHERE coverage_ok AND NOT {OUT}")
text("candle_agg", QL + "," + C1H, "SELECT symbol, time_bucket(INTERVAL '8 hours', ts) AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close FROM candles GROUP BY symbol, time_bucket(INTERVAL '8 hours', ts)")
HTF = "high AS (SELECT symbol, date_trunc('day', ts_open) AS ts_open, last(bid_close ORDER BY ts_open) AS higher_close, date_trunc('day', ts_open) + INTERVAL '1 day' AS available_at FROM bars GROUP BY symbol, date_trunc('day', ts_open))"
text("higher_timeframe_close", QB + "," + HTF, "SELECT symbol, ts_open, round(higher_close, 6) AS higher_close, available_at FROM high")
text("tick_validation", Q + ", s AS (SELECT CASE WHEN seq % 101 = 0 THEN -bid ELSE bid END AS bid, CASE WHEN seq % 97 = 0 THEN bid - 0.5 ELSE ask END AS ask FROM quotes)", "SELECT 'empty' AS rule, 'reject' AS action, CAST(count(*) = 0 AS BIGINT) AS n FROM s UNION ALL SELECT 'crossed', 'reject', count(*) FILTER (WHERE ask < bid) FROM s UNION ALL SELECT 'non_positive', 'reject', count(*) FILTER (WHERE ask <= 0 OR bid <= 0) FROM s")
BENT = "bent AS (SELECT * REPLACE (CASE WHEN hour(ts_open) = 8 THEN bid_high - 5 ELSE bid_high END AS bid_high) FROM bars)"
BAD = "bid_low > least(bid_open, bid_close) OR bid_high < greatest(bid_open, bid_close) OR ask_low > least(ask_open, ask_close) OR ask_high < greatest(ask_open, ask_close)"
text("bar_ohlc_violations", QB + "," + BENT, f"SELECT symbol, ts_open, round(bid_high, 6) AS bid_high FROM bent WHERE {BAD}")
text("bar_duplicates", QB + ", d AS (SELECT symbol, date_trunc('day', ts_open) AS ts_open, tick_count FROM bars), k AS (SELECT *, count(*) OVER (PARTITION BY symbol, ts_open) AS copies FROM d)", "SELECT * FROM k WHERE copies > 1")
text("weekend_quarantine", QB, "SELECT symbol, ts_open, tick_count FROM bars WHERE isodow(ts_open) >= 6")
SPIKE = "r AS (SELECT *, bid_close / bid_open - 1 AS ret FROM {b}), s AS (SELECT *, CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w END AS sigma FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts_open ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"
text("spike_flags", QB + "," + SPIKE.format(b="bars", n=30), "SELECT symbol, ts_open, round(ret, 6) AS ret, round(sigma, 6) AS sigma FROM s WHERE abs(ret) > 2 * sigma")
SHARE = _bars("INTERVAL '1 hour'") + ", h AS (SELECT CASE WHEN hour(ts_open) < 7 THEN 'asia' WHEN hour(ts_open) < 12 THEN 'london' WHEN hour(ts_open) < 16 THEN 'new_york' ELSE 'other' END AS session, sum(volume) AS volume FROM bars GROUP BY 1), g AS (SELECT session, volume, volume / sum(volume) OVER () AS share FROM h)"
text("session_volume_peaks", QL + "," + SHARE, "SELECT session, volume, round(share, 6) AS share, share > 0.2 AS peak FROM g")
text("missing_session_peaks", QL + "," + SHARE, "SELECT s AS session FROM (VALUES ('asia'), ('london'), ('new_york'), ('sydney')) v(s) WHERE s NOT IN (SELECT session FROM g WHERE share > 0.2)")
text("price_precision", Q, "SELECT seq, symbol, round(ask, 6) AS ask FROM quotes WHERE ask <> round(ask, 1)")
text("bar_validation_report", QB + "," + BENT + "," + SPIKE.format(b="bent", n=100), f"SELECT 'duplicates' AS rule, 'reject' AS action, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM bent GROUP BY symbol, ts_open HAVING count(*) > 1) UNION ALL SELECT 'ohlc', 'reject', count(*) FROM bent WHERE {BAD} UNION ALL SELECT 'weekend', 'quarantine', count(*) FROM bent WHERE isodow(ts_open) >= 6 UNION ALL SELECT 'spike', 'flag', count(*) FROM s WHERE abs(ret) > 15 * sigma")
text("candle_faults", QL + "," + C4H + ", c AS (SELECT * REPLACE (CASE WHEN hour(ts) = 12 THEN low - 1 WHEN hour(ts) = 20 THEN 200000.0 ELSE high END AS high) FROM candles)", "SELECT symbol, ts, CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'range' ELSE 'scale' END AS fault FROM c WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR high <= 0.001 OR high >= 100000")
text("capability_drift", "", "SELECT p_partkey, 'size' AS field, CAST(p_size AS DOUBLE) AS documented, CAST(p_size + 1 AS DOUBLE) AS observed FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'price', round(p_retailprice, 6), round(p_retailprice + 0.5, 6) FROM part WHERE p_partkey % 11 = 0")

DST = "d AS (SELECT event_id AS seq, ts FROM events UNION ALL SELECT event_id + 1000000000, ts + INTERVAL '70 days' FROM events UNION ALL SELECT event_id + 2000000000, ts + INTERVAL '290 days' FROM events)"
text("session_bucket_dst", DST, f"SELECT seq, coalesce({bucket()}, 'unknown') AS session FROM d")
text("session_bucket_utc", Q, "SELECT CASE WHEN hour(ts) >= 22 OR hour(ts) < 1 THEN 'rollover' WHEN hour(ts) < 7 THEN 'asia' WHEN hour(ts) < 12 THEN 'london' WHEN hour(ts) < 13 THEN 'overlap' WHEN hour(ts) < 17 THEN 'new_york' ELSE 'asia' END AS session, count(*) AS n FROM quotes GROUP BY 1")
text("capture_bucket", Q, f"SELECT {CAPTURE} AS bucket, count(*) AS n FROM quotes GROUP BY 1")
text("reset_anchors", DST, "SELECT seq, timezone('UTC', timezone('Europe/Prague', date_trunc('day', timezone('Europe/Prague', timezone('UTC', ts)) - INTERVAL '17 hours 30 minutes') + INTERVAL '17 hours 30 minutes')) AS anchor FROM d")
text("weekend_spans", QL, "SELECT seq, symbol FROM lagged WHERE prev IS NOT NULL AND ((isodow(prev) <= 6 AND date_diff('day', prev, ts) >= 6 - isodow(prev)) OR date_diff('day', prev, ts) >= 13 - isodow(prev))")
text("swap_nights", "", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS night, CAST(CASE WHEN isodow(ts) = 3 AND CAST(ts AS DATE) <> DATE '2024-01-10' THEN 3 ELSE 1 END AS INTEGER) AS nights FROM events")
VISIT = f", b AS (SELECT symbol, seq, ts, {CAPTURE} AS bucket FROM quotes), n AS (SELECT *, lag(bucket) OVER (PARTITION BY symbol ORDER BY ts, seq) AS pb FROM b), v AS (SELECT symbol, bucket, count(*) FILTER (WHERE bucket IS DISTINCT FROM pb) AS visits, count(*) AS ticks FROM n WHERE bucket IS NOT NULL GROUP BY 1, 2)"
text("episode_visits", Q + VISIT, "SELECT * FROM v")
text("episode_report", Q + VISIT, "SELECT m.bucket, CAST(m.minimum AS BIGINT) AS minimum, CAST(coalesce(s.visits, 0) AS BIGINT) AS visits, CASE WHEN coalesce(s.visits, 0) >= m.minimum THEN 'ok' ELSE 'below minimum' END AS status FROM (VALUES ('asia', 60), ('london', 1000), ('overlap', 20), ('rollover', 5), ('sydney', 1)) m(bucket, minimum) LEFT JOIN (SELECT bucket, sum(visits) AS visits FROM v GROUP BY 1) s USING (bucket)")
text("quotes_dedupe_last", Q, "SELECT max(seq) AS seq, symbol, date_trunc('hour', ts) AS ts, CAST(floor(bid / 10) AS BIGINT) AS level FROM quotes GROUP BY 2, 3, 4")
text("missing_hours", Q + ", h AS (SELECT DISTINCT symbol, date_trunc('hour', ts) AS slot FROM quotes), e AS (SELECT symbol, unnest(generate_series(min(slot), max(slot), INTERVAL '1 hour')) AS slot FROM h GROUP BY symbol)", "SELECT * FROM e ANTI JOIN h USING (symbol, slot)")
text("resume_fresh", Q + ", l AS (SELECT symbol, max(ts) AS last FROM quotes WHERE seq % 3 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1)", "SELECT seq, symbol FROM quotes LEFT JOIN l USING (symbol) WHERE last IS NULL OR ts > last")
PF = "CASE WHEN -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) WHEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) > 0 THEN 99.0 ELSE 0.0 END"


def curve(by: str, source: str = "trades", name: str = "curve") -> str:
    return f"""{name}_0 AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY {by} ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING) AS balance FROM {source}),
{name}_1 AS (SELECT *, greatest(10000.0, max(balance) OVER (PARTITION BY {by} ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS peak FROM {name}_0),
{name} AS (SELECT *, 100 * (peak - balance) / peak AS dd_pct FROM {name}_1)"""


TR = PRELUDE["trades"]
METRICS = f"count(*) AS trades, round(count(*) FILTER (WHERE pnl > 0) / count(*), 4) AS win_rate, round({PF}, 3) AS profit_factor, round(sum(pnl), 2) AS net, round(100 * sum(pnl) / 10000, 2) AS return_pct, round(greatest(0.0, max(dd_pct)), 2) AS max_dd_pct, round(sum(r), 2) AS total_r"
PT = TR + ", t AS (SELECT *, supplier % 20 AS params FROM trades)," + curve("book, params", "t")
text("book_best", PT + f", m AS (SELECT book, params, {METRICS} FROM curve GROUP BY 1, 2)", "SELECT book, params, profit_factor, net FROM m QUALIFY row_number() OVER (PARTITION BY book ORDER BY profit_factor DESC, net DESC, params) = 1")
text("book_streams", "t AS (SELECT l_suppkey AS book, l_shipdate AS at_ts, round(l_extendedprice, 6) AS price FROM lineitem), b AS (SELECT * FROM t UNION ALL SELECT book + 1000000000000000, at_ts, price FROM t), s AS (SELECT book, list_sort(list({'a': at_ts, 'p': price})) AS stream FROM b GROUP BY 1)", "SELECT min(book) AS book, count(*) AS copies FROM s GROUP BY stream")
ORD = "o AS (SELECT seq AS id, symbol, ts + INTERVAL '1 minute' AS ts, CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM quotes)"
text("asof_backward_tol", Q + "," + ORD + ", r AS (SELECT symbol, ts, bid FROM quotes)", "SELECT o.id, CASE WHEN o.ts - r.ts <= INTERVAL '2 hours' THEN round(r.bid, 6) END AS bid FROM o ASOF LEFT JOIN r ON o.symbol = r.symbol AND o.ts >= r.ts")
text("asof_forward_first_quote", Q + "," + ORD, "SELECT o.id, round(r.ask, 6) AS ask FROM o ASOF LEFT JOIN quotes r ON o.symbol = r.symbol AND o.ts <= r.ts")
text("asof_higher_timeframe", QB + "," + HTF, "SELECT b.symbol, b.ts_open, CASE WHEN b.available_at - h.available_at <= INTERVAL '26 hours' THEN round(h.higher_close, 6) END AS higher_close FROM bars b ASOF LEFT JOIN high h ON b.symbol = h.symbol AND b.available_at >= h.available_at")
text("equity_before_day", PRELUDE["path"] + ", m AS (SELECT DISTINCT account, date_trunc('month', ts) + INTERVAL '1 month' AS day FROM path), p AS (SELECT account, ts, last(equity ORDER BY seq) AS equity FROM path GROUP BY 1, 2)", "SELECT m.account, m.day, p.equity FROM m ASOF LEFT JOIN p ON m.account = p.account AND m.day > p.ts")
text("outage_overlap", QB, f"SELECT symbol, ts_open FROM bars WHERE {OUT}")
NEWS = "n AS (SELECT k, TIMESTAMP '2024-01-02 08:30:00' + to_days(CAST(2 * k AS INTEGER)) + to_hours(k % 5) AS due, CASE k % 3 WHEN 0 THEN ['click', 'view'] WHEN 1 THEN ['purchase'] ELSE ['error', 'signup', 'click'] END AS names FROM range(12) t(k))"
text("news_window", Q + "," + NEWS, "SELECT seq, symbol FROM quotes WHERE EXISTS (SELECT 1 FROM n WHERE list_contains(names, symbol) AND ts >= due - INTERVAL '3 hours' AND ts <= due + INTERVAL '2 hours' AND ts >= CASE WHEN k % 4 <> 0 THEN due - INTERVAL '1 day' ELSE due + INTERVAL '20 minutes' END)")
text("artefact_guard", Q, "SELECT seq, CAST(CASE WHEN symbol = 'click' AND ts >= TIMESTAMP '2024-01-15' THEN 2 WHEN symbol = 'click' AND ts >= TIMESTAMP '2024-01-05' THEN 1 WHEN symbol = 'view' AND ts >= TIMESTAMP '2024-01-10' THEN 1 END AS INTEGER) AS version, NOT ((symbol = 'click' AND ts >= TIMESTAMP '2024-01-05') OR (symbol = 'view' AND ts >= TIMESTAMP '2024-01-10')) AS refused FROM quotes")


def roll(f: str, x: str, n: int, w: str) -> str:
    fr = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {fr} >= {n} THEN {f}({x}) OVER {fr} END"


WA, WT = "PARTITION BY symbol ORDER BY available_at", "PARTITION BY symbol ORDER BY ts"


def atr(n: int) -> str:
    return f"a0 AS (SELECT *, bid_close / lag(bid_close) OVER ({WA}) - 1 AS ret_1, greatest(bid_high - bid_low, abs(bid_close - lag(bid_close) OVER ({WA}))) AS tr FROM bars), a AS (SELECT *, {roll('avg', 'tr', n, WA)} AS atr FROM a0)"


text("ret_atr", QB + "," + atr(14), "SELECT symbol, available_at, round(ret_1, 6) AS ret_1, round(atr, 6) AS atr FROM a")
text("spread_regime", QB + f", s AS (SELECT *, ask_close - bid_close AS spread FROM bars), m AS (SELECT *, {roll('median', 'spread', 20, WA)} AS md FROM s), r AS (SELECT *, spread / nullif(md, 0) AS ratio FROM m)", "SELECT symbol, available_at, round(md, 6) AS spread_median, round(ratio, 6) AS spread_ratio, CASE WHEN ratio IS NULL THEN NULL WHEN ratio > 1.5 THEN 'elevated' ELSE 'normal' END AS spread_regime FROM r")
QN = ", ".join(f"list_sort(list(m) OVER ({WA} ROWS BETWEEN 21 PRECEDING AND CURRENT ROW))[{k}] AS q{p}" for p, k in ((2, 5), (4, 9), (6, 14), (8, 18)))  # nearest of 22
text("vol_quintile", QB + "," + atr(5) + f", v AS (SELECT *, {roll('avg', 'atr', 4, WA)} AS m FROM a), q AS (SELECT *, count(m) OVER ({WA} ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS n, {QN} FROM v)", "SELECT symbol, available_at, CAST(CASE WHEN n < 22 OR m IS NULL THEN NULL WHEN m <= q2 THEN 1 WHEN m <= q4 THEN 2 WHEN m <= q6 THEN 3 WHEN m <= q8 THEN 4 ELSE 5 END AS BIGINT) AS vol_regime_quintile FROM q")
TREND = f"tr AS (SELECT *, (bid_close - {roll('avg', 'bid_close', 20, WA)}) / nullif({roll('stddev_samp', 'bid_close', 20, WA)}, 0) AS st FROM bars)"
text("trend_regime", QB + "," + TREND, "SELECT symbol, available_at, round(st, 6) AS trend_strength, CASE WHEN st IS NULL THEN NULL WHEN st > 0.5 THEN 'up' WHEN st < -0.5 THEN 'down' ELSE 'none' END AS trend_state FROM tr")
text("rolling_hh_ll", QL + "," + C4H, "SELECT symbol, ts, " + ", ".join(f"round({roll(f, x, n, WT)}, 6) AS {k}_{n}" for n in (6, 24) for f, x, k in (("max", "high", "hh"), ("min", "low", "ll"))) + " FROM candles")
text("moving_averages", QL + "," + C4H, "SELECT symbol, ts, " + ", ".join(f"round({roll('avg', 'close', n, WT)}, 6) AS sma_{n}" for n in (5, 20)) + " FROM candles")
text("true_range", QL + "," + C4H + f", l AS (SELECT *, lag(close) OVER ({WT}) AS pc FROM candles)", "SELECT symbol, ts, round(greatest(high - low, abs(high - pc), abs(low - pc)), 6) AS tr FROM l")
text("rsi_wilder", QL + "," + C4H + f", n AS (SELECT symbol, ts, row_number() OVER ({WT}) - 1 AS i, close - lag(close) OVER ({WT}) AS d FROM candles), s AS (SELECT symbol, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM n WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14), r AS (SELECT symbol, CAST(14 AS BIGINT) AS i, g, l FROM s UNION ALL SELECT r.symbol, n.i, (r.g * 13 + greatest(n.d, 0)) / 14, (r.l * 13 + greatest(-n.d, 0)) / 14 FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)", "SELECT n.symbol, n.ts, round(CASE WHEN r.l > 0 THEN 100 - 100 / (1 + r.g / r.l) WHEN r.l IS NOT NULL THEN 100 END, 6) AS rsi FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i")
ORACLES["rsi_wilder"] = ORACLES["rsi_wilder"].replace("WITH ", "WITH RECURSIVE ", 1)
text("zscore_pop", QL + "," + C4H + f", x AS (SELECT *, high - low AS x FROM candles), z AS (SELECT *, {roll('avg', 'x', 20, WT)} AS m, {roll('stddev_pop', 'x', 20, WT)} AS sd FROM x)", "SELECT symbol, ts, round(CASE WHEN sd <= 1e-12 THEN 0.0 ELSE (x - m) / sd END, 6) AS z FROM z")
text("prev_day_levels", QL + "," + C4H + ", d AS (SELECT symbol, CAST(ts AS DATE) AS day, first(open ORDER BY ts) AS o, max(high) AS h, min(low) AS l FROM candles GROUP BY 1, 2), p AS (SELECT symbol, day, o, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))", "SELECT c.symbol, c.ts, round(o, 6) AS day_open, round(ph, 6) AS prev_day_high, round(pl, 6) AS prev_day_low FROM candles c JOIN p ON p.symbol = c.symbol AND p.day = CAST(c.ts AS DATE)")
text("warm_returns", QL + "," + C4H, f"SELECT symbol, ts, round(coalesce(close / lag(close, 1) OVER ({WT}) - 1, 0.0), 6) AS ret1, round(coalesce(close / lag(close, 5) OVER ({WT}) - 1, 0.0), 6) AS ret5 FROM candles")
text("centred_leak", QB, f"SELECT symbol, available_at, round(avg(bid_close) OVER ({WA} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centred FROM bars")
text("full_rank_leak", QB, "SELECT symbol, available_at, rank() OVER (PARTITION BY symbol ORDER BY bid_close) + (count(*) OVER (PARTITION BY symbol, bid_close) - 1) / 2 AS full_rank FROM bars")
text("truncation_test", QB + ", cuts AS (SELECT * FROM (VALUES (TIMESTAMP '2024-01-10 12:00:00'), (TIMESTAMP '2024-01-20 00:00:00')) t(cutoff)), w0 AS (SELECT c.cutoff, b.* FROM bars b, cuts c), w1 AS (SELECT *, bid_close / lag(bid_close) OVER w - 1 AS ret, greatest(bid_high - bid_low, abs(bid_close - lag(bid_close) OVER w)) AS tr, avg(bid_close) OVER (PARTITION BY cutoff, symbol ORDER BY available_at ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS centred, rank() OVER (PARTITION BY cutoff, symbol ORDER BY bid_close) + (count(*) OVER (PARTITION BY cutoff, symbol, bid_close) - 1) / 2.0 AS fr, CASE WHEN count(*) OVER w20 >= 20 THEN (bid_close - avg(bid_close) OVER w20) / nullif(stddev_samp(bid_close) OVER w20, 0) END AS st FROM w0 WINDOW w AS (PARTITION BY cutoff, symbol ORDER BY available_at), w20 AS (PARTITION BY cutoff, symbol ORDER BY available_at ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), w AS (SELECT *, CASE WHEN count(tr) OVER v >= 14 THEN avg(tr) OVER v END AS atr FROM w1 WINDOW v AS (PARTITION BY cutoff, symbol ORDER BY available_at ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), p0 AS (SELECT c.cutoff, b.* FROM bars b, cuts c WHERE b.available_at <= c.cutoff), p1 AS (SELECT *, bid_close / lag(bid_close) OVER w - 1 AS ret, greatest(bid_high - bid_low, abs(bid_close - lag(bid_close) OVER w)) AS tr, avg(bid_close) OVER (PARTITION BY cutoff, symbol ORDER BY available_at ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS centred, rank() OVER (PARTITION BY cutoff, symbol ORDER BY bid_close) + (count(*) OVER (PARTITION BY cutoff, symbol, bid_close) - 1) / 2.0 AS fr, CASE WHEN count(*) OVER w20 >= 20 THEN (bid_close - avg(bid_close) OVER w20) / nullif(stddev_samp(bid_close) OVER w20, 0) END AS st FROM p0 WINDOW w AS (PARTITION BY cutoff, symbol ORDER BY available_at), w20 AS (PARTITION BY cutoff, symbol ORDER BY available_at ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), p AS (SELECT *, CASE WHEN count(tr) OVER v >= 14 THEN avg(tr) OVER v END AS atr FROM p1 WINDOW v AS (PARTITION BY cutoff, symbol ORDER BY available_at ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), d AS (SELECT w.cutoff, bool_or(abs(w.ret - p.ret) > 1e-12 OR abs(w.atr - p.atr) > 1e-12 OR abs(w.st - p.st) > 1e-12 OR (w.ret IS NULL) <> (p.ret IS NULL) OR (w.atr IS NULL) <> (p.atr IS NULL) OR (w.st IS NULL) <> (p.st IS NULL) OR p.symbol IS NULL) AS h, bool_or(abs(w.centred - p.centred) > 1e-12) AS c, bool_or(abs(w.fr - p.fr) > 1e-12) AS f FROM w LEFT JOIN p ON p.cutoff = w.cutoff AND p.symbol = w.symbol AND p.available_at = w.available_at WHERE w.available_at <= w.cutoff GROUP BY 1)", "SELECT pipeline, strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, coalesce(CASE pipeline WHEN 'honest' THEN h WHEN 'centred' THEN c ELSE f END, false) AS leaks FROM d, (VALUES ('honest'), ('centred'), ('full_rank')) x(pipeline)")

FRESH = f"f AS (SELECT *, (ask - bid) / 0.01::DOUBLE AS pips FROM lagged WHERE epoch_us(ts) - epoch_us(prev) <= {GAP}000 AND (ask - bid) / 0.01::DOUBLE > 0)"
EPI = FRESH + f", e AS (SELECT symbol, {bucket()} AS session, isodow(ts) - 1 AS weekday, seq, pips FROM f WHERE {bucket()} IS NOT NULL)"
STRESS = "w AS (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY pips DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY symbol, session) AS n FROM e), st AS (SELECT symbol, session, weekday, seq, pips FROM w WHERE rn <= greatest(1, n // 4))"
text("fresh_spreads", QL + "," + FRESH, "SELECT seq, symbol, round(pips, 6) AS pips FROM f")
text("spread_nearest_rank", QL + "," + EPI, "SELECT symbol, session, round(quantile_disc(pips, 0.95), 6) AS q95, round(quantile_disc(pips, 0.5), 6) AS q50, count(*) AS episodes FROM e GROUP BY 1, 2")
text("stress_top_quartile", QL + "," + EPI + "," + STRESS, "SELECT symbol, session, count(*) AS n, round(min(pips), 6) AS least, CAST(sum(seq) AS BIGINT) AS seqs FROM st GROUP BY 1, 2")


def levels(source: str, p: str) -> str:
    return f"""{p}0 AS (SELECT symbol, session, weekday, quantile_disc(pips, 0.95) AS v, count(*) AS n FROM {source} GROUP BY 1, 2, 3 HAVING count(*) >= 8),
{p}1 AS (SELECT symbol, session, quantile_disc(pips, 0.95) AS v, count(*) AS n FROM {source} GROUP BY 1, 2 HAVING count(*) >= 8),
{p}3 AS (SELECT symbol, quantile_disc(pips, 0.95) AS v, count(*) AS n FROM {source} GROUP BY 1 HAVING count(*) >= 8)"""


NAMES = ("symbol+session+volatility+news+weekday", "symbol+session+volatility", "symbol")


def level_cols(p: str) -> tuple[str, str, str]:
    v = f"coalesce({p}0.v, {p}1.v, {p}3.v, {{b}})"
    n = f"CAST(coalesce({p}0.n, {p}1.n, {p}3.n, 0) AS BIGINT)"
    s = f"CASE WHEN {p}0.v IS NOT NULL THEN '{NAMES[0]}' WHEN {p}1.v IS NOT NULL THEN '{NAMES[1]}' WHEN {p}3.v IS NOT NULL THEN '{NAMES[2]}' ELSE 'global_bound' END"
    return v, n, s


def level_joins(p: str) -> str:
    return f"LEFT JOIN {p}0 ON {p}0.symbol = c.symbol AND {p}0.session = c.session AND {p}0.weekday = c.weekday LEFT JOIN {p}1 ON {p}1.symbol = c.symbol AND {p}1.session = c.session LEFT JOIN {p}3 ON {p}3.symbol = c.symbol"


V, N, S = level_cols("a")
SESS = "(VALUES ('asia'), ('london'), ('new_york'), ('overlap'), ('rollover'))"
text("spread_fallback", QL + "," + EPI + "," + levels("e", "a") + f", c AS (SELECT s AS symbol, x AS session, 'normal' AS volatility, false AS news, CAST(d AS INTEGER) AS weekday FROM (VALUES ('click'), ('view'), ('nothing')) a(s), {SESS} b(x), (VALUES (0), (5)) w(d))", f"SELECT c.symbol, c.session, c.volatility, c.news, c.weekday, round({V.format(b='40.0')}, 6) AS value, {N} AS episodes, {S} AS level FROM c {level_joins('a')}")


def mtr(step: str, threshold: int, tf: str, name: str) -> str:
    return _bars(step, f"{name}_b", threshold) + f""", {name}_t AS (SELECT symbol, ts_open, greatest(bid_high - bid_low, abs(bid_high - lag(bid_close) OVER (PARTITION BY symbol ORDER BY ts_open)), abs(bid_low - lag(bid_close) OVER (PARTITION BY symbol ORDER BY ts_open))) / 0.01::DOUBLE AS tr FROM {name}_b WHERE coverage_ok),
{name}_n AS (SELECT *, least(100, count(*) OVER (PARTITION BY symbol) - 1) AS used, row_number() OVER (PARTITION BY symbol ORDER BY ts_open DESC) AS back FROM {name}_t),
{name} AS (SELECT symbol, '{tf}' AS tf, used AS bars_used, list_sort(list(tr))[used // 2 + 1] AS median_tr FROM {name}_n WHERE used >= 20 AND back <= used GROUP BY symbol, used)"""


text("median_true_range", QL + "," + mtr(T4H, GAP, "4h", "m"), "SELECT symbol, CAST(bars_used AS BIGINT) AS bars_used, round(median_tr, 6) AS median_tr FROM m")
V2, N2, S2 = level_cols("x")
CUBE = (
    QL + "," + EPI + "," + STRESS + "," + levels("e", "a") + "," + levels("st", "x") + "," + mtr(T4H, 86_400_000, "4h", "m4") + "," + mtr("INTERVAL '1 day'", 86_400_000, "1d", "md")
    + f""", c AS (SELECT t.symbol, s.x AS session, 0 AS weekday, t.tf || '@' || m.k || 'x' AS timeframe, t.median_tr * m.v AS stop_pips FROM (SELECT * FROM m4 UNION ALL SELECT * FROM md) t, {SESS} s(x), (VALUES ('0.5', 0.5::DOUBLE), ('1.0', 1.0), ('2.0', 2.0), ('3.0', 3.0)) m(k, v)),
l AS (SELECT c.symbol, c.session, c.timeframe, c.stop_pips, {V.format(b='50.0')} AS entry_pips, {V2.format(b='50.0')} AS exit_pips, 0.6::DOUBLE AS commission_pips, {N} AS entry_episodes, {N2} AS exit_episodes, {S} AS l1, {S2} AS l2 FROM c {level_joins('a')} {level_joins('x')}),
cube AS (SELECT symbol, session, timeframe, stop_pips, entry_pips, exit_pips, commission_pips, entry_pips + exit_pips + 0.6::DOUBLE AS round_trip_pips, (entry_pips + exit_pips + 0.6::DOUBLE) / stop_pips AS c,
  CASE WHEN l1 = 'global_bound' OR l2 = 'global_bound' THEN 'global_bound' WHEN l1 = '{NAMES[0]}' AND l2 = '{NAMES[0]}' THEN 'exact' WHEN l1 = l2 THEN 'fallback:' || l1 ELSE 'fallback:' || least(l1, l2) || '|' || greatest(l1, l2) END AS cost_level, entry_episodes, exit_episodes FROM l)"""
)
text("cost_cube", CUBE, "SELECT symbol, session, timeframe, round(stop_pips, 6) AS stop_pips, round(entry_pips, 6) AS entry_pips, round(exit_pips, 6) AS exit_pips, commission_pips, round(round_trip_pips, 6) AS round_trip_pips, round(c, 6) AS c, cost_level, entry_episodes, exit_episodes FROM cube")
text("gate_verdict", CUBE + ", g AS (SELECT symbol, count(*) AS cells, count(*) FILTER (WHERE cost_level <> 'global_bound' AND c < 0.004) AS passing, count(*) FILTER (WHERE cost_level = 'global_bound') AS bound_cells FROM cube GROUP BY 1), b AS (SELECT symbol, c, session, timeframe FROM cube QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c, session, timeframe) = 1)", "SELECT g.symbol, cells, passing, bound_cells, round(c, 6) AS best_c, session AS best_session, timeframe AS best_timeframe, passing > 0 AND bound_cells = 0 AS accepted FROM g JOIN b USING (symbol)")
text("session_worst_spreads", CUBE + f", b AS (SELECT symbol, session, max(entry_pips) AS e, max(exit_pips) AS x FROM cube WHERE session <> 'rollover' GROUP BY 1, 2), t AS (SELECT symbol, max(e) AS te, max(x) AS tx FROM b GROUP BY 1)", f"SELECT t.symbol, s.x AS session, round(coalesce(b.e, te), 6) AS entry_pips, round(coalesce(b.x, tx), 6) AS exit_pips FROM t CROSS JOIN {SESS} s(x) LEFT JOIN b ON b.symbol = t.symbol AND b.session = s.x")
text("sensitivity_surface", TR + ", m AS (SELECT book, avg(gross * 0.08) AS g, avg(cost * (1 + supplier % 2)) AS k FROM trades GROUP BY 1)", "SELECT book, x / 4 AS multiplier, round(g - x / 4 * k, 6) AS expectancy, g - k > 0 AND (g - k) - (g - 1.25 * k) > (g - k) / 2 AS artefact FROM m, range(3, 9) t(x)")

BUNDLE = QL + "," + C1H + f""", b0 AS (SELECT *, lag(close) OVER ({WT}) AS pc FROM candles),
b1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, high - low AS rg FROM b0),
b AS (SELECT *, {roll('avg', 'tr', 14, WT)} AS atr, {roll('avg', 'close', 20, WT)} AS sma_20, {roll('avg', 'close', 50, WT)} AS sma_50, {roll('max', 'high', 24, WT)} AS hh_24, {roll('min', 'low', 24, WT)} AS ll_24, {roll('max', 'high', 48, WT)} AS hh_48, {roll('min', 'low', 48, WT)} AS ll_48, {roll('avg', 'rg', 120, WT)} AS rm, {roll('stddev_pop', 'rg', 120, WT)} AS rs FROM b1)"""
FLOOR = "0.05::DOUBLE"


def signal(up: str, down: str, ls: str, ss: str, target: str | None = None, rr: float = 2.0) -> str:
    goal = (target, target) if target else (f"close + {rr} * greatest(close - ({ls}), {FLOOR})", f"close - {rr} * greatest(({ss}) - close, {FLOOR})")
    return f"SELECT symbol, ts, CASE WHEN {up} THEN 'long' ELSE 'short' END AS side, round(CASE WHEN {up} THEN close - greatest(close - ({ls}), {FLOOR}) ELSE close + greatest(({ss}) - close, {FLOOR}) END, 6) AS stop, round(CASE WHEN {up} THEN {goal[0]} ELSE {goal[1]} END, 6) AS target FROM s WHERE ({up}) OR ({down})"


text("signal_donchian", BUNDLE + f", s AS (SELECT *, lag(hh_48) OVER ({WT}) AS t, lag(ll_48) OVER ({WT}) AS f FROM b)", signal("coalesce(atr > 0 AND close > t AND f IS NOT NULL, false)", "coalesce(atr > 0 AND close < f AND t IS NOT NULL, false)", "close - 1.5 * atr", "close + 1.5 * atr"))
DAYS = ", d AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l FROM candles GROUP BY 1, 2), p AS (SELECT symbol, day, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)), s AS (SELECT b.*, ph, pl, CASE WHEN rs <= 1e-12 THEN 0.0 ELSE (rg - rm) / rs END AS rz FROM b JOIN p ON p.symbol = b.symbol AND p.day = CAST(b.ts AS DATE))"
text("signal_mean_revert", BUNDLE + DAYS, signal("coalesce(atr > 0 AND rz >= 1.0 AND close BETWEEN pl AND ph AND close < sma_20 AND low <= sma_20 - 0.5 * atr, false)", "coalesce(atr > 0 AND rz >= 1.0 AND close BETWEEN pl AND ph AND close > sma_20 AND high >= sma_20 + 0.5 * atr, false)", "low - 1.0 * atr", "high + 1.0 * atr", "sma_20"))
RSI = f", n AS (SELECT symbol, ts, row_number() OVER ({WT}) - 1 AS i, close - pc AS d FROM b0), sd AS (SELECT symbol, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM n WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14), r AS (SELECT symbol, CAST(14 AS BIGINT) AS i, g, l FROM sd UNION ALL SELECT r.symbol, n.i, (r.g * 13 + greatest(n.d, 0)) / 14, (r.l * 13 + greatest(-n.d, 0)) / 14 FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1), s AS (SELECT b.*, CASE WHEN r.l > 0 THEN 100 - 100 / (1 + r.g / r.l) WHEN r.l IS NOT NULL THEN 100 END AS rsi, lag(sma_20) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS sp, lag(sma_50) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS bp FROM b JOIN n ON n.symbol = b.symbol AND n.ts = b.ts LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i)"
text("signal_trend_pullback", BUNDLE + RSI, signal("coalesce(atr > 0 AND atr / 0.01::DOUBLE >= 1 AND sp IS NOT NULL AND sma_50 < sma_20 AND pc < bp AND close > sma_20 AND rsi > 48, false)", "coalesce(atr > 0 AND atr / 0.01::DOUBLE >= 1 AND sp IS NOT NULL AND sma_50 > sma_20 AND pc > bp AND close < sma_20 AND rsi < 52, false)", "least(ll_24, close - 1.5 * atr)", "greatest(hh_24, close + 1.5 * atr)"))
ORACLES["signal_trend_pullback"] = ORACLES["signal_trend_pullback"].replace("WITH ", "WITH RECURSIVE ", 1)
B20 = f"({WT} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
text("signal_channel_volume", QL + "," + C1H + f", c AS (SELECT *, count(*) OVER {B20} AS n, max(high) OVER {B20} AS t, min(low) OVER {B20} AS f, avg(volume) OVER {B20} AS v, high - low AS rg FROM candles), g AS (SELECT *, {roll('avg', 'rg', 14, WT)} AS atr FROM c)", "SELECT symbol, ts, CASE WHEN close > t THEN 'long' ELSE 'short' END AS side FROM g WHERE n >= 20 AND atr IS NOT NULL AND (close > t OR close < f) AND volume >= 0.8 * v AND hour(ts) >= 6 AND hour(ts) < 20 QUALIFY row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) = 1")
text("signal_toy", QB + "," + TREND + f", x AS (SELECT *, bid_close / lag(bid_close) OVER ({WA}) - 1 AS ret FROM tr)", "SELECT symbol, available_at, 'buy' AS side, round(ask_close - 0.1, 6) AS stop, round(ask_close + 0.2, 6) AS target FROM x WHERE st > 0.5 AND ret < 0")
text("market_fills", Q + "," + ORD + ", a AS (SELECT o.*, q.bid AS b1, q.ask AS a1 FROM (SELECT *, ts + INTERVAL '30 minutes' AS arrival FROM o) o ASOF LEFT JOIN quotes q ON o.symbol = q.symbol AND o.arrival <= q.ts), z AS (SELECT a.*, q.bid AS b0, q.ask AS a0 FROM a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.ts <= q.ts)", "SELECT id, round(CASE WHEN side = 'buy' THEN a1 + 0.02 ELSE b1 - 0.02 END, 6) AS fill_price, round(CASE WHEN side = 'buy' THEN a1 - a0 ELSE b1 - b0 END, 6) AS latency_move FROM z")
text("first_touch_exit", Q + ", p AS (SELECT seq AS id, symbol, ts, seq % 8 = 0 AS buy, CASE WHEN seq % 8 = 0 THEN ask - 8 ELSE bid + 8 END AS stop, CASE WHEN seq % 8 = 0 THEN ask + 15 ELSE bid - 15 END AS target FROM quotes), t AS (SELECT p.id, q.ts AS exit_ts, q.seq, CASE WHEN buy THEN q.bid ELSE q.ask END AS x, buy, stop, target FROM p JOIN quotes q ON q.symbol = p.symbol AND q.ts > p.ts AND q.ts <= p.ts + INTERVAL '1 day'), h AS (SELECT *, CASE WHEN buy THEN x <= stop ELSE x >= stop END AS s, CASE WHEN buy THEN x >= target ELSE x <= target END AS g FROM t), o AS (SELECT * FROM h WHERE s OR g QUALIFY row_number() OVER (PARTITION BY id ORDER BY exit_ts, seq) = 1)", "SELECT p.id, o.exit_ts, round(CASE WHEN s THEN x ELSE o.target END, 6) AS exit_price, CASE WHEN s THEN 'closed_sl' WHEN g THEN 'closed_tp' END AS exit_reason, s AND g AS ambiguous FROM p LEFT JOIN o USING (id)")

text("risk_sizing", """c AS (SELECT c_custkey, c_custkey % 17 <> 0 AS readable, c_custkey % 13 = 0 AS foreign_, CAST(round(abs(c_acctbal) * 10, 2) AS DECIMAL(18,2)) AS equity, CAST(round(abs(c_acctbal) * 5, 2) AS DECIMAL(18,2)) AS margin, CAST(round(abs(c_acctbal) * 0.5, 2) AS DECIMAL(18,2)) AS dl,
  CAST(0.0010 + (c_custkey % 20) * 0.0002 AS DECIMAL(18,4)) AS sd FROM customer),
b AS (SELECT *, least(equity * 0.005, dl * 0.60 - c_custkey % 50, equity * 0.02 - c_custkey % 90 - c_custkey % 30, margin - c_custkey % 70) AS budget, greatest(sd, 0.0015) AS st FROM c),
v AS (SELECT *, CASE WHEN budget > 0 THEN CAST(CAST(floor(CAST(budget AS DOUBLE) / CAST(st * 100000 AS DOUBLE) * 100 + 1e-9) AS BIGINT) AS DECIMAL(18,2)) / 100 END AS lots FROM b),
w AS (SELECT *, CASE WHEN NOT readable THEN 'unreadable' WHEN foreign_ THEN 'foreign positions' WHEN budget <= 0 THEN 'no headroom' WHEN lots < 0.01 THEN 'below least volume' WHEN CAST(st * 100000 AS DOUBLE) * least(lots, 0.5) > CAST(budget AS DOUBLE) + 1e-9 THEN 'over budget' ELSE 'accepted' END AS reason FROM v)""",
    "SELECT c_custkey, reason, round(CASE WHEN reason = 'accepted' THEN CAST(least(lots, 0.5) AS DOUBLE) END, 6) AS volume, round(CASE WHEN reason = 'accepted' THEN CAST(st * 100000 AS DOUBLE) * least(lots, 0.5) END, 6) AS risk_amount, round(CASE WHEN reason IN ('accepted', 'below least volume', 'over budget') THEN CAST(st AS DOUBLE) END, 6) AS effective_stop FROM w")
text("reservation_greedy", """r AS (SELECT l_suppkey AS account, l_orderkey * 10 + l_linenumber AS seq, floor(l_quantity) AS max_loss, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, floor(l_quantity)) AS i FROM lineitem),
g AS (SELECT account, seq, max_loss, i, max_loss <= 400 AS accepted, CASE WHEN max_loss <= 400 THEN max_loss ELSE 0 END AS used FROM r WHERE i = 1 UNION ALL SELECT r.account, r.seq, r.max_loss, r.i, g.used + r.max_loss <= 400, CASE WHEN g.used + r.max_loss <= 400 THEN g.used + r.max_loss ELSE g.used END FROM g JOIN r ON r.account = g.account AND r.i = g.i + 1)""", "SELECT account, seq, max_loss, accepted FROM g")
ORACLES["reservation_greedy"] = ORACLES["reservation_greedy"].replace("WITH ", "WITH RECURSIVE ", 1)
text("reservations_live", "e AS (SELECT o_custkey AS account, o_orderkey % 3 AS k, CASE WHEN o_orderstatus = 'F' THEN 'release' ELSE 'reserve' END AS kind, o_totalprice AS ml, o_totalprice / 4 AS mg FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey DESC) = 1)", "SELECT account, count(*) AS reservations, round(sum(ml), 6) AS max_loss, round(sum(mg), 6) AS margin FROM e WHERE kind = 'reserve' GROUP BY 1")
text("phase_breaches", PRELUDE["path"] + ", a AS (SELECT *, equity - seq % 500 AS balance, date_trunc('day', timezone('Europe/Prague', timezone('UTC', ts))) AS anchor FROM path), d AS (SELECT *, greatest(max(equity) OVER w, first_value(balance) OVER w) - 40 AS floor_ FROM a WINDOW w AS (PARTITION BY account, anchor ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))", "SELECT account, seq, 'maximum_daily_loss' AS rule, CAST(equity AS DOUBLE) AS equity, CAST(floor_ AS DOUBLE) AS level FROM d WHERE equity < floor_ UNION ALL SELECT account, seq, 'maximum_loss', CAST(equity AS DOUBLE), 40000.0 FROM d WHERE equity < 40000 UNION ALL SELECT account, seq, 'profit_target', CAST(equity AS DOUBLE), 190000.0 FROM d WHERE equity >= 190000")
EDGES = "('queued','submitted'),('submitted','filled'),('submitted','partially_filled'),('submitted','rejected'),('submitted','requoted'),('submitted','unknown'),('partially_filled','open'),('partially_filled','unknown'),('partially_filled','rejected'),('filled','open'),('open','closed_sl'),('open','closed_tp'),('open','closed_manual'),('requoted','submitted')"
text("illegal_transitions", f"s AS (SELECT l_orderkey AS order_id, l_linenumber * 1000000 + l_partkey AS seq, min(['queued', 'submitted', 'filled', 'open', 'closed_tp', 'rejected'][l_suppkey % 6 + 1]) AS status FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS previous FROM s), e(a, b) AS (VALUES {EDGES})", "SELECT order_id, seq, previous, status FROM p WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE a = previous AND b = status)")

CU = TR + "," + curve("book")
text("drawdown_curve", CU, "SELECT book, seq, round(balance, 6) AS balance, round(peak, 6) AS peak, round(dd_pct, 6) AS dd_pct FROM curve")
text("compounded_curve", TR + ", c AS (SELECT book, exit_ts, seq, 10000 * exp(sum(ln(1 + r * 0.001)) OVER (PARTITION BY book ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS equity FROM trades), p AS (SELECT *, greatest(10000.0, max(equity) OVER (PARTITION BY book ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS peak FROM c)", "SELECT book, seq, round(equity, 4) AS equity, round(100 * (peak - equity) / peak, 4) AS dd_pct FROM p")
text("trade_metrics", CU, f"SELECT book, {METRICS} FROM curve GROUP BY 1")
text("merged_equity", TR + ", seg AS (SELECT * FROM trades WHERE exit_ts >= TIMESTAMP '1997-01-01' AND exit_ts < TIMESTAMP '1999-01-01')," + curve("book", "seg"), f"SELECT book, count(*) AS trades, round({PF}, 2) AS pf, round(greatest(0.0, max(dd_pct)), 2) AS max_dd_pct, round(sum(pnl), 2) AS net, round(10000 + sum(pnl), 2) AS end_balance FROM curve GROUP BY 1")
MON = ", mo AS (SELECT book, strftime(exit_ts, '%Y-%m') AS month, sum(pnl) AS pnl, count(*) AS trades FROM trades GROUP BY 1, 2)"
text("monthly_pnl", TR + MON, "SELECT book, month, round(pnl, 6) AS pnl, trades FROM mo")
text("month_summary", TR + MON, "SELECT book, round(min(pnl), 6) AS worst, count(*) FILTER (WHERE pnl > 0) AS positive, count(*) AS months FROM mo GROUP BY 1")
ROLL = TR + ", s AS (SELECT DISTINCT book, TIMESTAMP '1996-01-01' + to_days(CAST(15 * k AS INTEGER)) AS window_start FROM trades, range(0, 200) t(k) WHERE TIMESTAMP '1996-01-01' + to_days(CAST(15 * k AS INTEGER)) + INTERVAL '90 days' <= TIMESTAMP '2000-01-01'), w AS (SELECT s.book, window_start, coalesce(100 * (product(1 + r * 0.001) - 1), 0.0) AS ret FROM s LEFT JOIN trades t ON t.book = s.book AND exit_ts >= window_start AND exit_ts < window_start + INTERVAL '90 days' GROUP BY 1, 2)"
text("rolling_90d", ROLL, "SELECT book, window_start, round(ret, 6) AS ret FROM w")
text("rolling_90d_best_median", ROLL, "SELECT book, count(*) AS windows, round(max(ret), 6) AS best, round(list_sort(list(ret))[count(*) // 2 + 1], 6) AS median FROM w GROUP BY 1")
text("topk_configs", TR + f", c AS (SELECT book, supplier % 20 AS params, round({PF}, 6) AS pf, round(sum(pnl), 6) AS net FROM trades GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY pf DESC, net DESC, params) AS INTEGER) AS rank FROM c)", "SELECT * FROM k WHERE rank <= 3")
text("acceptance_gate", PT + f", m AS (SELECT book, params, {METRICS} FROM curve GROUP BY 1, 2)", "SELECT book, params, profit_factor AS pf, max_dd_pct, trades FROM m WHERE profit_factor >= 1.2 AND max_dd_pct < 5 AND trades >= 15")
text("portfolio_frontier", TR + ", t AS (SELECT * FROM trades)," + curve("book", "t") + ", d AS (SELECT book, greatest(max(dd_pct), 0.5) AS v FROM curve GROUP BY 1), md AS (SELECT list_sort(list(v))[count(*) // 2 + 1] AS m FROM d), w AS (SELECT book, least(m / v, 2.0) AS wt FROM d, md), x AS (SELECT scale, exit_ts, seq, ln(1 + r * 0.005 * scale * wt) AS g FROM t JOIN w USING (book), (VALUES (0.1::DOUBLE), (0.2), (0.4), (0.8)) s(scale)), e AS (SELECT *, 10000 * exp(sum(g) OVER (PARTITION BY scale ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS eq FROM x), p AS (SELECT *, greatest(10000.0, max(eq) OVER (PARTITION BY scale ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS pk FROM e), f AS (SELECT scale, max(100 * (pk - eq) / pk) AS dd, last(eq ORDER BY exit_ts, seq) AS fin FROM p GROUP BY 1)", "SELECT scale, round(dd, 3) AS max_dd_pct, round(log10(fin), 6) AS log10_end, dd < 8 AS inside, coalesce(dd < 8 AND scale = max(CASE WHEN dd < 8 THEN scale END) OVER (), false) AS chosen FROM f")

text("ledger_dispersion", "", "SELECT o_orderpriority AS selection_criterion, o_orderstatus AS fill_mode, count(*) AS trials, round(stddev_samp(o_totalprice / 100000), 6) AS s FROM orders GROUP BY 1, 2 HAVING count(*) >= 2")
text("ledger_comparable", "", "SELECT count(*) AS trials FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AND o_orderkey % 2 = 0")
SH = TR + ", m AS (SELECT supplier, count(*) AS t, avg(r) AS mu, stddev_samp(r) AS sd, stddev_pop(r) AS sp FROM trades GROUP BY 1), k AS (SELECT m.supplier AS candidate, t, CASE WHEN sd <= 1e-9 THEN 0.0 ELSE mu / sd END AS sr, sum(power(r - mu, 3)) / t / power(max(sp), 3) AS skew, sum(power(r - mu, 4)) / t / power(max(sp), 4) AS kurt FROM trades JOIN m USING (supplier) GROUP BY m.supplier, t, mu, sd), z AS (SELECT *, sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (t - 1)) AS se FROM k WHERE t >= 2)"
text("sharpe_se", SH, "SELECT candidate, t, round(sr, 6) AS sr, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(se, 6) AS se FROM z")
text("hac_autocorr", TR + ", d AS (SELECT supplier, exit_ts, seq, r - avg(r) OVER (PARTITION BY supplier) AS d, count(*) OVER (PARTITION BY supplier) AS t, row_number() OVER (PARTITION BY supplier ORDER BY exit_ts, seq) AS i FROM trades), l AS (SELECT *, greatest(1, CAST(floor(4 * power(t / 100, 2.0 / 9)) AS INTEGER)) AS n FROM d WHERE t >= 8), c AS (SELECT a.supplier, sum(a.d * b.d) AS s FROM l a JOIN l b ON a.supplier = b.supplier AND b.i < a.i AND a.i - b.i <= a.n GROUP BY 1), v AS (SELECT supplier, max(t) AS t, max(n) AS n, sum(d * d) AS q FROM l GROUP BY 1)", "SELECT supplier AS candidate, t, n AS n_lags, round(s / q, 6) AS autocorr_sum, round(sqrt((1 + 2 * s / q) / t), 6) AS se FROM v JOIN c USING (supplier) WHERE 1 + 2 * s / q > 0")
ORACLES["chain_verify"] = """WITH RECURSIVE o AS (SELECT o_orderkey AS pos, o_orderkey || '|' || o_custkey || '|' || o_orderpriority AS body, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
c AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, repeat('0', 64) AS prev_hash, repeat('0', 64) AS h UNION ALL SELECT o.i, o.pos, c.h, sha256(o.body || '|' || c.h) FROM c JOIN o ON o.i = c.i + 1),
t AS (SELECT c.i, c.pos, c.prev_hash, CASE WHEN c.pos % 500 = 0 OR c.pos % 800 = 0 THEN 'x' ELSE body END AS body, CASE WHEN c.pos % 500 = 0 THEN sha256('x|' || c.prev_hash) ELSE h END AS record_hash FROM c JOIN o USING (i) WHERE c.i > 0),
l AS (SELECT *, prev_hash = lag(record_hash, 1, repeat('0', 64)) OVER (ORDER BY i) AS link_ok, sha256(body || '|' || prev_hash) = record_hash AS hash_ok FROM t)
SELECT pos, prev_hash, link_ok, hash_ok FROM l WHERE NOT link_ok OR NOT hash_ok"""
text("stream_monitor", Q + ", m AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM quotes)", "SELECT symbol, count(*) AS ticks, count(*) FILTER (WHERE ts < mark) AS gaps, coalesce(max(CASE WHEN ts >= mark THEN (epoch_us(ts) - epoch_us(mark)) // 1000 END), 0) AS max_gap_ms, max(ts) AS last_ts FROM m GROUP BY 1")
text("stale_quotes", "", "SELECT event_type AS symbol, TIMESTAMP '2024-01-31 00:00:00' - max(ts) > INTERVAL '5 hours' AS stale FROM events GROUP BY 1 UNION ALL SELECT 'never', true")
text("capture_coverage", Q, "SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM quotes GROUP BY 1, 2")
text("hour_sequence", "", "SELECT hour FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL '1 hour')) AS hour, max(ts) AS last FROM events) WHERE hour < last")
text("file_paths", Q, "SELECT DISTINCT symbol, date_trunc('hour', ts) AS hour, printf('%s/%04d/%02d/%02d/%02dh_ticks.bi5', symbol, year(ts), month(ts) - 1, day(ts), hour(ts)) AS path FROM quotes")
text("money_rounding", "l AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem)", "SELECT l_orderkey, l_linenumber, sum(CAST((CAST(q * 100 AS BIGINT) // 30) * 30 AS DOUBLE) / 100) AS down, sum(CAST(((CAST(p * 100 AS BIGINT) + 29) // 30) * 30 AS DOUBLE) / 100) AS up, sum(CAST(CASE WHEN CAST(p * 100 AS BIGINT) % 100 = 50 THEN (CAST(p * 100 AS BIGINT) // 100) + (CAST(p * 100 AS BIGINT) // 100) % 2 ELSE (CAST(p * 100 AS BIGINT) + 50) // 100 END AS DOUBLE) / 10) AS even FROM l GROUP BY 1, 2")
text("month_partitions", TR, "SELECT strftime(exit_ts, '%Y-%m') AS month, count(*) AS rows FROM trades GROUP BY 1")
KINDS = "['market_status', 'rule_reset', 'swap_posting', 'quote', 'pending_trigger', 'fill', 'stop_or_target', 'decision', 'submission']"
text("event_order", Q, f"SELECT seq, {KINDS}[seq % 9 + 1] AS kind, CAST(CASE seq % 9 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE seq % 9 + 1 END AS BIGINT) AS priority FROM quotes")
text("artefact_expanding", Q + ", x AS (SELECT seq, symbol, ts, CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN bid END AS b FROM quotes)", "SELECT seq, round(avg(b) OVER w * count(b) OVER w, 2) AS total, count(b) OVER w AS observations FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
text("best_risk", TR + ", t AS (SELECT * FROM trades), k(risk) AS (VALUES (0.0005::DOUBLE), (0.001), (0.002), (0.004), (0.008)), c AS (SELECT book, risk, exit_ts, seq, 10000 * exp(sum(ln(1 + r * risk)) OVER (PARTITION BY book, risk ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS eq FROM t, k), p AS (SELECT *, greatest(10000.0, max(eq) OVER (PARTITION BY book, risk ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS pk FROM c), d AS (SELECT book, risk, max(100 * (pk - eq) / pk) AS dd FROM p GROUP BY 1, 2), s AS (SELECT DISTINCT book, TIMESTAMP '1996-01-01' + to_days(CAST(15 * i AS INTEGER)) AS w FROM t, range(0, 200) u(i) WHERE TIMESTAMP '1996-01-01' + to_days(CAST(15 * i AS INTEGER)) + INTERVAL '90 days' <= TIMESTAMP '2000-01-01'), q AS (SELECT s.book, k.risk, w, coalesce(100 * (product(1 + r * k.risk) - 1), 0.0) AS ret FROM s CROSS JOIN k LEFT JOIN t ON t.book = s.book AND exit_ts >= w AND exit_ts < w + INTERVAL '90 days' GROUP BY 1, 2, 3), m AS (SELECT book, risk, list_sort(list(ret))[count(*) // 2 + 1] AS med FROM q GROUP BY 1, 2)", "SELECT book, risk, round(dd, 6) AS max_dd_pct, round(med, 6) AS median FROM d JOIN m USING (book, risk) WHERE dd < 8 QUALIFY row_number() OVER (PARTITION BY book ORDER BY med DESC, risk) = 1")
text("account_allowed", "", "SELECT c_custkey, sha256(c_name) AS login_hash FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey % 2 = 0")
