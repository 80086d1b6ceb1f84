"""DuckDB texts of the replays: the bar and tick loops as recursive queries.

One recursion step is one bar (or quote) of every run at once; a row is a run's
state after it, with the trade that closed on it, if any. The texts follow the rules
of the survey, not the code of operators.replay.
"""

from __future__ import annotations

import json

from tickloom.operators import research, signals
from tickloom.plans.oracle import C1H, ORACLES, Q, QL, WT, roll

PIP, GAP, LEAST = "0.01::DOUBLE", "(2.0::DOUBLE * 0.01::DOUBLE)", "(5.0::DOUBLE * 0.01::DOUBLE)"
PER_PIP = "(100.0::DOUBLE * 0.01::DOUBLE)"
LINES, MEANS = (24, 48, 60, 96, 240, 336), (20, 50, 100, 200)

BUNDLE = (
    QL + ",\n" + C1H + f""", b0 AS (SELECT *, lag(close) OVER ({WT}) AS pc, row_number() OVER ({WT}) - 1 AS i FROM candles),
b1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, high - low AS rg, CAST(ts AS DATE) AS d, isodow(ts) = 5 AND hour(ts) >= 21 AS late FROM b0),
b2 AS (SELECT *, {roll('avg', 'tr', 14, WT)} AS atr, {", ".join(f"{roll('avg', 'close', n, WT)} AS sma_{n}" for n in MEANS)}, {", ".join(f"{roll('max', 'high', n, WT)} AS hh_{n}, {roll('min', 'low', n, WT)} AS ll_{n}" for n in LINES)},
  {roll('avg', 'rg', 120, WT)} AS rm, {roll('stddev_pop', 'rg', 120, WT)} AS rs FROM b1),
dy AS (SELECT symbol, d, max(high) AS dh, min(low) AS dl FROM b1 GROUP BY 1, 2),
dp AS (SELECT symbol, d, lag(dh) OVER (PARTITION BY symbol ORDER BY d) AS ph, lag(dl) OVER (PARTITION BY symbol ORDER BY d) AS pl FROM dy),
sd AS (SELECT symbol, avg(greatest(close - pc, 0)) AS g, avg(greatest(pc - close, 0)) AS l FROM b0 WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14),
rs AS (SELECT symbol, CAST(14 AS BIGINT) AS i, g, l FROM sd UNION ALL SELECT rs.symbol, b0.i, (rs.g * 13 + greatest(b0.close - b0.pc, 0)) / 14, (rs.l * 13 + greatest(b0.pc - b0.close, 0)) / 14 FROM rs JOIN b0 ON b0.symbol = rs.symbol AND b0.i = rs.i + 1),
b AS (SELECT b2.*, ph, pl, CASE WHEN rs <= 1e-12 THEN 0 ELSE (rg - rm) / rs END AS rz, CASE WHEN r.l > 0 THEN 100 - 100 / (1 + r.g / r.l) WHEN r.l IS NOT NULL THEN 100 END AS rsi,
  {", ".join(f"lag({c}) OVER (PARTITION BY b2.symbol ORDER BY b2.ts) AS p_{c}" for c in ("sma_20", "sma_100", "sma_200", *[f"{x}_{n}" for n in (48, 96, 240, 336) for x in ("hh", "ll")]))}
  FROM b2 LEFT JOIN dp ON dp.symbol = b2.symbol AND dp.d = b2.d LEFT JOIN rs r ON r.symbol = b2.symbol AND r.i = b2.i)"""
)


def num(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def ready_signals(name: str, p: dict) -> str:
    """SELECT of symbol, params, i, side, stop and target of a family without memory."""
    goal = None
    if name == "donchian_breakout":
        n, far = p["channel"], f"{num(p['atr_x'])} * atr"
        known = f"atr > 0 AND p_hh_{n} IS NOT NULL AND p_ll_{n} IS NOT NULL"
        up, down, ls, ss = f"{known} AND close > p_hh_{n}", f"{known} AND close < p_ll_{n}", f"close - {far}", f"close + {far}"
    elif name == "trend_pullback":
        s, far = f"sma_{p['slow']}", f"{num(p['atr_x'])} * atr"
        known = f"atr > 0 AND atr / {PIP} >= {num(p['min_atr_pips'])} AND p_sma_20 IS NOT NULL"
        up = f"{known} AND {s} < sma_20 AND pc < p_{s} AND close > sma_20 AND rsi > {num(p['rsi_min'])}"
        down = f"{known} AND {s} > sma_20 AND pc > p_{s} AND close < sma_20 AND rsi < {num(p['rsi_max'])}"
        ls, ss = f"least(ll_24, close - {far})", f"greatest(hh_24, close + {far})"
    else:
        reach, pad = f"{num(p['dist_atr'])} * atr", f"{num(p['stop_atr'])} * atr"
        known = f"atr > 0 AND rz >= {num(p['range_z'])} AND close BETWEEN pl AND ph"
        up, down = f"{known} AND close < sma_20 AND low <= sma_20 - {reach}", f"{known} AND close > sma_20 AND high >= sma_20 + {reach}"
        ls, ss, goal = f"low - {pad}", f"high + {pad}", "sma_20"
    dl, ds = f"greatest(close - ({ls}), {LEAST})", f"greatest(({ss}) - close, {LEAST})"
    rr = num(p["rr"]) if goal is None else ""
    return f"SELECT symbol, '{json.dumps(p, sort_keys=True)}' AS params, i, CASE WHEN {up} THEN 'long' ELSE 'short' END AS side, CASE WHEN {up} THEN close - {dl} ELSE close + {ds} END AS stop, CASE WHEN {up} THEN {goal or f'close + {rr} * {dl}'} ELSE {goal or f'close - {rr} * {ds}'} END AS target FROM b WHERE coalesce({up}, false) OR coalesce({down}, false)"


# What a machine with memory sees on a free bar: its state after (m1 day, m2, m3
# numbers, m4 side), and the signal.
OPENING = """CASE WHEN NOT ({on}) THEN m1 WHEN m1 IS DISTINCT FROM d AND hour(ts) = 13 AND minute(ts) = 0 THEN d ELSE m1 END AS n1,
  CASE WHEN NOT ({on}) THEN m2 WHEN m1 IS DISTINCT FROM d THEN CASE WHEN hour(ts) = 13 AND minute(ts) = 0 THEN high ELSE m2 END WHEN hour(ts) < 13 + a1 THEN greatest(m2, high) ELSE m2 END AS n2,
  CASE WHEN NOT ({on}) THEN m3 WHEN m1 IS DISTINCT FROM d THEN CASE WHEN hour(ts) = 13 AND minute(ts) = 0 THEN low ELSE m3 END WHEN hour(ts) < 13 + a1 THEN least(m3, low) ELSE m3 END AS n3, m4 AS n4,
  CASE WHEN ({on}) AND m1 = d AND hour(ts) >= 13 + a1 AND hour(ts) < 20 AND m2 > m3 THEN CASE WHEN close > m2 THEN 'long' WHEN close < m3 THEN 'short' END END AS s_side, close - a3 * atr AS s_long, close + a3 * atr AS s_short"""
OPENING_ON = "free AND coalesce(atr > 0, false) AND hour(ts) >= 13 AND hour(ts) < 22"

IMPULSE = """CASE WHEN NOT ({on}) THEN CASE WHEN {off} THEN NULL ELSE m1 END WHEN {armed} THEN CASE WHEN {go} THEN NULL ELSE m1 END WHEN high - low >= a1 * atr THEN d END AS n1,
  CASE WHEN {armed} OR NOT ({on}) THEN m2 WHEN close > open THEN high ELSE low END AS n2, m3 AS n3,
  CASE WHEN {armed} OR NOT ({on}) THEN m4 WHEN close > open THEN 'long' ELSE 'short' END AS n4,
  CASE WHEN ({on}) AND {armed} AND {go} THEN m4 END AS s_side, least(ll_60, close - a3 * atr) AS s_long, greatest(hh_60, close + a3 * atr) AS s_short"""
IMPULSE_PARTS = {"on": "free AND coalesce(atr > 0, false) AND hour(ts) >= 7 AND hour(ts) < a4", "off": "free AND coalesce(atr > 0, false) AND hour(ts) >= a4", "armed": "(m1 IS NOT NULL AND m1 = d)", "go": "((m4 = 'long' AND close > m2) OR (m4 = 'short' AND close < m2))"}


def replay(name: str, strategy: str, params: list[dict], split: str | None = None, part: str = "all", trails: list[dict] | None = None) -> str:
    """CTEs that end in `name`: the trades of every run."""
    stateless = strategy in signals.STATELESS
    rows = []
    for p in params:
        a = (0, 0, 0, 0) if stateless else (p.get("orb_hours", p.get("impulse_atr")), p["rr"], p["atr_x"], p.get("hour_end", 0))
        for t in trails or [None]:
            text = json.dumps(p, sort_keys=True)
            rows.append("('%s', '%s', %s, %s)" % (text, text + (f"|{t}" if t else "").replace("'", "''"), ", ".join(map(num, a)), ", ".join(num(t[k]) if t else "NULL::DOUBLE" for k in ("act_r", "sl_r", "tp_r"))))
    cut = f"count(*) FILTER (WHERE ts < TIMESTAMP '{split}')" if split else "0"
    first, last = {"all": ("0", "count(*)"), "train": ("0", cut), "valid": (cut, "count(*)")}[part]
    held = "CASE WHEN NOT opened AND way IS NULL THEN NULL"
    out = []
    if stateless:
        out.append(f"{name}_sig AS MATERIALIZED ({' UNION ALL '.join(ready_signals(strategy, p) for p in params)})")
        sig, see = f"LEFT JOIN {name}_sig g ON g.symbol = s.symbol AND g.params = s.params AND g.i = b.i", "m1 AS n1, m2 AS n2, m3 AS n3, m4 AS n4, CASE WHEN free THEN g_side END AS s_side, g_stop AS s_stop, g_target AS s_target"
        extra = "g.side AS g_side, g.stop AS g_stop, g.target AS g_target"
    else:
        sig, extra = "", "NULL::VARCHAR AS g_side, NULL::DOUBLE AS g_stop, NULL::DOUBLE AS g_target"
        see = OPENING.format(on=OPENING_ON) if strategy == "opening_range_break" else IMPULSE.format(**IMPULSE_PARTS)
    # A machine's stop is floored like the others'.
    floor_ = "s_stop AS f_stop, s_target AS f_target" if stateless else f"CASE WHEN s_side = 'long' THEN close - greatest(close - s_long, {LEAST}) ELSE close + greatest(-(close - s_short), {LEAST}) END AS f_stop, CASE WHEN s_side = 'long' THEN close + a2 * greatest(close - s_long, {LEAST}) ELSE close - a2 * greatest(-(close - s_short), {LEAST}) END AS f_target"
    runs = f"{name}_runs AS (SELECT symbol, p.*, x.first, x.last FROM (SELECT symbol, {first} AS first, {last} AS last FROM b GROUP BY symbol) x, (VALUES {', '.join(rows)}) p(params, run, a1, a2, a3, a4, act, sl, tp))"
    base = "symbol, params, run, a1, a2, a3, a4, act, sl, tp, last"
    state = f"""{name}_st AS (
  SELECT {base}, first AS i, 10000.0::DOUBLE AS balance, NULL::DATE AS day, 0.0::DOUBLE AS day_pnl, NULL::DATE AS lock_to, NULL::INTEGER AS way, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::TIMESTAMP AS at_ts, 0::BIGINT AS since,
    0.0::DOUBLE AS lots, 0.0::DOUBLE AS fee, 0.0::DOUBLE AS risk, 0.0::DOUBLE AS dist, 0.0::DOUBLE AS best, false AS trailed, NULL::VARCHAR AS w_side, 0.0::DOUBLE AS w_stop, NULL::DOUBLE AS w_target, 0.0::DOUBLE AS w_ref,
    NULL::DATE AS m1, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS m3, NULL::VARCHAR AS m4, NULL::TIMESTAMP AS x_ts, 0.0::DOUBLE AS x_price, NULL::VARCHAR AS x_why, 0.0::DOUBLE AS x_net, 0::BIGINT AS x_held, NULL::INTEGER AS x_way, NULL::TIMESTAMP AS x_at, 0.0::DOUBLE AS x_entry, 0.0::DOUBLE AS x_stop, 0.0::DOUBLE AS x_lots, 0.0::DOUBLE AS x_fee, 0.0::DOUBLE AS x_risk FROM {name}_runs
  UNION ALL
  SELECT {base}, i, balance, day, day_pnl, lock_to, CASE WHEN ended THEN NULL ELSE way END, entry, stop, target, at_ts, since, lots, fee, risk, dist, best, trailed,
    CASE WHEN s_side IS NOT NULL THEN s_side ELSE w_side END, CASE WHEN s_side IS NOT NULL THEN f_stop ELSE w_stop END, CASE WHEN s_side IS NOT NULL THEN f_target ELSE w_target END, CASE WHEN s_side IS NOT NULL THEN close ELSE w_ref END,
    n1, n2, n3, n4, CASE WHEN ended THEN ts END, price, why, net, i - since, way, at_ts, entry, stop, lots, fee, risk
  FROM (SELECT *, {floor_} FROM (SELECT *, {see} FROM (
    SELECT * REPLACE (balance + coalesce(net, 0) AS balance, day_pnl + coalesce(net, 0) AS day_pnl,
        CASE WHEN ended AND day_pnl + net <= -0.05::DOUBLE * (balance + net) THEN d + 1 ELSE lock_to END AS lock_to,
        CASE WHEN way IS NULL OR ended THEN best WHEN way > 0 THEN greatest(best, high) ELSE least(best, low) END AS best),
      (way IS NULL OR ended) AND w_side IS NULL AND NOT locked AND NOT late AND NOT refused AS free
    FROM (SELECT *, CASE WHEN ended THEN way * (price - entry) / {PIP} * {PER_PIP} * lots - fee END AS net FROM (
    SELECT *, coalesce(why IS NOT NULL, false) AS ended, CASE WHEN why LIKE '%sl' THEN stop WHEN why LIKE '%tp' THEN target WHEN why IS NOT NULL THEN close END AS price FROM (
    SELECT *, CASE WHEN way IS NULL THEN NULL WHEN CASE WHEN way > 0 THEN low <= stop ELSE high + {GAP} >= stop END THEN CASE WHEN trailed THEN 'trail_sl' ELSE 'sl' END
      WHEN CASE WHEN way > 0 THEN high >= target ELSE low + {GAP} <= target END THEN CASE WHEN trailed THEN 'trail_tp' ELSE 'tp' END WHEN i - since >= 480 THEN 'timeout' WHEN late THEN 'friday_close' END AS why FROM (
    SELECT * REPLACE (CASE WHEN moved AND way * (t_stop - stop) > 0 THEN t_stop ELSE stop END AS stop, trailed OR (moved AND way * (t_stop - stop) > 0) AS trailed,
      CASE WHEN moved AND (target IS NULL OR way * (t_goal - target) > 0) THEN t_goal ELSE target END AS target) FROM (
    SELECT *, coalesce(act IS NOT NULL AND way IS NOT NULL AND way * (best - entry) >= act * dist, false) AS moved, best - way * sl * dist AS t_stop, best + way * tp * dist AS t_goal FROM (
    SELECT * REPLACE (CASE WHEN opened THEN o_way ELSE way END AS way, CASE WHEN opened THEN o_price ELSE entry END AS entry, CASE WHEN opened THEN w_stop ELSE stop END AS stop, CASE WHEN opened THEN w_target ELSE target END AS target,
      CASE WHEN opened THEN ts ELSE at_ts END AS at_ts, CASE WHEN opened THEN i ELSE since END AS since, CASE WHEN opened THEN o_lots ELSE lots END AS lots, CASE WHEN opened THEN o_lots * 0.1::DOUBLE ELSE fee END AS fee,
      CASE WHEN opened THEN o_lots * (o_dist / {PIP}) * {PER_PIP} ELSE risk END AS risk, CASE WHEN opened THEN o_dist ELSE dist END AS dist, CASE WHEN opened THEN o_price ELSE best END AS best, CASE WHEN opened THEN false ELSE trailed END AS trailed,
      CASE WHEN asked THEN NULL ELSE w_side END AS w_side) FROM (
    SELECT *, asked AND NOT veto AND raw >= 0.01::DOUBLE AS opened, asked AND NOT veto AND raw < 0.01::DOUBLE AS refused, trunc(raw / 0.01::DOUBLE) * 0.01::DOUBLE AS o_lots FROM (
    SELECT *, asked AND (o_dist <= 0 OR meant <= 0 OR 2.0::DOUBLE * {PIP} / meant > 0.25 OR meant / {PIP} < 5) AS veto, balance * 0.01::DOUBLE / (o_dist / {PIP} * {PER_PIP}) AS raw FROM (
    SELECT *, abs(o_price - w_stop) AS o_dist FROM (
    SELECT s.* REPLACE (b.i AS i, b.d AS day, CASE WHEN s.day IS DISTINCT FROM b.d THEN 0 ELSE s.day_pnl END AS day_pnl), b.ts, b.d, b.late, b.open, b.high, b.low, b.close, b.atr, b.hh_60, b.ll_60, {extra},
      coalesce(b.d <= s.lock_to, false) AS locked, s.w_side IS NOT NULL AND s.way IS NULL AND NOT coalesce(b.d <= s.lock_to, false) AS asked, CASE WHEN s.w_side = 'long' THEN 1 ELSE -1 END AS o_way,
      b.open + CASE WHEN s.w_side = 'long' THEN {GAP} ELSE 0.0 END AS o_price, abs(s.w_ref - s.w_stop) AS meant
    FROM {name}_st s JOIN b ON b.symbol = s.symbol AND b.i = s.i + 1 AND b.i < s.last {sig}))))))))))))))"""
    trades = f"""{name} AS (SELECT symbol, '{strategy}' AS strategy, run AS params, CASE WHEN x_way > 0 THEN 'long' ELSE 'short' END AS side, x_at AS entry_ts, x_ts AS exit_ts, x_entry AS entry_price, x_price AS exit_price, x_stop AS stop_price, x_lots AS volume, x_net AS pnl, x_fee AS commission, CASE WHEN x_risk > 0 THEN x_net / x_risk ELSE 0 END AS r, x_why AS exit_reason, x_held AS bars_held FROM {name}_st WHERE x_ts IS NOT NULL
  UNION ALL SELECT symbol, '{strategy}', run, CASE WHEN way > 0 THEN 'long' ELSE 'short' END, at_ts, ts, entry, px, stop, lots, net, fee, CASE WHEN risk > 0 THEN net / risk ELSE 0 END, 'end_of_data', i - since FROM (
    SELECT *, way * (px - entry) / {PIP} * {PER_PIP} * lots - fee AS net FROM (SELECT s.*, b.ts, b.close + CASE WHEN way > 0 THEN 0 ELSE {GAP} END AS px FROM {name}_st s JOIN b ON b.symbol = s.symbol AND b.i = s.i WHERE s.i = s.last - 1 AND way IS NOT NULL)))"""
    return ",\n".join([*out, runs, state, trades])


ROUNDED = "symbol, strategy, params, side, entry_ts, exit_ts, exit_reason, bars_held, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("entry_price", "exit_price", "stop_price", "volume", "pnl", "commission", "r"))


def whole(name: str, ctes: list[str], body: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {BUNDLE},\n" + ",\n".join(ctes) + "\n" + body


TRAIL = {"act_r": 0.5, "sl_r": 0.5, "tp_r": 1.0}
for query, family in (("lab_replay_donchian", "donchian_breakout"), ("lab_replay_momentum", "london_momentum"), ("lab_replay_opening_range", "opening_range_break")):
    whole(query, [replay("t", family, signals.grid(family))], f"SELECT {ROUNDED} FROM t")
whole("lab_replay_trailing", [replay("t", "trailing_momentum", signals.grid("trailing_momentum"), trails=[TRAIL])], f"SELECT {ROUNDED.replace(' params,', chr(32) + 'split_part(params, chr(124), 1) AS params,')} FROM t")


def validated(name: str, families: list[str], k: int, pf: float, dd: float, trails: list[dict] | None) -> None:
    """The k best sets of each symbol and family on the first part, and what they
    make on the second."""
    cut, ctes, sets = "2024-01-20", [], []
    for n, f in enumerate(families):
        for part in ("train", "valid"):
            ctes.append(replay(f"{part}{n}", f, signals.grid(f), cut, part, trails))
        for p in signals.grid(f):
            sets += [f"('{f}', '{json.dumps(p, sort_keys=True)}{(f'|{t}' if t else '').replace(chr(39), chr(39) * 2)}')" for t in trails or [None]]
    factor = "CASE WHEN -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) WHEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) > 0 THEN 99 ELSE 0 END"
    for part in ("train", "valid"):
        ctes.append(f"{part} AS ({' UNION ALL '.join(f'SELECT * FROM {part}{n}' for n in range(len(families)))})")
    ctes += [
        f"sets AS (SELECT symbol, strategy, params FROM (SELECT DISTINCT symbol FROM b), (VALUES {', '.join(sets)}) s(strategy, params))",
        f"score AS (SELECT symbol, strategy, params, round({factor}, 6) AS pf, round(sum(pnl), 6) AS net, count(*) AS trades FROM train GROUP BY 1, 2, 3)",
        f"best AS (SELECT symbol, strategy, params, coalesce(pf, 0) AS train_pf, coalesce(net, 0) AS train_net, coalesce(trades, 0) AS train_trades, row_number() OVER (PARTITION BY symbol, strategy ORDER BY coalesce(pf, 0) DESC, coalesce(net, 0) DESC, params) AS rank FROM sets LEFT JOIN score USING (symbol, strategy, params) QUALIFY rank <= {k})",
        "v0 AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY symbol, strategy, params ORDER BY exit_ts ROWS UNBOUNDED PRECEDING) AS bal FROM valid JOIN best USING (symbol, strategy, params))",
        "v1 AS (SELECT *, greatest(10000.0, max(bal) OVER (PARTITION BY symbol, strategy, params ORDER BY exit_ts ROWS UNBOUNDED PRECEDING)) AS peak FROM v0)",
        f"m AS (SELECT symbol, strategy, params, count(*) AS trades, round(count(*) FILTER (WHERE pnl > 0) / count(*), 4) AS win_rate, round({factor}, 3) AS profit_factor, round(sum(pnl), 2) AS net, round(100 * sum(pnl) / 10000, 2) AS return_pct, round(greatest(0, max(100 * (peak - bal) / peak)), 2) AS max_dd_pct, round(sum(r), 2) AS total_r FROM v1 GROUP BY 1, 2, 3)",
    ]
    cols = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("trades", "win_rate", "profit_factor", "net", "return_pct", "max_dd_pct", "total_r"))
    whole(name, ctes, f"SELECT symbol, strategy, params, CAST(rank AS INTEGER) AS rank, train_pf, train_net, train_trades, {cols}, coalesce(profit_factor, 0) >= {pf} AND coalesce(max_dd_pct, 0) < {dd} AND coalesce(trades, 0) >= 15 AS accepted FROM best LEFT JOIN m USING (symbol, strategy, params)")


validated("grid_optimiser", list(signals.GRIDS), 3, 2, 5, None)
validated("trailing_sweep", ["trailing_momentum"], 6, 1.6, 8, research.trails())

# Quotes: the position's levels first, then the order; a position opened on a quote
# is tested from the next one on.
ORACLES["tick_replay"] = f"""WITH RECURSIVE {Q},
q AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS i, CAST(round(bid, 4) AS DECIMAL(18, 8)) AS bid, CAST(round(ask, 4) AS DECIMAL(18, 8)) AS ask, seq % 12 = 0 AS buy, seq % 6 = 0 AS wants,
  CAST(round(CASE WHEN seq % 12 = 0 THEN bid - 20 ELSE ask + 20 END, 4) AS DECIMAL(18, 8)) AS stop, CAST(round(CASE WHEN seq % 12 = 0 THEN ask + 30 ELSE bid - 30 END, 4) AS DECIMAL(18, 8)) AS target FROM quotes),
st AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS n, NULL::BOOLEAN AS buy, NULL::DECIMAL(18, 8) AS entry, NULL::TIMESTAMP AS at_ts, NULL::DECIMAL(18, 8) AS stop, NULL::DECIMAL(18, 8) AS target, NULL::TIMESTAMP AS x_ts, NULL::DECIMAL(18, 8) AS x_price, NULL::VARCHAR AS x_why, NULL::BOOLEAN AS x_buy, NULL::DECIMAL(18, 8) AS x_entry, NULL::TIMESTAMP AS x_at, NULL::DECIMAL(18, 8) AS x_stop
  FROM q WHERE i = 0
  UNION ALL
  SELECT symbol, i, n + CASE WHEN why IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN opens THEN q_buy WHEN why IS NULL THEN buy END, CASE WHEN opens THEN CASE WHEN q_buy THEN ask ELSE bid END WHEN why IS NULL THEN entry END, CASE WHEN opens THEN ts WHEN why IS NULL THEN at_ts END, CASE WHEN opens THEN q_stop WHEN why IS NULL THEN stop END, CASE WHEN opens THEN q_target WHEN why IS NULL THEN target END,
    CASE WHEN why IS NOT NULL THEN ts END, CASE WHEN why = 'closed_sl' THEN CASE WHEN buy THEN bid ELSE ask END WHEN why = 'closed_tp' THEN target END, why, buy, entry, at_ts, stop
  FROM (SELECT *, wants AND (buy IS NULL OR why IS NOT NULL) AS opens FROM (
    SELECT s.* EXCLUDE (i), q.i, q.ts, q.bid, q.ask, q.buy AS q_buy, q.wants, q.stop AS q_stop, q.target AS q_target,
      CASE WHEN s.buy THEN CASE WHEN q.bid <= s.stop THEN 'closed_sl' WHEN q.bid >= s.target THEN 'closed_tp' END WHEN NOT s.buy THEN CASE WHEN q.ask >= s.stop THEN 'closed_sl' WHEN q.ask <= s.target THEN 'closed_tp' END END AS why
    FROM st s JOIN q ON q.symbol = s.symbol AND q.i = s.i + 1)))
SELECT symbol, n, CASE WHEN x_buy THEN 'buy' ELSE 'sell' END AS side, 0.1::DOUBLE AS volume, CAST(x_entry AS DOUBLE) AS entry_price, x_at AS entry_ts, CAST(x_price AS DOUBLE) AS exit_price, x_ts AS exit_ts, x_why AS exit_reason, round(net, 6) AS pnl, round(net / (abs(CAST(x_entry - x_stop AS DOUBLE)) * 10), 6) AS r_multiple
FROM (SELECT *, CAST(CASE WHEN x_buy THEN x_price - x_entry ELSE x_entry - x_price END AS DOUBLE) * 10 - 0.7 AS net FROM st WHERE x_ts IS NOT NULL)
"""
