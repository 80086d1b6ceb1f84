"""Long searches, mergeable digests, recursions by slices, ties and the normal
distribution, each against a brute-force version."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import stats
from tickloom.operators import costs, dedupe, features, levels, portfolio, research, slices, ticks
from tickloom.plans import views

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
ORDER = "id long, symbol string, side string, kind string, level double, stop double, target double, ts timestamp_ntz, seq long, good_till timestamp_ntz"


def walk(r, n, symbols=("a", "b"), tie=0.2):
    """Random walks; some quotes share an instant."""
    out, seq = [], 0
    for s in symbols:
        p, at = 100.0, T0
        for _ in range(n):
            at += timedelta(seconds=0 if r.random() < tie else int(r.integers(1, 5000)))
            p = round(p + float(r.normal(0, 1)), 2)
            out.append((s, at, seq, p, round(p + 0.1 * float(r.integers(1, 4)), 2)))
            seq += 1
    return out


def quotes(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, bid double, ask double")


def follow(order, rows):
    """(status, entry_ts, entry_price, exit_ts, exit_price, reason) of one order, quote by quote."""
    i, symbol, side, kind, level, stop, target, ts, seq, till = order
    own = [q for q in rows if q[0] == symbol]
    buy, held = side == "buy", None
    for _, at, n, bid, ask in own:
        later = at > ts or (seq is not None and at == ts and n > seq)
        if held is None:
            if not later:
                continue
            if till is not None and at > till:
                return ("expired", None, None, None, None, None)
            x = ask if buy else bid
            if level is None or not ((x <= level) if buy == (kind == "limit") else (x >= level)):
                continue
            held = (at, level if kind == "limit" else x + (0.02 if buy else -0.02))
        x = bid if buy else ask
        sl = stop is not None and (x <= stop if buy else x >= stop)
        tp = target is not None and (x >= target if buy else x <= target)
        if sl or tp:
            return ("filled", *held, at, x + (-0.05 if buy else 0.05) if sl else target, "closed_sl" if sl else "closed_tp")
    return ("filled", *held, None, None, None) if held else ("resting",) + (None,) * 5


def test_resting_orders_quote_by_quote(spark):
    r = np.random.default_rng(4)
    rows = walk(r, 150)
    orders = []
    for i in range(120):
        s, at, seq, bid, ask = rows[int(r.integers(len(rows)))]
        side, kind = ("buy", "sell")[int(r.integers(2))], ("limit", "stop")[int(r.integers(2))]
        level = round(bid + float(r.normal(0, 3)), 2)
        way = 1 if side == "buy" else -1
        orders.append((i, s, side, kind, level, level - way * 2.0, None if i % 4 == 0 else level + way * 3.0, at, seq if i % 3 else None, at + timedelta(hours=int(r.integers(0, 60))) if i % 2 else None))
    orders += [(900, "a", "buy", "limit", None, 1.0, None, T0, None, None), (901, "nobody", "buy", "limit", 500.0, 1.0, None, T0, None, None), (902, "a", "buy", "limit", 500.0, None, None, T0 - timedelta(days=1), None, None)]
    got = {x["id"]: (x["status"], x["entry_ts"], x["entry_price"], x["exit_ts"], x["exit_price"], x["exit_reason"]) for x in levels.resting_orders(spark.createDataFrame(orders, ORDER), quotes(spark, rows), 0.02, 0.05).collect()}
    for o in orders:
        want = follow(o, rows)
        assert got[o[0]][:2] == want[:2] and got[o[0]][3] == want[3] and got[o[0]][5] == want[5], (o, got[o[0]], want)
        for k in (2, 4):
            assert got[o[0]][k] == (None if want[k] is None else pytest.approx(want[k]))
    assert {g[0] for g in got.values()} == {"filled", "expired", "resting"} and {g[5] for g in got.values()} >= {"closed_sl", "closed_tp"}


def test_resting_orders_of_nothing(spark):
    empty = quotes(spark, [])
    o = spark.createDataFrame([(1, "a", "buy", "limit", 1.0, 0.5, None, T0, None, None)], ORDER)
    assert [x["status"] for x in levels.resting_orders(o, empty).collect()] == ["resting"]
    assert levels.resting_orders(o.where("id < 0"), quotes(spark, walk(np.random.default_rng(1), 5))).collect() == []


def test_long_touch_equals_short_touch(spark):
    q = views.quotes(spark, SF)
    p = q.select(F.col("seq").alias("id"), "symbol", F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"), "ts", F.when(F.col("seq") % 2 == 0, F.col("bid") - 30).otherwise(F.col("ask") + 30).alias("stop"), F.when(F.col("seq") % 2 == 0, F.col("ask") + 30).otherwise(F.col("bid") - 30).alias("target"))
    cols = ["id", "exit_ts", "exit_price", "exit_reason", "ambiguous"]
    a = sorted(map(tuple, ticks.first_touch(p, q, timedelta(hours=30)).select(*cols).collect()))
    b = sorted(map(tuple, levels.long_touch(p, q, F.expr("interval 30 hours")).select(*cols).collect()))
    assert a == b and sum(x[1] is not None for x in a) > 100


@pytest.mark.parametrize("horizon", [None, timedelta(hours=40)])
def test_touch_neither_broadcasts_quotes_nor_multiplies_rows(spark, horizon):
    """Quotes and their nodes never go through the driver, whatever the size of their files,
    and positions are not written out for the bars of their horizon; quotes share instants."""
    q = quotes(spark, walk(np.random.default_rng(9), 400, tie=0.8))
    buy = F.col("seq") % 2 == 0
    p = q.select(F.col("seq").alias("id"), "symbol", F.when(buy, "buy").otherwise("sell").alias("side"), "ts", F.when(buy, F.col("bid") - 4).otherwise(F.col("ask") + 4).alias("stop"), F.when(buy, F.col("bid") + 5).otherwise(F.col("ask") - 5).alias("target"))
    done = levels.long_touch(p, q) if horizon is None else ticks.first_touch(p, q, horizon)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Generate explode" not in plan
    rows = q.collect()
    got = {r["id"]: (r["exit_ts"], r["exit_price"], r["exit_reason"]) for r in done.collect()}
    for x in p.collect():
        want = (None, None, None)
        for r in rows:
            if r["symbol"] == x["symbol"] and r["ts"] > x["ts"] and (horizon is None or r["ts"] <= x["ts"] + horizon):
                y = r["bid"] if x["side"] == "buy" else r["ask"]
                sl, tp = (y <= x["stop"], y >= x["target"]) if x["side"] == "buy" else (y >= x["stop"], y <= x["target"])
                if sl or tp:
                    want = (r["ts"], y if sl else x["target"], "closed_sl" if sl else "closed_tp")
                    break
        assert got[x["id"]] == want


@pytest.mark.parametrize("top", [1, 2, 4])
def test_cover_is_exact_and_small(spark, top):
    r = np.random.default_rng(top)
    spans = [(int(a), int(a + n)) for a, n in zip(r.integers(0, 5000, 300), r.integers(0, 3000, 300))]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", levels.cover("a", "b", top).alias("n")).collect()
    for x in got:
        every = sorted(p for n in x["n"] for p in range(n["block"] * levels.FAN ** n["level"], (n["block"] + 1) * levels.FAN ** n["level"]))
        assert every == list(range(x["a"], x["b"]))
        assert sum(n["level"] < top for n in x["n"]) <= 2 * levels.FAN * top


# ---------------------------------------------------------------- digests


def test_digests_merge_in_any_grouping_and_see_order(spark):
    rows = [("x", T0 + timedelta(hours=7 * i), i, float(i % 5)) for i in range(60)] + [("y", T0 + timedelta(hours=7 * i), i, float(i % 5)) for i in range(60)]
    rows += [("z", T0 + timedelta(hours=7 * i), i, float((i + (i == 20) - (i == 21)) % 5)) for i in range(60)]
    t = spark.createDataFrame(rows, "book string, ts timestamp_ntz, seq long, v double")
    text = lambda at: {r["book"]: r["s"] for r in dedupe.merge_digests(dedupe.stream_digest(t, ["book"], ["ts", "seq"], [F.col("v")], at), ["book"]).select("book", dedupe.digest_text().alias("s")).collect()}
    day, week, one = text(slices.day("ts")), text(F.floor(slices.day("ts") / 7)), text(F.lit(0))
    assert day == week == one and day["x"] == day["y"] != day["z"]
    # Stored parts: two halves digested apart make the whole.
    a, b = t.where("seq < 25"), t.where("seq >= 25")
    half = lambda df, n: dedupe.stream_digest(df, ["book"], ["ts", "seq"], [F.col("v")], F.lit(n))
    both = {r["book"]: r["s"] for r in dedupe.merge_digests(half(a, 1).unionByName(half(b, 2)), ["book"]).select("book", dedupe.digest_text().alias("s")).collect()}
    assert both == day


def test_digest_by_its_formula(spark):
    t = spark.createDataFrame([("x", T0, i, i * i) for i in range(700)], "book string, ts timestamp_ntz, seq long, v long")
    h = [r[0] for r in t.orderBy("seq").select(F.xxhash64("v")).collect()]
    lanes = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "i int, h long").select("i", *[F.pmod(F.xxhash64(F.lit(k), F.col("h")), F.lit(dedupe._PRIME)).alias(f"l{k}") for k in range(4)]).orderBy("i").collect()
    want = [sum(r[f"l{k}"] * pow(base, r["i"], dedupe._PRIME) for r in lanes) % dedupe._PRIME for k, base in enumerate(dedupe._BASES)]
    got = dedupe.merge_digests(dedupe.stream_digest(t, ["book"], ["ts", "seq"], [F.col("v")], slices.block("seq", 100)), ["book"]).first()
    assert [got[f"v{k}"] for k in range(4)] == want and got["n"] == 700


def test_fingerprint_needs_no_lists(spark):
    t = spark.createDataFrame([(1, T0, 1.5), (2, T0, 1.5)], "book long, entry_ts timestamp_ntz, exit_price double")
    plan = dedupe.fingerprint(t)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "partial_sum" in plan


# ---------------------------------------------------------------- recursions and windows


@pytest.mark.parametrize("n", [2, 14])
def test_wilder_means_across_slices(spark, n):
    r = np.random.default_rng(n)
    rows = [(s, T0 + timedelta(minutes=i), float(x)) for s, m in (("a", 2600), ("b", n), ("c", 1)) for i, x in enumerate(100 + np.cumsum(r.normal(0, 1, m)))]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    df = features.wilder_rsi(t, n)
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()
    got = {(x["symbol"], x["ts"]): x["rsi"] for x in df.collect()}
    for s in "abc":
        c = [x for x in rows if x[0] == s]
        up = [max(b[2] - a[2], 0.0) for a, b in zip(c, c[1:])]
        dn = [max(a[2] - b[2], 0.0) for a, b in zip(c, c[1:])]
        for i, x in enumerate(c):
            if i < n:
                assert got[s, x[1]] is None
                continue
            g, l = (sum(up[:n]) / n, sum(dn[:n]) / n) if i == n else ((g * (n - 1) + up[i - 1]) / n, (l * (n - 1) + dn[i - 1]) / n)  # noqa: E741, F821
            assert got[s, x[1]] == pytest.approx(100.0 if l <= 0 else 100 - 100 / (1 + g / l), rel=1e-12)


def test_wilder_of_a_market_that_only_rises(spark):
    t = spark.createDataFrame([("a", T0 + timedelta(minutes=i), float(i)) for i in range(40)], "symbol string, ts timestamp_ntz, close double")
    got = [x["rsi"] for x in features.wilder_rsi(t).orderBy("ts").collect()]
    assert got[:14] == [None] * 14 and got[14:] == [100.0] * 26


@pytest.mark.parametrize("how", ["nearest", "linear", "lower", "higher", "midpoint"])
def test_quintiles_equal_pandas(spark, how):
    import pandas as pd

    r = np.random.default_rng(9)
    x = np.round(r.normal(5, 2, 400) * 4) / 4  # with ties, and means that are exact
    t = spark.createDataFrame([("a", T0 + timedelta(minutes=i), None if i < 3 else float(v)) for i, v in enumerate(x)], "symbol string, available_at timestamp_ntz, atr double")
    df = features.vol_quintile(t, 4, 52, how)
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()
    got = [y["vol_regime_quintile"] for y in df.orderBy("available_at").collect()]
    a = pd.Series(x).where(pd.Series(range(400)) >= 3)
    a = a.rolling(4).mean()
    q = [a.rolling(52).quantile(p, interpolation=how) for p in (0.2, 0.4, 0.6, 0.8)]
    want = [None if pd.isna(v) or pd.isna(q[3][i]) else 1 + sum(v > z[i] for z in q) for i, v in enumerate(a)]
    assert got == want and set(got) == {None, 1, 2, 3, 4, 5}


def test_expanding_fit_by_days(spark):
    r = np.random.default_rng(2)
    rows = [("a", T0 + timedelta(hours=int(h)), float(x)) for h, x in zip(sorted(r.integers(0, 200, 300)), r.normal(0, 1, 300))] + [("b", T0, None), ("b", T0, 2.0)]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    end = T0 + timedelta(hours=120)
    for y in research.expanding_fit(t, "ts", "x", end).collect():
        seen = [v for s, at, v in rows if s == y["symbol"] and at <= y["ts"] and at <= end and v is not None]
        assert y["observations"] == len(seen) and y["fitted"] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def test_autocorrelation_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(slices, "ROWS", 32)
    r = np.random.default_rng(3)
    x = r.normal(0, 1, 500)
    x[1:] += 0.4 * x[:-1]
    t = spark.createDataFrame([("c", T0 + timedelta(hours=i), i, float(v)) for i, v in enumerate(x)] + [("few", T0, i, 1.0) for i in range(7)], "candidate string, ts timestamp_ntz, seq long, r double")
    got = stats.autocorrelation_error(t, ["candidate"], ["ts", "seq"]).collect()
    assert len(got) == 1
    d, lags = x - x.mean(), stats.default_lags(500)
    want = sum((d[k:] * d[:-k]).sum() for k in range(1, lags + 1)) / (d * d).sum()
    assert got[0]["n_lags"] == lags and got[0]["autocorr_sum"] == pytest.approx(want) and got[0]["se"] == pytest.approx(math.sqrt((1 + 2 * want) / 500))


# ---------------------------------------------------------------- ties


@pytest.mark.parametrize("down", [False, True])
def test_ranks_inside_ties(spark, down):
    r = np.random.default_rng(5)
    rows = [("a", float(v), i) for i, v in enumerate(np.where(r.random(3000) < 0.9, 1.0, np.round(r.normal(1, 0.02, 3000), 3)))] + [("a", None, 9000), ("b", 1.0, 1)]
    t = spark.createDataFrame(rows, "symbol string, pips double, seq long")
    got = slices.ranked(t, ["symbol"], "pips", "seq", 0.01, down, most=64)
    at = {(x["symbol"], x["seq"]): (x["_pos"], x["_n"]) for x in got.collect()}
    own = sorted((x for x in rows if x[0] == "a"), key=lambda x: (x[1] is not None, x[1] or 0, x[2]), reverse=down)
    if down:
        assert own[-1][1] is None
    assert [at["a", x[2]] for x in own] == [(i, 3001) for i in range(3001)] and at["b", 1] == (0, 1)


def test_one_constant_spread_is_many_slices(spark):
    t = spark.range(5000).select(F.lit("a").alias("symbol"), F.lit("asia").alias("session"), F.lit(1.0).alias("pips"), F.col("id").alias("seq"))
    got = slices.ranked(t, ["symbol", "session"], "pips", "seq", 0.01, True, most=500).withColumn("p", F.spark_partition_id())
    assert got.select("p").distinct().count() > 1
    few = costs.stressed_quarter(t)
    assert few.count() == 1250 and few.agg(F.min("seq")).first()[0] == 3750


# ---------------------------------------------------------------- distribution


def test_normal_distribution_as_columns(spark):
    x = [float(v) for v in np.linspace(-9, 9, 2001)] + [0.0, 40.0, -40.0]
    t = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").select("x", stats.cdf(F.col("x")).alias("p"), stats.erf(F.col("x")).alias("e"), stats.pdf(F.col("x")).alias("d"))
    for r in t.collect():
        if r["x"] is None:
            assert r["p"] is None and r["e"] is None
            continue
        assert abs(r["p"] - stats.normal_cdf(r["x"])) < 1e-12 and abs(r["e"] - math.erf(r["x"])) < 1e-12 and r["d"] == pytest.approx(float(stats.normal_pdf(r["x"])), rel=1e-12)


def test_decision_equals_the_scalar(spark):
    t = spark.createDataFrame([(0.3, 0.1, 0.05), (0.1, 0.1, 0.05), (0.2, 0.1, None)], "sr double, h double, se double")
    p, ok = stats.decision(F.col("sr"), F.col("h"), F.col("se"), "iid")
    got = t.select(p.alias("p"), ok.alias("ok")).collect()
    for r, (sr, h, se) in zip(got[:2], ((0.3, 0.1, 0.05), (0.1, 0.1, 0.05))):
        want = stats.deflated_decision(sr, h, se, "iid")
        assert r["p"] == pytest.approx(want[0], abs=1e-12) and r["ok"] == want[1]
    assert got[2]["p"] is None
    with pytest.raises(ValueError):
        stats.decision(F.col("sr"), F.col("h"), F.col("se"), "")


# ---------------------------------------------------------------- selections


def test_configurations_by_hand(spark):
    r = np.random.default_rng(6)
    books = [("a", "trailing", 2.0), ("b", "static", 4.0), ("c", "static", 0.1)]
    rows = [(b, T0 + timedelta(hours=int(h)), i * 10 + k, float(x)) for k, (b, _, _) in enumerate(books) for i, (h, x) in enumerate(zip(sorted(r.integers(0, 24 * 300, 80)), r.normal(0.1, 1, 80)))]
    t = spark.createDataFrame(rows, "book string, exit_ts timestamp_ntz, seq long, r double")
    d = spark.createDataFrame(books, "book string, kind string, val_dd double")
    configs = [("all", F.lit(True), True), ("equal", F.lit(True), False), ("static", F.col("kind") == "static", True), ("none fits", F.col("kind") == "trailing", True)]
    got = {x["config"]: x for x in portfolio.configurations(t, d, configs, [0.5, 2.0, 60.0], T0, 0.01, 25.0).collect()}

    def one(names, weighted, scale):
        dds = {b: max(v, 0.5) for b, _, v in books if b in names}
        med = sorted(dds.values())[len(dds) // 2]
        eq = peak = 10_000.0
        worst, curve = 0.0, []
        for b, at, _, x in sorted((y for y in rows if y[0] in names), key=lambda y: (y[1], y[2])):
            eq += x * 0.01 * scale * (min(med / dds[b], 2.0) if weighted else 1.0) * eq
            curve.append((at, eq))
            peak = max(peak, eq)
            worst = max(worst, 100 * (peak - eq) / peak)
        at = lambda day: next((e for a, e in reversed(curve) if a < day), 10_000.0)
        rets, day = [], T0
        while day + timedelta(days=90) <= curve[-1][0]:
            rets.append(100 * (at(day + timedelta(days=90)) / at(day) - 1))
            day += timedelta(days=15)
        return worst, eq, sorted(rets)[len(rets) // 2], max(rets)

    for name, (names, weighted) in {"all": ("abc", True), "equal": ("abc", False), "static": ("bc", True), "none fits": ("a", True)}.items():
        best = [(s, *one(names, weighted, s)) for s in (0.5, 2.0, 60.0)]
        best = [b for b in best if b[1] < 25.0]
        if not best:
            assert name not in got
            continue
        s, dd, eq, med, top = best[-1]
        x = got[name]
        assert (x["scale"], x["max_dd_pct"], x["end_equity"], x["median"], x["best"]) == (s, pytest.approx(dd), pytest.approx(eq), pytest.approx(med), pytest.approx(top))
    assert [n for n, x in got.items() if x["chosen"]] == [max(got, key=lambda n: got[n]["median"])]


def test_accounts_are_columns_not_copies_of_trades(spark):
    """Ends of many accounts equal compounded_curve's, also after a total loss and for trades
    an account does not take; no trade is written out for a risk."""
    r = np.random.default_rng(12)
    rows = [(("x", "y")[i % 2], T0 + timedelta(hours=int(h)), i, float(v)) for i, (h, v) in enumerate(zip(r.integers(0, 24 * 40, 300), r.normal(0.05, 1, 300)))]
    t = spark.createDataFrame(rows, "book string, exit_ts timestamp_ntz, seq long, r double")
    risks = {"low": F.lit(0.01), "all": F.lit(0.9), "some": F.when(F.col("seq") % 3 == 0, 0.05), "none": F.lit(None).cast("double")}
    ends = portfolio.compounded_ends(t, ["book"], risks)
    got = {(x["book"], x["name"]): x for x in ends.collect()}
    assert len(got) == 6
    for n in ("low", "all", "some"):
        c = portfolio.compounded_curve(t.where(risks[n].isNotNull()), ["book"], risks[n])
        for x in c.groupBy("book").agg(F.max("dd_pct").alias("dd"), F.max_by("equity", F.struct("exit_ts", "seq")).alias("end"), F.max("exit_ts").alias("last")).collect():
            y = got[x["book"], n]
            assert y["max_dd_pct"] == pytest.approx(x["dd"]) and y["end_equity"] == pytest.approx(x["end"]) and y["last"] == x["last"]
    assert got["x", "all"]["max_dd_pct"] == 100.0
    plan = portfolio.running_many(t.withColumn("k", F.lit(0.1)), {"a": F.col("r") * F.col("k")}, ["book"], ["exit_ts", "seq"], slices.day("exit_ts"))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    at = {(x["name"], x["exit_ts"]): x["equity"] for x in portfolio.compounded_at(t, {"low": F.lit(0.01)}).collect()}
    c = portfolio.compounded_curve(t.withColumn("one", F.lit(1)), ["one"], F.lit(0.01)).groupBy("exit_ts").agg(F.max_by("equity", "seq").alias("e")).collect()
    assert len(at) == len(c) and all(at["low", x["exit_ts"]] == pytest.approx(x["e"]) for x in c)


def test_configurations_that_fit_no_scale(spark):
    t = spark.createDataFrame([("a", T0, 1, -1.0), ("a", T0 + timedelta(days=2), 2, -1.0)], "book string, exit_ts timestamp_ntz, seq long, r double")
    d = spark.createDataFrame([("a", 2.0)], "book string, val_dd double")
    got = portfolio.configurations(t, d, [("all", F.lit(True), True)], [50.0], T0, 0.01, 5.0)
    assert got.collect() == [] and got.columns == ["config", "scale", "max_dd_pct", "end_equity", "best", "median", "chosen"]
