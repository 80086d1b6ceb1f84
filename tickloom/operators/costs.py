"""Trading costs as conditional distributions, and the cost cube over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.sessions import SESSIONS, session_bucket
from tickloom.operators.bars import micros, resample
from tickloom.operators.slices import day, numbered, previous, ranked
from tickloom.session import staged

LEVELS = (("symbol", "session", "volatility", "news", "weekday"), ("symbol", "session", "volatility"), ("symbol", "session"), ("symbol",))
MULTIPLES = (0.5, 1.0, 2.0, 3.0)
LEVEL = 0.01  # pips of a slice where episodes are ranked by spread


def fresh_spreads(ticks: DataFrame, pip: float, max_gap_ms: int = 120_000) -> DataFrame:
    """seq, symbol, ts and pips of every positive spread whose quote follows the
    one before within max_gap_ms."""
    t = previous(ticks, "_before", micros(F.col("ts")), ["symbol"], ["ts", "seq"], day("ts"))
    t = t.withColumn("_gap", micros(F.col("ts")) - F.col("_before")).withColumn("pips", (F.col("ask") - F.col("bid")) / F.lit(pip))
    return t.where((F.col("_gap") <= max_gap_ms * 1000) & (F.col("pips") > 0)).select("seq", "symbol", "ts", "pips")


def entry_episodes(ticks: DataFrame, pip: float, max_gap_ms: int = 120_000) -> DataFrame:
    """Spread samples with their cell key; samples outside all sessions drop."""
    t = fresh_spreads(ticks, pip, max_gap_ms).withColumn("session", session_bucket(F.col("ts")))
    return t.where("session IS NOT NULL").select("symbol", "session", F.lit("normal").alias("volatility"), F.lit(False).alias("news"), F.weekday("ts").alias("weekday"), "seq", "pips")


def stressed_quarter(episodes: DataFrame) -> DataFrame:
    """The widest quarter (at least one) of each symbol's session, ties to the later."""
    t = ranked(episodes, ["symbol", "session"], "pips", "seq", LEVEL, down=True)
    return t.where(F.col("_pos") < F.greatest(F.lit(1), F.floor(F.col("_n") / 4))).drop("_n", "_pos")


def nearest_rank(x: str, q: float):
    """The smallest value whose rank reaches q of the count."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})")


def levelled(episodes: DataFrame) -> DataFrame:
    """Episodes of equal spread of every fallback level as one row: level, the exact key's
    columns (those that the level leaves out hold a constant), pips and their number _c.
    Staged, as quantiles and draws read it several times; a quantile or draw is a place in
    these counts, so episodes are read once and never sorted."""
    exact = episodes.groupBy(*LEVELS[0], "pips").agg(F.count(F.lit(1)).alias("_c"))
    each = F.explode(F.array(*[F.struct(*_at_level(i)) for i in range(len(LEVELS))])).alias("_l")
    return staged(exact.select(each, "pips", "_c").select("_l.*", "pips", "_c").groupBy(*BY, "pips").agg(F.sum("_c").alias("_c")), "levelled")


BY = ["level", *LEVELS[0]]


def _at_level(i: int) -> list[Column]:
    none = {"symbol": "", "session": "", "volatility": "", "news": False, "weekday": -1}
    return [F.lit(i).alias("level"), *[(F.col(k) if k in LEVELS[i] else F.lit(none[k])).alias(k) for k in LEVELS[0]]]


def at_ranks(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """wanted (.., level and key, _r) with pips: the spread in place _r, from 0, of the key's
    episodes in order of spread. Only the slices of spreads that a place falls into are
    looked through."""
    v = values.withColumn("_at", F.floor(F.least("pips", F.lit(1e12)) / LEVEL).cast("long"))
    so_far = lambda by, order: F.sum("_c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slices = v.groupBy(*BY, "_at").agg(F.sum("_c").alias("_c")).withColumn("_to", so_far(BY, "_at")).withColumn("_from", F.col("_to") - F.col("_c")).drop("_c")
    t = wanted.join(slices, BY).where("_r >= _from AND _r < _to").withColumn("_r", F.col("_r") - F.col("_from")).drop("_from", "_to")
    inside = v.join(t.select(*BY, "_at").distinct(), [*BY, "_at"]).withColumn("_to", so_far([*BY, "_at"], "pips")).withColumn("_from", F.col("_to") - F.col("_c")).drop("_c")
    return t.join(inside, [*BY, "_at"]).where("_r >= _from AND _r < _to").drop("_r", "_at", "_from", "_to")


def lookup(cells: DataFrame, episodes: DataFrame, q: float, bound: float, least: int = 8) -> DataFrame:
    """cells (with the exact key's columns) with value, episodes and level of the
    first fallback level that has enough episodes; else the bound.

    Level tables hold one row a key combination, so each join's right side is
    small against the episodes it sums up; Spark checks its size itself.
    """
    return _looked_up(cells, levelled(episodes), q, bound, least)


def _looked_up(cells: DataFrame, values: DataFrame, q: float, bound: float, least: int) -> DataFrame:
    counts = values.groupBy(*BY).agg(F.sum("_c").alias("_n")).where(F.col("_n") >= least)
    # The smallest value whose rank reaches q of the count.
    place = F.greatest(F.ceil(F.lit(float(q)) * F.col("_n")), F.lit(1)) - 1
    levels = staged(at_ranks(counts.withColumn("_r", place), values), "quantiles")
    out = cells
    for i, keys in enumerate(LEVELS):
        side = levels.where(F.col("level") == i).select(*keys, F.col("pips").alias(f"_v{i}"), F.col("_n").alias(f"_n{i}"))
        out = out.join(side, list(keys), "left")
    names = ["+".join(k) for k in LEVELS]
    value = F.coalesce(*[f"_v{i}" for i in range(4)], F.lit(bound))
    level = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), names[i]) for i in range(4)], F.lit("global_bound"))
    n = F.coalesce(*[f"_n{i}" for i in range(4)], F.lit(0))
    return out.select(*cells.columns, value.alias("value"), n.cast("long").alias("episodes"), level.alias("level"))


def add_episodes(episodes: DataFrame, more: DataFrame) -> DataFrame:
    """Episodes with further ones: rows of the cell's key, seq and pips. A spread that
    is not positive, or a key with a null, is refused."""
    keys = list(LEVELS[0])
    good = F.col("pips") > 0
    for k in keys:
        good = good & F.col(k).isNotNull()
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("pips")).otherwise(F.raise_error(F.lit("an episode needs a whole key and a positive spread")).cast("double"))
    return episodes.select(*keys, "seq", "pips").unionByName(more.select(*keys, "seq", checked.alias("pips")))


def draw(cells: DataFrame, episodes: DataFrame, seed: int, draws: int = 1, least: int = 8) -> DataFrame:
    """Seeded draws for each cell, from the first fallback level that has enough
    episodes: the sample whose rank a hash of (seed, key, draw) names, with level and
    episodes as provenance. Cells that no level serves draw nothing."""
    return _drawn(cells, levelled(episodes), seed, draws, least)


def _drawn(cells: DataFrame, values: DataFrame, seed: int, draws: int, least: int) -> DataFrame:
    keys, names = list(LEVELS[0]), ["+".join(k) for k in LEVELS]
    served = _looked_up(cells, values, 0.5, 0.0, least).where("level <> 'global_bound'").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("draw").cast("string"))
    want = served.withColumn("_r", F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.col("episodes"))
    own = F.struct(*[F.col(k) for k in keys], "draw", "level", "episodes").alias("_own")
    at = F.coalesce(*[F.when(F.col("level") == name, F.struct(*_at_level(i))) for i, name in enumerate(names)]).alias("_l")
    return at_ranks(want.select(own, at, "_r").select("_own", "_l.*", "_r"), values).select(*[f"_own.{k}" for k in keys], "_own.draw", "pips", "_own.level", "_own.episodes")


def draw_with_provenance(cells: DataFrame, episodes: DataFrame, seed: int, bound: float, kind: str = "entry", draws: int = 1, least: int = 8) -> DataFrame:
    """draw with its whole provenance: kind, level, episodes and the 95 % quantile of the
    level that served. A cell that no level serves draws the bound, the widest figure
    that is defensible, with no episodes and no quantile. For stop exits give the
    stressed quarter as episodes and kind stop_exit."""
    keys = list(LEVELS[0])
    values = levelled(episodes)
    each = staged(cells.select(*keys).distinct(), "cells")
    top = staged(_looked_up(each, values, 0.95, bound, least), "levels")
    got = _drawn(each, values, seed, draws, least).join(top.where("level <> 'global_bound'").select(*keys, F.col("value").alias("q95")), keys)
    none = top.where("level = 'global_bound'").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    none = none.select(*keys, "draw", F.lit(float(bound)).alias("pips"), "level", "episodes", F.lit(None).cast("double").alias("q95"))
    return got.unionByName(none).withColumn("kind", F.lit(kind))


def pip_values(specs: DataFrame, ticks: DataFrame, account: str = "USD") -> DataFrame:
    """specs (symbol, pip_size, contract_size, quote_currency) with pip_value in the
    account's currency a lot. A quote in another currency is converted by the last bid
    of the pair account + quote; without that pair it stays null, and what builds on
    it fails closed."""
    last = ticks.groupBy(F.col("symbol").alias("_pair")).agg(F.max_by("bid", F.struct("ts", "seq")).alias("_rate"))
    t = specs.join(last, F.concat(F.lit(account), F.upper("quote_currency")) == F.col("_pair"), "left")
    per_pip = F.col("pip_size") * F.col("contract_size")
    return t.withColumn("pip_value", F.when(F.upper("quote_currency") == account, per_pip).otherwise(per_pip / F.col("_rate"))).drop("_pair", "_rate")


def commission_in_pips(specs: DataFrame, ticks: DataFrame, account: str = "USD") -> DataFrame:
    """specs with commission_pips: the round trip's commission a lot over the pip's
    value. A symbol that has no conversion is an error."""
    value = F.when(F.col("pip_value").isNotNull(), F.col("pip_value")).otherwise(F.raise_error(F.concat(F.lit("no conversion rate for "), F.col("symbol"))).cast("double"))
    return pip_values(specs, ticks, account).withColumn("commission_pips", F.col("commission") / value)


def median_true_range(ticks: DataFrame, timeframe: str, pip: float, window: int, threshold_ms: int = 60_000, least: int = 20, compat: bool = False) -> DataFrame:
    """symbol, bars_used and the upper median, in pips, of the true range of the
    last complete bars. The window shrinks to the bars there are less one; symbols
    with fewer than `least` give nothing. compat measures against the previous
    high, as older records did, instead of the previous close."""
    bars = resample(ticks, timeframe, threshold_ms).where("coverage_ok")
    # The last window + 1 bars of a symbol are all that is read.
    bars = numbered(bars, ["symbol"], [F.col("ts_open")], day("ts_open")).withColumnRenamed("_n", "_all").where(F.col("_pos") >= F.col("_all") - window - 1)
    o = Window.partitionBy("symbol").orderBy("ts_open")
    last = F.lag("bid_high" if compat else "bid_close").over(o)
    tr = F.greatest(F.col("bid_high") - F.col("bid_low"), F.abs(F.col("bid_high") - last), F.abs(F.col("bid_low") - last)) / F.lit(pip)
    w = Window.partitionBy("symbol")
    t = bars.withColumn("tr", tr).withColumn("bars_used", F.least(F.lit(window), F.col("_all") - 1)).where((F.col("bars_used") >= least) & (F.col("_all") - F.col("_pos") <= F.col("bars_used")))
    t = t.withColumn("_rank", F.row_number().over(w.orderBy("tr", "ts_open")))
    return t.where(F.col("_rank") == F.floor(F.col("bars_used") / 2) + 1).select("symbol", F.col("bars_used").cast("long").alias("bars_used"), F.col("tr").alias("median_tr"))


def cost_cube(ticks: DataFrame, timeframes: list[str], pip: float, commission_pips: float, bound: float, window: int = 200, q: float = 0.95, max_gap_ms: int = 120_000, threshold_ms: int = 60_000, weekday: int = 0) -> DataFrame:
    """One cell a symbol, session, timeframe and stop multiple: spreads of entry and
    stop exit at the quantile, plus commission, over the stop."""
    entry = staged(entry_episodes(ticks, pip, max_gap_ms), "episodes")  # five reads follow
    stress = stressed_quarter(entry)
    stops = None
    for tf in timeframes:
        one = median_true_range(ticks, tf, pip, window, threshold_ms).withColumn("tf", F.lit(tf))
        stops = one if stops is None else stops.unionByName(one)
    keyed = stops.withColumn("session", F.explode(F.array(*[F.lit(s) for s in SESSIONS]))).withColumn("multiple", F.explode(F.array(*[F.lit(m) for m in MULTIPLES])))
    keyed = keyed.select("symbol", "session", F.lit("normal").alias("volatility"), F.lit(False).alias("news"), F.lit(weekday).alias("weekday"), F.concat("tf", F.lit("@"), F.format_string("%.1f", "multiple"), F.lit("x")).alias("timeframe"), (F.col("median_tr") * F.col("multiple")).alias("stop_pips"))
    a = lookup(keyed, entry, q, bound).withColumnsRenamed({"value": "entry_pips", "episodes": "entry_episodes", "level": "_l1"})
    b = lookup(a, stress, q, bound).withColumnsRenamed({"value": "exit_pips", "episodes": "exit_episodes", "level": "_l2"})
    exact = "+".join(LEVELS[0])
    pair = F.array_join(F.array_sort(F.array_distinct(F.array("_l1", "_l2"))), "|")
    level = F.when((F.col("_l1") == "global_bound") | (F.col("_l2") == "global_bound"), "global_bound").when((F.col("_l1") == exact) & (F.col("_l2") == exact), "exact").otherwise(F.concat(F.lit("fallback:"), pair))
    round_trip = F.col("entry_pips") + F.col("exit_pips") + commission_pips
    return b.select("symbol", "session", "timeframe", "stop_pips", "entry_pips", "exit_pips", F.lit(commission_pips).alias("commission_pips"), round_trip.alias("round_trip_pips"), (round_trip / F.col("stop_pips")).alias("c"), level.alias("cost_level"), "entry_episodes", "exit_episodes")


def gate_verdict(cells: DataFrame, limit: float = 0.25) -> DataFrame:
    """Per symbol: cells that pass, whether it is accepted, and its best cell."""
    clean = F.col("cost_level") != "global_bound"
    best = F.min_by(F.struct("session", "timeframe"), F.struct("c", "session", "timeframe"))
    t = cells.groupBy("symbol").agg(F.count(F.lit(1)).alias("cells"), F.count_if(clean & (F.col("c") < limit)).alias("passing"), F.count_if(~clean).alias("bound_cells"), F.min("c").alias("best_c"), best.alias("_b"))
    return t.select("symbol", "cells", "passing", "bound_cells", "best_c", F.col("_b.session").alias("best_session"), F.col("_b.timeframe").alias("best_timeframe"), ((F.col("passing") > 0) & (F.col("bound_cells") == 0)).alias("accepted"))


def session_worst(cells: DataFrame) -> DataFrame:
    """Worst entry and exit spread of every session; a session without cells takes
    its symbol's worst."""
    by = cells.groupBy("symbol", "session").agg(F.max("entry_pips").alias("e"), F.max("exit_pips").alias("x"))
    top = by.groupBy("symbol").agg(F.max("e").alias("te"), F.max("x").alias("tx"))
    every = top.withColumn("session", F.explode(F.array(*[F.lit(s) for s in SESSIONS])))
    return every.join(by, ["symbol", "session"], "left").select("symbol", "session", F.coalesce("e", "te").alias("entry_pips"), F.coalesce("x", "tx").alias("exit_pips"))


def sensitivity(trades: DataFrame, by: str = "book") -> DataFrame:
    """Net expectancy (gross - multiple x cost) at 0.75 to 2.0 times the costs, and
    whether a quarter more cost takes more than half of it."""
    m = F.explode(F.array(*[F.lit(x / 4) for x in range(3, 9)]))
    t = trades.groupBy(by).agg(F.avg("gross").alias("g"), F.avg("cost").alias("k"))
    at = lambda x: F.col("g") - x * F.col("k")
    flag = (at(1.0) > 0) & ((at(1.0) - at(1.25)) > at(1.0) / 2)
    return t.withColumn("artefact", flag).withColumn("multiplier", m).select(by, "multiplier", (F.col("g") - F.col("multiplier") * F.col("k")).alias("expectancy"), "artefact")
