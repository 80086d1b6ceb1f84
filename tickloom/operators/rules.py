"""Account rules over marked paths, sizing and reservations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.sessions import reset_anchor
from tickloom.functions.units import round_volume_down


def phase_breaches(path: DataFrame, capital: float | str, daily: float | None = None, maximum: float | None = None, target: float | None = None, zone: str = "Europe/Prague", reset: str = "00:00", ratchet: bool = False, at_floor: bool = False) -> DataFrame:
    """One row for every point of an account that violates a rule or reaches the
    target: account, ts, rule, equity, level.

    The day's baseline is the balance at its first point, with ratchet the highest
    equity since (at that point also the balance). at_floor breaches on reaching
    the floor, else on falling below it. Amounts are absolute.
    """
    cap = F.lit(capital).cast(path.schema["equity"].dataType)
    amount = lambda x: F.lit(x).cast(path.schema["equity"].dataType)
    t = path.withColumn("anchor", reset_anchor(F.col("ts"), zone, reset))
    w = Window.partitionBy("account", "anchor").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("balance").over(w)
    base = F.greatest(F.max("equity").over(w), first) if ratchet else first
    rules = []
    if daily is not None:
        floor_ = base - amount(daily)
        hit = F.col("equity") <= floor_ if at_floor else F.col("equity") < floor_
        rules.append(F.when(hit, F.struct(F.lit("maximum_daily_loss").alias("rule"), floor_.alias("level"))))
    if maximum is not None:
        rules.append(F.when(F.col("equity") < cap - amount(maximum), F.struct(F.lit("maximum_loss").alias("rule"), (cap - amount(maximum)).alias("level"))))
    if target is not None:
        rules.append(F.when(F.col("equity") >= cap + amount(target), F.struct(F.lit("profit_target").alias("rule"), (cap + amount(target)).alias("level"))))
    t = t.withColumn("_hits", F.array_compact(F.array(*rules)))
    return t.select("account", "seq", "ts", "equity", F.inline("_hits"))


def size_positions(orders: DataFrame, per_trade: str = "0.005", open_limit: str = "0.02", daily_share: str = "0.60") -> DataFrame:
    """orders with reason, volume, risk_amount and effective_stop.

    Columns read, decimals but for the flags: readable, foreign_positions, equity,
    margin_available, daily_loss, open_risk, reserved_loss, reserved_margin,
    stop_distance, gap_95, daily_limit, value_per_unit, volume_step, volume_min,
    volume_max. Every step can only reduce; a volume below the least is refused.
    """
    dec = lambda x: F.lit(x).cast("decimal(10,4)")
    budget = F.least(F.col("equity") * dec(per_trade), F.col("daily_limit") * dec(daily_share) - F.col("daily_loss"), F.col("equity") * dec(open_limit) - F.col("open_risk") - F.col("reserved_loss"), F.col("margin_available") - F.col("reserved_margin"))
    t = orders.withColumn("_budget", budget.cast("decimal(38,10)")).withColumn("_stop", F.greatest("stop_distance", "gap_95"))
    per_lot = F.col("_stop") * F.col("value_per_unit")
    raw = F.when(F.col("_budget") > 0, (F.col("_budget") / per_lot).cast("decimal(38,10)"))
    t = t.withColumn("_v", round_volume_down(raw, F.col("volume_step")))
    t = t.withColumn("_lots", F.least("_v", "volume_max")).withColumn("_risk", F.col("_stop") * F.least("_v", "volume_max") * F.col("value_per_unit"))
    reason = (
        F.when(~F.col("readable"), "unreadable").when(F.col("foreign_positions"), "foreign positions").when(F.col("_budget") <= 0, "no headroom")
        .when(F.col("_v") < F.col("volume_min"), "below least volume").when(F.col("_risk") > F.col("_budget"), "over budget").otherwise("accepted")
    )
    t = t.withColumn("reason", reason)
    ok = F.col("reason") == "accepted"
    stop = F.when(ok | F.col("reason").isin("below least volume", "over budget"), F.col("_stop"))
    return t.select(*orders.columns, "reason", F.when(ok, F.col("_lots")).alias("volume"), F.when(ok, F.col("_risk")).alias("risk_amount"), stop.alias("effective_stop"))


def lots_with_overshoot(budget: Column, stop_pips: Column, pip_value: Column, step: Column, least: Column, most: Column, overshoot: float = 1.3) -> Column:
    """Lots down to the step and at most `most`; where they fall below the least lot,
    that lot, if its risk stays within `overshoot` times the budget, else null."""
    per_lot = stop_pips * pip_value
    lots = F.least(F.floor(budget / per_lot / step) * step, most)
    return F.when((per_lot <= 0) | per_lot.isNull() | (budget <= 0), None).when(lots >= least, lots).when(least * per_lot <= overshoot * budget, least)


def reserve_greedily(requests: DataFrame, limit: Column, by: str = "account", order: str = "seq", amount: str = "max_loss") -> DataFrame:
    """requests with accepted: in order, a request is taken while it fits into what
    the limit still leaves. A refusal frees nothing and takes nothing, so this is
    no prefix sum. Requests are sorted by (by, order) within partitions and folded in
    Arrow batches, one running amount at a time: an account of any length is read as
    a stream and costs its own rows once.
    """
    names = [*requests.columns, "accepted"]

    def fold(batches):
        key, used = None, 0
        for batch in batches:
            who, want, most = (batch.column(c).to_pylist() for c in (by, amount, "_limit"))
            took = []
            for a, x, top in zip(who, want, most):
                if a != key:
                    key, used = a, 0
                fits = x is not None and top is not None and used + x <= top
                used = used + x if fits else used
                took.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(took, pa.bool_())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", accepted boolean"
    return requests.withColumn("_limit", limit).repartition(by).sortWithinPartitions(by, order).mapInArrow(fold, schema)


def live_reservations(events: DataFrame) -> DataFrame:
    """account, reservations, max_loss and margin after the last event of each key;
    a release removes its key."""
    last = events.groupBy("account", "key").agg(F.max_by(F.struct("kind", "max_loss", "margin"), "seq").alias("e"))
    return last.where("e.kind = 'reserve'").groupBy("account").agg(F.count(F.lit(1)).alias("reservations"), F.sum("e.max_loss").alias("max_loss"), F.sum("e.margin").alias("margin"))


# Permitted order transitions.
EDGES = (
    ("queued", "submitted"), ("submitted", "filled"), ("submitted", "partially_filled"), ("submitted", "rejected"), ("submitted", "requoted"), ("submitted", "unknown"),
    ("partially_filled", "open"), ("partially_filled", "unknown"), ("partially_filled", "rejected"), ("filled", "open"),
    ("open", "closed_sl"), ("open", "closed_tp"), ("open", "closed_manual"), ("requoted", "submitted"),
)


def illegal_transitions(statuses: DataFrame, by: str = "order_id", order: str = "seq") -> DataFrame:
    """Consecutive statuses of an order that no edge permits."""
    w = Window.partitionBy(by).orderBy(order)
    t = statuses.withColumn("previous", F.lag("status").over(w)).where("previous IS NOT NULL")
    edges = statuses.sparkSession.createDataFrame(list(EDGES), "previous string, status string")
    return t.join(F.broadcast(edges), ["previous", "status"], "left_anti").select(by, order, "previous", "status")


def allowed(accounts: DataFrame, register: DataFrame) -> DataFrame:
    """Accounts that match a register entry in all five identity fields."""
    return accounts.join(register, ["login_hash", "server", "account_type", "currency", "phase"], "left_semi")
