"""As-of joins by one union and one window, and interval predicates.

Spark has no AS OF keyword; a union of both sides sorted by time with the last
(or next) right row carried along is one shuffle and one sort. It is taken within
a key's days, and only each day's last (or first) right row passes between days.
Ties: a right row at the left row's own instant is visible.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bars import micros
from tickloom.operators.slices import latest


def _carry(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], columns: list[str], forward: bool, right_first: bool, span: int) -> DataFrame:
    l_cols = left.columns
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in columns])
    l = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))  # noqa: E741
    r = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*l_cols).alias("s")).schema["s"].dataType).alias("_left"), payload.alias("_right"))
    # The side that must be seen first at one instant sorts first.
    first = F.col("_side").asc() if right_first else F.col("_side").desc()
    order = [F.col("_t"), first]
    if forward:
        # Backward in time: frames that end at the partition's end cost its square.
        order = [F.col("_t").desc(), F.col("_side").desc() if right_first else F.col("_side").asc()]
    at = F.floor(F.unix_date(F.to_date("_t")) / span).cast("long")
    return latest(l.unionByName(r), "_seen", "_right", by, order, at, forward).where("_side = 1").select("_left.*", "_seen")


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tolerance: timedelta | None, by: list[str] | None = None, columns: list[str] | None = None, strict: bool = False, unlimited: bool = False, span: int = 1) -> DataFrame:
    """Each left row with the latest right row at or before it (before it, if
    strict), no older than tolerance; older ones give nulls. A missing tolerance
    is refused unless unlimited is stated. span: days of a slice; more of them where
    there are many keys with few rows each."""
    if tolerance is None and not unlimited:
        raise ValueError("an as-of join needs a staleness limit")
    if tolerance is not None and tolerance <= timedelta(0):
        raise ValueError("the staleness limit must be positive")
    by = by if by is not None else ["symbol"]
    columns = columns if columns is not None else [c for c in right.columns if c not in by and c not in left.columns]
    got = _carry(left, right, left_on, right_on, by, columns, False, not strict, span)
    fresh = F.col("_seen").isNotNull()
    if tolerance is not None:
        fresh = fresh & (micros(F.col(left_on)) - micros(F.col("_seen._at")) <= int(tolerance.total_seconds() * 1e6))
    return got.select(*left.columns, *[F.when(fresh, F.col(f"_seen.{c}")).alias(c) for c in columns])


def asof_forward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Each left row with the first right row at or after it."""
    by = by if by is not None else ["symbol"]
    columns = columns if columns is not None else [c for c in right.columns if c not in by and c not in left.columns]
    got = _carry(left, right, left_on, right_on, by, columns, True, False, 1)
    return got.select(*left.columns, *[F.col(f"_seen.{c}").alias(c) for c in columns])


def news_restricted(rows: DataFrame, events: DataFrame, at: str, before: timedelta, after: timedelta) -> DataFrame:
    """rows with `restricted`: an event known by then, for the row's symbol, whose
    window around its scheduled time holds the row.

    Events are dealt to the hours their window touches, so the join is an equi-join
    on (symbol, hour) and no side is replicated whole.
    """
    lo = F.col("scheduled_time") - F.lit(before)
    hi = F.col("scheduled_time") + F.lit(after)
    hour = lambda c: F.date_trunc("HOUR", c).cast("timestamp_ntz")
    e = events.select(F.explode("affected_instruments").alias("symbol"), "available_at", lo.alias("_lo"), hi.alias("_hi"))
    e = e.withColumn("_h", F.explode(F.sequence(hour(F.col("_lo")), hour(F.col("_hi")), F.expr("interval 1 hour"))))
    e = e.withColumnRenamed("available_at", "_known").withColumnRenamed("symbol", "_s").withColumnRenamed("_h", "_eh")
    inside = (F.col("symbol") == F.col("_s")) & (hour(F.col(at)) == F.col("_eh")) & (F.col("_known") <= F.col(at)) & (F.col("_lo") <= F.col(at)) & (F.col(at) <= F.col("_hi"))
    met = rows.join(e, inside, "left_semi").withColumn("restricted", F.lit(True))
    return met.unionByName(rows.join(e, inside, "left_anti").withColumn("restricted", F.lit(False)))


def calendar_known(rows: DataFrame, events: DataFrame, at: str, tolerance: timedelta = timedelta(days=1), by: list[str] | None = None) -> DataFrame:
    """rows with the scheduled time of the event published last, by its own
    available_at and no longer ago than tolerance: the honest calendar join."""
    known = events.select(*(by or []), F.col("available_at").alias("_known"), "scheduled_time")
    by = by or ["_all"]
    if by == ["_all"]:
        rows, known = rows.withColumn("_all", F.lit(0)), known.withColumn("_all", F.lit(0))
    return asof_backward(rows, known, at, "_known", tolerance, by, ["scheduled_time"]).drop("_all")


def guard_available(rows: DataFrame, versions: DataFrame, at: str, by: list[str], columns: list[str]) -> DataFrame:
    """rows with the newest artefact version available by then, and `refused`
    where none is."""
    got = asof_backward(rows, versions.withColumn("_ok", F.lit(True)), at, "available_from", None, by, [*columns, "_ok"], unlimited=True)
    return got.withColumn("refused", F.col("_ok").isNull()).drop("_ok")
