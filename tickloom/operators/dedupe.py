"""Unique rows that keep a stated one, gaps against a calendar, and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.sessions import capture_bucket
from tickloom.operators.slices import day, previous


def keep_last(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row a key: the one with the largest seq. max_by combines on the map
    side, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def keep_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row a key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_slots(rows: DataFrame, ts: str, unit: str, by: str = "symbol") -> DataFrame:
    """(by, slot): calendar slots between a key's first and last row without any."""
    slot = F.date_trunc(unit, ts).cast("timestamp_ntz")
    seen = rows.select(by, slot.alias("slot")).distinct()
    span = seen.groupBy(by).agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    every = span.select(by, F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit.lower()}"))).alias("slot"))
    return every.join(seen, [by, "slot"], "left_anti")


def episode_visits(ticks: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Visits (runs of ticks) to each capture bucket by symbol; a tick in no bucket
    ends a run."""
    t = ticks.withColumn("bucket", capture_bucket(F.col("ts")) if bucket is None else bucket)
    t = previous(t, "_last", F.col("bucket"), ["symbol"], ["ts", "seq"], day("ts"))
    new = F.col("bucket").isNotNull() & ~F.col("bucket").eqNullSafe(F.col("_last"))
    return t.withColumn("_new", new).where("bucket IS NOT NULL").groupBy("symbol", "bucket").agg(F.count_if("_new").alias("visits"), F.count(F.lit(1)).alias("ticks"))


def episode_report(visits: DataFrame, minimums: DataFrame) -> DataFrame:
    """bucket minimums with visits and whether they suffice."""
    got = minimums.join(visits.groupBy("bucket").agg(F.sum("visits").alias("visits")), "bucket", "left")
    got = got.withColumn("visits", F.coalesce("visits", F.lit(0)))
    return got.withColumn("status", F.when(F.col("visits") >= F.col("minimum"), "ok").otherwise("below minimum"))


# An order-aware hash as a monoid: (n, v1 .. v4), where v is the sum of h(row i) B^i
# modulo the prime 2^31 - 1, one base B a lane. (n, v) and (m, u) of what follows make
# (n + m, v + u B^n), so parts are hashed where they lie and put together in any grouping.
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_566_083_941, 1_812_433_253, 1_000_003)
_LANES = [f"v{i}" for i in range(len(_BASES))]


def _power(base: int, n: Column) -> Column:
    """base^n modulo the prime, by the four bytes of n."""
    out = None
    for i in range(4):
        step = pow(base, 1 << (8 * i), _PRIME)
        # One literal, folded when the plan is made.
        table = F.from_json(F.lit(str([pow(step, j, _PRIME) for j in range(256)])), "array<bigint>")
        one = table[F.shiftright(n, 8 * i).bitwiseAND(F.lit(255)).cast("int")]
        out = one if out is None else out * one % _PRIME
    return out


def stream_digest(rows: DataFrame, by: list[str], order: list[str], values: list[Column], at: Column) -> DataFrame:
    """by, at and the digest (n, v0 .. v3) of the slice's rows in `order`, their place and
    values hashed. The order must begin with what `at` slices; streams below 2^32 rows a
    slice. Rows are summed up where they lie."""
    t = rows.select(*by, at.alias("at"), *order, F.xxhash64(*values).alias("_h"))
    place = (F.row_number().over(Window.partitionBy(*by, "at").orderBy(*order)) - 1).cast("long")
    t = t.withColumn("_i", place)
    # One array of the lanes: sums of four long expressions would be one method too large
    # for the JVM to compile.
    lanes = [F.pmod(F.xxhash64(F.lit(i), F.col("_h")), F.lit(_PRIME)) * _power(base, F.col("_i")) % _PRIME for i, base in enumerate(_BASES)]
    return _summed(t.select(*by, "at", F.lit(1).cast("long").alias("n"), F.array(*lanes).alias("_v")), [*by, "at"])


def _summed(t: DataFrame, by: list[str]) -> DataFrame:
    return t.groupBy(*by).agg(F.sum("n").alias("n"), *[(F.sum(F.col("_v")[i]) % _PRIME).alias(v) for i, v in enumerate(_LANES)])


def merge_digests(parts: DataFrame, by: list[str], order: str = "at") -> DataFrame:
    """by with the digest of all parts in `order`: slices of a day, stored digests of
    months, or both."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = parts.withColumn("_b", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lanes = [F.col(v) * _power(base, F.col("_b")) % _PRIME for v, base in zip(_LANES, _BASES)]
    return _summed(t.select(*by, "n", F.array(*lanes).alias("_v")), by)


def digest_text(n: str = "n", lanes: list[str] | None = None) -> Column:
    return F.concat_ws("-", F.col(n).cast("string"), *[F.lpad(F.hex(F.col(v)), 8, "0") for v in lanes or _LANES])


def fingerprint(trades: DataFrame, book: str = "book", span: int = 64) -> DataFrame:
    """book and a hash of its trade stream (entry, exit price rounded to 6, in that
    order): the digests of slices of `span` days, put together. Fewer days where a book
    has very many trades a day, more where there are many books with few."""
    t = trades.select(book, "entry_ts", F.round("exit_price", 6).alias("_p"))
    parts = stream_digest(t, [book], ["entry_ts", "_p"], [F.col("entry_ts"), F.col("_p")], F.floor(day("entry_ts") / span))
    return merge_digests(parts, [book]).select(book, digest_text().alias("stream"))


def fresh_after(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows later than the last stored instant of their symbol."""
    last = stored.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return rows.join(last, "symbol", "left").where("_last IS NULL OR ts > _last").drop("_last")
