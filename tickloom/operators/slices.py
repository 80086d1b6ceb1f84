"""Windows over one key's long history as many tasks.

A few symbols hold most rows, so a window partitioned by symbol alone is a few
tasks whatever the cluster. Here a history is cut where its order allows, and what
must pass a border is summed up a slice first: one row a slice goes through the
window that is partitioned by the key alone.

Rows whose slicing value is null sort first, as Spark sorts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1 << 16  # rows of a stretch, neighbours from other stretches not counted


def day(ts: str) -> Column:
    """The slice of an instant: whole days since the epoch."""
    return F.unix_date(F.to_date(ts)).cast("long")


def block(x: str, size: float) -> Column:
    """The slice of a number: whole multiples of size."""
    return F.floor(F.col(x) / size).cast("long")


def _keyed(df: DataFrame, by: list[str], at: Column | list[Column]) -> tuple[DataFrame, list[str]]:
    """df with its keys and slice as columns without nulls (_k0 .., _at), so that what is
    summed up meets its rows by plain equality and without another shuffle. A slice of
    several numbers is a struct of them."""
    keys = [f"_k{i}" for i in range(len(by))]
    text = {k: F.coalesce(F.col(c).cast("string"), F.lit("\0")) for k, c in zip(keys, by)}
    own = [F.coalesce(x, F.lit(-(1 << 62))) for x in (at if isinstance(at, list) else [at])]
    return df.withColumns({**text, "_at": own[0] if len(own) == 1 else F.struct(*own)}), keys


def _meet(t: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside their slice's row of ends."""
    return t.join(ends, [*keys, "_at"])


def numbered(df: DataFrame, by: list[str], order: list[Column], at: Column | list[Column]) -> DataFrame:
    """df with _pos, its place from 0 in `order` within `by`, and _n, the rows of
    `by`. The order must begin with what `at` slices."""
    t, keys = _keyed(df, by, at)
    key = Window.partitionBy(*keys)
    ends = t.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_c"))
    ends = ends.withColumn("_base", F.sum("_c").over(key.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).withColumn("_n", F.sum("_c").over(key)).drop("_c")
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(*order)))
    return _meet(t, ends, keys).withColumn("_pos", F.col("_base") + F.col("_r") - 1).drop("_at", "_r", "_base", *keys)


def ranked(df: DataFrame, by: list[str], value: str, seq: str, size: float, down: bool = False, most: int = ROWS) -> DataFrame:
    """numbered in order of (value, seq), or of both downwards, in slices of values `size`
    wide. A value that more than `most` rows of a key share is cut further, by seq: such
    values, one row each, are found first, and stand between the slices of the values
    about them."""
    t, keys = _keyed(df, by, block(value, size))
    few = t.groupBy(*keys, "_at", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most)
    few = few.groupBy(*keys, "_at").agg(F.sort_array(F.collect_list("_v")).alias("_common"))
    t = t.join(few, [*keys, "_at"], "left").withColumnRenamed("_at", "_block").drop(*keys)
    v, common = F.col(value), F.coalesce("_common", F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>"))
    own = F.array_contains(common, v)
    part = 2 * F.size(F.filter(common, lambda x: x < v)) + F.when(own, 1).otherwise(0)
    place = [F.col("_block"), F.coalesce(part, F.lit(0)).cast("long"), F.when(own, block(seq, most)).otherwise(F.lit(0).cast("long"))]
    order = [F.desc(value), F.desc(seq)] if down else [F.col(value), F.col(seq)]
    return numbered(t, by, order, [-x if down else x for x in place]).drop("_block", "_common")


def over(df: DataFrame, make, before: int, ts: str, after: int = 0, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = (), at: Column | None = None) -> DataFrame:
    """make(t, w) where w orders stretches of ROWS rows, each led by the `before`
    rows before it and followed by the `after` rows behind it; the added rows are
    taken away again. Right for frames of at most that many rows."""
    size = max(ROWS, before, after, 1)
    t = numbered(df, list(by), [F.col(c) for c in (ts, *order)], day(ts) if at is None else at)
    own, rest = F.floor(F.col("_pos") / size), F.pmod(F.col("_pos"), F.lit(size))
    homes = [own]
    if before:
        homes.append(F.when((rest >= size - before) & ((own + 1) * size < F.col("_n")), own + 1))
    if after:
        homes.append(F.when((rest < after) & (own > 0), own - 1))
    t = t.withColumn("_own", own).withColumn("_stretch", F.explode(F.array_compact(F.array(*homes)))) if len(homes) > 1 else t.withColumn("_own", own).withColumn("_stretch", own)
    w = Window.partitionBy(*by, "_stretch").orderBy("_pos")
    return make(t, w).where("_own = _stretch").drop("_pos", "_n", "_own", "_stretch")


def previous(df: DataFrame, name: str, value: Column, by: list[str], order: list[str], at: Column) -> DataFrame:
    """df with `name`: value in the row before, in `order` within `by`."""
    t, keys = _keyed(df, by, at)
    ends = t.groupBy(*keys, "_at").agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias("_v"))
    ends = ends.withColumn("_v", F.lag("_v").over(Window.partitionBy(*keys).orderBy("_at")))
    t = t.withColumn("_l", F.lag(F.struct(value.alias("v"))).over(Window.partitionBy(*keys, "_at").orderBy(*order)))
    return _meet(t, ends, keys).withColumn(name, F.coalesce("_l", "_v")["v"]).drop("_l", "_v", "_at", *keys)


def highest_before(df: DataFrame, name: str, value: str, by: list[str], order: list[str], at: Column) -> DataFrame:
    """df with `name`: the largest value of all rows before."""
    t, keys = _keyed(df, by, at)
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = t.groupBy(*keys, "_at").agg(F.max(value).alias("_v"))
    ends = ends.withColumn("_v", F.max("_v").over(past(Window.partitionBy(*keys).orderBy("_at"))))
    t = t.withColumn("_m", F.max(value).over(past(Window.partitionBy(*keys, "_at").orderBy(*order))))
    return _meet(t, ends, keys).withColumn(name, F.greatest("_m", "_v")).drop("_m", "_v", "_at", *keys)


def running(df: DataFrame, value: Column, by: list[str], order: list[str], at: Column, total: str, peak: str) -> DataFrame:
    """df with the running sum of value and its highest so far."""
    t, keys = _keyed(df, by, at)
    w = Window.partitionBy(*keys, "_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_x", value).withColumn("_s", F.sum("_x").over(w)).withColumn("_p", F.max("_s").over(w))
    past = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = t.groupBy(*keys, "_at").agg(F.sum("_x").alias("_all"), F.max("_s").alias("_hi"))
    ends = ends.withColumn("_base", F.coalesce(F.sum("_all").over(past), F.lit(0.0)))
    ends = ends.withColumn("_top", F.max(F.col("_base") + F.col("_hi")).over(past)).drop("_all", "_hi")
    out = _meet(t, ends, keys).withColumn(total, F.col("_base") + F.col("_s")).withColumn(peak, F.greatest(F.col("_top"), F.col("_base") + F.col("_p")))
    return out.drop("_at", "_x", "_s", "_p", "_base", "_top", *keys)


def running_many(df: DataFrame, values: dict[str, Column], by: list[str], order: list[str], at: Column) -> tuple[DataFrame, list[str]]:
    """df with _at, and for each name the running sum s_name of its value within the slice
    and the highest p_name so far; and the columns that, with _at, name a slice. Many
    curves over the same rows are columns here, so rows are sorted once and never copied."""
    t, keys = _keyed(df, by, at)
    w = Window.partitionBy(*keys, "_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({f"x_{n}": v for n, v in values.items()})
    t = t.withColumns({f"s_{n}": F.sum(f"x_{n}").over(w) for n in values}).withColumns({f"p_{n}": F.max(f"s_{n}").over(w) for n in values})
    return t.drop(*[f"x_{n}" for n in values]), keys


def latest(df: DataFrame, name: str, value: str, by: list[str], order: list[Column], at: Column, forward: bool = False) -> DataFrame:
    """df with `name`: the last value that is not null in `order`, the row's own
    included; forward, in an order that runs back in time, the next one."""
    t, keys = _keyed(df, by, at)
    w = Window.partitionBy(*keys, "_at").orderBy(*order)
    t = t.withColumn("_l", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_r", F.row_number().over(w))
    # A slice's last row has seen all of it.
    ends = t.groupBy(*keys, "_at").agg(F.max_by("_l", "_r").alias("_v"))
    past = Window.partitionBy(*keys).orderBy(F.col("_at").desc() if forward else F.col("_at").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_v", F.last("_v", ignorenulls=True).over(past))
    return _meet(t, ends, keys).withColumn(name, F.coalesce("_l", "_v")).drop("_l", "_r", "_v", "_at", *keys)


def expanding_sums(df: DataFrame, ts: str, value: Column, total: str, count: str, by: list[str]) -> DataFrame:
    """df with the sum and number of the values up to each row's instant, rows of the same
    instant included: sums of its day so far upon the totals of the days before."""
    t, keys = _keyed(df.withColumn("_x", value), by, day(ts))
    so_far = Window.partitionBy(*keys, "_at").orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = t.groupBy(*keys, "_at").agg(F.sum("_x").alias("_all"), F.count("_x").alias("_of"))
    ends = ends.withColumn("_base", F.coalesce(F.sum("_all").over(past), F.lit(0.0))).withColumn("_were", F.coalesce(F.sum("_of").over(past), F.lit(0))).drop("_all", "_of")
    t = t.withColumn("_s", F.coalesce(F.sum("_x").over(so_far), F.lit(0.0))).withColumn("_c", F.count("_x").over(so_far))
    out = _meet(t, ends, keys).withColumn(total, F.col("_base") + F.col("_s")).withColumn(count, F.col("_were") + F.col("_c"))
    return out.drop("_at", "_x", "_base", "_were", "_s", "_c", *keys)


def smoothed(df: DataFrame, values: dict[str, Column], n: int, ts: str, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ()) -> DataFrame:
    """df with Wilder's means: the mean of the values of rows 1 to n at row n, then
    (n - 1)/n of the mean before plus 1/n of the value. Null before row n. Values may not
    be negative, and may look at the row before in the window that values(w) is given.

    A step is an affine map, so a slice of rows is one as well. Within a slice the mean is
    a weighted running sum, scaled to the slice's first row (only sums of positive terms,
    so nothing cancels); a slice's map is its last row's. A slice is 40 n rows or more,
    after which less than 1e-17 of a mean is left, so the maps of the last three slices
    make up what a slice begins with, to the last bit of a double."""
    size, keep = max(512, 40 * n), (n - 1) / n
    t = numbered(df, list(by), [F.col(c) for c in (ts, *order)], day(ts)).drop("_n")
    t = t.withColumn("_own", F.floor(F.col("_pos") / size))
    # A slice begins with the last row of the one before, for values that look back.
    t = t.withColumn("_slice", F.explode(F.when(F.pmod("_pos", F.lit(size)) == size - 1, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(*by, "_slice").orderBy("_pos")
    t = t.withColumns({f"_x_{k}": make(w) for k, make in values.items()}).where("_own = _slice")
    k = F.col("_pos") - F.col("_slice") * size
    # The first n values count from row n on, as their plain mean.
    born = F.greatest(F.col("_pos"), F.lit(n)) - F.col("_slice") * size
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = {f"_s_{v}": F.sum(F.when(F.col("_pos") > 0, F.coalesce(f"_x_{v}", F.lit(0.0)) * F.pow(F.lit(keep), -born)).otherwise(0.0)).over(so_far) for v in values}
    t = t.withColumns(grown)
    last = t.where(k == size - 1).select(*by, F.col("_slice").alias("_before"), *[(F.col(f"_s_{v}") * (keep ** (size - 1) / n)).alias(f"_e_{v}") for v in values])
    past = Window.partitionBy(*by).orderBy("_before")
    for v in values:
        e = F.col(f"_e_{v}")
        for back in (1, 2):
            e = e + keep ** (size * back) * F.coalesce(F.lag(f"_e_{v}", back).over(past), F.lit(0.0))
        last = last.withColumn(f"_b_{v}", e)
    last = last.select(*by, (F.col("_before") + 1).alias("_slice"), *[f"_b_{v}" for v in values])
    t = t.join(last, [*by, "_slice"], "left")
    mean = {v: F.when(F.col("_pos") >= n, F.pow(F.lit(keep), k) * (keep * F.coalesce(f"_b_{v}", F.lit(0.0)) + F.col(f"_s_{v}") / n)) for v in values}
    return t.withColumns(mean).select(*df.columns, *values)
