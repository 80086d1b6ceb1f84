"""The driver tables seen as quotes, bars, trades, account paths and dimensions.

events is the quote stream: its types are symbols, its value the bid. orders and
lineitem give account paths and trades. The SQL texts state the same views.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import resample

OUTAGES = [(datetime(2024, 1, 5, 6), datetime(2024, 1, 5, 11)), (datetime(2024, 1, 17), datetime(2024, 1, 17, 9, 30))]
THRESHOLD_MS = 6 * 3_600_000
PIP = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_quotes(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("symbol"), F.col("value").alias("bid"),
        (F.col("value") + F.lit(0.01) * (1 + F.col("event_id") % 7)).alias("ask"),
        (1 + F.col("user_id") % 10).cast("double").alias("bid_volume"), (1 + F.col("user_id") % 5).cast("double").alias("ask_volume"), F.lit(False).alias("sequence_gap"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_quotes(table(spark, sf_dir, "events"))


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "4h") -> DataFrame:
    return resample(quotes(spark, sf_dir), timeframe, THRESHOLD_MS, OUTAGES)


def candles(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Mid candles (symbol, ts, open, high, low, close)."""
    b = resample(quotes(spark, sf_dir), timeframe, THRESHOLD_MS)
    mid = lambda n: ((F.col(f"bid_{n}") + F.col(f"ask_{n}")) / 2).alias(n)
    return b.select("symbol", F.col("ts_open").alias("ts"), mid("open"), F.greatest((F.col("bid_high") + F.col("ask_high")) / 2, *[mid(n) for n in ("open", "close")]).alias("high"), F.least((F.col("bid_low") + F.col("ask_low")) / 2, *[mid(n) for n in ("open", "close")]).alias("low"), mid("close"), "volume")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades of books (ship day exit, discount less tax as r)."""
    li = table(spark, sf_dir, "lineitem")
    r = (F.col("l_discount") - F.col("l_tax")) * 10
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("book"), F.col("l_shipdate").cast("timestamp_ntz").alias("exit_ts"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"),
        F.round(r * F.col("l_quantity") / 100, 6).alias("pnl"), F.round(r, 6).alias("r"), F.col("l_extendedprice").alias("gross"), (F.col("l_extendedprice") * F.col("l_tax")).alias("cost"), F.col("l_suppkey").alias("supplier"),
    )


def account_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a marked account path around 100 000."""
    o = table(spark, sf_dir, "orders")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cents = F.round(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * 10).cast("long")
    t = o.withColumn("_c", cents)
    equity = (F.lit(10_000_000).cast("long") + F.sum("_c").over(w)).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")
    t = t.withColumn("equity", equity.cast("decimal(18,2)"))
    return t.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "equity", (F.col("equity") - (F.col("o_orderkey") % 500).cast("decimal(18,2)")).cast("decimal(18,2)").alias("balance"))
