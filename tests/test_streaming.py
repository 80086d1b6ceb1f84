"""Streams against batch on the same rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators.bars import resample
from tickloom.plans import views
from tickloom.streaming import capture

SF = "/root/testdata/sf0.001"


def feed(spark, tmp_path, parts=3):
    """The events in some files, in order."""
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    n = e.count()
    for k in range(parts):
        lo, hi = k * n // parts, (k + 1) * n // parts
        e.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for k in range(parts):
        for p in (tmp_path / f"in/{k}").glob("*.parquet"):
            (tmp_path / "feed").mkdir(exist_ok=True)
            p.rename(tmp_path / "feed" / f"{k}.parquet")
    return str(tmp_path / "feed")


def drain(q):
    q.processAllAvailable()
    q.stop()


def test_stream_bars_equal_batch(spark, tmp_path):
    q = views.as_quotes(capture.read_quotes(spark, feed(spark, tmp_path)))
    s = capture.stream_bars(q).writeStream.format("memory").queryName("sb").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(s)
    got = {(r["symbol"], r["ts_open"]): (r["bid_open"], r["bid_close"], r["tick_count"]) for r in spark.table("sb").withColumn("ts_open", F.col("ts_open").cast("timestamp_ntz")).collect()}
    batch = resample(views.quotes(spark, SF), "4h", 1)
    end = views.quotes(spark, SF).agg(F.max("ts")).first()[0] - timedelta(hours=1)
    want = {(r["symbol"], r["ts_open"]): (r["bid_open"], r["bid_close"], r["tick_count"]) for r in batch.where(F.col("available_at") <= F.lit(end)).collect()}
    assert got == want and len(got) > 100


def test_resume_stores_each_row_once(spark, tmp_path):
    folder = feed(spark, tmp_path)
    q = views.as_quotes(capture.read_quotes(spark, folder))
    twice = q.unionByName(q)
    s = capture.without_repeats(twice, ["seq"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(s)
    assert spark.table("once").count() == views.quotes(spark, SF).count()


def test_monitor_equals_batch(spark, tmp_path):
    q = views.as_quotes(capture.read_quotes(spark, feed(spark, tmp_path)))
    bent = q.withColumn("ts", F.when(F.col("seq") % 50 == 7, F.col("ts") - F.expr("interval 3 days")).otherwise(F.col("ts")))
    s = capture.monitor(bent).writeStream.format("memory").queryName("mon").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(s)
    last = {}
    for r in spark.table("mon").collect():
        if r["ticks"] >= last.get(r["symbol"], (0,))[0]:
            last[r["symbol"]] = (r["ticks"], r["gaps"], r["max_gap_ms"])
    batch = views.quotes(spark, SF).withColumn("ts", F.when(F.col("seq") % 50 == 7, F.col("ts") - F.expr("interval 3 days")).otherwise(F.col("ts")))
    want = {r["symbol"]: (r["ticks"], r["gaps"], r["max_gap_ms"]) for r in capture.monitor_batch(batch).collect()}
    assert last == want and sum(x[1] for x in want.values()) > 5


def test_json_capture_resumes(spark, tmp_path):
    folder = feed(spark, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        capture.append_json(views.as_quotes(capture.read_quotes(spark, folder)), out, state).awaitTermination()
    assert spark.read.json(out).count() == views.quotes(spark, SF).count()
    assert capture.stale(capture.resume_points(views.quotes(spark, SF)), spark.createDataFrame([("x",)], "symbol string"), datetime(2024, 1, 1), 1).first()["stale"]
