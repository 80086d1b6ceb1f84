"""Stored files, the polled feed, outages as a stream and the chained table."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.plans import views
from tickloom.sources import binary, chain, quote_files
from tickloom.streaming import outages, polling

SF = "/root/testdata/sf0.001"
NAMES = {"click": "EURUSD", "view": "USDJPY", "purchase": "XAUUSD", "error": "GBPUSD", "signup": "AUDUSD"}


@pytest.fixture(scope="module")
def hours(spark, tmp_path_factory):
    """Hour files of all quotes, and two bad ones of a symbol of their own."""
    root = str(tmp_path_factory.mktemp("hours"))
    q = views.quotes(spark, SF).withColumn("symbol", F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.col("symbol")])
    slot = F.make_timestamp_ntz("y", "m", "d", "h", F.lit(0), F.lit(0))
    n = quote_files.store(binary.encode_ticks(q).select(binary.hour_path_column("symbol", slot).alias("path"), "content"), root)
    bad = [("NZDUSD/2024/00/05/03h_ticks.bi5", b"no lzma"), ("NZDUSD/2024/00/05/04h_ticks.bi5", b"neither"), ("NZDUSD/2024/00/05/05h_ticks.bi5", b"")]
    quote_files.store(spark.createDataFrame(bad, "path string, content binary"), root)
    return root, q, n


def planned(path, *filters, **options):
    """The files that a reader plans after filters were pushed."""
    r = quote_files.FileReader({"path": path, **options})
    list(r.pushFilters(list(filters)))
    return [p.items for p in r.partitions()]


def test_range_scan_reads_what_was_stored(spark, hours):
    root, q, n = hours
    a, b = datetime(2024, 1, 5, 7, 30), datetime(2024, 1, 12, 16, 15)
    got = quote_files.scan_range(spark, root, ["EURUSD", "XAUUSD"], a, b)
    want = q.where(F.col("symbol").isin("EURUSD", "XAUUSD")).withColumn("ts", F.date_trunc("MILLISECOND", "ts").cast("timestamp_ntz")).where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
    key = lambda df: sorted((r["symbol"], r["ts"], round(r["bid"], 3)) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) > 50
    assert n == q.select("symbol", F.date_trunc("HOUR", "ts")).distinct().count()


def test_skipped_days_are_never_planned(hours):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    root, _, n = hours
    everything = planned(root)
    assert sum(map(len, everything)) == n + 2  # the empty file is a closed hour
    some = planned(root, EqualTo(("symbol",), "EURUSD"), GreaterThanOrEqual(("ts",), datetime(2024, 1, 5, 7, 30)), LessThan(("ts",), datetime(2024, 1, 6)))
    slots = [s for p in some for _, _, s in p]
    assert slots and all(datetime(2024, 1, 5, 7) <= s < datetime(2024, 1, 6, 1) for s in slots) and all(x[1] == "EURUSD" for p in some for x in p)
    assert planned(root, In(("symbol",), ("EURUSD",)), EqualTo(("symbol",), "XAUUSD")) == []
    assert planned(root, GreaterThanOrEqual(("ts",), datetime(2031, 1, 1))) == []
    # Tasks are dealt by bytes, not one a file.
    assert len(everything) == 1 and len(planned(root, pack="2000")) > 3


def test_pushed_filters_reach_the_plan(spark, hours):
    root, _, n = hours
    t = quote_files.read(spark, root, pack="1")  # a task a file
    assert t.rdd.getNumPartitions() == n + 2
    one = t.where((F.col("symbol") == "EURUSD") & (F.col("ts") >= F.lit(datetime(2024, 1, 5))) & (F.col("ts") < F.lit(datetime(2024, 1, 6))))
    assert 0 < one.rdd.getNumPartitions() <= 25


def test_all_bad_files_are_named(spark, hours):
    root, _, _ = hours
    with pytest.raises(Exception) as e:
        quote_files.read(spark, root).where("symbol = 'NZDUSD'").collect()
    assert "03h_ticks" in str(e.value) and "04h_ticks" in str(e.value)
    kept = quote_files.read(spark, root, errors="keep").where("symbol = 'NZDUSD'").collect()
    assert len(kept) == 2 and all(r["error"] and r["ts"] is None for r in kept)
    assert quote_files.read(spark, root + "/nowhere").count() == 0


def test_candle_files_and_inventory(spark, tmp_path):
    t0 = datetime(2024, 2, 1, 5)
    rows = [(s, t0 + timedelta(days=d, minutes=m), 1.5, 1.75, 1.25, 1.5 + m / 100, 3.0) for s in ("EURUSD", "USDJPY") for d in (0, 1, 4) for m in range(3)]
    c = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    root = str(tmp_path / "days")
    assert quote_files.store(quote_files.encode_candles(c), root) == 6
    quote_files.store(spark.createDataFrame([("EURUSD/2024/01/03/BID_candles_min_1.bi5", b"")], "path string, content binary"), root)
    got = quote_files.scan_range(spark, root, ["EURUSD"], t0, t0 + timedelta(days=2), "candles")
    assert sorted((r["ts"], r["close"]) for r in got.collect()) == [(r[1], r[5]) for r in rows if r[0] == "EURUSD" and r[1] < t0 + timedelta(days=2)]
    inv = {r["symbol"]: (r["days"], r["closed"], r["missing"]) for r in quote_files.inventory(spark, root, date(2024, 2, 1), date(2024, 2, 6)).collect()}
    assert inv == {"EURUSD": (4, 1, "2024-02-04"), "USDJPY": (3, 0, "2024-02-03,2024-02-04")}


# ---------------------------------------------------------------- polled feed


def write_poll(folder, name, rows):
    import json

    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"symbol": s, "ts": t, "bid": 1.0, "ask": 2.0}) + "\n" for s, t in rows))


def test_a_stopped_feed_gives_each_row_once(spark, tmp_path):
    feed, stored, state = tmp_path / "feed", str(tmp_path / "stored"), str(tmp_path / "state")
    cycle = lambda **o: polling.poll_cycle(spark, str(feed), stored, state, partitions=2, **o)
    write_poll(feed, "0001.json", [("a", "2024-01-01T00:00:05Z"), ("b", "2024-01-01T00:00:05Z")])
    write_poll(feed, "0002.json", [("a", "2024-01-01T00:00:03Z"), ("a", "2024-01-01T00:00:04Z")])
    write_poll(feed, ".0003.json.tmp", [("a", "2030-01-01T00:00:00Z")])
    assert cycle() == 4
    assert cycle() == 0  # nothing new
    write_poll(feed, "0003.json", [("a", "2024-01-01T00:00:04.5Z"), ("a", "2024-01-01T00:00:09Z")])
    write_poll(feed, "0004.json", [])
    write_poll(feed, "0005.json", [("b", "2024-01-01T00:00:05Z")])
    assert cycle() == 3
    got = sorted((r["symbol"], r["poll"], r["place"], r["sequence_gap"]) for r in polling.stored_polls(spark, stored).collect())
    # The mark of the first run still stands in the second.
    assert got == [("a", "0001.json", 0, False), ("a", "0002.json", 0, True), ("a", "0002.json", 1, True), ("a", "0003.json", 0, True), ("a", "0003.json", 1, False), ("b", "0001.json", 1, False), ("b", "0005.json", 0, False)]


def test_resume_points_and_archive(spark, tmp_path):
    feed, gone = tmp_path / "feed", tmp_path / "gone"
    write_poll(feed, "1.json", [("a", "2024-01-01T00:00:01Z"), ("a", "2024-01-01T00:00:02Z"), ("b", "2024-01-01T00:00:01Z")])
    points = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, 1))], "symbol string, last_ts timestamp_ntz")
    for name in ("2.json", "3.json"):
        polling.poll_cycle(spark, str(feed), str(tmp_path / "s"), str(tmp_path / "c"), points, 2, archive=str(gone))
        write_poll(feed, name, [("a", f"2024-01-01T00:00:1{name[0]}Z")])
    polling.poll_cycle(spark, str(feed), str(tmp_path / "s"), str(tmp_path / "c"), points, 2, archive=str(gone))
    assert sorted(r["ts"].second for r in polling.stored_polls(spark, str(tmp_path / "s")).where("symbol = 'a'").collect()) == [2, 12, 13]
    assert (gone / "1.json").exists() and not (feed / "1.json").exists()


def test_run_counts_attempts_and_backs_off():
    calls, slept = iter([3, OSError("down"), OSError("down"), 2, ValueError("bad"), 1]), []

    def cycle():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    rows, downs = polling.run(cycle, 6, ["a", "b"], backoff=40.0, sleep=slept.append, now=lambda: "t")
    assert rows == 6 and slept == [40.0, 60.0, 40.0] and downs == [("a", "t"), ("b", "t")] * 3


# ---------------------------------------------------------------- outages


def test_outages_do_not_depend_on_arrival(spark, tmp_path):
    """Quotes and starts in order of arrival, some late within the watermark."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    events = [("a", at(0), False), ("a", at(10), True), ("a", at(12), True), ("a", at(30), False), ("a", at(25), False), ("a", at(31), False), ("a", at(200), False), ("a", at(205), True), ("b", at(5), True), ("b", at(4), False), ("b", at(5), False)]
    for i in range(0, len(events), 3):
        spark.createDataFrame(events[i : i + 3], "symbol string, ts timestamp_ntz, start boolean").coalesce(1).write.parquet(str(tmp_path / f"p{i:02d}"))
    (tmp_path / "in").mkdir()
    for k, p in enumerate(sorted(tmp_path.glob("p*/part*.parquet"))):
        p.rename(tmp_path / f"in/{k}.parquet")
    feed = spark.readStream.schema("symbol string, ts timestamp_ntz, start boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with polling.stateful(spark, 2):
        s = outages.watch_outages(feed, "1 hour", 60 * 60_000).writeStream.format("memory").queryName("outs").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    s.awaitTermination()
    got = {r["symbol"]: r for r in outages.last_rows(spark.table("outs")).collect()}
    a, b = got["a"], got["b"]
    # 12 to 25 by the start, 31 + 60 to 200 by silence, and down again since 205.
    assert (a["windows"], a["downtime_ms"], a["silences"], a["silent_ms"]) == (1, 13 * 60_000, 1, 109 * 60_000)
    assert a["down_since"].replace(tzinfo=None) == at(205) and (b["windows"], b["downtime_ms"]) == (1, 0)


# ---------------------------------------------------------------- chained table


def records(spark, a, b, parts=3):
    return spark.range(a, b, 1, parts).select(F.col("id"), F.concat(F.lit("record "), F.col("id").cast("string")).alias("body"))


def test_one_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "chain")
    first = chain.append(records(spark, 0, 10), path)
    second = chain.append(records(spark, 10, 15), path)
    assert first != second and chain.head(path) == second
    with pytest.raises(Exception) as e:  # a writer that still holds the first head
        chain.append(records(spark, 90, 99), path, on=first)
    assert "StaleHead" in str(e.value)
    t = chain.read(spark, path)
    assert sorted(r["id"] for r in t.collect()) == list(range(15))
    assert chain.broken_records(t).count() == 0 and chain.broken_parts(t).count() == 0 and chain.broken_heads(path) == []
    assert len(list((tmp_path / "chain/parts").glob("*.parquet"))) == len([p for link in chain.links(path) for p in link["parts"]])


def test_what_was_altered_is_found(spark, tmp_path):
    path = str(tmp_path / "chain")
    chain.append(records(spark, 0, 40, 2), path)
    t = chain.read(spark, path).cache()
    edited = t.withColumn("body", F.when(F.col("id") == 7, "x").otherwise(F.col("body")))
    assert [(r["id"], r["link_ok"], r["hash_ok"]) for r in chain.broken_records(edited, span=4).collect()] == [(7, True, False)]
    rewritten = edited.withColumn("record_hash", F.when(F.col("id") == 7, F.sha2(F.concat_ws("|", "body", "prev_hash"), 256)).otherwise(F.col("record_hash")))
    assert [(r["id"], r["link_ok"], r["hash_ok"]) for r in chain.broken_records(rewritten, span=4).collect()] == [(8, False, True)]
    gone = t.where("id <> 25")
    assert [r["id"] for r in chain.broken_records(gone).collect()] == [26]
    cut = t.where("id < 39")
    assert chain.broken_records(cut).count() == 0 and chain.broken_parts(cut).count() == 1


def test_blank_records_and_overwrites_fail(spark, tmp_path):
    path = str(tmp_path / "chain")
    with pytest.raises(Exception):
        chain.append(spark.createDataFrame([(1, "  ")], "id long, body string"), path)
    assert chain.links(path) == [] and chain.head(path) == chain.GENESIS
    assert chain.append(records(spark, 0, 0), path) == chain.GENESIS  # nothing to append, no link
    with pytest.raises(Exception):
        records(spark, 0, 3).write.format("chained_table").option("path", path).option("head", chain.GENESIS).mode("overwrite").save()
    with pytest.raises(ValueError):
        chain.read(spark, path)


def test_promotion_of_quotes_at_zero(spark, tmp_path):
    """A stored price of 0 is no reason to refuse the batch of the query."""
    from tickloom.plans import catalog, stored  # noqa: F401  adds to the catalog

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("value", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["promoted_tables"](spark, str(tmp_path)).collect()
    assert sum(r["ticks"] for r in got) == e.count() and len(got) == 5
    assert all(r["refused"] and r["crossed"] == e.where("event_id % 97 = 0").count() for r in got)


def test_digests_are_made_where_files_are_listed(spark, tmp_path):
    """Files at any depth, empty ones too, without hidden ones; the driver lists no folder
    but the topmost."""
    import hashlib

    from tickloom.sources import tables

    root = tmp_path / "files"
    some = {"top.txt": b"top", "000/1.txt": b"one", "000/deep/2.txt": b"two" * 700_000, "001/3.txt": b"", "001/.3.txt.crc": b"?", "_gone/4.txt": b"?", "002/_5.txt": b"?"}
    for name, content in some.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    df = tables.file_digests(spark, str(root))
    assert "FileScan" not in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple") and "BatchScan" not in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert sorted(tuple(r) for r in df.collect()) == sorted((n.split("/")[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in some.items() if n in ("top.txt", "000/1.txt", "000/deep/2.txt", "001/3.txt"))


class _State:
    """A value or a list of a processor's state, kept here."""

    def __init__(self):
        self.x, self.put, self.clear = None, lambda v: setattr(self, "x", v), lambda: setattr(self, "x", None)
        self.update, self.get, self.exists = self.put, lambda: self.x, lambda: self.x is not None


class _Handle:
    def __init__(self):
        self.getValueState = self.getListState = lambda name, schema: _State()


def test_gap_flags_go_out_in_lots(monkeypatch):
    """Rows of one symbol in any order of arrival, put in order and given in lots."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(polling, "LOT", 7)
    r = np.random.default_rng(2)
    p = polling._HighWater()
    p.init(_Handle())
    top = None
    for batch in range(3):
        rows = [(f"{batch}/{k // 10:03d}", k % 10, "A", pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(int(r.integers(0, 500)) + 200 * batch, "s"), float(k), 2.0, 3.0, 4.0) for k in range(60)]
        t = pd.DataFrame([rows[i] for i in r.permutation(60)], columns=[c.split()[0] for c in polling.POLL.split(", ")])
        out = list(p.handleInputRows(("A",), iter([t[:25], t[25:]]), None))
        assert max(map(len, out)) == 7 and list(out[0].columns) == [c.split()[0] for c in polling.FLAGGED.split(", ")]
        want = []
        for row in rows:
            want.append((*row, top is not None and row[3] < top))
            top = row[3] if top is None else max(top, row[3])
        assert [tuple(x) for x in pd.concat(out).itertuples(index=False)] == want


def test_waiting_events_are_packed(monkeypatch):
    """Events that wait for the watermark are kept as numbers in lots, and counted as before."""
    import numpy as np

    monkeypatch.setattr(outages, "LOT", 5)
    r = np.random.default_rng(4)
    w = outages._Watch(1000)
    w.init(_Handle())
    seen = []
    for mark in (-1, 3_000, 3_500, 9_000):
        fresh = [(int(us) * 1000, int(kind)) for us, kind in zip(r.integers(0, 9_000, 30), r.random(30) < 0.8)]
        fresh = [e for e in fresh if mark < 0 or e[0] > mark * 1000]
        seen += fresh
        got = w._settle([np.array([us * 2 + kind for us, kind in fresh], np.int64)], mark)
        assert got == outages._pass((0, outages._NONE, outages._NONE, 0, 0, 0, 0), sorted(seen), 1000)
        assert all(len(x[0]) <= 5 * 8 for x in w.waiting.get() or [])
