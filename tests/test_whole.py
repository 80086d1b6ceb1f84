"""Registered queries read every row: each against its text without the text's cut,
or by brute force."""

from dataclasses import replace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_oracle import plain
from tickloom.operators import features, replay, research, signals
from tickloom.plans import catalog, oracle
from tickloom.sources import synthetic

TABLES = "lineitem orders events".split()


def whole(name, sf, *cuts):
    """Rows of a query's text with its row filters taken out."""
    sql = oracle.ORACLES[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c.sql(sql)


def same(df, rel):
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got and got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["compounded_curve", "portfolio_frontier", "best_risk"])
def test_books_hold_every_trade(spark, name):
    sf = "/root/testdata/sf0.001"
    same(catalog.QUERIES[name](spark, sf), whole(name, sf, " WHERE supplier % 10 = 0"))


@pytest.mark.parametrize("name", ["portfolio_frontier", "best_risk"])
def test_accounts_past_the_range_of_a_double(spark, tmp_path, name):
    """Trades so good that some accounts overflow: those have no drawdown in SQL."""
    c = duckdb.connect()
    good = "CASE WHEN i > 1900 THEN l_discount WHEN i % 7 = 3 THEN -0.1 ELSE 40.0 + i % 11 END"
    c.sql(f"""COPY (SELECT l.* REPLACE (i AS l_orderkey, {good} AS l_discount, 'A' AS l_returnflag, CASE WHEN i % 2 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, TIMESTAMP '1996-01-01' + to_days(CAST(CASE WHEN i > 1900 THEN (i - 1900) * 14 ELSE i // 2 - 951 END AS INTEGER)) AS l_shipdate)
    FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM '/root/testdata/sf0.001/lineitem.parquet') l WHERE i <= 2000) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    for t in ("orders", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    want = whole(name, tmp_path)
    assert name == "best_risk" or any(r[1] != r[1] for r in want.fetchall())
    same(catalog.QUERIES[name](spark, str(tmp_path)), want)


def test_streams_of_every_book(spark):
    sf = "/root/testdata/sf0.01"  # its suppliers go past 10
    same(catalog.QUERIES["book_streams"](spark, sf), whole("book_streams", sf, " WHERE l_suppkey < 10"))


def test_chain_breaks_past_any_prefix(spark):
    o = spark.range(10_000).select(F.col("id").alias("pos"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("body"))
    # Rewritten records break the link after them, also across a range's end (4095
    # and 4096); an edit that leaves the hash is found at the record itself.
    got = {r["pos"] for r in catalog._broken(o, F.col("pos").isin(4095, 8000), F.col("pos") == 9000).collect()}
    assert got == {4096, 8001, 9000}


def test_chain_reads_every_order(spark, monkeypatch):
    seen = []
    check = catalog.ledger.broken_links
    monkeypatch.setattr(catalog.ledger, "broken_links", lambda records, *a: seen.append(records.count()) or check(records, *a))
    keys = sorted(r["o_orderkey"] for r in spark.read.parquet("/root/testdata/sf0.01/orders.parquet").collect())
    after = {b for a, b in zip(keys, keys[1:]) if a % 500 == 0}
    edited = {k for k in keys if k % 800 == 0 and k % 500}
    assert {r["pos"] for r in catalog.QUERIES["chain_verify"](spark, "/root/testdata/sf0.01").collect()} == after | edited
    assert seen == [15_000]


@pytest.mark.parametrize("name", ["asof_backward_tol", "asof_forward_first_quote", "market_fills", "first_touch_exit"])
def test_joins_ask_for_every_quote(spark, name):
    sf = "/root/testdata/sf0.001"
    df = catalog.QUERIES[name](spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    same(df, whole(name, sf, " WHERE seq % 5 = 0", " WHERE seq % 3 = 0", " WHERE seq % 4 = 0"))


def test_grids_are_whole(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.001", []
    run = replay.grid_replay

    def count(bundle, name, params, *a, **b):
        seen.append((name, len(params) * len(b.get("trails") or [0]), b.get("part", "all")))
        return run(bundle, name, params, *a, **b)

    monkeypatch.setattr(catalog.replay, "grid_replay", count)
    for name in ("lab_replay_momentum", "lab_replay_opening_range", "lab_replay_trailing", "trailing_sweep", "grid_optimiser"):
        catalog.QUERIES[name](spark, sf)
    sizes = {n: len(signals.grid(n)) for n in signals.GRIDS}
    assert seen[:5] == [("london_momentum", 36, "all"), ("opening_range_break", 18, "all"), ("trailing_momentum", 18, "all"), ("trailing_momentum", 486, "train")] + seen[4:5]
    assert seen[4][0] == "trailing_momentum" and seen[4][2] == "valid" and 0 < seen[4][1] <= 486
    assert seen[5:11] == [(n, k, "train") for n, k in sizes.items()]
    assert {n for n, _, part in seen[11:] if part == "valid"} == set(sizes) and all(k <= sizes[n] for n, k, _ in seen[11:])


def test_sweep_gives_six_a_symbol(spark):
    got = catalog.trailing_sweep(spark, "/root/testdata/sf0.001").toPandas()
    assert set(got.groupby("symbol").size()) == {6} and got["symbol"].nunique() == 5 and "accepted" in got


def test_trails_equal_runs_of_their_own(spark):
    b = synthetic.bars(spark, 900)
    bundle = features.lab_bundle(b.select("symbol", F.col("ts_open").alias("ts"), *[F.col(f"bid_{n}").alias(n) for n in ("open", "high", "low", "close")])).cache()
    acc = replay.Account(spreads=catalog.SPREADS)
    key = ["params", "n"]
    for name in ("london_momentum", "donchian_breakout"):
        params, trails = signals.grid(name)[:3], research.trails()[:2]
        got = replay.grid_replay(bundle, name, params, acc, trails=trails).toPandas().sort_values(key).reset_index(drop=True)
        parts = [replay.grid_replay(bundle, name, params, replace(acc, trail=t)).toPandas().assign(params=lambda x, t=t: x["params"] + f"|{t}") for t in trails]
        assert got.equals(pd.concat(parts).sort_values(key).reset_index(drop=True))
