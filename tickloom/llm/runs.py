"""Periodic runs of words, by harmonic grid probing.

A run is a longest stretch whose words repeat with a smallest period q, at least
`exponent` times and `least` words. Any stretch of exponent * p words holds that many
multiples of p, so for each period p only the grid points 0, p, 2p, ... are probed: the
words at jp and (j+1)p must agree, and so must those of the next steps, exponent - 1 in a
row. The grids of all periods of a document hold some n ln n points; they are compared as
arrays, in pieces of bounded size. What survives is extended to both sides by comparing
stretches of the text with itself p words on, in chunks that double. Periods go upwards,
so a survivor that lies in a run found before, of a period that divides p, is that run
again and is skipped; two words p apart in a run of period p are in no other run of it.

Defined cases: a null text has no words; a null doc_id is the empty string; equal rows
give equal results; an empty table gives no rows; texts of any length are read whole, in
memory for one document at a time; the columns of docs are carried along, but for those
the result has itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, slices

GRID = 1 << 18  # grid points compared at a time
FIELDS = "runs array<struct<start:long,length:long,period:long>>, kept string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _reach(w: np.ndarray, at: int, p: int, up: bool) -> int:
    """How many words in a row from at on, upwards or downwards, equal the one p on."""
    n, step, done = len(w) - p, 16, 0
    while True:
        a, b = (at + done, min(at + done + step, n)) if up else (max(at - done - step + 1, 0), at - done + 1)
        if a >= b:
            return done
        differ = np.flatnonzero(w[a:b] != w[a + p : b + p])
        if len(differ):
            return done + (int(differ[0]) if up else b - a - 1 - int(differ[-1]))
        done += b - a
        step = min(2 * step, 1 << 16)


def _survivors(w: np.ndarray, most: int, row: int):
    """(period, grid point) pairs, periods upwards, where row probes in a row agree."""
    n, first = len(w), 1
    while first <= most:
        # Periods whose grids hold some GRID points together, one period at least.
        last, points = first, n // first
        while last < most and points + n // (last + 1) <= GRID:
            last += 1
            points += n // last
        p = np.arange(first, last + 1)
        count = (n - 1) // p  # pairs (jp, (j+1)p)
        period = np.repeat(p, count)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
        same = w[at] == w[at + period]
        good = same.copy()
        for k in range(1, row):
            good[:-k] &= same[k:]
            good[-k:] = False
        good &= at + row * period < n  # the row stays in its grid
        yield from zip(period[good].tolist(), at[good].tolist())
        first = last + 1


def find_runs(w: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start."""
    n = len(w)
    found: list[tuple[int, int, int]] = []
    here, mine = 0, []
    for p, at in _survivors(w, n // exponent, exponent - 1):
        if here != p:
            here, mine = p, [(s, s + size) for s, size, q in found if p % q == 0]
        if any(s <= at and at + p < e for s, e in mine):
            continue
        s = at - _reach(w, at - 1, p, False) if at else 0
        e = at + p + _reach(w, at, p, True)
        mine.append((s, e))
        if e - s >= max(least, exponent * p):
            found.append((s, e - s, p))
    return sorted(found)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: no run has it after its first period."""
    turn = np.zeros(n + 1, np.int64)
    for s, size, p in runs:
        turn[s + p] += 1
        turn[s + size] -= 1
    return np.cumsum(turn[:n]) == 0


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten, by the checksum of its id, repeats a stretch to its end."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, change=None) -> DataFrame:
    """docs with runs and kept, the words that stay, joined by one space.
    change(words, doc_id): what is done to the words before, if anything."""
    own = [f.split()[0] for f in FIELDS.split(", ")]
    docs = docs.drop(*own)
    names = docs.columns

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            runs, kept = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode().split()  # at the six ASCII spaces
                words = change(words, doc_id) if change else words
                known: dict[bytes, int] = {}
                w = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words))
                got = find_runs(w, exponent, least)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                stay = kept_words(len(words), got).tolist() if got else None
                kept.append(b" ".join(x for x, on in zip(words, stay) if on) if got else b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, _RUN), pa.array(kept, pa.binary()).cast(pa.string())], [*names, *own])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{schema}, " + FIELDS)


def digest(docs: DataFrame) -> DataFrame:
    """The longest run, all runs and the collapsed text of each document, after plant."""
    done = periodic_runs(docs.select("doc_id", "text"), change=plant)
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    done = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    exponent = F.expr("-1000 * top.less div top.period")
    return done.select("doc_id", "n_runs", "top.start", (-F.col("top.less")).alias("length"), "top.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
