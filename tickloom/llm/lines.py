"""Line dedup by winnowing over line hashes.

A document is its sequence of lines that are not blank. A window is the shortest
run of lines that holds `lines` lines or `words` words, taken from every start
and to every end. Each window selects its smallest line hash, the last of equal
ones, as fingerprint; a place that several windows select is kept once. Whether
a run is a window, and what it selects, follows from its lines alone, so two
copies of a window always share a fingerprint.

Places are joined by fingerprint: one that no other place shares goes no further.
Those left are extended to both sides, as far as the windows that selected them
reach, and each extension is compared by a 128-bit hash of its text with the
first place of the corpus, by (doc_id, text hash, line), that has it; so a hot
line costs a row a place and never a pair of places. Matching extensions that
overlap or touch make up the repeated run. The first place stays; later runs are
deleted.

So a line goes if and only if it lies in a window that occurred before, and that
is what the SQL states.

Defined cases: a null text has no lines and stays null; a null doc_id sorts
first; equal rows are one place, so none of them loses lines to its own copy;
blank lines stay; an empty table gives no rows; other columns are carried along, but
for input columns named n_lines or n_removed, which the result's replace.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, drop_table, free_shuffles, slices, stage, unused

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLACE = "doc long, th long, fp long, spans array<struct<s:int,e:int,g1:long,g2:long>>"
SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("g1", pa.int64()), ("g2", pa.int64())])


def line_windows(sizes: list[int], lines: int, words: int) -> list[tuple[int, int]]:
    """(first, last) of every shortest run with `lines` lines or `words` words."""
    n = len(sizes)
    total = [0]
    for x in sizes:
        total.append(total[-1] + x)
    out, e = set(), 0
    for s in range(n):
        e = max(e, s)
        while e < n and e - s + 1 < lines and total[e + 1] - total[s] < words:
            e += 1
        if e < n:
            out.add((s, e))
    s = n - 1
    for e in range(n - 1, -1, -1):
        s = min(s, e)
        while s >= 0 and e - s + 1 < lines and total[e + 1] - total[s] < words:
            s -= 1
        if s >= 0:
            out.add((s, e))
    return sorted(out)


def fingerprints(hashes: list[int], windows: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Selected places and the windows that select each."""
    out: dict[int, list[tuple[int, int]]] = {}
    for s, e in windows:
        at = min(range(e, s - 1, -1), key=hashes.__getitem__)
        out.setdefault(at, []).append((s, e))
    return out


def split_lines(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and the places of those that are not blank."""
    every = text.split("\n") if text else []
    return every, [i for i, x in enumerate(every) if x.strip(" \t\r\v\f")]


def dedup_lines(docs: DataFrame, lines: int = 3, words: int = 50) -> DataFrame:
    """The columns of docs, text without its repeated runs, and n_lines, n_removed."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed")
    th, runs = unused(docs, "__th"), unused(docs, "__runs")
    keyed = docs.withColumn(th, F.coalesce(F.xxhash64("text"), F.lit(0)))

    def places(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            doc, th, fp, count, span = [], [], [], [], [[] for _ in range(3)]
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                every, at = split_lines(text.as_py())
                kept = [every[i].encode() for i in at]
                hashes = [xxhash.xxh3_64_intdigest(x) for x in kept]
                found = fingerprints(hashes, line_windows([len(WORD.findall(every[i])) for i in at], lines, words))
                for p, runs in found.items():
                    doc.append(d)
                    th.append(t)
                    fp.append(hashes[p])
                    count.append(len(runs))
                    for s, e in runs:
                        for c, v in zip(span, (s, e, xxhash.xxh3_128_digest(b"\n".join(kept[s : e + 1])))):
                            c.append(v)
            gram = np.frombuffer(b"".join(span[2]), "<i8").reshape(-1, 2)
            flat = pa.StructArray.from_arrays([pa.array(span[0], pa.int32()), pa.array(span[1], pa.int32()), pa.array(gram[:, 0]), pa.array(gram[:, 1])], fields=list(SPAN))
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), spans], ["doc", "th", "fp", "spans"])

    placed = stage(arrow_map(keyed.select(F.col("doc_id").cast("long"), th, "text"), places, PLACE), "places")
    # Both are written, so that a hot fingerprint's places can be split among tasks.
    shared = stage(placed.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "shared")
    near = stage(placed.hint("merge").join(shared, "fp", "left_semi").select("doc", "th", "fp", F.inline("spans")), "extended")
    drop_table(placed)
    drop_table(shared)
    free_shuffles(spark)
    same = ["fp", "g1", "g2"]
    first = stage(near.groupBy(*same).agg(F.min(F.struct("doc", "th", "s", "e")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first_places")
    later = near.join(first, same).where(F.struct("doc", "th", "s", "e") > F.col("first"))
    marks = later.select("doc", "th", "s", "e").distinct().groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias(runs))
    marks = stage(marks, "runs")
    free_shuffles(spark)
    joined = _left(keyed, marks, th, runs)
    names = docs.columns

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            texts, before, gone = [], [], []
            for text, gaps in zip(batch.column("text"), batch.column(runs).to_pylist()):
                text = text.as_py()
                every, at = split_lines(text)
                dead = {at[i] for r in gaps or [] for i in range(r["s"], r["e"] + 1)}
                texts.append("\n".join(x for i, x in enumerate(every) if i not in dead) if dead else text)
                before.append(len(at))
                gone.append(len(dead))
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines long, n_removed long"
    return arrow_map(joined, cut, schema)


def _left(keyed: DataFrame, marks: DataFrame, th: str, runs: str) -> DataFrame:
    doc, mth = unused(keyed, "__doc"), unused(keyed, "__mth")
    m = marks.select(F.col("doc").alias(doc), F.col("th").alias(mth), runs)
    # One plan at every size: texts and runs meet by a merge join, never by copies
    # of the runs, whose number grows with the corpus.
    return keyed.hint("merge").join(m, keyed["doc_id"].eqNullSafe(m[doc]) & (keyed[th] == m[mth]), "left").drop(doc, mth, th)
