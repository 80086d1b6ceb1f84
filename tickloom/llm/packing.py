"""Best-fit packing by minimum bin slack.

Documents longer than a sequence are cut into whole sequences, a shorter piece
first. Piece lengths form a histogram of at most `capacity` entries, whatever
the corpus size. Each bin takes the longest piece left and, by a bitset
subset-sum over the lengths still available, the fullest feasible combination
with it; the combination repeats as often as its pieces last. Pieces then find
their bin by their rank among pieces of equal length.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, slices, stage, text_buffers
from tickloom.llm.tokens import encoder

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """One row a piece; (part, nth) is its task and its rank among the task's
    pieces of that length."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        with encoder(vocabulary) as enc:
            for batch in batches:
                for rows in slices(batch, "text", 1 << 20):
                    ids, upto = enc.encode(*text_buffers(rows.column("text")))
                    ids = ids.astype("<u4")
                    total = np.diff(upto) + 1
                    count = -(-total // capacity)
                    head = total - (count - 1) * capacity
                    doc = np.repeat(np.arange(len(total)), count)
                    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                    length = np.where(piece == 0, head[doc], capacity)
                    last = piece == count[doc] - 1
                    raw = memoryview(ids).cast("B")
                    tail = END_ID.to_bytes(4, "little")
                    crc = []
                    for a, n, end in zip((upto[doc] + start).tolist(), length.tolist(), last.tolist()):
                        x = zlib.crc32(raw[4 * a : 4 * (a + n - end)])
                        crc.append(zlib.crc32(tail, x) if end else x)
                    order = np.argsort(length, kind="stable")
                    by_len = length[order]
                    new = np.concatenate(([True], by_len[1:] != by_len[:-1])) if len(by_len) else np.zeros(0, bool)
                    nth = np.empty(len(length), np.int64)
                    nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                    nth += seen[length]
                    seen += np.bincount(length, minlength=capacity + 1)
                    cols = [rows.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return arrow_map(docs.select("doc_id", "text"), run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths with the largest sum up to room,
    longer pieces first where several fit. reach holds, as bits, the sums that
    the lengths seen so far can make."""
    reach, trail = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            trail.append((reach, length, take))
            reach |= (reach << (take * length)) & limit
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            out += [length] * take
            at -= take * length
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) for the whole histogram."""
    left = {k: v for k, v in histogram.items() if v}
    plan = []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        bins = sorted([top, *fullest(rest, capacity - top)], reverse=True) if capacity > top and rest else [top]
        need = {k: bins.count(k) for k in set(bins)}
        times = min(left[k] // n for k, n in need.items())
        plan.append((times, bins))
        for k, n in need.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    table = stage(pieces(docs, vocabulary, capacity), "pieces")
    per_task = table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}

    # Runs of slots of one length: bins sequence..sequence+times-1 hold `each` of
    # them from `at` on. There are at most some capacity * log(capacity) runs.
    runs, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for times, bins in plan_bins(histogram, capacity):
        at = 0
        for length in dict.fromkeys(bins):
            each = bins.count(length)
            runs.append((length, used[length], sequence, each, at))
            used[length] += times * each
            at += each * length
        sequence += times
    runs.sort()
    run_len, run_from, run_seq, run_each, run_at = (np.array(x, np.int64) for x in (zip(*runs) if runs else [()] * 5))
    run_key = run_len << 44 | run_from

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("nth").to_numpy() + b.column("base").to_numpy()
            k = np.searchsorted(run_key, length << 44 | rank, "right") - 1
            step = rank - run_from[k]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(run_seq[k] + step // run_each[k]), pa.array(run_at[k] + step % run_each[k] * length)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    keyed = table.join(base.select("length", "part", "base"), ["length", "part"])
    return arrow_map(keyed.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "base"), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
