"""Shared tables, connected components and numpy text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_folder

MASK64 = (1 << 64) - 1

# ---------------------------------------------------------------- tables


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from
    files that outlive any executor."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def drop_table(df: DataFrame) -> None:
    """Remove the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans already written."""
    gc.collect()
    spark._jvm.System.gc()


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def trim() -> None:
    """Give memory that this Python worker has freed back to the system: workers
    are reused, and what one keeps counts against its executor for good."""
    if _POWERS and len(_POWERS[0]) > SLICE + 4096:
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with batches of some 4 MB (unless the session states its own
    size) whose workers keep nothing once a task ends."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES, None) is None:
        conf.set(ARROW_BYTES, "4MB")

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(whole, schema)


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): smallest node reachable over edges(src, dst).

    Alternating large-star and small-star steps, each a partial minimum by node
    followed by a join, until the edges are stars around smallest nodes. Every round
    is written to the shared folder. Nodes without an edge are not returned.
    """
    cur = stage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(cur):
            break
        nxt = stage(_small_star(_large_star(cur)), "cc")
        drop_table(cur)
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(e: DataFrame) -> bool:
    """Whether every larger node has one edge and no smaller node is a larger one."""
    ends = e.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    hooked = e.join(low, e.u == low.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionAll(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


# ---------------------------------------------------------------- byte kernels

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
SLICE = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, SLICE + 4096)
        with np.errstate(over="ignore"):
            out = []
            for base in (_P, _PINV):
                a = np.full(m, np.uint64(base), np.uint64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    large = pc.fill_null(col.cast(pa.large_string()), "")
    bufs = large.buffers()
    off = np.frombuffer(bufs[1], np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space) and, for each
    document, the index of its first word (length documents + 1)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~_SPACE[buf]
    left = np.empty_like(w)
    left[0] = False
    left[1:] = w[:-1]
    first = off[:-1][off[:-1] < len(buf)]
    left[first] = False
    starts = np.flatnonzero(w & ~left)
    right = np.empty_like(w)
    right[-1] = False
    right[:-1] = w[1:]
    right[first[first > 0] - 1] = False
    ends = np.flatnonzero(w & ~right) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, in slices of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            up, down = _powers(hi - lo + 1)
            c = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((_LOWER[buf[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=c[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            i = j
    return mix64(out)


_STEP = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; the
    whole sequence as one where there are fewer words; empty without words."""
    starts, ends, first = word_spans(buf, off)
    wh = word_hashes(buf, starts, ends)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(len(wh) - k + 1, 0), np.uint64)
        for i in range(k):
            roll += wh[i : i + len(roll)] * (_STEP[i % 5] + np.uint64(2 * (i // 5)))
    roll = mix64(roll)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            x = np.sort(roll[a : b - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif b > a:
            h = b - a
            for w in wh[a:b].tolist():
                h = (h * 0xD1342543DE82EF95 + w + 1) & MASK64
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Consecutive row slices of a batch whose text holds about limit bytes; a
    longer document is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    end = np.cumsum(size)
    i = 0
    while i < n:
        base = end[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(end, base + limit, "right")))
        yield batch.slice(i, j - i)
        i = j
