"""Exact top-k search by inner product over a vector-approximation file.

Components become floor(64 x). The file is a stored table of cells, one byte a
component, on one grid for the whole corpus (equal-width cells between a
component's smallest and largest value), in lots of some LOT_ROWS rows. A query's
score over a row lies within the sum, over components, of the query's value times
its cell's bounds. The scan reads cells alone: each lot keeps, of a query, the rows
whose upper bound reaches the k-th best lower bound of the lot, and a rank over all
lots keeps those that reach the k-th best lower bound of the corpus. Exact vectors are
then read in falling order of upper bound: first k of them, whose worst exact
score closes the list; then only rows whose upper bound reaches that score.

Query blocks meet lots by an equi-join on a lot number that each query block is
written out for. Where there are fewer lots than cores, a lot is written out for
some groups of query blocks. Exact vectors meet only the candidates, by row number.

Defined cases: a vector that is null or holds null or non-finite components
takes no part; vectors of unequal lengths do not meet; ties go to the smaller
vec_id; repeated rows are candidates each, and queries each once by vec_id and
vector; fewer than k candidates give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, drop_table, free_shuffles, stage
from tickloom.llm.vectors import Blocks, blob, by_length, usable

CELLS = 255
LOT_ROWS, LOT_BYTES = 1 << 16, 1 << 23  # of a lot, whichever is less
SLICE = 4096  # rows of a lot looked at together
_SAFE = float(1 << 52)


def _numbered(base: DataFrame) -> DataFrame:
    """rid, id, dim and the vector as bytes, a row number of its own each."""

    def run(batches):
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for d, at, x in by_length(batch.column("v")):
                if d:
                    rid = n + np.arange(len(at))
                    n += len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(ids[at]), pa.array(np.full(len(at), d, np.int32)), pa.array([blob(r) for r in x.astype("<i8")], pa.binary())], ["rid", "id", "dim", "v"])

    return arrow_map(base, run, "rid long, id long, dim int, v binary")


def _matrix(batch: pa.RecordBatch):
    """(length, row numbers, matrix) of a batch of _numbered rows."""
    dim = np.asarray(batch.column("dim"))
    for d in np.unique(dim).tolist():
        at = np.flatnonzero(dim == d)
        yield d, at, np.frombuffer(b"".join(batch.column("v").take(pa.array(at)).to_pylist()), "<i8").reshape(len(at), d)


def grids(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: the smallest value and the cell width of every component. A
    task gives one row a length."""

    def run(batches):
        low, high = {}, {}
        for batch in batches:
            for d, _, x in _matrix(batch):
                low[d] = np.minimum(low.get(d, x[0]), x.min(0))
                high[d] = np.maximum(high.get(d, x[0]), x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array([blob(low[d]) for d in low], pa.binary()), pa.array([blob(high[d]) for d in low], pa.binary())], ["dim", "low", "high"])

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in arrow_map(vectors, run, "dim int, low binary, high binary").collect():
        a, b = (np.frombuffer(r[c], "<i8") for c in ("low", "high"))
        low, high = out.get(r["dim"], (a, b))
        out[r["dim"]] = np.minimum(low, a), np.maximum(high, b)
    return {d: (low.astype(np.float64), np.maximum((high.astype(np.float64) - low) / CELLS, 1e-9)) for d, (low, high) in out.items()}


FILE = "dim int, lot long, n long, rids binary, ids binary, cells binary"


def _packer(grid: dict):
    """A lot's rows as one row of cells."""

    def pack(rows: pa.Table) -> pa.Table:
        d = rows["dim"][0].as_py()
        low, width = grid[d]
        x = np.frombuffer(b"".join(rows["v"].to_pylist()), "<i8").reshape(-1, d)
        cells = np.clip((x - low) / width, 0, CELLS - 1).astype(np.uint8)
        out = [[d], [rows["lot"][0].as_py()], [len(x)], [blob(np.asarray(rows["rid"]))], [blob(np.asarray(rows["id"]))], [blob(cells)]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[c.split()[0] for c in FILE.split(", ")])

    return pack


def scan(cells: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    """(query index, row index, middle, slack) of the rows of a lot that may be among a
    query's k best of it, its own id left out: the score lies within middle
    +- slack."""
    q = queries.astype(np.float64)
    reach = np.abs(q)
    # Half a cell, and what rounding may take.
    slack = reach @ (0.5 * width) * (1 + 1e-9) + 1e-6 + 1e-12 * (reach @ (np.abs(low) + CELLS * width))
    step, base = q * width, (q @ (low + 0.5 * width))[:, None]
    own = {v: np.flatnonzero(q_ids == v) for v in np.intersect1d(ids, q_ids).tolist()}
    best = np.full((len(q), k), -np.inf)  # the k largest middles so far
    found = []
    for s in range(0, len(ids), SLICE):
        middle = step @ cells[s : s + SLICE].T.astype(np.float64) + base
        for at in np.flatnonzero(np.isin(ids[s : s + SLICE], q_ids)).tolist():
            middle[own[int(ids[s + at])], at] = -np.inf
        n = middle.shape[1]
        top = np.partition(middle, n - k, axis=1)[:, n - k :] if n > k else middle
        best = np.partition(np.hstack([best, top]), -k, axis=1)[:, -k:]
        i, j = np.nonzero((middle >= (best.min(1) - 2 * slack)[:, None]) & (middle > -np.inf))
        found.append((i, j + s, middle[i, j]))
    i, j, m = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    keep = m >= best.min(1)[i] - 2 * slack[i]
    return i[keep], j[keep], m[keep], slack[i[keep]]


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (query rid, query_id, rid) with vec_id and the exact score."""
    side = vectors.select(F.col("rid").alias("_q"), F.col("v").alias("x"))
    own = vectors.select(F.col("rid").alias("_r"), F.col("id").alias("vec_id"), F.col("v").alias("y"))
    rows = pairs.join(own, F.col("rid") == F.col("_r")).join(side, F.col("query") == F.col("_q"))

    def run(batches):
        for batch in batches:
            score = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                a, b = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                big = float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) >= _SAFE
                score.append(sum(int(i) * int(j) for i, j in zip(a.tolist(), b.tolist())) if big else int(a @ b))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("query_id"), batch.column("vec_id"), pa.array(score, pa.int64())], ["query", "query_id", "vec_id", "score"])

    return arrow_map(rows.select("query", "query_id", "vec_id", "x", "y"), run, "query long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lot_rows: int = LOT_ROWS, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query; queries
    are the rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    ints = F.transform(vector_col, lambda x: F.floor(F.lit(64.0) * x.cast("double")))
    base = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    exact = stage(_numbered(base), "vectors")
    grid = grids(exact)
    total = exact.count()
    lots = max(1, -(-total // max(1, min(lot_rows, LOT_BYTES // max(grid, default=1)))))
    file = stage(exact.withColumn("lot", F.pmod(F.xxhash64("rid"), F.lit(lots))).groupBy("dim", "lot").applyInArrow(_packer(grid), FILE), "cells")
    groups = max(1, -(-2 * spark.sparkContext.defaultParallelism // lots))
    # Rows that repeat an id and its vector ask once.
    asked = exact.where(F.col("id") % every == 0).groupBy("id", "dim", "v").agg(F.min("rid").alias("rid"))

    def gather(batches):
        held = Blocks(lambda d: query_rows)
        row = lambda d, rid, ids, x: pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([blob(c)], pa.binary()) for c in (rid, ids, x))], ["qdim", "qrids", "qids", "queries"])
        for batch in batches:
            rid, ids = np.asarray(batch.column("rid")), np.asarray(batch.column("id"))
            for d, at, x in _matrix(batch):
                for full in held.add(d, rid[at], ids[at], x):
                    yield row(d, *full)
        for d, rest in held.rest():
            yield row(d, *rest)

    ask = arrow_map(asked.select("rid", "id", "dim", "v"), gather, "qdim int, qrids binary, qids binary, queries binary").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    ask = ask.withColumn("group", F.pmod(F.xxhash64("qrids"), F.lit(groups)))
    dealt = file.select("dim", F.col("lot").alias("flot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("fgroup"), "rids", "ids", "cells")
    met = dealt.join(ask, F.expr("dim = qdim AND flot = lot AND fgroup = group")).select("dim", "rids", "ids", "cells", "qrids", "qids", "queries")

    def look(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                rid, ids, q_rid, q_ids = (np.frombuffer(r[c], np.int64) for c in ("rids", "ids", "qrids", "qids"))
                q, at, middle, slack = scan(np.frombuffer(r["cells"], np.uint8).reshape(-1, d), ids, q_ids, np.frombuffer(r["queries"], "<i8").reshape(-1, d), *grid[d], k)
                yield pa.RecordBatch.from_arrays([pa.array(q_rid[q]), pa.array(q_ids[q]), pa.array(rid[at]), pa.array(middle), pa.array(slack)], ["query", "query_id", "rid", "middle", "slack"])

    found = arrow_map(met, look, "query long, query_id long, rid long, middle double, slack double")
    # A query's slack is the same for all rows, so the order by middle is that of both bounds.
    order = Window.partitionBy("query").orderBy(F.desc("middle"), "rid")
    kth = F.max(F.when(F.col("n") == k, F.col("middle"))).over(Window.partitionBy("query"))
    ranked = found.withColumn("n", F.row_number().over(order)).withColumn("kth", kth)
    near = stage(ranked.where("kth IS NULL OR middle + slack >= kth - slack").drop("kth"), "candidates")
    free_shuffles(spark)
    first = stage(_exact(near.where(F.col("n") <= k), exact), "first_read")
    worst = first.groupBy("query").agg(F.min("score").alias("worst"))
    more = near.where(F.col("n") > k).join(worst, "query").where("middle + slack >= worst").select("query", "query_id", "rid")
    scored = first.unionByName(_exact(more, exact))
    drop_table(file)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
