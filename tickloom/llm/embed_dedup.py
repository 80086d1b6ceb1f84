"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned onto the principal axes of their
second moments (from a bounded sample of rows; any orthogonal axes give right
bounds), so leading coordinates carry most of every cosine. Rows are dealt to blocks
by ranges of their leading coordinates. A tile compares two blocks: it sums the
products of the leading coordinates, adds as bound the product of the two remaining
norms, and goes on to the next coordinates only for pairs whose bound still reaches
the threshold. Survivors are compared exactly in double precision. Two blocks whose
ranges and remaining norms cannot reach the threshold make no tile.

Equal vectors are one class with a count. A tile gives the number of links of
each class and of each cluster one edge a member to its smallest: at most the rows
of its blocks, however dense a cluster is. The edges go through connected components.
Pairs of blocks are what grows with the square of the rows where vectors fill the
sphere evenly, as no range can tell them apart; BLOCK_BYTES keeps them few.

Defined cases: a null or zero vector, one with null or non-finite components, a
length without fellows or an id that is null links with nothing (component_id is
its own id); repeated rows count as vectors of their own; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, components, free_shuffles, stage
from tickloom.llm.vectors import blob, lists, usable

SLACK = 1e-5  # of the single-precision bounds
SAMPLE = 1 << 15  # rows, about, that the axes and the ranges are taken from
BLOCK_BYTES = 1 << 22  # of the vectors of a block
BOX = 16  # leading coordinates that a block's ranges are kept of


def sampled(classes: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE unit vectors, chosen by a hash."""
    share = min(1.0, SAMPLE / max(n, 1))
    some = classes.where(F.pmod(F.xxhash64("cid", F.lit(4)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([blob(x) for x in unit(lists(batch.column("v"))).astype(np.float32)], pa.binary())], ["x"])

    got = arrow_map(some, run, "x binary").toArrow().column("x").to_pylist()
    return np.frombuffer(b"".join(got), np.float32).reshape(len(got), -1).astype(np.float64)


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Axes by falling second moment."""
    m = x.T @ x
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


class Ranges:
    """Blocks as ranges of leading coordinates: the widest coordinate of a part is
    halved at its median until there are enough parts."""

    def __init__(self, x: np.ndarray, parts: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.parts = 0
        self.root = self._cut(x[:, :BOX], parts)

    def _cut(self, x: np.ndarray, parts: int) -> int:
        if parts <= 1 or len(x) < 2 or not (spread := x.max(0) - x.min(0)).max() > 0:
            self.parts += 1
            return -self.parts
        axis = int(spread.argmax())
        at = float(np.quantile(x[:, axis], (parts // 2) / parts))
        low = x[:, axis] < at
        if not low.any() or low.all():
            self.parts += 1
            return -self.parts
        k = len(self.nodes)
        self.nodes.append((axis, at, 0, 0))
        self.nodes[k] = (axis, at, self._cut(x[low], parts // 2), self._cut(x[~low], parts - parts // 2))
        return k

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            else:
                axis, at, a, b = self.nodes[node]
                low = x[rows, axis] < at
                todo += [(a, rows[low]), (b, rows[~low])]
        return out


def tiles(low: np.ndarray, high: np.ndarray, rest: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of blocks (i <= j) whose boxes of leading coordinates and largest
    remaining norms still allow a cosine of the threshold."""
    out = []
    for i in range(len(low)):
        most = np.maximum.reduce([low[i] * low[i:], low[i] * high[i:], high[i] * low[i:], high[i] * high[i:]]).sum(1) + rest[i] * rest[i:]
        # |a - b|^2 = 2 - 2 cos, and boxes that far apart hold no such pair.
        gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
        most = np.minimum(most, 1 - (gap * gap).sum(1) / 2)
        out += [(i, i + j) for j in np.flatnonzero(most >= threshold - 4 * SLACK).tolist()]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of two blocks of unit vectors with cosine >= threshold;
    within one block, i < j."""
    d = a.shape[1]
    ra, rb = (a @ axes).astype(np.float32), (b @ axes).astype(np.float32)
    lead = max(1, min(d, d // 4))
    rest = lambda r, k: np.sqrt(np.maximum(1 - (r[:, :k].astype(np.float64) ** 2).sum(1), 0)).astype(np.float32) + np.float32(SLACK)
    cut = np.float32(threshold - SLACK)
    sa, sb = rest(ra, lead), rest(rb, lead)
    hits_i, hits_j = [], []
    for s in range(0, len(a), 256):  # keep the bound matrix small
        i, j = np.nonzero(ra[s : s + 256, :lead] @ rb[:, :lead].T + sa[s : s + 256, None] * sb[None, :] >= cut)
        i += s
        if same:
            on = i < j
            i, j = i[on], j[on]
        hits_i.append(i)
        hits_j.append(j)
    i, j = np.concatenate(hits_i), np.concatenate(hits_j)
    out_i, out_j = [], []
    for s in range(0, len(i), 1 << 15):
        p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
        done, acc = lead, (ra[p, :lead] * rb[q, :lead]).sum(1)
        while done < d and len(p):
            more = min(d, done + max(8, d // 4))
            acc = acc + (ra[p, done:more] * rb[q, done:more]).sum(1)
            done = more
            keep = acc + (rest_at(ra, p, done) * rest_at(rb, q, done) if done < d else np.float32(2 * SLACK)) >= cut
            p, q, acc = p[keep], q[keep], acc[keep]
        ok = (a[p] * b[q]).sum(1) >= threshold
        out_i.append(p[ok])
        out_j.append(q[ok])
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *out_i]), np.concatenate([z, *out_j])


def rest_at(r: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    tail = r[rows, k:].astype(np.float64)
    return np.sqrt((tail * tail).sum(1)).astype(np.float32) + np.float32(SLACK)


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id) of every linked row that is not the smallest of its cluster."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        u, v = find(x), find(y)
        if u != v:
            low, high = (u, v) if ids[u] < ids[v] else (v, u)
            root[high] = low
    touched = np.unique(np.concatenate([i, j]))
    top = np.array([ids[find(x)] for x in touched.tolist()], np.int64)
    own = ids[touched]
    return own[own != top], top[own != top]


BLOCKS = "block long, n int, cids binary, ms binary, v binary, low binary, high binary, rest double"


def _builder(axes: np.ndarray):
    """One group's vectors as a block with its box and largest remaining norm."""

    def build(key, table):
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(table.num_rows, -1)
        turned = unit(v) @ axes
        box = turned[:, :BOX]
        rest = float(np.sqrt(np.maximum(1 - (box * box).sum(1), 0)).max()) + SLACK
        cols = [[key[0].as_py() << 24 | key[1].as_py()], [table.num_rows], [blob(np.asarray(table.column("cid")))], [blob(np.asarray(table.column("m")))], [blob(v)], [blob(box.min(0) - SLACK)], [blob(box.max(0) + SLACK)], [rest]]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return build


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    rows = stage(vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), (usable(vector_col) & F.col(id_col).isNotNull()).alias("ok")), "vectors")
    live = rows.where(F.col("ok") & F.exists("v", lambda x: x != 0)).select("id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), F.size("v").alias("dim"))
    classes = stage(live.groupBy("h1", "h2", "dim", "v").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("m")), "classes")
    forests = degrees = None
    schema = "kind int, x long, y long"
    for r in classes.groupBy("dim").count().collect():
        dim, n = r["dim"], r["count"]
        own = classes.where(F.col("dim") == dim)
        most = block_rows or max(256, BLOCK_BYTES // (8 * dim))
        some = sampled(own, n)
        axes = principal_axes(some) if len(some) else np.eye(dim)
        ranges = Ranges(some @ axes, -(-n // most)) if len(some) else Ranges(np.zeros((0, dim)), 1)

        def place(batches, axes=axes, ranges=ranges):
            for batch in batches:
                x = lists(batch.column("v"))
                yield pa.RecordBatch.from_arrays([pa.array(ranges.of((unit(x) @ axes)[:, :BOX])), batch.column("cid"), batch.column("m"), pa.array([blob(y) for y in x], pa.binary())], ["range", "cid", "m", "v"])

        # A range may hold more than a block's rows; those go to blocks of their own.
        placed = stage(arrow_map(own.select("cid", "m", "v"), place, "range long, cid long, m long, v binary"), "placed")
        sizes = {x["range"]: x["count"] for x in placed.groupBy("range").count().collect()}
        lots = spark.createDataFrame([(k, max(1, -(-c // (2 * most)))) for k, c in sizes.items()], "range long, lots long")
        dealt = placed.join(F.broadcast(lots), "range").withColumn("lot", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("lots")))

        parts = stage(dealt.select("range", "lot", "cid", "m", "v").groupBy("range", "lot").applyInArrow(_builder(axes), BLOCKS), "blocks")
        free_shuffles(spark)
        boxes = parts.select("block", "low", "high", "rest").orderBy("block").collect()  # a row a block
        low, high = (np.stack([np.frombuffer(b[c], np.float64) for b in boxes]) for c in ("low", "high"))
        wanted = [(boxes[i]["block"], boxes[j]["block"]) for i, j in tiles(low, high, np.array([b["rest"] for b in boxes]), threshold)]
        pairs = spark.createDataFrame(wanted, "a long, b long").repartition(max(12, min(len(wanted), 4096)), "a", "b")
        side = lambda x: parts.select(F.col("block").alias(x), F.col("cids").alias(f"c{x}"), F.col("ms").alias(f"m{x}"), F.col("v").alias(f"v{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").repartition(max(12, min(len(wanted), 4096)), "a", "b")

        def run(batches, axes=axes, dim=dim):
            for batch in batches:
                for r in batch.to_pylist():
                    same = r["a"] == r["b"]
                    ia, ib, ma, mb = (np.frombuffer(r[c], np.int64) for c in ("ca", "cb", "ma", "mb"))
                    va, vb = (np.frombuffer(r[c], np.float64).reshape(-1, dim) for c in ("va", "vb"))
                    xi, xj = tile_links(unit(va), unit(vb), axes, threshold, same)
                    da = np.bincount(xi, mb[xj], len(ia)).astype(np.int64)
                    db = np.bincount(xj, ma[xi], len(ib)).astype(np.int64)
                    ids = ia if same else np.concatenate([ia, ib])
                    x, y = stars(ids, xi, xj + (0 if same else len(ia)))
                    kind = np.concatenate([np.zeros((da > 0).sum() + (db > 0).sum(), np.int32), np.ones(len(x), np.int32)])
                    xs = np.concatenate([ia[da > 0], ib[db > 0], x])
                    ys = np.concatenate([da[da > 0], db[db > 0], y])
                    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["kind", "x", "y"])

        found = stage(arrow_map(met, run, schema), "links")
        free_shuffles(spark)
        deg, edge = found.where("kind = 0"), found.where("kind = 1")
        degrees = deg if degrees is None else degrees.unionByName(deg)
        forests = edge if forests is None else forests.unionByName(edge)
    if degrees is None:
        empty = spark.createDataFrame([], schema)
        degrees = forests = empty
    comp = components(forests.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    links = degrees.groupBy(F.col("x").alias("cid")).agg(F.sum("y").alias("others"))
    known = classes.select("h1", "h2", "v", "cid", "m").join(links, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("h1", "h2", "v", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    full = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.hash("v")))
    out = full.join(known, ["h1", "h2", "v"], "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))
