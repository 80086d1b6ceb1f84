"""Mixing sources to target weights by the cube method.

Each source's target is its weighted share of all words, at most `ceiling` times
its own size, the excess reshared until none is above. A document's expected
copies r = target / size of its source split into whole copies and a probability
p that is equal within the source. The flight phase moves all p of a group along
vectors that leave its chosen words and chosen documents as they are (the null
space of those two constraints): the largest undecided document against all the
others, which share the counter-move, so large documents are settled while many
small ones can still make up for them. Every move is a fair game: its two ends
are drawn so that no p changes in the mean. The few smallest documents left land
together: their p is written as a mixture of outcomes, each the one nearest to
the words expected, and one outcome is drawn, so every p keeps its mean here too.
Only where that outcome misses the source's target by more than NEAR of it (a
source of few documents, or one made up of a huge one) the nearest of all outcomes
is taken instead: there the words count for more than the probabilities.

A source is cut into buckets of some BUCKET documents by a hash; what each bucket
leaves undecided flies again in buckets of the next level until a source is one
group. The draws come from a generator seeded by group, and so are independent of
the order; reruns agree.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source, after the others; rows that share a doc_id are documents of their own;
equal rows are counted before they are dealt, so a hot one is spread as well; an
empty table gives no rows; extra columns are kept out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 1000  # documents a bucket holds, about
LANDING = 12  # undecided documents of a source that land together
NEAR = 0.02  # of a source's target: the miss beyond which words go first


def word_targets(sizes: list[int], weights: list[float], ceiling: float) -> list[float]:
    """Targets of sources with these sizes: weighted shares of the total, none
    above ceiling * size."""
    target, free, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / whole > ceiling * sizes[i]]
        if not over:
            for i in free:
                target[i] = rest * weights[i] / whole
            break
        for i in over:
            target[i] = ceiling * sizes[i]
        rest -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def flight(p: np.ndarray, size: np.ndarray, draw: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move p to 0 or 1 while sum(size * p) and sum(p) stay and every p keeps its
    mean; at most `leave` entries (two or more) end between."""
    p, size = np.array(p, float), np.asarray(size, float)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-size[open_], kind="stable")]
    aside = np.zeros(0, np.int64)  # a document that no vector can move any more
    while len(open_) + len(aside) > leave or len(open_) > 1 and leave == 2:
        q, s = p[open_], size[open_]
        u = _direction(q, s)
        if u is None:
            if len(aside):
                break
            aside, open_ = open_[:1], open_[1:]
            continue
        with np.errstate(divide="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf))
        a, b = up.min(), down.min()
        # a with probability b / (a + b): the mean move is 0.
        first = draw.random() * (a + b) < b
        q = q + u * (a if first else -b)
        hit = (up if first else down) <= (a if first else b) * (1 + 1e-12)
        q = np.where(hit, np.round(q), np.clip(q, 0, 1))
        q[q < 1e-11], q[q > 1 - 1e-11] = 0, 1
        p[open_] = q
        open_ = open_[(q > 0) & (q < 1)]
    return p


def _direction(q: np.ndarray, s: np.ndarray) -> np.ndarray | None:
    """A move of the first entry by 1 that the others make up for in count and
    words, each by its room q (1 - q); None where there is none."""
    room = q[1:] * (1 - q[1:])
    total = room.sum()
    mean = (room * s[1:]).sum() / total
    off = s[1:] - mean
    spread = (room * off * off).sum()
    u = np.empty(len(q))
    u[0] = 1
    if s[1:].max() == s[1:].min():
        if s[0] != s[1]:
            return None
        u[1:] = -room / total
    else:
        u[1:] = -room * (1 / total + (s[0] - mean) * off / spread)
    return u


def land(p: np.ndarray, size: np.ndarray, draw: np.random.Generator, near: float = np.inf) -> np.ndarray:
    """Decide the open entries (LANDING at most), each with its p as mean: take the
    outcome v nearest in words, then in count, with the largest chance c that
    leaves p = c v + (1 - c) p' a p' within bounds; else go on from p', which has
    an entry less open and the same expected words as far as v met them. An outcome
    more than `near` words off gives way to the nearest one."""
    out, size = np.array(p, float), np.asarray(size, float)
    want, best = out @ size, None
    while len(open_ := np.flatnonzero((out > 0) & (out < 1))):
        q, s = out[open_], size[open_]
        v = (np.arange(1 << len(q))[:, None] >> np.arange(len(q)) & 1).astype(float)
        v = v[np.lexsort((np.abs(v.sum(1) - q.sum()).round(6), np.abs(v @ s - q @ s).round(6)))[0]]
        c = np.where(v > 0, q, 1 - q).min()
        if best is None:
            best = out.copy()
            best[open_] = v
        if draw.random() < c:
            out[open_] = v
        else:
            rest = np.clip((q - c * v) / (1 - c), 0, 1)
            rest[rest < 1e-11], rest[rest > 1 - 1e-11] = 0, 1
            out[open_] = rest
    return out if best is None or abs(out @ size - want) <= near else best


def _fly(rows: pa.Table, ids: tuple[str, ...], level: int, seed: int, last: bool) -> pa.Table:
    """One group's flight, and its landing where it is the source's last."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("size", *ids, "p")], null_placement="at_start"))
    name = f"{seed}|{level}|{rows['bucket'][0]}|{rows['key'][0]}"
    draw = np.random.default_rng(xxhash.xxh3_64_intdigest(name.encode()))
    size = rows["size"].to_numpy()
    p = flight(rows["p"].to_numpy(), size, draw, LANDING if last else 2)
    p = land(p, size, draw, NEAR * rows["target"][0].as_py()) if last else p
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))


def _pilot(ids: tuple[str, ...], level: int, seed: int, last: bool, cols: list[str]):
    return lambda rows: _fly(rows, ids, level, seed, last).select(cols)


FLOWN = "key string, {ids}, size long, source_size long, target double, whole long, buckets long, p double"


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0, seed: int = 8, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ids (whole numbers that name a document), size, source_size,
    target, taken and copies of every document.

    One row a source comes to the driver (a mixture names its sources).
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    sized = docs.select(*[F.col(c).cast("long").alias(c) for c in ids], key.alias("key"), size.alias("size"))
    sized = stage(sized.groupBy("key", *ids, "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    totals = sorted(((r["key"], r["words"], r["rows"]) for r in sized.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows")).collect()), key=lambda r: r[0].encode("utf-32-be"))
    goals = word_targets([n for _, n, _ in totals], [weights[i % len(weights)] for i in range(len(totals))], ceiling)
    rows, most = [], 1
    for (k, n, count), goal in zip(totals, goals):
        r = min(goal / n, ceiling) if n else 0.0
        whole = math.floor(r + 1e-12)
        buckets = -(-count // BUCKET)
        most = max(most, buckets)
        rows.append((k, n, goal, whole, max(r - whole, 0.0), buckets))
    per = spark.createDataFrame(rows, "key string, source_size long, target double, whole long, p double, buckets long")
    # One row a source, made on the driver: bounded by the mixture's own length.
    every = sized.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).join(F.broadcast(per), "key")
    schema = FLOWN.format(ids=", ".join(f"`{c}` long" for c in ids))
    cols = ["key", *ids, "size", "source_size", "target", "whole", "buckets", "p"]
    waiting, done, level = every.withColumn("h", F.xxhash64(*ids, "size", "nth", F.lit(seed))), None, 0
    while True:
        last = most == 1
        dealt = waiting.withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
        groups = dealt.select(*cols, "bucket").groupBy("key", "bucket")
        flown = groups.applyInArrow(_pilot(ids, level, seed, last, cols), schema)
        if not last:
            flown = stage(flown, "flown")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        got = flown if last else flown.where(~is_open)
        done = got if done is None else done.unionByName(got)
        if last:
            break
        # Every bucket leaves two at most: the next level has 2 / BUCKET times as many.
        level, most = level + 1, -(-2 * most // BUCKET)
        nxt = F.ceil(F.col("buckets") * 2 / BUCKET).cast("long")
        waiting = flown.where(is_open).withColumn("buckets", nxt).withColumn("h", F.xxhash64(*ids, "size", "p", F.lit(seed + level)))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return done.select(*ids, "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
