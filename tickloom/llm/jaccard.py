"""N-gram Jaccard join with grouped prefixes.

A document is its set of hashed 5-word shingles. Documents with equal sets are
one class. All sets are sorted by one global order, rare shingles first: two
sets whose Jaccard similarity is 0.8 or more share a shingle among the first
n - ceil(0.8 n) + 1 of each. Classes with the same prefix and size are one
group; groups, not documents, are indexed by their prefix shingles.

A bucket (the groups with one prefix shingle) never emits all its pairs at once.
First every bucket compares its members with its smallest group only, and the
classes of a group with their smallest class; found links give components. Then
crowded buckets that still lie in several components compare a few chance partners
of each group, which joins those that are alike by way of others. At last members
of a bucket that are still in different components are paired, so a large group of
near copies costs some rows a member, and no link that could join two components
stays unread. Group pairs are filtered by size, by the places of the
shingle that brings them up, and by a bound on the overlap: how many prefix
shingles they share, plus what is left beyond. Those left expand to their classes,
which are verified on the whole sets.

The order needs no exact counts to be right: shingles that occur often within a
stretch of a partition are counted, and the 2^19 most frequent of the corpus (8
MB, a fixed bound) sort last, by count; all others sort by hash.

Defined cases: a null or empty text, or one of white space, has an empty set and
links with nothing; equal rows are one class; a row without doc_id is kept, its
component_id null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, components, drop_table, free_shuffles, mix64, shingle_sets, slices, stage, text_buffers

STRETCH = 1 << 21  # shingles looked at together for frequent ones
OFTEN = 2  # occurrences within a stretch that make a shingle a candidate
TABLE = 1 << 19  # shingles of the frequency table
CROWD, LOT, DEALS = 32, 9, 4  # members that make a bucket crowded, members of a lot, deals of a group


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _sets(part: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return shingle_sets(*text_buffers(part.column("text")), k)


def _digest(x: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        h = mix64(x ^ np.uint64(seed)).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(x))
    return int(np.int64(h.view(np.int64)))


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent shingles, TABLE at most."""

    def count(batches):
        held, size, known = [], 0, set()

        def out():
            flat, n = np.unique(np.concatenate(held), return_counts=True)
            on = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(flat[on].view(np.int64)), pa.array(n[on].astype(np.int64))], ["tok", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for x in _sets(part, k):
                    d = _digest(x, 1)
                    if len(x) and d not in known:
                        known.add(d)
                        held.append(x)
                        size += len(x)
                if size >= STRETCH:
                    yield out()
                    held, size, known = [], 0, set()
        if held:
            yield out()

    counted = stage(arrow_map(docs.select("text"), count, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")), "frequent")
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    floor_, held = None, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > TABLE:
            break
        floor_ = r["level"]
    if floor_ is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counted.where(level >= floor_).toArrow()
    tok, n = np.asarray(t.column("tok")).view(np.uint64), np.asarray(t.column("n"))
    order = np.argsort(tok)
    drop_table(counted)
    return tok[order], n[order]


def prefix(x: np.ndarray, table: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, tuple[int, int]]:
    """The prefix of a sorted set in the global order (shingles outside the table
    by hash, then those inside by count and hash), and its last entry's sort key."""
    tok, n = table
    m = prefix_length(len(x), percent)
    if not m:
        return x, (0, 0)
    if len(tok):
        at = np.minimum(np.searchsorted(tok, x), len(tok) - 1)
        often = tok[at] == x
        rare = int(len(x) - often.sum())
        if rare < m:
            order = np.argsort(n[at[often]], kind="stable")[: m - rare]
            hot = x[often][order]
            x = np.concatenate([x[~often], hot])
            return x, (int(n[at[often]][order[-1]]), int((hot[-1] ^ np.uint64(1 << 63)).view(np.int64)))
        x = x[~often]
    x = x[:m]
    return x, (0, int((x[-1] ^ np.uint64(1 << 63)).view(np.int64)))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in rows)])
    flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _blob(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = spark.sparkContext.broadcast(frequent_shingles(docs, k))

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part, k)
                heads, last = [], []
                for x in sets:
                    h, key = prefix(x, table.value, percent)
                    heads.append(h)
                    last.append(key)
                cols = [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), pa.array([_digest(x, 2) for x in sets], pa.int64()), pa.array([_digest(x, 3) for x in sets], pa.int64()), pa.array([_digest(h, 4) for h in heads], pa.int64()), pa.array([c for c, _ in last], pa.int64()), pa.array([h for _, h in last], pa.int64()), _lists(heads)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "s1", "s2", "g", "last_count", "last_hash", "prefix"])

    kinds = "doc_id long, n int, s1 long, s2 long, g long, last_count long, last_hash long, prefix array<long>"
    full = stage(arrow_map(docs, describe, kinds), "prefixes")
    all_ = stage(full.drop("prefix"), "sets")
    live = all_.where("n > 0 and doc_id is not null")
    # A class is named by its smallest doc_id, a group by its smallest class.
    classes = stage(live.groupBy("s1", "s2", "n", "g").agg(F.min("doc_id").alias("cid"), F.first("last_count").alias("last_count"), F.first("last_hash").alias("last_hash")), "classes")
    groups = stage(classes.groupBy("g", "n").agg(F.min("cid").alias("gid"), F.first("last_count").alias("last_count"), F.first("last_hash").alias("last_hash")), "groups")
    members = stage(classes.join(groups.select("g", "n", "gid"), ["g", "n"]).select("gid", "cid"), "members")

    head = full.withColumnRenamed("doc_id", "gid").join(groups.select("gid", "n", "g"), ["gid", "n", "g"], "left_semi")
    # place: the size in the upper 32 bits, the position in the prefix below.
    index = head.select(F.posexplode("prefix").alias("pos", "tok"), "gid", "n").select("tok", "gid", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place"))
    # Written between its two uses so that the join of a hot shingle can be split.
    shared = stage(index.groupBy("tok").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low < high").select("tok", "low"), "shared")
    free_shuffles(spark)
    index = stage(index.join(shared, "tok"), "index")
    drop_table(shared)
    free_shuffles(spark)

    # Round one: each bucket against its smallest group. Shingles of a pair whose
    # bucket has a smaller group are not counted here, so this may pass a pair by;
    # round two does not.
    star = index.where("gid <> low").groupBy(F.col("low").alias("a"), F.col("gid").alias("b")).agg(F.count(F.lit(1)).alias("both"))
    star = _bounded(star, groups, percent)
    within = members.where("gid <> cid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    spread = star.join(members.select(F.col("gid").alias("b"), F.col("cid").alias("y")), "b").select("a", F.col("y").alias("b"))
    tried = stage(spread.unionByName(within).distinct(), "tried")
    links = verify(tried, docs, k, percent)
    comp = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    free_shuffles(spark)

    placed, spans, mixed = _torn(index, members, comp, "mixed")
    drop_table(index)

    # Round two: buckets of more than CROWD groups still in several components are
    # dealt by a hash to lots of some LOT groups, and each lot compares all its pairs:
    # a few chance partners a group and bucket join what is alike, at a cost that
    # grows with the bucket and not with its square. Round three passes nothing by.
    sides = [_side(mixed.where(F.col("n") > CROWD).withColumn("lot", F.pmod(F.xxhash64("gid", "tok"), F.ceil(F.col("n") / LOT))), x, ["tok", "lot"]) for x in "ab"]
    chance = stage(_apart(*sides, ["tok", "lot"], percent), "chance")
    # Likewise the classes of a crowded group, in several deals as they share one key.
    crowd = placed.join(spans.where("c1 < c2").select("gid"), "gid")
    crowd = crowd.join(crowd.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD), "gid").withColumn("deal", F.explode(F.sequence(F.lit(1), F.lit(DEALS))))
    crowd = crowd.withColumn("lot", F.pmod(F.xxhash64("cid", "deal"), F.ceil(F.col("n") / LOT)))
    x, y = (crowd.select("gid", "deal", "lot", F.col("cid").alias(c), F.col("comp").alias(f"{c}comp")) for c in "ab")
    within = stage(x.join(y, ["gid", "deal", "lot"]).where("a < b and acomp <> bcomp").select("a", "b").distinct(), "chance_within")
    if not (chance.isEmpty() and within.isEmpty()):
        near = stage(_bounded(_shared(chance, head), groups, percent).unionByName(within).distinct(), "near")
        drop_table(chance)
        some = verify(near, docs, k, percent)
        comp = components(comp.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(some.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        before = mixed
        placed, spans, mixed = _torn(before, members, comp, "mixed_again")
        drop_table(before)
        free_shuffles(spark)

    # Round three: members of a bucket in different components.
    cross = _apart(_side(mixed, "a", ["tok"]), _side(mixed, "b", ["tok"]), ["tok"], percent)
    cross = stage(_bounded(_shared(cross, head), groups, percent), "cross")
    drop_table(full)
    sa, sb = (placed.select(F.col("gid").alias(x), F.col("cid").alias(f"{x}c"), F.col("comp").alias(f"{x}comp")) for x in "ab")
    pairs = cross.join(sa, "a").join(sb, "b").where("acomp <> bcomp").select(F.least("ac", "bc").alias("a"), F.greatest("ac", "bc").alias("b"))
    torn = placed.join(spans.where("c1 < c2").select("gid"), "gid")
    x, y = (torn.select("gid", F.col("cid").alias(c), F.col("comp").alias(f"{c}comp")) for c in "ab")
    inside = x.join(y, "gid").where("a < b and acomp <> bcomp").select("a", "b")
    seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = stage(pairs.unionByName(inside).distinct().join(seen, ["a", "b"], "left_anti"), "fresh")
    free_shuffles(spark)
    more = verify(fresh, docs, k, percent)
    edges = comp.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    final = components(edges)
    named = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").select("s1", "s2", "n", "g", F.coalesce("component", "cid").alias("component_id"))
    out = all_.join(named, ["s1", "s2", "n", "g"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def _torn(index: DataFrame, members: DataFrame, comp: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every class with its component, every group with the range of its classes'
    components, and the index rows (c1 and c2: that range, n: groups) of buckets
    whose groups lie in more than one."""
    placed = stage(members.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("gid", "cid", F.coalesce("component", "cid").alias("comp")), "placed")
    spans = placed.groupBy("gid").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    side = index.select("tok", "gid", "place").join(spans, "gid")
    torn = stage(side.groupBy("tok").agg(F.min("c1").alias("least"), F.max("c2").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("tok", "n"), name)
    return placed, spans, stage(side.join(torn, "tok"), f"{name}_side")


def _side(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Index rows as side x (a or b) of a join: xn its size, xp the place in its prefix."""
    return rows.select(*keys, F.col("gid").alias(x), F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.shiftright("place", 32).alias(f"n{x}"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"p{x}"))


def _apart(left: DataFrame, right: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs of groups with the same keys. Groups that lie whole in one and the same
    component need no look. Of those left, the first shingle a pair shares has all
    their overlap at or after it, so a shingle brings a pair up only where that many
    are still left on both sides."""
    on = f"a < b and not (a1 = a2 and b1 = b2 and a1 = b1) and least(na - pa, nb - pb) >= {_need(percent)}"
    return left.join(right, keys).where(on).select("a", "b").distinct()


def _shared(pairs: DataFrame, head: DataFrame) -> DataFrame:
    """pairs with the number of prefix shingles they share."""
    for x in "ab":
        pairs = pairs.join(head.select(F.col("gid").alias(x), F.col("prefix").alias(f"h{x}")), x)
    return pairs.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("both"))


def _bounded(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Group pairs (a, b, both: shingles their prefixes share) whose sizes and
    prefixes still allow the threshold.

    Up to the smaller of the two last prefix entries both sets are known. The set
    whose prefix ends there has ceil(percent / 100 * n) - 1 shingles left, so the
    overlap is at most both + that.
    """
    a, b = (groups.select(F.col("gid").alias(x), F.col("n").cast("long").alias(f"n{x}"), F.struct("last_count", "last_hash").alias(f"k{x}")) for x in "ab")
    rows = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    rest = f"(CASE WHEN ka <= kb THEN na ELSE nb END * {percent} + 99) div 100 - 1"
    return rows.where(f"both + {rest} >= {_need(percent)}").select("a", "b")


def _need(percent: int) -> str:
    """SQL: the least overlap of sets of na and nb entries that reaches the threshold."""
    return f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of doc_ids whose whole shingle sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(ids, "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _blob(_sets(part, k))], ["doc_id", "set"])

    whole = stage(arrow_map(texts, sets, "doc_id long, set binary"), "whole_sets")
    rows = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")

    def check(batches):
        for batch in batches:
            on = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(u), len(v)) >= percent * max(len(u), len(v), 1):
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    on[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(on))

    return arrow_map(rows.select("a", "b", "x", "y"), check, "a long, b long").distinct()
