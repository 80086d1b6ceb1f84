"""Quality classifier by co-training.

Two views of a document: its text (character classes, word statistics, repeats
and hashed words) and its metadata (source, language, length). Each view has a
logistic model. In every round each view scores all unlabelled documents and hands
those it is surest about, in the proportion of the classes, to the other; both are
fitted again. Each view is then calibrated (Platt) on labelled documents that no
round saw, and the calibrated log odds, less the prior counted twice, score all
documents. A document is rejected below `threshold`.

Parameters of score() bound what comes to the driver: `labelled` rows by a hash of
doc_id, one a doc_id, and from each round the `give` surest documents of each view,
found among all unlabelled ones; texts with the same features are one of them.
Everything is done with every whole text.

Defined cases: a null text is an empty one, null metadata a value of its own;
labels with a null or without a document are ignored, several labels of a
document count as their smallest; where labels hold one class only or none,
every document gets that class's rate (1 without any) as score; repeated rows
are scored each; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, drop_table, slices, stage, text_buffers, word_hashes, word_spans

WORDS = 192  # buckets of hashed words
SOURCES, LANGS = 64, 16  # values with a feature of their own, the most frequent labelled ones
STATS = 19  # text features before the hashed words
WORD_RIDGE = 20.0

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed,
# 6 sentence marks, 7 quotes and brackets, 8 symbols, 9 bytes of other letters.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:!?"]] = 6
_CLASS[[ord(c) for c in "'\"()[]{}-"]] = 7
_CLASS[[ord(c) for c in "|$%&*#@<>=+~^_/\\`"]] = 8
_CLASS[128:] = 9


def text_features(col) -> np.ndarray:
    buf, off = text_buffers(col)
    n = len(off) - 1
    size = np.diff(off).astype(float)
    doc = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(doc * 10 + _CLASS[buf], minlength=n * 10).reshape(n, 10) / np.maximum(size, 1)[:, None]
    starts, ends, first = word_spans(buf, off)
    wh = word_hashes(buf, starts, ends)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    m = np.maximum(words, 1)
    mean = np.bincount(owner, length, n) / m
    var = np.bincount(owner, length * length, n) / m - mean * mean
    same = np.zeros(len(wh))
    same[1:] = (wh[1:] == wh[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner, same, n) / m
    order = np.lexsort((wh, owner))
    new = np.ones(len(wh))
    new[1:] = (wh[order][1:] != wh[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], new, n) / m
    bag = np.bincount(owner * WORDS + (wh % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    bag = np.log1p(bag) / np.log1p(m)[:, None]
    edge = np.bincount(owner, _CLASS[buf[np.maximum(ends - 1, 0)]] == 8, n) / m if len(wh) else np.zeros(n)
    stats = np.stack([mean / 8, np.sqrt(np.maximum(var, 0)) / 8, again, distinct, np.log1p(m) / 8, np.log1p(size) / 10, edge, (words == 0).astype(float)], axis=1)
    return np.hstack([kinds * 4, stats, np.minimum(kinds[:, 8:9] * 50, 5), bag])


def known_values(source: list, lang: list) -> tuple[dict, dict]:
    """The places of the sources and languages that get a feature; all others
    share one, nulls are a value like any other."""
    out = []
    for values, most in ((source, SOURCES), (lang, LANGS)):
        count = Counter("\0" if v is None else str(v) for v in values)
        out.append({v: i + 1 for i, (v, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most])})
    return out[0], out[1]


def meta_features(source, lang, n_chars, known: tuple[dict, dict]) -> np.ndarray:
    n = len(source)
    sizes = [len(k) + 1 for k in known]
    out = np.zeros((n, sum(sizes) + 3))
    for col, place, base in zip((source, lang), known, (0, sizes[0])):
        enc = pc.dictionary_encode(pc.fill_null(col.cast(pa.string()), "\0"))
        where = np.array([place.get(v, 0) for v in enc.dictionary.to_pylist()], np.int64)
        out[np.arange(n), base + where[np.asarray(enc.indices)]] = 1
    x = np.asarray(pc.fill_null(n_chars.cast(pa.float64()), -1.0))
    out[:, -3], out[:, -2], out[:, -1] = np.log1p(np.maximum(x, 0)) / 10, (np.log1p(np.maximum(x, 0)) / 10) ** 2, x < 0
    return out


def newton(z: np.ndarray, y: np.ndarray, pen: np.ndarray) -> np.ndarray:
    """Ridge logistic weights by Newton steps, halved until the loss falls."""

    def loss(w):
        r = z @ w
        return float(np.logaddexp(0, r).sum() - y @ r + 0.5 * (pen * w * w).sum())

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(30):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (p - y) + pen * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * abs(now) + 1e-9:
            break
    return w


class Logit:
    """A ridge logistic model and its Platt calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        pen = np.full(z.shape[1], ridge)
        pen[STATS : STATS + WORDS] *= WORD_RIDGE if z.shape[1] > STATS + WORDS else 1.0
        pen[-1] = 1e-6
        self.w, self.a, self.b = newton(z, y, pen), 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's slope and offset, with his smoothed targets."""
        r = self.raw(x)
        scale = max(float(r.std()), 1e-3)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = newton(np.stack([r / scale, np.ones(len(r))], 1), target, np.full(2, 1e-3))
        self.a, self.b = max(float(a) / scale, 0.0), float(b)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -12, 12)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


RAW = "doc_id long, h long, t binary, source string, lang string, n_chars double"


def _raw(docs: DataFrame) -> DataFrame:
    """Text features of every row, with a hash of them, beside its metadata."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [x.tobytes() for x in text_features(part.column("text")).astype(np.float32)]
                h = pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in rows], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), h, pa.array(rows, pa.binary()), *(part.column(c).cast(pa.string()) for c in ("source", "lang")), part.column("n_chars").cast(pa.float64())], [x.split()[0] for x in RAW.split(", ")])

    return arrow_map(docs.select("doc_id", "text", "source", "lang", "n_chars"), run, RAW)


def _views(rows: pa.Table | pa.RecordBatch, known) -> tuple[np.ndarray, np.ndarray]:
    """Both feature matrices of rows of _raw."""
    t = np.frombuffer(b"".join(rows.column("t").to_pylist()), np.float32).reshape(rows.num_rows, -1).astype(float)
    source, lang, n_chars = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows.column(c) for c in ("source", "lang", "n_chars")))
    return t, meta_features(source, lang, n_chars, known)


SURE = "view int, good boolean, odds double, h long"


def surest(pool: DataFrame, models, known, taken: list[int], many: tuple[int, int]) -> pa.Table:
    """(view, good) and the features of the rows, of all the pool, that each model
    is surest about: many[0] good and many[1] bad ones a view, one a feature hash.
    Every task passes on its own surest; no more than those are ranked."""
    gone = np.array(sorted(taken), np.int64)

    def run(batches):
        best = {(v, g): {} for v in (0, 1) for g in (False, True)}
        for batch in batches:
            h = np.asarray(batch.column("h"))
            free = ~np.isin(h, gone)
            for v, (m, x) in enumerate(zip(models, _views(batch, known))):
                r = m.raw(x)
                for g, on in ((False, free & (r < -1)), (True, free & (r > 1))):
                    k, at = many[0] if g else many[1], np.flatnonzero(on)
                    at = at[np.lexsort((h[at], -np.abs(r[at])))]
                    top = best[v, g]
                    for i in at[: 4 * k]:
                        top.setdefault(int(h[i]), float(r[i]))
                    if len(top) > k:
                        best[v, g] = dict(sorted(top.items(), key=lambda x: (-abs(x[1]), x[0]))[:k])
        rows = [(v, g, r, h) for (v, g), top in best.items() for h, r in top.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int32(), pa.bool_(), pa.float64(), pa.int64()))], ["view", "good", "odds", "h"])

    every = arrow_map(pool, run, SURE).distinct()
    order = Window.partitionBy("view", "good").orderBy(F.desc(F.abs("odds")), "h")
    ranked = every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.when(F.col("good"), many[0]).otherwise(many[1])).select("view", "good", "h").collect()
    if not ranked:
        return None
    # At most 2 * sum(many) rows, by the parameter `give`.
    picked = pool.sparkSession.createDataFrame([tuple(r) for r in ranked], "view int, good boolean, h long")
    met = pool.join(F.broadcast(picked), "h").groupBy("h", "view", "good").agg(F.min(F.struct("t", "source", "lang", "n_chars")).alias("x"))
    return met.select("h", "view", "good", "x.*").orderBy("view", "good", "h").toArrow()


def co_train(text, meta, y: np.ndarray, held: np.ndarray, ask, rounds: int, give: int):
    """Both views' models. held marks labelled rows kept for calibration; ask gives
    what the models are surest about among the unlabelled."""
    views, fit = (text, meta), ~held
    rate = float(y[fit].mean())
    many = max(1, round(give * rate)), max(1, round(give * (1 - rate)))
    extra = [[(v[fit], y[fit])] for v in views]
    taken: list[int] = []
    models = [Logit(*e[0]) for e in extra]
    for _ in range(rounds):
        got = ask(models, taken, many)
        if got is None:
            break
        rows, both, good, hashes = got
        for view in (0, 1):
            on = rows == view
            extra[1 - view].append((both[1 - view][on], good[on].astype(float)))
        taken += hashes.tolist()
        models = [Logit(np.vstack([x for x, _ in e]), np.concatenate([z for _, z in e])) for e in extra]
    for m, v in zip(models, views):
        m.calibrate(v[held], y[held])
    return models


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = 6000, rounds: int = 3, give: int = 400):
    """(text model, metadata model, prior log odds, known values), or a constant rate."""
    known_ids = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("double").alias("y"))
    some = known_ids.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # One row a doc_id, however often it is repeated; `labelled` rows at most.
    cols = ["text", "source", "lang", "n_chars"]
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *cols).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*cols)).alias("x"))
    chosen = stage(one.select("doc_id", "y", "x.*"), "labelled")
    got = _raw(chosen).join(chosen.select("doc_id", "y"), "doc_id").orderBy("doc_id").toArrow()
    y = np.asarray(got.column("y"))
    if len(y) < 10 or len(set(y)) < 2:
        return None, None, float(y.mean()) if len(y) else 1.0, None
    held = np.array([xxhash.xxh3_64_intdigest(int(d).to_bytes(8, "little", signed=True)) % 4 == 0 for d in np.asarray(got.column("doc_id"))])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 2 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None, None, float(y.mean()), None
    known = known_values(got.column("source").to_pylist(), got.column("lang").to_pylist())
    # Every row without a label, those without doc_id as well.
    pool = stage(_raw(docs.where("doc_id IS NOT NULL")).hint("merge").join(known_ids.select("doc_id"), "doc_id", "left_anti").unionByName(_raw(docs.where("doc_id IS NULL"))), "pool")

    def ask(models, taken, many):
        rows = surest(pool, models, known, taken, many)
        return None if rows is None else (np.asarray(rows.column("view")), _views(rows, known), np.asarray(rows.column("good")), np.asarray(rows.column("h")))

    models = co_train(*_views(got, known), y, held, ask, rounds, give)
    drop_table(pool)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    return models[0], models[1], float(np.log(rate / (1 - rate))), known


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, target: str = "quality", labelled: int = 6000, rounds: int = 3, give: int = 400) -> DataFrame:
    """The columns of docs with p_text, p_meta, p_quality and keep."""
    clash = [c for c in docs.columns if c in ("p_text", "p_meta", "p_quality", "keep")]
    docs = docs.drop(*clash)
    by_text, by_meta, prior, known = fit(docs, labels, target, labelled, rounds, give)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                if by_text is None:
                    p = pt = pm = np.full(n, prior)
                else:
                    a = by_text.odds(text_features(part.column("text")))
                    b = by_meta.odds(meta_features(part.column("source"), part.column("lang"), part.column("n_chars"), known))
                    pt, pm, p = sigmoid(a), sigmoid(b), sigmoid(a + b - prior)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pt), pa.array(pm), pa.array(p), pa.array(p >= threshold)], [*names, "p_text", "p_meta", "p_quality", "keep"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, schema + ", p_text double, p_meta double, p_quality double, keep boolean")
