"""Every operator against a brute-force version on the smallest tables and on
hand-made rows with nulls, empties, ties, repeats and clashing columns."""

import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import binary_tokens, chat, embed_dedup, jaccard, lines, mixing, packing, pii, quality, tokens, topk
from tickloom.llm.common import components, table_path, text_buffers

SF = "/root/testdata/sf0.001"
VOC = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, n int, key string, block int"
EXTRA = ("x", 1, "k", 2)


@functools.lru_cache
def lib():
    return Tokenizer.from_file(VOC)


LONG = "word another thing " * 3000
ODD = [
    (1, "One two three four five six seven\nsecond line", "en", "a", 44, *EXTRA),
    (2, "One two three four five six seven\nsecond line", "en", "a", 44, *EXTRA),
    (2, "One two three four five six seven\nsecond line", "en", "a", 44, *EXTRA),
    (3, None, None, None, None, *EXTRA),
    (4, "", "en", "b", 0, *EXTRA),
    (5, " \t\n ", "en", "b", 4, *EXTRA),
    (None, "no id here at all", "en", "b", 17, *EXTRA),
    (6, LONG, "en", "b", len(LONG), *EXTRA),
    (7, "tiny", "en", "c", 4, *EXTRA),
    (8, "tiny  TINY", "en", None, 10, *EXTRA),
    (9, "a@b.co and a@b.co, 10.0.0.300 1.2.3.4 <|endoftext|> é　x", "fr", "c", 50, *EXTRA),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {n: r for n, r in union_find(edges, {x for e in edges for x in e}).items()}
    assert rows(components(spark.createDataFrame([], "src long, dst long"))) == []


# ---------------------------------------------------------------- vectors


def vector_rows():
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 8))
    vecs = [*base, *(base + 0.05 * r.standard_normal(base.shape)), *base[:6]]
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    out += [(200, None), (201, [float("nan")] + [1.0] * 7), (202, [None] + [1.0] * 7), (203, [0.0] * 8), (None, [1.0] * 8), (0, out[0][1]), (300, [1.0, 2.0]), (320, [1.0, 2.5]), (340, [float("inf")] * 8), (360, [])]
    return out


@pytest.mark.parametrize("source", ["odd", "table"])
def test_top_k_is_exact(spark, source):
    if source == "odd":
        data = vector_rows()
        df = spark.createDataFrame([(*x, 1, 2) for x in data], "vec_id long, embedding array<float>, label int, id int")
    else:
        df = spark.read.parquet(f"{SF}/embeddings.parquet")
        data = rows(df.select("vec_id", "embedding"))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in good:
        if q % 20 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:20]
            want.setdefault((q, tuple(v)), [(i, -s) for s, i in hits])
    got = defaultdict(list)
    for r in topk.top_k(df, lot_rows=32, query_rows=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: w for (q, _), w in want.items() if w}


def test_top_k_of_huge_components_and_nothing(spark):
    df = spark.createDataFrame([(20, [1e14, 1.0]), (1, [1e14, 3.0]), (2, [1e14, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):  # the score no longer fits a long
        topk.top_k(df).collect()
    assert rows(topk.top_k(df.where("vec_id < 0"))) == []


@pytest.mark.parametrize("source", ["odd", "table"])
def test_embedding_links(spark, source):
    if source == "odd":
        data = vector_rows()
        df = spark.createDataFrame([(*x, 1, 2) for x in data], "vec_id long, embedding array<float>, m int, v int")
    else:
        df = spark.read.parquet(f"{SF}/embeddings.parquet")
        data = rows(df.select("vec_id", "embedding"))
    ok = [k for k, (i, v) in enumerate(data) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, pairs = defaultdict(int), []
    for a in ok:
        for b in ok:
            u, w = np.array(data[a][1]), np.array(data[b][1])
            if a != b and len(u) == len(w) and u @ w / math.sqrt((u @ u) * (w @ w)) >= 0.9:
                links[a] += 1
                pairs.append((data[a][0], data[b][0]))
    comp = union_find(pairs, {i for i, _ in data if i is not None})
    want = sorted(((i, links[k], comp.get(i), comp.get(i) == i if i is not None else True) for k, (i, _) in enumerate(data)), key=str)
    assert sorted(rows(embed_dedup.near_duplicates(df, block_rows=16)), key=str) == want
    assert rows(embed_dedup.near_duplicates(df.where("vec_id < -5"))) == []


# ---------------------------------------------------------------- tokens


def expected_ids(text):
    return [*lib().encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_files_round_trip(spark, request, which):
    df = request.getfixturevalue(which)
    blocks, by_rank = binary_tokens.write_binary(df, VOC, table_path(spark, "t"))
    got = rows(binary_tokens.read_binary(blocks, by_rank).orderBy("start"))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    ids = [(r[0] if r[0] is not None else -1) for r in got]
    assert ids == sorted(ids)
    want = sorted((-1 if d is None else d, len(i := expected_ids(t)), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in rows(df.select("doc_id", "text")))
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == want


def test_literal_special_tokens_and_odd_text_equal_the_library():
    r = np.random.default_rng(12)
    bits = ["<|endoftext|>", "<|endoftext|", "|>", "<", " ", "  ", "\n", "\r\n", "\t", "end", "Of", ".", ",", "é", "　", "🙂", "'s", "12", "\u0085", "<|endoftext|><|endoftext|>"]
    texts = ["".join(bits[i] for i in r.integers(0, len(bits), int(r.integers(0, 12)))) for _ in range(3000)]
    texts[0:3] = ["end <|endoftext|> of", "<|endoftext", "|> a"]  # no token across two documents
    buf, off = text_buffers(pa.array(texts))
    with tokens.encoder(VOC) as enc:
        ids, upto = enc.encode(buf, off)
    assert ids[: upto[1]].tolist() == [437, 220, 50256, 286]
    for t, a, b in zip(texts, upto[:-1].tolist(), upto[1:].tolist()):
        assert ids[a:b].tolist() == lib().encode(t, add_special_tokens=False).ids, t


def test_pack_bytes():
    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7, 9], np.uint32)
    control, data = binary_tokens.pack(v)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 + 1 + 1
    assert binary_tokens.unpack(control, data, len(v)).tolist() == v.tolist()


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(spark, request, which):
    df = request.getfixturevalue(which)
    cap = 256
    got = packing.pack(df, VOC, cap).toPandas()
    want = []
    for d, t in rows(df.select("doc_id", "text")):
        ids = expected_ids(t)
        head = (len(ids) - 1) % cap + 1
        cuts = [0, *range(head, len(ids) + 1, cap)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((-1 if d is None else d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[cols].fillna(-1).astype(int).values.tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= cap
    assert got["sequence_id"].nunique() <= 1.03 * got["length"].sum() / cap + 1
    assert len(packing.pack(df.where("1 = 0"), VOC, cap).collect()) == 0


def test_fullest_is_the_largest_sum():
    r = np.random.default_rng(3)
    for _ in range(60):
        counts = {int(x): int(r.integers(1, 4)) for x in r.integers(3, 40, 5)}
        room = int(r.integers(5, 90))
        sums = {0}
        for k, n in counts.items():
            sums = {s + i * k for s in sums for i in range(n + 1) if s + i * k <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(k) <= counts[k] for k in set(got))


# ---------------------------------------------------------------- near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check_join(df):
    data = rows(df.select("doc_id", "text"))
    sets = [(d, shingles(t)) for d, t in data]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y)]
    comp = union_find(pairs, {d for d, _ in data if d is not None})
    got = sorted(rows(jaccard.near_duplicates(df)), key=str)
    assert got == sorted(((d, len(s), comp.get(d)) for d, s in sets), key=str)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_jaccard_join(request, which):
    check_join(request.getfixturevalue(which))


def test_jaccard_join_of_many_near_copies(spark, monkeypatch):
    """A chain of copies, each some words further, and a passage all share."""
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(120)]
    text, out = list(words), []
    shared = " ".join(f"s{i}" for i in range(30))
    for i in range(60):
        text = list(text)
        text[int(r.integers(120))] = f"x{i}"
        out.append((i, " ".join(text)))
    out += [(100 + i, shared + " " + " ".join(f"u{i}_{k}" for k in range(int(r.integers(2, 40))))) for i in range(40)]
    monkeypatch.setattr(jaccard, "OFTEN", 4)
    check_join(spark.createDataFrame(out, "doc_id long, text string"))
    monkeypatch.setattr(jaccard, "CROWD", 2)
    monkeypatch.setattr(jaccard, "LOT", 2)
    check_join(spark.createDataFrame(out, "doc_id long, text string"))


def test_jaccard_join_of_crowded_buckets_and_groups(spark, monkeypatch):
    """Texts that share most shingles, a part of them linked in chains, with few
    equal to the smallest of their bucket; and equal prefixes with unlike rests."""
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(160)]
    out = []
    for i in range(90):
        cut, n = int(r.integers(0, 60)), int(r.integers(60, 100))
        out.append((i, " ".join(words[cut : cut + n] + [f"e{i % 30}_{k}" for k in range(int(r.integers(0, 12)))])))
    monkeypatch.setattr(jaccard, "CROWD", 4)
    monkeypatch.setattr(jaccard, "LOT", 3)
    check_join(spark.createDataFrame(out, "doc_id long, text string"))
    # Every shingle is frequent and all of one count: prefixes are the same ones.
    monkeypatch.setattr(jaccard, "prefix", lambda x, table, percent: (np.sort(x)[: jaccard.prefix_length(len(x), percent)], (0, int((np.sort(x)[jaccard.prefix_length(len(x), percent) - 1] ^ np.uint64(1 << 63)).view(np.int64)))) if len(x) else (x, (0, 0)))
    check_join(spark.createDataFrame(out, "doc_id long, text string"))


def test_jaccard_join_of_nothing(odd):
    assert rows(jaccard.near_duplicates(odd.where("1 = 0"))) == []


# ---------------------------------------------------------------- lines


def brute_lines(data, lines_=3, words=50):
    """Windows by trying every run of every document."""
    seqs = {}
    for d, t in data:
        kept = [x for x in (t or "").split("\n") if x.strip(" \t\r\v\f")]
        seqs[(d, t)] = kept
    places = defaultdict(list)
    for (d, t), seq in seqs.items():
        full = lambda s, e: e - s + 1 >= lines_ or sum(len(x.split()) for x in seq[s : e + 1]) >= words  # noqa: E731,B023
        for s in range(len(seq)):
            for e in range(s, len(seq)):
                if full(s, e) and not (e > s and full(s, e - 1) and full(s + 1, e)):
                    places[tuple(seq[s : e + 1])].append((d, t, s, e))
    return seqs, places


def test_line_dedup(spark, docs):
    data = rows(docs.select("doc_id", "text"))
    seqs, places = brute_lines(data)
    dead = defaultdict(set)
    for at in places.values():
        for d, t, s, e in sorted(at)[1:]:
            dead[(d, t)] |= set(range(s, e + 1))
    want = {d: (len(seqs[(d, t)]), len(dead[(d, t)])) for d, t in data}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(docs).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 0


def test_copies_of_a_window_share_a_fingerprint():
    r = np.random.default_rng(8)
    for _ in range(300):
        run = [int(x) for x in r.integers(0, 6, 14)]
        size = {h: 1 + 13 * h for h in range(6)}  # a line's words follow from it
        selected, windows = defaultdict(set), 0
        for s, e in (found := lines.line_windows([size[h] for h in run], 3, 50)):
            windows += 1
        for p, spans in lines.fingerprints(run, found).items():
            for s, e in spans:
                assert run[p] == min(run[s : e + 1])
                selected[tuple(run[s : e + 1])].add(p - s)
        assert all(len(x) == 1 for x in selected.values())
        assert len(lines.fingerprints(run, found)) <= windows


def test_line_dedup_rules(spark):
    long = " ".join(f"w{i}" for i in range(55))
    data = [(1, f"a\nb\nc\nd\n\n{long}"), (2, "x\na\nb\nc\ny"), (3, f"q\n{long}\nr"), (4, "a\nb"), (5, None), (5, ""), (6, "b\nc\nd"), (6, "b\nc\nd"), (None, "k\nl\nm")]
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame([(*x, 0, 1) for x in data], "doc_id long, text string, n_lines int, e int")).collect()}
    assert (2, "x\ny", 3) in got and (3, "q\nr", 1) in got and (4, "a\nb", 0) in got and (5, None, 0) in got
    assert (6, "", 3) in got and (None, "k\nl\nm", 0) in got
    assert rows(lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))) == []


# ---------------------------------------------------------------- mixing


def test_targets():
    assert mixing.word_targets([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    got = mixing.word_targets([10, 1000, 0, 500], [5, 2, 1, 5], 3)
    assert got[0] == 30 and got[2] == 0 and sum(got) == pytest.approx(1510) and got[3] == pytest.approx(1480 * 5 / 7)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).toPandas()
    size = {}
    for d, t, s in rows(df.select("doc_id", "text", "source")):
        size.setdefault(s, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert len(got) == df.count() and (got["taken"] <= 3 * got["size"]).all()
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    goal = mixing.word_targets([sum(size[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    assert sorted(set(got["target"].round(6))) == sorted({round(g, 6) for g in goal})
    for (target, _), g in got.groupby(["target", "source_size"]):
        if which == "docs" and 0 < target < 3 * g["source_size"].iloc[0]:
            assert abs(g["taken"].sum() - target) <= 0.03 * target + g["size"].min()
    again = mixing.mix(df).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, got[key].values.tolist()))
    assert mixing.mix(df.where("1 = 0")).count() == 0


def test_flight_keeps_both_totals():
    r = np.random.default_rng(5)
    size = r.integers(1, 500, 300)
    p = mixing.flight(np.full(300, 0.3), size, r)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(90) and p @ size == pytest.approx(0.3 * sum(size))
    out = mixing.land(p, size, r)
    assert set(out) <= {0, 1} and abs(out @ size - 0.3 * sum(size)) <= 20
    assert mixing.flight(np.full(5, 0.4), np.full(5, 7), r).sum() == pytest.approx(2)
    assert len(mixing.flight(np.zeros(0), np.zeros(0), r)) == 0


@pytest.mark.parametrize("p, giant", [(0.3, 0), (0.7, 4000)])
def test_every_document_keeps_its_probability(p, giant):
    """Over 2000 seeds: each document, and each fifth by size, within 4.5 and 4
    standard errors of p; one document is most of a tenth of all words."""
    size = np.round(np.exp(np.random.default_rng(7).normal(4, 1.2, 120))).astype(int)
    size[0] = giant or size[0]
    runs = 2000
    out = np.empty((runs, 120))
    for seed in range(runs):
        draw = np.random.default_rng(10_000 + seed)
        out[seed] = mixing.land(mixing.flight(np.full(120, p), size, draw, mixing.LANDING), size, draw)
    assert np.abs(out.mean(0) - p).max() <= 4.5 * math.sqrt(p * (1 - p) / runs)
    for fifth in np.argsort(size).reshape(5, 24):
        rate = out[:, fifth].mean(1)
        assert abs(rate.mean() - p) <= 4 * rate.std() / math.sqrt(runs)


def test_mixing_of_many_equal_rows_and_levels(spark, monkeypatch):
    """A hot repeated row, rows without id, and several levels of buckets."""
    monkeypatch.setattr(mixing, "BUCKET", 8)
    big = (1 << 62) + 1  # keeps all its digits beside rows without id
    data = [(big, "a b c", "x")] * 300 + [(None, "a b", "x")] * 100 + [(i, "w " * (1 + i % 40), "x" if i % 3 else "y") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 900 and (got["taken"] <= 3 * got["size"]).all()
    for _, g in got.groupby("target"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 40
    equal = pd.DataFrame(mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).where(F.col("doc_id") == big).collect(), columns=got.columns)["taken"]
    assert len(equal) == 300 and equal.nunique() > 1


# ---------------------------------------------------------------- chats


def test_chats(spark):
    t = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (6, None, "user", "x"), (6, 1, "user", "y"), (6, 1, "user", "y"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*x, 1, "z") for x in t], "conv_id long, turn int, role string, text string, n int, k string")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(df).collect()}
    turn = lambda r, x: f"<|im_start|>{r}\n{x}<|im_end|>\n"
    assert got == {2: (2, turn("user", "hi") + turn("assistant", "yes")), 4: (2, turn("user", "hi") + turn("assistant", "no")), 5: (1, turn("", "")), 6: (2, turn("user", "x") + turn("user", "y"))}
    assert rows(chat.format_chats(df.where("1 = 0"))) == []


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.score(docs, train).join(test.select("doc_id", "quality"), "doc_id").select("keep", "quality").toPandas()
    right = (got["keep"] == (got["quality"] == 1)).mean()
    assert right >= 0.97 and got[got["quality"] == 1]["keep"].mean() >= 0.98
    assert (~got[got["quality"] == 0]["keep"]).mean() >= 0.8


def test_quality_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(odd, none).toPandas()
    assert len(got) == len(ODD) and got["keep"].all() and list(got.columns[:9]) == odd.columns
    some = spark.createDataFrame([(1, 1, 0), (1, None, 0), (4, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, some)["keep"] is not None and quality.score(odd, some).count() == len(ODD)
    assert quality.score(odd.where("1 = 0"), some).count() == 0
    many = spark.createDataFrame([(i, f"good text number {i}." if i % 2 else "| | $ $ | $ |", None, None, None) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    out = {r["doc_id"]: r["keep"] for r in quality.score(many, lab).collect()}
    assert [out[i] for i in range(240, 300)] == [bool(i % 2) for i in range(240, 300)]


# ---------------------------------------------------------------- personal data

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = np.random.default_rng(6)
    bits = ["a", "b.c", "@", "@@", "x@y.z", ".", "..", "1", "12", "255", "300", "0000300", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+1 (858) 555-7280", "+", "-", " ", "\n", "é", "🙂", "%", "_", "a@b-c.d-e.f", "00", "1.1.1.1.1.1"]
    for _ in range(4000):
        text = "".join(bits[i] for i in r.integers(0, len(bits), int(r.integers(1, 14))))
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data_digest(spark, odd, docs):
    for df in (odd, docs):
        for r in pii.digest(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(r["text"] or ""))
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            spans = [x for x in r["spans"].split(",") if x]
            assert set(x for x in base.split(",") if x) <= set(spans)
            for k in pii.KINDS:
                assert r[f"n_{k}"] == sum(x.startswith(k + ":") for x in spans)
    assert rows(pii.digest(odd.where("1 = 0"))) == []
    out = {r["doc_id"]: r["text"] for r in pii.redact(odd).collect()}
    assert out[9].startswith("[EMAIL] and [EMAIL], 10.0.0.300 [IP]") and out[3] is None


def test_tagger_on_held_out_rows():
    model = pii.trained()
    ids, tags = pii.training_rows(300, seed=999)
    got = model.decode(ids)
    spans = lambda row: {(int(k), int(p)) for p, k in enumerate((row + 1) // 2) if k}
    hit = made = true = 0
    for a, b in zip(got.astype(int), tags):
        x, y = spans(a), spans(b)
        hit, made, true = hit + len(x & y), made + len(x), true + len(y)
    assert hit / made > 0.93 and hit / true > 0.93


def test_tagger_gradient():
    model = pii.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, tags = pii.training_rows(3, 2, 12)
    _, g = model.loss(ids, tags)
    for name, at in (("wf", (3, 5)), ("wb", (12, 30)), ("wo", (4, 2)), ("tr", (0, 3)), ("bf", (20,)), ("emb", (int(ids[0, 3]), 2))):
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = model.loss(ids, tags)[0]
        model.p[name][at] = old - 1e-5
        down = model.loss(ids, tags)[0]
        model.p[name][at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=2e-2, abs=2e-4), name


def test_model_adds_forms_the_patterns_miss_and_leaves_clean_text():
    model = pii.trained()
    call = "hethe tion (858) 555-7280 thand the ering. "
    clean = "Licensed under CC BY-NC 4.0. In 2024 there were 17 of 300 thand, v2.1 and 12%. " * 3
    (base, spans), (_, none) = pii.find([call, clean], model)
    assert not base and [s[1] for s in spans] == [3] and none == []


def planted(n, length, share, seed):
    forms = pii.Forms(seed)
    for _ in range(n):
        text, tags = pii.labelled_text(forms, length, share)
        yield text, set(pii.runs(np.array(tags)))


def test_added_spans_on_planted_forms_that_no_pattern_meets():
    """Recall of every kind at least 0.9 and precision at least 0.95, over forms of
    another seed than the training's."""
    model = pii.trained()
    texts, gold = zip(*planted(300, 600, 0.05, 4321))
    hit, true, made, right = Counter(), Counter(), 0, 0
    for want, (base, spans) in zip(gold, pii.find(list(texts), model)):
        missed = [w for w in want if not any(a < w[2] and w[0] < b for a, _, b in base)]
        added = set(spans) - set(base)
        true.update(k for _, k, _ in missed)
        hit.update(w[1] for w in missed if w in added)
        made, right = made + len(added), right + len(added & want)
    assert set(true) == set(range(5)) and all(hit[k] >= 0.9 * true[k] for k in true)
    assert right >= 0.95 * made and made > 300


def test_personal_data_anywhere_in_very_long_texts():
    """Spans at window and piece borders, in a text of several pieces with digits."""
    model = pii.trained()
    filler = "hethe tion 17 thand the 300 ering, at the end. "
    text = (filler * (2 * pii.PIECE // len(filler) + 40))[: 2 * pii.PIECE + 900]
    parts, want = [], []
    for at in (0, 90, 127, 500, pii.PIECE - pii.SEAM - 8, pii.PIECE - pii.SEAM // 2 - 8, pii.PIECE - 9, 2 * pii.PIECE - 700, 2 * pii.PIECE + 880):
        want.append(at)
    for a, b in zip(want, [*want[1:], len(text)]):
        call = " (858) 555-7280 "
        parts.append(call + text[a + len(call) : b])
    got = {s for s, k, _ in pii.find(["".join(parts)], model)[0][1] if k == 3}
    assert sum(a + 1 in got for a in want) >= len(want) - 1 and len(got) <= len(want) + 1


def test_no_stretch_that_holds_a_span_is_passed_by(monkeypatch):
    model = pii.trained()
    texts = [t for t, _ in planted(40, 2000, 0.03, 99)]
    some = pii.model_spans(texts, model)
    monkeypatch.setattr(pii, "could_hold", lambda em, first, tr: np.ones(em.shape[1], bool))
    assert pii.model_spans(texts, model) == some


def test_best_path_equals_a_plain_search():
    r = np.random.default_rng(8)
    model = pii.Tagger(3)
    model.p["tr"] = r.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    em = r.standard_normal((4, 3, pii.TAGS)).astype(np.float32)
    paths = np.array(list(itertools.product(range(pii.TAGS), repeat=4)))
    moves = model.p["tr"][paths[:, :-1], paths[:, 1:]].sum(1)
    for row, got in enumerate(model.viterbi(em).tolist()):
        assert got == paths[(em[np.arange(4), row, paths].sum(1) + moves).argmax()].tolist()


def test_stretches_of_all_lots_are_decoded_together(monkeypatch):
    """However many lots the texts take, their stretches share a few Viterbi passes."""
    model, calls, plain = pii.trained(), [], pii.Tagger.viterbi
    monkeypatch.setattr(pii.Tagger, "viterbi", lambda self, em: calls.append(em.shape) or plain(self, em))
    texts = [t for t, _ in planted(60, 3000, 0.01, 5)]
    some = pii.model_spans(texts, model)
    few = len(calls)
    monkeypatch.setattr(pii, "PIECE", 1 << 12)
    monkeypatch.setattr(pii, "LOT", 1 << 12, raising=False)
    calls.clear()
    assert pii.model_spans(texts, model) == some and sum(map(len, some)) > 50
    assert few < 12 and len(calls) < 12


def test_one_product_a_step_serves_both_directions(monkeypatch):
    calls, plain = [], np.matmul
    monkeypatch.setattr(pii.np, "matmul", lambda *a, **b: calls.append(1) or plain(*a, **b))
    r = np.random.default_rng(12)
    model = pii.Tagger(3)
    for rows_, t in ((1, 1), (3, 2), (5, 7), (40, 64)):
        ids = r.integers(0, pii.CHARS, (rows_, t))
        calls.clear()
        got = model.emissions(ids).transpose(0, 2, 1)
        assert len(calls) <= t + 1 and np.allclose(got, model.scores(ids)[0], atol=1e-4)
    model.p = {k: v * 200 for k, v in model.p.items()}  # gates shut or open, exp overflows
    with np.errstate(over="ignore"):
        want = model.scores(ids)[0]
    assert np.allclose(model.emissions(ids).transpose(0, 2, 1), want, rtol=1e-3, atol=1)


def test_blocks_that_a_span_could_gain_in_are_hot():
    """Against all runs of places, one by one; scores of blocks are means where windows meet."""
    r = np.random.default_rng(13)
    model = pii.Tagger(5)
    model.p["tr"] = r.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    model.p["bo"][0], model.p["tr"][0, 0] = 8, 0
    model.p["wo"] *= 24
    tr = model.p["tr"]
    pieces = [r.integers(1, pii.CHARS, n).astype(np.int16) for n in (0, 1, 32, 255, 256, 257, 300, 700, 481)]
    windows = pii.Windows(pieces, model, {})
    hot = pii.could_hold(windows.sums(tr), windows.first[:-1], tr)
    assert 0 < hot.sum() < len(hot)
    step = pii.WINDOW - pii.BLOCK
    for x, a, z in zip(pieces, windows.first, windows.first[1:]):
        size = (z - a) * pii.BLOCK
        row = np.zeros(size, np.int64)
        row[: len(x)] = x
        total, met = np.zeros((size, pii.TAGS)), np.zeros((size, 1))
        for at in range(0, size - pii.BLOCK, step):
            total[at : at + pii.WINDOW] += model.scores(row[None, at : at + pii.WINDOW])[0][:, 0]
            met[at : at + pii.WINDOW] += 1
        em = total / met
        assert np.allclose(windows.scores(np.arange(a, z)).reshape(size, -1), em, atol=1e-4)
        for b in range(1, pii.TAGS, 2):
            within = max(tr[b, b + 1], tr[b + 1, b + 1])
            gain = np.concatenate([[0], np.cumsum(np.maximum(em[:, b], em[:, b + 1]) - em[:, 0] + within - tr[0, 0])])
            runs_ = gain[None, :] - gain[:, None] + tr[0, b] + max(tr[b, 0], tr[b + 1, 0]) - within - tr[0, 0]
            for s, e in np.argwhere(np.triu(runs_ > -pii.MARGIN + 1e-3, 1)):
                assert hot[a + s // pii.BLOCK : a + (e - 1) // pii.BLOCK + 1].all()


def test_secrets_have_columns_of_their_own(spark):
    rows_ = [(1, 'so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ernd a@b.co'), (2, "the token of the secret is lost at the end"), (3, None)]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got[1]["n_secret"] == 1 and got[1]["secrets"] == "secret:12:52" and got[1]["spans"].startswith("email:") and got[1]["n_private"] == 2
    assert got[2]["n_private"] == 0 and got[3]["n_private"] == 0


def test_counts_are_of_base_spans(spark):
    """What the tagger adds stands in spans and n_private, not in the contract's counts."""
    texts = [pii.labelled_text(pii.Forms(seed), 400, 0.3)[0] for seed in range(40)]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    added = 0
    for i, text in enumerate(texts):
        base = plain_spans(text)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        spans = [x for x in got[i]["spans"].split(",") if x]
        added += len(spans) - len(base)
        assert got[i]["n_private"] == len(spans) + got[i]["n_secret"]
    assert added > 0


def test_chat_of_very_many_turns(spark):
    """One conversation of 20000 turns, and its snapshot of one turn less."""
    n = 20_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    both = turns.unionByName(turns.where(F.col("turn") < n - 1).withColumn("conv_id", F.lit(2).cast("long")))
    got = chat.format_chats(both).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, n)] and got[0]["text"].endswith(f"t{n - 1}<|im_end|>\n")


# ---------------------------------------------------------------- the fit, by brute force


def brute_models(rows, labels, rounds, give):
    """Co-training on all rows in memory: what fit() does over tables."""
    known = {}
    for d, y in labels:
        if d is not None and y is not None:
            known[d] = min(y, known.get(d, y))
    own = {d: min(r[1:] for r in rows if r[0] == d) for d in sorted(known) if any(r[0] == d for r in rows)}
    feats = lambda xs: quality.text_features(pa.array([x[0] for x in xs], pa.string())).astype(np.float32).astype(float)
    values = quality.known_values([x[1] for x in own.values()], [x[2] for x in own.values()])
    meta = lambda xs: quality.meta_features(pa.array([x[1] for x in xs], pa.string()), pa.array([x[2] for x in xs], pa.string()), pa.array([x[3] for x in xs], pa.float64()), values)
    y = np.array([known[d] for d in own], float)
    held = np.array([quality.xxhash.xxh3_64_intdigest(int(d).to_bytes(8, "little", signed=True)) % 4 == 0 for d in own])
    pool = [r[1:] for r in rows if r[0] is None or r[0] not in known]
    t = feats(pool)
    h = [int(np.uint64(quality.xxhash.xxh3_64_intdigest(x.astype(np.float32).tobytes())).view(np.int64)) for x in t]
    m = meta(pool)

    def ask(models, taken, many):
        out = []
        for view, (model, x) in enumerate(zip(models, (t, m))):
            r = model.raw(x)
            for good in (False, True):
                best = {}
                for i in np.flatnonzero((r > 1) if good else (r < -1)).tolist():
                    if h[i] not in taken:
                        best.setdefault((h[i], round(float(r[i]), 12)), i)
                top = sorted(best.items(), key=lambda x: (-abs(x[0][1]), x[0][0]))[: many[0] if good else many[1]]
                out += [(view, good, k[0], i) for k, i in top]
        if not out:
            return None
        one = {}
        for view, good, k, i in out:  # one row a feature hash, the smallest
            same = [j for j in range(len(pool)) if h[j] == k]
            one[view, good, k] = min(same, key=lambda j: (t[j].astype(np.float32).tobytes(), (pool[j][1] is not None, pool[j][1]), (pool[j][2] is not None, pool[j][2]), pool[j][3]))
        keys = sorted(one)
        at = [one[k] for k in keys]
        return np.array([k[0] for k in keys]), (t[at], m[at]), np.array([k[1] for k in keys]), np.array([k[2] for k in keys])

    return quality.co_train(feats(list(own.values())), meta(list(own.values())), y, held, ask, rounds, give)


def test_quality_fit_equals_brute_force(spark):
    """Over tables with a doc_id repeated often, rows without doc_id and copies."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    first = labels.join(docs, "doc_id").select(F.min("doc_id")).first()[0]
    docs = docs.unionByName(docs.where(F.col("doc_id") == first).crossJoin(spark.range(50)).drop("id")).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    by_text, by_meta, _, _ = quality.fit(docs, labels, rounds=2, give=10)
    want = brute_models([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()], 2, 10)
    for got, model in zip((by_text, by_meta), want):
        assert np.allclose(got.w, model.w, atol=1e-6) and abs(got.a - model.a) < 1e-6 and abs(got.b - model.b) < 1e-6
