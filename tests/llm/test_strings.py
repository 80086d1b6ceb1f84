"""Suffix arrays, fill-in-middle and periodic runs against brute-force versions."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import fim, runs, suffixes
from tickloom.llm.common import text_buffers

SF = "/root/testdata/sf0.001"
PASSAGE = "Überall steht derselbe lange Satz, der mehr als fünfzig Bytes hat. "
COLUMNS = "doc_id long, text string, lang string, n int, runs string, kept int, output string, form int, name string, th int"
EXTRA = ("x", 1, "r", 2, "o", 3, "n", 4)


def odd_texts():
    long = "many words that go on " * 4000
    out = [
        (1, "start " + PASSAGE + "end of one\nsecond line"), (2, "other " + PASSAGE + "end of two\nsecond line\n"), (2, "other " + PASSAGE + "end of two\nsecond line\n"), (2, "again " + PASSAGE + "same id"),
        (3, None), (4, ""), (5, " \t\n\x0b\r\n\n"), (None, "no id " + PASSAGE), (None, "no id " + PASSAGE), (6, long), (7, long), (8, long + "!"), (9, "a" * 300), (10, "b" + "a" * 200 + "c"),
        (11, "tiny"), (12, "has <S> inside\nand more"), (13, "x <P\n<M"), (14, "🙂é\x00\x1c " * 30), (15, "🙂é\x00\x1c " * 31 + "z"), (-3, "negative " + PASSAGE), (16, "one two " * 2 + "one"), (17, "w w w w w w"), (18, "w w w w w"),
    ]
    return out + [(100 + i, f"hot copy {i % 3} " + PASSAGE * 2) for i in range(40)] + [(7, "many")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in odd_texts()], COLUMNS)


def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


# ---------------------------------------------------------------- suffix arrays


def random_symbols(r):
    t = r.integers(1, r.integers(1, 5) + 1, r.integers(0, 60))
    if r.random() < 0.4:
        t = np.tile(t, r.integers(1, 8))
    return np.append(t, 0).astype(np.uint8)


def test_suffix_arrays_and_prefixes():
    r = np.random.default_rng(1)
    for _ in range(1500):
        t = random_symbols(r)
        b = t.tobytes()
        order = suffixes.suffix_array(t)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffixes.common_prefixes(t, order, 20)
        for x, y in zip(order[1:].tolist(), order[:-1].tolist()):
            m = 0
            while m < 20 and max(x, y) + m < len(b) and b[x + m] == b[y + m]:
                m += 1
            assert shared[x] == m
    assert suffixes.suffix_array(np.zeros(0, np.uint8)).tolist() == []


def test_substrings_that_end_where_a_key_of_symbols_ends():
    r = np.random.default_rng(3)
    for stem in (b"acdefgh", b"acdefghijklmnop"):  # with the b, one key and two keys of eight
        ends = [stem + x for x in (b"bc", b"ba", b"bba", b"bbba")]
        for _ in range(40):
            b = b"".join(ends[i] for i in r.integers(0, 4, 12)) + b"\0"
            order = suffixes.suffix_array(np.frombuffer(b, np.uint8))
            assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_smallest_owner_of_windows():
    r = np.random.default_rng(2)
    for _ in range(200):
        base = [bytes(r.integers(97, 98 + r.integers(1, 20), r.integers(20, 200)).astype(np.uint8)) for _ in range(4)]
        parts = [p for p in (base[r.integers(4)][r.integers(0, 20) :] + base[r.integers(4)][: r.integers(0, 60)] for _ in range(8)) if len(p) >= 20]
        owner = r.integers(0, 5, len(parts)).astype(np.int64)
        best = {}
        for p, o in zip(parts, owner.tolist()):
            for i in range(len(p) - 19):
                best[p[i : i + 20]] = min(best.get(p[i : i + 20], 9), o)
        for p, got in zip(parts, suffixes.smallest_owner(parts, owner, 20)):
            assert got.tolist() == [best[p[i : i + 20]] for i in range(len(p) - 19)]


@pytest.mark.parametrize("cap", [3, 40, 512])
def test_segments_name_every_window_once(monkeypatch, cap):
    monkeypatch.setattr(suffixes, "CAP", cap)
    r = np.random.default_rng(cap)
    for _ in range(100):
        texts = [bytes(r.integers(97, 97 + r.integers(1, 8), r.integers(0, 150)).astype(np.uint8)) for _ in range(6)]
        buf, off = text_buffers(pa.array([x.decode() for x in texts]))
        seen, names = set(), {}
        for d, s, n, name in zip(*(x.tolist() for x in suffixes.segments(buf, off, 30))):
            assert n <= cap
            for i in range(s, s + n):
                assert (d, i) not in seen
                seen.add((d, i))
                assert names.setdefault(texts[d][i : i + 30], name) == name
        assert seen == {(d, i) for d, x in enumerate(texts) for i in range(len(x) - 29)}


@pytest.mark.parametrize("held", [4, 1 << 18])
def test_shared_names_across_batches(monkeypatch, held):
    monkeypatch.setattr(suffixes, "HELD", held)
    r = np.random.default_rng(5)
    cols = zip(r.integers(0, 120, 600).tolist(), r.integers(0, 2, 600).tolist(), (r.integers(0, 4, 600) * r.integers(0, 2, 600)).tolist())
    data = sorted((n, sh * (n % 3 > 0), d, 0, i) for i, (n, sh, d) in enumerate(cols))
    data += [(500, 7, 1, 0, i) for i in range(30)] + [(501, 7, i % 2, 0, i) for i in range(30)]
    docs, kinds, size = {}, {}, {}
    for n, sh, d, *_ in data:
        docs.setdefault(n, set()).add(d)
        kinds.setdefault(n, set()).add(sh)
        size[n] = size.get(n, 0) + 1
    for step in (1, 2, 7, 50, 700):
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(data[i : i + step], np.int64).T], ["name", "sh", "doc", "th", "at"]) for i in range(0, len(data), step)]
        got = [tuple(x.values()) for b in suffixes._shared_names(parts) for x in b.to_pylist()]
        want = {x: (min(docs[x[0]]) if len(kinds[x[0]]) == 1 else None) for x in data if len(docs[x[0]]) > 1}
        assert len(got) == len({x[:5] for x in got})
        # A name beyond HELD may go on as one of several, shared or not; nothing is lost.
        assert {x[:5] for x in got} >= set(want) and {x[:5] for x in got} - set(want) <= {x for x in data if size[x[0]] > held}
        for x in got:
            assert x[5] == want.get(x[:5]) or (x[5] is None and size[x[0]] > held)
    assert list(suffixes._shared_names([])) == []


@pytest.mark.parametrize("held, room", [(4, 20), (1 << 18, 1 << 21)])
@pytest.mark.parametrize("buckets", [1, 7, 70_000])
def test_packed_rows_of_names(monkeypatch, held, room, buckets):
    monkeypatch.setattr(suffixes, "HELD", held)
    monkeypatch.setattr(suffixes, "ROOM", room)
    r = np.random.default_rng(6)
    pool = r.integers(-(1 << 63), 1 << 63, 150)
    own = np.where(r.integers(0, 4, 3000) > 0, pool[r.integers(0, 150, 3000) ** 2 // 150], pool[3])
    x = [own, r.integers(-9, 9, 3000), np.sort(r.integers(-(1 << 63), 1 << 63, 3000)), r.integers(0, 2, 3000), np.arange(3000)]
    x[2][:1000] = 5
    data = {y[4]: y for y in zip(*(c.tolist() for c in x))}
    packs = [y for i in range(0, 3000, 400) for y in suffixes._pack([c[i : i + 400] for c in x], buckets).to_pylist()]
    assert sum(y["n"] for y in packs) == 3000 and all(0 <= y["bucket"] < buckets for y in packs)
    packs.sort(key=lambda y: y["bucket"])
    batches = [pa.RecordBatch.from_pylist(packs[i : i + 3], pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])) for i in range(0, len(packs), 3)]
    got = [tuple(y.values()) for b in suffixes._shared_rows(batches) for y in b.to_pylist()]
    assert len(got) == len({y[4] for y in got}) and all(data[y[4]] == y[:5] for y in got)
    docs, kinds, size = {}, {}, {}
    for n, sh, d, *_ in data.values():
        docs.setdefault(n, set()).add(d)
        kinds.setdefault(n, set()).add(sh)
        size[n] = size.get(n, 0) + 1
    want = {i: (min(docs[y[0]]) if len(kinds[y[0]]) == 1 else None) for i, y in data.items() if len(docs[y[0]]) > 1}
    low = {y[4]: y[5] for y in got}
    assert set(low) >= set(want)
    for i, at in low.items():
        assert (i in want and at == want[i]) or (at is None and size[data[i][0]] > held)


def test_packed_rows_are_small():
    texts = pa.array([f"document {i} of " + " ".join(map(str, range(i, i + 400))) for i in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([0] * 300), texts], ["doc", "th", "text"])
    got = list(suffixes._name_segments(50, 4)([batch]))
    rows = sum(sum(b.column("n").to_pylist()) for b in got)
    assert rows > 20_000 and sum(len(y) for b in got for y in b.column("data").to_pylist()) < 20 * rows  # five longs are 40


@pytest.mark.parametrize("heavy", [1 << 21, 100])
def test_repeats_part_by_part(spark, odd, monkeypatch, heavy):
    seen = []
    free = suffixes._release
    monkeypatch.setattr(suffixes, "LARGE", 1)
    monkeypatch.setattr(suffixes, "_release", lambda s: seen.append(free(s)))
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [(r["doc_id"], r["n_bytes"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.remove_repeats(odd, 50, heavy=heavy).collect()]
    assert sorted(got, key=repr) == removed(data, 50)
    assert len(seen) >= 11  # shared names, wanted, four parts of texts, four of segments, gaps


def test_segment_hashes_tell_segments_apart():
    r = np.random.default_rng(8)
    buf = r.integers(97, 99, 300_000).astype(np.uint8)
    at = np.sort(r.integers(0, 299_000, 4000))
    size = r.integers(50, 600, 4000)
    got = suffixes.segment_hashes(buf, at, size).tolist()
    raw = [buf[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())]
    assert len(set(got)) == len(set(raw)) and len(set(zip(got, raw))) == len(set(raw))


def removed(data, length):
    """Brute force: (n_bytes, spans, kept) of each row."""
    first = {}
    for d, t in data:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1) if d is not None else ():
            w = raw[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in data:
        raw = (t or "").encode()
        dead = [False] * len(raw)
        for i in range(len(raw) - length + 1) if d is not None else ():
            if first[raw[i : i + length]] < d:
                dead[i : i + length] = [True] * length
        spans = [m.span() for m in re.finditer("1+", "".join("01"[x] for x in dead))]
        out.append((d, len(raw), spans, bytes(b for b, x in zip(raw, dead) if not x)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [1 << 21, 100])
@pytest.mark.parametrize("source", ["odd", "table"])
def test_repeats_against_brute_force(spark, odd, monkeypatch, source, heavy):
    if heavy == 100 and source == "table":
        heavy = 2000
    df = odd if source == "odd" else table(spark)
    data = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = [(r["doc_id"], r["n_bytes"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.remove_repeats(df, 50, heavy=heavy).collect()]
    assert sorted(got, key=repr) == removed(data, 50)
    assert any(x[2] for x in got)


def test_repeats_of_nothing_and_other_lengths(spark, odd):
    assert suffixes.digest(odd.where("doc_id < -99")).collect() == []
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [(r["doc_id"], r["n_bytes"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.remove_repeats(odd, 20).collect()]
    assert sorted(got, key=repr) == removed(data, 20)
    with pytest.raises(ValueError):
        suffixes.remove_repeats(odd, 8)
    row = suffixes.digest(odd).where("doc_id = 4").first()
    assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (0, 0, 0, hashlib.sha256(b"").hexdigest())


# ---------------------------------------------------------------- fill in the middle


def middle(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = ("".join(lines[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("source", ["odd", "table"])
def test_fill_in_middle(spark, odd, source):
    df = odd if source == "odd" else table(spark)
    done = fim.restored(fim.fill_in_middle(df))
    forms = set()
    for r in done.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == middle(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
        forms.add(r["form"])
    assert forms >= {"psm", "spm", "plain"} if source == "odd" else {"psm", "spm"}
    want = sorted(repr((r["doc_id"], hashlib.sha256(middle(r["doc_id"], r["text"])[4].encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())) for r in df.collect())
    assert sorted(repr((r["doc_id"], r["output_sha256"], r["restored_sha256"])) for r in fim.digest(df).collect()) == want


def test_fill_in_middle_parameters(spark, odd):
    assert [f.name for f in fim.fill_in_middle(odd).schema] == ["doc_id", "text", "lang", "runs", "kept", "name", "th", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["form"] for r in fim.fill_in_middle(odd, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(odd, spm=0).collect()} == {"plain", "psm"}
    words = fim.restored(fim.fill_in_middle(odd, pattern=r"\s*\S+|\s+", seed=8))
    assert all(r["restored"] == (r["text"] or "") and r["n"] == len(re.findall(r"\s*\S+|\s+", r["text"] or "")) for r in words.where("doc_id < 14").collect())
    assert fim.digest(odd.where("doc_id < -99")).collect() == []


# ---------------------------------------------------------------- periodic runs


def all_runs(w, exponent=4, least=6):
    """Every period and every stretch; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_of_random_words(monkeypatch):
    r = np.random.default_rng(3)
    for k in range(3000):
        w = r.integers(0, r.integers(1, 5), r.integers(0, 80))
        if k % 2:
            a = int(r.integers(0, len(w) + 1))
            w = np.concatenate([w[:a], np.tile(r.integers(0, 3, r.integers(1, 8)), r.integers(1, 9)), w[a:]])
        monkeypatch.setattr(runs, "GRID", int(r.integers(3, 50)) if k % 5 == 0 else 1 << 18)
        assert runs.find_runs(w) == all_runs(w.tolist())
    assert runs.find_runs(w, exponent=2, least=4) == all_runs(w.tolist(), 2, 4)


def collapsed(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
    found = all_runs([number[x] for x in w])
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{q}\n" for s, size, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, *sha)


@pytest.mark.parametrize("source", ["odd", "table"])
def test_runs_digest(spark, odd, source):
    df = odd if source == "odd" else table(spark)
    data = [(r["doc_id"], r["text"]) for r in df.collect()]
    if source == "odd":  # brute force on a long periodic text takes too long
        data = [(d, t) for d, t in data if not t or len(t) < 5000]
        df = df.where("text IS NULL OR length(text) < 5000")
    got = [tuple(r) for r in runs.digest(df).collect()]
    assert sorted(got, key=repr) == sorted((collapsed(*x) for x in data), key=repr)
    assert any(r[1] for r in got)


def test_runs_of_long_texts_and_nothing(spark, odd):
    by = {r["doc_id"]: r for r in runs.periodic_runs(odd.where("doc_id IN (6, 8, 16, 17, 18)")).collect()}
    assert [tuple(x) for x in by[6]["runs"]] == [(0, 20000, 5)] and by[6]["kept"] == "many words that go on"
    assert [tuple(x) for x in by[8]["runs"]] == [(0, 20000, 5)] and by[8]["kept"] == "many words that go on !"
    assert by[16]["runs"] == [] and by[18]["runs"] == [] and [tuple(x) for x in by[17]["runs"]] == [(0, 6, 1)] and by[17]["kept"] == "w"
    assert [f.name for f in runs.periodic_runs(odd).schema][-2:] == ["runs", "kept"]
    assert runs.digest(odd.where("doc_id < -99")).collect() == []


def test_rows_of_segments_carry_no_text_hash_unless_needed(spark):
    """The hash of the text is there only to tell rows of one doc_id apart."""
    text = "a passage of more than fifty bytes that stands in both of the documents"
    one = spark.createDataFrame([(1, text), (2, "so " + text), (None, text), (None, text)], "doc_id long, text string")
    two = one.unionByName(spark.createDataFrame([(2, text + "!")], "doc_id long, text string"))
    assert {r["th"] for r in suffixes.repeated_spans(one).collect()} == {0}
    assert len({r["th"] for r in suffixes.repeated_spans(two).collect()} - {0}) == 2
    done = suffixes.remove_repeats(two).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in done if r["doc_id"]) == [(1, text.encode()), (2, b"!"), (2, b"so ")]
