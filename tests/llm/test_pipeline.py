"""The corpus pipeline stage by stage against brute-force versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from test_contracts import SF, brute_lines, expected_ids, shingles, union_find
from tickloom.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # A repeated row, rows without id or text, and an empty text.
    more = spark.createDataFrame([(100_001, None, "en", "src0", None), (100_002, "", "en", None, 0), (None, "no id but some words here", "en", "src1", 25)], docs.schema)
    docs = docs.unionByName(docs.limit(1)).unionByName(more)
    out = [docs]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(k))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def table(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_quality_keeps_what_the_classifier_keeps(spark, steps):
    want = quality.score(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).where("keep")
    assert Counter(table(want)) == Counter(table(steps[1])) and steps[1].count() >= 0.8 * steps[0].count()


def test_repeated_runs_of_lines_are_gone(steps):
    before = table(steps[1])
    seqs, places = brute_lines({(d, t) for d, t, _ in before if d is not None})
    dead = defaultdict(set)
    for at in places.values():
        for d, t, s, e in sorted(at)[1:]:
            dead[(d, t)] |= set(range(s, e + 1))
    want = Counter()
    for d, t, s in before:
        lines = (t or "").split("\n")
        live = [i for i, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        gone = {live[i] for i in dead.get((d, t), ())}
        if not gone or len(gone) < len(live):
            want[(d, "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t, s)] += 1
    assert Counter(table(steps[2])) == want


def test_one_document_of_each_group_stays(steps):
    before = list(dict.fromkeys(table(steps[2])))
    sets = [(d, shingles(t)) for d, t, _ in before if d is not None]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    comp = union_find(pairs, {d for d, _ in sets})
    want = Counter(r for r in before if r[0] is None or comp[r[0]] == r[0])
    assert Counter(table(steps[3])) == want


def test_mixed_sources_come_near_their_targets(steps):
    before, after = table(steps[3]), table(steps[4])
    size = Counter()
    for _, t, s in before:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    goal = dict(zip(names, mixing.word_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    got, largest = Counter(), Counter()
    for _, t, s in after:
        got[s] += len(WORD.findall(t or ""))
    for _, t, s in before:
        largest[s] = max(largest[s], len(WORD.findall(t or "")))
    assert all(abs(got[s] - goal[s]) <= 1.5 * largest[s] for s in names if size[s])
    kept = {(d, t) for d, t, _ in before}
    assert {(d, t) for d, t, _ in after} <= kept and max(Counter((d, t) for d, t, _ in after).values()) <= 3


def test_pieces_hold_every_document_once_for_each_copy(steps):
    want = Counter()
    for d, t, _ in table(steps[4]):
        ids = expected_ids(t)
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    rows = steps[5].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048


CLASH = ["__th", "__runs", "__doc", "__mth", "__row", "__a", "__b", "__copies", "__h", "y", "size", "key", "n", "keep"]


def odd_docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], schema)


def test_stages_on_clashing_columns_ties_and_long_texts(spark):
    """Every stage keeps extra columns whatever their names; ties and repeated rows, a
    null row and a text of some MB pass through all of them."""
    long = "\n".join(f"line {i} of a very long text with words w{i} w{i + 1}" for i in range(40_000))
    rows = [(1, "same text of seven words in here", "en", "a", 32), (2, "same text of seven words in here", "en", "a", 32), (2, "same text of seven words in here", "en", "a", 32), (3, long, "en", "b", len(long)), (4, None, None, None, None), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (5, "", "en", "b", 0)]
    docs = odd_docs(spark, rows)
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = f(spark, docs, SF).cache()
        assert docs.columns == [c for c in names if c in docs.columns] and set(names) - set(docs.columns) <= {"keep"}, name
        assert 0 < docs.count() <= 3 * before
        names = docs.columns
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in got} <= {1, 2, 3, 4, 5, None} and max(r["length"] for r in got) == 2048


def test_stages_on_an_empty_table(spark):
    docs = odd_docs(spark, [])
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0, name
