"""Fill-in-middle transformation over units that a regular expression cuts.

The tokenizers library's Split pre-tokenizer, with isolated matches of the unit
pattern, gives each unit's offsets in code points; nothing is trained. The number of
offsets is n. Two ranks drawn from a hash of the seed and doc_id pick the units after
which prefix and middle end, and their offsets give the slices.

Defined cases: a null text is empty; a null doc_id is the empty string in the hash;
an empty text, one that holds a sentinel and one that the rate leaves out are plain,
their output is the text itself; equal rows give equal outputs; an empty table gives
no rows; the columns of docs are carried along, but for those the result has itself.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, slices

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of 8 hex digits of the hash."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(text: str, ends: list[int], h: list[int], rate: int, spm: int, marks: tuple[str, str, str] = SENTINELS) -> tuple[str, int | None, int | None, str]:
    """(form, prefix length, middle length, output) of a text whose units end at ends."""
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return "plain", None, None, text
    n = len(ends)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = (ends[k - 1] if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = marks
    if h[3] % 100 < spm:
        return "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, pattern: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output. rate: documents in a
    hundred that are cut; spm: of those, the ones in suffix-first form."""
    own = [f.split()[0] for f in FIELDS.split(", ")]
    docs = docs.drop(*own)
    names = docs.columns

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, pre_tokenizers

        cutter = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            out: list[list] = [[] for _ in own]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ends = [end for _, (_, end) in cutter.pre_tokenize_str(text)] if text else []
                for column, value in zip(out, (len(ends), *arrange(text, ends, draws(doc_id, seed), rate, spm))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds))], [*names, *own])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{schema}, {FIELDS}")


def restored(done: DataFrame, column: str = "restored") -> DataFrame:
    """done with the texts rebuilt from output and form alone, by Spark's functions."""
    p, s, m = SENTINELS

    def between(a: str, b: str):
        return F.expr(f"substring(output, locate('{a}', output) + {len(a)}, locate('{b}', output) - locate('{a}', output) - {len(a)})")

    middle = F.expr(f"substring(output, locate('{m}', output) + {len(m)})")
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return done.withColumn(column, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))


def digest(docs: DataFrame) -> DataFrame:
    done = restored(fill_in_middle(docs.select("doc_id", "text")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
