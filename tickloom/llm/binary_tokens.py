"""Token-id output: frequency-ranked ids, byte-aligned variable length.

Ids are ranked by how often they occur in the whole corpus (ties to the smaller
id); a rank takes 1 to 4 bytes, and the lengths of four ranks share one control
byte kept apart from the data. A file holds blocks of documents in ascending
doc_id order (nulls first, equal doc_ids by their ids). numpy decodes a block by
looking its control bytes up in a 256-entry table.

Files are Parquet containers, one row a block: shard, block, first (ids of the
shard before it), doc_ids, counts, control and data. So executors write through
Spark's commit protocol to whatever store the shared folder is in.

Defined cases: a null or empty text is the end id alone; repeated rows are kept
each; an empty table gives no blocks; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_map, drop_table, free_shuffles, slices, stage, text_buffers
from tickloom.llm.tokens import encoder

END_ID = 0
BLOCK_IDS = 1 << 20  # ids after which a block is closed

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
_FILLED = np.arange(4) <= _CODES[:, :, None]  # [control, value, byte]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    quad = np.zeros((len(v) + 3) // 4 * 4, np.uint8)
    quad[: len(v)] = code
    quad = quad.reshape(-1, 4)
    return (quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack()."""
    filled = _FILLED[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[filled] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def token_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit or 16-bit, see width) with the
    end id, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary) as enc:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    ids, upto = enc.encode(*text_buffers(part.column("text")))
                    n = part.num_rows
                    full = np.zeros(len(ids) + n, ids.dtype)
                    keep = np.ones(len(full), bool)
                    keep[upto[1:] + np.arange(n)] = False
                    full[keep] = ids
                    ends = (upto + np.arange(n + 1)) * ids.dtype.itemsize
                    blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(full)])
                    width = pa.array(np.full(n, ids.dtype.itemsize, np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), width, blob], ["doc_id", "width", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, width int, ids binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a token_table batch and where each document starts."""
    col = batch.column("ids")
    if not len(col):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    width = batch.column("width")[0].as_py()
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data.view(f"<u{width}"), (off - off[0]) // width


def id_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all documents; its length is bounded by the
    vocabulary."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(_flat(batch)[0])
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = arrow_map(tokens, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], np.uint32)


BLOCKS = "shard int, block int, first long, doc_ids array<long>, counts binary, control binary, data binary"


def write_binary(docs: DataFrame, vocabulary: str, path: str) -> tuple[DataFrame, np.ndarray]:
    """Encode all documents into the file format below path; returns the blocks
    as read back and the ids by rank."""
    spark = docs.sparkSession
    tokens = stage(token_table(docs, vocabulary), "ids")
    by_rank = id_ranks(tokens)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.rdd.getNumPartitions())

    def run(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, counts, values, held = [], [], [], 0

        def close():
            control, data = pack(np.concatenate(values))
            row = [[shard], [block], [first], [names], [np.array(counts, "<u4").tobytes()], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "block", "first", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            ids, off = _flat(batch)
            ranks, ids_of = rank_of[ids], batch.column("doc_id").to_pylist()
            i = 0
            while i < len(ids_of):
                j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_IDS - held, "right")) - 1)
                names += ids_of[i:j]
                counts += np.diff(off[i : j + 1]).tolist()
                values.append(ranks[off[i] : off[j]])
                held += int(off[j] - off[i])
                i = j
                if held >= BLOCK_IDS or i < len(ids_of):
                    yield close()
                    block, first, held = block + 1, first + held, 0
                    names, counts, values = [], [], []
        if names:
            yield close()

    ordered = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "ids").drop("h")
    arrow_map(ordered, run, BLOCKS).write.option("compression", "uncompressed").parquet(path)
    drop_table(tokens)
    free_shuffles(spark)
    return spark.read.schema(BLOCKS).parquet(path), by_rank


def read_binary(blocks: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files.

    The shards' totals (one number a shard) give the ids before each shard.
    """
    totals = arrow_map(blocks.select("shard", "counts"), _totals, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    base, seen = {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        base[r["shard"]] = seen
        seen += r["n"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                end = np.cumsum(counts)
                ids = by_rank[unpack(row["control"], row["data"], int(end[-1]))].astype("<u4")
                start = end - counts
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist())]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(start + base[row["shard"]] + row["first"]), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _totals(batches):
    for batch in batches:
        n = [int(np.frombuffer(x.as_py(), "<u4").sum(dtype=np.int64)) for x in batch.column("counts")]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(n, pa.int64())], ["shard", "n"])
