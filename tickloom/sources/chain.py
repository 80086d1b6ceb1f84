"""An append-only table with one writer: every append is a link of a hash chain.

Tasks write their rows as Parquet parts, each a chain of its own: the first record follows
the part's seed, every other the one before it. The seed holds the head that the append
builds on and the part's number. The commit writes the next head, which covers the heads
of all its parts in order. Heads are numbered, and a number is taken once: a writer whose
head is no longer the newest is refused, its parts are removed, and nobody reads them,
because readers go by the heads. Records that break a rule fail the append.

    rows.write.format("chained_table").option("path", p).option("head", chain.head(p)).mode("append").save()
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

GENESIS = "0" * 64
ADDED = ("batch", "part", "pos", "prev_hash", "record_hash")


class StaleHead(RuntimeError):
    pass


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def seed(head: str, part: int) -> str:
    return _sha(f"{head}|{part}")


def _heads(path: str) -> list[tuple[int, str]]:
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/heads", allow_not_found=True))
    return sorted((int(f.base_name.split(".")[0]), f.path) for f in found if f.base_name.endswith(".json"))


def links(path: str) -> list[dict]:
    """The heads in order: number, prev, parts (file, seed, last, rows) and head."""
    store, _ = fs.FileSystem.from_uri(path)
    out = []
    for _, p in _heads(path):
        with store.open_input_stream(p) as f:
            out.append(json.loads(f.read()))
    return out


def head(path: str) -> str:
    """The newest head, which the next append must name."""
    last = _heads(path)[-1:]
    if not last:
        return GENESIS
    with fs.FileSystem.from_uri(path)[0].open_input_stream(last[0][1]) as f:
        return json.loads(f.read())["head"]


class ChainedTable(DataSource):
    """Options: path; head, the head that the append builds on; text, the column that is
    hashed and may not be blank."""

    @classmethod
    def name(cls) -> str:
        return "chained_table"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("a chained table is appended to, never overwritten")
        return ChainWriter(self.options)


class Part(WriterCommitMessage):
    def __init__(self, number: int, file: str, last: str, rows: int):
        self.number, self.file, self.last, self.rows = number, file, last, rows


class ChainWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.on, self.text = options["path"], options["head"], options.get("text", "body")
        self.name = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.path)
        context = TaskContext.get()
        number = context.partitionId()
        # Another attempt of the task writes another file; the commit names one of them.
        file = f"parts/{self.name}-{number:06d}-{context.taskAttemptId()}.parquet"
        last, n, out = seed(self.on, number), 0, None
        store.create_dir(f"{root}/parts")
        try:
            for batch in iterator:
                before, own = [], []
                for text in batch.column(self.text).to_pylist():
                    if text is None or not text.strip():
                        raise ValueError(f"{self.text} is blank in row {n + len(own)} of part {number}")
                    before.append(last)
                    last = _sha(f"{text}|{last}")
                    own.append(last)
                size = batch.num_rows
                more = [pa.array([number] * size, pa.int32()), pa.array(range(n, n + size), pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())]
                full = pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *ADDED[1:]])
                out = out or pq.ParquetWriter(store.open_output_stream(f"{root}/{file}"), full.schema, compression="zstd")
                out.write_batch(full)
                n += size
        finally:
            if out:
                out.close()
        return Part(number, file if n else "", last, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        store.create_dir(f"{root}/heads")
        taken = _heads(self.path)
        now = head(self.path)
        # A commit that raises is followed by abort, which removes the parts.
        if now != self.on:
            raise StaleHead(f"the append builds on {self.on[:12]}, the table is at {now[:12]}")
        if not parts:
            return
        number = taken[-1][0] + 1 if taken else 0
        link = {"number": number, "prev": self.on, "parts": [{"part": m.number, "file": m.file, "seed": seed(self.on, m.number), "last": m.last, "rows": m.rows} for m in parts]}
        link["head"] = _sha("|".join([self.on, *(m.last for m in parts)]))
        try:
            _take(store, f"{root}/heads/{number:012d}.json", json.dumps(link).encode())
        except FileExistsError:
            raise StaleHead(f"another writer took link {number}") from None

    def abort(self, messages: list[Part | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.file and store.get_file_info(f"{root}/{m.file}").is_file:
                store.delete_file(f"{root}/{m.file}")


def _take(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a file that must not exist yet. A mounted folder decides at once; elsewhere
    the test and the write are two steps, and writers need the store's own lock."""
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "xb") as f:
            f.write(content)
        return
    if store.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    with store.open_output_stream(path) as f:
        f.write(content)


def append(rows: DataFrame, path: str, on: str | None = None, text: str = "body") -> str:
    """Append rows, on the newest head unless `on` names one; the new head."""
    rows.sparkSession.dataSource.register(ChainedTable)
    rows.write.format("chained_table").option("path", path).option("head", head(path) if on is None else on).option("text", text).mode("append").save()
    return head(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed records, with batch, pos, prev_hash and record_hash, and their part's
    seed, last hash and number of rows."""
    kept = [(p["file"].rsplit("/", 1)[1], link["number"], p["seed"], p["last"], p["rows"]) for link in links(path) for p in link["parts"]]
    if not kept:
        raise ValueError("the table has no link yet")
    parts = spark.createDataFrame(kept, "_file string, batch long, seed string, last string, rows long")
    t = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/parts/{k[0]}" for k in kept])
    return t.withColumn("_file", F.col("_metadata.file_name")).join(parts, "_file").drop("_file")


def broken_records(records: DataFrame, text: str = "body", span: int = 1 << 16) -> DataFrame:
    """Records whose hash does not follow from their text and the hash before it, or whose
    prev_hash is not that of the record before them (the part's seed for the first). A
    part is checked in ranges of positions."""
    by = ["batch", "part"]
    at = F.floor(F.col("pos") / span)
    t = records.withColumn("_at", at)
    ends = t.groupBy(*by, "_at").agg(F.max_by("record_hash", "pos").alias("_end"), F.min("pos").alias("_first"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*by).orderBy("_at")))
    t = t.withColumn("_lag", F.lag("record_hash").over(Window.partitionBy(*by, "_at").orderBy("pos"))).join(ends, [*by, "_at"])
    want = F.when(F.col("pos") == 0, F.col("seed")).when(F.col("pos") == F.col("_first"), F.col("_end")).otherwise(F.col("_lag"))
    link_ok = F.coalesce(F.col("prev_hash") == want, F.lit(False))
    hash_ok = F.coalesce(F.sha2(F.concat_ws("|", text, "prev_hash"), 256) == F.col("record_hash"), F.lit(False))
    return t.withColumn("link_ok", link_ok).withColumn("hash_ok", hash_ok).where(~(F.col("link_ok") & F.col("hash_ok"))).drop("_at", "_end", "_first", "_lag")


def broken_parts(records: DataFrame) -> DataFrame:
    """(batch, part) whose records are not those of the committed link: their number or
    the last hash differs."""
    t = records.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("record_hash", "pos").alias("end"), F.max("rows").alias("rows"), F.max("last").alias("last"))
    return t.where("n <> rows OR end <> last").select("batch", "part", "n", "rows")


def broken_heads(path: str) -> list[int]:
    """Numbers of links that do not follow from the link before them and their parts."""
    bad, before = [], GENESIS
    for i, link in enumerate(links(path)):
        seeds = all(p["seed"] == seed(before, p["part"]) for p in link["parts"])
        if link["number"] != i or link["prev"] != before or not seeds or link["head"] != _sha("|".join([before, *(p["last"] for p in link["parts"])])):
            bad.append(link["number"])
        before = link["head"]
    return bad
