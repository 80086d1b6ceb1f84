"""The corpus pipeline: quality, line dedup, near-duplicate join, mixing, packing.

Each stage takes the documents its predecessor kept. A stage's table is written
to the shared folder as Parquet and read again. No stage but the last changes
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import jaccard, lines, mixing, packing, quality
from tickloom.llm.common import scan, stage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; a null text is an
    empty one, and without usable labels every document stays."""
    return quality.score(docs, scan(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; one that loses all its lines was
    a copy and goes. n_chars follows the text."""
    done = lines.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near-duplicates, and one of its rows
    where it is repeated word for word; documents without words or doc_id stay."""
    found = jaccard.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.where("doc_id IS NOT NULL").hint("merge").join(found, "doc_id", "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("__row")
    one = rest.groupBy("doc_id", "text").agg(first).select("doc_id", "text", "__row.*") if others else rest.distinct()
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows are known to it by two hashes
    of their whole content; equal rows share what is taken of them. A null text has no
    words; documents of a source without any are never taken."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    numbers = [F.xxhash64(*every).alias("__a"), F.xxhash64(F.lit("again"), *every).alias("__b")]
    taken = mixing.mix(docs.select(*numbers, "text", "source"), ids=("__a", "__b")).where("copies > 0").groupBy("__a", "__b").agg(F.sum("copies").alias("__copies"))
    # One shuffle of the texts serves both the distinct rows and the join.
    alone = docs.select(F.struct(*every).alias("__row"), *numbers).groupBy("__a", "__b").agg(F.first("__row").alias("__row"))
    both = alone.hint("merge").join(taken, ["__a", "__b"])
    return both.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens; a null or empty text is the
    end id alone, and no documents are no pieces."""
    return packing.pack(docs, VOCABULARY, 2048)


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", keep_one_of_group), ("mixing", mix_sources), ("packing", pack_sequences)]

# The classifier is fitted, so SQL cannot state the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
