"""Registered queries of this package: thin digests over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tickloom.llm import binary_tokens, chat, embed_dedup, fim, jaccard, lines, mixing, packing, pii, quality, runs, suffixes, topk
from tickloom.llm.common import scan, table_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_vector_file_topk(spark, sf_dir):
    return topk.top_k(scan(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_ranked_token_files(spark, sf_dir):
    blocks, by_rank = binary_tokens.write_binary(scan(spark, sf_dir, "documents"), VOCABULARY, table_path(spark, "token_files"))
    return binary_tokens.read_binary(blocks, by_rank)


def op3_winnow_lines(spark, sf_dir):
    done = lines.dedup_lines(scan(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op4_pca_near_duplicates(spark, sf_dir):
    return embed_dedup.near_duplicates(scan(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_cotrained_quality(spark, sf_dir):
    return quality.score(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "p_quality", "keep")


def op6_minimum_slack_packing(spark, sf_dir):
    return packing.pack(scan(spark, sf_dir, "documents"), VOCABULARY, capacity=2048)


def op7_grouped_prefix_join(spark, sf_dir):
    return jaccard.near_duplicates(scan(spark, sf_dir, "documents"), k=5, percent=80)


def op8_cube_mixing(spark, sf_dir):
    return mixing.mix(scan(spark, sf_dir, "documents"), weights=(5, 2, 1), ceiling=3.0)


def op9_collapse_snapshots(spark, sf_dir):
    return chat.format_chats(scan(spark, sf_dir, "conversations"))


def op10_bilstm_crf_pii(spark, sf_dir):
    return pii.digest(scan(spark, sf_dir, "documents"))


def op11_induced_suffix_dedup(spark, sf_dir):
    return suffixes.digest(scan(spark, sf_dir, "documents"), length=50)


def op12_fill_in_middle(spark, sf_dir):
    return fim.digest(scan(spark, sf_dir, "documents"))


def op13_harmonic_runs(spark, sf_dir):
    return runs.digest(scan(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_file_topk, op2_ranked_token_files, op3_winnow_lines, op4_pca_near_duplicates, op5_cotrained_quality, op6_minimum_slack_packing, op7_grouped_prefix_join,
        op8_cube_mixing, op9_collapse_snapshots, op10_bilstm_crf_pii, op11_induced_suffix_dedup, op12_fill_in_middle, op13_harmonic_runs,
    )
}
