"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.llm import (
    licences, lm_scoring, mixing, near_dup, pieces, pii, prefix_trie, quality, rendezvous, token_codes, topk,
    whitening, winnow)
from ticketloom.llm.staging import table


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; they are installed beside the interpreter, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cross_entropy_difference(spark, sf_dir):
    return lm_scoring.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_codes(spark, sf_dir):
    return token_codes.digest(table(spark, sf_dir, "documents"),
                              tokenizer_path("word_bpe_49k.json"))


def op3_branch_and_bound_topk(spark, sf_dir):
    return topk.digest(table(spark, sf_dir, "embeddings"))


def op4_probminhash_classes(spark, sf_dir):
    return near_dup.digest(table(spark, sf_dir, "documents"))


def op5_subword_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nbest_pieces(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


SHARDS = 40


def op7_rendezvous_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"))
    placed = rendezvous.with_shards(docs, "doc_id", [1.0] * SHARDS)
    slotted = rendezvous.with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return rendezvous.with_shards(slotted, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")


def op8_winnow_contamination(spark, sf_dir):
    return winnow.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licence_dice(spark, sf_dir):
    return licences.digest(table(spark, sf_dir, "documents"))


def op10_pii_spans(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


def op12_source_mix(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op13_refined_whitening(spark, sf_dir):
    return whitening.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {q.__name__: q for q in (
    op1_cross_entropy_difference, op2_token_codes, op3_branch_and_bound_topk,
    op4_probminhash_classes, op5_subword_quality, op6_nbest_pieces, op7_rendezvous_shards,
    op8_winnow_contamination, op9_licence_dice, op10_pii_spans, op11_prefix_trie, op12_source_mix,
    op13_refined_whitening)}
#: The others hold checksums, learned scores or searches that SQL cannot state; tests compare them
#: with brute force, exact round trips or held-out labels.
ORACLES = {
    "op1_cross_entropy_difference": lm_scoring.ORACLE,
    "op3_branch_and_bound_topk": topk.ORACLE,
    "op8_winnow_contamination": winnow.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_source_mix": mixing.ORACLE,
}
