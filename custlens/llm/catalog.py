"""Queries of the operators: each one over its whole table, full result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm import sql
from custlens.llm.common import read_table
from custlens.session import scratch_path


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def op1_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.token_coder import read_token_files, write_token_files
    path = _scratch(spark, "tokens")
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, with_ids=False)


def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.html_extract import extract_pages
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op3_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.shuffle_shards import write_shards
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return write_shards(docs, _scratch(spark, "shards")).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_oph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.oph_minhash import compare_with_edits
    return compare_with_edits(read_table(spark, sf_dir, "documents"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.decision_list import BASE, fit_rules, judge
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, read_table(spark, sf_dir, "labels"))).select("doc_id", *BASE, "base_failed", "kept")


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, n_chars and text_sha256 of the decoded text."""
    from custlens.llm.piece_sampling import decode_documents, encode_documents
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decode_documents(encode_documents(read_table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.weak_toxicity import fit, score
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.anchor_pii import find_personal_data
    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op9_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.hilbert_pack import pack
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.lsh_forest import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.dialogue_repair import damage, repair_conversations
    return repair_conversations(damage(read_table(spark, sf_dir, "conversations")))


def op12_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.rank_profiles import identify, learn
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op13_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.spelling_groups import misspell, spelling_variants
    return spelling_variants(read_table(spark, sf_dir, "documents"), misspell)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_coder, op2_tag_paths, op3_shuffle_shards, op4_oph_minhash, op5_decision_list, op6_piece_sampling, op7_weak_toxicity, op8_anchor_pii, op9_hilbert_pack, op10_lsh_forest,
              op11_glr_repair, op12_rank_profiles, op13_trie_pairs)
}

ORACLE: dict[str, str] = {"op11_glr_repair": sql.OP11, "op13_trie_pairs": sql.OP13}
