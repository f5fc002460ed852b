"""The queries of this subpackage and their DuckDB SQL.

A query reads whole tables, applies its operator with production parameters
and derives the columns of its contract.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, conversation_trie, decontaminate, html_extract, language_id, line_dedup, lm_score, ngram_join, oracles, packing, suffix_dedup, token_counts, vector_codes
from .common import crc, table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "emptied", "kept_text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.fit(docs.where(crc("doc_id") % 4 != 2))
    found = language_id.identify(docs, dictionaries)
    return found.select("doc_id", (crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents"), crc("doc_id") % 5 != 1)
    return found.select("doc_id", (crc("doc_id") % 5 == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), closing=1, capacity=2048)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = conversation_trie.encode_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.share_openings(coded, block=20, ways=4))


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_wrappers, op2_anisotropic_search, op3_suffix_dedup, op4_line_dedup, op5_byte_bpe, op6_token_counts, op7_language_id, op8_ngram_join, op9_decontaminate, op10_lm_score, op11_harmonic_packing, op12_vector_codes, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": oracles.SUFFIX_DEDUP, "op8_ngram_join": oracles.NGRAM_JOIN, "op12_vector_codes": oracles.VECTOR_CODES, "op13_conversation_trie": oracles.CONVERSATION_TRIE}
