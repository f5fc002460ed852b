"""A training-data pipeline over ``documents``: each stage calls one operator.

Language identification drops documents without a letter or with a tie of
languages; line deduplication deletes lines that an earlier document holds,
and drops documents that lose all their text; of each group of near copies
(Jaccard of five-word shingles from 0.8) the smallest id stays; documents that
hold a benchmark item go; what is left is encoded and decoded by byte-level
BPE.  Every stage covers all rows of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import byte_bpe, common, decontaminate, language_id, line_dedup, ngram_join
from pathloom.llm.registry import BYTE_BPE

#: Bytes of text that a worker of the last stage encodes at once; the stages before have filled the executors.
BLOCK_BYTES = 4 << 20
#: A text is rejected if the two best languages are nearer than this share of the size.
MIN_MARGIN = 0.0005


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known(docs, language_id.fit(docs), min_margin=MIN_MARGIN)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, _, deleted, emptied = names = tuple(f"__pipeline_{x}" for x in line_dedup.ADDED)
    found = line_dedup.dedup_lines(docs, added=names).where(~F.col(emptied))
    return found.withColumns({"text": F.col(kept), "n_chars": F.when(F.col(deleted) > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = ngram_join.join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__pipeline_copy"))
    return docs.join(copies, docs["doc_id"] == F.col("__pipeline_copy"), "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    coded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=BLOCK_BYTES), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", known_language), ("line_dedup", without_repeated_lines), ("ngram_join", without_near_copies), ("decontaminate", without_benchmark), ("byte_bpe", tokens)]

#: No stage is expressible in SQL as it stands; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
