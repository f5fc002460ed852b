"""Inputs whose order is not stable, repeated and null ids, clashing names."""

import struct

import public_tokenizers as P
from pyspark.sql import functions as F

from pathloom.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_after_a_shuffle(spark):
    texts = [f"some words of text {i} and  more\n of it" for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, "again"), (None, "left out")], "doc_id long, text string")
    docs = docs.repartition(5).join(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id").withColumn("decoded", F.rand()).withColumn("text", F.col("text"))
    model = byte_bpe.encoder(byte_bpe.read_ranks(PATH), P.PATTERN)
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN, block_bytes=2000), PATH).collect()
    want = sorted([(i, t) for i, t in enumerate(texts)] + [(7, "again")])
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in rows) == want
    assert all(bytes(r.ids) == struct.pack(f"<{r.n_tokens}I", *model.encode_ordinary(bytes(r.decoded).decode())) for r in rows)
    clash = spark.createDataFrame([(1, struct.pack("<I", model.encode_ordinary("a")[0]), "x")], "doc_id long, ids binary, decoded string")
    assert [tuple(r) for r in byte_bpe.decode(clash, PATH).selectExpr("doc_id", "cast(decoded as string)").collect()] == [(1, "a")]
