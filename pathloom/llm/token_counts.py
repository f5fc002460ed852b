"""Token counts of a sentencepiece model, in Arrow batches, lengths only.

Batches are balanced by bytes.  Texts are split where a single space stands
between two other characters: no piece of the model goes on over a space, and
the model puts the same mark before a segment as it makes of that space, so
the counts of the segments add up to the count of the whole text.  Each
distinct segment of a batch is encoded once.

Null and empty texts have no bytes and no tokens.  Rows are kept one to one,
so ties, copies and extra columns need no treatment; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

#: The mark that stands for a space in the model's pieces.
MARK = "▁"
#: Texts whose every space is a safe boundary lack this.
ODD = f"  |^ | $|{MARK}"
SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts, and how many each text has."""
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    if not odd.any():
        parts = pc.split_pattern(texts, " ")
        return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    lists = [SAFE.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd, strict=True)]
    return pa.array([s for x in lists for s in x], pa.string()), np.array([len(x) for x in lists])


def counts(model, texts: pa.Array) -> np.ndarray:
    flat, sizes = segments(texts)
    coded = flat.dictionary_encode()
    lengths = np.fromiter(map(len, model.encode(coded.dictionary.to_pylist(), num_threads=1)), np.int64, len(coded.dictionary))
    total = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)])])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return total[ends[1:]] - total[ends[:-1]]


def check_safe(model) -> None:
    """A space is a safe boundary only if no piece has its mark after another character."""
    for i in range(model.get_piece_size()):
        if re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)):
            raise ValueError("a piece of this model goes on over a space; its texts can't be split")


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = common.BATCH_BYTES) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    import sentencepiece

    spark = docs.sparkSession
    common.bounded_batches(spark)
    with open(model_path, "rb") as f:
        proto = f.read()
    check_safe(sentencepiece.SentencePieceProcessor(model_proto=proto))
    shared = spark.sparkContext.broadcast(proto)  # under a megabyte

    def make():
        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.as_text(batch.column(1))
            n = counts(model, texts)
            return pa.record_batch([batch.column(0).cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

        return apply

    out = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(common.map_slices(make, "text", batch_bytes), "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
