"""Byte-level BPE by a global shuffle of distinct words, and its decoding.

Every text is cut at the spaces that stand between two characters that are no
white space; the pattern always has a boundary there, so each such word (with
its leading space) can be encoded alone, every match of the pattern in it
separately.  A task turns a block of texts into its distinct words and, for
each document, the positions as a sequence of word numbers (the exploded
pre-tokens, packed).  The distinct words are dealt into buckets by hash;
a bucket encodes each distinct word once.  The ids go back to the blocks and
are put together by position.  Decoding joins the table of token bytes, which
is as large as the vocabulary, and needs nothing else.

Words are aggregated in each block before the shuffle, so a word that all
texts share is one entry a block.  Null texts are empty; empty texts have no
ids and decode to no bytes.  Rows with a null id are left out, since nothing
could be joined to them; rows that share an id are encoded each by itself.  The
input is read twice and must give its rows in the same order; what is more than
a reading of files (a join, a shuffle) is written as a table first.  Copies,
ties and extra columns need no treatment; a column ``decoded`` gives way to the
one that ``decode`` adds.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space of the pattern, for RE2, next to a space: where a plain cut isn't safe.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
ODD = rf"{WHITE} | {WHITE}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, dictionary-encoded, and how many each text has.
    A word but the first of its text stands without its leading space and a mark
    in front of it: ``\\x01`` for a space, ``\\x02`` for none."""
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    if odd.any():
        import regex

        safe = regex.compile(r"(?<=\S) (?=\S)")
        lists = [safe.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd, strict=True)]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = pa.array([w for x in lists for w in x], pa.string())
    else:
        parts = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten().cast(pa.string())
    coded = flat.dictionary_encode()
    first = np.zeros(len(flat), dtype=bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = True
    # a word that opens a text is another word than the same one after a space
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + ~first
    kept, number = np.unique(number, return_inverse=True)
    marks = pa.array(np.where(kept % 2 == 1, "\x01", "\x02"), pa.string())
    dictionary = pc.binary_join_element_wise(marks, coded.dictionary.take(pa.array(kept // 2)), "")
    return pa.DictionaryArray.from_arrays(pa.array(number.astype(np.int32)), dictionary), sizes


def scatter(ids: np.ndarray, texts: pa.Array, buckets: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The positions of a block, and its distinct words by bucket; words are numbered by bucket, then as they come there."""
    coded, sizes = cut(texts)
    bucket = (common.hash_words(coded.dictionary.cast(pa.binary())) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    positions = common.pack_arrays(ids, sizes, number[coded.indices.to_numpy(zero_copy_only=False)], level=3)
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    words = coded.dictionary.take(pa.array(order))
    out = []
    for b in np.flatnonzero(np.diff(ends)):
        data, offsets = common.joined(words.slice(ends[b], ends[b + 1] - ends[b]))
        out.append((int(b), common.pack_arrays(np.diff(offsets).astype(np.int32), data, level=3)))
    return positions, out


def encode_words(model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, how many of each word); each distinct word is encoded once."""
    coded = words.dictionary_encode()
    found = [model.encode_ordinary(" " + w[1:] if w[0] == "\x01" else w[1:]) for w in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy(zero_copy_only=False)
    return flat[common.spans(starts[which], sizes[which])], sizes[which]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = common.BLOCK_BYTES) -> DataFrame:
    """Per row: id, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary
    buckets = 4 * common.partitions(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null")
    rows = common.read_alike(rows, "texts")

    def cut_blocks(batches):
        """Blocks of the task's rows: (block, positions, words by bucket).  The id of a block is made
        from its place and its rows, so that both readings below name it alike."""
        import xxhash
        from pyspark import TaskContext

        place = 0
        for batch in batches:
            for part in common.slices(batch, "text", block_bytes):
                ids, texts = part.column(0).to_numpy(zero_copy_only=False), common.as_text(part.column(1))
                data, offsets = common.joined(texts)
                seen = xxhash.xxh3_64(f"{TaskContext.get().partitionId()}/{place}")
                for a in (ids, offsets, data):
                    seen.update(np.ascontiguousarray(a).tobytes())
                place += 1
                yield seen.intdigest() >> 1, *scatter(ids, texts, buckets)
                del ids, texts, data, offsets
                common.release()

    def cut_positions(batches):
        for block, positions, _ in cut_blocks(batches):
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([positions], pa.binary())], names=["block", "positions"])

    def cut_words(batches):
        for block, _, out in cut_blocks(batches):
            yield pa.record_batch([pa.array([block] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([w for _, w in out], pa.binary())], names=["block", "bucket", "words"])

    def encode_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        model = encoder(shared.value, pattern)
        sizes, data = zip(*(common.unpack_arrays(w) for w in pdf["words"]), strict=True)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])
        ids, lengths = encode_words(model, words)
        word_ends = np.cumsum([len(s) for s in sizes])
        id_ends = np.concatenate([[0], np.cumsum(lengths)])
        out = [common.pack_arrays(lengths[e - len(s) : e].astype(np.uint32), ids[id_ends[e - len(s)] : id_ends[e]]) for s, e in zip(sizes, word_ends, strict=True)]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "ids": out})

    def put_together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) != 1 or right.empty:
            raise ValueError("the rows came in another order when they were read again; write them as a table first")
        keys, sizes, numbers = common.unpack_arrays(left["positions"].iloc[0])
        parts = [common.unpack_arrays(b) for _, b in sorted(zip(right["bucket"], right["ids"], strict=True))]
        lengths = np.concatenate([p[0] for p in parts]).astype(np.int64)
        flat = np.concatenate([p[1] for p in parts])
        starts = np.cumsum(lengths) - lengths
        tokens = flat[common.spans(starts[numbers], lengths[numbers])]
        ends = np.concatenate([[0], np.cumsum(lengths[numbers])])[np.concatenate([[0], np.cumsum(sizes)])]
        return pd.DataFrame({"id": keys, "n_tokens": np.diff(ends), "ids": [tokens[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    # the rows are read twice: what moves is the words and ids of the blocks, and once the positions
    words = rows.mapInArrow(cut_words, "block long, bucket int, words binary")
    replies = words.groupBy("bucket").applyInPandas(common.of_group(encode_bucket), "block long, bucket int, ids binary")
    positions = rows.mapInArrow(cut_positions, "block long, positions binary")
    out = positions.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(common.of_cogroup(put_together), "id long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the tokens, joined from the vocabulary table."""
    spark, encoded = encoded.sparkSession, encoded.drop("decoded")
    ranks = read_ranks(ranks_path)
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)  # as large as the vocabulary
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)

    def apply(batches):
        tokens = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            for part in common.slices(batch, ids_col):
                ids = part.column(at)
                data, offsets = common.joined_bytes(ids)
                pieces = tokens.take(pa.array(np.frombuffer(data, "<u4")))
                joined, ends = common.joined_bytes(pieces)
                cuts = ends[offsets // 4]
                whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(joined)])
                yield pa.record_batch([*part.columns, whole.cast(pa.binary())], names=[*part.schema.names, "decoded"])
                del ids, data, offsets, pieces, joined, ends, cuts, whole
                common.release()

    return encoded.mapInArrow(apply, f"{schema}, decoded binary")
