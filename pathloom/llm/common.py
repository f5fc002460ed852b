"""What the operators share: the shared folder, written tables, batches balanced by bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python batch holds at once (a longer text is a batch of its own).
BATCH_BYTES = 4 << 20
#: Upper bound on what is sent to every executor; larger sides are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set to a temporary folder only where it is unset and the master is
    a single process, as in tests.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    there = f"file://{tempfile.mkdtemp(prefix='pathloom-')}"
    spark.conf.set("spark.checkpoint.dir", there)
    spark.sparkContext.setCheckpointDir(there)
    return there


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back: it is
    computed once, survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plan nodes below which a second reading gives the same rows in the same order.
PLAIN = ("Project", "Filter", "LogicalRelation", "LocalRelation")


def read_alike(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it only reads files, which gives the same rows in the same order each time; else a written table of it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo, plain = [plan], plan.deterministic()
    while todo:
        node = todo.pop()
        plain = plain and node.nodeName() in PLAIN
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df if plain else materialise(df, name)


def bounded_batches(spark: SparkSession, mb: int = 16) -> None:
    """Bounds the Arrow batches that Spark sends to Python by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(column: str) -> F.Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string"))


def release() -> None:
    """Gives back to the system what Arrow and the C library keep of freed memory:
    workers live on beside each other, each with the largest block it has had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def of_group(f: Callable) -> Callable:
    """``f`` for applyInPandas on groups; what it used is released after each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        release()
        return out

    return run


def of_cogroup(f: Callable) -> Callable:
    """The same for cogroups."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = f(left, right)
        release()
        return out

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the bytes of ``column`` pass ``limit``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_slices(make: Callable, column: str, limit: int = BATCH_BYTES) -> Callable:
    """For mapInArrow: ``make()`` is called once a task and returns a function
    from a record batch to a record batch, applied to byte-balanced slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                yield apply(part)
                release()

    return run


def as_text(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its rows."""
    return joined_bytes(as_text(column))


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


#: The bytes that separate words are 0x20 and 0x09 to 0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, byte by byte (all bytes of longer characters are above 0x7F).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(column: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a text column, dictionary-encoded, and
    the offsets of its rows in them."""
    data, offsets = joined(column)
    if lower:
        data = LOWER[data]
    inside = ~SPACES[data]
    starts = inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        starts[offsets[:-1][offsets[:-1] < len(data)]] |= inside[offsets[:-1][offsets[:-1] < len(data)]]
    at = np.flatnonzero(starts)
    rows = np.searchsorted(at, offsets)
    kept = np.zeros(len(data) + 1, np.int32)
    np.cumsum(inside, out=kept[1:])
    ends = np.append(kept[at], kept[-1])
    flat = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return flat.dictionary_encode(), rows


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit content hash of each distinct word."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, dictionary.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(dictionary))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that all bits depend on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Blocks: documents in bounded groups, exchanged with buckets of hashed keys as packed arrays.

#: Bytes of text of a block (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20


def deflate(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def inflate(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_arrays(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; ``unpack_arrays`` gives them back."""
    import zstandard

    c = zstandard.ZstdCompressor(level=level)
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = c.compress(a.tobytes())
        parts.append(a.dtype.str.encode().ljust(4) + len(body).to_bytes(8, "little") + body)
    return b"".join(parts)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, size = blob[at : at + 4].decode().strip(), int.from_bytes(blob[at + 4 : at + 12], "little")
        out.append(np.frombuffer(inflate(blob[at + 12 : at + 12 + size]), dtype=kind))
        at += 12 + size
    return out


def new_block() -> int:
    """A random id; unique because the table that holds it is written once."""
    return uuid.uuid4().int & ((1 << 62) - 1)


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, level: int = 3, flag: F.Column | None = None) -> DataFrame:
    """A written table (block, ids, texts): documents in groups of bounded bytes,
    compressed.  Reading it gives the same blocks each time.  ``flag`` is a boolean
    of each row, kept with the ids (null: false)."""
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                data, offsets = joined(part.column(1))
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flags = pc.fill_null(part.column(2), False).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.record_batch([pa.array([new_block()], pa.int64()), pa.array([pack_arrays(ids, np.diff(offsets).astype(np.int64), flags)], pa.binary()), pa.array([deflate(data.tobytes(), level)], pa.binary())], names=["block", "ids", "texts"])
                del data, offsets
                release()

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), (F.lit(False) if flag is None else flag).alias("flag")).where("id is not null")
    return materialise(rows.mapInArrow(apply, "block long, ids binary, texts binary"), "blocks")


def block_texts(ids: bytes, texts: bytes) -> tuple[np.ndarray, pa.Array]:
    """The ids and texts of one block."""
    keys, lengths, _ = unpack_arrays(ids)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return keys, pa.Array.from_buffers(pa.large_string(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(inflate(texts))])


def block_flags(ids: bytes) -> np.ndarray:
    return unpack_arrays(ids)[2].astype(bool)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i, end to end."""
    lengths = lengths.astype(np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
