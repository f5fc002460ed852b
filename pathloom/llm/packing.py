"""Harmonic packing: sequences of at most ``capacity`` ids, by classes of reciprocal capacity.

A document is cut from the front into pieces of ``capacity``, then of the
powers of two below it that its rest holds, down to ``least``; what is left,
shorter than ``least``, stays whole.  A piece of length t belongs to the class
k = floor(capacity / t), whose bins take exactly k pieces; a class is filled
length by length, so that a piece's place follows from its rank alone: the bin
is rank div k and the offset (rank mod k) * t.

Workers tokenise their documents, cut them and number their pieces by length;
a running sum over the workers' counts (one row for each worker and length)
tells every worker at which rank its pieces begin, and each then fills bins by
itself.  The pieces aren't shuffled.  Bins of powers of two are full without
padding.  Of each length fewer than k pieces are over.  Those of a power of
two form sequences whose lengths are powers of two again, which need no
padding; those of another length are cut into powers of two first.  So padding
is only what k * t lacks of the capacity in the full bins of lengths below
``least`` (with 64 and 2,048 about one in two thousand ids).

Null and empty texts are the closing id alone; a very long text is many full
pieces.  Rows are packed each by itself, so ties, copies, repeated and null ids
need no treatment, and other columns are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, word_bpe


def bits(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def cut(lengths: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these lengths, in order."""
    powers = capacity >> np.arange(1, (capacity // least).bit_length())
    rest = lengths % capacity
    sizes = np.concatenate([np.full((len(lengths), 1), capacity), np.broadcast_to(powers, (len(lengths), len(powers))), (rest % least)[:, None]], axis=1)
    counts = np.concatenate([(lengths // capacity)[:, None], (rest[:, None] & powers) > 0, (rest % least > 0)[:, None]], axis=1)
    pieces = np.repeat(sizes.ravel(), counts.ravel())
    document = np.repeat(np.arange(len(lengths)), counts.sum(axis=1))
    ends = np.cumsum(pieces)
    return document, ends - pieces - (np.cumsum(lengths) - lengths)[document], pieces


class Layout:
    """Where the piece of a length and rank lies, from the number of pieces of each length."""

    def __init__(self, totals: dict[int, int], capacity: int, least: int):
        self.capacity, self.least, self.n, self.sequences = capacity, least, totals, 0
        self.base: dict[tuple[int, bool], int] = {}
        self.over: dict[tuple[int, bool], int] = {}
        small: dict[int, int] = {}
        self.before: dict[tuple[int, int], int] = {}
        for t in sorted(totals):
            over = totals[t] % (capacity // t)
            if t < least:
                for p in bits(t):
                    self.before[t, p] = small.get(p, 0)
                    small[p] = self.before[t, p] + over
            self.add((t, False), totals[t], over if t >= least else 0)
        for p, n in sorted(small.items()):
            self.add((p, True), n, n % (capacity // p))
        self.small = small

    def add(self, key: tuple[int, bool], n: int, over: int) -> None:
        self.base[key], self.over[key] = self.sequences, over
        self.sequences += n // (self.capacity // key[0]) + len(bits(over))

    def place(self, length: int, rank: np.ndarray, small: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces of one length; ``small``: those that were cut to a power of two below ``least``."""
        k, n = self.capacity // length, (self.small if small else self.n)[length]
        base, full, groups = self.base[length, small], n // k, bits(self.over[length, small])
        sequence, offset = base + rank // k, rank % k * length
        late = rank >= full * k
        if late.any():
            starts = np.concatenate([[0], np.cumsum(groups)[:-1]]).astype(np.int64)
            q = rank[late] - full * k
            group = np.searchsorted(starts, q, side="right") - 1
            sequence[late], offset[late] = base + full + group, (q - starts[group]) * length
        return sequence, offset

    def pieces(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the row's piece, length, sequence, offset), one row more for each further cut."""
        parts = []
        for t in np.unique(length).tolist():
            at = np.flatnonzero(length == t)
            kept = rank[at] < self.n[t] // (self.capacity // t) * (self.capacity // t) if t < self.least else np.ones(len(at), bool)
            rows = at[kept]
            parts.append((rows, np.zeros(len(rows), np.int64), np.full(len(rows), t), *self.place(t, rank[rows])))
            rows, start = at[~kept], 0
            if len(rows):
                first = self.n[t] // (self.capacity // t) * (self.capacity // t)
                for p in bits(t):
                    parts.append((rows, np.full(len(rows), start), np.full(len(rows), p), *self.place(p, self.before[t, p] + rank[rows] - first, small=True)))
                    start += p
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Neighbouring runs of ids as binary values."""
    ends = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data, dtype="<u4"))])


def pieces(docs: DataFrame, tokenizer: str, closing: int, capacity: int, least: int, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """A written table of the pieces, with the worker that cut them and their rank among its pieces of the same length."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, seen, words = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_bpe.loaded(shared.value)
        for batch in batches:
            for part in common.slices(batch, "text", batch_bytes):
                flat, sizes = words.of(common.as_text(part.column(1)))
                ids = np.full(len(flat) + len(sizes), closing, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
                document, start, length = cut(sizes + 1, capacity, least)
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
                seen += counts
                yield pa.record_batch([part.column(0).take(pa.array(document)), pa.array(start), pa.array(length), binaries(ids, length).cast(pa.binary()), pa.array((sizes + 1)[document]), pa.array(np.full(len(length), worker)), pa.array(rank)], names=["id", "start", "length", "ids", "doc_tokens", "worker", "rank"])
                common.release()

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return common.materialise(rows.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, worker long, rank long"), "pieces")


def pack(docs: DataFrame, tokenizer_path: str, closing: int = 1, capacity: int = 2048, least: int = 64, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = common.BATCH_BYTES) -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    if capacity & capacity - 1 or least & least - 1 or not 1 <= least <= capacity:
        raise ValueError("capacity and least must be powers of two")
    spark = docs.sparkSession
    common.bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        cutted = pieces(docs, f.read(), closing, capacity, least, id_col, text_col, batch_bytes)
    counts = common.materialise(cutted.groupBy("worker", "length").agg(F.count("*").alias("n")), "counts")
    # at most least + log2(capacity) lengths
    layout = Layout({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, least)
    earlier = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("worker", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    if counts.count() * 24 <= common.BROADCAST_BYTES:
        begins = F.broadcast(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            row, start, size, sequence, offset = layout.pieces(length, rank)
            data, ends = common.joined_bytes(batch.column(3))
            picked = data.view("<u4")[common.spans(ends[row] // 4 + start, size)]
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(batch.column(1).to_numpy()[row] + start), pa.array(size), binaries(picked, size).cast(pa.binary()), batch.column(4).take(pa.array(row)), pa.array(sequence), pa.array(offset)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    ranked = cutted.join(begins, ["worker", "length"]).select("id", "start", "length", "ids", "doc_tokens", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
