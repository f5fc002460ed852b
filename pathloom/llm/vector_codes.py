"""Vector code compression: product codes learnt by Lloyd's algorithm over distinct integer parts.

Components become integers, ``floor(scale * x)``, and vectors are cut into
equal parts.  Equal parts at one position are one weighted row, so each round
works on distinct rows only: a batch of them gives its nearest entries and
sums, weights included, and only entries times parts rows of sums meet.  The
codebooks start from the parts of the smallest ids.  At the end each distinct
part has a code and an error, which are joined back to the vectors.  The
weights tell which parts are frequent, so that a part that a third of all
vectors share is joined by broadcast and all others by a shuffle.

Dropped are vectors that are null or hold a null or non-finite component.  All
others must have one length, a multiple of the number of parts, and components
below 2^19 in size (so that all sums of squares fit 64 bits); otherwise an
error says so.  Rows are coded each by itself: repeated and null ids keep their own row (for the start of
the codebooks, equal ids come in the order of their vectors, null ids last).  Fewer vectors than entries give as many entries; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lookup import join_counted

#: Components are smaller than this after scaling: 2^27.
MOST = 1 << 27
#: Distances are worked out for so many parts at once.
CHUNK = 4096


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance), ties to the lower index, in 64-bit integers."""
    index, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for at in range(0, len(parts), CHUNK):
        apart = ((parts[at : at + CHUNK, None, :] - book[None]) ** 2).sum(axis=2)
        index[at : at + CHUNK] = apart.argmin(axis=1)
        distance[at : at + CHUNK] = apart.min(axis=1)
    return index, distance


def values(column: pa.Array) -> np.ndarray:
    """A list column whose rows have the same length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows, parts) of a batch with columns pos and part."""
    pos, parts = batch.column("pos").to_numpy(), values(batch.column("part"))
    for p in np.unique(pos).tolist():
        rows = np.flatnonzero(pos == p)
        yield p, rows, parts[rows]


def sums(distinct: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(position, entry) -> (weight, weighted sums of components): one row for each entry in use, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = batch.column("n").to_numpy()
            for p, rows, parts in by_position(batch):
                index, _ = nearest(parts, books[p])
                own = weight[rows]
                exact = np.int64 if float(np.abs(parts).max()) * float(own.sum()) < 1 << 62 else object
                total, held = np.zeros((books.shape[1], parts.shape[1]), exact), np.zeros(books.shape[1], np.int64)
                np.add.at(total, index, parts.astype(exact) * own[:, None].astype(exact))
                np.add.at(held, index, own)
                used = np.flatnonzero(held)
                yield pa.record_batch([pa.array(np.full(len(used), p)), pa.array(used), pa.array(held[used]), pa.array([[decimal.Decimal(int(x)) for x in t] for t in total[used]], pa.list_(pa.decimal128(38)))], names=["pos", "entry", "n", "total"])

    found = distinct.mapInArrow(run, "pos long, entry long, n long, total array<decimal(38,0)>")
    wide = [F.sum(F.get("total", i)).alias(f"c{i}") for i in range(books.shape[2])]
    return {(r.pos, r.entry): (int(r.n), [int(r[f"c{i}"]) for i in range(books.shape[2])]) for r in found.groupBy("pos", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *wide).collect()}


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(per kept vector: id, label, ``codes`` (array of entries' indices), ``error``, ``label_error``; the codebooks, parts x entries x components)."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    kept = common.materialise(kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("x", lambda v: F.floor(F.greatest(F.least(v, F.lit(float(MOST))), F.lit(float(-MOST))) * scale)).alias("q")), "vectors")
    shape = kept.agg(F.count("*").alias("n"), F.min(F.size("q")).alias("least"), F.max(F.size("q")).alias("most"), F.max(F.array_max(F.transform("q", lambda v: F.abs(v)))).alias("largest")).first()
    named = lambda df: df.withColumnsRenamed({"id": id_col, "label": label_col})
    if not shape.n:
        return named(kept.select("id", "label", F.col("q").alias("codes"), F.col("row").alias("error"), F.col("row").alias("label_error"))), np.zeros((parts, 0, 0), np.int64)
    if shape.least != shape.most or shape.least % parts or not shape.least or shape.largest >= MOST:
        raise ValueError(f"vectors must have one length, a multiple of {parts}, and components below {MOST} after scaling; found lengths {shape.least} to {shape.most}, components to {shape.largest}")
    width = shape.least // parts
    first = kept.orderBy(F.asc_nulls_last("id"), "q", "row").limit(entries).select("q").collect()  # the codebooks' start
    books = np.array([r.q for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    single = kept.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("q", i * width + 1, width))).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))
    distinct = common.materialise(single.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds):
        for (p, e), (n, total) in sums(distinct, books).items():
            books[p, e] = [x // n for x in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, rows, own in by_position(batch):
                code[rows], error[rows] = nearest(own, books[p])
            yield pa.record_batch([batch.column("pos"), batch.column("part"), batch.column("n"), pa.array(code), pa.array(error)], names=["pos", "part", "n", "code", "error"])

    coded = common.materialise(distinct.mapInArrow(assign, "pos long, part array<long>, n long, code long, error long"), "codes")
    met = join_counted(single, coded, ["pos", "part"], "n", shape.n * parts)
    of_row = met.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"]).alias("codes"), F.sum("error").alias("error"))
    found = common.materialise(of_row.join(kept.select("row", "id", "label"), "row").select("id", "label", "codes", "error"), "coded")
    labels = common.materialise(found.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    out = join_counted(found, labels, ["label"], "n", shape.n).select("id", "label", "codes", "error", "label_error")
    return named(out), books
