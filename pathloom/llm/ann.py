"""Approximate nearest neighbours by inner product, with score-aware quantisation.

A vector is cut into subspaces of two dimensions, each coded by one of 16
centres (four bits).  The loss that codes and centres minimise weighs the
residual parallel to the vector ``eta`` times as much as the residual
orthogonal to it, since the parallel error is what moves large inner products.
A query is turned into tables of its inner products with all centres; a scan
adds table entries for every row, two codes (a byte) at a time, and the best
``rerank`` rows of every block are scored exactly.

Rows are dealt into blocks by a hash of their id.  The query set meets every
block; a task scans one block for one group of queries, so its memory is
bounded by the two bounds below and no row is paired with another outside the
scan.  What leaves a task is the exact ``k`` best of each query and block.

Equal vectors of a block are scanned once and share their ids, so copies can't
push others out of the rerank list; ties go to the smaller id.  Vectors that
are null, zero, of another length than most, or hold null or non-finite
components take no part.  Repeated rows with one id count as one each.  Empty
tables give empty results; with fewer candidates than ``k`` all are returned.

The centres are fitted on at most ``SAMPLE_ROWS`` vectors, taken in the order
of a hash of the id; every row is coded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE_ROWS = 4096
#: Rows of a block, queries of a group: together the bound on a task.
BLOCK_ROWS = 8192
GROUP_QUERIES = 4096
#: Queries whose tables are in memory at once.
SCAN_QUERIES = 256
CENTRES = 16
ETA = 4.0


def padded(x: np.ndarray) -> np.ndarray:
    """Columns filled up to a multiple of four: two dimensions a code, two codes a byte."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))


def encode(x: np.ndarray, centres: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes that minimise |r|^2 + (eta - 1) (r.u)^2, one subspace at a time; u is x over its length."""
    m = centres.shape[0]
    parts = x.reshape(len(x), m, 2)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    apart = ((parts[:, :, None, :] - centres[None]) ** 2).sum(3)
    along = np.einsum("nmkd,nmd->nmk", parts[:, :, None, :] - centres[None], unit)
    codes = apart.argmin(2)
    chosen = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
    total = chosen.sum(1)
    for _ in range(rounds):
        for j in range(m):
            others = total - chosen[:, j]
            best = (apart[:, j] + (eta - 1) * (others[:, None] + along[:, j]) ** 2).argmin(1)
            codes[:, j] = best
            chosen[:, j] = along[np.arange(len(x)), j, best]
            total = others + chosen[:, j]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, eta: float = ETA, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centres (subspaces, 16, 2): codes and weighted least squares in turn."""
    rng = np.random.default_rng(seed)
    m = x.shape[1] // 2
    parts = x.reshape(len(x), m, 2)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    centres = np.stack([parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j] for j in range(m)])
    for turn in range(rounds):
        codes = encode(x, centres, 1.0 if turn < rounds // 2 else eta, 1).astype(np.int64)
        weight = 0.0 if turn < rounds // 2 else eta - 1
        residual = parts - np.take_along_axis(centres[None], codes[:, :, None, None], 2)[:, :, 0]
        along = (residual * unit).sum(2)
        total = along.sum(1)
        for j in range(m):
            u, p = unit[:, j], parts[:, j]
            pull = total - along[:, j] + (p * u).sum(1)
            for c in range(CENTRES):
                own = codes[:, j] == c
                if own.any():
                    left = own.sum() * np.eye(2) + weight * u[own].T @ u[own]
                    centres[j, c] = np.linalg.solve(left, p[own].sum(0) + weight * (u[own] * pull[own, None]).sum(0))
    return centres


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] * 16 + codes[:, 1::2]


def scan(packed: np.ndarray, centres: np.ndarray, queries: np.ndarray, kind: np.dtype = np.float32) -> np.ndarray:
    """Approximate inner products (rows, queries) from tables of four-bit codes."""
    tables = np.einsum("qmd,mkd->mkq", queries.reshape(len(queries), -1, 2), centres).astype(kind)
    out = np.zeros((len(packed), len(queries)), kind)
    for j in range(packed.shape[1]):
        pair = (tables[2 * j][:, None, :] + tables[2 * j + 1][None, :, :]).reshape(256, -1)
        out += pair[packed[:, j]]
    return out


def leaders(scores: np.ndarray, n: int) -> np.ndarray:
    """Rows of the n largest scores, ties at the end to the first rows."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: n - len(above)]])


def search_block(ids: np.ndarray, x: np.ndarray, packed: np.ndarray, qids: np.ndarray, q: np.ndarray, centres: np.ndarray, k: int, rerank: int) -> list[tuple[int, int, float]]:
    """The k best rows of one block for each query: (query id, row id, exact score)."""
    order = np.argsort(ids, kind="stable")
    ids, x, packed = ids[order], x[order], packed[order]
    _, first, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    lead = np.argsort(first, kind="stable")  # distinct vectors in the order of their smallest ids
    vectors = x[first[lead]].astype(np.float64)
    codes = packed[first[lead]]
    found = []
    for at in range(0, len(q), SCAN_QUERIES):
        part = q[at : at + SCAN_QUERIES]
        approx = np.ascontiguousarray(scan(codes, centres, padded(part), x.dtype).T)
        for i in range(len(part)):
            rows = leaders(approx[i], rerank)
            exact = (vectors[rows] * part[i].astype(np.float64)).sum(1)
            best = sorted(zip(-exact, rows, strict=True))
            out: list[tuple[float, int]] = []
            for negative, row in best:
                if len(out) >= k and -negative < out[k - 1][0]:
                    break
                g = lead[row]
                own = ids[by_group[starts[g] : min(starts[g] + k + 1, starts[g + 1])]]
                out += [(float(-negative), int(v)) for v in own if v != qids[at + i]][:k]
                out.sort(key=lambda e: (-e[0], e[1]))
                out = out[:k]
            found += [(int(qids[at + i]), v, s) for s, v in out]
    return found


def element(vectors: DataFrame, vector_col: str) -> str:
    """float for columns of floats; all others are read as doubles, so no component is rounded or lost."""
    return "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"


def usable(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(f"array<{kind}>").alias("v"))
    v = v.where(f"vec_id is not null and v is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < cast('infinity' as {kind})) and exists(v, e -> e <> 0)")
    widths = v.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return v.where(F.size("v") == (widths[0]["width"] if widths else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 100, eta: float = ETA, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per query the k nearest other rows found: query_id, rank, vec_id, score (exact, double)."""
    spark = vectors.sparkSession
    kind = "float" if element(vectors, vector_col) == element(queries, vector_col) == "float" else "double"
    stored = np.float32 if kind == "float" else np.float64
    rows, asked = usable(vectors, id_col, vector_col, kind), usable(queries, id_col, vector_col, kind)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, n_asked = rows.count(), asked.count()
    if not n or not n_asked:
        return empty
    share = min(1.0, 1.2 * SAMPLE_ROWS / n)
    sample = rows.where(F.xxhash64("vec_id").cast("double") / 2.0**64 + 0.5 <= share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    centres = fit(padded(np.array([r["v"] for r in sample or rows.limit(SAMPLE_ROWS).collect()], dtype=np.float64)), eta)
    shared = spark.sparkContext.broadcast(centres)  # 32 numbers for every two dimensions
    blocks, groups = math.ceil(n / block_rows), math.ceil(n_asked / GROUP_QUERIES)

    def code(batches):
        for pdf in batches:
            x = padded(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])) if len(pdf) else np.zeros((0, 4))
            packed = pack(encode(x, shared.value, eta)) if len(x) else np.zeros((0, 1), np.uint8)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": [np.asarray(v, dtype=stored).tobytes() for v in pdf["v"]], "code": [c.tobytes() for c in packed]})

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x = np.frombuffer(b"".join(left["v"]), stored).reshape(len(left), -1)
        packed = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
        q = np.stack([np.asarray(v, dtype=np.float64) for v in right["v"]])
        return pd.DataFrame(search_block(left["vec_id"].to_numpy(), x, packed, right["query_id"].to_numpy(), q, shared.value, k, rerank), columns=columns)

    index = rows.mapInPandas(code, "vec_id long, v binary, code binary").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    left = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("g")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(task, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
