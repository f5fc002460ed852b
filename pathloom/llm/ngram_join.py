"""Jaccard self-join of documents on word shingles, by T-occurrence search.

A document is the set of its word shingles.  Two documents link when
100 |A and B| >= 80 |A or B|; a partner of a set of n shingles must then share
T = ceil(0.8 n) of them.  As in DivideSkip, the inverted lists of a document's
shingles are divided: its T - 1 longest lists are set aside, the n - T + 1
shortest are merged, since a partner must be in one of those, and what they
find is probed in the long ones by binary search.

Lengths of lists: each block of documents sends its distinct shingles with
their counts to buckets by hash, which add up and answer.  A document of which
fewer than T shingles occur elsewhere has no partner and goes no further.
Documents with equal sets become one.  The short lists are merged by a shuffle
on the shingle.

A list may hold a third of all documents, so a list doesn't emit all its
pairs.  First it names one document, and its members are verified against that
one; what links is joined to components.  Lists whose members are all in one
component are done.  In further rounds each document that is in an unfinished
list meets ``NAMED`` documents of its two longest unfinished lists.  After
``ROUNDS`` rounds all pairs of a list that are still in different components
are verified, but for those whose sizes, positions in the list or parity
sketches rule a link out (each toggles a bit for every shingle, so that the
bits in which two sketches differ are at most the shingles that only one set
has).  A pair in many lists is made at the first, or after a list that only one
of the two is in.  No pair is given up, so components are exact.  Each round
joins the components of the round before, not all links found.

Null texts, empty texts and texts without words have no shingles and link with
nothing.  Texts with fewer words than a shingle have one: all their words.
Shingles are compared by 48 bits of their hash.  Rows with a null id are left
out.  Rows that share an id are one document, for which the largest of their sets
stands (of equally large ones the greatest in bytes); each row comes back once,
with its own number of shingles and the component of its id.  Copies, ties and
extra columns need no treatment; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components
from .lm_score import bucket_of, trim, widen

WORDS = 5
ROUNDS = 4
#: Documents that a list names in a round but the first.
NAMED = 6
#: Bytes of text of a block: what a Python worker holds grows with it.
BLOCK_BYTES = 4 << 20
#: A link needs 100 I >= PERCENT U.
PERCENT = 80


def shingle_sets(texts, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle values of all texts, ascending within a text, and the offsets of the texts."""
    coded, rows = common.words(texts)
    count = np.diff(rows)
    h = common.hash_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    values, owner = [], []
    for width in range(1, k + 1):
        docs = np.flatnonzero(count >= k if width == k else count == width)
        starts = common.spans(rows[docs], count[docs] - width + 1)
        value = np.full(len(starts), np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64)))
        for i in range(width):
            value = common.mix(value ^ h[starts + i]) * np.uint64(0xE7037ED1A0B428DB)
        values.append(common.mix(value))
        owner.append(np.repeat(docs.astype(np.int32), count[docs] - width + 1))
        del starts, value
    del coded, h
    value, doc = np.concatenate(values), np.concatenate(owner)
    del values, owner
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    del order
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(rows)))


def need(n):
    """T: the shingles that a partner of a set of n must share."""
    return (n * PERCENT + 99) // 100


def shared_sets(docs: DataFrame, id_col: str, text_col: str, k: int, block_bytes: int) -> DataFrame:
    """(doc_id, n, shared): of sets that may have a partner the shingles that occur elsewhere,
    six bytes each, in one order for all documents: by length of list, then by value."""
    buckets = 4 * common.partitions(docs.sparkSession)
    blocks = common.text_blocks(docs, id_col, text_col, block_bytes)

    def scatter(batches):
        for pdf in batches:
            for block, ids, texts in zip(pdf["block"], pdf["ids"], pdf["texts"], strict=True):
                value, _ = shingle_sets(common.block_texts(ids, texts)[1], k)
                keys, counts = np.unique(value, return_counts=True)
                b = bucket_of(keys, buckets)
                order = np.argsort(b, kind="stable")
                ends = np.searchsorted(b[order], np.arange(buckets + 1))
                del value
                out = [(int(i), common.pack_arrays(trim(keys[p]).ravel(), np.minimum(counts[p], 255).astype(np.uint8))) for i in np.flatnonzero(np.diff(ends)) for p in [order[ends[i] : ends[i + 1]]]]
                yield pd.DataFrame({"block": pd.Series([block] * len(out), dtype="int64"), "bucket": pd.Series([i for i, _ in out], dtype="int32"), "keys": [g for _, g in out]})
                del keys, counts, b, order, ends, out
                common.release()

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = zip(*(common.unpack_arrays(g) for g in pdf["keys"]), strict=True)
        _, where = np.unique(widen(np.concatenate(keys)), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        grade = np.where(total < 2, 0, np.ceil(np.log2(np.maximum(total, 2))).astype(np.int64)).astype(np.uint8)[where]
        ends = np.cumsum([len(c) for c in counts])
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "grades": [common.pack_arrays(grade[e - len(c) : e]) for c, e in zip(counts, ends, strict=True)]})

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, texts = common.block_texts(left["ids"].iloc[0], left["texts"].iloc[0])
        value, offsets = shingle_sets(texts, k)
        keys, where = np.unique(value, return_inverse=True)
        grades = np.zeros(len(keys), np.uint8)
        order = np.argsort(bucket_of(keys, buckets), kind="stable")
        if len(right):
            grades[order] = np.concatenate([common.unpack_arrays(g)[0] for _, g in sorted(zip(right["bucket"], right["grades"], strict=True))])
        grade = grades[where]
        n = np.diff(offsets)
        out = []
        for i in range(len(ids)):
            g, v = grade[offsets[i] : offsets[i + 1]], value[offsets[i] : offsets[i + 1]]
            met = g > 0
            if not n[i] or met.sum() < need(n[i]):
                out.append(None)
                continue
            g, v = g[met], v[met] & np.uint64((1 << 48) - 1)
            out.append(trim(v[np.lexsort((v, g))]).tobytes())
        return pd.DataFrame({"doc_id": ids, "n": n.astype(np.int64), "shared": out})

    sent = blocks.mapInPandas(scatter, "block long, bucket int, keys binary")
    replies = sent.groupBy("bucket").applyInPandas(common.of_group(lengths), "block long, bucket int, grades binary")
    return common.materialise(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(common.of_cogroup(gather), "doc_id long, n long, shared binary"), "sets")


def short_lists(sets: DataFrame) -> DataFrame:
    """(h, doc, n, pos): a set's n - T + 1 shortest lists; those that nothing else is in are gone already."""

    def apply(batches):
        for batch in batches:
            docs, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for doc, n, shared in zip(docs, ns, batch.column(2).to_pylist(), strict=True):
                v = widen(np.frombuffer(shared, np.uint8))
                alone = n - len(v)
                v = v[: n - need(n) + 1 - alone]
                out.append((np.full(len(v), doc), np.full(len(v), n), v.astype(np.int64), np.arange(alone, alone + len(v))))
            if out:
                d, n, h, p = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int64())], names=["h", "doc", "n", "pos"])

    return sets.select("doc_id", "n", "shared").mapInArrow(apply, "h long, doc long, n long, pos long")


def sketches(sets: DataFrame) -> DataFrame:
    """(doc, s0, s1, alone): 128 bits of parity of the shared shingles, and how many are not shared."""

    def apply(batches):
        for batch in batches:
            out = []
            for n, shared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v = common.mix(widen(np.frombuffer(shared, np.uint8)))
                bits = np.packbits(np.bincount((v & np.uint64(127)).astype(np.int64), minlength=128) & 1).view(np.int64)
                out.append((bits[0], bits[1], n - len(v)))
            s0, s1, alone = zip(*out, strict=True) if out else ([], [], [])
            yield pa.record_batch([batch.column(0), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(alone, pa.int64())], names=["doc", "s0", "s1", "alone"])

    return sets.select("doc_id", "n", "shared").mapInArrow(apply, "doc long, s0 long, s1 long, alone long")


def overlap(a: bytes, b: bytes) -> int:
    """Shingles of the shorter set found in the other by binary search."""
    x, y = (np.frombuffer(z, np.uint8) for z in ((a, b) if len(a) <= len(b) else (b, a)))
    x, y = widen(x), np.sort(widen(y))
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, with their components (u, v) and overlap."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))

    def apply(batches):
        for batch in batches:
            na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(4, 8))
            common_ = [overlap(x, y) for x, y in zip(sa, sb, strict=True)]
            kept = [i for i, c in enumerate(common_) if 100 * c >= PERCENT * (na[i] + nb[i] - c)]
            ends = batch.select(["a", "b", "u", "v"]).take(pa.array(kept, pa.int64()))
            yield ends.append_column("overlap", pa.array([common_[i] for i in kept], pa.int64()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v", "na", "nb", "sa", "sb").mapInArrow(apply, "a long, b long, u long, v long, overlap long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, component) after ``links`` between components (a node without a label is its own)."""
    above = common.materialise(components(links), "joined")
    moved = labels.join(above.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    return common.materialise(moved.union(above.join(labels, "node", "left_anti").select("node", "component")), "labels")


FITS = "5 * least(n, m) >= 4 * greatest(n, m)"


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    spark = docs.sparkSession
    sets = shared_sets(docs, id_col, text_col, k, block_bytes)
    several = sets.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    again = common.materialise(sets.join(several, "doc_id", "left_semi"), "again")  # rows that share an id
    may = sets.where("shared is not null")
    if not again.isEmpty():
        one = again.where("shared is not null").groupBy("doc_id").agg(F.max(F.struct("n", "shared")).alias("s")).select("doc_id", "s.n", "s.shared")
        may = may.join(several, "doc_id", "left_anti").select("doc_id", "n", "shared").union(one)
    # equal sets are one: all their shingles occur elsewhere, so the whole set is at hand
    key = F.when(F.octet_length("shared") == 6 * F.col("n"), F.sha2("shared", 256)).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    keyed = may.select("doc_id", key.alias("key"))
    members = common.materialise(keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("rep")), "key").select("doc_id", "rep"), "members")
    reps = common.materialise(may.join(members.where("doc_id = rep").select("doc_id"), "doc_id"), "reps")
    entries = short_lists(reps)
    lists = common.materialise(entries.join(entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "h"), "lists")
    labels = None
    rounds = max(1, rounds)  # the last is pair by pair
    for turn in range(rounds + 1):
        if labels is not None:
            labelled = lists.join(labels, lists["doc"] == labels["node"], "left").select("h", "doc", "n", "pos", F.coalesce("component", "doc").alias("comp"))
            open_lists = labelled.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h")
            lists_now = common.materialise(labelled.join(open_lists, "h"), "open")
            if lists_now.isEmpty():
                break
        else:
            lists_now = lists.withColumn("comp", F.col("doc"))
        if turn == 0:  # one document of each list against the others
            named = lists_now.groupBy("h").agg(F.min_by(F.struct("doc", "n", "comp"), F.struct(F.xxhash64("doc"), "doc")).alias("p"))
            named = named.select("h", F.col("p.doc").alias("other"), F.col("p.n").alias("m"), F.col("p.comp").alias("pcomp"))
            pairs = lists_now.join(named, "h").where("comp <> pcomp").where(FITS)
        elif turn < rounds:  # a few documents of each document's two longest lists
            long = lists_now.join(lists_now.groupBy("h").agg(F.count("*").alias("c")), "h")
            two = long.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("c"), "h"))).where("k <= 2")
            drawn = two.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("doc", F.lit(turn)), "doc"))).where(F.col("k") <= NAMED)
            pairs = two.join(drawn.select("h", F.col("doc").alias("other"), F.col("n").alias("m"), F.col("comp").alias("pcomp")), "h").where("comp <> pcomp").where(FITS)
        else:  # what is left, pair by pair, at the first list that both are in: later ones follow a list that both are in
            before = F.lag("h").over(Window.partitionBy("doc").orderBy("pos"))
            drawn = lists_now.withColumn("before", before).join(sketches(reps), "doc")
            other = drawn.select("h", F.col("before").alias("mbefore"), F.col("doc").alias("other"), F.col("n").alias("m"), F.col("comp").alias("pcomp"), F.col("pos").alias("mpos"), F.col("s0").alias("t0"), F.col("s1").alias("t1"), F.col("alone").alias("malone"))
            # a link has 9 I >= 4 (n + m), and so at most (n + m) / 9 shingles on one side only
            near = "9 * (bit_count(s0 ^ t0) + bit_count(s1 ^ t1) + alone + malone) <= n + m"
            reach = "9 * (least(pos, mpos) + least(n - pos, m - mpos)) >= 4 * (n + m)"
            fresh = "before is null or mbefore is null or before <> mbefore"
            pairs = drawn.join(other, "h").where("doc < other and comp <> pcomp").where(fresh).where(FITS).where(near).where(reach)
        pairs = pairs.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"), F.least("comp", "pcomp").alias("u"), F.greatest("comp", "pcomp").alias("v")).distinct()
        linked = common.materialise(verify(pairs, reps).select("u", "v"), "verified")
        labels = common.materialise(components(linked), "labels") if labels is None else merged(labels, linked)
    ids = members.join(labels, members["rep"] == labels["node"], "left").select(F.col("doc_id"), F.coalesce("component", "rep").alias("c"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumnRenamed("doc_id", id_col)
