"""Prefix trie of conversations by distributed MSD radix partitioning.

Turns are dictionary-encoded: equal (role, text) have one id, found by the
SHA-256 of both.  A conversation is the string of its ids, eight bytes a turn,
the fastest-changing digits first.  Conversations with equal strings become one
row with a weight, so copies cost nothing further.

Buckets are sets of strings with a common prefix, the root bucket all of them.
A bucket over the local bound recurses: it passes over the bytes that all its
strings share (the common prefix of its least and greatest string) and splits
by the next byte, in one aggregation for all large buckets of a round.  The
bound grows with the input, so that at most ``MOST_LARGE`` buckets can be over
it; their splits are broadcast.  A bucket within the bound goes to one task,
where a multikey quicksort splits it by whole turns, less, equal and greater,
and each equal part is a node of the trie.  Nodes above a bucket are summed up
from what the buckets below say.

Turns are in order of ``turn`` (null first), those with an equal turn in order
of their hash; a repeated row is a turn of its own.  Null role or text is
empty.  Rows without a conversation's id are left out, since nothing could be
named after them; other columns are not read.  A conversation is one row with
16 bytes a turn and has to fit as such; its texts don't.  An empty table gives
no node, not even a root.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lookup import join_counted

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: A bucket with so many bytes of strings or less is finished in one task, unless the input has more than MOST_LARGE times as many.
LOCAL_BYTES = 1 << 16
MOST_LARGE = 100_000
#: Ids of members are hashed in runs of ids that agree but for so many low bits.
RUN_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
TURN = 8

NODE = "prefix binary, upper boolean, depth long, words long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def encode_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A written table (conv, turns): per conversation its turns in order, as an array of (id, words)."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = common.materialise(rows, "turns")
    dictionary = common.materialise(turns.groupBy("digest").agg(F.count("*").alias("n")).select("digest", "n", F.monotonically_increasing_id().alias("id")), "dictionary")
    coded = join_counted(turns, dictionary, ["digest"], "n", turns.count())
    order = F.array_sort(F.collect_list(F.struct("turn", "digest", "id", "words")))
    return common.materialise(coded.groupBy("conv").agg(F.transform(order, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns")), "coded")


def share_openings(coded: DataFrame, block: int = 20, ways: int = 4) -> DataFrame:
    """Every conversation c behind the first turns of another one: crc32(c) mod ``ways`` turns of conversation c - c % ``block``
    (all if fewer, none if absent) take the place of its own first turns, however many it has.  % cuts toward zero."""
    heads = coded.where(F.col("conv") % block == 0).select(F.col("conv").alias("__head"), F.slice("turns", 1, ways - 1).alias("__first"))
    shared = (common.crc("conv") % ways).cast("int")
    own = F.slice("turns", shared + 1, F.size("turns"))
    met = coded.join(heads, F.col("conv") - F.col("conv") % block == F.col("__head"), "left")
    return met.select("conv", F.when(F.col("__first").isNull(), own).otherwise(F.concat(F.slice("__first", F.lit(1), shared), own)).alias("turns"))


def hashed_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, words, ids) in order of key and ids -> one row a key with the number, the least and the hash of its ids.
    Only the hash's state is held between rows."""
    key, words, n, least, state, done = None, None, 0, 0, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 5
        done.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "words", "n", "conv", "ends"])

    for batch in batches:
        for k, w, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, words, n, least, state.hexdigest()))
                key, words, n, least, state = k, w, 0, ids[0], hashlib.sha256()
            state.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
            n += len(ids)
        yield flush()
    if key is not None:
        done.append((key, words, n, least, state.hexdigest()))
        yield flush()


def distinct_strings(sequences: DataFrame) -> DataFrame:
    """A written table (key, words, n, conv, ends): each string of turns once, with its conversations."""
    digits = F.transform("turns", lambda t: F.reverse(F.lpad(F.hex(t["id"]), 2 * TURN, "0")))
    rows = sequences.select("conv", F.unhex(F.array_join(digits, "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    runs = rows.groupBy("key", F.shiftright("conv", RUN_BITS).alias("run")).agg(F.array_sort(F.collect_list("conv")).alias("ids"), F.first("words").alias("words"))  # at most 2^RUN_BITS ids
    ordered = runs.repartition("key").sortWithinPartitions("key", "run").select("key", "words", "ids")
    return common.materialise(ordered.mapInArrow(hashed_members, "key binary, words array<long>, n long, conv long, ends string"), "strings")


def common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(os.path.commonprefix([x, y])) for x, y in zip(a, b, strict=True)], dtype="int32")


def radix_buckets(strings: DataFrame, local_bytes: int) -> DataFrame:
    """``strings`` with the bytes ``held`` that each one's bucket shares, and whether it ends there (``ended``; others go on)."""
    prefix = F.md5(F.substring("key", F.lit(1), F.col("held")))
    shared = F.pandas_udf(common_prefix, "int")
    active, finished = strings.withColumns({"held": F.lit(0), "ended": F.lit(False)}), []
    while True:
        sizes = active.groupBy(prefix.alias("bucket"), "held").agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
        large = common.materialise(sizes.where((F.col("n") > 1) & (F.col("bytes") > local_bytes)).select("bucket", "held", shared("least", "most").alias("shared")), "large")  # at most MOST_LARGE rows
        if large.isEmpty():
            return _all([*finished, active])
        split = F.broadcast(large.select(F.col("bucket").alias("__bucket"), F.col("held").alias("__held"), "shared"))
        within = (prefix == F.col("__bucket")) & (F.col("held") == F.col("__held"))
        ends = F.length("key") == F.col("shared")
        further = active.join(split, within).select(*strings.columns, F.when(ends, F.col("shared")).otherwise(F.col("shared") + 1).alias("held"), ends.alias("ended"))
        finished.append(active.join(split, within, "left_anti"))
        further = common.materialise(further, "round")
        finished.append(further.where("ended"))
        active = further.where("not ended")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Nodes:
    """The nodes of one bucket, parents before children."""

    def __init__(self):
        self.depth, self.parent, self.n, self.conv, self.words, self.end = [], [], [], [], [], []

    def add(self, depth: int, parent: int, n: int, conv: int, words: int, end: int) -> int:
        for column, value in zip((self.depth, self.parent, self.n, self.conv, self.words, self.end), (depth, parent, n, conv, words, end), strict=True):
            column.append(value)
        return len(self.depth) - 1


def quicksort(turns: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: np.ndarray, conv: np.ndarray, depth: int) -> Nodes:
    """Multikey quicksort of distinct strings that share their first ``depth`` turns, where depth -1 asks for the root as well."""
    out = Nodes()
    todo: list[tuple[np.ndarray, int, int]] = []

    def node(rows: np.ndarray, depth: int, parent: int) -> None:
        over = lengths[rows] > depth
        ends = rows[~over]
        last = int(words[starts[rows[0]] + depth - 1]) if depth else 0
        i = out.add(depth, parent, int(n[rows].sum()), int(conv[rows].min()), last, int(ends[0]) if len(ends) else -1)
        if over.any():
            todo.append((rows[over], depth, i))

    every = np.arange(len(lengths))
    if depth < 0:
        node(every, 0, -1)
    else:
        todo.append((every, depth, -1))
    while todo:
        rows, depth, parent = todo.pop()
        if len(rows) == 1:  # a string alone: the rest of it is a chain
            r = int(rows[0])
            for d in range(depth + 1, int(lengths[r]) + 1):
                parent = out.add(d, parent, int(n[r]), int(conv[r]), int(words[starts[r] + d - 1]), r if d == lengths[r] else -1)
            continue
        here = turns[starts[rows] + depth]
        pivot = here[len(here) // 2]
        for part in (rows[here < pivot], rows[here > pivot]):
            if len(part):
                todo.append((part, depth, parent))
        node(rows[here == pivot], depth + 1, parent)
    return out


def finish(keys: list[bytes], words: list[list[int]], n: np.ndarray, conv: np.ndarray, ends: list[str], held: int, ended: bool) -> list[tuple]:
    """Rows of ``NODE`` of one bucket: its nodes, and what it adds to each node above it (``upper``)."""
    top = held // TURN if ended else -(-held // TURN) - 1  # depth of the lowest node that other buckets share
    rows, leaves, saved, kids = [], 0, 0, 0
    if not ended:
        lengths = np.array([len(k) // TURN for k in keys], np.int64)
        found = quicksort(np.frombuffer(b"".join(keys), ">u8"), np.array([w for x in words for w in x], np.int64), np.cumsum(lengths) - lengths, lengths, n, conv, top)
        size = len(found.depth)
        child, leaf = [0] * size, [0] * size
        kept = [(a - 1) * w for a, w in zip(found.n, found.words, strict=True)]
        for i in range(size - 1, -1, -1):
            leaf[i] += not child[i]
            if (p := found.parent[i]) >= 0:
                child[p] += 1
                leaf[p] += leaf[i]
                kept[p] += kept[i]
        above = keys[0][: TURN * top] if top >= 0 else None
        for i, p in enumerate(found.parent):
            rows.append((above if p < 0 else None, False, found.depth[i], found.words[i], found.conv[i], found.conv[p] if p >= 0 else None, found.n[i], child[i], leaf[i], kept[i], ends[found.end[i]] if found.end[i] >= 0 else NO_ENDS))
            if p < 0:
                leaves, saved, kids = leaves + leaf[i], saved + kept[i], kids + 1
    total, least = int(n.sum()), int(conv.min())
    for d in range(top + 1):
        rows.append((keys[0][: TURN * d], True, d, words[0][d - 1] if d else 0, least, None, total, kids if d == top else 0, leaves, saved, ends[0] if ended and d == top else None))
    return rows


def finish_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket; holds one bucket at a time."""
    types = (pa.binary(), pa.bool_(), *[pa.int64()] * 8, pa.string())
    names = [x.split()[0] for x in NODE.split(", ")]
    bucket, held = None, []

    def flush() -> list[tuple]:
        if not held:
            return []
        keys, words, n, conv, ends, size, ended, _ = zip(*held, strict=True)
        held.clear()
        return finish(list(keys), list(words), np.array(n, np.int64), np.array(conv, np.int64), list(ends), size[0], ended[0])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[5:] != bucket:
                if rows := flush():
                    yield table(rows)
                bucket = row[5:]
            held.append(row)
    if rows := flush():
        yield table(rows)


def trie(sequences: DataFrame, id_col: str = "conv_id", local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Per node of the trie of ``sequences`` (conv, turns: array of (id, words)): the smallest member, ``depth``, the parent's
    smallest member, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = sequences.sparkSession
    common.bounded_batches(spark)
    strings = distinct_strings(sequences)
    total = strings.agg(F.sum(F.length("key"))).first()[0] or 0
    placed = radix_buckets(strings, max(local_bytes, total // MOST_LARGE))
    columns = ["key", "words", "n", "conv", "ends", "held", "ended"]
    dealt = placed.withColumn("bucket", F.md5(F.substring("key", F.lit(1), F.col("held")))).repartition("bucket", "held", "ended").sortWithinPartitions("bucket", "held", "ended")
    rows = common.materialise(dealt.select(*columns, "bucket").mapInArrow(finish_buckets, NODE), "nodes")

    said = rows.where("upper").groupBy("prefix", "depth").agg(*[F.max(c).alias(c) for c in ("words", "ends")], F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    said = common.materialise(said.withColumn("above", F.when(F.col("depth") > 0, F.substring("prefix", F.lit(1), F.length("prefix") - TURN))), "upper")
    over = said.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.substring("prefix", F.lit(1), d * TURN))).alias("prefix"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    over = over.groupBy("prefix").agg(F.sum("own").alias("own"))
    below = said.where("above is not null").groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("split"))
    parents = said.select(F.col("prefix").alias("above"), F.col("conv").alias("parent_conv"))
    upper = said.join(over, "prefix").join(below, "prefix", "left").join(parents, "above", "left")
    upper = upper.select("conv", "depth", "parent_conv", "n_convs", (F.col("n_children") + F.coalesce("split", F.lit(0))).alias("n_children"), "n_leaves", (F.col("saved") + F.col("own")).alias("saved"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"))

    names = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    inner = rows.where("not upper")
    border = inner.where("prefix is not null").drop("parent_conv")
    counted = said.select("prefix", F.col("n_children").alias("__kids"), F.col("conv").alias("parent_conv"))
    met = join_counted(border, counted, ["prefix"], "__kids", said.agg(F.sum("n_children")).first()[0] or 0)
    out = inner.where("prefix is null").select(*names).unionByName(met.select(*names)).unionByName(upper.select(*names))
    return out.withColumnsRenamed({"conv": id_col, "parent_conv": f"parent_{id_col}", "saved": "saved_tokens", "ends": "ends_sha256"})
