"""Removal of byte strings that an earlier document holds, by suffix sorting.

Every byte of a text that is covered by a ``LENGTH``-byte string which also
starts in a document with a smaller id is removed.  Strings are judged on the
input, overlaps count, and no match crosses documents.

Where to sort.  Each window of ``LENGTH`` bytes is routed by its least hashed
``SEED``-byte string: equal windows hold the same one at the same place, so
they meet in one bucket.  Neighbouring windows mostly have the same, and go
there as one segment of text.  A first exchange finds the seeds that several
documents hold; segments with other seeds can't match and stay where they are.
A block of documents sends equal segments once, with the smallest id.

How to sort.  A bucket concatenates its segments and sorts its suffixes
blockwise: first it ranks the suffixes at the positions of a difference cover
modulo ``PERIOD``; then it takes one suffix bucket at a time (a range of first
bytes, of bounded size), sorts it by the first ``PERIOD`` bytes, and resolves
longer ties by the ranks of the two cover positions that a pair of suffixes has
at the same distance.  So the memory of the sort is bounded by a suffix bucket
and the sample.  Neighbours in the order that share ``LENGTH`` bytes are one
class; the smallest id of a class decides which windows go.

Null and empty texts, and texts shorter than ``LENGTH`` bytes, lose nothing.
Of documents with equal texts the smallest id keeps its own.  Rows with a null
id are left out; several rows with one id are one document each, and don't
take from each other.  Extra columns need no treatment; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lm_score import bucket_of, trim, widen

LENGTH = 50
SEED = 24
BLOCK_BYTES = 3 << 20
#: Suffixes that are sorted at a time.
SUFFIXES = 1 << 19
#: A difference cover modulo 31, each difference once.
PERIOD = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
POSITION_BITS = 28


def distances() -> np.ndarray:
    """[i, j]: the least d with i + d and j + d both in the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
    return out


DISTANCE = distances()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        more = min(size, n - size)
        out[size : size + more] = out[:more] * step
        size *= 2
    return out[:n]


class Prefixes:
    """Hashes of all substrings of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        if len(data):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])
        self.shift = powers(INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[ends] - self.sums[starts]) * self.shift[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return common.mix((self.sums[length:] - self.sums[:n]) * self.shift[:n])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a block: for each segment its document, first window, number of windows, seed value and content value."""
    empty = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if not (lengths >= LENGTH).any():
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    prefixes = Prefixes(data)
    seeds = prefixes.all(SEED)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    width, reach = LENGTH - SEED + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    windows = np.maximum(lengths - LENGTH + 1, 0)
    starts = common.spans(offsets[:-1], windows)
    anchor = (least[starts] & low).astype(np.int64)
    del least
    new = np.ones(len(starts), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(new)
    first = starts[at]
    count = np.diff(np.append(at, len(starts)))
    content = prefixes.of(first, first + count + LENGTH - 1)
    doc = np.searchsorted(offsets, first, side="right") - 1
    return doc, first, count, seeds[anchor[at]], content ^ common.mix(count.astype(np.uint64))


def key(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as numbers in the order of the bytes."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").ravel().astype(np.uint64)


def prefix_keys(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first ``PERIOD`` bytes of suffixes as four numbers."""
    keys = [key(data, at + 8 * i) for i in range(4)]
    keys[3] >>= np.uint64(8 * (32 - PERIOD))
    return keys


def changes(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
    return new


def cover_ranks(data: np.ndarray, n: int) -> np.ndarray:
    """By position: the rank of each cover suffix among them, by twice ``PERIOD`` bytes; 0 elsewhere and past the end."""
    sample = (np.arange(0, n, PERIOD)[:, None] + COVER[None]).ravel()
    sample = sample[sample < n]
    ranks = np.zeros(n + 2 * PERIOD, np.int64)
    keys = prefix_keys(data, sample)
    order = np.lexsort(keys[::-1])
    ranks[sample[order]] = np.cumsum(changes(order, keys))
    # a cover position plus the period is one again, so ranks double their reach
    keys = [ranks[sample], ranks[sample + PERIOD]]
    order = np.lexsort(keys[::-1])
    ranks[sample[order]] = np.cumsum(changes(order, keys))
    return ranks


def resolve(at: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Orders suffixes inside groups that share ``PERIOD`` bytes: three-way partition around a
    suffix of each group, compared by the ranks of cover positions at the same distance.
    ``at`` and ``group`` are in the order so far; returns the positions in the final order."""
    at = at.copy()
    lo = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(lo, len(at)))
    lo, size = lo[size > 1], size[size > 1]
    while len(lo):
        index = common.spans(lo, size)
        own = np.repeat(np.arange(len(lo)), size)
        members, pivot = at[index], at[lo + size // 2][own]
        d = DISTANCE[members % PERIOD, pivot % PERIOD]
        sign = np.sign(ranks[members + d] - ranks[pivot + d])
        order = np.lexsort((sign, own))
        at[index] = members[order]
        sides = own * 3 + sign + 1
        counts = np.bincount(sides, minlength=3 * len(lo)).reshape(-1, 3)
        less, more = counts[:, 0], counts[:, 2]
        lo, size = np.concatenate([lo, lo + size - more]), np.concatenate([less, more])
        lo, size = lo[size > 1], size[size > 1]
    return at


def classes(data: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A number for each window (position in ``data``): equal ones for equal ``LENGTH`` bytes.
    ``data`` has 2 * LENGTH bytes to spare at its end."""
    n = len(data) - 2 * LENGTH
    ranks = cover_ranks(data, n)
    out = np.empty(len(windows), np.int64)
    two = data[windows].astype(np.int64) * 256 + data[windows + 1]
    by_bytes = np.argsort(two, kind="stable")
    ends = np.searchsorted(two[by_bytes], np.arange(65537))
    done = at = 0
    while at < 65536:
        end = int(np.searchsorted(ends, ends[at] + SUFFIXES, side="right")) - 1
        end = min(max(end, at + 1), 65536)
        own = by_bytes[ends[at] : ends[end]]
        at = end
        if not len(own):
            continue
        own = own[np.argsort(windows[own], kind="stable")]
        place = windows[own]
        keys = prefix_keys(data, place)
        order = np.lexsort(keys[::-1])
        group = np.cumsum(changes(order, keys))
        final = resolve(place[order], group, ranks)
        # neighbours that share LENGTH bytes are one class
        new = np.ones(len(final), dtype=bool)
        same = np.ones(len(final) - 1, dtype=bool)
        for i in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            k = key(data, final + i)
            same &= k[1:] == k[:-1]
        new[1:] = ~same
        out[own[np.searchsorted(place, final)]] = done + np.cumsum(new) - 1
        done += int(new.sum())
    return out


def routed(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, shared: set | np.ndarray, buckets: int):
    """The segments of a block that go to buckets: all segments, which distinct one each is (or -1), and the
    distinct ones as (first window, windows, smallest id), by bucket."""
    doc, first, count, seed, content = segments(data, offsets)
    own = ids[doc]
    goes = np.isin(seed & np.uint64((1 << 48) - 1), shared) if len(seed) else np.zeros(0, dtype=bool)
    value, lead, which = np.unique(content[goes], return_index=True, return_inverse=True)
    smallest = np.full(len(value), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, own[goes])
    bucket = bucket_of(seed[goes][lead], buckets)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    distinct = np.full(len(first), -1)
    distinct[goes] = number[which]
    return doc, first, count, distinct, first[goes][lead][order], count[goes][lead][order], smallest[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def several_docs(doc: np.ndarray, seed: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct seeds of a block, and which of them several documents of it hold."""
    keys, where = np.unique(seed, return_inverse=True)
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, where, ids[doc])
    np.maximum.at(high, where, ids[doc])
    return keys, low < high


def sort_bucket(lengths: np.ndarray, smallest: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each window of the segments whether an id smaller than the segment's holds it."""
    n_windows = lengths - LENGTH + 1
    starts = np.cumsum(lengths) - lengths
    # a segment that several blocks sent is sorted once, with its smallest id
    value = Prefixes(text).of(starts, starts + lengths) ^ common.mix(lengths.astype(np.uint64))
    _, lead, which = np.unique(value, return_index=True, return_inverse=True)
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, which, smallest)
    once = text[common.spans(starts[lead], lengths[lead])]
    once_starts = np.cumsum(lengths[lead]) - lengths[lead]
    windows = common.spans(once_starts, n_windows[lead])
    number = classes(np.concatenate([once, np.zeros(2 * LENGTH, np.uint8)]), windows)
    holder = np.repeat(least, n_windows[lead])
    lowest = np.full(int(number.max()) + 1 if len(number) else 0, np.iinfo(np.int64).max)
    np.minimum.at(lowest, number, holder)
    once_ends = np.cumsum(n_windows[lead]) - n_windows[lead]
    all_windows = common.spans(once_ends[which], n_windows)
    return lowest[number[all_windows]] < np.repeat(smallest, n_windows)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans and ``kept`` (binary: the bytes that stay)."""
    buckets = 4 * common.partitions(docs.sparkSession)
    blocks = common.text_blocks(docs, id_col, text_col, block_bytes)

    def read(ids: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows = common.block_texts(ids, texts)
        return keys, *common.joined(rows)

    def seeds(batches):
        for pdf in batches:
            for block, ids, texts in zip(pdf["block"], pdf["ids"], pdf["texts"], strict=True):
                keys, data, offsets = read(ids, texts)
                doc, _, _, seed, _ = segments(data, offsets)
                value, several = several_docs(doc, seed, keys)
                b = bucket_of(value, buckets)
                order = np.argsort(b, kind="stable")
                ends = np.searchsorted(b[order], np.arange(buckets + 1))
                out = [(int(i), common.pack_arrays(trim(value[p]).ravel(), np.packbits(several[p]))) for i in np.flatnonzero(np.diff(ends)) for p in [order[ends[i] : ends[i + 1]]]]
                yield pd.DataFrame({"block": pd.Series([block] * len(out), dtype="int64"), "bucket": pd.Series([i for i, _ in out], dtype="int32"), "seeds": [s for _, s in out]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each block's seeds those that several documents hold."""
        values, flags = zip(*(common.unpack_arrays(s) for s in pdf["seeds"]), strict=True)
        values = [widen(v) for v in values]
        _, where, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        several = (counts > 1)[where] | np.concatenate([np.unpackbits(f)[: len(v)].astype(bool) for f, v in zip(flags, values, strict=True)])
        ends = np.cumsum([len(v) for v in values])
        kept = [common.pack_arrays(trim(v[several[e - len(v) : e]]).ravel()) for v, e in zip(values, ends, strict=True)]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "reply": kept})

    def shared_seeds(replies: pd.DataFrame) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(widen(common.unpack_arrays(r)[0]) for r in replies["reply"])])

    def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, data, offsets = read(left["ids"].iloc[0], left["texts"].iloc[0])
        _, _, _, _, first, count, smallest, ends = routed(data, offsets, keys, shared_seeds(right), buckets)
        out = []
        for i in np.flatnonzero(np.diff(ends)):
            own = slice(ends[i], ends[i + 1])
            lengths = count[own] + LENGTH - 1
            out.append((int(i), common.pack_arrays(lengths.astype(np.int32), smallest[own], data[common.spans(first[own], lengths)], level=3)))
        return pd.DataFrame({"block": pd.Series([left["block"].iloc[0]] * len(out), dtype="int64"), "bucket": pd.Series([i for i, _ in out], dtype="int32"), "segments": [s for _, s in out]})

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, smallest, text = zip(*(common.unpack_arrays(s) for s in pdf["segments"]), strict=True)
        windows = [int((n.astype(np.int64) - LENGTH + 1).sum()) for n in lengths]
        gone = sort_bucket(np.concatenate(lengths).astype(np.int64), np.concatenate(smallest), np.concatenate(text))
        ends = np.cumsum(windows)
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "reply": [common.pack_arrays(np.packbits(gone[e - n : e])) for n, e in zip(windows, ends, strict=True)]})

    def remove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, data, offsets = read(left["ids"].iloc[0], left["texts"].iloc[0])
        verdicts = {b: r for b, r in zip(right["bucket"], right["reply"], strict=True) if b >= 0}
        doc, first, count, distinct, _, own_count, smallest, ends = routed(data, offsets, keys, shared_seeds(right[right["bucket"] < 0]), buckets)
        bits = [np.unpackbits(common.unpack_arrays(verdicts[i])[0])[: own_count[ends[i] : ends[i + 1]].sum()] for i in range(buckets) if ends[i + 1] > ends[i]]
        bits = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
        begins = np.cumsum(own_count) - own_count
        sent = distinct >= 0
        windows = common.spans(first[sent], count[sent])
        gone = bits[common.spans(begins[distinct[sent]], count[sent])] | np.repeat(keys[doc[sent]] > smallest[distinct[sent]], count[sent])
        mark = np.zeros(len(data) + 1, np.int32)
        np.add.at(mark, windows[gone], 1)
        ending = windows[gone] + LENGTH
        np.add.at(mark, ending, -1)
        covered = np.cumsum(mark[:-1]) > 0
        starts_run = covered.copy()
        starts_run[1:] &= ~covered[:-1]
        starts_run[offsets[:-1][offsets[:-1] < len(data)]] |= covered[offsets[:-1][offsets[:-1] < len(data)]]
        removed, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (covered, starts_run))
        kept = data[~covered].tobytes()
        place = offsets - removed[offsets]
        return pd.DataFrame({"doc_id": keys, "n_bytes": np.diff(offsets), "n_removed": np.diff(removed[offsets]), "n_spans": np.diff(runs[offsets]), "kept": [kept[a:b] for a, b in zip(place[:-1], place[1:], strict=True)]})

    shape = "block long, bucket int, reply binary"
    known = common.materialise(blocks.mapInPandas(seeds, "block long, bucket int, seeds binary").groupBy("bucket").applyInPandas(meet, shape), "seeds")
    sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(route, "block long, bucket int, segments binary")
    verdicts = sent.groupBy("bucket").applyInPandas(judge, shape)
    replies = known.withColumn("bucket", F.lit(-1)).union(verdicts)
    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc_id", id_col)


