"""Log-probabilities of texts by a weighted backoff automaton.

The model interpolates n-gram orders (Jelinek-Mercer): with c(h) > 0,
P(w | h) = L c(hw) / c(h) + (1 - L) P(w | h'), else P(w | h'), where h' is h
without its first word; the lowest order is (c(w) + 0.5) / (N + 0.5 (V + 1)).
As an automaton, every history of at most ``ORDER`` - 1 tokens seen in training
is a state, and so are the empty history and the start of a text.  A state has
an arc for each n-gram seen after it, whose weight is the logarithm of the
smoothed probability and which leads to the longest state that ends the n-gram.
What has no arc takes the state's failure arc, of weight log10(1 - L), to h'.
A text is read from left to right; the state carries over and the weights of
the arcs taken add up.

Counts come from all training rows.  A task turns a block of texts into its
distinct n-grams with their counts in training rows, dealt into buckets by
hash; a bucket adds them up, counts the distinct training words, and sends each
block the totals of its own n-grams.  From these a block builds the part of
the automaton that its texts can reach: nothing else could be read in it.  All
texts of a block are read side by side.  A text longer than ``LANE`` tokens is
read in lanes, each of which first reads the ``ORDER`` - 1 tokens before it,
on which alone its state depends, so the result is that of one reading.
N-grams are counted in each block first, so a frequent one is one entry a block;
no task and no broadcast holds the whole model.  An n-gram is known by the
bucket and 48 other bits of its hash.

Null texts are empty: one end token.  Without training rows N = V = 0 and all
orders give 0.5 / 0.5.  Rows with a null id are left out; rows that share an id
are scored each by itself.  Ids are any 64-bit numbers.  Copies, ties and extra
columns need no treatment; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 3
LAMBDA = 0.7
#: Tokens of a text that are read in one lane.
LANE = 512
BLOCK_BYTES = 4 << 20
#: Values of the two tokens that are no words.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Bytes of a key beside its bucket: of shingles and of n-grams.
HASH_BYTES, GRAM_BYTES = 6, 6
#: The states that every automaton has; those of n-grams follow.
ROOT, BEGIN = 0, 1


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (words, then end), the number of each token (words, then end, a text) in
    them, and the offsets of the texts."""
    coded, rows = common.words(texts)
    ends = np.cumsum(np.diff(rows) + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, len(coded.dictionary), np.int64)
    word = np.ones(len(out), dtype=bool)
    word[ends - 1] = False
    out[word] = coded.indices.to_numpy(zero_copy_only=False)
    return np.append(common.hash_words(coded.dictionary), END), out, np.concatenate([[0], ends]).astype(np.int64)


def places(offsets: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def number(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each value among the distinct ones (all from 0 and below ``limit``), and a place of each of these.
    Where they fit one integer, values are sorted together with their places, which takes a fraction of sorting indices."""
    bits = len(values).bit_length()
    if limit << bits <= 1 << 63:
        packed = np.sort(values << bits | np.arange(len(values)))
        order, values = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(values)
        values = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks, order[new]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)


def trim(keys: np.ndarray) -> np.ndarray:
    """The lowest six bytes of each value."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])


def widen(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = data.reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def low_bits(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64((1 << 8 * GRAM_BYTES) - 1)


def pack_keys(keys: np.ndarray) -> np.ndarray:
    """Ascending values below 2 ^ 48 as their differences, byte by byte, the highest bytes first."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(steps[:, GRAM_BYTES - 1 :: -1].T).ravel()


def unpack_keys(data: np.ndarray) -> np.ndarray:
    steps = np.zeros((len(data) // GRAM_BYTES, 8), np.uint8)
    steps[:, GRAM_BYTES - 1 :: -1] = data.reshape(GRAM_BYTES, -1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def planes(counts: np.ndarray) -> np.ndarray:
    """Counts as rows of bytes, the lowest bytes first; each row compresses best by itself."""
    counts = small(counts)
    return counts.astype(counts.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, counts.itemsize).T


def of_planes(rows: list[np.ndarray]) -> np.ndarray:
    return sum(row.astype(np.int64) << 8 * i for i, row in enumerate(rows))


class Nodes:
    """The distinct n-grams of a block: ``at[n - 1]`` names the node of the n-gram of n tokens that ends at
    each position (-1: the text is too short for it).  Nodes are numbered by order, after the two states that
    every automaton has; those of single tokens as ``vocabulary``, the hashes of distinct tokens.  A longer one
    is its history and a word: ``before`` and ``last`` name them, ``shorter`` the n-gram without its first
    word.  A history may begin with the start of the text."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, offsets: np.ndarray, order: int) -> None:
        place = places(offsets)
        self.at, self.ends = [words + 2], [2, 2 + len(vocabulary)]
        self.before, self.shorter = [], []
        keys = np.concatenate([np.array([0, START], np.uint64), common.mix(vocabulary)])
        for n in range(2, order + 1):
            there = np.flatnonzero(place >= n - 2)
            before = self.at[-1][there - 1]
            if n == 2:
                before[place == 0] = BEGIN
            last = words[there]
            rank, first = number(before * len(vocabulary) + last, self.ends[-1] * len(vocabulary))
            node = np.full(len(words), -1, np.int64)
            node[there] = rank + self.ends[-1]
            before, last = before[first], last[first]
            self.before.append(before)
            self.shorter.append(self.at[-1][there[first]])
            self.at.append(node)
            self.ends.append(self.ends[-1] + len(first))
            keys = np.concatenate([keys, common.mix(keys[before] * np.uint64(0xE7037ED1A0B428DB) + vocabulary[last])])
        self.keys = keys[2:]

    def in_buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the nodes by bucket and key, and where each bucket ends in it."""
        bucket = bucket_of(self.keys, buckets)
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(8 * GRAM_BYTES) | low_bits(self.keys))
        return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


class Automaton:
    """States, arcs and failure arcs that the texts of a block can reach.

    A state is a node of at most ``order`` - 1 tokens with a count.  An arc is known by the node of the n-gram
    that it completes, so the arc that a state of m tokens has for the word at a position is the node of m + 1
    tokens that ends there.  ``weights`` and ``targets`` hold what an arc weighs and where it leads (-1: the
    state has no such arc); ``failure`` leads a state to its history without the first word, and ``leave`` is
    what that weighs.  The empty history has an arc for every word.
    """

    def __init__(self, nodes: Nodes, counts: np.ndarray, n: int, v: int, documents: int, weight: float) -> None:
        order, size, words = len(nodes.at), nodes.ends[-1], slice(2, nodes.ends[1])
        self.at = nodes.at
        count = np.concatenate([[0, documents], counts])
        self.length = np.repeat(np.arange(order + 1), [2, *np.diff(nodes.ends)])
        self.length[BEGIN] = 1
        chance = np.zeros(size)
        chance[words] = (count[words] + 0.5) / (n + 0.5 * (v + 1))
        self.failure = np.full(size, ROOT, np.int64)
        self.targets = np.full(size, -1, np.int64)
        self.targets[words] = np.where((count[words] > 0) & (order > 1), np.arange(2, nodes.ends[1]), ROOT)
        for k, before, shorter in zip(range(2, order + 1), nodes.before, nodes.shorter, strict=True):
            own = slice(nodes.ends[k - 1], nodes.ends[k])
            self.failure[own] = shorter
            seen = count[own] > 0
            chance[own] = np.where(seen, weight * count[own] / np.maximum(count[before], 1) + (1 - weight) * chance[shorter], 0)
            self.targets[own] = np.where(seen, np.arange(nodes.ends[k - 1], nodes.ends[k]) if k < order else shorter, -1)
        with np.errstate(divide="ignore"):
            self.weights = np.log10(chance)
            fall = np.log10(1 - weight) if weight < 1 else -np.inf
        # a start that no training text has is no history; it weighs nothing to leave it
        self.leave = np.where(count > 0, fall, 0.0)
        self.start = BEGIN if order > 1 else ROOT

    def step(self, states: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads in each state the word at a position: the states after it, and the weights of the arcs on the way."""
        total, after = np.zeros(len(states)), np.empty(len(states), np.int64)
        left = np.arange(len(states))
        while len(left):
            length, arc = self.length[states], np.empty(len(left), np.int64)
            for m, nodes in enumerate(self.at):
                own = np.flatnonzero(length == m)
                arc[own] = nodes[at[own]]
            target = self.targets[arc]
            hit = target >= 0
            done = left[hit]
            total[done] += self.weights[arc[hit]]
            after[done] = target[hit]
            miss = ~hit
            left, at, states = left[miss], at[miss], states[miss]
            total[left] += self.leave[states]
            states = self.failure[states]
        return after, total

    def traverse(self, offsets: np.ndarray, memory: int, lane: int = LANE) -> np.ndarray:
        """The weight of every token, all texts read from left to right side by side; a state depends on
        ``memory`` tokens."""
        out = np.zeros(int(offsets[-1]))
        pieces = -(-np.diff(offsets) // lane)
        begin = np.repeat(offsets[:-1], pieces) + lane * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + lane, np.repeat(offsets[1:], pieces))
        warm = np.maximum(begin - memory, np.repeat(offsets[:-1], pieces))
        states = np.where(warm == np.repeat(offsets[:-1], pieces), self.start, ROOT)
        order = np.argsort(warm - end, kind="stable")  # the longest lanes first
        begin, end, warm, states = begin[order], end[order], warm[order], states[order]
        for t in range(int((end - warm).max(initial=0))):
            k = int(np.searchsorted(warm - end, -t, side="left"))  # lanes longer than t
            at = warm[:k] + t
            states[:k], weights = self.step(states[:k], at)
            own = at >= begin[:k]
            out[at[own]] = weights[own]
        return out


def score(docs: DataFrame, trained: F.Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, weight: float = LAMBDA, block_bytes: int = BLOCK_BYTES, lane: int = LANE) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score.  ``trained`` says of a row (by its id) whether to learn from it."""
    buckets = 4 * common.partitions(docs.sparkSession)
    blocks = common.text_blocks(docs, id_col, text_col, block_bytes, flag=trained)

    def read(ids: bytes, texts: bytes):
        keys, rows = common.block_texts(ids, texts)
        vocabulary, words, offsets = tokens(rows)
        return keys, offsets, Nodes(vocabulary, words, offsets, order)

    def scatter(batches):
        for pdf in batches:
            for block, ids, texts in zip(pdf["block"], pdf["ids"], pdf["texts"], strict=True):
                _, offsets, nodes = read(ids, texts)
                learned = common.block_flags(ids)
                taught = np.repeat(learned, np.diff(offsets))
                counts = np.concatenate([np.bincount(at[taught & (at >= 0)] - low, minlength=high - low) for at, low, high in zip(nodes.at, nodes.ends[:-1], nodes.ends[1:], strict=True)])
                by_bucket, ends = nodes.in_buckets(buckets)
                low, counts, single = low_bits(nodes.keys)[by_bucket], counts[by_bucket], by_bucket < nodes.ends[1] - 2
                out = [(int(i), common.pack_arrays(*pack_keys(low[p]).reshape(GRAM_BYTES, -1), small(counts[p]), np.packbits(single[p]))) for i in np.flatnonzero(np.diff(ends)) for p in [slice(ends[i], ends[i + 1])]]
                sums = {"n": int(taught.sum()), "documents": int(learned.sum())}
                yield pd.DataFrame({"block": block, "bucket": [i for i, _ in out], "grams": [g for _, g in out]} | {k: [x] + [0] * (len(out) - 1) for k, x in sums.items()})
                del nodes, taught, counts, by_bucket, low, single, out
                common.release()

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        *hashes, counts, single = zip(*(common.unpack_arrays(g) for g in pdf["grams"]), strict=True)
        sizes = [len(c) for c in counts]
        flags = np.concatenate([np.unpackbits(s)[:n] for s, n in zip(single, sizes, strict=True)])
        where, keys = number(np.concatenate([unpack_keys(np.concatenate(h)) for h in zip(*hashes, strict=True)]).astype(np.int64), 1 << 8 * GRAM_BYTES)
        total = np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
        word = np.zeros(len(keys), dtype=bool)
        word[where[flags == 1]] = True
        ends = np.cumsum(sizes)
        back = total[where]
        known = [int((word & (total > 0)).sum())] + [0] * (len(pdf) - 1)
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "totals": [common.pack_arrays(*planes(back[e - n : e])) for n, e in zip(sizes, ends, strict=True)], "known": known, "n": pdf["n"], "documents": pdf["documents"]})

    sent = blocks.mapInPandas(scatter, "block long, bucket int, grams binary, n long, documents long")
    replies = common.materialise(sent.groupBy("bucket").applyInPandas(common.of_group(add_up), "block long, bucket int, totals binary, known long, n long, documents long"), "totals")
    n, v, documents = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "known", "documents")]).first()

    def traverse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, offsets, nodes = read(left["ids"].iloc[0], left["texts"].iloc[0])
        counts = np.empty(len(nodes.keys), np.int64)
        counts[nodes.in_buckets(buckets)[0]] = np.concatenate([of_planes(common.unpack_arrays(t)) for _, t in sorted(zip(right["bucket"], right["totals"], strict=True))])
        automaton = Automaton(nodes, counts, n, v, documents, weight)
        words = nodes.at[0]
        del nodes
        known = (counts > 0)[words - 2].astype(np.int64)
        sums = [np.add.reduceat(x, offsets[:-1]) for x in (known, automaton.weights[words], automaton.traverse(offsets, order - 1, lane))]
        return pd.DataFrame({"id": keys, "n_tokens": np.diff(offsets), "n_known": sums[0], "train_tokens": np.int64(n), "base_score": sums[1], "score": sums[2]})

    out = blocks.groupBy("block").cogroup(replies.select("block", "bucket", "totals").groupBy("block")).applyInPandas(common.of_cogroup(traverse), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
