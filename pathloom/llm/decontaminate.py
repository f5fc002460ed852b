"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are indexed by their word trigrams (shorter items by what they
have, and documents are searched by such grams too): every term has a postings list of items with BM25 impacts, in blocks
with the largest impact of each.  Every training document is read as passages
of ``PASSAGE`` words, half overlapping, and each passage is a query.  A passage
whose terms cannot reach the lowest threshold of any item, by the largest
impact of each term, is passed over; the others run block-max WAND and give
every item whose score is at least ``SHARE`` of the most that a passage can score
on it: the item's best run of the terms of ``PASSAGE`` words, or all of a shorter
item.  A found item is verified on the words around the passage: the share of
its question's trigrams, and of its answer's, that occur there.  The question
is the item up to its last line or sentence and the answer the rest; an item of
one sentence is all question.

Words are lower-case runs between white space without punctuation at their
ends.  Document frequencies and lengths are those of all items.  The index of
a shard of at most ``SHARD_BYTES`` of items is sent to all executors; more
items make more shards, each met by all documents.

Null and empty texts match nothing; items that are null, or without words,
match nothing.  An item repeated under several ids is found under each; of rows
with one item id each text is an item.  Rows with a null id are left out (and
kept by ``decontaminate``); documents that share an id are read each by itself.
Texts and items may be of any length.  Extra columns are not read.  Empty tables
give empty results.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 3
PASSAGE = 64
SHARE = 0.3
QUESTION, ANSWER = 0.6, 0.5
K1, B = 1.2, 0.75
POSTINGS_BLOCK = 64
SHARD_BYTES = 8 << 20
PUNCTUATION = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


def word_values(texts) -> tuple[np.ndarray, np.ndarray]:
    """The values of all words of the texts and the offsets of the texts; words of punctuation alone count as one word."""
    import xxhash

    coded, rows = common.words(texts)
    h = np.fromiter((xxhash.xxh3_64_intdigest(PUNCTUATION.sub(b"", w)) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return h[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64), rows


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """The value of the k words from each position on (shorter by k - 1)."""
    n = max(0, len(values) - k + 1)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = common.mix(out ^ values[i : i + n]) * np.uint64(0xE7037ED1A0B428DB)
    return out


def parts(text: str) -> tuple[str, str]:
    """Question and answer: the last line, or else the last sentence, is the answer."""
    body = text.strip()
    for cut in (r"\n(?=[^\n]*$)", r"(?<=[.!?])\s+(?=[^.!?]*[.!?]?$)"):
        if (m := re.search(cut, body)) and len(body[: m.start()].split()) >= GRAM and len(body[m.end() :].split()) >= GRAM:
            return body[: m.start()], body[m.end() :]
    return body, ""


def item_terms(text: str) -> list[int]:
    values, _ = word_values(pa.array([text]))
    return grams(values, min(GRAM, len(values))).tolist() if len(values) else []


def best_window(terms: list[int], impacts: dict[int, float], width: int) -> float:
    """The largest sum of impacts, each once, of so many terms in a row."""
    held: Counter = Counter()
    total = best = 0.0
    for i, t in enumerate(terms):
        held[t] += 1
        total += impacts[t] if held[t] == 1 else 0.0
        if i >= width:
            held[terms[i - width]] -= 1
            total -= impacts[terms[i - width]] if not held[terms[i - width]] else 0.0
        best = max(best, total)
    return best


class Index:
    """Postings of a shard of items: term -> items and impacts, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], n: int, mean: float) -> None:
        self.ids, self.questions, self.answers, self.own, self.most = [], [], [], [], []
        self.sizes: set[int] = set()  # of the grams by which the items are indexed
        postings: dict[int, list[tuple[int, float]]] = {}
        for item_id, text in sorted(items):
            in_order = item_terms(text)
            terms = Counter(in_order)
            if not terms:
                continue
            length, own, impacts = len(in_order), 0.0, {}
            for t, tf in terms.items():
                idf = math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5))
                impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                postings.setdefault(t, []).append((len(self.ids), impact))
                impacts[t] = impact
                own += impact
            question, answer = parts(text)
            self.ids.append(item_id)
            self.sizes.add(min(GRAM, len(word_values(pa.array([text]))[0])))
            self.own.append(own)
            self.most.append(own if length <= PASSAGE - GRAM + 1 else best_window(in_order, impacts, PASSAGE - GRAM + 1))
            self.questions.append(set(item_terms(question)))
            self.answers.append(set(item_terms(answer)))
        self.postings = postings
        self.items = {t: [k for k, _ in p] for t, p in postings.items()}
        self.blocks = {t: [(p[i : i + POSTINGS_BLOCK][-1][0], max(w for _, w in p[i : i + POSTINGS_BLOCK])) for i in range(0, len(p), POSTINGS_BLOCK)] for t, p in postings.items()}
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        self.largest = np.array([max(w for _, w in postings[int(t)]) for t in self.terms])
        self.least = SHARE * min(self.most, default=math.inf)
        self.longest = max((len(q) + len(a) for q, a in zip(self.questions, self.answers, strict=True)), default=0) + 2 * GRAM

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score reaches their threshold: block-max WAND over the terms of a passage."""
        lists = [(self.postings[t], self.blocks[t], max(w for _, w in self.blocks[t]), self.items[t]) for t in sorted(set(terms)) if t in self.postings]
        at = [0] * len(lists)
        heap = [(p[0][0], i) for i, (p, *_) in enumerate(lists)]
        heapq.heapify(heap)
        found = []

        def seek(i: int, item: int) -> int | None:
            """Moves list i to the first posting at or after the item."""
            at[i] = bisect_left(lists[i][3], item, at[i])
            return lists[i][3][at[i]] if at[i] < len(lists[i][3]) else None

        while heap:
            # pivot: the first item that the largest impacts of the lists so far can bring over the lowest threshold
            order, bound, pivot = [], 0.0, None
            while heap:
                item, i = heapq.heappop(heap)
                order.append((item, i))
                bound += lists[i][2]
                if bound >= self.least:
                    pivot = item
                    break
            if pivot is None:
                break
            while heap and heap[0][0] == pivot:
                order.append(heapq.heappop(heap))
            # the blocks that hold the pivot or what follows it, and how far all of them reach
            tight, reach = 0.0, heap[0][0] - 1 if heap else math.inf
            for _, i in order:
                blocks = lists[i][1]
                b = at[i] // POSTINGS_BLOCK
                while b < len(blocks) and blocks[b][0] < pivot:
                    b += 1
                if b < len(blocks):
                    tight += blocks[b][1]
                    reach = min(reach, blocks[b][0])
            after = pivot + 1
            if tight < self.least - 1e-9:  # no item up to there can pass
                after = max(after, reach + 1) if reach < math.inf else None
            elif tight >= SHARE * self.most[pivot] - 1e-9:
                score = 0.0
                for _, i in order:
                    if seek(i, pivot) == pivot:
                        score += lists[i][0][at[i]][1]
                if score >= SHARE * self.most[pivot]:
                    found.append((pivot, score))
            if after is None:
                break
            for _, i in order:
                if (item := seek(i, after)) is not None:
                    heapq.heappush(heap, (item, i))
        return found

    def match(self, values: np.ndarray) -> dict[int, tuple[int, float, float, float]]:
        """Of one document (the values of its words): item -> (word it begins near, score, question, answer), verified, the best of each."""
        found: dict[int, tuple[int, float, float, float]] = {}
        for k in self.sizes if len(self.terms) else ():
            self.match_grams(grams(values, k), PASSAGE - k + 1, found)
        return found

    def match_grams(self, terms: np.ndarray, width: int, found: dict) -> None:
        """Adds what the grams of one length find; ``width`` of them are a passage."""
        if not len(terms):
            return
        where = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[where] == terms
        weight = np.concatenate([[0], np.cumsum(np.where(known, self.largest[where], 0.0))])
        starts = np.arange(0, max(1, len(terms) - width + PASSAGE // 2), PASSAGE // 2)  # the last reaches the end
        ends = np.minimum(starts + width, len(terms))
        for s, e in zip(*(x[weight[ends] - weight[starts] >= self.least - 1e-9] for x in (starts, ends)), strict=True):
            for item, score in self.search([int(t) for t in terms[s:e][known[s:e]]]):
                around = set(terms[max(0, s - self.longest) : e + self.longest].tolist())
                q = len(self.questions[item] & around) / max(1, len(self.questions[item]))
                a = len(self.answers[item] & around) / len(self.answers[item]) if self.answers[item] else 1.0
                if q >= QUESTION and a >= ANSWER and (item not in found or score > found[item][1]):
                    found[item] = (int(s), score, q, a)


def shards(items: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> list[DataFrame]:
    rows = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].alias("text")).where("item_id is not null and text is not null and length(text) > 0")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, math.ceil(2 * size / shard_bytes)) if size > shard_bytes else 1
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, item_id, word, score, question_share, answer_share): every verified match of an item in a document."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    made = shards(items, item_id_col, item_text_col, shard_bytes)

    def term_rows(batches):
        for batch in batches:
            terms = [item_terms(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([pa.array([np.array(t, np.uint64).astype(np.int64).tolist() for t in terms], pa.list_(pa.int64()))], names=["terms"])

    all_terms = made[0]
    for more in made[1:]:
        all_terms = all_terms.union(more)
    all_terms = all_terms.mapInArrow(term_rows, "terms array<long>").where("size(terms) > 0")
    n, mean = all_terms.agg(F.count("*"), F.avg(F.size("terms"))).first()
    counted = all_terms.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null and text is not null")
    out = None
    for shard in made:
        own = shard.collect()  # at most shard_bytes
        held = shard.mapInArrow(term_rows, "terms array<long>").select(F.explode("terms").alias("t")).distinct()
        frequency = {r["t"] % (1 << 64): r["f"] for r in counted.join(held, "t").collect()}
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own], frequency, n, mean or 1.0))

        def apply(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            values, offsets = word_values(batch.column(1))
            ids = batch.column(0).to_pylist()
            found = [(i, index.value.ids[k], *m) for i, s, e in zip(ids, offsets[:-1], offsets[1:], strict=True) for k, m in sorted(index.value.match(values[s:e]).items())]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "item_id", "word", "score", "question_share", "answer_share"])

        one = rows.mapInArrow(common.map_slices(lambda apply=apply: apply, "text"), "id long, item_id long, word long, score double, question_share double, answer_share double")
        out = one if out is None else out.union(one)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    id_col = kwargs.get("id_col", "doc_id")
    name = f"__{uuid.uuid4().hex}"
    bad = contaminated(docs, items, **kwargs).select(F.col(id_col).alias(name)).distinct()
    return docs.join(bad, docs[id_col] == F.col(name), "left_anti")
