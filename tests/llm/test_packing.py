"""Packing against the library's own ids, and its layout by arithmetic."""

import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import packing, registry, word_bpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, start string, length int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(registry.WORD_BPE))


@pytest.fixture(scope="module")
def words():
    return word_bpe.Words(open(P.path(registry.WORD_BPE), encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\x0b\x85\xa0 .,'!abZÉéßÿ÷×ǅİΣς́ͅﬁ0九\x01\x00|<>"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_ids_equal_the_library(library, words, texts):
    import pyarrow as pa

    texts = [*texts, "<|endoftext|>a <|STARTOFTEXT|> don't isn'T <|startoftext|>.,!"]
    flat, sizes = words.of(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_worker_forgets_words_beyond_the_bound(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(word_bpe, "KNOWN_UNITS", 3)
    words = word_bpe.Words(open(P.path(registry.WORD_BPE), encoding="utf-8").read())
    for text in ("one two three four", "five six", "one seven"):
        assert words.of(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_bpe.Words(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([(64, 8), (16, 16), (32, 1)]))
def test_layout(lengths, sizes):
    capacity, least = sizes
    document, start, length = packing.cut(np.array(lengths, np.int64), capacity, least)
    for i, n in enumerate(lengths):  # the pieces of a document tile it
        own = document == i
        assert length[own].sum() == n and (start[own] == np.cumsum(length[own]) - length[own]).all()
    seen, rank = {}, []
    for t in length.tolist():
        rank.append(seen.get(t, 0))
        seen[t] = rank[-1] + 1
    layout = packing.Layout(seen, capacity, least)
    row, inner, size, sequence, offset = layout.pieces(length, np.array(rank, np.int64))
    for i, t in enumerate(length.tolist()):  # further cuts tile the piece
        own = np.argsort(inner[row == i])
        assert size[row == i].sum() == t and (inner[row == i][own] == np.cumsum(size[row == i][own]) - size[row == i][own]).all()
    padding = 0
    for s in range(layout.sequences):
        own = np.argsort(offset[sequence == s])
        n = size[sequence == s].sum()
        assert 0 < n <= capacity and (offset[sequence == s][own] == np.cumsum(size[sequence == s][own]) - size[sequence == s][own]).all()
        padding += 0 if n & (n - 1) == 0 else capacity - n
    assert set(sequence.tolist()) == set(range(layout.sequences))
    tails = sum(n // (capacity // t) * (capacity - capacity // t * t) for t, n in seen.items() if t < least)
    assert padding <= tails


def check(got, texts, library, closing=1):
    """``texts``: rows (id, text); pieces of rows that share an id are held together."""
    want, have = [], {}
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, closing]
        want.append((i, tuple(ids)))
    for r in got:
        have.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in have.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    return want


def test_query(spark, library):
    rows = registry.op11_harmonic_packing(spark, SF).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, ids in check(rows, texts, library):
        own = sorted(by.pop(i), key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in own) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in own)
    assert not by


def test_odd_rows(spark, library):
    """Null, empty and very long texts, repeated and null ids, clashing columns, an empty table."""
    texts = [(1, None), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000), (None, "x"), (4, "don't <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in texts], SCHEMA)
    rows = packing.pack(docs.repartition(3), P.path(registry.WORD_BPE)).collect()
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), x) for i, ids in check(rows, texts, library) for x in ids)
    assert sorted((key(r.doc_id), x) for r in rows for x in np.frombuffer(r.ids, "<u4").tolist()) == want
    lengths = {}
    for r in rows:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert all(n & (n - 1) == 0 for n in lengths.values())
    assert packing.pack(docs.where("false"), P.path(registry.WORD_BPE)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, P.path(registry.WORD_BPE), capacity=1000)
