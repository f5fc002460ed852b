"""The trie against a direct one made of dictionaries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pathloom.llm import conversation_trie as ct
from pathloom.llm import lookup, registry

SCHEMA = "conv_id long, turn long, role string, text string, key string, n int, prefix string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """rows (conv, turn, role, text) -> {conv: [(role, text)]} by the rule of shared openings."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + x[h:]
    return out


def direct(rows):
    found = rebuilt(rows)
    members = {}
    for c, seq in found.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(found[c]) == len(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def got(spark, rows, local_bytes=ct.LOCAL_BYTES):
    table = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA).repartition(3)
    found = ct.trie(ct.share_openings(ct.encode_turns(table)), local_bytes=local_bytes)
    assert found.columns == COLUMNS
    return sorted(tuple(-1 if x is None else x for x in r) for r in found.collect())


def conversations(seed=1):
    """Copies, common openings, conversations that end where others go on, ties, repeated rows, nulls and a long one."""
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        if c % 20 == 0 and c % 40:
            continue  # no conversation to open with
        n = rng.choice([1, 1, 2, 3, 5])
        rows += [(c, t, rng.choice(["user", "assistant"]), f"w{rng.randrange(3)} " * rng.randrange(3)) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(6)]
    rows += [(c, t, "user", f"same {t}") for c in range(1060, 1066) for t in range(c - 1056)]
    rows += [(2000, t, "user", f"long {t % 2}") for t in range(300)] + [(2001, t, "user", f"long {t % 2}") for t in range(200)]
    rows += [(3000, None, None, "first"), (3000, 0, "user", None), (3000, 0, "user", "tie"), (3000, 0, "user", "tie"), (3001, 5, None, None), (-41, 0, "a", "\x1c b\x0bc d"), (-40, 0, "a", "x"), (None, 0, "user", "no one")]
    return rows


@pytest.mark.parametrize("local_bytes, shares", [(ct.LOCAL_BYTES, 20_000), (24, 20_000), (200, 10)])
def test_odd_rows(spark, monkeypatch, local_bytes, shares):
    monkeypatch.setattr(lookup, "SHARES", shares)
    monkeypatch.setattr(ct, "RUN_BITS", 3)
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    assert got(spark, rows, local_bytes) == direct(rows)


def test_negative_ids_cut_toward_zero(spark):
    rows = [(-40, 0, "a", "x"), (-40, 1, "a", "y"), (-41, 0, "b", "z"), (-41, 1, "b", "z"), (-41, 2, "b", "z")]
    seqs = {r.conv: len(r.turns) for r in ct.share_openings(ct.encode_turns(spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA))).collect()}
    h = zlib.crc32(b"-41") % 4
    assert seqs == {-40: 2, -41: min(h, 2) + 3 - h if h < 3 else 2}


def test_no_turns_left_and_empty(spark):
    """A conversation whose opening is absent may have no turn at all; it ends at the root."""
    ids = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:3]
    rows = [(c, 0, "user", "gone") for c in ids]
    assert got(spark, rows) == direct(rows) and len(direct(rows)) == 1
    assert got(spark, []) == []


def test_hash_state_over_batches():
    import pyarrow as pa

    rows = [(b"a", [1], [1, 2]), (b"a", [1], [4]), (b"a", [1], [9, 10]), (b"b", [], [-3])]
    batches = [pa.record_batch([pa.array([r[i]], t) for i, t in enumerate((pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["key", "words", "ids"]) for r in rows]
    out = [tuple(r.values()) for b in ct.hashed_members(iter(batches)) for r in b.to_pylist()]
    assert out == [(b"a", [1], 5, 1, hashlib.sha256(b"1,2,4,9,10").hexdigest()), (b"b", [], 1, -3, hashlib.sha256(b"-3").hexdigest())]


def test_quicksort_alone():
    rng = random.Random(5)
    seqs = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(6))) for _ in range(80)})
    rng.shuffle(seqs)
    lengths = np.array([len(s) for s in seqs])
    flat = np.array([x for s in seqs for x in s])
    found = ct.quicksort(flat, flat, np.cumsum(lengths) - lengths, lengths, np.ones(len(seqs), np.int64), np.arange(len(seqs)), -1)
    want = {}
    for s in seqs:
        for d in range(len(s) + 1):
            want[s[:d]] = want.get(s[:d], 0) + 1
    assert sorted(zip(found.depth, found.n)) == sorted((len(p), n) for p, n in want.items())
    assert all(p < i and found.depth[p] == found.depth[i] - 1 for i, p in enumerate(found.parent) if p >= 0)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    have = registry.op13_conversation_trie(spark, "/root/testdata/sf0.001")
    assert have.columns == COLUMNS and sorted(tuple(-1 if x is None else x for x in r) for r in have.collect()) == direct(rows)
