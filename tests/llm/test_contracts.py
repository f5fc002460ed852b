"""The registered queries against DuckDB and brute force, columns and digests included."""

import hashlib
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from pathloom.llm import byte_bpe, registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_digests_of_byte_bpe(spark, con):
    model = byte_bpe.encoder(byte_bpe.read_ranks(P.path(registry.BYTE_BPE)), P.PATTERN)
    want = []
    for i, text in con.execute("select doc_id, coalesce(text, '') from documents").fetchall():
        ids = model.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = registry.op5_byte_bpe(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_token_counts(spark, con):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path(registry.PIECES))
    rows = con.execute("select doc_id, coalesce(text, '') from documents").fetchall()
    want = sorted((i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op6_token_counts(spark, SF).collect()) == want


def test_held_out_flags(spark):
    for name, mod, rest in (("op7_language_id", 4, 2), ("op10_lm_score", 5, 1)):
        rows = registry.queries()[name](spark, SF).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows) and {r.held_out for r in rows} == {True, False}
        assert name != "op7_language_id" or all(0 <= r.score <= 1 for r in rows)


def test_search(spark, con):
    vectors = {i: np.array(v, np.float64) for i, v in con.execute("select vec_id, embedding from embeddings where embedding is not null").fetchall()}
    rows = registry.op2_anisotropic_search(spark, SF).collect()
    assert {r.query_id for r in rows} == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q in {r.query_id for r in rows}:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - float(vectors[q] @ vectors[r.vec_id])) < 1e-9 for r in own)
        best = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:20]
        hits += len({i for _, i in best} & {r.vec_id for r in own})
    assert hits >= 0.9 * len(rows)
