"""Vector codes against a direct Lloyd on all vectors, row by row."""

import hashlib
import math

import numpy as np
import pytest

from pathloom.llm import lookup, registry, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, pos int, `n` string, row string"


def direct(rows, parts, entries, rounds):
    """rows (id, vector, label) -> sorted [(id, label, codes, error, label_error)], codebooks."""
    kept = [(i, v, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = len(kept[0][3]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[list(cut(r[3], p)) for r in first] for p in range(parts)]

    def near(q, p):
        return min((sum((x - y) ** 2 for x, y in zip(cut(q, p), e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(r[3], p)[1] for r in kept]
            books[p] = [[sum(c) // len(c) for c in zip(*own, strict=True)] if (own := [cut(r[3], p) for r, o in zip(kept, of, strict=True) if o == i]) else e for i, e in enumerate(books[p])]
    out = []
    for i, _, lab, q in kept:
        found = [near(q, p) for p in range(parts)]
        out.append((i, lab, [x for _, x in found], sum(d for d, _ in found)))
    by = {}
    for _, lab, _, e in out:
        by[lab] = by.get(lab, 0) + e
    return sorted(((*r, by[r[1]]) for r in out), key=repr), books


def got(spark, rows, **kind):
    table = spark.createDataFrame([(i, v, lab, "x", 7, "n", "r") for i, v, lab in rows], SCHEMA).repartition(3)
    found, books = vector_codes.compress(table, **kind)
    assert found.columns == ["vec_id", "label", "codes", "error", "label_error"]
    return sorted((tuple(r) for r in found.collect()), key=repr), books


@pytest.mark.parametrize("shares", [20_000, 3])
def test_odd_rows(spark, monkeypatch, shares):
    """Null and non-finite components, repeated, null and negative ids, equal vectors, null labels, frequent parts joined both ways."""
    monkeypatch.setattr(lookup, "SHARES", shares)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.02, 8)], int(i) % 3) for i in range(60)]
    rows += [(i, rows[5][1], None) for i in range(100, 140)]  # a third of all rows are alike
    rows += [(7, rows[9][1], 1), (7, rows[8][1], 1), (None, rows[3][1], None), (-4, [-0.001] * 8, 2)]
    rows += [(200, None, 1), (201, [0.1] * 7 + [None], 1), (202, [float("nan")] + [0.1] * 7, 1), (203, [0.1] * 7 + [float("-inf")], 1)]
    want, books = direct(rows, 4, 8, 2)
    have, found = got(spark, rows, parts=4, entries=8, rounds=2)
    assert have == want and found.tolist() == books
    assert vector_codes.digest(found) == hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


def test_fewer_vectors_than_entries(spark):
    rows = [(1, [0.5, -0.5], 0), (2, [0.25, 0.0], 0)]
    assert got(spark, rows, parts=2, entries=64)[0] == direct(rows, 2, 64, 2)[0]


def test_empty(spark):
    assert got(spark, [], parts=2)[0] == [] and got(spark, [(1, None, 3), (2, [None, 1.0], 3)], parts=2)[0] == []


def test_what_cannot_be_coded(spark):
    for rows in ([(1, [0.1, 0.2], 0), (2, [0.1] * 4, 0)], [(1, [0.1] * 3, 0)], [(1, [], 0)], [(1, [1e300, 0.0], 0)]):
        with pytest.raises(ValueError, match="one length"):
            got(spark, rows, parts=2)


def test_ties_and_large_sums():
    book = np.array([[0, 0], [2, 0], [0, 0]])
    assert [x.tolist() for x in vector_codes.nearest(np.array([[1, 0], [0, 0], [3, 0]]), book)] == [[0, 0, 1], [1, 0, 1]]


def test_sums_beyond_64_bits(spark):
    distinct = spark.createDataFrame([(0, [(1 << 27) - 1, -(1 << 27) + 1], 1 << 40), (0, [1, 2], 3)], "pos long, part array<long>, n long")
    want = {(0, 0): ((1 << 40) + 3, [((1 << 27) - 1) * (1 << 40) + 3, -((1 << 27) - 1) * (1 << 40) + 6])}
    assert vector_codes.sums(distinct, np.zeros((1, 1, 2), np.int64)) == want


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 100 or vec_id % 7 = 0")
    found, books = vector_codes.compress(rows)
    want, same = direct([tuple(r) for r in rows.select("vec_id", "embedding", "label").collect()], 16, 64, 2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want and books.tolist() == same
    assert set(registry.op12_vector_codes(spark, "/root/testdata/sf0.001").columns) == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}
