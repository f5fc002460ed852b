"""Rows that share an id, null ids and extra columns of the n-gram join."""

from pyspark.sql import functions as F

from pathloom.llm import ngram_join


def test_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(5, " ".join(base)), (5, " ".join(base)), (5, "another short text"), (3, near), (9, near), (None, near), (7, "a b c d e f"), (7, "a b c d e f"), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(f"in {n}") for n in ("component_id", "n_shingles", "h", "shared", "rep")})
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())
    assert got == [(3, 56, 3), (5, 1, 3), (5, 56, 3), (5, 56, 3), (7, 2, 7), (7, 2, 7), (8, 0, 8), (8, 0, 8), (9, 56, 3)]
