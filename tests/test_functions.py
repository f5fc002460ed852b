"""Text functions and sinks on small rows."""

from pyspark.sql import functions as F

from pathloom.functions import text
from pathloom.sources import sinks


def test_text(spark):
    r = spark.createDataFrame([("a/b.c", "f@x@p/q.c", "1.2_3.4_L9i2", ["a", "a", "b"], "abcdef", "@kind path-problem\n external/cwe/cwe-078 external/cwe/cwe-22 external/cwe/cwe-22")], "p string, i string, b string, w array<string>, l string, q string")
    got = r.select(text.basename(F.col("p")), text.split_id(F.col("i")), text.split_id(F.col("p")), text.block_context(F.col("b")), text.block_context(F.col("p")), text.valid_path(F.col("w")), text.variable_slice(F.col("l"), F.lit(2), F.lit(4)), text.cwe_numbers(F.col("q")), text.query_kind(F.col("q")), text.query_kind(F.col("p")), text.numbered(F.col("w"), F.lit(7))).first()
    assert list(got) == ["b.c", ("f@x", "p/q.c"), ("a/b.c", ""), "_L9i2", "original", False, "bc", [22, 78], "path-problem", None, "7: a\n8: a\n9: b"]


def test_replace_results(spark, tmp_path):
    kind = "project_name string, cwe_code string, v int"
    sinks.replace_results(spark.createDataFrame([("p", "1", 1), ("p", "2", 2), ("q", "1", 3)], kind), f"{tmp_path}/r")
    sinks.replace_results(spark.createDataFrame([("p", "1", 9)], kind), f"{tmp_path}/r")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [2, 3, 9]


def test_debug_rows_and_paths(spark):
    rows = spark.createDataFrame([("unit", 1), ("unit", 2), ("unit", 3), ("context_unit", 4), ("context_unit", 5), ("context_unit", 6)], "t string, i int")
    assert sorted(r.i for r in sinks.debug_rows(rows, "t", ["i"], keep=2).collect()) == [1, 2, 4, 5, 6]
    paths = spark.createDataFrame([("/old/a",), ("/older",), (None,), ("",), ("/x/old/a",)], "p string")
    assert [r.p for r in sinks.rewrite_paths(paths, "p", "/old/", "/new/").collect()] == ["/new/a", "/older", "/x/old/a"]
