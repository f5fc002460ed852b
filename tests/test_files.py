"""Readers and sinks on small files."""

import json

from pyspark.sql import functions as F

from pathloom.plans import core
from pathloom.sources import files, readers, sinks


def test_path_json_and_lists(spark, tmp_path):
    point = lambda **x: {"file_path": "a.c", "line": 1, "relatedCode": "c", "functionName": "f", "variable": "v"} | x
    long = "x" * 10_001
    steps = [{"propagation step": 1, "from": point(), "to": point(functionName=None, semanticLabel=None)}, {"propagation step": 2, "from": point(relatedCode=long), "to": point(relatedCode=long + "y")}]
    one = {"source": point(), "sink": point(), "propagation path": steps}
    (tmp_path / "p.json").write_text(json.dumps(one))
    (tmp_path / "list.json").write_text(json.dumps([one, {"propagation path": []}, 7, {"other": 1}, one]))
    rows = readers.path_json(spark, f"{tmp_path}/p.json").orderBy("idx").collect()
    assert [(r.flowstep, r.same_function, r["to"].functionName) for r in rows] == [(1, True, ""), (2, False, "f")]
    assert [(r.path_idx, len(r.steps)) for r in files.path_list(spark, f"{tmp_path}/list.json").orderBy("path_idx").collect()] == [(0, 2), (4, 2)]


def test_symbols_and_lines(spark, tmp_path):
    (tmp_path / "x_macros.csv").write_text('name,body,file_path,start_line,end_line\nM,"a, ""b""",d/a.c,1,2\n,x,a.c,1,2\nS,short\n')
    assert [tuple(r) for r in readers.symbols(spark, f"{tmp_path}/x_macros.csv", "macros").collect()] == [("M", 'a, "b"', "d/a.c", 1, 2)]
    (tmp_path / "s.c").write_text("one\n\nthree")
    assert [(r.line, r.text) for r in readers.source_lines(spark, f"{tmp_path}/s.c").orderBy("line").collect()] == [(1, "one"), (2, ""), (3, "three")]
    assert files.preferred(spark, f"{tmp_path}/none.csv", f"{tmp_path}/x_macros.csv") == f"{tmp_path}/x_macros.csv" and files.preferred(spark, f"{tmp_path}/none.csv") is None
    assert files.discover(str(tmp_path), "*_macros.csv") == f"{tmp_path}/x_macros.csv" and files.discover(str(tmp_path), "none*") is None


def test_graph_tables(spark, tmp_path):
    (tmp_path / "basic_blocks.csv").write_text("function_qualified_name,file_path,bb_id,is_entry,is_exit\nf,a.c,1.1_2.2,True,false\nf,a.c,1.1_2.2,false,TRUE\ng,a.c,3.1_4.2,true,\n")
    files.graph_tables(spark, str(tmp_path), f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out/basic_blocks").collect()
    assert sorted((r.function_qualified_name, r.is_entry, r.is_exit) for r in rows if r.function_qualified_name == "f") == [("f", False, True)] and len(rows) == 2


def test_suites_and_queries(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.ql").write_text("@kind path-problem external/cwe/cwe-078 external/cwe/cwe-22")
    (tmp_path / "q" / "b.ql").write_text("@kind problem external/cwe/cwe-1")
    assert sorted((r.file, r.cwe) for r in files.query_files(spark, f"{tmp_path}/q").collect()) == [("a.ql", 22), ("a.ql", 78)]
    names = spark.createDataFrame([("x/CWE78_Injection",), ("CWE022",), ("none",), ("CWE78_b",)], "n string")
    assert [r.cwe for r in files.weakness_folders(names, "n").collect()] == [22, 78]
    (tmp_path / "f.csv").write_text("a,b,c,d\nbad,/workspace/t/x.c,3,4\ngood,t/x.c,5,4\nlast,/workspace/t/x.c,4,4\n")
    assert sorted(tuple(r) for r in files.suite_functions(spark, f"{tmp_path}/f.csv").collect()) == [("/t/x.c", 3, "bad"), ("/t/x.c", 4, "last")]


def test_paths(spark):
    there = spark.createDataFrame([("/src/p/a.c",), ("/src/a.c",), ("/src/q/b.c",)], "f string")
    asked = spark.createDataFrame([("p/a.c",), ("a.c",), ("file:/q/b.c",), ("none.c",), (None,)], "p string")
    assert {(r.p, r.resolved, r.matches) for r in files.resolved(asked, "p", there, "f").collect()} == {("p/a.c", "/src/p/a.c", 1), ("a.c", None, 2), ("file:/q/b.c", "/src/q/b.c", 1), ("none.c", None, 0), (None, None, 0)}
    tables = spark.createDataFrame([("/results/ai-analysis/sourcecode/q/b.c",), ("x/y/a.c",), ("z.c",)], "p string")
    assert {(r.p, r.file) for r in files.located(tables, "p", there, "f", "/src").collect()} == {("/results/ai-analysis/sourcecode/q/b.c", "/src/q/b.c"), ("x/y/a.c", "/src/a.c")}


def test_settings_and_switches(monkeypatch):
    assert files.settings("a: 1\n# note\nlist:\n  - x\n  - 'y'\nb: 'two' # end\n") == {"a": "1", "list": ["x", "y"], "b": "two"}
    monkeypatch.setenv("SOME_CACHE", "off")
    assert not files.cache_enabled("SOME_CACHE") and files.cache_enabled("NO_SUCH_SWITCH")


def test_sinks(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, "x")], "v int, w string")

    for _ in range(2):
        assert [r.v for r in sinks.read_through(spark, f"{tmp_path}/r", compute, project_name="p", cwe_code="1").collect()] == [1]
    assert len(calls) == 1
    edges = spark.createDataFrame([(1, 0, 2, "TRUE"), (1, 0, 1, "FALSE")], "fn long, src long, dst long, etype string")
    assert sinks.graph_dot(edges).first().dot == 'digraph "1" {\n  "0" -> "1" [label="FALSE"];\n  "0" -> "2" [label="TRUE"];\n}'
    sinks.by_function(edges, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g").count() == 2
    log = spark.createDataFrame([("path_10",), ("path_9",)], "p string")
    sinks.text_log(log.withColumn("n", sinks.numbered_paths(F.col("p"))).coalesce(1), f"{tmp_path}/log", ["n"], F.col("p"))
    assert [r.value for r in spark.read.text(f"{tmp_path}/log").collect()] == ["path_9", "path_10"]


def test_shared_plans_see_new_content(spark, tmp_path):
    """A table that is overwritten under the same names is another table."""
    core.plan("twice_shared", "select v * 2 as v from some_rows")
    core.plan("twice_read", "select a.v from twice_shared a join twice_shared b on a.v = b.v")
    core.SHARED += ("twice_shared",)
    try:
        for n in (1, 22):
            spark.range(n).selectExpr("cast(id as int) as v").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t")
            frame = spark.read.parquet(f"{tmp_path}/t")
            assert core.run(spark, "twice_read", {"some_rows": frame}).count() == n
    finally:
        core.SHARED = core.SHARED[:-1]
        del core.PLANS["twice_shared"], core.PLANS["twice_read"]
        core.forget(spark)
