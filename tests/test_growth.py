"""Copies of definitions aren't met with copies of places: tables of many copies, results by hand, and joins by what they send on."""

import re

from pathloom import catalog  # noqa: F401
from pathloom.plans.core import run

SITE = "site long, line long, file_path string, base string, name string"
DEF = "ordinal long, name string, qname string, file_path string, base string, start_line long, end_line long"


def joined(df):
    """The rows that joins of a collected DataFrame put out, the most of one."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [0], [plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def sites(spark, n):
    return spark.createDataFrame([(i, 20, "src/a.c", "a.c", "g1") for i in range(n)], SITE)


def defs(spark, n):
    return spark.createDataFrame([(i, "g1", "ns::g1", ("lib/" if i < 5 else "src/") + "a.c", "a.c", 10, 30) for i in range(n)], DEF)


def test_enclosing_function_of_copies(spark):
    got = run(spark, "enclosing_function", {"use_site": sites(spark, 300), "function_def": defs(spark, 300)})
    assert {tuple(r) for r in got.collect()} == {(i, 20, "g1", "ns::g1", 10, 30) for i in range(300)}
    assert joined(got) <= 300


def test_enclosing_suffix_of_copies(spark):
    got = run(spark, "enclosing_suffix", {"use_site": sites(spark, 300), "function_def": defs(spark, 300)})
    assert {tuple(r) for r in got.collect()} == {(i, "ns::g1", 10, 30) for i in range(300)}
    assert joined(got) <= 300


def test_global_by_name_of_copies(spark):
    asked = spark.createDataFrame([(i, "ns::v" if i % 2 else "v", "a.c", "src/", 1) for i in range(300)], "site long, name string, base string, dir string, line long")
    names = spark.createDataFrame([(i, "v", f"t{i}") for i in range(299, -1, -1)], "ordinal long, name string, type_name string")
    got = run(spark, "global_by_name", {"requested_symbol": asked, "global_var": names})
    assert {tuple(r) for r in got.collect()} == {(i, "v", "t0") for i in range(300)}
    assert joined(got) <= 300


def test_open_request_joins_on_keys(spark):
    asked = spark.createDataFrame([(i, n, "a.c", "src/", 1) for i, n in enumerate(["g1", "ns::g1", "m", "x", "", None] * 3)], "site long, name string, base string, dir string, line long")
    macros = spark.createDataFrame([(1, "m", "b", "a.c", 1)], "ordinal long, name string, body string, base string, line long")
    got = run(spark, "open_request", {"requested_symbol": asked, "function_def": defs(spark, 300), "macro_def": macros})
    assert [tuple(r) for r in got.collect()] == [("x", "a.c")]
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().sparkPlan().toString())


def test_macros_of_copies(spark):
    """A line's macros are reduced to the first of each name before paths meet them."""
    points = spark.createDataFrame([(p, i, "a.c", 5 + i) for p in range(100) for i in range(2)], "path_id long, pos long, file_path string, line long")
    macros = spark.createDataFrame([(i, "m" if i % 2 else "n", "src/a.c", "a.c", 5 + i % 3, f"d{i}.h", f"b{i}") for i in range(300, -1, -1)], "ordinal long, name string, use_file string, base string, use_line long, def_file string, body string")
    got = run(spark, "macro_preload", {"code_point": points, "macro_use": macros})
    assert {tuple(r) for r in got.collect()} == {(p, *x) for p in range(100) for x in (("n", "b0", "d0.h"), ("m", "b3", "d3.h"))}
    assert joined(got) <= 400
