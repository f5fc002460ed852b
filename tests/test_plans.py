"""Oracle parity of some plans on sf0.001, path fixtures, graphs and readers."""

import json

import duckdb
import pytest

from pathloom import catalog
from pathloom.operators import graphs, loops, walks
from pathloom.plans.core import run
from pathloom.sources import readers

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(None if v is None else float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["top_units", "depth", "full_segment", "coverage", "merged_constraint", "enclosing_function", "symbol_fallback", "nearest_label", "validation_category", "cfg_closure", "cfg_components"])
def test_oracle(spark, name):
    got = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert plain(tuple(r) for r in got.collect()) == plain(tuple(r[names.index(c)] for c in got.columns) for r in want.fetchall())


def segments(spark, points, calls):
    flow = spark.createDataFrame([(1, i, fn, "a.c", line, "v", fn, 0, 0) for i, (fn, line) in enumerate(points)], "path_id long, pos long, fn string, file string, line long, var string, code string, sc long, ec long")
    edges = spark.createDataFrame([(t, "a.c", line, f, "a.c") for t, line, f in calls], "caller string, caller_file string, line long, callee string, callee_file string")
    rows = run(spark, "segment_step", {"flow_point": flow, "call_edge": edges}).orderBy("idx").collect()
    return "".join(r["segment"][0] for r in rows), [r["relation"] for r in rows]


def test_one_function_is_all_intermediate(spark):
    assert segments(spark, [("f", 1), ("f", 2), ("f", 3)], []) == ("ii", ["SAME", "SAME"])


def test_return_return_call_call_splits_at_the_shallowest(spark):
    split, relations = segments(spark, [("c", 1), ("b", 2), ("a", 3), ("d", 4), ("e", 5)], [("b", 2, "c"), ("a", 3, "b")])
    assert relations == ["RETURN", "RETURN", "CALL", "CALL"]
    assert split == "bbff"


def test_start_in_the_shallowest_function(spark):
    assert segments(spark, [("a", 1), ("a", 2), ("b", 3), ("c", 4)], [])[0] == "iff"


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 0, 1, "TRUE"), (1, 0, 2, "FALSE"), (1, 1, 3, "UNCONDITIONAL"), (1, 2, 3, "UNCONDITIONAL"), (1, 3, 1, "TRUE")], "fn long, src long, dst long, etype string")
    assert {(r.block, r.component) for r in graphs.strong_components(edges).collect()} == {(0, 0), (1, 1), (2, 2), (3, 1)}
    assert {(r.block, r.dominator) for r in graphs.dominators(edges).where("immediate").collect()} == {(1, 0), (2, 0), (3, 0)}
    paths = walks.enumerate_paths(edges.where("src < dst"), 3)
    assert {(r.path, r.constraints) for r in paths.collect()} == {("0>1>3", "0:TRUE"), ("0>2>3", "0:FALSE")}
    assert {r.kind for r in walks.classify_constraints(paths).collect()} == {"optional"}


def test_sarif(spark, tmp_path):
    place = lambda line: {"location": {"physicalLocation": {"artifactLocation": {"uri": "file:///src/a.c"}, "region": {"startLine": line}}, "message": {"text": "m"}}}
    doc = {"runs": [{"results": [{"ruleId": "r", "message": {"text": "t"}, "codeFlows": [{"threadFlows": [{"locations": [place(1), {"location": {}}, place(2)]}]}]}]}, {"results": []}]}
    (tmp_path / "x.sarif").write_text(json.dumps(doc))
    rows = readers.sarif(spark, str(tmp_path / "x.sarif")).collect()
    assert [(r.uri, r.startLine, r.endColumn, r.label) for r in rows] == [("/src/a.c", 1, 0, "m"), ("/src/a.c", 2, 0, "m")]


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in readers.latest(rows, ["k"], "o").collect()} == {("a", "y"), ("b", "z")}


def test_edges_of_all_rows(spark):
    """Every row of lineitem that is no self-loop has its edge, and the last one names the kind; every step has its call."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    want = {}
    for r in rows:
        key = (r.l_orderkey - r.l_orderkey % 4, r.l_partkey % 12, r.l_suppkey % 12)
        kind = {"A": "TRUE", "R": "FALSE"}.get(r.l_returnflag, "UNCONDITIONAL")
        if key[1] != key[2]:
            want[key] = max(want.get(key, ("", "")), (f"{r.l_orderkey}/{r.l_linenumber}/{r.l_partkey}/{r.l_suppkey}/{r.l_returnflag}", kind))
    assert {(r.fn, r.src, r.dst): r.etype for r in graphs.bb_edges(spark, SF).collect()} == {k: v[1] for k, v in want.items()}
    steps, calls = (catalog.queries()[q](spark, SF).collect() for q in ("step", "call_edge"))
    pairs = {(c.caller, c.callee) for c in calls} | {(c.callee, c.caller) for c in calls}
    assert all((s.t_fn, s.f_fn) in pairs for s in steps) and {c.line % 2 for c in calls} == {0, 1}


def test_paths_through_a_loop(spark):
    """0 -> 1 -> 2 -> 1 (back), 1 -> 3: a path through the loop's second run, and paths to every block."""
    edges = spark.createDataFrame([(1, 0, 1, "UNCONDITIONAL"), (1, 1, 2, "TRUE"), (1, 2, 1, "UNCONDITIONAL"), (1, 1, 3, "FALSE")], "fn long, src long, dst long, etype string")
    loop = edges.where("src > dst").selectExpr("fn", "dst as head", "src as tail")
    paths = walks.enumerate_paths(loops.unroll(edges, loop))
    assert {(r.target, r.path, r.constraints) for r in paths.collect()} == {(0, "0", ""), (1, "0>1", ""), (2, "0>1>2", "1:TRUE"), (3, "0>1>3", "1:FALSE"), (3, "0>1>2>1_L1i2>3", "1:TRUE,1_L1i2:FALSE"), (3, "0>1>2>1_L1i2>2_L1i2>3", "1:TRUE,1_L1i2:TRUE")}
    assert {(r.target, r.block, r.branch, r.kind) for r in walks.classify_constraints(paths).collect()} == {(2, 1, "TRUE", "dominator"), (3, 1, "FALSE", "optional"), (3, 1, "TRUE", "optional")}
