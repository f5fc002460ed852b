"""Rows worked out by hand from the rules: path cases, merging, coverage, results, segment constraints, parameter positions."""

import pytest

from pathloom import catalog  # noqa: F401  (registers the plans)
from pathloom.operators import loops, segment_constraints, walks
from pathloom.plans.core import run

FLOW = "path_id long, pos long, fn string, file string, line long, var string, code string, sc long, ec long"
CALL = "caller string, caller_file string, line long, callee string, callee_file string"


def tables(spark, paths, calls):
    """Points as (function, line[, variable[, code]]) of each path; calls as (caller, line, callee)."""
    flow = [(i, k, p[0], "a.c", p[1], p[2] if len(p) > 2 else "v", p[3] if len(p) > 3 else p[0], 0, 0) for i, points in paths.items() for k, p in enumerate(points)]
    return {"flow_point": spark.createDataFrame(flow, FLOW), "call_edge": spark.createDataFrame([(a, "a.c", n, b, "a.c") for a, n, b in calls], CALL)}


def split(spark, points, calls):
    rows = run(spark, "segment_step", tables(spark, {1: points}, calls)).orderBy("idx").collect()
    return "".join(r["segment"][0] for r in rows)


RETURNS = [("b", 2, "c"), ("a", 3, "b")]


@pytest.mark.parametrize("points,calls,want", [
    ([("f", 1), ("f", 2), ("f", 3)], [], "ii"),  # one function
    ([("c", 1), ("b", 2), ("a", 3), ("d", 4), ("e", 5)], RETURNS, "bbff"),  # return, return, call, call
    ([("a", 1), ("a", 2), ("b", 3), ("c", 4)], [], "iff"),  # starts in the shallowest function
    ([("x", 1), ("a", 2), ("b", 3), ("a", 4), ("c", 5)], [("a", 2, "x"), ("a", 4, "b")], "biif"),  # two calls out of it: the last one
    ([("a", 1), ("b", 1), ("c", 2)], [("b", 1, "a"), ("c", 2, "b")], "bb"),  # only returns
    ([("a", 1, "v", "one"), ("a", 2, "v", "two"), ("a", 3, "v", "two")], [], "ff"),  # recursion: equal names, other code
])
def test_split(spark, points, calls, want):
    assert split(spark, points, calls) == want


def test_ties_and_keys(spark):
    t = tables(spark, {1: [("p", 1), ("q", 2), ("p", 3)], 2: [("f", 1, ""), ("f", 2, "")], 3: [("c", 1), ("a", 3), ("d", 4)], 4: [("c", 1), ("a", 3), ("e", 4)]}, [("a", 3, "c"), ("p", 3, "q")])
    assert [r.id for r in run(spark, "lca", t).where("path_id = 1").collect()] == ["p@a.c"]  # p and q would tie if q came first
    keys = {(r.path_id, r.segment): r for r in run(spark, "segment_key", t).collect()}
    assert "::" not in keys[2, "intermediate"].skey and len(keys[2, "intermediate"].skey) == 32  # empty variable: the bare hash
    assert keys[2, "backward"].is_virtual and keys[2, "forward"].is_virtual
    assert keys[3, "backward"].skey == keys[4, "backward"].skey and keys[3, "forward"].skey != keys[4, "forward"].skey
    units = run(spark, "logic_unit_full", t).where("first_path in (3, 4)").groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in units} == {"backward": 1, "intermediate": 2, "forward": 2}


def test_look_alike_cross_step(spark):
    """The step that the split maps to is the first with the same ends, whatever its kind."""
    points = [("c", 5), ("a", 3), ("c", 5), ("a", 3), ("d", 4)]
    assert split(spark, points, [("a", 3, "c")]) == "biif"


def test_merge(spark):
    """Two sets of points and a path without the function: three variants, so no must stays; a may key that was
    demoted is not given twice; where all variants agree a key may stand in both lists."""
    kind = "segment string, unit_key string, fn string, variant string, line long, branch string, kind string"
    rows = [("forward", "u", "f", v, 1, "TRUE", "must") for v in ("p", "q")] + [("forward", "u", "f", "p", 2, "TRUE", "must"), ("forward", "u", "f", "q", 2, "TRUE", "may"), ("forward", "u", "f", "q", 1, "TRUE", "may"), ("forward", "u", "f", "q", 9, "FALSE", "may")]
    for variants, want in ((2, [(1, "must", False, None), (1, "may", False, None), (2, "may", True, 0.5), (9, "may", False, None)]), (4, [(1, "may", True, 0.5), (2, "may", True, 0.25), (9, "may", False, None)])):
        counts = spark.createDataFrame([("forward", "u", "f", variants)], "segment string, unit_key string, fn string, n long")
        got = run(spark, "merged_constraint", {"constraint_row": spark.createDataFrame(rows, kind), "variant_count": counts}).collect()
        assert sorted((r.line, r.kind, r.demoted_from_must, r.coverage) for r in got) == sorted(want, key=lambda x: x[:3])


def test_variant_count(spark):
    points = spark.createDataFrame([(1, "forward", "u", "f", "a", 1), (2, "forward", "u", "f", "b", 1), (1, "forward", "u", "g", "a", 1), (2, "forward", "u", "g", "a", 1)], "path_id long, segment string, unit_key string, fn string, points string, n_points long")
    unit = lambda n: spark.createDataFrame([("forward", "u", n)], "segment string, unit_key string, usage_count long")
    assert {r.fn: r.n for r in run(spark, "variant_count", {"point_set": points, "logic_unit": unit(2)}).collect()} == {"f": 2, "g": 1}
    assert {r.fn: r.n for r in run(spark, "variant_count", {"point_set": points, "logic_unit": unit(3)}).collect()} == {"f": 3, "g": 2}


def test_coverage(spark):
    counts = [5, 3, 1, 1, 4, 2, 1, 1, 1, 1]  # 20 paths; descending 5 4 3 2 1 1 1 1 1 1
    units = spark.createDataFrame([("forward", f"u{i}", c) for i, c in enumerate(counts)], "segment string, unit_key string, usage_count long")
    got = {r.decile: r.coverage for r in run(spark, "coverage", {"logic_unit": units}).collect()}
    assert got == {0: 0, 10: 25, 20: 45, 30: 60, 40: 70, 50: 75, 60: 80, 70: 85, 80: 90, 90: 95, 100: 100}
    assert run(spark, "pareto", {"logic_unit": units}).first().units_for_80 == 6
    assert run(spark, "top_tenth", {"logic_unit": units}).first().coverage == 45  # the second unit: index 1 from 0
    assert run(spark, "coverage_80", {"logic_unit": units}).first().percent_for_80 == 60


def test_parameter_position(spark):
    kind = "path_id long, pos long, variable string, line_code string, semantic_label string"
    rows = [("n", "static int run(char *p, int n)", True), ("q", "static int run(char *p, int n)", False), ("n", "go(n);", False), ("int", "int x = 1;", False), ("v", "void f )v(", False)]
    points = spark.createDataFrame([(1, i, v, c, None) for i, (v, c, _) in enumerate(rows)], kind)
    assert [r.is_parameter for r in run(spark, "parameter_position", {"code_point": points}).orderBy("pos").collect()] == [w for *_, w in rows]
    labels = [(None, "v", "variable `v`"), (" call to f ", "call to f", "the call to f (`v`)"), ("... = ...", "v", "variable `v`"), ("[summary] read: x", "v", "variable `v`"), ("  ", "v", "variable `v`")]
    points = spark.createDataFrame([(1, i, "v", "", s) for i, (s, *_) in enumerate(labels)], kind)
    assert [(r.display, r.narrative) for r in run(spark, "display_variable", {"code_point": points}).orderBy("pos").collect()] == [tuple(x[1:]) for x in labels]


DIAMOND = [(1, 0, 1, "TRUE"), (1, 0, 2, "FALSE"), (1, 1, 3, "UNCONDITIONAL"), (1, 2, 3, "UNCONDITIONAL"), (1, 3, 4, "TRUE"), (1, 3, 5, "FALSE")]


def test_segment_constraints(spark):
    """0 branches to 1 and 2, which meet in 3; 3 branches to 4 and 5.  Block n covers the lines 10 n to 10 n + 5."""
    edges = spark.createDataFrame(DIAMOND, "fn long, src long, dst long, etype string")
    blocks = spark.createDataFrame([(1, n, 10 * n + (5 if n == 2 else 0), 10 * n + (0 if n == 2 else 5)) for n in range(6)], "fn long, block long, sl long, el long")  # 2 is reversed
    paths = walks.enumerate_paths(loops.unroll(edges, edges.selectExpr("fn", "dst as head", "src as tail").limit(0)))
    kind = "segment string, unit_key string, function_id string, fn long, seq long, line long, sc long, ec long, is_parameter boolean, start_line long"
    point = lambda s, u, seq, line, fn="f", p=False: (s, u, fn, 1, seq, line, 1, 2, p, 0)
    rows = [point("backward", "one", 0, 42)]  # one point in 4
    rows += [point("forward", "two", 0, 21), point("forward", "two", 1, 21), point("forward", "two", 2, 53)]  # through 2 to 5
    rows += [point("backward", "left out", 0, 0), point("backward", "left out", 1, 12, p=True)]  # declaration line, parameter
    rows += [point("intermediate", "first", 0, 12), point("intermediate", "first", 1, 33, "g"), point("intermediate", "first", 2, 44)]  # g is not the first function
    rows += [point("intermediate", "alone", 0, 12)]
    rows += [point("forward", "backwards", 0, 53), point("forward", "backwards", 1, 21)]  # no path goes from 5 to 2
    got = segment_constraints.constraints(spark.createDataFrame(rows, kind), blocks, paths).collect()
    assert {(r.unit_key, r.line, r.branch, r.n, r.total, r.kind) for r in got} == {
        ("one", 35, "TRUE", 2, 2, "dominator"), ("one", 5, "TRUE", 1, 2, "optional"), ("one", 5, "FALSE", 1, 2, "optional"),
        ("two", 5, "FALSE", 1, 1, "dominator"), ("two", 35, "FALSE", 1, 1, "dominator"),
        ("first", 5, "TRUE", 1, 1, "dominator"), ("first", 35, "TRUE", 1, 1, "dominator"),
    }


def test_caps_are_told(spark):
    edges = spark.createDataFrame([(1, 3 * k + a, 3 * k + b, t) for k in range(9) for a, b, t in ((0, 1, "TRUE"), (0, 2, "FALSE"), (1, 3, "UNCONDITIONAL"), (2, 3, "UNCONDITIONAL"))], "fn long, src long, dst long, etype string")
    capped, whole = walks.enumerate_paths(edges, 27).collect(), walks.enumerate_paths(edges, 27, max_paths=None, max_calls=None).collect()
    assert (len(capped), len(whole)) == (200, 512) and all(r.truncated for r in capped) and not any(r.truncated for r in whole)


VARIANT = "segment string, unit_key string, function_id string, points string, fn long, line long, sc long, ec long, is_parameter boolean, start_line long"


def test_variants_of_a_unit_merge(spark):
    """Two ways through the diamond: what both take must be taken, what one takes may; a variant without the function counts."""
    edges = spark.createDataFrame(DIAMOND, "fn long, src long, dst long, etype string")
    blocks = spark.createDataFrame([(1, n, 10 * n, 10 * n + 5) for n in range(6)], "fn long, block long, sl long, el long")
    paths = walks.enumerate_paths(edges)
    point = lambda points, line, p=False: ("backward", "u", "f", points, 1, line, 1, 2, p, 0)
    rows = [point("left", 12), point("left", 42), point("right", 21), point("right", 42), point("right", 13, True)]
    asked = segment_constraints.variant_questions(spark.createDataFrame(rows, VARIANT), blocks)
    assert {(r.points, r.target, tuple(r.required), r.several) for r in asked.collect()} == {("left", 4, (1,), True), ("right", 4, (2,), True)}
    found = segment_constraints.variant_answers(asked, paths, blocks)
    assert {(r.variant, r.line, r.branch, r.kind) for r in found.collect()} == {("left", 5, "TRUE", "must"), ("left", 35, "TRUE", "must"), ("right", 5, "FALSE", "must"), ("right", 35, "TRUE", "must")}
    for n, kinds in ((2, {("TRUE", 35): ("must", False, None)}), (3, {("TRUE", 35): ("may", True, 2 / 3)})):
        count = spark.createDataFrame([("backward", "u", "f", n)], "segment string, unit_key string, fn string, n long")
        merged = run(spark, "merged_constraint", {"constraint_row": found, "variant_count": count}).collect()
        got = {(r.branch, r.line): (r.kind, r.demoted_from_must, r.coverage) for r in merged}
        assert got == {("TRUE", 5): ("may", True, 1 / n), ("FALSE", 5): ("may", True, 1 / n)} | kinds


def test_results_of_contexts(spark):
    """A path's verdict is that of its own context: one unit, three contexts of which one has no result, and a path without a middle."""
    decomposition = [(1, "b1", "i", "f1"), (2, "b2", "i", "f1"), (3, "b3", "i", "f1"), (4, "b1", None, "f1"), (5, "b1", "j", "f1")]
    tables = {
        "decomposition": spark.createDataFrame(decomposition, "path_id long, b_key string, i_key string, f_key string"),
        "path_unit": spark.createDataFrame([(p, "intermediate", i) for p, _, i, _ in decomposition if i], "path_id long, segment string, unit_key string"),
        "unit_result": spark.createDataFrame([("intermediate", "i", True, False), ("intermediate", "j", False, False)], "segment string, unit_key string, analysed boolean, cached boolean"),
        "context_result": spark.createDataFrame([("i", "b1", "f1", False, "HIGH"), ("i", "b2", "f1", True, "odd")], "unit_key string, backward_key string, forward_key string, fp boolean, level string"),
        "logic_unit": spark.createDataFrame([("backward", "b1", "v")], "segment string, unit_key string, variable string"),
    }
    got = {(r.path_id, r.variable_name, r.is_vulnerable, r.verdict, float(r.confidence)) for r in run(spark, "path_result", tables).collect()}
    assert got == {(1, "v", True, "Confirmed Vulnerability", 0.9), (2, "unknown", False, "False Positive", 0.5), (3, "unknown", False, "Context not found", 0.0), (4, "v", False, "Not analyzed", 0.0), (5, "v", False, "Not analyzed", 0.0)}


def test_order_over_ranges_of_keys(spark):
    rows = [(s, f"k{n % 7:03d}{n:04d}", u) for s in ("backward", "intermediate") for u in (1, 2, 9) for n in range(u * 5)]
    units = spark.createDataFrame(rows, "segment string, unit_key string, usage_count long").dropDuplicates(["segment", "unit_key"])
    got = run(spark, "unit_order", {"logic_unit": units}).collect()
    for s in ("backward", "intermediate"):
        own = sorted((r for r in got if r.segment == s), key=lambda r: (-r.usage_count, r.unit_key))
        assert [r.priority for r in own] == list(range(1, len(own) + 1))


def test_calls_and_places_in_code(spark):
    lines = spark.createDataFrame([("a.c", 1, "if (x) y = go(1) + run (go(2));"), ("a.c", 2, "return (z); sizeof(int)"), ("b.c", 3, "int (*f)(void) = g;"), ("b.c", 4, None)], "file string, line long, text string")
    assert {tuple(r) for r in run(spark, "code_calls", {"code_line": lines}).collect()} == {("a.c", 1, "go", 2), ("a.c", 1, "run", 1), ("b.c", 3, "int", 1)}
    code = spark.createDataFrame([(1, "File Path: src/a b.c\n 10: int x = M;\n11: p(x); // 7: no\n\n  12:"), (2, "10: without a path"), (3, "File Path: e.c\nnothing"), (4, None)], "path_id long, text string")
    assert {tuple(r) for r in run(spark, "related_code_site", {"related_code": code}).collect()} == {(1, "src/a b.c", 10), (1, "src/a b.c", 11), (1, "src/a b.c", 12)}


def test_all_tags_of_a_query(spark):
    text = spark.createDataFrame([(1, "@kind path-problem external/cwe/cwe-020 external/cwe/cwe-0079 external/cwe/cwe-20"), (2, "@kind problem external/cwe/cwe-79"), (3, "@kind path-problem")], "file long, text string")
    assert {tuple(r) for r in run(spark, "query_pairs", {"query_text": text}).collect()} == {(1, 20), (1, 79)}
    assert {tuple(r) for r in run(spark, "query_catalogue", {"query_text": text}).collect()} == {(20, 1, 1, 1), (79, 2, 1, 1)}


def test_places_of_the_suite(spark):
    files = ["src1", "a/juliet-test-suite-c/x.c", "lib/CWE12_x.c", "lib/x.c", "s/main.cpp", "s/main_linux.cpp"]
    alerts = spark.createDataFrame([(f, n) for n, f in enumerate(files)], "file string, line long")
    assert {r.file for r in run(spark, "suite_alert", {"alert": alerts}).collect()} == set(files[:3])
    labelled = spark.createDataFrame([("src1", 0, "bad", "f"), ("src1", 9, "bad", "g"), ("lib/x.c", 3, "good", "h")], "file string, line long, kind string, fn string")
    row = run(spark, "evaluation", {"alert": alerts, "labelled_function": labelled}).collect()[0]
    assert (row.tp, row.fp, row.total_bad, row.total_good, row.recall, row.precision_pct, row.fpr) == (1, 0, 2, 1, 50.0, 100.0, 0.0)
