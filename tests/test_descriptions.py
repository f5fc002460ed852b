"""Blocks by id, texts of constraints, versions of queries and lookups, on rows worked out by hand."""

from pathloom import catalog  # noqa: F401  (registers the plans)
from pathloom.plans.core import run
from pathloom.sources import sinks


def rows(spark, name, **tables):
    return {tuple(r) for r in run(spark, name, {k: spark.createDataFrame(v, s) for k, (v, s) in tables.items()}).collect()}


def test_ids_of_blocks(spark):
    ids = ["615.4_612.10", "3.1_5.2_L10i2_L3i2", "12.3", "x.1_2.3", "0.0_0.0", "7_9", "1.2_b", "-1.0_2.0"]
    got = {r[0]: r[2:] for r in rows(spark, "block_id_parts", asked_id=([(i,) for i in ids], "block_id string"))}
    assert got["615.4_612.10"] == ("original", 615, 612, 4, True, True)
    assert got["3.1_5.2_L10i2_L3i2"] == ("_L10i2_L3i2", 3, 5, 3, False, True)
    assert got["12.3"] == ("original", None, None, 1, False, True)
    assert [got[i][3] for i in ("x.1_2.3", "1.2_b", "0.0_0.0", "7_9", "-1.0_2.0")] == [999, 999, 1, 3, 4]
    assert not got["0.0_0.0"][5] and not got["1.2_b"][4]


def test_text_of_blocks(spark):
    lines = (["abcdef", "ghi", "", "jklmnop"], "file string, line long, text string")
    source = ([("a.c", n + 1, t) for n, t in enumerate(lines[0])], lines[1])
    asked = ["1.2_1.3", "1.3_4.2", "2.1_1.1", "0.1_2.1", "9.1_9.4", "4.3_4.3_L1i2", "1.9_1.2"]
    got = dict((r[1], r[2]) for r in rows(spark, "block_text", source_line=source, asked_block=([("a.c", i) for i in asked], "file string, block_id string")))
    # the last column and the one behind it belong to the text; what ends before it starts goes on for two lines
    assert got == {"1.2_1.3": "bcd", "1.3_4.2": "cdefghijkl", "2.1_1.1": "ghijk", "0.1_2.1": "", "9.1_9.4": "", "4.3_4.3_L1i2": "lm", "1.9_1.2": ""}


def test_merged_points(spark):
    flow = [(1, n, f, "a.c", line, sc, 9) for n, (f, line, sc) in enumerate([("f", 1, 1), ("f", 1, 1), ("g", 1, 1), ("f", 1, 1), ("f", 1, 2), ("f", 30, 2), ("f", 31, 2), ("f", 90, 1), ("f", 91, 1)])]
    flow = (flow, "path_id long, pos long, fn string, file string, line long, sc long, ec long")
    assert {r[:3] + r[-1:] for r in rows(spark, "merged_identical_points", flow_point=flow)} == {(1, "f@a.c", 0, 3), (1, "g@a.c", 2, 1), (1, "f@a.c", 4, 1), (1, "f@a.c", 5, 1), (1, "f@a.c", 6, 1), (1, "f@a.c", 7, 1), (1, "f@a.c", 8, 1)}
    point = ([("f@a.c", n, 1, n, n == 31) for n in (1, 30, 31, 90, 91)], "function_id string, line long, fn long, graph_line long, is_parameter boolean")
    block = ([(1, 0, 20, 5), (1, 1, 1, 9), (1, 2, 30, 40)], "fn long, block long, sl long, el long")
    got = rows(spark, "merged_block_points", flow_point=flow, graph_point=point, block=block)
    # points in no block stay apart, parameters are left out, a block that ends before it starts holds none
    assert got == {(1, "f@a.c", 0, 1, 4), (1, "f@a.c", 5, 2, 1), (1, "f@a.c", 7, None, 1), (1, "f@a.c", 8, None, 1), (1, "g@a.c", 2, None, 1)}


def test_graphs_without_self_loops(spark):
    edges = ([("f", 1, 1), ("f", 1, 2), ("f", 2, 2), ("f", 0, 1), ("f", 2, 1)], "function string, src long, dst long")
    blocks = ([("f", 0, "0.0_0.0"), ("f", 1, "1.1_2.2"), ("f", 2, "3.1_4.2")], "function string, block long, bb_id string")
    assert rows(spark, "clean_edge", function_edge=edges, function_block=blocks) == {("f", 1, 2), ("f", 2, 1)}
    assert rows(spark, "self_loop", function_edge=(edges[0][:4], edges[1])) == {("f", 1, 1, "exits kept"), ("f", 2, 0, "infinite")}


def test_start_of_a_function(spark):
    source = ([("a.c", n + 1, t) for n, t in enumerate(["/* top */", "int f() {", " }\t", "// about g", "int", "g() {", "", "h()"])] + [("b.c", 1, "x")], "file string, line long, text string")
    asked = [("a.c", 2), ("a.c", 6), ("a.c", 8), ("a.c", 7), ("a.c", 40), ("a.c", 0), ("none.c", 5), ("a.c", 4)]
    got = {r[:2]: r[2] for r in rows(spark, "adjusted_start", source_line=source, reported_start=(asked, "file string, line long"))}
    assert got == {("a.c", 2): 1, ("a.c", 6): 4, ("a.c", 8): 8, ("a.c", 7): 4, ("a.c", 40): 8, ("a.c", 0): 0, ("none.c", 5): 5, ("a.c", 4): 4}


def test_texts_of_constraints(spark):
    key = "segment string, unit_key string, fn string, line long, branch string"
    merged = ([("forward", "u", "f@a.c", 3, "TRUE", "must", False), ("forward", "u", "f@a.c", 9, "FALSE", "may", True), ("forward", "u", "f@a.c", 4, "TRUE", "may", False), ("forward", "u", "g", 1, "FALSE", "must", False)], f"{key}, kind string, demoted_from_must boolean")
    must = ([("forward", "u", "f@a.c", 9, "FALSE", 2, 3)], f"{key}, c long, n long")
    count = ([("forward", "u", "f@a.c", 3), ("forward", "u", "g", 1)], "segment string, unit_key string, fn string, n long")
    text = rows(spark, "merged_constraint_text", merged_constraint=merged, must_constraint=must, variant_count=count).pop()[2]
    assert text == "\n".join([
        "=== Control Flow Constraints (Merged from Path Variants) ===", "", "Function f (merged from 3 variants):", "  MUST-satisfy (all variants):", "    - Line 3: branch `TRUE`", "  MAY-satisfy (variant-dependent):",
        "    - Line 4: branch `TRUE`", "    - Line 9: branch `FALSE` (2/3 variants, demoted from must)", "", "Function g:", "  MUST-satisfy (all variants):", "    - Line 1: branch `FALSE`", "",
    ])
    assert "May" not in (prompt := rows(spark, "constraint_prompt", merged_constraint=merged).pop()[2]) and prompt.count("Function ") == 2 and "Line 9" not in prompt
    shown = ([(1, 1, 0, "TRUE", "UNKNOWN", ""), (1, 2, 7, "FALSE", " a < b ", "7.1_8.2_L10i2")], "fn long, place long, line long, branch string, condition string, block_id string")
    assert rows(spark, "constraint_display", shown_constraint=shown).pop()[1] == "    - Line ?: TRUE\n    - Line 7: FALSE - `a < b` (in L10i2) [from block: 7.1_8.2_L10i2]"


def test_versions_of_a_query(spark):
    texts = ["import cpp\nselect 1", "import cpp\nimport x\npredicate p(int i) { }\n import no\nselect 1", "select 1"]
    got = rows(spark, "version_diff", query_version=([(7, n, t) for n, t in enumerate(texts)], "file long, version long, text string"))
    assert got == {(7, 0, 3, 0, True, True), (7, 1, 0, 4, False, False)}


def test_first_definition_of_a_name(spark):
    asked = ([(1, "g", "a.c", "src/", 5), (2, "n::g", "b.c", "lib/", 5), (3, "h", "a.c", "x/", 5)], "site long, name string, base string, dir string, line long")
    defs = ([(9, "g", "n::g", "src/a.c", "a.c", 1, 9), (4, "g", "m::g", "z/b.c", "z.c", 1, 9), (7, "g", "n::g", "lib/a.c", "a.c", 70, 200)], "ordinal long, name string, qname string, file_path string, base string, start_line long, end_line long")
    assert rows(spark, "context_lookup", requested_symbol=asked, function_def=defs) == {(1, "g", "n::g", 1), (2, "n::g", "m::g", 0)}
    macros = ([(3, "g", "lib/x.c", "x.c", 1, "d3", "b3"), (5, "g", "src/x.c", "x.c", 1, "d5", "b5"), (6, "g", "src/sub/x.c", "x.c", 1, "d6", "b6"), (8, "h", "src/x.c", "x.c", 1, "d8", "b8")], "ordinal long, name string, use_file string, base string, use_line long, def_file string, body string")
    assert {r[:3] for r in rows(spark, "macro_same_directory", requested_symbol=asked, macro_use=macros)} == {(1, "g", "b5"), (3, "h", "b8")}
    sites = ([(1, 5, "g", "a.c"), (2, 1, "g", "a.c"), (3, 150, "g", "a.c"), (4, 70, "g", "a.c"), (5, 500, "g", "a.c"), (6, 1, "q", "a.c")], "site long, line long, name string, base string")
    assert {r[0]: r[2] for r in rows(spark, "point_in_body", use_site=sites, function_def=defs)} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_capped_debug_rows(spark):
    given = spark.createDataFrame([("unit", n) for n in range(5)] + [("context_unit", n) for n in range(5)], "type string, id long")
    assert sorted((r.type, r.id) for r in sinks.debug_rows(given, "type", ["id"], keep=2).collect()) == [("context_unit", n) for n in range(5)] + [("unit", 0), ("unit", 1)]
