"""Stored result files of two queries, scored again: by hand, by folder, and so that what isn't scored again stays."""

import json

from pathloom.operators import rescore


def document(*threads):
    place = lambda p: {"location": {"physicalLocation": {"artifactLocation": {"uri": p[0]}, "region": {"startLine": p[1]}} if p[1] is not None else {"artifactLocation": {"uri": p[0]}}}}
    return json.dumps({"runs": [{"results": []}, {"results": [{"ruleId": "r", "codeFlows": [{"threadFlows": [{"locations": [place(p) for p in t]} for t in threads]}]}]}]})


def put(root, folder, stage, text, name="a.sarif"):
    there = root / folder / stage / "query_results"
    there.mkdir(parents=True, exist_ok=True)
    (there / name).write_text(text)


SUITE = "/w/juliet-test-suite-c/testcases/CWE20_x/"


def suite(spark, tmp_path):
    table = tmp_path / "suite" / "cwe20_functions.csv"
    table.parent.mkdir(exist_ok=True)
    rows = [("old_bad", SUITE + "s1/a.c", 10, 20), ("the_bad", SUITE + "s1/a.c", 15, 20), ("goodG2B", SUITE + "s1/a.c", 30, 31), ("helper", SUITE + "s1/a.c", 42, ""), ("other_bad", "/elsewhere/b.c", 1, 2)]
    table.write_text("col0,col1,col2,col3\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return rescore.suites(spark, str(tmp_path / "suite"))


def test_rescore(spark, tmp_path):
    root, target, functions = tmp_path / "run", str(tmp_path / "scored"), suite(spark, tmp_path)
    # 25 is nearer to 20 than to 30 only by the order below first; 36 lies five behind 31; 37 beyond
    put(root, "CWE-020_q", "initial", document([("s1/a.c", 12), ("s1/a.c", 16)], [("s1/a.c", 16), (SUITE + "s1/a.c", 36), ("s1/main.cpp", 16), ("lib/a.c", 16)], []))
    put(root, "CWE-020_q", "iteration_2", document([("s1/a.c", 25)]))
    put(root, "CWE-020_q", "iteration_10", document([("s1/a.c", 36), ("s1/a.c", 42), ("s1/a.c", 60), ("s9/bad.c", None)]))
    put(root, "CWE-020_p", "initial", "no json")
    put(root, "CWE-021_q", "initial", document([("s1/good.c", 3)]))
    put(root, "CWE-020_q", "initial/notes", document([("s1/a.c", 30)]), "x.txt")
    rescore.rescore(spark, str(root), functions, target)
    hits = {(r.cwe, r.query, r.iteration, r.kind, r.file, r.function, r.alerts) for r in spark.read.parquet(f"{target}/hits").collect()}
    assert hits == {
        (20, "q", 0, "bad", "s1/a.c", "old_bad", 1), (20, "q", 0, "bad", "s1/a.c", "the_bad", 2), (20, "q", 0, "good", SUITE + "s1/a.c", "goodG2B", 1), (20, "q", 2, "good", "s1/a.c", "goodG2B", 1), (20, "q", 10, "good", "s1/a.c", "goodG2B", 1),
        (20, "q", 10, "unknown", "s1/a.c", "helper", 1), (20, "q", 10, "unknown", "s1/a.c", "unknown", 1), (20, "q", 10, "bad", "s9/bad.c", "unknown", 1), (21, "q", 0, "good", "s1/good.c", "unknown", 1),
    }
    rows = {(r.cwe, r.query, r.iteration): r for r in spark.read.parquet(f"{target}/results").collect()}
    assert set(rows) == {(20, "q", 0), (20, "q", 2), (20, "q", 10), (20, "p", 0), (21, "q", 0)}
    first = rows[20, "q", 0]
    # other_bad lies outside the suite's path
    assert (first.true_positive_count, first.false_positive_count, first.total_alerts, first.total_bad_functions, first.total_good_functions) == (2, 1, 3, 2, 1)
    assert (first.recall, first.precision, first.f1_score, first.false_positive_rate, first.result_count) == (100.0, 66.67, 80.0, 100.0, 2)
    assert (rows[20, "p", 0].total_alerts, rows[20, "p", 0].unique_functions_with_alerts, rows[20, "p", 0].precision) == (0, 0, 0.0)
    assert (rows[21, "q", 0].total_good_functions, rows[21, "q", 0].false_positive_rate) == (0, 0.0)
    reports = {(r.cwe, r.query): r for r in spark.read.parquet(f"{target}/reports").collect()}
    q = reports[20, "q"]
    assert (q.last_iteration, q.initial_true_positive, q.final_true_positive, q.true_positive_improvement, q.true_positive_improvement_percentage, q.false_positive_improvement_percentage) == (10, 2, 1, -1, -50.0, 0.0)
    assert reports[20, "p"].final_true_positive is None and reports[20, "p"].true_positive_improvement is None


def test_scored_again(spark, tmp_path):
    """Another result of one query replaces its own rows only; columns of a stored log stay, its error goes."""
    root, target, functions = tmp_path / "run", str(tmp_path / "scored"), suite(spark, tmp_path)
    log = spark.createDataFrame([(20, "q", 0, "timed out", "m1", 7), (20, "p", 0, None, "m2", 8)], "cwe long, query string, iteration long, error string, model string, result_count long")
    log.write.partitionBy(*rescore.KEY).parquet(f"{target}/results")
    for query in "qp":
        put(root, f"CWE-020_{query}", "initial", document([("s1/a.c", 16)]))
    for _ in range(2):  # the second time changes nothing
        rescore.rescore(spark, str(root), functions, target)
        assert {(r.query, r.true_positive_count, r.result_count, r.model) for r in spark.read.parquet(f"{target}/results").collect()} == {("q", 1, 1, "m1"), ("p", 1, 1, "m2")}
    for query in "qp":
        put(root, f"CWE-020_{query}", "initial", document([("s1/a.c", 30)]))
    rescore.rescore(spark, str(root), functions, target, query="q")
    assert {(r.query, r.function) for r in spark.read.parquet(f"{target}/hits").collect()} == {("q", "goodG2B"), ("p", "the_bad")}
    after = spark.read.parquet(f"{target}/results")
    assert "error" not in after.columns and {(r.query, r.result_count, r.model) for r in after.collect()} == {("q", 0, "m1"), ("p", 1, "m2")}
