"""Builds over a call graph and the choice of blocks, by hand."""

from pathloom import catalog  # noqa: F401  (registers the plans)
from pathloom.operators import builds
from pathloom.plans.core import run


def test_covered(spark):
    """a calls b and c, b calls d, d calls a (a cycle) and e; z isn't called; null ends nowhere."""
    calls = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("d", "e"), ("z", "z"), ("a", None)], "caller string, callee string")
    entries = spark.createDataFrame([("a",), ("a",), ("z",), ("q",), (None,)], "function string")
    got = lambda n: {(r.entry, r.function, r.depth) for r in builds.covered(calls, entries, n).collect()}
    assert got(0) == {("a", "a", 0), ("z", "z", 0), ("q", "q", 0)}
    assert got(2) == got(0) | {("a", "b", 1), ("a", "c", 1), ("a", "d", 2)}
    assert got(9) == got(2) | {("a", "e", 3)} and len(builds.covered(calls, entries, 9).collect()) == 7


def test_graph_coverage(spark):
    found = spark.createDataFrame([("a", "a", 0), ("a", "b", 1), ("a", "none", 1)], "entry string, function string, depth long")
    blocks = spark.createDataFrame([("a", 0, "0.0_3.1"), ("a", 1, "1.1_2.9"), ("a", 2, "20.0_3.9"), ("b", 1, "1.1_1.2")], "function string, block long, bb_id string")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 0), ("b", 1, 1), ("b", 1, 7)], "function string, src long, dst long")
    assert {tuple(r) for r in builds.graph_coverage(found, blocks, edges).collect()} == {("a", 0, 1, 2, 1), ("a", 1, 2, 1, 1)}


def test_level(spark):
    rows = [(1, 0, "5.1_6.1", 2), (1, 0, "5.1_6.1_L4i2", 2), (1, 1, "7.1_9.1_L4i2", 3), (1, 1, "7.1_7.9_L4i2", 1)]  # only the second run has both points
    rows += [(2, 0, "5.1_6.1", 2), (2, 1, "7.1_9.1_L4i2", 3), (2, 1, "7.1_9.1_L4i2_L2i2", 3)]  # no run has both
    rows += [(3, 0, "5.1_8.1", 4), (3, 0, "5.1_6.1", 2), (3, 0, "5.1_6.1_L4i2", 1)]  # one point
    got = run(spark, "block_by_level", {"point_candidate": spark.createDataFrame(rows, "question long, point long, block_id string, size long")}).collect()
    assert {(r.question, r.point, r.block_id, r.whole) for r in got} == {
        (1, 0, "5.1_6.1_L4i2", True), (1, 1, "7.1_7.9_L4i2", True), (2, 0, "5.1_6.1", False), (2, 1, "7.1_9.1_L4i2", False), (3, 0, "5.1_6.1", True)}
