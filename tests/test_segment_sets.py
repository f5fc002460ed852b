"""Questions of sets of points in their rows, and which graphs and how many exchanges they take."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import catalog
from pathloom.operators import loops, segment_constraints

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sets_ask_as_their_points_do(spark):
    """Lines 7 (a parameter) and 0 (the declaration) don't ask, 9 lies in no block; two lines of a file may be one of the graph."""
    places = spark.createDataFrame([("f", n, 1, n % 50, n == 7, 0) for n in (0, 7, 9, 12, 21, 22, 33, 62)], "function_id string, line long, fn long, graph_line long, is_parameter boolean, start_line long")
    blocks = spark.createDataFrame([(1, 1, 10, 19), (1, 2, 20, 29), (1, 3, 20, 39), (1, 4, 40, 12)], "fn long, block long, sl long, el long")
    texts = ["12:1:2", "33:1:2,12:1:2", "12:1:2,62:1:2,21:0:0", "12:9:9,62:1:2,22:0:0", "0:1:2,7:1:2,9:1:2", "9:1:1,33:0:1", "99:1:1"]
    sets = spark.createDataFrame([("backward", "u", "f", t) for t in texts] + [("forward", "v", "f", texts[1]), ("forward", "v", "g", texts[1]), ("forward", "v", "f", "")], "segment string, unit_key string, function_id string, points string")
    got = segment_constraints.set_questions(sets, segment_constraints.located(places, blocks))
    points = sets.where("points <> ''").withColumn("p", F.explode(F.split("points", ","))).selectExpr("segment", "unit_key", "function_id", "points", "cast(split(p, ':')[0] as long) as own", "cast(split(p, ':')[1] as long) as sc", "cast(split(p, ':')[2] as long) as ec")
    points = points.join(places.withColumnRenamed("line", "own"), ["function_id", "own"]).withColumnRenamed("graph_line", "line")
    want = segment_constraints.variant_questions(points, blocks)
    rows = {(r.segment, r.unit_key, r.points, r.target, tuple(map(int, filter(None, r.ask.split(",")))), r.several) for r in got.collect()}
    assert rows == {(r.segment, r.unit_key, r.points, r.target, tuple(r.required), r.several) for r in want.collect()} and len(rows) == 6


@pytest.mark.parametrize("in_order", [True, False])
def test_paths_that_pass_blocks(in_order):
    paths = [tuple(p) + (9,) for n in range(4) for p in itertools.permutations((1, 2, 3), n)] + [(1, 2, 1, 9), (9, 1, 9)]
    known = segment_constraints.Answers([(">".join(map(str, p)), "") for p in paths], {}, in_order)
    for n in range(4):
        for asked in itertools.product((1, 2, 3, 7), repeat=n):
            met = {paths[i] for i in np.asarray(known.met([*asked, 9] if in_order else list(asked)))}
            inside = lambda p: (rest := iter(p[:-1])) and all(b in rest for b in asked)
            assert met == {p for p in paths if (inside(p) if in_order else set(asked) <= set(p))}


def test_only_their_graphs_are_worked_on(spark):
    some = spark.createDataFrame([(4,), (28,)], "fn long")
    got = loops.loops_within(spark, SF, some)
    every = loops.loops_of(spark, SF, "bb_edge", "block", "loop_union")
    rows = lambda df: sorted(map(str, df.where("fn in (4, 28)").collect()))
    assert [rows(df.select(sorted(df.columns))) for df in (got[0], got[1], got[3])] == [rows(every[n].select(sorted(every[n].columns))) for n in ("bb_edge", "block", "loop_union")]
    assert all(df.where("fn not in (4, 28)").isEmpty() for df in got)


@pytest.mark.parametrize("name", ["variant_constraint_rows", "merged_path_constraints"])
def test_sets_are_exchanged_by_path_and_by_unit(spark, name):
    """No row of a set's answers is dealt out, and none is written."""
    assert exchanges(catalog.queries()[name](spark, SF)) <= 2
