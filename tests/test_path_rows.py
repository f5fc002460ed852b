"""Paths in rows: Spark's own statements against the plain ones on odd paths, and how often a path's points are exchanged."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom import catalog  # noqa: F401
from pathloom.plans import core, round_trips

FLOW = "path_id long, pos long, fn string, file string, line long, var string, code string, sc long, ec long"
CALL = "caller string, caller_file string, line long, callee string, callee_file string"


@pytest.fixture(scope="module")
def tables(spark):
    rng, flow = random.Random(5), []
    for path in range(150):
        for pos in range(rng.choice((1, 2, 3, 4, 6, 9, 14))):
            fn = rng.choice("abcd")
            place = None if rng.random() < 0.1 else rng.randrange(4)
            flow.append((None if path == 149 else path, pos, fn, rng.choice(("x.c", "y.c")), rng.randrange(4), rng.choice(("v", "w", "", None)), fn if rng.random() < 0.9 else None, place, place))
    calls = [(a, f, line, b, g) for a in "abcd" for b in "abcd" for f in ("x.c", "y.c") for g in ("x.c", "y.c") for line in range(4) if rng.random() < 0.4]
    return {"flow_point": spark.createDataFrame(flow, FLOW), "call_edge": spark.createDataFrame(calls, CALL)}


def rows(spark, name, tables):
    core.forget(spark)
    got = core.run(spark, name, tables)
    return sorted(map(str, (r.asDict() for r in got.collect())))


@pytest.mark.parametrize("name", ["segment_edge", "path_unit", "connection_edge", "point_set", "merged_constraint", "merged_constraint_text", "path_result"])
def test_same_rows(spark, tables, name, monkeypatch):
    got = rows(spark, name, tables)
    monkeypatch.setattr(core, "SPARK", {})
    assert got and got == rows(spark, name, tables)
    core.forget(spark)


@pytest.mark.parametrize("name,most", [("path_unit", 1), ("path_flow", 1), ("constraint_order", 2), ("constraint_prompt", 3)])
def test_a_path_is_exchanged_once(spark, tables, name, most):
    """One exchange by path, one by unit, one for what a prompt says of a unit; nothing is written on the way."""
    core.forget(spark)
    plan = core.run(spark, name, tables | {"call_edge": F.broadcast(tables["call_edge"])})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most and not core._written


def test_points_of_lineitem_keep_their_partitions(spark):
    """Points and steps of paths have the same exchange."""
    plan = catalog.queries()["step"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tables_that_stand_in_are_read(spark):
    """A table given for a plan that Spark's own statement passes over is read all the same."""
    keys = spark.createDataFrame([(1, "b", "i", "f")], "path_id long, b_key string, i_key string, f_key string")
    assert [r.flow for r in core.run(spark, "path_flow", {"decomposition": keys}).collect()] == ["b > i > f"]
    edges = {r.kind: r.n for r in core.run(spark, "connection_edge", {"decomposition": keys}).collect()}
    assert edges == {"B-I": 1, "I-F": 1}


def test_texts_of_conversations_stay_put(spark, tmp_path):
    """Two paths share a conversation, one has another and one has none; files are compressed, and an object holds its turns in order."""
    whose = spark.createDataFrame([(1, "forward", "u", 7), (2, "forward", "u", 7), (3, "backward", "w", 8), (4, "backward", "x", 9)], "path_id long, phase string, unit_key string, conv_id long")
    turns = spark.createDataFrame([(7, 1, "b", "two"), (7, 0, "a", "one"), (8, None, None, None), (5, 0, "a", "x")], "conv_id long, turn int, role string, text string")
    round_trips.write_conversations(whose, turns, f"{tmp_path}/c", ["path_id", "phase", "unit_key"], "phase")
    got = spark.read.json(f"{tmp_path}/c")
    assert {(r.path_id, r.phase, r.unit_key, tuple((t.turn, t.text) for t in r.conversation_history)) for r in got.collect()} == {(1, "forward", "u", ((0, "one"), (1, "two"))), (2, "forward", "u", ((0, "one"), (1, "two"))), (3, "backward", "w", ((None, None),))}
    assert all(f.endswith(".json.gz") for f in got.inputFiles())


def test_one_conversation_of_many_is_stored_about_once(spark, tmp_path):
    """20 conversations of 4,000 random letters, each of 100 paths by turns: compression finds the text of the path before."""
    rng = random.Random(3)
    turns = spark.createDataFrame([(c, 0, "a", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4000))) for c in range(20)], "conv_id long, turn int, role string, text string")
    whose = spark.range(2000).selectExpr("id as path_id", "'forward' as phase", "'u' as unit_key", "id % 20 as conv_id").coalesce(1)
    round_trips.write_conversations(whose, turns, f"{tmp_path}/c", ["path_id", "phase", "unit_key"], "phase")
    assert spark.read.json(f"{tmp_path}/c").count() == 2000
    assert sum(f.stat().st_size for f in (tmp_path / "c").rglob("*.json.gz")) < 1_000_000


def test_conditions_on_keys_stay_above_the_rules(spark, tables):
    plan = core.run(spark, "unit_contexts", tables)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
