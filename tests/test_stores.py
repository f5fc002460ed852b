"""Upserted tables under retries and broken writes, and the two phases of an assessment, by hand."""

import os

import pandas as pd

from pathloom.operators import assess
from pathloom.sources.stores import Store

SCHEMA = "k string, j int, v string, n long"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def state(store):
    return {tuple(r) for r in store.read().collect()}


def test_upserts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", SCHEMA, ["k", "j"])
    assert state(store) == set() and store.compact() == 0
    store.upsert(rows(spark, ("a", 1, "x", 1), ("a", 1, "y", 3), ("a", 1, "z", 2), ("b", None, "p", 1), (None, None, "q", 1)), "n")
    assert state(store) == {("a", 1, "y", 3), ("b", None, "p", 1), (None, None, "q", 1)}
    store.upsert(rows(spark, ("b", None, None, 9), ("c", 1, "new", 1)))
    assert state(store) == {("a", 1, "y", 3), ("b", None, None, 9), (None, None, "q", 1), ("c", 1, "new", 1)}
    store.remove(rows(spark, (None, None, "", 0), ("nobody", 1, "", 0)))
    store.clear("n >= 9")
    assert state(store) == {("a", 1, "y", 3), ("c", 1, "new", 1)}
    store.upsert(rows(spark, ("b", None, "again", 1)))
    assert state(store) == {("a", 1, "y", 3), ("c", 1, "new", 1), ("b", None, "again", 1)}


def test_a_retry_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", SCHEMA, ["k", "j"])
    v = store.upsert(rows(spark, ("a", 1, "x", 1)))
    for _ in range(2):
        assert store.upsert(rows(spark, ("a", 1, "y", 1)), version=v + 1) == v + 1
    assert state(store) == {("a", 1, "y", 1)} and [n for n, _ in store.versions()] == [1, 2]


def test_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", SCHEMA, ["k", "j"])
    store.upsert(rows(spark, ("a", 1, "x", 1), ("b", 1, "x", 1)))
    store.clear("k = 'b'")
    before = state(store)
    assert store.compact() == 2 and state(store) == before == {("a", 1, "x", 1)}
    store.upsert(rows(spark, ("c", 1, "x", 1)))
    store.drop_history()
    assert store.versions() == [(2, "snapshot"), (3, "log")] and state(store) == before | {("c", 1, "x", 1)}
    broken = store._place(4, "snapshot").removeprefix("file://")
    os.makedirs(broken)  # a writer died here
    assert state(store) == before | {("c", 1, "x", 1)} and store.next_version() == 4


def test_two_phases(spark, monkeypatch):
    def strict(units: pd.DataFrame) -> pd.DataFrame:
        """Says what it was asked; an unknown end counts as none."""
        said = [f"{k}:{b}:{f}" for k, b, f in zip(units["unit_key"], units["backward_fp"], units["forward_fp"], strict=True)]
        return pd.DataFrame({"fp": units["unit_key"].isin(["b1"]), "level": said})

    monkeypatch.setitem(assess.ASSESSORS, "strict", strict)
    units = spark.createDataFrame([("backward", "b1", 3), ("backward", "b2", 1), ("forward", "f1", 1), ("intermediate", "m", 2), ("intermediate", "k", 1)], "segment string, unit_key string, usage_count long")
    contexts = spark.createDataFrame([("m", "b1", "f1"), ("m", "b2", "none"), ("k", "b2", "f1")], "unit_key string, b_key string, f_key string")
    cached = spark.createDataFrame([("backward", "b2", "none", "none", True, "cached"), ("intermediate", "k", "b2", "f1", False, "cached")], assess.RESULT)
    got = {tuple(r) for r in assess.assess(units, contexts, "strict", cached).collect()}
    assert got == {
        ("backward", "b1", "none", "none", True, "b1:None:None", 1), ("forward", "f1", "none", "none", False, "f1:None:None", 1),
        ("intermediate", "m", "b1", "f1", False, "m:True:False", 2), ("intermediate", "m", "b2", "none", False, "m:True:None", 2),
        ("backward", "b2", "none", "none", True, "cached", 0), ("intermediate", "k", "b2", "f1", False, "cached", 0)}
    assert len(assess.assess(units, contexts, "strict").collect()) == 6 and assess.assess(units.where("false"), contexts, "strict").collect() == []
