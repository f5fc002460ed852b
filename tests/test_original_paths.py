"""All paths of graphs as they are, against a recursion; and what the query on their branches sends on."""

import random
import re

import numpy as np

from pathloom import catalog  # noqa: F401
from pathloom.operators import graphs, loops, walks

SF = "/root/testdata/sf0.001"
EDGE = "fn long, src long, dst long, etype string"
#: 0 leads to 60 at once and by a way of 61 blocks; 2 and 5 lead to each other with nothing before; 7 leads to itself; nothing leads to 30 and 31 from outside.
GRAPHS = [(1, 0, 60, "TRUE"), *((1, i, i + 1, "FALSE" if i == 0 else "UNCONDITIONAL") for i in range(60)), (2, 5, 2, "TRUE"), (2, 2, 5, "FALSE"), (3, 7, 7, "TRUE"), (3, 7, 9, "FALSE"), (3, 20, 7, "TRUE"), (3, 30, 31, "TRUE"), (3, 31, 30, "TRUE"), (3, 20, -4, "FALSE")]
PICK = random.Random(3)
GRAPHS += [(fn, s * 3, d * 3, PICK.choice(["TRUE", "FALSE", "UNCONDITIONAL"])) for fn in range(10, 60) for s, d in sorted({(PICK.randrange(fn % 5 + 3), PICK.randrange(fn % 5 + 3)) for _ in range(fn % 17 + 2)})]


def by_recursion(edges):
    """(target, path, branches) of one function, backward as the SQL goes."""
    before, blocks = {}, sorted({b for s, d, _ in edges for b in (s, d)})
    for s, d, kind in edges:
        before.setdefault(d, []).append((s, kind))
    begins = {b for b in blocks if b not in before} or {blocks[0]}

    def back(block, path, taken):
        if block in begins:
            yield path, taken
            return
        for s, kind in before.get(block, ()):
            if s not in path:
                yield from back(s, (s, *path), taken if kind == "UNCONDITIONAL" else ((s, kind), *taken))

    return [(b, *found) for b in blocks for found in back(b, (b,), ())]


def wanted():
    paths, kinds = set(), set()
    for fn in {g[0] for g in GRAPHS}:
        found = by_recursion([g[1:] for g in GRAPHS if g[0] == fn])
        paths |= {(fn, t, ">".join(map(str, p)), ",".join(f"{b}:{k}" for b, k in taken)) for t, p, taken in found}
        for t in {x[0] for x in found}:
            mine = [set(taken) for target, _, taken in found if target == t]
            every = set().union(*mine)
            for b, k in every:
                n = sum((b, k) in m for m in mine)
                kinds.add((fn, t, b, k, n, len(mine), "dominator" if n == len(mine) else "must_take" if sum(x == b for x, _ in every) == 1 else "optional"))
    return paths, kinds


def test_original_paths_and_constraints(spark):
    edges, (paths, kinds) = spark.createDataFrame(GRAPHS, EDGE), wanted()
    got = [tuple(r) for r in walks.original_paths(edges).collect()]
    assert len(got) == len(paths) and set(got) == paths and {x[2].count(">") for x in got if x[:2] == (1, 60)} == {1, 60}
    got = [tuple(r) for r in walks.original_constraints(edges).collect()]
    assert len(got) == len(kinds) and set(got) == kinds and {k[-1] for k in kinds} == {"dominator", "must_take", "optional"}


def test_constraints_counted_where_walked(spark):
    """As many as classified from the paths, with clones, caps and an edge of two kinds; an edge of no function counts nowhere."""
    edges = spark.createDataFrame([*GRAPHS, (10, 0, 3, "FALSE"), (10, 0, 3, "TRUE"), (None, 1, 2, "TRUE")], EDGE)
    unrolled = loops.unroll(edges, edges.where("src > dst").selectExpr("fn", "dst as head", "src as tail"))
    for graph, caps in ((unrolled, {}), (unrolled, {"max_paths": 3, "max_calls": 40}), (edges, {"max_paths": None, "max_calls": None})):
        want = [tuple(r) for r in walks.classify_constraints(walks.enumerate_paths(graph, **caps)).collect()]
        got = [tuple(r) for r in walks.enumerate_constraints(graph, **caps).collect()]
        assert len(got) == len(want) and set(got) == set(want) and {k[-1] for k in want} == {"dominator", "must_take", "optional"}


def test_pieces_hold_all_paths(monkeypatch):
    """A whole graph of 6 blocks and an entry, walked 1 path at a time and 4,000: as many paths, and no more at once than asked for."""
    edge = np.ones((2, 7, 7), bool)
    edge[:, :, 0] = False
    for chunk in (1, 98, 1 << 21):
        monkeypatch.setattr(graphs, "CHUNK", chunk)
        pieces = list(walks.forward(np.ones((2, 7), bool), edge))
        found = [(int(f), *map(int, p)) for fs, ps in pieces for f, p in zip(fs, ps, strict=True)]
        assert len(found) == len(set(found)) == 2 * (1 + 6 + 30 + 120 + 360 + 720 + 720) and max(len(f) for f, _ in pieces) <= max(1, chunk // 49)


def test_no_path_leaves_its_task(spark):
    """The edges move, paths don't: no rows are made of paths, nothing is counted or joined behind the walk."""
    for query in (walks.cfg_original_constraints, walks.cfg_constraints):
        plan = query(spark, SF)._jdf.queryExecution().sparkPlan().toString()
        behind = plan.partition("MapInArrow")[0]
        assert "MapInArrow" in plan and not re.search("Generate|Aggregate|Join|Window|Exchange", behind)
