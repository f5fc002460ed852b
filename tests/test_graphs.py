"""Graphs of many functions worked on at once, of unlike sizes, against a search by hand; joins of loops send nothing whole."""

import random

from pathloom import catalog  # noqa: F401
from pathloom.operators import graphs, loops


def reached(after, start, without=None):
    seen, todo = set(), [start]
    while todo:
        for d in after.get(todo.pop(), ()):
            if d not in seen and d != without:
                seen.add(d)
                todo.append(d)
    return seen


def test_graphs_of_unlike_sizes(spark):
    """Two blocks to some more than 64; numbers of blocks with gaps."""
    pick, rows = random.Random(5), []
    for fn, (n, m) in enumerate([(2, 1), (2, 2), (5, 9), (12, 16), (12, 30), (40, 60), (90, 110), (200, 230)]):
        rows += [(fn, s * 3 + 7, d * 3 + 7, "TRUE") for s, d in {(pick.randrange(n), pick.randrange(n)) for _ in range(m)} if s != d]
    edges = spark.createDataFrame(rows, "fn long, src long, dst long, etype string")
    closure, parts, doms, met = set(), set(), set(), {}
    for fn in {r[0] for r in rows}:
        after = {}
        for _, s, d, _ in (r for r in rows if r[0] == fn):
            after.setdefault(s, set()).add(d)
        blocks = sorted({*after, *(d for v in after.values() for d in v)})
        ahead = {b: reached(after, b) for b in blocks}
        closure |= {(fn, b, d) for b in blocks for d in ahead[b]}
        parts |= {(fn, b, min([b] + [x for x in ahead[b] if b in ahead[x]])) for b in blocks}
        nodes = ahead[blocks[0]] | {blocks[0]}
        met[fn] = {b: {d for d in nodes if d in (b, blocks[0]) or b not in reached(after, blocks[0], d) | {blocks[0]}} for b in nodes}
        doms |= {(fn, b, d, d != b and met[fn][b] - {b} == met[fn][d]) for b in nodes for d in met[fn][b]}
    assert {tuple(r) for r in graphs.closure(edges).collect()} == closure
    assert {tuple(r) for r in graphs.strong_components(edges).collect()} == parts
    assert {tuple(r) for r in graphs.dominators(edges).collect()} == doms
    backs = {(fn, d, s) for fn, s, d, _ in rows} & closure
    assert {tuple(r) for r in graphs.edges_on_cycles(edges).collect()} == backs


def test_no_table_of_loops_is_broadcast(spark):
    """Files of a few bytes a row hide what the rows take: no join on functions goes by the files' sizes."""
    found = loops.loops_of(spark, "/root/testdata/sf0.001", *loops.TEXTS)
    for name in ("loop_exact", "loop_do_while", "loop_component", "loop_union"):
        plan = found[name]._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
