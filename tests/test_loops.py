"""Loops: hand-made nests, programs against their own runs, discovery by hand, witnesses."""

import itertools
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.operators import graphs, loops, walks

EDGE = "fn long, src long, dst long, etype string"
NEST = [("0", "1", "UNCONDITIONAL"), ("1", "2", "TRUE"), ("2", "3", "TRUE"), ("3", "2", "UNCONDITIONAL"), ("2", "4", "FALSE"), ("4", "1", "UNCONDITIONAL"), ("1", "5", "FALSE")]


def acyclic(edges):
    after, left = defaultdict(set), {n for s, d, _ in edges for n in (s, d)}
    for s, d, kind in edges:
        if kind != loops.CYCLE:
            after[s].add(d)
    while ends := {n for n in left if not after[n] & left}:
        left -= ends
    return not left


def test_nest():
    got = set(loops.unrolled(NEST, [("1", "4"), ("2", "3")]))
    assert got == {
        ("0", "1", "UNCONDITIONAL"), ("1", "2", "TRUE"), ("1", "5", "FALSE"), ("2", "3", "TRUE"), ("2", "4", "FALSE"), ("3", "2_L2i2", "ITER2_START"),
        ("2_L2i2", "3_L2i2", "TRUE"), ("2_L2i2", "4", "FALSE"), ("3_L2i2", "4", "ITER2_EXIT"), ("4", "1_L1i2", "ITER2_START"),
        ("1_L1i2", "2_L1i2", "TRUE"), ("1_L1i2", "5", "FALSE"), ("2_L1i2", "3_L1i2", "TRUE"), ("2_L1i2", "4_L1i2", "FALSE"), ("3_L1i2", "2_L2i2_L1i2", "ITER2_START"),
        ("2_L2i2_L1i2", "3_L2i2_L1i2", "TRUE"), ("2_L2i2_L1i2", "4_L1i2", "FALSE"), ("3_L2i2_L1i2", "4_L1i2", "ITER2_EXIT"), ("4_L1i2", "5", "ITER2_EXIT"),
    }


def test_limits_leave_a_loop_as_it_is():
    got = set(loops.unrolled(NEST, [("1", "4"), ("2", "3")], max_body=2))  # the outer loop has more blocks
    assert ("4", "1", "CYCLE") in got and ("3", "2_L2i2", "ITER2_START") in got and acyclic(got)
    assert not any("_L" in s for s, _, _ in loops.unrolled(NEST, [("1", "4"), ("2", "3")], max_nesting=0))


def test_what_is_no_loop():
    forward = [("0", "1", "TRUE"), ("0", "2", "FALSE"), ("1", "2", "UNCONDITIONAL")]
    assert loops.unrolled([*forward, ("1", "1", "TRUE")], [("1", "1"), ("2", "0"), ("0", "2")]) == forward  # self-loop, no such edge


def test_two_entries_are_cut():
    got = loops.unrolled([("0", "1", "TRUE"), ("0", "2", "FALSE"), ("1", "2", "UNCONDITIONAL"), ("2", "1", "TRUE"), ("2", "3", "FALSE")], [("1", "2")])
    assert acyclic(got) and {(s, d) for s, d, _ in got} >= {("0", "1"), ("0", "2"), ("1", "2"), ("2", "3")}


def test_headers_as_text():
    """Block 10 comes before block 9 as text, so the outer loop is worked on first; its second run has the inner loop once."""
    nest = [("8", "9", "UNCONDITIONAL"), ("9", "10", "TRUE"), ("10", "11", "TRUE"), ("11", "10", "UNCONDITIONAL"), ("10", "12", "FALSE"), ("12", "9", "UNCONDITIONAL"), ("9", "13", "FALSE")]
    found = [("9", "12"), ("10", "11")]
    inner = lambda e: sum(s.startswith("11") for s in {s for s, _, _ in e})
    assert (inner(loops.unrolled(nest, found)), inner(loops.unrolled(nest, found, by_text=True))) == (4, 3)
    assert acyclic(loops.unrolled(nest, found, by_text=True))


# Programs: a list of statements, each a block, an if, a while or a do-while; every list ends with a block.
BLOCK = st.just("block")
LISTS = st.recursive(st.lists(BLOCK, max_size=1), lambda inner: st.lists(st.one_of(BLOCK, st.tuples(st.sampled_from(["if", "while", "do"]), inner)), max_size=2), max_leaves=4)


def compiled(program):
    """(edges, loops, runs): runs are all (blocks, branches) where each loop runs its body twice at most each time it is entered; after
    the second time a while loop is left without its condition, and a back edge counts for no branch."""
    numbers, edges, found = itertools.count(), [], []

    def statements(items):
        """(first block, last block, runs from one to the other)"""
        parts = [statement(x) for x in items] + [statement("block")]
        for a, b in itertools.pairwise(parts):
            for end, kind in a[1]:
                edges.append((end, b[0], kind))
        runs = [((), ())]
        for *_, own in parts:
            runs = [(x + y, p + q) for x, p in runs for y, q in own]
        return parts[0][0], parts[-1][1][0][0], runs

    def statement(x):
        if x == "block":
            n = next(numbers)
            return n, [(n, "UNCONDITIONAL")], [((n,), ())]
        kind, body = x
        if kind == "do":
            first, last, runs = statements(["block", *body])  # else an inner loop's header would be this one's too
            test = next(numbers)
            edges.extend([(last, test, "UNCONDITIONAL"), (test, first, "TRUE")])
            found.append((first, test))
            once = [(b + (test,), p + ((test, "FALSE"),)) for b, p in runs]
            return first, [(test, "FALSE")], once + [(b + (test,) + c, p + q) for b, p in runs for c, q in once]
        head = next(numbers)
        first, last, runs = statements(body)
        edges.append((head, first, "TRUE"))
        take, leave = ((head, "TRUE"),), ((head, "FALSE"),)
        skipped = [((head,), leave)]
        if kind == "if":
            return head, [(head, "FALSE"), (last, "UNCONDITIONAL")], skipped + [((head,) + b, take + p) for b, p in runs]
        edges.append((last, head, "UNCONDITIONAL"))
        found.append((head, last))
        once = [((head,) + b + (head,), take + p + leave) for b, p in runs]
        twice = [((head,) + b + (head,) + c, take + p + take + q) for b, p in runs for c, q in runs]
        return head, [(head, "FALSE")], skipped + once + twice

    first, last, runs = statements(program)
    return [(str(s), str(d), k) for s, d, k in edges], [(str(h), str(t)) for h, t in found], runs, str(first), str(last)


@settings(max_examples=200, deadline=None)
@given(LISTS)
def test_programs(program):
    edges, found, runs, first, last = compiled(program)
    got = loops.unrolled(edges, found, max_body=10**6, max_nesting=10)
    assert acyclic(got) and not any(k == loops.CYCLE for _, _, k in got)
    after = defaultdict(list)
    for s, d, k in got:
        after[s].append((d, k))
    seen, todo = set(), [(first, (int(first),), ())]
    while todo:
        x, path, taken = todo.pop()
        if not after[x]:
            assert graphs.base(x) == last
            seen.add((path, taken))
        todo += [(d, (*path, loops.number(d)), (*taken, (loops.number(x), k)) if k in ("TRUE", "FALSE") else taken) for d, k in after[x]]
    assert len(seen) < 50_000 and seen == set(runs)


def test_discovery(spark):
    """A while loop (1, 2), a do-while loop (4) and a loop by goto (6 to 5, no exit of its own) that only the component shows."""
    edges = spark.createDataFrame([(1, 0, 1, "UNCONDITIONAL"), (1, 1, 2, "TRUE"), (1, 2, 1, "UNCONDITIONAL"), (1, 1, 3, "FALSE"), (1, 3, 4, "UNCONDITIONAL"), (1, 4, 3, "TRUE"), (1, 4, 5, "FALSE"), (1, 5, 6, "UNCONDITIONAL"), (1, 6, 5, "TRUE"), (1, 6, 7, "TRUE")], EDGE)
    blocks = spark.createDataFrame([(1, n, f"{10 * n}.1_{10 * n + 5}.9", 10 * n, 1, 10 * n + 5, 9) for n in range(8)], "fn long, block long, bb_id string, sl long, sc long, el long, ec long")
    source = spark.createDataFrame([(1, 10, 29, 12)], "fn long, loop_line long, end_line long, cond_line long")
    got = loops.find_loops(edges, blocks, source)
    rows = lambda n: {(r["head"], r.tail, r.exit_block) for r in got[n].collect()}
    assert rows("loop_exact") == {(1, 2, 3)} and rows("loop_do_while") == {(3, 4, 5), (5, 6, 7)}
    assert rows("loop_back_edge") == {(3, 4, 5)} and rows("loop_component") == {(1, 2, None), (3, 4, None), (5, 6, None)}
    assert {(r["head"], r.tail, r.exit_block, r.found_by) for r in got["loop_union"].collect()} == {(1, 2, 3, "1 source"), (3, 4, 5, "2 back edge"), (5, 6, None, "3 component")}
    unbound = spark.createDataFrame([(1, 9, 29, None)], source.schema)  # a loop without a condition: a block that starts within two lines
    assert {(r["head"], r.tail) for r in loops.find_loops(edges, blocks, unbound)["loop_exact"].collect()} == {(1, 2)}


def test_first_runs_keep_their_edges(spark):
    edges = spark.createDataFrame([(7, int(s), int(d), k) for s, d, k in NEST], EDGE)
    found = spark.createDataFrame([(7, 1, 4), (7, 2, 3), (8, 0, 1)], "fn long, head long, tail long")
    got = {(str(r.src), str(r.dst), r.etype) for r in loops.first_runs(loops.unroll(edges, found)).collect()}
    assert got == {(s, d, "BACK" if int(s) > int(d) else k) for s, d, k in NEST}


def test_witnesses(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 2, 1), (1, 3, 4), (1, 5, 6), (1, 6, 5), (1, 4, 5), (2, 0, 1)]
    got = loops.cycles(spark.createDataFrame([(*r, "TRUE") for r in rows], EDGE)).collect()
    assert {(r.fn, r.component, r.length, r.cycle) for r in got} == {(1, 1, 2, "1>2>1"), (1, 5, 2, "5>6>5")}


@pytest.mark.parametrize("rule", ["direct", "clones", "entries"])
def test_rules_of_the_search(spark, rule):
    if rule == "direct":
        edges, own = [(1, "0", "1", "TRUE")], None
        want = {("1", "0>1", "direct"), ("0", "0", "direct")}
    elif rule == "clones":  # block 3 itself can't be reached, its clone can
        edges, own = [(1, "0", "1", "TRUE"), (1, "1", "3_L1i2", "FALSE"), (1, "3", "2", "TRUE"), (1, "2", "3", "TRUE")], [(1, 0)]
        want = {("0", "0", "direct"), ("1", "0>1", "direct"), ("3", "0>1>3_L1i2", "clones")}
    else:  # the function begins at 1; block 0.0_ is none
        edges, own = [(1, "0", "1", "TRUE"), (1, "1", "2", "FALSE"), (1, "0.0_0.0", "2", "TRUE")], [(1, 1)]
        want = {("0", "0", ""), ("1", "1", "direct"), ("2", "1>2", "direct")} - {("0", "0", "")}
    entries = spark.createDataFrame(own, "fn long, block long") if own else None
    got = walks.enumerate_paths(spark.createDataFrame(edges, "fn long, src string, dst string, etype string"), entries=entries).collect()
    assert {(str(r.target), r.path, r.rule) for r in got} == want


def test_walks_share_their_steps(spark):
    edges = spark.createDataFrame([(1, str(3 * k + a), str(3 * k + b), "TRUE") for k in range(9) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))], "fn long, src string, dst string, etype string")
    got = walks.enumerate_paths(edges, 27, max_calls=40).collect()
    assert 0 < len(got) < 40 and all(r.truncated for r in got)
