"""Loops of control-flow graphs: how they are found, a witness for each cycle, and their unrolling to two runs.

Loops are found in three ways.  Loops of the source know their lines, and reachability on the graph tells header, exit
and back edge; an edge that leads back to an earlier line is the back edge of a do-while loop; and every edge into the
entry of a cyclic component is one.  Their union has each (header, back edge) once, under the first way that found it.

A graph belongs to one function and is small; unrolling works on one at a time.  Everything else is joins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import compile_sql, frame, kept, run, shared
from . import graphs

#: Loops with more blocks, or with blocks that are clones of clones this many times over, stay as they are.
MAX_BODY, MAX_NESTING = 50, 3
#: The edge from the first run into the second, the one that leaves after it, and one that would still close a cycle.
START, EXIT, CYCLE = "ITER2_START", "ITER2_EXIT", "CYCLE"

# The header is the least block (as text) with the loop's condition, or without one the least that starts within two lines
# of it; the exit is the least successor that doesn't lead straight back; the back edge starts at the block of the loop's
# lines that ends first.
LOOP_EXACT = """
select h.fn, h.loop_line, h.head, x.exit_block, t.tail
from (select fn, loop_line, min_by(head, bb_id) as head from turn group by fn, loop_line) h
join (select c.fn, c.loop_line, min_by(e.dst, x.bb_id || '@' || c.bb_id) as exit_block
      from (select distinct fn, loop_line, head, bb_id from turn) c join bb_edge e on e.fn = c.fn and e.src = c.head join block x on x.fn = e.fn and x.block = e.dst
      left join bb_edge k on k.fn = e.fn and k.src = e.dst and k.dst = c.head where k.fn is null group by c.fn, c.loop_line) x on x.fn = h.fn and x.loop_line = h.loop_line
join (select fn, loop_line, tail from (
      select c.fn, c.loop_line, c.tail, row_number() over (partition by c.fn, c.loop_line order by b.el, b.bb_id, c.tail) as k
      from (select distinct fn, loop_line, end_line, tail from turn) c join block b on b.fn = c.fn and b.block = c.tail where b.sl >= c.loop_line and b.el <= c.end_line) y where k = 1) t on t.fn = h.fn and t.loop_line = h.loop_line"""
TURN = """
select c.fn, c.loop_line, c.end_line, c.head, c.bb_id, e.src as tail
from (select l.fn, l.loop_line, l.end_line, b.block as head, b.bb_id from source_loop l join block b on b.fn = l.fn
      where case when l.cond_line is not null then l.cond_line between b.sl and b.el else b.sl between l.loop_line and l.loop_line + 2 end) c
join bb_edge e on e.fn = c.fn and e.dst = c.head join reach r on r.fn = c.fn and r.src = c.head and r.dst = e.src"""
LOOP_DO_WHILE = """
select e.fn, e.dst as head, coalesce(f.block, o.block) as exit_block, e.src as tail
from bb_edge e join block s on s.fn = e.fn and s.block = e.src join block t on t.fn = e.fn and t.block = e.dst join reach r on r.fn = e.fn and r.src = e.dst and r.dst = e.src
left join (select distinct b.fn, b.block from source_loop l join block b on b.fn = l.fn and l.cond_line between b.sl and b.el) k on k.fn = e.fn and k.block = e.dst
left join (select x.fn, x.src, min_by(x.dst, b.bb_id) as block from bb_edge x join block b on b.fn = x.fn and b.block = x.dst where x.etype = 'FALSE' group by x.fn, x.src) f on f.fn = e.fn and f.src = e.src
left join (select a.fn, a.src, a.dst, min_by(x.dst, b.bb_id) as block from bb_edge a join bb_edge x on x.fn = a.fn and x.src = a.src and x.dst <> a.dst join block b on b.fn = x.fn and b.block = x.dst group by a.fn, a.src, a.dst) o on o.fn = e.fn and o.src = e.src and o.dst = e.dst
where s.el > t.sl and k.block is null and coalesce(f.block, o.block) is not null"""
LOOP_BACK_EDGE = """
select e.fn, e.dst as head, min(x.dst) as exit_block, e.src as tail
from bb_edge e join block s on s.fn = e.fn and s.block = e.src join block t on t.fn = e.fn and t.block = e.dst
join bb_edge x on x.fn = e.fn and x.src = e.src and (x.etype = 'FALSE' or x.etype = 'UNCONDITIONAL' and x.dst <> e.dst)
where s.sl > t.sl group by e.fn, e.src, e.dst"""
LOOP_COMPONENT = """
select h.fn, h.head, cast(null as bigint) as exit_block, e.src as tail
from (select c.fn, c.component, coalesce(min(case when o.block is not null then c.block end), min(c.block)) as head, count(distinct c.block) as n
      from component c left join bb_edge i on i.fn = c.fn and i.dst = c.block left join component o on o.fn = i.fn and o.block = i.src and o.component <> c.component
      group by c.fn, c.component) h
join bb_edge e on e.fn = h.fn and e.dst = h.head join component c on c.fn = e.fn and c.block = e.src and c.component = h.component
where h.n > 1"""
LOOP_UNION = """
select fn, head, tail, exit_block, found_by
from (select *, row_number() over (partition by fn, head, tail order by found_by, exit_block) as k
      from (select fn, head, tail, exit_block, '1 source' as found_by from loop_exact union all select fn, head, tail, exit_block, '2 back edge' as found_by from loop_back_edge
            union all select fn, head, tail, exit_block, '3 component' as found_by from loop_component) x) y where k = 1"""
# The shortest cycle through a component's smallest block; where several blocks lead on, the smallest does.
TEXTS = {"turn": TURN, "loop_exact": LOOP_EXACT, "loop_do_while": LOOP_DO_WHILE, "loop_back_edge": LOOP_BACK_EDGE, "loop_component": LOOP_COMPONENT, "loop_union": LOOP_UNION}


def asked(wanted: Iterable[str]) -> set[str]:
    """What ``wanted`` reads, directly or not."""
    names = set(wanted)
    while more := {x for n in names & set(TEXTS) for x in re.findall(r"(?:from|join)\s+([a-z_]+)", TEXTS[n])} - names:
        names |= more
    return names


def find_loops(edges: DataFrame, blocks: DataFrame | None, source_loops: DataFrame | None, wanted: Iterable[str] = TEXTS) -> dict[str, DataFrame]:
    """The tables of ``TEXTS`` over a graph that ``wanted`` needs: each way of finding loops and their union.  All are joined
    by function: files of small numbers are far smaller than the tables in them, so none is sent whole to everyone by its files' size."""
    tables = {n: t for n, t in {"bb_edge": edges, "block": blocks, "source_loop": source_loops}.items() if t is not None}
    names = asked(wanted)
    # whoever asks what a header reaches asks for blocks with an edge back to it
    for name, of in (("reach", graphs.edges_on_cycles), ("component", graphs.strong_components), ("turn", None)):
        if name in names:
            df = of(edges) if of else frame(edges.sparkSession, TEXTS[name], {n: t.hint("merge") for n, t in tables.items()})
            tables[name] = kept(df, name)
    tables = {n: t.hint("merge") for n, t in tables.items()}
    for name, text in TEXTS.items():
        if name in names and name != "turn":
            tables[name] = frame(edges.sparkSession, text, tables)
    return tables


def number(block: str) -> int:
    return int(graphs.base(block))


def backward(tails: Iterable[str], head: str, before: dict[str, set[str]]) -> set[str]:
    """The natural loop of a header: what leads to its tails without passing it."""
    body, todo = {head}, list(tails)
    while todo:
        x = todo.pop()
        if x not in body:
            body.add(x)
            todo += before[x]
    return body


class Graph:
    """Successors with the kind of each edge; changes as loops are unrolled."""

    def __init__(self, edges: Iterable[tuple[str, str, str]]):
        self.after: dict[str, dict[str, str]] = defaultdict(dict)
        for s, d, t in edges:
            self.after[s][d] = t

    def before(self) -> dict[str, set[str]]:
        out = defaultdict(set)
        for s, successors in self.after.items():
            for d in successors:
                out[d].add(s)
        return out

    def reached(self, starts: Iterable[str]) -> set[str]:
        seen, todo = set(), list(starts)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += self.after.get(x, ())
        return seen

    def body(self, head: str, tails: set[str]) -> tuple[set[str], set[str]]:
        """(the loop's blocks, the blocks its back edges start from) as the graph is now; ``tails`` are known by their base."""
        before, ahead = self.before(), self.reached([head])
        now = {x for x in before[head] if graphs.base(x) in tails and number(x) >= number(head) and x in ahead}
        return (backward(now, head, before) & ahead if now else set()), now

    def unroll(self, head: str, tails: set[str], standing: set[tuple[str, str]], max_body: int, max_nesting: int) -> bool:
        """Gives the loop a second run: a clone of each block.  Edges between blocks of the loop lead to clones, others keep target
        and kind; back edges aren't copied.  The first run's back edges lead to the clone of the header, and the clones of
        their blocks leave to where the header leaves to; so do those of an inner loop that stands, lest they lead nowhere."""
        body, now = self.body(head, tails)
        if not now or len(body) > max_body or max(b.count("_L") for b in body) >= max_nesting:
            return False
        clone = {b: f"{b}_L{graphs.base(head)}i2" for b in body}
        for b in sorted(body):
            for d, kind in list(self.after[b].items()):
                if d in body and d != head and (d, graphs.base(b)) in standing and number(b) >= number(d):
                    inner, _ = self.body(d, {t for h, t in standing if h == d})
                    for x in [x for x in self.after[d] if x not in inner and x != head]:
                        self.after[clone[b]].setdefault(clone.get(x, x), EXIT)
                elif d != head:
                    self.after[clone[b]][clone.get(d, d)] = kind
        leaves = [d for d in self.after[head] if d not in body]
        for t in sorted(now):
            del self.after[t][head]
            self.after[t][clone[head]] = START
            for d in leaves:
                self.after[clone[t]].setdefault(d, EXIT)
        return True

    def cyclic(self) -> list[set[str]]:
        """The sets of blocks that all reach each other, of two or more."""
        left, out = set(self.after), []
        ahead = {b: self.reached(self.after[b]) for b in list(self.after)}
        while left:
            b = min(left)
            own = {x for x in ahead[b] if b in ahead.get(x, ())} | {b}
            left -= own
            if len(own) > 1:
                out.append(own)
        return out

    def cut_cycles(self) -> list[tuple[str, str]]:
        """Takes out, and gives, the edges on a cycle that lead back to an earlier line, and if that isn't all, those that lead out of
        a clone.  Then none is left: edges into clones lead to none of fewer runs, and all others lead on."""
        gone = []
        for leads_back in (lambda s, d, kind: kind != START and number(s) >= number(d), lambda s, d, kind: s.count("_L") > d.count("_L")):
            for own in self.cyclic():
                for s in sorted(own):
                    for d in [d for d, kind in self.after[s].items() if d in own and leads_back(s, d, kind)]:
                        del self.after[s][d]
                        gone.append((s, d))
        return gone


def unrolled(edges: Iterable[tuple[str, str, str]], loops: Iterable[tuple[str, str]], by_text: bool = False, max_body: int = MAX_BODY, max_nesting: int = MAX_NESTING) -> list[tuple[str, str, str]]:
    """The edges with every loop (header, block of the back edge) run twice, inner loops first: by the size of their blocks, or
    ``by_text``, as the reference numbers them, by the header as text from the end.  Each loop is worked on in the graph that the
    loops inside it have left, so their second runs belong to it and get a second run too.  Back edges to one header are one loop.
    Self-loops go."""
    edges = [e for e in edges if e[0] != e[1]]
    graph, tails = Graph(edges), defaultdict(set)
    for head, tail in loops:
        if head != tail:
            tails[head].add(tail)
    own = {n for s, d, _ in edges for n in (s, d)}
    size = {h: len(graph.body(h, t)[0]) for h, t in tails.items()}
    heads = sorted(sorted(tails, reverse=True), key=lambda h: 0 if by_text else size[h])
    standing = {(h, t) for h in tails for t in tails[h]}
    for head in heads:
        if graph.unroll(head, tails[head], standing, max_body, max_nesting):
            standing -= {(head, t) for t in tails[head]}
    gone = graph.cut_cycles()
    met = graph.reached(own)  # a clone that nothing leads to is left out
    return sorted([(s, d, t) for s, successors in graph.after.items() if s in met for d, t in successors.items()] + [(s, d, CYCLE) for s, d in gone if s in met and d in met])


def unroll(edges: DataFrame, loops: DataFrame, by_text: bool = False, max_body: int = MAX_BODY, max_nesting: int = MAX_NESTING) -> DataFrame:
    """(fn, src, dst, etype) with clones named ``<block>_L<header>i2``, clones of clones accordingly; without the edges of kind
    CYCLE, which only loops with several entries or over the limits leave, the graph has no cycle."""

    def rows_of(triples: list[tuple], own: list[tuple]) -> list[tuple]:
        return unrolled(triples, own, by_text, max_body, max_nesting)

    text = lambda df, *columns: df.withColumns({c: F.col(c).cast("string") for c in columns})
    own = graphs.listed(text(loops.select("fn", "head", "tail").distinct(), "head", "tail"), "fn", "head", "tail")
    both = graphs.with_lists(graphs.listed(text(edges, "src", "dst"), "fn", "src", "dst", "etype"), own, "loops")
    return graphs.by_function(both, "fn long, src string, dst string, etype string", rows_of)


def first_runs(unrolled_edges: DataFrame) -> DataFrame:
    """(fn, src, dst, etype) of the edges that start in a first run, by base blocks; those to an earlier block are of kind BACK."""
    return unrolled_edges.sparkSession.sql("""
        select fn, cast(src as bigint) as src, cast(split_part(dst, '_L', 1) as bigint) as dst, case when cast(src as bigint) > cast(split_part(dst, '_L', 1) as bigint) then 'BACK' else etype end as etype
        from {edges} where not contains(src, '_L')""", edges=unrolled_edges)


def cycles(edges: DataFrame) -> DataFrame:
    """(fn, component, length, cycle): for each component with a cycle the shortest one through its smallest block, the smallest
    block first wherever several lead on; the first block stands at the end again."""

    def rows_of(edges: list[tuple]) -> list[tuple]:
        after, before = defaultdict(set), defaultdict(set)
        for s, d, c in edges:
            after[c, s].add(d)
            before[c, d].add(s)
        rows = []
        for c in sorted({c for _, _, c in edges}):
            far, todo = {}, [(s, 1) for s in sorted(before[c, c])]
            for x, n in todo:  # grows as it is read: breadth first
                if x not in far:
                    far[x] = n
                    todo += [(s, n + 1) for s in sorted(before[c, x]) if s not in far]
            at, path = c, [c]
            while at != c or len(path) == 1:
                left = far[at] - 1
                at = c if left == 0 else min(d for d in after[c, at] if far.get(d) == left)
                path.append(at)
            rows.append((c, len(path) - 1, ">".join(map(str, path))))
        return rows

    inside = graphs.edges_of_components(edges)
    return graphs.by_function(graphs.listed(inside, "fn", "src", "dst", "component"), "fn long, component long, length long, cycle string", rows_of)


def cyclic_blocks(unrolled_edges: DataFrame) -> DataFrame:
    """(fn, cyclic_blocks): how many blocks lie on a cycle of edges that may be walked."""

    def rows_of(edges: list[tuple]) -> list[tuple]:
        return [(sum(map(len, Graph(e for e in edges if e[2] != CYCLE).cyclic())),)]

    return graphs.by_function(graphs.listed(unrolled_edges, "fn", "src", "dst", "etype"), "fn long, cyclic_blocks long", rows_of)


def _tables(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}
    return {n: shared(spark, n, base) for n in ("bb_edge", "block", "source_loop") if n in names}


def loops_within(spark: SparkSession, sf_dir: str, functions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, blocks, entries, loops) of the graphs of ``functions`` (fn), and of no others: each graph is worked on by itself."""
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}
    own = lambda name, tables: kept(run(spark, name, tables).join(functions, "fn", "left_semi"), name)
    edges = own("bb_edge", {"lineitem": base["lineitem"]})
    blocks, flags = (kept(run(spark, n, {"bb_edge": edges}), n) for n in ("block", "bb_flags"))
    found = find_loops(edges, blocks, own("source_loop", {"orders": base["orders"]}), ["loop_union"])
    return edges, blocks, flags.where("is_entry = 1").select("fn", "block"), found["loop_union"]


def loops_of(spark: SparkSession, sf_dir: str, *wanted: str) -> dict[str, DataFrame]:
    given = _tables(spark, sf_dir, asked(wanted) | {"bb_edge"})
    return find_loops(given["bb_edge"], given.get("block"), given.get("source_loop"), wanted)


def unrolled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = loops_of(spark, sf_dir, "loop_union")
    return unroll(found["bb_edge"], found["loop_union"])


def _of(name: str):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return loops_of(spark, sf_dir, name)[name]

    call.__name__ = name
    return call


def cfg_unrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unrolled_graph(spark, sf_dir)


def unrolled_first_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_runs(unrolled_graph(spark, sf_dir))


def unrolled_cyclic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclic_blocks(unrolled_graph(spark, sf_dir))


def cfg_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(_tables(spark, sf_dir, ["bb_edge"])["bb_edge"])


QUERIES = (*(_of(n) for n in TEXTS if n != "turn"), cfg_unrolled, unrolled_first_runs, unrolled_cyclic_blocks, cfg_cycles)


def _prefix() -> str:
    """The graph, what reaches what, and components, for DuckDB."""
    parts = {n: compile_sql(n, "duckdb") for n in ("bb_edge", "block", "source_loop")}
    return "with recursive " + ",\n".join(f"{n} as ({t})" for n, t in parts.items()) + """,
    reach as (select fn, src, dst from bb_edge union select c.fn, c.src, e.dst from reach c join bb_edge e on e.fn = c.fn and e.src = c.dst),
    component as (select n.fn, n.block, least(n.block, coalesce(min(a.dst), n.block)) as component from (select fn, src as block from bb_edge union select fn, dst as block from bb_edge) n
      left join (select x.fn, x.src, x.dst from reach x join reach y on y.fn = x.fn and y.src = x.dst and y.dst = x.src) a on a.fn = n.fn and a.src = n.block group by n.fn, n.block)"""


_CYCLES = """,
    inside as (select e.fn, e.src, e.dst, a.component as c from bb_edge e join component a on a.fn = e.fn and a.block = e.src join component b on b.fn = e.fn and b.block = e.dst and b.component = a.component),
    away as (select fn, c, src as block, 1 as n from inside where dst = c union select i.fn, i.c, i.src, a.n + 1 from away a join inside i on i.fn = a.fn and i.c = a.c and i.dst = a.block where a.n < 12 and a.block <> a.c),
    far as (select fn, c, block, min(n) as n from away group by fn, c, block),
    step as (select i.fn, i.c, i.src, min(i.dst) as dst from inside i join far f on f.fn = i.fn and f.c = i.c and f.block = i.src left join far g on g.fn = i.fn and g.c = i.c and g.block = i.dst
             where f.n > 1 and g.n = f.n - 1 and i.dst <> i.c or f.n = 1 and i.dst = i.c group by i.fn, i.c, i.src),
    trail as (select fn, c, c as block, cast(c as varchar) as cycle, 0 as length from (select distinct fn, c from inside) x
              union all select s.fn, s.c, s.dst, t.cycle || '>' || cast(s.dst as varchar), t.length + 1 from trail t join step s on s.fn = t.fn and s.c = t.c and s.src = t.block where t.length = 0 or t.block <> t.c)
    select fn, c as component, cast(length as bigint) as length, cycle from trail where length > 0 and block = c"""


def oracles() -> dict[str, str]:
    known = dict(TEXTS)
    with_all = _prefix() + "".join(f",\n{n} as ({t})" for n, t in known.items())
    out = {n: f"{with_all}\nselect * from {n}" for n in TEXTS if n != "turn"}
    out["cfg_cycles"] = _prefix() + _CYCLES
    out["unrolled_first_runs"] = compile_sql("bb_edge", "duckdb").join(("select fn, src, dst, case when src > dst then 'BACK' else etype end as etype from (", ") e"))
    out["unrolled_cyclic_blocks"] = compile_sql("bb_edge", "duckdb").join(("select distinct fn, cast(0 as bigint) as cyclic_blocks from (", ") e"))
    return out
