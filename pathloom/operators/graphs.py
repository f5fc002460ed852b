"""Control-flow graphs: reachability, components, dominators.

A graph belongs to one function and is small; graphs are dealt out by function, and those of a batch are worked
on together, as arrays of alike sizes: a call of Python for each function would cost more than its graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..plans.core import compile_sql, run


#: Cells of the arrays of a chunk of graphs; a larger graph is a chunk of its own.
CHUNK = 1 << 21
#: Rows that a worker gives back at once.
ROWS = 50_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by function to as many tasks as a shuffle has: graphs are small in bytes and long to work on, and adaptive
    execution, which goes by bytes, would put them all into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(by or ("fn",)))


def listed(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, rows): one row a function with its rows as an array, dealt out; many functions reach a worker in one batch."""
    return dealt(df, by).groupBy(by).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def packed(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The functions of a batch by size, some at once: (their numbers in the batch, blocks (function, place), whether a place has a
    block, adjacency (function, place, place)).  Places follow the order of blocks; a chunk's cubes stay small.  Where rows have a
    ``kind`` (a small number, none 0), adjacency holds it."""
    rows = batch.column("rows")
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    flat = rows.flatten()
    src, dst = (pc.struct_field(flat, [n]).to_numpy(zero_copy_only=False) for n in ("src", "dst"))
    kind = pc.struct_field(flat, ["kind"]).to_numpy(zero_copy_only=False) if flat.type.get_field_index("kind") >= 0 else np.ones(len(src), bool)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    owners, blocks = np.concatenate([owner, owner]), np.concatenate([src, dst])
    order = np.lexsort((blocks, owners))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(owners[order]) != 0) | (np.diff(blocks[order]) != 0)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    own, block = owners[order][new], blocks[order][new]
    size = np.bincount(own, minlength=len(lengths))
    first = np.cumsum(size) - size
    place = np.arange(len(own)) - first[own]
    by_size, edge_from = np.argsort(size, kind="stable"), np.cumsum(lengths) - lengths
    i = 0
    while i < len(by_size):
        # sizes rise: the last one of a chunk bounds it
        n = max(1, int(size[by_size[i]]))
        j = i + max(1, CHUNK // (n * n))
        j = i + max(1, int(np.searchsorted(size[by_size[i:j]], 2 * n, side="right")))
        chosen = by_size[i:j]
        n, i = max(1, int(size[chosen[-1]])), j
        mine = np.full(len(lengths), -1)
        mine[chosen] = np.arange(len(chosen))
        nodes, there = np.zeros((len(chosen), n), np.int64), np.zeros((len(chosen), n), bool)
        held = np.concatenate([np.arange(first[c], first[c] + size[c]) for c in chosen])
        nodes[mine[own[held]], place[held]], there[mine[own[held]], place[held]] = block[held], True
        e = np.concatenate([np.arange(edge_from[c], edge_from[c] + lengths[c]) for c in chosen])
        edge = np.zeros((len(chosen), n, n), kind.dtype)
        edge[mine[owner[e]], place[at[e]], place[at[len(owner) + e]]] = kind[e]
        yield chosen, nodes, there, edge


def reach(edge: np.ndarray) -> np.ndarray:
    """Which places lead to which by one edge or more: Warshall's steps for all functions of a chunk at once."""
    n = edge.shape[1]
    if n > 64:  # by bits, and only where a step changes something
        bits = np.packbits(edge, axis=2)
        for k in range(n):
            f, i = np.nonzero(bits[:, :, k >> 3] >> (7 - (k & 7)) & 1)
            bits[f, i] |= bits[f, k]
        return np.unpackbits(bits, axis=2, count=n).astype(bool)
    found = edge.copy()
    for k in range(n):
        found |= found[:, :, k, None] & found[:, k, None, :]
    return found


def components(found: np.ndarray) -> np.ndarray:
    """The first place of each place's component."""
    return (found & found.transpose(0, 2, 1) | np.eye(found.shape[1], dtype=bool)).argmax(axis=2)


def by_pieces(edges: DataFrame, schema: str, pieces_of: Callable) -> DataFrame:
    """``pieces_of(nodes, there, edge)`` gives function numbers of a chunk and the other columns, piece by piece, for all functions
    of ``edges``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chosen, *graph in packed(batch):
                for of, columns in pieces_of(*graph):
                    fn = batch.column("fn").take(pa.array(chosen[of]))
                    yield pa.RecordBatch.from_arrays([fn, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values())], names=["fn", *columns])

    return listed(edges, "fn", *(c for c in ("src", "dst", "kind") if c in edges.columns)).mapInArrow(work, schema)


def by_chunks(edges: DataFrame, schema: str, rows_of: Callable) -> DataFrame:
    """As ``by_pieces``, with all rows of a chunk at once, from edges without their kinds."""
    return by_pieces(edges.select("fn", "src", "dst"), schema, lambda *graph: [rows_of(*graph)])


def closure(edges: DataFrame) -> DataFrame:
    """(fn, src, dst): dst can be reached from src by one edge or more."""

    def rows_of(nodes, there, edge):
        f, i, j = np.nonzero(reach(edge))
        return f, {"src": nodes[f, i], "dst": nodes[f, j]}

    return by_chunks(edges, "fn long, src long, dst long", rows_of)


def strong_components(edges: DataFrame) -> DataFrame:
    """(fn, block, component): blocks that reach each other; the component is its smallest block."""

    def rows_of(nodes, there, edge):
        f, i = np.nonzero(there)
        return f, {"block": nodes[f, i], "component": nodes[f, components(reach(edge))[f, i]]}

    return by_chunks(edges, "fn long, block long, component long", rows_of)


def edges_on_cycles(edges: DataFrame) -> DataFrame:
    """(fn, src, dst): the rows of ``closure`` whose dst leads back to src by one edge."""

    def rows_of(nodes, there, edge):
        f, i, j = np.nonzero(reach(edge) & edge.transpose(0, 2, 1))
        return f, {"src": nodes[f, i], "dst": nodes[f, j]}

    return by_chunks(edges, "fn long, src long, dst long", rows_of)


def edges_of_components(edges: DataFrame) -> DataFrame:
    """(fn, src, dst, component): the edges between blocks of one component."""

    def rows_of(nodes, there, edge):
        of = components(reach(edge))
        f, i, j = np.nonzero(edge & (of[:, :, None] == of[:, None, :]))
        return f, {"src": nodes[f, i], "dst": nodes[f, j], "component": nodes[f, of[f, i]]}

    return by_chunks(edges, "fn long, src long, dst long, component long", rows_of)


def dominators(edges: DataFrame) -> DataFrame:
    """(fn, block, dominator, immediate): a block's dominators by the fixpoint over predecessors, from the
    entry, which is the function's smallest block."""

    def rows_of(nodes, there, edge):
        n = edge.shape[1]
        met = reach(edge)[:, 0, :]
        met[:, 0] = True
        doms = np.repeat(met[:, None, :], n, axis=1)
        doms[:, 0, 1:] = False
        changed = True
        while changed:
            changed = False
            for b in range(1, n):
                before = np.nonzero(edge[:, :, b].any(axis=0))[0]
                new = met & (doms[:, before] | ~(edge[:, before, b] & met[:, before])[:, :, None]).all(axis=1)
                new[:, b] = met[:, b]
                changed, doms[:, b] = changed or bool((new != doms[:, b]).any()), new
        doms &= met[:, :, None]
        count = doms.sum(axis=2)
        f, b, d = np.nonzero(doms)
        return f, {"block": nodes[f, b], "dominator": nodes[f, d], "immediate": (b != d) & (count[f, b] == count[f, d] + 1)}

    return by_chunks(edges, "fn long, block long, dominator long, immediate boolean", rows_of)


def lists(column: pa.ListArray) -> Iterator[list[tuple]]:
    """The rows of each function of a batch, sorted; null is none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    rows, at = list(zip(*(c.to_pylist() for c in column.flatten().flatten()), strict=True)), 0
    for n in lengths:
        yield sorted(rows[at : at + n])
        at += n


def by_function(graphs: DataFrame, schema: str, rows_of: Callable) -> DataFrame:
    """``rows_of`` gives the rows of a function, without ``fn``, from the lists of ``graphs`` (fn, lists)."""
    names = [c for c in graphs.columns if c != "fn"]
    kinds = [f.dataType for f in StructType.fromDDL(schema)]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(k) for k in kinds]
        out: list[tuple] = []
        for batch in batches:
            for fn, *own in zip(batch.column("fn").to_pylist(), *(lists(batch.column(n)) for n in names), strict=True):
                out += [(fn, *r) for r in rows_of(*own)]
                if len(out) >= ROWS:
                    yield table(out, types)
                    out = []
        if out:
            yield table(out, types)

    def table(out: list[tuple], types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=columns)

    columns = StructType.fromDDL(schema).names
    return graphs.mapInArrow(work, schema)


def with_lists(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """The lists of ``left`` with those that ``right`` has for the function; both are dealt out alike, so none moves again."""
    right = right.withColumnsRenamed({"fn": "__fn", "rows": name})
    return left.join(right.hint("merge"), F.col("fn") == F.col("__fn"), "left").drop("__fn")


def base(block) -> str:
    return str(block).split("_L")[0]


def bb_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, "bb_edge", {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")})


def cfg_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(bb_edges(spark, sf_dir))


def cfg_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_components(bb_edges(spark, sf_dir))


def cfg_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominators(bb_edges(spark, sf_dir))


QUERIES = (cfg_closure, cfg_components, cfg_dominators)


def _closure_sql() -> str:
    return "with recursive e as (" + compile_sql("bb_edge", "duckdb") + "), c as (select fn, src, dst from e union select c.fn, c.src, e.dst from c join e on e.fn = c.fn and e.src = c.dst) select fn, src, dst from c"


def _components_sql() -> str:
    return _closure_sql().replace("select fn, src, dst from c", "select n.fn, n.block, least(n.block, coalesce(min(a.dst), n.block)) as component from (select fn, src as block from e union select fn, dst as block from e) n left join (select x.fn, x.src, x.dst from c x join c y on y.fn = x.fn and y.src = x.dst and y.dst = x.src) a on a.fn = n.fn and a.src = n.block group by n.fn, n.block")


def _dominators_sql() -> str:
    """A block dominates those that the entry can't reach without it."""
    return "with recursive e as (" + compile_sql("bb_edge", "duckdb") + """),
    entry as (select fn, min(least(src, dst)) as b from e group by fn),
    r as (select fn, b as n from entry union select r.fn, e.dst from r join e on e.fn = r.fn and e.src = r.n),
    rd as (select i.fn, x.n as d, i.b as n from entry i join r x on x.fn = i.fn where x.n <> i.b union select rd.fn, rd.d, e.dst from rd join e on e.fn = rd.fn and e.src = rd.n where e.dst <> rd.d),
    dom as (select r.fn, r.n as block, d.n as dominator from r join r d on d.fn = r.fn left join rd on rd.fn = r.fn and rd.d = d.n and rd.n = r.n where rd.n is null),
    c as (select fn, block, count(*) as n from dom group by fn, block)
    select dom.fn, dom.block, dom.dominator, dom.block <> dom.dominator and x.n = y.n + 1 as immediate from dom join c x on x.fn = dom.fn and x.block = dom.block join c y on y.fn = dom.fn and y.block = dom.dominator"""


def oracles() -> dict[str, str]:
    return {"cfg_closure": _closure_sql(), "cfg_components": _components_sql(), "cfg_dominators": _dominators_sql()}
