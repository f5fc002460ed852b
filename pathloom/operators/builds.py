"""What a build of graphs covers: functions within some calls of its entries, and the blocks that a question is put to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import compile_sql, kept, plan, shared

#: Calls from an entry that a build follows unless told otherwise.
MAX_DEPTH = 3

# The least number of runs at which every point of a question has a block; without one each point takes its own least.
plan("block_by_level", """
select question, point, block_id, runs, whole from (
  select c.question, c.point, c.block_id, c.runs, l.runs is not null as whole, row_number() over (partition by c.question, c.point order by c.runs, c.size, c.block_id) as k
  from (select question, point, block_id, size, (length(block_id) - length(replace(block_id, '_L', ''))) / 2 as runs from point_candidate) c
  left join (select n.question, min(n.runs) as runs
             from (select question, (length(block_id) - length(replace(block_id, '_L', ''))) / 2 as runs, count(distinct point) as n from point_candidate group by question, (length(block_id) - length(replace(block_id, '_L', ''))) / 2) n
             join (select question, count(distinct point) as n from point_candidate group by question) a on a.question = n.question and a.n = n.n group by n.question) l on l.question = c.question
  where l.runs is null or c.runs = l.runs) x where k = 1""")


def covered(calls: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(entry, function, depth): the functions that a build from an entry covers, each at the fewest calls from it.

    ``calls`` has caller and callee, ``entries`` function.  The frontier of each depth is written and joined with the calls;
    functions met before are left out, so a cycle ends by itself and lineage doesn't grow with the depth."""
    calls = calls.select("caller", "callee").where("caller is not null and callee is not null").distinct()
    front = kept(entries.select(F.col("function").alias("entry"), "function").where("function is not null").distinct().withColumn("depth", F.lit(0).cast("long")), "frontier")
    found = [front]
    for depth in range(1, max_depth + 1):
        met = front.join(calls, F.col("function") == F.col("caller")).select("entry", F.col("callee").alias("function")).distinct()
        for earlier in found:
            met = met.join(earlier.select("entry", "function"), ["entry", "function"], "left_anti")
        front = kept(met.withColumn("depth", F.lit(depth).cast("long")), "frontier")
        if front.isEmpty():
            break
        found.append(front)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def graph_coverage(found: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, depth, functions, blocks, edges) of builds: what each depth adds; blocks 0.0_ don't count, nor edges at them."""
    real = blocks.where("not startswith(bb_id, '0.0_')").select("function", "block")
    sizes = real.groupBy("function").agg(F.count("*").alias("blocks"))
    at = lambda end: real.select("function", F.col("block").alias(end))
    wired = edges.join(at("src"), ["function", "src"], "left_semi").join(at("dst"), ["function", "dst"], "left_semi").groupBy("function").agg(F.count("*").alias("edges"))
    met = found.join(sizes, "function", "left").join(wired, "function", "left")
    return met.groupBy("entry", "depth").agg(F.count("*").alias("functions"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")}
    return {n: shared(spark, n, base) for n in ("function_call", "function_entry", "function_block", "function_edge")}


def call_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every function, as deep as a build goes."""
    given = _tables(spark, sf_dir)
    return covered(given["function_call"], given["function_entry"])


def build_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _tables(spark, sf_dir)
    return graph_coverage(covered(given["function_call"], given["function_entry"]), given["function_block"], given["function_edge"])


QUERIES = (call_coverage, build_coverage)


def oracles() -> dict[str, str]:
    parts = ",\n".join(f"{n} as ({compile_sql(n, 'duckdb')})" for n in ("function_call", "function_entry", "function_block", "function_edge"))
    text = f"""with recursive {parts},
    walk as (select function as entry, function, 0 as depth from function_entry where function is not null
             union select w.entry, c.callee, w.depth + 1 from walk w join function_call c on c.caller = w.function where c.callee is not null and w.depth < {MAX_DEPTH}),
    found as (select entry, function, cast(min(depth) as bigint) as depth from walk group by entry, function)"""
    size = """ select f.entry, f.depth, count(*) as functions, cast(coalesce(sum(b.n), 0) as bigint) as blocks, cast(coalesce(sum(e.n), 0) as bigint) as edges from found f
    left join (select function, count(*) as n from function_block where bb_id not like '0.0\\_%' escape '\\' group by function) b on b.function = f.function
    left join (select e.function, count(*) as n from function_edge e join function_block s on s.function = e.function and s.block = e.src join function_block d on d.function = e.function and d.block = e.dst
               where s.bb_id not like '0.0\\_%' escape '\\' and d.bb_id not like '0.0\\_%' escape '\\' group by e.function) e on e.function = f.function group by f.entry, f.depth"""
    return {"call_coverage": text + " select * from found", "build_coverage": text + size}
