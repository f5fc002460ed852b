"""The analysis of units in two phases with an assessor of one's own.

An assessor is a function from a batch of units to their verdicts; it is named in ``ASSESSORS`` and called in the tasks.  The first
phase covers the ends of paths, the second their middles once for each pair of ends that they stand between, with what the
first phase said of these.  Between the phases the results are written, so the second reads them and doesn't ask again when an
executor is lost.  What a cache knows isn't asked at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import kept, plan
from ..sources.stores import Store

#: What an assessor gets: one row a unit, a middle with the verdicts of its ends (null: no such end, or none of it is known).
ASKED = ("segment", "unit_key", "b_key", "f_key", "usage_count", "backward_fp", "forward_fp")
RESULT = "segment string, unit_key string, b_key string, f_key string, fp boolean, level string"
KEYS = ["segment", "unit_key", "b_key", "f_key"]
NONE = "none"


def by_digest(units: pd.DataFrame) -> pd.DataFrame:
    """A verdict that follows from a unit's key and, for a middle, from its ends: where one end is a false positive, so is it."""
    digits = [hashlib.md5(k.encode()).hexdigest() for k in units["unit_key"]]
    ends = [b is True or f is True for b, f in zip(units["backward_fp"], units["forward_fp"], strict=True)]
    own = [d[0] in "01234567" for d in digits]
    return pd.DataFrame({"fp": [o or e for o, e in zip(own, ends, strict=True)], "level": [("HIGH", "MEDIUM", "LOW")[int(d[1], 16) % 3] for d in digits]})


ASSESSORS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {"by_digest": by_digest}


def ask(units: DataFrame, assessor: str) -> DataFrame:
    """The assessor's rows beside the units' keys."""
    judge = ASSESSORS[assessor]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = judge(batch.astype({"backward_fp": object, "forward_fp": object}))
            yield pd.concat([batch[KEYS].reset_index(drop=True), said[["fp", "level"]].reset_index(drop=True)], axis=1)

    return units.select(*ASKED).mapInPandas(run, RESULT)


def assess(units: DataFrame, contexts: DataFrame, assessor: str, cached: DataFrame | None = None) -> DataFrame:
    """Rows of ``RESULT`` and ``phase``, 0 for what was cached.  ``units`` has (segment, unit_key, usage_count), ``contexts`` the
    ends (b_key, f_key; ``none`` where there is none) of each middle's unit_key.  A unit of several contexts has as many rows."""
    spark = units.sparkSession
    cached = cached if cached is not None else spark.createDataFrame([], RESULT)
    known = cached.select(*KEYS).distinct()
    none = F.lit(None).cast("boolean")
    ends = units.where("segment <> 'intermediate'").select("segment", "unit_key", F.lit(NONE).alias("b_key"), F.lit(NONE).alias("f_key"), "usage_count", none.alias("backward_fp"), none.alias("forward_fp"))
    first = kept(ask(ends.join(known, KEYS, "left_anti"), assessor).withColumn("phase", F.lit(1)), "phase_one")
    said = first.drop("phase").unionByName(cached.where("segment <> 'intermediate'")).select("segment", "unit_key", "fp")
    of = lambda segment, key, fp: said.where(F.col("segment") == segment).select(F.col("unit_key").alias(key), F.col("fp").alias(fp))
    middles = units.where("segment = 'intermediate'").join(contexts, "unit_key").join(known, KEYS, "left_anti")
    middles = middles.join(of("backward", "b_key", "backward_fp"), "b_key", "left").join(of("forward", "f_key", "forward_fp"), "f_key", "left")
    second = kept(ask(middles, assessor).withColumn("phase", F.lit(2)), "phase_two")
    return first.unionByName(second).unionByName(cached.withColumn("phase", F.lit(0))).select(*KEYS, "fp", "level", "phase")


plan("middle_context", "select distinct u.unit_key, coalesce(d.b_key, 'none') as b_key, coalesce(d.f_key, 'none') as f_key from path_unit u join decomposition d on d.path_id = u.path_id where u.segment = 'intermediate'")
# Units whose ends an earlier run has assessed.
plan("assessed_before", "select segment, unit_key, 'none' as b_key, 'none' as f_key, usage_count % 2 = 0 as fp, 'LOW' as level from logic_unit where segment = 'backward' and usage_count > 1")


def assessed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phases over all units and contexts, with what an earlier run knows."""
    from ..catalog import query

    of = lambda name: query(name)(spark, sf_dir)
    return assess(of("logic_unit"), of("middle_context"), "by_digest", of("assessed_before"))


CACHE = "analysis_type string, cwe_code string, variable_name string, chain_hash string, backward_hash string, result string, ordinal long"


def cache_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result cache after two rounds of upserts, a compaction between them, and the removal of one kind of analysis."""
    from ..catalog import query
    from ..plans.round_trips import fresh

    rows = query("cache_row")(spark, sf_dir)
    store = Store(spark, fresh(spark, "cache"), CACHE, ["analysis_type", "cwe_code", "variable_name", "chain_hash", "backward_hash"])
    store.upsert(rows.where("ordinal % 3 <> 0"), "ordinal")
    store.compact()
    store.drop_history()
    store.upsert(rows.where("ordinal % 3 = 0"), "ordinal")
    store.clear("analysis_type = 'P'")
    return store.read()


CALL = "caller string, caller_file string, line long, callee string, callee_file string, calls boolean"


def call_cache_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call cache: filled from the call graph beforehand, then with what was asked one by one, without one file's calls."""
    from ..catalog import query
    from ..plans.round_trips import fresh

    store = Store(spark, fresh(spark, "calls"), CALL, ["caller", "caller_file", "line", "callee", "callee_file"])
    store.upsert(query("call_edge")(spark, sf_dir).withColumn("calls", F.lit(True)))
    store.clear("caller_file = 's1.c'")
    store.upsert(query("call_asked")(spark, sf_dir))
    return store.read()


plan("call_asked", """
select distinct s.t_fn as caller, s.t_file as caller_file, s.t_line as line, s.f_fn as callee, s.f_file as callee_file, p.calls
from step s join call_probe p on p.path_id = s.path_id and p.flowstep = s.flowstep""")

QUERIES = (assessed_units, cache_upserted, call_cache_upserted)


def oracles() -> dict[str, str]:
    from ..plans.core import compile_sql

    part = lambda *names: "with " + ",\n".join(f"{n} as ({compile_sql(n, 'duckdb')})" for n in names)
    return {
        "assessed_units": part("logic_unit", "middle_context", "assessed_before") + """,
            u as (select *, substr(md5(unit_key), 1, 1) < '8' as own, ['HIGH', 'MEDIUM', 'LOW'][(instr('0123456789abcdef', substr(md5(unit_key), 2, 1)) - 1) % 3 + 1] as level from logic_unit),
            one as (select segment, unit_key, 'none' as b_key, 'none' as f_key, own as fp, level, 1 as phase from u where segment <> 'intermediate' and (segment, unit_key) not in (select segment, unit_key from assessed_before)
                    union all select *, 0 as phase from assessed_before)
            select * from one union all
            select u.segment, u.unit_key, c.b_key, c.f_key, u.own or coalesce(b.fp, false) or coalesce(f.fp, false) as fp, u.level, 2 as phase
            from u join middle_context c on c.unit_key = u.unit_key left join one b on b.segment = 'backward' and b.unit_key = c.b_key left join one f on f.segment = 'forward' and f.unit_key = c.f_key where u.segment = 'intermediate'""",
        "cache_upserted": part("cache_row") + """
            select analysis_type, cwe_code, variable_name, chain_hash, backward_hash, result, ordinal from (
              select *, row_number() over (partition by analysis_type, cwe_code, variable_name, chain_hash, backward_hash order by case when ordinal % 3 = 0 then 1 else 0 end desc, ordinal desc) as k from cache_row where analysis_type <> 'P') x where k = 1""",
        "call_cache_upserted": part("call_edge", "call_asked") + """
            select caller, caller_file, line, callee, callee_file, bool_or(calls) as calls from call_asked group by caller, caller_file, line, callee, callee_file
            union all select e.*, true from (select caller, caller_file, line, callee, callee_file from call_edge where caller_file <> 's1.c') e
            anti join call_asked a on a.caller = e.caller and a.caller_file = e.caller_file and a.line = e.line and a.callee = e.callee and a.callee_file = e.callee_file""",
    }
