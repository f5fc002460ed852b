"""Registry of the relational queries and their DuckDB oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .operators import assembly, assess, blocks, builds, descriptions, graphs, lookups, loops, paths, predicates, replies, rescore, segment_constraints, symbols, walks  # noqa: F401  (their plans register on import)
from .plans import demo, round_trips  # noqa: F401
from .plans.core import INNER, PLANS, compile_sql, run

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def base_tables(spark: SparkSession, sf_dir: str, used: set[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in used}


def query(name: str):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = compile_sql(name, "spark")
        return run(spark, name, base_tables(spark, sf_dir, {t for t in TABLES if re.search(rf"\b{t}\b", text)}))

    call.__name__ = name
    return call


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most reused logic units of each segment, with the reuse of the segment."""
    return query("top_units")(spark, sf_dir)


def queries() -> dict:
    found = {name: query(name) for name in PLANS if name not in demo.DOMAIN | INNER}
    return found | {f.__name__: f for f in (*graphs.QUERIES, *loops.QUERIES, *walks.QUERIES, *builds.QUERIES, *replies.QUERIES, *assess.QUERIES, *rescore.QUERIES, *segment_constraints.QUERIES)} | round_trips.queries()


def oracle_sql() -> dict[str, str]:
    return {name: compile_sql(name, "duckdb") for name in PLANS if name not in demo.DOMAIN | INNER} | graphs.oracles() | loops.oracles() | walks.oracles() | builds.oracles() | replies.oracles() | assess.oracles() | rescore.oracles() | round_trips.oracles()
