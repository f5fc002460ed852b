"""Readers of the reference's input formats as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int, endColumn: int>>"
SARIF = f"runs array<struct<results: array<struct<ruleId: string, message: struct<text: string>, codeFlows: array<struct<threadFlows: array<struct<locations: array<struct<location: struct<physicalLocation: {PLACE}, message: struct<text: string>>>>>>>>>>>>"
POINT = "struct<file_path: string, line: int, lineCode: string, variable: string, semanticLabel: string, relatedCode: string, functionName: string, startColumn: int, endColumn: int>"
CODE_CHARS = 10_000

#: Positional columns of the symbol tables.
SYMBOLS = {
    "functionlist": "name string, qualified_name string, file_path string, start_line int, end_line int",
    "function_use_def": "name string, qualified_name string, use_file string, use_line int, def_file string, def_start int, def_end int",
    "macros": "name string, body string, file_path string, start_line int, end_line int",
    "macro_use_def": "name string, use_file string, use_line int, def_file string, def_line int, body string",
    "globalvars": "name string, qualified_name string, type_name string, file_path string, start_line int, end_line int",
    "classes": "name string, qualified_name string, file_path string, start_line int, end_line int",
}


def clean_uri(uri: F.Column) -> F.Column:
    """Strips ``file:`` and leaves one of several leading slashes."""
    return F.regexp_replace(F.regexp_replace(uri, "^file:", ""), "^/+", "/")


def sarif(spark: SparkSession, path: str, all_runs: bool = False) -> DataFrame:
    """A row a location of a thread flow; locations without a place are left out, missing numbers are 0."""
    return locations(spark.read.text(path, wholetext=True), all_runs)


def sarif_lines(spark: SparkSession, path: str, all_runs: bool = False) -> DataFrame:
    """The same of files that hold a document a line."""
    return locations(spark.read.text(path), all_runs)


def locations(texts: DataFrame, all_runs: bool = False) -> DataFrame:
    doc = texts.select(F.input_file_name().alias("source"), F.from_json("value", SARIF).alias("d"))
    runs = doc.select("source", F.posexplode("d.runs").alias("run_idx", "run"))
    if not all_runs:
        runs = runs.where("run_idx = 0")
    results = runs.select("source", "run_idx", F.posexplode("run.results").alias("result_idx", "r"))
    flows = results.select("source", "run_idx", "result_idx", "r.ruleId", F.col("r.message.text").alias("message"), F.posexplode("r.codeFlows").alias("flow_idx", "f"))
    threads = flows.select("source", "run_idx", "result_idx", "ruleId", "message", "flow_idx", F.posexplode("f.threadFlows").alias("tf_idx", "t"))
    places = threads.select("source", "run_idx", "result_idx", "ruleId", "message", "flow_idx", "tf_idx", F.posexplode("t.locations").alias("loc_idx", "l"))
    p = "l.location.physicalLocation"
    number = lambda name: F.coalesce(F.col(f"{p}.region.{name}"), F.lit(0)).alias(name)
    return places.where(f"{p}.region is not null and {p}.artifactLocation is not null").select("source", "run_idx", "result_idx", F.col("ruleId").alias("rule_id"), "message", "flow_idx", "tf_idx", "loc_idx", clean_uri(F.col(f"{p}.artifactLocation.uri")).alias("uri"), number("startLine"), number("startColumn"), number("endColumn"), F.col("l.location.message.text").alias("label"))


def path_json(spark: SparkSession, path: str) -> DataFrame:
    """A row a step of a propagation path; code longer than ``CODE_CHARS`` is cut and says its size."""
    doc = spark.read.schema(f"`propagation path` array<struct<`propagation step`: int, `from`: {POINT}, `to`: {POINT}>>").json(path, multiLine=True)
    steps = doc.select(F.input_file_name().alias("path_id"), F.posexplode("propagation path").alias("idx", "s"))
    code = lambda side: F.when(F.length(f"s.{side}.relatedCode") > CODE_CHARS, F.concat(F.substring(f"s.{side}.relatedCode", 1, CODE_CHARS), F.lit(" ["), F.length(f"s.{side}.relatedCode"), F.lit("]"))).otherwise(F.col(f"s.{side}.relatedCode"))
    named = lambda side: F.col(f"s.{side}").withField("functionName", F.coalesce(f"s.{side}.functionName", F.lit(""))).alias(side)
    return steps.select("path_id", "idx", F.col("s.propagation step").alias("flowstep"), named("from"), named("to"), (code("from") == code("to")).alias("same_function"))


def symbols(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A symbol table; rows that are short or without a name are left out."""
    schema = SYMBOLS[kind]
    last = schema.split(",")[-1].split()[0]
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, escape='"').where(f"name is not null and name <> '' and {last} is not null")


def source_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of source files, lines from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")


def latest(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The last row written of each key."""
    payload = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*payload), ordinal).alias("p")).select(*key, *[f"p.{c}" for c in payload])
