"""Queries that write a domain view in a file format and read it with the library's reader, or write it with a sink
and read that back; the oracle is the view itself, so a reader or sink that loses or changes a row shows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, readers, sinks
from .core import compile_sql, kept, plan, shared_dir

plan("rows_functionlist", "select name || cast(ordinal as string) as name, qname as qualified_name, file_path, cast(start_line as int) as start_line, cast(end_line as int) as end_line from function_def")
plan("rows_function_use_def", "select name || cast(ordinal as string) as name, qname as qualified_name, base as use_file, cast(start_line + 3 as int) as use_line, file_path as def_file, cast(start_line as int) as def_start, cast(end_line as int) as def_end from function_def")
plan("rows_macros", "select name, body || ', \"' || cast(ordinal as string) || '\"' as body, base as file_path, cast(line as int) as start_line, cast(line + 1 as int) as end_line from macro_def")
plan("rows_macro_use_def", "select name, use_file, cast(use_line as int) as use_line, def_file, cast(ordinal as int) as def_line, body from macro_use")
plan("rows_globalvars", "select name, 'ns::' || name as qualified_name, type_name, 'v.c' as file_path, cast(ordinal as int) as start_line, cast(ordinal as int) as end_line from global_var")
plan("rows_classes", "select name, qname as qualified_name, 'k.cc' as file_path, cast(ordinal as int) as start_line, cast(ordinal + 9 as int) as end_line from class_def")
plan("rows_basic_blocks", "select cast(fn as string) as function_qualified_name, 'f.c' as file_path, bb_id, is_entry = 1 as is_entry, is_exit = 1 as is_exit from block")
plan("rows_bb_edges", "select cast(fn as string) as function_qualified_name, cast(src as string) as from_bb_id, cast(dst as string) as to_bb_id, etype as edge_type from bb_edge")
plan("rows_conditions", "select cast(fn as string) as function_qualified_name, 'f.c' as file_path, cast(block as string) as bb_id, cast(true_block as string) as true_bb_id, cast(false_block as string) as false_bb_id from bb_condition")
plan("rows_loops", "select cast(fn as string) as function_qualified_name, cast(dst as string) as loop_start_bb_id, cast(min(src) as string) as loop_exit_bb_id, cast(max(src) as string) as loop_back_bb_id from back_edge group by fn, dst")
plan("rows_functions", "select qname || cast(ordinal as string) as qualified_name, file_path, cast(start_line as int) as start_line, cast(end_line as int) as end_line, cast(start_line as string) || '.1_' || cast(end_line as string) || '.2' as function_id from function_def")
plan("rows_suite", "select distinct 's' || cast(ordinal as string) || '.c' as file, cast(l as int) as line, name as function from (select ordinal, name, @series(start_line % 7¦start_line % 7 + 2)@ as l from function_def) x")
plan("rows_history", "select query, iteration, result_count, category from validation_category")
plan("rows_sarif", "select l.result_idx, l.rule_id, l.flow_idx, l.tf_idx, l.loc_idx, u.path as uri, l.line, l.sc, l.ec, l.label from location l join uri_clean u on u.result_idx = l.result_idx and u.flow_idx = l.flow_idx and u.tf_idx = l.tf_idx and u.loc_idx = l.loc_idx")
plan("rows_query_files", "select distinct file, cast(cwe as int) as cwe from (select 'q' || cast(doc as string) || '.ql' as file, @extract(text¦external/cwe/cwe-0*([0-9]+)¦1)@ as cwe from (select file as doc, text from query_text where text like '%path-problem%') a union all select 'q' || cast(doc as string) || '.ql' as file, @extract(text¦cwe-[0-9]+ external/cwe/cwe-0*([0-9]+)¦1)@ as cwe from (select file as doc, text from query_text where text like '%path-problem%') b) x")
plan("rows_resolved", "select r.uri, case when count(f.file_path) = 1 then min(f.file_path) end as resolved, count(f.file_path) as matches from (select distinct uri, regexp_replace(regexp_replace(uri, '^file:/?', ''), '^/+', '') as clean from location) r left join (select distinct file_path from function_def union select 'old/' || file_path as file_path from function_def where ordinal % 40 = 0) f on f.file_path = r.clean or f.file_path like '%/' || r.clean group by r.uri")
plan("rows_located", "select distinct file_path as asked, 'src/' || file_path as file from (select 'a/' || base as file_path from function_def) x")
plan("rows_token_csv", "select model_name, prompt_tokens, cast(0 as int) as place from token_row union all select 'TOTAL' as model_name, sum(prompt_tokens) as prompt_tokens, cast(1 as int) as place from token_row")
plan("rows_debug_segments", "select path_id, segment, steps, skey from (select path_id, segment, steps, skey, row_number() over (partition by segment order by path_id) as k from segment_key) x where k <= 1000")
plan("rows_decomposition_log", "select 'path_' || cast(path_id as string) || ': ' || coalesce(b_key, '-') || ' | ' || coalesce(i_key, '-') || ' | ' || coalesce(f_key, '-') as value from decomposition")
plan("rows_evaluation", "select kind, file, fn as function, count(*) as hits from labelled_function where kind <> 'unknown' group by kind, file, fn")
plan("rows_patched", "select user_id as report, cast(count(*) as bigint) as total, case when user_id % 2 = 0 then cast(max(event_id) as bigint) else cast(-1 as bigint) end as best from events group by user_id")
plan("rows_debug", "select type, id, detail from (select type, id, detail, row_number() over (partition by type order by id, detail) as k from debug_row) x where k <= 1000 or type = 'context_unit'")
plan("rows_box", "select file, @chain(case line when 2 then substr(text, 3) when 4 then substr(text, 1, 5) else text end¦~¦line)@ as text from source_line where line between 2 and 4 group by file")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def view(name: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..catalog import query

        return query(name)(spark, sf_dir)

    return of


def _symbols(kind: str):
    def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh(spark, kind)
        view(f"rows_{kind}")(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
        return readers.symbols(spark, path, kind)

    return trip


def _graph(kind: str):
    """Every row is written twice, first with another payload: the last one wins."""

    def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, rows = fresh(spark, kind), view(f"rows_{kind}")(spark, sf_dir)
        key, last = files.GRAPH_TABLES[kind][1], rows.columns[-1]
        stale = rows.withColumn(last, F.lit("false" if last == "is_exit" else "stale") if last in ("is_exit", "edge_type", "function_id") else F.lit("stale"))
        rows = rows.withColumn(last, F.col(last).cast("string"))
        stale.withColumn("o", F.lit(0)).unionByName(rows.withColumn("o", F.lit(1))).repartition(*key).sortWithinPartitions("o").drop("o").write.option("header", kind == "functions").csv(path)
        return files.graph_table(spark, path, kind)

    return trip


def scan_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = fresh(spark, "suite"), view("rows_suite")(spark, sf_dir)
    rows.groupBy("function", "file").agg(F.min("line").alias("start"), F.max("line").alias("end")).withColumn("file", F.concat(F.lit("/workspace/"), "file")).write.option("header", True).csv(path)
    return files.suite_functions(spark, path).withColumn("file", F.regexp_replace("file", "^/", ""))


def scan_suite_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "suite")
    view("rows_suite")(spark, sf_dir).write.option("header", True).csv(path)
    return files.suite_functions(spark, path)


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "history")
    sinks.json_rows(view("rows_history")(spark, sf_dir), path)
    return files.history(spark, path)


def scan_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of SARIF 2.1.0, one a result, read back as locations."""
    path, rows = fresh(spark, "sarif"), view("location")(spark, sf_dir)
    place = F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("line").cast("int").alias("startLine"), F.col("sc").cast("int").alias("startColumn"), F.col("ec").cast("int").alias("endColumn")).alias("region"))
    point = F.struct("loc_idx", F.struct(F.struct(place.alias("physicalLocation"), F.struct(F.col("label").alias("text")).alias("message")).alias("location")).alias("p"))
    listed = lambda items, name: F.struct(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["p"]).alias(name))
    threads = rows.groupBy("result_idx", "rule_id", "flow_idx", "tf_idx").agg(listed(point, "locations").alias("p"))
    flows = threads.groupBy("result_idx", "rule_id", "flow_idx").agg(listed(F.struct("tf_idx", "p"), "threadFlows").alias("p"))
    results = flows.groupBy("result_idx", "rule_id").agg(listed(F.struct("flow_idx", "p"), "codeFlows").alias("p"))
    run = F.struct(F.array(F.struct(F.col("rule_id").alias("ruleId"), F.struct(F.col("result_idx").cast("string").alias("text")).alias("message"), "p.codeFlows")).alias("results"))
    results.select(F.to_json(F.struct(F.array(run).alias("runs"))).alias("value")).write.text(path)
    read = readers.sarif_lines(spark, path)
    # a reader numbers flows and thread flows from 0 in their order; the view's numbers may begin at 1
    return read.select(F.col("message").cast("bigint").alias("result_idx"), "rule_id", F.col("uri"), F.col("startLine").cast("bigint").alias("line"), F.col("startColumn").cast("bigint").alias("sc"), F.col("endColumn").cast("bigint").alias("ec"), "label", F.col("loc_idx").cast("bigint").alias("loc_idx"))


def scan_query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text

    rows = view("query_text")(spark, sf_dir).where(text.query_kind(F.col("text")) == "path-problem")
    return rows.select(F.concat(F.lit("q"), F.col("file").cast("string"), F.lit(".ql")).alias("file"), F.explode(text.cwe_numbers(F.col("text"))).alias("cwe"))


def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = view("function_def")(spark, sf_dir)
    there = defs.select("file_path").union(defs.where("ordinal % 40 = 0").select(F.concat(F.lit("old/"), "file_path"))).distinct()
    return files.resolved(view("location")(spark, sf_dir).select("uri").distinct(), "uri", there, "file_path")


def path_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = view("function_def")(spark, sf_dir).select("base").distinct()
    asked = bases.select(F.concat(F.lit("a/"), "base").alias("asked"))
    there = bases.select(F.explode(F.array(F.concat(F.lit("src/a/"), "base"), F.concat(F.lit("src/"), "base"))).alias("file"))
    return files.located(asked, "asked", there, "file", "src")


def sink_token_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "tokens")
    sinks.with_summary(view("token_row")(spark, sf_dir).select("model_name", "prompt_tokens"), "model_name", ["prompt_tokens"]).write.option("header", True).csv(path)
    return spark.read.csv(path, header=True, schema="model_name string, prompt_tokens long, place int")


def sink_debug_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "segments")
    sinks.debug_rows(view("segment_key")(spark, sf_dir), "segment", ["path_id"]).select("path_id", "segment", "steps", "skey").write.parquet(path)
    return spark.read.parquet(path)


def sink_decomposition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, none = fresh(spark, "log"), F.lit("-")
    line = F.concat(F.lit("path_"), F.col("path_id").cast("string"), F.lit(": "), F.coalesce("b_key", none), F.lit(" | "), F.coalesce("i_key", none), F.lit(" | "), F.coalesce("f_key", none))
    sinks.text_log(view("decomposition")(spark, sf_dir), path, ["path_id"], line)
    return spark.read.text(path)


def sink_evaluation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "evaluation")
    sinks.evaluation_json(view("labelled_function")(spark, sf_dir).where("kind <> 'unknown'").withColumnRenamed("fn", "function"), path)
    read = spark.read.schema("kind string, functions long, hits long, found array<struct<file: string, function: string, hits: long>>").json(path)
    return read.select("kind", F.explode("found").alias("f")).select("kind", "f.file", "f.function", "f.hits")


def sink_patched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    reports = events.groupBy(F.col("user_id").alias("report")).agg(F.count("*").alias("total")).withColumn("best", F.lit(-1).cast("bigint"))
    metrics = events.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("report")).agg(F.max("event_id").alias("best"))
    return sinks.patched(reports, metrics, ["report"])


def write_conversations(whose: DataFrame, turns: DataFrame, path: str, by: list[str], folder: str) -> None:
    """One object each of ``whose`` (``by``, conv_id) with its turns, in folders by ``folder``.  Whose they are is written first, since
    each folder reads it, and of the turns those that somebody has.  Turns are nested by conversation before they meet what has them,
    so no text is shuffled or sorted for each of these; folders are written one by one, since a write by partitions would sort the
    texts.  Those that have one conversation stand together, where compression finds the text again."""
    whose = kept(whose.sortWithinPartitions("conv_id"), "whose")
    talks = kept(sinks.nested(turns.join(whose.select("conv_id").distinct(), "conv_id", "left_semi"), ["conv_id"], "conversation_history"), "talk")
    for (value,) in whose.select(folder).distinct().collect():
        own = whose.where(F.col(folder) == value).join(talks, "conv_id").select(*(c for c in by if c != folder), "conversation_history")
        own.write.option("ignoreNullFields", "false").option("compression", "gzip").json(f"{path}/{folder}={value}")


def _conversations(name: str, whose: str, by: list[str], folder: str):
    """Turns nested by unit or path, written as one object each in folders by phase, and read back as turns."""

    def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
        owners, path = view(whose)(spark, sf_dir), fresh(spark, name)
        turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
        write_conversations(owners, turns, path, by, folder)
        kinds = dict(owners.dtypes)
        fields = ", ".join(f"{c}: {k}" for c, k in turns.dtypes if c != "conv_id")
        read = spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in by) + f", conversation_history array<struct<{fields}>>").json(path)
        return read.select(*by, F.explode("conversation_history").alias("t")).select(*by, "t.*")

    return trip


def sink_debug_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "debug")
    sinks.debug_rows(view("debug_row")(spark, sf_dir), "type", ["id", "detail"]).write.partitionBy("type").parquet(path)
    return spark.read.parquet(path).select("type", "id", "detail")


def source_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view("source_line")(spark, sf_dir)
    boxes = lines.select("file").distinct().selectExpr("file", "2 as start_line", "3 as start_col", "4 as end_line", "5 as end_col")
    return files.box(lines, boxes).select("file", F.replace("text", F.lit("\n"), F.lit("~")).alias("text"))


def _json_sink(name: str):
    """A plan written as JSON lines and read back."""

    def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, path = view(name)(spark, sf_dir), fresh(spark, name)
        sinks.json_rows(rows, path)
        return spark.read.schema(rows.schema).json(path)

    return trip


TRIPS = {f"scan_{k}": (_symbols(k), f"rows_{k}") for k in readers.SYMBOLS}
TRIPS |= {f"scan_graph_{k}": (_graph(k), f"rows_{k}") for k in files.GRAPH_TABLES}
TRIPS |= {f"sink_{n}": (_json_sink(p), p) for n, p in {"statistics": "unit_stats", "connections": "connection_edge", "contexts": "debug_contexts", "run_header": "debug_summary", "reasoning_index": "schedule", "path_results": "path_result", "unit_results": "unit_result", "history": "iteration_report", "merged_constraints": "merged_constraint"}.items()}
TRIPS |= {"scan_suite": (scan_suite, "rows_suite"), "scan_suite_named": (scan_suite_named, "rows_suite"), "scan_history": (scan_history, "rows_history"), "scan_query_files": (scan_query_files, "rows_query_files"), "path_resolution": (path_resolution, "rows_resolved"), "path_location": (path_location, "rows_located"), "sink_token_csv": (sink_token_csv, "rows_token_csv"), "sink_debug_segments": (sink_debug_segments, "rows_debug_segments"), "sink_decomposition_log": (sink_decomposition_log, "rows_decomposition_log"), "sink_evaluation_json": (sink_evaluation_json, "rows_evaluation"), "sink_patched_report": (sink_patched_report, "rows_patched"), "source_box": (source_box, "rows_box"), "scan_sarif": (scan_sarif, "rows_sarif")}


TRIPS |= {"sink_unit_conversations": (_conversations("unit_turn", "unit_talk", ["segment", "unit_key"], "segment"), "unit_turn"), "sink_path_conversations": (_conversations("path_turn", "path_talk", ["path_id", "phase", "unit_key"], "phase"), "path_turn"), "sink_debug_rows": (sink_debug_rows, "rows_debug")}


def queries() -> dict:
    return {name: trip for name, (trip, _) in TRIPS.items()}


def oracles() -> dict[str, str]:
    found = {name: compile_sql(of, "duckdb") for name, (_, of) in TRIPS.items()}
    found["scan_sarif"] = f"select result_idx, rule_id, uri, line, sc, ec, label, loc_idx from ({found['scan_sarif']}) x"
    return found
