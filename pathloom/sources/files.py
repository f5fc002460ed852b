"""Readers of lists, graphs, suites, query files and histories, and the resolution of paths."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

#: Columns of the control-flow tables and the key of which the last row wins.
GRAPH_TABLES = {
    "functions": ("qualified_name string, file_path string, start_line int, end_line int, function_id string", ["qualified_name"]),
    "basic_blocks": ("function_qualified_name string, file_path string, bb_id string, is_entry string, is_exit string", ["function_qualified_name", "bb_id"]),
    "bb_edges": ("function_qualified_name string, from_bb_id string, to_bb_id string, edge_type string", ["function_qualified_name", "from_bb_id", "to_bb_id"]),
    "conditions": ("function_qualified_name string, file_path string, bb_id string, true_bb_id string, false_bb_id string", ["function_qualified_name", "bb_id"]),
    "loops": ("function_qualified_name string, loop_start_bb_id string, loop_exit_bb_id string, loop_back_bb_id string", ["function_qualified_name", "loop_start_bb_id"]),
}
#: Prefixes that a scanner's container puts before source paths.
CONTAINER_PREFIXES = ("/results/ai-analysis/sourcecode/", "/results/ai-analysis/", "/results/")
CACHE_SWITCHES = ("1", "true", "yes", "on")


def existing(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there))


def preferred(spark: SparkSession, *paths: str) -> str | None:
    """The first of the paths that exists: precise tables before simple ones."""
    return next((p for p in paths if existing(spark, p)), None)


def discover(folder: str, pattern: str, variable: str = "") -> str | None:
    """The path that an environment variable names, else the first match in a folder by name."""
    return os.environ.get(variable) or next(iter(sorted(glob.glob(f"{folder}/**/{pattern}", recursive=True))), None)


def cache_enabled(variable: str, default: bool = True) -> bool:
    value = os.environ.get(variable)
    return default if value is None else value.strip().lower() in CACHE_SWITCHES


def settings(text: str) -> dict:
    """A flat scanner configuration: ``key: value`` lines and lists of ``- value`` below a key."""
    out: dict = {}
    key = None
    for line in text.split("\n"):
        body = line.split(" #")[0].rstrip()
        if body.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] or []), body.lstrip()[2:].strip().strip("'\"")]
        elif ":" in body and not body.lstrip().startswith("#"):
            key, value = (x.strip().strip("'\"") for x in body.split(":", 1))
            out[key] = value or None
    return out


def in_file_order() -> Column:
    """Where a row of a text file stands; it survives a shuffle."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())


def graph_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A control-flow table: the last row of each key; flags as booleans.  A header row is left out if there is one."""
    schema, key = GRAPH_TABLES[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    rows = spark.read.csv(path, header=False, schema=", ".join(f"{n} string" for n in names)).withColumn("__at", in_file_order())
    rows = rows.where(F.col(names[0]).isNotNull() & (F.col(names[0]) != names[0]))
    out = readers.latest(rows, key, "__at").select(*[F.col(n).try_cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))])
    return out.withColumns({c: F.lower(c) == "true" for c in ("is_entry", "is_exit") if c in names})


def graph_tables(spark: SparkSession, folder: str, target: str) -> None:
    """Reads the control-flow tables that a folder holds and writes each as a table."""
    for kind in GRAPH_TABLES:
        if existing(spark, f"{folder}/{kind}.csv"):
            graph_table(spark, f"{folder}/{kind}.csv", kind).write.mode("overwrite").parquet(f"{target}/{kind}")


def suite_functions(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, function): a row a line of a labelled function; of several on a line the last one.  Files are
    (function, file, start, end) by place, or have named columns file, line, function."""
    named = spark.read.csv(path, header=True, inferSchema=False)
    if {"file", "line", "function"} <= set(named.columns):
        rows = named.select("file", F.col("line").try_cast("int").alias("line"), "function", in_file_order().alias("at"))
    else:
        spans = spark.read.csv(path, header=True, schema="function string, file string, start int, end int", enforceSchema=True).select("*", in_file_order().alias("at")).where("start <= end")
        rows = spans.select("file", F.explode(F.sequence("start", "end")).alias("line"), "function", "at")
    rows = rows.withColumn("file", F.regexp_replace("file", "^/workspace/", "/")).where("line is not null and coalesce(function, '') <> ''")
    return readers.latest(rows, ["file", "line"], "at").select("file", "line", "function")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of propagation paths in one JSON array: (path_idx, steps); items without steps or that are no paths are skipped."""
    kind = f"array<struct<`propagation step`: int, `from`: {readers.POINT}, `to`: {readers.POINT}>>"
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("path_idx", "item"))
    steps = items.select("path_idx", F.from_json("item", f"`propagation path` {kind}", {"mode": "PERMISSIVE"})["propagation path"].alias("steps"))
    return steps.where("steps is not null and size(steps) > 0")


def query_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, cwe) of query files of the kind that follows paths."""
    from ..functions import text

    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.ql").select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.where(text.query_kind(F.col("value")) == "path-problem").select("file", F.explode(text.cwe_numbers(F.col("value"))).alias("cwe"))


def weakness_folders(names: DataFrame, column: str) -> DataFrame:
    """The distinct weakness numbers in names of test folders, ascending."""
    return names.select(F.regexp_extract(column, r"CWE(\d+)", 1).try_cast("int").alias("cwe")).where("cwe is not null").distinct().orderBy("cwe")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Recorded iterations, one JSON object a line."""
    return spark.read.schema("query long, iteration long, result_count long, category string").json(path)


def resolved(paths: DataFrame, column: str, files: DataFrame, file_col: str) -> DataFrame:
    """``paths`` with ``resolved`` and ``matches``: the only file that ends with the path, null for none or several.
    Joined by file name, so only files of one name are compared."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(F.col(column), "^file:/?", ""), "^/+", "")
    asked = paths.select(column).distinct().select(F.col(column).alias("__asked"), clean.alias("__clean"), base(clean).alias("__base"))
    there = files.select(F.col(file_col).alias("__file"), base(F.col(file_col)).alias("__base"))
    fits = (F.col("__file") == F.col("__clean")) | F.endswith("__file", F.concat(F.lit("/"), F.col("__clean")))
    found = asked.join(there, "__base").where(fits).groupBy("__asked").agg(F.count("*").alias("matches"), F.min("__file").alias("__file"))
    out = paths.join(found, F.col(column).eqNullSafe(F.col("__asked")), "left")
    return out.select(*[paths[c] for c in paths.columns], F.when(F.col("matches") == 1, F.col("__file")).alias("resolved"), F.coalesce("matches", F.lit(0)).alias("matches"))


def candidates(path: Column, root: str) -> Column:
    """Where a path of a table may lie below ``root``, best first: as it is, without a container's prefix, by each suffix."""
    relative = F.regexp_replace(path, "^/+", "")
    stripped = [F.when(path.startswith(p), F.substring(path, len(p) + 1, 1 << 30)) for p in CONTAINER_PREFIXES]
    parts = F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    below = F.array_compact(F.array(relative, *stripped))
    return F.array_distinct(F.concat(F.transform(F.filter(F.concat(below, suffixes), lambda x: x != ""), lambda x: F.concat(F.lit(root.rstrip("/") + "/"), x)), F.transform(F.array_compact(F.array(*stripped)), lambda x: F.concat(F.lit("/"), x))))


def located(paths: DataFrame, column: str, files: DataFrame, file_col: str, root: str) -> DataFrame:
    """(path, file): the first candidate of each path that is a file."""
    tried = paths.select(column).distinct().select(column, F.posexplode(candidates(F.col(column), root)).alias("rank", "file"))
    return tried.join(files.select(F.col(file_col).alias("file")).distinct(), "file").groupBy(column).agg(F.min_by("file", "rank").alias("file"))


def box(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """The text of each box (file, start_line, start_col, end_line, end_col): whole lines, cut at both ends."""
    met = lines.join(boxes, "file").where("line between start_line and end_line")
    first = F.when(F.col("line") == F.col("start_line"), F.col("start_col")).otherwise(1)
    last = F.when((F.col("line") == F.col("end_line")) & (F.col("end_col") >= 0), F.col("end_col")).otherwise(F.length("text"))
    cut = met.withColumn("text", F.substring(F.col("text"), first, F.greatest(last - first + 1, F.lit(0))))
    return cut.groupBy("file", "start_line", "start_col", "end_line", "end_col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
