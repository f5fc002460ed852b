"""Sinks: results replaced by project and weakness, capped debug rows, path rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Debug rows kept of each type in a run; types in ``UNCAPPED`` are kept whole.
DEBUG_ROWS = 1000
UNCAPPED = ("context_unit",)


def replace_results(rows: DataFrame, path: str, by: tuple[str, ...] | list[str] = ("project_name", "cwe_code")) -> None:
    """Writes ``rows``; what was stored for a project and weakness that occur in ``rows`` is replaced, the rest stays."""
    # rebalance splits the partitions of a key that holds much more than others
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def debug_rows(rows: DataFrame, type_col: str, order: list[str], keep: int = DEBUG_ROWS) -> DataFrame:
    """The first ``keep`` rows of each type in the given order (the cap is the feature), all of the uncapped types."""
    ranked = rows.where(~F.col(type_col).isin(*UNCAPPED)).withColumn("__k", F.row_number().over(Window.partitionBy(type_col).orderBy(*order)))
    return ranked.where(F.col("__k") <= keep).drop("__k").unionByName(rows.where(F.col(type_col).isin(*UNCAPPED)))


def rewrite_paths(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """``rows`` with the prefix ``old`` of a path column replaced; rows without a path are left out."""
    path = F.col(column)
    return rows.where(path.isNotNull() & (path != "")).withColumn(column, F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path))


def read_through(spark: SparkSession, path: str, compute, **key: str) -> DataFrame:
    """What is stored under ``path`` for the key; where nothing is, ``compute()`` is stored first."""
    from .files import existing

    place = "/".join([path, *[f"{k}={v}" for k, v in key.items()]])
    if not existing(spark, f"{place}/*"):
        rows = compute()
        for k, v in key.items():
            rows = rows.withColumn(k, F.lit(v))
        replace_results(rows, path, tuple(key))
    return spark.read.parquet(place)


def json_rows(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def nested(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """A row a key with its other columns as an ordered array of objects: conversations of a unit, units of a path."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def with_summary(rows: DataFrame, label: str, numbers: list[str]) -> DataFrame:
    """``rows`` and, last, one with the sums of ``numbers``; ``place`` orders them."""
    total = rows.agg(*[F.sum(c).cast(dict(rows.dtypes)[c]).alias(c) for c in numbers]).withColumn(label, F.lit("TOTAL"))
    return rows.withColumn("place", F.lit(0)).unionByName(total.withColumn("place", F.lit(1)), allowMissingColumns=True)


def text_log(rows: DataFrame, path: str, order: list[str], line: F.Column) -> None:
    """Lines in order, in files whose order by name is that of the lines."""
    rows.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def numbered_paths(path_id: F.Column) -> F.Column:
    """``path_12`` as 12: paths are written in the order of their numbers."""
    return F.regexp_extract(path_id.cast("string"), r"(\d+)$", 1).try_cast("bigint")


def evaluation_json(hits: DataFrame, path: str) -> None:
    """Hits (file, function, kind) as one row a kind: its functions, each with its number of hits, and totals."""
    functions = hits.groupBy("kind", "file", "function").agg(F.count("*").alias("hits"))
    json_rows(functions.groupBy("kind").agg(F.count("*").alias("functions"), F.sum("hits").alias("hits")).join(nested(functions, ["kind"], "found"), "kind"), path)


def patched(reports: DataFrame, metrics: DataFrame, key: list[str]) -> DataFrame:
    """``reports`` with the metrics of their key in place of what they held; others stay."""
    new = [c for c in metrics.columns if c not in key]
    renamed = metrics.withColumnsRenamed({c: f"__new_{c}" for c in new})
    out = reports.join(renamed, key, "left")
    kept = [F.coalesce(f"__new_{c}", c).alias(c) if c in new else F.col(c) for c in reports.columns]
    return out.select(*kept, *[F.col(f"__new_{c}").alias(c) for c in new if c not in reports.columns])


def graph_dot(edges: DataFrame) -> DataFrame:
    """(fn, dot): the graph of each function in the DOT language."""
    line = F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('" [label="'), F.col("etype"), F.lit('"];'))
    body = edges.groupBy("fn").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return body.select("fn", F.concat(F.lit('digraph "'), F.col("fn").cast("string"), F.lit('" {\n'), F.col("body"), F.lit("\n}")).alias("dot"))


def by_function(rows: DataFrame, path: str, column: str = "fn", folders: int = 256) -> None:
    """Graphs as a table in a bounded number of folders, each function in one of them."""
    rows.withColumn("part", F.pmod(F.xxhash64(column), F.lit(folders))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
