"""Scalar columns over text and names that several operators of the path analysis use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of query texts.
CWE_TAG = r"external/cwe/cwe-(\d+)"
KIND_TAG = r"@kind\s+([\w-]+)"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def split_id(function_id: Column) -> Column:
    """``fn@file`` as a struct; the last ``@`` separates, an id without one has no file."""
    parts = lambda group: F.regexp_extract(function_id, "^(.*)@([^@]*)$", group)
    apart = function_id.contains("@")
    return F.struct(F.when(apart, parts(1)).otherwise(function_id).alias("fn"), F.when(apart, parts(2)).otherwise(F.lit("")).alias("file"))


def block_context(block: Column) -> Column:
    """The part of a block id that names its loop iteration, or ``original``."""
    found = F.regexp_extract(block, "(_L.*)$", 1)
    return F.when(found == "", F.lit("original")).otherwise(found)


def valid_path(blocks: Column) -> Column:
    """At least four fifths of the blocks of a path are distinct."""
    return 10 * F.size(F.array_distinct(blocks)) >= 8 * F.size(blocks)


def variable_slice(line: Column, start: Column, end: Column) -> Column:
    """Columns ``start`` to ``end`` of a line, from 1, the last one excluded."""
    return F.substring(line, start, F.greatest(end - start, F.lit(0)))


def cwe_numbers(query_text: Column) -> Column:
    """The distinct weakness numbers of a query's tags, ascending."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(query_text, F.lit(CWE_TAG), F.lit(1)), lambda x: x.cast("int"))))


def query_kind(query_text: Column) -> Column:
    return F.nullif(F.regexp_extract(query_text, KIND_TAG, 1), F.lit(""))


def numbered(lines: Column, first: Column) -> Column:
    """An array of lines as one text, each with its number."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x)), "\n")
