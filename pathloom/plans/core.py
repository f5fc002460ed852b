"""Plans as named SQL views over domain tables.

A plan is a SELECT over other plans or over base tables.  ``compile_sql`` gathers the
plans that a query needs into one WITH statement, for Spark or for DuckDB; the few
constructs that the dialects spell differently are macros, ``@name(a¦b¦c)@``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, str] = {}
#: Plans that Spark computes by another statement with the same rows; the oracle keeps the plain one.
SPARK: dict[str, str] = {}
#: Plans that only Spark's statements read: no queries, and not for the oracle.
INNER: set[str] = set()

MACROS = {
    "spark": {
        "chain": lambda x, sep, order: f"array_join(transform(array_sort(collect_list(struct({order} as o, {x} as x))), e -> e.x), '{sep}')",
        "extract": lambda x, pattern, group: f"regexp_extract({x}, r'{pattern}', {group})",
        "series": lambda low, high: f"explode(sequence(cast({low} as bigint), cast({high} as bigint)))",
        "lines": lambda x: f"explode(split({x}, '\\n', -1))",
        "numbered": lambda x: f"posexplode(split({x}, '\\n', -1)) as (n, line)",
        "matches": lambda x, pattern: f"{x} rlike r'{pattern}'",
        "sha": lambda x: f"sha2({x}, 256)",
        "each": lambda x, pattern, group: f"explode(regexp_extract_all({x}, r'{pattern}', {group}))",
    },
    "duckdb": {
        "chain": lambda x, sep, order: f"string_agg({x}, '{sep}' order by {order})",
        "extract": lambda x, pattern, group: f"regexp_extract({x}, '{pattern}', {group})",
        "series": lambda low, high: f"unnest(generate_series(cast({low} as bigint), cast({high} as bigint)))",
        "lines": lambda x: f"unnest(string_split({x}, chr(10)))",
        "numbered": lambda x: f"generate_subscripts(string_split({x}, chr(10)), 1) - 1 as n, unnest(string_split({x}, chr(10))) as line",
        "matches": lambda x, pattern: f"regexp_matches({x}, '{pattern}')",
        "sha": lambda x: f"sha256({x})",
        "each": lambda x, pattern, group: f"unnest(regexp_extract_all({x}, '{pattern}', {group}))",
    },
}


def plan(name: str, sql: str, spark: str | None = None) -> None:
    PLANS[name] = sql.strip()
    if spark:
        SPARK[name] = spark.strip()


def inner(name: str, sql: str) -> None:
    PLANS[name] = sql.strip()
    INNER.add(name)


def words(text: str) -> list[str]:
    return re.findall(r"(?:from|join)\s+([a-z_][a-z0-9_]*)", text, re.I)


def reached(text: str, given: frozenset[str]) -> set[str]:
    """The tables of ``given`` that a statement comes down to."""
    seen, todo = set(), words(text)
    while todo:
        word = todo.pop()
        if word not in seen:
            seen.add(word)
            todo += words(PLANS[word]) if word in PLANS and word not in given else []
    return seen & given


def body_of(name: str, dialect: str, given: frozenset[str] = frozenset()) -> str:
    """The plan's statement.  Where Spark's own would pass over a table that is ``given`` for a plan, it's the plain one."""
    if dialect != "spark" or name not in SPARK or not reached(PLANS[name], given) <= reached(SPARK[name], given):
        return PLANS[name]
    return SPARK[name]


def needed(sql: str, tables: set[str], dialect: str = "spark", given: frozenset[str] | None = None) -> list[str]:
    """The plans that ``sql`` uses, each after those that it uses itself."""
    out: list[str] = []
    given = frozenset(tables) if given is None else given

    def visit(text: str, path: tuple[str, ...]) -> None:
        for word in words(text):
            if word in PLANS and word not in out and word not in path and word not in tables:
                visit(body_of(word, dialect, given), (*path, word))
                out.append(word)

    visit(sql, ())
    return out


def compile_sql(name: str, dialect: str, tables: set[str] = frozenset(), given: frozenset[str] | None = None) -> str:
    """One statement for the plan ``name``; plans named in ``tables`` are base tables instead (``given``: those that aren't
    written plans themselves)."""
    given = frozenset(tables) if given is None else given
    body = body_of(name, dialect, given)
    parts = [f"{n} as (\n{body_of(n, dialect, given)}\n)" for n in needed(body, tables, dialect, given) if n != name]
    text = ("with " + ",\n".join(parts) + "\n" if parts else "") + body
    macros = MACROS[dialect]
    return re.sub(r"@(\w+)\((.*?)\)@", lambda m: macros[m[1]](*[x.strip() if m[1] != "chain" or i != 1 else x for i, x in enumerate(m[2].split("¦"))]), text, flags=re.S)


#: Plans that Spark would compute anew for each reader: where a query reads one more than once, it's written as a table and
#: read from there.  Steps and points of paths aren't among them, since a table of them would be shuffled again by path, and
#: what follows from a row of a path or of its keys isn't either.
SHARED = ("call_edge", "related_step", "cross_step", "depth", "lca", "cut", "path_row", "path_key", "logic_unit", "connection_edge", "bb_edge", "bb_flags", "resolved_location", "unit_constraint", "merged_constraint", "must_constraint", "coverage", "macro_first")

#: Shared plans that are far smaller than what they come of; written even for one reader, since their files' size tells Spark whether
#: to send them to everyone instead of dealing out anew what meets them.
REDUCED = ("call_edge", "macro_first")

_written: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, in a single process, a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='pathloom-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def written(spark: SparkSession, name: str, text: str, tables: dict[str, DataFrame], base: tuple) -> DataFrame:
    """The plan as a table, computed once for the same inputs in a session; ``forget`` drops what is known."""
    key = (spark.sparkContext.applicationId, name, base)
    if key not in _written:
        df = frame(spark, text, tables)
        path = f"{shared_dir(spark)}/plans/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        _written[key] = spark.read.schema(df.schema).parquet(path)
    return _written[key]


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table."""
    path = f"{shared_dir(df.sparkSession)}/plans/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Drops the tables written so far, files included."""
    for df in _written.values():
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.clear()


def stamp(df: DataFrame) -> tuple:
    """The files of a table with their sizes and times: another content under the same names is another table.  One listing
    a folder, none a file."""
    spark, out = df.sparkSession, {}
    files = set(df.inputFiles())
    for folder in {f.rpartition("/")[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            out[folder, status.getPath().toUri().getRawPath().rpartition("/")[2]] = (status.getLen(), status.getModificationTime())
    return tuple((f, *out[tuple(f.rpartition("/")[::2])]) for f in sorted(files))


def frame(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A statement over DataFrames by name."""
    used = set(re.findall(r"(?:from|join)\s+([a-z_][a-z0-9_]*)", text, re.I))
    given = {k: v for k, v in tables.items() if k in used}
    text = text.replace("{", "{{").replace("}", "}}")
    for k in given:
        text = re.sub(rf"((?:from|join)\s+){k}\b", rf"\1{{{k}}}", text, flags=re.I)
    return spark.sql(text, **given)


def shared(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The plan as a written table, computed once for the same inputs in a session."""
    used = set(re.findall(r"(?:from|join)\s+([a-z_][a-z0-9_]*)", compile_sql(name, "spark"), re.I))
    tables = {k: v for k, v in tables.items() if k in used}
    base = tuple(sorted((k, df.semanticHash(), stamp(df)) for k, df in tables.items()))
    return written(spark, name, compile_sql(name, "spark", set(tables)), tables, base)


def repeated(name: str, given: frozenset[str]) -> list[str]:
    """The shared plans that the statement of ``name`` would compute more than once or that are reduced, each after those that it uses."""
    order, times = needed(body_of(name, "spark", given), set(given), given=given), Counter({name: 1})
    for n in (name, *reversed(order)):
        for word in words(body_of(n, "spark", given)):
            if word in order:
                times[word] += 1 if n in SHARED else times[n]
    return [n for n in order if n in SHARED and n != name and times[n] > (n not in REDUCED)]


def run(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The plan as a DataFrame over ``tables``: base tables, or domain tables that stand in for a plan."""
    base = tuple(sorted((k, df.semanticHash(), stamp(df)) for k, df in tables.items()))
    given, tables = frozenset(tables), dict(tables)
    for n in repeated(name, given):
        tables[n] = written(spark, n, compile_sql(n, "spark", set(tables), given), tables, base)
    return frame(spark, compile_sql(name, "spark", set(tables), given), tables)
