"""Re-scoring of stored result files: all folders of a run in one job.

A run keeps its results under ``CWE-<number>_<query>/initial`` and ``CWE-<number>_<query>/iteration_<n>``.  ``stored``
reads every document once and counts its places; ``hits`` gives each place the suite's function around it, ``scores``
the metrics of a folder, ``report`` what changed from the first to the last iteration of a query.  ``rescore`` writes
them by folder: what is scored again replaces what was stored for it, all else stays, so the last write wins and a
repeated run changes nothing.  The files of one folder are scored together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import kept, plan, shared_dir
from ..sources import readers, sinks

FOLDER = r"CWE-0*(\d+)_([^/]+)/(?:[^/=]+=)?(initial|iteration_(\d+))/"
KEY = ["cwe", "query", "iteration"]
#: Lines beside a place that are tried, nearer ones first and of two the one below.
NEAR = 5
METRICS = "true_positive_count false_positive_count true_positive_rate false_positive_rate good_result_count bad_result_count unknown_result_count total_alerts unique_functions_with_alerts recall precision f1_score total_bad_functions total_good_functions".split()

MARK = "named_struct('what', {what}, 'uri', cast(null as string), 'line', cast(null as int))"
PLACE = "named_struct('what', 'place', 'uri', coalesce(l.location.physicalLocation.artifactLocation.uri, ''), 'line', coalesce(l.location.physicalLocation.region.startLine, 0))"
THREADS = "flatten(transform(coalesce(d.runs, array()), r -> flatten(transform(coalesce(r.results, array()), x -> flatten(transform(coalesce(x.codeFlows, array()), f -> coalesce(f.threadFlows, array())))))))"
SEEN = f"concat(array({MARK.format(what=repr('file'))}), flatten(transform({THREADS}, t -> concat(array({MARK.format(what=repr('thread'))}), transform(coalesce(t.locations, array()), l -> {PLACE})))))"


def stored(spark: SparkSession, root: str, pattern: str = "*.sarif", lines: bool = False) -> DataFrame:
    """(cwe, query, iteration, what, uri, line, n): how often a folder's documents hold each place, and, as rows without
    a place, its threads and its documents.  The first run is iteration 0.  A document is a file, or a line of one; one
    that can't be read counts without threads.  Files outside such folders are left out."""
    texts = spark.read.text(root, wholetext=not lines, recursiveFileLookup=True, pathGlobFilter=pattern)
    part = lambda n: F.regexp_extract(F.col("_metadata.file_path"), FOLDER, n)
    docs = texts.select(part(1).try_cast("long").alias("cwe"), part(2).alias("query"), F.when(part(3) == "initial", F.lit(0)).otherwise(part(4).try_cast("long")).cast("long").alias("iteration"), F.from_json("value", readers.SARIF).alias("d"))
    return docs.where("cwe is not null").select(*KEY, F.explode(F.expr(SEEN)).alias("p")).groupBy(*KEY, "p.what", "p.uri", "p.line").agg(F.count("*").alias("n"))


def of_suite(uri: Column) -> Column:
    """Places count whose path is one of the suite's; main files don't."""
    return (uri.contains("/juliet-test-suite-c/") | uri.startswith("s") | uri.rlike(r"CWE\d+_")) & ~uri.endswith("main.cpp") & ~uri.endswith("main_linux.cpp")


def kind_of(name: Column) -> Column:
    return F.when(F.lower(name).contains("bad"), "bad").when(F.lower(name).contains("good"), "good").otherwise("unknown")


def suites(spark: SparkSession, path: str) -> DataFrame:
    """(cwe, file, line, function) of tables ``cwe<number>_functions.csv`` with (function, file, start, end) by place and
    a header; of several functions on a line the last one."""
    from ..sources.files import in_file_order

    rows = spark.read.csv(path, header=True, schema="function string, file string, start int, end int", enforceSchema=True, recursiveFileLookup=True)
    rows = rows.select(F.regexp_extract("_metadata.file_path", r"cwe(\d+)_functions", 1).try_cast("long").alias("cwe"), "*", in_file_order().alias("at")).where("cwe is not null and start <= coalesce(end, start)")
    spread = rows.select("cwe", "file", F.explode(F.sequence("start", F.coalesce("end", "start"))).alias("line"), "function", "at").where("coalesce(function, '') <> ''")
    return readers.latest(spread, ["cwe", "file", "line"], "at")


def around(asked: DataFrame, suite: DataFrame) -> DataFrame:
    """(cwe, uri, line, function) of distinct places (cwe, uri, line).  A path below the test folders stands for the whole
    one; of several the greatest."""
    short = F.regexp_extract("file", r"/testcases/[^/]+/(.+)$", 1)
    whole = suite.select("cwe", "file").distinct().select("cwe", short.alias("uri"), "file").where("uri <> ''").groupBy("cwe", "uri").agg(F.max("file").alias("whole"))
    probes = F.explode(F.sequence(F.lit(-NEAR), F.lit(NEAR))).alias("off")
    tried = asked.join(whole, ["cwe", "uri"], "left").select("cwe", "uri", "line", F.coalesce("whole", "uri").alias("file"), probes)
    met = tried.withColumnRenamed("line", "__at").withColumn("line", F.col("__at") + F.col("off")).join(suite, ["cwe", "file", "line"])
    return met.groupBy("cwe", "uri", F.col("__at").alias("line")).agg(F.min_by("function", F.struct(F.abs("off"), -F.col("off"))).alias("function"))


def hits(seen: DataFrame, suite: DataFrame) -> DataFrame:
    """(cwe, query, iteration, kind, file, function, alerts).  Places without a function around them are ``unknown``; where
    a weakness has no suite, or a place has no line, the file's name tells the kind."""
    places = seen.where("what = 'place'").where(of_suite(F.col("uri"))).select(*KEY, "uri", "line", "n")
    found = around(places.where("line > 0").select("cwe", "uri", "line").distinct(), suite)
    known = suite.select("cwe").distinct().withColumn("listed", F.lit(True))
    met = places.join(found, ["cwe", "uri", "line"], "left").join(F.broadcast(known), "cwe", "left")  # one row a weakness
    by_name = (F.col("line") > 0) & F.col("listed").isNotNull()
    kind = F.when(by_name, kind_of(F.coalesce("function", F.lit("")))).otherwise(kind_of(F.element_at(F.split("uri", "/"), -1)))
    rows = met.select(*KEY, kind.alias("kind"), F.col("uri").alias("file"), F.coalesce(F.when(by_name, F.col("function")), F.lit("unknown")).alias("function"), "n")
    return rows.groupBy(*KEY, "kind", "file", "function").agg(F.sum("n").alias("alerts"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def rounded(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100.0


def scores(seen: DataFrame, found: DataFrame, suite: DataFrame) -> DataFrame:
    """One row a folder, ``METRICS`` by its distinct (file, function); rates in percent with two decimals.  Of the suite
    count the functions whose names say their kind."""
    count = lambda kind: F.coalesce(F.col(kind), F.lit(0)).cast("long")
    by_kind = found.groupBy(*KEY).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("bad", "good", "unknown")])
    folders = seen.groupBy(*KEY).agg(F.sum(F.when(F.col("what") == "thread", F.col("n")).otherwise(0)).alias("total_alerts"))
    named = suite.where("contains(file, '/juliet-test-suite-c/')").select("cwe", "file", "function").distinct().withColumn("kind", kind_of(F.col("function")))
    totals = named.groupBy("cwe").agg(*[F.count_if(F.col("kind") == k).alias(f"total_{k}_functions") for k in ("bad", "good")])
    rows = folders.join(by_kind, KEY, "left").join(totals, "cwe", "left")
    bad, good, unknown, all_bad, all_good = count("bad"), count("good"), count("unknown"), count("total_bad_functions"), count("total_good_functions")
    recall, precision = percent(bad, all_bad), percent(bad, bad + good)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    values = {
        "true_positive_count": bad, "false_positive_count": good, "true_positive_rate": rounded(recall), "false_positive_rate": rounded(percent(good, all_good)), "good_result_count": good, "bad_result_count": bad,
        "unknown_result_count": unknown, "total_alerts": F.col("total_alerts"), "unique_functions_with_alerts": bad + good + unknown, "recall": rounded(recall), "precision": rounded(precision), "f1_score": rounded(f1), "total_bad_functions": all_bad, "total_good_functions": all_good,
    }
    return rows.select(*KEY, *[values[m].alias(m) for m in METRICS])


REPORTED = {"true_positive": "true_positive_count", "false_positive": "false_positive_count", "unknown_result": "unknown_result_count", "true_positive_rate": "true_positive_rate", "false_positive_rate": "false_positive_rate", "good_result": "good_result_count", "bad_result": "bad_result_count", "total_threadflows": "total_alerts"}


def report(scored: DataFrame) -> DataFrame:
    """One row a query: its first and last metrics (null where it has none) and the improvement where it has both.  The
    last iteration is the one with the greatest number."""
    first, last = F.col("iteration") == 0, F.struct("iteration", *REPORTED.values())
    both = scored.groupBy("cwe", "query").agg(F.max(F.when(first, last)).alias("a"), F.max(F.when(~first, last)).alias("b"))
    change = lambda m: F.col(f"b.{m}") - F.col(f"a.{m}")
    share = lambda m: F.when(change(m).isNotNull(), percent(change(m), F.col(f"a.{m}")))
    sides = [F.col(f"{s}.{m}").alias(f"{name}_{out}") for name, s in (("initial", "a"), ("final", "b")) for out, m in REPORTED.items() if (name, out) != ("initial", "total_threadflows")]
    gains = [c.alias(f"{out}_improvement{suffix}") for out in ("true_positive", "false_positive") for suffix, c in (("", change(REPORTED[out])), ("_percentage", share(REPORTED[out])))]
    return both.select("cwe", "query", F.col("b.iteration").alias("last_iteration"), *sides, *gains)


def rescore(spark: SparkSession, root: str, suite: DataFrame, target: str, pattern: str = "*.sarif", lines: bool = False, query: str | None = None) -> DataFrame:
    """Scores what lies under ``root`` (of one query only, if its name is given), writes ``target``/hits, /results and
    /reports and returns the scores.  Results keep the columns that a log stored there has besides."""
    seen = stored(spark, root, pattern, lines)
    seen = kept(seen.where(F.col("query") == query) if query else seen, "seen")
    found = kept(hits(seen, suite), "hits")
    scored = kept(scores(seen, found, suite).withColumns({"result_count": F.col("true_positive_count"), "threadflow_count": F.col("total_alerts")}), "scores")
    sinks.replace_results(found, f"{target}/hits", KEY)
    sinks.replace_results(_over(spark, f"{target}/results", scored, KEY), f"{target}/results", KEY)
    sinks.replace_results(_over(spark, f"{target}/reports", report(scored), ["cwe", "query"]), f"{target}/reports", ["cwe", "query"])
    return scored


def _over(spark: SparkSession, path: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with what else is stored for their keys, an error excepted."""
    from ..sources.files import existing

    if not existing(spark, f"{path}/*"):
        return rows
    before = spark.read.parquet(path)
    rest = [c for c in before.columns if c not in rows.columns and c != "error"]
    if not rest:
        return rows
    types = dict(rows.dtypes)
    old = before.select(*[F.col(c).cast(types[c]).alias(c) for c in key], *rest)
    return kept(rows.join(old, key, "left"), "results")


# What the queries score: documents of results written to folders, and the suite's tables beside them.
plan("stored_hit", """
select p.cwe, p.query, p.iteration, case when p.line > 0 then case when lower(f.function) like '%bad%' then 'bad' when lower(f.function) like '%good%' then 'good' else 'unknown' end
            else case when lower(split_part(p.uri, '/', -1)) like '%bad%' then 'bad' when lower(split_part(p.uri, '/', -1)) like '%good%' then 'good' else 'unknown' end end as kind,
       p.uri as file, coalesce(f.function, 'unknown') as function, cast(sum(p.n) as bigint) as alerts
from (select cwe, query, iteration, uri, line, count(*) as n from stored_place
      where (contains(uri, '/juliet-test-suite-c/') or uri like 's%' or @matches(uri¦CWE[0-9]+_)@) and uri not like '%main.cpp' and uri not like '%main_linux.cpp' group by cwe, query, iteration, uri, line) p
left join (select a.cwe, a.uri, a.line, min_by(s.function, abs(a.off) * 2 + case when a.off < 0 then 1 else 0 end) as function
           from (select x.cwe, x.uri, x.line, o.off, x.line + o.off as probe from (select distinct cwe, uri, line from stored_place where line > 0) x cross join (select @series(-5¦5)@ as off) o) a
           join (select cwe, uri, function, @series(start_line¦end_line)@ as probe from (select cwe, file as uri, function, start_line, end_line from stored_function union all select cwe, @extract(file¦/testcases/[^/]+/(.+)$¦1)@ as uri, function, start_line, end_line from stored_function) y) s
             on s.cwe = a.cwe and s.uri = a.uri and s.probe = a.probe group by a.cwe, a.uri, a.line) f on f.cwe = p.cwe and f.uri = p.uri and f.line = p.line
group by 1, 2, 3, 4, 5, 6""")
plan("stored_score", """
select cwe, query, iteration, bad as true_positive_count, good as false_positive_count, floor(recall * 100 + 0.5) / 100.0 as recall, floor(precision_pct * 100 + 0.5) / 100.0 as precision,
       floor(case when total_good > 0 then 100.0 * good / total_good else 0.0 end * 100 + 0.5) / 100.0 as false_positive_rate, floor(case when precision_pct + recall > 0 then 2 * precision_pct * recall / (precision_pct + recall) else 0.0 end * 100 + 0.5) / 100.0 as f1_score,
       unknown as unknown_result_count, bad + good + unknown as unique_functions_with_alerts, total_alerts, total_bad as total_bad_functions, total_good as total_good_functions
from (select t.*, coalesce(h.bad, 0) as bad, coalesce(h.good, 0) as good, coalesce(h.unknown, 0) as unknown, s.total_bad, s.total_good, case when s.total_bad > 0 then 100.0 * coalesce(h.bad, 0) / s.total_bad else 0.0 end as recall,
             case when h.bad + h.good > 0 then 100.0 * h.bad / (h.bad + h.good) else 0.0 end as precision_pct
      from (select cwe, query, iteration, count(distinct result_idx) as total_alerts from stored_place group by cwe, query, iteration) t
      left join (select cwe, query, iteration, count(case when kind = 'bad' then 1 end) as bad, count(case when kind = 'good' then 1 end) as good, count(case when kind = 'unknown' then 1 end) as unknown from stored_hit group by cwe, query, iteration) h on h.cwe = t.cwe and h.query = t.query and h.iteration = t.iteration
      join (select cwe, count(distinct case when lower(function) like '%bad%' then file || function end) as total_bad, count(distinct case when lower(function) like '%good%' and lower(function) not like '%bad%' then file || function end) as total_good from stored_function group by cwe) s on s.cwe = t.cwe) x""")
plan("stored_report", """
select cwe, query, last_iteration, a_tp as initial_true_positive, tp as final_true_positive, tp - a_tp as true_positive_improvement, case when a_tp > 0 then 100.0 * (tp - a_tp) / a_tp else 0.0 end as true_positive_improvement_percentage,
       fp - a_fp as false_positive_improvement, n as final_total_threadflows
from (select cwe, query, max(iteration) as last_iteration, max(case when iteration = 0 then true_positive_count end) as a_tp, max(case when iteration = 0 then false_positive_count end) as a_fp,
             max_by(true_positive_count, iteration) as tp, max_by(false_positive_count, iteration) as fp, max_by(total_alerts, iteration) as n from stored_score group by cwe, query) x""")

SHOWN = {"rescored_hits": "stored_hit", "rescored_results": "stored_score", "rescored_reports": "stored_report"}


def _given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..catalog import query

    return query(name)(spark, sf_dir)


def _rescored(spark: SparkSession, sf_dir: str) -> str:
    """Writes the documents and the suite's tables, scores one query first on its own and then all, and gives the folder."""
    base = f"{shared_dir(spark)}/files/rescore-{uuid.uuid4().hex}"
    region = F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("line").cast("int").alias("startLine")).alias("region"))
    places = _given(spark, sf_dir, "stored_place").groupBy(*KEY, "result_idx").agg(F.collect_list(F.struct(F.struct(region.alias("physicalLocation")).alias("location"))).alias("locations"))
    flow = F.struct(F.array(F.struct(F.array(F.struct(F.col("locations"))).alias("threadFlows"))).alias("codeFlows"))
    stage = F.when(F.col("iteration") == 0, "initial").otherwise(F.concat(F.lit("iteration_"), F.col("iteration").cast("string")))
    docs = places.select(F.concat(F.lit("CWE-0"), F.col("cwe").cast("string"), F.lit("_"), "query").alias("folder"), stage.alias("stage"), F.to_json(F.struct(F.array(F.struct(F.array(flow).alias("results"))).alias("runs"))).alias("value"))
    docs.write.partitionBy("folder", "stage").text(f"{base}/run")
    tables = _given(spark, sf_dir, "stored_function").select(F.concat(F.lit("cwe"), F.col("cwe").cast("string"), F.lit("_functions")).alias("table"), "function", "file", "start_line", "end_line")
    tables.write.partitionBy("table").option("header", True).csv(f"{base}/suite")
    suite = kept(suites(spark, f"{base}/suite"), "suite")
    for only in ("q1", None):
        rescore(spark, f"{base}/run", suite, f"{base}/scored", "*.txt", lines=True, query=only)
    return f"{base}/scored"


def rescored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_rescored(spark, sf_dir)}/hits")
    return rows.select(F.col("cwe").cast("long"), "query", F.col("iteration").cast("long"), "kind", "file", "function", "alerts")


def rescored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_rescored(spark, sf_dir)}/results")
    shown = "true_positive_count false_positive_count recall precision false_positive_rate f1_score unknown_result_count unique_functions_with_alerts total_alerts total_bad_functions total_good_functions".split()
    return rows.select(F.col("cwe").cast("long"), "query", F.col("iteration").cast("long"), *shown)


def rescored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_rescored(spark, sf_dir)}/reports")
    return rows.select(F.col("cwe").cast("long"), "query", "last_iteration", "initial_true_positive", "final_true_positive", "true_positive_improvement", "true_positive_improvement_percentage", "false_positive_improvement", "final_total_threadflows")


QUERIES = (rescored_hits, rescored_results, rescored_reports)


def oracles() -> dict[str, str]:
    from ..plans.core import compile_sql

    return {name: compile_sql(of, "duckdb") for name, of in SHOWN.items()}
