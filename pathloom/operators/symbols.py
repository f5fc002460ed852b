"""Symbol lookups: interval join, fallbacks, nearest lines; evaluation, cache, iterations, text."""

from ..plans.core import plan



def around(places: str) -> str:
    """(file_path, base, line, near, any): the first definition around each distinct place whose path fits the place's, and the first of all.
    Definitions over the same lines of a file are one, so neither copies of sites nor of definitions are met with each other."""
    return f"""
      select u.file_path, u.base, u.line, min(case when right(f.file_path, length(u.file_path)) = u.file_path or right(u.file_path, length(f.file_path)) = f.file_path then f.ordinal end) as near, min(f.ordinal) as any
      from ({places}) u join (select d.ordinal, d.file_path, d.base, d.start_line, d.end_line, @series(floor(d.start_line / 64)¦floor(d.end_line / 64))@ as bin
                              from (select file_path, base, start_line, end_line, min(ordinal) as ordinal from function_def group by file_path, base, start_line, end_line) d) f
        on f.base = u.base and f.bin = cast(floor(u.line / 64) as bigint) and u.line between f.start_line and f.end_line group by u.file_path, u.base, u.line"""


# Files are cut into bins of 64 lines; an ordinal names one definition, so the first one is found by partial minima.
plan("enclosing_function", """
select b.site, b.line, f.name, f.qname, f.start_line, f.end_line
from (select u.site, u.line, coalesce(min(case when right(f.file_path, length(u.file_path)) = u.file_path or right(u.file_path, length(f.file_path)) = f.file_path then f.ordinal end), min(f.ordinal)) as ordinal
      from use_site u join (select d.ordinal, d.file_path, d.base, d.start_line, d.end_line, @series(floor(d.start_line / 64)¦floor(d.end_line / 64))@ as bin from function_def d) f
        on f.base = u.base and f.bin = cast(floor(u.line / 64) as bigint) and u.line between f.start_line and f.end_line
      group by u.site, u.line) b
join function_def f on f.ordinal = b.ordinal""", spark=f"""
select b.site, b.line, f.name, f.qname, f.start_line, f.end_line
from (select u.site, u.line, coalesce(min(p.near), min(p.any)) as ordinal from use_site u
      join ({around("select distinct file_path, base, line from use_site")}) p on p.base = u.base and p.line = u.line and p.file_path <=> u.file_path group by u.site, u.line) b
join function_def f on f.ordinal = b.ordinal""")
# Definitions are reduced to the first of each key before they meet the places that ask for them.
plan("function_by_name", """
select u.site, f.ordinal, f.qname, f.start_line
from use_site u join (select name, base, min(ordinal) as ordinal, min_by(qname, ordinal) as qname, min_by(start_line, ordinal) as start_line from function_def group by name, base) f on f.name = u.name and f.base = u.base""")
plan("macros_at_location", "select base, line, name, min_by(body, ordinal) as body from macro_def group by base, line, name")
plan("symbol_fallback", """
select site, name, kind, detail from (
  select u.site, u.name, s.kind, s.detail, row_number() over (partition by u.site order by s.priority, s.ordinal) as k
  from use_site u join (
    select 1 as priority, 'function' as kind, name, min(ordinal) as ordinal, min_by(qname, ordinal) as detail from function_def group by name
    union all select 2 as priority, 'macro' as kind, name, min(ordinal) as ordinal, min_by(body, ordinal) as detail from macro_def group by name
    union all select 3 as priority, 'global' as kind, name, min(ordinal) as ordinal, min_by(type_name, ordinal) as detail from global_var group by name
    union all select 4 as priority, 'class' as kind, name, min(cast(ordinal as bigint)) as ordinal, min_by(qname, ordinal) as detail from class_def group by name) s on s.name = u.name) x
where k = 1""")
plan("unresolved_sites", "select u.site, u.name from requested_symbol u where not exists (select 1 from function_def f where f.name = u.name) and not exists (select 1 from macro_def m where m.name = u.name)")
plan("distinct_functions", "select base, name, min(start_line) as start_line, count(*) as defs from function_def group by base, name")
plan("function_info", """
select name, qname, len from (select name, qname, length(qname) as len, rank() over (partition by name order by length(qname), qname) as k from (select distinct name, qname from function_def) a) b where k = 1""")
plan("nearest_label", """
select site, kind, off from (
  select u.site, l.kind, l.line - u.line as off,
         row_number() over (partition by u.site order by abs(l.line - u.line), case when l.line > u.line then 0 else 1 end, l.ordinal) as k
  from alert u
  join (select b.ordinal, b.file, b.line, b.kind, b.line + o.d as probe from labelled_function b cross join (select @series(-5¦5)@ as d) o) l on l.file = u.file and l.probe = u.line) x
where k = 1""")
# Places count whose path is one of the suite's; main files don't.
plan("suite_alert", "select * from alert where (contains(file, '/juliet-test-suite-c/') or file like 's%' or @matches(file¦CWE[0-9]+_)@) and file not like '%main.cpp' and file not like '%main_linux.cpp'")
plan("evaluation", """
select tp, fp, total_bad, total_good, case when total_bad = 0 then 0.0 else cast(tp as double) / total_bad * 100 end as recall,
       case when tp + fp = 0 then 0.0 else cast(tp as double) / (tp + fp) * 100 end as precision_pct,
       case when total_good = 0 then 0.0 else cast(fp as double) / total_good * 100 end as fpr
from (select count(distinct case when kind = 'bad' and hit then file || '/' || fn end) as tp, count(distinct case when kind = 'good' and hit then file || '/' || fn end) as fp,
             count(distinct case when kind = 'bad' then file || '/' || fn end) as total_bad, count(distinct case when kind = 'good' then file || '/' || fn end) as total_good
      from (select l.*, a.line is not null as hit from labelled_function l left join (select distinct file, line from suite_alert) a on a.file = l.file and a.line = l.line) x) b""")
plan("function_kinds", """
select case when lower(fn || '_' || kind) like '%bad%' then 'bad' when lower(fn || '_' || kind) like '%good%' then 'good' else 'unknown' end as kind, count(*) as functions, count(distinct file) as files
from labelled_function group by 1""")
plan("cache_latest", """
select analysis_type, cwe_code, variable_name, chain_hash, backward_hash, result from (
  select *, row_number() over (partition by analysis_type, cwe_code, variable_name, chain_hash, backward_hash order by ordinal desc) as k from cache_row) x where k = 1""")
plan("cache_probe", """
select count(*) as asked, count(c.result) as hits, cast(count(c.result) as double) / greatest(1, count(*)) as hit_rate
from probe q
left join (select cwe_code, variable_name, chain_hash, max(result) as result from cache_latest where analysis_type = 'F' group by cwe_code, variable_name, chain_hash) c
  on c.cwe_code = q.cwe_code and c.variable_name = q.variable_name and c.chain_hash = q.chain_hash""")
plan("verdict", """
select ordinal, case when fp is null then false else not fp end as vulnerable,
       case when fp is null then 0.0 when lower(level) = 'high' then 0.9 when lower(level) = 'medium' then 0.6 when lower(level) = 'low' then 0.3 else 0.5 end as confidence,
       case when fp is null then 'Unknown' when fp then 'False Positive' else 'Confirmed Vulnerability' end as verdict_type
from recorded_result x""")
plan("batch_summary", """
select count(*) as paths, count(case when vulnerable then 1 end) as detected, cast(count(case when vulnerable then 1 end) as double) / greatest(1, count(*)) as detection_rate, count(case when verdict_type = 'Unknown' then 1 end) as unknown_paths from verdict""")
plan("validation_category", """
select query, iteration, result_count, coalesce(before, 0) as before_count,
       case when event_type = 'error' then 'compile_error' when before is null or result_count > before then 'success_increase' when result_count < before then 'result_decrease' else 'no_change' end as category
from (select *, lag(result_count) over (partition by query order by iteration) as before from iteration) x""")
plan("early_stop", """
select query, iteration, case when result_count > 1000 then 'explosion' when p2 is not null and result_count = p1 and p1 = p2 then 'convergence' when p2 is not null and result_count = p2 and result_count <> p1 then 'oscillation' else 'continue' end as decision
from (select *, lag(result_count, 1) over w as p1, lag(result_count, 2) over w as p2 from iteration window w as (partition by query order by iteration)) x""")
plan("iteration_report", "select query, count(*) as iterations, min_by(result_count, iteration) as first_count, max_by(result_count, iteration) as last_count, max_by(result_count, iteration) - min_by(result_count, iteration) as delta, max(result_count) as best from iteration group by query")
plan("token_usage", "select model_name, count(*) as calls, sum(prompt_tokens) as prompt_tokens, max(prompt_tokens) as largest from token_row group by model_name")
plan("result_distribution", "select item as file, count(*) as n from work_item group by item order by n desc, file limit 10")
# Items of one count are alike, so their places are summed by count: of u items after b others they run from b + 1 to b + u.
plan("concentration", """
select sum(n * (items * (total_rows + 1) - 2 * items * before - items * (items + 1))) as weighted, cast(max(total_rows) as bigint) as groups_n, sum(n * items) as total
from (select n, items, coalesce(sum(items) over (order by n desc rows between unbounded preceding and 1 preceding), 0) as before, sum(items) over () as total_rows
      from (select n, count(*) as items from (select item, count(*) as n from work_item group by item) a group by n) b) c""")
plan("related_code_lines", "select file, count(*) as code_lines, min(length(text)) as shortest from source_line where text <> '' group by file")
plan("next_work", "select distinct l.item from work_item l where not exists (select 1 from processed_item t where t.item = l.item)")
plan("uncached_functions", "select d.base, d.name from distinct_functions d where not exists (select 1 from cached_graph c where c.base = d.base and c.name = d.name)")
plan("clean_uri", "select page_id, @extract(url¦^[a-z]+://([^/]+)¦1)@ as host, replace(replace(url, 'https://', ''), 'http://', '') as path from pages")

plan("bb_degree", "select fn, src as block, count(*) as successors, count(case when etype = 'TRUE' then 1 end) as true_edges, count(case when etype = 'FALSE' then 1 end) as false_edges from bb_edge group by fn, src")
plan("bb_flags", """
select b.fn, b.block, max(case when i.dst is null then 1 else 0 end) as is_entry, max(case when o.src is null then 1 else 0 end) as is_exit
from (select fn, src as block from bb_edge union select fn, dst as block from bb_edge) b
left join bb_edge i on i.fn = b.fn and i.dst = b.block left join bb_edge o on o.fn = b.fn and o.src = b.block group by b.fn, b.block""")
plan("bb_condition", "select t.fn, t.src as block, min(t.dst) as true_block, min(f.dst) as false_block from bb_edge t join bb_edge f on f.fn = t.fn and f.src = t.src and t.etype = 'TRUE' and f.etype = 'FALSE' group by t.fn, t.src")
plan("back_edge", "select fn, src, dst, src - dst as span from bb_edge where src > dst")
plan("edge_classification", """
select fn, src, etype, count(*) as c, max(total) as total, case when count(*) = max(total) then 'dominator' else 'optional' end as kind
from (select *, count(*) over (partition by fn, src) as total from bb_edge) x where etype <> 'UNCONDITIONAL' group by fn, src, etype""")
