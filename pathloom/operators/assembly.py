"""Flows from locations, results of paths from their units, scheduling by phase, reports and statistics."""

from ..plans.core import inner, plan

# Locations to flows: the enclosing function of each location, thread flows of two locations at least.
plan("resolved_location", """
select l.result_idx, l.rule_id, l.flow_idx, l.tf_idx, l.loc_idx, l.line, l.sc, l.ec, l.label, l.path, split_part(l.path, '/', -1) as base, f.name as fn
from (select a.*, u.path from location a join uri_clean u on u.result_idx = a.result_idx and u.flow_idx = a.flow_idx and u.tf_idx = a.tf_idx and u.loc_idx = a.loc_idx) l
left join (select v.base, v.line, min(f.ordinal) as ordinal
           from (select distinct split_part(uri, '/', -1) as base, line from location) v
           join (select d.ordinal, d.base, d.start_line, d.end_line, @series(floor(d.start_line / 64)¦floor(d.end_line / 64))@ as bin from function_def d) f
             on f.base = v.base and f.bin = cast(floor(v.line / 64) as bigint) and v.line between f.start_line and f.end_line group by v.base, v.line) e on e.base = split_part(l.path, '/', -1) and e.line = l.line
left join function_def f on f.ordinal = e.ordinal""")
plan("thread_flow", """
select result_idx, flow_idx, tf_idx, max(rule_id) as rule_id, count(*) as locations, count(fn) as points, min_by(coalesce(fn, ''), loc_idx) as src_fn, min_by(base, loc_idx) as src_file, max_by(coalesce(fn, ''), loc_idx) as sink_fn, max_by(base, loc_idx) as sink_file
from resolved_location group by result_idx, flow_idx, tf_idx having count(*) >= 2""")
plan("complete_flow", "select * from thread_flow where src_fn <> '' and sink_fn <> ''")
plan("shortest_flow", "select result_idx, flow_idx, tf_idx, locations from (select t.*, row_number() over (partition by result_idx, flow_idx order by locations, tf_idx) as k from thread_flow t) x where k = 1")
plan("flow_level_1", "select c.result_idx, c.flow_idx, c.tf_idx, c.points, c.src_file, c.src_fn, c.sink_file, c.sink_fn from complete_flow c join shortest_flow s on s.result_idx = c.result_idx and s.flow_idx = c.flow_idx and s.tf_idx = c.tf_idx")
plan("flow_level_2", "select result_idx, flow_idx, tf_idx, points, src_file, src_fn, sink_file, sink_fn from (select f.*, row_number() over (partition by src_file, src_fn, sink_file, sink_fn order by points, result_idx, flow_idx, tf_idx) as k from flow_level_1 f) x where k = 1")
plan("flow_level_3", "select result_idx, flow_idx, tf_idx, points, src_file, sink_file from (select f.*, row_number() over (partition by src_file, sink_file order by points, result_idx, flow_idx, tf_idx) as k from flow_level_1 f) x where k = 1")
plan("skipped_locations", "select base, line, n from (select base, line, count(*) as n from resolved_location where fn is null group by base, line) x order by n desc, base, line limit 10")
plan("flow_listing", "select result_idx, flow_idx, tf_idx, @chain(path || ':' || cast(line as string) || ' (' || label || ')'¦ -> ¦loc_idx)@ as listing from resolved_location group by result_idx, flow_idx, tf_idx")

# Spark's own statement: a unit's key tells its variable unless that is empty, and the results of a path's context are those of its unit.
ASSESSED = """
       d.i_key is not null and coalesce(r.analysed or r.cached, false) and m.unit_key is not null and coalesce(not m.fp, false) as is_vulnerable,
       case when d.i_key is null or not coalesce(r.analysed or r.cached, false) then 'Not analyzed' when m.unit_key is null then 'Context not found' when m.fp is null then 'Unknown' when m.fp then 'False Positive' else 'Confirmed Vulnerability' end as verdict,
       case when d.i_key is null or not coalesce(r.analysed or r.cached, false) or m.unit_key is null or m.fp is null then 0.0 else case lower(coalesce(m.level, 'low')) when 'high' then 0.9 when 'medium' then 0.6 when 'low' then 0.3 else 0.5 end end as confidence"""
OUTCOME = """
left join (select unit_key, analysed, cached from unit_result where segment = 'intermediate') r on r.unit_key = d.i_unit
left join (select distinct unit_key, fp, level from unit_result where segment = 'intermediate' and level is not null) m on m.unit_key = d.i_unit"""
inner("path_outcome", "select path_id, b_key, i_key, f_key, b_variable, case when i_key is not null then i_key || '__ctx_' || substr(coalesce(b_key, 'none'), 1, 8) || '_' || substr(coalesce(f_key, 'none'), 1, 8) end as i_unit from path_key")

# Paths from their units: what is missing is not analysed, what has no result for the path's context is not found.
plan("path_result", """
select d.path_id, coalesce(case when d.b_key is not null then coalesce(b.variable, 'unknown') when d.i_key is not null then coalesce(u.variable, 'unknown') when d.f_key is not null then coalesce(f.variable, 'unknown') end, 'unknown') as variable_name,
       d.i_key is not null and coalesce(r.analysed or r.cached, false) and m.matched and coalesce(not m.fp, false) as is_vulnerable,
       case when d.i_key is null or not coalesce(r.analysed or r.cached, false) then 'Not analyzed' when not m.matched then 'Context not found' when m.fp is null then 'Unknown' when m.fp then 'False Positive' else 'Confirmed Vulnerability' end as verdict,
       case when d.i_key is null or not coalesce(r.analysed or r.cached, false) or not m.matched or m.fp is null then 0.0 else case lower(coalesce(m.level, 'low')) when 'high' then 0.9 when 'medium' then 0.6 when 'low' then 0.3 else 0.5 end end as confidence
from decomposition d
left join path_unit pu on pu.path_id = d.path_id and pu.segment = 'intermediate'
left join unit_result r on r.segment = 'intermediate' and r.unit_key = pu.unit_key
left join context_match m on m.path_id = d.path_id
left join logic_unit u on u.segment = 'intermediate' and u.unit_key = pu.unit_key
left join logic_unit b on b.segment = 'backward' and b.unit_key = d.b_key
left join logic_unit f on f.segment = 'forward' and f.unit_key = d.f_key""", spark=f"""
select path_id, coalesce(b_variable, 'unknown') as variable_name, {ASSESSED}
from (select path_id, b_variable, i_key, i_unit from path_outcome where b_key is not null and coalesce(b_variable, '') <> '') d {OUTCOME}
union all
select d.path_id, coalesce(case when d.b_key is not null then b.variable when d.i_key is not null then coalesce(u.variable, 'unknown') when d.f_key is not null then f.variable end, 'unknown') as variable_name, {ASSESSED}
from (select path_id, b_key, i_key, f_key, i_unit from path_outcome where not (b_key is not null and coalesce(b_variable, '') <> '')) d {OUTCOME}
left join logic_unit u on u.segment = 'intermediate' and u.unit_key = d.i_unit
left join (select unit_key, variable from logic_unit where segment = 'backward' and coalesce(variable, '') = '') b on b.unit_key = d.b_key
left join logic_unit f on f.segment = 'forward' and f.unit_key = d.f_key""")
plan("path_report", "select verdict, count(*) as paths, count(case when is_vulnerable then 1 end) as vulnerable, count(distinct variable_name) as variables from path_result group by verdict")
plan("cache_efficiency", "select count(*) as units, cast(count(case when cached then 1 end) as double) / greatest(1, count(*)) as hit_rate, cast(count(case when analysed then 1 end) as double) / greatest(1, count(*)) as analysis_rate, cast(sum(usage_count) as double) / greatest(1, count(*)) as reuse_factor from unit_result")
plan("context_result", "select distinct u.unit_key, coalesce(d.b_key, 'none') as backward_key, coalesce(d.f_key, 'none') as forward_key, r.fp, r.level from path_unit u join decomposition d on d.path_id = u.path_id join unit_result r on r.segment = 'intermediate' and r.unit_key = u.unit_key where u.segment = 'intermediate'")
plan("context_match", "select d.path_id, c.fp, c.level, c.unit_key is not null as matched from (select p.path_id, u.unit_key, coalesce(p.b_key, 'none') as b_key, coalesce(p.f_key, 'none') as f_key from decomposition p join path_unit u on u.path_id = p.path_id and u.segment = 'intermediate') d left join (select * from context_result where level is not null) c on c.unit_key = d.unit_key and c.backward_key = d.b_key and c.forward_key = d.f_key", spark="""
select d.path_id, c.fp, c.level, c.unit_key is not null as matched from (select path_id, unit_key from path_unit where segment = 'intermediate') d
left join (select distinct unit_key, fp, level from unit_result where segment = 'intermediate' and level is not null) c on c.unit_key = d.unit_key""")
plan("schedule", """
select phase, segment, count(*) as units, count(case when cached then 1 end) as from_cache, count(case when not cached then 1 end) as to_analyse, sum(usage_count) as paths
from (select r.*, case when segment = 'intermediate' then 2 else 1 end as phase from unit_result r) x group by phase, segment""")
plan("uncached_order", """
select r.segment, r.unit_key, r.usage_count, p.before + row_number() over (partition by r.segment, r.usage_count, substr(r.unit_key, 1, 6) order by r.unit_key) as priority
from (select * from unit_result where not cached) r
join (select segment, usage_count, prefix, coalesce(sum(n) over (partition by segment order by usage_count desc, prefix rows between unbounded preceding and 1 preceding), 0) as before
      from (select segment, usage_count, substr(unit_key, 1, 6) as prefix, count(*) as n from unit_result where not cached group by segment, usage_count, substr(unit_key, 1, 6)) c) p
  on p.segment = r.segment and p.usage_count = r.usage_count and p.prefix = substr(r.unit_key, 1, 6)""")
plan("reuse_heatmap", "select segment, unit_key, usage_count from logic_unit where usage_count > 1")
plan("unit_manager", "select count(*) as units, sum(usage_count) as paths, max(usage_count) as largest, cast(sum(usage_count) as double) / greatest(1, count(*)) as average, count(case when usage_count > 1 then 1 end) as reused from logic_unit where not is_virtual")
plan("connection_units", "select kind, count(distinct src) as sources, count(distinct dst) as targets, sum(n) as paths, max(n) as strongest from connection_edge group by kind")
plan("virtual_connections", "select e.kind, count(*) as edges, count(case when v.unit_key is not null then 1 end) as from_virtual, count(case when w.unit_key is not null then 1 end) as to_virtual from connection_edge e left join (select distinct unit_key from logic_unit where is_virtual and segment = 'backward') v on v.unit_key = e.src left join (select distinct unit_key from logic_unit where is_virtual and segment = 'forward') w on w.unit_key = e.dst group by e.kind")
plan("neighbours", "select unit, kind, count(*) as neighbours, sum(n) as weight from (select src as unit, 'out ' || kind as kind, n from connection_edge union all select dst as unit, 'in ' || kind as kind, n from connection_edge) x group by unit, kind",
     spark="select unit, kind, count(*) as neighbours, sum(n) as weight from (select n, inline(array(struct(src as unit, 'out ' || kind as kind), struct(dst as unit, 'in ' || kind as kind))) from connection_edge) x group by unit, kind")
plan("path_flow", "select path_id, coalesce(b_key, '') || ' > ' || coalesce(i_key, '') || ' > ' || coalesce(f_key, '') as flow from decomposition")
plan("outer_variable", "select path_id, segment, case when segment = 'backward' then last_var else first_var end as variable, case when segment = 'backward' then last_line else first_line end as line, case when segment = 'backward' then last_id else first_id end as function_id from segment_edge")
plan("time_ordered", "select path_id, @chain(fn || ':' || cast(line as string)¦ > ¦pos)@ as flow, count(distinct fn) as functions from flow_point group by path_id")
plan("call_then_continue", "select s.path_id, s.idx, min(n.idx) as back_idx from related_step s join related_step n on n.path_id = s.path_id and n.idx > s.idx and n.t_id = s.f_id where s.relation = 'CALL' group by s.path_id, s.idx")
plan("first_function_points", """
select path_id, function_id, pos, line from (
  select p.path_id, p.fn || '@' || p.file as function_id, p.pos, p.line, lag(p.line) over w as before_line, lag(p.sc) over w as before_sc, p.sc
  from flow_point p join (select path_id, min_by(fn, pos) as fn, min_by(file, pos) as file from flow_point group by path_id) h on h.path_id = p.path_id and h.fn = p.fn and h.file = p.file
  window w as (partition by p.path_id order by p.pos)) x where before_line is null or before_line <> line or before_sc <> sc""")
plan("related_code_once", "select path_id, @chain(code¦ | ¦pos)@ as codes, count(*) as n from (select path_id, code, min(pos) as pos from flow_point group by path_id, code) x group by path_id")
plan("coverage_80", """
select segment, min_by(p1 + (80 - c1) * 10.0 / (c2 - c1), p1) as percent_for_80 from (
  select segment, decile as p1, coverage as c1, lead(coverage) over (partition by segment order by decile) as c2 from coverage) x
where c1 < 80 and c2 >= 80 group by segment""")
plan("top_tenth", """
select segment, cast(max(paths_before + least(units, place - units_before) * usage_count) as double) / max(total) * 100 as coverage
from (select *, cast(floor(0.1 * n) as bigint) + 1 as place from usage_step) x where units_before < place group by segment""")
plan("single_variant", "select c.segment, c.unit_key, c.fn, c.line, c.branch, c.kind from constraint_row c join (select segment, unit_key, fn, count(distinct points) as n from point_set group by segment, unit_key, fn) v on v.segment = c.segment and v.unit_key = c.unit_key and v.fn = c.fn where v.n = 1")
plan("constraint_order", "select segment, unit_key, fn, line, branch, kind, row_number() over (partition by segment, unit_key, fn order by line, branch, kind) as place from merged_constraint")
plan("improvement", "select query, iteration, result_count, coalesce(before, 0) as before_count, result_count - coalesce(before, 0) as gained, case when coalesce(before, 0) = 0 then 0.0 else cast(result_count - before as double) / before end as ratio from (select *, lag(result_count) over (partition by query order by iteration) as before from iteration) x")
plan("convergence", "select query, iteration, max(result_count) over w3 - min(result_count) over w3 as spread, case when count(*) over w3 = 3 and max(result_count) over w3 = min(result_count) over w3 then true else false end as stable from iteration window w3 as (partition by query order by iteration rows between 2 preceding and current row)")
plan("continue_iteration", "select query, iteration, category in ('success_increase', 'compile_error') and iteration < 10 as continues from validation_category")
plan("iteration_total", "select query, count(case when category = 'success_increase' then 1 end) as increases, count(case when category = 'no_change' then 1 end) as unchanged, count(case when category = 'compile_error' then 1 end) as failures from validation_category group by query")
plan("weakness_report", "select cwe_code, count(*) as results, count(case when analysis_type = 'F' then 1 end) as finished, count(distinct variable_name) as variables from cache_row group by cwe_code")
plan("deduplicated_counts", "select coalesce(n.kind, 'unknown') as kind, count(distinct a.file || ':' || cast(a.line as string)) as places, count(*) as flows from (select flow, min_by(file, pos) as file, min_by(line, pos) as line, min(pos) as site from alert group by flow) a left join nearest_label n on n.site = a.site group by 1")
plan("flow_evaluation", "select coalesce(n.kind, 'unknown') as kind, count(*) as flows, count(distinct a.flow) as queries from alert a left join nearest_label n on n.site = a.site group by 1")
plan("evaluation_scores", """
select tp, fp, total_bad, case when total_bad = 0 then 0.0 else cast(100 * tp as double) / total_bad end as tpr, case when tp + fp = 0 then 0.0 else cast(100 * tp as double) / (tp + fp) end as precision_pct, case when 2 * tp + fp + (total_bad - tp) = 0 then 0.0 else cast(200 * tp as double) / (tp + fp + total_bad) end as f1
from (select count(distinct case when l.kind = 'bad' and a.site is not null then l.file || '/' || l.fn end) as tp, count(distinct case when l.kind = 'good' and a.site is not null then l.file || '/' || l.fn end) as fp, count(distinct case when l.kind = 'bad' then l.file || '/' || l.fn end) as total_bad
      from labelled_function l left join suite_alert a on a.file = l.file and a.line = l.line) x""")
plan("distribution_by_base", "select split_part(path, '/', -1) as base, count(*) as n from uri_clean group by 1")
plan("token_total", "select count(*) as calls, sum(prompt_tokens) as prompt_tokens, count(distinct model_name) as models from token_row")
plan("debug_summary", "select segment, count(*) as segments, sum(steps) as steps, count(distinct skey) as keys, count(case when is_virtual then 1 end) as virtual_segments from segment_key group by segment")
plan("debug_contexts", "select i_key, b_key, f_key, count(*) as n from decomposition where i_key is not null group by i_key, b_key, f_key")
plan("flow_summary", "select path_id, fn, @chain(cast(line as string)¦, ¦pos)@ as lines, count(*) as points from flow_point group by path_id, fn")
plan("template_variables", "select path_id, replace(replace('from {source} to {sink}', '{source}', coalesce(source_var, '{source}') || '@' || cast(source_line as string)), '{sink}', coalesce(sink_var, '{sink}') || '@' || cast(sink_line as string)) as text from shared_variables")
plan("constraint_text", """
select segment, unit_key, fn, @chain('    - At line ' || cast(line as string) || case when branch = 'TRUE' then ', the condition ''c' || cast(line as string) || ''' must evaluate to TRUE' else ', take the ' || branch || ' branch' end || case when kind = 'may' and coverage is not null then ' (demoted from must)' else '' end¦; ¦line * 100 + case branch when 'TRUE' then 1 else 0 end * 10 + case kind when 'may' then 1 else 0 end)@ as text
from (select distinct segment, unit_key, fn, line, branch, kind, coverage from merged_constraint) x group by segment, unit_key, fn""")
plan("variant_text", """
select segment, unit_key, fn, 'Propagation variants in ' || substr(fn, 1, length(fn) - instr(reverse(fn), '@')) || ' (' || cast(count(*) as string) || ' variants across ' || cast(sum(paths) as string) || ' paths)' as title, @chain('variant of ' || cast(paths as string) || ' paths: ' || points¦; ¦first_path)@ as text
from variant_paths group by segment, unit_key, fn having count(*) > 1""")
plan("macro_text", "select path_id, @chain(name || ': ' || body || ' (defined in ' || split_part(def_file, '/', -1) || ')'¦; ¦name)@ as text from macro_preload group by path_id")
plan("query_tags", "select file, @matches(text¦@kind +path-problem)@ as is_path, @extract(text¦@kind +([a-z-]+)¦1)@ as kind, @extract(text¦external/cwe/cwe-0*([0-9]+)¦1)@ as first_cwe, contains(text, 'select') and contains(text, 'from') and contains(text, 'where') as has_clauses from query_text")
plan("query_tag", "select distinct file, cast(tag as bigint) as cwe from (select file, @each(text¦external/cwe/cwe-0*([0-9]+)¦1)@ as tag from query_text) x")
plan("query_catalogue", "select t.cwe, count(*) as queries, count(case when q.is_path then 1 end) as path_queries, min(t.file) as first_file from query_tag t join query_tags q on q.file = t.file group by t.cwe")
plan("query_pairs", "select t.file, t.cwe from query_tag t join query_tags q on q.file = t.file where q.is_path")
plan("query_diff", "select a.file, b.file as next_file, length(b.text) - length(a.text) as chars_added, length(a.text) - length(replace(a.text, ' ', '')) as words_before, length(b.text) - length(replace(b.text, ' ', '')) as words_after from query_text a join query_text b on b.file = a.file + 1")
# Every call of a line; words of the language that brackets follow are none.
plan("code_calls", """
select file, line, callee, count(*) as n from (select file, line, @each(text¦([A-Za-z_][A-Za-z0-9_]*) *[(]¦1)@ as callee from code_line) x
where callee not in ('if', 'for', 'while', 'switch', 'return', 'sizeof') group by file, line, callee""")
plan("symbol_call_site", "select r.name, c.file, c.line, c.n from (select distinct name, split_part(name, '::', -1) as simple from requested_symbol where name <> '') r join code_calls c on c.callee = r.simple")
plan("related_code_site", "select path_id, file, cast(found as bigint) as line from (select path_id, trim(@extract(text¦File Path: *([^\n]*)¦1)@) as file, @each(text¦(?m)^ *([0-9]+):¦1)@ as found from related_code) x where file <> ''")
plan("related_code_macro", "select s.path_id, m.name, min(s.line) as first_line, count(*) as uses from related_code_site s join macro_use m on m.base = s.file and m.use_line = s.line group by s.path_id, m.name")
plan("numbered_code", "select file, @chain(cast(line as string) || ': ' || text¦ / ¦line)@ as code, count(*) as lines from source_line group by file")
plan("source_range", "select file, line, substr(text, 3, 5) as box from source_line where line between 2 and 4")
