"""Lookups of symbols, macros, calls, blocks and functions, each with its order of preference; caches by their whole key."""

from ..plans.core import inner, plan
from .symbols import around

ASKED_PATH = "select site, line, base, case when site % 3 = 0 then '/home/' || file_path when site % 3 = 1 then base else file_path end as file_path from use_site"

plan("function_by_qname", """
select u.site, f.qname, f.file_path, f.start_line
from requested_symbol u join (select base, qname, min_by(file_path, ordinal) as file_path, min_by(start_line, ordinal) as start_line from function_def group by base, qname) f on f.base = u.base and f.qname = u.name""")
plan("functions_in_file", "select f.file_path, f.base, count(*) as defs, count(distinct f.qname) as functions, min(f.start_line) as first_line from function_def f group by f.file_path, f.base")
plan("enclosing_suffix", """
select b.site, f.qname, f.start_line, f.end_line
from (select u.site, coalesce(min(case when right(f.file_path, length(u.file_path)) = u.file_path or right(u.file_path, length(f.file_path)) = f.file_path then f.ordinal end), min(f.ordinal)) as ordinal
      from (select site, line, base, case when site % 3 = 0 then '/home/' || file_path when site % 3 = 1 then base else file_path end as file_path from use_site) u
      join (select d.ordinal, d.file_path, d.base, d.start_line, d.end_line, @series(floor(d.start_line / 64)¦floor(d.end_line / 64))@ as bin from function_def d) f
        on f.base = u.base and f.bin = cast(floor(u.line / 64) as bigint) and u.line between f.start_line and f.end_line
      group by u.site) b join function_def f on f.ordinal = b.ordinal""", spark=f"""
select b.site, f.qname, f.start_line, f.end_line
from (select u.site, coalesce(min(p.near), min(p.any)) as ordinal from ({ASKED_PATH}) u
      join ({around(f"select distinct file_path, base, line from ({ASKED_PATH}) v")}) p on p.base = u.base and p.line = u.line and p.file_path <=> u.file_path group by u.site) b
join function_def f on f.ordinal = b.ordinal""")
plan("macro_by_use", """
select r.site, r.name, coalesce(u.body, n.body) as body, coalesce(u.def_file, n.def_file) as def_file, case when u.body is not null then 'use' else 'name' end as found_by
from requested_symbol r
left join (select name, base, use_line, min_by(body, ordinal) as body, min_by(def_file, ordinal) as def_file from macro_use group by name, base, use_line) u on u.name = r.name and u.base = r.base and u.use_line = r.line
left join (select name, min_by(body, ordinal) as body, min_by(def_file, ordinal) as def_file from macro_use group by name) n on n.name = r.name
where coalesce(u.body, n.body) is not null""")
plan("macros_by_name", "select r.name, m.ordinal, m.body, m.def_file from (select distinct name from requested_symbol) r join macro_use m on m.name = r.name")
plan("macro_same_directory", """
select r.site, r.name, case when d.n is null then m.body else d.body end as body, case when d.n is null then m.def_file else d.def_file end as def_file
from requested_symbol r join (select name, min_by(body, ordinal) as body, min_by(def_file, ordinal) as def_file from macro_use group by name) m on m.name = r.name
left join (select name, dir, count(*) as n, min_by(body, ordinal) as body, min_by(def_file, ordinal) as def_file from (select *, substr(use_file, 1, length(use_file) - length(split_part(use_file, '/', -1))) as dir from macro_use) x group by name, dir) d on d.name = r.name and d.dir = r.dir""")
plan("macro_preload", """
select l.path_id, m.name, min_by(m.body, l.first_seen * 1000000 + m.ordinal) as body, min_by(m.def_file, l.first_seen * 1000000 + m.ordinal) as def_file
from (select path_id, file_path, line, min(pos) as first_seen from code_point group by path_id, file_path, line) l join macro_use m on m.base = l.file_path and m.use_line = l.line
group by l.path_id, m.name""", spark="""
select l.path_id, m.name, min_by(m.body, l.first_seen * 1000000 + m.ordinal) as body, min_by(m.def_file, l.first_seen * 1000000 + m.ordinal) as def_file
from (select path_id, file_path, line, min(pos) as first_seen from code_point group by path_id, file_path, line) l join macro_first m on m.base = l.file_path and m.use_line = l.line
group by l.path_id, m.name""")
# The first macro of each name on a line is the first for all paths that pass it.
inner("macro_first", "select base, use_line, name, min(ordinal) as ordinal, min_by(body, ordinal) as body, min_by(def_file, ordinal) as def_file from macro_use group by base, use_line, name")
plan("global_by_name", "select r.site, min_by(g.name, g.ordinal) as name, min_by(g.type_name, g.ordinal) as type_name from requested_symbol r join global_var g on g.name = split_part(r.name, '::', -1) group by r.site",
     # the first variable of each name meets the places
     spark="select r.site, min_by(g.name, g.ordinal) as name, min_by(g.type_name, g.ordinal) as type_name from requested_symbol r join (select name, min(ordinal) as ordinal, min_by(type_name, ordinal) as type_name from global_var group by name) g on g.name = split_part(r.name, '::', -1) group by r.site")
plan("class_by_name", "select r.site, min_by(c.name, c.ordinal) as name, min_by(c.qname, c.ordinal) as qname from requested_symbol r join class_def c on c.name = split_part(r.name, '::', -1) group by r.site")
plan("context_lookup", """
select r.site, r.name, coalesce(c.qname, f.qname) as qname, case when c.n is not null then 1 else 0 end as in_context
from (select *, split_part(name, '::', -1) as simple from requested_symbol) r join (select name, min_by(qname, ordinal) as qname from function_def group by name) f on f.name = r.simple
left join (select name, base, count(*) as n, min_by(qname, ordinal) as qname from function_def group by name, base) c on c.name = r.simple and c.base = r.base""")
plan("use_def_function", """
select u.site, u.name, coalesce(p.qname, n.qname) as qname, coalesce(p.start_line, n.start_line) as start_line, case when p.qname is not null then 'precise' when n.qname is not null then 'name' else 'none' end as found_by
from use_site u
left join (select name, base, start_line + 3 as use_line, min_by(qname, ordinal) as qname, min(start_line) as start_line from function_def group by name, base, start_line + 3) p on p.name = u.name and p.base = u.base and p.use_line = u.line
left join (select name, base, min_by(qname, ordinal) as qname, min_by(start_line, ordinal) as start_line from function_def group by name, base) n on n.name = u.name and n.base = u.base""")
plan("call_probe", """
select s.path_id, s.flowstep, case when c.caller is not null then true else false end as calls
from (select * from related_step where relation <> 'SAME') s left join call_edge c on c.caller = s.t_fn and split_part(c.caller_file, '/', -1) = split_part(s.t_file, '/', -1) and c.line = s.t_line and c.callee = s.f_fn and split_part(c.callee_file, '/', -1) = split_part(s.f_file, '/', -1)""")
plan("call_query_hash", """select distinct @sha('{"from_file": "' || split_part(f_file, '/', -1) || '", "from_function_name": "' || f_fn || '", "to_file": "' || split_part(t_file, '/', -1) || '", "to_function_name": "' || t_fn || '", "to_line": ' || cast(t_line as string) || '}')@ as query_hash, f_fn, f_file, t_fn, t_file, t_line from step""")
plan("call_cache", "select h.query_hash, max(case when p.calls then 1 else 0 end) as calls, count(*) as asked from call_query_hash h join step s on s.f_fn = h.f_fn and s.f_file = h.f_file and s.t_fn = h.t_fn and s.t_file = h.t_file and s.t_line = h.t_line join call_probe p on p.path_id = s.path_id and p.flowstep = s.flowstep group by h.query_hash")
plan("call_cache_stats", "select calls, count(*) as entries, sum(asked) as asked from call_cache group by calls")
plan("call_graph", "select c.caller, c.caller_file, c.callee, c.callee_file, c.line, f.qname as caller_qname, g.qname as callee_qname from call_edge c left join (select name, base, min(qname) as qname from function_def group by name, base) f on f.name = c.caller and f.base = c.caller_file left join (select name, base, min(qname) as qname from function_def group by name, base) g on g.name = c.callee and g.base = c.callee_file")
plan("block_edge", "select distinct b.fn, b.bb_id, b.sl, b.el, e.dst, e.etype from block b join bb_edge e on e.fn = b.fn and e.src = b.block")
plan("cfg_bundle", "select b.fn, count(distinct b.block) as blocks, coalesce(max(e.edges), 0) as edges, sum(b.is_entry) as entries, sum(b.is_exit) as exits from block b left join (select fn, count(*) as edges from bb_edge group by fn) e on e.fn = b.fn group by b.fn")
plan("cfg_cache_stats", "select count(*) as functions, sum(blocks) as blocks, sum(edges) as edges, max(blocks) as largest from cfg_bundle")
# The name itself, else the shortest that contains it: names are met by their parts between ::, then compared whole.
plan("function_like", """
select asked, qname from (
  select asked, qname, row_number() over (partition by asked order by rank, length(qname), qname) as k
  from (select n.asked, f.qname, 0 as rank from name_asked n join (select distinct qname from function_def) f on f.qname = n.asked
        union all select n.asked, f.qname, 1 as rank from name_asked n join (select distinct qname, @each(qname¦[^:]+¦0)@ as part from function_def) f on f.part = split_part(n.asked, '::', 1) where contains(f.qname, n.asked)) x) y
where k = 1""")
plan("function_start", "select s.fn, s.base, coalesce(c.start_line, d.start_line) as start_line, c.start_line is not null as from_graph from (select distinct name as fn, base from use_site) s left join (select name, base, min(start_line) as start_line from graph_function group by name, base) c on c.name = s.fn and c.base = s.base left join distinct_functions d on d.name = s.fn and d.base = s.base")
plan("line_kind", """
select site, min_by(kind, rank) as kind, min(rank) as rank from (
  select a.site, l.kind, v.rank * 100000000 + l.ordinal as rank from (
    select site, line, file, 0 as rank from alert union all select site, line, 'src' || file, 1 from alert union all select site, line, substr(file, 4), 2 from alert) v join alert a on a.site = v.site join labelled_function l on l.file = v.file and l.line = v.line) x group by site""")
plan("first_classified", "select a.flow, min_by(n.kind, a.pos) as kind, min(a.pos) as pos from alert a join nearest_label n on n.site = a.site where n.kind <> 'unknown' group by a.flow")
plan("cache_get", """
select q.ordinal, q.analysis_type, c.result, c.result is not null as hit
from probe q left join cache_latest c on c.analysis_type = q.analysis_type and c.cwe_code = q.cwe_code and c.variable_name = q.variable_name and c.chain_hash = q.chain_hash and c.backward_hash = q.backward_hash""")
plan("cache_get_any_context", """
select q.ordinal, coalesce(e.result, a.result) as result, case when e.result is not null then 'context' when a.result is not null then 'chain' else 'miss' end as found_by
from (select * from probe where analysis_type = 'P') q
left join cache_latest e on e.analysis_type = q.analysis_type and e.cwe_code = q.cwe_code and e.variable_name = q.variable_name and e.chain_hash = q.chain_hash and e.backward_hash = q.backward_hash
left join (select analysis_type, cwe_code, variable_name, chain_hash, min_by(result, backward_hash) as result from cache_latest group by analysis_type, cwe_code, variable_name, chain_hash) a on a.analysis_type = q.analysis_type and a.cwe_code = q.cwe_code and a.variable_name = q.variable_name and a.chain_hash = q.chain_hash""")
plan("cache_check", "select analysis_type, count(*) as asked, count(case when hit then 1 end) as hits, count(case when not hit then 1 end) as misses, cast(count(case when hit then 1 end) as double) / greatest(1, count(*)) as rate from cache_get group by analysis_type")
plan("legacy_cache", "select q.ordinal, l.result from probe q left join (select cwe_code, variable_name, chain_hash, max_by(result, ordinal) as result from cache_row group by cwe_code, variable_name, chain_hash) l on l.cwe_code = q.cwe_code and l.variable_name = q.variable_name and l.chain_hash = q.chain_hash")
plan("cfg_cache_key", "select u.site, coalesce(q.functions, n.functions, 0) as functions, case when q.functions is not null then 'qualified' when n.functions is not null then 'plain' else 'none' end as found_by from use_site u left join (select qname, base, count(*) as functions from cached_graph group by qname, base) q on q.qname = 'ns::' || u.name and q.base = u.base left join (select name, base, count(*) as functions from cached_graph group by name, base) n on n.name = u.name and n.base = u.base")
