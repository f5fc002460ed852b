"""Predicates and projections over points, steps, blocks, paths of files and names."""

from ..plans.core import plan

#: Labels that say nothing about a variable, words of a declaration, prefixes of library names.
NOISY = ("... = ...", "[summary param]", "[summary] to write:", "[summary] read:")
TYPE_WORDS = ("int", "void", "char", "float", "double", "struct", "unsigned", "signed", "const", "static", "*")
LIBRARY_PREFIXES = ("__builtin_", "__libc_", "_IO_", "__cxa_", "std::")
SOURCE_ENDINGS = (".cpp", ".c", ".h", ".hpp", ".cc", ".cxx")


def any_of(test: str, values: tuple[str, ...]) -> str:
    return "(" + " or ".join(test.format(v) for v in values) + ")"


plan("flow_complete", """
select path_id, count(*) as points, min(case when coalesce(file_path, '') = '' or line is null or coalesce(line_code, '') = '' or coalesce(variable, '') = '' or coalesce(related_code, '') = '' or coalesce(fn, '') = '' or sc is null or ec is null then 0 else 1 end) = 1 as complete
from code_point group by path_id""")
plan("uri_clean", "select result_idx, flow_idx, tf_idx, loc_idx, regexp_replace(regexp_replace(uri, '^file:', ''), '^/+', '/') as path, case when uri like 'file:%' and length(uri) > 5 and substr(uri, 6, 1) <> '/' then '/' || substr(uri, 6) when uri like 'file:%' then substr(uri, 6) else uri end as precompute_path from location")
plan("step_key", "select path_id, flowstep, split_part(f_file, '/', -1) || ':' || cast(f_line as string) || '->' || split_part(t_file, '/', -1) || ':' || cast(t_line as string) || '#' || cast(flowstep as string) as key from step")
plan("parameter_position", f"""
select path_id, pos, opens > 0 and closes > 0 and {any_of("contains(substr(code, 1, opens - 1), '{}')", TYPE_WORDS)} and contains(substr(code, opens, greatest(0, closes - opens)), variable) as is_parameter
from (select path_id, pos, variable, trim(line_code) as code, instr(trim(line_code), '(') as opens, case when contains(line_code, ')') then length(trim(line_code)) - instr(reverse(trim(line_code)), ')') + 1 else 0 end as closes from code_point) x""")
plan("display_variable", f"""
select path_id, pos, display, case when display <> variable and coalesce(semantic_label, '') <> '' then 'the ' || display || ' (`' || variable || '`)' else 'variable `' || display || '`' end as narrative
from (select *, case when trim(coalesce(semantic_label, '')) = '' or {any_of("contains(semantic_label, '{}')", NOISY)} then variable else trim(semantic_label) end as display from code_point) x""")
plan("block_shape", "select fn, bb_id, split_part(bb_id, '_L', 1) as base_id, sl > el as is_reversed, abs(el - sl) + 1 as size, case when contains(bb_id, '_L') then substr(bb_id, instr(bb_id, '_L')) else 'original' end as context from block")
plan("block_contained", "select a.fn, a.bb_id as inner_id, b.bb_id as outer_id from block a join block b on b.fn = a.fn and b.bb_id <> a.bb_id and (b.sl < a.sl or b.sl = a.sl and b.sc <= a.sc) and (b.el > a.el or b.el = a.el and b.ec >= a.ec)")
plan("branch_block", "select b.fn, b.block, coalesce(e.n, 0) = 2 as is_branch from block b left join (select fn, src, count(*) as n from bb_edge group by fn, src) e on e.fn = b.fn and e.src = b.block")
plan("point_block", """
select fn, line, bb_id, size from (
  select p.fn, p.line, b.bb_id, abs(b.el - b.sl) + 1 as size, rank() over (partition by p.fn, p.line order by abs(b.el - b.sl)) as k
  from block_point p join block b on b.fn = p.fn and p.line between least(b.sl, b.el) and greatest(b.sl, b.el)) x where k = 1""")
plan("valid_start", "select b.fn, b.block, b.is_entry = 1 or p.dst is not null as is_valid from block b left join (select distinct fn, dst from bb_edge) p on p.fn = b.fn and p.dst = b.block")
plan("predecessor_count", "select b.fn, b.block, coalesce(p.n, 0) as predecessors from block b left join (select fn, dst, count(*) as n from bb_edge group by fn, dst) p on p.fn = b.fn and p.dst = b.block")
plan("point_in_body", """
select u.site, u.line, coalesce(max(case when f.start_line is null then null when u.line <> f.start_line then 1 else 0 end), 1) = 1 as in_body
from use_site u left join (select name, base, start_line, end_line, @series(floor(start_line / 64)¦floor(greatest(start_line, end_line) / 64))@ as bin from (select distinct name, base, start_line, end_line from function_def) d) f
  on f.name = u.name and f.base = u.base and f.bin = cast(floor(u.line / 64) as bigint) and u.line between f.start_line and greatest(f.start_line, f.end_line) group by u.site, u.line""")
plan("steps_of_function", "select function_id, path_id, count(*) as steps, min(idx) as first_idx, max(idx) as last_idx from (select path_id, idx, f_id as function_id from related_step union select path_id, idx, t_id as function_id from related_step) x group by function_id, path_id")
plan("symbol_name", f"""
select site, name, case when name = '' then 'required' when {any_of("name like '%{}'", SOURCE_ENDINGS)} then 'file path' when contains(name, '/') or contains(name, chr(92)) then 'separator'
       when @matches(name¦^[a-zA-Z_][a-zA-Z0-9_]*(::[a-zA-Z_][a-zA-Z0-9_]*)*$)@ then 'valid' else 'identifier' end as judged from requested_symbol""")
plan("library_function", f"select r.site, r.name, {any_of("substr(r.name, 1, length('{0}')) = '{0}'", LIBRARY_PREFIXES)} or l.name is not null as is_library from requested_symbol r left join library_name l on l.name = r.name")
plan("open_request", "select distinct r.name, r.base from requested_symbol r where r.name <> '' and not exists (select 1 from function_def f where f.name = r.name or f.qname = r.name) and not exists (select 1 from macro_def m where m.name = r.name)",
     # names that no definition has, by name and by qualified name apart: each is a join on one key
     spark="select r.name, r.base from (select distinct name, base from requested_symbol where name <> '') r where not exists (select 1 from function_def f where f.name = r.name) and not exists (select 1 from function_def q where q.qname = r.name) and not exists (select 1 from macro_def m where m.name = r.name)")
plan("strict_kind", """
select fn, case when c = 'bad' then 'bad' when c = 'good' then 'good' when lower(c) like '%bad%' and contains(c, 'Sink') then 'bad' when lower(c) like '%good%' and (contains(c, 'B2G') or contains(c, 'G2B')) then 'good'
       when @matches(c¦^CWE[0-9]+_)@ and @matches(split_part(c, '_', -1)¦bad|Bad|BAD)@ then 'bad' when @matches(c¦^CWE[0-9]+_)@ and @matches(split_part(c, '_', -1)¦good|Good|GOOD)@ then 'good'
       when @matches(c¦^CWE[0-9]+_)@ and @matches(split_part(c, '_', -1)¦^[0-9]+$)@ then 'bad'
       when c like '~CWE%' and (contains(c, '_bad') or @matches(c¦_[0-9]+$)@) then 'bad' when c like '~CWE%' and contains(c, '_good') then 'good' else 'unknown' end as kind
from (select fn, trim(fn) as c from suite_function) x""")
plan("suite_totals", "select count(distinct case when kind = 'bad' and lower(fn) like '%bad%' then fn end) as bad_functions, count(distinct case when kind = 'good' and lower(fn) like '%good%' then fn end) as good_functions from strict_kind")
plan("keyword_groups", "select result_idx, flow_idx, tf_idx, max(case when contains(lower(uri), 'lib') or contains(lower(label), 'a') then 1 else 0 end) = 1 as mentions from location group by result_idx, flow_idx, tf_idx")
# Up to the line behind the next blank line or closing brace; to the top where there is none.  A start behind the file's end is its last line.
plan("adjusted_start", """
select a.file, a.line as start_line, case when a.line < 1 or n.lines is null then a.line when a.line > n.lines then n.lines else coalesce(a.boundary + 1, 1) end as adjusted
from (select file, line, asked, max(case when asked = 0 and @matches(text¦^\\s*[}]?\\s*$)@ then line end) over (partition by file order by line, asked desc rows between unbounded preceding and current row) as boundary
      from (select file, line, text, 0 as asked from source_line union all select distinct file, line, cast(null as string) as text, 1 as asked from reported_start) x) a
left join (select file, count(*) as lines from source_line group by file) n on n.file = a.file where a.asked = 1""")
