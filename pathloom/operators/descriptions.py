"""Texts for constraints and their variants, versions of queries, and what a dump of symbols leaves out."""

from ..plans.core import plan

ORDER = "line * 10 + case branch when 'TRUE' then 1 when 'FALSE' then 2 else 3 end"
NAME = "case when contains(fn, '@') then substr(fn, 1, length(fn) - instr(reverse(fn), '@')) else fn end"

# The merged constraints of a unit: what every variant needs, then what some do, with the share of variants that needed it.
plan("merged_constraint_text", f"""
select segment, unit_key, '=== Control Flow Constraints (Merged from Path Variants) ===' || chr(10) || chr(10) || replace(@chain(text¦~~¦fn)@, '~', chr(10)) || chr(10) as text, count(*) as functions
from (select segment, unit_key, fn, 'Function ' || {NAME} || case when n > 1 then ' (merged from ' || cast(n as string) || ' variants)' else '' end || ':'
             || coalesce('~  MUST-satisfy (all variants):~' || must, '') || coalesce('~  MAY-satisfy (variant-dependent):~' || may, '') as text
      from (select segment, unit_key, fn, max(n) as n, nullif(@chain(case when kind = 'must' then item end¦~¦{ORDER})@, '') as must, nullif(@chain(case when kind = 'may' then item || note end¦~¦{ORDER})@, '') as may
            from (select m.segment, m.unit_key, m.fn, m.line, m.branch, m.kind, v.n, '    - Line ' || cast(m.line as string) || ': branch `' || m.branch || '`' as item,
                         case when m.demoted_from_must then ' (' || cast(d.c as string) || '/' || cast(d.n as string) || ' variants, demoted from must)' else '' end as note
                  from merged_constraint m join variant_count v on v.segment = m.segment and v.unit_key = m.unit_key and v.fn = m.fn
                  left join must_constraint d on d.segment = m.segment and d.unit_key = m.unit_key and d.fn = m.fn and d.line = m.line and d.branch = m.branch) x
            group by segment, unit_key, fn) y) z
group by segment, unit_key""", spark=f"""
select segment, unit_key, '=== Control Flow Constraints (Merged from Path Variants) ===' || chr(10) || chr(10) || replace(@chain(text¦~~¦fn)@, '~', chr(10)) || chr(10) as text, count(*) as functions
from (select segment, unit_key, fn, 'Function ' || {NAME} || case when n > 1 then ' (merged from ' || cast(n as string) || ' variants)' else '' end || ':'
             || coalesce('~  MUST-satisfy (all variants):~' || must, '') || coalesce('~  MAY-satisfy (variant-dependent):~' || may, '') as text
      from (select segment, unit_key, fn, max(n) as n, nullif(@chain(case when kind = 'must' then item end¦~¦{ORDER})@, '') as must, nullif(@chain(case when kind = 'may' then item || note end¦~¦{ORDER})@, '') as may
            from (select m.segment, m.unit_key, m.fn, m.line, m.branch, m.kind, m.n, '    - Line ' || cast(m.line as string) || ': branch `' || m.branch || '`' as item,
                         case when m.demoted_from_must then ' (' || cast(m.c as string) || '/' || cast(m.n as string) || ' variants, demoted from must)' else '' end as note
                  from merged_row m where m.unit_key is not null) x
            group by segment, unit_key, fn) y) z
group by segment, unit_key""")
# What a prompt says of them: only what must be taken.
plan("constraint_prompt", f"""
select segment, unit_key, '=== Control Flow Constraints ===' || chr(10) || chr(10) || replace(@chain(text¦~~¦fn)@, '~', chr(10)) || chr(10) as text
from (select segment, unit_key, fn, 'Function ' || {NAME} || ':~  Branch conditions that MUST be taken to reach this code:~' || items as text
      from (select segment, unit_key, fn, @chain('    - At line ' || cast(line as string) || case when branch = 'TRUE' then ', the condition ''c' || cast(line as string) || ''' must evaluate to TRUE' else ', take the ' || branch || ' branch' end¦~¦{ORDER})@ as items
            from merged_constraint where kind = 'must' group by segment, unit_key, fn) x) y
group by segment, unit_key""")
# How they are shown: a line that isn't known as a question mark, conditions in backticks, loops by their context.
plan("constraint_display", """
select fn, replace(@chain('    - Line ' || case when line = 0 then '?' else cast(line as string) end || ': ' || branch || case when condition in ('', 'UNKNOWN', 'None') then '' else ' - `' || condition || '`' end
       || case when context <> 'original' then ' (in ' || context || ')' else '' end || case when block_id <> '' then ' [from ' || 'block: ' || block_id || ']' else '' end¦~¦place)@, '~', chr(10)) as text, count(*) as constraints
from (select fn, place, line, branch, trim(coalesce(condition, '')) as condition, coalesce(block_id, '') as block_id, case when contains(coalesce(block_id, ''), '_L') then substr(block_id, instr(block_id, '_L') + 1) else 'original' end as context from shown_constraint) x group by fn""")

# Versions of a query: how many lines more or fewer, and whether there are more imports or predicates.
plan("version_lines", "select file, version, count(*) as lines, count(case when @matches(line¦^import\\s)@ then 1 end) as imports, count(case when @matches(line¦^predicate\\s+\\w)@ then 1 end) as predicates from (select file, version, @lines(text)@ as line from query_version) x group by file, version")
plan("version_diff", """
select a.file, a.version, greatest(b.lines - a.lines, 0) as lines_added, greatest(a.lines - b.lines, 0) as lines_removed, b.imports > a.imports as new_imports, b.predicates > a.predicates as new_predicates
from version_lines a join version_lines b on b.file = a.file and b.version = a.version + 1""")

# Dumps leave out system headers, and functions whose body lies in another file.
plan("use_def_dump", "select distinct f.name, f.qname, c.use_file, c.use_line, f.file_path as def_file, f.start_line as def_start, f.end_line as def_end from raw_call c join function_def f on f.ordinal = c.target where not contains(c.use_file, '/usr/include/')")
plan("class_dump", "select ordinal, name, qname, file_path from raw_class where not contains(file_path, 'usr/include')")
plan("global_dump", "select ordinal, name, type_name, file_path from raw_global where not contains(file_path, 'usr/include')")
plan("function_dump", "select f.ordinal, f.name, f.qname, b.body_file as file_path, f.start_line, f.end_line from function_def f join raw_body b on b.ordinal = f.ordinal where b.body_file = f.file_path")

# The code of the function around a place, read once a function.
plan("enclosing_code", """
select s.site, s.file, s.line, s.name, c.code
from (select t.site, t.file, t.line, min_by(f.name, f.start_line) as name, min(f.start_line) as start_line
      from text_site t join (select file, name, start_line, end_line, @series(floor(start_line / 64)¦floor(end_line / 64))@ as bin from text_function) f on f.file = t.file and f.bin = cast(floor(t.line / 64) as bigint) and t.line between f.start_line and f.end_line
      group by t.site, t.file, t.line) s
join (select f.file, f.name, f.start_line, replace(@chain(l.text¦~|~¦l.line)@, '~|~', chr(10)) as code
      from (select file, name, start_line, @series(start_line¦end_line)@ as at from text_function) f join source_line l on l.file = f.file and l.line = f.at group by f.file, f.name, f.start_line) c on c.file = s.file and c.name = s.name and c.start_line = s.start_line""")

# The first paths of a list: the limit is the feature.
plan("limited_paths", "select path_id, count(*) as points from flow_point group by path_id order by path_id limit 100")
