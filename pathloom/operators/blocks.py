"""Blocks by their ids ``line.column_line.column[_context]``: their parts and texts, kinds of edges, graphs without self-loops
and places that are none, and points merged where they stand in one block or at one place."""

from ..plans.core import plan

PARSES = "^-?[0-9]+([.][^_]*)?_-?[0-9]+([._]|$)"
LINE = "try_cast(split_part(split_part(base_id, '_', {}), '.', 1) as bigint)"
COLUMN = "try_cast(split_part(split_part(base_id, '_', {}), '.', 2) as bigint)"

# An id that doesn't parse counts as 999 lines, so that any other block goes before it; one without an end as one line.
plan("block_id_parts", f"""
select block_id, base_id, case when contains(block_id, '_L') then substr(block_id, instr(block_id, '_L')) else 'original' end as context, case when parses then s end as start_line, case when parses then e end as end_line,
       case when not contains(base_id, '_') then 1 when parses then abs(e - s) + 1 else 999 end as size, parses and s > e as is_reversed, substr(block_id, 1, 4) <> '0.0_' as has_place
from (select block_id, base_id, @matches(base_id¦{PARSES})@ as parses, {LINE.format(1)} as s, {LINE.format(2)} as e
      from (select block_id, split_part(block_id, '_L', 1) as base_id from asked_id where block_id is not null) x) y""")

# The text from the id's first column to its last, that one included; of an id that ends before it starts two lines more.
plan("block_text", f"""
select a.file, a.block_id, coalesce(t.text, '') as text
from asked_block a left join (
  select file, block_id, @chain(case when line = s and s = e then substr(text, sc, greatest(ec - sc + 2, 0)) when line = s then substr(text, sc) when line = e then substr(text, 1, ec + 1) else text end¦¦line)@ as text
  from (select b.file, b.block_id, b.s, b.e, b.sc, b.ec, l.line, l.text
        from (select file, block_id, s, e, greatest(sc, 1) as sc, ec, @series(s¦e)@ as at
              from (select file, block_id, s, case when s > e then s + 2 else e end as e, sc, ec
                    from (select file, block_id, {LINE.format(1)} as s, {LINE.format(2)} as e, {COLUMN.format(1)} as sc, {COLUMN.format(2)} as ec from (select file, block_id, split_part(block_id, '_L', 1) as base_id from asked_block) w) x where s >= 1 and e >= 1) y) b
        join source_line l on l.file = b.file and l.line = b.at) z group by file, block_id) t on t.file = a.file and t.block_id = a.block_id""")

plan("edge_kind", "select e.fn, e.src, e.dst, case when e.dst = c.true_block then 'TRUE' when e.dst = c.false_block then 'FALSE' else 'UNCONDITIONAL' end as kind from bb_edge e left join bb_condition c on c.fn = e.fn and c.block = e.src")
plan("clean_edge", """
select e.function, e.src, e.dst from function_edge e join function_block s on s.function = e.function and s.block = e.src join function_block t on t.function = e.function and t.block = e.dst
where substr(s.bb_id, 1, 4) <> '0.0_' and substr(t.bb_id, 1, 4) <> '0.0_' and e.src <> e.dst""")
plan("self_loop", "select function, src as block, count(case when dst <> src then 1 end) as exits, case when count(case when dst <> src then 1 end) = 0 then 'infinite' else 'exits kept' end as kind from function_edge group by function, src having max(case when dst = src then 1 else 0 end) = 1")

# Of the points of a path in a function, those that follow each other at one place are one.
plan("merged_identical_points", """
select path_id, function_id, min(pos) as first_pos, max(line) as line, max(sc) as sc, max(ec) as ec, count(*) as merged_count from (
  select *, sum(case when line = line_before and sc = sc_before and ec = ec_before then 0 else 1 end) over (partition by path_id, function_id order by pos rows between unbounded preceding and current row) as island
  from (select path_id, pos, line, sc, ec, function_id, lag(line) over w as line_before, lag(sc) over w as sc_before, lag(ec) over w as ec_before
        from (select path_id, pos, line, sc, ec, fn || '@' || file as function_id from flow_point) a window w as (partition by path_id, function_id order by pos)) b) c
group by path_id, function_id, island""")
# Or in one block: the first around the line that doesn't end before it starts.  A point in none stays by itself.
plan("merged_block_points", """
select path_id, function_id, min(pos) as first_pos, min(block) as block, count(*) as merged_count from (
  select *, sum(case when block = block_before then 0 else 1 end) over (partition by path_id, function_id order by pos rows between unbounded preceding and current row) as island
  from (select p.path_id, p.pos, p.function_id, g.block, lag(g.block) over (partition by p.path_id, p.function_id order by p.pos) as block_before
        from (select path_id, pos, line, fn || '@' || file as function_id from flow_point) p
        left join (select q.function_id, q.line, max(q.is_parameter) as is_parameter, min(b.block) as block
                   from (select function_id, line, fn, graph_line, case when is_parameter then 1 else 0 end as is_parameter from graph_point) q
                   left join block b on b.fn = q.fn and b.sl <= b.el and q.graph_line between b.sl and b.el group by q.function_id, q.line) g on g.function_id = p.function_id and g.line = p.line
        where coalesce(g.is_parameter, 0) = 0) b) c
group by path_id, function_id, island""")
