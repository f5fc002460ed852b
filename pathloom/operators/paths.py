"""Paths: steps, relations, depth, split, virtual steps, keys, logic units, connections."""

from ..plans.core import SPARK, inner, plan

ITEM = "x.idx as idx, x.flowstep as flowstep, x.f_id as f_id, x.t_id as t_id, x.f_line as f_line, x.t_line as t_line, x.f_var as f_var, x.t_var as t_var, x.f_sc as f_sc, x.f_ec as f_ec, x.t_sc as t_sc, x.t_ec as t_ec, x.same_function as same_function, x.relation as relation"
#: A step that stands still at one end of ``x``.
STILL = "cast(-1 as bigint) as idx, cast(0 as bigint) as flowstep, x.{e}_id as f_id, x.{e}_id as t_id, x.{e}_line as f_line, x.{e}_line as t_line, x.{e}_var as f_var, x.{e}_var as t_var, x.{e}_sc as f_sc, x.{e}_ec as f_ec, x.{e}_sc as t_sc, x.{e}_ec as t_ec, true as same_function, 'VIRTUAL' as relation"


def _still(items: str, end: str) -> str:
    return f"transform(slice({items}, {'1' if end == 'f' else '-1'}, least(size({items}), 1)), x -> struct({STILL.format(e=end)}))"


def _items(where: str) -> str:
    return f"transform(filter(s, x -> {where}), x -> struct({ITEM}))"


def _hash(segment: str, k: str) -> str:
    return f"md5('{segment}:' || get({k}_items, 0).f_id || array_join(transform({k}_items, x -> case when not (x.f_id = x.t_id and x.same_function) then '->' || x.t_id end), ''))"


def _key(k: str) -> str:
    return f"case when coalesce({k}_variable, '') = '' then {k}_hash else {k}_variable || '::' || {k}_hash end as {k}_key"


# A path with its steps in a row: Spark meets the points of a path in one exchange, and all that follows of a path follows
# within its row.  The rules are those of the plain statements: depths, the split at the shallowest function, virtual steps, keys.
inner("path_row", f"""
select path_id, b_items, i_items, f_items, b_virtual, i_virtual, f_virtual, b_variable, i_variable, f_variable, {_key('b')}, {_key('i')}, {_key('f')}
from (select *, {_hash('backward', 'b')} as b_hash, {_hash('intermediate', 'i')} as i_hash, {_hash('forward', 'f')} as f_hash,
             get(b_items, size(b_items) - 1).t_var as b_variable, get(i_items, 0).f_var as i_variable, get(f_items, 0).f_var as f_variable
from (select path_id, size(b) = 0 as b_virtual, size(i) = 0 as i_virtual, size(f) = 0 as f_virtual,
             case when size(b) > 0 then b when size(i) > 0 then {_still('i', 'f')} else {_still('f', 'f')} end as b_items,
             case when size(i) > 0 then i else {_still('f', 'f')} end as i_items,
             case when size(f) > 0 then f when size(i) > 0 then {_still('i', 't')} else {_still('b', 't')} end as f_items
from (select path_id, {_items('x.idx <= b_end')} as b, {_items('x.idx > b_end and x.idx < i_end')} as i, {_items('x.idx > b_end and x.idx >= i_end')} as f
from (select path_id, s, case when lca is null or starts then -1 else coalesce(t, -1) end as b_end,
             case when lca is null then 9223372036854775807 when starts then coalesce(first_out, size(s))
                  else coalesce(array_max(transform(filter(s, x -> x.f_id = lca and x.relation <> 'SAME' and x.idx > t), x -> x.idx)), size(s)) end as i_end
from (select path_id, s, lca, coalesce(get(s, 0).idx = 0 and get(s, 0).f_id = lca, false) as starts, get(filter(s, x -> x.f_id = lca and x.relation <> 'SAME'), 0).idx as first_out,
             get(filter(s, x -> x.f_file = touch.f_file and x.f_line = touch.f_line and x.t_file = touch.t_file and x.t_line = touch.t_line), 0).idx as t
from (select path_id, s, lca, get(filter(s, x -> x.relation <> 'SAME' and (x.f_id = lca or x.t_id = lca)), 0) as touch
from (select path_id, s, array_min(transform(array_distinct(transform(e, y -> y.id)), k -> struct(
               coalesce(try_element_at(filter(e, y -> y.id = k and y.dep is not null), -1).dep, 0) as depth, get(filter(e, y -> y.id <=> k), 0).seq as seq, k as id))).id as lca
from (select path_id, s, flatten(transform(filter(s, x -> x.relation <> 'SAME'), x -> array(
               struct(x.f_id as id, 2 * x.idx as seq, case when x.relation = 'RETURN' then x.cur + 1 end as dep), struct(x.t_id as id, 2 * x.idx + 1 as seq, x.cur as dep)))) as e
from (select path_id, array_sort(collect_list(struct(idx, flowstep, f_id, t_id, f_file, f_line, t_file, t_line, f_var, t_var, f_sc, f_ec, t_sc, t_ec, same_function, relation, cur))) as s
from (select *, sum(case relation when 'CALL' then 1 when 'RETURN' then -1 else 0 end) over (partition by path_id order by idx rows between unbounded preceding and current row) as cur
from (select path_id, cast(idx as bigint) as idx, cast(flowstep as bigint) as flowstep, f_id, t_id, f_file, f_line, t_file, t_line, f_var, t_var, f_sc, f_ec, t_sc, t_ec, same_function, relation
      from related_step where path_id is not null) r0) r1 group by path_id) r2) r3) r4) r5) r6) r7) r8) r9) r10""")
# Behind ``inline``, so that Spark doesn't push conditions on keys down into the rules, which would write them out many times.
inner("path_key", """
select path_id, inline(array(struct(b_key, i_key, f_key, b_variable, i_variable, f_variable, b_virtual, i_virtual, f_virtual, cast(size(b_items) as bigint) as b_steps, cast(size(i_items) as bigint) as i_steps, cast(size(f_items) as bigint) as f_steps)))
from path_row""")
SEGMENTS = {"b": "backward", "i": "intermediate", "f": "forward"}


def _segments(fields: str, where: str) -> str:
    """``inline`` of one struct a segment, with ``{k}`` for its letter."""
    return "inline(filter(array(" + ", ".join(f"struct('{s}' as segment, {fields.format(k=k)})" for k, s in SEGMENTS.items()) + f"), x -> {where}))"


inner("path_segment", f"""
select path_id, own_b, own_f, {_segments('{k}_key as skey, {k}_variable as variable, {k}_virtual as is_virtual, {k}_steps as steps', 'x.steps > 0')}
from (select *, case when b_steps > 0 then b_key end as own_b, case when f_steps > 0 then f_key end as own_f from path_key) y""")
inner("segment_row", f"select path_id, b_key, f_key, {_segments('{k}_key as skey, {k}_virtual as is_virtual, {k}_items as items', 'size(x.items) > 0')} from path_row")
FULL_STEP = "select path_id, x.idx, x.flowstep, x.f_id, x.t_id, x.f_line, x.t_line, x.f_var, x.t_var, x.f_sc, x.f_ec, x.t_sc, x.t_ec, x.same_function, x.relation, segment, is_virtual from (select path_id, segment, is_virtual, explode(items) as x from segment_row) y"
UNIT_KEY = "case when segment = 'intermediate' then skey || '__ctx_' || substr(coalesce({b}, 'none'), 1, 8) || '_' || substr(coalesce({f}, 'none'), 1, 8) else skey end"
SEGMENTED = {
    "segment_step": FULL_STEP + " where not is_virtual",
    "virtual_step": FULL_STEP + " where is_virtual",
    "full_segment": FULL_STEP,
    "segment_edge": """
select path_id, segment, cast(size(items) as bigint) as n, get(items, 0).idx as first_idx, get(items, size(items) - 1).idx as last_idx,
       get(items, 0).f_id as first_id, get(items, 0).f_var as first_var, get(items, 0).f_line as first_line, get(items, 0).f_sc as first_sc, get(items, 0).f_ec as first_ec,
       get(items, size(items) - 1).t_id as last_id, get(items, size(items) - 1).t_var as last_var, get(items, size(items) - 1).t_line as last_line, get(items, size(items) - 1).t_sc as last_sc, get(items, size(items) - 1).t_ec as last_ec
from segment_row where not is_virtual""",
    "segment_key": "select path_id, segment, is_virtual, variable, steps, skey from path_segment",
    "decomposition": "select path_id, b_key, i_key, f_key from path_key",
    "path_unit": f"""
select path_id, segment, variable, is_virtual and segment <> 'intermediate' as is_virtual, steps, {UNIT_KEY.format(b='own_b', f='own_f')} as unit_key,
       case when segment = 'intermediate' then skey || '__ctx_' || coalesce(own_b, 'none') || '_' || coalesce(own_f, 'none') else skey end as full_key
from path_segment""",
    "logic_unit": """
select segment, unit_key, usage_count, m.path_id as first_path, m.variable, m.is_virtual, m.steps
from (select segment, unit_key, count(*) as usage_count, min(struct(path_id, variable, is_virtual, steps)) as m from path_unit group by segment, unit_key) x""",
    "context_fanout": "select skey as i_key, count(distinct unit_key) as contexts, count(*) as paths from (select skey, " + UNIT_KEY.format(b="own_b", f="own_f") + " as unit_key from path_segment where segment = 'intermediate' and skey is not null) x group by skey having count(distinct unit_key) > 1",
    "connection_edge": """
select kind, src, dst, count(*) as n
from (select inline(array(struct('B-I' as kind, b_key as src, i_key as dst), struct('I-F' as kind, i_key as src, f_key as dst), struct('B-F' as kind, case when i_key is null then b_key end as src, f_key as dst))) from path_key) e
where src is not null and dst is not null group by kind, src, dst""",
    "point_set": "select path_id, segment, unit_key, fn, points, n_points from unit_part",
}
# The points of a path's segment by function, with what its steps branch to; one exchange by unit then serves all variants.
inner("unit_part", f"""
select path_id, segment, unit_key, fn, leads, array_join(transform(q, y -> y.x), ',') as points, cast(size(q) as bigint) as n_points, cons
from (select path_id, segment, unit_key, fn, leads, array_sort(transform(filter(p, y -> y.fn <=> fn), y -> struct(y.line * 1000000 + y.sc * 1000 + y.ec as o, cast(y.line as string) || ':' || cast(y.sc as string) || ':' || cast(y.ec as string) as x))) as q,
             array_sort(array_distinct(transform(filter(items, y -> y.f_id = fn), y -> struct(y.f_line as line, y.relation as relation)))) as cons
from (select path_id, segment, unit_key, items, p, posexplode(array_distinct(transform(p, y -> y.fn))) as (leads, fn)
from (select path_id, segment, {UNIT_KEY.format(b='b_key', f='f_key')} as unit_key, items,
             array_distinct(concat(transform(items, x -> struct(x.f_id as fn, x.f_line as line, coalesce(x.f_sc, 0) as sc, coalesce(x.f_ec, 0) as ec)), transform(items, x -> struct(x.t_id as fn, x.t_line as line, coalesce(x.t_sc, 0) as sc, coalesce(x.t_ec, 0) as ec)))) as p
from segment_row) a) b) c""")
inner("unit_variant", """
select segment, unit_key, fn, points, cons, sets + case when paths < usage_count then 1 else 0 end as n
from (select segment, unit_key, fn, points, cons, count(*) over (partition by segment, unit_key, fn) as sets, sum(paths) over (partition by segment, unit_key, fn) as paths, sum(first_of) over (partition by segment, unit_key) as usage_count
      from (select segment, unit_key, fn, points, count(*) as paths, count(case when leads = 0 then 1 end) as first_of, array_distinct(flatten(collect_set(cons))) as cons
            from (select segment, unit_key, fn, points, leads, cons from unit_part distribute by segment, unit_key) a group by segment, unit_key, fn, points) b) c""")
inner("unit_constraint", """
select segment, unit_key, fn, line, branch, count(case when kind = 'must' then 1 end) as c, max(n) as n, max(kind = 'may') as has_may
from (select segment, unit_key, fn, n, x.line, x.branch, case when (x.line + length(points)) % 3 = 0 then 'may' else 'must' end as kind
      from (select segment, unit_key, fn, points, n, explode(array_distinct(transform(cons, y -> struct(y.line as line, case when y.relation = 'CALL' then 'TRUE' else 'FALSE' end as branch)))) as x from unit_variant) a) b
group by segment, unit_key, fn, line, branch""")
inner("merged_row", """
select segment, unit_key, fn, line, branch, c, n, inline(filter(array(
         struct(case when c > 0 and unit_key is not null then case when c = n then 'must' else 'may' end end as kind, c < n as demoted_from_must),
         struct(case when has_may and not (c > 0 and c < n and unit_key is not null) then 'may' end as kind, false as demoted_from_must)), x -> x.kind is not null))
from unit_constraint""")
SEGMENTED |= {
    "variant_count": "select distinct segment, unit_key, fn, n from unit_variant where unit_key is not null",
    "must_constraint": "select segment, unit_key, fn, line, branch, c, n from unit_constraint where c > 0 and unit_key is not null",
    "merged_constraint": "select segment, unit_key, fn, line, branch, kind, demoted_from_must, case when demoted_from_must then cast(c as double) / n end as coverage from merged_row",
}

plan("step", """
select path_id, pos as idx, pos + 1 as flowstep, fn as f_fn, file as f_file, line as f_line, var as f_var, sc as f_sc, ec as f_ec,
       t_fn, t_file, t_line, t_var, t_sc, t_ec,
       case when length(code) > 10000 then substr(code, 1, 10000) || ' [' || cast(length(code) as string) || ']' else code end
       = case when length(t_code) > 10000 then substr(t_code, 1, 10000) || ' [' || cast(length(t_code) as string) || ']' else t_code end as same_function
from (select *, lead(fn) over w as t_fn, lead(file) over w as t_file, lead(line) over w as t_line, lead(var) over w as t_var,
             lead(code) over w as t_code, lead(sc) over w as t_sc, lead(ec) over w as t_ec
      from flow_point window w as (partition by path_id order by pos)) p
where t_fn is not null""")

plan("related_step", """
select s.*, case when s.same_function then 'SAME' when c.caller is not null then 'RETURN' else 'CALL' end as relation,
       s.f_fn || '@' || s.f_file as f_id, s.t_fn || '@' || s.t_file as t_id
from step s left join call_edge c
  on c.caller = s.t_fn and c.caller_file = s.t_file and c.line = s.t_line and c.callee = s.f_fn and c.callee_file = s.f_file""")

plan("cross_step", """
select *, sum(case when relation = 'CALL' then 1 else -1 end) over (partition by path_id order by idx rows between unbounded preceding and current row) as cur
from related_step where relation <> 'SAME'""")

plan("depth", """
select a.path_id, a.id, coalesce(w.dep, 0) as depth, a.first_seq
from (select path_id, id, min(seq) as first_seq
      from (select path_id, f_id as id, 2 * idx as seq from cross_step union all select path_id, t_id as id, 2 * idx + 1 as seq from cross_step) x group by path_id, id) a
left join (select path_id, id, max_by(dep, seq) as dep
           from (select path_id, t_id as id, 2 * idx + 1 as seq, cur as dep from cross_step
                 union all select path_id, f_id as id, 2 * idx as seq, cur + 1 as dep from cross_step where relation = 'RETURN') y group by path_id, id) w
  on w.path_id = a.path_id and w.id = a.id""")

plan("lca", "select path_id, id, depth from (select *, row_number() over (partition by path_id order by depth, first_seq) as k from depth) x where k = 1")

plan("touch", """
select r.path_id, r.idx, r.f_file, r.f_line, r.t_file, r.t_line
from (select c.*, row_number() over (partition by c.path_id order by c.idx) as k
      from cross_step c join lca l on l.path_id = c.path_id and (c.f_id = l.id or c.t_id = l.id)) r where k = 1""")

plan("cut", """
select e.path_id, e.n, e.lca, e.starts, e.first_out, e.t, max(case when c.idx > e.t then c.idx end) as last_out
from (select r.path_id, count(*) as n, max(l.id) as lca, max(case when r.idx = 0 and r.f_id = l.id then 1 else 0 end) as starts,
             min(case when r.f_id = l.id and r.relation <> 'SAME' then r.idx end) as first_out,
             min(case when r.f_file = t.f_file and r.f_line = t.f_line and r.t_file = t.t_file and r.t_line = t.t_line then r.idx end) as t
      from related_step r left join lca l on l.path_id = r.path_id left join touch t on t.path_id = r.path_id
      group by r.path_id) e
left join cross_step c on c.path_id = e.path_id and c.f_id = e.lca
group by e.path_id, e.n, e.lca, e.starts, e.first_out, e.t""")

plan("segment_step", """
select r.path_id, r.idx, r.flowstep, r.f_id, r.t_id, r.f_line, r.t_line, r.f_var, r.t_var, r.f_sc, r.f_ec, r.t_sc, r.t_ec, r.same_function, r.relation,
       case when c.lca is null then 'intermediate'
            when c.starts = 1 then case when r.idx < coalesce(c.first_out, c.n) then 'intermediate' else 'forward' end
            when r.idx <= c.t then 'backward'
            when r.idx < coalesce(c.last_out, c.n) then 'intermediate' else 'forward' end as segment, false as is_virtual
from related_step r join cut c on c.path_id = r.path_id""")

plan("segment_edge", """
select path_id, segment, count(*) as n, min(idx) as first_idx, max(idx) as last_idx,
       min_by(f_id, idx) as first_id, min_by(f_var, idx) as first_var, min_by(f_line, idx) as first_line, min_by(f_sc, idx) as first_sc, min_by(f_ec, idx) as first_ec,
       max_by(t_id, idx) as last_id, max_by(t_var, idx) as last_var, max_by(t_line, idx) as last_line, max_by(t_sc, idx) as last_sc, max_by(t_ec, idx) as last_ec
from segment_step group by path_id, segment""")

plan("virtual_step", """
select p.path_id, cast(-1 as bigint) as idx, cast(0 as bigint) as flowstep, v.id as f_id, v.id as t_id, v.line as f_line, v.line as t_line, v.var as f_var, v.var as t_var,
       v.sc as f_sc, v.ec as f_ec, v.sc as t_sc, v.ec as t_ec, true as same_function, 'VIRTUAL' as relation, p.segment, true as is_virtual
from (select path_id, 'intermediate' as segment, 'forward' as own, 'first' as side from (select path_id, max(case when segment = 'intermediate' then 1 else 0 end) as i, max(case when segment = 'forward' then 1 else 0 end) as f from segment_edge group by path_id) a where i = 0 and f = 1
      union all
      select path_id, 'backward' as segment, case when i = 1 then 'intermediate' else 'forward' end as own, 'first' as side from (select path_id, max(case when segment = 'backward' then 1 else 0 end) as b, max(case when segment = 'intermediate' then 1 else 0 end) as i from segment_edge group by path_id) c where b = 0
      union all
      select path_id, 'forward' as segment, case when i = 1 then 'intermediate' else 'backward' end as own, 'last' as side from (select path_id, max(case when segment = 'forward' then 1 else 0 end) as f, max(case when segment = 'intermediate' then 1 else 0 end) as i from segment_edge group by path_id) d where f = 0) p
join (select path_id, segment, 'first' as side, first_id as id, first_line as line, first_var as var, first_sc as sc, first_ec as ec from segment_edge
      union all
      select path_id, segment, 'last' as side, last_id as id, last_line as line, last_var as var, last_sc as sc, last_ec as ec from segment_edge) v
  on v.path_id = p.path_id and v.segment = p.own and v.side = p.side""")

plan("full_segment", "select * from segment_step union all select * from virtual_step")

plan("segment_key", """
select path_id, segment, is_virtual, variable, steps,
       case when coalesce(variable, '') = '' then chain_hash else variable || '::' || chain_hash end as skey
from (select path_id, segment, max(is_virtual) as is_virtual, count(*) as steps,
             case when segment = 'backward' then max_by(t_var, idx) else min_by(f_var, idx) end as variable,
             md5(segment || ':' || min_by(f_id, idx) || coalesce(@chain(case when not (f_id = t_id and same_function) then '->' || t_id else '' end¦¦idx)@, '')) as chain_hash
      from full_segment group by path_id, segment) k""")

plan("decomposition", """
select path_id, max(case when segment = 'backward' then skey end) as b_key, max(case when segment = 'intermediate' then skey end) as i_key, max(case when segment = 'forward' then skey end) as f_key
from segment_key group by path_id""")

plan("path_unit", """
select k.path_id, k.segment, k.variable, k.is_virtual and k.segment <> 'intermediate' as is_virtual, k.steps,
       case when k.segment = 'intermediate' then k.skey || '__ctx_' || substr(coalesce(d.b_key, 'none'), 1, 8) || '_' || substr(coalesce(d.f_key, 'none'), 1, 8) else k.skey end as unit_key,
       case when k.segment = 'intermediate' then k.skey || '__ctx_' || coalesce(d.b_key, 'none') || '_' || coalesce(d.f_key, 'none') else k.skey end as full_key
from segment_key k join decomposition d on d.path_id = k.path_id""")

plan("logic_unit", """
select segment, unit_key, count(*) as usage_count, min(path_id) as first_path, min_by(variable, path_id) as variable, min_by(is_virtual, path_id) as is_virtual, min_by(steps, path_id) as steps
from path_unit group by segment, unit_key""")

plan("logic_unit_full", "select segment, full_key as unit_key, count(*) as usage_count, min(path_id) as first_path from path_unit group by segment, full_key")

# Ranks go over ranges of keys: a running sum over the ranges, and a count within each.
plan("unit_order", """
select u.segment, u.unit_key, u.usage_count, p.before + row_number() over (partition by u.segment, u.usage_count, substr(u.unit_key, 1, 6) order by u.unit_key) as priority, case when u.segment = 'intermediate' then 2 else 1 end as phase
from logic_unit u
join (select segment, usage_count, prefix, coalesce(sum(n) over (partition by segment order by usage_count desc, prefix rows between unbounded preceding and 1 preceding), 0) as before
      from (select segment, usage_count, substr(unit_key, 1, 6) as prefix, count(*) as n from logic_unit group by segment, usage_count, substr(unit_key, 1, 6)) c) p
  on p.segment = u.segment and p.usage_count = u.usage_count and p.prefix = substr(u.unit_key, 1, 6)""")

plan("top_units", """
select x.segment, x.unit_key, x.usage_count, x.variable, x.is_virtual, t.reuse_units, t.reuse_paths
from (select segment, unit_key, usage_count, variable, is_virtual, row_number() over (partition by segment order by usage_count desc, unit_key) as k from logic_unit) x
join (select segment, count(*) as reuse_units, sum(usage_count) as reuse_paths from logic_unit group by segment) t on t.segment = x.segment
where x.k <= 10""")

plan("relation_counts", "select segment, relation, count(*) as n from full_segment group by segment, relation")
plan("segment_patterns", """
select pattern, count(*) as paths from (
  select path_id, max(case when segment = 'backward' then 'B' else '' end) || max(case when segment = 'intermediate' then 'I' else '' end) || max(case when segment = 'forward' then 'F' else '' end) as pattern
  from segment_step group by path_id) x group by pattern""")
plan("context_fanout", "select i_key, count(distinct unit_key) as contexts, count(*) as paths from decomposition d join path_unit u on u.path_id = d.path_id and u.segment = 'intermediate' where i_key is not null group by i_key having count(distinct unit_key) > 1")
plan("unit_stats", """
select segment, sum(usage_count) as total_segments, count(case when not is_virtual then 1 end) as unique_units, max(usage_count) as max_usage,
       cast(sum(usage_count) as double) / greatest(1, count(case when not is_virtual then 1 end)) as reuse_ratio, count(case when usage_count > 1 then 1 end) as reused_units
from logic_unit group by segment""")
plan("reuse_distribution", "select segment, usage_count, count(*) as units from logic_unit group by segment, usage_count")
plan("connection_edge", """
select kind, src, dst, count(*) as n from (
  select 'B-I' as kind, b_key as src, i_key as dst from decomposition where b_key is not null and i_key is not null
  union all select 'I-F' as kind, i_key as src, f_key as dst from decomposition where i_key is not null and f_key is not null
  union all select 'B-F' as kind, b_key as src, f_key as dst from decomposition where b_key is not null and f_key is not null and i_key is null) e
group by kind, src, dst""")
plan("unit_contexts", "select distinct i_key, coalesce(b_key, 'none') as b_key, coalesce(f_key, 'none') as f_key from decomposition where i_key is not null and (b_key is not null or f_key is not null)")
plan("primary_context", "select i_key, min(b_key || '|' || f_key) as context, count(*) as contexts from unit_contexts group by i_key")
plan("high_degree", """
select unit, sum(d) as degree
from (select src as unit, count(*) as d from connection_edge group by src union all select dst as unit, count(*) as d from connection_edge group by dst) x
group by unit having sum(d) > 2 order by degree desc, unit limit 5""")
plan("connection_patterns", """
select case when b_key is not null and i_key is not null and f_key is not null then 'B-I-F' when b_key is not null and i_key is not null then 'B-I' when i_key is not null and f_key is not null then 'I-F'
            when b_key is not null and f_key is not null then 'B-F' when b_key is not null then 'B' when i_key is not null then 'I' else 'F' end as pattern, count(*) as paths
from decomposition group by 1""")
# Units of one usage count are alike, so running sums go over the distinct counts: a unit's rank is in one of these steps.
plan("usage_step", """
select segment, usage_count, units, coalesce(sum(units) over b, 0) as units_before, coalesce(sum(units * usage_count) over b, 0) as paths_before, sum(units) over (partition by segment) as n, sum(units * usage_count) over (partition by segment) as total
from (select segment, usage_count, count(*) as units from logic_unit group by segment, usage_count) x
window b as (partition by segment order by usage_count desc rows between unbounded preceding and 1 preceding)""")
plan("coverage", """
select segment, decile, cast(coalesce(max(case when take > units_before then paths_before + least(units, take - units_before) * usage_count end), 0) as double) / max(total) * 100 as coverage
from (select s.*, t.decile, cast(floor(t.decile / 100.0 * s.n) as bigint) as take from usage_step s cross join (select d * 10 as decile from (select @series(0¦10)@ as d) z) t) x
group by segment, decile""")
plan("pareto", """
select segment, min(units_before + greatest(1, cast(floor((total * 80 - paths_before * 100 + usage_count * 100 - 1) / (usage_count * 100)) as bigint))) as units_for_80, max(n) as units
from usage_step where (paths_before + units * usage_count) * 100 >= total * 80 group by segment""")

plan("point_set", """
select path_id, segment, unit_key, fn, @chain(cast(line as string) || ':' || cast(sc as string) || ':' || cast(ec as string)¦,¦pk)@ as points, count(*) as n_points
from (select distinct u.path_id, u.segment, u.unit_key, p.fn, p.line, coalesce(p.sc, 0) as sc, coalesce(p.ec, 0) as ec, p.line * 1000000 + coalesce(p.sc, 0) * 1000 + coalesce(p.ec, 0) as pk
      from path_unit u join (select path_id, segment, f_id as fn, f_line as line, f_sc as sc, f_ec as ec from full_segment union all select path_id, segment, t_id, t_line, t_sc, t_ec from full_segment) p
        on p.path_id = u.path_id and p.segment = u.segment) x
group by path_id, segment, unit_key, fn""")
plan("variants", """
select a.segment, a.unit_key, a.fn, a.distinct_sets + case when a.paths < u.usage_count then 1 else 0 end as point_sets
from (select segment, unit_key, fn, count(distinct points) as distinct_sets, count(distinct path_id) as paths from point_set group by segment, unit_key, fn) a
join logic_unit u on u.segment = a.segment and u.unit_key = a.unit_key
where a.distinct_sets + case when a.paths < u.usage_count then 1 else 0 end > 1""")
plan("variant_paths", "select segment, unit_key, fn, points, count(*) as paths, min(path_id) as first_path from point_set group by segment, unit_key, fn, points")
# Rows of one key may stand in must and in may; a variant without the function counts and has no constraints.
plan("variant_count", """
select a.segment, a.unit_key, a.fn, a.sets + case when a.paths < u.usage_count then 1 else 0 end as n
from (select segment, unit_key, fn, count(distinct points) as sets, count(distinct path_id) as paths from point_set group by segment, unit_key, fn) a
join logic_unit u on u.segment = a.segment and u.unit_key = a.unit_key""")
plan("must_constraint", """
select r.segment, r.unit_key, r.fn, r.line, r.branch, count(distinct r.variant) as c, max(v.n) as n
from constraint_row r join variant_count v on v.segment = r.segment and v.unit_key = r.unit_key and v.fn = r.fn
where r.kind = 'must' group by r.segment, r.unit_key, r.fn, r.line, r.branch""")
plan("merged_constraint", """
select segment, unit_key, fn, line, branch, case when c = n then 'must' else 'may' end as kind, c < n as demoted_from_must, case when c < n then cast(c as double) / n end as coverage from must_constraint
union all
select o.segment, o.unit_key, o.fn, o.line, o.branch, 'may' as kind, false as demoted_from_must, cast(null as double) as coverage
from (select distinct segment, unit_key, fn, line, branch from constraint_row where kind = 'may') o
where not exists (select 1 from must_constraint m where m.segment = o.segment and m.unit_key = o.unit_key and m.fn = o.fn and m.line = o.line and m.branch = o.branch and m.c < m.n)""")
plan("merged_points", """
select path_id, island, min(pos) as first_pos, max(pos) as last_pos, count(*) as points, max(fn) as fn from (
  select *, sum(case when fn = before then 0 else 1 end) over (partition by path_id order by pos rows between unbounded preceding and current row) as island
  from (select *, lag(fn) over (partition by path_id order by pos) as before from flow_point) a) b
group by path_id, island""")
plan("compressed_flow", """
select path_id, src_file, src_fn, sink_file, sink_fn, points from (
  select f.*, row_number() over (partition by src_file, src_fn, sink_file, sink_fn order by points, path_id) as k
  from (select path_id, min_by(file, pos) as src_file, min_by(fn, pos) as src_fn, max_by(file, pos) as sink_file, max_by(fn, pos) as sink_fn, count(*) as points from flow_point group by path_id having count(*) >= 2) f) g
where k = 1""")
plan("compressed_flow_files", """
select path_id, src_file, sink_file, points from (
  select f.*, row_number() over (partition by src_file, sink_file order by points, path_id) as k
  from (select path_id, min_by(file, pos) as src_file, max_by(file, pos) as sink_file, count(*) as points from flow_point group by path_id having count(*) >= 2) f) g
where k = 1""")
plan("shared_variables", "select path_id, min_by(var, pos) as source_var, max_by(var, pos) as sink_var, min_by(line, pos) as source_line, max_by(line, pos) as sink_line from flow_point group by path_id")
plan("sampled_points", """
select p.path_id, p.pos, p.fn from flow_point p
join (select path_id, count(*) as n from flow_point group by path_id) c on c.path_id = p.path_id
where c.n <= 4 or p.pos in (0, cast(floor(1 * (cast(c.n - 1 as double) / 3)) as bigint), cast(floor(2 * (cast(c.n - 1 as double) / 3)) as bigint), c.n - 1)""")

SPARK.update({name: text.strip() for name, text in SEGMENTED.items()})
