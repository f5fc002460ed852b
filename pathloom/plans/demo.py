"""Domain tables projected from the driver's tables (the reference ships no inputs)."""

from .core import inner, plan

# Spark keeps the partitions by path that the numbers of points need, and texts are made behind that exchange.
plan("flow_point", """
select l_orderkey as path_id,
       row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as pos,
       'f' || cast(l_suppkey % 7 as string) as fn, 's' || cast(l_suppkey % 3 as string) || '.c' as file,
       l_partkey % 200 as line, l_returnflag as var,
       'f' || cast(l_suppkey % 7 as string) || 's' || cast(l_suppkey % 3 as string) || '.c' as code,
       cast(l_linenumber as bigint) as sc, cast(l_linenumber as bigint) + cast(l_quantity as bigint) as ec
from lineitem""", spark="""
select path_id, pos, 'f' || cast(l_suppkey % 7 as string) as fn, 's' || cast(l_suppkey % 3 as string) || '.c' as file,
       l_partkey % 200 as line, l_returnflag as var,
       'f' || cast(l_suppkey % 7 as string) || 's' || cast(l_suppkey % 3 as string) || '.c' as code,
       cast(l_linenumber as bigint) as sc, cast(l_linenumber as bigint) + cast(l_quantity as bigint) as ec
from (select path_id, row_number() over (partition by path_id order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as pos,
             l_suppkey, l_partkey, l_returnflag, l_linenumber, l_quantity
      from (select l_orderkey as path_id, l_suppkey, l_partkey, l_returnflag, l_linenumber, l_quantity, l_extendedprice, l_shipdate from lineitem) a) b""")

plan("call_edge", """
select distinct case when t_line % 2 = 0 then t_fn else f_fn end as caller, case when t_line % 2 = 0 then t_file else f_file end as caller_file,
       case when t_line % 2 = 0 then t_line else f_line end as line,
       case when t_line % 2 = 0 then f_fn else t_fn end as callee, case when t_line % 2 = 0 then f_file else t_file end as callee_file
from step""")

plan("function_def", """
select p_partkey as ordinal, 'g' || cast(p_partkey % 40 as string) as name, 'ns::g' || cast(p_partkey % 40 as string) as qname,
       case when p_partkey % 2 = 0 then 'src/' else 'lib/' end || 's' || cast(p_partkey % 3 as string) || '.c' as file_path,
       's' || cast(p_partkey % 3 as string) || '.c' as base, (p_partkey % 50) * 10 as start_line, (p_partkey % 50) * 10 + p_size as end_line
from part""")

plan("use_site", """
select event_id as site, event_id % 500 as line, case when user_id % 2 = 0 then 'src/' else 'lib/' end || 's' || cast(user_id % 3 as string) || '.c' as file_path,
       's' || cast(user_id % 3 as string) || '.c' as base, 'g' || cast(event_id % 60 as string) as name
from events""")

plan("macro_def", "select s_suppkey as ordinal, 'g' || cast(s_suppkey % 90 as string) as name, 'm' || cast(s_suppkey % 5 as string) as body, 's' || cast(s_suppkey % 3 as string) || '.c' as base, s_suppkey % 500 as line from supplier")
plan("global_var", "select c_custkey as ordinal, 'g' || cast(c_custkey % 120 as string) as name, c_mktsegment as type_name from customer")
plan("class_def", "select n_nationkey as ordinal, 'g' || cast(n_nationkey + 40 as string) as name, n_name as qname from nation")

plan("bb_edge", """
select fn, src, dst, max_by(etype, ordinal) as etype
from (select l_orderkey - l_orderkey % 4 as fn, l_partkey % 12 as src, l_suppkey % 12 as dst,
             case l_returnflag when 'A' then 'TRUE' when 'R' then 'FALSE' else 'UNCONDITIONAL' end as etype,
             struct_key as ordinal
      from (select *, cast(l_orderkey as string) || '/' || cast(l_linenumber as string) || '/' || cast(l_partkey as string) || '/' || cast(l_suppkey as string) || '/' || l_returnflag as struct_key from lineitem) x
      where l_partkey % 12 <> l_suppkey % 12) y
group by fn, src, dst""")

plan("labelled_function", """
select d.doc_id as ordinal, d.source as file, d.doc_id as line,
       case when l.quality = 1 then 'good' when l.quality = 0 then 'bad' else 'unknown' end as kind,
       'fn' || cast(d.doc_id % 50 as string) as fn
from documents d left join labels l on d.doc_id = l.doc_id""")

plan("cache_row", """
select o_orderkey as ordinal, 'cwe' || cast(o_custkey % 5 as string) as cwe_code, o_orderstatus as analysis_type, cast(o_custkey % 40 as string) as variable_name,
       md5(cast(o_custkey as string)) as chain_hash, case when o_custkey % 3 = 0 then '0' else md5('b' || cast(o_custkey as string)) end as backward_hash,
       o_orderpriority as result
from orders""")

plan("iteration", """
select user_id as query, row_number() over (partition by user_id order by ts, event_id) as iteration, cast(floor(value) as bigint) as result_count, event_type
from events""")

plan("code_point", """
select path_id, pos, file as file_path, line, case when line % 17 = 0 then '' else fn end as fn, var as variable, sc, ec, code as related_code,
       case line % 5 when 0 then 'static int run(char *' || var || ', int n)' when 1 then 'x = ' || var || ' + 1;' when 2 then '  go(' || var || ');' when 3 then 'return )' || var || '(;' else 'void ' || var || ' (int q) {' end as line_code,
       case pos % 5 when 0 then null when 1 then '... = ...' when 2 then ' *call to get ' when 3 then '[summary param] x' else var end as semantic_label
from flow_point""")

plan("location", """
select l_orderkey as result_idx, 'cpp/rule-' || cast(l_orderkey % 4 as string) as rule_id, l_suppkey % 2 as flow_idx, l_linenumber % 2 as tf_idx,
       row_number() over (partition by l_orderkey, l_suppkey % 2, l_linenumber % 2 order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as loc_idx,
       case l_partkey % 3 when 0 then 'file:///' when 1 then 'file:' else '/' end || case when l_partkey % 2 = 0 then 'src/' else 'lib/' end || 's' || cast(l_suppkey % 3 as string) || '.c' as uri,
       (l_partkey * 7) % 560 as line, cast(l_linenumber as bigint) as sc, cast(l_linenumber as bigint) + cast(l_quantity as bigint) as ec, l_returnflag as label
from lineitem""")

plan("source_line", "select 'd' || cast(doc_id as string) || '.c' as file, n + 1 as line, line as text from (select doc_id, @numbered(text)@ from documents where text is not null) x")

plan("block", """
select fn, b as block, cast(sl as string) || '.1_' || cast(el as string) || '.9' as bb_id, sl, cast(1 as bigint) as sc, el, cast(9 as bigint) as ec, is_entry, is_exit
from (select fn, block as b, block * 10 as sl, block * 10 + case when block % 5 = 4 then -3 else block % 4 * 6 + 2 end as el, is_entry, is_exit from bb_flags) x""")

plan("block_point", "select distinct user_id - user_id % 4 as fn, event_id % 140 as line from events")
plan("macro_use", "select s_suppkey as ordinal, 'g' || cast(s_suppkey % 90 as string) as name, case when s_suppkey % 2 = 0 then 'src/' else 'lib/' end || 's' || cast(s_suppkey % 3 as string) || '.c' as use_file, 's' || cast(s_suppkey % 3 as string) || '.c' as base, s_suppkey * 37 % 500 as use_line, 'inc/m' || cast(s_suppkey % 7 as string) || '.h' as def_file, 'm' || cast(s_suppkey % 5 as string) as body from supplier")
plan("requested_symbol", "select event_id as site, case event_id % 9 when 0 then '' when 1 then 'util/g1.c' when 2 then 'g1.h' when 3 then 'ns::g' || cast(event_id % 60 as string) when 4 then '9g' when 5 then 'std::move' when 6 then '__builtin_expect' when 7 then 'strlen' else 'g' || cast(event_id % 60 as string) end as name, 's' || cast(user_id % 3 as string) || '.c' as base, case when user_id % 2 = 0 then 'src/' else 'lib/' end as dir, event_id % 500 as line from events")
plan("library_name", "select distinct case p_partkey % 50 when 0 then 'strlen' when 1 then 'memcpy' when 2 then 'sqrt' else 'lib' || cast(p_partkey as string) end as name from part")
plan("alert", "select event_id as site, case event_id % 13 when 0 then 'lib/' when 1 then 'x/juliet-test-suite-c/' else '' end || 'src' || cast(user_id % 20 as string) || case when event_id % 17 = 0 then '/main.cpp' else '' end as file, event_id % 1000 as line, cast(user_id as bigint) as flow, event_id as pos from events")
plan("probe", "select c_custkey as ordinal, 'cwe' || cast(c_custkey % 5 as string) as cwe_code, cast(c_custkey % 40 as string) as variable_name, md5(cast(c_custkey as string)) as chain_hash, case when c_custkey % 3 = 0 then '0' else md5('b' || cast(c_custkey as string)) end as backward_hash, '0' as forward_hash, 'p' as project, case c_custkey % 3 when 0 then 'F' when 1 then 'O' else 'P' end as analysis_type from customer")
plan("recorded_result", "select o_orderkey as ordinal, case o_orderstatus when 'F' then true when 'O' then false end as fp, substr(o_orderpriority, 3) as level from orders")
plan("token_row", "select event_type as model_name, cast(floor(value) as bigint) as prompt_tokens, event_id as ordinal from events")
plan("work_item", "select source as item, doc_id from documents")
plan("processed_item", "select distinct d.source as item from documents d join labels b on d.doc_id = b.doc_id where b.toxic = 1")
plan("query_text", "select doc_id as file, '@name q' || cast(doc_id as string) || case when doc_id % 3 = 0 then ' @kind problem' else ' @kind path-problem' end || ' external/cwe/cwe-' || case when doc_id % 5 = 0 then '0' else '' end || cast(20 + doc_id % 60 as string) || ' external/cwe/cwe-' || cast(doc_id % 40 + 100 as string) || case when doc_id % 4 = 0 then ' select 1' else ' from X where y select z' end as text from documents")
plan("unit_result", """
select segment, unit_key, usage_count, usage_count % 3 = 0 as cached, usage_count % 3 <> 0 and usage_count % 11 <> 0 as analysed,
       case usage_count % 4 when 0 then null when 1 then true else false end as fp, case usage_count % 5 when 0 then 'HIGH' when 1 then 'medium' when 2 then 'low' when 3 then 'odd' else null end as level
from logic_unit""")
plan("suite_function", "select 'CWE' || cast(doc_id % 90 + 20 as string) || '_' || source || '_' || case doc_id % 7 when 0 then 'bad' when 1 then 'goodG2B' when 2 then cast(doc_id as string) when 3 then 'badSink' when 4 then 'helper' when 5 then 'Good1' else '9_good' end as fn from documents union all select '~CWE' || cast(doc_id as string) || case doc_id % 3 when 0 then '_bad' when 1 then '_good' else '_12' end as fn from documents")

plan("source_loop", """
select fn, loop_line, max(end_line) as end_line, max(cond_line) as cond_line
from (select o_orderkey - o_orderkey % 4 as fn, o_custkey % 12 * 10 as loop_line, o_custkey % 12 * 10 + 10 * (1 + o_custkey % 9) as end_line, case when o_custkey % 4 <> 0 then o_custkey % 12 * 10 + 1 end as cond_line from orders) x
group by fn, loop_line""")

plan("constraint_row", """
select segment, unit_key, fn, points as variant, f_line as line, case when relation = 'CALL' then 'TRUE' else 'FALSE' end as branch, case when (f_line + length(points)) % 3 = 0 then 'may' else 'must' end as kind
from (select distinct s.segment, s.unit_key, s.fn, s.points, q.f_line, q.relation from point_set s join full_segment q on q.path_id = s.path_id and q.segment = s.segment and q.f_id = s.fn) x""", spark="""
select segment, unit_key, fn, points as variant, x.line, case when x.relation = 'CALL' then 'TRUE' else 'FALSE' end as branch, case when (x.line + length(points)) % 3 = 0 then 'may' else 'must' end as kind
from (select distinct segment, unit_key, fn, points, x from (select segment, unit_key, fn, points, explode(cons) as x from unit_part) y) z""")
plan("graph_point", """
select function_id, line, cast(substr(function_id, 2, 1) as bigint) * 4 + cast(substr(function_id, 5, 1) as bigint) * 28 as fn, line % 140 as graph_line, line % 17 = 0 as is_parameter, cast(0 as bigint) as start_line
from (select f_id as function_id, f_line as line from full_segment union select t_id as function_id, t_line as line from full_segment) x""", spark="""
select function_id, line, cast(substr(function_id, 2, 1) as bigint) * 4 + cast(substr(function_id, 5, 1) as bigint) * 28 as fn, line % 140 as graph_line, line % 17 = 0 as is_parameter, cast(0 as bigint) as start_line
from (select distinct function_id, line from (select inline(array(struct(f_fn || '@' || f_file as function_id, f_line as line), struct(t_fn || '@' || t_file as function_id, t_line as line))) from step where path_id is not null) y) x""")
plan("point_candidate", """
select event_id - event_id % 8 as question, event_id % 3 as point,
       cast(event_id % 5 * 10 as string) || '.1_' || cast(event_id % 5 * 10 + user_id % 4 as string) || '.9' || case user_id % 5 when 0 then '' when 1 then '' when 2 then '_L10i2' when 3 then '_L10i2_L0i2' else '_L0i2' end as block_id, user_id % 4 + 1 as size
from events""")
plan("function_call", "select 'h' || cast(l_partkey % 997 as string) as caller, 'h' || cast(l_suppkey * 7 % 997 as string) as callee from lineitem where l_linenumber = 1 group by 1, 2")
plan("function_entry", "select 'h' || cast(p_partkey % 997 as string) as function from part group by 1")
plan("function_block", "select 'h' || cast(l_partkey % 997 as string) as function, l_suppkey % 9 as block, min(cast(l_suppkey % 9 as string) || '.' || case when l_suppkey % 9 = 0 then '0' else '1' end || '_' || cast(l_suppkey % 9 + 2 as string) || '.9') as bb_id from lineitem group by 1, 2")
plan("function_edge", "select 'h' || cast(l_partkey % 997 as string) as function, l_suppkey % 9 as src, l_linenumber % 9 as dst from lineitem group by 1, 2, 3")
# Replies of several forms, some of them broken, with the texts of conversations as what they say.
plan("reply", """
select site, case k
    when 0 then '{"analysis": "' || t || '", "rule_checks": [{"rule_text": "r' || n || '", "check_result": "ok", "code_references": ["f' || n || '.c:1", "g.c:2"]}, {"rule_text": "s", "check_result": "", "code_references": []}]}'
    when 1 then '```json' || chr(10) || '{"needed_functions_not_provided": ["f' || n || '", "g' || n || '", "f' || n || '"], "why": "' || t || '"}' || chr(10) || '```'
    when 2 then '{"analysis": "' || t || '" "rule_checks": [{"rule_text": "r"}]}'
    when 3 then '{"feasibility": true, "feasibility_reason": "' || t || '", "required_conditions_code": null, "purpose_rule_checks": [{"rule_text": "p' || n || '", "check_result": "no", "code_references": ["x"]}], "is_false_positive": false, "false_positive_confidence": "LOW"}'
    when 4 then '{"analysis": "' || t || '", "purpose_rule_checks": [{"rule_text": "p", "code_references": ["y' || n || '"]}]}'
    when 5 then '{"analysis": "' || t
    when 6 then 'It''s open. "needed_functions_not_provided": ["a' || n || '", "b"] ' || t
    when 7 then '{"analysis": 1, "rule_checks": [{"findings": "' || t || '", "what_checked": "w' || n || '"}]}'
    when 8 then '{{"analysis": "' || t || '", "list": [{{"a": 1}}]}}'
    when 9 then '["' || t || '"]' when 10 then '' else t end as content
from (select conv_id * 10000 + coalesce(turn, 0) as site, cast(conv_id % 100 as string) as n, (conv_id + coalesce(turn, 0)) % 12 as k, replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') as t from conversations where conv_id is not null) x""")

plan("reported_start", "select 'd' || cast(doc_id as string) || '.c' as file, cast(doc_id % 7 + 1 as bigint) as line from documents union all select 'd' || cast(doc_id as string) || '.c' as file, cast(doc_id % 7 + 9 as bigint) as line from documents")
plan("graph_function", "select name, base, start_line from function_def where ordinal % 2 = 0")
plan("cached_graph", "select name, qname, base from function_def where ordinal % 3 = 0")
plan("name_asked", "select distinct case when ordinal % 2 = 0 then qname when ordinal % 3 = 0 then 'missing' || name else name end as asked from function_def")
plan("code_line", "select distinct file_path as file, line, line_code || case when line % 3 = 0 then ' if (g' || cast(line % 60 as string) || '(a, next(b))) g1 (c); g1(d);' else '' end as text from code_point")
plan("related_code", "select path_id, 'File Path: ' || min(file) || chr(10) || replace(@chain(' ' || cast(line as string) || ': x = m(' || var || ');'¦~¦line * 100 + pos)@, '~', chr(10)) as text from flow_point where path_id % 5 <> 0 group by path_id union all select path_id, 'no path here' as text from flow_point where path_id % 5 = 0 group by path_id")

# Results of four queries on three weaknesses, first runs and iterations, and the functions of their suites.
plan("stored_place", """
select cwe, query, iteration, result_idx, case line % 7 when 0 then 'lib/other.c' when 1 then '/juliet-test-suite-c/testcases/CWE' || cast(cwe as string) || '_x/s1/main.cpp' when 2 then '/juliet-test-suite-c/testcases/CWE' || cast(cwe as string) || '_x/' || short
            when 3 then 'lib/CWE9_' || case when n = 1 then 'bad' when n = 2 then 'good' else 'odd' end || '.c' else short end as uri, case when line % 7 = 3 and n < 4 then 0 else line end as line
from (select 20 + l_orderkey % 3 as cwe, 'q' || cast(l_suppkey % 4 as string) as query, cast(l_orderkey % 4 as bigint) as iteration, l_orderkey as result_idx, l_linenumber as n, l_partkey % 400 as line,
             's' || cast(l_suppkey % 5 as string) || '/CWE' || cast(20 + l_orderkey % 3 as string) || '_t' || cast(l_partkey % 2 as string) || '.c' as short from lineitem) x""")
plan("stored_function", """
select cwe, '/juliet-test-suite-c/testcases/CWE' || cast(cwe as string) || '_x/s' || cast(s as string) || '/CWE' || cast(cwe as string) || '_t' || cast(t as string) || '.c' as file, slot * 10 as start_line, slot * 10 + min(size) as end_line,
       'CWE' || cast(cwe as string) || '_' || cast(slot as string) || case slot % 4 when 0 then '_bad' when 1 then '_goodB2G' when 2 then '_helper' else 'BadSink' end as function
from (select 20 + p_partkey % 3 as cwe, p_partkey % 5 as s, p_partkey % 2 as t, p_partkey % 41 as slot, p_size % 7 as size from part) x group by cwe, s, t, slot""")

plan("asked_id", "select distinct case event_id % 9 when 0 then '12.3' when 1 then 'x.1_2.3' when 2 then '0.0_0.0' when 3 then cast(user_id as string) || '.4_' || cast(event_id % 90 as string) || '.1_L10i2' when 4 then '7.2_9.1_L3i2_L1i2' when 5 then '' when 6 then cast(user_id as string) || '_' || cast(user_id + 3 as string) when 7 then '5.1_b' else cast(event_id % 90 as string) || '.1_' || cast(user_id as string) || '.9' end as block_id from events")
plan("asked_block", "select 'd' || cast(doc_id as string) || '.c' as file, cast(doc_id % 4 as string) || '.' || cast(1 + doc_id % 5 as string) || '_' || cast(doc_id % 3 + doc_id % 4 as string) || '.' || cast(doc_id % 60 as string) || case when doc_id % 6 = 0 then '_L1i2' else '' end as block_id from documents where doc_id is not null")
plan("shown_constraint", "select fn, src * 100 + dst as place, case when dst = 5 then 0 else src * 10 end as line, etype as branch, case dst % 4 when 0 then 'UNKNOWN' when 1 then ' c' || cast(src as string) || ' ' when 2 then null else '' end as condition, case when src % 3 = 0 then '' else cast(src as string) || '.1_9.2' || case when src % 2 = 0 then '_L10i2' else '' end end as block_id from bb_edge where etype <> 'UNCONDITIONAL'")
plan("query_version", "select doc_id as file, v as version, 'import cpp' || chr(10) || case when (doc_id + v) % 3 = 0 then 'import x.y' || chr(10) || ' import z' || chr(10) else '' end || case when (doc_id * v) % 4 = 1 then 'predicate p(int i) {' || chr(10) || '}' || chr(10) else '' end || case when v = 2 then coalesce(text, '') else '' end as text from (select doc_id, text, @series(1¦3)@ as v from documents) x")
plan("raw_call", "select event_id as ordinal, event_id % 1500 + 1 as target, case event_id % 5 when 0 then '/usr/include/' when 1 then '/src/usr/include' else 'src/' end || 's' || cast(user_id % 3 as string) || '.c' as use_file, event_id % 500 as use_line from events")
plan("raw_class", "select c_custkey as ordinal, 'k' || cast(c_custkey % 50 as string) as name, 'ns::k' || cast(c_custkey % 50 as string) as qname, case c_custkey % 4 when 0 then '/usr/include/c++/' when 1 then 'x/usr/include' else 'src/' end || 'k.h' as file_path from customer")
plan("raw_global", "select s_suppkey as ordinal, 'v' || cast(s_suppkey % 50 as string) as name, s_name as type_name, case s_suppkey % 3 when 0 then '/usr/include/' else 'src/' end || 'v.h' as file_path from supplier")
plan("raw_body", "select ordinal, case when ordinal % 5 = 0 then 'gen/' || base else file_path end as body_file from function_def")
plan("text_function", "select 'd' || cast(doc_id as string) || '.c' as file, 'fn' || cast(k as string) as name, k * 3 + doc_id % 2 as start_line, k * 3 + doc_id % 2 + doc_id % 5 as end_line from (select doc_id, @series(1¦3)@ as k from documents where doc_id is not null) x")
plan("text_site", "select event_id as site, 'd' || cast(event_id % 1000 as string) || '.c' as file, cast(user_id % 13 as bigint) as line from events")
plan("unit_turn", "select u.segment, u.unit_key, c.turn, c.role, c.text from logic_unit u join conversations c on c.conv_id = u.first_path % 100")
plan("path_turn", "select p.path_id, p.segment as phase, t.unit_key, t.turn, t.role, t.text from path_unit p join unit_turn t on t.segment = p.segment and t.unit_key = p.unit_key")
# Which conversation is whose, without its texts.
inner("unit_talk", "select segment, unit_key, first_path % 100 as conv_id from logic_unit")
inner("path_talk", "select p.path_id, p.segment as phase, t.unit_key, t.conv_id from path_unit p join unit_talk t on t.segment = p.segment and t.unit_key = p.unit_key")
plan("debug_row", "select 'segment' as type, segment || ':' || cast(path_id as string) as id, skey as detail from segment_key union all select 'unit' as type, segment || ':' || unit_key as id, cast(usage_count as string) as detail from logic_unit union all select 'connection' as type, kind || ':' || src || ':' || dst as id, cast(n as string) as detail from connection_edge union all select 'context_unit' as type, i_key || ':' || b_key || ':' || f_key as id, '' as detail from unit_contexts")

#: Views that only stand in for a domain's tables; they are no queries of their own.
DOMAIN = frozenset("asked_id asked_block shown_constraint query_version raw_call raw_class raw_global raw_body text_function text_site unit_turn path_turn debug_row rows_debug stored_place stored_function stored_hit stored_score stored_report source_loop graph_point point_candidate function_call function_entry function_block function_edge reply reported_start graph_function cached_graph name_asked code_line related_code assessed_before".split())
