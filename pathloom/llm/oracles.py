"""DuckDB SQL of the operators that SQL can express, written from their contracts and not from their code."""

#: Words as in the contract: A-Z lower-cased, runs of anything but the six bytes of white space.
_WORDS = """select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents"""

NGRAM_JOIN = f"""
with recursive d as ({_WORDS}),
s as (select distinct doc_id, sh from (
  select doc_id, unnest(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from d) x),
n as (select d.doc_id, count(s.sh) as n from d left join s on s.doc_id = d.doc_id group by d.doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
link as (select met.a, met.b from met join n na on na.doc_id = met.a join n nb on nb.doc_id = met.b where 100 * met.c >= 80 * (na.n + nb.n - met.c)),
edge as (select a, b from link union all select b, a from link),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on e.a = r.b)
select n.doc_id, cast(n.n as bigint) as n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id
from n left join reach r on r.a = n.doc_id group by n.doc_id, n.n"""

#: The 50-byte strings of each text as 100 hexadecimal digits; a run ends where the next removed string begins beyond its end.
SUFFIX_DEDUP = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
p as (select doc_id, i as pos, substr(h, 2 * i + 1, 100) as str from (select doc_id, h, unnest(generate_series(0, cast(length(h) // 2 as bigint) - 50)) as i from d) x),
f as (select str, min(doc_id) as first_doc from p group by str having min(doc_id) < max(doc_id)),
hit as (select p.doc_id, p.pos from p join f on f.str = p.str and f.first_doc < p.doc_id),
run as (select doc_id, min(pos) as lo, max(pos) + 50 as hi from (
  select *, sum(case when pos - before <= 50 then 0 else 1 end) over (partition by doc_id order by pos rows unbounded preceding) as island
  from (select *, lag(pos) over (partition by doc_id order by pos) as before from hit) x) y group by doc_id, island),
gap as (select r.doc_id, coalesce(lag(r.hi) over (partition by r.doc_id order by r.lo), 0) as lo, r.lo as hi from run r
  union all select doc_id, max(hi) as lo, cast(null as bigint) as hi from run group by doc_id),
kept as (select g.doc_id, string_agg(case when g.hi is null then substr(d.h, 2 * g.lo + 1) else substr(d.h, 2 * g.lo + 1, 2 * (g.hi - g.lo)) end, '' order by g.lo) as h from gap g join d on d.doc_id = g.doc_id group by g.doc_id),
sums as (select doc_id, sum(hi - lo) as removed, count(*) as spans from run group by doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(s.removed, 0) as bigint) as n_removed, cast(coalesce(s.spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from d left join sums s on s.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id"""

_VECTOR_ROUND = """
a{i} as (select pos, part, n, arg_min(entry, d * 64 + entry) as entry, min(d) as d
    from (select pos, part, n, entry, sum((x - y) * (x - y)) as d
          from (select v.pos, v.part, v.n, b.entry, unnest(v.part) as x, unnest(b.c) as y from v join b{i} b on b.pos = v.pos) u group by pos, part, n, entry) t group by pos, part, n)"""

_VECTOR_BOOK = """,
s{i} as (select pos, entry, k, sum(x * n) as s, sum(n) as n from (select pos, entry, n, unnest(part) as x, generate_subscripts(part, 1) as k from a{i}) u group by pos, entry, k),
m{i} as (select pos, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by k) as c from s{i} group by pos, entry),
b{j} as (select b.pos, b.entry, coalesce(m.c, b.c) as c from b{i} b left join m{i} m on m.pos = b.pos and m.entry = b.entry),"""

#: Two rounds over distinct parts; entries and distances are whole numbers throughout.
VECTOR_CODES = """
with e as (select row_number() over () as r, vec_id, label, embedding from embeddings where embedding is not null and len(embedding) > 0),
f as (select r, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding) as x from e),
ok as (select r, count(*) as n from f group by r having count(*) = count(x) and bool_and(isfinite(x))),
q as (select f.r, f.k // (ok.n // 16) as pos, list(cast(floor(256 * cast(f.x as double)) as bigint) order by f.k) as part from f join ok on ok.r = f.r group by f.r, f.k // (ok.n // 16)),
v as (select pos, part, count(*) as n from q group by pos, part),
b0 as (select q.pos, o.entry, q.part as c from q join (select r, row_number() over (order by vec_id) - 1 as entry from e where r in (select r from ok)) o on o.r = q.r where o.entry < 64),""" + _VECTOR_ROUND.format(i=0) + _VECTOR_BOOK.format(i=0, j=1) + _VECTOR_ROUND.format(i=1) + _VECTOR_BOOK.format(i=1, j=2) + _VECTOR_ROUND.format(i=2) + """,
c as (select q.r, string_agg(printf('%02x', a2.entry), '' order by q.pos) as code, cast(sum(a2.d) as bigint) as error from q join a2 on a2.pos = q.pos and a2.part = q.part group by q.r)
select e.vec_id, c.code, c.error, cast(sum(c.error) over (partition by e.label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by pos, entry)) from b2) as codebooks_sha256
from c join e on e.r = c.r"""

#: crc32 bit by bit: for each digit its code goes in and eight steps follow (marked -1).
CONVERSATION_TRIE = """
with o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k,
             length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as t, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as w
      from conversations where conv_id is not null),
h as (select c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(c as varchar), ''), lambda x: list_prepend(cast(ord(x) as bigint), [cast(-1 as bigint) for i in range(8)])))),
             lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 4 as h from (select distinct c from o) x),
r as (select h.c, o.k as k, o.t, o.w from h join o on o.c = h.c - h.c % 20 and o.k <= h.h union all select h.c, o.k, o.t, o.w from h join o on o.c = h.c where o.k > h.h),
s as (select c, row_number() over (partition by c order by k) as d, sha256(t) as t, w from r),
p as (select a.c, a.d, max(case when b.d = a.d then b.w end) as w, string_agg(b.t, '' order by b.d) as p from s a join s b on b.c = a.c and b.d <= a.d group by a.c, a.d
      union all select c, 0 as d, 0 as w, '' as p from h),
e as (select c, max(d) as d from p group by c),
n as (select p.p, p.d, max(p.w) as w, min(p.c) as c, count(*) as n, coalesce(string_agg(cast(p.c as varchar), ',' order by p.c) filter (where e.d = p.d), '') as ends from p join e on e.c = p.c group by p.p, p.d),
k as (select b.p, count(*) as n from n a join n b on a.d = b.d + 1 and left(a.p, length(b.p)) = b.p group by b.p),
u as (select b.p, cast(sum((a.n - 1) * a.w) as bigint) as saved, cast(sum(case when k.n is null then 1 else 0 end) as bigint) as leaves
      from n a left join k on k.p = a.p join (select distinct p, d from n) b on b.d <= a.d and left(a.p, 64 * b.d) = b.p group by b.p)
select n.c as conv_id, n.d as depth, m.c as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children, u.leaves as n_leaves, u.saved as saved_tokens, sha256(n.ends) as ends_sha256
from n left join n m on m.d = n.d - 1 and m.p = left(n.p, 64 * m.d) left join k on k.p = n.p join u on u.p = n.p"""
