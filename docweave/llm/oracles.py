"""DuckDB SQL for the corpus queries that SQL can express."""

OP7 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded as (
  select *, replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), chr(10), '%0A') as safe_role,
         replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B') as safe_text
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('<|turn|>') + length(safe_role) + 1 + length(safe_text) + length('<|end|>') + 1) as bigint) as formatted_chars
from coded group by conv_id
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
with rows as (select doc_id, {LOWER} as norm from documents),
groups as (select norm, max(doc_id) as keep_id, count(*) as group_size from rows group by norm)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(r.norm) as text_sha256
from rows r join groups g on r.norm = g.norm
"""

OP2 = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, s, array_to_string(w[s : s + 19], ' ') as t from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as s from words where len(w) >= 20)),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by t order by doc_id, s) as n from windows) where n > 1),
gone as (select distinct doc_id, unnest(generate_series(s, s + 19)) as p from again),
kept as (select doc_id, p, word from (select doc_id, unnest(generate_series(1, len(w))) as p, unnest(w) as word from words) anti join gone using (doc_id, p)),
left_over as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from kept group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join left_over using (doc_id)
"""

OP6 = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select r, doc_id, p, substring(h, 2 * p + 1, 100) as s from (select r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) as p from d where length(h) >= 100)),
firsts as (select s, min(doc_id) as least from windows group by s),
late as (select r, p, lag(p) over (partition by r order by p) as before from windows join firsts using (s) where doc_id > least),
runs as (select r, p, sum(case when p - before <= 50 then 0 else 1 end) over (partition by r order by p) as g from late),
spans as (select r, min(p) as a, max(p) + 50 as z from runs group by r, g),
gaps as (select *, coalesce(lag(z) over (partition by r order by a), 0) as y from spans),
kept as (select r, count(*) as n, sum(z - a) as gone, string_agg(substring(h, 2 * y + 1, 2 * (a - y)), '' order by a) || substring(any_value(h), 2 * max(z) + 1) as t from gaps join d using (r) group by r)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(t, h))) as kept_sha256 from d left join kept using (r)
"""

OP12 = r"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)) as b
  from conversations),
coded as (
  select * exclude (b), xor(list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end), 4294967295) % 20 as k
  from keyed),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
         case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text
  from coded, range(case k when 0 then 0 when 3 then 2 else 1 end)),
seen as (
  select *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as i,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as n
  from damaged),
marked as (
  select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(i) over (partition by conv_id order by n) || i as pair
  from seen),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from marked group by conv_id),
ins(q, z, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
closing(a, z, c, l, t) as (
  select q, q, 0, '', [] from (values (0), (1), (2), (3)) v(q)
  union all select q, z, 3, 'I', [role || ':'] from ins
  union all select a.q, b.z, 6, 'II', [a.role || ':', b.role || ':'] from ins a join ins b on a.z = b.q where a.q <> b.z),
moves as (
  select conv_id, n, q as a, q as z, 4 as c, 'D' as l, [] as t from marked, (values (0), (1), (2), (3)) v(q)
  union all
  select conv_id, n, a, z, case fault when 'truncated' then 3 else 0 end, 'K', [role || ':' || text]
  from marked join (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) v(i, a, z) using (i) where fault in ('', 'truncated')
  union all
  select conv_id, n, ins.q, ins.z, case fault when 'truncated' then 6 else 3 end, 'R', [ins.role || ':' || text] from marked, ins where fault in ('', 'truncated')),
steps as (
  select m.conv_id, m.n, k.a, m.z, k.c + m.c as c, k.l || m.l as l, list_concat(k.t, m.t) as t from moves m join closing k on k.z = m.a),
best as (
  select conv_id, cast(0 as bigint) as n, 0 as q, {'c': cast(0 as bigint), 'l': '', 't': cast([] as varchar[])} as s from counts
  union all
  select conv_id, n, q, s from (
    select b.conv_id, b.n + 1 as n, p.z as q, min({'c': b.s.c + p.c, 'l': b.s.l || p.l, 't': list_concat(b.s.t, p.t)}) as s
    from best b join steps p on p.conv_id is not distinct from b.conv_id and p.n = b.n + 1 and p.a = b.q
    group by all)),
ends as (
  select b.conv_id, min({'c': b.s.c + k.c, 'l': b.s.l || k.l, 't': list_concat(b.s.t, k.t)}) as s
  from best b join counts c on b.conv_id is not distinct from c.conv_id and b.n = c.n join closing k on k.a = b.q and k.z in (0, 3) group by all)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(s.c, 0) as cost, coalesce(s.l, '') as audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id left join ends e on o.conv_id is not distinct from e.conv_id
"""


def op13(rounds: int = 5, k: int = 40) -> str:
    """The rounds one after the other; sums and distances are whole numbers."""
    parts = [f"""with vectors as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as j, v from vectors qualify row_number() over (order by sha256('2:' || vec_id), v) <= {k})"""]
    near = """select vec_id, x.v, arg_min(j, {{'d': d, 'j': j}}) as j, min(d) as d from (
  select vec_id, x.v, j, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from vectors x, c{r} c) x group by all"""
    for r in range(rounds):
        parts.append(f"""a{r} as ({near.format(r=r)}),
m{r} as (select j, list(s order by i) as v from (
  select j, i, cast(floor(cast(sum(x) as double) / count(*)) as bigint) as s from (select j, unnest(range(64)) as i, unnest(v) as x from a{r}) group by j, i) group by j),
c{r + 1} as (select j, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (j))""")
    parts.append(f"last as ({near.format(r=rounds)})")
    return ",\n".join(parts) + f"""
select vec_id, cast(l.j as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by l.j) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from last l join c{rounds} c using (j)
"""


ORACLES = {
    "op12_chat_repair": OP12,
    "op13_ball_kmeans": op13(),
    "op6_suffix_dedup": OP6,
    "op2_substring_dedup": OP2,
    "op7_chat_format": OP7,
    "op9_exact_dedup": OP9,
}
