"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op7_chat"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(text, '&', '&a;'), '#', '&h;'), '<', '&l;') as body from c
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(role) + 2 + length(body) + 8)::bigint as formatted_chars
from e group by conv_id
"""

ORACLES["op8_warc"] = r"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') as target from pages
), f as (select *, max(page_id) over (partition by payload_digest) as last from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and last <> page_id then last end as refers_to, target
from f
"""

ORACLES["op5_substring"] = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)
), first as (select s, min(doc_id) as f from win group by s),
hit as (select doc_id, i from win join first using (s) where f < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from hit),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by i) as t from word anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

ORACLES["op9_decontaminate"] = r"""
with norm as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') from benchmark
), items as (
  select distinct id as item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as s
  from (select id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from norm where kind = 'b' and len(w) > 0)
), sizes as (select distinct n from items),
win as (
  select id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from norm, sizes where kind = 'd' and len(w) >= n)
), hit as (select id, i, n, item_id from win join items using (n, s)),
places as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from hit) group by id),
named as (select id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct id, item_id::varchar as item from hit) group by id)
select d.id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from norm d left join places using (id) left join named using (id) where d.kind = 'd'
"""

ORACLES["op6_ngram_join"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as x
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
link as (select a, b from pair join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 90 * (p.n + q.n - c)),
reach as (select doc_id as a, doc_id as r from d union select l.b, r.r from reach r join link l on l.a = r.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r)::bigint as component_id
from d left join n using (doc_id) join reach on reach.a = d.doc_id group by all
"""

ORACLES["op10_lpf"] = r"""
with b as (
  select doc_id, encode(coalesce(text, '')) as t, octet_length(encode(coalesce(text, ''))) as n from documents
), x as (select doc_id, hex(t) as h, n from b),
win as (select doc_id, i, substr(h, (2 * i + 1)::bigint, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from x)),
first as (select s, min(doc_id) as f from win group by s),
hit as (select doc_id, i from win join first using (s) where f < doc_id),
span as (
  select doc_id, min(i) as a, max(i) + 50 as z
  from (select doc_id, i, sum(new) over (partition by doc_id order by i) as g
        from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from hit))
  group by doc_id, g
), gaps as (
  select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as p, lead(a) over (partition by doc_id order by a) as q from span
), parts as (
  select g.doc_id, count(*) as n_spans, sum(z - a) as gone,
    string_agg(substr(h, (2 * p + 1)::bigint, (2 * (a - p))::bigint) || case when q is null then substr(h, (2 * z + 1)::bigint) else '' end, '' order by a) as kept
  from gaps g join x using (doc_id) group by g.doc_id
)
select x.doc_id, n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when n_spans is null then h else kept end)) as kept_sha256
from x left join parts using (doc_id)
"""

