"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .chat import CONTROL
from .urls import LIMIT, SECOND_LEVEL, SIGMAS, WEIGHT

_EMBEDDINGS = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, c) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.c),
least as (select a, min(c) as c from reach group by a),
degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, l.c as component_id, e.vec_id = l.c as kept
from embeddings e join least l on l.a = e.vec_id left join degree d on d.a = e.vec_id
"""

_SUFFIX = """
with t as (select doc_id, encode(coalesce(text, '')) as b from documents),
h as (select doc_id, hex(b) as h, octet_length(b) as n from t),
c as (select doc_id, n, h, unnest(range(0, n - 399, 500)) as c from h where n >= 400),
p as (select doc_id, n, c, substr(h, 2 * c + 1, 2 * 899) as h from c),
w as (select doc_id, c, h, unnest(range(0, least(500, n - 399 - c))) as s from p),
k as (select doc_id, c + s as s, md5(substr(h, 2 * s + 1, 800)) as k from w),
twice as (select k from k group by k having count(*) > 1),
marked as (select doc_id, s, s - lag(s) over (partition by doc_id order by s) as gap from k where k in (select k from twice)),
numbered as (select doc_id, s, sum(case when gap <= 400 then 0 else 1 end) over (partition by doc_id order by s) as r from marked),
runs as (select doc_id, min(s) as lo, max(s) + 400 as hi from numbered group by doc_id, r),
parts as (
  select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as s, lo as e from runs
  union all select doc_id, max(hi), null from runs group by doc_id),
kept as (
  select p.doc_id, string_agg(substr(h.h, 2 * p.s + 1, 2 * (coalesce(p.e, h.n) - p.s)), '' order by p.s) as h
  from parts p join h using (doc_id) group by p.doc_id),
sums as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans from runs group by doc_id)
select h.doc_id, cast(h.n as bigint) as n_bytes, cast(coalesce(s.n_removed, 0) as bigint) as n_removed, coalesce(s.n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k.h, h.h))) as kept_sha256
from h left join sums s using (doc_id) left join kept k using (doc_id)
"""

_SECOND = "|".join(SECOND_LEVEL)
_URLS = f"""
with parts as (
  select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
named as (
  select host, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]*(:[0-9]*)?$', '') as name from (select distinct host from p)),
suffixed as (
  select host, name, case when regexp_matches(name, '^[0-9.]+$|^\\[') then name
    else regexp_extract(name, '(?:^|\\.)((?:{_SECOND})\\.[a-z][a-z]|[^.]*)$', 1) end as suffix from named),
domained as (
  select host, suffix, case when length(name) <= length(suffix) + 1 then name
    else regexp_extract(substr(name, 1, length(name) - length(suffix) - 1), '[^.]*$', 0) || '.' || suffix end as domain from suffixed),
outcomes as (select doc_id as page_id, max(cast(quality = 0 or toxic = 1 as int)) as bad from labels
  where (quality = 0 or toxic = 1) is not null group by doc_id),
counted as (select host, cast(count(*) as double) as n, cast(sum(bad) as double) as b from p join outcomes using (page_id) group by host),
hosts as (select d.*, coalesce(n, 0.0) as n, coalesce(b, 0.0) as b from domained d left join counted using (host)),
domains as (select domain, suffix, sum(n) as n, sum(b) as b from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(b) as b from domains group by suffix),
total as (select (sum(b) + 0.5) / (sum(n) + 1.0) as m, sum(n) as n from suffixes),
w1 as (select sum((b - n * m) * (b - n * m) / n) as spread, sum(m * (1 - m)) as chance, sum(n) as n, sum(n * n) as n2, sum(n * m * (1 - m)) as v,
  count(*) as groups from (select s.n, s.b, t.m from suffixes s, total t) where n > 0),
k1 as (select case when groups <= 1 or (spread - chance + v / n) / (n - n2 / n) <= 0 then {WEIGHT[1]}
  else greatest({WEIGHT[0]}, least({WEIGHT[1]}, (v / n) / ((spread - chance + v / n) / (n - n2 / n)) - 1)) end as k from w1),
s2 as (select s.suffix, (s.b + t.m * k) / (s.n + k) as sm from suffixes s, total t, k1),
d1 as (select d.*, sm from domains d join s2 using (suffix)),
w2 as (select sum((b - n * sm) * (b - n * sm) / n) as spread, sum(sm * (1 - sm)) as chance, sum(n) as n, sum(n * sm * (1 - sm)) as v from d1 where n > 0),
k2 as (select case when (spread - chance) / n <= 0 then {WEIGHT[1]}
  else greatest({WEIGHT[0]}, least({WEIGHT[1]}, (v / n) / ((spread - chance) / n) - 1)) end as k from w2),
d2 as (select domain, suffix, (b + sm * k) / (n + k) as dm from d1, k2),
h1 as (select h.*, dm from hosts h join d2 using (domain, suffix)),
w3 as (select sum((b - n * dm) * (b - n * dm) / n) as spread, sum(dm * (1 - dm)) as chance, sum(n) as n, sum(n * dm * (1 - dm)) as v from h1 where n > 0),
k3 as (select case when (spread - chance) / n <= 0 then {WEIGHT[1]}
  else greatest({WEIGHT[0]}, least({WEIGHT[1]}, (v / n) / ((spread - chance) / n) - 1)) end as k from w3),
h2 as (select host, n, k, (b + dm * k) / (n + k) as hm from h1, k3),
bound as (select host, hm - {SIGMAS} * sqrt(hm * (1 - hm) / (n + k + 1)) as bound from h2),
rules(action, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, rule, coalesce(action, case when bound > {LIMIT} then 'block' else 'allow' end) as verdict
from p left join bound using (host) left join fits using (page_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in CONTROL:
        out = f"replace({out}, {_quoted(control)}, {_quoted(control[0] + chr(92) + control[1:])})"
    return out


_CHAT = f"""
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length('<|turn|>' || {_escaped('role')} || '<|body|>' || {_escaped('text')} || '<|end|>') as n from m),
c as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn) as turns,
    coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '') as loss, sum(n) as n from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(n + length('<s></s>') as bigint) as formatted_chars from c
"""

# Terms are split off at ASCII characters that are neither letters nor digits; only A-Z are lower-cased.
_RANKED = """
with split as (
  select doc_id as id, 0 as side, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents
  union all
  select item_id, 1, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') from benchmark),
listed as (
  select id, side, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from split),
occurring as (select id, side, term, count(*) as tf from listed group by id, side, term),
lengths as (select id, sum(tf)::bigint as n from occurring where side = 0 group by id),
total as (select count(*) as docs, sum(n)::bigint as terms from lengths),
sized as (select id, 100 - 75 + ((75 * n * docs) // terms) as m from lengths, total),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from occurring, total where side = 0 group by term),
scored as (
  select i.id as item_id, d.id as doc_id, sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m)))::bigint as score
  from occurring i join occurring d on i.term = d.term join weights on weights.term = i.term join sized on sized.id = d.id
  where i.side = 1 and d.side = 0 group by i.id, d.id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

_INFILL = """
with u as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u,
    sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
    ('0x' || h[25:32])::bigint as h4 from u),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from d),
p as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256
from p
"""

SQL: dict[str, str] = {"op2_embedding_dedup": _EMBEDDINGS, "op4_suffix_dedup": _SUFFIX, "op5_url_filter": _URLS, "op8_chat_format": _CHAT,
                       "op12_ranked_search": _RANKED, "op13_fill_in_middle": _INFILL}
