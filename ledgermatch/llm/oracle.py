"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

CHAT = r"""
with d as (select conv_id, coalesce('s' || cast(conv_id as varchar), 'n') as key, turn, role, text from conversations),
t as (select *, row_number() over (partition by key order by turn nulls first, role nulls first, text nulls first) as pos,
        count(*) over (partition by key) as n_turns,
        case when role is null then 'n' else 's' || length(role) || ':' || role end
        || case when text is null then 'n' else 's' || length(text) || ':' || text end as own from d),
p as (select *, string_agg(own, '') over (partition by key order by pos) as prefix from t),
f as (select n_turns as n, prefix, arg_min(key, (case when conv_id is null then 1 else 0 end, conv_id)) as key
      from p where pos = n_turns group by all),
kept as (select key from f where not exists (select 1 from p where p.pos = f.n and p.pos < p.n_turns and p.prefix = f.prefix)),
r as (select t.*, (pos - 1) // 256 as part,
        '<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
        || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) as line
      from t join kept using (key))
select conv_id, cast(part as bigint) as part, cast(n_turns as bigint) as n_turns, string_agg(line, '' order by pos) as text
from r group by conv_id, part, n_turns
"""

EMBEDDINGS = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
fine as (select * from v where label is not null and vec_id is not null and e is not null
         and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) as (select vec_id, vec_id from v union select l.b, reach.y from reach join l on l.a = reach.x),
c as (select x as vec_id, min(y) as component_id from reach group by x),
n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from v left join c using (vec_id) left join n using (vec_id)
"""

MIXING = r"""
with d as (select doc_id, source, case when source is null then 'n' else 's' || source end as key,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as hash
  from documents),
s as (select key, any_value(source) as source, cast(sum(size) as bigint) as source_size from d group by key),
w as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3 * source_size as stop from s),
o as (select *, row_number() over (order by stop / weight, source nulls last) as turn from w),
q as (select *, cast((select sum(source_size) from s) - coalesce(sum(stop) over (order by turn rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(weight) over (order by turn rows between current row and unbounded following) as double) as level from o),
lv as (select arg_min(level, turn) as level from q where level * weight <= stop),
t as (select q.key, source_size, least(cast(stop as double), lv.level * weight) as target from q, lv),
m as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
r as (select d.*, m.source_size, m.target, m.whole, least(m.target - m.whole * m.source_size, m.source_size) as missing,
    sum(size) over (partition by d.key order by hash range between unbounded preceding and current row) as upto,
    sum(size) over (partition by d.key, hash) as own from d join m using (key)),
b as (select key, min(upto) as upto, arg_min(own, upto) as own, arg_min(hash, (upto, hash)) as hash, any_value(missing) as missing
      from r where missing > 0 and upto >= missing group by key),
c as (select key, case when upto - missing < missing - (upto - own) then hash else hash - 1 end as threshold from b)
select doc_id, size, source_size, target, cast(size * (whole + case when hash <= threshold then 1 else 0 end) as bigint) as taken
from r left join c using (key)
"""


def urls(depth: int = 12, count: int = 3, z: float = 1.96, m: float = 4.0, reject: float = 0.5) -> str:
    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"

    parts = [f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r as (select *, case when {fits('example.org', '/en/1')} then 'example.org/en/1' when {fits('example.org', '/es/')} then 'example.org/es/'
   when {fits('com', '/de/')} then 'com/de/' when {fits('com', '/fr/')} then 'com/fr/' when {fits('org', '/')} then 'org/' end as rule from h),
x as (select *, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' when rule is not null then 'allow' end as said,
   list_filter(string_split(path, '/'), lambda s: s <> '') as every from r),
t0 as (select page_id, host, path, rule, said, case said when 'block' then 1 when 'allow' then 0 end as bad, '' as template,
   every as segs from x),
g as (select (coalesce(sum(bad), 0) + 1)::double / (count(bad) + 2)::double as p0 from t0)"""]
    for k in range(depth + 1):
        parts.append(f"""
s{k} as (select host, template, segs[{k + 1}] as seg, count(*) as n, count(bad) as labelled, coalesce(sum(bad), 0) as b from t{k}
   where len(segs) > {k} group by all),
k{k} as (select * from s{k} where n >= {count}),
a{k} as (select *, sum(labelled) over (partition by host, template) as l_all, sum(b) over (partition by host, template) as b_all from k{k}),
z{k} as (select host, template, seg, case when labelled > 0 and case when l_all > labelled then
   pow(b::double / labelled - (b_all - b)::double / (l_all - labelled), 2) >
   {z * z!r} * (b_all::double / l_all) * (1 - b_all::double / l_all) * (1.0::double / labelled + 1.0::double / (l_all - labelled))
   else pow(b::double / labelled - p0, 2) > {z * z!r} * p0 * (1 - p0) / labelled end
   then seg else '~' end as said_as from a{k}, g),
t{k + 1} as (select t.* replace (t.template || case when len(t.segs) > {k} then '/' || coalesce(z.said_as, '*') else '' end as template)
   from t{k} t left join z{k} z on z.host = t.host and z.template = t.template and z.seg = t.segs[{k + 1}])""")
    parts.append(f"""
p as (select host, template, count(bad) as labelled, coalesce(sum(bad), 0) as b from t{depth + 1} group by all),
hp as (select host, (sum(b) + {m} * any_value(p0))::double / (sum(labelled) + {m})::double as ph from p, g group by host),
pu as (select p.host, template, (b + {m}::double * ph) / (labelled + {m}::double) as purity from p join hp using (host))
select page_id, host, path, rule, coalesce(said, case when purity >= {reject} then 'block' else 'allow' end) as verdict, template
from t{depth + 1} join pu using (host, template)""")
    return ",".join(parts)


LINES = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, coalesce(doc_id <> last, false) as gone from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from m group by doc_id
"""

DIVERGENCE = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
t as (select lang, term from w group by all having count(distinct id) >= 30),
c as (select lang, source, term, count(*) as n from w join t using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from t group by lang),
gs as (select g.lang, g.source, coalesce(any_value(v.v), 0) as v, cast(coalesce(sum(c.n), 0) as hugeint) as total
    from g left join v using (lang) left join c on c.lang = g.lang and c.source = g.source group by all),
ls as (select lang, sum(total) as total from gs group by lang),
p as (select gs.lang, gs.source, t.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (gs.total + 5 * gs.v) as p
    from gs join t using (lang) left join c on c.lang = gs.lang and c.source = gs.source and c.term = t.term),
q as (select p.lang, p.term, 1 + (1000000000::hugeint * (sum(p.n) + 5)) // (any_value(ls.total) + 5 * any_value(v.v)) as q
    from p join ls using (lang) join v using (lang) group by p.lang, p.term),
pairs as (select a.lang, a.source, b.source as item, coalesce(f.value, 0) as value from gs a join gs b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x
      join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
    on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select p.lang, p.source, p.term as item, p.p - q.q as value from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from terms) where rank <= 50
"""

SQL = {
    "op2_chat_formatting": CHAT,
    "op4_url_templates": urls(),
    "op5_embedding_neardup": EMBEDDINGS,
    "op6_mixing": MIXING,
    "op11_line_dedup": LINES,
    "op12_source_divergence": DIVERGENCE,
}
