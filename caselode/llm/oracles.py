"""DuckDB statements with the rows of the contract queries, where SQL can express them."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
i as (
  select distinct cast(item_id as varchar) as item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
iw as (
  select distinct item_id, least(8, len(w)) as n, array_to_string(w[s : s + least(8, len(w)) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) as s from i where len(w) > 0)),
ns as (select distinct n from iw),
dw as (
  select r, n, s, array_to_string(w[s : s + n - 1], ' ') as k
  from (select r, n, w, unnest(range(1, len(w) - n + 2)) as s from d, ns where len(w) >= n)),
hits as (select r, dw.n, s, item_id from dw join iw on dw.n = iw.n and dw.k = iw.k),
hw as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from hits) group by r),
hi as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hw using (r) left join hi using (r)
"""

OP4 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as w from documents),
e as (select r, doc_id, s, array_to_string(w[s : s + 12], ' ') as k from (select *, unnest(range(1, len(w) - 11)) as s from d where len(w) >= 13)),
f as (select k, min(doc_id) as first from e group by k),
g as (select r, unnest(range(s, s + 13)) as p from e join f using (k) where doc_id > first),
h as (select r, list(distinct p) as gone from g group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
       sha256(coalesce(array_to_string(case when gone is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]) end, ' '), '')) as kept_sha256
from d left join h using (r)
"""

OP7 = r"""
with s as (
  select doc_id, coalesce('0' || source, '1') as skey, cast(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) as bigint) as size from documents),
p as (
  select skey, cast(sum(size) as bigint) as source_size, ([3.0, 1.0, 2.0])[cast((row_number() over (order by skey) - 1) % 3 + 1 as integer)]::double as weight
  from s group by skey),
c as (select *, source_size * 2.0::double as cap from p),
l as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, skey rows between unbounded preceding and 1 preceding), 0))
         / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, skey rows between unbounded preceding and 1 preceding), 0)) as level
  from c),
f as (select level as free from l where cap > level * weight order by cap / weight, skey limit 1),
t as (select skey, source_size, case when cap <= level * weight then cap else (select free from f) * weight end as target from l),
b as (
  select s.*, coalesce(sum(size) over (partition by skey order by md5(coalesce(cast(doc_id as varchar), '')), size rows between unbounded preceding and 1 preceding), 0) as begin
  from s),
w as (select cast(sum(source_size) as bigint) as total, greatest(1, least(1024, cast(sum(source_size) as bigint) // 65536)) as words from p),
i as (select skey, coalesce(sum(target) over (order by skey rows between unbounded preceding and 1 preceding), 0) / sum(target) over () as low from t where target > 0),
n as (select slot, (slot + 1) * 0.6180339887498949::double - floor((slot + 1) * 0.6180339887498949::double) as point from (select unnest(range(cast(floor(total * 1.5::double / words) as bigint) + 1)) as slot from w)),
k as (select slot, skey, row_number() over (partition by skey order by slot) - 1 as rank from n asof join i on point >= low),
h as (select skey, count(*) as drawn from k group by skey),
m as (
  select doc_id, size, source_size, target, skey, begin // words as rank,
         cast(case when size = 0 then 0 else cast(round(target) as bigint) // source_size * size
              + least(size, greatest(0, cast(round(target) as bigint) % source_size - begin)) end as bigint) as taken
  from b join t using (skey), w)
select doc_id, size, source_size, target, taken,
       cast(case when taken > 0 then coalesce(k.slot, m.rank + (select cast(floor(total * 1.5::double / words) as bigint) + 1 from w)) end as bigint) as first_slot
from m left join k using (skey, rank)
"""

OP9 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \t-\r]+') as w from documents),
s as (
  select distinct doc_id, k from (
    select doc_id, array_to_string(w[i : i + 2], ' ') as k from (select *, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
    union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 2)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (
  select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (k) where x.doc_id < y.doc_id group by 1, 2) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
u as (select a, b from l union all select b, a from l),
t as (select doc_id as node, doc_id as to_node from d union select t.node, u.b from t join u on t.to_node = u.a),
m as (select node, min(to_node) as component_id from t group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from d join m on m.node = d.doc_id left join n on n.doc_id = d.doc_id
"""

OP10 = rf"""
with u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
v as (select *, string_split(host, '.') as q, array_to_string(string_split(host, '.')[-2:], '.') as two from u),
x as (
  select page_id, host, path,
         case when regexp_matches(host, '^[0-9.]+$') then host when two in {{suffixes}} then two else q[-1] end as suffix,
         case when regexp_matches(host, '^[0-9.]+$') then host when two in {{suffixes}} then array_to_string(q[-3:], '.') else two end as domain
  from v),
o as (
  select suffix, domain, host, case when quality = 0 or toxic = 1 then 1 else 0 end as bad
  from x join labels on page_id = doc_id where quality is not null or toxic is not null),
h as (select suffix, domain, host, count(*)::double as n, sum(bad)::double as b from o group by all),
dm as (select suffix, domain, sum(n) as n, sum(b) as b from h group by all),
sf as (select suffix, sum(n) as n, sum(b) as b from dm group by all),
g as (
  select 'h' as level, sum(n) as n, sum(b) as b, sum(n * n) as n2, sum(b * b / n) as b2, count(*)::double as g from h
  union all select 'd', sum(n), sum(b), sum(n * n), sum(b * b / n), count(*)::double from dm
  union all select 's', sum(n), sum(b), sum(n * n), sum(b * b / n), count(*)::double from sf),
m as (select *, case when n > 0 then b / n else 0 end as m from g),
e as (select *, m * (1 - m) as within, n - n2 / n - (g - 1) as base from m),
k as (
  select level, m, case when n > 0 and within > 0 and base > 0 and (b2 - n * m * m - (g - 1) * within) > 0
                then least(1000.0::double, greatest(2.0::double, within * base / (b2 - n * m * m - (g - 1) * within) - 1)) else 1000.0::double end as s
  from e),
kk as (select max(case level when 's' then m end) as gm, max(case level when 's' then s end) as ks, max(case level when 'd' then s end) as kd, max(case level when 'h' then s end) as kh from k),
sp as (select suffix, (sf.b + ks * gm) / (sf.n + ks) as sm from sf, kk),
dp as (select suffix, domain, (dm.b + kd * sm) / (dm.n + kd) as pm from dm join sp using (suffix), kk),
hp as (select host, h.b + kh * pm as pa, h.n - h.b + kh * (1 - pm) as pc from h join dp using (suffix, domain), kk),
hb as (select host, pa / (pa + pc) - 1.645::double * sqrt(pa * pc / ((pa + pc) * (pa + pc) * (pa + pc + 1))) as bound from hp),
r as (
  select x.page_id, x.host, x.path, bound,
    case when x.host = 'www.example.com' or x.host like '%.www.example.com' then starts_with(path, '/en/') else false end as r1,
    case when x.host = 'example.com' or x.host like '%.example.com' then starts_with(path, '/en/') else false end as r2,
    (x.host = 'net' or x.host like '%.net') and starts_with(path, '/es/') as r3,
    (x.host = 'net' or x.host like '%.net') and starts_with(path, '/fr/') as r4,
    (x.host = 'com' or x.host like '%.com') and starts_with(path, '/') as r5
  from x left join hb on x.host = hb.host)
select page_id, host, path,
  case when r1 then 'www.example.com/en/' when r2 then 'example.com/en/' when r3 then 'net/es/' when r4 then 'net/fr/' when r5 then 'com/' end as rule,
  case when r1 then 'allow' when r2 then 'block' when r3 or r4 then 'block' when r5 then 'allow' when bound > 0.5 then 'block' else 'allow' end as verdict
from r
"""


def op6() -> str:
    from caselode.llm.secret_scan import BASE, RULES

    parts = []
    for k, (kind, pattern, _, group, least) in enumerate(RULES):
        rx = pattern.replace("'", "''")
        parts.append(f"""select r, {k} as ord, '{kind}' as kind, s as start, s + length(hit) as stop from (
  select r, hits[i] as hit, parts[i] as part,
         cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as bigint) as s
  from (select *, unnest(range(1, len(hits) + 1)) as i from (
    select r, regexp_extract_all(text, '{rx}') as hits, regexp_extract_all(text, '{rx}', {group}) as parts, string_split_regex(text, '{rx}') as gaps from d)))
where length(part) >= {least}""")
    found = "\nunion all ".join(parts)
    listing = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord, stop)"
    counted = ", ".join(f"count(*) filter (kind = '{r[0]}') as n_{r[0]}" for r in RULES[:BASE])
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
f as ({found})
select doc_id, {counted}, sha256({listing} filter (ord < {BASE}), '')) as base_sha256, {listing}, '') as spans
from d left join f using (r) group by r, doc_id"""


def sql() -> dict[str, str]:
    from caselode.llm.url_reputation import TWO_LABEL_SUFFIXES

    return {"op2_decontaminate": OP2, "op4_substring_dedup": OP4, "op6_secrets": op6(), "op7_mix_sources": OP7, "op9_minhash": OP9, "op10_url_reputation": OP10.replace("{suffixes}", str(TWO_LABEL_SUFFIXES))}
