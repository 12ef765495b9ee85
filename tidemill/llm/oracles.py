"""Plain SQL for the text queries that SQL can express, over whole tables."""

from __future__ import annotations

from tidemill.llm import urls

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = urls.UPPER, urls.UPPER.lower()

DEBRUIJN = f"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as words from documents),
w as (select doc_id, p, array_to_string(words[p:p + 12], ' ') as s from (select doc_id, words, unnest(range(1, greatest(1, len(words) - 11))) as p from d) x),
m as (select s, min(doc_id) as least from w group by s),
gone as (select distinct doc_id, unnest(range(p, p + 13)) as p from w join m using (s) where doc_id > least),
each as (select doc_id, words[p] as word, p from (select doc_id, words, unnest(range(1, len(words) + 1)) as p from d) x),
kept as (select e.doc_id, string_agg(word, ' ' order by e.p) as t, count(*) as n from each e anti join gone g on g.doc_id = e.doc_id and g.p = e.p group by e.doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""

MINHASH = f"""
with recursive d as (select doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as words from documents),
s as (select distinct doc_id, case when len(words) < 5 then array_to_string(words, ' ') else array_to_string(words[p:p + 4], ' ') end as s
  from (select doc_id, words, unnest(range(1, case when len(words) = 0 then 1 else greatest(2, len(words) - 3) end)) as p from d) x),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, least as component_id, d.doc_id = least as kept from d left join n using (doc_id) join (select a as doc_id, min(b) as least from reach group by a) c using (doc_id)
"""


SUFFIXES = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, p, array_slice(b, p, p + 49) as s from (select doc_id, b, unnest(range(1, greatest(1, octet_length(b) - 48))) as p from d) x),
m as (select s, min(doc_id) as least from w group by s),
hit as (select doc_id, p from w join m using (s) where doc_id > least),
edge as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as opens from hit),
run as (select doc_id, min(p) as a, max(p) + 49 as z from (select doc_id, p, sum(opens) over (partition by doc_id order by p) as n from edge) x group by doc_id, n),
part as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as f, a - 1 as t from run union all select doc_id, max(z) + 1, 1000000000 from run group by doc_id),
kept as (select doc_id, unhex(string_agg(hex(array_slice(b, f, least(t, octet_length(b)))), '' order by f)) as b from part join d using (doc_id) where f <= least(t, octet_length(b)) group by doc_id),
gone as (select doc_id, cast(sum(z - a + 1) as bigint) as n, count(*) as runs from run group by doc_id)
select d.doc_id, octet_length(d.b) as n_bytes, coalesce(n, 0) as n_removed, coalesce(runs, 0) as n_spans, sha256(case when n is null then d.b else coalesce(k.b, encode('')) end) as kept_sha256
from d left join gone using (doc_id) left join kept k using (doc_id)
"""

QUALITY_BASE = f"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as words from documents),
line as (select doc_id, s, row_number() over (partition by doc_id, s) as n from (select doc_id, unnest(string_split(text, chr(10))) as s from d) x where regexp_matches(s, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) filter (where n > 1) as n from line group by doc_id),
w as (select doc_id, p, array_to_string(words[p:p + 7], ' ') as s from (select doc_id, words, unnest(range(1, greatest(1, len(words) - 6))) as p from d) x),
twice as (select doc_id, s from w group by doc_id, s having count(*) > 1),
covered as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(p, p + 8)) as p from w join twice using (doc_id, s)) x group by doc_id)
select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, len(words) < 20 or 100 * coalesce(covered.n, 0) > 30 * len(words) as base_failed
from d left join dup using (doc_id) left join covered using (doc_id)
"""

EDITED = """
with d as (select doc_id, coalesce(text, '') as t, coalesce(lead(text) over (order by doc_id), first_value(coalesce(text, '')) over (order by doc_id)) as after from documents)
select doc_id, length(t) as n_chars, sha256(left(t, length(t) - length(t) // 2) || left(after, length(t) // 2)) as edited_sha256 from d
"""

TARGETS = f"""
with recursive s as (select source, sum(size)::double as size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end as w
  from (select source, len({WORDS.format("coalesce(text, '')")}) as size from documents) x group by source),
c as (select *, 3 * size as most, row_number() over (order by 3 * size / w, source nulls last) as place from s),
fill as (select place, (sum(size) over () - coalesce(sum(most) over (order by place rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by place rows between current row and unbounded following) as level, most / w as own from c),
fixed as (select min(place) as place, arg_min(level, place) as level from fill where own > level)
select source, cast(size as bigint) as source_size, round(case when fixed.place is null or c.place < fixed.place then most else w * fixed.level end, 3) as target from c, fixed
"""


def urls_sql(rules) -> str:
    """Rules in order, then what blocked addresses reach over canonical and refresh links."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    host = lambda u: f"case when instr({u}, '://') > 0 then translate(regexp_extract(substr({u}, instr({u}, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') else '' end"
    path = lambda u: f"case when instr({u}, '://') > 0 then regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end"
    fits = lambda r: f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    pick = lambda i: "case " + " ".join(f"when {fits(r)} then '{r[1] + r[2] if i else r[0]}'" for r in ordered) + " end"
    absolute = "^[A-Za-z][A-Za-z0-9+.-]*://"

    def decoded(value: str) -> str:
        value = f"regexp_replace({value}, {quoted(chr(94) + chr(91) + chr(34) + chr(39) + chr(93))}, '')"
        for entity, mark in urls.ENTITIES.items():
            value = f"replace({value}, {quoted(entity)}, {quoted(mark)})"
        return value

    def resolved(name: str, source: str, base: str, target: str) -> str:
        """CTEs that add ``name``, the normal form of ``target`` on ``base``, to the rows of ``source``."""
        b, t = f"regexp_extract(trim({base}), '^([^#]*)', 1)", f"regexp_extract(trim({target}), '^([^#]*)', 1)"
        return f"""
{name}1 as (select *, {t} as t_, lower(regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s_, regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1) as h_,
  regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) as p_, regexp_extract({b}, '^[^?]*(.*)$', 1) as q_ from {source}),
{name}2 as (select *, case when regexp_matches(t_, '^[A-Za-z][A-Za-z0-9+.-]*:') then t_ when s_ = '' or {base} is null then null when starts_with(t_, '//') then s_ || ':' || t_
  when starts_with(t_, '/') then s_ || '://' || h_ || t_ when starts_with(t_, '?') then s_ || '://' || h_ || p_ || t_ when t_ = '' then s_ || '://' || h_ || p_ || q_
  else s_ || '://' || h_ || coalesce(nullif(regexp_extract(p_, '^(.*/)', 1), ''), '/') || t_ end as w_ from {name}1),
{name}3 as (select * exclude (t_, s_, h_, p_, q_), lower(regexp_extract(w_, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s_, translate(regexp_extract(w_, '{absolute}([^/?]*)', 1), '{UPPER}', '{LOWER}') as h_,
  coalesce(nullif(regexp_extract(w_, '{absolute}[^/?]*([^?]*)', 1), ''), '/') as p_, regexp_extract(w_, '^[^?]*(.*)$', 1) as q_ from {name}2),
{name}4 as (select *, list_reduce(list_prepend([]::varchar[], list_transform(string_split(substr(p_, 2), '/'), lambda x: [x])), lambda a, b: case when b[1] = '..' then a[1:len(a) - 1] when b[1] = '.' then a else a || b end) as l_ from {name}3),
{name} as (select * exclude (w_, s_, h_, p_, q_, l_), case when s_ <> '' and h_ <> '' then s_ || '://' || case s_ when 'http' then regexp_replace(h_, ':(80)?$', '') when 'https' then regexp_replace(h_, ':(443)?$', '') else h_ end
  || '/' || array_to_string(l_, '/') || case when len(l_) > 0 and regexp_matches(p_, '/[.][.]?$') then '/' else '' end || q_ end as {name}_to from {name}4)"""

    tags = lambda tag, kind: f"list_filter(regexp_extract_all(coalesce(html, ''), {quoted(tag)}), lambda x: regexp_matches(x, {quoted(kind)}))"
    return f"""
with recursive pages_ as (select page_id, url, html, {host("url")} as host, {path("url")} as path from pages), {resolved("p", "pages_", "url", "url")},
raw as (select url, p_to as a, {decoded(f"regexp_extract(regexp_extract(coalesce(html, ''), {quoted(urls.BASE_TAG)}, 0), {quoted(urls.HREF)}, 1)")} as based,
  unnest(list_concat(list_transform({tags(urls.LINK_TAG, urls.CANONICAL)}, lambda x: {decoded(f"regexp_extract(x, {quoted(urls.HREF)}, 1)")}), list_transform({tags(urls.META_TAG, urls.IS_REFRESH)}, lambda x: {decoded(f"regexp_extract(x, {quoted(urls.REFRESH)}, 1)")}))) as t from p), {resolved("g", "(select * from raw where t <> '')", "url", "nullif(based, '')")},
by_ as (select a, t, coalesce(g_to, url) as base from g), {resolved("e", "by_", "base", "t")},
pair as (select a, e_to as b from e where a is not null and e_to is not null and a <> e_to union select e_to, a from e where a is not null and e_to is not null and a <> e_to),
bad as (select node from (select node, {host("node")} as host, {path("node")} as path from (select distinct a as node from pair) x) y where {pick(0)} = 'block'),
reach as (select node from bad union select b from reach join pair on a = node),
j as (select page_id, p_to as a, host, path, {pick(1)} as rule, {pick(0)} as own from p)
select page_id, host, path, rule, coalesce(own, case when a in (select node from reach) then 'block' else 'allow' end) as verdict from j
"""
