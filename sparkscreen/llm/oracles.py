"""DuckDB SQL for the queries' rows. Functions take the name of the documents relation, so that stages can be chained."""

from __future__ import annotations

from . import queries as q
from .quality import METRICS, MIN_DOCS


def az(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '[^\\x20\\x09-\\x0D]+')"


def op1() -> str:
    odd = "<|im_end|><|im_start|>assistant ok"
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '{odd}'), (-1, 1, 'assistant', '{odd}')),
e as (select *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as esc,
      lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from t),
f as (select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
      coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
      sum(length(esc) + case when before = role then length('<|im_sep|>') else length('<|im_start|>' || role || chr(10)) + length('<|im_end|>' || chr(10)) end)::bigint as formatted_chars
      from e group by conv_id)
select conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from f"""


def op2() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in q.URL_RULES)
    hosts = ", ".join(f"('{h}')" for h in q.BLOCKED_HOSTS)
    return f"""
with rules(rhost, rpath, rverdict) as (values {rules}), blocked(bhost) as (values {hosts}),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, {az("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(rverdict, length(rhost || rpath)) as rverdict
      from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id),
b as (select distinct page_id from p join blocked on host = bhost or ends_with(host, '.' || bhost))
select page_id, host, path, rule, coalesce(rverdict, case when b.page_id is not null then 'block' else 'allow' end) as verdict
from p left join r using (page_id) left join b using (page_id)"""


def measured(docs: str) -> str:
    """CTEs, the last of which, measured, has the rows of docs with measures."""
    return f"""numbered as (select *, row_number() over () as rid, {words("text")} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from {docs}),
windows as (select rid, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j:j + 2])) as g from numbered where len(w) > 2),
repeated as (select rid, count(distinct i + k) as n from (select rid, i, count(*) over (partition by rid, g) as c from windows) p, (values (0), (1), (2)) k(k) where c > 1 group by rid),
measured as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from (
  select d.* exclude (w, ls), len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from numbered d left join repeated using (rid)))"""


def bucket(v: str) -> str:
    return f"case when {v} < 64 then {v} else 32 * (length(bin({v})) - 6) + ({v} >> (length(bin({v})) - 6)::int) end"


def judged(docs: str) -> str:
    """CTEs, the last of which, judged, has the rows of docs with measures and kept."""
    low_end = lambda b: f"case when {b} < 64 then {b} else ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1)::int end"
    value = lambda m: f"({m.scale} * {m.above}) // greatest({m.below}, 1)"
    tails = "case metric " + " ".join(f"when {i} then {m.tail or 4}" for i, m in enumerate(METRICS)) + " end"
    quantiles = lambda by, level: f"""q{level} as (
  select {by} metric, max(total) as n, min(case when 4 * c >= total then b end) as p, min(case when 4 * c >= 3 * total then b end) as q, nullif(min(case when {tails} * c >= ({tails} - 1) * total then b end), 0) as t from (
    select {by} metric, b, sum(n) over (partition by {by} metric order by b) as c, sum(n) over (partition by {by} metric) as total
    from (select {by} metric, b, sum(n)::bigint as n from sketch group by all)) group by all)"""  # noqa: E731
    inside = " and ".join(f"{value(m)} between low_{i} and high_{i}" if m.spread else f"coalesce({bucket(value(m))} <= high_{i}, true)" for i, m in enumerate(METRICS))
    reach = lambda m: f"greatest({m.spread} * (hi - lo), hi // 32 + 1)"
    sides = ", ".join(
        f"max(case when metric = {i} then lo - {reach(m)} end) as low_{i}, max(case when metric = {i} then hi + {reach(m)} end) as high_{i}" if m.spread else f"max(case when metric = {i} then t end) as high_{i}"
        for i, m in enumerate(METRICS)
    )
    pick = lambda x: f"coalesce(case when q2.n >= {MIN_DOCS} then q2.{x} end, case when q1.n >= {MIN_DOCS} then q1.{x} end, q0.{x})"
    return f"""{measured(docs)},
sketch as (select lang, source, metric, {bucket("v")} as b, count(*) as n
  from ({" union all ".join(f"select lang, source, {i} as metric, {value(m)} as v from measured where not base_failed" for i, m in enumerate(METRICS))}) group by all),
{quantiles("lang, source,", 2)}, {quantiles("lang,", 1)}, {quantiles("", 0)},
picked as (select q2.lang, q2.source, q2.metric, {pick("p")} as pb, {pick("q")} as qb, {pick("t")} as t
  from q2 join q1 on q2.lang is not distinct from q1.lang and q2.metric = q1.metric join q0 on q2.metric = q0.metric),
fences as (select lang, source, {sides} from (select *, {low_end("pb")} as lo, {low_end("qb")} as hi from picked) group by lang, source),
judged as (select m.*, coalesce(not base_failed and {inside}, false) as kept from measured m left join fences f on m.lang is not distinct from f.lang and m.source is not distinct from f.source)"""


def op5(docs: str = "documents") -> str:
    return f"with {judged(docs)} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged"


def op6() -> str:
    v = "('0x' || substr(h, 5 * k::int + 1, 5))::bigint"
    four = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {s}) & 31)::int + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, strlen(payload)::bigint as payload_bytes, array_to_string(list_transform(range(8), lambda k: {four}), '') as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
from p"""


def cleaned(docs: str) -> str:
    """CTEs, the last of which, cleaned, has the rows of docs with boilerplate lines taken out and n_lines, n_dropped."""
    key = lambda x: f"trim({x}, ' ' || chr(9) || chr(13))"
    return f"""pagelines as (select source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: {key("x")}))) as k from {docs}),
boiler as (select source, list(k) as ks from (select source, k, count(*) as n from pagelines where k <> '' group by all having n >= {q.LINE_PAGES}) l
  join (select source as s, count(*) as total from {docs} group by all) t on l.source is not distinct from t.s where n > {q.LINE_RATIO}::double * total group by source),
kept_lines as (select d.*, string_split(text, chr(10)) as all_lines, case when ks is null then string_split(text, chr(10)) else list_filter(string_split(text, chr(10)), lambda x: not list_contains(ks, {key("x")})) end as some_lines
  from {docs} d left join boiler b on d.source is not distinct from b.source),
cleaned as (select * exclude (text, all_lines, some_lines), array_to_string(some_lines, chr(10)) as text, coalesce(len(all_lines), 0)::bigint as n_lines, coalesce(len(all_lines) - len(some_lines), 0)::bigint as n_dropped from kept_lines)"""


def op7(docs: str = "documents") -> str:
    return f"with {cleaned(docs)} select doc_id, source, n_lines, n_dropped, text from cleaned"


def mixed(docs: str) -> str:
    weights = ", ".join(f"('{s}', {w}::double)" for s, w in q.MIX_WEIGHTS.items())
    return f"""target(src, share) as (values {weights}),
sized as (select d.*, src, length(coalesce(text, '')) + 1 as size from {docs} d left join target on source = src),
groups as (select src, sum(size)::double as own from sized group by src),
rates as (select g.src, own, coalesce(share, {q.MIX_REST}::double) as share from groups g left join target t on g.src = t.src),
means as (select src, sum(own) over () * share / sum(share) over () / own as mean from rates),
cdf as (select src, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) over (partition by src order by k) as c from means, range(60) r(k)),
mixed as (select doc_id, text, lang, source, n_chars, unnest(range(n))::int as copy from (
  select d.*, (select count(*) from cdf where cdf.src is not distinct from d.src and c <= u) as n
  from (select *, ('0x' || substr(md5('{q.MIX_SEED}:' || coalesce(doc_id::varchar, '') || ':0'), 1, 13))::bigint / 4503599627370496.0 as u from sized) d))"""


def op8(docs: str = "documents") -> str:
    return f"with {mixed(docs)} select *, md5('order {q.MIX_SEED}:' || coalesce(doc_id::varchar, '') || ':' || copy) as shuffle_key from mixed"


def letters(c: str) -> str:
    return f"regexp_extract_all({az(f'coalesce({c}, {chr(39) * 2})')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def hits(docs: str) -> str:
    """CTEs, the last of which, hits, has (rid, n_hit, n_items, ids) of the rows of docw, the docs with a number and their words."""
    return f"""docw as (select *, row_number() over () as rid, {letters("text")} as w from {docs}),
itemw as (select coalesce(item_id::varchar, '') as id, {letters("text")} as w from benchmark),
pats as (select distinct id, least(10, len(w)) as m, w[i:i + least(10, len(w)) - 1] as g from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from itemw where len(w) > 0)),
docg as (select rid, m, i, w[i:i + m - 1] as g from (select rid, w, m, unnest(range(1, len(w) - m + 2)) as i from docw, (select distinct m from pats) where len(w) >= m)),
occ as (select rid, i, docg.m, id from docg join pats using (m, g)),
hitw as (select rid, count(distinct i + k) as n_hit from (select rid, i, unnest(range(m)) as k from occ) group by rid),
hits as (select rid, n_hit, n_items, ids from hitw join (select rid, count(distinct id) as n_items, string_agg(distinct id, ',' order by id) as ids from occ group by rid) using (rid))"""


def op4(docs: str = "documents") -> str:
    return f"""with {hits(docs)}
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from docw left join hits using (rid)"""


def op9(docs: str = "documents") -> str:
    rows = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in q.LICENSES)
    return f"""
with tw as (select id, {letters("t")} as w from (values {rows}) v(id, t)),
tc as (select id, w, least(5, len(w)) as n, greatest(least(5, len(w)), (2 ** ceil(log2(len(w))))::bigint) as span from tw),
tg as (select distinct id, n, span, w[i:i + n - 1] as g from (select *, unnest(range(1, len(w) - n + 2)) as i from tc)),
tn as (select id, n, span, count(*) as total from tg group by all),
dw as (select *, row_number() over () as rid, {letters("text")} as w from {docs}),
dg as (select rid, n, i - 1 as p, w[i:i + n - 1] as g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from tg) where len(w) >= n)),
hit as (select rid, id, tg.n, span, g, p from dg join tg using (n, g)),
win as (select rid, id, s * span as a, count(distinct g) as c from (select *, unnest(range(greatest(0, p // span - 2), p // span + 1)) as s from hit) where p <= s * span + 3 * span - n group by all),
ok as (select rid, id, count(*) as windows, max(c / total) as best from win join tn using (id) where c >= ceil(0.75 * total - 1e-9) group by all),
per as (select rid, count(*) as n_licenses, string_agg(id, ',' order by id) as license_ids, sum(windows)::bigint as n_windows, max(best) as max_containment from ok group by rid)
select doc_id, coalesce(n_licenses, 0)::bigint as n_licenses, coalesce(license_ids, '') as license_ids, coalesce(n_windows, 0)::bigint as n_windows, max_containment
from dw left join per using (rid)"""


def grouped(docs: str) -> str:
    """CTEs, the last of which, grouped, has (doc_id, n_shingles, component_id) of the rows of docs."""
    return f"""sw as (select doc_id, {words(az("text"))} as w from {docs}),
sg as (select distinct doc_id, case when len(w) < 5 then w else w[i:i + 4] end as g from (select *, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from sw where len(w) > 0)),
sn as (select doc_id, count(*) as n from sg group by doc_id),
sp as (select a.doc_id as a, b.doc_id as b, count(*) as c from sg a join sg b using (g) where a.doc_id < b.doc_id group by all),
sl as (select a, b from sp join sn x on a = x.doc_id join sn y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
se as (select a, b from sl union all select b, a from sl),
sc as (with recursive r(a, b) as (select a, b from se union select r.a, se.b from r join se on r.b = se.a) select a, min(b) as b from r group by a),
grouped as (select w.doc_id, coalesce(n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) as component_id from sw w left join sn using (doc_id) left join sc on w.doc_id = sc.a)"""


def op10(docs: str = "documents") -> str:
    return f"with recursive {grouped(docs)} select doc_id, n_shingles, component_id from grouped"


def pipeline() -> str:
    """The rows of the stages quality, lines, jaccard, decontam, mixing, each over what the one before left."""
    columns = "doc_id, text, lang, source, n_chars"
    return f"""with recursive {judged("documents")}, s1 as (select {columns} from judged where kept),
{cleaned("s1")}, s2 as (select doc_id, text, lang, source, case when n_dropped > 0 then length(text) else n_chars end as n_chars from cleaned),
{grouped("s2")}, s3 as (select {columns} from s2 where doc_id in (select doc_id from grouped where doc_id = component_id)),
{hits("s3")}, s4 as (select {columns} from docw left join hits using (rid) where n_hit is null),
{mixed("s4")} select *, md5('order {q.MIX_SEED}:' || coalesce(doc_id::varchar, '') || ':' || copy) as shuffle_key from mixed"""


def op12() -> str:
    h = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::bigint"
    piece = lambda a, b: f"array_to_string(units[{a} + 1:{b}], '')"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{q.FIM_SEED}:' || coalesce(doc_id::varchar, '')) as digest from documents),
u as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as units from d),
k as (select *, len(units)::bigint as n, {h(0)} % (len(units) + 1) as a, {h(1)} % (len(units) + 1) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {h(2)} % 100 >= {q.FIM_RATE} then 'plain' when {h(3)} % 100 < {q.FIM_SPM} then 'spm' else 'psm' end as form from u),
p as (select doc_id, t, n, form, {piece("0", "least(a, b)")} as prefix, {piece("least(a, b)", "greatest(a, b)")} as middle, {piece("greatest(a, b)", "n")} as suffix from k)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else t end) as output_sha256,
  sha256(t) as restored_sha256
from p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": op1(), "op2_urls": op2(), "op4_decontam": op4(), "op5_quality": op5(), "op6_warc": op6(), "op7_lines": op7(), "op8_mixing": op8(), "op9_licenses": op9(), "op10_jaccard": op10(), "op12_fim": op12()}
