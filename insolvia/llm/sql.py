"""DuckDB SQL for the operators whose contract SQL can express over whole tables."""
from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_url_filters": r"""
with rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(rule, verdict) as (values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
cut as (select *, split_part(rule, '/', 1) as rule_host, substr(rule, strpos(rule, '/')) as rule_path from rules),
best as (
  select page_id, host, path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
  from parts join cut on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by all)
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, case when p.host = '' then 'block' else 'allow' end) as verdict
from parts p left join best b on p.page_id = b.page_id and p.host = b.host and p.path = b.path
""",
    "op3_exact_dedup": r"""
with norm as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
ranked as (select doc_id, t, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size from norm window w as (partition by t order by points desc, doc_id))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from ranked
""",
    "op4_substring_dedup": r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, unnest(range(1, len(w) - 48)) as pos, w from words where len(w) >= 50),
keyed as (select doc_id, pos, array_to_string(w[pos : pos + 49], ' ') as k from windows),
marked as (select doc_id, pos, doc_id > min(doc_id) over (partition by k) as again from keyed),
gone as (select distinct doc_id, unnest(range(pos, pos + 50)) as place from marked where again),
lists as (select doc_id, list(place) as places from gone group by doc_id),
kept as (select words.doc_id, len(w) as n_words, len(coalesce(places, [])) as n_removed,
  array_to_string([x for x, i in w if not list_contains(coalesce(places, []), i)], ' ') as t
  from words left join lists using (doc_id))
select doc_id, n_words, n_removed, sha256(coalesce(t, '')) as kept_sha256 from kept
""",
    "op7_decontamination": rf"""
with words as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
items as (select item_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from benchmark),
windows as (
  select distinct item_id, size, array_to_string(w[pos : pos + size - 1], ' ') as k
  from (select item_id, w, least(10, len(w)) as size, unnest(range(1, greatest(1, len(w) - 9) + 1)) as pos from items where len(w) > 0)),
sizes as (select distinct size from windows),
places as (select doc_id, size, pos, array_to_string(w[pos : pos + size - 1], ' ') as k
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as pos from words cross join sizes where len(w) >= size)),
found as (select doc_id, pos, p.size as size, item_id from places p join windows using (size, k)),
hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as place from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct doc_id, item_id::varchar as name from found) group by doc_id)
select words.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits using (doc_id) left join named using (doc_id)
""",
    "op10_near_dedup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select distinct doc_id, s from (
  select doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[pos : pos + 2], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as pos from words where len(w) > 0))),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
sym as (select a, b from links union select b, a from links),
reach(doc_id, r) as (select a, a from sym union select reach.doc_id, sym.b from reach join sym on reach.r = sym.a),
parts as (select doc_id, min(r) as part from reach group by doc_id)
select words.doc_id, coalesce(n, 0) as n_shingles, coalesce(part, words.doc_id) as component_id, coalesce(part, words.doc_id) = words.doc_id as kept
from words left join sizes using (doc_id) left join parts using (doc_id)
""",
    "op12_hard_negatives": r"""
with usable as (
  select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * c::double) for c in embedding] as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
pairs as (select a.id as a, r.id as r, a.label = r.label as same, list_dot_product(a.x, r.x)::bigint as s from usable a join usable r on a.id % 100 = 0 and a.id <> r.id),
positives as (select a, r, s from pairs where same qualify row_number() over (partition by a order by s desc, r) <= 5)
select p.a as anchor_id, p.r as positive_id, row_number() over (partition by p.a, p.r order by n.s desc, n.r)::int as rank, n.r as negative_id, p.s as positive_score, n.s as negative_score
from positives p join pairs n on n.a = p.a and not n.same and 80 * p.s <= 100 * n.s and n.s <= p.s
qualify row_number() over (partition by p.a, p.r order by n.s desc, n.r) <= 5
""",
}
