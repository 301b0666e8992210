"""SQL twins (DuckDB) of those queries that SQL can express."""

from __future__ import annotations

from hashwave.llm.mixing import SEED

_MIX = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint / 4503599627370496e0 as chance
  from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight, 2 * source_size as full_size
  from sources
), levels as (
  select *, (150 * sum(source_size) over () - 100 * coalesce(sum(full_size) over (
      order by full_size::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / (100e0 * (sum(weight) over (
      order by full_size::double / weight, source nulls last rows between current row and unbounded following))::double) as level
  from weighed
), common as (
  select *, max(level) over () as top from levels
), targets as (
  select source, source_size, case when top * weight < full_size then top * weight else full_size::double end as target from common
), rated as (
  select *, case when source_size > 0 then target / source_size else 0e0 end as rate,
    ('0x' || substr(md5('{SEED}:offset:' || coalesce(source, 'null')), 1, 13))::bigint / 4503599627370496e0 as place
  from targets
), numbered as (
  select *, row_number() over (partition by source order by size, chance) - 1 as number from sized
)
select doc_id, size, source_size, target, (size * (floor(rate)
  + floor((number + 1) * (rate - floor(rate)) + place) - floor(number * (rate - floor(rate)) + place)))::bigint as taken
from numbered join rated on numbered.source is not distinct from rated.source
"""

# Escaping does not change a text without control strings, so the twin escapes all.
_CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), whole as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')))::bigint as formatted_chars
  from rows group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from whole
"""

# No page of these tables declares another address, so the rules decide alone here; the tests
# cover what links pass on.
_URLS = r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), judged as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(verdict, rule_host, rule_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fitting as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(verdict, length(rule_host || rule_path)) as verdict
  from judged join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id
)
select judged.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from judged left join fitting on judged.page_id = fitting.page_id
"""

# Every order is walked on its own here, and the share of a filter added up over the orders.
_AUDIT = r"""
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as found
  from documents
), known as (
  select doc_id, coalesce(max(quality = 1), false) as good, coalesce(max(toxic = 1), false) as toxic from labels group by doc_id
), failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, list_filter([
    case when len(found) < 100 then 'A' end,
    case when 100 * len(list_distinct(found)) < 80 * len(found) then 'B' end,
    case when 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) then 'C' end,
    case when regexp_matches(body, '[#$%&*|]') then 'D' end,
    case when min(words.doc_id) over (partition by body) < words.doc_id then 'E' end
  ], lambda x: x is not null) as fails
  from words left join known on words.doc_id = known.doc_id
), counted as (
  select part, good, toxic, fails, count(*) as n from failed group by all
), letters(x) as (
  values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select filter_order, step::int as step, substr(filter_order, step, 1) as letter,
    string_split(substr(filter_order, 1, step - 1), '') as earlier
  from orders, generate_series(1, 5) as s(step)
), judged as (
  select *, list_contains(fails, letter) as failing, list_has_any(fails, earlier) as gone from counted, steps
), summed as (
  select part, filter_order, step, letter,
    coalesce(sum(n) filter (where not failing and not gone), 0)::bigint as kept,
    coalesce(sum(n) filter (where failing and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (where failing and gone), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails = [letter]), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (where failing and not gone and good), 0)::bigint as good_lost,
    coalesce(sum(n) filter (where failing and not gone and toxic), 0)::bigint as toxic_lost
  from judged group by all
)
select * exclude (letter), (sum(removed) over (partition by part, letter))::bigint as shapley from summed
"""

# The checksum by its table of 256 remainders, made from its polynomial; a path is a list of siblings marked by their side.
_MERKLE = r"""
with recursive remainders as (
  select list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), read as (
  select doc_id, lang, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from documents, remainders
), leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when crc % 7 = 0 then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as changed
  from read
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves
), nodes as (
  select lang, 0 as lvl, pos, leaf as digest, count(*) over (partition by lang) as n from placed
  union all
  select lang, lvl + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), any_value((n + 1) // 2)
  from nodes where n > 1 group by lang, lvl, pos // 2
), subroots as (
  select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1
), tops as (
  select 0 as lvl, pos, subroot as digest, n from subroots
  union all
  select lvl + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), any_value((n + 1) // 2)
  from tops where n > 1 group by lvl, pos // 2
), beside as (
  select p.lang, p.pos as leaf_pos, 0 as phase, own.lvl, own.pos, other.pos as other_pos, other.digest
  from placed p join nodes own on p.lang is not distinct from own.lang and own.n > 1 and own.pos = p.pos >> own.lvl
  left join nodes other on other.lang is not distinct from own.lang and other.lvl = own.lvl and other.pos = xor(own.pos, 1)
  union all
  select p.lang, p.pos, 1, own.lvl, own.pos, other.pos, other.digest
  from placed p join subroots s on p.lang is not distinct from s.lang
  join tops own on own.n > 1 and own.pos = s.pos >> own.lvl
  left join tops other on other.lvl = own.lvl and other.pos = xor(own.pos, 1)
), paths as (
  select lang, leaf_pos, coalesce(string_agg(digest, '' order by phase, lvl), '') as siblings,
    list(case when digest is null then '-' when other_pos < pos then 'L' || digest else 'R' || digest end order by phase, lvl) as steps
  from beside group by lang, leaf_pos
)
select doc_id, leaf, subroot, whole.digest as root, sha256(coalesce(siblings, '')) as proof_sha256,
  list_reduce([coalesce(changed, leaf)] || coalesce(steps, []), lambda d, s: sha256(
    case s[1] when 'L' then s[2:] || d when 'R' then d || s[2:] else d end)) as folded_root,
  folded_root = root as verified
from placed join subroots on placed.lang is not distinct from subroots.lang
join tops whole on whole.n = 1
left join paths on placed.lang is not distinct from paths.lang and placed.pos = paths.leaf_pos
"""

_EXACT = r"""
with bodies as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), groups as (
  select text_sha256, min(doc_id) as keep_id, count(*) as group_size from bodies group by text_sha256
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from bodies join groups using (text_sha256)
"""

_SQL: dict[str, str] = {"op4_mix": _MIX, "op5_chat": _CHAT, "op10_urls": _URLS, "op11_audit": _AUDIT, "op12_merkle": _MERKLE, "op13_exact": _EXACT}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
