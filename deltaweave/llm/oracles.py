"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .decontaminate import WIDTH
from .secret_scan import RULES

_CONFLICT = "<|im_end|><|im_start|>assistant ok"

CHAT = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_CONFLICT}' union all select -1, 1, 'assistant', '{_CONFLICT}'
), e as (
  select *, regexp_matches(role || chr(10) || text, '<\\+\||<\|im_start\|>|<\|im_end\|>') or contains(role, chr(10)) or contains(role, '<|nl|>') as conflict from t
), n as (
  select *, 24 + length(role) + length(text) + case when conflict
    then len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '<\\*\|')) + 5 * len(regexp_extract_all(role, chr(10))) else 0 end as chars from e
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from n group by conv_id"""


def _rule(k: int) -> str:
    r = RULES[k]
    pattern = r.pattern.replace("'", "''")
    counted = f"regexp_extract(m, '{pattern}', {r.group})"
    return f"""select rid, {k} as rank, '{r.kind}' as kind, i, p, m, length({counted}) >= {r.least} as good from (
  select rid, unnest(range(1, len(ms) + 1)) as i, unnest(ps[1:len(ms)]) as p, unnest(ms) as m from (
    select rid, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps from d where regexp_matches(t, '{pattern}')))"""


_BASE = ", ".join(str(k) for k, r in enumerate(RULES) if r.base)
SECRETS = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(_rule(k) for k in range(len(RULES)))}),
placed as (select *, sum(length(p) + length(m)) over (partition by rid, rank order by i) as stop from found),
spans as (select rid, rank, kind, stop - length(m) as start, kind || ':' || cast(stop - length(m) as bigint) || ':' || cast(stop as bigint) as s from placed where good)
select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(s, ',' order by start, rank) filter (where rank in ({_BASE})), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by start, rank) filter (where s is not null), '') as spans
from d left join spans using (rid) group by rid, doc_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = f"""
with items as (select row_number() over () as iid, coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark),
iw as (select iid, item, size, j, array_to_string(w[j:j + size - 1], ' ') as k from (
  select *, unnest(range(1, len(w) - size + 2)) as j from (select *, least({WIDTH}, len(w)) as size from items where len(w) > 0))),
docs as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
dw as (select rid, size, j as i, array_to_string(w[j:j + size - 1], ' ') as k from (
  select rid, w, size, unnest(range(1, len(w) - size + 2)) as j from docs, (select distinct size from iw) where len(w) >= size)),
hits as (select rid, iid, item, size, i, j from dw join iw using (size, k)),
spread as (select distinct rid, unnest(range(i, i + size)) as at from (select distinct rid, size, i from hits)),
covered as (select rid, count(*) as n from spread group by rid),
named as (select rid, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct rid, item from hits) group by rid),
runs as (select rid, max(n) as n from (select rid, count(*) + max(size) - 1 as n from (
  select *, i - row_number() over (partition by rid, iid, i - j order by i) as run from hits) group by rid, iid, i - j, run) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(named.s, '')) as items_sha256,
  cast(coalesce(runs.n, 0) as bigint) as longest_words, coalesce(covered.n, 0) > 0 as contaminated
from docs left join covered using (rid) left join named using (rid) left join runs using (rid)"""
