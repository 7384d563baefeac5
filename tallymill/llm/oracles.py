"""SQL of the registered queries, where SQL can say it."""

from __future__ import annotations

from tallymill.llm.chat import CONTROL, END, SAYS, START
from tallymill.llm.quality import STOP_WORDS, stop_forms

ORACLES: dict[str, str] = {}

ORACLES["op2_decontamination"] = r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_starts as (
  select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as s from item_words where len(w) > 0),
windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[s : s + 12], ' ') as phrase from item_starts),
lengths as (select distinct n from windows),
places as (
  select doc_id, w, lengths.n as n, unnest(range(1, len(w) - lengths.n + 2)) as s
  from doc_words, lengths where len(w) >= lengths.n),
hits as (
  select p.doc_id, p.s, p.n, windows.item_id
  from (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as phrase from places) p
  join windows on windows.phrase = p.phrase and windows.n = p.n),
hit_words as (
  select doc_id, count(distinct pos) as n_hit
  from (select doc_id, unnest(range(s, s + n)) as pos from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id),
phrase_words as (
  select phrase, n, unnest(string_split(phrase, ' ')) as word, unnest(range(0, n)) as off
  from (select distinct phrase, n from windows)),
standing as (
  select doc_id, word, pos
  from (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from doc_words)
  where word in (select word from phrase_words)),
frequency as (select word, count(distinct doc_id) as df from standing group by word),
rarest as (
  select phrase, word, off from phrase_words join frequency using (word)
  qualify row_number() over (partition by phrase order by df, off) = 1),
begins as (
  select distinct r.phrase, s.doc_id, s.pos - r.off as start from rarest r join standing s using (word)),
near_places as (
  select b.doc_id, b.phrase, b.start
  from begins b join phrase_words p using (phrase)
  join standing s on s.doc_id = b.doc_id and s.word = p.word
    and s.pos between b.start + p.off - 2 and b.start + p.off + 2
  group by b.doc_id, b.phrase, b.start, p.n having count(distinct p.off) = p.n),
near_hits as (
  select doc_id, string_agg(item, ',' order by item) as near_items
  from (select distinct doc_id, cast(item_id as varchar) as item from near_places join windows using (phrase))
  group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words,
  cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated,
  coalesce(near_items, '') as near_items
from doc_words d left join hit_words using (doc_id) left join hit_items using (doc_id)
  left join near_hits using (doc_id)
"""

ORACLES["op1_quality_rules"] = r"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
parts as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts),
windows as (
  select doc_id, s, array_to_string(w[s : s + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as s from parts where len(w) >= 5)),
again as (select doc_id, g from windows group by doc_id, g having count(*) > 1),
repeated as (
  select doc_id, count(distinct pos) as n
  from (select doc_id, unnest(range(s, s + 5)) as pos from windows join again using (doc_id, g))
  group by doc_id),
counts as (
  select p.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) as n_upper,
    len(list_filter(w, lambda x: list_contains({stops}, x))) as n_stop
  from parts p left join repeated r using (doc_id)),
verdict as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  case when base_failed then false else
    n_words <= 1000000 and word_chars / n_words between 2 and 12 and n_symbols / n_words <= 0.3
    and n_upper / word_chars <= 0.5 and n_stop / n_words >= 0.04 and n_dup_lines / n_lines <= 0.5 end as kept
from verdict
"""

ORACLES["op1_quality_rules"] = ORACLES["op1_quality_rules"].replace(
    "{stops}", "[" + ", ".join(f"'{w}'" for w in stop_forms(STOP_WORDS)) + "]"
)

ORACLES["op5_chat_formatting"] = r"""
with every as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (select *, length(text) + length(role) + {marks} + {extra:text} + {extra:role} as chars from every)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""


def _added(col: str) -> str:
    """Characters that escaping adds: one per backslash and control string."""
    return " + ".join(
        f"(length({col}) - length(replace({col}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROL)
    )


for _part, _sql in (
    ("{marks}", str(len(START + SAYS + END))), ("{extra:text}", _added("text")), ("{extra:role}", _added("role")),
):
    ORACLES["op5_chat_formatting"] = ORACLES["op5_chat_formatting"].replace(_part, _sql)

ORACLES["op11_filter_interaction"] = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
flags as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
    max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 100 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
    || case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when min(doc_id) over (partition by t) < doc_id then 'E' else '' end as fails
  from (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts)
  left join flags using (doc_id)),
counted as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
steps as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
each as (
  select *, contains(fails, filter_order[step]) as own,
    len(fails) > 0 and len(translate(fails, filter_order[1 : step - 1], '')) < len(fails) as earlier,
    filter_order[step] as letter
  from counted, steps),
summed as (
  select part, filter_order, step, letter,
    coalesce(sum(n) filter (where not own and not earlier), 0) as kept,
    coalesce(sum(n) filter (where own and not earlier), 0) as removed,
    coalesce(sum(n) filter (where own and earlier), 0) as redundant,
    coalesce(sum(n) filter (where fails = letter), 0) as unique_fails,
    coalesce(sum(good) filter (where own and not earlier), 0) as good_lost,
    coalesce(sum(toxic) filter (where own and not earlier), 0) as toxic_lost
  from each group by part, filter_order, step, letter)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept,
  cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from summed
"""

ORACLES["op13_hard_negatives"] = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
    cast(list_dot_product(a.v, b.v) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id,
  cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank,
  id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 5
"""
