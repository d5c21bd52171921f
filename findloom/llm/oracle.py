"""The queries that DuckDB's SQL can express, for comparison; rows are told apart by number, as ids may repeat."""

QUALITY = r"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), listed as (
  select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from docs
), words as (
  select rid, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n_words from listed
), sized as (
  select rid, count(*) as n_words, sum(length(w)) as word_chars from words group by rid
), leads as (
  select rid, pos, n_words, length(w) as chars,
    concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) as g5,
    lead(w, 5) over o as w6, lead(w, 6) over o as w7, lead(w, 7) over o as w8, lead(w, 8) over o as w9, lead(w, 9) over o as w10
  from words window o as (partition by rid order by pos)
), starts as (
  select rid, pos, chars, n_words, unnest([5, 6, 7, 8, 9, 10]) as n,
    unnest([
      g5, concat_ws(' ', g5, w6), concat_ws(' ', g5, w6, w7), concat_ws(' ', g5, w6, w7, w8),
      concat_ws(' ', g5, w6, w7, w8, w9), concat_ws(' ', g5, w6, w7, w8, w9, w10)
    ]) as gram
  from leads
), found as (
  select rid, pos, chars, n, pos + n - 1 <= n_words
    and count(*) over (partition by rid, n, pos + n - 1 <= n_words, gram) > 1 as twice from starts
), inside as (
  select rid, n, chars,
    coalesce(max(case when twice then pos end) over (partition by rid, n order by pos rows unbounded preceding) > pos - n, false) as covered
  from found
), shares as (
  select rid, n, count(*) filter (covered) as n_covered,
    coalesce(sum(chars) filter (covered), 0)::double / sum(chars)::double as share
  from inside group by rid, n
), grams as (
  select rid, max(n_covered) filter (n = 5) as n_repeat_words, max(share) as worst,
    bool_or(share > (case n when 5 then 0.15::double when 6 then 0.14::double when 7 then 0.13::double
      when 8 then 0.12::double when 9 then 0.11::double else 0.10::double end)) as too_much
  from shares group by rid
), lines as (
  select rid, line, count(*) - 1 as again
  from (select rid, unnest(string_split(t, chr(10))) as line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid, line
), repeated as (
  select rid, sum(again) as n_dup_lines, sum(again * length(line)) as chars from lines group by rid
), measured as (
  select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(repeated.chars, 0)::double / greatest(1, length(t))::double as dup_line_share,
    coalesce(worst, 0::double) as dup_gram_share, coalesce(too_much, false) as too_much
  from docs left join sized using (rid) left join grams using (rid) left join repeated using (rid)
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measured
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, dup_line_share, dup_gram_share, base_failed,
  not (base_failed or too_much or dup_line_share > 0.3::double) as kept
from judged
"""

TOOL_CALLS = r"""
with recursive turns as (
  select conv_id, turn, coalesce(role, '') as role, text from conversations
), calls as (
  select conv_id, turn as position, conv_id || ':' || turn as call_id, text,
    case role when 'user' then 'reply' when 'system' then 'configure' else role end as tool,
    case when text is null then '{' else '{"prompt":' || to_json(text) || case when turn is null then '' else ',' end end
      || case when turn is null then '' else '"turn":' || turn end || '}' as arguments,
    case when turn >= 2 and role = 'user' then conv_id || ':' || (turn - 2) end as after
  from turns where role <> 'assistant'
), results as (
  select conv_id, turn as position, conv_id || ':' || (turn - 1) as call_id, text as content from turns where role = 'assistant'
), ranked as (
  select *, row_number() over (
    partition by call_id
    order by position nulls first, conv_id nulls first, arguments nulls first, tool nulls first, after nulls first
  ) as nth from calls
), first_calls as (
  select * from ranked where call_id is not null and nth = 1
), answers as (
  select *, row_number() over (
    partition by call_id order by position nulls first, content nulls first, conv_id nulls first
  ) as nth, count(*) over (partition by call_id) as n_results
  from results
), depths as (
  select call_id, 0 as depth from first_calls where after is null or after not in (select call_id from first_calls)
  union all
  select f.call_id, d.depth + 1 from first_calls f join depths d on f.after = d.call_id
), heads as (
  select f.*, depth, coalesce(n_results, 0) as n_results, content, null as trouble
  from first_calls f join depths using (call_id)
  left join (select call_id, n_results, content from answers where nth = 1) using (call_id)
  union all by name
  select *, 0 as depth, 0 as n_results, null as content,
    case when call_id is null then 'no id' else 'repeated id' end as trouble
  from ranked where call_id is null or nth > 1
), linked as (
  select h.conv_id, h.position, h.call_id, h.tool, h.depth, h.n_results, h.content, h.arguments,
    concat_ws('; ', h.trouble, case when h.after is not null and p.call_id is null then 'unknown dependency' end,
      case when h.tool not in ('reply', 'configure') then 'unknown tool' end,
      case when h.tool in ('reply', 'configure') then
        case when h.text is null then 'missing prompt' when length(h.text) not between 1 and 2000 then 'range of prompt' end end,
      case when h.tool in ('reply', 'configure') then
        case when h.position is null then 'missing turn'
          when h.position < 0 or h.tool = 'configure' and h.position > 0 then 'range of turn' end end) as errors
  from heads h left join first_calls p on h.after = p.call_id
), orphans as (
  select a.conv_id, a.position, a.call_id, null as tool, 0 as depth, 1 as n_results, a.content, null as arguments,
    case when a.call_id is null then 'no id; no call' when f.call_id is null then 'no call' else 'repeated result' end as errors
  from answers a left join first_calls f using (call_id) where f.call_id is null or a.nth > 1
), lines as (
  select *, '{' || concat_ws(',', '"arguments":' || arguments, '"id":' || to_json(call_id), '"result":' || to_json(content),
    '"tool":' || to_json(tool)) || '}' as line
  from (select * from linked union all by name select * from orphans)
)
select conv_id, position, call_id, tool, depth::bigint as depth,
  row_number() over (
    partition by conv_id order by depth, position nulls first, call_id nulls first, line nulls first
  ) - 1 as "order",
  n_results::bigint as n_results, errors = '' as valid, errors, line
from lines
"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain_words(table: str, columns: str) -> str:
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return f"select {columns}, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}"


BENCHMARK = f"""
with words as (
  {_plain_words("documents", "row_number() over () as rid, doc_id")}
), items as (
  {_plain_words("benchmark", "item_id")}
), windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as words
  from items, unnest(range(1, len(w) - least(len(w), 10) + 2)) as t(i) where len(w) > 0
), sizes as (
  select distinct size from windows
), spots as (
  select rid, i, size, array_to_string(w[i : i + size - 1], ' ') as words
  from words, sizes, unnest(range(1, len(w) - size + 2)) as t(i)
), hits as (
  select rid, i, size, item_id from spots join windows using (size, words)
), places as (
  select rid, count(distinct p) as n_hit from (select distinct rid, i, size from hits) as h, unnest(range(i, i + size)) as t(p) group by rid
), found as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct rid, cast(item_id as varchar) as item from hits where item_id is not null) as h group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join places using (rid) left join found using (rid)
"""


def _nearest(i: int) -> str:
    return f"""assigned{i} as materialized (
  select rid, part, arg_min(entry, (square, entry)) as entry, min(square) as square
  from (
    select c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) as square
    from components as c join books{i} as b using (part, pos) group by c.rid, c.part, b.entry
  ) as d group by rid, part
)"""


def _moved(i: int) -> str:
    return f"""books{i + 1} as materialized (
  select part, entry, pos, coalesce(m.x, b.x) as x
  from books{i} as b left join (
    select part, entry, pos, (total - ((total % n) + n) % n) // n as x
    from (
      select part, entry, pos, sum(x)::bigint as total, count(*) as n
      from components join assigned{i} using (rid, part) group by part, entry, pos
    ) as s
  ) as m using (part, entry, pos)
)"""


CODES = f"""
with kept as materialized (
  select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), components as materialized (
  select rid, (i - 1) // (len(embedding) // 16) as part, (i - 1) % (len(embedding) // 16) as pos,
    cast(floor(256 * cast(embedding[i] as double)) as bigint) as x
  from kept, unnest(range(1, len(embedding) + 1)) as t(i)
), books0 as materialized (
  select part, rid - 1 as entry, pos, x from components where rid <= 64
), {_nearest(0)}, {_moved(0)}, {_nearest(1)}, {_moved(1)}, {_nearest(2)}, codes as (
  select rid, string_agg(printf('%02x', entry), '' order by part) as code, sum(square)::bigint as error from assigned2 group by rid
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) from books2) as codebooks_sha256
from kept join codes using (rid)
"""

# The checksum is the usual one (reflected polynomial 0xEDB88320), a byte at a time.
SPELLINGS = f"""
with recursive steps as (
  select list(list_reduce(range(8), lambda c, b: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as step
  from range(256) as t(n)
), runs as (
  select coalesce(cast(doc_id as varchar), '') as id, translate(run, '{_UPPER}', '{_UPPER.lower()}') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) as r
  where length(run) >= 6 group by 1, 2
), bytes as (
  select run, n, hex(encode(id || ':' || run)) as h from runs
), marked as (
  select run, n, 4294967295 - list_reduce(
    list_transform(range(1, length(h) // 2 + 1), lambda i: cast('0x' || h[2 * i - 1 : 2 * i] as bigint)),
    lambda c, b: xor(c >> 8, step[xor(c, b) % 256 + 1]), cast(4294967295 as bigint)
  ) as mark from bytes, steps
), spelled as (
  select case when mark % 199 = 0 then left(run, mark % length(run)) || substr(run, mark % length(run) + 2) else run end as word, n from marked
), words as materialized (
  select word, cast(sum(n) as bigint) as n from spelled where length(word) >= 6 group by word having sum(n) >= 5
), spots as materialized (
  select word, n, i, left(word, i - 1) as head, substr(word, i + 1) as rest from words, unnest(range(1, length(word) + 1)) as t(i)
), near as materialized (
  select a.word, b.word as near, b.n as near_n
  from spots as a join spots as b on a.i = b.i and a.head = b.head and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from spots as a join words as b on a.head || a.rest = b.word
  union select b.word, a.word, a.n from spots as a join words as b on a.head || a.rest = b.word
), best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word
), forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * w.n then near end as form,
    case when near_n >= 5 * w.n then near_n end as form_n
  from words as w left join best using (word)
), paths(word, root) as (
  select word, word from forms
  union all select p.word, f.form from paths as p join forms as f on f.word = p.root where f.form is not null
)
select f.word, f.form, p.root, f.n, f.n_near, f.form_n
from forms as f join paths as p using (word) join forms as e on e.word = p.root where e.form is null
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_tool_call_linking": TOOL_CALLS, "op10_quality_rules": QUALITY, "op11_benchmark_decontamination": BENCHMARK,
        "op12_elkan_codes": CODES, "op13_spelling_neighbourhoods": SPELLINGS,
    }
