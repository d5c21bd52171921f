"""The queries of ``registry`` in DuckDB's SQL, each from the raw tables on."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators.present import TEMPLATE

WORD = r"[\p{L}\p{M}\p{N}]+"


def fold(x: str) -> str:
    out = f"lower({x})"
    for special, plain in lx.SPECIAL:
        out = f"replace({out}, '{special}', '{plain}')"
    return rf"regexp_replace(strip_accents({out}), '\p{{Mn}}+', '', 'g')"


def normalize(x: str) -> str:
    return rf"trim(regexp_replace({fold(x)}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def tokens(x: str) -> str:
    return f"list_filter(string_split({normalize(x)}, ' '), lambda t: t <> '')"


def german(x: str) -> str:
    return fold(f"replace(replace(replace(lower({x}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')")


def stopword(term: str, lang: str) -> str:
    parts = []
    for code, listed in lx.STOPWORDS.items():
        quoted = ", ".join(f"'{w}'" for w in tx.folded_list(listed))
        parts.append(f"({lang} = '{code}' and {term} in ({quoted}))")
    return "(" + " or ".join(parts) + ")"


def indexable(term: str, lang: str) -> str:
    return f"(length({term}) >= 2 and strlen({term}) <= 64 and not {stopword(term, lang)})"


def phrase_in(text: str, phrase: str) -> str:
    return f"contains(' ' || {text} || ' ', ' ' || {phrase} || ' ')"


POSTS = """
posts as (
  select d.doc_id, d.lang, substr(split_part(d.text, chr(10), 1), 1, 80) as title, d.text as content, d.source as tag,
         case when l.quality = 1 then 1.15 else 1.0 end::double as boost,
         date '2024-01-01' + (d.doc_id % 365)::int as post_date
  from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)
)"""

TERMS = f"""
field_rows as (
  select doc_id, lang, 'title' as field, title as text, 100 as strength from posts
  union all select doc_id, lang, 'content', content, 100 from posts
  union all select doc_id, lang, 'taxonomy', tag, 100 from posts
  union all select p.doc_id, p.lang, 'place', r.r_name, 30 from posts p
    join nation n on n.n_nationkey = p.doc_id % 25 join region r on r.r_regionkey = n.n_regionkey
  union all select p.doc_id, p.lang, 'place', n.n_name, 100 from posts p join nation n on n.n_nationkey = p.doc_id % 25
), raws as (
  select doc_id, lang, field, strength, unnest({words('text')}) as raw from field_rows
), folded as (
  select *, {fold('raw')} as norm, {german('raw')} as spelled from raws
), mentions as (
  select doc_id, lang, field, strength, norm as term from folded where {indexable('norm', 'lang')}
  union all
  select doc_id, lang, field, strength, spelled from folded
  where {indexable('norm', 'lang')} and lang = 'de' and spelled <> norm and strlen(spelled) <= 64
), terms as (
  select doc_id, lang, term,
    count(*) filter (field = 'title') as title, count(*) filter (field = 'content') as content,
    count(*) filter (field = 'taxonomy') as taxonomy,
    coalesce(max(case when field = 'place' then strength end), 0) as place
  from mentions group by all
)"""


ASKED = f"array_to_string(list_slice({words('text')}, 1, item_id % 3 + 1), ' ')"


def _all_asked(quotes: bool) -> str:
    text = f"case when item_id % 5 = 1 then '\"' || {ASKED} || '\"' else {ASKED} end" if quotes else ASKED
    return f"""select item_id * 4 + k as qid, ['de', 'en', 'es', 'fr'][k + 1] as lang, {text} as query
      from benchmark, (select unnest([0, 1, 2, 3]) as k)"""


def _queries(quotes: bool) -> str:
    return f"asked as ({_all_asked(quotes)})"


def _singulars() -> str:
    def less(n):
        return f"left(token, length(token) - {n})"

    return f"""
  select qid, lang, g, token, raw, {less(1)} as term, 1 as prio from groups
    where lang in ('fr', 'en') and length(token) >= 5 and regexp_matches(token, '[sx]$')
  union all select qid, lang, g, token, raw, {less(3)} || 'y', 1 from groups
    where lang = 'en' and length(token) >= 6 and token like '%ies'
  union all select qid, lang, g, token, raw, case when length(token) >= 6 and token like '%en' then {less(2)} else {less(1)} end, 1
    from groups where lang = 'de' and ((length(token) >= 6 and token like '%en') or (length(token) >= 5 and regexp_matches(token, '[ens]$')))"""


def _synonyms() -> str:
    return ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in tx.synonym_rows())


PARSED = f"""
q as (
  select qid, lang, query, {normalize('query')} as normalized, {tokens('query')} as tokens,
    list_filter(list_transform(regexp_extract_all(query, '"[^"]+"'), lambda p: {normalize('p')}), lambda p: contains(p, ' ')) as phrases
  from asked
), query_words as (
  select qid, lang, unnest({words('query')}) as raw, generate_subscripts({words('query')}, 1) as pos from asked
), groups as (
  select qid, lang, row_number() over (partition by qid order by pos) - 1 as g, token, raw from (
    select qid, lang, token, min(pos) as pos, arg_min(raw, pos) as raw
    from (select *, {fold('raw')} as token from query_words) where {indexable('token', 'lang')} group by qid, lang, token
  ) qualify g < 10
), n_groups as (select qid, count(*) as n from groups group by 1
), spelled_variants as (
  select qid, lang, g, token, raw, token as term, 0 as prio from groups
  union all select qid, lang, g, token, raw, {german('raw')}, 0 from groups
    where lang = 'de' and {german('raw')} <> token and strlen({german('raw')}) <= 64
  union all {_singulars()}
  union all select qid, g.lang, g, token, raw, s.other, 2 from groups g
    join (values {_synonyms()}) s(lang, word, other) on s.lang = g.lang and s.word = g.token
), qv0 as (
  select qid, lang, g, token, raw, term, min(prio) as prio from spelled_variants group by all
)"""

PREFIXED = """
vocabulary as (select distinct lang, term from terms
), longer as (
  select g.*, v.term from groups g join vocabulary v
    on v.lang = g.lang and starts_with(v.term, g.token) and v.term <> g.token
  where length(g.token) >= 4 and not regexp_matches(g.token, '^[0-9]+$')
  qualify row_number() over (partition by qid, g order by v.term) <= 30
), qv as (
  select qid, lang, g, token, raw, term, [1.0, 0.85, 0.8][prio + 1]::double as weight, ['word', 'plural', 'synonym'][prio + 1] as kind from qv0
  union all
  select l.qid, l.lang, l.g, l.token, l.raw, l.term, 0.5, 'prefix' from longer l
  where not exists (select 1 from qv0 v where v.qid = l.qid and v.g = l.g and v.term = l.term)
)"""


def _ranked(fallback: bool, quotes: bool, asked: str | None = None) -> str:
    f = "true" if fallback else "false"

    def points(name, weight, strength=False):
        amount = f"({name} / 100.0::double)" if strength else f"(1.0::double + 0.6::double * ln({name}::double))"
        return f"max(case when t.{name} > 0 then {weight}::double * {amount.replace(name, 't.' + name)} * v.weight end) as {name}"

    return f"""
with {POSTS}, {TERMS}, {asked or _queries(quotes)}, {PARSED}, {PREFIXED},
best as (
  select v.qid, v.lang, t.doc_id, v.g, {points('title', 10)}, {points('content', 3)}, {points('taxonomy', 2)},
    {points('place', 7, True)}
  from qv v join terms t on t.lang = v.lang and t.term = v.term group by all
), counts as (select lang, count(*) as n_docs from posts group by 1
), df as (select qid, g, count(*) as df from best group by 1, 2
), rare as (
  select g.qid, g.g, g.raw, coalesce(df, 0) as df, case when coalesce(df, 0) = 0 then 0.0 else
    greatest(0.2, least(1.0, ln(1 + greatest(coalesce(n_docs, 0), 1)::double / df) /
      greatest(ln(2.0::double), ln(1 + greatest(coalesce(n_docs, 0), 1)::double / 5)))) end as rarity
  from groups g left join df using (qid, g) left join counts c on c.lang = g.lang
), scored as (
  select b.qid, b.lang, b.doc_id, count(*) as matched,
    list_reduce(list((coalesce(title, 0.0) + coalesce(content, 0.0) + coalesce(taxonomy, 0.0) + coalesce(place, 0.0)) * r.rarity order by b.g),
      lambda x, y: x + y) as base,
    bool_and(title is not null) as titled
  from best b join rare r using (qid, g) group by 1, 2, 3
), modes as (
  select qid, n, case when reached >= n then 'none' when {f} and n > 1 and reached >= case when n >= 3 then ceil(n / 2) else 1 end then 'or' else 'none' end as fallback,
    case when reached >= n then n when {f} and n > 1 then case when n >= 3 then ceil(n / 2) else 1 end else n end as required
  from n_groups left join (select qid, max(matched) as reached from scored group by 1) using (qid)
), kept as (
  select s.*, m.n, m.fallback, p.title, p.content, p.boost, p.post_date, q.normalized, q.tokens, q.phrases,
    {normalize('p.title')} as title_norm,
    array_to_string(list_filter(q.tokens, lambda t: {indexable('t', 's.lang')}), ' ') as plain,
    array_to_string(list_filter({tokens('p.title')}, lambda t: {indexable('t', 's.lang')}), ' ') as plain_title
  from scored s join modes m using (qid) join posts p on p.doc_id = s.doc_id and p.lang = s.lang join q on q.qid = s.qid
  where s.matched >= m.required
), bonuses as (
  select *, case when title_norm <> '' and (title_norm = normalized or (plain <> '' and plain_title = plain)) then 20.0
           when len(tokens) >= 2 and {phrase_in('title_norm', 'normalized')} then 15.0 else 0.0 end::double as title_bonus,
    case when n >= 2 and matched = n and titled then 6.0 else 0.0 end::double as all_titled from kept
), bonused as (
  select *, base * case when fallback = 'or' then (matched::double / n) * (matched::double / n) else 1.0 end
    + title_bonus + all_titled as score0
  from bonuses
), placed as (select *, row_number() over (partition by qid order by score0 desc, doc_id) as nth from bonused
), looked as (
  select *, (len(phrases) > 0 or len(tokens) >= 2) and nth <= case when len(phrases) > 0 then 300 else 50 end as near,
    case when (len(phrases) > 0 or len(tokens) >= 2) and nth <= 300 then {normalize('content')} end as body from placed
), phrased as (
  select *, score0 + phrase as score1 from (
    select *, case when near and len(tokens) >= 2 and {phrase_in('body', 'normalized')} then 4.0 else 0.0 end::double as phrase from looked)
  where (near and len(list_filter(phrases, lambda p: not ({phrase_in('title_norm', 'p')} or {phrase_in('body', 'p')}))) = 0)
     or (not near and len(phrases) = 0)
), ranked as (
  select qid, lang, doc_id, score, fallback, matched, (matched = n and titled) as about, post_date, n, boost, title_bonus, all_titled,
    phrase, row_number() over (partition by qid order by score desc, post_date desc, doc_id desc) as place
  from (select *, round(cast(score1 * boost as decimal(18,6)), 2)::double as score from phrased where score1 * boost > 0)
  qualify place <= 500
)"""


EVENTS = """
searches as (
  select 'q' || regexp_extract(props, '[0-9]+') as query, ['fr', 'en', 'de'][user_id % 3 + 1] as lang, ts,
    floor(value)::bigint as results, case when event_id % 50 = 0 then 'or' else '' end as fallback, ts::date as day
  from events where event_type = 'view'
), log as (
  select query, lang, day, count(*) as searches, arg_max(results, (ts, results, fallback)) as results,
    arg_max(fallback, (ts, results, fallback)) as fallback
  from searches group by 1, 2, 3
), clicked as (
  select 'q' || regexp_extract(props, '[0-9]+') as query, ['fr', 'en', 'de'][user_id % 3 + 1] as lang, ts::date as day,
    user_id as post_id, 1 + event_id % 10 as rank, ['result', 'pinned', 'photos', 'other'][event_id % 4 + 1] as source
  from events where event_type = 'click'
), fine as (
  select c.* from clicked c
  where source in ('result', 'pinned', 'photos', 'guides') and post_id > 0
    and exists (select 1 from documents d where d.doc_id = c.post_id and d.lang = c.lang)
    and exists (select 1 from log l where l.query = c.query and l.lang = c.lang and l.day between c.day - 1 and c.day)
), clicks as (
  select query, lang, day, post_id, source, count(*) as clicks, sum(rank)::bigint as rank_total from fine group by all
)"""

AS_OF, NEXT_YEAR = "2024-01-30", "2025-01-15"
_RECENT = f"day between date '{AS_OF}' - 30 and date '{AS_OF}'"
_PROVEN = f"""
proven as (
  select query, lang, sum(searches) as searches from log where day between date '{AS_OF}' - 60 and date '{AS_OF}'
  group by 1, 2 having sum(searches) >= 3 and min(results) >= 5 and max(fallback) = ''
), popular as (
  select query, lang, row_number() over (partition by lang order by searches desc, query) as nth from proven
), merged as (
  select * from popular where nth <= 500 and length(query) between 3 and 40
)"""


def _report(where: str, thin: str = "") -> str:
    return f"""with {EVENTS}{thin} select query, lang, sum(searches)::bigint as searches, max(results) as results,
      max(fallback) as fallback, max(day) as last_day from {"thin" if thin else "log"} where {_RECENT} group by 1, 2 having {where}
      order by searches desc, last_day desc, query, lang limit 50"""


def _junk() -> str:
    probes = "|".join(f"(?:{p})" for p in lx.PROBES)
    return rf"""regexp_matches(query, '[\\<>{{}}$=;|^*@`\x00-\x1f\x7f]') or regexp_matches(lower(query), '{probes}')
      or len(list_filter(regexp_extract_all(query, '[()''"’,.]{{4,}}'), lambda r: regexp_matches(r, '[()]') and regexp_matches(r, '[''"’]'))) > 0
      or regexp_matches(query, '(?i)/(?:[a-z]{{2}}-[a-z]{{2}}|page/[0-9]+)(/|$)')
      or len(regexp_extract_all(query, '["''’]')) > 2 or length(trim(query)) > 100"""


def _page_text() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in lx.UNSEEN_TAGS.split("|"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    return out


def _entities(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


_LINE = r"trim(regexp_replace(x, '[\s\x{a0}\x{200b}]+', ' ', 'g'))"


def _path_words(source: str = "pages") -> str:
    skip = ", ".join(f"'{s}'" for s in lx.SKIP_SEGMENTS)
    return rf"""with raw as (
      select page_id, lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) as path from {source}
    ), parts as (select *, list_filter(string_split(path, '/'), lambda s: s <> '') as parts from raw
    ), useful as (
      select *, list_filter(case when parts[1] in ('fr', 'en', 'de') then parts[2:] else parts end,
        lambda s: not regexp_matches(s, '^[0-9]+$') and s not in ({skip})) as useful from parts
    ), found as (
      select *, list_slice(list_filter(flatten(list_transform(list_reverse(useful[-2:]),
        lambda s: {tokens(r"regexp_replace(regexp_replace(s, '\.html?$', ''), '[-_+.]+', ' ', 'g')")})),
        lambda w: not regexp_matches(w, '^[0-9]+$')), 1, 8) as found from useful
    )
    select page_id, case when strlen(path) <= 200
      and (not regexp_matches(path, '\.[a-z0-9]{{1,6}}$') or regexp_matches(path, '\.html?$'))
      and not regexp_matches(path, '(^|/)(\.|wp-(admin|content|includes|json)(/|$))')
      and len(parts) <= 6 and len(list_filter(found, lambda w: length(w) >= 3)) > 0
      then array_to_string(list_filter(found, lambda w, i: list_position(found, w) = i), ' ') else '' end as words from found"""


def _escaped(x: str) -> str:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\'\'", "&#039;")):
        x = f"replace({x}, '{plain}', '{safe}')"
    return x


def _hit(p: str, lang: str) -> str:
    """Whether a word is one of ``terms`` or begins with one of ``prefixes``."""
    return f"""(length({fold(p)}) >= 2 and (list_contains(terms, {fold(p)}) or len(list_filter(prefixes, lambda b: starts_with({fold(p)}, b))) > 0
      or ({lang} = 'de' and list_contains(terms, {german(p)}) and not {stopword(fold(p), "'de'")})))"""


def marked(text: str, lang: str) -> str:
    """The text with its matching words marked."""
    before, after = TEMPLATE.split("%s")
    parts = WORD + "|" + r"[^\p{L}\p{M}\p{N}]+"
    return f"""array_to_string(list_transform(regexp_extract_all({text}, '{parts}'), lambda p:
      case when regexp_matches(p, '^{WORD}') and {_hit('p', lang)} then '{before}' || {_escaped('p')} || '{after}' else {_escaped('p')} end), '')"""


MARKS = """
marks as (
  select qid, list_sort(list_distinct(list(v.term) filter (kind <> 'prefix'))) as terms,
    coalesce(list_sort(list_distinct(list(v.token) filter (length(v.token) >= 4 and not regexp_matches(v.token, '^[0-9]+$')))), []::varchar[]) as prefixes
  from qv v group by 1
)"""

PINS = f"""
pin_lines as (
  select qid as line, query, {normalize('query')} as norm, unnest([qid % 40 + 1, qid % 40]) as doc_id, unnest([0, 1]) as pos
  from ({_all_asked(False)}) where qid % 12 = 0
), pins as (select line, query, norm, doc_id, row_number() over (partition by line order by pos) - 1 as pos from pin_lines where doc_id > 0 and norm <> '')"""

PINNED = f"""{PINS}, pinned as (
  select q.qid, q.lang, d.doc_id, min(line * 10 + pos) as pin from q join pins on norm = normalized
  join documents d on d.doc_id = pins.doc_id and d.lang = q.lang where normalized <> '' group by 1, 2, 3
), with_pins as (
  select qid, doc_id, pin, coalesce(score, 0.0) as score, coalesce(about, false) as about,
    case when count(*) filter (pin is null) over (partition by qid) > 0 then coalesce(fallback, 'none') else 'none' end as fallback,
    row_number() over (partition by qid order by pin is null, pin, place) as place
  from ranked r full join pinned p using (qid, doc_id)
), able as (select *, about and pin is null and fallback = 'none' and doc_id % 4 = 0 as able from with_pins
), cut as (select *, able and row_number() over (partition by qid, able order by place) <= 3 as chosen from able
), told as (select *, chosen and count(*) filter (not chosen) over (partition by qid) > 0 as guide from cut
), listed as (select *, row_number() over (partition by qid order by place) as rank from told where not guide
)"""

RAW = f"""
raw as (
  select lang, day, ts, fallback, case when results % 3 = 0 then 0 else results end as results, floor(epoch(ts::timestamp))::bigint as n, query as own,
    'word' || translate(right(query, 1), '0123456789', 'abcdefghij') as word
  from searches
), typed as (
  select *, case when n % 7 = 0 then word || ')' || chr(39) || '(,,).)"(' when n % 7 = 1 then word when n % 11 = 0 then ' ' || upper(own) || '%20x' else own end as query,
    case when n % 7 = 1 then word when n % 11 = 0 then own || ' x' else own end as key
  from raw
), counted as (select key as query, lang, day, ts, results, fallback from typed where n % 7 <> 0
), probes as (select distinct word, lang, day from typed where n % 7 = 0
)"""

_NOT_PROBED = "not (results = 0 and exists (select 1 from probes p where p.word = k.query and p.lang = k.lang and p.day = k.day))"


def _log_of(source: str, where: str = "true") -> str:
    return f"""select query, lang, day, count(*) as searches, arg_max(results, (ts, results, fallback)) as results,
      arg_max(fallback, (ts, results, fallback)) as fallback from {source} where {where} group by 1, 2, 3"""


def _explained() -> str:
    damped = lambda f: f"(1.0::double + 0.6::double * ln(t.{f}::double))"
    fields = [("title", 10, damped("title")), ("content", 3, damped("content")), ("taxonomy", 2, damped("taxonomy")), ("place", 7, "(t.place / 100.0::double)")]
    rows = " union all ".join(
        f"select v.qid, t.doc_id, v.g, '{f}' as field, v.term, v.kind, t.{f}::int as value, v.weight, {w}::double * {a} * v.weight as gain "
        f"from qv v join terms t on t.lang = v.lang and t.term = v.term where t.{f} > 0"
        for f, w, a in fields
    )
    return f"""{_ranked(True, False)}, gains as ({rows}),
      won as (select * from gains qualify row_number() over (partition by qid, doc_id, g, field order by gain desc, weight desc, term, kind, value) = 1)
      select w.qid, doc_id, w.g, field, term, kind, value, round(cast(gain * rarity as decimal(18,6)), 2)::double as points from won w join rare using (qid, g)"""


def _explained_whole() -> str:
    rows = [
        ("fallback = 'or'", "partial match", "(matched::double / n) * (matched::double / n)", "null"), ("title_bonus > 0", "title", "null", "title_bonus"),
        ("all_titled > 0", "every word in the title", "null", "all_titled"), ("phrase > 0", "phrase in the text", "null", "phrase"),
        ("boost <> 1", "document boost", "boost", "null"),
    ]
    return f"{_ranked(True, True)} " + " union all ".join(
        f"select qid, doc_id, '{what}' as what, round(({factor})::double, 6) as factor, ({points})::double as points from ranked where {when}"
        for when, what, factor, points in rows
    )


def _excerpts() -> str:
    """The rules of an excerpt, from the places of words on."""
    budget = "(strlen(content) * 450 // greatest(length(content), 1))"
    text = r"trim(regexp_replace(piece, '\s*\n\s*', ' ', 'g'))"
    closing = ", ".join(f"'{c}'" for c in lx.CLOSING)
    return rf"""{_ranked(True, False)}, {MARKS}, shown as (
        select r.qid, r.doc_id, r.place, r.lang, p.content, m.terms, m.prefixes, {budget} as budget
        from ranked r join posts p using (doc_id) join marks m on m.qid = r.qid where r.place <= 10
      ), part_rows as (
        select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as pos from (
          select doc_id, regexp_extract_all(content, '{WORD}|[^\p{{L}}\p{{M}}\p{{N}}]+') as parts from (select distinct doc_id, content from shown))
      ), ends as (
        select *, sum(strlen(part)) over w as e, sum(length(part)) over w as ce from part_rows window w as (partition by doc_id order by pos)
      ), word_rows as (
        select doc_id, pos, part, e - strlen(part) as b, e, ce - length(part) as cb, ce, {fold('part')} as norm
        from ends where regexp_matches(part, '^{WORD}')
      ), hits as (select s.qid, w.*, s.budget from shown s join word_rows w using (doc_id) where {_hit('w.part', 's.lang')}
      ), stretches as (
        select a.qid, a.doc_id, a.pos, a.b, a.cb, max(z.e) as e, max(z.ce) as ce, count(*) as n, 10 * count(distinct z.norm) + count(*) as score
        from hits a join hits z on z.qid = a.qid and z.doc_id = a.doc_id and z.pos >= a.pos and (z.pos = a.pos or z.e <= a.b + a.budget) group by 1, 2, 3, 4, 5
      ), best_one as (select * from stretches qualify row_number() over (partition by qid, doc_id order by score desc, pos) = 1
      ), led as (
        select s.*, b.b, b.cb, b.e, b.ce, b.n, greatest(budget - (b.e - b.b), 0) as slack,
          regexp_extract(left(content, b.cb::int), '(?s)^(.*(?:
|[.!?] ))', 1) as sentence
        from shown s left join best_one b using (qid, doc_id)
      ), started as (
        select l.*, case when b is null then null when sentence <> '' and b - strlen(sentence) <= slack then strlen(sentence) when b <= slack // 3 then 0
            else (select min(w.b) from word_rows w where w.doc_id = l.doc_id and w.b >= l.b - l.slack // 3) end as first_byte,
          case when b is null then null when sentence <> '' and b - strlen(sentence) <= slack then length(sentence) when b <= slack // 3 then 0
            else (select min(w.cb) from word_rows w where w.doc_id = l.doc_id and w.b >= l.b - l.slack // 3) end as first
        from led l
      ), ended as (
        select s.*, greatest(coalesce((select max(w.ce) from word_rows w where w.doc_id = s.doc_id and w.b >= s.first_byte and w.e - s.first_byte <= s.budget), 0), s.ce) as last0
        from started s
      ), last_ as (select *, last0 + case when substr(content, last0::int + 1, 1) in ({closing}) then 1 else 0 end as last from ended
      ), pieces as (
        select *, case when b is not null then substr(content, first::int + 1, (last - first)::int) when length(content) <= 450 then content
          when regexp_extract(left(content, 450), '(?s)^(.*[\p{{L}}\p{{M}}\p{{N}}])[^\p{{L}}\p{{M}}\p{{N}}]', 1) <> ''
            then regexp_extract(left(content, 450), '(?s)^(.*[\p{{L}}\p{{M}}\p{{N}}])[^\p{{L}}\p{{M}}\p{{N}}]', 1) else left(content, 450) end as piece
        from last_
      )
      select qid, doc_id, place, case when first > 0 then '… ' else '' end || {marked(text, 'lang')} ||
        case when coalesce(last, length(piece)) < length(regexp_replace(content, '\s+$', '')) then ' …' else '' end as html,
        case when b is null then 'summary' else 'content' end as source, coalesce(n, 0)::int as hits from pieces"""


def _closest() -> str:
    return f"""with {POSTS}, {TERMS},
    tokens as (select distinct lang, left(term, 2) || substr(term, 4) as token from terms where length(term) between 5 and 9),
    known as (select lang, term, count(*) as n, count(*) filter (title > 0 or place > 0) as strong from terms group by 1, 2)
    select t.lang, t.token, k.term, levenshtein(t.token, k.term) as distance
    from tokens t join known k on k.lang = t.lang and left(k.term, 1) = left(t.token, 1)
      and abs(length(k.term) - length(t.token)) <= 2
    where length(t.token) >= 4 and levenshtein(t.token, k.term) between 1 and case when length(t.token) <= 5 then 1 else 2 end
    qualify row_number() over (partition by t.lang, t.token order by levenshtein(t.token, k.term), strong desc, n desc, k.term) = 1"""


def all_sql() -> dict[str, str]:
    ranked, quoted, strict = _ranked(True, False), _ranked(True, True), _ranked(False, False)
    parsed = f"with {POSTS}, {TERMS}, {_queries(True)}, {PARSED}, {PREFIXED}"
    log = f"with {EVENTS}"
    nodes = "select doc_id as id, doc_id // 7 as hub from documents where doc_id % 3 <> 0"
    closure = f"""edges as ({nodes}), hubs as (select doc_id as hub from documents where doc_id % 2 = 0),
          up as (select hub as id, hub, 0 as depth from hubs union all select id, hub, 1 from edges where id <> hub
            union all select a.id, b.hub, 2 from edges a join edges b on a.hub = b.id where a.id <> b.hub)"""
    abroad = f"""asked as (
      select (item_id * 4 + k) * 4 + j as qid, ['de', 'en', 'es', 'fr'][j + 1] as lang, {ASKED} as query
      from benchmark, (select unnest([0, 1, 2, 3]) as k), (select unnest([0, 1, 2, 3]) as j) where j <> k)"""
    by_path = f"asked as (select page_id as qid, 'en' as lang, words as query from ({_path_words(f"(select qid as page_id, 'https://x.example/en/' || replace(query, ' ', '-') || '.html' as url from ({_all_asked(False)}) where lang = 'en')")}) where words <> '')"
    sparse = """, thin as (select query, lang, day, searches, fallback, case substr(query, 2)::int % 5 when 0 then 0 when 1 then results % 4 else results end as results from log)"""
    season = f"""{log}, proven as (
            select query, lang, sum(searches) as searches from log where day between date '{NEXT_YEAR}' - 386 and date '{NEXT_YEAR}' - 344
            group by 1, 2 having sum(searches) >= 3 and min(results) >= 5 and max(fallback) = ''
          ), top as (select *, row_number() over (partition by lang order by searches desc, query) as nth from proven)
          select lang, query, row_number() over (partition by lang order by nth) as place from top where nth <= 2 and length(query) between 3 and 40"""
    found = {
        "rank_explain": _explained(),
        "explain_whole": _explained_whole(),
        "pin_lines": f"with {PINS} select line, query, norm, doc_id, pos from pins",
        "search_page": f"{quoted}, {PINNED} select qid, doc_id, rank, pin is not null as pinned, score, false as image_alt_only from listed where rank between 11 and 20",
        "search_totals": f"""{quoted}, {PINNED}, sums as (select qid, count(*) as total, max(fallback) as fallback from listed group by 1),
          lost as (select qid, string_agg(raw, '|' order by g) as words from rare where df = 0 group by 1)
          select qid, coalesce(total, 0) as total, ceil(coalesce(total, 0) / 10)::int as pages, coalesce(s.fallback, 'none') as fallback,
            coalesce(words, '') as missing_words from q left join sums s using (qid) left join lost using (qid)""",
        "search_guides": f"{quoted}, {PINNED} select qid, doc_id, score from told where guide",
        "highlight_sets": f"{parsed}, {MARKS} select qid, array_to_string(terms, '|') as terms, array_to_string(prefixes, '|') as prefixes from marks",
        "highlights": f"{ranked}, {MARKS} select qid, doc_id, {marked('p.title', 'r.lang')} as html from ranked r join posts p using (doc_id) join marks using (qid) where place <= 10",
        "excerpts": _excerpts(),
        "other_languages": f"{_ranked(False, False, abroad)} select qid // 4 as qid, lang, count(*) as results from ranked group by 1, 2",
        "path_results": f"{_ranked(True, False, by_path)} select qid, doc_id, place from ranked where place <= 5",
        "recorded_log": f"""{log}, {RAW}, firsts as (select query, lang, day from counted group by 1, 2, 3 qualify row_number() over (partition by day order by min(ts), query, lang) <= 40),
          kept as ({_log_of("counted join firsts using (query, lang, day)")}) select * from kept k where {_NOT_PROBED}""",
        "recorded_clicks": f"{log} select query, lang, case when substr(query, 2)::int < 100 and post_id between 7 * substr(query, 2)::int and 7 * substr(query, 2)::int + 6 then 'pinned' else source end as source, count(*) as clicks from clicked group by all",
        "suggestions_season": season,
        "eligible_docs": "select doc_id from documents where doc_id % 5 <> 0 and doc_id % 3 <> 0 and doc_id % 7 <> 0",
        "affected_docs": f"""with {closure}, changed as (select doc_id as id, ['post', 'hub', 'image'][doc_id % 3 + 1] as kind from documents where doc_id < 30)
          select id as doc_id from changed where kind in ('post', 'hub')
          union select u.id from up u join changed c on c.kind = 'hub' and c.id = u.hub where u.hub in (select hub from hubs)
          union select d.doc_id from documents d join changed c on c.kind = 'image' and c.id = d.doc_id % 50""",
        "place_tags": "select doc_id, source as name from documents where doc_id % 30 <> doc_id % 20",
        "result_image": """with i as (select doc_id % 50 as doc_id, doc_id as image_id, source as slug, n_chars % 100 as c, doc_id % 9 = 0 as featured from documents)
          select r.doc_id, arg_min(image_id, (i.slug <> r.source, case when i.slug = r.source then -c else 0 end, image_id)) as image_id
          from documents r join i on i.doc_id = r.doc_id where r.doc_id < 50 and (i.slug = r.source or featured) group by 1""",
        "refreshed": f"""with {POSTS}, {TERMS}, n as (select doc_id, count(*) as n from terms group by 1),
          a as (select doc_id, case when doc_id % 13 = 0 then 'removed' when doc_id % 11 = 0 then 'failed' when doc_id % 5 = 0 then 'indexed' else 'unchanged' end as action from documents)
          select doc_id, action, case when action = 'removed' then 0 else coalesce(n, 0) end as n_terms from a left join n using (doc_id)""",
        "token_counts": f"with {POSTS} select doc_id, lang, term, count(*) as tf from (select doc_id, lang, {fold('raw')} as term from (select doc_id, lang, unnest({words('content')}) as raw from posts)) group by all",
        "fold_distinct": f"select count(distinct {fold('text')}) as folded, count(distinct lower(text)) as lowered from documents",
        "terms_wide": f"with {POSTS}, {TERMS} select doc_id, lang, term, title, content, taxonomy, place from terms",
        "term_df": f"with {POSTS}, {TERMS} select lang, term, count(*) as df, sum(content)::bigint as occurrences from terms group by 1, 2",
        "stopword_filtered": f"with t as (select lang, {fold('raw')} as term from (select lang, unnest({words('text')}) as raw from documents)) select lang, count(*) as words, count(*) filter ({indexable('term', 'lang')}) as kept from t group by 1",
        "german_forms": f"with t as (select distinct raw from (select unnest({words('text')}) as raw from documents where lang = 'de')) select raw, {fold('raw')} as norm, {german('raw')} as spelled from t where {german('raw')} <> {fold('raw')}",
        "parsed_queries": f"{parsed} select q.qid, normalized, len(tokens) as n_tokens, coalesce(n, 0) as n_groups, array_to_string(phrases, '|') as phrases from q left join n_groups using (qid)",
        "query_variants": f"{parsed} select qid, g, raw, term, weight, kind from qv where kind <> 'prefix'",
        "prefix_expand": f"{parsed} select qid, g, term, weight from qv where kind = 'prefix'",
        "rank_and": f"{strict} select qid, doc_id, score, place from ranked",
        "rank_or": f"{ranked} select qid, doc_id, score, place, fallback, matched, about from ranked",
        "rank_phrase": f"{quoted} select qid, doc_id, score, place from ranked",
        "missing_words": f"{ranked} select qid, g, raw from rare where df = 0",
        "word_rarity": f"{ranked} select qid, g, df, round(rarity, 6) as rarity from rare",
        "page_two": f"{ranked} select qid, doc_id, place from ranked where place between 11 and 20",
        "rank_pins": f"""{ranked}, pinned as (
            select b.qid, d.doc_id from q a join documents d on d.lang = a.lang and d.doc_id % 40 = a.qid % 40
              join q b on b.normalized = a.normalized and b.lang = d.lang where a.qid % 3 = 0 group by 1, 2
          )
          select qid, doc_id, coalesce(score, 0.0) as score, pin is not null as pinned,
            row_number() over (partition by qid order by pin is null, pin, place) as place
          from ranked r full join (select *, doc_id as pin from pinned) p using (qid, doc_id)""",
        "rank_guides": f"""{ranked}, able as (select *, about and fallback = 'none' and doc_id % 4 = 0 as able from ranked),
          cut as (select *, able and row_number() over (partition by qid, able order by place) <= 3 as guide from able)
          select qid, doc_id, place, guide and count(*) filter (not guide) over (partition by qid) > 0 as guide from cut""",
        "log_counts": f"{log} select * from log",
        "stream_log_counts": f"{log} select * from log",
        "click_counts": f"{log} select * from clicks",
        "log_top": _report("true"),
        "log_zero": _report("max(results) = 0", sparse),
        "log_low": _report("max(results) between 1 and 3", sparse),
        "log_fallback": _report("max(fallback) <> ''"),
        "log_by_lang": f"{log} select lang, sum(searches)::bigint as searches, count(distinct query) as queries, coalesce(sum(searches) filter (results = 0), 0)::bigint as without_results from log where {_RECENT} group by 1",
        "clicks_report": f"""{log}, posts_ as (select query, lang, post_id, sum(clicks) as n, sum(rank_total) as ranks from clicks where {_RECENT} group by 1, 2, 3),
          total as (select query, lang, sum(n)::bigint as clicks, sum(ranks)::bigint as ranks, arg_min(post_id, (-n, post_id)) as top_post, max(n)::bigint as top_clicks from posts_ group by 1, 2)
          select t.query, t.lang, clicks, coalesce(searches, 0)::bigint as searches,
            ((ranks * 20 + clicks) // (clicks * 2)) / 10 as avg_rank, top_post, top_clicks
          from total t left join (select query, lang, sum(searches) as searches from log where {_RECENT} group by 1, 2) using (query, lang)
          order by clicks desc, searches desc, query, lang limit 50""",
        "clicks_unclicked": f"{log} select query, lang, sum(searches)::bigint as searches, max(results) as results from log l where {_RECENT} and results > 0 and not exists (select 1 from clicks c where c.query = l.query and c.lang = l.lang and c.{_RECENT}) group by 1, 2 having sum(searches) >= 2 order by searches desc, query, lang limit 50",
        "clicks_by_source": f"{log} select source, sum(clicks)::bigint as clicks from clicks where {_RECENT} group by 1",
        "proven": f"{log}, {_PROVEN} select query, lang, searches::bigint as searches from proven",
        "suggestions": f"{log}, {_PROVEN} select lang, query, row_number() over (partition by lang order by nth) as place from merged where nth <= 30 qualify place <= 10",
        "related": f"{log}, {_PROVEN}, me as (select distinct query, lang from merged) select m.lang || ':' || m.query as qid, o.query, 1::bigint as shared, row_number() over (partition by m.lang, m.query order by o.nth) as place from (select lang, 'q1 ' || query as query from me) m join merged o on o.lang = m.lang and o.query in (string_split(m.query, ' ')[2], 'q1') where length(o.query) >= 3 qualify place <= 6",
        "daily_cap": f"with {EVENTS}, firsts as (select query, lang, day, row_number() over (partition by day order by min(ts), query, lang) as nth from searches group by 1, 2, 3) select day, count(*) as searches from searches join firsts using (query, lang, day) where nth <= 40 group by 1",
        "baseline_forget": f"{log}, {RAW}, kept as ({_log_of('counted')}) select * from kept k where {_NOT_PROBED}",
        "prune": f"{log} select * from log where day >= date '{AS_OF}' - 7",
        "purge": f"{log}, {RAW}, kept as ({_log_of('typed', 'n % 7 <> 0')}) select * from kept k where {_NOT_PROBED}",
        "junk_filter": f"with c as (select item_id, query, replace(query, '%C3%A9', 'é') as q from (select item_id, [left(text, 6) || 'v%C3%A9lo', left(text, 6) || 'v%25C3%25A9lo', 'bavi%C3', left(text, 60), left(text, 140), left(text, 10) || ')''(,,).)\"(', 'sleep(' || item_id || ')', '/fr-fr/' || item_id, left(text, 8) || '\"a\" ''b''', 'porto ' || item_id] as qs from benchmark), unnest(qs) as u(query)) select item_id, query, contains(query, '%25') or query = 'bavi%C3' or ({_junk().replace('query', 'q')}) as junk from c",
        "path_query": _path_words(),
        "fuzzy_closest": _closest(),
        "html_text": rf"""with p as (select page_id, {_page_text()} as page from pages),
          b as (select page_id, regexp_replace(regexp_replace(regexp_replace(page, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</?(?:{lx.BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from p)
          select page_id, array_to_string(list_filter(list_transform(string_split({_entities('t')}, chr(10)), lambda x: {_LINE}), lambda x: x <> ''), chr(10)) as text from b""",
        "html_headings": rf"""with p as (select page_id, {_page_text()} as page from pages)
          select page_id, array_to_string(list_filter(list_transform(regexp_extract_all(page, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', 1), lambda x: {_LINE.replace('(x', "(" + _entities("regexp_replace(x, '<[^>]*>', '', 'g')"), 1)}), lambda x: x <> ''), '|') as headings from p""",
        "place_strength": f"with {POSTS}, {TERMS} select doc_id, text as name, strength from field_rows where field = 'place'",
        "hub_closure": f"""with edges as ({nodes}), hubs as (select doc_id as hub from documents where doc_id % 2 = 0),
          up as (select hub as id, hub, 0 as depth from hubs union all select id, hub, 1 from edges where id <> hub
            union all select a.id, b.hub, 2 from edges a join edges b on a.hub = b.id where a.id <> b.hub)
          select id as doc_id, hub, min(depth) as depth, [100, 60, 36][min(depth) + 1] as strength from up where hub in (select hub from hubs) group by 1, 2""",
        "image_concepts": "select d.doc_id % 50 as doc_id, source as slug, arg_min(lang, (-(n_chars % 100), d.doc_id)) as label, max(n_chars % 100) / 100.0::double as confidence from documents d group by 1, 2",
        "concept_exact": f"""{parsed}, named as (
            select q.qid, l.token as slug, l.token from q join (select distinct lang, token from groups where g = 0) l on l.lang = q.lang and {phrase_in('q.normalized', 'l.token')}
          ), covers as (select g.qid, n.slug, count(distinct g.g) as covered from groups g join named n on n.qid = g.qid and n.token = g.token group by 1, 2)
          select c.qid, arg_min(slug, slug) as slug from covers c join n_groups n using (qid) join q using (qid) where covered = n.n and len(phrases) = 0 group by 1""",
        "status_summary": "with s as (select " + _STATE + " as state from " + _STATE_FROM + ") select count(*) filter (state <> 'orphan') as eligible, count(*) filter (state = 'current') as current, count(*) filter (state = 'stale') as stale, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'missing') as missing, count(*) filter (state = 'orphan') as orphan from s",
        "stale_ids": "select doc_id from (select coalesce(p.doc_id, d.doc_id) as doc_id, " + _STATE + " as state from " + _STATE_FROM + ") where state <> 'current' order by 1",
        "index_plan": "select coalesce(n.doc_id, o.doc_id) as doc_id, case when n.doc_id is null then 'removed' when n.doc_id % 11 = 0 then 'failed' when o.doc_id is not null and n.doc_id % 5 <> 0 then 'unchanged' else 'indexed' end as action from (select doc_id from documents where doc_id % 13 <> 0) n full join (select doc_id from documents where doc_id % 17 <> 0) o on n.doc_id = o.doc_id",
        "index_stats": f"with {POSTS}, {TERMS} select count(*) as rows, count(distinct term) as terms, count(*) filter (title > 0) as in_title, count(*) filter (content > 0) as in_content, count(*) filter (taxonomy > 0) as in_taxonomy, count(*) filter (place > 0) as in_place from terms",
        "docs_per_lang": "select lang, count(*) as docs from documents group by 1",
        "doc_terms": f"with {POSTS}, {TERMS} select doc_id, term, title from terms where title > 0",
    }
    index = f"with {POSTS}, {TERMS}"
    wide = TERMS.replace(
        "), raws as (",
        f"""
  union all select doc_id, lang, 'excerpt', split_part(content, chr(10), 2), 100 from posts
  union all select doc_id, lang, 'heading', headings, 100 from posts join ({found["html_headings"]}) h on page_id = doc_id
  union all select doc_id, lang, 'alt', p_type, 100 from posts join part on p_partkey = doc_id
  union all select doc_id, lang, 'custom', p_name, 100 from posts join part on p_partkey = doc_id
  union all select doc_id, lang, 'guide', n_name, 100 from posts join nation on n_nationkey = doc_id % 25 where doc_id % 4 = 0
  union all select p.doc_id, p.lang, 'hub', h.title, [100, 60, 36][depth + 1]
    from (select id, hub, min(depth) as depth from up where hub in (select hub from hubs) group by 1, 2) u
    join posts p on p.doc_id = u.id join posts h on h.doc_id = u.hub and h.lang = p.lang where depth > 0
), raws as (""", 1,
    )
    wide = wide[: wide.index("), terms as (")]
    counted = ", ".join(f"count(*) filter (field = '{f}') as {f}" for f in lx.COUNT_FIELDS)
    strongest = ", ".join(f"coalesce(max(case when field = '{f}' then strength end), 0) as {f}" for f in lx.STRENGTH_FIELDS)
    return found | {
        "stream_recorded_log": found["recorded_log"],
        "stream_click_counts": found["click_counts"],
        "terms_all_fields": f"""with {POSTS}, {closure}, {wide}
            union all select doc_id, lang, 'concept', greatest(n_chars % 100, 1), '#' || source from documents
          ) select doc_id, lang, term, {counted}, {strongest} from mentions group by all""",
        "rank_twice": found["rank_or"],
        "view_clicks": """with c as (select user_id as post_id, ['result', 'pinned', 'photos', 'other'][event_id % 4 + 1] as source,
            case when user_id % 3 <> 0 then 'v' || (event_id % 9) end as view from events where event_type = 'click')
          select source, view is null as nameless,
            count(*) filter (view is null) + count(distinct (view, post_id)) filter (view is not null) as clicks from c group by 1, 2""",
        "suggestions_blocked": f"""{log}, {_PROVEN}
          select lang, query, row_number() over (partition by lang order by nth) as place from merged
          where nth <= 30 and not (substr(query, 2)::int % 3 = 0 and substr(query, 2)::int % 2 <> 0) qualify place <= 10""",
        "stats_in_steps": f"""{index}, counts as (select lang, count(*) as docs from documents where doc_id % 13 <> 0 group by 1)
          select lang, count(*) as rows, any_value(docs) as docs, count(*) filter (title > 0) as in_title, count(*) filter (content > 0) as in_content,
            count(*) filter (taxonomy > 0) as in_taxonomy, count(*) filter (place > 0) as in_place
          from terms join counts using (lang) where doc_id % 13 <> 0 group by 1""",
        "indexed_in_steps": f"{index} select * from terms where doc_id % 13 <> 0",
        "words_in_steps": f"{index} select lang, term, count(*) as docs, count(*) filter (title > 0 or place > 0) as strong from terms where doc_id % 13 <> 0 group by 1, 2",
    }


_STATE = "case when p.doc_id is null then 'orphan' when d.doc_id is null then 'missing' when d.doc_id % 19 = 0 then 'failed' when d.doc_id % 6 <> 0 then 'current' else 'stale' end"
_STATE_FROM = "(select doc_id from documents where doc_id % 9 <> 0 and doc_id % 14 <> 0) p full join (select doc_id from documents where doc_id % 10 <> 3) d on p.doc_id = d.doc_id"
