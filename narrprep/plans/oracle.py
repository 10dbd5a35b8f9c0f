r"""The registered queries once more as DuckDB SQL over the same tables.

Written on its own, from lines, lists, window functions and folds, so that an
error in an operator is not repeated here.  RE2 knows no look-around and its
``\w``, ``\s`` and ``\b`` are ASCII, so classes are spelled out.
"""

from __future__ import annotations

from ..functions.abbreviations import ENGLISH, SPANISH, longest_first
from ..functions.language import MARKERS
from ..functions.text import LIGATURES, PLAIN_CHARACTERS
from ..operators.jobs import TRANSITIONS
from ..operators.voices import LANGUAGE_NAMES, VOICES
from . import inputs as X

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
_WS = r"\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SP = f"[{_WS}]"
NSP = f"[^{_WS}]"
LB = r"[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement)}, 'g')"


def swap(expr: str, old: str, new: str) -> str:
    return f"replace({expr}, {lit(old)}, {lit(new)})"


def strip(expr: str) -> str:
    return sub(expr, f"^{SP}+|{SP}+$", "")


def words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(NSP + '+')}))"


def each(expr: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        expr = swap(expr, old, new)
    return expr


def artifacts(expr: str) -> str:
    keep = (
        f"not regexp_matches({strip('l')}, {lit(f'^(?i:(Page{SP}+)?)[0-9]+$')}) "
        f"and not regexp_matches({strip('l')}, '^[-_=]{{3,}}$')"
    )
    return f"array_to_string(list_filter(string_split({expr}, chr(10)), lambda l: {keep}), chr(10))"


def hyphens(expr: str) -> str:
    return sub(expr, rf"({W}+)-{SP}*\n{SP}*({W}+)", r"\1\2")


def expand(expr: str, table: dict[str, str]) -> str:
    for key, value in longest_first(table):
        expr = sub(expr, rf"(^|{NW})" + key.replace(".", r"\."), rf"\1{value}")
    return expr


def spoken(expr: str, language: str) -> str:
    return f"case when {language} = 'es' then {expand(expr, SPANISH)} else {expand(expr, ENGLISH)} end"


def numbers(expr: str) -> str:
    expr = sub(expr, r"\$([0-9])", r"$ \1")
    expr = sub(expr, r"€([0-9])", r"€ \1")
    return sub(expr, r"([0-9]{3})-([0-9]{3})-([0-9]{4})", r"\1, \2, \3")


def punctuation(expr: str) -> str:
    expr = sub(expr, r"\.{2,}", "...")
    expr = sub(expr, r"!{2,}", "!")
    expr = sub(expr, r"\?{2,}", "?")
    expr = sub(expr, r"([.!?])([A-Za-z])", r"\1 \2")
    expr = sub(expr, rf"{SP}*\({SP}*", " (")
    expr = sub(expr, rf"{SP}*\){SP}*", ") ")
    return swap(expr, ";", ".")


def whitespace(expr: str) -> str:
    expr = sub(expr, r"\n{3,}", "\n\n")
    expr = f"replace({expr}, chr(10)||chr(10), chr(1))"
    expr = f"replace({expr}, chr(10), ' ')"
    expr = f"replace({expr}, chr(1), chr(10)||chr(10))"
    expr = sub(expr, r"[ \t]+", " ")
    expr = sub(expr, r" *\n\n *", "\n\n")
    return strip(expr)


def markers(lang: str, expr: str) -> str:
    known = ", ".join(lit(w) for w in MARKERS[lang])
    return (
        f"len(list_filter(string_split_regex(lower({expr}), {lit(NW + '+')}), lambda w: w in ({known})))"
    )


def detected(source: str) -> str:
    """Subquery: doc_id, text, other columns, counts and the detected language."""
    return f"""(
      select *, case when n_words >= 5 and es_hits > en_hits and es_hits / n_words > 0.05 then 'es'
                     when n_words >= 5 and en_hits > es_hits and en_hits / n_words > 0.05 then 'en'
                     else 'unknown' end as detected
      from (select *, {words('text')} as n_words, {markers('es', 'text')} as es_hits,
                   {markers('en', 'text')} as en_hits from {source}))"""


DAMAGED = f"(select doc_id, lang, {lit(X.DAMAGE_HEAD)} || text || {lit(X.DAMAGE_TAIL)} as text from documents)"

CLEANED = f"""
with raw as (select * from {detected(DAMAGED)}),
a as (select doc_id, detected, {each(each('text', LIGATURES), PLAIN_CHARACTERS)} as t from raw),
b as (select doc_id, detected, {artifacts(hyphens('t'))} as t from a),
c as (select doc_id, detected, {spoken('t', 'detected')} as t from b),
d as (select doc_id, detected, {whitespace(punctuation(numbers('t')))} as clean from c)
"""

BOOKS = """(select doc_id, lang, source,
  'Prologue' || chr(10) || chr(10) || text || chr(10) || chr(10) || '  Chapter ' || doc_id || ': Of ' || source
  || chr(10) || chr(10) || text || chr(10) || chr(10) || 'CAPÍTULO IX. Cierre' || chr(10) || 'short' || chr(10)
  || 'Introductions are no heading' || chr(10) || 'Epilogue - End' || chr(10) || chr(10) || text || chr(10)
  || 'Part II' || chr(10) as text from documents)"""

_PLAIN = (
    "prologue|epilogue|introduction|conclusion|preface|foreword|afterword|prólogo|prologo|epílogo|epilogo|"
    "introducción|introduccion|conclusión|prefacio"
)
_NUM = rf"^(?i)(chapter|part|cap[íÍi]tulo|parte){SP}+([0-9]+|[ivxlc]+)((?:{NW}.*)?)$"
_SPEC = rf"^(?i)({_PLAIN})((?:{NW}.*)?)$"
_REST = rf"^{SP}*[:\-.]?{SP}*(.*)$"


def roman(expr: str) -> str:
    """Each digit counts negative when a greater one follows."""
    value = (
        "list_transform(string_split(upper({e}), ''), lambda c: case c when 'I' then 1 when 'V' then 5 "
        "when 'X' then 10 when 'L' then 50 when 'C' then 100 when 'D' then 500 when 'M' then 1000 end)"
    ).format(e=expr)
    return (
        f"case when regexp_matches(upper({expr}), '^[IVXLCDM]+$') then nullif(greatest(list_sum(list_transform("
        f"list_zip({value}, list_append(({value})[2:], 0)), lambda z: case when z[1] < z[2] then -z[1] else z[1] end)), 0), 0) end"
    )


def heading_ctes(source: str, keys: str) -> str:
    """lines -> found(keys, heading_no, start_char, title, number, text_chars)."""
    key_cols = [k.strip() for k in keys.split(",")]
    part = ", ".join(key_cols)
    return f"""
src as (select {keys}, text, length(text) as text_chars, string_split(text, chr(10)) as ls from {source}),
lines0 as (select {keys}, text_chars, unnest(ls) as line, unnest(range(len(ls))) as ln from src),
lines as (select *, coalesce(sum(length(line) + 1) over (partition by {part} order by ln rows between unbounded preceding and 1 preceding), 0)::bigint as start_char,
   {strip('line')} as l from lines0),
hit as (select *, regexp_matches(l, {lit(_NUM)}, 's') as is_num, regexp_matches(l, {lit(_SPEC)}, 's') as is_spec from lines),
named as (select *,
   regexp_extract(l, {lit(_NUM)}, 2, 's') as numeral,
   case lower(regexp_extract(l, {lit(_NUM)}, 1, 's')) when 'chapter' then 'Chapter' when 'part' then 'Part' when 'parte' then 'Parte' else 'Capítulo' end as prefix,
   {strip(f"regexp_extract(regexp_extract(l, {lit(_NUM)}, 3, 's'), {lit(_REST)}, 1, 's')")} as num_rest,
   regexp_extract(l, {lit(_SPEC)}, 1, 's') as word,
   {strip(f"regexp_extract(regexp_extract(l, {lit(_SPEC)}, 2, 's'), {lit(_REST)}, 1, 's')")} as spec_rest
   from hit where is_num or is_spec),
found as (select {keys}, text_chars, start_char,
   row_number() over (partition by {part} order by start_char)::int as heading_no,
   case when is_num then prefix || ' ' || numeral || case when num_rest <> '' then ': ' || num_rest else '' end
        else word || case when spec_rest <> '' then ': ' || spec_rest else '' end end as title,
   case when is_num then case when regexp_matches(numeral, '^[0-9]+$') then numeral::int else ({roman('numeral')})::int end end as number
   from named)"""


def span_ctes(keys: str, found: str = "found") -> str:
    return f"""
measured as (select *, coalesce(lead(start_char) over (partition by {keys} order by start_char), text_chars) - start_char as n_here,
   count(*) over (partition by {keys}) as n_all from {found}),
kept as (select * from measured where n_all <= 1 or n_here >= 500),
spans as (select *, row_number() over (partition by {keys} order by start_char)::int as chapter_no,
   coalesce(lead(start_char) over (partition by {keys} order by start_char), text_chars)::bigint as end_char from kept)"""


DOC_SPANS = f"with {heading_ctes(BOOKS, 'doc_id')}, {span_ctes('doc_id')}"

PARAGRAPHED = "(select doc_id, source, lang, replace(text, chr(10), chr(10) || chr(10)) as text from documents)"


def para_ctes(source: str, keys: str = "doc_id") -> str:
    """paras(keys, para_idx, p, n_paras, para_pos)"""
    return f"""
para_list as (select {keys}, list_filter(list_transform(string_split_regex(text, '\\n\\n+'), lambda x: {strip('x')}), lambda x: x <> '') as ps from {source}),
paras0 as (select {keys}, len(ps) as n_paras, unnest(ps) as p, unnest(range(len(ps)))::int as para_idx from para_list),
paras as (select *, coalesce(sum(length(p) + 2) over (partition by doc_id order by para_idx rows between unbounded preceding and 1 preceding), 0)::bigint as para_pos from paras0)"""


def sent_list(expr: str) -> str:
    marked = f"regexp_replace({expr}, {lit(rf'([.!?][' + chr(34) + chr(39) + rf')\]]*){SP}+')}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def sentence_ctes(source: str, keys: str = "doc_id") -> str:
    return para_ctes(source, keys) + f""",
sent_list as (select {keys}, para_idx, n_paras, para_pos, length(p) as para_len, {sent_list('p')} as ss from paras),
sents as (select {keys}, para_idx, n_paras, para_pos, para_len, len(ss) as n_sents, unnest(ss) as sentence, unnest(range(len(ss)))::int as sent_idx from sent_list)"""


_BREAK = rf"([,;]{SP}+|{SP}+(?:and|or|but|because|while|when){SP}+)"


def piece_ctes(source: str, max_chars: int, keys: str = "doc_id") -> str:
    """pieces(keys, para_idx, sent_idx, piece_no, t, cut): folds that build the texts."""
    parts = f"list_filter(string_split(regexp_replace(sentence, {lit(_BREAK)}, chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
    return sentence_ctes(source, keys) + f""",
long_fold as (select {keys}, para_idx, sent_idx, list_reduce({parts}, lambda a, x:
    case when a.cur <> '' and length(a.cur || x) > {max_chars}
         then {{'cur': x, 'done': list_append(a.done, {strip('a.cur')})}}
         else {{'cur': a.cur || x, 'done': a.done}} end, {{'cur': '', 'done': []::varchar[]}}) as f
    from sents where length(sentence) > {max_chars}),
long_parts as (select {keys}, para_idx, sent_idx, unnest(list_append(f.done, {strip('f.cur')})) as part,
    unnest(range(len(f.done) + 1)) as part_no from long_fold),
word_fold as (select {keys}, para_idx, sent_idx, part_no, part, case when length(part) > {max_chars} then
    list_reduce(list_filter(string_split_regex(part, {lit(SP + '+')}), lambda x: x <> ''), lambda a, x:
    case when a.cur = '' then {{'cur': x, 'done': a.done}}
         when length(a.cur) + 1 + length(x) > {max_chars} then {{'cur': x, 'done': list_append(a.done, a.cur)}}
         else {{'cur': a.cur || ' ' || x, 'done': a.done}} end, {{'cur': '', 'done': []::varchar[]}}) end as f from long_parts),
cut_pieces as (select {keys}, para_idx, sent_idx, part_no,
    unnest(case when f is null then [part] else list_append(f.done, f.cur) end) as t,
    unnest(case when f is null then [0] else range(len(f.done) + 1) end) as word_no from word_fold),
pieces as (
  select {keys}, para_idx, sent_idx, part_no, word_no, t, true as cut from cut_pieces
  union all
  select {keys}, para_idx, sent_idx, 0, 0, sentence, false from sents where length(sentence) <= {max_chars})"""


def pack_ctes(source: str, max_chars: int = 400, pause: int = 100, keys: str = "doc_id") -> str:
    """packed(keys, para_idx, k, t, brk)"""
    return piece_ctes(source, max_chars, keys) + f""",
grouped as (select {keys}, para_idx, list({{'t': t, 'cut': cut}} order by sent_idx, part_no, word_no) as xs from pieces group by all),
packed_fold as (select {keys}, para_idx, list_reduce(xs, lambda a, x:
    case when x.cut then {{'cur': '', 'done': list_append(case when a.cur <> '' then list_append(a.done, a.cur) else a.done end, x.t)}}
         when a.cur = '' then {{'cur': x.t, 'done': a.done}}
         when length(a.cur) + 1 + length(x.t) > {max_chars} then {{'cur': x.t, 'done': list_append(a.done, a.cur)}}
         else {{'cur': a.cur || ' ' || x.t, 'done': a.done}} end, {{'cur': '', 'done': []::varchar[]}}) as f from grouped),
packed_list as (select {keys}, para_idx, case when f.cur <> '' then list_append(f.done, f.cur) else f.done end as ts from packed_fold),
packed as (select l.{keys}, l.para_idx, unnest(ts) as t, unnest(range(len(ts))) as k, len(ts) as n_k,
    (para_idx < n_paras - 1 and length(p) >= {pause}) as may_break from packed_list l join paras using ({keys}, para_idx))"""


def merge_ctes(source: str, min_chars: int = 50, max_chars: int = 400) -> str:
    """merged(doc_id, chunk_idx, text, para_idx, paragraph_break_after)"""
    return pack_ctes(source, max_chars) + f""",
doc_list as (select doc_id, list({{'t': t, 'p': para_idx, 'b': may_break and k = n_k - 1}} order by para_idx, k) as xs from packed group by doc_id),
doc_fold as (select doc_id, list_reduce(xs[2:], lambda a, x:
    case when length(a.buf.t) < {min_chars} and length(a.buf.t) + 1 + length(x.t) <= {max_chars}
         then {{'buf': {{'t': a.buf.t || ' ' || x.t, 'p': x.p, 'b': x.b}}, 'done': a.done}}
         else {{'buf': x, 'done': list_append(a.done, a.buf)}} end,
    {{'buf': xs[1], 'done': xs[:0]}}) as f from doc_list),
merged0 as (select doc_id, list_append(f.done, f.buf) as cs from doc_fold),
merged1 as (select doc_id, unnest(cs) as c, unnest(range(len(cs)))::int as chunk_idx from merged0),
merged as (select doc_id, chunk_idx, c.t as text, c.p as para_idx, c.b as paragraph_break_after from merged1)"""


def samples(n_words: str, speed: str = "1.0::double") -> str:
    seconds = f"({n_words}) / 150.0::double * 60.0::double / {speed}"
    return (
        f"case when ({n_words}) > 0 then floor(greatest(0.1::double, least({seconds}, 60.0::double)) * 24000)::bigint else 0 end"
    )


BOOK_CHUNKS = sentence_ctes(PARAGRAPHED, "source, lang, doc_id") + f""",
chunks as (select source, doc_id, para_idx, sent_idx, case when lang <> 'de' then doc_id end as chapter_no,
   {samples(words('sentence'))} as n_samples, (sent_idx = n_sents - 1 and para_idx < n_paras - 1) as paragraph_break_after from sents),
w1 as (select *, last_value(chapter_no ignore nulls) over (partition by source order by doc_id, para_idx, sent_idx rows between unbounded preceding and 1 preceding) as prev from chunks),
w2 as (select *, (chapter_no is not null and chapter_no is distinct from prev) as chapter_change from w1),
w3 as (select *, case when chapter_change and prev is not null then 36000 else 0 end as cp, case when paragraph_break_after then 12000 else 0 end as pp from w2),
lines as (select *, coalesce(sum(cp + n_samples + pp) over (partition by source order by doc_id, para_idx, sent_idx rows between unbounded preceding and 1 preceding), 0)::bigint as marker_sample,
   (sum(cp + n_samples + pp) over (partition by source))::bigint as total_samples,
   row_number() over (partition by source order by doc_id, para_idx, sent_idx) - 1 as chunk_no,
   count(*) over (partition by source) as total_chunks from w3),
marks as (select source, doc_id, chapter_no, marker_sample, row_number() over w as marker_no,
   coalesce(lead(marker_sample) over w, total_samples) as end_sample from lines where chapter_change
   window w as (partition by source order by doc_id, para_idx, sent_idx))"""


def millis(expr: str) -> str:
    return f"floor(({expr}) / 24000.0::double * 1000.0::double)::bigint"


_STATUS = "case event_type " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in X.STATUS_OF.items()) + " end"
LOG = f"""(select user_id as job_id, ts, event_id, {_STATUS} as status, event_type as stage, value as percent,
  json_extract_string(props, '$.k')::int as chunk, 'at ' || event_type as message from events)"""
ORDER = "over (partition by job_id order by ts, event_id)"

JOBS = """(select o_orderkey as job_id, o_custkey as user_id, o_orderdate as created_at,
  case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'processing' end as status,
  o_orderkey % 12 / 5.0::double as speed,
  case when o_orderpriority <> '5-LOW' then '[' || (o_orderkey % 7) || ', ' || substr(o_orderpriority, 1, 1) || ']' end as chapters_to_convert
  from orders)"""

RUN_ROWS = para_ctes(PARAGRAPHED) + f""",
chunks as (select p.doc_id, p.para_idx as chunk_idx, p.p as text, sha256(d.text) as input_hash, {lit(X.RUN_HASH)} as settings_hash
  from paras p join {PARAGRAPHED} d using (doc_id)),
done as (select c.doc_id, c.chunk_idx, c.input_hash, case when l.toxic = 1 then {lit(X.OLD_HASH)} else c.settings_hash end as settings_hash
  from chunks c join labels l on l.doc_id = c.doc_id and l.quality = 1)"""

_VOICED = """(select doc_id, case when lang = 'en' then case when n_chars > 1000 then 'am_adam' else 'bf_emma' end
  when lang = 'es' then 'ef_dora' when lang = 'fr' then 'ff_' || source else 'xx_none' end as voice from documents)"""
_CATALOGUE = "(values " + ", ".join(f"({lit(v)}, {lit(c)}, {lit(d)})" for v, c, d in VOICES) + ") cat(voice, code, description)"
_NAMES = "(values " + ", ".join(f"({lit(c)}, {lit(n)})" for c, n in LANGUAGE_NAMES.items()) + ") names(lang_code, lang_name)"
ROUTED = f"""(select r.doc_id, r.voice, r.lang_code, names.lang_name, r.description from (
  select v.doc_id, v.voice, coalesce(cat.code, case when left(v.voice, 1) in ('a','b','e','f','j','z') then left(v.voice, 1) else 'a' end) as lang_code,
  cat.description from {_VOICED} v left join {_CATALOGUE} on cat.voice = v.voice) r left join {_NAMES} on names.lang_code = r.lang_code)"""


def base_name(expr: str) -> str:
    return f"regexp_extract({expr}, '([^/]*)/*$', 1)"


def _marked_rules(expr: str) -> str:
    expr = sub(expr, "([0-9]+)km", r"\1 kilometers")
    expr = sub(expr, r"\$([0-9]+)", r"\1 dollars")
    for key, value in (("NATO", "NAY-toh"), ("SQL", "sequel")):
        for _ in range(2):
            expr = sub(expr, f"(^|{NW}){key}({NW}|$)", rf"\1{value}\2")
    for key, value in (("approx.", "roughly"), ("no.", "number")):
        expr = sub(expr, f"(^|{NW})" + key.replace(".", r"\."), rf"\1{value}")
    for key, value in (("the", "thee"), ("und", "oont"), ("que", "kay")):
        for _ in range(2):
            expr = sub(expr, f"(^|{NW}){key}({NW}|$)", rf"\1{value}\2")
    return expr


def _html(expr: str) -> str:
    expr = f"regexp_replace({expr}, '(?is)<script[^>]*>.*?</script>', chr(10), 'g')"
    expr = f"regexp_replace({expr}, '(?is)<style[^>]*>.*?</style>', chr(10), 'g')"
    expr = f"regexp_replace({expr}, '(?s)<!--.*?-->', chr(10), 'g')"
    expr = f"regexp_replace({expr}, '<[A-Za-z/!?][^>]*>', chr(10), 'g')"
    expr = _entities(expr)
    lines = f"list_filter(list_transform(string_split_regex({expr}, {lit(LB)}), lambda l: {strip('l')}), lambda l: l <> '')"
    return f"array_to_string({lines}, chr(10) || chr(10))"


def _entities(expr: str) -> str:
    return swap(swap(swap(swap(expr, "&copy;", "©"), "&middot;", "·"), "&quot;", '"'), "&amp;", "&")


TOC = """(select d.source, d.doc_id as entry_id, (2 - l.toxic)::int as level, 'About ' || d.lang as title,
  d.doc_id + l.quality * 3 - 2 as section_num from documents d join labels l using (doc_id))"""

OFFSETS = """(select source, doc_id, length(text)::bigint as n_chars,
  coalesce(sum(length(text) + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as char_offset
  from documents where length(text) > 0)"""

SOURCE_SECTIONS = """(select source, doc_id as section_num,
  'Chapter ' || doc_id || '. In ' || lang || chr(10) || chr(10) || text as text from documents)"""

_RULER = "=" * 60
EXPORT = f"""(with {heading_ctes(BOOKS, 'doc_id')}, {span_ctes('doc_id')},
listing as (select doc_id, string_agg(chapter_no || '. ' || title, chr(10) order by chapter_no) as lines from spans group by doc_id)
select b.doc_id, b.text, {lit(_RULER + chr(10) + 'METADATA' + chr(10) + _RULER + chr(10))} || 'title: Book ' || b.doc_id || chr(10) || 'author: ' || b.source || chr(10)
  || 'creator: ' || b.lang || chr(10) || 'page_count: 1' || chr(10) || chr(10)
  || case when lines is not null then {lit(_RULER + chr(10) + 'CHAPTERS' + chr(10) + _RULER + chr(10))} || lines || chr(10) || chr(10) else '' end
  || {lit(_RULER + chr(10) + 'TEXT' + chr(10) + _RULER + chr(10) + chr(10))} || b.text as export
from {BOOKS} b left join listing using (doc_id))"""

_PATHS = """(select '/in/' || source || '/book' || doc_id ||
  case lang when 'en' then '.pdf' when 'fr' then '.EPUB' when 'de' then '.wav' else '' end as path from documents)"""

_TOTAL_CLOCK = "printf('%02d:%02d:%02d', total_samples // 24000 // 3600, total_samples // 24000 % 3600 // 60, total_samples // 24000 % 60)"


def narration_ctes(source: str) -> str:
    """n: chunks of texts ``(doc_id, text)`` with chapter and place in time."""
    return f"""{heading_ctes(source, 'doc_id')}, {span_ctes('doc_id')},
{merge_ctes(source).lstrip()},
n0 as (select m.*, (select max(s.chapter_no) from spans s where s.doc_id = m.doc_id and s.start_char <= p.para_pos and p.para_pos < s.end_char) as chapter_no,
   {samples(words('m.text'))} as n_samples from merged m join paras p on p.doc_id = m.doc_id and p.para_idx = m.para_idx),
n1 as (select *, last_value(chapter_no ignore nulls) over (partition by doc_id order by chunk_idx rows between unbounded preceding and 1 preceding) as prev from n0),
n2 as (select *, (chapter_no is not null and chapter_no is distinct from prev) as chapter_change from n1),
n3 as (select *, case when chapter_change and prev is not null then 36000 else 0 end as cp, case when paragraph_break_after then 12000 else 0 end as pp from n2),
n as (select *, coalesce(sum(cp + n_samples + pp) over (partition by doc_id order by chunk_idx rows between unbounded preceding and 1 preceding), 0)::bigint as marker_sample,
   (sum(cp + n_samples + pp) over (partition by doc_id))::bigint as total_samples from n3)
"""


NARRATED = CLEANED.replace(DAMAGED, BOOKS).rstrip() + ", " + narration_ctes("(select doc_id, clean as text from d)")
BOOK_TEXTS = f"""(select source as doc_id, string_agg(text || chr(10) || chr(10) || 'Oh.' || chr(10) || chr(10) || section_num, chr(10) || chr(10) order by section_num) as text
  from {SOURCE_SECTIONS} group by source)"""

ORACLE = {
    "narration_summary": NARRATED
    + f"""select d.doc_id, d.detected, (select count(*) from spans s where s.doc_id = d.doc_id) as n_chapters, n_chunks, total_samples, {_TOTAL_CLOCK} as duration
from d join (select doc_id, count(*) as n_chunks, max(total_samples) as total_samples from n group by doc_id) t on t.doc_id = d.doc_id""",
    "book_narration": f"with {narration_ctes(BOOK_TEXTS)} select doc_id as source, chunk_idx, text, para_idx, chapter_no, n_samples, marker_sample + cp as start_sample, total_samples from n",
    "narration_chunks": NARRATED + "select doc_id, chunk_idx, text, para_idx, chapter_no, n_samples, marker_sample + cp as start_sample from n",
    "narration_markers": NARRATED
    + f"""select k.doc_id, k.marker_no::int as marker_no, k.chapter_no, s.title, {millis('marker_sample')} as start_ms, {millis('end_sample')} as end_ms
from (select doc_id, chapter_no, marker_sample, row_number() over w as marker_no, coalesce(lead(marker_sample) over w, total_samples) as end_sample
  from n where chapter_change window w as (partition by doc_id order by chunk_idx)) k join spans s on s.doc_id = k.doc_id and s.chapter_no = k.chapter_no""",
    "chapter_select_text": DOC_SPANS
    + f"""select l.doc_id, (select string_agg(substr(b.text, s.start_char + 1, s.end_char - s.start_char), chr(10) || chr(10) order by s.chapter_no)
  from spans s where s.doc_id = l.doc_id and s.chapter_no in (l.quality + 1, l.toxic * 2 + 3)) as text from labels l join {BOOKS} b using (doc_id)""",
    "chapter_rebase": DOC_SPANS
    + """, w as (select s.doc_id, s.chapter_no, s.end_char - s.start_char as n from spans s join labels l on l.doc_id = s.doc_id and s.chapter_no > l.quality),
x as (select *, coalesce(sum(n + 2) over (partition by doc_id order by chapter_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from w)
select doc_id, chapter_no, start_char, start_char + n as end_char from x""",
    "job_create": f"""select user_id, 'pending' as status, 'book ' || job_id || '.EPUB' as input_filename, 'epub' as input_format,
  replace(chapters_to_convert, ' ', '') as chapters_to_convert from {JOBS}""",
    "job_updates": f"""with u as (select l_orderkey as job_id, case min(l_returnflag) when 'A' then 'cancelled' when 'N' then 'processing' else 'completed' end as to_status from lineitem group by 1),
j as (select u.job_id, u.to_status, j.status, case when j.status is null then 'unknown job'
  when to_status = 'cancelled' and j.status = 'completed' then 'too late to cancel, status completed'
  when (j.status, to_status) not in (('pending', 'processing'), ('pending', 'cancelled'), ('processing', 'completed'), ('processing', 'cancelled')) then 'Not allowed: ' || j.status || '>' || to_status end as refused
  from u left join {JOBS} j on j.job_id = u.job_id)
select job_id, case when refused is null then to_status else status end as status, case when refused is null and to_status = 'completed' then 100.0::double end as percent, refused from j""",
    "update_times": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') as updated_at from events",
    "detect_language": f"select doc_id, n_words, es_hits, en_hits, detected from {detected('documents')}",
    "language_confusion": f"select lang, detected, count(*) as n_docs from {detected('documents')} group by all",
    "clean_text": CLEANED + "select doc_id, detected, clean from d",
    "preview_text": CLEANED
    + """select doc_id, detected, case when length(clean) > 1000 then substr(clean, 1, 1000) || '...' else clean end as preview,
         length(clean) as total_chars, length(clean) > 1000 as truncated from d""",
    "page_artifacts": f"select doc_id, {artifacts(swap('text', chr(10), chr(10) + '  12 ' + chr(10) + 'Page  7' + chr(10) + '=====' + chr(10) + '--' + chr(10)))} as clean from documents",
    "hyphen_rejoin": f"select doc_id, {hyphens(swap('text', ', ', '- ' + chr(10) + ' '))} as clean from documents",
    "abbrev_expand": f"with m as (select doc_id, lang, {swap('text', ', ', ', Dr. Sra. no etc. at 5 p.m. (Sept. 3, vs. S.A.) ')} as t from documents) select doc_id, {spoken('t', 'lang')} as clean from m",
    "punctuation_spacing": f"select doc_id, {whitespace(punctuation(numbers(swap('text', ', ', '....then!!what??(so )$5;€6 call 555-123-4567.ok'))))} as clean from documents",
    "rules_apply": f"select doc_id, {_marked_rules(swap('text', ', ', ', no. 5km of SQL for $30 and approx. NATO, '))} as clean from documents",
    "rules_dictionary": r"""with keys as (select distinct unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as key from benchmark),
rules as (select key, 'W' || length(key) || substr(key, 1, 2) as value from keys where length(key) > 3),
tokens as (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}_]+|[^\p{L}\p{M}\p{Nd}_]+')) as t, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}_]+|[^\p{L}\p{M}\p{Nd}_]+'), 1) as i from documents)
select d.doc_id, coalesce(c.clean, d.text) as clean from documents d left join (
  select doc_id, string_agg(coalesce(value, t), '' order by i) as clean from tokens left join rules on key = t group by doc_id) c using (doc_id)""",
    "observed_cleaning": f"""select detected, count(*) as n_docs, (select count(*) from documents) as seen_rows, (select sum(length(text)) from documents)::bigint as seen_chars,
  (select max(length(text)) from documents)::bigint as seen_longest, (select count(*) from {detected('documents')} where detected = 'en') as seen_english
from {detected('documents')} group by detected""",
    "rules_merge": """
with r as (select 'turn' || turn as dict_id, turn::int as priority,
  case role when 'user' then 'words' when 'assistant' then 'acronyms' else 'patterns' end as kind,
  string_split(text, ' ')[1] as key, string_split(text, ' ')[-1] as replacement, conv_id::int as ord from conversations),
w as (select *, row_number() over (partition by kind, key order by priority desc, ord desc) as rn,
  first_value(priority) over f as first_priority, first_value(ord) over f as first_ord from r where kind <> 'patterns'
  window f as (partition by kind, key order by priority, ord))
select kind, key, dict_id, priority, replacement, first_priority, first_ord as ord from w where rn = 1
union all select kind, key, dict_id, priority, replacement, priority, ord from r where kind = 'patterns'""",
    "html_text": f"select page_id, {_html('html')} as text from pages",
    "page_metadata": f"select page_id, {strip(_entities('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)'''))} as title, '' as author, 1::bigint as page_count from pages",
    "site_sections": f"""with s as (select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, page_id as section_num, length({_html('html')})::bigint as n_chars from pages)
select *, coalesce(sum(n_chars + 2) over (partition by host order by section_num rows between unbounded preceding and 1 preceding), 0)::bigint as char_offset from s where n_chars > 0""",
    "section_offsets": f"select * from {OFFSETS}",
    "conversation_assemble": "select conv_id, (turn // 1024)::bigint as block_no, count(*) as n_sections, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations where length(text) > 0 group by 1, 2",
    "book_assemble": "select source, (doc_id // 512)::bigint as block_no, count(*) as n_sections, string_agg(text, chr(10) || chr(10) order by doc_id) as text from documents where length(text) > 0 group by 1, 2",
    "headings": f"with {heading_ctes(BOOKS, 'doc_id')} select doc_id, heading_no, start_char, title, number from found",
    "chapter_spans": DOC_SPANS + " select doc_id, chapter_no, title, number, start_char, end_char from spans",
    "chapter_text": DOC_SPANS + f" select s.doc_id, s.chapter_no, substr(b.text, s.start_char + 1, s.end_char - s.start_char) as chapter_text from spans s join {BOOKS} b using (doc_id)",
    "book_chapters": f"""with {heading_ctes(SOURCE_SECTIONS, 'source, section_num')},
offs as (select source, section_num, coalesce(sum(length(text) + 2) over (partition by source order by section_num rows between unbounded preceding and 1 preceding), 0)::bigint as o,
   (sum(length(text) + 2) over (partition by source) - 2)::bigint as n from {SOURCE_SECTIONS}),
whole as (select f.source, f.section_num, f.title, f.number, f.start_char + o.o as start_char, o.n as text_chars from found f join offs o using (source, section_num)),
{span_ctes('source', 'whole')}
select source, section_num, chapter_no, title, number, start_char, end_char from spans""",
    "chapter_select": DOC_SPANS + " select s.doc_id, s.chapter_no, s.title, s.start_char from spans s join labels l on l.doc_id = s.doc_id and l.quality + l.toxic + 1 = s.chapter_no",
    "chapter_by_number": DOC_SPANS + " select doc_id, title, number from spans where number = doc_id",
    "chapter_titles": f"with {heading_ctes(BOOKS, 'doc_id')} select doc_id, string_agg(title, ' | ' order by heading_no) as titles from found group by doc_id",
    "paragraph_chapter": DOC_SPANS + f", {para_ctes(BOOKS)} select p.doc_id, p.para_idx, p.para_pos, min(s.chapter_no) as chapter_no from paras p left join spans s on s.doc_id = p.doc_id and p.para_pos >= s.start_char and p.para_pos < s.end_char group by 1, 2, 3",
    "toc_offsets": f"""with t as (select * from {TOC} where section_num > 0),
lv as (select *, min(level) over (partition by source) as m from t),
top as (select source, entry_id, level, title, section_num from lv where case when m = 1 then level = 1 else level <= 2 end)
select t.*, coalesce(o.char_offset, 0)::bigint as start_char from top t asof left join {OFFSETS} o on t.source = o.source and t.section_num >= o.doc_id""",
    "toc_flatten": """with recursive e as (select conv_id, turn + 1 as entry_id, case when turn > 0 then (turn + 1) // 2 end as parent_id, 100 - turn as ord, role as title from conversations),
t as (select conv_id, entry_id, 1 as level, lpad(ord::varchar, 12, '0') as path, title from e where parent_id is null
  union all select e.conv_id, e.entry_id, t.level + 1, t.path || '.' || lpad(e.ord::varchar, 12, '0'), e.title from e join t on e.conv_id = t.conv_id and e.parent_id = t.entry_id)
select * from t""",
    "toc_href_join": f"""with p as (select regexp_extract(url, 'example\\.([a-z]+)', 1) as site, page_id as section_num, regexp_extract(url, '^[^?#]*') as href from pages),
l as (select site, section_num as entry_id, case when section_num % 5 = 4 then 'gone.html' when section_num % 2 = 0 then href || '#top' else 'text/' || {base_name('href')} || '#top' end as href from p),
n as (select site, name, max(section_num) as section_num from (select site, href as name, section_num from p union all select site, {base_name('href')}, section_num from p) group by 1, 2),
x as (select l.*, string_split(href, '#')[1] as target from l)
select x.site, x.entry_id, coalesce(a.section_num, b.section_num) as section_num from x
left join n a on a.site = x.site and a.name = x.target left join n b on b.site = x.site and b.name = {base_name('x.target')}
where coalesce(a.section_num, b.section_num) is not null""",
    "toc_or_headings": f"with {heading_ctes(BOOKS, 'doc_id')} select doc_id, 'Listed' as title, (quality * 10)::bigint as start_char from labels union all select doc_id, title, start_char from found where doc_id not in (select doc_id from labels)",
    "sentences": f"with {sentence_ctes(PARAGRAPHED)} select doc_id, para_idx, sent_idx, sentence from sents",
    "split_long": f"""with {piece_ctes('documents', 120)}
select doc_id, (row_number() over (partition by doc_id order by para_idx, sent_idx, part_no, word_no) - 1)::int as piece_idx, t as piece, cut from pieces""",
    "pack_chunks": f"with {pack_ctes(PARAGRAPHED)} select doc_id, (row_number() over (partition by doc_id order by para_idx, k) - 1)::int as chunk_idx, t as text, para_idx, (may_break and k = n_k - 1) as paragraph_break_after from packed",
    "merge_short": f"with {merge_ctes(PARAGRAPHED)} select * from merged",
    "chunk_durations": f"with {merge_ctes(PARAGRAPHED)} select doc_id, chunk_idx, {words('text')} as n_words, {samples(words('text'), '1.25::double')} as n_samples from merged",
    "timeline": f"with {BOOK_CHUNKS} select source, doc_id, para_idx, sent_idx, chapter_no, n_samples, chapter_change, marker_sample + cp as start_sample, total_samples, chunk_no / total_chunks * 100.0::double as percent from lines",
    "chapter_markers": f"with {BOOK_CHUNKS} select source, marker_no::int as marker_no, chapter_no, marker_sample as start_sample, end_sample, {millis('marker_sample')} as start_ms, {millis('end_sample')} as end_ms from marks",
    "marker_metadata": f"""with {BOOK_CHUNKS} select source, ((marker_no - 1) // 16)::bigint as block_no,
  case when (marker_no - 1) // 16 = 0 then ';FFMETADATA1' || chr(10) else '' end || string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10)
  || 'START=' || {millis('marker_sample')} || chr(10) || 'END=' || {millis('end_sample')} || chr(10) || 'title=Chapter ' || chapter_no || chr(10), '' order by marker_no) as metadata
  from marks group by source, (marker_no - 1) // 16""",
    "duration_by_source": f"""with {BOOK_CHUNKS}, t as (select source, count(*) as n_chunks, sum(cp + n_samples + pp)::bigint as total_samples from lines group by source)
select *, printf('%02d:%02d:%02d', total_samples // 24000 // 3600, total_samples // 24000 % 3600 // 60, total_samples // 24000 % 60) as duration from t""",
    "proportional_markers": f"""with t as (select source, (sum(length(text) + 2) - 2)::bigint as total_chars, sum({samples(words('text'))})::bigint as total_samples from documents group by source),
o as (select o.source, doc_id as chapter_no, case when char_offset > 0 then least(floor(char_offset / total_chars::double * total_samples)::bigint, total_samples) end as own from {OFFSETS} o join t using (source))
select source, chapter_no, coalesce(own, last_value(own ignore nulls) over (partition by source order by chapter_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_sample from o""",
    "synthesize_batch": f"with {para_ctes(PARAGRAPHED)} select doc_id, count(*) as n_texts, sum({samples(words('p'))})::bigint as n_samples from paras group by doc_id",
    "score_model": f"with {para_ctes(PARAGRAPHED)} select doc_id, para_idx as chunk_idx, {samples(words('p'))} as n_samples from paras",
    "document_totals": f"""with {para_ctes(BOOKS, 'doc_id')}, {heading_ctes(BOOKS, 'doc_id')},
np as (select doc_id, count(*) as n from paras group by 1), nh as (select doc_id, count(*) as n from found group by 1)
select source, lang, count(*) as n_docs, sum(length(text))::bigint as n_chars, sum({words('text')})::bigint as n_words, sum(np.n)::bigint as n_paragraphs, sum(nh.n)::bigint as n_headings
from {BOOKS} b join np using (doc_id) join nh using (doc_id) group by 1, 2""",
    "roman_numerals": f"with r as (select o_orderkey, translate(o_orderkey::varchar, '0123456789', 'IVXLCDMIVA') as numeral from orders) select o_orderkey, numeral, ({roman('numeral')})::bigint as value, o_orderkey as number from r",
    "format_duration": """select o_orderkey, printf('%02d:%02d:%06.3f', floor(o_totalprice / 3600)::bigint, floor((o_totalprice % 3600) / 60)::bigint, o_totalprice % 60) as clock_millis,
  printf('%02d:%02d:%02d', floor(o_totalprice)::bigint // 3600, floor(o_totalprice)::bigint % 3600 // 60, floor(o_totalprice)::bigint % 60) as clock from orders""",
    "content_fingerprint": f"select doc_id, sha256(text) as input_hash, {lit(X.RUN_HASH)} as settings_hash, printf('%06d', doc_id) as label from documents",
    "filename_labels": f"""select doc_id, substr({sub(sub('''source || '/<a>: "b"? ' || text''', '[<>:"/' + chr(92)*2 + '|?*]', ''), SP + '+', '_')}, 1, 100) as label from documents""",
    "url_parts": f"""with u as (select page_id, {base_name('''regexp_extract(url, '^[^?#]*')''')} as name from pages)
select page_id, name, regexp_replace(name, '([^.])\\.[^.]+$', '\\1') as stem, lower(regexp_extract(name, '[^.](\\.[^.]+)$', 1)) as suffix from u""",
    "format_routing": f"""select path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as extension,
  case lower(regexp_extract(path, '(\\.[^./]+)$', 1)) when '.pdf' then 'pdf' when '.epub' then 'epub' end as format,
  case lower(regexp_extract(path, '(\\.[^./]+)$', 1)) when '.pdf' then 'application/pdf' when '.epub' then 'application/epub+zip' when '.wav' then 'audio/wav' else 'application/octet-stream' end as media_type from {_PATHS}""",
    "chapter_list": DOC_SPANS + """ select doc_id, chapter_no, title, case when chapter_no > 1 then (chapter_no * 10)::varchar else '?' end as start,
  chapter_no || '. ' || title || case when chapter_no > 1 then ' (section ' || (chapter_no * 10) || ')' else '' end as line from spans""",
    "text_export": f"select doc_id, export from {EXPORT}",
    "export_header": f"select doc_id, {strip('text')} as body from {BOOKS}",
    "pending_chunks": f"with {RUN_ROWS} select doc_id, chunk_idx, text from chunks c where not exists (select 1 from done d where d.doc_id = c.doc_id and d.chunk_idx = c.chunk_idx and d.input_hash = c.input_hash and d.settings_hash = c.settings_hash)",
    "resume_chunks": f"with {RUN_ROWS} select doc_id, chunk_idx, text from chunks c where not exists (select 1 from done d where (d.doc_id % 2 = 1 or d.chunk_idx % 3 > 0) and d.doc_id = c.doc_id and d.chunk_idx = c.chunk_idx and d.input_hash = c.input_hash and d.settings_hash = c.settings_hash)",
    "run_manifests": f"""with {RUN_ROWS}, m as (select c.doc_id, count(d.doc_id) as done_chunks, count(*) as total_chunks from chunks c
  left join done d on (d.doc_id % 2 = 1 or d.chunk_idx % 3 > 0) and d.doc_id = c.doc_id and d.chunk_idx = c.chunk_idx and d.input_hash = c.input_hash and d.settings_hash = c.settings_hash group by c.doc_id)
select *, done_chunks < total_chunks as unfinished, done_chunks > 0 and done_chunks < total_chunks as started from m""",
    "store_and_read": f"""with {RUN_ROWS} select doc_id, chunk_idx, case when doc_id % 50 in (3, 9) then text || ';' else text end as text from chunks
where doc_id % 50 <> 7 and (doc_id % 50 not in (3, 9) or chunk_idx < 3)""",
    "store_manifest": f"""with {RUN_ROWS} select doc_id, case when doc_id % 50 in (3, 9) then 1 else 0 end as run_no,
  count(*) filter (doc_id % 50 <> 7 and (doc_id % 50 not in (3, 9) or chunk_idx < 3)) as n_rows from chunks group by doc_id having n_rows > 0""",
    "recover_missing": f"with {RUN_ROWS} select d.doc_id, d.chunk_idx, d.settings_hash from done d join chunks c on d.doc_id = c.doc_id and d.chunk_idx = c.chunk_idx and d.settings_hash = c.settings_hash where length(c.text) > 100",
    "resume_verify": """with r as (select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id)),
x as (select doc_id, case when quality is null then 'no stored run' when quality = 0 and toxic = 1 then 'stored run has another version'
  when quality = 0 then 'input differs from the stored run' when toxic = 1 then 'settings differ from the stored run' else 'stored run can go on' end as reason from r)
select doc_id, reason, reason = 'stored run can go on' as valid from x""",
    "progress_percent": f"with {para_ctes(PARAGRAPHED)} select doc_id, count(*) filter (length(p) > 200) as completed_chunks, count(*) as total_chunks, count(*) filter (length(p) > 200) * 100.0::double / count(*) as percent from paras group by doc_id",
    "latest_state": f"select job_id, status, stage, percent, chunk, message, ts, n_updates from (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as rn, count(*) over (partition by job_id) as n_updates from {LOG}) where rn = 1",
    "job_view": f"select job_id, status, stage, case when status = 'completed' then 100.0 else coalesce(percent, 0.0) end::double as percent, coalesce(chunk, 0) as chunk, message from (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as rn from {LOG}) where rn = 1",
    "progress_changes": f"select job_id, event_id, status, stage from (select *, lag(stage) {ORDER} as b, row_number() {ORDER} as rn from {LOG}) where rn = 1 or stage <> b",
    "state_changes": f"""select job_id, event_id, status, stage, percent, chunk, message from (
  select *, lag({{'a': status, 'b': stage, 'c': percent, 'd': chunk, 'e': message}}) {ORDER} as b, row_number() {ORDER} as rn from {LOG})
where rn = 1 or b is distinct from {{'a': status, 'b': stage, 'c': percent, 'd': chunk, 'e': message}}""",
    "open_stalls": f"""select job_id, status, ts, epoch_us((select max(ts) from events)) - epoch_us(ts) as silent_us from (
  select *, row_number() over (partition by job_id order by ts desc, event_id desc) as rn from {LOG})
where rn = 1 and status is distinct from 'completed' and status is distinct from 'failed' and status is distinct from 'cancelled'
and epoch_us((select max(ts) from events)) - epoch_us(ts) > 3600000000""",
    "user_jobs": f"select user_id, job_id, created_at from {JOBS} where user_id = 7 order by created_at desc, job_id limit 10 offset 1",
    "own_job": f"select job_id, user_id, 'owner' as asked_by from {JOBS} where job_id = 7",
    "voices_of_language": f"select lang_code, lang_name, string_agg(distinct voice, ',' order by voice) as voices from {ROUTED} group by all",
    "commit_and_read": f"with {RUN_ROWS} select doc_id, chunk_idx, case when doc_id % 3 = 0 then text || '!' else text end as text from chunks",
    "spoken_seconds": f"select doc_id, round({words('text')} / 150.0::double * 60.0::double, 6) as seconds from documents",
    "job_feed": f"select job_id, event_id, status from (select *, coalesce(sum((status in ('completed', 'failed', 'cancelled'))::int) over (partition by job_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as ended from {LOG}) where ended = 0",
    "stalled_jobs": f"select job_id, event_id, ts, next_ts, gap_us from (select *, epoch_us(next_ts) - epoch_us(ts) as gap_us from (select *, lead(ts) {ORDER} as next_ts from {LOG})) where gap_us > 21600000000",
    "illegal_transitions": f"select job_id, event_id, from_status, status from (select *, lag(status) {ORDER} as from_status from {LOG}) where from_status <> status and (from_status, status) not in ("
    + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in TRANSITIONS)
    + ")",
    "job_update_log": f"""with recursive u as (select job_id, event_id, case when chunk % 4 = 0 then 'cancelled' else status end as t, row_number() {ORDER} as rn from {LOG}),
run as (
  select job_id, 0::bigint as rn, null::bigint as event_id, null::varchar as t, null::varchar as a, case when job_id % 5 > 0 then 'pending' end as b from u where rn = 1
  union all
  select u.job_id, u.rn, u.event_id, u.t, run.b, case when (run.b, u.t) in ({", ".join(f"({lit(a)}, {lit(b)})" for a, b in TRANSITIONS)}) then u.t else run.b end
  from run join u on u.job_id = run.job_id and u.rn = run.rn + 1)
select job_id, event_id, a as from_status, b as status,
  case when a is not null and t = 'completed' and a <> b then 100.0::double end as percent,
  case when a is null then 'unknown job' when a <> b then null
    when t = 'cancelled' and a not in ('pending', 'processing') then 'too late to cancel, status ' || a else 'Not allowed: ' || a || '>' || t end as refused
from run where rn > 0""",
    "job_timings": f"""with t as (select job_id, min(ts) filter (status = 'pending') as created_at, min(ts) filter (status = 'processing') as started_at,
  min(ts) filter (status in ('completed', 'failed', 'cancelled')) as completed_at from {LOG} group by job_id)
select *, floor((epoch_us(started_at) - epoch_us(created_at)) / 1000000)::bigint as wait_seconds, floor((epoch_us(completed_at) - epoch_us(started_at)) / 1000000)::bigint as run_seconds from t""",
    "jobs_page": f"select user_id, row_no, job_id, created_at from (select *, row_number() over (partition by user_id order by created_at desc, job_id)::int as row_no from {JOBS}) where row_no between 3 and 7",
    "pending_jobs": f"select job_id, user_id, speed from {JOBS} where status = 'pending' and speed between 0.5 and 2.0",
    "rejected_requests": f"select job_id, speed from {JOBS} where not speed between 0.5 and 2.0",
    "requested_chapters": f"select job_id, unnest(from_json(chapters_to_convert, '[\"INTEGER\"]')) as chapter_no from {JOBS} where chapters_to_convert is not null",
    "job_owners": f"select user_id, c_name as owner, count(*) as n_jobs, count(*) filter (status = 'completed') as n_completed from {JOBS} j join customer on c_custkey = user_id group by 1, 2",
    "progress_json": f"select job_id::varchar as key, to_json({{'event_id': event_id, 'status': status, 'stage': stage, 'percent': percent, 'chunk': chunk, 'message': message}})::varchar as value from {LOG}",
    "progress_lines": f"select event_id, case when chunk % 2 = 0 then printf('[%s] %.1f%% - Chapter %d: %s', stage, round(percent * 2, 0) / 2, chunk, message) else printf('[%s] %.1f%% - %s', stage, round(percent * 2, 0) / 2, message) end as line from {LOG}",
    "voice_routing": f"select doc_id, voice, lang_code, lang_name, description from {ROUTED}",
    "voices_by_language": f"select lang_code, lang_name, voice, count(*) as n_docs from {ROUTED} group by all",
    "stream_prepare": f"with {merge_ctes(PARAGRAPHED)} select * from merged",
    "stream_changes": f"select job_id, event_id, status, stage from (select *, lag(stage) {ORDER} as b, row_number() {ORDER} as rn from {LOG}) where rn = 1 or stage <> b",
    "stream_done": f"""select job_id, event_id, status,
  case when status = 'completed' then round((epoch_us(ts) - epoch_us(first_ts)) / 1000000.0::double, 3) end as duration_seconds,
  case when status = 'failed' then message end as error_message
from (select *, row_number() {ORDER} as rn from (select *, min(ts) over (partition by job_id) as first_ts from {LOG}) where status in ('completed', 'failed', 'cancelled')) where rn = 1""",
    "stream_silent": f"""with n as (select *, lead(ts) {ORDER} as following from {LOG})
select job_id, event_id, status, ts, following as next_ts, epoch_us(following) - epoch_us(ts) as gap_us from n
where epoch_us(following) - epoch_us(ts) > 21600000000
union all
select job_id, event_id, status, ts, null, null from n
where following is null and status not in ('completed', 'failed', 'cancelled') and epoch_us((select max(ts) from events)) - epoch_us(ts) > 21600000000""",
    "stream_latest": f"select job_id, status, stage, percent, chunk, message, ts, n_updates from (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as rn, count(*) over (partition by job_id) as n_updates from {LOG}) where rn = 1",
    "stream_dedup": f"select job_id, event_id, stage from {LOG}",
    "stream_stalls": f"""with g as (select *, case when ts - lag(ts) {ORDER} < interval 2 hours then 0 else 1 end as opens from {LOG}),
s as (select *, sum(opens) {ORDER} as n from g),
w as (select job_id, min(ts) as session_start, max(ts) + interval 2 hours as session_end, count(*) as n_updates from s group by job_id, n)
select * from w where session_end < (select max(ts) from events)""",
}
