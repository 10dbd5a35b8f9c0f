"""The queries as SQL, where SQL can express them."""

from __future__ import annotations

from .line_dedup import line_dedup_sql
from .merkle import manifest_sql
from .secret_scan import digest_sql

NGRAM_JACCARD = r"""
with recursive words as (
    select row_number() over () as row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select distinct row, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words where len(w) > 0
), sizes as (
    select row, count(*) as n from shingles group by row
), common as (
    select a.row as a, b.row as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.row < b.row group by 1, 2
), links as (
    select a, b from common join sizes x on x.row = a join sizes y on y.row = b where 100 * common.n >= 80 * (x.n + y.n - common.n)
), ways as (
    select a, b from links union all select b, a from links
), reach as (
    select row as a, row as b from sizes union select reach.a, ways.b from reach join ways on reach.b = ways.a
), least as (
    select a, min(doc_id) as component_id from reach join words on words.row = reach.b group by a
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id
from words left join sizes using (row) left join least on least.a = words.row
"""

CHAT = r"""
with messages as (
    select distinct conv_id, turn, role, text from conversations
), told as (
    select conv_id, turn, coalesce(role, 'unknown') as role, text,
        regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as own
    from messages
)
select conv_id, (turn // 256)::bigint as thread_block, (turn // 256)::bigint as turn_block,
    count(*) as n_messages, 0::bigint as n_replies,
    string_agg(role || ': ' || own, chr(10) order by turn, role, text) as chat
from told group by 1, 2, 3
"""

ORACLE = {
    "op2_line_dedup": line_dedup_sql(),
    "op3_ngram_jaccard_join": NGRAM_JACCARD,
    "op4_secret_scan": digest_sql(),
    "op7_chat_formatting": CHAT,
    "op11_merkle_manifest": manifest_sql(),
}
