"""Secrets in texts, found over a trigram index, with DataFrame functions only.

A rule is a regular expression.  From it the trigrams that every match must hold are derived as a Boolean query
(alternatives of trigrams that occur together).  The index lists, per trigram that any rule asks for, the documents
that hold it; the postings of a query are intersected, and only the candidates of a rule are searched with its
expression.  A rule without mandatory trigrams searches every document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running_offsets
from .common import ROW, keyed

_MOST = 32


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read the same in the engines used.  A match counts if group ``group`` (0: all of it) is
    ``least`` characters long; matches that do not count still use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")

RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("prefixed", r"(ghp_|gho_|glpat-|xoxb-|xoxp-|sk_live_)[A-Za-z0-9_-]+", 0, 20),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams of which one must lie whole in every matching text; empty: no condition."""
    from re import _parser

    def both(a, b):
        joined = {x | y for x, y in product(a, b)}
        return joined if len(joined) <= _MOST else (a if len(a) <= len(b) else b)

    def grams(words):
        found = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
        return {frozenset()} if frozenset() in found else found

    def walk(tokens):
        """Conditions so far, and the exact strings that the last part can read, if they are few."""
        need, words = {frozenset()}, {""}
        for op, value in tokens:
            op = str(op)
            inner, exact = {frozenset()}, None
            if op == "LITERAL":
                exact = {chr(value).lower()}
            elif op == "IN" and all(str(o) == "LITERAL" for o, _ in value):
                exact = {chr(v).lower() for _, v in value}
            elif op == "SUBPATTERN":
                inner, exact = walk(value[-1])
            elif op == "BRANCH":
                parts = [walk(part) for part in value[1]]
                if all(e is not None and n == {frozenset()} for n, e in parts):
                    exact = set().union(*(e for _, e in parts))
                else:
                    inner = set().union(*(both(n, grams(e)) if e is not None else n for n, e in parts))
                    inner = {frozenset()} if frozenset() in inner else inner
            elif op == "MAX_REPEAT":
                least, most, part = value
                n, e = walk(part)
                if e is not None and n == {frozenset()} and most == 1:
                    exact = e | ({""} if least == 0 else set())
                elif least >= 1:
                    inner = both(n, grams(e)) if e is not None else n
            if exact is not None and len(exact) * len(words) <= _MOST and inner == {frozenset()}:
                words = {a + b for a, b in product(words, exact)}
            else:
                need = both(both(need, grams(words)), inner)
                words = exact if exact is not None and inner == {frozenset()} else {""}
        return need, words

    need, words = walk(_parser.parse(pattern))
    found = both(need, grams(words))
    return [] if frozenset() in found else sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings: ``trigram`` and the keys of the documents that hold it, for the trigrams named."""
    low = keyed(docs).select(*ROW, F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select(*ROW, F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Row keys with the numbers of the rules whose trigram query they meet (``may``)."""
    queries = [(n, a, t) for n, rule in enumerate(rules) for a, terms in enumerate(trigram_query(rule.pattern)) for t in sorted(terms)]
    session = docs.sparkSession
    terms = session.createDataFrame(queries or [(0, 0, "")], "rule int, alternative int, trigram string")
    terms = terms.join(terms.groupBy("rule", "alternative").agg(F.count(F.lit(1)).alias("asked")), ["rule", "alternative"])
    postings = trigram_index(docs, sorted({t for _, _, t in queries}) or [""])
    # The terms are a few dozen rows of the rule table.
    met = postings.join(F.broadcast(terms), "trigram").groupBy(*ROW, "rule", "alternative").agg(
        F.count(F.lit(1)).alias("met"), F.first("asked").alias("asked")
    )
    return met.filter("met = asked").groupBy(*ROW).agg(F.collect_set("rule").alias("may"))


def _spans(text: Column, rule: Rule) -> Column:
    """Matches that count: start and end in code points."""
    pattern = _at_least(rule)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    # Every match ends where the gaps and matches before it and itself end.
    lengths = F.transform(F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda x: F.length(x).cast("bigint")).alias("hit")),
                          lambda x: F.coalesce(x["gap"], F.lit(0)) + F.coalesce(x["hit"], F.lit(0)))
    starts = running_offsets(lengths, 0)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    zipped = F.zip_with(
        F.arrays_zip(found.alias("hit"), parts.alias("part")),
        F.zip_with(starts, gaps, lambda a, b: a + b),
        lambda x, start: F.struct(
            start.alias("start"), (start + F.length(x["hit"])).alias("end"), F.length(x["part"]).alias("size"), F.length(x["hit"]).alias("n")
        ),
    )
    counted = F.filter(zipped, lambda x: x["n"].isNotNull() & (x["size"] >= rule.least))
    return F.transform(counted, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _tagged(spans: Column, number: int, rule: Rule) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(number).alias("rule"), x["end"].alias("end"),
            F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base"),
        ),
    )


def secret_scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id`` and ``spans``: an array of structs (start, rule, end, kind, base) in order of start, then of rules.

    One row per row of ``docs``.  Matches of a rule are leftmost and do not overlap; ends are exclusive, both count
    code points.  A null text is an empty one and holds nothing; repeated rows and null ids are scanned like
    others; an empty table gives an empty one.  Other columns are ignored.
    """
    may = candidates(docs, rules)
    rows = keyed(docs).join(may, ROW, "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    kinds = []
    for n, rule in enumerate(rules):
        asked = F.array_contains("may", n) if trigram_query(rule.pattern) else F.lit(True)
        # Whether there is any match long enough costs one pass and spares the exact places.
        hit = F.col("text").rlike(_at_least(rule))
        spans = F.when(F.coalesce(asked, F.lit(False)) & hit, _spans(F.col("text"), rule)).otherwise(none)
        kinds.append(_tagged(spans, n, rule))
    return rows.select("doc_id", F.array_sort(F.concat(*kinds)).alias("spans"))


def _at_least(rule: Rule) -> str:
    """Pattern of the matches that count, where the rule is one class repeated; others are filtered afterwards."""
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[n(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def digest_sql(rules: Sequence[Rule] = RULES) -> str:
    """The same in SQL, every rule over every text."""
    parts, counts = [], []
    for n, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
        select row, {n} as rule, '{rule.kind}' as kind, {rule.base} as base, hits[k] as hit, parts[k] as part,
            list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) as start
        from (
            select row, gaps, hits, parts, unnest(range(1, len(hits) + 1)) as k from (
                select row, regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as hits,
                    regexp_extract_all(text, '{pattern}', {rule.group}) as parts from texts
            )
        ) where length(parts[k]) >= {rule.least}""")
        if rule.kind in ("assign", "access", "hex"):
            counts.append(f"count(kind) filter (kind = '{rule.kind}')::bigint as n_{rule.kind}")
    word = "kind || ':' || start::bigint || ':' || (start + length(hit))::bigint"
    return f"""
    with texts as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
    spans as ({" union all ".join(parts)})
    select any_value(texts.doc_id) as doc_id, {", ".join(counts)},
        sha256(coalesce(string_agg({word}, ',' order by start, rule) filter (base), '')) as base_sha256,
        coalesce(string_agg({word}, ',' order by start, rule), '') as spans
    from texts left join spans using (row) group by texts.row
    """
