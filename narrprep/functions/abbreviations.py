"""Built-in abbreviation tables and literal-rule folds."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .charclass import quote, whole

# English abbreviations and their spoken form.
ENGLISH = {
    "Dr.": "Doctor",
    "Mr.": "Mister",
    "Mrs.": "Missus",
    "Ms.": "Miss",
    "Prof.": "Professor",
    "vs.": "versus",
    "etc.": "etcetera",
    "St.": "Saint",
    "Jr.": "Junior",
    "Sr.": "Senior",
    "Ltd.": "Limited",
    "Inc.": "Incorporated",
    "Corp.": "Corporation",
    "Ave.": "Avenue",
    "Blvd.": "Boulevard",
    "Apt.": "Apartment",
    "Vol.": "Volume",
    "Ch.": "Chapter",
    "Fig.": "Figure",
    "approx.": "approximately",
    "govt.": "government",
    "dept.": "department",
    "Mt.": "Mount",
    "i.e.": "that is",
    "e.g.": "for example",
    "a.m.": "A M",
    "p.m.": "P M",
    "A.M.": "A M",
    "P.M.": "P M",
    "Jan.": "January",
    "Feb.": "February",
    "Mar.": "March",
    "Apr.": "April",
    "Jun.": "June",
    "Jul.": "July",
    "Aug.": "August",
    "Sep.": "September",
    "Sept.": "September",
    "Oct.": "October",
    "Nov.": "November",
    "Dec.": "December",
}

# Spanish abbreviations and their spoken form.
SPANISH = {
    "Dr.": "Doctor",
    "Dra.": "Doctora",
    "Sr.": "Señor",
    "Sra.": "Señora",
    "Srta.": "Señorita",
    "Prof.": "Profesor",
    "Profa.": "Profesora",
    "Lic.": "Licenciado",
    "Lda.": "Licenciada",
    "Ing.": "Ingeniero",
    "Arq.": "Arquitecto",
    "Abog.": "Abogado",
    "Gral.": "General",
    "Cnel.": "Coronel",
    "Tte.": "Teniente",
    "Cpt.": "Capitán",
    "Ud.": "Usted",
    "Uds.": "Ustedes",
    "S.A.": "Sociedad Anónima",
    "Cía.": "Compañía",
    "Pág.": "Página",
    "págs.": "páginas",
    "Cap.": "Capítulo",
    "Vol.": "Volumen",
    "Núm.": "Número",
    "núm.": "número",
    "etc.": "etcétera",
    "Ej.": "Ejemplo",
    "ej.": "ejemplo",
    "a.m.": "de la mañana",
    "p.m.": "de la tarde",
    "A.M.": "de la mañana",
    "P.M.": "de la tarde",
}


def literal_replacement(text: str) -> str:
    """Escape ``text`` so that a replacement puts it in unchanged."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def longest_first(table: dict[str, str]) -> list[tuple[str, str]]:
    """Longest key first; keys of one length keep their order."""
    return sorted(table.items(), key=lambda item: -len(item[0]))


def rule_array(rules: list[tuple[str, str]], whole_word: bool) -> Column:
    """Constant array of (key, pattern, replacement) for :func:`apply_rules`.

    Written as one JSON constant, which the optimizer folds, so that a long
    table does not become thousands of expression nodes.
    """
    rows = [
        {
            "key": key,
            "pattern": whole(key, right=whole_word),
            "replacement": replacement,
        }
        for key, replacement in rules
    ]
    schema = "array<struct<key:string,pattern:string,replacement:string>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def apply_rules(text: Column, rules: Column) -> Column:
    """Apply literal rules one after another, as a fold over the rule array.

    A rule can only fire where its key occurs, so the cheap byte search
    ``contains`` guards the regular expression.  The text is named once, so
    the plan does not grow with the number of rules.
    """
    return F.aggregate(
        rules,
        text,
        lambda acc, rule: F.when(
            F.contains(acc, rule["key"]),
            F.regexp_replace(acc, rule["pattern"], rule["replacement"]),
        ).otherwise(acc),
    )


def _set_off(rules: list[tuple[str, str]]) -> list[str]:
    """Keys that may be there only after another rule has fired, or that end another key."""

    def overlap(left: str, right: str) -> bool:
        return any(left.endswith(right[:i]) for i in range(1, min(len(left), len(right)) + 1))

    def may(key: str) -> bool:
        made = any(overlap(new, key) or overlap(key, new) or new in key or key in new for _, new in rules)
        return made or any(other != key and other.endswith(key) for other, _ in rules)

    return [key for key, _ in rules if may(key)]


def _expanded(text: Column, table: dict[str, str]) -> Column:
    """``apply_rules`` of the keys that are in the text, or may be by then; every key ends in a dot, which is looked for."""
    rules = longest_first(table)
    keys = "|".join(quote(key) for key, _ in rules)
    found = F.regexp_extract_all(text, F.lit(rf"\.(?<=({keys}))"), F.lit(1))
    late = _set_off(rules)
    every = rule_array(rules, whole_word=False)

    def fold(keys_there: Column) -> Column:
        there = F.filter(every, lambda r: r["key"].isin(late) | F.array_contains(keys_there, r["key"]))
        return F.when(F.size(keys_there) > 0, apply_rules(text, there)).otherwise(text)

    return let(F.array_distinct(found), fold)


def expand_abbreviations(text: Column, language: Column) -> Column:
    """Expand built-in abbreviations: Spanish for ``es``, else English.

    Only the left side is bounded, so an abbreviation at a sentence end
    (``in Mar.``) is expanded too.
    """
    return let(text, lambda t: F.when(language == "es", _expanded(t, SPANISH)).otherwise(_expanded(t, ENGLISH)))
