"""Index of whole-word rules: which of very many can change a text at all.

A fold over all rules looks for every key in every text.  Here the words of a text are looked up once, and the fold goes
over the rules found only.  A rule can change a text if its key occurs there when its turn comes: either the words of
the key are in the text, or they come with the replacement of a rule that was found.  So the index follows replacements
to the rules whose keys share a word with them.  Rules that are found without effect change nothing, so the result is
that of the fold over all rules, in their order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.abbreviations import apply_rules, literal_replacement, rule_array

_WORD = re.compile(r"\w+")


def _plain(c: str) -> bool:
    """A character that belongs to a word under every definition of one: letter, decimal digit or underscore."""
    return c.isalpha() or c.isdecimal() or c == "_"


def words_of(text: str) -> set[str]:
    """Runs of letters, decimal digits and underscores; other numerals part words."""
    found = set(_WORD.findall(text))
    for word in [w for w in found if not w.isascii() and not all(map(_plain, w))]:
        found.discard(word)
        found.update("".join(c if _plain(c) else " " for c in word).split())
    return found


class RuleIndex:
    """Rules by the words of their keys; rules are numbered by their order of application."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.size = len(rules)
        self.keys = [frozenset(words_of(key)) for key, _ in rules]
        self.made = [words_of(value) for _, value in rules]
        # A rule whose key ends in a mark, or that leaves nothing, may make words grow together.
        self.loose = {k for k, (key, value) in enumerate(rules) if not (_plain(key[0]) and _plain(key[-1]) and value)}
        self.wordless = [key for (key, _), words in zip(rules, self.keys, strict=True) if not words]
        self.by_word: dict[str, list[int]] = {}
        self.by_first: dict[str, list[int]] = {}
        for k, words in enumerate(self.keys):
            for word in words:
                self.by_word.setdefault(word, []).append(k)
            if words:
                self.by_first.setdefault(min(words), []).append(k)
        self.follow: dict[int, list[int]] = {}

    def _followers(self, rule: int) -> list[int]:
        """Later rules whose keys share a word with the replacement of a rule."""
        if rule not in self.follow:
            self.follow[rule] = sorted({k for w in self.made[rule] for k in self.by_word.get(w, ()) if k > rule})
        return self.follow[rule]

    def find(self, text: str | None) -> list[int]:
        """Rules that can change a text, in order; all of them where one may make words grow together."""
        if not text:
            return []
        words = words_of(text)
        found = {k for w in words for k in self.by_first.get(w, ()) if self.keys[k] <= words}
        open_rules = list(found)
        while open_rules:
            more = [k for k in self._followers(open_rules.pop()) if k not in found]
            found.update(more)
            open_rules.extend(more)
        if not self.loose.isdisjoint(found) or any(found or key in text for key in self.wordless):
            return list(range(self.size))
        return sorted(found)


def apply_indexed(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Whole-word rules (key, replacement) applied in their order; only those that a text has words for are tried."""
    index = RuleIndex(rules)

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(index.find)

    every = rule_array([(key, literal_replacement(value)) for key, value in rules], True)
    return apply_rules(text, F.transform(found(text), lambda k: F.get(every, k)))
