"""Regular-expression character classes shared by every text function.

They are spelled out instead of using ``\\w``, ``\\s`` and ``\\b`` so that a
pattern means the same in every locale: letters with accents are word
characters, a no-break space is white space, and a file or group separator
(U+001C to U+001F) is white space too.
"""

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NON_SPACE = r"[^\p{IsWhite_Space}\x1c-\x1f]"
# White space that does not end a "\n" line.
LINE_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]"
# Characters that end a line of extracted markup, and white space that does not.
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
INLINE_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n\r\x0b\x0c\x1c-\x1e\x85  ]]"

LEFT_EDGE = rf"(?<!{WORD})"
RIGHT_EDGE = rf"(?!{WORD})"


def quote(literal: str) -> str:
    """Escape ``literal`` for use inside a Java regular expression."""
    return "".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch for ch in literal)


def whole(literal: str, right: bool = True) -> str:
    """Pattern of ``literal`` between word boundaries (left only without ``right``).

    The literal stands first and the boundary looks back over it: a search
    for a fixed text is much faster than a look-behind at every character.
    """
    text = quote(literal)
    word = [bool(literal) and (literal[i].isalnum() or literal[i] == "_") for i in (0, -1)]
    before = rf"(?<!{WORD}{text})" if word[0] else rf"(?<={WORD}{text})"
    after = (RIGHT_EDGE if word[1] else rf"(?={WORD})") if right else ""
    return text + before + after


def any_of(words: list[str]) -> str:
    """Alternation of ``words`` with shared beginnings written once.

    Java tries alternatives one by one, so a flat list of n words costs n
    tries at every position; here a position is given up after a letter or two.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [quote(ch) + pattern(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?+" if "" in node else body

    return pattern(tree)
