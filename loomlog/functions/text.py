"""Token rules of the text search: case, accents, and what separates two tokens."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is not a letter, a digit or private-use separates tokens; the short form is for
#: lower-case ASCII texts.
_SEPARATORS, _ASCII_SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+", "[^a-z0-9]+"


# Letters with a plain form that lower-casing does not reach.
_PLAIN_FORMS = {"ς": "σ", "µ": "μ", "ſ": "s"}


@cache
def fold_table() -> tuple[str, str]:
    """``translate`` arguments that strip accents from lower-case Latin letters.

    The rule: a letter that decomposes into a plain ASCII letter and exactly one combining
    mark becomes that letter, and the marks found this way vanish where they stand alone.
    Other marks separate tokens.
    """
    plain, marks = dict(_PLAIN_FORMS), set()
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = _PLAIN_FORMS.get(parts[0], parts[0])
        if char.lower() == char and len(parts) == 2 and base.isascii():
            plain[char] = base
            marks.add(parts[1])
    return "".join(plain) + "".join(sorted(marks)), "".join(plain.values())


def folded(body: Column) -> Column:
    """Lower case without accents; pure ASCII text skips the character table."""
    lower = F.lower(body)
    source, target = fold_table()
    ascii_only = F.octet_length(body) == F.length(body)
    return F.when(ascii_only, lower).otherwise(F.translate(lower, source, target))


def token_array(folded_text: Column) -> Column:
    """Tokens of a folded text, in order."""
    return F.filter(F.split(folded_text, _SEPARATORS), lambda token: token != "")


def tokens(body: Column) -> Column:
    """Tokens of a body, in order."""
    ascii_only = F.octet_length(body) == F.length(body)
    plain = F.array_remove(F.split(F.lower(body), _ASCII_SEPARATORS), "")
    return F.when(ascii_only, plain).otherwise(token_array(folded(body)))


def query_tokens(text: str) -> list[str]:
    """The same rule applied to a short query string on the driver."""
    source, target = fold_table()
    table = {ord(s): (target[i] if i < len(target) else None) for i, s in enumerate(source)}
    lower = text.lower().translate(table)
    kept = (c if _is_token_char(c) else " " for c in lower)
    return "".join(kept).split()


def _is_token_char(char: str) -> bool:
    category = unicodedata.category(char)
    return category[0] in "LN" or category == "Co"


#: Trimming that also removes tabs, line ends and Unicode spaces.
_WIDE_SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def wide_trim(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^{_WIDE_SPACE}|{_WIDE_SPACE}\z", "")
