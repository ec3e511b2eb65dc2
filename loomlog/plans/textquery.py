"""Search expressions.

A search is a short text: words, ``"phrases"``, ``prefix*``, ``a + b``, ``^first``,
``NEAR(a b, n)``, ``body : word`` and the upper-case words AND, OR and NOT.  NOT binds
tighter than AND, AND tighter than OR; words side by side bind tightest of all.

The text is read once on the driver into a small tree.  From it come two Column conditions:
``search_condition`` decides a row exactly, and ``candidate_flags`` names the tokens that a
token table can look up first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.functions.text import folded, query_tokens, token_array

MAX_QUERY_CHARS = 1000
DEFAULT_NEAR = 10


class SearchSyntaxError(ValueError):
    """The search expression cannot be read."""


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; a flag per token says whether it is only a prefix."""

    parts: tuple[tuple[str, bool], ...]
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases that occur within ``distance`` tokens of each other."""

    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


@dataclass(frozen=True)
class Nothing:
    """Matches no row, e.g. a phrase without any token."""


_LEXEME = re.compile(
    r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<sign>[(){}:,+*^-]))'
)


def _lexemes(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = _LEXEME.match(text, at)
        if not match:
            raise SearchSyntaxError(f"syntax error near {text[at:at + 10]!r}")
        kind = match.lastgroup
        value = match.group(kind)
        if kind == "quoted":
            found.append(("text", value[1:-1].replace('""', '"')))
        elif kind == "word" and value in ("AND", "OR", "NOT"):
            found.append((value, value))
        elif kind == "word":
            found.append(("text", value))
        else:
            found.append((value, value))
        at = match.end()
    found.append(("end", ""))
    return found


class _Reader:
    def __init__(self, text: str):
        self.items = _lexemes(text)
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.items[min(self.at + ahead, len(self.items) - 1)][0]

    def take(self, kind: str) -> str:
        found, value = self.items[self.at]
        if found != kind:
            raise SearchSyntaxError(f"syntax error near {value!r}: expected {kind}")
        self.at += 1
        return value

    def query(self):
        tree = self.binary(0)
        self.take("end")
        return tree

    def binary(self, rank: int):
        levels = (("OR", Either), ("AND", Both), ("NOT", Without))
        if rank == len(levels):
            return self.operand()
        word, node = levels[rank]
        tree = self.binary(rank + 1)
        while self.peek() == word:
            self.take(word)
            tree = node(tree, self.binary(rank + 1))
        return tree

    def operand(self):
        if self.peek() == "(":
            return self.parenthesis()
        start = self.at
        visible = self.column_prefix()
        if visible is not None and self.peek() == "(":
            tree = self.parenthesis()
            return tree if visible else Nothing()
        self.at = start
        return self.side_by_side()

    def parenthesis(self):
        self.take("(")
        tree = self.binary(0)
        self.take(")")
        return tree

    def column_prefix(self) -> bool | None:
        """Read ``body :``; the answer says whether the body is among the columns."""
        start = self.at
        negated = self.peek() == "-"
        if negated:
            self.take("-")
        names = []
        if self.peek() == "{":
            self.take("{")
            while self.peek() == "text":
                names.append(self.take("text"))
            self.take("}")
        elif self.peek() == "text" and (negated or self.peek(1) == ":"):
            names.append(self.take("text"))
        if not names:
            if negated:
                raise SearchSyntaxError("syntax error near '-'")
            self.at = start
            return None
        if self.peek() != ":":
            raise SearchSyntaxError(f"no such column: {names[0]}")
        self.take(":")
        unknown = [name for name in names if name.lower() != "body"]
        if unknown:
            raise SearchSyntaxError(f"no such column: {unknown[0]}")
        return not negated

    def side_by_side(self):
        tree = self.near_or_phrase()
        while self.peek() in ("text", "^", "{", "-"):
            following = self.near_or_phrase()
            if isinstance(tree, Nothing):
                tree = following
            elif not isinstance(following, Nothing):
                tree = Both(tree, following)
        return tree

    def near_or_phrase(self):
        visible = self.column_prefix()
        if self.peek() == "text" and self.peek(1) == "(":
            tree = self.near()
        elif self.peek() == "^":
            self.take("^")
            tree = self.phrase(first=True)
        else:
            tree = self.phrase()
        return Nothing() if visible is False else tree

    def near(self):
        name = self.take("text")
        if name != "NEAR":
            raise SearchSyntaxError(f"syntax error near {name!r}")
        self.take("(")
        phrases = [self.phrase()]
        distance = DEFAULT_NEAR
        while self.peek() == "text":
            phrases.append(self.phrase())
        if self.peek() == ",":
            self.take(",")
            number = self.take("text")
            if not number.isdecimal():
                raise SearchSyntaxError(f"expected integer, got {number!r}")
            distance = int(number)
        self.take(")")
        phrases = [phrase for phrase in phrases if isinstance(phrase, Phrase)]
        if not phrases:
            return Nothing()
        return phrases[0] if len(phrases) == 1 else Near(tuple(phrases), distance)

    def phrase(self, first: bool = False):
        parts = self.string()
        while self.peek() == "+":
            self.take("+")
            parts += self.string()
        return Phrase(tuple(parts), first) if parts else Nothing()

    def string(self) -> list[tuple[str, bool]]:
        words = query_tokens(self.take("text"))
        parts = [(word, False) for word in words]
        if self.peek() == "*":
            self.take("*")
            if parts:
                parts[-1] = (parts[-1][0], True)
        return parts


def parse_search(query: str):
    """The tree of a search expression; raises ``SearchSyntaxError`` where it cannot be read."""
    if not query or not query.strip():
        raise SearchSyntaxError("the search is empty")
    if len(query) > MAX_QUERY_CHARS:
        raise SearchSyntaxError(f"the search is longer than {MAX_QUERY_CHARS} characters")
    try:
        return _Reader(query).query()
    except RecursionError:
        raise SearchSyntaxError("the search is nested too deeply") from None


# --- exact condition ----------------------------------------------------------------------


# A character of a token, and one between tokens.
_IN = r"[\p{L}\p{N}\p{Co}]"
_BETWEEN = r"[^\p{L}\p{N}\p{Co}]"


def search_condition(query: str, body: Column) -> Column:
    """True where the body matches.

    The body is folded once.  A cheap necessary test (every word occurs somewhere) comes first;
    the exact test then stops at the first place that matches.
    """
    tree = parse_search(query)
    if not _leaves(tree):
        return F.lit(False)
    matched = F.exists(
        F.array(folded(body)), lambda text: _possible(tree, text) & _exact(tree, text)
    )
    return F.coalesce(matched, F.lit(False))


def _joined(tree, of) -> Column:
    """``of`` every part of a chain of AND or of OR, joined pair by pair: long searches stay shallow plans."""
    parts, left = [], [tree]
    while left:
        node = left.pop()
        if type(node) is type(tree):
            left += [node.right, node.left]
        elif node not in parts:
            parts.append(node)
    columns, join = [of(part) for part in parts], and_ if isinstance(tree, Both) else or_
    while len(columns) > 1:
        pairs = [columns[i : i + 2] for i in range(0, len(columns), 2)]
        columns = [join(*pair) if len(pair) == 2 else pair[0] for pair in pairs]
    return columns[0]


def _leaves(tree) -> list:
    if isinstance(tree, (Both, Either, Without)):
        return _leaves(tree.left) + _leaves(tree.right)
    return [] if isinstance(tree, Nothing) else [tree]


def _words(leaf) -> list[str]:
    phrases = leaf.phrases if isinstance(leaf, Near) else (leaf,)
    return sorted({word for phrase in phrases for word, _ in phrase.parts})


def _possible(tree, text: Column) -> Column:
    if isinstance(tree, (Both, Either)):
        return _joined(tree, lambda part: _possible(part, text))
    if isinstance(tree, Without):
        return _possible(tree.left, text)
    if isinstance(tree, Nothing):
        return F.lit(False)
    return reduce(and_, [text.contains(word) for word in _words(tree)])


def _exact(tree, text: Column) -> Column:
    if isinstance(tree, (Both, Either)):
        return _joined(tree, lambda part: _exact(part, text))
    if isinstance(tree, Without):
        return _exact(tree.left, text) & ~_exact(tree.right, text)
    if isinstance(tree, Nothing):
        return F.lit(False)
    if isinstance(tree, Near):
        return _near(tree, text)
    return text.rlike(_pattern(tree))


def _pattern(phrase: Phrase) -> str:
    """The phrase as a pattern.  Tokens hold only letters and digits, so they stand for themselves.

    The look behind follows the first word, so the scan for a start is one for a plain string.
    """
    (head, _), *_rest = phrase.parts
    words = [word + (f"{_IN}*" if is_prefix else "") for word, is_prefix in phrase.parts]
    words[0] = words[0] if phrase.first else words[0].replace(head, f"{head}(?<!{_IN}{head})", 1)
    start = rf"\A{_BETWEEN}*" if phrase.first else ""
    return start + f"{_BETWEEN}+".join(words) + f"(?!{_IN})"


def _near(near: Near, text: Column) -> Column:
    """One pass over the places where a phrase may start.

    The pass remembers the last start of every phrase; at a start ``k`` the phrases are near if
    all of them last started within their own length plus the distance before ``k``.
    """
    return F.exists(F.array(token_array(text)), lambda words: _near_in(near, words))


def _near_in(near: Near, words: Column) -> Column:
    names = [f"p{i}" for i in range(len(near.phrases))]
    heads = [phrase.parts[0] for phrase in near.phrases]

    def step(state: Column, k: Column) -> Column:
        starts = [_starts_at(phrase, words, k) for phrase in near.phrases]
        last = [F.when(s, k).otherwise(state[name]) for s, name in zip(starts, names)]
        reach = [len(phrase.parts) + near.distance for phrase in near.phrases]
        close = reduce(and_, [place >= k - far for place, far in zip(last, reach)])
        return F.struct(
            *[place.alias(name) for place, name in zip(last, names)],
            (state["hit"] | (reduce(or_, starts) & close)).alias("hit"),
        )

    candidates = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda k: reduce(or_, [_token_is(part, F.get(words, k)) for part in heads]),
    )
    before_all = F.struct(
        *[F.lit(-(1 << 30)).alias(name) for name in names], F.lit(False).alias("hit")
    )
    return F.aggregate(candidates, before_all, step)["hit"]


def _token_is(part: tuple[str, bool], token: Column) -> Column:
    word, is_prefix = part
    return token.startswith(word) if is_prefix else token == word


def _starts_at(phrase: Phrase, words: Column, k: Column) -> Column:
    tests = [_token_is(part, F.get(words, k + i)) for i, part in enumerate(phrase.parts)]
    return F.coalesce(reduce(and_, tests), F.lit(False))


# --- token table lookup -------------------------------------------------------------------


def candidate_flags(query: str) -> tuple[list[tuple[str, bool]], object]:
    """Tokens to look up, and the tree to combine their presence with.

    Presence of all tokens is necessary for a phrase but not sufficient, and the right side of
    NOT says nothing about presence; candidates are therefore checked exactly afterwards.
    """
    tree = parse_search(query)
    wanted: list[tuple[str, bool]] = []
    for leaf in _leaves(_positive(tree)):
        phrases = leaf.phrases if isinstance(leaf, Near) else (leaf,)
        for phrase in phrases:
            wanted += [part for part in phrase.parts if part not in wanted]
    return wanted, _positive(tree)


def _positive(tree):
    if isinstance(tree, Without):
        return _positive(tree.left)
    if isinstance(tree, (Both, Either)):
        return type(tree)(_positive(tree.left), _positive(tree.right))
    return tree


def combine_flags(tree, flag_of) -> Column:
    """Candidate condition given ``flag_of((token, is_prefix)) -> Column``."""
    if isinstance(tree, (Both, Either)):
        return _joined(tree, lambda part: combine_flags(part, flag_of))
    if isinstance(tree, Nothing):
        return F.lit(False)
    phrases = tree.phrases if isinstance(tree, Near) else (tree,)
    return reduce(and_, [flag_of(part) for phrase in phrases for part in phrase.parts])


def any_token(wanted: list[tuple[str, bool]], token: Column) -> Column:
    """True for rows of the token table that serve at least one wanted token."""
    exact = [word for word, is_prefix in wanted if not is_prefix]
    tests = [token.isin(*exact)] if exact else []
    tests += [token.startswith(word) for word, is_prefix in wanted if is_prefix]
    return reduce(or_, tests) if tests else F.lit(False)


def presence_flags(query: str) -> tuple[list[tuple[str, bool]], object] | None:
    """Tokens and tree of a search that presence of tokens decides; None where bodies must be looked at.

    That is so for single words and prefixes joined by AND, OR and NOT: no phrase, no first word,
    no NEAR.
    """
    tree = parse_search(query)
    leaves = _leaves(tree)
    if not all(isinstance(leaf, Phrase) and len(leaf.parts) == 1 and not leaf.first for leaf in leaves):
        return None
    wanted: list[tuple[str, bool]] = []
    for leaf in leaves:
        wanted += [part for part in leaf.parts if part not in wanted]
    return wanted, tree


def presence(tree, flag_of) -> Column:
    """The exact condition of a tree of ``presence_flags``, given ``flag_of((token, is_prefix)) -> Column``."""
    if isinstance(tree, (Both, Either)):
        return _joined(tree, lambda part: presence(part, flag_of))
    if isinstance(tree, Without):
        return presence(tree.left, flag_of) & ~presence(tree.right, flag_of)
    if isinstance(tree, Nothing):
        return F.lit(False)
    return flag_of(tree.parts[0])
