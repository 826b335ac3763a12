"""A closed expression language over items, compiled to a value column and a reason column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import close_matches

#: The limits of an expression.
MAX_LENGTH, MAX_TERMS, MAX_OFFSET, MAX_NESTING = 300, 20, 4, 6
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?|\.\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>[-+*/()\[\]]))")
NUMBER = "decimal(38,12)"


class ExpressionError(ValueError):
    """The expression is refused, for a reason and perhaps with near names."""

    def __init__(self, reason: str, candidates: list[str] | None = None):
        super().__init__(reason)
        self.reason, self.candidates = reason, candidates or []


@dataclass(frozen=True)
class Vocabulary:
    """items: names with a column each; presets: names that stand for expressions; not_ingested: known, but not in the data."""

    items: frozenset[str]
    presets: dict[str, str] = field(default_factory=dict)
    not_ingested: frozenset[str] = frozenset()


class Parser:
    """Precedence climbing over tokens: + - below * / below a sign below a term with an offset."""

    BINDING = {"+": 1, "-": 1, "*": 2, "/": 2}

    def __init__(self, text: str, words: Vocabulary, shift: int = 0, nesting: int = 0):
        if not isinstance(text, str) or not text.strip() or len(text) > MAX_LENGTH or nesting > MAX_NESTING:
            raise ExpressionError("bad_expression")
        self.words, self.shift, self.nesting, self.tokens, at = words, shift, nesting, [], 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise ExpressionError("bad_expression")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.tokens.reverse()

    def _next(self, want: str | None = None) -> tuple[str, str]:
        if not self.tokens or want and self.tokens[-1][1] != want:
            raise ExpressionError("bad_expression")
        return self.tokens.pop()

    def whole(self):
        tree = self.sums(0)
        if self.tokens:
            raise ExpressionError("bad_expression")
        return tree

    def sums(self, least: int):
        left = self.signed()
        while self.tokens and self.BINDING.get(self.tokens[-1][1], -1) > least:
            op = self._next()[1]
            left = (op, left, self.sums(self.BINDING[op]))
        return left

    def signed(self):
        if self.tokens and self.tokens[-1][1] == "-":
            self._next()
            return ("neg", self.signed())
        kind, text = self._next()
        if kind == "num":
            return ("num", text)
        if kind == "name":
            return self.term(text, self.offset())
        if text != "(":
            raise ExpressionError("bad_expression")
        inner = self.sums(0)
        self._next(")")
        return inner

    def offset(self) -> int:
        if not self.tokens or self.tokens[-1][1] != "[":
            return self.shift
        self._next()
        self._next("t")
        n = 0
        if self.tokens and self.tokens[-1][1] == "-":
            self._next()
            kind, text = self._next()
            if kind != "num" or text not in map(str, range(1, MAX_OFFSET + 1)):
                raise ExpressionError("bad_expression")
            n = int(text)
        self._next("]")
        return self.shift + n

    def term(self, name: str, offset: int):
        if offset > MAX_OFFSET:
            raise ExpressionError("bad_expression")
        if name in self.words.presets:
            return Parser(self.words.presets[name], self.words, offset, self.nesting + 1).whole()
        if name in self.words.not_ingested:
            raise ExpressionError("input_not_ingested")
        if name not in self.words.items:
            raise ExpressionError("unknown_item", close_matches(name, sorted({*self.words.items, *self.words.presets})))
        return ("term", name, offset)


def parse(text: str, words: Vocabulary):
    tree = Parser(text, words).whole()
    if len(list(terms(tree))) > MAX_TERMS:
        raise ExpressionError("bad_expression")
    return tree


def terms(tree):
    if tree[0] == "term":
        yield tree[1:]
    for part in tree[1:]:
        if isinstance(part, tuple):
            yield from terms(part)


def compiled(tree, item) -> tuple[Column, Column]:
    """(value, reason): item(name, offset) gives those of a term. The first reason from the left wins; then value is null."""
    kind = tree[0]
    if kind == "num":
        return F.lit(tree[1]).cast(NUMBER), F.lit(None).cast("string")
    if kind == "term":
        return item(tree[1], tree[2])
    if kind == "neg":
        value, reason = compiled(tree[1], item)
        return -value, reason
    (a, ra), (b, rb) = compiled(tree[1], item), compiled(tree[2], item)
    reason = F.coalesce(ra, rb)
    if kind == "/":
        reason = F.coalesce(reason, F.when(b <= 0, F.lit("nonpositive_denominator")))
        value = F.when(b > 0, a.cast("decimal(25,6)") / F.when(b > 0, b).cast("decimal(25,6)"))
    elif kind == "*":
        value = a.cast("decimal(19,6)") * b.cast("decimal(19,6)")
    else:
        value = a + b if kind == "+" else a - b
    return F.when(reason.isNull(), value.cast(NUMBER)), reason
