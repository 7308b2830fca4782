"""A recursive-descent parser of the query language.

Precedence: NOT, then AND, then OR; terms side by side are combined by OR. ``(a b c)@2`` asks for
two of three, ``q^2`` boosts, a backslash takes the next character as it is.
"""

from __future__ import annotations

import re

from quillon.model import SearchError
from quillon.plans import ast

_END = set(' \t\n\r\f\v()[]{}"^:/@')
_NUMBER = re.compile(r"\d+(?:\.\d+)?")


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    # ---- characters

    def fail(self, what: str) -> SearchError:
        return SearchError(f"Parse error at {self.at} in '{self.text}': {what}")

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self) -> str:
        self.blank()
        return self.text[self.at : self.at + 1]

    def take(self, s: str) -> bool:
        self.blank()
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def keyword(self, *words: str) -> bool:
        self.blank()
        for w in words:
            end = self.at + len(w)
            if self.text.startswith(w, self.at) and (not w.isalpha() or end == len(self.text) or self.text[end] in " \t\n\r()"):
                self.at = end
                return True
        return False

    def until(self, mark: str) -> str:
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                out.append(self.text[self.at + 1] if self.text[self.at + 1] in (mark, "\\") and mark == '"' else (self.text[self.at + 1] if self.text[self.at + 1] == mark else self.text[self.at : self.at + 2]))
                self.at += 2
                continue
            self.at += 1
            if c == mark:
                return "".join(out)
            out.append(c)
        raise self.fail(f"{mark} expected")

    def number(self) -> float:
        if not (m := _NUMBER.match(self.text, self.at)):
            raise self.fail("number expected")
        self.at = m.end()
        return float(m[0])

    # ---- grammar

    def query(self) -> ast.Query:
        if not self.peek():
            raise self.fail("empty query")
        q = self.either()
        if self.peek():
            raise self.fail("unexpected input")
        return q

    def either(self) -> ast.Query:
        parts = [self.both()]
        while True:
            if self.keyword("OR", "||"):
                parts.append(self.both())
            elif (c := self.peek()) and c != ")":
                parts.append(self.both())
            else:
                return parts[0] if len(parts) == 1 else ast.Or(tuple(parts))

    def both(self) -> ast.Query:
        parts = [self.unary()]
        while self.keyword("AND", "&&"):
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else ast.And(tuple(parts))

    def unary(self) -> ast.Query:
        if self.keyword("NOT", "!"):
            return ast.Not(self.unary())
        if self.take("+"):
            return ast.UnaryPlus(self.boosted())
        if self.take("-"):
            return ast.UnaryMinus(self.boosted())
        return self.boosted()

    def boosted(self) -> ast.Query:
        q = self.primary()
        while self.text.startswith("^", self.at):
            self.at += 1
            q = ast.Boost(q, self.number())
        return q

    def primary(self) -> ast.Query:
        c = self.peek()
        if not c:
            raise self.fail("query expected")
        if c == "(":
            return self.group()
        if c == '"':
            self.at += 1
            text = self.until('"')
            if self.text.startswith("~", self.at):
                self.at += 1
                return ast.Proximity(text, int(self.number()))
            return ast.Phrase(text)
        if c == "/":
            self.at += 1
            return ast.TermRegex(self.until("/"))
        if c in "[{":
            return self.range()
        return self.word()

    def group(self) -> ast.Query:
        self.at += 1
        if self.peek() == ")":
            raise self.fail("empty group")
        inner = self.either()
        if not self.take(")"):
            raise self.fail(") expected")
        if self.text.startswith("@", self.at):
            self.at += 1
            least = int(self.number())
            if least < 1:
                raise SearchError("minimum match must be at least 1")
            return ast.MinimumMatch(inner.parts if isinstance(inner, ast.Or) else (inner,), least)
        return ast.Group(inner)

    def range(self) -> ast.Query:
        low_in = self.text[self.at] == "["
        self.at += 1
        low = self.bound()
        if not self.keyword("TO"):
            raise self.fail("TO expected")
        high = self.bound()
        if self.peek() not in ("]", "}"):
            raise self.fail("] expected")
        high_in = self.text[self.at] == "]"
        self.at += 1
        return ast.TermRange(low, high, low_in, high_in)

    def bound(self) -> str | None:
        if self.peek() == '"':
            self.at += 1
            return self.until('"')
        text, escaped = self.raw()
        if not text:
            raise self.fail("bound expected")
        return None if text == "*" and not escaped else text

    def raw(self) -> tuple[str, bool]:
        out, escaped = [], False
        while self.at < len(self.text) and self.text[self.at] not in _END:
            if self.text[self.at] == "\\" and self.at + 1 < len(self.text):
                escaped = True
                self.at += 1
            out.append(self.text[self.at])
            self.at += 1
        return "".join(out), escaped

    def word(self) -> ast.Query:
        text, escaped = self.raw()
        if not text:
            raise self.fail("query expected")
        if self.text.startswith(":", self.at):
            self.at += 1
            return ast.FieldQuery(text, self.primary())
        if escaped:
            return ast.Term(text)
        if m := re.fullmatch(r"([^~]+)~(\d?)", text):
            return ast.Fuzzy(m[1], int(m[2]) if m[2] else None)
        if text.endswith("*") and len(text) > 1 and not set("*?") & set(text[:-1]):
            return ast.Prefix(text[:-1])
        return ast.WildCard(text) if set("*?") & set(text) else ast.Term(text)


def parse(text: str) -> ast.Query:
    """The query's tree, or :class:`SearchError`."""
    return _Parser(text).query()
