"""Nodes of a query. ``str`` gives the form that error messages quote."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Query:
    def __str__(self) -> str:
        return f"{type(self).__name__}({','.join(_shown(getattr(self, f.name)) for f in fields(self))})"


def _shown(x: object) -> str:
    if isinstance(x, tuple):
        return f"NonEmptyList({', '.join(map(_shown, x))})"
    if x is None:
        return "None"
    return str(x).lower() if isinstance(x, bool) else str(x)


@dataclass(frozen=True)
class Term(Query):
    text: str


@dataclass(frozen=True)
class Prefix(Query):
    text: str


@dataclass(frozen=True)
class TermRange(Query):
    low: str | None
    high: str | None
    low_in: bool = True
    high_in: bool = True


@dataclass(frozen=True)
class TermRegex(Query):
    text: str


@dataclass(frozen=True)
class Phrase(Query):
    text: str


@dataclass(frozen=True)
class Fuzzy(Query):
    text: str
    edits: int | None = None


@dataclass(frozen=True)
class Proximity(Query):
    text: str
    distance: int = 0


@dataclass(frozen=True)
class WildCard(Query):
    text: str


@dataclass(frozen=True)
class And(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Or(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class MinimumMatch(Query):
    parts: tuple[Query, ...]
    least: int


@dataclass(frozen=True)
class Not(Query):
    part: Query


@dataclass(frozen=True)
class Group(Query):
    part: Query


@dataclass(frozen=True)
class FieldQuery(Query):
    name: str
    part: Query

    def __str__(self) -> str:
        return f"Field({self.name},{self.part})"


@dataclass(frozen=True)
class Boost(Query):
    part: Query
    factor: float


@dataclass(frozen=True)
class ConstantScore(Query):
    part: Query
    score: float = 1.0


@dataclass(frozen=True)
class NoMatch(Query):
    pass


@dataclass(frozen=True)
class UnaryPlus(Query):
    part: Query


@dataclass(frozen=True)
class UnaryMinus(Query):
    part: Query


#: Leaves of the tree.
LEAVES = (Term, Prefix, TermRange, TermRegex, Phrase, Fuzzy, Proximity, WildCard)


def rebuilt(q: Query, change) -> Query:
    """``q`` with ``change`` applied to its direct parts."""
    if isinstance(q, (And, Or)):
        return type(q)(tuple(change(p) for p in q.parts))
    if isinstance(q, MinimumMatch):
        return MinimumMatch(tuple(change(p) for p in q.parts), q.least)
    if isinstance(q, FieldQuery):
        return FieldQuery(q.name, change(q.part))
    if isinstance(q, Boost):
        return Boost(change(q.part), q.factor)
    if isinstance(q, ConstantScore):
        return ConstantScore(change(q.part), q.score)
    if isinstance(q, (Not, Group, UnaryPlus, UnaryMinus)):
        return type(q)(change(q.part))
    return q
