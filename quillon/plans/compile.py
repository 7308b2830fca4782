"""From a query tree to columns over one aggregation of the postings.

Each leaf becomes a predicate on ``field`` and ``term``. The postings that meet any of them are
grouped by document once, with a flag for each leaf, the frequency of exact terms and the
positions of phrase terms; combinators are then Boolean and float columns over those. No clause
costs a join, whatever the tree looks like.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.score import ScoreFunction
from quillon.model import Schema, SearchError
from quillon.plans import ast


def _float(x: float) -> Column:
    return F.lit(float(x)).cast("float")


@dataclass
class Part:
    """Match and score of a subtree, and whether it matches a document with no posting at all."""

    match: Column
    score: Column
    empty: bool = False


@dataclass
class Compiler:
    schema: Schema
    num_docs: int
    frequencies: dict[tuple[str, str], int]  # documents with each exact or phrase term
    scorer: ScoreFunction
    spark: SparkSession
    strict_ranges: bool = False
    predicates: list[Column] = field(default_factory=list)
    aggregates: list[Column] = field(default_factory=list)
    known: dict[object, str] = field(default_factory=dict)

    # ---- leaves

    def _flag(self, key: object, predicate: Column) -> str:
        """The name of the flag of a leaf; equal leaves share one."""
        if key not in self.known:
            name = f"m{len(self.known)}"
            self.known[key] = name
            self.predicates.append(predicate)
            self.aggregates.append(F.max(predicate).alias(name))
        return self.known[key]

    def _value(self, key: object, value: Column) -> str:
        if key not in self.known:
            self.known[key] = f"v{len(self.known)}"
            self.aggregates.append(value.alias(self.known[key]))
        return self.known[key]

    def _is(self, name: str, text: str) -> Column:
        return (F.col("field") == name) & (F.col("term") == text)

    def _term(self, name: str, text: str) -> Part:
        p = self._is(name, text)
        flag = F.coalesce(F.col(self._flag((name, "term", text), p)), F.lit(False))
        tf = F.col(self._value((name, "tf", text), F.max(F.when(p, F.col("tf")))))
        df = self.frequencies.get((name, text), 0)
        made = self.scorer(tf, F.lit(df), F.lit(self.num_docs)).cast("float")
        return Part(flag, F.when(flag, made).otherwise(_float(0)))

    def _constant(self, key: tuple, predicate: Column) -> Part:
        flag = F.coalesce(F.col(self._flag(key, predicate)), F.lit(False))
        return Part(flag, F.when(flag, _float(1)).otherwise(_float(0)))

    def _range(self, name: str, q: ast.TermRange) -> Part:
        if q.low is None or q.high is None:
            raise SearchError("Unsupported TermRange error?")
        t = F.col("term")
        low = t >= q.low if q.low_in or not self.strict_ranges else t > q.low
        high = t <= q.high if q.high_in and self.strict_ranges else t < q.high
        return self._constant((name, q), (F.col("field") == name) & low & high)

    def _regex(self, name: str, q: ast.TermRegex) -> Part:
        try:
            self.spark._jvm.java.util.regex.Pattern.compile(q.text)
        except IllegalArgumentException:
            raise SearchError(f"Invalid regex query {q}") from None
        return self._constant((name, q), (F.col("field") == name) & F.col("term").rlike(q.text))

    def _phrase(self, name: str, q: ast.Phrase) -> Part:
        if not self.schema.field(name).positions:
            raise SearchError("Index does not support phrase queries")
        words = q.text.split(" ")
        if any((name, w) not in self.frequencies for w in words):
            raise SearchError(f"Some terms in phrase '{q}' could not be found in index")
        places = []
        for w in words:
            p = self._is(name, w)
            self._flag((name, "term", w), p)
            places.append(self._value((name, "positions", w), F.first(F.when(p, F.col("positions")), ignorenulls=True)))
        # a phrase begins where each of its words is as far on as its place in it
        starts = [F.expr(f"transform({c}, x -> x - {i})") for i, c in enumerate(places)]
        both = F.size(reduce(F.array_intersect, starts)) > 0
        flag = F.coalesce(both, F.lit(False)) if len(words) > 1 else F.coalesce(F.col(self.known[(name, "term", words[0])]), F.lit(False))
        return Part(flag, F.when(flag, _float(1)).otherwise(_float(0)))

    # ---- tree

    def compile(self, q: ast.Query, name: str | None = None) -> Part:
        """``name`` is the field inside a field query, else None: leaves use the default one."""
        own = name or self.schema.default_field.name
        inner = lambda p: self.compile(p, name)
        if isinstance(q, ast.Term):
            return self._term(own, q.text)
        if isinstance(q, ast.Prefix):
            return self._constant((own, q), (F.col("field") == own) & F.col("term").startswith(q.text))
        if isinstance(q, ast.TermRange):
            return self._range(own, q)
        if isinstance(q, ast.TermRegex):
            return self._regex(own, q)
        if isinstance(q, ast.Phrase):
            return self._phrase(own, q)
        if isinstance(q, ast.FieldQuery):
            if name:
                raise SearchError(f"Unsupported nested field query: {q}")
            return self.compile(q.part, self.schema.field(q.name).name)
        if isinstance(q, ast.Group):
            return inner(q.part)
        if isinstance(q, ast.And):
            parts = [inner(p) for p in q.parts]
            match = reduce(lambda a, b: a & b, [p.match for p in parts])
            return Part(match, F.when(match, self._sum(parts)).otherwise(_float(0)), all(p.empty for p in parts))
        if isinstance(q, ast.Or):
            parts = [inner(p) for p in q.parts]
            return Part(reduce(lambda a, b: a | b, [p.match for p in parts]), self._sum(parts), any(p.empty for p in parts))
        if isinstance(q, ast.MinimumMatch):
            if q.least < 1:
                raise SearchError("minimum match must be at least 1")
            parts = [inner(p) for p in q.parts]
            match = reduce(lambda a, b: a + b, [p.match.cast("int") for p in parts]) >= q.least
            return Part(match, F.when(match, self._sum(parts)).otherwise(_float(0)), sum(p.empty for p in parts) >= q.least)
        if isinstance(q, ast.Not):
            p = inner(q.part)
            return Part(~p.match, _float(0), not p.empty)
        if isinstance(q, ast.Boost):
            p = inner(q.part)
            return Part(p.match, (p.score * _float(q.factor)).cast("float"), p.empty)
        if isinstance(q, ast.ConstantScore):
            p = inner(q.part)
            return Part(p.match, F.when(p.match, _float(q.score)).otherwise(_float(0)), p.empty)
        if isinstance(q, ast.NoMatch):
            return Part(F.lit(False), _float(0))
        raise SearchError(f"Unsupported query: {q}")

    @staticmethod
    def _sum(parts: list[Part]) -> Column:
        """Float sum from left to right; a part that does not match scores 0."""
        return reduce(lambda a, b: (a + b).cast("float"), [p.score for p in parts], _float(0))

    # ---- plan

    def plan(self, postings: DataFrame, docs: DataFrame, q: ast.Query) -> DataFrame:
        """``doc_id, score`` of the documents that match. Only if a document without any of the
        query's terms could match are all documents read."""
        part = self.compile(q)
        if not self.predicates:
            own = docs.select("doc_id")
            return own.filter(part.match).select("doc_id", part.score.alias("score"))
        flags = postings.filter(reduce(lambda a, b: a | b, self.predicates)).groupBy("doc_id").agg(*self.aggregates)
        if part.empty:
            flags = docs.select("doc_id").join(flags, "doc_id", "left")
        return flags.filter(part.match).select("doc_id", part.score.alias("score"))


def leaf_terms(q: ast.Query, default: str, name: str | None = None) -> set[tuple[str, str]]:
    """(field, term) of all exact and phrase terms."""
    own = name or default
    if isinstance(q, ast.Term):
        return {(own, q.text)}
    if isinstance(q, ast.Phrase):
        return {(own, w) for w in q.text.split(" ")}
    if isinstance(q, ast.FieldQuery):
        return leaf_terms(q.part, default, q.name)
    found: set[tuple[str, str]] = set()

    def see(p: ast.Query) -> ast.Query:
        found.update(leaf_terms(p, default, name))
        return p

    ast.rebuilt(q, see)
    return found
