"""Rewrites of a parsed query, on the driver."""

from __future__ import annotations

from quillon.functions.analysis import tokens_of
from quillon.model import Analyzer, SearchError
from quillon.plans import ast


def analyzed(q: ast.Query, analyzer: Analyzer) -> ast.Query:
    """Terms and phrases as the default field's analyzer would index them. A term of several
    tokens becomes an OR of them; ranges, prefixes and patterns stay as they are."""
    if isinstance(q, ast.Term):
        tokens = tokens_of(q.text, analyzer.lower_case)
        if not tokens:
            raise SearchError(f"Error tokenizing Term '{q.text}' during query analysis")
        return ast.Term(tokens[0]) if len(tokens) == 1 else ast.Or(tuple(map(ast.Term, tokens)))
    if isinstance(q, ast.Phrase):
        tokens = tokens_of(q.text, analyzer.lower_case)
        if not tokens:
            raise SearchError(f"Error tokenizing Phrase '{q.text}' during query analysis")
        return ast.Phrase(" ".join(tokens))
    return ast.rebuilt(q, lambda p: analyzed(p, analyzer))


def last_term_as_prefix(q: ast.Query) -> ast.Query:
    """The last leaf, if it is a term, also matches what it begins."""
    if isinstance(q, ast.Term):
        return ast.Group(ast.Or((q, ast.Prefix(q.text))))
    if isinstance(q, (ast.And, ast.Or, ast.MinimumMatch)):
        last = len(q.parts) - 1
        at = iter(range(len(q.parts)))
        return ast.rebuilt(q, lambda p: last_term_as_prefix(p) if next(at) == last else p)
    return ast.rebuilt(q, last_term_as_prefix)
