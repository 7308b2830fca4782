"""Queries: syntax tree, parser, rewrites, and compilation to columns."""
