"""The inverted index as tables, and how it is built.

``postings``: field, term, doc_id, tf, positions (null for fields without positions);
``terms``: field, term, df; ``docs``: doc_id and the stored columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.analysis import tokenize
from quillon.model import Schema, SearchError


@dataclass
class SearchIndex:
    schema: Schema
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    num_docs: int
    tokens: DataFrame | None = None  # ``field, p, doc_id, pos, term`` of an index that is not saved yet

    def cached(self) -> SearchIndex:
        """The same index held in memory (and on disk where it does not fit)."""
        return SearchIndex(self.schema, self.postings.cache(), self.terms.cache(), self.docs.cache(), self.num_docs)

    # ---- dictionary

    def dictionary(self, field: str) -> DataFrame:
        """``term, df`` of one field, in order of terms."""
        self.schema.field(field)
        return self.terms.filter(F.col("field") == field).select("term", "df").orderBy("term")

    def num_terms(self, field: str) -> int:
        return self.dictionary(field).count()

    def term_index(self, field: str, term: str) -> int:
        """How many terms come before ``term``: the place where it is or would be."""
        return self.dictionary(field).filter(F.col("term") < term).count()

    def terms_for_prefix(self, field: str, prefix: str) -> DataFrame:
        return self.dictionary(field).filter(F.col("term").startswith(prefix))

    def terms_for_range(self, field: str, low: str, high: str) -> DataFrame:
        return self.dictionary(field).filter((F.col("term") >= low) & (F.col("term") < high))

    def terms_for_regex(self, field: str, pattern: str) -> DataFrame:
        return self.dictionary(field).filter(F.col("term").rlike(pattern))

    def postings_for(self, field: str, term: str) -> DataFrame:
        self.schema.field(field)
        return self.postings.filter((F.col("field") == field) & (F.col("term") == term)).select("doc_id", "tf", "positions")

    def frequencies(self, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequency of each (field, term) that exists; as many rows as are asked for."""
        if not wanted:
            return {}
        by: dict[str, list[str]] = {}
        for field, term in sorted(wanted):
            by.setdefault(field, []).append(term)
        hit = F.lit(False)
        for field, names in by.items():
            hit = hit | ((F.col("field") == field) & F.col("term").isin(names))
        return {(r["field"], r["term"]): r["df"] for r in self.terms.filter(hit).collect()}


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``doc_id`` from 1 in the given order, for small tables without a key."""
    return rows.withColumn("doc_id", F.row_number().over(Window.orderBy(*order)))


def build_index(rows: DataFrame, schema: Schema, key: str = "doc_id", values: Mapping[str, Column] | None = None) -> SearchIndex:
    """Index ``rows``. A field's text is the column of its name or the expression in ``values``;
    an array of strings is taken as tokens. Null values have no tokens.

    One exchange: tokens are exploded, counted within tasks, then by (field, term, doc_id).
    """
    values = dict(values or {})
    src = rows.select(F.col(key).alias("doc_id"), *[values.get(f.name, F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields])
    kinds = dict(src.dtypes)
    for f in schema.fields:
        if kinds[f.name] not in ("string", "array<string>"):
            raise SearchError(f"Field '{f.name}' is {kinds[f.name]}; only strings can be indexed")
    split = [F.struct(F.lit(f.name).alias("field"), F.lit(f.positions).alias("p"), (F.col(f"`{f.name}`") if kinds[f.name].startswith("array") else tokenize(F.col(f"`{f.name}`"), f.analyzer.lower_case)).alias("tokens")) for f in schema.fields]
    tokens = src.select("doc_id", F.explode(F.array(*split)).alias("f")).select("doc_id", "f.field", "f.p", "f.tokens").select("doc_id", "field", "p", F.posexplode("tokens").alias("pos", "term"))
    postings = postings_of(tokens, schema)
    terms = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    docs = src.select("doc_id", *[f"`{f}`" for f in schema.stored])
    return SearchIndex(schema, postings, terms, docs, rows.count(), tokens)


def postings_of(tokens: DataFrame, schema: Schema) -> DataFrame:
    """``field, term, doc_id, tf, positions`` of exploded tokens; no exchange where they are dealt by
    ranges of the first three."""
    keys = ["field", "term", "doc_id"]
    if not any(f.positions for f in schema.fields):
        return tokens.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("tf")).withColumn("positions", F.lit(None).cast("array<int>"))
    grouped = tokens.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list(F.when(F.col("p"), F.col("pos")))).alias("at"))
    return grouped.select(*keys, "tf", F.when(F.size("at") > 0, F.col("at")).alias("positions"))
