"""Searching an index: ranked, paged hits with stored fields and highlights."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.highlight import Highlighter
from quillon.functions.score import ScoreFunction, tf_idf
from quillon.model import SearchError, SearchRequest
from quillon.operators.index import SearchIndex
from quillon.plans import ast
from quillon.plans.compile import Compiler, leaf_terms
from quillon.plans.parser import parse
from quillon.plans.rewrite import analyzed, last_term_as_prefix
from quillon.sources.folders import shared_dir

#: Hits up to this number, skipped ones included, are ranked on the driver and sent to all tasks to fetch their
#: stored values; more are ranked in a sort of ranges and joined.
FEW = 10_000


class Searcher:
    def __init__(self, index: SearchIndex, scorer: ScoreFunction = tf_idf, highlighter: Highlighter | None = None, strict_ranges: bool = False, few: int = FEW):
        self.index, self.scorer = index, scorer
        self.highlighter = highlighter or Highlighter()
        self.strict_ranges, self.few = strict_ranges, few

    # ---- matching

    def tree(self, query: str | ast.Query, last_term_prefix: bool = False) -> ast.Query:
        q = parse(query) if isinstance(query, str) else query
        q = analyzed(q, self.index.schema.default_field.analyzer)
        return last_term_as_prefix(q) if last_term_prefix else q

    def scored(self, query: str | ast.Query, last_term_prefix: bool = False) -> DataFrame:
        """``doc_id, score`` of all matches, in no order."""
        return self._plan(self.tree(query, last_term_prefix))

    def ids(self, query: str | ast.Query) -> DataFrame:
        """``doc_id`` of all matches."""
        return self.scored(query).select("doc_id")

    def _plan(self, q: ast.Query) -> DataFrame:
        default = self.index.schema.default_field.name
        df = self.index.frequencies(leaf_terms(q, default))
        c = Compiler(self.index.schema, self.index.num_docs, df, self.scorer, self.index.postings.sparkSession, self.strict_ranges)
        return c.plan(self.index.postings, self.index.docs, q)

    # ---- hits

    def _check(self, request: SearchRequest) -> tuple[list[str], list[str]]:
        stored = self.index.schema.stored
        shown = stored if request.result_fields is None else request.result_fields
        marked = stored if request.highlight_fields is None else request.highlight_fields
        faults = [f"{what} not stored in index: '{', '.join(bad)}'." for what, names in (("Fields", shown), ("Highlights", marked)) if (bad := [n for n in names if n not in stored])]
        if faults:
            raise SearchError(" ".join(faults))
        if request.size < 0 or request.skip < 0:
            raise SearchError("size and skip must not be negative")
        return list(shown), list(marked)

    def search(self, request: SearchRequest | str) -> DataFrame:
        """``doc_id, score, fields, highlights``, best first, equal scores by ``doc_id``. Stored
        values are fetched for the page only."""
        r = SearchRequest(request) if isinstance(request, str) else request
        q = self.tree(r.query, r.last_term_prefix)
        shown, marked = self._check(r)
        page = self._page(self._plan(q), r.skip, r.size)
        if not shown and not marked:
            none = F.expr("cast(map() as map<string,string>)")
            return page.select("doc_id", "score", none.alias("fields"), none.alias("highlights"))
        rows = page if r.size > self.few else F.broadcast(page)
        hits = self.index.docs.select("doc_id", *[f"`{n}`" for n in dict.fromkeys([*shown, *marked])]).join(rows, "doc_id")
        as_map = lambda names, value: F.create_map(*[x for n in names for x in (F.lit(n), value(n))]) if names else F.expr("cast(map() as map<string,string>)")
        stored = lambda n: F.col(f"`{n}`").cast("string")
        hits = hits.select("doc_id", "score", as_map(shown, stored).alias("fields"), as_map(marked, lambda n: self.highlighter.column(stored(n), r.query)).alias("highlights"))
        return hits.orderBy(F.desc("score"), F.asc("doc_id"))

    def _page(self, found: DataFrame, skip: int, size: int) -> DataFrame:
        if skip + size <= self.few:
            return found.orderBy(F.desc("score"), F.asc("doc_id")).offset(skip).limit(size)
        # ranges of ranks; places within a range plus the counts of those before it
        n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spark, path = found.sparkSession, f"{shared_dir(found.sparkSession)}/quillon-page-{uuid.uuid4().hex}"
        # written, as the ranges must be the same for both readers, also after a lost executor
        found.repartitionByRange(n, F.desc("score"), F.asc("doc_id")).withColumn("part", F.spark_partition_id()).write.parquet(path)
        held = spark.read.parquet(path)
        before, start = 0, {}
        for row in held.groupBy("part").count().orderBy("part").collect():  # a row for each range
            start[row["part"]] = before
            before += row["count"]
        wanted = {p: s for p, s in start.items() if s < skip + size}
        if not wanted:
            return held.limit(0).drop("part")
        first = F.create_map(*[F.lit(x) for p, s in wanted.items() for x in (p, s)])
        place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), F.asc("doc_id"))) + first[F.col("part")]
        return held.filter(F.col("part").isin(list(wanted))).withColumn("place", place).filter((F.col("place") > skip) & (F.col("place") <= skip + size)).drop("part", "place")

    def try_search(self, request: SearchRequest | str) -> tuple[DataFrame | None, str | None]:
        """(hits, None) or (None, what is wrong with the request)."""
        try:
            return self.search(request), None
        except SearchError as e:
            return None, str(e)


def instant_search(index: SearchIndex, query: str, size: int = 10, skip: int = 0, highlight: list[str] | None = None, fields: list[str] | None = None) -> DataFrame | None:
    """Search as one types: the last term also matches what it begins, all stored fields come
    along, marks are for a browser. None if the query cannot be answered yet."""
    marks = Highlighter("<mark>", "</mark>", 150)
    return Searcher(index, highlighter=marks).try_search(SearchRequest(query, size, skip, highlight, fields, True))[0]


def matching(index: SearchIndex, query: str, **more) -> DataFrame:
    """The stored rows of all matches, with their scores."""
    return index.docs.join(Searcher(index, **more).scored(query), "doc_id")


__all__ = ["Searcher", "instant_search", "matching"]
