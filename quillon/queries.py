"""The search engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.highlight import Highlighter, formatted
from quillon.functions.render import card, function_card
from quillon.functions.score import no_score, term_frequency
from quillon.model import Analyzer, Field, Schema, SearchRequest
from quillon.operators.index import SearchIndex, build_index, numbered
from quillon.operators.search import Searcher, instant_search
from quillon.plans import ast
from quillon.sources.folders import shared_dir
from quillon.sources.html import page_text
from quillon.sources.paths import excluded, normal_path, title_or_name, url_path
from quillon.sources.scaladoc import documented, index_functions, read_sources
from quillon.sources.store import load_index, save_index

Run = Callable[[SparkSession, str], DataFrame]

LOW = Analyzer(lower_case=True)
DOCUMENTS = Schema.of(Field("text", LOW), Field("lang", LOW, positions=False), Field("source", LOW, positions=False))
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

#: Tokens of documents.text, their counts, and the number of documents.
TOKENS = r"""
tok AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT doc_id, string_split_regex(regexp_replace(lower(text), '[ \t\n\v\f\r]+$', ''), '[ \t\n\v\f\r]+') AS l FROM documents)),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return build_index(table(spark, sf_dir, "documents"), DOCUMENTS)


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round(F.col("score").cast("double"), 3))


def _term_score(term: str) -> str:
    """(doc_id, s) of one term's TF-IDF, as a subquery."""
    return f"(SELECT doc_id, CAST(ln(1 + tf) * (ln((n + 1.0) / (df + 1.0)) + 1) AS FLOAT) AS s FROM tf JOIN df USING (term), n WHERE term = '{term}')"


def _sum(terms: list[str]) -> str:
    """doc_id and the sum of the terms' scores, of documents with any of them."""
    joins = " ".join(f"LEFT JOIN {_term_score(t)} t{i} USING (doc_id)" for i, t in enumerate(terms))
    total = " + ".join(f"coalesce(t{i}.s, CAST(0 AS FLOAT))" for i in range(len(terms)))
    some = " OR ".join(f"t{i}.s IS NOT NULL" for i in range(len(terms)))
    return f"SELECT doc_id, {total} AS score FROM documents {joins} WHERE {some}"


def _page(terms: list[str], size: int, skip: int = 0) -> str:
    return f"WITH {TOKENS} SELECT doc_id, round(CAST(score AS DOUBLE), 3) AS score FROM ({_sum(terms)}) ORDER BY score DESC, doc_id LIMIT {size} OFFSET {skip}"


def _register(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _ids(name: str, query: str | ast.Query, sql: str) -> None:
    _register(name, lambda s, d: Searcher(documents_index(s, d)).ids(query), f"WITH {TOKENS} {sql}")


def _has(what: str) -> str:
    return f"SELECT doc_id FROM tok WHERE {what}"


_DOCS = "SELECT doc_id FROM documents"
_in = lambda *terms: _has(f"term IN ({', '.join(repr(t) for t in terms)})")


# ---- leaves

_ids("term_ids", "That", f"SELECT DISTINCT doc_id FROM ({_in('that')})")
_ids("prefix_ids", "thes*", f"SELECT DISTINCT doc_id FROM ({_has('''starts_with(term, 'thes')''')})")
_ids("range_ids", "[tho TO thr]", f"SELECT DISTINCT doc_id FROM ({_has('''term >= 'tho' AND term < 'thr' ''')})")
_ids("regex_ids", "/^w(as|ith)(er|an)/", f"SELECT DISTINCT doc_id FROM ({_has('''regexp_matches(term, '^w(as|ith)(er|an)')''')})")
_ids("phrase_ids", '"of the"', "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
_ids("phrase_three", '"the and attion"', "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'the' AND b.term = 'and' AND c.term = 'attion'")
_ids("phrase_repeated", '"the the"', "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'the' AND b.term = 'the'")
_ids("phrase_one_term", '"that"', f"SELECT DISTINCT doc_id FROM ({_in('that')})")
_ids("missing_term", "qqqqq", f"SELECT DISTINCT doc_id FROM ({_in('qqqqq')})")
_ids("empty_range", "[z TO a]", "SELECT doc_id FROM documents WHERE false")

# ---- combinators

_ids("and_", "that AND with", f"{_in('that')} INTERSECT {_in('with')}")
_ids("or_", "oder OR les", f"{_in('oder')} UNION {_in('les')}")
_ids("implicit_or", "und les", f"{_in('und')} UNION {_in('les')}")
_ids("and_not", "that AND NOT with", f"{_in('that')} EXCEPT {_in('with')}")
_ids("not_only", "NOT the", f"{_DOCS} EXCEPT {_in('the')}")
_ids("not_not", "NOT NOT les", f"SELECT DISTINCT doc_id FROM ({_in('les')})")
_ids("or_not", "les OR NOT the", f"{_in('les')} UNION ({_DOCS} EXCEPT {_in('the')})")
_ids("nested_groups", "(that AND (with OR was)) OR (les AND NOT des)", f"({_in('that')} INTERSECT ({_in('with')} UNION {_in('was')})) UNION ({_in('les')} EXCEPT {_in('des')})")
_ids("min_match_2of3", "(that with was)@2", f"SELECT doc_id FROM ({_in('that', 'with', 'was')}) JOIN (SELECT doc_id, count(DISTINCT term) AS k FROM tok WHERE term IN ('that', 'with', 'was') GROUP BY doc_id) USING (doc_id) WHERE k >= 2 GROUP BY doc_id")
_ids("no_match", ast.NoMatch(), "SELECT doc_id FROM documents WHERE false")
_ids("field_term", "lang:de", "SELECT doc_id FROM documents WHERE lang = 'de'")
_ids("field_group", "source:(src1 src2)", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
_ids("field_range", "source:[src1 TO src2]", "SELECT doc_id FROM documents WHERE source >= 'src1' AND source < 'src2'")
_ids("field_not", "lang:(NOT en)", "SELECT doc_id FROM documents WHERE lang <> 'en'")
_ids("cross_field_and", "that AND source:src3 AND NOT lang:fr", f"SELECT DISTINCT doc_id FROM ({_in('that')}) JOIN documents USING (doc_id) WHERE source = 'src3' AND lang <> 'fr'")

# ---- scores, ranking, pages


def _search(name: str, request: SearchRequest, sql: str, **more) -> None:
    _register(name, lambda s, d: _scored(Searcher(documents_index(s, d), **more).search(request)).select("doc_id", "score"), sql)


_search("term_topk", SearchRequest("Oneand"), _page(["oneand"], 10))
_search("or_topk", SearchRequest("that with was", 20), _page(["that", "with", "was"], 20))
_search("page_skip", SearchRequest("that with was", 15, 30), _page(["that", "with", "was"], 15, 30))
_register("scored_all", lambda s, d: _scored(Searcher(documents_index(s, d)).scored("that with")), f"WITH {TOKENS} SELECT doc_id, round(CAST(score AS DOUBLE), 3) AS score FROM ({_sum(['that', 'with'])})")
_register(
    "and_scored",
    lambda s, d: _scored(Searcher(documents_index(s, d)).scored("that AND with")),
    f"WITH {TOKENS} SELECT doc_id, round(CAST(a.s + b.s AS DOUBLE), 3) AS score FROM {_term_score('that')} a JOIN {_term_score('with')} b USING (doc_id)",
)
_register(
    "boosted_or",
    lambda s, d: _scored(Searcher(documents_index(s, d)).scored("that^2.5 OR with")),
    f"WITH {TOKENS} SELECT doc_id, round(CAST(coalesce(a.s * CAST(2.5 AS FLOAT), CAST(0 AS FLOAT)) + coalesce(b.s, CAST(0 AS FLOAT)) AS DOUBLE), 3) AS score FROM documents LEFT JOIN {_term_score('that')} a USING (doc_id) LEFT JOIN {_term_score('with')} b USING (doc_id) WHERE a.s IS NOT NULL OR b.s IS NOT NULL",
)
_register(
    "const_score_mix",
    lambda s, d: _scored(Searcher(documents_index(s, d)).scored("thes* OR that")),
    f"WITH {TOKENS} SELECT doc_id, round(CAST(CAST(p.doc_id IS NOT NULL AS FLOAT) + coalesce(a.s, CAST(0 AS FLOAT)) AS DOUBLE), 3) AS score FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT DISTINCT doc_id FROM tok WHERE starts_with(term, 'thes')) p USING (doc_id) LEFT JOIN {_term_score('that')} a USING (doc_id) WHERE p.doc_id IS NOT NULL OR a.s IS NOT NULL".replace("p.doc_id", "p.hit").replace("SELECT DISTINCT doc_id FROM tok WHERE starts", "SELECT DISTINCT doc_id, true AS hit FROM tok WHERE starts"),
)
_register("constant_score", lambda s, d: _scored(Searcher(documents_index(s, d)).scored(ast.ConstantScore(ast.Term("that"), 3.0))), f"WITH {TOKENS} SELECT DISTINCT doc_id, 3.0::DOUBLE AS score FROM tok WHERE term = 'that'")
_register("custom_scorer", lambda s, d: _scored(Searcher(documents_index(s, d), term_frequency).scored("that with")), f"WITH {TOKENS} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM tf WHERE term IN ('that', 'with') GROUP BY doc_id")
_register("no_score", lambda s, d: _scored(Searcher(documents_index(s, d), no_score).scored("that with")), f"WITH {TOKENS} SELECT DISTINCT doc_id, 0.0::DOUBLE AS score FROM tok WHERE term IN ('that', 'with')")
_register(
    "last_term_prefix",
    lambda s, d: _scored(Searcher(documents_index(s, d)).scored("with thes", last_term_prefix=True)).select("doc_id"),
    f"WITH {TOKENS} {_in('with')} UNION {_has('''starts_with(term, 'thes')''')}",
)
_register(
    "not_scored",
    lambda s, d: _scored(Searcher(documents_index(s, d)).scored("that AND NOT thes*")),
    f"WITH {TOKENS} SELECT doc_id, round(CAST(s AS DOUBLE), 3) AS score FROM {_term_score('that')} WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE starts_with(term, 'thes'))",
)


def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = Searcher(documents_index(spark, sf_dir)).search(SearchRequest("that with was", 20, result_fields=["lang", "source"]))
    return hits.select("doc_id", F.col("fields")["lang"].alias("lang"), F.col("fields")["source"].alias("source"))


_register("stored_fields", stored_fields, f"WITH {TOKENS} SELECT doc_id, lang, source FROM ({_sum(['that', 'with', 'was'])}) JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20")


def highlight_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of every document with the phrase, which is near the front in some only."""
    found = Searcher(documents_index(spark, sf_dir)).ids('"of the"')
    docs = table(spark, sf_dir, "documents").join(found, "doc_id")
    return docs.select("doc_id", Highlighter().column(F.col("text"), "of the").alias("fragment"))


_register(
    "highlight_first_match",
    highlight_first_match,
    rf"""WITH {TOKENS},
hit AS (SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'),
o AS (SELECT doc_id, text, strpos(lower(text), 'of the') - 1 AS off, length(text) AS len FROM documents JOIN hit USING (doc_id)),
w AS (SELECT *, greatest(off - 50, 0) AS start FROM o),
e AS (SELECT *, regexp_extract(substr(text, start + 1), '^[^ \n\t.]*', 0) AS head FROM w),
b AS (SELECT *, CASE WHEN off < 0 OR start = 0 OR len < 100 THEN 0 WHEN start + length(head) > off THEN start ELSE start + length(head) END AS begin FROM e),
f AS (SELECT doc_id, CASE WHEN off < 0 THEN substr(text, begin + 1) ELSE substr(text, begin + 1, off - begin) || '<b>' || substr(text, off + 1, 6) || '</b>' || substr(text, off + 7) END AS full_text FROM b),
t AS (SELECT doc_id, regexp_replace(full_text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS full_text FROM f)
SELECT doc_id, CASE WHEN length(full_text) > 107 THEN substr(full_text, 1, 107) || '...' ELSE full_text END AS fragment FROM t""",
)


def instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instant_search(documents_index(spark, sf_dir), "oneand thesa").select("doc_id", F.col("fields")["lang"].alias("lang"), F.length(F.col("highlights")["text"]).alias("shown"))




def _fragment(column: str, needle: str, size: int = 100, before: str = "<b>", after: str = "</b>") -> str:
    """The highlighter's fragment of a column, as an expression."""
    n, most = len(needle), size + len(before) + len(after)
    at = f"(strpos(lower({column}), '{needle}') - 1)"
    start = f"greatest({at} - {size // 2}, 0)"
    head = rf"length(regexp_extract(substr({column}, {start} + 1), '^[^ \n\t.]*', 0))"
    begin = f"(CASE WHEN {at} < 0 OR {start} = 0 OR length({column}) < {size} THEN 0 WHEN {start} + {head} > {at} THEN {start} ELSE {start} + {head} END)"
    marked = f"(CASE WHEN {at} < 0 THEN {column} ELSE substr({column}, {begin} + 1, {at} - {begin}) || '{before}' || substr({column}, {at} + 1, {n}) || '{after}' || substr({column}, {at} + {n + 1}) END)"
    trimmed = rf"regexp_replace({marked}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
    return f"(CASE WHEN length({trimmed}) > {most} THEN substr({trimmed}, 1, {most}) || '...' ELSE {trimmed} END)"


_register(
    "instant_search",
    instant,
    f"""WITH {TOKENS}, p AS (SELECT DISTINCT doc_id, CAST(1 AS FLOAT) AS s FROM tok WHERE starts_with(term, 'thesa')),
h AS (SELECT doc_id, coalesce(a.s, CAST(0 AS FLOAT)) + (coalesce(b.s, CAST(0 AS FLOAT)) + coalesce(p.s, CAST(0 AS FLOAT))) AS score
      FROM (SELECT doc_id FROM documents) LEFT JOIN {_term_score('oneand')} a USING (doc_id) LEFT JOIN {_term_score('thesa')} b USING (doc_id) LEFT JOIN p USING (doc_id)
      WHERE a.s IS NOT NULL OR b.s IS NOT NULL OR p.s IS NOT NULL ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, lang, CAST(length({_fragment('text', 'oneand thesa', 150, '<mark>', '</mark>')}) AS INTEGER) AS shown FROM h JOIN documents USING (doc_id)""",
)


def request_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page whose request names a field to return and another to highlight."""
    hits = Searcher(documents_index(spark, sf_dir)).search(SearchRequest("that", 40, 5, highlight_fields=["text"], result_fields=["lang"]))
    return hits.select("doc_id", F.col("fields")["lang"].alias("lang"), F.col("highlights")["text"].alias("fragment"))


_register(
    "request_highlights",
    request_highlights,
    f"WITH {TOKENS}, h AS ({_sum(['that'])} ORDER BY score DESC, doc_id LIMIT 40 OFFSET 5) SELECT doc_id, lang, {_fragment('text', 'that')} AS fragment FROM h JOIN documents USING (doc_id)",
)

#: Requests that cannot be answered, by what is wrong with them.
FAULTS = {
    "open range": (SearchRequest("[a TO *]"), "Unsupported TermRange error?"),
    "unknown field": (SearchRequest("nowhere:that"), "Unsupported field: 'nowhere'"),
    "nested field": (SearchRequest("lang:(source:src1)"), "Unsupported nested field query: Field(source,Term(src1))"),
    "missing phrase term": (SearchRequest('"that qqqqq"'), "Some terms in phrase 'Phrase(that qqqqq)' could not be found in index"),
    "phrase without positions": (SearchRequest('lang:"en de"'), "Index does not support phrase queries"),
    "pattern": (SearchRequest("/a(/"), "Invalid regex query TermRegex(a()"),
    "fuzzy": (SearchRequest("that~1"), "Unsupported query: Fuzzy(that,1)"),
    "fields": (SearchRequest("that", result_fields=["a", "lang"], highlight_fields=["b"]), "Fields not stored in index: 'a'. Highlights not stored in index: 'b'."),
    "size": (SearchRequest("that", -1), "size and skip must not be negative"),
}


def request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    searcher = Searcher(documents_index(spark, sf_dir))
    return spark.createDataFrame([(k, searcher.try_search(r)[1]) for k, (r, _) in FAULTS.items()], "fault string, message string")


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_register("request_faults", request_faults, "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(m)})" for k, (_, m) in FAULTS.items()) + ") t(fault, message)")

# ---- the index itself

_register("postings_build", lambda s, d: documents_index(s, d).postings.filter("field = 'text'").select("term", "doc_id", F.col("tf").cast("long").alias("tf")), f"WITH {TOKENS} SELECT term, doc_id, tf FROM tf")
_register("positions_build", lambda s, d: documents_index(s, d).postings.filter("field = 'text'").select("term", "doc_id", F.array_join("positions", ",").alias("positions")), f"WITH {TOKENS} SELECT term, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tok GROUP BY 1, 2")
_register("term_df", lambda s, d: documents_index(s, d).dictionary("text"), f"WITH {TOKENS} SELECT term, df FROM df")
_register("dict_prefix", lambda s, d: documents_index(s, d).terms_for_prefix("text", "wh"), f"WITH {TOKENS} SELECT term, df FROM df WHERE starts_with(term, 'wh')")
_register("dict_range", lambda s, d: documents_index(s, d).terms_for_range("text", "tho", "thr"), f"WITH {TOKENS} SELECT term, df FROM df WHERE term >= 'tho' AND term < 'thr'")
_register("dict_regex", lambda s, d: documents_index(s, d).terms_for_regex("text", "ou(r|t)$"), f"WITH {TOKENS} SELECT term, df FROM df WHERE regexp_matches(term, 'ou(r|t)$')")
_register("term_postings", lambda s, d: documents_index(s, d).postings_for("text", "that").select("doc_id", F.col("tf").cast("long").alias("tf"), F.element_at("positions", 1).alias("first_pos")), f"WITH {TOKENS} SELECT doc_id, count(*) AS tf, CAST(min(pos) AS INTEGER) AS first_pos FROM tok WHERE term = 'that' GROUP BY doc_id")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    own = index.postings.groupBy("field").agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))
    return own.withColumn("docs", F.lit(index.num_docs).cast("long"))


_one = lambda c: f"SELECT '{c}' AS field, count(DISTINCT {c}) AS terms, count(*) AS postings, CAST(count(*) AS BIGINT) AS tokens, count(*) AS docs FROM documents"
_register("index_stats", index_stats, f"WITH {TOKENS} SELECT 'text' AS field, count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, (SELECT n FROM n) AS docs FROM tf UNION ALL {_one('lang')} UNION ALL {_one('source')}")


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(Searcher(saved_index(spark, sf_dir)).search(SearchRequest("that with was", 20))).select("doc_id", "score")


_SAVED: dict[tuple[str, str], str] = {}


def saved_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of documents, saved by the first call of an application and loaded by every one."""
    own = spark.sparkContext.applicationId, sf_dir
    if own not in _SAVED:
        path = f"{shared_dir(spark)}/quillon-index-{uuid.uuid4().hex}"
        save_index(documents_index(spark, sf_dir), path)
        _SAVED[own] = path
    return load_index(spark, _SAVED[own], expect={"text": "positional", "lang": "frequency"})


_register("index_roundtrip", index_roundtrip, _page(["that", "with", "was"], 20))
for _name, _query in {"term_ids": "That", "prefix_ids": "thes*", "range_ids": "[tho TO thr]", "regex_ids": "/^w(as|ith)(er|an)/", "phrase_ids": '"of the"', "and_not": "that AND NOT with", "not_only": "NOT the", "cross_field_and": "that AND source:src3 AND NOT lang:fr"}.items():
    _register(f"saved_{_name}", lambda s, d, q=_query: Searcher(saved_index(s, d)).ids(q), ORACLES[_name])


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down, of more hits than are sent to the driver."""
    return _scored(Searcher(saved_index(spark, sf_dir), few=50).search(SearchRequest("that with was", 60, 45))).select("doc_id", "score")


_register("deep_page", deep_page, _page(["that", "with", "was"], 60, 45))


def dict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return spark.createDataFrame([(index.num_terms("text"), index.term_index("text", "that"), index.term_index("text", "thatt"))], "terms long, at long, would_be long")


_register("dict_numbers", dict_numbers, f"WITH {TOKENS} SELECT count(*) AS terms, count(*) FILTER (term < 'that') AS at, count(*) FILTER (term < 'thatt') AS would_be FROM df")


def tokens_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are tokens already, one with positions and one without."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.split("p_name", "e").alias("pieces"))
    index = build_index(rows, Schema.of(Field("words"), Field("pieces", positions=False)), "p_partkey")
    return index.postings.select("field", "term", F.col("doc_id").alias("p_partkey"), F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


_register(
    "tokens_index",
    tokens_index,
    """WITH w AS (SELECT p_partkey, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)),
e AS (SELECT p_partkey, unnest(string_split(p_name, 'e')) AS term FROM part)
SELECT 'words' AS field, term, p_partkey, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM w GROUP BY 2, 3
UNION ALL SELECT 'pieces', term, p_partkey, count(*), CAST(NULL AS VARCHAR) FROM e GROUP BY 2, 3""",
)

# ---- other tables


def part_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Schema.of(Field("p_name", LOW), Field("p_brand", positions=False))
    index = build_index(table(spark, sf_dir, "part"), names, "p_partkey")
    return Searcher(index).ids("p_brand:[Brand#1 TO Brand#3] AND NOT anvil").withColumnRenamed("doc_id", "p_partkey")


_register("part_name_search", part_name_search, r"SELECT DISTINCT p_partkey FROM (SELECT p_partkey, unnest(string_split_regex(p_brand, '[ \t\n\v\f\r]+')) AS t FROM part) WHERE t >= 'Brand#1' AND t < 'Brand#3' AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE list_contains(string_split_regex(lower(p_name), '[ \t\n\v\f\r]+'), 'anvil'))")


def conversation_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    index = build_index(rows, Schema.of(Field("text", LOW), Field("role", positions=False)), "key")
    return Searcher(index).ids('"of the" AND role:user').select("doc_id.conv_id", "doc_id.turn")


_register(
    "conversation_phrase",
    conversation_phrase,
    r"""WITH tok AS (SELECT conv_id, turn, role, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (
  SELECT conv_id, turn, role, string_split_regex(lower(text), '[ \t\n\v\f\r]+') AS l FROM conversations))
SELECT DISTINCT a.conv_id, a.turn FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos = a.pos + 1
WHERE a.term = 'of' AND b.term = 'the' AND a.role = 'user'""",
)

# ---- paths and extractors

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_BARE = rf"regexp_replace({_PATH}, '\.[^./]*$', '')"
_register("path_normalise", lambda s, d: table(s, d, "pages").select("page_id", normal_path(url_path(F.col("url"))).alias("path")), f"SELECT page_id, regexp_replace({_BARE}, '^/', '') AS path FROM pages")
_register(
    "path_exclude",
    lambda s, d: table(s, d, "pages").filter(~excluded(url_path(F.col("url")), ["/en", "/de.html", "/fr/1"])).select("page_id"),
    f"SELECT page_id FROM (SELECT page_id, {_BARE} AS p FROM pages) WHERE NOT (p = '/en' OR starts_with(p, '/en/') OR p = '/de' OR starts_with(p, '/de/') OR p = '/fr/1' OR starts_with(p, '/fr/1/'))",
)
_register(
    "title_fallback",
    lambda s, d: table(s, d, "pages").select("page_id", title_or_name(F.when(F.col("page_id") % 2 == 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)), normal_path(url_path(F.col("url")))).alias("title")),
    f"SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END, string_split(regexp_replace({_BARE}, '^/', ''), '/')[-1]) AS title FROM pages",
)


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages").select("page_id", "html"))


def html_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_text(table(spark, sf_dir, "pages")).withColumn("path", normal_path(url_path(F.col("url"))))
    index = build_index(rows, Schema.of(Field("body", LOW), Field("title", LOW), Field("path", positions=False)), "page_id")
    return _scored(Searcher(index).search(SearchRequest("that title:with", 25))).select("doc_id", "score")



#: Visible text of the pages, whose markup is regular, and their titles.
PAGES = r"""
plain AS (SELECT page_id, replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<nav>.*?</nav>|<!--.*?-->', '', 'g'), '\s+', ' ', 'g'),
      '</?(?:!DOCTYPE|html|body|div|article|h1|p|br|footer)[^>]*>', chr(10), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS t,
  replace(replace(regexp_replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '\s+', ' ', 'g'), '&quot;', '"'), '&amp;', '&') AS title FROM pages),
lines AS (SELECT page_id, title, list_filter(list_transform(string_split(regexp_replace(t, '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM plain),
shown AS (SELECT page_id, title, CASE WHEN len(l) = 0 THEN '' ELSE array_to_string(l, chr(10)) || chr(10) END AS body FROM lines)"""

_register("html_text", html_text, f"WITH {PAGES} SELECT page_id, body, title FROM shown")


def _field_score(field: str, term: str) -> str:
    tokens = rf"string_split_regex(regexp_replace(lower({field}), '[ \t\n\v\f\r]+$', ''), '[ \t\n\v\f\r]+')"
    return f"(SELECT page_id, len(list_filter({tokens}, lambda x: x = '{term}')) AS tf FROM shown WHERE list_contains({tokens}, '{term}'))"


_idf = lambda t: f"CAST(ln(1 + {t}.tf) * (ln(((SELECT count(*) FROM pages) + 1.0) / ((SELECT count(*) FROM {t}) + 1.0)) + 1) AS FLOAT)"
_register(
    "html_text_search",
    html_text_search,
    f"""WITH {PAGES}, a AS {_field_score('body', 'that')}, b AS {_field_score('title', 'with')}
SELECT page_id AS doc_id, round(CAST(coalesce({_idf('a')}, CAST(0 AS FLOAT)) + coalesce({_idf('b')}, CAST(0 AS FLOAT)) AS DOUBLE), 3) AS score
FROM pages LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id) WHERE a.tf IS NOT NULL OR b.tf IS NOT NULL ORDER BY score DESC, doc_id LIMIT 25""",
)


def scaladoc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources made of the benchmark's items as comments, by the documented function."""
    text = F.regexp_replace("text", r"[*/@\\\"]|\s+", " ")
    made = F.concat(F.lit("object Main {\n  /** "), text, F.lit("\n    * @param a first\n    */\n  def item"), F.col("item_id"), F.lit("(a: Int = 1): Long = {\n    a\n  }\n}\n"))
    return documented(table(spark, sf_dir, "benchmark").select("item_id", made.alias("source"))).select("item_id", "name", F.col("params")[0].alias("param"), "return_type", "start_line", "end_line")


_register("scaladoc_extract", scaladoc_extract, "SELECT item_id, 'item' || item_id AS name, 'a: first: Int (Optional)' AS param, 'Long' AS return_type, 4 AS start_line, 6 AS end_line FROM benchmark")


#: A source of several functions around an item's text: what has a comment, what inherits it, what none has.
_SOURCE = ("class Item {\n  def before = \"a(\"\n  /** ", "\n    * @param a first\n    * @tparam T kind\n    */\n  @inline def item", "[T](a: T, b: Int = 1)(implicit c: Ordering[T]): List[T] =\n    List(a)\n      .map(x => x)\n\n  def ::(x: Long): Unit = {\n    ()\n  }\n  def `not plain`(s: String) = s; def last = 2\n  def none: Int\n  def this() = this(1)\n}\n")


def scaladoc_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.trim(F.regexp_replace("text", r"[*/@\\\"]|\s+", " "))
    made = F.concat(F.lit(_SOURCE[0]), text, F.lit(_SOURCE[1]), F.col("item_id"), F.lit(_SOURCE[2]))
    got = documented(table(spark, sf_dir, "benchmark").select("item_id", made.alias("source")))
    return got.select("item_id", "name", "description", F.array_join("annotations", ";").alias("annotations"), F.array_join("params", ";").alias("params"), "return_type", "start_line", "end_line")


_register(
    "scaladoc_varied",
    scaladoc_varied,
    r"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '[*/@\\"]|\s+', ' ', 'g')) AS t FROM benchmark)
SELECT item_id, 'before' AS name, '' AS description, '' AS annotations, '' AS params, 'Unit' AS return_type, 1 AS start_line, 1 AS end_line FROM b
UNION ALL SELECT item_id, 'item' || item_id, t, '@inline', 'T: kind;a: first: T;b: Int (Optional);c: Ordering[T] (Implicit)', 'List[T]', 6, 8 FROM b
UNION ALL SELECT item_id, '::', t, '', 'x: Long', 'Unit', 10, 12 FROM b
UNION ALL SELECT item_id, 'not plain', t, '', 's: String', 'Unit', 13, 13 FROM b
UNION ALL SELECT item_id, 'last', t, '', '', 'Unit', 13, 13 FROM b""",
)


def scaladoc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources written as files, read by a pattern of names, indexed by function and searched."""
    folder = f"{shared_dir(spark)}/quillon-sources-{uuid.uuid4().hex}"
    line = F.concat(F.lit("/** Of "), F.lower("r_name"), F.lit(" */ def region"), F.col("r_regionkey").cast("string"), F.lit("(key: Int): Region = key"))
    table(spark, sf_dir, "region").select(line.alias("value")).write.text(folder)
    rows = numbered(documented(read_sources(spark, folder, "part-*.txt")), "name")
    hits = Searcher(index_functions(rows)).search(SearchRequest("returnType:Region AND description:(asia OR europe)", result_fields=["functionName", "params", "returnType", "description"]))
    shown = F.col("fields")
    return hits.select(shown["functionName"].alias("name"), function_card(shown["functionName"], shown["params"], shown["returnType"], shown["description"]).alias("card"))


_register(
    "scaladoc_files",
    scaladoc_files,
    "SELECT 'region' || r_regionkey AS name, '<article><h3><code>region' || r_regionkey || '(key: Int): Region</code></h3><p>Of ' || lower(r_name) || '</p></article>' AS card FROM region WHERE r_name IN ('ASIA', 'EUROPE')",
)


def fragment_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last word of each name wrapped, by offsets that come from the names."""
    first = F.instr("p_name", " ") - 1
    last = F.length(F.substring_index("p_name", " ", -1))
    offsets = F.array(F.lit(0), first, F.length("p_name") - last, last)
    return table(spark, sf_dir, "part").select("p_partkey", formatted(F.col("p_name"), F.when(first > 0, offsets).otherwise(F.expr("cast(array() as array<int>)")), "[", "]").alias("fragment"))


_register("fragment_format", fragment_format, "SELECT p_partkey, CASE WHEN strpos(p_name, ' ') > 1 THEN regexp_replace(regexp_replace(p_name, '([^ ]*)$', '[\\1]'), '^([^ ]*)', '[\\1]') ELSE p_name END AS fragment FROM part")


def hit_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("link"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    shown = Highlighter().column(F.col("title"), "the")
    return rows.select("page_id", card(F.col("title"), F.col("link"), shown).alias("card"))


_register(
    "hit_cards",
    hit_cards,
    """WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages),
o AS (SELECT *, strpos(lower(t), 'the') - 1 AS off, length(t) AS len FROM p),
w AS (SELECT *, greatest(off - 50, 0) AS start FROM o),
e AS (SELECT *, regexp_extract(substr(t, start + 1), '^[^ \\n\\t.]*', 0) AS head FROM w),
b AS (SELECT *, CASE WHEN off < 0 OR start = 0 OR len < 100 THEN 0 WHEN start + length(head) > off THEN start ELSE start + length(head) END AS begin FROM e),
f AS (SELECT page_id, url, t, CASE WHEN off < 0 THEN substr(t, begin + 1) ELSE substr(t, begin + 1, off - begin) || '<b>' || substr(t, off + 1, 3) || '</b>' || substr(t, off + 4) END AS s FROM b),
g AS (SELECT page_id, url, t, regexp_replace(s, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS s FROM f),
h AS (SELECT page_id, url, t, CASE WHEN length(s) > 107 THEN substr(s, 1, 107) || '...' ELSE s END AS s FROM g)
SELECT page_id, '<article><h3><a href="' || replace(url, '&', '&amp;') || '">' || replace(t, '&', '&amp;') || '</a></h3><p>' || replace(s, '&', '&amp;') || '</p></article>' AS card FROM h""",
)
