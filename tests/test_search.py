"""Fixture expectations of the search engine, and random trees against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.analysis import tokenize, tokens_of
from quillon.functions.highlight import formatted, Highlighter, format_fragment
from quillon.functions.render import card
from quillon.functions.score import no_score, term_frequency
from quillon.model import Analyzer, Field, Schema, SearchError, SearchRequest
from quillon.operators.index import build_index, numbered
from quillon.operators.search import Searcher, instant_search, matching
from quillon.plans import ast
from quillon.plans.parser import parse
from quillon.plans.rewrite import last_term_as_prefix

BOOKS = [
    (1, "The Tale of Peter Rabbit", "Beatrix Potter"),
    (2, "The Tale of Two Bad Mice", "Beatrix Potter"),
    (3, "One Fish, Two Fish, Red Fish, Blue Fish", "Dr. Seuss"),
    (4, "Green Eggs and Ham", "Dr. Seuss"),
]
CATS = [
    (1, "the quick brown fox jumped over the lazy cat".split(" ")),
    (2, "the very fast cat jumped across the room".split(" ")),
    (3, "a lazy cat sleeps all day".split(" ")),
]
LOW = Analyzer.default().with_lower_casing()


@pytest.fixture(scope="module")
def books(spark):
    df = spark.createDataFrame(BOOKS, "doc_id int, title string, author string")
    return build_index(df, Schema.of(Field("title", LOW), Field("author", LOW, positions=False))).cached()


@pytest.fixture(scope="module")
def plain_books(spark):
    df = spark.createDataFrame(BOOKS, "doc_id int, title string, author string")
    return build_index(df, Schema.of(Field("title"), Field("author", positions=False))).cached()


def cats(spark, positions):
    return build_index(spark.createDataFrame(CATS, "doc_id int, words array<string>"), Schema.of(Field("words", positions=positions, stored=False))).cached()


@pytest.fixture(scope="module")
def cat_positions(spark):
    return cats(spark, True)


@pytest.fixture(scope="module")
def cat_counts(spark):
    return cats(spark, False)


def ids(index, query, **more):
    return sorted(r["doc_id"] for r in Searcher(index, **more).ids(query).collect())


@pytest.mark.parametrize(
    "query, expected",
    [
        ("Bad", [2]), ("bad", [2]), ("two AND author:Seuss", [3]), ("title:two AND author:Seuss", [3]),
        ("TWO AND NOT author:[r TO t]", [2]), ("TWO AND author:[a TO e]", [2, 3]), ("two author:[a TO c]", [1, 2, 3]),
        ("two OR author:[a TO c]", [1, 2, 3]), ("tale OR two", [1, 2, 3]), ("author:(potter seuss)", [1, 2, 3, 4]),
        ("author:(potter seuss) AND NOT eggs", [1, 2, 3]), ("(eggs AND ham AND author:(potter SEUSS))", [4]),
        ('"Eggs"', [4]), ('"eggs"', [4]), ('"Green Eggs"', [4]), ("/e(r|e)/", [1, 4]), ("NOT tale", [3, 4]),
        ("(tale two eggs)@2", [2]), ("NOT NOT tale", [1, 2]), ("tale OR NOT two", [1, 2, 4]), ("fish^3", [3]), ("title:[z TO a]", []),
    ],
)
def test_books(books, query, expected):
    assert ids(books, query) == expected


@pytest.mark.parametrize(
    "query, message",
    [
        ("/[a/", "Invalid regex query TermRegex([a)"),
        ('"fakeword"', "Some terms in phrase 'Phrase(fakeword)' could not be found in index"),
        ('author:"dr."', "Index does not support phrase queries"),
        ("[* TO b]", "Unsupported TermRange error?"),
        ("nope:x", "Unsupported field: 'nope'"),
        ("author:(title:x)", "Unsupported nested field query: Field(title,Term(x))"),
        ("x~1", "Unsupported query: Fuzzy(x,1)"),
        ('"a b"~2', "Unsupported query: Proximity(a b,2)"),
        ("b?d", "Unsupported query: WildCard(b?d)"),
        ("+x", "Unsupported query: UnaryPlus(Term(x))"),
    ],
)
def test_errors(books, query, message):
    assert Searcher(books).try_search(query) == (None, message)


@pytest.mark.parametrize("query", ["", "  ", "(", "/jump.*", "(a b)@0", "a)", "[a b]"])
def test_unparsable(query):
    with pytest.raises(SearchError):
        parse(query)


def test_projection_errors(books):
    search = Searcher(books).try_search
    assert search(SearchRequest("bad", highlight_fields=["fakefield"]))[1] == "Highlights not stored in index: 'fakefield'."
    both = SearchRequest("bad", result_fields=["fakefield1", "fakefield2"], highlight_fields=["fakefield"])
    assert search(both)[1] == "Fields not stored in index: 'fakefield1, fakefield2'. Highlights not stored in index: 'fakefield'."
    assert search(SearchRequest("bad", size=-1))[1]


def test_paging(books):
    s = Searcher(books)
    q = "author:(potter seuss)"
    for size, skip, n in [(0, 0, 0), (1, 0, 1), (3, 0, 3), (1000, 0, 4), (1000, 3, 1), (10, 9, 0)]:
        assert s.search(SearchRequest(q, size, skip)).count() == n


def test_stored_fields(books):
    (hit,) = Searcher(books).search(SearchRequest("Bad", result_fields=None)).collect()
    assert hit["fields"] == {"title": BOOKS[1][1], "author": BOOKS[1][2]} and hit["highlights"] == {}
    (hit,) = Searcher(books).search(SearchRequest("Bad", highlight_fields=["title"])).collect()
    assert hit["highlights"] == {"title": "The Tale of Two <b>Bad</b> Mice"} and hit["fields"] == {}
    assert matching(books, "Bad").count() == 1


def test_ranking(plain_books):
    ranked = lambda q: [(r["doc_id"], round(r["score"], 6)) for r in Searcher(plain_books).search(q).collect()]
    assert ranked("Bad") == [(2, 1.328272)]
    assert ranked("XYZ") == []
    assert [d for d, _ in ranked("Tale OR Two")] == [2, 1, 3]
    assert ranked("T*") == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert ranked('"Two Bad Mice"') == [(2, 1.0)]
    assert dict(ranked("Two OR author:Seuss"))[3] > dict(ranked("Two"))[3]
    assert dict(ranked("Bad^2"))[2] == pytest.approx(2.656543, abs=1e-5)
    assert dict(ranked("Bad AND NOT Eggs"))[2] == pytest.approx(1.328272, abs=1e-5)
    assert dict(ranked("(Bad AND Eggs) OR Two"))[3] == dict(ranked("Two"))[3]


def test_scorers(plain_books):
    assert Searcher(plain_books, no_score).search("Tale").collect()[0]["score"] == 0.0
    assert [r["score"] for r in Searcher(plain_books, term_frequency).search("Fish,").collect()] == [3.0]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("fast", [2]), ("fast cat", [1, 2, 3]), ("the OR fast OR cat", [1, 2, 3]), ("[a TO z]", [1, 2, 3]), ("fast AND cat", [2]),
        ("cat AND (fast OR quick)", [1, 2]), ("cat AND NOT fast", [1, 3]), ("f*", [1, 2]), ("sleeps*", [3]), ("/jump.*/ /cat/", [1, 2, 3]), ("/f(o|a)/", [1, 2]),
    ],
)
def test_cats(cat_counts, cat_positions, query, expected):
    assert ids(cat_counts, query) == expected and ids(cat_positions, query) == expected


@pytest.mark.parametrize(
    "phrase, expected",
    [
        ("a", [3]), ("day", [3]), ("sleeps all day", [3]), ("the quick brown", [1]), ("very", [2]), ("very fast", [2]),
        ("the very fast cat jumped across the room", [2]), ("lazy cat", [1, 3]), ("sleeps day", []), ("the cat", []),
    ],
)
def test_phrases(cat_counts, cat_positions, phrase, expected):
    assert ids(cat_positions, f'"{phrase}"') == expected
    with pytest.raises(SearchError, match="does not support phrase"):
        ids(cat_counts, f'"{phrase}"')


def test_dictionary(cat_positions):
    d = cat_positions
    assert [r["term"] for r in d.terms_for_prefix("words", "f").collect()] == ["fast", "fox"]
    assert [r["term"] for r in d.terms_for_prefix("words", "x").collect()] == []
    assert [r["term"] for r in d.terms_for_range("words", "a", "c").collect()] == ["a", "across", "all", "brown"]
    assert [r["term"] for r in d.terms_for_regex("words", "^r|y$").collect()] == ["day", "lazy", "room", "very"]
    assert d.term_index("words", "across") == 1 and d.num_terms("words") == 16
    assert [(r["doc_id"], r["tf"], r["positions"]) for r in d.postings_for("words", "the").orderBy("doc_id").collect()] == [(1, 2, [0, 6]), (2, 2, [0, 6])]


def test_last_term():
    f = ast.Term("f")
    both = ast.Group(ast.Or((f, ast.Prefix("f"))))
    assert last_term_as_prefix(parse("f")) == both
    assert last_term_as_prefix(parse("fn:f")) == ast.FieldQuery("fn", both)
    assert last_term_as_prefix(parse("first OR f")) == ast.Or((ast.Term("first"), both))


def test_instant(books):
    assert [(r["doc_id"], r["fields"]["author"]) for r in instant_search(books, "gre").collect()] == [(4, "Dr. Seuss")]
    assert instant_search(books, "(") is None


LONG = "Contents: A letter to cat\n" + " ".join(["hello cat,"] * 100) + " world"


@pytest.mark.parametrize(
    "text, query, expected",
    [
        ("hello world", "cat", "hello world"), ("hello world", "world", "hello <b>world</b>"), ("hello world", "world ", "hello <b>world</b>"),
        ("hello world", " world", "hello <b>world</b>"), ("hello world", "WoRlD", "hello <b>world</b>"), ("hello world", "h", "<b>h</b>ello world"),
        ("hello world", "d", "hello worl<b>d</b>"), ("hello world", "hello world", "<b>hello world</b>"),
        ("hello world, you, nice world, you", "world", "hello <b>world</b>, you, nice world, you"),
        (LONG, "Contents", "<b>Contents</b>: A letter to cat\nhello cat, hello cat, hello cat, h..."),
        (LONG, "cat", "Contents: A letter to <b>cat</b>\nhello cat, hello cat, hello cat, h..."),
        (LONG, "world", "cat, hello cat, hello cat, <b>world</b>"), (LONG, "d", "hello cat, hello cat, worl<b>d</b>"), (LONG, "fake", LONG[:67] + "..."),
    ],
)
def test_highlights(spark, text, query, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(Highlighter(max_size=60).column(F.col("t"), query)).first()[0] == expected


def test_fragments():
    assert format_fragment("hello world", [0, 5, 6, 5]) == "<b>hello</b> <b>world</b>"
    with pytest.raises(ValueError):
        format_fragment("hello world", [6, 6])
    with pytest.raises(AssertionError):
        format_fragment("hello world", [6])


@pytest.mark.parametrize("text, tokens", [("", [""]), ("   ", []), (" a b ", ["", "a", "b"]), ("a\x0bb c", ["a", "b c"]), ("a\n\nb\t", ["a", "b"]), ("É x", ["É", "x"])])
def test_tokens(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"))).first()[0] == tokens
    assert tokens_of(text) == tokens


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id int, t string")
    index = build_index(rows, Schema.of(Field("t")))
    assert index.num_docs == 3 and ids(index, "NOT a") == [1, 2] and ids(index, "a") == [3]
    empty = build_index(rows.limit(0), Schema.of(Field("t")))
    assert ids(empty, "a OR NOT b") == []
    with pytest.raises(SearchError):
        build_index(rows, Schema.of(Field("doc_id")))


def test_numbered(spark):
    assert [tuple(r) for r in numbered(spark.createDataFrame([("b",), ("a",)], "t string"), "t").orderBy("doc_id").collect()] == [("a", 1), ("b", 2)]


def test_strict_ranges(plain_books):
    assert ids(plain_books, "author:[Dr. TO Potter]") == [3, 4]
    assert ids(plain_books, "author:[Dr. TO Potter]", strict_ranges=True) == [1, 2, 3, 4]


# ---- random trees against sets


def _random(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        kind = rng.randrange(4)
        letters = "abcd"
        if kind == 0:
            return ast.Term(rng.choice(letters))
        if kind == 1:
            return ast.Phrase(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))))
        if kind == 2:
            lo, hi = sorted(rng.sample("abcde", 2))
            return ast.TermRange(lo, hi)
        return ast.Prefix(rng.choice(letters))
    kind = rng.randrange(4)
    parts = tuple(_random(rng, depth - 1) for _ in range(rng.randint(2, 3)))
    if kind == 0:
        return ast.And(parts)
    if kind == 1:
        return ast.Or(parts)
    if kind == 2:
        return ast.MinimumMatch(parts, rng.randint(1, 2))
    return ast.Not(parts[0])


def _matches(q, words):
    if isinstance(q, ast.Term):
        return q.text in words
    if isinstance(q, ast.Phrase):
        p = q.text.split(" ")
        return any(words[i : i + len(p)] == p for i in range(len(words)))
    if isinstance(q, ast.TermRange):
        return any(q.low <= w < q.high for w in words)
    if isinstance(q, ast.Prefix):
        return any(w.startswith(q.text) for w in words)
    if isinstance(q, ast.Not):
        return not _matches(q.part, words)
    got = [_matches(p, words) for p in q.parts]
    return all(got) if isinstance(q, ast.And) else sum(got) >= (q.least if isinstance(q, ast.MinimumMatch) else 1)


def test_random_trees(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 7))]) for i in range(40)] + [(40, list("abc"))]
    index = build_index(spark.createDataFrame(docs, "doc_id int, t array<string>"), Schema.of(Field("t", stored=False))).cached()
    for _ in range(25):
        q = _random(rng, 2)
        assert ids(index, q) == [i for i, w in docs if _matches(q, w)], str(q)


def test_card(spark):
    row = spark.createDataFrame([('a < "b"', "/x?a&b", "1 > <b>0</b>")], "t string, l string, f string")
    assert row.select(card(F.col("t"), F.col("l"), F.col("f"))).first()[0] == '<article><h3><a href="/x?a&amp;b">a &lt; &quot;b&quot;</a></h3><p>1 &gt; <b>0</b></p></article>'


def test_pages_of_many_hits(spark):
    """Pages ranked in ranges equal those of the driver's sort, wherever they begin and end."""
    rows = spark.createDataFrame([(i, "a " * (i % 7 + 1) + ("b" if i % 3 else "c")) for i in range(200)], "doc_id long, t string")
    index = build_index(rows, Schema.of(Field("t")))
    for skip, size in ((0, 10), (5, 40), (60, 200), (199, 5), (200, 5), (0, 0)):
        want = Searcher(index).search(SearchRequest("a b", size, skip)).select("doc_id", "score").collect()
        assert sorted(Searcher(index, few=3).search(SearchRequest("a b", size, skip)).select("doc_id", "score").collect()) == sorted(want)


def test_formatted_columns(spark):
    df = spark.createDataFrame([("hello world", [0, 5, 6, 5]), ("hello", []), (None, [0, 1]), ("x", None), ("abc", [0, 1, 1, 1]), ("abc", [3, 0])], "t string, o array<int>")
    assert [r[0] for r in df.select(formatted(F.col("t"), F.col("o"))).collect()] == ["<b>hello</b> <b>world</b>", "hello", None, None, "<b>a</b><b>b</b>c", "abc<b></b>"]
    for bad in ([0], [2, 3], [1, 1, 0, 1], [0, -1]):
        with pytest.raises(Exception, match="offset"):
            spark.createDataFrame([("abc", bad)], "t string, o array<int>").select(formatted(F.col("t"), F.col("o"))).collect()
