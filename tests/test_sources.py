import pytest
from pyspark.sql import functions as F

from quillon.model import Analyzer, Field, Schema, SearchError
from quillon.operators.index import build_index, numbered
from quillon.operators.search import Searcher
from quillon.sources.html import page_text, plain_text
from quillon.sources.paths import site_documents
from quillon.sources.scaladoc import documented, index_functions, parse_scaladoc, read_sources
from quillon.sources.store import load_index, save_index
from quillon.streaming.maintain import load_maintained, maintain_index


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Two mice", "Potter"), (3, "two fish", "Dr. Seuss")], "doc_id int, title string, author string")
    low = Analyzer(True)
    index = build_index(rows, Schema.of(Field("title", low), Field("author", low, positions=False)))
    save_index(index, str(tmp_path / "ix"))
    again = load_index(spark, str(tmp_path / "ix"), expect={"title": "positional", "author": "frequency"})
    assert [r["doc_id"] for r in Searcher(again).search("Two AND author:seuss").collect()] == [3]
    assert again.schema == index.schema and again.num_docs == 2
    with pytest.raises(SearchError):
        load_index(spark, str(tmp_path / "ix"), expect={"author": "positional"})
    plan = again.postings_for("title", "two")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "EqualTo(term,two)" in plan
    plan = lambda q: Searcher(again).scored(q)._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan("two AND NOT mi*") and "StringStartsWith(term,mi)" in plan("mi*")
    assert plan("two OR fish").count("Exchange") == 1 and "Join" not in plan("two OR fish") and "Join" in plan("NOT two")
    assert "TakeOrderedAndProject" in Searcher(again).search("two")._jdf.queryExecution().executedPlan().toString()


def test_streaming(spark, tmp_path):
    schema = Schema.of(Field("t", Analyzer(True)))
    src = tmp_path / "in"
    for part in ([(1, "red fish"), (2, "blue fish")], [(3, "Red eggs")]):
        spark.createDataFrame(part, "doc_id long, t string").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("doc_id long, t string").parquet(str(src))
        maintain_index(stream, schema, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    index = load_maintained(spark, schema, str(tmp_path / "ix"))
    assert index.num_docs == 3 and sorted(r["doc_id"] for r in Searcher(index).ids('"red fish" OR eggs').collect()) == [1, 3]
    assert index.frequencies({("t", "red")}) == {("t", "red"): 2}


def test_paths(spark):
    rows = spark.createDataFrame([("/one.md",), ("/two.md",), ("/cats/ziggy.md",), ("/cats/neeko.md",)], "path string").withColumn("title", F.lit(None).cast("string")).withColumn("body", F.lit("x"))
    kept = lambda *e: [r["path"] for r in site_documents(rows, list(e)).orderBy("path").collect()]
    assert kept("/one.md") == kept("/one") == ["cats/neeko", "cats/ziggy", "two"]
    assert kept("/cats") == ["one", "two"] and len(kept("/doesnt-exist.md")) == 4
    assert [r["title"] for r in site_documents(rows, ["/cats", "/two"]).collect()] == ["one"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<h1>The Title</h1><p>normal <b>bold</b> <i>italics</i> <code>code</code></p>", "The Title\nnormal bold italics code\n"),
        ("<table><caption>Cap</caption><tr><th>AAA</th><th>BBB</th></tr><tr><td>CCC</td><td>DDD</td></tr></table><p>Some more text</p>", "AAA\nBBB\nCCC\nDDD\nCap\n\nSome more text\n"),
        ('<p>AAA <img src="x" alt="Some Explanation" title="Tooltip Text"> CCC</p>', "AAA Some Explanation Tooltip Text CCC\n"),
        ("<nav><a>x</a></nav><p>a<!-- no --></p><script>var x</script>", "a\n"),
        ("<ul><li>Item 1</li><li>Item <em>em</em> 2</li></ul>", "Item 1\nItem em 2\n\n"),
        ("<dl><dt>term 1</dt><dd>aaa</dd></dl>", "term 1\naaa\n\n"),
        ("<blockquote><p>Paragraph 1</p><cite>an attribution</cite></blockquote>", "Paragraph 1\nan attribution\n\n"),
        ("<figure><img><figcaption>This is the <i>caption</i></figcaption></figure>", "This is the caption\n\n"),
        ("", ""), ("plain &amp; text", "plain & text\n"), ("<p>unclosed", "unclosed\n"),
    ],
)
def test_html(html, text):
    assert plain_text(html)[0] == text


def test_pages(spark):
    rows = spark.createDataFrame([(1, "<head><title>T  x</title></head><h1>H</h1>"), (2, None), (3, "<h1>H &lt;</h1>")], "page_id int, html string")
    assert [tuple(r) for r in page_text(rows).orderBy("page_id").collect()] == [(1, "H\n", "T x"), (2, None, None), (3, "H <\n", "H <")]


SOURCE = '''
object Main {
  /** Adds two numbers,
    * both whole.
    * @param a The first
    * @param b The second
    * @tparam T A type
    */
  @deprecated("Use add", "1.0")
  def plus[T](a: Int, b: Int = 1): Int = a + b

  def twice(xs: List[(Int, Int)], f: Int => Int)(implicit ord: Ordering[Int]): List[Int] = {
    xs.map(x => f(x._1))
  }
  private def show(s: String) { println("def no(x)") }
}
'''


def test_scaladoc(spark, tmp_path):
    plus, twice, show = parse_scaladoc(SOURCE)
    assert plus == ("plus", "Adds two numbers, both whole.", ['@deprecated("Use add", "1.0")'], ["T: A type", "a: The first: Int", "b: The second: Int (Optional)"], "Int", 8, 9)
    assert twice[0] == "twice" and twice[1] == plus[1] and twice[3] == ["xs: List[(Int, Int)]", "f: Int => Int", "ord: Ordering[Int] (Implicit)"] and twice[4:] == ("List[Int]", 11, 13)
    assert show[0] == "show" and show[4:] == ("Unit", 14, 14)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "Main.scala").write_text(SOURCE)
    (tmp_path / "other.txt").write_text(SOURCE)
    rows = numbered(documented(read_sources(spark, str(tmp_path))), "start_line").cache()
    assert [r["name"] for r in rows.orderBy("doc_id").collect()] == ["plus", "twice", "show"]
    assert [r["doc_id"] for r in Searcher(index_functions(rows)).search("description:numbers, AND returnType:Int").collect()] == [1]
    assert documented(rows.select(F.lit(None).cast("string").alias("source"))).count() == 0


VARIED = '''
class Many(val a: Int) {
  /** Sums up. */
  def total: Int =
    xs
      .map(f)
      .sum

  def pick(b: Boolean): String =
    if (b) "y{"
    else "n"

  def name = "x"
  def quote = '"'
  def this() = this(1)
  def ::(x: Int): Int = x; def +(y: Int) = y
  def a_=(x: Int): Unit = { a = x }
  def `back quoted`(s: String = """a
b)"""): String = s
  def later: Int
  /** Not a def { */
  @inline
  final def tagged[A, B](a: A)(implicit b: B): (A, B) = (
    a,
    b
  )
  def text = """two
lines"""
  def last = 1
}
'''


def test_scaladoc_of_varied_sources():
    got = {r[0]: r for r in parse_scaladoc(VARIED)}
    assert list(got) == ["total", "pick", "name", "quote", "::", "+", "a_=", "back quoted", "tagged", "text", "last"]
    lines = {k: r[5:] for k, r in got.items()}
    assert lines == {"total": (3, 6), "pick": (8, 10), "name": (12, 12), "quote": (13, 13), "::": (15, 15), "+": (15, 15), "a_=": (16, 16), "back quoted": (17, 18), "tagged": (21, 25), "text": (26, 27), "last": (28, 28)}
    assert got["pick"][1] == "Sums up." and got["tagged"][1] == "Not a def {" and got["tagged"][2] == ["@inline"]
    assert got["tagged"][3:5] == (["A", "B", "a: A", "b: B (Implicit)"], "(A, B)")
    assert got["back quoted"][3] == ["s: String (Optional)"] and got["name"][4] == "Unit" and got["::"][3:5] == (["x: Int"], "Int")


@pytest.mark.parametrize(
    "html, text, title",
    [
        ("<head><title>a&amp;&amp</title></head><p>b&amp;&amp<br>&quot;c&quot d&copy &copy;</p>", 'b&&amp\n"c&quot d&copy ©\n', "a&&amp"),
        ("<p>&#65;&#66 &#x43;&#x44 &ampx; &notit; &lt;&lt x&y &</p>", "A&#66 C&#x44 &ampx; &notit; <&lt x&y &\n", None),
        ('<p>&amp<img alt="a&amp;b&amp" title="&lt;"></p>', "&ampa&b&amp <\n", None),
    ],
)
def test_references_that_are_cut_off_stay(html, text, title):
    assert plain_text(html) == (text, title)


def test_html_text_equals_its_sql_where_references_are_cut_off(spark, tmp_path):
    import duckdb

    from quillon import queries

    page = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><article><h1>{0}</h1><p>x &amp; y.</p></article></body></html>'
    rows = [(i, f"http://example.org/{i}", page.format(t)) for i, t in enumerate(["a &amp;&amp;", "a &amp;&amp", "a &amp;&am", "a &amp;&", "a &quot;&quot"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, queries.html_text(spark, str(tmp_path)).collect())) == sorted(con.execute(queries.ORACLES["html_text"]).fetchall())
