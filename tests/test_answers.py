"""Gold rows by their keys, arithmetic, items of feeds and services."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import arithmetic, gold
from quarry.sources import feeds

ARITHMETIC = {
    "1+2": "3", "2*-3": "-6", "-2*3=?": "-6", "(1+2)*3": "9", "1+2*3": "7", "2/3 = ?": "0.66666667", "--4": "4", "0.50+.5": "1", "1.+2": "3", "10-4-3": "3", "8/4/2": "1", "  5 ": "5", "-(2+3)": "-5", "2-(-3)": "5", "+ 4": "4", "((7))": "7", "0/5": "0",
    "100000000000*100000000000": "10000000000000000000000", "1/3": "0.33333333", "2*(3+4)-1": "13", "1/0": None, "1/(2-2)": None, "1 2": None, "1+": None, "(1": None, "1)": None, "()": None, "3(4)": None, "(3)(4)": None, "007+1": None, "2**3": None, "4//2": None, "1.2.3": None, "2*(3": None, ")1(": None, "abc": None, "?": None, "": None, "1+1+1+1+1": None, "*2": None, "2 = 3": None,
}


def test_arithmetic(spark):
    rows = spark.createDataFrame(list(enumerate([*ARITHMETIC, None])), "i int, q string").select("q", arithmetic.answer(F.col("q"), 3).alias("a")).collect()
    assert {r["q"]: r["a"] for r in rows} == ARITHMETIC | {None: None}


def test_the_eighth_place_is_rounded_by_the_exact_value(spark):
    """Half of the last place goes to the even digit: 512 parts end on the ninth place."""
    asked = ["1/512", "3/512", "10037/512", "-1/512", "100000001/10", "1/1280 + 0", "1-1/500000000", "1/700000000"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string").orderBy("i").select(arithmetic.answer(F.col("q"), 3).alias("a")).collect()
    assert [r["a"] for r in rows] == ["0.00195312", "0.00585938", "19.60351562", "-0.00195312", "10000000.1", "0.00078125", "1", "0"]


def test_quality_scores_round_as_in_sql(spark):
    """Halves of the sixth place: lines of k letters, the first with some more."""
    import duckdb

    from quarry import jobs
    from quarry.operators import corpus

    told = ["\n".join(["a" * (k + more), *["a" * k] * (n - 1)]) for k in (2, 22, 35, 39, 55, 63, 80, 91) for n in (4, 8) for more in range(n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(told)))
    found = corpus.extraction_quality(spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(jobs.oracle_sql()["extraction_quality"]).fetchall())


def test_operators_are_limited(spark):
    one = spark.range(1).select(arithmetic.answer(F.lit("1+2+3"), 1).alias("a"), arithmetic.answer(F.lit("1+2+3"), 2).alias("b")).first()
    assert tuple(one) == (None, "6")


RSS = '<?xml version="1.0"?><rss version="2.0" xmlns:media="http://x"><channel><title>Feed</title><item><title> A &amp; b </title><media:title>zz</media:title><link>http://a</link></item><item><title>B</title><description><![CDATA[<p>text b</p>]]></description><pubDate>Mon</pubDate></item><item><link>http://c</link></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>At</title><link rel="alternate" href="http://at"/><link href="http://second"/><summary>sum</summary><published>2024</published></entry><entry><title>Only</title></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="http://rdf"><item><title>R</title><link>http://r</link><description>d</description></item></rdf:RDF>'


def test_an_item_keeps_its_own_fields(spark):
    docs = [("rss", "http://f", RSS), ("atom", "http://g", ATOM), ("rdf", "h", RDF), ("bad", "i", "<rss><channel>"), ("none", "j", None), ("plain", "k", "plain")]
    found = feeds.feed_items(spark.createDataFrame(docs, "source string, url string, payload string")).collect()
    assert [(r["source"], r["at"], r["title"], r["url"], r["text"], r["published"]) for r in found] == [
        ("rss", 0, "A & b", "http://a", "A & b", None), ("rss", 1, "B", "http://f", "B: <p>text b</p>", "Mon"), ("rss", 2, None, "http://c", "", None),
        ("atom", 0, "At", "http://at", "At: sum", "2024"), ("atom", 1, "Only", "http://g", "Only", None), ("rdf", 0, "R", "http://r", "R: d", None),
    ]
    assert len({r["id"] for r in found}) == 6
    assert feeds.feed_items(spark.createDataFrame(docs, "source string, url string, payload string"), 1).count() == 3


def test_answers_of_services(spark):
    rows = spark.createDataFrame([("a", "u", '{"d":{"x":[1,"two",{"k":3}]}}'), ("b", "u", '{"d":{"x":5}}'), ("c", "u", "nope"), ("e", "u", '{"d":1}'), ("f", "u", None)], "source string, url string, payload string")
    assert [(r["source"], r["at"], r["text"]) for r in feeds.rest_items(rows, "d.x", "v={value}!").collect()] == [("a", 0, "v=1!"), ("a", 1, "v=two!"), ("a", 2, 'v={"k":3}!'), ("b", 0, "v=5!")]
    assert [r["source"] for r in feeds.rest_items(rows).collect()] == ["a", "b", "e"]
    pages = spark.createDataFrame([("s", "u", "<p>word</p>" + "x" * 5000)], "source string, url string, payload string")
    assert [len(feeds.scraped_items(pages, q).first()["text"]) for q in ("", "WORD", "none")] == [5005, 5005, 3000]


def _papers(spark):
    rows = [(1, "p1", "10.1/A", "", "Deep  Learning for Dense Prediction", "Some body text, First then second.", 4, 3), (2, "p2", "", "2001.1", "Deep Learning", "", 0, 0), (3, "p3", "10.1/b", None, None, "first", 2, 0), (4, "p4", "10.1/a", "2001.1", "ab", "second first", 1, 1)]
    return spark.createDataFrame(rows, "position int, paper_id string, doi string, arxiv_id string, title string, body string, pages int, full_pages int")


@pytest.mark.parametrize("row, paper", [
    (("p3", "10.1/a", None, None), "p3"), ((" p3 ", None, None, None), "p3"), ((None, " 10.1/A ", None, None), "p1"), (("other", None, "2001.1", None), "p2"), ((None, None, None, "deep learning"), "p1"), ((None, None, None, "LEARNING  for dense"), "p1"),
    ((None, None, None, "b"), None), ((None, None, None, "ab"), "p4"), ((None, None, None, "AB"), "p4"), ((None, None, None, "deep learning for dense prediction!"), None), ((None, "10.1/b", "2001.1", "dense"), "p1"), ((None, None, None, None), None), (("", "", "", " "), None), ((None, None, None, "p"), "p1"),
])
def test_papers_of_gold_rows(spark, row, paper):
    asked = spark.createDataFrame([(7, *row)], "gold_id int, paper_id string, doi string, arxiv_id string, title string")
    found = [r["paper_id"] for r in gold.matched(asked, _papers(spark)).collect()]
    if row[3] == "b":
        paper = "p4"  # the only title with a b
    assert found == ([paper] if paper else [])


def test_checks_and_their_summary(spark):
    kinds = [("1", None, None, "BODY  text", None, None, None), ("2", "ordered_contains", 2.0, None, ["first", " ", "second"], None, None), ("3", "ordered_contains", 1.0, None, ["second", "first"], None, None), ("4", "min_chars", 1.0, None, None, 35, None), ("5", "page_nonempty_ratio", 1.0, None, None, None, 0.75), ("6", "odd", 1.0, None, None, None, None), ("7", "contains", 1.0, "", None, None, None)]
    rows = [(1, "p1", kinds), (2, "p2", [kinds[4]]), (3, "gone", [kinds[0]]), (4, "p3", [])]
    asked = spark.createDataFrame([(i, p, "", "", "", c) for i, p, c in rows], f"gold_id int, paper_id string, doi string, arxiv_id string, title string, checks {gold.CHECKS}")
    made = gold.checked(asked, _papers(spark)).cache()
    found = {(r["gold_id"], r["check_id"]): (r["passed"], r["detail"]) for r in made.collect()}
    assert found == {
        (1, "1"): (True, "contains:BODY  text"), (1, "2"): (True, "ordered_contains"), (1, "3"): (False, "ordered_contains_missing:first"), (1, "4"): (False, "min_chars:34>=35"), (1, "5"): (True, "page_nonempty_ratio:0.750>=0.750"), (1, "6"): (False, "unknown_check_type"), (1, "7"): (False, "contains:"),
        (2, "5"): (False, "page_nonempty_ratio_missing_page_stats"), (3, "1"): (False, "paper_missing_in_corpus"),
    }
    assert tuple(gold.summary(asked, made).first()) == (4, 2, 9, 3, 0.4)
