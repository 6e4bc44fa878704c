"""Main text of pages: the given table against its articles, and small pages."""

import html
import re

from civitext.llm import html_blocks as hb

BODY = "<p>This is the first paragraph of a long story about rivers.</p><p>Short one.</p><p>And a third paragraph that goes on for a while.</p>"
TEXT = "This is the first paragraph of a long story about rivers. Short one. And a third paragraph that goes on for a while."


def test_the_table_is_learned_whole():
    assert all(hb.keeps(hb.tree(), tuple(row[:-1])) == bool(row[-1]) for row in hb.LABELLED)


def test_boilerplate_goes_and_the_article_stays():
    page = (
        "<html><head><title>T</title><script>if (a<b) '<p>x</p>'</script></head><body class='sidebar-left'><header><a href=/>Home</a> Site of things</header>"
        f"<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class='cookie-notice'>We use cookies here, please agree to all of them now.</div><article><header><h1>Title here</h1></header>{BODY}"
        "<aside>Read this other thing too</aside></article><div id=comments><p>Great story, I really liked reading all of this, thanks.</p></div>"
        "<form>Name <input name=q> <button>Send</button></form><footer>&copy; 2024 all rights reserved by us</footer></body></html>"
    )
    assert hb.main_text(page) == "Title here " + TEXT


def test_pages_without_marks():
    page = f"<body><div><a href=a>Home</a> | <a href=b>News</a></div><div>{BODY}</div><div><a href=c>More</a> <a href=d>Less</a></div>"
    assert hb.main_text(page) == TEXT


def test_references_white_space_and_broken_markup():
    assert hb.main_text("<article><p>caf&eacute;&nbsp;&amp;\n\t <b>b</b>old<p>x &lt;p&gt; &#x41;<!-- c --></article>") == "café & bold x <p> A"
    assert hb.main_text("<article><p>one<br>two <a href='x>y'>link</a> and words around it</p><!-- open") == "one two link and words around it"
    assert hb.main_text("a < b and plain text without any element stays as it is") == "a < b and plain text without any element stays as it is"
    assert hb.main_text("<script>no end") == "" and hb.main_text("") == ""


def test_query_equals_articles_of_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = hb.op7_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        wanted = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert r.text == wanted and r.n_chars == len(wanted)


def test_nulls_repeats_long_pages_and_other_columns(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 100000
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, "", 4), (2, "v", long, 5)], "page_id long, url string, html string, text int")
    out = hb.extract_main_text(pages)
    assert out.columns == ["page_id", "url", "text"] and sorted(len(r.text) for r in out.collect()) == [0, 0, 0, len("word & word") * 100000 + 99999]
    assert hb.extract_main_text(pages.limit(0)).count() == 0
