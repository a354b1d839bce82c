import pytest

from tarnsearch.functions.entities import decode_entities, table
from tarnsearch.functions.html import extract
from tarnsearch.queries import html_links, html_text


@pytest.fixture
def page(column):
    return lambda html: column(extract, [html])[0]


def test_entities(column):
    cases = {
        "A&#241;o &#x41;&#X42;": "Año AB",
        "&iquest;b&uacute;squeda? &Ntilde;": "¿búsqueda? Ñ",
        "Tom & Jerry &notanentity; &;": "Tom & Jerry &notanentity; &;",
        "&amp;lt;": "&lt;",
        "a&nbsp;b&#160;c": "a b c",
        "&gt; if you’re": "> if you’re",
        "&aaaaaaaaaaaaaaaa; &#1114112; &#xD800;": "&aaaaaaaaaaaaaaaa; &#1114112; &#xD800;",
        "👎&amp;👎 & 👎": "👎&👎 & 👎",
        "": "",
        "&": "&",
    }
    assert column(decode_entities, list(cases)) == list(cases.values())
    assert column(decode_entities, [None]) == [None]
    assert len(table()) == 87


def test_title_and_text(page):
    p = page("<html><head><title>Tarn &amp; co</title></head><body><p>uno</p><p>dos  <b>tr</b>es</p></body></html>")
    assert p["title"] == "Tarn & co" and p["text"] == "Tarn & co uno dos tres"


def test_what_is_no_text(page):
    p = page("<!doctype html><body>real<script>var x='<a href=/no>f</a>'</script><STYLE>.a{}</STYLE> words<!-- <a href='/h'>no</a> --><svg><p>x</p>")
    assert p["text"] == "real words" and p["links"] == []


def test_links(page):
    for html in ('<a href="/x">t</a>', "<a href='/x'>t</a>", "<a href=/x>t</a>", '<a  class="c"  href = "/x" >t</a>', '<a data-href="/no" href="/x">t</a>', "<a href=/x>t", '<a href="/x>t</a>', "<a href='/x>t</a>", '<a href="/x" class="c>t</a>'):
        assert [(x["href"], x["text"]) for x in page(html)["links"]] == [("/x", "t")], html
    p = page('<a href="/a?x=1&amp;y=2">Ca&ntilde;&oacute;n</a><a>none</a><a href="/paid" rel="nofollow ad">n</a><a href="/b">uno<a href="/c">dos</a><abbr href="/z">q</abbr>')
    assert [(x["href"], x["text"]) for x in p["links"]] == [("/a?x=1&y=2", "Cañón"), ("/b", "uno"), ("/c", "dos")]


def test_robots_and_base(page):
    p = page('<base target=x><base href="https://e.example/d/"><base href="/no"><meta name="ROBOTS" content="NOINDEX, follow">')
    assert (p["base"], p["noindex"], p["nofollow"]) == ("https://e.example/d/", True, False)
    assert page('<meta content=none name=robots>')["nofollow"]
    assert not page('<meta name="viewport" content="noindex">')["noindex"]


def test_malformed_and_empty(page, column):
    p = page('<p>uno<a href="/x">dos<p>tres < cuatro <div')
    assert p["text"].startswith("uno") and [x["href"] for x in p["links"]] == ["/x"]
    assert page("")["text"] == "" and page("<html></html>")["title"] == ""
    assert column(extract, [None]) == [None]


def test_pages_without_title_or_text(spark, tmp_path):
    rows = [(1, "T", "uno\ndos", [("/a", "A")]), (2, None, "uno", [("/b", "B")]), (3, "T", None, [("/c", "C")]), (4, None, None, None)]
    spark.createDataFrame([(i, f"http://a.example/{i}", t, x, ls, None, False, False) for i, t, x, ls in rows], "page_id long, url string, title string, text string, links array<struct<href:string,text:string>>, base string, noindex boolean, nofollow boolean").write.parquet(f"{tmp_path}/extracted_page.parquet")
    assert {r["page_id"]: (r["title"], r["text"]) for r in html_text(spark, str(tmp_path)).collect()} == {1: ("T", "T uno dos A"), 2: ("", "uno B"), 3: ("T", "T C"), 4: ("", "")}
    assert sorted((r["page_id"], r["n"], r["href"], r["text"]) for r in html_links(spark, str(tmp_path)).collect()) == [(1, 0, "/a", "A"), (2, 0, "/b", "B"), (3, 0, "/c", "C")]
