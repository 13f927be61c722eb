from __future__ import annotations

import html as references
import re
import time

import pytest

from twinframe.llm import html
from twinframe.llm.queries import op1_main_text

SF = "/root/testdata/sf0.001"


def marked(page: str) -> str:
    """The blocks of the one article of a table's page, by plain splitting."""
    article = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    blocks = [re.sub(r"</?b>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
    return "\n".join(b for b in (" ".join(references.unescape(x).split()) for x in blocks) if b)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op1_main_text(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert (r.text, r.url, r.n_chars) == (marked(pages[r.page_id].html), pages[r.page_id].url, len(r.text))


@pytest.mark.parametrize(("page", "text"), [
    ("", ""),
    ("plain < text &eacute; 1<2 &amp;amp; ", "plain < text é 1<2 &amp;"),
    ("<p>one <b>two</b><br>three<p>four", "one two three\nfour"),
    ("<p> a\n\t b&nbsp;c </p>  <div>d</div>", "a b c\nd"),
    ("<head><title>no</title></head><body><header>no</header><main><header>yes</header><p>text</main><footer>no</footer>", "yes\ntext"),
    ("<nav>menu entries</nav><p>body text</p><script>var x = '</p> no';</script><style>p{}</style><form>no <p>no</form>", "body text"),
    ('<div class="cookie-notice">we use cookies</div><div id=comments><p>first!</div><div class="article-body">text</div><div class="ad">buy</div>', "text"),
    ('<p title="a > b">x</p><p title=\'it\'>y</p><p don\'t>z', "x\ny\nz"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<p>a<!-- <p>no --> b</p><!-- never closed <p>no", "a b"),
    ("<div hidden>no</div><p style='display: none'>no</p><p>yes</p>", "yes"),
    ("</div></p><p>a</span></p>", "a"),
    ("<P>UP</P><SCRIPT>no</SCRIPT>", "UP"),
])
def test_pages(page, text):
    assert html.main_text(page, {}) == text


def test_learned_tags_bound_the_run():
    page = "<div><i>go</i> <i>home</i> now read</div><p>{}</p><div><i>x</i> see also that other place</div>".format("word " * 40)
    assert html.main_text(page, {}).count("\n") == 2
    costs = html.learn({("i", False): 500, ("/i", False): 500, ("p", True): 900, ("/p", True): 900, ("div", True): 5, ("div", False): 400, ("/div", False): 400, ("/div", True): 5}, 300)
    assert costs["i"] > 50 > 1 > costs["p"] > 0
    assert html.main_text(page, costs) == ("word " * 40).strip()


def test_weights_come_from_labelled_pages(frame):
    page = "<div class='x'>short teaser <i>link</i></div><article><p>one two three four</p><p>five six</p></article>"
    pages = frame("page_id bigint, html string", *[(i, page) for i in range(30)], (98, None), (99, "<p>no label</p>"), (None, page))
    costs = html.fit(pages)
    assert costs["i"] > costs["p"]
    assert html.fit(pages.where("page_id > 90")) == {}
    found = pages.withColumn("text", html.extract("html", costs))
    assert {r.page_id: r.text for r in found.collect()}[3] == "one two three four\nfive six"


def test_odd_pages_end_in_time(frame):
    began = time.time()
    for page in ('<a href="' * 20_000, "<div>" * 30_000 + "x", "<b><p>" * 20_000, "<!-- " * 20_000, "<script> " * 20_000, "<" * 100_000, "<p>" + "word " * 200_000, "</b>" * 50_000):
        html.main_text(page, {})
    assert time.time() - began < 30
    pages = frame("page_id bigint, html string, text string, n_chars string", (1, None, "", ""), (1, "", "", ""), (2, "<p>a</p>", "", ""), (2, "<p>a</p>", "", ""))
    assert sorted(r.t for r in pages.select(html.extract("html", {}).alias("t")).collect()) == ["", "", "a", "a"]
    assert pages.limit(0).select(html.extract("html", {})).count() == 0


@pytest.mark.parametrize("words", ["layout has-sidebar", "with_sidebar", "no-comments", "page-header", "layout--sidebar", "search"])
def test_wrappers_around_the_page_stay(words):
    body = "<p>one two three four</p><p>five six</p>"
    for page in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div role=main>{body}</div>", body):
        assert html.main_text(f"<body><div class='{words}'><nav>menu</nav>{page}<footer>no</footer></div></body>", {}) == "one two three four\nfive six"
    assert html.pieces(f"<div class='{words}'><article>{body}</article></div>")[1] == 1
    assert html.main_text(f"<form id=page><main>{body}</main></form>", {}) == "one two three four\nfive six"


def test_asides_beside_marked_content_still_go():
    page = "<article><p>one two three</p></article><div class='comments'><article><p>first comment here</p></article></div><div hidden><main>no</main></div>"
    assert html.main_text(page, {}) == "one two three"
    assert html.main_text("<div class='related'><main><p>a b</p></main></div><article>c</article>", {}) == "a b\nc"


def test_one_inline_tag_does_not_cut_a_text():
    words = "word " * 40
    page = f"<div><i>go</i> <i>home</i> now</div><p>{words}</p><p>{words}<i>x</i> {words}</p><p>{words}</p>"
    costs = html.learn({("i", False): 500, ("/i", False): 500, ("p", True): 900, ("/p", True): 900, ("div", True): 5, ("div", False): 400, ("/div", False): 400, ("/div", True): 5}, 300)
    assert html.main_text(page, costs) == "\n".join([words.strip(), f"{words}x {words.strip()}", words.strip()])


def test_fit_counts_wrapped_pages(frame):
    page = "<div class='layout search'><div class='x'>short teaser <i>link</i></div><article><p>one two three four</p></article></div>"
    costs = html.fit(frame("page_id bigint, html string", *[(i, page) for i in range(30)]))
    assert costs["i"] > costs["p"]
