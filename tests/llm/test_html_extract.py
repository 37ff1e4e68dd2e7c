"""Main text: one page by itself, and pages of a host that agree on a path."""

import pytest

from acct_health.llm.html_extract import Page, extract, winning_paths, with_host


def _text(html):
    return Page(html).text(None)


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain text", "plain text"), ("<p>a</p><p>b</p>", "a b"), ("<b>bo</b>ld <i>it</i>", "bold it"), ("a<br>b<div>c</div>", "a b c"),
    ("<article><h1>T</h1><p><b>One\n two&nbsp;<br><p>three &amp; four &#233;&lt;x&gt;</article><footer>f</footer>", "T One two three & four é<x>"),
    ("<body><nav><ul><li><a href=x>menu</a></li></ul></nav><main><p>body text here</p><aside>side</aside></main></body>", "body text here"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<div class='cookie-notice'>We use</div><div class='post-12'>Real words <form>name <input></form> stay</div><div id='comments'>reader</div>", "Real words stay"),
    ("<article>kept <div class='ad'>buy</div><div class=\"share-buttons\">x</div><span>on</span></article>", "kept on"),
    ("<article>cut off at a tag <foot", "cut off at a tag"), ("<article>a < b and c > d</article>", "a < b and c > d"),
    ("<article><p title='a > b'>quoted</p></article>", "quoted"), ("<div hidden>no</div><div style='display:none'>no</div><div>yes</div>", "yes"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<table><tr><td>one<td>two</table>", "two"),
])
def test_pages(html, text):
    assert _text(html) == text


@pytest.mark.parametrize("html", [
    "<article><h1>title</h1><div class=body>{}</div></article>", "<main><article><p>lead</p><section>{}</section><section>end</section></article></main>",
    "<body><div class=content><div class=lead>lead</div><div class=text>{}</div></div></body>",
    "<body><div id=wrap><div class=links><a href=x>one</a><a href=y>two</a></div><div class=content><div><h2>head</h2></div><div><div class=text>{}</div></div></div></div></body>",
    "<main><h1>head</h1><div class=tags><a href=x>tag</a></div><div class=text>{}</div><table><tr><td>cell</table></main>",
    "<div class=content><p>lead</p><table><tr><td>cell<td>{}</table></div>",
])
def test_nested_bodies_are_whole(html):
    inner = "Words of the text. " * 5
    got = _text(html.format(inner))
    for word in ("title", "lead", "head", "end", "cell", "tag"):
        assert (word in got.split()) == (f">{word}<" in html)
    assert inner.strip() in got and "one" not in got.split()


@pytest.mark.parametrize("name", ["sidebar-first", "one-sidebar", "page-with-sidebar", "nav-open", "header-fixed", "comments-open", "search-results"])
def test_layout_names_hide_no_page(name):
    for attribute in ("class", "id"):
        for tag in ("html", "body", "main", "article", "div", "section"):
            assert _text(f"<{tag} {attribute}='{name}'><p>Text of the page</p></{tag}>") == "Text of the page"
    assert _text(f"<body class='{name}'><div class='sidebar'>side</div><div class='story'>Story text</div></body>") == "Story text"
    assert _text("<main role=search>found</main>") == "found"


@pytest.mark.parametrize("html, text", [
    ('<article><h2 id="related-work">Related work</h2><p class="comment-on-law">a comment</p><p>text</p></article>', "Related work a comment text"),
    ('<article><p>text</p><section id="search-strategy"><h3>Search</h3><p>We searched</p></section></article>', "text Search We searched"),
    ('<div class=story><p>text</p><div class="notice-of-appeal">The notice</div></div>', "text The notice"),
    ('<article>text <div class="search-tools"><input> find</div><div class="related-topics"><a href=x>one</a></div></article>', "text"),
    ('<article>text <div class="related-posts">more</div><div id="comment-12">reader</div><ul class="share-buttons"><li>x</ul><li class=social>y</article>', "text"),
    ('<article><p class="notice">Note<p>main text<p class=ad>buy<h2>head</h2>on</article>', "main text head on"),
    ('<article><ul><li class="ad-x">buy<li>one<li class="ad-x">buy<ul><li>inner</li>still</ul>ad</li><li>two</ul>end</article>', "one two end"),
    ('<article><dl><dt class="ad">x<dd>y<dt class="ad">z</dl>end</article>', "y end"),
    ('<article><table><tr class="ad"><td>x<td>y<tr><td>z</table>end</article>', "z end"),
    ('<article><header><h1>Title</h1><p>by me</p></header>text<footer>f</footer></article>', "Title by me text"),
    ('<article><header><a href=x>menu</a></header>text</article>', "text"), ('<header><h1>Site</h1></header><article>text</article>', "text"),
    ('<article><div class="entry-header"><h1>Title</h1></div>text</article>', "Title text"),
    ('<a name=top><article>text <a href=x>linked <a href=y>twice</a> on</article>', "text linked twice on"),
    ('<article><p class="ad">buy <table><tr><td>cell</table> on</article>', "cell on"),
])
def test_the_article_is_kept(html, text):
    assert _text(html) == text


def test_deep_pages_take_linear_time():
    n = 100_000
    assert _text("<p class=ad>x<button>" + "<div>" * n + "</x>" * n + "</button><p>text") == "text"
    assert _text("<article>" + "<ul><li class=ad>" * 2000 + "</ul>" * 2000 + "text</article>") == "text"


def test_pages_hidden_by_more_than_names_stay_empty():
    assert _text("<body hidden>no</body>") == "" and _text("<nav>menu</nav><div class='sidebar' hidden>no</div>") == ""


def test_very_long_page():
    assert len(_text("<article>" + "<p>word</p>" * 50_000 + "</article>")) == 50_000 * 5 - 1
    assert _text("<" * 50_000 + "<p>x") .endswith("x")


def _site():
    article = lambda i: f"<html><body><nav>menu</nav><div class='story-{i}'><p>{'Story words ' * 20}{i}</p></div><div class='teasers'>{{}}</div></body></html>"
    rows = [(i, f"http://News.example.org/{i}", article(i).format("short")) for i in range(6)]
    # by itself this page would take its teasers; the host's other pages know better
    rows.append((6, "https://news.example.org/6?x", article(6).format("Teaser text without links " * 200)))
    rows += [(7, "http://other.example.org/", "<article>other</article>"), (8, None, "<p>no host</p>"), (9, "news.example.org", None), (9, "http://x.example.org", "")]
    return rows


def test_host_consensus(spark):
    pages = spark.createDataFrame(_site(), "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 as text", "'p' as path", "'v' as votes")
    paths = {r["__host"]: r.path for r in winning_paths(with_host(pages)).collect()}
    assert paths["news.example.org"] == "/body/div.story-#" and paths["other.example.org"] == "/article"
    for limit in (1000, 0):  # winning paths broadcast, or joined by salted host
        got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(pages, limit).collect()}
        assert len(got) == len(_site())
        assert got[(6, "https://news.example.org/6?x")] == ("Story words " * 20 + "6", 241)
        assert got[(8, None)] == ("no host", 7) and got[(9, "news.example.org")] == ("", 0) and got[(9, "http://x.example.org")] == ("", 0)
    assert extract(pages.where("false")).count() == 0
