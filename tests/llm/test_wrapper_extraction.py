"""Main text by wrappers: against a plain cut of the tables' pages, on hand-made sites, and on odd input."""

import re
from html import unescape

from hypothesis import given, settings
from hypothesis import strategies as st

from verbatrix.llm import page_tree, wrapper_extraction

FIELDS = "page_id long, url string, html string, text string, n_chars long"


def texts(spark, pages):
    frame = spark.createDataFrame([(i, url, html, "old", 1) for i, (url, html) in enumerate(pages)], FIELDS).repartition(3)
    rows = wrapper_extraction.extracted(frame).collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.page_id: r.text for r in rows}


def test_pages_of_the_tables(spark, small):
    """There the article's tags and line breaks cut the text into blocks."""
    got = {r.page_id: r.text for r in wrapper_extraction.op11_wrapper_extraction(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        lines = (" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1|br)>", inner.replace("<b>", "")))
        assert got[r.page_id] == " ".join(x for x in lines if x)


def site(i, words):
    """A page without article or main: menus, a notice, a form, an advert, comments and a fixed line around the text."""
    return "https://Site.example.com/a/%d" % i, f"""<html><head><title>T {i}</title><script>if (a<b) "</p>"</script></head><body class="has-sidebar">
      <div id="top-nav"><a href="/">Home</a> <a href="/b">News {i}</a></div><div class="cookie-notice">We use cookies {i}</div>
      <div class="wrap"><div class="col"><h2>Head {words[0]}</h2>{''.join(f'<p>{w} <b>bo</b>ld &amp; more &lt;{i}' for w in words)}<h5>Published by the desk</h5></div>
      <div class="col two"><ul>{''.join(f'<li><a href="/{w}">see {w} {i}</a>' for w in words)}</ul><form>Mail <input> {i}</form></div></div>
      <section class="comments"><article class="comment"><p>Nice {i}!</p></article></section><div class="ad">Buy {i}</div><footer>&copy; {i}</footer></body></html>"""


def test_site_without_article(spark):
    pages = [site(i, [f"word{i}x{j} and a good deal of text to read" for j in range(2 + i % 3)]) for i in range(7)]
    got = texts(spark, pages)
    for i in range(7):
        words = [f"word{i}x{j} and a good deal of text to read" for j in range(2 + i % 3)]
        assert got[i] == " ".join([f"Head {words[0]}", *(f"{w} bold & more <{i}" for w in words)])


def test_article_keeps_all_but_what_is_beside(spark):
    html = """<body><header>Site</header><article class="post comments-open"><header><h1>Title</h1></header><p>One<br>two</p><aside>Also</aside>
      <div class="related-posts">More</div><blockquote>Quote <a href=x>link</a>ed</blockquote><table><tr><td>a<td>b</table><pre> x
      y </pre><div class="share"><a>Tweet</a></div><div class="comment-list"><article><p>First!</p></article></div><footer>By me</footer></article><p>Out"""
    want = "Title One two Quote linked a b x y"
    assert texts(spark, [("http://a.b/1", html), ("http://a.b/2", "<main><p>Main &nbsp; text</p><nav>x</nav></main><p>out"), ("http://c.d", "<div class=nav>m</div><div class='entry-content'><p>In</p></div><p>out</p>")]) == {0: want, 1: "Main text", 2: "In"}


def test_copies_and_lone_pages_lose_nothing(spark):
    """Equal pages of a host and hosts of one page give all of their text."""
    page = "<body><nav>m</nav><div><p>Same text here</p><p>again</p></div></body>"
    got = texts(spark, [("http://h.h/1", page)] * 5 + [("http://lone.h", page)])
    assert set(got.values()) == {"Same text here again"}


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "<p>deep" + "</div>" * 5000
    wide = "<article>" + "".join(f"<h{1 + i % 6}>{i}</h{1 + i % 6}>" for i in range(3000)) + "</article>"
    pages = [(None, None), ("x", ""), ("no host", "just text"), ("http://u.u/1", deep), ("http://u.u/2", wide), ("http://u.u/3", "<p class='a{b} #(+?)'>x<a{b c=\"1>z</p>"), ("HTTP://U.u?q", '<div title="a>b">in</div><!-- <p>no --><!doctype><![CDATA[x]]></x-y>'), ("http://u.u/4", "<article>" + "long text " * 300_000), ("http://u.u/5", "<script>never ends <p>x")]
    got = texts(spark, pages)
    assert got[0] == got[1] == got[8] == ""
    assert got[2] == "just text" and got[3] == "deep" and got[6] == "in"
    assert got[4] == " ".join(map(str, range(3000))) and got[7] == ("long text " * 300_000).strip()
    assert wrapper_extraction.extracted(spark.createDataFrame([], FIELDS)).collect() == []


def test_rounds_of_parts_and_joins_by_size(spark, monkeypatch):
    """Many different shapes of one host, merged in several rounds and joined without a broadcast, give the same texts."""
    pages = [("http://many.h/%d" % i, "<body>" + "".join(f"<{t}>skip {i}</{t}>" for j, t in enumerate(("nav", "footer", "aside", "form", "header")) if i >> j & 1) + f"<div><p>Text of {i}</p>{'<ul><li>a<li>b</ul>' * (i % 3)}</div>") for i in range(40)]
    want = texts(spark, pages)
    monkeypatch.setattr(wrapper_extraction, "BROADCAST_BYTES", -1)
    parts = wrapper_extraction.wrappers
    monkeypatch.setattr(wrapper_extraction, "wrappers", lambda shapes, held: parts(shapes, held, 3))
    assert texts(spark, pages) == want
    assert all(v.startswith(f"Text of {i}") and "skip" not in v for i, v in want.items())


tree = st.recursive(st.just("#"), lambda kids: st.tuples(st.sampled_from(["div", "p.x", "ul", "li!"]), st.lists(kids, min_size=1, max_size=4)), max_leaves=12)


def built(t):
    return page_tree.Node("#", None, [0]) if t == "#" else page_tree.Node(t[0], [built(c) for c in t[1]])


def count(node):
    return sum(1 for _ in page_tree.leaves(node))


@settings(max_examples=200, deadline=None)
@given(st.lists(tree, min_size=1, max_size=5), st.lists(tree, min_size=1, max_size=5))
def test_expressions(a, b):
    """Folding and aligning keep every text in one slot; what is written reads back; folding again changes nothing."""
    x, y = (page_tree.folded(page_tree.Node("page", [built(c) for c in side])) for side in (a, b))
    for node, side in ((x, a), (y, b)):
        assert sum(len(leaf.texts) for leaf, _ in page_tree.leaves(node)) == str(side).count("#")
        assert page_tree.written(page_tree.read(page_tree.written(node))) == page_tree.written(node)
    both = page_tree.merged(x, y)
    assert sum(len(leaf.texts) for leaf, _ in page_tree.leaves(both)) == str((a, b)).count("#")
    assert count(page_tree.merged(page_tree.read(page_tree.written(both)), x)) >= count(x)


def test_repeated_groups_meet_single_ones():
    shape = lambda html: page_tree.written(page_tree.folded(page_tree.blocks(html)[0]))
    many, one = shape("<dl><h2>a</h2><p>b</p><h2>c</h2><p>d</p></dl>"), shape("<dl><h2>a</h2><p>b</p></dl>")
    assert "(h2,p)+" in many
    assert page_tree.written(page_tree.merged(page_tree.read(many), page_tree.read(one))) == many
    assert "p?{#}" in page_tree.written(page_tree.merged(page_tree.read(one), page_tree.read(shape("<dl><h2>a</h2></dl>"))))
