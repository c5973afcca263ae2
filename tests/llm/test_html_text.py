import pytest

from ledgerlens.llm.html_text import extract, main_text

LONG = "A paragraph that is clearly long enough to be text."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html></html>", ""), ("just text", "just text"), ("a < b", "a < b"),
    (f"<nav><a>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>End.</p></article><footer>&copy; me</footer>", f"Title {LONG} End."),
    # no article element; containers named by class or id
    (f"<div id=top-menu><ul><li><a href=x>One</a></li></ul></div><div class='post'><h2>T</h2><p>{LONG}</p></div>"
     f"<div class=\"user-comments\"><p>{LONG} says a reader</p></div>", f"T {LONG}"),
    # inline elements add no blank, breaks and blocks do; white space is one blank
    (f"<p>a<b>b</b>c<br>d &amp;&nbsp; e\n\n f &#233;</p><p>{LONG}</p>", f"abc d & e f é {LONG}"),
    # scripts may hold markup; comments are not text
    (f"<script>var t='</p><p>x';</script><!-- <p>no</p> --><style>p{{}}</style><p>{LONG}</p>", LONG),
    # an advert, a notice and a form inside the article
    (f"<article><p>{LONG}</p><div class=ad>Buy</div><div class='cookie-notice'>We use</div><form>Mail</form><p>Last one.</p></article>", f"{LONG} Last one."),
    # page cut off, elements left open
    (f"<body><nav><ul><li><a>x</a><article><h1>T<p>{LONG}<p>More", f"T {LONG} More"),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</p></article><header>Site</header>", f"Head {LONG}"),
    # a quote opens a value only after the equals sign
    (f"<article><p title=it's>{LONG}</p><p>Don't stop.</p></article><footer>it's me</footer>", f"{LONG} Don't stop."),
    (f"<article><p title = 'a > b' data-x=\"c > d\" lang=en'>{LONG}</p></article>", LONG),
    (f"<main><p>{LONG}</p></main><p>{LONG} but outside</p>", LONG),
    (f"<p title='a > b'>{LONG}</p><p hidden>secret</p><aside>side</aside>", LONG),
])
def test_pages(page, want):
    assert extract(page) == want


def test_isolated_short_line_is_dropped():
    page = f"<div><h1>T</h1><p>{LONG}</p></div><div class=share>x</div><div class=related>y</div><p>Imprint</p>"
    assert extract(page) == f"T {LONG}"


def test_many_lines():
    body = "".join(f"<p>Line {i} of the text</p>" for i in range(20_000))
    assert extract(f"<nav>menu</nav>{body}").count("Line") == 20_000


def test_operator(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "old"), (1, "u", f"<p>{LONG}</p>", "old"), (2, None, None, "old"), (None, "v", "", "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = main_text(df)
    assert out.columns == df.columns
    assert sorted([(r.page_id, r.url, r.text) for r in out.collect()], key=str) == sorted(
        [(1, "u", LONG), (1, "u", LONG), (2, None, ""), (None, "v", "")], key=str)
    assert main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("page, want", [
    # names of the layout, not of a side part
    (f'<div class="layout has-sidebar"><article><p>{LONG}</p></article></div>', LONG),
    (f'<div class="no-ads side-effects"><p>{LONG}</p></div>', LONG),
    (f'<div class="overlay"><article><p>{LONG}</p></article></div>', LONG),
    (f'<div class="widget"><article><p>{LONG}</p></article></div>', LONG),
    # parts of a text
    (f'<article><div class="post-header"><h1>T</h1></div><p>{LONG}</p><section id="discussion"><h2 id="side-effects">S</h2><p>More.</p>'
     f'</section><p class="legal">Law.</p></article>', f"T {LONG} S More. Law."),
    # still side parts
    (f'<div class="sidebar-left"><p>{LONG} a</p></div><div class="ad-300x250">{LONG} b</div><div class="post"><p>{LONG}</p></div>'
     f'<ul class="commentList"><li>{LONG} c</li></ul>', LONG),
    (f'<article><p>{LONG}</p></article><div class="related"><article><p>{LONG} teaser</p></article></div>', LONG),
    (f'<aside><article><p>{LONG} a</p></article></aside><p>{LONG}</p>', LONG),
    (f'<div class="widget"><article><p>{LONG}</p><div class="ad">{LONG}</div></article></div>', LONG),
])
def test_names_of_side_parts(page, want):
    assert extract(page) == want


ADS = "<div class=ad>x</div><div class=ad>y</div>"


@pytest.mark.parametrize("page, want", [
    # an article that is not the page's main text
    (f"<div class=post><p>{LONG}</p></div><nav>x</nav><nav>y</nav><section><article><h3>Teaser</h3></article></section>", LONG),
    (f"<div class=post><p>{LONG}</p><p>{LONG}</p></div><section><article><h3>Teaser</h3></article></section>", f"{LONG} {LONG} Teaser"),
    (f'<div class=post><p>{LONG}</p></div><article class="comment"><p>{LONG} says a reader</p><p>{LONG}</p></article>', LONG),
    (f'<article><p>{LONG}</p></article><article class="user-comment"><p>{LONG} says a reader</p></article>', LONG),
    (f'<article class="post category-legal tag-ads"><p>{LONG}</p></article><p>Imprint</p>', LONG),
    # a heading and a short paragraph parted from the rest by side lines
    (f"<h1>Title</h1>{ADS}<p>{LONG}</p>", f"Title {LONG}"),
    (f"<h1>Title</h1>{ADS}<p>By me</p>{ADS}<h2>Part</h2><p>{LONG}</p>", f"Title By me Part {LONG}"),
    (f"<p>{LONG}</p>{ADS}<p>Short.</p>{ADS}<p>{LONG}</p>", f"{LONG} Short. {LONG}"),
    # a site's name is no title of a text that has its own
    (f"<h1>Site</h1>{ADS}<h1>Title</h1><p>{LONG}</p>", f"Title {LONG}"),
])
def test_article_and_headings(page, want):
    assert extract(page) == want
