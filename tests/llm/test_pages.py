from __future__ import annotations

import html
import itertools
import random
import re

import pytest

from srcatlas.llm import htmltext, queries


def test_cut_is_the_cheapest_labelling():
    rnd = random.Random(0)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        value = [rnd.choice([rnd.uniform(-2, 2), 0.0, 1.0, -1.0]) for _ in range(n)]
        edges = {(a, b): rnd.choice([rnd.uniform(0, 2), 1.0]) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5}

        def cost(side, value=value, edges=edges):
            own = sum(max(0, -v) if s else max(0, v) for v, s in zip(value, side, strict=True))
            return own + sum(w for (a, b), w in edges.items() if side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(htmltext.minimum_cut(value, edges)) - best) < 1e-9


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><!-- never closed <p>words that nobody sees at all", ""),
        ("<article><p>One &amp;amp; two&nbsp;  three\n four</p><p>Short.<br>Next", "One &amp; two three four\n\nShort. Next"),
        ("<ARTICLE><h1>Head</h1><script>if (a<b) '</p>'</SCRIPT ><p class='x>y'>Text here</p></ARTICLE>", "Head\n\nText here"),
        ("<nav><a>Home</a></nav><article><header><h1>Head</h1></header><p>Body of it.</p><form>Your name<button>Go</button></form></article>", "Head\n\nBody of it."),
        ("<article><p>Body of it all.</p><div class='comments'><p>I read this and liked it a lot, thanks for the many words.</p></div></article>", "Body of it all."),
        ("<div class='cookie-notice'><p>We use cookies to make all of this better for you.</p></div><main><p>The text itself.</p></main>", "The text itself."),
        ("<div id='content'><h2>Head of it</h2><p>A longer paragraph with many words in it.<p>And another.</div><div id=footer>(c) me</div>", "Head of it\n\nA longer paragraph with many words in it.\n\nAnd another."),
        ("<article><ul><li>first thing<li>second <b>thing</b></ul></article><aside><p>Read also these other things</p></aside>", "first thing\n\nsecond thing"),
    ],
)
def test_pages(page, want):
    assert htmltext.main_text(page)[0] == want


LONG = "A paragraph of the text itself, with a good many words in it."


@pytest.mark.parametrize(
    "start",
    [
        "<body class='has-sidebar'><article>", "<html class='no-js modal-open'><body class='single-post sidebar right-sidebar' id='search'><article>",
        "<article class='post comments-open'>", "<main class='with-sidebar comments'>", "<div class='content search-result social'>",
        "<body class='page-sidebar-left'><article class='post tag-social category-menu newsletter'>", "<div id='content' class='no-comments has-sidebar'>",
        "<div class='layout has-sidebar'><article>", "<div class='page-wrapper sidebar-open search-results'><main>",
    ],
)
def test_states_and_layouts_lose_no_text(start):
    page = f"{start}<h1>Head of it</h1><p>{LONG}</p><p>{LONG}</p><div class='ad'><p>{LONG} Buy it.</p></div><p>Short.</p>"
    assert htmltext.main_text(page)[0] == f"Head of it\n\n{LONG}\n\n{LONG}\n\nShort."


@pytest.mark.parametrize(
    "start",
    [
        "<div class='sidebar'>", "<div class='left-sidebar'>", "<div id='comment-list'>", "<div class='comments-area'>", "<div class='post-comments'>", "<div class='main-sidebar'>",
        "<div class='widget_text'>", "<div class='related-posts'>", "<div class='modal-content'>", "<div class='social-share-buttons'>", "<div class='cookie-notice'>",
        "<div class='box ad'>", "<div class='ad-728'>", "<div role='complementary'>", "<div id='comments'><article class='comment-body'>",
        "<div class='comments'><div class='content'>",
    ],
)
def test_boilerplate_stays_out(start):
    page = f"<body class='has-sidebar'><article class='comments-open'><p>{LONG}</p>{start}<p>{LONG} I like it.</p>"
    assert htmltext.main_text(page)[0] == LONG


def test_deep_and_long_pages():
    deep = "<article>" + "<div>" * 3000 + "<p>words in the deep of this page" + "</div>" * 3000
    assert htmltext.main_text(deep)[0] == "words in the deep of this page"
    many = "<article>" + "".join(f"<p>paragraph number {i} of many</p>" for i in range(20_000))
    assert htmltext.main_text(many)[0].count("\n\n") == 19_999
    assert isinstance(htmltext.main_text("<a href='" * 500 + "x")[0], str)


def labels(page):
    """(text, label by the classifier alone, label after the cut) of every block."""
    found = [(b, t) for b in htmltext.read_blocks(page) if (t := b.text())]
    logits = [b.logit(t) for b, t in found]
    cut = htmltext.minimum_cut(logits, htmltext.ties([b for b, _ in found]))
    return [(t, v > 0, c) for (_, t), v, c in zip(found, logits, cut, strict=True)]


LINKS = "<ul><li><a href=a>Home page</a><li><a href=b>All of it</a></ul>"


@pytest.mark.parametrize(
    ("page", "text", "content"),
    [
        (f"<div><p>{LONG}</p><div>Yes.</div><p>{LONG}</p></div>", "Yes.", True),
        (f"<div><p>{LONG}</p><p>{LONG}</p><li>One</li><p>{LONG}</p></div>", "One", True),
        (f"<div><p>{LONG}</p><p>So <a href=x>here</a>.</p><p>{LONG}</p></div>", "So here.", True),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div>{LINKS}<p>Write to us for more help</p>{LINKS}</div>", "Write to us for more help", False),
        (f"<div>{LINKS}<p>Seen by 2,000 of you</p>{LINKS}</div><div><p>{LONG}</p><p>{LONG}</p></div>", "Seen by 2,000 of you", False),
    ],
)
def test_cut_decides_what_the_classifier_gets_wrong(page, text, content):
    by_text = {t: (alone, cut) for t, alone, cut in labels(page)}
    assert by_text[text] == (not content, content)
    assert htmltext.main_text(page)[0].count(LONG) == page.count(LONG) and "Home" not in htmltext.main_text(page)[0]


def test_pages_in_one_form_and_small_forms():
    fields = "<input type=hidden name=v><input type=hidden name=w>"
    page = f"<body><form action='x'>{fields}<ul><li><a href=x>Home</a></ul><article><h1>Head of it</h1><p>{LONG}</p><p>{LONG}</p></article></form>"
    assert htmltext.main_text(page)[0] == f"Head of it\n\n{LONG}\n\n{LONG}"
    page = f"<article><p>{LONG}</p><form><p>Leave your name and your address here</p><input><input><textarea></textarea><button>Go</button></form></article>"
    assert htmltext.main_text(page)[0] == LONG
    page = f"<article><p>{LONG}</p></article><div class='wp-block-comments-query-loop'><p>{LONG} I like it.</p></div>"
    assert htmltext.main_text(page)[0] == LONG


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<div>word" * 100_000, "<b>" * 100_000 + "<p>x" * 50_000, "<div>" * 50_000 + "</x>" * 200_000, "<![CDATA[>" * 100_000,
        "<script>" + "</script " * 100_000, "<a '>\"" * 100_000, "<!-- " * 200_000, "<p>a sentence with some words in it</p><li><a>x</a></li>" * 10_000,
    ],
    ids=["tags", "deep", "inline", "closers", "sections", "script", "quotes", "comments", "mixed"],
)
def test_long_pages_take_time_in_proportion(page):
    import time

    start = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - start < 8


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "", "y"), (None, "v", "<article><p>Some text here</p></article>", None)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING")
    got = sorted(map(str, ((r.page_id, r.url, r.text, r.n_chars) for r in htmltext.extract(pages).collect())))
    assert got == sorted(map(str, [(1, "u", "", 0)] * 2 + [(2, None, "", 0), (None, "v", "Some text here", 14)]))
    assert htmltext.extract(pages.where("false")).count() == 0
    assert htmltext.extract(pages, url_col=None).columns == ["page_id", "text", "n_chars", "n_blocks", "n_kept"]


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op5_main_text(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"(?s)<article>(.*?)</article>", page.html).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[page.page_id].text, got[page.page_id].url, got[page.page_id].n_chars) == (want, page.url, len(want))
