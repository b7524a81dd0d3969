import html as references
import re
import tracemalloc

import pytest
from cases import PAGES, none, page

from shiftledger.llm import html
from shiftledger.llm.common import table

PLAIN = [
    ("<article><h1>A &amp; B</h1><p>one\n two <b>th</b>ree<br>four<p>five &eacute;&#33;&am</article><footer>x</footer>", "A & B one two three four five é!&am"),
    ("<nav>m</nav><main><p>text<aside>side</aside><div class='comments'><p>said</div><p>end</main>", "text end"),
    ("<body><div class=\"cookie-notice\">we</div><p>only <i>this</i></p><form>f</form><script>var a='<p>';</script>", "only this"),
    ("<article>a<style>p{}</style>b<!-- no <p> -->c<p class='ad'>buy<p>d</article>", "ab c d".replace("b c", "bc")),
    ("", ""), (None, ""), ("plain text", "plain text"), ("<article>cut <p>off <a href='x", "cut off"), ("a < b > c", "a < b > c"),
    ("<header>h</header><section>x</section>" + "<p>long</p>" * 5000, "x " + " ".join(["long"] * 5000)),
    ("<ul><li>one<li class=sidebar>two<li>three</ul>", "one three"), ("<article>&nbsp;x\x0b\ty</article>", "\xa0x y"),
]


@pytest.mark.parametrize("page_html,text", [x for x in PLAIN if x[0] is not None])
def test_blocks(page_html, text):
    assert html.main_text(page_html) == text


def test_pages_with_odd_cases(spark):
    rows = [page(k, None if k % 2 else f"http://h{k}/", h) for k, (h, _) in enumerate(PLAIN)]
    pages = spark.createDataFrame([*rows, rows[0]], PAGES)
    found = html.extract(pages).orderBy("page_id").collect()
    assert [r["text"] for r in found] == [PLAIN[0][1], *[t for _, t in PLAIN]]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html.extract(none(spark, PAGES)).count() == 0


def test_template_text_of_a_host_goes(spark):
    """Without an article element, what all pages of a host have in the same places is not main text."""
    body = "<div id=top><span>Welcome to the site</span><p>Top stories</p></div><div><p>Own text {0} of it<p>more {0}</div><div><p>Made by us</div>"
    rows = [page(k, f"http://one.example/{k}", body.format(f"word{k} " * (k + 1))) for k in range(8)]
    rows.append(page(50, "http://two.example/", body.format("alone ")))
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[2] == "Own text word2 word2 word2 of it more word2 word2 word2"
    assert found[50].startswith("Welcome to the site")  # a single page reveals no template
    classes = html.templates(spark.createDataFrame(rows, PAGES)).collect()
    assert [r["host"] for r in classes] == ["one.example"]


def test_classes_out_of_order_are_not_valid():
    assert html.template_places([1, 2, 3, 4], [[1, 3, 4]]) == {0, 2, 3}
    assert html.template_places([3, 1, 4], [[1, 3, 4]]) == set()
    assert html.template_places([1, 7, 8, 7, 8, 2, 3], [[1, 2, 3], [7, 8]]) == {0, 1, 2, 3, 4, 5, 6}
    assert html.template_places([1, 7, 2, 8, 3], [[1, 2, 3], [7, 8]]) == {0, 2, 4}


def test_given_pages(spark):
    sf_dir = "/root/testdata/sf0.001"
    pytest.importorskip("pathlib").Path(sf_dir).is_dir() or pytest.skip("no test tables")
    for row in html.extract(table(spark, sf_dir, "pages")).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S)
        parts = re.split(r"</?(?:p|h1|br)>", article.group(1)) if article else []
        blocks = [re.sub(r"\s+", " ", references.unescape(re.sub("<[^>]*>", "", x))).strip() for x in parts]
        assert row["text"] == " ".join(b for b in blocks if b)


def test_notice_in_the_articles_of_a_host_goes(spark):
    """Template text inside articles goes under whatever name; the text of copies and of few pages stays."""
    body = "<body><article><h1>Title {0}</h1><p>{1}<div class=zq><p>Please support <b>our</b> site</div><p>Last {0}</article><footer>f</footer>"
    rows = [page(k, f"http://one.example/{k}", body.format(k, f"word{k} " * (k + 1))) for k in range(8)]
    copy = "<title>{0}</title><article><h1>Same</h1><p>one text<p>of all pages</article><p>{0}"
    rows += [page(20 + k, f"http://two.example/{k}", copy.format(k)) for k in range(8)]
    pair = "<article><h1>{0}</h1><p>{0} a<p>{0} b<p>{0} c</article>"
    rows += [page(40 + k, f"http://three.example/{k}", pair.format("both" if k < 2 else k)) for k in range(4)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[2] == "Title 2 word2 word2 word2 Last 2"
    assert all("support" not in found[k] and "site" not in found[k] for k in range(8))
    assert found[25] == "Same one text of all pages"
    assert found[41] == "both both a both b both c" and found[43] == "3 3 a 3 b 3 c"


ARTICLE = "<article><p>one<p>two</article>"
HELD = [
    f'<body class="single has-sidebar search">{ARTICLE}</body>',
    f'<html class="no-js cookie"><body id=search><div id="content" class="with-sidebar">{ARTICLE}<div class="sidebar">s</div></div>',
    f'<div class="search"><section class="search-related"><div class="share">s</div>{ARTICLE}</section></div>',
    f'<main><div class=share>s</div><section class="related">{ARTICLE}</section></main>',
    '<main><p>one<p>two<div class=related><article>r</article></div></main>',
    f'{ARTICLE}<div class="related-posts"><article>other</article></div>',
    '<article><p>one<div class="ad-slot">buy</div><p>two<div class="comments"><article><p>a long comment of many words</article></div></article>',
    '<body class="has-sidebar"><div class="with-sidebar"><p>one<p>two</div><div class="site-footer">f</div></body>',
    '<article><p>one<div class="notice-period sharepoint">two</div></article>',
    '<div class="search"><main><p>one<p>two</main></div>',
]


@pytest.mark.parametrize("page_html", HELD)
def test_names_do_not_mark_what_holds_the_article(page_html):
    assert html.main_text(page_html) == "one two"


def test_headings_and_lines_that_articles_share_stay(spark):
    """Shared headings, bylines and closing lines are article text; a container of template text alone is a notice."""
    body = (
        "<article><h1>Title {0}</h1><p>By the editors</p><p>{1}</p><h2>Summary</h2><div class=zq><p>Please support our site</div>"
        "<div class=part><h2>Method</h2></div><div class=text><p>As before: <b>all</b></p><p>{0} more</p></div>"
        "<p>Thanks for reading.</p></article><footer>f</footer>"
    )
    rows = [page(k, f"http://one.example/{k}", body.format(k, f"word{k} " * 20)) for k in range(8)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(8):
        own = " ".join([f"word{k}"] * 20)
        assert found[k] == f"Title {k} By the editors {own} Summary Method As before: all {k} more Thanks for reading."


@pytest.mark.parametrize("tag", ["<div class=a>", "<div class=ad>", "<p class=ad>", "<article>", "<li>", "</section>"])
def test_deep_and_broken_nesting(tag):
    """Memory and time grow with the length of the page: 30 000 elements that are never closed, or never opened."""
    deep = "<div>" * 2000 + tag * 30_000
    tracemalloc.start()
    found = html.main_text(f"<article><p>one</p></article>{deep}</span></b><p>two")
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    assert found == "one" if tag != "<article>" else found == "one two"
