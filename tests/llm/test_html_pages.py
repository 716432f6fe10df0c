"""Pages with names, several articles and odd or hostile markup, each with its text marked by hand."""

import html.parser
import time

import pytest

from meterline.llm.html_text import main_text

LONG = "A paragraph, with commas, which is long enough to be the text of an article, surely."
PAGES = {
    "names in an article": (
        f'<article><div class="section-header"><h2>Methods</h2></div><p>{LONG}</p><section class="related-work"><p>Work of others.</p></section><p class="form-factor">Small form.</p></article>',
        f"Methods\n\n{LONG}\n\nWork of others.\n\nSmall form.",
    ),
    "boxes in an article": (f'<article><p>{LONG}</p><div class="share-buttons">Share this</div><div class="ad-slot">Buy it, now</div><section class="comments"><p>Reader, says.</p></section></article>', LONG),
    "two articles": (f"<main><article><h1>One</h1><p>{LONG}</p></article><article><h1>Two</h1><p>{LONG} Again.</p></article></main>", f"One\n\n{LONG}\n\nTwo\n\n{LONG} Again."),
    "unquoted apostrophes": ("<article><p title=don't>First para, that's it.</p><p>It's second</p></article>", "First para, that's it.\n\nIt's second"),
    "one apostrophe": ("<article><p title=don't>First para, here.</p><p>Second one</p></article>", "First para, here.\n\nSecond one"),
    "signs in quotes": (f'<article><p title="a > b">{LONG}</p><p data-x=\'<p>\'>Next.</p></article>', f"{LONG}\n\nNext."),
    "a quote that never ends": (f'<article><p>{LONG}</p><p title="x>Next one</p></article>', f"{LONG}\n\nNext one"),
    "signs in the text": (f"<article><p>{LONG} 1 < 2, a <3 b</p></article>", f"{LONG} 1 < 2, a <3 b"),
    "a page that stops in a tag": (f"<article><p>{LONG}</p><p class=", LONG),
    "a title before the article": (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", f"Title\n\n{LONG}"),
    "a site's name is no title": (f"<h1>Site</h1><article><h1>Title</h1><p>{LONG}</p></article>", f"Title\n\n{LONG}"),
    "a short last section": (f"<div id=content><div><p>{LONG * 4}</p></div><div><p>A short last section.</p></div></div>", f"{LONG * 4}\n\nA short last section."),
    "a list of links in the article": (f"<article><p>{LONG}</p><h2>Works</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></article>", f"{LONG}\n\nWorks\n\nOne\n\nTwo\n\nThree"),
    "a menu in the article": (f"<article><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul><p>{LONG}</p></article>", LONG),
    "named parts with paragraphs": (
        f"<article><p>{LONG}</p><section class='related'><p>Plain words.</p></section><div class=share><p>Shared words.</p></div><div class=menu><p>The menu of the day.</p></div><div class=share><p><a href=x>Share</a></p></div></article>",
        f"{LONG}\n\nPlain words.\n\nShared words.\n\nThe menu of the day.",
    ),
    "buttons in sentences": (f"<article><p>{LONG}</p><p>Press the <button>Start</button> key, <label>this one</label>.</p><p><button>Share</button></p><button>Buy</button></article>", f"{LONG}\n\nPress the Start key, this one."),
    "comments as articles": (f"<article><p>{LONG}</p></article><article class='comment'><p>Reader, says.</p></article><div><article class='comment-reply'><p>Yes, so.</p></article></div>", LONG),
    "comments under a heading": (f"<article><p>{LONG}</p><h2>After</h2><p>More.</p><h3>3 comments</h3><div class=thread><p>I say, so.</p></div><p>And I.</p><h2>Sources</h2><p>A book.</p></article>", f"{LONG}\n\nAfter\n\nMore.\n\nSources\n\nA book."),
    "long numbers": (f"<article><p>{LONG} &#{'9' * 5000}; &#{'0' * 5000}65; &#x{'0' * 5000}41;&#38;&#39</p></article>", f"{LONG} \ufffd A A&'"),
    "references": (f"<article><p>{LONG} &lt;b&gt; &eacute;&#8211;&#x41;</p></article>", f"{LONG} <b> é–A"),
}


@pytest.mark.parametrize("case", PAGES)
def test_pages(case):
    page, text = PAGES[case]
    assert main_text(f"<html><body>{page}</body></html>") == text


HOSTILE = {
    "open tags": "<a " * 350_000, "open quotes": "<a '" * 250_000, "nested": "<div>" * 200_000, "nested text": "<div>x " * 140_000, "lists in a deep list": "<ul>" + "<div>" * 60_000 + "<li>x</li>" * 60_000, "ends": "<b>" + "</i>" * 250_000,
    "raw": "<title>" + "</title " * 130_000, "comments": "<!--" * 250_000, "held paragraphs": "<p><table><td>" + "<div>x" * 100_000, "named parts": "<article>" + "<div class=share><p>x" * 60_000, "headings": "<h3>" * 200_000, "heading of empty parts": "<h2>" + "<b>" * 100_000 + "<h3>" * 100_000, "articles": "<article><div><h2>x</h2>" * 50_000, "labels": "<p>" + "<label>x " * 120_000,
    "attributes": "<p " + "a=1 b='2' " * 100_000 + ">x</p>",
}


@pytest.mark.parametrize("case", HOSTILE)
def test_hostile_pages_take_linear_time(case):
    def took(page):
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    page = HOSTILE[case]
    quarter, whole = took(page[: len(page) // 4]), took(page)
    assert whole < 8 * quarter + 1 and whole < 20


def test_repeated_rows_and_other_columns(spark):
    from meterline.llm.html_text import extract

    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x")] * 2 + [(2, None, None, "x"), (None, "v", "", "x"), (3, "w", "plain " * 200_000, "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "v", 0), (1, "u", len(LONG)), (1, "u", len(LONG)), (2, "", 0), (3, "w", 1_199_999)]


class Article(html.parser.HTMLParser):
    """A plain extractor of pages whose article is marked: its blocks, cut at the tags that begin or end one."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.run = False, [], ""

    def cut(self):
        if self.run.strip():
            self.blocks.append(" ".join(self.run.split()))
        self.run = ""

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.run += " "
        elif tag not in ("a", "b", "i", "em"):
            self.cut()

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em"):
            self.cut()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.run += data


def test_same_as_a_plain_extractor(spark, sf):
    from meterline.llm.html_text import op9_html_text
    from meterline.llm.shared import table

    big = sf.replace("sf0.001", "sf0.01")
    want = []
    for r in table(spark, big, "pages").collect():
        plain = Article()
        plain.feed(r.html or "")
        plain.cut()
        text = "\n\n".join(plain.blocks)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, op9_html_text(spark, big).collect())) == sorted(want)
