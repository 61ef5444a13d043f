import re
import time

import pytest

from quern.llm import html_text as h
from quern.llm.common import table

PARAGRAPHS = ["First paragraph of the story, long enough to count as one.", "Second &amp; third &eacute;t&eacute; &#8212; see <a href='/x'>the <b>notes</b></a> for more.", "Short."]
WANT = ["A headline", "First paragraph of the story, long enough to count as one.", "Second & third été — see the notes for more.", "Short."]


def page(body, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body>{before}{body}{after}</body></html>"


MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(12)) + "</ul></nav>"
STORY = "<h1>A headline</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
CASES = {
    "plain": page(f"<article>{STORY}</article>", MENU, "<footer>&copy; someone, all rights reserved by us</footer>"),
    "divs": page(f"<div class='content'>{STORY}</div>", "<div class='top-menu'><a href=/>Home</a> <a href=/n>News</a></div>", "<div id='sidebar'><p>Ten best walks of the year and other things to read next week</p></div>"),
    "advert inside": page(f"<main>{STORY.replace('<p>Second', '<div class=ad-box>Buy now, the best things in town for less money today only</div><p>Second')}</main>", MENU),
    "form and comments": page(f"<article>{STORY}<form><p>Your name please</p><input></form></article>", "<header><p>Site of the year, all about everything</p></header>", "<section id='comments'><div class='comment'><p>I liked this very much indeed, thank you for it</p></div></section>"),
    "long comments": page(f"<article>{STORY}</article>", MENU, "<div id='comments'>" + "<div class='comment'><p>I liked this very much indeed and thank you for it. It is seldom that one reads so long a piece to its very end, and then would like to begin again at once.</p></div>" * 40 + "</div>"),
    "long sidebar": page(f"<div class='content'>{STORY}</div>", "<div class='sidebar'><h3>More</h3><p>Ten best walks of the year, and other things to read next week when there is time for it. We have chosen them for you with some care, and you will find them below.</p></div>", "<div class='newsletter'><p>Every week we write a letter to all who want to hear from us, and we would be glad to send it to you as well. Leave your address here and nothing else.</p></div>"),
    "aside inside": page(f"<article>{STORY.replace('<p>Short', '<aside><p>Related: something that was written before on the matter</p></aside><p>Short')}</article>"),
    "notice": page(f"<div class='cookie-notice'><p>We use cookies to make this site better for you and us.</p></div><article>{STORY}</article>"),
    "unclosed": page("<article>" + STORY.replace("</p>", "<br>").replace("</h1>", "</h1>") + "</article>", MENU.replace("</nav>", "")),
    "white space": page(f"<article>\n  {STORY.replace(' of ', chr(10) + ' of' + chr(9))}\n</article>".replace("A headline", " A  headline&nbsp;")),
    "comment tags": page(f"<!-- <p>not this</p> --><article>{STORY.replace('Short.', 'Short.<!-- nor > this -->')}</article>"),
    "quotes in attributes": page(f"<article data-x='a > b' title=\"<p>no</p>\">{STORY}</article>"),
}


@pytest.mark.parametrize("name", CASES)
def test_article(name):
    assert h.main_text(CASES[name]).split("\n\n") == WANT


def test_odd_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<html><body></body></html>") == h.main_text("<script>a</script>") == ""
    assert h.main_text("just words, no markup at all") == "just words, no markup at all"
    assert h.main_text("a < b and c > d") == "a < b and c > d"
    for broken in ("<p", "<", "</", "<!--", "<![CDATA[", "<p class='x", "</p></div>" * 50, "<div>" * 3000 + "deep inside words" + "</div>" * 3000):
        h.main_text(broken)
    long = "<article>" + "<p>some words of a long page</p>" * 40_000 + "</article>"
    assert h.main_text(long).count("\n\n") == 39_999


def test_best_region_is_the_best():
    import random

    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.uniform(-2, 2) for _ in range(rnd.randrange(0, 30))]
        a, b = h.best_region(s)
        best = max([0, *[sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]])
        assert sum(s[a:b]) == pytest.approx(best)


def test_weights_have_the_signs_of_the_method():
    w = h.weights()
    assert w["word"] > 0 and w["link"] < 0 and all(v < 0 for k, v in w.items() if k.startswith("tag:"))
    assert all(w["mark:" + m] < 0 for m in ("ad", "sidebar", "cookie", "comment", "menu"))
    assert all(w["mark:" + m] > 0 for m in ("post", "entry", "story"))


def test_weights_hold_on_other_labelled_pages():
    right = total = 0
    for page in h.labelled_pages(40, seed=99):
        got = " ".join(h.main_text("".join(x for x, _ in page)).split())
        for piece, main in page:
            for text in re.findall(r">([^<>&]{12,})<", piece):
                total += 1
                right += (" ".join(text.split()) in got) == main
    assert total > 500 and right > 0.95 * total


def without_names(html):
    """The same page with plain divs and a mark that says nothing."""
    html = re.sub(r"<(/?)(?:nav|article|main|footer|header|section)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"(class|id)=('[^']*'|\"[^\"]*\"|[^\s>]+)", r"\1=x9", html)


def test_the_scan_decides_without_names(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").collect():
        if r.html:
            assert h.main_text(without_names(r.html)) == h.main_text(r.html)
    for name in ("plain", "white space", "comment tags", "unclosed"):
        assert h.main_text(without_names(CASES[name])).split("\n\n") == WANT


def test_taking_the_scan_out_changes_the_result(spark, sf_dir):
    """What is left after the skipped elements alone is more than the main text."""
    for r in table(spark, sf_dir, "pages").collect():
        if r.html:
            made, _ = h.events(r.html)
            assert sum(e.words for e in made) > len(h.main_text(r.html).split())


def test_a_mark_alone_removes_nothing():
    story = "<h1>A head line</h1><p>Some long text of a story, that goes on.</p><p>More.</p>"
    want = "A head line\n\nSome long text of a story, that goes on.\n\nMore."
    for mark in ("post tags-news", "page sidebar-left", "hidden-print entry"):
        assert h.main_text(f"<body>{MENU}<div class='{mark}'>{story}</div></body>") == want
    assert h.main_text("<div class='toc'><p>long text that stands here</p></div>") == "long text that stands here"
    assert h.main_text("<div>Hi there.</div>") == "Hi there."


def test_references_are_decoded_where_they_stand():
    assert h.main_text("<p>&am<i>p;</i> x &lt;b&gt; caf&eacute;</p>") == "&amp; x <b> café"


HOSTILE = {
    "inline": lambda n: "<b>" * n + "</i>" * n, "open tags": lambda n: "<a " * n, "open quotes": lambda n: "<a '" * n, "open values": lambda n: "<a href='>" * n, "scopes": lambda n: "<i><article>" + "<b>" * n + "</i>" * n,
    "rules": lambda n: "<b>" * n + "<hr>" * n, "articles": lambda n: "<div>" * n + "<article>" * n, "marks": lambda n: "<div class=ad>word " * n, "comments": lambda n: "<!-- <" * n, "scripts": lambda n: "<script> " * n,
    "class": lambda n: '<p class="' * n, "blanks": lambda n: "<p " + " " * n + "='" * 2 + " " * n, "paragraphs": lambda n: "<p>some words " * n, "ends": lambda n: "<div><span></div>" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_page(name):
    def took(n):
        began = time.perf_counter()
        h.main_text(HOSTILE[name](n))
        return time.perf_counter() - began

    h.weights()
    # four times as much; the square of it would be 16 times
    small = min(took(5000) for _ in range(5))
    assert min(took(20_000) for _ in range(4)) < 8 * small + 0.05


def test_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r.page_id: r.html or "" for r in pages.collect()}
    out = h.extract(pages).collect()
    assert len(out) == len(source)
    for r in out:
        body = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)
        want = re.split(r"</?(?:p|h1)>", body[1]) if body else []
        import html

        want = [t for x in want if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()))]
        assert r.text.split("\n\n") == want and r.n_chars == len(r.text)
    rows = [(1, None, None, "x"), (1, "u", "<p>words in it</p>", "y"), (None, None, "", "z")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(h.extract(odd).collect(), key=str) == sorted([(1, None, "", 0), (1, "u", "words in it", 11), (None, None, "", 0)], key=str)
    assert h.extract(odd.limit(0)).collect() == []


PROSE = "The river rose in the night and the lower town was under water by noon. People carried what they could up the hill, and the school was opened for those who had nowhere to go."
MORE = "By the evening the rain had stopped. The mayor said that the bridge would stay closed until it has been looked at, which may take a week or longer."
HAND = {
    "all of a page in one form": (
        f"<html><body><form id='aspnetForm' action='x'><input type=hidden><div id='nav'><a href=1>Home</a> <a href=2>News</a></div><div><h1>Flood in the valley</h1><p>{PROSE}</p><p>{MORE}</p></div></form></body></html>",
        ["Flood in the valley", PROSE, MORE],
    ),
    "a form without a heading that holds most words": (f"<body><div><a href=1>Home</a></div><form><p>{PROSE}</p><p>{MORE}</p></form></body>", [PROSE, MORE]),
    "the heading in a header of a plain element": (
        f"<body><nav><a href=1>Home</a></nav><div class='post'><header><h1>Flood in the valley</h1></header><p>{PROSE}</p><p>{MORE}</p></div><footer>Contact us</footer></body>", ["Flood in the valley", PROSE, MORE],
    ),
    "an article of links": (
        "<body><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul><article><h1>Links of the week</h1><ul><li><a href=a>How the old bridge was built</a></li><li><a href=b>A short history of the mill by the river</a></li><li><a href=c>What the flood of last year has taught us</a></li></ul></article></body>",
        ["Links of the week", "How the old bridge was built", "A short history of the mill by the river", "What the flood of last year has taught us"],
    ),
    "a page header whose heading is a link": (
        f"<body><header><h1><a href='/'>The Valley News</a></h1><p>All the news of the valley since long ago</p></header><article><h2>Flood in the valley</h2><p>{PROSE}</p><p>{MORE}</p></article></body>", ["Flood in the valley", PROSE, MORE],
    ),
    "a page header beside an article with a heading": (f"<body><header><h1>The Valley News</h1><p>Every day</p></header><article><h1>Flood in the valley</h1><p>{PROSE}</p><p>{MORE}</p></article></body>", ["Flood in the valley", PROSE, MORE]),
    "a search form and a comment form": (
        f"<body><form class='search'><input> Search this site</form><div><h1>Flood in the valley</h1><p>{PROSE}</p><p>{MORE}</p></div><form id='reply'><h3>Leave a reply</h3><p>Your address will not be shown</p><textarea></textarea></form></body>", ["Flood in the valley", PROSE, MORE],
    ),
}


@pytest.mark.parametrize("name", HAND)
def test_pages_by_hand(name):
    page, want = HAND[name]
    assert h.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("name", HAND)
def test_the_region_is_the_best_of_all(name):
    """Against a plain scan of all regions; of equal sums the first that begins."""
    made, elements = h.events(HAND[name][0])
    scores, _ = h.scored(made, elements, h.weights())
    a, b = h.best_region(scores)
    every = [(sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert abs(sum(scores[a:b]) - max(every)[0]) < 1e-9
    assert h.best_region([1.0, -1.0, 1.0]) == (0, 1) and h.best_region([2.0, -3.0, 2.0]) == (0, 1) and h.best_region([0.0, 2.0, 0.0]) == (1, 2) and h.best_region([-1.0]) == (0, 0)
