"""HTML extraction (operator 1) by maximum-scoring subsequence.

A page is a sequence of words and tags.  Tags score negative; a word scores by
where it stands: in a link, in which kind of block, how long that block is, and
by the marks (words of class, id and role) of the elements around it.  These
weights are fitted, as a logistic regression, to labelled pages, which
:func:`labelled_pages` makes by rule.  One linear scan finds the contiguous
region with the greatest sum, and the blocks in it are the main text.

Three things are taken out before the scan and count as one tag: elements that
are never main text (:data:`SKIPPED`: navigation, page footer, asides, fields,
scripts and the like); forms and page headers (:data:`DOUBTFUL`), but for a form
that holds the page's heading, article or half of its words, as when all of a
page stands in one, and a header that holds the page's only heading of the first
rank, unless that is a link; and marked elements whose own words sum to less than
nothing, so that an advert does not part an article in two.  A mark alone removes
nothing, and what holds a page's heading or article and half of its words is not
judged by its marks.  In an article that has more words in links than others, the
links are what it is about and don't speak against it.  If nothing scores above
zero, the region is all that is left.

Blocks: white space inside one becomes a single blank, character references are
decoded where they stand, blocks are joined by two line breaks.  `<br>` is
white space.

Defined results: a null, empty or text-less page gives the empty string.
Repeated rows each get a row.  An empty table gives no rows.  Very long pages
are read whole; every step is one pass, and the work per tag does not depend on
how many elements are open.  Broken markup: an unclosed element ends with its
parent, a block ends an open paragraph, an end tag without a start is ignored,
a quote that is never closed ends with the tag, a tag that is never closed ends
the page.  Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[^\s/>]+")
_PLAIN = re.compile(r"""[^>"']*""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: elements without content, and elements whose content is not markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
#: elements that start and end a block of text
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select".split()
)
#: elements that are never main text, and those that hardly ever are (`header` outside an article)
SKIPPED = frozenset("head nav footer aside button select label fieldset svg canvas audio video object".split())
DOUBTFUL = frozenset("form header".split())
MAIN = frozenset("article main".split())
#: elements that a new one of their kind ends, those that an inline end tag does not reach beyond, and those that an article ends
SIBLING = frozenset("li td th tr dt dd option".split())
SCOPE = frozenset("table td article main".split())
LISTS = frozenset("nav ul ol header menu head".split())
LENGTHS = (3, 8, 14, 24)


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(from, to, name, attributes, closing) of each tag, and of comments and the like with an empty name, in one forward pass."""
    last = {q: page.rfind(q) for q in "\"'"}
    at, n = 0, len(page)
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        head = lt + 1 + closing
        if page[head : head + 1].isascii() and page[head : head + 1].isalpha():
            name = _NAME.match(page, head)
            i = start = name.end()
            while True:
                i = _PLAIN.match(page, i).end()
                if i >= n or page[i] == ">":
                    break
                j = i - 1
                while page[j].isspace():
                    j -= 1
                if page[j] != "=":  # a quote that opens no value
                    i += 1
                elif last[page[i]] > i:
                    i = page.find(page[i], i + 1) + 1
                else:
                    i = page.find(">", i) if page.find(">", i) >= 0 else n
            at = min(i + 1, n)
            if i < n:
                yield lt, at, name[0].lower(), page[start:i], closing
            else:
                yield lt, n, "", "", False
        elif after in ("!", "?") or closing and page[head : head + 1]:
            ends = ("-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">")
            end = page.find(ends, lt + 2)
            at = end + len(ends) if end >= 0 else n
            yield lt, at, "", "", False
        else:
            at = lt + 1


def marks(attributes: str) -> list[str]:
    """Words of class, id, role and the like, parted at dashes and capitals; `hidden` for what is not shown."""
    out = []
    for _, value in _ATTRIBUTE.findall(attributes):
        out += [x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value.strip("\"'")).lower()) if x]
    if _UNSEEN.search(attributes) or _HIDDEN.search(_QUOTED.sub("", attributes)):
        out.append("hidden")
    return sorted(set(out))


@dataclass(slots=True)
class Element:
    parent: int
    marks: Sequence[str]
    first: int  # events from `first` up to `last` stand in it
    last: int = -1
    head: bool = False  # a heading or an article stands in it
    name: str = ""  # of a doubtful element, an article or the like


@dataclass(slots=True)
class Event:
    """A tag (`text` is None; `br` is a blank), or the text between two tags."""

    kind: str  # a tag's name, or the kind of block that the text stands in
    text: str | None
    block: int
    element: int
    link: bool
    at: int
    words: int = 0


def events(page: str) -> tuple[list[Event], list[Element]]:
    """The page without skipped elements (one event each), and its marked elements; element 0 is the page."""
    out: list[Event] = []
    elements = [Element(-1, (), 0)]
    stack: list[tuple[str, bool, int]] = []  # name, whether it is skipped, the marked element around it before
    blocks: list[int] = []  # places of blocks in the stack
    open_: Counter = Counter()  # open elements by name
    scopes: list[tuple[int, Counter]] = [(0, Counter())]  # of each open scope: its place, and the inline elements open in it
    apart = mains = lists = 0
    block, here = 0, 0
    at = skip_to = 0

    def pop(to: int) -> None:
        nonlocal apart, mains, lists, here
        while len(stack) > to:
            name, skipped, before = stack.pop()
            apart -= skipped
            mains -= name in MAIN
            lists -= name in LISTS
            open_[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if len(scopes) > 1 and scopes[-1][0] == len(stack):
                scopes.pop()
            elif name not in BLOCK:
                scopes[-1][1][name] -= 1
            if before != here:
                elements[here].last = len(out)
                here = before

    def find(name: str) -> int:
        k = len(stack) - 1
        while stack[k][0] != name:
            k -= 1
        return k

    def add(start: int, end: int) -> None:
        if start < end and not apart:
            text = html.unescape(page[start:end])
            if words := len(text.split()):
                kind = stack[blocks[-1]][0] if blocks else "body"
                out.append(Event(kind, text, block, here, open_["a"] > 0, start, words))
            elif out and out[-1].text is not None and out[-1].block == block:
                out.append(Event("br", " ", block, here, False, start))

    for lt, end, name, attributes, closing in tags(page):
        if lt < skip_to:
            continue
        add(at, lt)
        at = end
        if not name:
            continue
        if closing:
            if name in BLOCK:
                block += 1
                if not apart:
                    out.append(Event("/" + name, None, block, here, False, lt))
                if open_[name] > 0:
                    pop(find(name))
            elif scopes[-1][1][name] > 0:
                pop(find(name))
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, end)
                at = skip_to = close.end() if close else len(page)
            continue
        if name == "br":
            if not apart:
                out.append(Event("br", " ", block, here, False, lt))
            continue
        if name in BLOCK:
            block += 1
            if blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] == name and name in SIBLING):  # a block ends an open paragraph, an item the one before
                pop(blocks[-1])
            if name in MAIN and lists:  # an article is never part of a menu that was left open
                pop(next(k for k, x in enumerate(stack) if x[0] in LISTS))
        elif name == "a" and scopes[-1][1]["a"] > 0:
            pop(find("a"))
        skipped = name in SKIPPED
        doubtful = name == "form" or name == "header" and not mains
        if not apart:
            out.append(Event(name, None, block, here, False, lt))
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        found = marks(attributes) if attributes and not attributes.isspace() and not apart else []
        stack.append((name, skipped, here))
        if not apart and not skipped and (found or doubtful or name in MAIN):
            elements.append(Element(here, found, len(out), name=name if doubtful or name in MAIN else ""))
            here = len(elements) - 1
        if name in BLOCK:
            blocks.append(len(stack) - 1)
        if name in SCOPE:
            scopes.append((len(stack) - 1, Counter()))
        elif name not in BLOCK:
            scopes[-1][1][name] += 1
        if not apart and (name == "h1" or name in MAIN):
            elements[here].head = True
        apart += skipped
        mains += name in MAIN
        lists += name in LISTS
        open_[name] += 1
    add(at, len(page))
    pop(0)
    elements[0].last = len(out)
    for k in range(len(elements) - 1, 0, -1):
        elements[elements[k].parent].head |= elements[k].head
    return out, elements


def _blocks(made: list[Event]) -> dict[int, list[str]]:
    """Features of each block: how long it is, whether it ends like a sentence, whether it has a copyright sign."""
    words: Counter = Counter()
    ended, signed = {}, set()
    for e in made:
        if e.words:
            words[e.block] += e.words
            ended[e.block] = e.text.rstrip()[-1:] in ".!?:;\"'”»…)"
            if "©" in e.text:
                signed.add(e.block)
    return {b: [f"length:{bisect_right(LENGTHS, n - 1)}", *(["ended"] if ended[b] else []), *(["©"] if b in signed else [])] for b, n in words.items()}


def features(e: Event, block: list[str], link: bool | None = None) -> list[str]:
    """What tells main text from other text, apart from marks."""
    return ["word", "in:" + e.kind, *block, *(["link"] if (e.link if link is None else link) else [])]


def doubted(made: list[Event], elements: list[Element]) -> list[bool]:
    """Whether each element is a form or a page header that is taken out."""
    plain = list(accumulate((0 if e.link else e.words for e in made), initial=0))
    headings = [i for i, e in enumerate(made) if e.kind == "h1" and e.words]
    only = len({made[i].block for i in headings}) == 1 and not all(made[i].link for i in headings)
    out = []
    for x in elements:
        if x.name == "form":
            out.append(not x.head and 2 * (plain[x.last] - plain[x.first]) < plain[-1])
        else:
            out.append(x.name == "header" and not (only and x.first <= headings[0] < x.last))
    return out


def of_links(made: list[Event], elements: list[Element]) -> list[bool]:
    """Whether each event stands in an article that has more words in links than others, its headings aside."""
    words = lambda wanted: list(accumulate((e.words if e.words and e.kind[:1] != "h" and e.link == wanted else 0 for e in made), initial=0))
    linked, plain = words(True), words(False)
    out = [False] * len(made)
    for x in elements:
        if x.name == "article" and x.head and linked[x.last] - linked[x.first] > plain[x.last] - plain[x.first]:
            out[x.first : x.last] = [True] * (x.last - x.first)
    return out


#: what the labelled pages are made of: (wrapper, whether its content is main text, marks that such wrappers have; '' for none)
SYLLABLES = "ba be bri co da den el fa gor hi in ka lem lo mar men ner no or pa quer ra ri sa sel ta ten tor un va ver wil".split()
CONTENT = "post entry article story content body text main blog news page hentry prose document chapter".split()
ADVERT = "ad ads advert advertisement advertising banner sponsor sponsored promo promotion promoted".split()
SIDE = "sidebar side rail widget related recommended aside complementary trending popular".split()
NOTICE = "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login disclaimer alert".split()
COMMENT = "comment comments commentlist respond reply replies discussion disqus".split()
MENU = "menu menubar nav navbar navigation breadcrumb breadcrumbs toc tags toolbar share sharing social pagination pager skip search searchbox".split()
BOTTOM = "footer foot copyright contentinfo masthead hidden".split()


def labelled_pages(pages: int = 300, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Pages as pieces of markup in order, each with whether its words are main text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    sentence = lambda a, b: phrase(a, b).capitalize() + rnd.choice((".", ".", ".", ".", "!", "?", "", ""))
    prose = lambda: " ".join(sentence(3, 18) for _ in range(rnd.choice((1, 1, 2, 4, 8))))
    link = lambda a=1, b=3: f"<a href='/{word()}'>{phrase(a, b)}</a>"

    def open_div(kinds: Sequence[str], plain: float, names: str = "div div section") -> str:
        if rnd.random() < plain:
            return "<div>"
        mark = rnd.choice(kinds) + rnd.choice(("", "", "-" + rnd.choice(("box", "area", "wrap", "1", "top", "item"))))
        return f"<{rnd.choice(names.split())} {rnd.choice(('class', 'class', 'id'))}='{mark}'>"

    def close(opened: str) -> str:
        return f"</{_NAME.match(opened, 1)[0]}>"

    def wrapped(opened: str, inner: str) -> str:
        return opened + inner + close(opened)

    def menu() -> str:
        items = [link() for _ in range(rnd.randint(2, 10))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rnd.random() < 0.6 else rnd.choice((" ", " | ", "<br>")).join(items)
        return wrapped(open_div(MENU, 0.4), rnd.choice(("", "", f"<span>{phrase(1, 2)}</span>", f"<h3>{phrase(1, 2)}</h3>")) + inner)

    def advert() -> str:
        if rnd.random() < 0.4:
            return wrapped("<div>", " ".join(sentence(2, 7) for _ in range(rnd.randint(1, 2))))
        return wrapped(open_div(ADVERT, 0), rnd.choice((sentence(3, 12), f"<p>{sentence(3, 14)}</p>", f"<p>{prose()}</p>", f"<h3>{phrase(2, 4)}</h3><p>{sentence(4, 9)}</p>{link()}", f"<a href='/x'>{phrase(2, 8)}</a>")))

    def side() -> str:
        body = rnd.choice((f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>", "<ul>" + "".join(f"<li>{link(2, 7)}</li>" for _ in range(rnd.randint(2, 6))) + "</ul>", f"<p>{sentence(4, 16)}</p>", f"<p>{sentence(4, 12)}</p><p>{link(2, 6)}</p>"))
        return wrapped(open_div(SIDE, 0), f"<h3>{phrase(1, 4)}</h3>" + body)

    def notice() -> str:
        return wrapped(open_div(NOTICE, 0), rnd.choice(("<p>{}</p>", "{}", "<span>{}</span>", "<div>{}</div>")).format(rnd.choice((sentence(6, 24), prose(), prose()))) + rnd.choice(("", link())))

    def comments() -> str:
        each = "".join(wrapped(open_div(COMMENT, 0.2, "div div li"), f"<span>{word()}</span><p>{prose()}</p>") for _ in range(rnd.randint(1, 6)))
        return wrapped(open_div(COMMENT, 0), f"<h3>{phrase(1, 3)}</h3>" + each)

    def bottom() -> str:
        return wrapped(open_div(BOTTOM, 0.5), rnd.choice((f"&copy; {word()}.{word()} &middot; {sentence(2, 9)} {sentence(1, 5)}", f"<p>&copy; {phrase(3, 8)}</p>", f"<span>{phrase(2, 6)}</span> {link()}", f"{link()} {link()} {phrase(2, 4)}")))

    def story() -> list[tuple[str, bool]]:
        pieces = [(rnd.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>")).format(phrase(2, 10)), True)]
        style = rnd.choice(("p", "p", "p", "br", "div"))
        for _ in range(rnd.choice((2, 4, 8, 14))):
            kind = rnd.random()
            text = prose() if rnd.random() < 0.8 else rnd.choice((sentence, phrase))(1, 3)
            if rnd.random() < 0.25:
                text = text.replace(" ", f" <a href='/{word()}'>{phrase(1, 3)}</a> ", 1)
            if kind < 0.08:
                text = f"<h2>{phrase(1, 6)}</h2>"
            elif kind < 0.16:
                text = "<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
            elif kind < 0.2:
                text = f"<blockquote>{prose()}</blockquote>"
            elif kind < 0.23:
                text = "<table>" + "".join(f"<tr><td>{phrase(1, 3)}</td><td>{phrase(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
            else:
                text = {"p": f"<p>{text}</p>", "br": f"{prose()}<br><br>", "div": f"<div>{prose()} {prose()}</div>"}[style]
            pieces.append((text, True))
            if rnd.random() < 0.06:
                pieces.append((rnd.choice((advert, side))() if rnd.random() < 0.8 else notice(), False))
        return pieces

    out = []
    for _ in range(pages):
        page = [(x(), False) for x in (menu, menu, notice, advert, side) if rnd.random() < 0.5]
        outer = rnd.choice(("<article>", "<main>", "<div>", "<div>", "<td>", open_div(CONTENT, 0), open_div(CONTENT, 0), open_div(CONTENT, 0)))
        page += [(outer, True), *story(), (close(outer), True)]
        out.append(page + [(x(), False) for x in (menu, advert, side, comments, notice, bottom) if rnd.random() < 0.5])
    return out


#: bounds of a word's score, of what all marks around it add to it, and of a tag's score
MOST, MOST_MARKS, LEAST_TAG = 3.0, 20.0, -2.0
DECAY = 4e-6


@cache
def weights() -> dict[str, float]:
    """Weight of each feature of a word (logistic regression, words counted once each) and of each tag (log odds, kept below zero)."""
    tag = (Counter(), Counter())
    seen: Counter = Counter()  # (features, whether main) -> words
    for page in labelled_pages():
        starts = list(accumulate((len(x) for x, _ in page), initial=0))
        made, elements = events("".join(x for x, _ in page))
        blocks = _blocks(made)
        for e in made:
            main = page[bisect_right(starts, e.at) - 1][1]
            if e.text is None:
                tag[main][e.kind] += 1
            elif e.words:
                found, k = features(e, blocks[e.block]), e.element
                while k > 0:
                    found += ["mark:" + m for m in elements[k].marks]
                    k = elements[k].parent
                seen[tuple(sorted(found)), main] += min(e.words, 20)
    names = sorted({f for found, _ in seen for f in found})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(seen), len(names)))
    for i, (found, _) in enumerate(seen):
        np.add.at(x[i], [at[f] for f in found], 1)
    y, c = np.array([float(main) for _, main in seen]), np.array(list(seen.values()), float)
    c = np.where(y > 0, c / c[y > 0].sum(), c / c[y == 0].sum())
    w = np.zeros(len(names))
    for _ in range(15):  # Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + DECAY * np.eye(len(w)), x.T @ (c * (p - y)) + DECAY * w)
    size = [sum(t.values()) for t in tag]
    odds = {k: math.log((tag[1][k] + 1) / size[1] * size[0] / (tag[0][k] + 1)) for k in {*tag[0], *tag[1]}}
    return dict(zip(names, w.tolist(), strict=True)) | {"tag:" + k: max(LEAST_TAG, min(-0.05, v)) for k, v in odds.items()}


#: score of a tag that no labelled page has
OTHER_TAG = -0.3


def best_region(scores: Sequence[float]) -> tuple[int, int]:
    """(from, to) of the contiguous run with the greatest sum, the first of equals; (0, 0) if none is positive."""
    best, run, start, region = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


def scored(made: list[Event], elements: list[Element], weight: dict[str, float]) -> tuple[list[float], list[bool]]:
    """(score, whether it is cut out) of each event."""
    blocks, out_of_doubt, about_links = _blocks(made), doubted(made, elements), of_links(made, elements)
    plain = list(accumulate((0 if e.link else e.words for e in made), initial=0))
    own, around = [0.0], [0.0]
    for x in elements[1:]:
        held = sum(weight.get("mark:" + m, 0.0) for m in x.marks)
        if x.head and 2 * (plain[x.last] - plain[x.first]) >= plain[-1]:
            held = max(0.0, held)
        own.append(held)
        around.append(min(MOST_MARKS, max(-MOST_MARKS, around[x.parent] + held)))
    scores = []
    for e, listed in zip(made, about_links, strict=True):
        if e.words:
            scores.append(e.words * max(-MOST, min(MOST, around[e.element] + sum(weight.get(f, 0.0) for f in features(e, blocks[e.block], e.link and not listed)))))
        else:
            scores.append(0.0 if e.text else weight.get("tag:" + e.kind, OTHER_TAG))
    total = list(accumulate((s if e.words else 0.0 for s, e in zip(scores, made, strict=True)), initial=0.0))
    cut, upto = [False] * len(made), 0
    for x, held, doubt in zip(elements, own, out_of_doubt, strict=True):
        if x.first >= upto and (doubt or held < 0 and total[x.last] - total[x.first] < 0):
            for i in range(x.first, x.last):
                scores[i], cut[i] = 0.0, True
            upto = x.last
    return scores, cut


def main_text(page: str | None, weight: dict[str, float] | None = None) -> str:
    if not page:
        return ""
    weight = weights() if weight is None else weight
    made, elements = events(page)
    scores, cut = scored(made, elements, weight)
    if not any(e.words and not c for e, c in zip(made, cut, strict=True)):  # marks speak against all that there is
        scores, cut = scored(made, elements, {k: v for k, v in weight.items() if not k.startswith("mark:")})
    a, b = best_region(scores)
    if a == b:
        a, b = 0, len(made)
    first, last = (made[a].block, made[b - 1].block) if made else (0, 0)
    blocks: list[tuple[int, list[str]]] = []
    for e, c in zip(made, cut, strict=True):
        if e.text is not None and not c and first <= e.block <= last:
            if not blocks or blocks[-1][0] != e.block:
                blocks.append((e.block, []))
            blocks[-1][1].append(e.text)
    texts = (" ".join("".join(x).split()) for _, x in blocks)
    return "\n\n".join(t for t in texts if t)


_SCHEMA = "page_id long, url string, text string, n_chars long"


def _extracted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x.as_py(), weight) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(weights())), _SCHEMA)
