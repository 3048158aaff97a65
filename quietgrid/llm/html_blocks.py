"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text.  A block's features are its word count and
link density, those of its neighbours, what it stands in (an article, a part of the page's frame such
as a menu, an advert or a form, a list, a heading, a paragraph; and whether the story stands elsewhere), whether it is
the page's first or last, and whether a short text outside the story reads like a notice of rights.  A decision
tree grown from the small labelled table EXAMPLES says which blocks are main text; these are joined in page
order.

An element that is marked as a part of the frame is none where it holds the page's story: the largest
element marked as such or, where nothing is, more than half of the page's words outside links.

Null and empty pages have no blocks and an empty text, empty tables give empty results, and each row is a
page of its own, repeated rows included, so there are no ties; columns other than those named are not read.  The scan of a page
is linear in its length: a tag that never ends makes the rest of the page text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tree

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button head audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME_TAGS = frozenset("nav aside footer form header dialog menu fieldset".split())
FRAME_WORDS = frozenset("ad ads adv advert adverts advertisement adslot alert banner breadcrumb breadcrumbs comment comments cookie cookies consent discussion disqus disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split())
FRAME_STARTS = ("comment", "advert", "sidebar", "cookie", "newsletter", "promo", "breadcrumb", "footer", "navbar", "subscri", "adsense", "adslot", "disqus")
#: Words that may stand beside a frame word in a name without changing what it names.
BESIDE = frozenset("site page post posts entry article content main body top bottom left right upper lower list item items box bar block wrapper wrap container inner outer section area zone slot unit link links button buttons panel group row col column global primary secondary sub mobile desktop sticky text title id js user reader form the widget".split())
#: Parts of the frame that hold texts of their own; an article in them is not the story.
STRONG_TAGS = frozenset("nav aside footer dialog menu".split())
STRONG_STARTS = ("comment", "discussion", "disqus", "repl", "respon", "related", "recommend", "sidebar", "promo", "sponsor", "advert", "footer", "nav")
IN_STORY = frozenset({"header", "tags", "widget"})  # inside the story these name parts of it
STORY_TAGS = frozenset({"article", "main"})
STORY_WORDS = frozenset("article story entry post content main maincontent body text".split())

ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAG_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_PART = re.compile(r"""[>"']""")


class Tags:
    """The tags of a page, one after the other, in one pass over it."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def __iter__(self) -> Iterator[tuple[int, str, bool, str]]:
        """(start of the tag, its name, whether it closes, its attributes); ``at`` is where it ends."""
        page = self.page
        while (start := page.find("<", self.at)) >= 0 and start < self.last[">"]:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                self.at = end + 3 if end >= 0 else len(page)
                yield start, "", False, ""
            elif page.startswith(("<!", "<?"), start):
                self.at = page.find(">", start) + 1
                yield start, "", False, ""
            elif m := TAG_NAME.match(page, start + 1):
                end = self._end(m.end())
                if end < 0:
                    return
                self.at = end + 1
                yield start, m[1].lower(), page[start + 1] == "/", page[m.end() : end]
            else:  # a plain sign
                yield start, "<", False, ""

    def _end(self, at: int) -> int:
        """Where the tag's ``>`` stands, outside of quoted values; -1 if it has none."""
        while m := TAG_PART.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if self.page[at - 2] in "= \t\n\r" and self.last[m[0]] >= at:
                at = self.page.index(m[0], at) + 1
        return -1

    def skip(self, tag: str) -> None:
        """Goes on after the end tag of an element without markup inside."""
        if end := re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, self.at):
            close = self.page.find(">", end.end())
            self.at = close + 1 if close >= 0 else len(self.page)
        elif tag == "head" and (body := re.compile(r"<body\b", re.I).search(self.page, self.at)):
            self.at = body.start()
        else:
            self.at = len(self.page)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    frame: bool
    story: bool
    item: bool
    heading: bool
    paragraph: bool
    label: str = ""


@dataclass
class Element:
    up: int  # the element around it, -1 for none
    tag: str
    frame: int  # 0 no part of the frame, 1 one by its tag or name, 2 one that holds texts of its own
    story: bool
    words: int = 0  # inside it, outside links


def _kind(tag: str, attributes: str, in_story: bool) -> tuple[int, bool]:
    """How far the element is a part of the page's frame, and whether it is marked as the story."""
    frame, story = 2 if tag in STRONG_TAGS else int(tag in FRAME_TAGS), tag in STORY_TAGS
    if attributes and tag not in ("html", "body"):
        if HIDDEN.search(attributes):
            frame = 2
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden":
                frame = 2 if not value or value.lower() == "hidden" else frame
            elif name == "role":
                frame = max(frame, 1 if value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog") else 0)
                story |= value in ("main", "article")
            else:
                for part in value.split():
                    names = {x.lower() for x in NAME.findall(part)}
                    marks = {x for x in names if x in FRAME_WORDS or x.startswith(FRAME_STARTS)}
                    if in_story:
                        marks -= IN_STORY
                    if tag not in STORY_TAGS and marks and names <= marks | BESIDE:
                        frame = max(frame, 2 if any(x.startswith(STRONG_STARTS) for x in marks) else 1)
                    elif names & STORY_WORDS and names <= STORY_WORDS | {"the", "page"}:
                        story = True
    return frame, story


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    of: list[int] = []  # the element of each block
    elements: list[Element] = []
    stack: list[int] = []
    held = Counter()  # open elements by tag
    parts: list[tuple[str, bool]] = []
    links, label, done = 0, "", 0
    tags = Tags(page)

    def flush() -> None:
        nonlocal parts
        text = " ".join("".join(x for x, _ in parts).split())
        if text:
            linked = sum(len(x.split()) for x, in_link in parts if in_link)
            near = [elements[i].tag for i in stack[-3:]]
            heading = bool(near) and re.fullmatch("h[1-6]", near[-1]) is not None
            out.append(Block(text, len(text.split()), linked, False, False, "li" in near, heading, bool(near) and near[-1] in ("p", "blockquote", "pre"), label))
            of.append(stack[-1] if stack else -1)
            if stack:
                elements[stack[-1]].words += max(0, out[-1].words - linked)
        parts = []

    def pop() -> None:
        held[elements[stack.pop()].tag] -= 1

    for start, tag, closing, attributes in tags:
        if start > done:
            parts.append((entities.unescape(page[done:start]), links > 0))
        if tag == "<":
            parts.append(("<", links > 0))
            tags.at = start + 1
        done = tags.at
        if tag == "br":
            parts.append((" ", False))
        elif tag in SKIPPED and not closing:
            if not attributes.rstrip().endswith("/"):
                tags.skip(tag)
                done = tags.at
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if closing:
                while held[tag] and elements[stack[-1]].tag != tag:
                    pop()
                if held[tag]:
                    pop()
            elif tag not in VOID:
                top = elements[stack[-1]].tag if stack else ""
                if top and (top == "p" or top == tag and tag in ("p", "li", "td", "th", "dt", "dd")):
                    pop()
                up = stack[-1] if stack else -1
                in_story = up >= 0 and elements[up].story
                frame, story = _kind(tag, attributes, in_story)
                # a header inside the article is its heading, not the page's
                elements.append(Element(up, tag, 0 if tag == "header" and in_story else frame, story or in_story))
                stack.append(len(elements) - 1)
                held[tag] += 1
                found = re.search(r"data-main=(\d)", attributes)
                label = found[1] if found else label
    if done < len(page):
        parts.append((entities.unescape(page[done:]), links > 0))
    flush()
    _place(out, of, elements)
    return out


def _place(found: list[Block], of: list[int], elements: list[Element]) -> None:
    """Says of each block whether it stands in a part of the frame, and whether in the story."""
    for e in reversed(elements):
        if e.up >= 0:
            elements[e.up].words += e.words
    total = sum(b.words - b.linked for b in found)
    strong: list[bool] = []
    for e in elements:
        strong.append(e.frame == 2 or e.up >= 0 and strong[e.up])
    roots = [i for i, e in enumerate(elements) if e.story and (e.up < 0 or not elements[e.up].story)]
    main = max((i for i in roots if not strong[i]), key=lambda i: elements[i].words, default=-1)
    if main < 0:  # the only story stands in what a name says to be frame
        main = max((i for i in roots if 2 * elements[i].words > total), key=lambda i: elements[i].words, default=-1)
    while main >= 0:
        elements[main].frame = 0
        main = elements[main].up
    if not roots:
        for e in elements:
            if e.frame == 1 and 2 * e.words > total:
                e.frame = 0
    framed: list[bool] = []
    for e in elements:
        framed.append(e.frame > 0 or e.up >= 0 and framed[e.up])
    for b, i in zip(found, of, strict=True):
        b.frame, b.story = (framed[i], elements[i].story) if i >= 0 else (False, False)


FEATURES = ("frame", "story", "elsewhere", "words", "link_density", "before_words", "before_links", "after_words", "after_links", "item", "heading", "paragraph", "notice", "first", "last")
NOTICE = re.compile(r"copyright|©|\(c\) ?\d|all rights|rights reserved|imprint|privacy|cookies?\b|terms of|log ?in|sign (in|up)|menu$|^top$|^back\b|^next$|^contact$|share this", re.I)


def features(found: list[Block]) -> list[list[float]]:
    rows = [(float(b.words), b.linked / max(1, b.words)) for b in found]
    none, any_story = (0.0, 0.0), any(b.story and not b.frame for b in found)
    out = []
    for i, b in enumerate(found):
        before, after = rows[i - 1] if i else none, rows[i + 1] if i + 1 < len(rows) else none
        marks = (b.frame, b.story, any_story and not b.story)
        form = (b.item, b.heading, b.paragraph, not b.story and b.words <= 12 and bool(NOTICE.search(b.text)), i == 0, i + 1 == len(rows))
        out.append([*map(float, marks), *rows[i], *before, *after, *map(float, form)])
    return out


#: The labelled table: blocks of small pages of our own; data-main tells what the blocks from there on are.
EXAMPLES = (
    """<body><div data-main=0 class="menu"><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div>
    <article><h1 data-main=1>Harbour opens</h1><p>The harbour opened on Monday after two years of work on the long quay and the lights.</p><p>Short.</p>
    <p>Boats came in from <a href=/b>three towns</a> and stayed for the night, and the people of the village met them with bread.</p></article>
    <div data-main=0 class="ad">Buy two lamps and pay for one of them only this week in all our shops.</div><footer data-main=0><p>Copyright, all rights reserved by the paper and its owners.</p></footer></body>""",
    """<body><header data-main=0><p>The Daily Sheet</p><a href=/l>Log in</a></header><main><p data-main=1>No.</p><p>A long dry summer left the upper meadows brown, and farmers moved the herds down to the river early.</p>
    <ul><li>Hay is short</li><li>Water holds</li></ul><blockquote>We have seen worse years than this one.</blockquote><section data-main=0 class="comments"><p>I was there and it was not like that at all, believe me, I saw the herds myself.</p><p>Same.</p></section></main>
    <aside data-main=0><h3>Most read</h3><ul><li><a href=/1>Bridge closed again</a></li><li><a href=/2>Market days</a></li></ul></aside></body>""",
    """<body><div data-main=0><a href=/>Start</a> <a href=/m>Map</a></div><div><p data-main=1>The museum keeps four hundred clocks, most of them made in the valley between two wars, and all of them still go.</p>
    <p>Visitors may wind one of the clocks on the first day of a month when the keeper is in the house.</p><p>It costs nothing, but a small gift is welcome at the door of the old mill.</p></div><form data-main=0><p>Your mail address for our letter</p></form>
    <div data-main=0><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body>""",
    """<body><div data-main=0 class="cookie-notice"><p>We use cookies to make this site work better for you and for our partners in trade.</p></div><nav data-main=0><a href=/>Index</a></nav>
    <article><header><h1 data-main=1>On bees</h1></header><p>Bees.</p><p>They fly.</p><p>When the lime trees bloom the hives grow heavy and the keeper takes the honey twice in a month.</p><div data-main=0 class="advert"><p>Honey glasses at half the price in the big shop by the station.</p></div>
    <p data-main=1>In winter the keeper feeds them.</p></article><div data-main=0 class="sidebar"><p>The weather tomorrow will be fair with some clouds in the hills.</p></div></body>""",
    """<body><p data-main=1>There is no frame here at all, only some lines about a walk along the river to the weir and back home.</p><p>The path is wet in spring and the boards are loose, so take good shoes and time.</p></body>""",
    """<body><ul data-main=0><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul><p>Menu</p><div><h2 data-main=1>Old wells</h2><p>Three wells were found under the square when the pipes were laid, and the oldest is lined with oak.</p>
    <p>The town will keep it open under glass so that everybody can look down.</p></div><div data-main=0><p>Share this</p></div></body>""",
    """<article><h1 data-main=1>Snow</h1><p>It fell all night.</p><p><a href=/s>See the pictures of the day</a></p><p>Enough.</p></article>""",
    """<article><p data-main=1>Rain.</p></article>""",
    """<div data-main=0><p>This site may store small files on your machine so that we can count visits and keep you signed in for a month.</p></div><article><h1 data-main=1>Ice</h1><p>The pond froze in one night.</p></article>
    <div data-main=0><h3>Also on this site</h3><p>Ten ways to stack wood so that it dries before the winter comes, told by people who know it well.</p><p>More</p></div>""",
    """<div data-main=0><h2>Win a lamp</h2><p>Tell us in ten words why you need it and send them in by Friday at the latest.</p></div><main><p data-main=1>The bus is late today.</p><p>So is the train.</p></main>""",
    """<main><h2 data-main=1>Two lists</h2><ul><li><a href=/x>First link of the story</a></li><li>Bread</li></ul><table><tr><td>4</td><td>5</td></tr></table><p>End</p></main>""",
    """<div class="entry-content"><p data-main=1>Fog lay on the lake until noon.</p><p>Then it went.</p></div><p data-main=0>All rights reserved</p>""",
    """<p data-main=1>A page without any mark at all can still tell a story in a line or two of plain words.</p><p data-main=0>Imprint</p>""",
    """<p data-main=0><a href=/1>Back</a></p><p><a href=/2>To the list of all things</a></p><p data-main=1>A single plain paragraph stands between two lines of links and is the story here.</p><p data-main=0><a href=/3>Next</a></p><p>Top</p>""",
    # small pages without any mark
    """<body><h1 data-main=1>Thanks</h1><p>Yes.</p></body>""",
    """<body><h1 data-main=1>Closed</h1><p>We come back in May.</p><p data-main=0>Copyright 2019</p></body>""",
    """<p data-main=1>No.</p>""",
    """<body><h2 data-main=1>A note</h2><p>The key is with Anna.</p><p>Ring twice.</p></body>""",
    """<body><div data-main=0><a href=/>Home</a></div><div data-main=1>In the old barn by the river an owl has raised four young ones this year.</div><div>Yes.</div><div data-main=0>Copyright 2018</div></body>""",
    """<body><div data-main=0><a href=/>Start</a></div><div data-main=1>The bell was cast again.</div><div>It rings at noon.</div><div data-main=0>All rights reserved</div></body>""",
    """<body><div data-main=1>The road to the pass is closed until the snow has gone and the walls are mended.</div><div>So it is every year.</div><div>Wait.</div><div data-main=0>(c) 2021 The Pass</div></body>""",
    """<body><h1 data-main=1>List</h1><ul><li>Bread</li><li>Salt</li></ul></body>""",
    """<body><div data-main=0><a href=/1>All</a> <a href=/2>New</a></div><div data-main=0>Log in</div><div data-main=0><a href=/3>Terms of use</a></div></body>""",
    # pages without any mark: length and links of a block and of its neighbours are all there is
    """<div data-main=0><a href=/1>World</a> <a href=/2>Town</a> <a href=/3>Sport today</a> <a href=/4>Weather</a></div><div><a href=/5>All papers of this week</a></div><div data-main=1>The mill by the bridge was sold to three brothers who mean to grind rye there again from the spring on.</div><div>They have found an old stone in the yard and will cut it anew.</div>
    <div>It turns.</div><div data-main=0><a href=/6>Mills of the north</a> <a href=/7>Bread at home</a></div><div><a href=/8>More about rye</a></div><div>Top</div>""",
    """<table data-main=0><tr><td><a href=/a>Front page</a></td><td><a href=/b>Archive of all years</a></td><td>Today</td></tr></table><p data-main=1>After the storm the ferry lay on the sand for two days, and the crew slept in the church until the tide came back.</p><p>Nobody was hurt.</p><p>The captain, who has sailed that line for thirty years, said that he had never seen the water fall so far.</p>
    <p data-main=0><a href=/c>Read on in the archive</a></p><p><a href=/d>Ferry lines</a> and <a href=/e>time tables</a></p>""",
    """<div data-main=0><a href=/x>Home</a></div><div><a href=/y>Letters to us</a></div><div><a href=/z>Shop</a></div><p data-main=1>In the high valley the snow stays until June, so the school keeps skis for every child and the teacher goes ahead with a lamp.</p><p>See also what <a href=/k>the teacher wrote</a> about the long winter of that year and the wolves that came down to the barns.</p><p>All came home.</p>
    <div data-main=0><a href=/q>Schools</a> | <a href=/r>Snow</a> | <a href=/s>Wolves</a></div><div><a href=/t>Next page</a></div>""",
    """<div data-main=0>Menu</div><div><a href=/1>Start here</a></div><div><a href=/2>What we do</a></div><h2 data-main=1>The well</h2><p>For eight weeks no rain fell on the farms along the upper road, and people went with carts to the well behind the chapel.</p><p>Then it rained.</p><div data-main=0><a href=/3>Rain tables</a></div><div>Contact</div><div><a href=/4>Imprint and rights</a></div>""",
    """<p data-main=0><a href=/1>One</a> <a href=/2>Two</a></p><p data-main=1>The clock in the tower has been wrong since the lightning, and the two bakers of the square open by the sun.</p><p>One of them wants it so.</p><p data-main=0><a href=/3>Clocks</a> <a href=/4>Bakers</a> <a href=/5>Storms and lightning</a></p>""",
)


@cache
def classifier() -> tree.Node:
    found = [blocks(x) for x in EXAMPLES]
    x = np.array([r for f in found for r in features(f)])
    y = np.array([float(b.label == "1") for f in found for b in f])
    return tree.grow(x, y, depth=7, least=2)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if tree.share(classifier(), row) >= 0.5)


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars of each page."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return pages.select(*keep, html_col).mapInArrow(run, schema)
