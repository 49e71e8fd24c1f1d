"""Segments of text of an HTML page, with what its markup says of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Elements that are never part of an article's text, whatever stands around them.
NEVER = frozenset("audio button canvas datalist dialog embed head iframe input map math meter noembed noframes noscript object optgroup option progress script select style svg template textarea title video xmp".split())
#: An element that opens closes an open one of these, up to the nearest of the scopes.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset("tr table".split())), "th": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])), "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])), "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset(["html"])),
}
ENDS_P = BLOCK - frozenset("body caption frameset head html legend noscript optgroup option select tbody td template tfoot th thead tr".split())

# Log odds that text inside is the article's, by element, role and word of class or id.
TAG_COST = {"article": 4.0, "main": 4.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -10.0, "fieldset": -8.0, "menu": -10.0, "search": -10.0, "header": -10.0}
ROLE_COST = {"main": 4.0, "article": 4.0, "navigation": -12.0, "banner": -10.0, "contentinfo": -12.0, "complementary": -12.0, "search": -10.0, "form": -10.0, "dialog": -12.0, "alertdialog": -12.0, "alert": -10.0, "menu": -10.0, "menubar": -10.0, "toolbar": -10.0}
GOOD_NAMES = frozenset("article articlebody body content entry hentry main post prose story text".split())
BAD_NAMES = frozenset(
    "ad ads adsbygoogle adslot advert advertisement advertising adverts affiliate alert alerts announcement aside author-box banner banners bottombar breadcrumb breadcrumbs byline-social consent cookie cookies copyright "
    "disclaimer donate donation dropdown footer footnav form gdpr global-nav header hero-nav hidden infobar leaderboard leftnav legal login masthead menu menus message-bar mobilenav modal mpu nav navbar navigation "
    "navmenu newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup popover promo promoted promos promotion rail recommend recommendation recommendations recommended related "
    "rightnav search searchbox share sharebar sharing sidebar sidebars sidenav signin signup sitemap skip skyscraper social sponsor sponsored sponsors subnav subscribe subscription taboola ticker toc toolbar "
    "topbar topnav trending upsell warning widget widgets".split()
)
COMMENT_NAMES = frozenset("comment comments commentarea commentform commentlist commenters commentsection disqus guestbook livefyre replies reply respond usercomments".split())
BAD, GOOD, COMMENT = -8.0, 2.0, -12.0
#: Text outside a page's article or main element.
OUTSIDE = -4.0
NEVER_COST = -60.0

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>\"']++))?+")
_NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text as written, open and close tags; comments, declarations and the inside of raw elements are skipped.

    One pass: a quote that is never closed counts as any other character, and is looked for once."""
    at, n, unclosed = 0, len(html), set()
    while at < n:
        found = _OPEN.search(html, at)
        if not found:
            yield "text", html[at:], ""
            return
        if found.start() > at:
            yield "text", html[at : found.start()], ""
        here = found.end()
        comment, slash, name = found.groups()
        if comment:
            short = html.startswith((">", "->"), here)
            end = html.find(">", here) if short else html.find("-->", here)
            at = n if end < 0 else end + (1 if short else 3)
            continue
        if name is None:
            end = html.find(">", here)
            at = n if end < 0 else end + 1
            continue
        stop = here
        while True:
            if html.startswith(">", stop):
                stop += 1
                break
            mark = _STOP.search(html, stop)
            if not mark:
                return  # a tag cut off at the end of the page
            stop = mark.end()
            if mark[0] == ">":
                break
            if mark[0] not in unclosed and html[max(here, mark.start() - 9) : mark.start()].rstrip().endswith("="):
                end = html.find(mark[0], stop)
                if end < 0:
                    unclosed.add(mark[0])
                else:
                    stop = end + 1
        name = name.lower()
        at = stop
        yield ("close" if slash else "open"), name, html[here : stop - 1]
        if not slash and name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.start() if end else n


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    return out


def names_of(text: str) -> set[str]:
    """The words of class and id: whole, and in parts at dashes, underscores, digits and changes of case."""
    return set(re.split(r"\s+", text.lower())) | {w.lower() for w in _NAME.findall(text)}


@dataclass(slots=True)
class Element:
    """An element: its parent's number, the log odds of its own markup, and what is inside."""

    name: str
    parent: int
    good: float = 0.0
    #: bad counts wherever it stands, soft only where the element isn't a wrapper of the article
    bad: float = 0.0
    soft: float = 0.0
    #: soft comes from being a header, of the page or of an article
    header: bool = False
    comment: bool = False
    #: the nearest element around, or itself, that inline text is judged by
    said: int = 0
    root: bool = False
    words: int = 0
    has_main: bool = False
    has_article: bool = False
    has_h1: bool = False
    inside: float = 0.0
    inline: dict[str, int] = field(default_factory=dict)


def judged(name: str, parent: int, text: str) -> Element:
    """An element with what its name and attributes say."""
    e = Element(name, parent, root=name in ("article", "main"))
    if name in NEVER:
        e.bad = NEVER_COST
    cost = TAG_COST.get(name, 0.0)
    if not cost and not text and name != "h1":
        return e
    if text and not text.isspace():
        a = attributes(text)
        if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
            e.bad = NEVER_COST
        role = a.get("role", "").strip().lower()
        cost = min(cost, ROLE_COST.get(role, 0.0)) or max(cost, ROLE_COST.get(role, 0.0))
        e.root |= role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
        named = names_of(f"{a.get('class', '')} {a.get('id', '')} {a.get('itemtype', '').rpartition('/')[2]}") if name not in ("html", "body") else set()
        if named & COMMENT_NAMES:
            e.comment, e.soft = True, COMMENT
        bad = named & BAD_NAMES
        if named & GOOD_NAMES:
            e.good = GOOD
            bad -= {"header"}  # an article's own
        if bad:
            e.header, e.soft = bad == {"header"} and not e.comment, min(e.soft, BAD)
        e.has_main = role == "main"
    if e.root:
        e.good = max(e.good, 4.0)
    if cost < 0:
        if name in ("nav", "footer", "aside"):
            e.bad += cost
        else:
            e.header = name == "header" and (e.header or not e.soft)
            e.soft = min(e.soft, cost)
    e.has_main |= name == "main"
    e.has_article = name == "article" or e.root
    e.has_h1 = name == "h1"
    return e


@dataclass(slots=True)
class Segment:
    """A run of text of one block under one judgement."""

    block: int
    parent: int
    #: shape: kind of block, words, share of words in links, whether it ends as sentences do
    kind: str
    text: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    #: steps from the segment before, by way of the element that holds both
    steps: int = 0
    evidence: float = 0.0

    def shape(self) -> str:
        size = sum(self.words > bound for bound in (2, 5, 14, 39))
        links = 0 if not self.linked else 1 if 2 * self.linked <= self.words else 2
        ends = "".join(self.text).rstrip()[-1:] in tuple(".!?:;\"”’»…。！？")
        return f"{self.kind}|{size}|{links}|{int(ends)}"


SEGMENT_KINDS = ("heading", "p", "item", "cell", "other")


def _kind(name: str) -> str:
    return "heading" if name in HEADINGS else name if name == "p" else "item" if name in ("li", "dd", "dt") else "cell" if name in ("td", "th", "caption") else "other"


class _Page:
    """Elements and segments of one page, built in one pass over its tokens."""

    def __init__(self) -> None:
        self.elements = [Element("", -1)]
        self.stack = [0]
        self.count: dict[str, int] = {}
        self.blocks: list[int] = [0]  # open block elements
        self.links = 0
        self.segments: list[Segment] = []
        self.block, self.fresh, self.low, self.before = 0, True, 1, 1
        self.said = 0  # the element that the open segment is judged by

    def push(self, name: str, text: str) -> None:
        is_block = name in BLOCK
        if self.count.get("head") and name not in IN_HEAD:
            self.pop_until("head", frozenset())
        if is_block and name in ENDS_P and self.count.get("p"):
            self.pop_until("p", frozenset("button table td th caption".split()))
        if name in CLOSES:
            closing, scope = CLOSES[name]
            while any(self.count.get(c) for c in closing) and (found := self._nearest(closing, scope)) is not None:
                self.pop_to(found)
        e = judged(name, self.stack[-1], text)
        e.said = len(self.elements) if is_block or e.bad or e.soft else self.elements[self.stack[-1]].said
        self.elements.append(e)
        self.stack.append(len(self.elements) - 1)
        self.count[name] = self.count.get(name, 0) + 1
        if is_block:
            self.blocks.append(self.stack[-1])
            self.fresh |= name not in NEVER
        else:
            owner = self.elements[self.blocks[-1]].inline
            owner[name] = owner.get(name, 0) + 1
        self.links += name == "a"

    def _nearest(self, names: frozenset[str], scope: frozenset[str]) -> int | None:
        """Place in blocks of the nearest open block element of these names, None if one of scope is nearer.

        No farther than 64 blocks up: deeper nesting of lists' and tables' parts without their ends isn't written by anyone."""
        for i in range(len(self.blocks) - 1, max(0, len(self.blocks) - 64), -1):
            name = self.elements[self.blocks[i]].name
            if name in names:
                return i
            if name in scope:
                return None
        return None

    def pop_to(self, place: int) -> None:
        """Close the block element at that place of blocks with all inside."""
        target = self.blocks[place]
        while self.stack[-1] != target:
            self.pop()
        self.pop()

    def pop_until(self, name: str, scope: frozenset[str]) -> None:
        found = self._nearest(frozenset([name]), scope)
        if found is not None:
            self.pop_to(found)

    def pop(self) -> None:
        e = self.elements[self.stack.pop()]
        self.count[e.name] -= 1
        if e.name in BLOCK:
            self.blocks.pop()
            self.fresh |= e.name not in NEVER
        else:
            self.elements[self.blocks[-1]].inline[e.name] -= 1
        self.links -= e.name == "a"
        self.low = min(self.low, len(self.stack))

    def close(self, name: str) -> None:
        if not self.count.get(name):
            self.fresh |= name in BLOCK and name not in NEVER  # an end without its start parts text all the same
            return
        if name in BLOCK:
            while self.elements[self.stack[-1]].name != name:
                self.pop()
            self.pop()
        elif self.elements[self.blocks[-1]].inline.get(name):
            while self.elements[self.stack[-1]].name != name:
                self.pop()
            self.pop()

    def say(self, text: str) -> None:
        blank = not text or text.isspace()
        if blank and self.fresh:
            return
        own = self.stack[-1]
        if self.fresh or self.elements[own].said != self.said:
            block = self.blocks[-1]
            self.block += self.fresh
            s = Segment(self.block, self.elements[block].parent, _kind(self.elements[block].name))
            s.steps = (self.before - self.low) + (len(self.stack) - self.low)
            s.evidence = float(own)  # the element, until the page has been judged
            self.segments.append(s)
            self.fresh, self.before, self.low = False, len(self.stack), len(self.stack)
            self.said = self.elements[own].said
        s = self.segments[-1]
        s.text.append(text)
        n = 0 if blank else len(text.split())
        s.words += n
        s.linked += n * (self.links > 0)
        self.elements[own].words += n


def segments(html: str) -> list[Segment]:
    """The segments of a page in order, each with evidence: the log odds of the markup around it."""
    page = _Page()
    for kind, name, text in tokens(html):
        if kind == "text":
            page.say(unescape(name) if "&" in name else name)
        elif kind == "close":
            page.close(name)
        elif name == "br":
            page.say(" ")
        elif name in VOID:
            page.fresh |= name == "hr"
        else:
            page.push(name, text)
    elements = page.elements
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.words += e.words * (e.bad > NEVER_COST)
        up.has_main |= e.has_main
        up.has_article |= e.has_article
        up.has_h1 |= e.has_h1
    rooted = [False] * len(elements)
    best = [0.0] * len(elements)
    for i, e in enumerate(elements):
        # a wrapper of the article isn't what its name says
        half = 2 * e.words > elements[0].words
        wraps = e.has_main and e.name != "main" or not e.comment and half and (e.has_h1 or e.has_article) and not e.root
        soft = 0.0 if wraps else e.soft
        if i:
            up = elements[e.parent]
            if e.header and rooted[e.parent]:
                soft = 0.0
            e.inside = max(up.inside + e.bad + soft, NEVER_COST)
            rooted[i] = rooted[e.parent] or e.root
            best[i] = max(best[e.parent], e.good)
    # the article, where the page marks one: an article or main element with words that nothing speaks against
    marked = any(e.root and e.words and e.inside > -4 for e in elements)
    out = []
    for s in page.segments:
        if s.words:
            e = int(s.evidence)
            s.evidence = best[e] + elements[e].inside + (OUTSIDE if marked and not rooted[e] else 0.0)
            out.append(s)
    return out


def text_of(chosen: list[Segment]) -> str:
    """Segments as text: white space of a block is one space, blocks are two line ends apart."""
    blocks: list[list[str]] = []
    last = None
    for s in chosen:
        if s.block != last:
            blocks.append([])
            last = s.block
        blocks[-1] += s.text
    return "\n\n".join(" ".join("".join(b).split()) for b in blocks)
